"""Feeds: JSON records, JSON columns, RSS and Atom; fetched from public addresses alone."""

from __future__ import annotations

import hashlib
import http.client
import ipaddress
import json
import socket
import ssl
import time
import urllib.parse
import xml.etree.ElementTree as ET
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class SourceError(ValueError):
    """A feed that can't be fetched or read."""


#: Prefixes that carry an IPv4 address in their last 32 bits. Fixed values.
_CARRIERS = ("::ffff:0:0/96", "64:ff9b::/96", "64:ff9b:1::/48")


def is_public(address: str) -> bool:
    """Whether an address is globally reachable, and the IPv4 address it may carry too."""
    ip = ipaddress.ip_address(address)
    if ip.version == 6 and any(ip in ipaddress.ip_network(n) for n in _CARRIERS):
        return is_public(str(ipaddress.IPv4Address(int(ip) & 0xFFFFFFFF)))
    return ip.is_global and not (ip.is_multicast or ip.is_reserved or ip.is_unspecified)


def public_address(url: str, resolve: Callable = socket.getaddrinfo) -> tuple[urllib.parse.SplitResult, str]:
    """The parsed URL and an address of its host; every address of the host must be public."""
    parts = urllib.parse.urlsplit(url)
    if parts.scheme not in ("http", "https") or not parts.hostname or parts.username or parts.password:
        raise SourceError(f"only plain http and https URLs are fetched, not {url!r}")
    try:
        found = [x[4][0] for x in resolve(parts.hostname, parts.port or (443 if parts.scheme == "https" else 80), type=socket.SOCK_STREAM)]
    except OSError as e:
        raise SourceError(f"{parts.hostname} can't be resolved: {e}") from None
    if not found or not all(map(is_public, found)):
        raise SourceError(f"{parts.hostname} isn't a public address")
    return parts, found[0]


@dataclass
class Fetched:
    body: bytes | None
    etag: str | None = None
    last_modified: str | None = None
    unchanged: bool = False


def fetch(url: str, max_bytes: int = 5 << 20, wall_clock: float = 60, connect: float = 10, read: float = 30, etag: str | None = None, last_modified: str | None = None, resolve: Callable = socket.getaddrinfo) -> Fetched:
    """One GET of a validated address; redirects, larger bodies and slower answers raise SourceError."""
    parts, address = public_address(url, resolve)
    began = time.monotonic()
    secure = parts.scheme == "https"
    raw = socket.create_connection((address, parts.port or (443 if secure else 80)), timeout=connect)
    raw = ssl.create_default_context().wrap_socket(raw, server_hostname=parts.hostname) if secure else raw
    raw.settimeout(read)
    link = http.client.HTTPConnection(parts.hostname, timeout=read)
    link.sock = raw
    try:
        asked = {k: v for k, v in (("If-None-Match", etag), ("If-Modified-Since", last_modified)) if v}
        link.request("GET", (parts.path or "/") + (f"?{parts.query}" if parts.query else ""), headers=asked | {"Host": parts.netloc, "Accept-Encoding": "identity"})
        answer = link.getresponse()
        if answer.status == 304:
            return Fetched(None, etag, last_modified, True)
        if answer.status != 200:
            raise SourceError(f"{url} answered {answer.status}")
        held = b""
        while piece := answer.read(65536):
            held += piece
            if len(held) > max_bytes:
                raise SourceError(f"{url} is larger than {max_bytes} bytes")
            if time.monotonic() - began > wall_clock:
                raise SourceError(f"{url} took more than {wall_clock} seconds")
        return Fetched(held, answer.headers.get("ETag"), answer.headers.get("Last-Modified"))
    finally:
        link.close()


def fingerprint(body: bytes) -> str:
    return hashlib.sha256(body).hexdigest()


def leaf(value: object) -> str:
    """A JSON leaf as text: null empty, booleans true and false, numbers as written."""
    return "" if value is None else str(value).lower() if isinstance(value, bool) else value if isinstance(value, str) else json.dumps(value)


def _parsed(raw: bytes) -> object:
    try:
        return json.loads(raw, parse_float=str, parse_int=str, parse_constant=str)
    except ValueError as e:
        raise SourceError(f"not JSON: {e}") from None


def json_records(spark: SparkSession, raw: bytes, field_map: dict[str, str], columnar: str | None = None) -> DataFrame:
    """Fields of an array of flat objects, or of parallel arrays below the dotted path ``columnar``, all text.

    field_map: output column to input field. A feed is bounded by fetch's size limit.
    """
    data = _parsed(raw)
    if columnar is not None:
        for key in filter(None, columnar.split(".")):
            data = data.get(key) if isinstance(data, dict) else None
        arrays = {out: data.get(name) if isinstance(data, dict) else None for out, name in field_map.items()}
        wrong = [n for n, a in arrays.items() if not isinstance(a, list)]
        if wrong:
            raise SourceError(f"no arrays for {', '.join(wrong)}")
        if len({len(a) for a in arrays.values()}) > 1:
            raise SourceError("parallel arrays differ in length: " + ", ".join(f"{n} {len(a)}" for n, a in arrays.items()))
        rows = list(zip(*arrays.values(), strict=True))
    else:
        if not isinstance(data, list) or not all(isinstance(r, dict) for r in data):
            raise SourceError("expected an array of objects")
        rows = [tuple(r.get(name) for name in field_map.values()) for r in data]
    return spark.createDataFrame([tuple(map(leaf, r)) for r in rows], ", ".join(f"`{n}` string" for n in field_map))


#: Up to the next number outside strings, from where the last match ended; a number's own text follows.
BARE_NUMBER = r'\G((?:[^"0-9-]|"[^"\\]*+(?:\\.[^"\\]*+)*+")*+)(-?[0-9][0-9.eE+-]*)'


def map_records(texts: DataFrame, field_map: dict[str, str], value: str = "value") -> DataFrame:
    """json_records() in the plan, for batches and streams: texts that hold an object or an array of objects each, as rows of text.

    Numbers stay as they are written: they are put in quotes before Spark parses them. Nulls and absent fields are empty. A text that is
    neither has no rows; objects and lists in a field stay JSON.
    """
    quoted = F.regexp_replace(F.trim(value), BARE_NUMBER, '$1"$2"')
    many = F.when(quoted.startswith("{"), F.concat(F.lit("["), quoted, F.lit("]"))).when(quoted.startswith("["), quoted)
    wanted = ", ".join(f"`{name}`: string" for name in dict.fromkeys(field_map.values()))
    rows = texts.select(F.explode(F.from_json(many, f"array<struct<{wanted}>>")).alias("x")).filter("x is not null")
    return rows.select(*[F.coalesce(F.col("x")[name], F.lit("")).alias(out) for out, name in field_map.items()])


def zip_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Rows of parallel array columns (output name to array); arrays of different lengths raise an error on the cluster."""
    names = list(columns)
    sizes = [F.size(columns[n]) for n in names]
    equal = F.lit(True)
    for s in sizes[1:]:
        equal = equal & (s == sizes[0])
    zipped = F.when(equal, F.arrays_zip(*[F.col(columns[n]).alias(n) for n in names])).otherwise(F.raise_error(F.lit("parallel arrays differ in length")))
    return df.select(F.explode(zipped).alias("x")).select(*[F.col("x")[n].cast("string").alias(n) for n in names])


#: Default fields of entries. Fixed values.
ENTRY_FIELDS = {"id": "id", "title": "title", "published": "published"}


#: Elements that stand for a field, the first filled one counting. Fixed values.
SAME = {"id": ("id", "guid", "link"), "published": ("published", "pubDate", "updated")}


def map_entries(texts: DataFrame, field_map: dict[str, str] | None = None, value: str = "value") -> DataFrame:
    """rss_records() in the plan, for batches and streams: the items of RSS and the entries of Atom texts, one feed a row, as rows of text.

    A text with a document type or an entity raises an error on the cluster before it is parsed. One that is no XML has no
    rows; absent and empty fields are empty, and a link may stand in its href.
    """
    fields = field_map or ENTRY_FIELDS
    names = list(dict.fromkeys(c for f in fields.values() for c in SAME.get(f, (f,))))
    entry = f"array<struct<{', '.join(f'`{n}`: struct<_VALUE: string, _href: string>' for n in names)}>>"
    safe = F.when(F.col(value).rlike("<!(DOCTYPE|ENTITY)"), F.raise_error(F.lit("document types are not allowed in a feed"))).otherwise(F.col(value))
    parsed = F.from_xml(safe, f"channel struct<item: {entry}>, item {entry}, entry {entry}", {"ignoreNamespace": "true"})
    rows = texts.select(parsed.alias("f")).select(F.explode(F.concat(*[F.coalesce(F.col(c), F.array().cast(entry)) for c in ("f.channel.item", "f.item", "f.entry")])).alias("e"))
    filled = lambda n: F.coalesce(F.nullif(F.trim(F.col("e")[n]["_VALUE"]), F.lit("")), F.nullif(F.col("e")[n]["_href"], F.lit("")))
    return rows.select(*[F.coalesce(*[filled(n) for n in SAME.get(f, (f,))], F.lit("")).alias(out) for out, f in fields.items()])


def rss_records(spark: SparkSession, raw: bytes, field_map: dict[str, str] | None = None) -> DataFrame:
    """Entries of an RSS or Atom feed, all text. Document types are refused."""
    if b"<!DOCTYPE" in raw or b"<!ENTITY" in raw:
        raise SourceError("document types are not allowed in a feed")
    try:
        root = ET.fromstring(raw)
    except ET.ParseError as e:
        raise SourceError(f"not XML: {e}") from None
    def of(entry: ET.Element, name: str) -> str:
        for wanted in SAME.get(name, (name,)):
            for child in entry:
                if child.tag.rpartition("}")[2] == wanted:
                    text = (child.text or "").strip() or child.get("href", "")
                    if text:
                        return text
        return ""

    fields = field_map or ENTRY_FIELDS
    entries = [e for e in root.iter() if e.tag.rpartition("}")[2] in ("item", "entry")]
    return spark.createDataFrame([tuple(of(e, n) for n in fields.values()) for e in entries], ", ".join(f"`{n}` string" for n in fields))
