"""Signed documents as relations: scans of a ledger's folders, canonical bodies, signatures.

A document is JSON whose body is everything but its signature. The body's canonical text (keys by code point, no
white space) is made in the plan, whatever the document holds, and so is its hash. What can't be used keeps a
row with the reason.

Defined results: a text that is no JSON object, repeats a key or holds a fraction or an integer beyond 38 digits
has no canonical body and no hash. A signature that is malformed, or for which there is no key, doesn't hold.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.functions import cells
from tallyline.operators import judge
from tallyline.plans import crypto

#: A string of a JSON text.
STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
#: ISO 8601, in the forms that signed documents carry.
TIME = r"^\d{4}-\d\d-\d\d([T ]\d\d:\d\d(:\d\d(\.\d{1,6})?)?(Z|[+-]\d\d:?\d\d)?)?$"
UNREADABLE, NO_BODY, NO_TIME, FUTURE, UNVERIFIED = "unreadable JSON", "body does not canonicalize", "missing or malformed created_at", "created_at is in the future", "signature does not verify under any trusted key"


def _lower_escapes(json: Column) -> Column:
    """Escapes of control characters with the small hexadecimal letters of canonical text."""
    for letter in "ABCDEF":
        json = F.regexp_replace(json, rf"(?<!\\)((?:\\\\)*)\\u00([01]){letter}", rf"$1\\u00$2{letter.lower()}")
    return json


def body_text(text: Column) -> Column:
    """The canonical body of a document's text, null where there is none."""
    parts = F.from_json(text, "map<string,variant>")
    kept = F.map_entries(F.map_filter(parts, lambda k, _: k != "signature"))
    pairs = F.array_sort(F.transform(kept, lambda e: F.struct(e["key"].alias("key"), F.to_json(e["value"]).alias("json"))))
    joined = F.array_join(F.transform(pairs, lambda p: F.concat(cells.json_leaf(p["key"], T.StringType()), F.lit(":"), p["json"])), ",")
    inexact = F.regexp_replace(text, STRING, "").rlike(r"[0-9][.eE]|[0-9]{39}")
    return F.when(F.try_parse_json(text).isNotNull() & ~inexact & F.ltrim(text, F.lit(" \t\r\n")).startswith("{"), F.concat(F.lit("{"), _lower_escapes(joined), F.lit("}")))


def documents(texts: DataFrame) -> DataFrame:
    """texts (path, value) with kind, created, body, body_hash, signature (null without one) and reason (null if the document can be read)."""
    doc = texts.withColumns({"doc": F.try_parse_json("value"), "body": body_text(F.col("value"))})
    at = lambda path, kind="string": F.try_variant_get("doc", path, kind)
    created = F.when(at("$.created_at").rlike(TIME), F.try_to_timestamp(at("$.created_at")))
    named = doc.withColumns({"kind": at("$.kind"), "created_at": at("$.created_at"), "created": created, "signed": at("$.signature", "variant").isNotNull(), "signature": at("$.signature.value")})
    reason = F.when(F.col("doc").isNull(), UNREADABLE).when(F.col("body").isNull(), NO_BODY)
    return named.select(*texts.columns, "kind", "created_at", "created", "body", F.sha2("body", 256).alias("body_hash"), "signed", "signature", reason.alias("reason"))


def scan(spark: SparkSession, paths: str | Iterable[str]) -> DataFrame:
    """The documents below paths that Hadoop's file systems can read, one a file."""
    files = spark.read.text([paths] if isinstance(paths, str) else list(paths), wholetext=True)
    return documents(files.select(F.col("_metadata.file_path").alias("path"), "value"))


@F.pandas_udf(T.BooleanType())
def _holds(key: pd.Series, message: pd.Series, signature: pd.Series) -> pd.Series:
    return pd.Series(crypto.all_hold(zip(key, message, signature, strict=True)), dtype=bool)


@F.pandas_udf(T.StringType())
def _sign(seed: pd.Series, message: pd.Series) -> pd.Series:
    return pd.Series(crypto.signatures((bytes(s), m.encode()) for s, m in zip(seed, message, strict=True)), dtype=object)


def holds(key: Column, message: Column, signature: Column) -> Column:
    """Whether an Ed25519 signature holds (key and signature in hexadecimal, message a text), checked by the tasks. Anything missing or malformed doesn't."""
    return _holds(key.cast("string"), message.cast("string"), signature.cast("string"))


def sign(seed: Column, message: Column) -> Column:
    """The signature of texts by private keys of 32 bytes, in hexadecimal."""
    return _sign(seed, message)


@F.pandas_udf(T.IntegerType())
def _first_that_holds(keys: pd.Series, message: pd.Series, signature: pd.Series) -> pd.Series:
    """The place of the first of a row's keys under which its signature holds, null if there is none."""
    found: list[int | None] = [None] * len(keys)
    left, place = [n for n, s in enumerate(signature) if s is not None and keys[n] is not None], 0
    while left := [n for n in left if place < len(keys[n])]:
        held = crypto.all_hold((keys[n][place], message[n], signature[n]) for n in left)
        for n, good in zip(left, held, strict=True):
            found[n] = place if good else None
        left, place = [n for n, good in zip(left, held, strict=True) if not good], place + 1
    return pd.Series(found, dtype="Int32")


def signers(receipts: DataFrame, keys: DataFrame) -> DataFrame:
    """receipts (chain, body, signature, ...) with signer: "trusted", "chain" or "none"; keys: chain, key, own (the chain's embedded one).

    A chain's few keys are tried on each of its receipts, the trusted ones first. A key that is both counts as trusted and is tried once.
    """
    once = keys.filter("key is not null and own is not null").groupBy("chain", "key").agg(F.min("own").alias("own"))
    held = once.groupBy("chain").agg(F.sort_array(F.collect_list(F.struct("own", "key"))).alias("held"))
    of = held.select("chain", F.col("held.key").alias("keys of chain"), F.size(F.filter("held", lambda x: ~x["own"])).alias("trusted of chain"))
    tried = receipts.join(of, "chain", "left")
    place = _first_that_holds(F.col("keys of chain"), F.col("body").cast("string"), F.col("signature").cast("string"))
    found = tried.withColumn("place of key", place)
    signer = F.when(F.col("place of key").isNull(), "none").when(F.col("place of key") < F.col("trusted of chain"), "trusted").otherwise("chain")
    return found.select(*[F.col(f"`{c}`") for c in receipts.columns], signer.alias("signer"))


def key_caveats(signed: DataFrame) -> DataFrame:
    """(chain, receipts, caveat) of signers()' rows: chains of which some receipts bear no trusted key, but the chain's embedded one."""
    strange = signed.filter("signer = 'chain'").groupBy("chain").agg(F.count("*").alias("receipts"))
    return strange.withColumn("caveat", F.format_string("unrecognized signing key: %d receipt(s) verify under the chain's embedded key alone", "receipts"))


def usable(scanned: DataFrame, kind: str, trusted: Sequence[str], now: dt.datetime | None = None) -> DataFrame:
    """scanned with a reason for every document that isn't of the kind, bears a signature that none of the keys made or, if now is given, has no time or one in the future."""
    keys = [k for k in trusted if isinstance(k, str) and k]
    good = F.lit(False)
    for key in keys:
        good = good | holds(F.lit(key), F.col("body"), F.col("signature"))
    early = F.coalesce(F.col("reason"), F.when(~F.coalesce(F.col("kind") == kind, F.lit(False)), f"not a {kind}"))
    if now is not None:
        early = F.coalesce(early, F.when(F.col("created").isNull(), NO_TIME).when(F.col("created") > F.lit(now + judge.FUTURE_SKEW), FUTURE))
    # Signatures, which cost most, are checked where nothing else is wrong.
    checked = scanned.withColumn("reason", early)
    bad = checked.filter("reason is not null")
    rest = checked.filter("reason is null")
    unsigned = rest.filter("not signed")
    verified = rest.filter("signed").withColumn("reason", F.when(~good, UNVERIFIED))
    return bad.unionByName(unsigned).unionByName(verified)
