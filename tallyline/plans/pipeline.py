"""Steps that leave receipts: ingest, wrapped transforms, further periods, rebuilds, exports."""

from __future__ import annotations

import functools
import hashlib
import re
import shutil
from collections.abc import Callable
from decimal import Decimal
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.functions import cells, headers
from tallyline.operators import tree
from tallyline.operators.canonical import document_parts, semantic_hash
from tallyline.plans import crypto, files, history, receipts
from tallyline.session import written
from tallyline.sources import readers

BAND, SETTLE = "0.05", "72h"


class UntrustedSigner(ValueError):
    """A period comes under a key that the chain doesn't trust."""


class StaleCandidate(ValueError):
    """The chain moved between judgment and commit."""


class WriteMismatch(RuntimeError):
    """A table reads back otherwise than it was computed."""


class TailMismatch(ValueError):
    """A step's input isn't what the chain's last receipt describes."""


def parse_band(text: str) -> str:
    """A band as plain decimal text in (0, 1]: "5%" and "0.05" alike."""
    raw = text.strip()
    value = cells.python_decimal(raw.removesuffix("%"))
    value = value / 100 if value is not None and raw.endswith("%") else value
    if value is None or not 0 < value <= 1:
        raise ValueError(f"a band is a share above 0 and up to 1, such as 5% or 0.05, not {text!r}")
    out = cells.plain(value)
    if Decimal(out) != value:
        raise ValueError("a band has six decimal places at most")
    return out


def parse_settle(text: str) -> int:
    """Hours of "72h" or "3d"."""
    found = re.fullmatch(r"([0-9]+)([hd])", text.strip().lower())
    if not found:
        raise ValueError(f"a settling window is hours or days, such as 72h or 3d, not {text!r}")
    return int(found[1]) * (24 if found[2] == "d" else 1)


def tolerance(band: str | None, settle: str | None, bucket_column: str | None) -> dict[str, Any] | None:
    if band is None and settle is None:
        return None
    out: dict[str, Any] = {"band": parse_band(band or BAND), "settle_hours": parse_settle(settle or SETTLE)}
    return out | ({"bucket_column": headers.normalise(bucket_column)} if bucket_column else {})


def manifest_of(spark: SparkSession, path: str, seed: bytes, declared_origin: str = "", allowed: dict[str, Any] | None = None, bucket_column: str | None = None, sheet: str | None = None) -> tuple[dict[str, Any], DataFrame]:
    """The signed source manifest of a file, and its table."""
    with open(path, "rb") as file:
        evidence = hashlib.file_digest(file, "sha256").hexdigest()  # in blocks; a source's file lies with the driver
    df = readers.load(spark, path, sheet)
    made = receipts.source_manifest(df, seed, filename=Path(path).name, evidence_hash=evidence, byte_size=Path(path).stat().st_size, declared_origin=declared_origin, semantic_hash=semantic_hash(df), tolerance=allowed, bucket_column=bucket_column)
    return made, df


def keep_prior(folder: str | Path) -> Path | None:
    """Copies the present chain to archive/<tail>."""
    tail = receipts.tail_hash(folder)
    if tail is None:
        return None
    to = Path(folder) / "archive" / tail
    to.mkdir(parents=True, exist_ok=True)
    for name in [receipts.CHAIN, *receipts.receipt_names(folder)]:
        shutil.copyfile(files.inside(folder, name), to / name)
    return to


def ingest(spark: SparkSession, path: str, folder: str | Path, seed: bytes, declared_origin: str = "", band: str | None = None, settle: str | None = None, bucket_column: str | None = None, sheet: str | None = None) -> dict[str, Any]:
    """Starts a chain from a file. Errors in options or data leave an existing chain as it is."""
    allowed = tolerance(band, settle, bucket_column)
    made, _ = manifest_of(spark, path, seed, declared_origin, allowed, bucket_column, sheet)
    with files.locked(folder):
        keep_prior(folder)
        receipts.reset(folder, made, crypto.public_of(seed))
    return made


def _facts(df: DataFrame) -> list[Column]:
    """Rows, nulls by column and an order-free fingerprint: what a write observes and a read can check."""
    cell = lambda f: F.to_json(F.struct(f.name)) if isinstance(f.dataType, (T.MapType, T.VariantType)) else F.col(f.name)
    print_ = F.bit_xor(F.xxhash64(*[cell(f) for f in df.schema.fields])) if df.columns else F.lit(0)
    return [F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in df.columns], print_.alias("fingerprint")]


def evaluated(df: DataFrame, name: str) -> tuple[DataFrame, dict[str, int]]:
    """The table, computed once and written to the shared folder, and what the writing pass observed of it: rows, nulls by column.

    Whatever is asked of the result later reads what was written, so a step that gives other rows each time
    has one output. Raises WriteMismatch if the written table isn't the computed one.
    """
    names = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    plain = plain.select(*[F.col(f.name).cast("string").alias(f.name) if isinstance(f.dataType, T.NullType) else F.col(f.name) for f in plain.schema.fields])
    seen = Observation()
    stored = written(plain.observe(seen, *_facts(plain)), f"step-{re.sub(r'[^A-Za-z0-9_-]', '_', name)}")
    observed = seen.get
    if stored.agg(*_facts(stored)).first().asDict() != observed:
        raise WriteMismatch(f"the output of {name} reads back otherwise than it was computed")
    nulls = {n: observed[f"nulls_c{i}"] for i, n in enumerate(names)}
    return stored.toDF(*names), {"row_count": observed["rows"]} | {f"nulls[{n}]": c for n, c in nulls.items()}


def step(folder: str | Path, seed: bytes, trusted: list[str] | None = None, name: str | None = None, write_table: bool = False, tree_keys: list[str] | None = None, plan_identity: bool = False) -> Callable:
    """Decorates DataFrame -> DataFrame: the chain must verify and end in the input's hash; the output's receipt is appended.

    The function's table is computed once, in the pass that writes it; hash, totals and the caller read what was
    written. tree_keys: also declares the root of the output's content tree by these keys; plan_identity: also the hash of
    the analysed plan, which tells of changed code in helpers that the function's own source doesn't show.
    """

    def wrap(func: Callable[[DataFrame], DataFrame]) -> Callable[[object], DataFrame]:
        @functools.wraps(func)
        def run(data: object) -> DataFrame:
            spark = SparkSession.getActiveSession()
            df = readers.frame(spark, data)
            with files.locked(folder):
                if not receipts.receipt_names(folder):
                    raise TailMismatch(f"no chain in {folder}; ingest a source first")
                result = receipts.verify_folder(spark, folder, trusted)
                if not result.ok:
                    raise TailMismatch("\n".join(result.lines))
                tail = receipts.load_receipts(folder)[-1]
                found = semantic_hash(df)
                if found != receipts.output_hash(tail):
                    raise TailMismatch(f"the input hashes to {receipts.short(found)}, the chain ends in {receipts.short(receipts.output_hash(tail))} ({receipts.stage_name(tail)})")
                asked = readers.frame(spark, func(df))
                planned = {"plan_hash": receipts.plan_hash(asked)} if plan_identity else {}
                out, observed = evaluated(asked, name or func.__name__)
                declared = planned | ({"output_tree": {"kind": tree.KIND, "keys": tree_keys, "root": tree.root(tree.tree(out, tree_keys))}} if tree_keys else {})
                made = receipts.transform_receipt(out, seed, name=name or func.__name__, code_hash=receipts.code_hash(func), code_file=Path(func.__code__.co_filename).name, input_hash=found, output_hash=semantic_hash(out), **declared)
                if receipts.totals_of(made)["row_count"] != observed["row_count"]:
                    raise WriteMismatch(f"the receipt of {made['transform']['name']} counts other rows than the pass that wrote them")
                receipts.append(folder, made, crypto.public_of(seed))
                if write_table:
                    from tallyline.sources.writers import write_document

                    write_document(out, Path(folder) / "table.json")
            return out

        return run

    return wrap


def candidate(spark: SparkSession, path: str, folder: str | Path, seed: bytes, trusted: list[str] | None = None, sheet: str | None = None) -> dict[str, Any]:
    """A further period's manifest under the chain's own tolerance, judged but not committed."""
    return _candidate(spark, folder, seed, trusted, lambda origin, allowed, bucket: manifest_of(spark, path, seed, origin, allowed, bucket, sheet))


def candidate_of(df: DataFrame, filename: str, folder: str | Path, seed: bytes, trusted: list[str] | None = None) -> dict[str, Any]:
    """The same of a table that has no file: its evidence is its canonical document, and the byte size that document's."""

    def made(origin: str, allowed: dict[str, Any] | None, bucket: str | None) -> tuple[dict[str, Any], DataFrame]:
        digest, size = hashlib.sha256(), 0
        for part in document_parts(df):
            digest.update(part)
            size += len(part)
        found = digest.hexdigest()
        return receipts.source_manifest(df, seed, filename=filename, evidence_hash=found, byte_size=size, declared_origin=origin, semantic_hash=found, tolerance=allowed, bucket_column=bucket), df

    return _candidate(df.sparkSession, folder, seed, trusted, made)


def _candidate(spark: SparkSession, folder: str | Path, seed: bytes, trusted: list[str] | None, manifest: Callable) -> dict[str, Any]:
    receipts.recover(folder)
    held = receipts.load_receipts(folder)
    if not held:
        raise TailMismatch(f"no chain in {folder}; ingest a source first")
    public, chain = crypto.public_of(seed), receipts.read_chain(folder)
    keys = trusted or [chain.get("public_key")]
    if public not in keys:
        raise UntrustedSigner(f"key {crypto.fingerprint(public)} isn't among the chain's trusted keys")
    allowed = held[0].get("tolerance")
    bucket = allowed.get("bucket_column") if isinstance(allowed, dict) else None
    made, df = manifest((held[0].get("source") or {}).get("declared_origin", ""), allowed, bucket)
    runs = history.load(folder, spark, keys)
    judged = history.judge_run(spark, [made], None, runs)
    own = any((r.get("source") or {}).get("filename") == made["source"]["filename"] for r in runs)
    return {"manifest": made, "judgment": judged, "own_history": own, "base_tail": receipts.tail_hash(folder), "unchanged": made["semantic_hash"] == held[0].get("semantic_hash"), "committed": held[0], "frame": df}


def commit(spark: SparkSession, folder: str | Path, found: dict[str, Any], seed: bytes) -> None:
    """Makes the candidate the chain, if the chain is still the one it was judged against."""
    with files.locked(folder):
        receipts.recover(folder)
        if receipts.tail_hash(folder) != found["base_tail"]:
            raise StaleCandidate("the chain changed after the candidate was judged")
        keep_prior(folder)
        receipts.reset(folder, found["manifest"], crypto.public_of(seed))
        history.archive(folder, history.snapshot([found["manifest"]], receipts.tail_hash(folder), spark, seed, breached=found["judgment"]["breached"] or None), spark, history.keys_of(folder, seed=seed))


def append_period(spark: SparkSession, path: str, folder: str | Path, seed: bytes, trusted: list[str] | None = None, sheet: str | None = None) -> dict[str, Any]:
    """Judges and commits the next period of a source."""
    found = candidate(spark, path, folder, seed, trusted, sheet)
    if not found["unchanged"]:
        commit(spark, folder, found, seed)
    return found["judgment"]


def rebuild(spark: SparkSession, path: str, folder: str | Path, seed: bytes, steps: list[Callable[[DataFrame], DataFrame]], **options: Any) -> DataFrame:
    """Source and steps from the start; the same inputs and code give the same hashes."""
    ingest(spark, path, folder, seed, **options)
    df = readers.load(spark, path)
    for func in steps:
        df = step(folder, seed)(func)(df)
    return df


def attested_by_tree(df: DataFrame, folder: str | Path, trusted: list[str] | None = None) -> bool:
    """The same by the content tree that the last receipt declares: no byte of the table passes the driver. False where none is declared."""
    if not receipts.verify_folder(df.sparkSession, folder, trusted).ok:
        return False
    declared = receipts.load_receipts(folder)[-1].get("output_tree")
    good = isinstance(declared, dict) and declared.get("kind") == tree.KIND and isinstance(declared.get("keys"), list)
    return good and tree.root(tree.tree(df, declared["keys"])) == declared.get("root")


def attested(df: DataFrame, folder: str | Path, trusted: list[str] | None = None) -> bool:
    """Whether the table is what the end of a verified chain describes."""
    return receipts.verify_folder(df.sparkSession, folder, trusted, df).ok
