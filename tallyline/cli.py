"""Command line: ``python -m tallyline.cli COMMAND``. Exit codes: 0 green, 1 red, 2 yellow."""

from __future__ import annotations

import argparse
import json
import sys
import tempfile
import time
from pathlib import Path
from typing import Any

from tallyline.operators import runlog, totals
from tallyline.plans import annotations, crypto, history, pipeline, receipts
from tallyline.session import session


def _seed(args: argparse.Namespace) -> bytes:
    return crypto.load_private(args.key)


def _trusted(args: argparse.Namespace) -> list[str] | None:
    """Public keys, given in hexadecimal or as files."""
    out = [Path(k).read_text().strip() if Path(k).is_file() else k for k in args.pub or []]
    return out or None


def _say(args: argparse.Namespace, document: Any, lines: list[str]) -> None:
    print(json.dumps(document, indent=2, ensure_ascii=False) if args.json else "\n".join(lines))


def keygen(spark, args) -> int:
    public = crypto.generate(args.folder)
    _say(args, {"public_key": public, "fingerprint": crypto.fingerprint(public)}, [f"public key {public}", f"fingerprint {crypto.fingerprint(public)}"])
    return 0


def ingest(spark, args) -> int:
    if args.mode == "period":
        judged = pipeline.append_period(spark, args.file, args.folder, _seed(args), _trusted(args), args.sheet)
        _say(args, judged, judged["notices"] + judged["caveats"] or ["period appended"])
        return 2 if judged["caveats"] else 0
    made = pipeline.ingest(spark, args.file, args.folder, _seed(args), args.origin, args.band, args.settle, args.bucket_column, args.sheet)
    grouped = totals.grouped_numeric_columns(pipeline.readers.load(spark, args.file, args.sheet))
    warned = [f"column {g['column']} looks like numbers with thousands groups ({g['example']}) and isn't summed" for g in grouped]
    _say(args, made | {"warnings": warned}, [f"ingested {made['source']['filename']}: {made['control_totals']['row_count']} rows, hash {receipts.short(made['semantic_hash'])}", *warned])
    return 0


def verify(spark, args) -> int:
    data = pipeline.readers.load(spark, args.data) if args.data else None
    result, judged = history.verify_and_judge(spark, args.folder, _trusted(args), data, args.warn_drift, _seed(args) if args.key else None)
    if args.anchor_log:
        from tallyline.plans import anchor as anchors

        anchors.fold(result, args.folder, anchors.LogWitness(args.anchor_log))
    document = {"verdict": result.verdict, "lines": result.lines, "caveats": result.caveats, "caveat_details": judged["details"], "notices": judged["notices"], "broken_link": result.broken_link_detail, "data_mismatch": result.data_mismatch, "receipt_mismatch": result.receipt_mismatch}
    _say(args, document, result.lines + judged["notices"])
    return result.exit_code


def _runs(spark, args) -> list[dict[str, Any]]:
    """Archived runs that can be used; why others can't is said on standard error."""
    notices: list[str] = []
    found = history.load(args.folder, spark, _trusted(args), notices=notices)
    for text in notices:
        print(text, file=sys.stderr)
    return found


def _side(spark, args, name: str | None) -> dict[str, Any]:
    """A run's stages: an archived one by hash prefix, the latest one differing from the present, or the present chain."""
    folder = args.folder
    if name == "current":
        return {"source": history.source_identity(receipts.load_receipts(folder)), "stages": history.stages(receipts.load_receipts(folder))}
    held = _runs(spark, args)
    if name:
        held = [d for d in held if history.jcs.body_hash(d).startswith(name)]
        if len(held) != 1:
            raise ValueError(f"{len(held)} archived runs begin with {name!r}; exactly one must")
    else:
        held = [d for d in held if d["chain_tail_hash"] != receipts.tail_hash(folder)]
    if not held:
        raise ValueError("no archived run to compare with")
    return held[0]


def anchor(spark, args) -> int:
    """Has chain.json attested by a witness: a log file that only grows."""
    from tallyline.plans import anchor as anchors

    path = anchors.anchor(args.folder, anchors.LogWitness(args.log))
    _say(args, json.loads(path.read_text()), [f"anchored in {args.log}"])
    return 0


def diff(spark, args) -> int:
    a, b = _side(spark, args, args.a), _side(spark, args, args.b or "current")
    first = lambda side: {s["name"]: s for s in reversed(side["stages"])}
    old, new = first(a), first(b)
    rows = lambda side: spark.createDataFrame([(i, s["name"], n if isinstance(n := s["totals"].get("row_count"), int) else None, s.get("code_hash")) for i, s in enumerate(side["stages"])], "position long, name string, row_count long, code_hash string")
    out, lines = [], [] if a["source"]["filename"] == b["source"]["filename"] else [f"note: the runs have different sources, {a['source']['filename']!r} and {b['source']['filename']!r}"]
    for stage in runlog.stage_diff(rows(a), rows(b)).orderBy("at").collect():
        name = stage["name"]
        if stage["presence"] != "both":
            out.append({"stage": name, "presence": stage["presence"]})
            lines.append(f"{name}: {stage['presence']}")
            continue
        code = {"code_hash": [old[name].get("code_hash"), new[name].get("code_hash")]} if stage["code_changed"] else {}
        out.append({"stage": name, "row_delta": stage["row_delta"], "delta": totals.structured_delta(old[name]["totals"], new[name]["totals"])} | code)
        lines += [f"{name}: {x}" for x in totals.totals_delta(old[name]["totals"], new[name]["totals"])]
        lines += [f"{name}: code {str(x)[:8]} -> {str(y)[:8]}" for x, y in code.values()]
    _say(args, out, lines or ["no movement"])
    return 0


def log(spark, args) -> int:
    """Totals of archived runs by period: the last run of each counts."""
    from pyspark.sql import functions as F

    from tallyline.operators import judge

    runs, long = [], []
    for d in _runs(spark, args):
        run = history.jcs.body_hash(d)
        terms = d["tolerance"] if isinstance(d.get("tolerance"), dict) else {}
        flagged = sorted({m for ms in (d.get("breached") or {}).values() for m in ms})
        runs.append((run, history.parse_time(d["created_at"]), flagged, "signature" not in d, terms.get("band"), terms.get("settle_hours")))
        long += [(run, *r) for r in totals.document_rows(d["stages"][-1]["totals"] if d.get("stages") else {})]
    heads = spark.createDataFrame(runs, "body_hash string, created timestamp, flagged array<string>, unsigned boolean, band string, settle_hours int")
    seen = judge.observations(spark.createDataFrame(long, "body_hash string, section string, period string, name string, value string"), flat=True)
    metrics = sorted({r["metric"] for r in seen.select("metric").distinct().collect()}) if args.metric == "all" else [args.metric]
    by = heads.withColumn("period", runlog.cells.period_key(F.col("created"), args.by))
    marks = {r["period"]: r for r in by.groupBy("period").agg(F.flatten(F.collect_list("flagged")).alias("flagged"), F.max("unsigned").alias("unsigned"), F.max_by(F.struct("band", "settle_hours"), F.struct("created", "body_hash")).alias("terms")).collect()}
    text = lambda v: None if v is None else runlog.cells.plain(v)
    out = []
    for metric in metrics:
        valued = heads.join(seen.filter(F.col("metric") == metric).select("body_hash", "value"), "body_hash", "left")
        for r in runlog.log(valued, args.by).orderBy("period").collect():
            mark = marks[r["period"]]
            out.append({"period": r["period"], "metric": metric, "runs": r["runs"], "value": text(r["value"]), "delta": text(r["delta"]), "breached": metric in mark["flagged"], "unsigned": mark["unsigned"], "band": mark["terms"]["band"], "settle_hours": mark["terms"]["settle_hours"]})
    out.sort(key=lambda x: (x["period"], x["metric"]))
    line = lambda x: f"{x['period']}  {x['metric']}  {x['value'] or '-'}  {x['delta'] or ''}  {'!' if x['breached'] else ''}{'u' if x['unsigned'] else ''}"
    _say(args, out, [line(x).rstrip() for x in out] or ["no archived runs"])
    return 0


def annotate(spark, args) -> int:
    hashes = receipts.file_hashes(args.folder, receipts.receipt_names(args.folder))
    target = hashes.get(args.target, args.target)
    path = annotations.annotate(spark, args.folder, _seed(args), target, args.reason, args.author, args.supersedes)
    _say(args, {"annotation": path.stem}, [f"annotated {receipts.short(target)}"])
    return 0


def timeline(spark, args) -> int:
    document = annotations.timeline(spark, args.folder, _trusted(args))
    if args.key:
        document = receipts.signed(spark, document, _seed(args))
    _say(args, document, [f"{e['stage']}: {e['totals'].get('row_count')} rows" + (f" {e['row_delta']:+}" if "row_delta" in e else "") for e in document["entries"]])
    return 0


def custody(spark, args) -> int:
    found = annotations.custody(spark, args.folder, _trusted(args))
    _say(args, found, [f"{x['chain']}: {x['verdict']}" for x in found])
    return 1 if any(x["verdict"] == "red" for x in found) else 0


def export(spark, args) -> int:
    from tallyline.sources import writers

    if args.bundle:
        result = receipts.verify_folder(spark, args.folder, _trusted(args), pipeline.readers.load(spark, args.file))
        if not result.ok:
            _say(args, {"verdict": "red", "lines": result.lines}, result.lines)
            return 1
        writers.bundle(args.folder, args.file, args.to)
    else:
        writers.write_document(pipeline.readers.load(spark, args.file), args.to)
    _say(args, {"written": args.to}, [f"wrote {args.to}"])
    return 0


def watch(spark, args) -> int:
    from tallyline.sources import feeds
    from tallyline.streaming.watch import tick

    fields = json.loads(args.fields) if args.fields else None
    failures = 0
    while True:
        try:
            raw = Path(args.feed).read_bytes() if Path(args.feed).is_file() else feeds.fetch(args.feed).body
            df = feeds.rss_records(spark, raw, fields) if args.rss else feeds.json_records(spark, raw, fields or {}, args.columnar)
            decided = tick(spark, df, args.folder, _seed(args), args.feed, args.filename, _trusted(args), args.cap)
            _say(args, decided, [decided["decision"], *decided.get("caveats", [])])
            failures = 0
        except feeds.SourceError as e:
            failures += 1
            print(e, file=sys.stderr)
            if failures >= 10 or not args.every:
                return 1
        if not args.every:
            return 0
        time.sleep(args.every)


def review(spark, args) -> int:
    from tallyline.streaming.watch import review as decide

    if not args.event:
        held = annotations.pending(args.folder)
        _say(args, [{"hash": h, "caveats": d["caveats"]} for h, d in held], [f"{h[:12]}  {'; '.join(d['caveats'])}" for h, d in held] or ["nothing pending"])
        return 0
    _say(args, done := decide(spark, args.folder, _seed(args), args.event, args.accept, args.reason, args.author), [done])
    return 0


def _checks(spark, args) -> list[tuple[str, bool, str, str]]:
    """(what, whether it is as it should be, what was found, what to do otherwise)."""
    folder, conf = Path(args.folder), spark.conf
    local = spark.sparkContext.master.startswith("local")
    shared = conf.get("spark.checkpoint.dir", None)
    found = [
        ("java", int(spark._jvm.java.lang.Runtime.version().feature()) >= 17, spark._jvm.java.lang.System.getProperty("java.version"), "use Java 17 or later"),
        ("spark", int(spark.version.split(".")[0]) >= 4, spark.version, "use Spark 4 or later"),
        ("time zone", conf.get("spark.sql.session.timeZone") == "UTC", conf.get("spark.sql.session.timeZone"), "start sessions by tallyline.session.session"),
        ("shared folder", bool(shared) or local, shared or "none", "set spark.checkpoint.dir to a folder that all executors reach"),
    ]
    chain = receipts.read_chain(folder)
    found.append(("chain", bool(chain), f"{len(chain.get('receipts', []))} receipts", "ingest a source"))
    found.append(("interrupted commit", not (folder / receipts._JOURNAL).exists(), str((folder / receipts._JOURNAL).exists()), "run verify, which finishes it"))
    if chain:
        result = receipts.verify_folder(spark, folder, _trusted(args))
        found.append(("verdict", result.ok, result.verdict, result.lines[0]))
        notices: list[str] = []
        runs = history.load(folder, spark, _trusted(args), notices=notices)
        found.append(("history", not notices, f"{len(runs)} usable runs", "; ".join(notices)))
        waiting = annotations.pending(folder)
        found.append(("withheld changes", not waiting, str(len(waiting)), "decide on them with review"))
    if args.key:
        path = Path(args.key)
        try:
            public, why = crypto.public_of(crypto.load_private(path)), ""
        except (OSError, ValueError) as e:
            public, why = None, str(e)
        found.append(("private key", public is not None, public or "unreadable", why))
        if public:
            mode = path.stat().st_mode & 0o777
            found.append(("private key's mode", not mode & 0o077, oct(mode), f"chmod 600 {path}"))
            found.append(("private key's chain", not chain or public == chain.get("public_key"), crypto.fingerprint(public), "the chain was signed by another key"))
    return found


def doctor(spark, args) -> int:
    """Checks the set-up, the chain, its history and the key; 1 if anything is wrong."""
    found = _checks(spark, args)
    _say(args, [{"check": n, "ok": ok, "found": what, **({} if ok else {"fix": fix})} for n, ok, what, fix in found], [f"{'ok' if ok else '!!'}  {n}: {what}" + ("" if ok else f" ({fix})") for n, ok, what, fix in found])
    return 0 if all(ok for _, ok, *_ in found) else 1


def demo(spark, args) -> int:
    """A small chain in a temporary folder: intact, then with one changed cell."""
    with tempfile.TemporaryDirectory() as place:
        crypto.generate(f"{place}/keys")
        seed, folder = crypto.load_private(f"{place}/keys/private.pem"), f"{place}/chain"
        rows = "".join(f"2026-05-{d:02d},{c},{d * k}\n" for d in range(1, 29) for k, c in enumerate(("mail", "web", ""), 1))
        Path(f"{place}/export.csv").write_text("date,channel,clicks\n" + rows)
        pipeline.ingest(spark, f"{place}/export.csv", folder, seed)
        clean = pipeline.step(folder, seed, name="clean")(lambda df: df.filter("channel is not null"))
        out = clean(pipeline.readers.load(spark, f"{place}/export.csv"))
        print(*receipts.verify_folder(spark, folder, data=out).lines, sep="\n")
        from pyspark.sql import functions as F

        print(*receipts.verify_folder(spark, folder, data=out.withColumn("clicks", F.when(F.col("date") == "2026-05-03", "999").otherwise(F.col("clicks")))).lines, sep="\n")
    return 0


def parser() -> argparse.ArgumentParser:
    main = argparse.ArgumentParser(prog="tallyline", description=__doc__)
    sub = main.add_subparsers(dest="command", required=True)

    def command(func, *, key: bool | None = False, pub: bool = False):
        own = sub.add_parser(func.__name__, help=(func.__doc__ or "").strip())
        own.set_defaults(run=func)
        own.add_argument("--json", action="store_true")
        own.add_argument("--folder", default="receipts")
        own.add_argument("--key", required=bool(key), help="private.pem")
        if pub:
            own.add_argument("--pub", action="append", help="a trusted public key, as hexadecimal or file; repeatable")
        return own

    command(keygen)
    own = command(ingest, key=True, pub=True)
    own.add_argument("file")
    own.add_argument("--as", dest="mode", choices=("replace", "period"), default="replace")
    for option in ("--band", "--settle", "--bucket-column", "--sheet"):
        own.add_argument(option)
    own.add_argument("--origin", default="")
    own = command(verify, pub=True)
    own.add_argument("--data")
    own.add_argument("--warn-drift", action="store_true")
    own.add_argument("--anchor-log", help="the log in which chain.json was anchored; its finding joins the verdict")
    own = command(anchor)
    own.add_argument("--log", required=True)
    own = command(diff, pub=True)
    own.add_argument("a", nargs="?")
    own.add_argument("b", nargs="?")
    own = command(log, pub=True)
    own.add_argument("--metric", default="row_count", help="a metric's name, or all")
    own.add_argument("--by", choices=("day", "week", "month", "quarter"), default="day")
    own = command(annotate, key=True)
    for name in ("target", "reason", "author"):
        own.add_argument(name)
    own.add_argument("--supersedes")
    command(timeline, pub=True)
    command(custody, pub=True)
    own = command(export, pub=True)
    own.add_argument("file")
    own.add_argument("to")
    own.add_argument("--bundle", action="store_true")
    own = command(watch, key=True, pub=True)
    own.add_argument("feed")
    own.add_argument("--filename", help="the source's identity; the feed's own name without it")
    own.add_argument("--fields", help="JSON object of output columns and feed fields")
    own.add_argument("--columnar", help="dotted path to parallel arrays")
    own.add_argument("--rss", action="store_true")
    own.add_argument("--cap", type=int)
    own.add_argument("--every", type=float, help="seconds between ticks; one tick without")
    own = command(review)
    own.add_argument("event", nargs="?")
    own.add_argument("--accept", action="store_true")
    own.add_argument("--reason", default="")
    own.add_argument("--author", default="")
    command(doctor, key=None, pub=True)
    command(demo)
    return main


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return args.run(session(), args)
    except (ValueError, OSError) as e:
        if args.json:
            print(json.dumps({"error": str(e)}))
        else:
            print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
