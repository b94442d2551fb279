import json
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyline import cli
from tallyline.operators import links
from tallyline.operators.canonical import semantic_hash
from tallyline.plans import annotations, crypto, files, history, jcs, pipeline, receipts
from tallyline.sources import readers, writers

CSV = "date,channel,clicks\n" + "".join(f"2026-05-{d:02d},{c},{d * k}\n" for d in range(1, 11) for k, c in enumerate(("mail", "web", ""), 1))
#: Folders of chains that were signed elsewhere and the verdict on each, as a JSON object.
ELSEWHERE = json.loads(os.environ.get("TALLYLINE_SIGNED_CHAINS", "{}"))


def clean(df):
    return df.filter("channel is not null")


def by_channel(df):
    return df.groupBy("channel", "date").agg(F.sum(F.col("clicks").cast("long")).alias("clicks"))


@pytest.fixture(scope="module")
def seed(tmp_path_factory):
    folder = tmp_path_factory.mktemp("keys")
    crypto.generate(folder)
    return crypto.load_private(folder / "private.pem")


@pytest.fixture
def chain(spark, seed, tmp_path):
    (tmp_path / "in.csv").write_text(CSV)
    out = pipeline.rebuild(spark, str(tmp_path / "in.csv"), tmp_path / "r", seed, [clean, by_channel])
    return tmp_path / "r", out


def test_ed25519(spark):
    # RFC 8032, test 1
    seed = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")
    public = crypto.public_of(seed)
    assert public == "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a"
    value = crypto.sign(spark, seed, b"")
    assert value.startswith("e5564300c360ac729086e2cc806e828a") and crypto.verify(spark, public, b"", value)
    for key, message, made in ((public, b"x", value), ("00", b"", value), (public, b"", "zz"), (public, b"", value[:-2] + "00")):
        assert not crypto.verify(spark, key, message, made)


def test_canonical_json():
    assert jcs.canonical_bytes({"b": [1, None, True, "é\x1f/"], "a": {}}) == '{"a":{},"b":[1,null,true,"é\\u001f/"]}'.encode()
    with pytest.raises(ValueError, match="floats"):
        jcs.canonical_bytes({"a": [0.1]})


def test_intact_then_altered(spark, chain):
    folder, out = chain
    good = receipts.verify_folder(spark, folder, data=out)
    assert good.verdict == "green" and good.lines == ["✓ CHAIN INTACT: 3 receipts, 2 transforms, final row_count 20"]
    bad = receipts.verify_folder(spark, folder, data=out.withColumn("clicks", F.when(F.col("date") == "2026-05-03", 0).otherwise(F.col("clicks"))))
    assert bad.exit_code == 1 and "DATA MISMATCH" in bad.lines[0] and bad.data_mismatch["totals_delta"] == ["clicks 165 -> 156 (-9)"]
    assert pipeline.attested(out, folder)


def test_rewritten_receipt_is_found_by_file_then_by_signature(spark, chain):
    folder, _ = chain
    path = folder / "001_clean.json"
    document = json.loads(path.read_text())
    document["output_control_totals"]["row_count"] = 1
    path.write_text(files.text_of(document))
    assert receipts.verify_folder(spark, folder).receipt_mismatch == ["001_clean.json"]
    held = receipts.load_receipts(folder)
    assert "SIGNATURE INVALID on receipt 1 (clean)" in receipts.verify_chain(spark, held, [receipts.read_chain(folder)["public_key"]]).lines[0]


def test_broken_link_gap_and_strange_key(spark, chain, seed):
    folder, _ = chain
    held, key = receipts.load_receipts(folder), receipts.read_chain(folder)["public_key"]
    broken = receipts.verify_chain(spark, [held[0], held[2]], [key])
    assert broken.broken_link == 1 and "CHAIN BROKEN at link 0 -> 1 (by_channel)" in broken.lines[0]
    gap = receipts.verify_chain(spark, held, [key], names=["000_a.json", "001_b.json", "003_c.json"])
    assert gap.verdict == "yellow" and gap.caveats == ["coverage gap: receipt numbering jumps 001 -> 003; a stage may have run without leaving a receipt"]
    assert receipts.gaps(["source.json", "003_x.json"]) == []
    strange = receipts.verify_chain(spark, held, [crypto.public_of(b"\1" * 32)], chain_key=key)
    assert strange.verdict == "yellow" and "unrecognized signing key: 3 receipt(s)" in strange.caveats[0]
    drift = receipts.verify_chain(spark, held, [key], warn_drift=True)
    assert any(c.startswith("totals drift at link 0 -> 1 (clean): row_count 30 -> 20 (-10)") for c in drift.caveats)
    assert receipts.verify_chain(spark, [], [key]).verdict == "red"


@pytest.mark.parametrize(("folder", "verdict"), ELSEWHERE.items())
def test_chains_signed_elsewhere(spark, folder, verdict):
    chain, names = receipts.read_chain(folder), receipts.receipt_names(folder)
    found = receipts.verify_chain(spark, receipts.load_receipts(folder), [chain["public_key"]], names=names, recorded=chain["receipt_hashes"], actual=receipts.file_hashes(folder, names))
    assert found.verdict == verdict
    for export in Path(folder).glob("export.csv"):
        assert semantic_hash(readers.load(spark, str(export))) == receipts.output_hash(receipts.load_receipts(folder)[-1])


def test_step_refuses_other_inputs(spark, chain, seed, tmp_path):
    folder, out = chain
    with pytest.raises(pipeline.TailMismatch, match="the chain ends in"):
        pipeline.step(folder, seed)(clean)(out.limit(1))
    with pytest.raises(pipeline.TailMismatch, match="ingest a source first"):
        pipeline.step(tmp_path / "none", seed)(clean)(out)


def test_interrupted_reset_is_finished(spark, chain, seed):
    folder, _ = chain
    made = receipts.load_receipts(folder)[0]
    before = receipts.tail_hash(folder)
    text = files.text_of(made)
    files.write_text(folder / receipts._STAGED[0], text, overwrite=True)
    files.write_text(folder / receipts._STAGED[1], receipts._chain_text([receipts.SOURCE], crypto.public_of(seed), receipts.file_hashes(folder, [receipts.SOURCE])), overwrite=True)
    assert not receipts.recover(folder) and receipts.tail_hash(folder) == before
    files.write_text(folder / receipts._JOURNAL, "{}\n")
    assert receipts.recover(folder) and receipts.receipt_names(folder) == [receipts.SOURCE]
    assert receipts.verify_folder(spark, folder).ok


def test_paths_stay_inside(tmp_path):
    with pytest.raises(ValueError, match="not a file name"):
        files.inside(tmp_path, "../x.json")


def test_options():
    assert pipeline.parse_band("5%") == pipeline.parse_band("0.05") == "0.05" and pipeline.parse_settle("3d") == 72
    for bad in ("0", "101%", "x", "0.00000001"):
        with pytest.raises(ValueError, match="band"):
            pipeline.parse_band(bad)
    with pytest.raises(ValueError, match="settling"):
        pipeline.parse_settle("3w")


def test_periods_are_judged_against_history(spark, seed, tmp_path):
    folder = tmp_path / "r"
    days = lambda last, sales: "day,sales\n" + "".join(f"2026-01-{d:02d},{sales.get(d, 100)}\n" for d in range(1, last + 1))
    path = tmp_path / "feed.csv"
    path.write_text(days(5, {}))
    pipeline.ingest(spark, str(path), folder, seed, band="5%", settle="72h")
    result, _ = history.verify_and_judge(spark, folder, seed=seed)
    assert result.verdict == "green"
    path.write_text(days(6, {}))
    assert pipeline.append_period(spark, str(path), folder, seed)["caveats"] == []
    path.write_text(days(6, {3: 90}))
    judged = pipeline.append_period(spark, str(path), folder, seed)
    assert judged["caveats"] == ["settled period moved: sales changed in 1 settled bucket, worst 2026-01-03 (-10)"] and judged["breached"] == {"2026-01-03": ["sales"]}
    path.write_text(days(6, {}).replace("2026-01-04,100\n", ""))
    assert any(c.startswith("period buckets removed: 1 interior bucket") for c in pipeline.append_period(spark, str(path), folder, seed)["caveats"])
    with pytest.raises(pipeline.UntrustedSigner):
        pipeline.candidate(spark, str(path), folder, b"\2" * 32)
    found = pipeline.candidate(spark, str(path), folder, seed)
    found["base_tail"] = "x"
    with pytest.raises(pipeline.StaleCandidate):
        pipeline.commit(spark, folder, found, seed)
    assert [x["verdict"] for x in annotations.custody(spark, folder)].count("red") == 0


def test_annotations_and_timeline(spark, chain, seed):
    folder, _ = chain
    tail = receipts.tail_hash(folder)
    first = annotations.annotate(spark, folder, seed, tail, "known", "ann")
    annotations.annotate(spark, folder, seed, tail, "better", "ann", supersedes=first.stem)
    shown = annotations.timeline(spark, folder)["entries"]
    assert [e.get("row_delta") for e in shown] == [None, -10, 0] and {(a["reason"], a["superseded"]) for a in shown[2]["annotations"]} == {("known", True), ("better", False)}


def test_short_values():
    assert receipts.short("1234567890") == "1234567890" and receipts.short("12345678901") == "1234...01"


def test_red_findings_decide_in_their_order(spark, chain):
    folder, _ = chain
    held, key = receipts.load_receipts(folder), receipts.read_chain(folder)["public_key"]
    names, good = receipts.receipt_names(folder), receipts.file_hashes(folder, receipts.receipt_names(folder))
    both = receipts.verify_chain(spark, [held[0], held[2]], [key], names=[names[0], names[2]], recorded=good, actual=good | {names[0]: "x"})
    assert both.receipt_mismatch == [names[0]] and both.broken_link is None and both.of("link") and both.lines[0].startswith("✗ RECEIPT FILE MISMATCH: 000_source.json")
    strange = receipts.verify_chain(spark, [held[0], held[2]], [crypto.public_of(b"\1" * 32)], chain_key=key)
    assert strange.broken_link == 1 and strange.exit_code == 1 and "unrecognized signing key" in strange.caveats[0]


def test_link_relations(spark):
    rows = [("c", 0, "000_a", None, "h0", 5), ("c", 1, "001_b", "h0", "h1", None), ("c", 2, "003_c", "hX", "h2", 3), ("c", 3, "004_d", None, "h3", 4), ("d", 0, "001_x", None, "g0", 1)]
    df = spark.createDataFrame(rows, "chain string, position long, name string, input_hash string, output_hash string, row_count long")
    assert [(r.position, r.broken, r.first_broken) for r in links.link_check(df).orderBy("chain", "position").collect()] == [(1, False, False), (2, True, True), (3, True, False)]
    assert {r.gap for r in links.coverage_gaps(df).collect()} == {"numbering jumps 001 -> 003", "chain starts at 001, not 000"}
    assert [r.row_delta for r in links.row_deltas(df).filter("chain = 'c'").orderBy("position").collect()] == [None, None, -2, 1]


def test_bundle_and_document(spark, chain, tmp_path):
    import hashlib
    import zipfile

    folder, out = chain
    path = writers.write_document(out, tmp_path / "table.json")
    assert hashlib.sha256(path.read_bytes()).hexdigest() == receipts.output_hash(receipts.load_receipts(folder)[-1])
    bundle = writers.bundle(folder, path, tmp_path / "b.zip")
    with zipfile.ZipFile(bundle) as z:
        assert set(z.namelist()) == {"receipts/chain.json", "receipts/000_source.json", "receipts/001_clean.json", "receipts/002_by_channel.json", "table.json"}


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in.csv").write_text(CSV)
    folder, key = str(tmp_path / "r"), str(tmp_path / "k" / "private.pem")
    assert cli.main(["keygen", "--folder", str(tmp_path / "k")]) == 0
    assert cli.main(["ingest", str(tmp_path / "in.csv"), "--folder", folder, "--key", key, "--band", "5%"]) == 0
    assert cli.main(["verify", "--folder", folder, "--key", key, "--data", str(tmp_path / "in.csv")]) == 0
    capsys.readouterr()
    assert cli.main(["log", "--folder", folder, "--json"]) == 0
    assert json.loads(capsys.readouterr().out)[0]["value"] == "30"
    assert cli.main(["log", "--folder", folder, "--json", "--metric", "all"]) == 0
    logged = {x["metric"]: x for x in json.loads(capsys.readouterr().out)}
    assert logged["clicks"]["value"] == "330" and logged["clicks"]["band"] == "0.05" and logged["row_count"]["settle_hours"] == 72
    anchored = str(tmp_path / "anchors.log")
    assert cli.main(["anchor", "--folder", folder, "--log", anchored]) == 0 and cli.main(["anchor", "--folder", folder, "--log", anchored]) == 0
    assert cli.main(["verify", "--folder", folder, "--anchor-log", anchored]) == 0 and cli.main(["verify", "--folder", folder, "--anchor-log", anchored + "x"]) == 2
    (tmp_path / "anchors.log").write_text((tmp_path / "anchors.log").read_text().replace("T", "t", 1))
    assert cli.main(["verify", "--folder", folder, "--anchor-log", anchored]) == 1
    (tmp_path / "r" / "chain.json.anchor").unlink()
    (tmp_path / "in.csv").write_text(CSV.replace("2026-05-03,web,6", "2026-05-03,web,7"))
    assert cli.main(["verify", "--folder", folder, "--data", str(tmp_path / "in.csv")]) == 1
    assert cli.main(["ingest", str(tmp_path / "in.csv"), "--folder", folder, "--key", key, "--as", "period"]) == 2
    assert cli.main(["diff", "--folder", folder]) == 0 and "clicks 330 -> 331 (1)" in capsys.readouterr().out
    assert cli.main(["timeline", "--folder", folder]) == 0 and cli.main(["custody", "--folder", folder]) == 0
    capsys.readouterr()
    assert cli.main(["doctor", "--folder", folder, "--key", key, "--json"]) == 0
    checks = {x["check"]: x for x in json.loads(capsys.readouterr().out)}
    assert checks["verdict"]["found"] in ("green", "yellow") and checks["private key's chain"]["ok"] and "fix" not in checks["java"]
    (tmp_path / "k" / "private.pem").chmod(0o644)
    (tmp_path / "r" / "history" / "x.json").write_text("{")
    assert cli.main(["doctor", "--folder", folder, "--key", key, "--json"]) == 1
    assert {x["check"] for x in json.loads(capsys.readouterr().out) if not x["ok"]} == {"history", "private key's mode"}
    assert cli.main(["doctor", "--folder", str(tmp_path / "nothing")]) == 1
    assert cli.main(["ingest", str(tmp_path / "none.csv"), "--folder", folder, "--key", key]) == 1


def test_column_signatures_agree_with_the_jvm(spark):
    import os

    from tallyline.plans import ledger

    rows = []
    for k in range(40):
        seed, message = os.urandom(32), "".join(chr(32 + x % 900) for x in os.urandom(k))
        public, value = crypto.public_of(seed), crypto.signature(seed, message.encode())
        assert value == crypto.sign(spark, seed, message.encode())
        rows += [(public, message, value), (public, message + "x", value), (public, message, value[:-2] + ("00" if value[-2:] != "00" else "01")), (crypto.public_of(os.urandom(32)), message, value), (public, message, value.upper())]
    rows += [(None, "a", "b"), ("zz", "a", "b"), (rows[0][0], None, rows[0][2]), (rows[0][0], rows[0][1], None), (rows[0][0], rows[0][1], ""), ("ff" * 32, rows[0][1], rows[0][2]), (rows[0][0], rows[0][1], rows[0][2][:64] + "ff" * 32)]
    got = spark.createDataFrame(rows, "k string, m string, s string").select("k", "m", "s", ledger.holds(F.col("k"), F.col("m"), F.col("s")).alias("holds")).collect()
    assert [r.holds for r in got] == [all(x is not None for x in row) and crypto.verify(spark, row[0], row[1].encode(), row[2]) for row in rows]
    assert sum(r.holds for r in got) == 80


def test_signatures_of_many_rows_are_quick_and_exact():
    import time

    seeds = [bytes([k]) * 32 for k in range(5)]
    began = time.process_time()
    rows = [(seeds[k % 5], str(k).encode()) for k in range(2000)]
    made, keys = crypto.signatures(rows), [crypto.public_of(s) for s in seeds]
    checked = [(keys[k % 5 if k % 3 else 0], message, value) for k, ((_, message), value) in enumerate(zip(rows, made, strict=True))]
    assert crypto.all_hold(checked) == [bool(k % 3) or k % 5 == 0 for k in range(2000)]
    assert time.process_time() - began < 12  # 28 s at one row after the other
    # Few uses of a key go without a table, and points of small order are no exception.
    zero = "01" + "00" * 31
    few = [*checked[1:4], ("26e8958fc2b227b045c3f489f2ef98f0d5dfac05d3c63339b13802886d53fc05", b"", zero + "00" * 32), (zero, b"any", zero + "00" * 32), ("ff" * 32, b"any", zero + "00" * 32)]
    assert crypto.all_hold(few) == [x for n in range(len(few)) for x in crypto.all_hold(few[n : n + 1] * 9)[:1]]
    assert crypto.all_hold([]) == crypto.signatures([]) == []


def test_ledger_documents(spark):
    from tallyline.plans import ledger

    good = [{"b": [1, None, True, "é\x1f/\x7f\u2028\b\n\x0b\\u000B\\"], "a": {"z": 1, "A": 2, "é": 3, "": 4, "\x1b": 10**30}}, {}, {"x": -5, "y": [[]], "signature": {"value": "ab"}, "kind": "k", "created_at": "2026-01-02T03:04:05Z"}]
    texts = [json.dumps(d, ensure_ascii=k % 2 == 0, indent=k) for d in good for k in (0, 1, 2)]
    bad = ["", "nope", "[1]", '{"a": 1.0}', '{"a": 1e2}', '{"a": {"b": [2.5]}}', '{"a": 1, "a": 2}']
    rows = ledger.documents(spark.createDataFrame(list(enumerate(texts + bad)), "path long, value string")).orderBy("path").collect()
    for r, text in zip(rows, texts, strict=False):
        assert r.body.encode() == jcs.canonical_bytes(jcs.body(json.loads(text))) and r.body_hash == jcs.body_hash(json.loads(text)) and r.reason is None
    assert all(r.body is None and r.body_hash is None and r.reason for r in rows[len(texts) :])
    assert rows[6].signed and rows[6].signature == "ab" and str(rows[6].created) == "2026-01-02 03:04:05" and not rows[0].signed


def test_forged_history_is_left_out(spark, chain, seed):
    folder, _ = chain
    history.verify_and_judge(spark, folder, seed=seed)
    [path] = (folder / "history").glob("*.json")
    real = json.loads(path.read_text())
    make = lambda name, document: (folder / "history" / name).write_text(json.dumps(document))
    make("forged.json", real | {"chain_tail_hash": "ee" * 32})
    make("made-up.json", real | {"created_at": "2026-01-01T00:00:00Z", "signature": {"alg": "ed25519", "value": "00" * 64}})
    make("text.json", real | {"created_at": "2026-01-01T00:00:00Z", "signature": "me"})
    make("list.json", [1])
    make("future.json", {k: v for k, v in real.items() if k != "signature"} | {"created_at": "2999-01-01T00:00:00Z"})
    make("unsigned.json", {k: v for k, v in real.items() if k != "signature"} | {"created_at": "2026-01-01T00:00:00Z"})
    (folder / "history" / "broken.json").write_text("not json {")
    own = receipts.read_chain(folder)["public_key"]
    for trusted in (None, [own]):
        notices = []
        assert [d["created_at"] for d in history.load(folder, spark, trusted, notices=notices)] == [real["created_at"], "2026-01-01T00:00:00Z"]
        assert {n.split(": ")[1].removeprefix("skipping ") for n in notices} == {"forged.json", "made-up.json", "text.json", "list.json", "future.json", "broken.json"}
    assert [d["created_at"] for d in history.load(folder, spark, [crypto.public_of(b"\1" * 32)])] == ["2026-01-01T00:00:00Z"]
    assert any("broken.json" in n for n in history.verify_and_judge(spark, folder, seed=seed)[1]["notices"])
    assert history.has_tail(folder, real["chain_tail_hash"]) and not history.has_tail(folder, "ee" * 32)


def test_signers_of_many_chains(spark):
    from tallyline.plans import ledger

    seeds = {n: bytes([k]) * 32 for k, n in enumerate("abc")}
    rows = [(c, k, f"{c}{k}", crypto.signature(seeds[s], f"{c}{k}".encode())) for c in ("x", "y") for k, s in enumerate("abca")]
    keys = [("x", crypto.public_of(seeds["a"]), False), ("x", crypto.public_of(seeds["b"]), True), ("y", crypto.public_of(seeds["b"]), False), ("y", crypto.public_of(seeds["b"]), True)]
    got = ledger.signers(spark.createDataFrame(rows, "chain string, position int, body string, signature string"), spark.createDataFrame(keys, "chain string, key string, own boolean"))
    assert [r.signer for r in got.orderBy("chain", "position").collect()] == ["trusted", "chain", "none", "trusted", "none", "trusted", "none", "none"]


def test_signers_take_each_receipt_once(spark):
    from tallyline.plans import ledger

    counted = spark.sparkContext.accumulator(0)

    def tick(x):
        counted.add(1)
        return x

    seeds = {n: bytes([k]) * 32 for k, n in enumerate("abc")}
    keys = [("x", crypto.public_of(seeds["a"]), False), ("x", crypto.public_of(seeds["a"]), True), ("x", crypto.public_of(seeds["b"]), True), ("x", "zz", False), ("x", None, True), (None, crypto.public_of(seeds["a"]), True)]
    rows = [("x" if k % 5 else None, k, f"{k}", crypto.signature(seeds["abc"[k % 3]], b"%d" % k) if k % 7 else None) for k in range(60)]
    rows.append(("none", 60, "60", rows[1][3]))
    receipts_ = spark.createDataFrame(rows, "chain string, position int, body string, signature string").repartition(5)
    seen = receipts_.withColumn("signature", F.udf(tick, "string").asNondeterministic()("signature"))
    got = ledger.signers(seen, spark.createDataFrame(keys, "chain string, key string, own boolean"))
    assert got.columns == ["chain", "position", "body", "signature", "signer"]
    want = [["trusted", "chain", "none"][k % 3] if k % 7 and k % 5 else "none" for k in range(60)] + ["none"]
    assert [r.signer for r in sorted(got.collect(), key=lambda r: r.position)] == want
    assert counted.value == 61


def test_a_step_is_computed_once(spark, chain, seed):
    folder, out = chain
    counted = spark.sparkContext.accumulator(0)

    def tick(x):
        counted.add(1)
        return x

    def shaken(df):
        seen = F.udf(tick, "string")
        return df.withColumns({"at": F.rand(), "seen": seen("channel"), "none": F.lit(None)}).filter(F.rand() < 0.7)

    result = pipeline.step(folder, seed, tree_keys=["date", "channel"])(shaken)(out)
    assert counted.value == 20 and receipts.verify_folder(spark, folder, data=result).verdict == "green"
    assert receipts.totals_of(receipts.load_receipts(folder)[-1])["row_count"] == result.count() == result.count()
    assert counted.value == 20 and result.columns == ["channel", "date", "clicks", "at", "seen", "none"]
    assert pipeline.attested_by_tree(result.repartition(3), folder) and not pipeline.attested_by_tree(result.limit(1), folder)
    assert not pipeline.attested_by_tree(out, folder)


def test_what_a_write_observes(spark):
    df = spark.createDataFrame([(1, None, {"a": 1}), (2, "x", None)], "a int, A string, m map<string,int>")
    same, seen = pipeline.evaluated(df.toDF("a", "A", "m m"), "odd/name")
    assert same.columns == ["a", "A", "m m"] and seen == {"row_count": 2, "nulls[a]": 0, "nulls[A]": 1, "nulls[m m]": 1}
    assert pipeline.evaluated(df.limit(0), "none")[1]["row_count"] == 0


def test_plan_identity(spark, chain, seed, tmp_path):
    folder, out = chain
    out.write.parquet(str(tmp_path / "a"))
    out.write.parquet(str(tmp_path / "b"))

    def made(place, session, least=3, name="n"):
        df = session.read.parquet(str(tmp_path / place)).filter(F.col("clicks") > least)
        wide = df.select("*", *[F.lit(k).alias(f"w{k}") for k in range(60)])
        return wide.groupBy("channel").agg(F.count("*").alias(name), F.sum("w59").alias("w"))

    one = receipts.plan_hash(made("a", spark))
    assert one == receipts.plan_hash(made("a", spark.newSession())) == receipts.plan_hash(made("b", spark))
    assert len({one, receipts.plan_hash(made("a", spark, 4)), receipts.plan_hash(made("a", spark, name="m"))}) == 3
    pipeline.step(folder, seed, plan_identity=True)(clean)(out)
    assert len(receipts.load_receipts(folder)[-1]["plan_hash"]) == 64 and receipts.verify_folder(spark, folder).ok
