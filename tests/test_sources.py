"""Score stores, staged results, acquisition, annotation sets."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from tidepanel.operators import annotate, audit
from tidepanel.sources import files, news, scores


def heads(spark, texts):
    return spark.createDataFrame([(k, t) for k, t in texts.items()], "headline_id string, text string")


class Counted(scores.LexiconScorer):
    """A lexicon that gives away which texts it was asked for: they score 1."""

    def column(self, text):
        return F.lit(1.0).cast("float")


def test_a_store_scores_only_what_it_lacks(spark, tmp_path):
    store = scores.Store(spark, f"{tmp_path}/s", ["lm", "other"])
    lm = scores.LexiconScorer("lm", ["good"], ["bad"])
    first = {r["headline_id"]: r["score_lm"] for r in scores.score_all(heads(spark, {"a": "good", "b": "bad bad good"}), store, [lm]).collect()}
    assert first["a"] == 1.0 and abs(first["b"] + 1 / 3) < 1e-6
    probe = Counted("lm", ["good"], ["bad"])  # same fingerprint
    again = {r["headline_id"]: r["score_lm"] for r in scores.score_all(heads(spark, {"a": "good", "b": "bad bad good", "c": "bad"}), store, [probe], batch_rows=1).collect()}
    assert again == {"a": 1.0, "b": first["b"], "c": 1.0}
    more = {r["headline_id"]: (r["score_lm"], r["score_other"]) for r in scores.score_all(heads(spark, {"a": "good"}), store, [scores.LexiconScorer("other", ["x"], ["good"])]).collect()}
    assert more == {"a": (1.0, -1.0)} and store.load()[0].count() == 3
    changed = heads(spark, {"b": "good"})
    with pytest.raises(scores.IncompatibleScores):
        scores.score_all(changed, store, [lm])
    assert scores.score_all(changed, store, [lm], "rescore").first()["score_lm"] == 1.0
    new = scores.LexiconScorer("lm", ["bad"], ["good"])
    with pytest.raises(scores.IncompatibleScores):
        scores.score_all(heads(spark, {"a": "good"}), store, [new])
    assert scores.score_all(heads(spark, {"a": "good"}), store, [new], "rescore").first()["score_lm"] == -1.0
    left = {r["headline_id"]: r["score_lm"] for r in store.load()[0].collect()}
    assert left == {"a": -1.0, "b": None, "c": None}  # a whole column is stale, asked for or not
    for bad in (heads(spark, {"a": None}), heads(spark, {"a": "x"}).union(heads(spark, {"a": "y"}))):
        with pytest.raises(ValueError):
            scores.score_all(bad, store, [new])


def test_a_store_refuses_what_it_can_t_vouch_for(spark, tmp_path):
    store = scores.Store(spark, f"{tmp_path}/s", ["lm"])
    lm = scores.LexiconScorer("lm", ["good"], ["bad"])
    scores.score_all(heads(spark, {"a": "good"}), store, [lm])
    state = store.state()
    for broken in ({**state, "rows": 2}, {**state, "fingerprints": {}}, {**state, "fingerprints": {"lm": state["fingerprints"]["lm"], "who": {"x": 1}}}):
        store._write(store.POINTER, json.dumps(broken))
        with pytest.raises(scores.IncompatibleScores):
            store.load()
    store._write(store.POINTER, json.dumps(state))
    with store, pytest.raises(scores.IncompatibleScores), store:
        pass  # a second writer
    good, _ = store.load()
    store.commit(good.withColumn("text_sha256", F.lit("no digest")), state["fingerprints"])
    with pytest.raises(scores.IncompatibleScores):
        store.load()
    for fingerprint in ({}, None, {"x": float("nan")}):
        with pytest.raises(ValueError):
            scores.canonical(fingerprint)


def test_validation_and_joins(spark):
    h = heads(spark, {"a": "x", "b": "y"})
    ok = spark.createDataFrame([("a", 0.1), ("b", -1.0)], "headline_id string, s double")
    scores.validate(h, ok, ["s"])
    assert scores.joined(h, ok.where("s > 0")).where("s IS NULL").count() == 1
    for bad in (ok.where("s > 0"), ok.union(ok), ok.withColumn("s", F.lit(float("nan"))), ok.withColumn("s", F.lit(1.5)), ok.drop("s")):
        with pytest.raises(scores.IncompleteScores):
            scores.validate(h, bad, ["s"])
    with pytest.raises(scores.IncompleteScores):
        scores.joined(h, ok.union(ok))


def test_scorers_of_batches_and_classes(spark, tmp_path):
    df = heads(spark, {str(k): "x" * (k % 7) for k in range(50)} | {"n": None})
    scorer = scores.BatchScorer("m", {"v": 1}, lambda: lambda texts: [len(t) / 10 for t in texts], batch=4)
    assert all(abs(r["s"] - len(r["text"] or "") / 10) < 1e-6 for r in df.select("text", scorer.column(F.col("text")).alias("s")).collect())
    sorter = scores.Classifier("c", ["neg", "mid", "pos"], {"v": 1}, lambda: lambda texts: [[0.2, 0.4, 0.4] if t else [0.5, 0.25, 0.25] for t in texts])
    assert {(r["text"] or "") != "": r["p"] for r in df.select("text", scores.predictions(sorter, F.col("text")).alias("p")).collect()} == {True: "mid", False: "neg"}
    assert [r[0] for r in df.orderBy("headline_id").limit(3).select(scores.predictions(scorer, F.col("text"), (0.0, 0.15))).collect()] == [0 if len("x" * (k % 7)) == 1 else 1 if k % 7 > 1 else -1 for k in (0, 1, 10)]
    for call in (lambda: scores.predictions(sorter, F.col("text"), (0, 1)), lambda: scores.predictions(scorer, F.col("text"))):
        with pytest.raises(ValueError):
            call()
    scores.register("m", lambda: scorer)
    assert scores.build(["m"]) == [scorer]
    with pytest.raises(KeyError):
        scores.build(["nobody"])
    (tmp_path / "d.csv").write_text("Word,POSITIVE,Negative\nGood,2009,0\nbad,0,2011\n both ,1,1\nnone,0,0\n")
    assert scores.dictionary(spark, f"{tmp_path}/d.csv") == (["both", "good"], ["bad", "both"])
    (tmp_path / "e.csv").write_text("Word,POSITIVE,Negative\nGood,1,0\n")
    with pytest.raises(ValueError):
        scores.dictionary(spark, f"{tmp_path}/e.csv")


def test_staged_runs_publish_all_or_nothing(spark, tmp_path):
    out, source = tmp_path / "out", tmp_path / "in.txt"
    source.write_text("data")
    with files.StagedRun({"tables": out}, inputs={"in": source}) as run:
        run.csv("tables", "a.csv", spark.range(3))
        run.path_for("tables", "b.txt").write_text("b")
    assert (out / "a.csv").read_text() == "id\n0\n1\n2\n" and files.verify_published(out, {"tables": out}) == []
    for fail in (RuntimeError, None):
        with pytest.raises((RuntimeError, files.Incomplete)), files.StagedRun({"tables": out}) as run:
            path = run.path_for("tables", "c.txt")
            if fail:
                path.write_text("c")
                raise fail
    assert sorted(p.name for p in out.iterdir()) == ["a.csv", "b.txt", "manifest.json"]
    with files.StagedRun({"tables": out}, inputs={"in": source}) as run:
        run.path_for("tables", "a.csv").write_text("new")
    assert sorted(p.name for p in out.iterdir()) == ["a.csv", "manifest.json"]
    (out / "a.csv").write_text("touched")
    source.write_text("other")
    assert files.verify_published(out, {"tables": out}) == ["changed: tables/a.csv", "input changed: in"]
    (out / "a.csv").unlink()
    assert files.verify_published(out, {"tables": out})[0] == "missing: tables/a.csv"
    with pytest.raises(files.Incomplete):
        files.verify_published(tmp_path, {"tables": out})


def test_provenance_and_readiness(spark, tmp_path):
    source = tmp_path / "in.txt"
    source.write_text("1")
    made = files.provenance({"in": str(source)}, {"lags": 5}, "g1")
    files.write_with_provenance(spark.range(4), f"{tmp_path}/panel", made)
    rows, recorded = files.read_with_provenance(spark, f"{tmp_path}/panel")
    assert rows.count() == 4 and files.check_provenance(recorded, made) == []
    source.write_text("2")
    assert len(files.check_provenance(recorded, files.provenance({"in": str(source)}, {"lags": 6}, "g2"))) == 3 and files.check_provenance(None, made)
    gates = [files.Gate("a", lambda: []), files.Gate("b", lambda: ["no file"]), files.Gate("c", lambda: [], ("b",)), files.Gate("d", lambda: [], ("a",))]
    assert [(n, s) for n, s, _ in files.readiness(gates)] == [("a", "ready"), ("b", "failed"), ("c", "blocked"), ("d", "ready")]


RAW = '''Date,Article_title,Stock_symbol,Url
2024-01-02 10:00:00 UTC,"First
line two","a, b",https://www.example.com/1
2024-01-02 09:00:00 UTC,Other words,c,https://x.example.com/2
2024-01-02 10:00:05 UTC,First line two,d,https://example.com/3
bad,Other,,https://example.com/4
2024-01-03 00:00:00 UTC,Elsewhere,,https://notexample.com/5
'''


def test_from_a_raw_file_to_a_corpus(spark, tmp_path):
    source = tmp_path / "raw.csv"
    source.write_text(RAW)
    target, digest = tmp_path / "store" / "raw.csv", hashlib.sha256(RAW.encode()).hexdigest()
    with pytest.raises(files.Incomplete):
        files.acquire(source, target, len(RAW), "0" * 64)
    assert not target.exists()
    with pytest.raises(files.Incomplete):
        files.deduplicated_corpus(spark, str(source), f"{tmp_path}/c", ["example.com"])
    files.acquire(source, target, len(RAW.encode()), digest, chunk=7)
    with pytest.raises(files.Incomplete):
        files.acquire(source, target, len(RAW), digest)
    counts = files.deduplicated_corpus(spark, str(target), f"{tmp_path}/c", ["example.com"])
    assert counts["rows"] == 3 and counts["exact_dropped"] == 1
    clean = {r["source_row_id"]: r for r in spark.read.parquet(f"{tmp_path}/c/clean").collect()}
    assert [clean[k]["text_norm"] for k in sorted(clean)] == ["other words", "first line two"] and clean[1]["tickers"] == ["A", "B", "D"] and clean[1]["members"] == 2
    target.write_text(RAW + "x")
    with pytest.raises(files.Incomplete):
        files.require_acquired(target)
    assert news.load(spark, str(source), ["example.com"]).count() == 3
    (tmp_path / "odd.csv").write_text("a,b\n1,2\n3\n4,5\n")
    assert news.lenient(spark, f"{tmp_path}/odd.csv", ["b"]).count() in (2, 3)


def test_byte_ranges_give_whole_lines(spark, tmp_path):
    lines = [f"line {k} " + "x" * (k % 40) for k in range(5000)]
    (tmp_path / "big.txt").write_text("\n".join(lines) + "\n")
    found = files.sample_lines(spark, f"{tmp_path}/big.txt", 5, 2000).collect()
    raw = (tmp_path / "big.txt").read_bytes()
    assert {r["slice"] for r in found} == set(range(5)) and all(raw[r["at"] :].startswith(r["line"].encode() + b"\n") and r["line"] in set(lines) for r in found)
    whole = files.sample_lines(spark, f"{tmp_path}/big.txt", 1, 10**7)
    assert [r["line"] for r in whole.orderBy("at").collect()] == lines


def test_annotation_sets(spark):
    r = random.Random(5)
    rows = spark.createDataFrame([(k, f"text {k}", r.randint(0, 40), k % 2) for k in range(200)], "id int, text string, group_id int, label int")
    own = annotate.parts(rows, 40)
    assert own.groupBy("group_id").agg(F.countDistinct("part").alias("n")).where("n > 1").count() == 0
    assert 40 <= own.where("part = 'calibration'").count() < 60 and sorted(map(str, own.collect())) == sorted(map(str, annotate.parts(rows.repartition(7), 40).collect()))
    assert annotate.pilot(own, 10).where("part <> 'calibration'").count() == 0 and annotate.second_annotator(own).count() == 40
    with pytest.raises(ValueError):
        annotate.pilot(own, 1000)
    sheet = annotate.blind(own)
    assert sheet.columns == ["place", "id", "text"] and [x["id"] for x in sheet.orderBy("place").collect()] != sorted(x["id"] for x in sheet.collect())
    split = {(x["label"], x["part"]): x["n"] for x in annotate.split(rows, "label").groupBy("label", "part").agg(F.count("*").alias("n")).collect()}
    assert split == {(0, "fit"): 20, (1, "fit"): 20, (0, "evaluate"): 80, (1, "evaluate"): 80}
    labels = rows.select("id", F.lit("good").alias("label"))
    assert annotate.joined_labels(labels, own.drop("label"), ("good",)).count() == 200
    for bad in (labels.limit(10), labels.union(labels), labels.withColumn("label", F.lit("odd")), labels.withColumn("id", F.col("id") + 1)):
        with pytest.raises(ValueError):
            annotate.joined_labels(bad, own.drop("label"), ("good",))
    assert annotate.joined_measurements(rows.select("id", "text"), labels).count() == 200
    for first, second in ((rows.select("id", "label"), labels), (rows.select("id", "text"), labels.limit(5)), (rows.select("id", "text").limit(5), labels)):
        with pytest.raises(ValueError):
            annotate.joined_measurements(first, second)


def test_verdicts_on_sources(spark):
    dates = spark.range(300).selectExpr("'d' AS source", "timestamp_ntz '2024-01-01' + make_interval(0, 0, 0, int(id % 9)) AS ts", "if(id % 10 = 0, 'привет', 'hi') AS text", "array('T') AS tickers")
    times = spark.range(400).selectExpr("'t' AS source", "timestamp_ntz '2024-01-01' + make_interval(0, 0, 0, 0, 0, int(id * 7 % 1440)) AS ts", "'hi' AS text", "CAST(array() AS array<string>) AS tickers")
    rows = {r["source"]: r for r in audit.evidence(dates.union(times)).collect()}
    assert (rows["d"]["verdict"], rows["d"]["modal_time"], rows["d"]["likely_non_english"], rows["d"]["tagged_share"]) == ("date-only", "00:00", True, 1.0)
    assert rows["t"]["verdict"] == "intraday" and abs(rows["t"]["before_share"] + rows["t"]["after_share"] + rows["t"]["in_session_share"] - 1) < 1e-12
    notes = audit.screen_notes(audit.screened(audit.evidence(dates.union(times)), 100))
    assert len(notes) == 3 and "d" in notes[0]
    for df, refuse in ((dates, audit.refuse_dates), (times, audit.refuse_times)):
        with pytest.raises(ValueError):
            refuse(df, "ts")
        refuse(df.limit(100), "ts")
    audit.refuse_dates(times, "ts")
    audit.refuse_times(dates, "ts")
