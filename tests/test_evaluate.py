"""Labels from sheets to figures, the market with its warm-up, annotation sets as files."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidepanel.operators import evaluate, fits
from tidepanel.sources import files, market

DECLARED = {
    "rubric_version": "1", "rubric_sha256": "a" * 64, "annotator_role": "student", "instrument": "sheet", "label_source": "human", "blind_to_model_outputs": True, "independent_of_analyst": True,
    "scores_existed": False, "presentation_order_seed": 3, "deviations": [], "sessions": [{"start": "2024-01-01T10:00:00+00:00", "end": "2024-01-01T11:00:00+00:00"}],
}


def test_declarations():
    evaluate.check_declaration(DECLARED)
    for key, value in (("rubric_version", " "), ("rubric_sha256", "A" * 64), ("label_source", "model"), ("blind_to_model_outputs", "yes"), ("scores_existed", 0), ("deviations", None), ("sessions", []),
                       ("sessions", [{"start": "2024-01-01T10:00:00", "end": "2024-01-01T11:00:00"}]), ("sessions", [{"start": "2024-01-01T10:00:00+00:00", "end": "2024-01-01T09:00:00+00:00"}])):
        with pytest.raises(ValueError):
            evaluate.check_declaration({**DECLARED, key: value})


def test_sheets(spark, tmp_path):
    (tmp_path / "split.csv").write_text("id,group_id,part\na,0,calibration\nb,0,calibration\nc,1,evaluation\nd,2,evaluation\n")
    split = market.load_split(spark, f"{tmp_path}/split.csv")
    blind = spark.createDataFrame([(k, f"text {k}") for k in "abcd"], "id string, text string")
    (tmp_path / "who.json").write_text(json.dumps(DECLARED))
    sheet = "id,text,label,mixed,hard\na,text a,negative,0,1\nb,text b,unusable,0,0\nc,text c,,0,0\n"
    (tmp_path / "sheet.csv").write_text(sheet)
    got = {r["id"]: (r["label"], r["hard"]) for r in market.load_labels(spark, f"{tmp_path}/sheet.csv", f"{tmp_path}/who.json", split, "calibration", blind).collect()}
    assert got == {"a": (-1, 1), "b": (None, 0)}
    for bad in (sheet.replace("negative", ""), sheet.replace("text a", "other"), sheet + "z,text z,neutral,0,0\n", sheet.replace("0,1\n", "0,2\n"), sheet.replace("b,text b,unusable,0,0\n", "")):
        (tmp_path / "sheet.csv").write_text(bad)
        with pytest.raises(ValueError):
            market.load_labels(spark, f"{tmp_path}/sheet.csv", f"{tmp_path}/who.json", split, "calibration", blind)
    for bad in ("id,group_id,part\na,0,calibration\na,1,evaluation\n", "id,group_id,part\na,0,calibration\nb,0,evaluation\n", "id,group_id,part\na,0,other\n"):
        (tmp_path / "split.csv").write_text(bad)
        with pytest.raises(ValueError):
            market.load_split(spark, f"{tmp_path}/split.csv")


def test_from_bands_to_figures(spark):
    r = random.Random(1)
    rows = []
    for k in range(240):
        label = r.choice([-1, 0, 1])
        rows.append((k, k // 3, "calibration" if k < 90 else "evaluation", None if k % 40 == 0 else label, max(-1.0, min(1.0, 0.5 * label + r.gauss(0, 0.2))), max(-1.0, min(1.0, r.gauss(0, 0.5))), r.choice([-1, 0, 1]), int(k % 5 == 0)))
    df = spark.createDataFrame(rows, "id int, group_id int, part string, label int, good double, poor double, net int, hard int").persist()
    labels, scores = df.select("id", "group_id", "part", "label", "hard"), df.select("id", "good", "poor", "net")
    one = lambda part, d: d.join(labels.where(F.col("part") == part).select("id"), "id", "left_semi")
    bands = evaluate.calibrate(one("calibration", labels), one("calibration", scores), ["good", "poor"])
    assert bands["good"][0] < 0 < bands["good"][1] or bands["good"][0] <= bands["good"][1]
    found = evaluate.evaluate_frozen(one("evaluation", labels), one("evaluation", scores), bands, bands, ["net"], draws=100)
    assert found["requested"] == 150 and found["usable"] == 147 and found["ladder"]["good"]["macro_f1"] > 0.8 > found["ladder"]["poor"]["macro_f1"]
    contrast = found["contrasts"]["good", "poor"]
    assert contrast["low"] < contrast["difference"] < contrast["high"] and contrast["low"] > 0 and contrast["mcnemar_p"] < 0.01
    assert evaluate.confident(labels).count() == 192
    for call in (
        lambda: evaluate.calibrate(labels, scores, ["good"]), lambda: evaluate.evaluate(one("calibration", labels), one("calibration", scores), ["net"]),
        lambda: evaluate.evaluate(one("evaluation", labels), one("evaluation", scores), ["good"]), lambda: evaluate.evaluate_frozen(one("evaluation", labels), one("evaluation", scores), bands, {"good": (0, 1)}),
        lambda: evaluate.evaluate(one("evaluation", labels), one("evaluation", scores).limit(3), ["net"]), lambda: evaluate.calibrate(one("calibration", labels).where("label = 1"), one("calibration", scores), ["good"]),
    ):
        with pytest.raises(ValueError):
            call()


def test_agreement(spark):
    first = spark.createDataFrame([(k, k % 3 - 1 if k != 5 else None) for k in range(30)], "id int, label int")
    second = first.where("id < 20").withColumn("label", F.when(F.col("id") == 7, -1).otherwise(F.col("label")))
    got = evaluate.agreement(first, second).first()
    assert (got["matched"], got["usable"]) == (20, 19) and 0.8 < got["kappa"] < 1
    same = spark.createDataFrame([(1, 1), (2, 1)], "id int, label int")
    assert evaluate.agreement(same, same).first()["kappa"] is None
    for bad in (second.union(second), second.withColumn("id", F.col("id") + 100)):
        with pytest.raises(ValueError):
            evaluate.agreement(first, bad)


def test_market_and_annotation_files(spark, tmp_path):
    holidays = spark.createDataFrame([("2024-01-01",)], "day string")
    days = market.with_warm_up(spark, "2024-01-02", "2024-01-31", holidays, 5)
    assert days.count() == 27 and days.where("NOT in_window").count() == 5 and str(days.agg(F.max("session")).first()[0]) == "2024-01-31"
    bars = days.where("pos <> 9").select("session", (F.col("pos") + 1.0).alias("close"), (F.col("pos") + 2.0).alias("high"), (F.col("pos") + 1.0).alias("low"), F.lit(5.0).alias("volume"))
    rows = market.load(bars, bars.select("session", "close"), days)
    assert rows.where("ret IS NULL").count() == 3 and market.missing(rows).first()["without_price"] == 1
    market.write(rows, f"{tmp_path}/market", {"lags": 5})
    again, told = files.read_with_provenance(spark, f"{tmp_path}/market")
    assert again.count() == 27 and told["counts"]["warm_up"] == 5
    name = json.loads((tmp_path / "market" / "provenance.json").read_text())["rows"]
    assert files.footer(f"{tmp_path}/market/{name}")[1] == 27
    texts = spark.range(300).selectExpr("id", "concat('word', id % 150, ' and more of it') AS text", "concat('word', id % 150, ' and more of it') AS text_norm", "concat('s', id % 4) AS stratum")
    counts = market.build_annotation_set(texts, f"{tmp_path}/set", 80, 20, 10)
    assert counts["drawn"] == 80 and counts["calibration"] >= 20 and files.verify_published(f"{tmp_path}/set", {"set": f"{tmp_path}/set"}) == []
    assert (tmp_path / "set" / "to_label_primary.csv").read_text().startswith("id,text\n") and len((tmp_path / "set" / "pilot_items.csv").read_text().split()) == 11


def test_legacy_fits(spark):
    r = random.Random(3)
    rows = spark.createDataFrame([(k, 0.1 * k + r.random(), r.random() if k % 7 else None) for k in range(60)], "pos int, y double, x double")
    found = fits.listwise(rows, ["x"], "y", 2)
    assert found.n == 51
    with pytest.raises(ValueError):
        fits.fit(rows, ["x"], "y")
    with pytest.raises(RuntimeError):
        fits.contemporaneous(rows)
    with pytest.raises(KeyError):
        fits.contemporaneous(rows, admissible=True)
    assert fits.effect_size(0.001, 0.0005, 2.0) == pytest.approx((20.0, 0.4, 39.6))
