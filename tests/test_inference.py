"""Ingest, shifts, tail probabilities and bootstrap against plain loops and known values."""

import numpy as np
import pytest

from tidepanel.operators import inference
from tidepanel.plans import ingest
from tidepanel.sources import news


def test_csv_reasons(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text(
        'Date,Article_title,Stock_symbol,Url\n2024-01-02 00:00:00 UTC,"One, ""two""\nthree","a, b,,",https://www.example.com/x\n'
        "n/a,Bad stamp,,https://example.com/\n2024-13-02 00:00:00 UTC,No month,,https://example.com/\n2024-01-02 00:00:00 UTC,Other,,https://notexample.com/\n"
        "2024-01-02 00:00:00 UTC,,,https://example.com/\n2024-01-03 00:00:00 UTC,Late,,https://a.example.com/\n2024-01-02 23:59:59 UTC,!!!,,https://example.com/\n"
    )
    rows = news.flagged(news.scan(spark, str(path)), ["example.com"], "2024-01-01", "2024-01-02")
    assert {r["reason"]: r["n"] for r in news.counters(rows).collect()} == {"kept": 1, "bad_stamp": 2, "wrong_host": 1, "empty_text": 1, "out_of_window": 1, "no_words": 1}
    (row,) = news.parsed(rows).collect()
    assert (row["text_norm"], row["tickers"], row["host"], len(row["headline_id"])) == ("one two three", ["A", "B"], "example.com", 40)


def test_missing_column(spark, tmp_path):
    (tmp_path / "raw.csv").write_text("Date,Other\n2024-01-02,x\n")
    with pytest.raises(ValueError):
        news.scan(spark, str(tmp_path / "raw.csv"))


def test_tails():
    assert abs(inference.chi_square_tail(7.78186694, 3) - 0.0507417) < 1e-6
    assert abs(inference.chi_square_tail(9.656, 3) - 0.02173) < 1e-5
    assert abs(inference.chi_square_tail(2.0, 2) - np.exp(-1)) < 1e-12


def test_shifts_are_refits(spark):
    g = np.random.default_rng(3)
    data = g.normal(size=(40, 3))
    rows = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(data)], "pos int, z double, y double, c double").repartition(4)
    got = {r["k"]: r["coefficient"] for r in inference.shift_coefficients(rows, "z", "y", ["c"]).collect()}
    assert sorted(got) == list(range(40))
    for k, b in got.items():
        design = np.column_stack([np.ones(40), np.roll(data[:, 0], -k), data[:, 2]])
        assert abs(np.linalg.lstsq(design, data[:, 1], rcond=None)[0][1] - b) < 1e-10


def test_bootstrap_of_groups(spark):
    g = np.random.default_rng(5)
    t, a, b, grp = (g.integers(0, m, 200) for m in (2, 2, 2, 20))
    rows = spark.createDataFrame([tuple(map(int, r)) for r in zip(t, a, b, grp, strict=True)], "t int, a int, b int, g int")
    got = {r["draw"]: r["difference"] for r in inference.group_bootstrap(rows, "t", "a", "b", "g", [0, 1], 50, block=7).collect()}
    f1 = lambda t, p: np.mean([2 * ((t == c) & (p == c)).sum() / ((t == c).sum() + (p == c).sum()) for c in (0, 1)])
    assert abs(got[-1] - (f1(t, a) - f1(t, b))) < 1e-12
    for d in range(50):
        times = np.random.default_rng([7, d]).multinomial(20, np.full(20, 1 / 20))
        at = np.repeat(np.arange(200), times[grp])
        assert abs(got[d] - (f1(t[at], a[at]) - f1(t[at], b[at]))) < 1e-12
    right = {r["draw"]: r["accuracy"] for r in inference.group_bootstrap(rows, "t", "a", "b", "g", [0, 1], 1).collect()}
    assert abs(right[-1] - ((t == a).mean() - (t == b).mean())) < 1e-12


def test_registered_bootstrap_takes_the_default_draws(spark, monkeypatch):
    draws = []
    real = inference.group_bootstrap
    monkeypatch.setattr(inference, "group_bootstrap", lambda *a, **k: draws.append((df := real(*a, **k)).count() - 1) or df)
    monkeypatch.setattr(ingest.Q, "judged", lambda s, d: s.range(100).selectExpr("id AS doc_id", "int(id % 2) AS quality", "int(id % 7 = 0) AS toxic", "int(id % 3 = 0) AS long", "(id % 5 - 2) / 2.0D AS score"))
    assert ingest.group_bootstrap(spark, "").count() == 1 and draws == [10_000]


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "pos int, z double, y double")
    assert inference.shift_coefficients(none, "z", "y").count() == 0
