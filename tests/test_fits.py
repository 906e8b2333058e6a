"""Fits against plain least squares and loops over lags."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import fits, inference, sessions, stats, studies


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(1)
    n = 320
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=k) for k in range(n)]
    ret, rv, vol = 0.01 * rng.normal(size=n), np.abs(rng.normal(size=n)) * 1e-4, 10 + 0.002 * np.arange(n) + 0.1 * rng.normal(size=n)
    tone = {s: 0.2 * rng.normal(size=n) for s in "ab"}
    news = rng.integers(0, 12, n)
    rows = []
    for k in range(n):
        own = [float(tone[s][k]) if news[k] and k % 37 else None for s in "ab"]
        rows.append((days[k], k, int(news[k]), own[0], 0.1 + 0.01 * (k % 7) if news[k] >= 5 else None, own[1], 0.2 if news[k] >= 5 else None))
    day = spark.createDataFrame(rows, "session date, pos int, n int, s_a double, d_a double, s_b double, d_b double")
    bars = spark.createDataFrame([(days[k], 1.0, float(ret[k]) if k % 53 else None, float(rv[k]), float(vol[k])) for k in range(n)], "session date, close double, ret double, range_var double, log_volume double")
    return sessions.panel(day, bars).persist()


def arrays(panel, scorer="a", horizon=1):
    frame = panel.orderBy("pos").toPandas()
    lead = f"ret_lead{horizon}"
    keep = frame[[lead, f"s_{scorer}", *fits.CONTROLS]].notna().all(axis=1) & (frame["n"] > 0)
    rows = frame[keep]
    z = (rows[f"s_{scorer}"] - rows[f"s_{scorer}"].mean()) / rows[f"s_{scorer}"].std(ddof=1)
    x = np.column_stack([np.ones(len(rows)), z, rows[list(fits.CONTROLS)].to_numpy(float)])
    return x, rows[lead].to_numpy(float), rows["pos"].to_numpy(int)


def sandwich(x, u, pos, lags):
    g = x * u[:, None]
    s = g.T @ g
    for lag in range(1, lags + 1):
        for i in range(len(g)):
            for j in range(i):
                if pos[i] - pos[j] == lag:
                    s += (1 - lag / (lags + 1)) * (np.outer(g[i], g[j]) + np.outer(g[j], g[i]))
    bread = np.linalg.inv(x.T @ x)
    return bread @ s @ bread


def test_primary_is_least_squares_with_both_spacings(panel):
    x, y, pos = arrays(panel)
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    found = fits.primary(panel)
    assert np.allclose(found.beta, beta, rtol=1e-7) and found.n == len(y)
    for spacing, at in (("session", pos), ("row", np.arange(len(y)))):
        assert np.allclose(found.cov(spacing=spacing), sandwich(x, y - x @ beta, at, 5), rtol=1e-6)
    assert np.allclose(found.cov(2), sandwich(x, y - x @ beta, pos, 2), rtol=1e-6)


def test_contrast_stacks_both_equations(panel):
    frame = panel.where("s_b IS NOT NULL")
    found = fits.contrast(panel, ("a", "b"))
    x, y, pos = arrays(panel)
    other = arrays(panel, "b")[0]
    beta = [np.linalg.lstsq(d, y, rcond=None)[0] for d in (x, other)]
    pull = [np.linalg.inv(d.T @ d)[1] @ (d * (y - d @ b)[:, None]).T for d, b in zip((x, other), beta, strict=True)]
    h = pull[0] - pull[1]
    var = h @ h + sum(2 * (1 - (pos[i] - pos[j]) / 6) * h[i] * h[j] for i in range(len(h)) for j in range(i) if pos[i] - pos[j] <= 5)
    assert frame.count() and math.isclose(found["delta"], beta[0][1] - beta[1][1], rel_tol=1e-7) and math.isclose(found["se"], math.sqrt(var), rel_tol=1e-6)
    twice = fits.contrast(panel.withColumn("s_b", 2 * F.col("s_a")), ("a", "b"))
    assert twice["degenerate"] and abs(twice["delta"]) < 1e-12
    resid = x[:, 1] - np.delete(x, 1, axis=1) @ np.linalg.lstsq(np.delete(x, 1, axis=1), x[:, 1], rcond=None)[0]
    assert math.isclose(found["vif_first"], (len(y) - 1) / (resid @ resid), rel_tol=1e-7)


def test_ledger_reconciles_and_keeps_its_order(panel):
    rows = {r["reason"]: r for r in fits.ledger(panel).collect()}
    assert sum(r["first"] for r in rows.values()) == panel.count() and rows["eligible"]["first"] == fits.eligible(panel).count()
    assert all(r["any"] >= r["first"] for r in rows.values()) and rows["missing_control"]["any"] >= 62
    with pytest.raises(ValueError):
        fits.require_calendar(panel.where("pos <> 100"))
    with pytest.raises(KeyError):
        fits.ledger(panel.drop("volume_gap"))


def test_classes_of_intervals(spark):
    rows = [(-4.903076, 1.414825), (0.1, 3.0), (-9.0, 9.0), (6.0, 9.0), (-4.96, -0.04), (-5.05, 1.0)]
    got = [(r["association"], r["small"], r["boundary"]) for r in fits.classified(spark.createDataFrame(rows, "bps_low double, bps_high double")).collect()]
    assert got == [(False, True, True), (True, True, True), (False, False, False), (True, False, False), (False, True, True), (False, True, True)]


def test_families_take_exactly_their_tests(spark):
    rows = [(s, h, 0.01 * (1 + k)) for k, (s, h) in enumerate((s, h) for s in "abc" for h in fits.HORIZONS)]
    kind = "scorer string, horizon int, p double"
    got = {(r["scorer"], r["horizon"]): r for r in fits.return_families(spark.createDataFrame(rows, kind)).collect()}
    p = np.array([r[2] for r in rows[1:]])
    bh = np.minimum(1, np.minimum.accumulate((p * 14 / np.arange(1, 15))[::-1])[::-1])
    assert got["a", 1]["bh"] is None and got["a", 1]["claim"]
    assert np.allclose([got[s, h]["bh"] for s, h, _ in rows[1:]], bh) and np.allclose([got[s, h]["by"] for s, h, _ in rows[1:]], np.minimum(1, bh * sum(1 / i for i in range(1, 15))))
    for bad in (rows[:-1], rows + rows[:1], [*rows[:-1], ("c", 5, None)], [*rows[:-1], ("c", 6, 0.5)]):
        with pytest.raises(ValueError):
            fits.return_families(spark.createDataFrame(bad, kind))


def test_joint_wald_halves_and_timing(panel):
    found = fits.joint_fit(panel.withColumn("s_a", F.col("s_a") - 0.01), "a", "log_volume_lead1")
    w, df, p = fits.wald(found)
    at = [found.names.index(t) for t in fits.JOINT_TERMS]
    assert math.isclose(w, found.beta[at] @ np.linalg.inv(found.cov()[np.ix_(at, at)]) @ found.beta[at], rel_tol=1e-9) and df == 3
    assert abs(inference.chi_square_tail(7.78186694, 3) - 0.0507417) < 1e-6 and 0 <= p <= 1
    split = {r[0]: r for r in fits.halves(panel)}
    assert split["first"][1] + split["second"][1] == split["full"][1] == split["difference"][1]
    assert math.isclose(split["difference"][2], split["first"][2] - split["second"][2]) and math.isclose(split["difference"][3], math.hypot(split["first"][3], split["second"][3]))
    x, y, _ = arrays(panel)
    shifted = [np.linalg.lstsq(np.column_stack([np.roll(x[:, 1], -k), np.delete(x, 1, axis=1)]), y, rcond=None)[0][0] for k in range(len(y))]
    got = fits.timing(panel)
    r = np.round(np.array(shifted) / 1e-5)
    assert math.isclose(got["observed_bps"], shifted[0] * 1e4, rel_tol=1e-6)
    assert math.isclose(got["percentile"], ((r[1:] < r[0]).sum() + 0.5 * (r[1:] == r[0]).sum()) / len(y)) and got["gaps"] > 0
    assert fits.summary(panel)["sensitivities"] == 7


def test_precision_fits_no_tone_to_the_outcome(panel):
    x, y, pos = arrays(panel)
    c = np.delete(x, 1, axis=1)
    u, v = (a - c @ np.linalg.lstsq(c, a, rcond=None)[0] for a in (y, x[:, 1]))
    got = fits.precision(panel)
    assert math.isclose(got["sd_u"], u.std(ddof=1), rel_tol=1e-7) and math.isclose(got["sd_v"], v.std(ddof=1), rel_tol=1e-7)
    kappa = math.sqrt(sandwich(np.ones((len(u), 1)), u, pos, 5)[0, 0]) / (u.std(ddof=1) / math.sqrt(len(u)))
    assert math.isclose(got["kappa_session"], kappa, rel_tol=1e-6)
    assert math.isclose(got["h1_bps"], 1.96 * 1e4 / math.sqrt(len(y)) * y.std(ddof=1), rel_tol=1e-9)
    with pytest.raises(ValueError):
        fits.precision(panel.withColumn("s_a", F.when(F.col("s_a").isNotNull(), 1.0)))


def test_bands_of_three_classes(spark):
    rng = np.random.default_rng(2)
    truth = rng.integers(-1, 2, 300)
    score = np.clip(0.4 * truth + 0.3 * rng.normal(size=300), -1, 1)
    best, band = -1.0, None
    grid = np.linspace(-1, 1, 21)
    for lo in grid:
        for hi in grid[grid >= lo]:
            pred = np.where(score <= lo, -1, np.where(score > hi, 1, 0))
            f1 = 0.0
            for v in (-1, 0, 1):
                hit, all_ = ((pred == v) & (truth == v)).sum(), (pred == v).sum() + (truth == v).sum()
                f1 += 2 * hit / all_ / 3 if all_ else 0
            if f1 > best + 1e-12:
                best, band = f1, (lo, hi)
    df = spark.createDataFrame([(int(t), float(s)) for t, s in zip(truth, score, strict=True)], "truth int, score double")
    got = stats.best_band(stats.threshold_grid(df, "truth", "score", 21)).first()
    assert np.allclose((got["low"], got["high"], got["macro_f1"]), (*band, best))


def test_simulations_give_what_is_predicted(spark):
    rows = studies.attenuation(spark).collect()
    assert len(rows) == 21 and all(abs(r["simulated"] - r["predicted"]) < 0.02 for r in rows)
    got = {(r["gap"], r["rho"]): r for r in studies.spacing(spark, sessions=400, reps=4, gaps=(0.0, 0.3), rhos=(0.0, 0.6)).collect()}
    assert all(abs(got[0.0, r]["mean"] - 1) < 1e-12 for r in (0.0, 0.6)) and got[0.3, 0.6]["percent"] > 0.1 and got[0.3, 0.0]["kept"] < 320
