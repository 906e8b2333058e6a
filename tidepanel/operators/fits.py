"""Fits of returns and activity on tone, over the panel of one row a session.

Spark sums cross products and lagged products over the (persisted) panel; the driver solves systems of as many equations as there are terms.
A lag counts sessions (``session``) or retained rows (``row``); every fit has both errors. Columns of the panel: session, pos, n, s_<scorer>, d_<scorer>, ret,
range_var, volume_gap, log_volume, and ret_lead<h>, range_var_lead1, log_volume_lead1.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepanel.operators import inference

CONTROLS = ("ret", "range_var", "volume_gap")
#: Fixed order: a session is charged to the first reason that holds.
REASONS = ("no_lead_return", "zero_news", "missing_tone", "missing_control")
JOINT_REASONS = ("no_outcome", "zero_news", "missing_tone", "dispersion_undefined", "missing_control")
JOINT_TERMS = ("z_s", "z_abs_s", "z_d")
LAGS, SPACINGS, BPS, MARGIN, SECONDARY = 5, ("session", "row"), 10_000.0, 5.0, 14
HORIZONS = (1, 2, 3, 4, 5)
QUANTILE = NormalDist().inv_cdf(0.975)


# Samples


def _flags(panel: DataFrame, scorer: str, horizon: int) -> dict[str, Column]:
    for c in (f"s_{scorer}", "n", f"ret_lead{horizon}", *CONTROLS):
        if c not in panel.columns:
            raise KeyError(f"the panel has no {c}")
    missing = [F.col(c).isNull() for c in CONTROLS]
    return {
        "no_lead_return": F.col(f"ret_lead{horizon}").isNull(), "zero_news": F.coalesce(F.col("n"), F.lit(0)) < 1,
        "missing_tone": F.col(f"s_{scorer}").isNull(), "missing_control": missing[0] | missing[1] | missing[2],
    }


def _reason(flags: dict[str, Column]) -> Column:
    out = F.lit(None).cast("string")
    for name, flag in reversed(flags.items()):
        out = F.when(flag, name).otherwise(out)
    return out


def _ledger(panel: DataFrame, flags: dict[str, Column]) -> DataFrame:
    first = _reason(flags)
    rows = [F.struct(F.lit(r).alias("reason"), F.count_if(first == r).alias("first"), F.count_if(f).alias("any")) for r, f in flags.items()]
    kept = F.struct(F.lit("eligible").alias("reason"), F.count_if(first.isNull()).alias("first"), F.count_if(first.isNull()).alias("any"))
    return panel.agg(F.array(kept, *rows).alias("all")).select(F.inline("all"))


def ledger(panel: DataFrame, scorer: str = "a", horizon: int = 1) -> DataFrame:
    """(reason, first, any): sessions charged to a reason, and sessions it holds for; eligible ones besides."""
    return _ledger(panel, _flags(panel, scorer, horizon))


def eligible(panel: DataFrame, scorer: str = "a", horizon: int = 1) -> DataFrame:
    """The sessions that a fit uses."""
    return panel.where(_reason(_flags(panel, scorer, horizon)).isNull())


def commonly_eligible(panel: DataFrame, scorers: tuple[str, ...], horizon: int = 1) -> DataFrame:
    """Sessions eligible for every scorer."""
    if len(scorers) < 2 or len(set(scorers)) != len(scorers):
        raise ValueError(f"at least two different scorers, not {scorers}")
    for scorer in scorers:
        panel = eligible(panel, scorer, horizon)
    return panel


def common_ledger(panel: DataFrame, scorers: tuple[str, ...], horizon: int = 1) -> DataFrame:
    """(scorer, eligible, common, lost)."""
    ok = {s: _reason(_flags(panel, s, horizon)).isNull() for s in scorers}
    both = F.lit(True)
    for flag in ok.values():
        both = both & flag
    return panel.agg(F.array(*[F.struct(F.lit(s).alias("scorer"), F.count_if(f).alias("eligible"), F.count_if(both).alias("common")) for s, f in ok.items()]).alias("all")).select(
        F.inline("all")).withColumn("lost", F.col("eligible") - F.col("common"))


def calendar_breaks(panel: DataFrame, horizon: int = 1, base: str = "ret") -> DataFrame:
    """Sessions whose stored lead isn't the value so many rows later, or whose date doesn't come after the one before."""
    order = W.orderBy("pos")
    stored, again = F.col(f"{base}_lead{horizon}"), F.col("_again")
    whole = panel.withColumns({"_again": F.lead(base, horizon).over(order), "_before": F.lag("session").over(order)})
    differs = (stored.isNull() != again.isNull()) | (F.abs(stored - again) > 1e-8 + 1e-5 * F.abs(again))
    late = F.coalesce(F.col("session") <= F.col("_before"), F.lit(False))
    return whole.where(F.coalesce(differs, F.lit(False)) | late).select("session", stored.alias("stored"), again.alias("found"))


def require_calendar(panel: DataFrame, horizon: int = 1) -> None:
    """Refuse a panel that isn't the whole calendar: its leads aren't its next rows."""
    n = calendar_breaks(panel, horizon).count()
    if n:
        raise ValueError(f"ret_lead{horizon} isn't the return {horizon} sessions later on {n} sessions: rows are missing")


# Algebra


def moments(rows: DataFrame, cols: list[Column]) -> np.ndarray:
    """Sums of products of every two columns, in one pass."""
    k = len(cols)
    sums = rows.agg(F.array(*[F.sum(cols[i] * cols[j]) for i in range(k) for j in range(i, k)])).first()[0]
    out, it = np.zeros((k, k)), iter(sums)
    for i in range(k):
        for j in range(i, k):
            v = next(it)
            out[i, j] = out[j, i] = np.nan if v is None else v
    return out


def lagged_moments(rows: DataFrame, scores: list[Column], lags: int, pos: str = "pos") -> dict[str, np.ndarray]:
    """For both spacings, sums of products of every two scores at each distance from 0 to lags, in one pass."""
    k = len(scores)
    own = rows.select(F.col(pos).cast("long").alias("session"), F.row_number().over(W.orderBy(pos)).cast("long").alias("row"), *[s.alias(f"g{i}") for i, s in enumerate(scores)])
    both = own.select(F.explode(F.array(*[F.struct(F.lit(s).alias("spacing"), F.col(s).alias("at")) for s in SPACINGS])).alias("x"), *[f"g{i}" for i in range(k)]).select("x.*", *[f"g{i}" for i in range(k)])
    steps = both.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(lags)))).withColumn("at", F.col("at") - F.col("lag"))
    pairs = steps.join(both.select("spacing", "at", *[F.col(f"g{i}").alias(f"h{i}") for i in range(k)]), ["spacing", "at"])
    found = pairs.groupBy("spacing", "lag").agg(F.array(*[F.sum(F.col(f"g{i}") * F.col(f"h{j}")) for i in range(k) for j in range(k)]).alias("cells")).collect()
    out = {s: np.zeros((lags + 1, k, k)) for s in SPACINGS}
    for r in found:
        out[r["spacing"]][r["lag"]] = np.array(r["cells"], float).reshape(k, k)
    return out


def meat(omega: np.ndarray, lags: int) -> np.ndarray:
    """Bartlett-weighted sum of the lagged products up to lags."""
    out = omega[0].copy()
    for lag in range(1, lags + 1):
        out += (1 - lag / (lags + 1)) * (omega[lag] + omega[lag].T)
    return out


class Fit:
    """Coefficients, and what errors of any bandwidth up to ``lags`` need."""

    def __init__(self, names: list[str], cross: np.ndarray, omega_of, lags: int = LAGS):
        k = len(names)
        if not np.isfinite(cross).all():
            raise ValueError("a fit takes complete rows only")
        self.names, self.n, self.lags = names, int(cross[0, 0]), lags
        self.bread = np.linalg.inv(cross[:k, :k])
        self.beta = self.bread @ cross[:k, k]
        self.omega = omega_of(self.beta)

    def cov(self, lags: int | None = None, spacing: str = "session") -> np.ndarray:
        return self.bread @ meat(self.omega[spacing], self.lags if lags is None else lags) @ self.bread

    def error(self, term: str, lags: int | None = None, spacing: str = "session") -> float:
        i = self.names.index(term)
        return math.sqrt(self.cov(lags, spacing)[i, i])

    def coef(self, term: str) -> float:
        return float(self.beta[self.names.index(term)])

    def rows(self) -> list[tuple]:
        """(term, coef, se_session, se_row, z, p, bps, bps_low, bps_high) of every term."""
        out = []
        for t in self.names:
            b, e = self.coef(t), self.error(t)
            out.append((t, b, e, self.error(t, spacing="row"), b / e, inference.normal_p(b / e), *bps_interval(b, e)))
        return out


FIT_ROWS = "term string, coef double, se_session double, se_row double, z double, p double, bps double, bps_low double, bps_high double"


def fit(rows: DataFrame, xs: list[str], y: str, lags: int = LAGS) -> Fit:
    """Least squares with an intercept on rows without missing values."""
    if rows.where(" OR ".join(f"{c} IS NULL" for c in [*xs, y])).limit(1).count():
        raise ValueError("a fit takes complete rows only; samples are decided before")
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in xs]]
    target = F.col(y).cast("double")

    def omega(beta: np.ndarray) -> dict:
        resid = target - sum((F.lit(float(b)) * c for b, c in zip(beta[1:], cols[1:], strict=True)), F.lit(float(beta[0])))
        return lagged_moments(rows, [c * resid for c in cols], lags)

    return Fit(["const", *xs], moments(rows, [*cols, target]), omega, lags)


def standardized(rows: DataFrame, cols: dict[str, Column]) -> tuple[DataFrame, dict[str, float]]:
    """rows with z-scores (by name) over these rows, and their deviations; a constant column is refused."""
    sums = rows.agg(*[f(c).alias(f"{k}{i}") for i, c in enumerate(cols.values()) for k, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    out, sd = {}, {}
    for i, (name, c) in enumerate(cols.items()):
        if not sums[f"s{i}"]:
            raise ValueError(f"{name} has no deviation on these sessions")
        out[name], sd[name] = (c - sums[f"m{i}"]) / sums[f"s{i}"], sums[f"s{i}"]
    return rows.withColumns(out), sd


# Intervals


def bps_interval(coef: float, error: float) -> tuple[float, float, float]:
    """Basis points a deviation of tone, with the 95 % interval by the exact quantile."""
    return coef * BPS, (coef - QUANTILE * error) * BPS, (coef + QUANTILE * error) * BPS


def effect_size(coef: float, error: float, deviation: float = 1.0) -> tuple[float, float, float]:
    """The same idea for a raw coefficient times a deviation, with the multiplier 1.96."""
    return coef * deviation * BPS, (coef - 1.96 * error) * deviation * BPS, (coef + 1.96 * error) * deviation * BPS


#: What an interval says.
CONCLUSIONS = {
    (True, True): "Association detected, and small against the 5 bps yardstick",
    (True, False): "Association detected; magnitude not established as small",
    (False, True): "No association detected, and precise enough to exclude effects beyond +/-5 bps",
    (False, False): "Inconclusive",
}


def classified(rows: DataFrame, low: str = "bps_low", high: str = "bps_high", margin: float = MARGIN) -> DataFrame:
    """rows with association, small, boundary and conclusion, by ends rounded half-even to 0.1; near is measured before rounding."""
    lo, hi = (F.bround(F.col(c), 1) for c in (low, high))
    near = F.lit(False)
    for end in (low, high):
        for mark in (-margin, 0.0, margin):
            near = near | (F.abs(F.col(end) - mark) <= 0.1 + 1e-12)
    out = rows.withColumns({"association": (lo > 0) | (hi < 0), "small": (lo >= -margin) & (hi <= margin), "boundary": near})
    text = F.lit(None).cast("string")
    for (a, s), name in CONCLUSIONS.items():
        text = F.when((F.col("association") == a) & (F.col("small") == s), name).otherwise(text)
    return out.withColumn("conclusion", text)


# Return fits


def design(panel: DataFrame, scorer: str = "a", horizon: int = 1) -> tuple[DataFrame, float]:
    """Eligible rows with z_s, and the tone's deviation."""
    require_calendar(panel, horizon)
    rows, sd = standardized(eligible(panel, scorer, horizon), {"z_s": F.col(f"s_{scorer}")})
    return rows, sd["z_s"]


def primary(panel: DataFrame, scorer: str = "a", horizon: int = 1, lags: int = LAGS) -> Fit:
    """The later return on standardized tone and controls."""
    rows, sd = design(panel, scorer, horizon)
    out = fit(rows, ["z_s", *CONTROLS], f"ret_lead{horizon}", lags)
    out.tone_sd = sd
    return out


def lag_family(panel: DataFrame, scorer: str, horizons: tuple[int, ...] = HORIZONS) -> list[tuple]:
    """(scorer, horizon, coef, se, z, p, n) of each horizon, uncorrected."""
    out = []
    for h in horizons:
        f = primary(panel, scorer, h)
        b, e = f.coef("z_s"), f.error("z_s")
        out.append((scorer, h, b, e, b / e, inference.normal_p(b / e), f.n))
    return out


FAMILY_ROWS = "scorer string, horizon int, coef double, se double, z double, p double, n int"


def return_families(estimates: DataFrame, primary_test: tuple[str, int] = ("a", 1), scorers: tuple[str, ...] = ("a", "b", "c"), q: float = 0.05) -> DataFrame:
    """One primary test, uncorrected, and exactly 14 secondary ones adjusted together; claims go by BY."""
    from tidepanel.operators import stats

    found = estimates.select("scorer", "horizon", "p").collect()  # 15 declared tests
    wanted = {(s, h) for s in scorers for h in HORIZONS}
    if len(found) != len(wanted) or {(r["scorer"], r["horizon"]) for r in found} != wanted or not all(r["p"] is not None and 0 <= r["p"] <= 1 for r in found):
        raise ValueError(f"exactly the {len(wanted)} declared tests, each with a probability")
    first = (F.col("scorer") == primary_test[0]) & (F.col("horizon") == primary_test[1])
    second = stats.adjusted(estimates.where(~first), "p").withColumns({"family": F.lit("secondary_return"), "claim": F.col("by") <= q})
    alone = estimates.where(first).withColumns({"bh": F.lit(None).cast("double"), "by": F.lit(None).cast("double"), "family": F.lit("primary_return"), "claim": F.col("p") <= q})
    return second.unionByName(alone)


def vif(cross: np.ndarray, at: int) -> float:
    """Inflation of one column's variance by the others, from the cross products of a design whose first column is 1."""
    others = [i for i in range(len(cross)) if i not in (0, at)]
    mean = cross[0] / cross[0, 0]
    c = cross - cross[0, 0] * np.outer(mean, mean)
    if not others:
        return 1.0
    left = c[at, at] - c[at, others] @ np.linalg.solve(c[np.ix_(others, others)], c[others, at])
    return math.inf if left <= 0 else float(c[at, at] / left)


def contrast(panel: DataFrame, scorers: tuple[str, str] = ("a", "b"), horizon: int = 1, lags: int = LAGS) -> dict:
    """Difference of two scorers' coefficients on the same sessions, its error with the covariance across both equations, and diagnostics."""
    require_calendar(panel, horizon)
    rows, sd = standardized(commonly_eligible(panel, scorers, horizon), {f"z_{s}": F.col(f"s_{s}") for s in scorers})
    rows = rows.persist()
    y, controls = F.col(f"ret_lead{horizon}"), [F.col(c) for c in CONTROLS]
    names = [*[f"z_{s}" for s in scorers], *CONTROLS]
    cross = moments(rows, [F.lit(1.0), *map(F.col, names), y])
    scores, breads, betas = [], [], []
    for k, s in enumerate(scorers):
        at = [0, 1 + k, *range(1 + len(scorers), 1 + len(scorers) + len(CONTROLS))]
        bread = np.linalg.inv(cross[np.ix_(at, at)])
        beta = bread @ cross[at, -1]
        cols = [F.lit(1.0), F.col(f"z_{s}"), *controls]
        resid = y - sum((F.lit(float(b)) * c for b, c in zip(beta, cols, strict=True)), F.lit(0.0))
        scores += [c * resid for c in cols]
        breads.append(bread)
        betas.append(float(beta[1]))
    omega, width = lagged_moments(rows, scores, lags), len(CONTROLS) + 2
    pull = np.zeros(width * len(scorers))  # the difference of the two tone coefficients as a sum of scores
    pull[:width], pull[width : 2 * width] = breads[0][1], -breads[1][1]
    var = {s: float(pull @ meat(omega[s], lags) @ pull) for s in SPACINGS}
    n = int(cross[0, 0])
    designs = {s: cross[np.ix_(at, at)] for k, s in enumerate(scorers) for at in [[0, 1 + k, 3, 4, 5]]}
    rows.unpersist()
    delta, error = betas[0] - betas[1], math.sqrt(max(0.0, var["session"]))
    alone = np.where(np.arange(len(pull)) < width, pull, 0)
    degenerate = error <= 1e-6 * math.sqrt(float(alone @ meat(omega["session"], lags) @ alone))  # what rounding leaves of no difference
    z = math.nan if degenerate else delta / error
    return {
        "n": n, "beta_first": betas[0], "beta_second": betas[1], "delta": delta, "se": error, "se_row": math.sqrt(max(0.0, var["row"])), "z": z,
        "p": math.nan if degenerate else inference.normal_p(z), "degenerate": degenerate, "corr": float(cross[1, 2] / (n - 1)),
        "vif_first": vif(designs[scorers[0]], 1), "vif_second": vif(designs[scorers[1]], 1),
    }


def incremental(panel: DataFrame, scorers: tuple[str, str] = ("a", "b"), horizon: int = 1, lags: int = LAGS) -> Fit:
    """Both scorers' tone in one fit."""
    require_calendar(panel, horizon)
    rows, _ = standardized(commonly_eligible(panel, scorers, horizon), {f"z_{s}": F.col(f"s_{s}") for s in scorers})
    return fit(rows, [*[f"z_{s}" for s in scorers], *CONTROLS], f"ret_lead{horizon}", lags)


# Joint tests on activity


def joint_flags(panel: DataFrame, scorer: str, outcome: str) -> dict[str, Column]:
    control = "range_var" if outcome.startswith("range_var") else "volume_gap"
    missing = F.col(control).isNull() | (F.col("ret").isNull() if control == "volume_gap" else F.lit(False))
    return {
        "no_outcome": F.col(outcome).isNull(), "zero_news": F.coalesce(F.col("n"), F.lit(0)) < 1, "missing_tone": F.col(f"s_{scorer}").isNull(),
        "dispersion_undefined": F.col(f"d_{scorer}").isNull(), "missing_control": missing,
    }


def joint_ledger(panel: DataFrame, scorer: str, outcome: str) -> DataFrame:
    return _ledger(panel, joint_flags(panel, scorer, outcome))


def joint_fit(panel: DataFrame, scorer: str, outcome: str, lags: int = LAGS) -> Fit:
    """An activity measure of the next session on tone, its size and its dispersion, and the measure's own level."""
    rows = panel.where(_reason(joint_flags(panel, scorer, outcome)).isNull()).withColumn("abs_ret", F.abs("ret"))
    tone = F.col(f"s_{scorer}")
    rows, _ = standardized(rows, {"z_s": tone, "z_abs_s": F.abs(tone), "z_d": F.col(f"d_{scorer}")})
    own = ["range_var"] if outcome.startswith("range_var") else ["volume_gap", "abs_ret"]
    return fit(rows, [*JOINT_TERMS, *own], outcome, lags)


def wald(found: Fit, terms: tuple[str, ...] = JOINT_TERMS) -> tuple[float, int, float]:
    """Statistic, degrees and probability of all these terms being 0; a singular block is refused."""
    at = [found.names.index(t) for t in terms]
    block = found.cov()[np.ix_(at, at)]
    if np.linalg.matrix_rank(block) < len(at):
        raise ValueError("the covariance of these terms is singular")
    w = float(found.beta[at] @ np.linalg.solve(block, found.beta[at]))
    return w, len(at), inference.chi_square_tail(w, len(at))


# Sensitivities


def plug_in(n: int) -> int:
    return int(math.floor(4 * (n / 100) ** (2 / 9)))


def bandwidths(panel: DataFrame, scorer: str = "a", horizon: int = 1) -> list[tuple]:
    """(label, lags, n, bps, bps_low, bps_high, p) for bandwidths 0, 1, 5, 10 and the plug-in, from one pass over lagged products."""
    rows, _ = design(panel, scorer, horizon)
    n = rows.count()
    found = fit(rows, ["z_s", *CONTROLS], f"ret_lead{horizon}", max(10, plug_in(n)))
    out = []
    for label, lags in (("0", 0), ("1", 1), ("5 (primary)", 5), ("10", 10), ("plug-in", plug_in(n))):
        b, e = found.coef("z_s"), found.error("z_s", lags)
        out.append((label, lags, n, *bps_interval(b, e), inference.normal_p(b / e)))
    return out


BAND_ROWS = "label string, lags int, n long, bps double, bps_low double, bps_high double, p double"


def floors(panel: DataFrame, scorer: str = "a", least: int = 5) -> list[tuple]:
    """The primary fit with and without tone on sessions of fewer than ``least`` events: (label, n, blanked, bps, bps_low, bps_high, p)."""
    out = []
    for label, floor in (("none (primary)", 1), (f"n >= {least}", least)):
        thin = F.coalesce(F.col("n"), F.lit(0)) < floor
        found = primary(panel.withColumn(f"s_{scorer}", F.when(~thin, F.col(f"s_{scorer}"))), scorer)
        b, e = found.coef("z_s"), found.error("z_s")
        out.append((label, found.n, panel.where(thin).count(), *bps_interval(b, e), inference.normal_p(b / e)))
    return out


FLOOR_ROWS = "label string, n int, blanked long, bps double, bps_low double, bps_high double, p double"


def halves(panel: DataFrame, scorer: str = "a", horizon: int = 1) -> list[tuple]:
    """The primary fit on all eligible sessions and on two halves in order (tone blanked outside), and first minus second half:
    (part, n, bps, se_bps, bps_low, bps_high, p)."""
    middle = eligible(panel, scorer, horizon).agg(F.expr("sort_array(collect_list(pos))[CAST(floor(count(1) / 2) AS INT)]")).first()[0]  # a row a session
    out, part_of = [], {}
    for name, keep in (("full", F.lit(True)), ("first", F.col("pos") < middle), ("second", F.col("pos") >= middle)):
        found = primary(panel.withColumn(f"s_{scorer}", F.when(keep, F.col(f"s_{scorer}"))), scorer, horizon)
        b, e = found.coef("z_s"), found.error("z_s")
        part_of[name] = b, e, found.n
        bps = bps_interval(b, e)
        out.append((name, found.n, bps[0], e * BPS, bps[1], bps[2], inference.normal_p(b / e)))
    gap, error = part_of["first"][0] - part_of["second"][0], math.hypot(part_of["first"][1], part_of["second"][1])
    bps = bps_interval(gap, error)
    return [*out, ("difference", part_of["first"][2] + part_of["second"][2], bps[0], error * BPS, bps[1], bps[2], inference.normal_p(gap / error))]


HALF_ROWS = "part string, n int, bps double, se_bps double, bps_low double, bps_high double, p double"


def residuals(panel: DataFrame, scorer: str = "a", horizon: int = 1) -> DataFrame:
    """(pos, z_s, u) of the primary fit."""
    rows, _ = design(panel, scorer, horizon)
    found = fit(rows, ["z_s", *CONTROLS], f"ret_lead{horizon}", 0)
    u = F.col(f"ret_lead{horizon}") - sum((F.lit(found.coef(c)) * F.col(c) for c in ["z_s", *CONTROLS]), F.lit(found.coef("const")))
    return rows.select("pos", "z_s", u.alias("u"))


def residual_acf(panel: DataFrame, lags: int = 20, scorer: str = "a") -> DataFrame:
    """(lag, residual_acf, tone_acf, band, outside) over retained rows."""
    from tidepanel.operators import stats

    rows = residuals(panel, scorer).persist()
    both = [stats.autocorrelation(rows, c, "pos", lags).withColumnRenamed("acf", name) for c, name in (("u", "residual_acf"), ("z_s", "tone_acf"))]
    band = QUANTILE / math.sqrt(rows.count())
    return both[0].join(both[1], "lag").where("lag > 0").withColumn("band", F.lit(band)).withColumn("outside", F.abs("residual_acf") > band)


def summary(panel: DataFrame, scorer: str = "a") -> dict:
    """Whether any sensitivity changes the primary conclusion. Halves are compared by name."""
    spark = panel.sparkSession
    bands = [(r[0], r[4], r[5]) for r in bandwidths(panel, scorer)]
    thin = [(r[0], r[4], r[5]) for r in floors(panel, scorer)]
    split = {r[0]: r for r in halves(panel, scorer)}
    told = classified(spark.createDataFrame(bands + thin, "label string, bps_low double, bps_high double")).collect()
    names = sorted({r["conclusion"] for r in told})
    first = next(r for r in told if r["label"] == "5 (primary)")
    one, two = split["first"], split["second"]
    return {
        "primary_conclusion": first["conclusion"], "conclusions": names, "changes": len(names) > 1, "boundary_cases": sum(r["boundary"] for r in told),
        "sensitivities": len(told), "halves_overlap": one[4] <= two[5] and two[4] <= one[5],
    }


# Timing and planning


def timing(panel: DataFrame, scorer: str = "a", horizon: int = 1, unit: float = 0.1) -> dict:
    """Where the tone coefficient lies among those of tone moved round by every number of retained rows: a midrank percentile, no probability."""
    rows, _ = design(panel, scorer, horizon)
    rows = rows.persist()
    shifted = inference.shift_coefficients(rows, "z_s", f"ret_lead{horizon}", list(CONTROLS)).persist()
    observed = shifted.where("k = 0").first()["coefficient"]
    step = unit / BPS
    rounded = shifted.where("k > 0").select("coefficient", F.bround(F.col("coefficient") / step, 0).alias("r"))
    own = F.bround(F.lit(observed) / step, 0)
    q = lambda p: F.expr(f"percentile(coefficient, {p})") * BPS
    found = rounded.agg(
        F.count(F.lit(1)).alias("shifts"), F.count_if(F.col("r") < own).alias("below"), F.count_if(F.col("r") == own).alias("ties"),
        q(0.05).alias("p05"), q(0.95).alias("p95"), F.min("coefficient").alias("least"), F.max("coefficient").alias("most"),
    ).first()
    step_of = F.col("pos") - F.lag("pos").over(W.orderBy("pos"))
    gaps = rows.select(step_of.alias("d")).agg(F.count_if(F.col("d") > 1).alias("gaps"), (F.max("d") - 1).alias("largest")).first()
    n = found["shifts"] + 1
    shifted.unpersist()
    rows.unpersist()
    return {
        "n": n, "observed_bps": observed * BPS, "percentile": (found["below"] + 0.5 * found["ties"]) / n, "below": found["below"], "ties": found["ties"],
        "p05_bps": found["p05"], "p95_bps": found["p95"], "least": found["least"], "most": found["most"], "gaps": gaps["gaps"], "largest_gap": gaps["largest"] or 0,
    }


def precision(panel: DataFrame, scorer: str = "a", horizon: int = 1) -> dict:
    """Half-widths to expect, without a fit of tone to the outcome: outcome and tone are each fitted on the controls alone.

    kappa is the error of the mean of the outcome's residuals by lags of 5 over that of independent ones.
    """
    rows, _ = design(panel, scorer, horizon)
    y = f"ret_lead{horizon}"
    cross = moments(rows, [F.lit(1.0), *map(F.col, CONTROLS), F.col(y), F.col("z_s")])
    k = 1 + len(CONTROLS)
    n, inner = int(cross[0, 0]), np.linalg.inv(cross[:k, :k])
    if n <= k:
        raise ValueError("more sessions than controls are needed")
    left = {name: cross[at, at] - cross[at, :k] @ inner @ cross[:k, at] for name, at in (("u", k), ("v", k + 1))}
    sd_y = math.sqrt((cross[k, k] - cross[0, k] ** 2 / n) / (n - 1))
    sd_u, sd_v = (math.sqrt(left[c] / (n - 1)) for c in "uv")
    if sd_v <= 1.5e-8 or sd_u <= 1.5e-8 * sd_y:
        raise ValueError("nothing is left once the controls are taken out")
    beta = inner @ cross[:k, k]
    resid = F.col(y) - sum((F.lit(float(b)) * F.col(c) for b, c in zip(beta[1:], CONTROLS, strict=True)), F.lit(float(beta[0])))
    omega = lagged_moments(rows, [resid], LAGS)
    kappa = {s: math.sqrt(float(meat(omega[s], LAGS)[0, 0])) / n / (sd_u / math.sqrt(n)) for s in SPACINGS}
    wide = 1.96 * BPS / math.sqrt(n)
    return {"n": n, "sd_r": sd_y, "sd_u": sd_u, "sd_v": sd_v, "r_squared": 1 - sd_v**2, "kappa_session": kappa["session"], "kappa_row": kappa["row"], "h1_bps": wide * sd_y, "h2_bps": wide * sd_u / sd_v * kappa["session"]}


# Legacy forms


def listwise(rows: DataFrame, xs: list[str], y: str, lags: int = LAGS) -> Fit:
    """Least squares on the rows that are complete; lags count the rows that stay (the errors named ``row``)."""
    kept = rows.dropna(subset=[*xs, y])
    if kept.limit(1).count() == 0:
        raise ValueError("no complete rows")
    return fit(kept, xs, y, lags)


def contemporaneous(panel: DataFrame, scorer: str = "a", admissible: bool = False, lags: int = LAGS) -> Fit:
    """The same day's return on tone and lagged controls. Without stamps that show what was known when, it has no meaning and is refused."""
    if not admissible:
        raise RuntimeError("same-day fits need intraday stamps; say that they are admissible")
    xs = [f"s_{scorer}", "ret_lag1", "range_var_lag1", "log_volume_lag1"]
    lacking = [c for c in xs if c not in panel.columns]
    if lacking:
        raise KeyError(f"the panel has no {', '.join(lacking)}; lags are made on the whole calendar")
    return listwise(panel, xs, "ret", lags)


def predictive(panel: DataFrame, scorer: str = "a", horizon: int = 1, lags: int = LAGS) -> Fit:
    """The later return on raw tone and raw controls, kept beside the primary fit."""
    return listwise(panel, [f"s_{scorer}", "ret", "range_var", "log_volume"], f"ret_lead{horizon}", lags)


def analysis_sample(panel: DataFrame) -> DataFrame:
    """Sessions, those without events, and those that stay."""
    return panel.agg(F.count(F.lit(1)).alias("sessions"), F.count_if(F.coalesce(F.col("n"), F.lit(0)) < 1).alias("without_events"), F.count_if(F.col("n") > 0).alias("kept"))
