"""Statistics over the panel and over labels. Sums run in Spark; only k by k algebra runs on the driver."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

def standardized(rows: DataFrame, cols: list[str]) -> DataFrame:
    """z-scores by the rows' own mean and sample deviation, from one aggregate."""
    sums = rows.agg(*[f(c).alias(f"_{n}_{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    joined = rows.join(F.broadcast(sums))
    return joined.select("*", *[((F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).alias(f"z_{c}") for c in cols]).drop(*sums.columns)


def normal_equations(rows: DataFrame, xs: list[str], y: str) -> DataFrame:
    """X'X and X'y with an intercept, as (i, j, value); j = -1 is y. One pass."""
    cols = [F.lit(1.0), *map(F.col, xs)]
    pairs = [(i, j, F.sum(a * b)) for i, a in enumerate(cols) for j, b in [*enumerate(cols), (-1, F.col(y))] if j == -1 or j >= i]
    return rows.agg(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), v.alias("value")) for i, j, v in pairs]).alias("all")).select(F.inline("all"))


def solve(a: list[list[float]], b: list[float]) -> list[float]:
    n = len(b)
    m = [[*row, v] for row, v in zip(a, b, strict=True)]
    for k in range(n):
        p = max(range(k, n), key=lambda r: abs(m[r][k]))
        if abs(m[p][k]) < 1e-12:
            raise ValueError("the design is singular")
        m[k], m[p] = m[p], m[k]
        for r in range(n):
            if r != k:
                f = m[r][k] / m[k][k]
                m[r] = [x - f * z for x, z in zip(m[r], m[k], strict=True)]
    return [m[k][n] / m[k][k] for k in range(n)]


def fit(rows: DataFrame, xs: list[str], y: str) -> list[float]:
    """Least-squares coefficients, intercept first."""
    k = len(xs) + 1
    a, b = [[0.0] * k for _ in range(k)], [0.0] * k
    for r in normal_equations(rows, xs, y).collect():
        if r["j"] == -1:
            b[r["i"]] = r["value"]
        else:
            a[r["i"]][r["j"]] = a[r["j"]][r["i"]] = r["value"]
    return solve(a, b)


def hac_meat(rows: DataFrame, xs: list[str], y: str, beta: list[float], lags: int, pos: str = "pos") -> DataFrame:
    """Bartlett-weighted lagged products of scores, paired by session distance: (i, j, value)."""
    cols = [F.lit(1.0), *map(F.col, xs)]
    resid = F.col(y) - sum((F.lit(b) * c for b, c in zip(beta[1:], cols[1:], strict=True)), F.lit(beta[0]))
    scores = rows.select(F.col(pos).alias("pos"), *[(c * resid).alias(f"g{i}") for i, c in enumerate(cols)])
    own = scores.select(F.col("pos"), *[F.col(f"g{i}").alias(f"h{i}") for i in range(len(cols))])
    steps = scores.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(lags)))).withColumn("pos", F.col("pos") - F.col("lag"))
    pairs = steps.join(own, "pos")
    weight = F.lit(1.0) - F.col("lag") / F.lit(lags + 1.0)
    each = lambda i, j: F.when(F.col("lag") == 0, F.col(f"g{i}") * F.col(f"h{j}")).otherwise(weight * (F.col(f"g{i}") * F.col(f"h{j}") + F.col(f"h{i}") * F.col(f"g{j}")))
    cells = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    return pairs.agg(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.sum(each(i, j)).alias("value")) for i, j in cells]).alias("all")).select(F.inline("all"))


def autocorrelation(rows: DataFrame, value: str, pos: str, lags: int = 20) -> DataFrame:
    """(lag, acf) over retained rows in order."""
    order = W.orderBy(pos)
    mean = rows.agg(F.avg(value).alias("_m"))
    centred = rows.where(F.col(value).isNotNull()).join(F.broadcast(mean)).select(F.row_number().over(order).alias("r"), (F.col(value) - F.col("_m")).alias("c"))
    steps = centred.select(F.col("r").alias("at"), "c", F.explode(F.sequence(F.lit(0), F.lit(lags))).alias("lag")).withColumn("r", F.col("at") - F.col("lag"))
    pairs = steps.join(centred.select("r", F.col("c").alias("e")), "r")
    sums = pairs.groupBy("lag").agg(F.sum(F.col("c") * F.col("e")).alias("s"))
    return sums.select("lag", (F.col("s") / F.max(F.when(F.col("lag") == 0, F.col("s"))).over(W.partitionBy())).alias("acf"))


def adjusted(tests: DataFrame, p: str = "p", by: list[str] = ()) -> DataFrame:
    """tests with bh and by: false-discovery adjustments within each family."""
    family = W.partitionBy(*by)
    ordered = tests.withColumn("_r", F.row_number().over(family.orderBy(p))).withColumn("_m", F.count(F.lit(1)).over(family))
    harmonic = F.aggregate(F.sequence(F.lit(1), F.col("_m").cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / i)
    after = family.orderBy("_r").rowsBetween(0, W.unboundedFollowing)
    raw = F.col(p) * F.col("_m") / F.col("_r")
    return ordered.withColumn("bh", F.least(F.lit(1.0), F.min(raw).over(after))).withColumn("by", F.least(F.lit(1.0), F.min(raw * harmonic).over(after))).drop("_r", "_m")


def confusion(rows: DataFrame, truth: str, pred: str) -> DataFrame:
    return rows.groupBy(truth, pred).agg(F.count(F.lit(1)).alias("n"))


def banded(score: Column, low: Column | float, high: Column | float) -> Column:
    """-1 up to low, 1 above high, 0 in the band between."""
    return F.when(score <= low, -1).when(score > high, 1).otherwise(0)


def macro_f1(cells: DataFrame, by: list[str]) -> DataFrame:
    """cells(*by, truth, pred, n) to macro_f1 and accuracy over the labels -1, 0 and 1; a label that never occurs counts 0."""
    one = lambda v: [F.sum(F.when(c, F.col("n")).otherwise(0)) for c in ((F.col("truth") == v) & (F.col("pred") == v), F.col("truth") == v, F.col("pred") == v)]
    parts = [F.when(t + p > 0, 2 * h / (t + p)).otherwise(0.0) for h, t, p in map(one, (-1, 0, 1))]
    right = F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0))
    return cells.groupBy(*by).agg(((parts[0] + parts[1] + parts[2]) / 3).alias("macro_f1"), (right / F.sum("n")).alias("accuracy"), F.sum("n").alias("rows"))


def threshold_grid(scored: DataFrame, truth: str, score: str, points: int = 81) -> DataFrame:
    """Macro-F1 of every neutral band (low, high], low <= high on a grid over [-1, 1].

    Labels are counted at or below each grid point once, so a band costs its three labels and not the rows.
    """
    step = 2.0 / (points - 1)
    least = F.ceil((F.col(score) + 1) / step - 1e-9).cast("int")  # the first point at or above a score
    counts = scored.groupBy(F.greatest(least, F.lit(0)).alias("at")).agg(*[F.count_if(F.col(truth) == v).alias(f"c{v + 1}") for v in (-1, 0, 1)])
    grid = scored.sparkSession.range(points).select(F.col("id").cast("int").alias("g"))
    upto = grid.join(F.broadcast(counts), F.col("at") <= F.col("g"), "left").groupBy("g").agg(*[F.coalesce(F.sum(f"c{k}"), F.lit(0)).alias(f"c{k}") for k in range(3)])
    total = counts.agg(*[F.sum(f"c{k}").alias(f"t{k}") for k in range(3)])
    low, high = (upto.select(F.col("g").alias(n), *[F.col(f"c{k}").alias(f"{n}{k}") for k in range(3)]) for n in ("low", "high"))
    met = low.join(F.broadcast(high), F.col("low") <= F.col("high")).join(F.broadcast(total))
    hit = {0: F.col("low0"), 1: F.col("high1") - F.col("low1"), 2: F.col("t2") - F.col("high2")}
    said = {0: sum(F.col(f"low{k}") for k in range(3)), 1: sum((F.col(f"high{k}") - F.col(f"low{k}") for k in range(3)), F.lit(0)), 2: sum((F.col(f"t{k}") - F.col(f"high{k}") for k in range(3)), F.lit(0))}
    f1 = [F.when(said[k] + F.col(f"t{k}") > 0, 2 * hit[k] / (said[k] + F.col(f"t{k}"))).otherwise(0.0) for k in range(3)]
    point = lambda c: (F.col(c) * step - 1.0).alias(c)
    return met.select(point("low"), point("high"), ((f1[0] + f1[1] + f1[2]) / 3).alias("macro_f1"))


def best_band(grid: DataFrame) -> DataFrame:
    """The band of the largest macro-F1; of equals the lowest low, then the lowest high."""
    return grid.orderBy(F.desc(F.round("macro_f1", 12)), "low", "high").limit(1)


def mcnemar_cells(rows: DataFrame, first: Column, second: Column) -> DataFrame:
    return rows.agg(*[F.count_if(a & b).alias(n) for n, a, b in (("both", first, second), ("first_only", first, ~second), ("second_only", ~first, second), ("neither", ~first, ~second))])


def mcnemar_p(b: int, c: int) -> float:
    """Exact two-sided binomial probability of the discordant cells."""
    n, k = b + c, min(b, c)
    return min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n) if n else 1.0


def kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement corrected for chance; null when both are constant."""
    cells = rows.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy())
    shares = cells.withColumn("pa", F.sum("n").over(W.partitionBy("a")) / total).withColumn("t", total)
    of_b = cells.groupBy(F.col("b").alias("_b")).agg(F.sum("n").alias("nb"))
    of_a = cells.groupBy(F.col("a").alias("_a")).agg(F.sum("n").alias("na"))
    chance = of_a.join(of_b, F.col("_a") == F.col("_b")).agg(F.sum(F.col("na").cast("double") * F.col("nb")).alias("c"))
    seen = shares.agg(F.max("t").alias("rows"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("agree"))
    po, pe = F.col("agree") / F.col("rows"), F.coalesce("c", F.lit(0.0)) / (F.col("rows").cast("double") * F.col("rows"))
    return seen.join(F.broadcast(chance)).select("rows", po.alias("agreement"), F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))


def allocation(strata: DataFrame, total: int) -> DataFrame:
    """strata(stratum, n): proportional shares of total by largest remainder, ties by name, no more than n."""
    exact = F.col("n") * F.lit(float(total)) / F.sum("n").over(W.partitionBy())
    base = strata.withColumn("_e", exact).withColumn("_f", F.floor("_e"))
    left = F.lit(total) - F.sum("_f").over(W.partitionBy())
    rank = F.row_number().over(W.orderBy(F.desc(F.round(F.col("_e") - F.col("_f"), 9)), "stratum"))
    return base.select("stratum", "n", F.least(F.col("n"), F.col("_f") + (rank <= left).cast("long")).alias("take"))
