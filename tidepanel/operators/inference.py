"""Tail probabilities, circular shifts, bootstrap of groups.

Sums over sessions run in Spark. Arrays reach the driver only for one value a session or a labelled group, and
above ``MOST`` of them the functions refuse: such inputs aren't calendars or hand-labelled sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


MOST = 100_000


def chi_square_tail(x: float, df: int) -> float:
    """P(chi-square of df degrees > x), by the finite sums for whole df."""
    h = x / 2
    if df % 2 == 0:
        return math.exp(-h) * sum(h**i / math.factorial(i) for i in range(df // 2))
    return math.erfc(math.sqrt(h)) + math.exp(-h) * sum(h ** (i - 0.5) / math.gamma(i + 0.5) for i in range(1, (df + 1) // 2))


def normal_p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _array(rows: DataFrame, cols: list) -> np.ndarray:
    found = rows.select(*[F.col(c).cast("double") for c in cols]).limit(MOST + 1).collect()
    if len(found) > MOST:
        raise ValueError(f"more than {MOST} sessions or groups")
    return np.array([list(r) for r in found], np.float64).reshape(len(found), len(cols))


def shift_coefficients(rows: DataFrame, tone: str, y: str, controls: list[str] = (), pos: str = "pos") -> DataFrame:
    """(k, coefficient): y on the tone moved round by k retained sessions and on controls that stay, k from 0 to n - 1.

    The tone is residualized after each shift. Shifts are spread over tasks; a shift costs n by the number of controls.
    """
    spark = rows.sparkSession
    data = _array(rows, [pos, tone, y, *controls])
    data = data[np.argsort(data[:, 0], kind="stable")]
    n = len(data)
    design = np.column_stack([np.ones(n), data[:, 3:]])
    basis = np.linalg.qr(design)[0] if n else design
    tones, target = data[:, 1], data[:, 2] - basis @ (basis.T @ data[:, 2])
    shared = spark.sparkContext.broadcast((tones, target, basis))  # at most MOST rows

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tones, target, basis = shared.value
        for frame in frames:
            out = []
            for k in frame["id"]:
                z = np.roll(tones, -int(k))
                z = z - basis @ (basis.T @ z)
                size = z @ z
                out.append(float(z @ target / size) if size > 1e-20 else None)
            yield pd.DataFrame({"k": frame["id"].astype("int64"), "coefficient": pd.array(out, "Float64")})

    return spark.range(n).repartition(max(1, min(n, spark.sparkContext.defaultParallelism * 2))).mapInPandas(run, "k bigint, coefficient double")


def _macro_f1(cells: np.ndarray, k: int) -> np.ndarray:
    """cells: draws by k * k counts (truth by prediction)."""
    m = cells.reshape(-1, k, k)
    hit, total = np.diagonal(m, axis1=1, axis2=2), m.sum(1) + m.sum(2)
    return np.where(total > 0, 2 * hit / np.maximum(total, 1), 0.0).mean(1)


def _accuracy(cells: np.ndarray, k: int) -> np.ndarray:
    m = cells.reshape(-1, k, k)
    return np.diagonal(m, axis1=1, axis2=2).sum(1) / np.maximum(m.sum((1, 2)), 1)


def group_bootstrap(rows: DataFrame, truth: str, first: str, second: str, group: str, classes: list[int], draws: int = 10_000, seed: int = 7, block: int = 100) -> DataFrame:
    """(draw, difference, accuracy): macro-F1, and accuracy, of first minus second over whole groups drawn with replacement; draw -1 is the sample itself.

    Groups are counted in Spark first, so a draw costs the groups and not the rows. Every draw has a seed of its own:
    results don't depend on how draws are dealt over tasks.
    """
    k, spark = len(classes), rows.sparkSession
    cells = [F.count_if((F.col(truth) == t) & (F.col(p) == c)).cast("double").alias(f"c{n}_{i}_{j}") for n, p in enumerate((first, second)) for i, t in enumerate(classes) for j, c in enumerate(classes)]
    counts = rows.groupBy(F.col(group).alias("_g")).agg(*cells).orderBy("_g")
    shared = spark.sparkContext.broadcast(_array(counts, [c for c in counts.columns if c != "_g"]))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        n = len(own)
        for frame in frames:
            for low in range(0, len(frame), block):
                ids = frame["id"].to_numpy()[low : low + block]
                times = np.stack([np.ones(n) if d < 0 else np.random.default_rng([seed, int(d)]).multinomial(n, np.full(n, 1 / n)) for d in ids]) if n else np.zeros((len(ids), 0))
                sums = times @ own
                a, b = sums[:, : k * k], sums[:, k * k :]
                yield pd.DataFrame({"draw": ids, "difference": _macro_f1(a, k) - _macro_f1(b, k), "accuracy": _accuracy(a, k) - _accuracy(b, k)})

    return spark.range(-1, draws).mapInPandas(run, "draw bigint, difference double, accuracy double")
