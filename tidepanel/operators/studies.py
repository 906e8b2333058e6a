"""Simulations with a known answer: what measurement error does to a slope, and what gaps do to lagged errors.

Draws are rows of a range with seeded normals, so each case is one aggregate at any number of draws; replications of the spacing study
are tasks of their own, seeded by their cell and number.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DRAWS, SEED, THETA = 200_000, 20, 0.5
ATTENUATION = "study string, parameter string, predicted double, simulated double"


def _slopes(spark: SparkSession, pairs: dict[str, tuple[Column, Column, bool]], draws: int) -> dict[str, float]:
    """Slopes of y on x (or on x by its deviation) of several pairs, over the same draws: z, u, e and v are independent normals."""
    rows = spark.range(draws).select(*[F.randn(SEED + k).alias(name) for k, name in enumerate("zuev")])
    own = rows.agg(*[(F.covar_samp(x, y) / (F.stddev_samp(x) if by_sd else F.var_samp(x))).alias(name) for name, (x, y, by_sd) in pairs.items()])
    return own.first().asDict()


def attenuation(spark: SparkSession, draws: int = DRAWS) -> DataFrame:
    """(study, parameter, predicted, simulated): slopes under classical error, standardized, aggregated, correlated, bounded, and without any signal."""
    z, u, e, v = map(F.col, "zuev")
    outcome = THETA * z + e
    pairs, predicted = {}, {}

    def add(study: str, parameter: str, x: Column, y: Column, by_sd: bool, value: float) -> None:
        pairs[f"{study}|{parameter}"], predicted[f"{study}|{parameter}"] = (x, y, by_sd), value

    for noise in (0.0, 0.25, 1.0, 4.0):
        add("classical", f"{noise}", z + math.sqrt(noise) * u, outcome, False, THETA / (1 + noise))
        add("no signal", f"{noise}", z + math.sqrt(noise) * u, e, False, 0.0)
    for scale in (1.0, 2.0):
        for noise in (0.0, 0.25, 1.0):
            add("standardized", f"{scale} {noise}", scale * z + math.sqrt(noise) * u, outcome, True, THETA * math.sqrt(scale**2 / (scale**2 + noise)))
    day, n = 0.01, 337
    for noise in (0.25, 0.5):
        add("aggregated", f"{noise}", math.sqrt(day) * z + math.sqrt(noise / n) * u, THETA * math.sqrt(day) * z + e, True, THETA * math.sqrt(day) * math.sqrt(day / (day + noise / n)))
    for rho in (0.0, 0.01, 0.1, 1.0):
        spread = 0.25 * (1 + (n - 1) * rho) / n
        shared = math.sqrt(0.25 * rho) * u + math.sqrt(0.25 * (1 - rho) / n) * v
        add("correlated", f"{rho}", math.sqrt(day) * z + shared, THETA * math.sqrt(day) * z + e, True, THETA * math.sqrt(day) * math.sqrt(day / (day + spread)))
    # A score held to [-1, 1]: the slope by Stein's identity is theta times the chance of being inside, over the variance of what is held.
    total = 1.5
    inside = math.erf(1 / math.sqrt(2 * total))
    density = math.exp(-1 / (2 * total)) / math.sqrt(2 * math.pi * total)
    held = total * inside - 2 * total * density + (1 - inside)
    add("bounded", "0.5", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z + math.sqrt(0.5) * u)), outcome, False, THETA * inside / held)
    found = _slopes(spark, pairs, draws)
    return spark.createDataFrame([(*k.split("|"), predicted[k], found[k]) for k in pairs], ATTENUATION)


def _errors(x: np.ndarray, y: np.ndarray, at: np.ndarray, lags: int) -> float:
    """The error of the second coefficient by lags at distances of at."""
    bread = np.linalg.inv(x.T @ x)
    g = x * (y - x @ (bread @ (x.T @ y)))[:, None]
    wide = np.zeros((at[-1] + 1, x.shape[1]))
    wide[at] = g
    s = g.T @ g
    for lag in range(1, lags + 1):
        omega = wide[lag:].T @ wide[:-lag]
        s += (1 - lag / (lags + 1)) * (omega + omega.T)
    return math.sqrt((bread @ s @ bread)[1, 1])


def _replications(sessions: int, lags: int):
    def run(frames):
        for frame in frames:
            out = []
            for gap, rho, rep in zip(frame["gap"], frame["rho"], frame["rep"], strict=True):
                rng = np.random.default_rng([SEED, int(gap * 10_000), int(rho * 10), int(rep)])
                keep = rng.random(sessions) >= gap
                keep[0] = keep[-1] = True
                at = np.flatnonzero(keep)

                def chain(r: float) -> np.ndarray:
                    e = rng.normal(size=sessions)  # noqa: B023
                    e[1:] *= math.sqrt(1 - r * r)
                    for t in range(1, sessions):
                        e[t] += r * e[t - 1]
                    return e

                u, tone, c1, c2 = chain(rho), chain(0.85), rng.normal(size=sessions), rng.normal(size=sessions)
                y = 0.3 * c1 - 0.15 * c2 + 0.01 * u
                x = np.column_stack([np.ones(len(at)), tone[at], c1[at], c2[at]])
                out.append((gap, rho, len(at), _errors(x, y[at], at - at[0], lags) / _errors(x, y[at], np.arange(len(at)), lags)))
            yield pd.DataFrame(out, columns=["gap", "rho", "kept", "ratio"])

    return run


def spacing(spark: SparkSession, sessions: int = 2516, reps: int = 20, gaps: tuple = (0.0, 0.0004, 0.01, 0.05, 0.15, 0.3, 0.5), rhos: tuple = (0.0, 0.3, 0.6), lags: int = 5) -> DataFrame:
    """(gap, rho, kept, mean, least, most, percent): error by sessions over error by retained rows, when shares of sessions are missing and residuals persist."""
    cells = spark.createDataFrame([(g, r) for g in gaps for r in rhos], "gap double, rho double").crossJoin(spark.range(reps).withColumnRenamed("id", "rep"))
    each = cells.repartition(len(gaps) * len(rhos)).mapInPandas(_replications(sessions, lags), "gap double, rho double, kept int, ratio double")
    return each.groupBy("gap", "rho").agg(
        F.floor(F.avg("kept")).cast("int").alias("kept"), F.avg("ratio").alias("mean"), F.min("ratio").alias("least"), F.max("ratio").alias("most"),
        (F.max(F.abs(F.col("ratio") - 1)) * 100).alias("percent"),
    )
