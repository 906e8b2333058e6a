"""Annotation sets: whole groups into parts, subsets, blind sheets, and the checks of labels that come back. Orders are by seeded hashes of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What a sheet for annotators may hold.
BLIND = ("id", "text")


def shuffled(seed: int, key: str = "id") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


def parts(groups: DataFrame, calibration: int, seed: int = 20) -> DataFrame:
    """groups(id, group_id) with part: groups in seeded order go to calibration until it holds its number; no group is split."""
    sizes = groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("_n"))
    order = W.orderBy(shuffled(seed, "group_id"), "group_id").rowsBetween(W.unboundedPreceding, -1)  # a row a group of a drawn set
    taken = sizes.select("group_id", F.when(F.coalesce(F.sum("_n").over(order), F.lit(0)) < calibration, "calibration").otherwise("evaluation").alias("part"))
    return groups.join(taken, "group_id")


def subset(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """n rows in the order of a seeded hash; fewer rows are refused."""
    if rows.limit(n).count() < n:
        raise ValueError(f"fewer than {n} rows to take from")
    return rows.orderBy(shuffled(seed), "id").limit(n)


def pilot(assigned: DataFrame, n: int, seed: int = 21) -> DataFrame:
    """The calibration items that are labelled first."""
    return subset(assigned.where("part = 'calibration'"), n, seed)


def second_annotator(assigned: DataFrame, fraction: float = 0.2, seed: int = 22) -> DataFrame:
    return subset(assigned, int(round(assigned.count() * fraction)), seed)


def blind(rows: DataFrame, seed: int = 23) -> DataFrame:
    """place, id and text in shuffled order: nothing else reaches an annotator."""
    sheet = rows.select(*BLIND).withColumn("place", F.row_number().over(W.orderBy(shuffled(seed), "id")))  # a drawn set
    return sheet.select("place", *BLIND)


def split(rows: DataFrame, label: str, percent: int = 20, seed: int = 24) -> DataFrame:
    """rows with part: of each label the first ``percent`` in seeded order (rounded) to fit, the rest to evaluate. For labelled sets."""
    by = W.partitionBy(label)
    rank = F.row_number().over(by.orderBy(shuffled(seed), "id"))
    return rows.withColumn("part", F.when(rank <= F.round(F.count(F.lit(1)).over(by) * percent / 100), "fit").otherwise("evaluate"))


def label_problems(labels: DataFrame, assigned: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """(problem, n): ids that repeat, are unknown, or lack a label; labels that don't exist."""
    count = lambda df, name: df.agg(F.lit(name).alias("problem"), F.count(F.lit(1)).alias("n"))
    out = count(labels.groupBy("id").agg(F.count(F.lit(1)).alias("k")).where("k > 1 OR id IS NULL"), "repeated or null ids")
    out = out.unionByName(count(labels.join(assigned, "id", "left_anti"), "ids outside the set"))
    out = out.unionByName(count(assigned.join(labels, "id", "left_anti"), "items without a label"))
    return out.unionByName(count(labels.where(~F.coalesce(F.col("label").isin(*allowed), F.lit(False))), "unknown labels"))


def joined_labels(labels: DataFrame, assigned: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """Labels with their items, one to one; any problem is an error that tells all counts."""
    problems = label_problems(labels, assigned, allowed).where("n > 0").collect()
    if problems:
        raise ValueError("; ".join(f"{r['problem']}: {r['n']}" for r in problems))
    return assigned.join(labels, "id")


def joined_measurements(first: DataFrame, second: DataFrame, key: str = "id") -> DataFrame:
    """Two measurements of exactly the same ids, with no other column in common; else an error."""
    both = (set(first.columns) & set(second.columns)) - {key}
    if both:
        raise ValueError(f"both have {', '.join(sorted(both))}")
    for a, b, name in ((first, second, "second"), (second, first, "first")):
        if a.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(f"n > 1 OR {key} IS NULL").limit(1).count():
            raise ValueError("ids repeat or are null")
        n = a.join(b, key, "left_anti").count()
        if n:
            raise ValueError(f"the {name} lacks {n} ids")
    return first.join(second, key)
