"""Connected components of an edge table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm import common


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 200) -> DataFrame:
    """edges to (node, comp), comp the smallest node reachable; nodes without an edge are absent.

    Every round, a node takes the least label among its own and its neighbours', and then its label's label, so that
    labels travel twice as far each round. Edges of a node with very many of them are dealt over salts, and labels meet by partial
    aggregation, so such a node costs each task a row. Rounds are written to the shared folder, and each deletes the one before it.
    Rounds are as many as the logarithm of the longest path; labels that still change after ``most_rounds`` are an error.
    """
    with common.Scratch(edges.sparkSession) as scratch:
        both = common.saved(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).unionByName(edges.select(F.col(b).alias("a"), F.col(a).alias("b"))).where("a <> b").distinct(), "edges")
        heavy = common.salts(both, "a")
        labels = common.saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("comp")), "labels")
        for _ in range(most_rounds):
            spread = common.copied(labels.select(F.col("node").alias("a"), "comp"), "a", heavy)
            near = common.dealt(both, "a", heavy, "b").join(spread, ["a", "salt"]).groupBy(F.col("b").alias("node")).agg(F.min("comp").alias("near"))
            step = labels.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
            jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
            new = common.saved(step.join(jump, "comp", "left").select("node", "was", F.least("comp", F.coalesce("further", "comp")).alias("comp")), "labels")
            scratch.drop(labels)
            if new.where(F.col("was") != F.col("comp")).limit(1).count() == 0:
                scratch.keep(new)
                labels = new.select("node", "comp")
                labels._written = new._written
                return labels
            labels = new.select("node", "comp")
            labels._written = new._written
    raise RuntimeError(f"labels still changed after {most_rounds} rounds")
