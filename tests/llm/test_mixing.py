"""Water-filling by hand, and the mix's promises."""

import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tidepanel.llm import mixing


def filled(sizes, weights, share=Fraction(3, 2), epochs=2):
    """Clamp, reshare, repeat."""
    budget, open_, target = share * sum(sizes), set(range(len(sizes))), {}
    while open_:
        total = sum(weights[k] for k in open_)
        if not total:
            break
        over = [k for k in open_ if budget * weights[k] / total >= epochs * sizes[k]]
        if not over:
            target |= {k: budget * weights[k] / total for k in open_}
            break
        for k in over:
            target[k] = Fraction(epochs * sizes[k])
            budget -= epochs * sizes[k]
            open_.remove(k)
    return [float(target[k]) for k in range(len(sizes))]


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1000, 1, 1], [5, 500, 40, 40, 900, 2], [0, 7, 3], [100]])
def test_targets_are_those_of_clamping_and_resharing(spark, sizes):
    rows = [(i * 1000 + k, " ".join(["w"] * 1), f"s{i}") for i, n in enumerate(sizes) for k in range(n)] + [(i * 1000 + 999, None, f"s{i}") for i in range(len(sizes))]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = {r["source"]: r for r in mixed.groupBy("source").agg(F.max("mix_.target").alias("target"), F.sum(F.col("mix_.size") * F.col("mix_.times")).alias("taken"), F.max("mix_.times").alias("times")).collect()}
    for i, target in enumerate(filled(sizes, [(3, 1, 2)[i % 3] for i in range(len(sizes))])):
        row = got[f"s{i}"]
        assert math.isclose(row["target"], target, rel_tol=1e-9, abs_tol=1e-9)
        assert abs(row["taken"] - target) <= 2 and row["times"] <= 2


def test_nulls_ties_clashes_and_empty(spark):
    rows = [(1, "a b", None, 7), (1, "a b", None, 7), (None, None, "x", 8), (3, "", "x", 9), (4, "c " * 5000, "é", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target int")
    out = mixing.repeated(docs)
    assert out.columns == docs.columns and out.where("doc_id = 4").count() in (1, 2)
    assert mixing.mix(docs).where("source IS NULL").select("mix_.source_size").first()[0] == 4
    assert mixing.repeated(docs.limit(0)).count() == 0
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, mixing.mix(docs.repartition(3)).collect()))
