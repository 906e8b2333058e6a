"""Vector searches against brute force."""

import math

import numpy as np
from pyspark.sql import functions as F

from tidepanel.llm import vectors


def frame(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    vec = np.float32(centres[rng.integers(12, size=900)] + 0.3 * rng.normal(size=(900, 16)))
    vec[100:160] = vec[100]  # ties
    rows = [(i, v.tolist(), 7) for i, v in enumerate(vec)]
    rows += [(2000, None, 1), (2001, [float("nan")] * 16, 1), (2002, [None] + [1.0] * 15, 1), (2003, [0.0] * 16, 1), (2004, [1.0, 2.0], 1), (None, [1.0] * 16, 1), (2005, [], 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int").repartition(5), vec


def brute(ids, vec, k=20):
    out = {}
    for q in range(0, 900, 20):
        s = (vec.astype(np.float64) * vec[q].astype(np.float64)).sum(axis=1)
        order = sorted((j for j in range(len(vec)) if j != q), key=lambda j: (-round(s[j], 9), ids[j]))[:k]
        out[q] = [(ids[j], s[j]) for j in order]
    return out


def test_factor_one_is_exact_and_recall_holds(spark):
    df, vec = frame(spark)
    truth = brute(range(900), vec)
    for factor, least in ((1.0, 1.0), (None, 0.9)):
        got = {}
        for r in vectors.nearest(df, F.col("vec_id") % 20 == 0, factor=factor).collect():
            got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
        hits = 0
        for q, want in truth.items():
            found = [got[q][k] for k in range(1, 21)]
            hits += len({v for v, _ in found} & {v for v, _ in want})
            if factor == 1.0:
                assert all(math.isclose(a[1], b[1], rel_tol=1e-9) for a, b in zip(found, want, strict=True))
        assert hits >= least * 20 * len(truth)
        assert set(got) == set(truth)  # no row that takes no part asks; the one query of another length has no candidate
    assert vectors.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_a_smaller_factor_compares_fewer_points():
    rng = np.random.default_rng(3)
    vec = rng.normal(size=(40, 8))[rng.integers(40, size=4000)] + 0.05 * rng.normal(size=(4000, 8))
    tile, ids = vectors.widened(vectors.load(vectors.tree_tile(np.arange(4000), vec))), np.arange(0, 4000, 40)
    block, exact = {"ids": ids, "vec": vec[ids]}, vec[ids] @ vec.T
    exact[np.arange(len(ids)), ids] = -np.inf
    shares, recalls = [], []
    for factor in (1.0, 0.7, 0.4):
        seen, best = [], vectors.Best(ids, 20, np.float64)
        vectors.tree_search(factor, seen)(block, tile, best)
        shares.append(sum(a for a, _ in seen) / sum(b for _, b in seen))
        recalls.append(np.mean([len(set(best.id[k]) & set(np.argsort(-exact[k])[:20])) / 20 for k in range(len(ids))]))
    assert recalls[0] == 1.0 and shares[0] < 0.5 and shares[2] < shares[1] < shares[0]


def test_integer_products_of_any_size_are_exact(spark):
    rng = np.random.default_rng(4)
    a = np.vstack([np.floor(rng.normal(size=(20, 6)) * 10.0 ** rng.integers(0, 12, size=(20, 1))), [[1e300, -1e300, 7, 0, 0, 0], [1e300, 1e300, 2, 1, 1, 1], [1e18, 0, 0, 0, 0, 0]]])
    most = 2**63 - 1
    want = [[max(-most, min(most, sum(int(x) * int(y) for x, y in zip(p, q, strict=True)))) for q in a] for p in a]
    assert vectors.long_products(a, a).tolist() == want
    df = spark.createDataFrame([(20 * k, (v / 64).tolist(), 0) for k, v in enumerate(a)] + [(1, [1.7e308] * 6, 0)], "vec_id long, embedding array<double>, score int").repartition(3)
    got = {}
    for r in vectors.exact_top(df, F.col("vec_id") % 20 == 0, k=5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    rows, ids = np.vstack([a, [[1.7976931348623157e308] * 6]]), [*(20 * k for k in range(len(a))), 1]
    whole = [[int(math.floor(64 * (x / 64))) if abs(x) < 2**53 else int(x) for x in v] for v in rows]
    for k in range(len(a)):
        s = [max(-most, min(most, sum(x * y for x, y in zip(whole[k], v, strict=True)))) for v in whole]
        best = sorted((j for j in range(len(ids)) if j != k), key=lambda j: (-s[j], ids[j]))[:5]
        assert [(v, x) for _, v, x in sorted(got[20 * k])] == [(ids[j], s[j]) for j in best]


def test_large_components_lose_no_neighbour(spark):
    rng = np.random.default_rng(5)
    vec = rng.normal(size=(300, 8))
    vec[150] *= 1e200
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vec)], "vec_id long, embedding array<double>").coalesce(1)
    got = {}
    for r in vectors.nearest(df, F.col("vec_id") % 20 == 0, factor=1.0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    for q in range(0, 300, 20):
        s = vec @ vec[q]
        assert [v for _, v in sorted(got[q])] == sorted((j for j in range(300) if j != q), key=lambda j: (-s[j], j))[:20]


def test_exact_top_by_integers(spark):
    df, vec = frame(spark)
    whole = np.floor(64 * vec.astype(np.float64))
    got = {}
    for r in vectors.exact_top(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ids = [*range(900), 2003]
    all_ = np.vstack([whole, np.zeros(16)])
    for q in range(0, 900, 20):
        s = all_ @ all_[q]
        want = sorted((j for j in range(901) if j != q), key=lambda j: (-s[j], ids[j]))[:20]
        assert [(v, x) for _, v, x in sorted(got[q])] == [(ids[j], int(s[j])) for j in want]
    assert vectors.exact_top(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_a_repeated_query_id_costs_no_candidate(spark):
    rng = np.random.default_rng(2)
    vec = np.float32(rng.normal(size=(300, 8)))
    vec[40:75] = 5  # copies that score best for one another, some of them of a repeated id
    ids = [20, 20, *range(101, 138), 60, *[40] * 25, *range(201, 436)]
    vec[:2] = 3 * vec[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, vec, strict=True)], "vec_id long, embedding array<float>").coalesce(1)
    for found, whole in ((vectors.exact_top(df, F.col("vec_id").isin(20, 40)), np.floor(64 * vec.astype(np.float64))), (vectors.nearest(df, F.col("vec_id").isin(20, 40), factor=1.0), vec.astype(np.float64))):
        got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in found.collect())
        want = []
        for q in (k for k in range(300) if ids[k] in (20, 40)):
            s = whole @ whole[q]
            best = sorted((j for j in range(300) if ids[j] != ids[q]), key=lambda j: (-round(s[j], 9), ids[j]))[:20]
            want += [(ids[q], k + 1, ids[j], round(float(s[j]), 6)) for k, j in enumerate(best)]
        assert got == sorted(want)
