"""Exact top-k search by tiles, and approximate nearest neighbours by vantage-point trees.

Vectors are packed into tiles (shards) of bounded rows and bytes where they are read, without a shuffle; queries into blocks. Every
(query block, tile group) is one stream: the block first, then the group's tiles one after another, so a task holds
a block, a tile and the block's top lists and emits a list a query. Lists of the tile groups are merged by a window limited
to the first k, which Spark applies before and after its shuffle. All queries meet all tiles, in blocks; nothing is
broadcast and no pairs are made as rows. Components travel in the narrowest type that holds them exactly.

Ties go to the smaller id, in every step: identical vectors of a tile are one candidate with its smallest ids.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part (nor zero vectors in the
tree search), nor do rows without an id; vectors of another length than the query's are no candidates for it; rows that
repeat an id are rows of their own, none of which is a candidate for a query of that id; fewer candidates than k
give all; an empty table gives no rows; other columns are not touched. Large components: integer scores beyond 64 bits count as
the largest (or least) long, scaled components beyond doubles as the largest double; inner products beyond doubles are infinite.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepanel.llm import common

#: Rows of a tile, of a tree's shard and of a query block, bytes of any of them, and points of a tree's leaf.
TILE, SHARD, BLOCK, BYTES, LEAF = 2048, 8192, 4096, 16 << 20, 16
#: Share of true neighbours that a measured pruning factor has to reach on the sampled queries, and their number.
RECALL, SAMPLED = 0.94, 64
#: Bits of a limb of an integer too large for exact products of doubles, and the magnitude from which on a row is cut into limbs.
LIMB, LARGE = 20, 2.0**20


def dump(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def narrow(vec: np.ndarray) -> np.ndarray:
    """The same numbers in the narrowest of a few types that holds them all exactly."""
    most = np.abs(vec).max(initial=0)
    for kind, bound in ((np.int8, 127), (np.int16, 2**15 - 1), (np.int32, 2**31 - 1), (np.float32, 3e38)):
        if most <= bound and ((small := vec.astype(kind)) == vec).all():
            return small
    return vec


def load(raw: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(raw)) as found:
        return {k: found[k] for k in found.files}


def widened(tile: dict) -> dict:
    return tile | {"vec": tile["vec"].astype(np.float64)}


def usable(batch: pa.RecordBatch, zero: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors as double) of the rows that take part, by length."""
    ids, lists = batch.column("id"), batch.column("vec")
    by_length: dict[int, list[int]] = {}
    lengths = pc.list_value_length(lists)
    for k, (i, n) in enumerate(zip(ids.is_valid().to_pylist(), lengths.to_pylist(), strict=True)):
        if i and n:
            by_length.setdefault(n, []).append(k)
    for n, rows in by_length.items():
        own = lists.take(pa.array(rows))
        flat = own.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, n)
        good = np.isfinite(flat).all(axis=1)
        if not zero:
            good &= (flat != 0).any(axis=1)
        yield ids.take(pa.array(rows)).to_numpy(zero_copy_only=False).astype(np.int64)[good], flat[good]


def _packer(size: int, zero: bool, build):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        upto = lambda n: max(1, min(size, BYTES // (8 * n)))

        def tile(n: int, rows: int) -> pa.RecordBatch:
            ids, vec = (np.concatenate(x) for x in zip(*held[n], strict=True))
            held[n] = [(ids[rows:], vec[rows:])]
            return pa.RecordBatch.from_pydict({"rows": pa.array([len(ids[:rows])], pa.int64()), "data": pa.array([build(ids[:rows], vec[:rows])], pa.binary())})

        for batch in batches:
            for ids, vec in usable(batch, zero):
                n = vec.shape[1]
                held.setdefault(n, []).append((ids, vec))
                while sum(len(x[0]) for x in held[n]) >= upto(n):
                    yield tile(n, upto(n))
        for n in held:
            if sum(len(x[0]) for x in held[n]):
                yield tile(n, upto(n))

    return run


def pack(df: DataFrame, key: str, vec: str, size: int, zero: bool, build, what: str) -> DataFrame:
    """Saved tiles (no, rows, data); no counts from 0, found by a window over one row a tile."""
    read = df.select(F.col(key).cast("long").alias("id"), F.col(vec).alias("vec"))
    made = read.mapInArrow(_packer(size, zero, build), "rows bigint, data binary").withColumn("part", F.spark_partition_id())
    tiles = common.saved(made.withColumn("at", F.monotonically_increasing_id() - F.shiftleft(F.col("part").cast("long"), 33)), what)
    # Numbers without a gap: tiles are counted a partition, and only those counts meet in one place.
    counts = tiles.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select(F.col("part").alias("_part"), (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("_before"))
    return tiles.join(F.broadcast(before), F.col("part") == F.col("_part")).select("rows", "data", (F.col("_before") + F.col("at")).cast("int").alias("no"))


def plain_tile(ids: np.ndarray, vec: np.ndarray) -> bytes:
    order = np.argsort(ids, kind="stable")
    return dump(ids=ids[order], vec=narrow(vec[order]))


class Best:
    """Top lists of a block's queries: larger score first, then smaller id."""

    def __init__(self, own: np.ndarray, k: int, kind):
        self.k, self.own, n = k, own, len(own)
        self.none = -np.inf if kind is np.float64 else np.iinfo(np.int64).min
        self.score, self.id = np.full((n, k), self.none, kind), np.full((n, k), np.iinfo(np.int64).max, np.int64)

    @property
    def least(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Candidates as flat arrays; a query's own id is none."""
        keep = ids != self.own[query]
        query, score, ids = query[keep], score[keep], ids[keep]
        if not len(query):
            return
        rows = np.unique(query)
        q = np.concatenate([query, np.repeat(rows, self.k)])
        s, i = np.concatenate([score, self.score[rows].ravel()]), np.concatenate([ids, self.id[rows].ravel()])
        order = np.lexsort((i, -s if s.dtype == np.float64 else ~s, q))
        q, s, i = q[order], s[order], i[order]
        first = np.searchsorted(q, rows)
        take = first[:, None] + np.arange(self.k)
        self.score[rows], self.id[rows] = s[take], i[take]


def _searcher(k: int, search, kind):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = block = best = None

        def lists() -> pa.RecordBatch:
            n, real = len(block["ids"]), best.id != np.iinfo(np.int64).max
            row = np.repeat(np.arange(n, dtype=np.int64), real.sum(axis=1))
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(row), where[0], np.int64)), pa.array(row), pa.array(block["ids"][row]), pa.array(best.id[real]), pa.array(best.score[real])],
                names=["block", "row", "query_id", "id", "score"],
            )

        for batch in batches:
            for q, g, seq, data in zip(*(batch.column(c) for c in ("block", "part", "seq", "data")), strict=True):
                if (q.as_py(), g.as_py()) != where:
                    if best is not None:
                        yield lists()
                    where, block, best = (q.as_py(), g.as_py()), None, None
                if seq.as_py() == 0:
                    block = widened(load(data.as_py()))
                    best = Best(block["ids"], k, kind)
                elif block is not None:
                    tile = widened(load(data.as_py()))
                    if tile["vec"].shape[1] == block["vec"].shape[1]:
                        search(block, tile, best)
        if best is not None:
            yield lists()

    return run


def top(tiles: DataFrame, blocks: DataFrame, k: int, search, kind, key: str) -> DataFrame:
    """query_id, rank, key, score: each query's k best of the tiles, by the given searcher."""
    spark = tiles.sparkSession
    n_blocks, n_tiles = blocks.count(), tiles.count()
    parts = max(1, min(n_tiles, -(-2 * spark.sparkContext.defaultParallelism // max(1, n_blocks))))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(0, n - 1)))) if n else F.explode(F.array().cast("array<int>"))
    rows = blocks.select(F.col("no").alias("block"), upto(parts).alias("part"), F.lit(0).alias("seq"), "data").unionByName(
        tiles.select(upto(n_blocks).alias("block"), (F.col("no") % parts).alias("part"), (F.col("no") + 1).alias("seq"), "data")
    )
    streams = rows.repartitionById(max(1, n_blocks * parts), (F.col("block") * parts + F.col("part")).cast("int"))
    kind_name = "double" if kind is np.float64 else "bigint"
    found = streams.sortWithinPartitions("block", "part", "seq").mapInArrow(_searcher(k, search, kind), f"block bigint, row bigint, query_id bigint, id bigint, score {kind_name}")
    order = W.partitionBy("block", "row").orderBy(F.col("score").desc(), F.col("id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(key), "score")


# Exact search


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """Whole numbers held as doubles, as signed digits to the base 2^LIMB, lowest first."""
    sign, rest, out = np.sign(x), np.abs(x), []
    while rest.max(initial=0) > 0 or not out:
        out.append(sign * np.fmod(rest, 2.0**LIMB))
        rest = np.floor(rest / 2.0**LIMB)
    return out


def long_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a and b, exact; beyond 64 bits the largest or least long that a list holds."""
    out = np.empty((len(a), len(b)), np.int64)
    step = max(1, (1 << 20) // max(1, len(b)))
    lb, width = limbs(b), 4096  # 2^40 times width is exact
    for low in range(0, len(a), step):
        la = limbs(a[low : low + step])
        levels = np.zeros((max(4, len(la) + len(lb)) + 4, len(la[0]), len(b)), np.int64)
        for i, x in enumerate(la):
            for j, y in enumerate(lb):
                for c in range(0, x.shape[1], width):
                    levels[i + j] += (x[:, c : c + width] @ y[:, c : c + width].T).astype(np.int64)
        for p in range(len(levels) - 1):
            levels[p + 1] += levels[p] >> LIMB
            levels[p] &= (1 << LIMB) - 1
        high = levels[-1]
        for p in range(len(levels) - 2, 2, -1):
            high = np.clip((high << LIMB) + levels[p], -(1 << 40), 1 << 40)
        fits = (high >= -8) & (high < 8)
        value = (np.where(fits, high, 0) << 60) + (levels[2] << 40) + (levels[1] << LIMB) + levels[0]
        most = np.iinfo(np.int64).max
        out[low : low + step] = np.where(fits, np.maximum(value, -most), np.where(high > 0, most, -most))
    return out


def exact_search(block: dict, tile: dict, best: Best) -> None:
    """Matrix products, then the columns at or above what each query still needs (a tile's columns are in order of id).

    Rows with large components, on either side, are multiplied apart from the rest, so one of them costs no more than itself.
    """
    q, x = block["vec"], tile["vec"]
    big_q, big_x = (np.abs(v).max(axis=1) >= LARGE for v in (q, x))
    if x.shape[1] >= 1 << 13:  # so many columns that sums of products of small ones leave the exact doubles
        big_q[:], big_x[:] = True, True
    for rows, cols, product in (
        (~big_q, ~big_x, lambda a, b: a @ b.T), (big_q, np.ones(len(x), bool), long_products), (~big_q, big_x, long_products),
    ):
        rows, cols = np.flatnonzero(rows), np.flatnonzero(cols)
        for low in range(0, len(rows), 512):
            if len(cols):
                _columns(block["ids"], rows[low : low + 512], tile["ids"][cols], product(q[rows[low : low + 512]], x[cols]), best)


def _columns(own: np.ndarray, queries: np.ndarray, ids: np.ndarray, score: np.ndarray, best: Best) -> None:
    k = best.k
    rows = np.flatnonzero(score.max(axis=1) >= best.least[queries])
    if not len(rows):
        return
    none = -np.inf if score.dtype == np.float64 else np.iinfo(np.int64).min
    queries, score = queries[rows], score[rows]
    score[own[queries][:, None] == ids] = none  # a query's own id is none, however often it is there
    need = best.least[queries].astype(score.dtype)
    if len(ids) > k:
        need = np.maximum(need, np.partition(score, -k, axis=1)[:, -k])
    more = score > need[:, None]
    even = (score == need[:, None]) & (score > none)
    even &= np.cumsum(even, axis=1) <= k
    q, c = np.nonzero(more | even)
    best.add(queries[q], score[q, c].astype(np.int64), ids[c])


def scaled(vec: str, by: float) -> Column:
    """floor(by * x) of every component, still as doubles, for they may be large; beyond doubles the largest of them."""
    whole = lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)
    most = lambda x, y: F.when((F.abs(y) == float("inf")) & (F.abs(x) < float("inf")), F.signum(y) * 1.7976931348623157e308).otherwise(y)
    return F.transform(F.col(vec), lambda x: whole(most(x.cast("double"), x.cast("double") * by)))


def exact_top(df: DataFrame, queries: Column, k: int = 20, scale: float = 64.0, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """Each query's k largest integer inner products of components floor(scale * x)."""
    whole = lambda rows: rows.select(key, scaled(vec, scale).alias(vec))
    with common.Scratch(df.sparkSession) as scratch:
        tiles = pack(whole(df), key, vec, TILE, True, plain_tile, "tiles")
        blocks = pack(whole(df.where(queries)), key, vec, BLOCK, True, plain_tile, "query-blocks")
        out = common.saved(top(tiles, blocks, k, exact_search, np.int64, key), "top-lists")
        scratch.keep(out)
        return out


def op6_exact_top_k(spark, sf_dir: str) -> DataFrame:
    return exact_top(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


# Vantage-point trees


def exponent(vec: np.ndarray) -> int:
    """The power of two that brings the largest component to at most 1."""
    return int(np.frexp(np.abs(vec).max(initial=0))[1])


def tree_tile(ids: np.ndarray, vec: np.ndarray) -> bytes:
    """A shard: a vantage-point tree over its distinct vectors, scaled by a power of two (so nothing overflows or changes).

    Largest inner products are nearest points once a last component makes all of one length. Every inner node has a vantage point,
    the farthest from its first point, and halves its points by their distance to it. A leaf knows the least and
    the largest distance of its own points to each vantage point above it.
    """
    order = np.argsort(ids, kind="stable")
    ids, vec = ids[order], vec[order]
    power = exponent(vec)
    distinct, inverse = np.unique(np.ldexp(vec, -power), axis=0, return_inverse=True)
    by = np.argsort(inverse.ravel(), kind="stable")
    ids, starts = ids[by], np.searchsorted(inverse.ravel()[by], np.arange(len(distinct) + 1))
    norm = (distinct**2).sum(axis=1)
    high = norm.max(initial=0)
    points = np.hstack([distinct, np.sqrt(np.maximum(0, high - norm))[:, None]])
    vantage, bounds, leaves = [], [], []
    open_: list[tuple[np.ndarray, list]] = [(np.arange(len(distinct)), [])] if len(distinct) else []
    while open_:
        rows, path = open_.pop()
        if len(rows) <= LEAF:
            bounds += [(len(leaves), node, d.min(), d.max()) for node, d in path]
            leaves.append(rows)
            continue
        far = ((points[rows] - points[rows[0]]) ** 2).sum(axis=1)
        v = points[rows[far.argmax()]]
        d = np.sqrt(((points[rows] - v) ** 2).sum(axis=1))
        half, cut = np.argsort(d, kind="stable"), len(rows) // 2
        for side in (half[cut:], half[:cut]):
            open_.append((rows[side], [*[(node, e[side]) for node, e in path], (len(vantage), d[side])]))
        vantage.append(v)
    rows = np.concatenate(leaves) if leaves else np.arange(0)
    return dump(
        ids=ids, first=starts[rows], stop=starts[rows + 1], vec=narrow(distinct[rows]), power=np.array([power]),
        leaf=np.cumsum([0, *map(len, leaves)]), high=np.array([high]),
        vantage=np.array(vantage).reshape(-1, points.shape[1]), bounds=np.array(bounds, np.float64).reshape(-1, 4),
    )


class Query:
    """A block's queries, each scaled by a power of two, and distances of scores in a shard's terms.

    A query's length changes no order of its products, so for distances it is as long as the shard's longest vector.
    """

    def __init__(self, vec: np.ndarray, tile: dict):
        own = np.frexp(np.abs(vec).max(axis=1))[1]
        self.vec, self.power, self.high = np.ldexp(vec, -own[:, None]), own + int(tile["power"][0]), float(tile["high"][0])
        norm = (self.vec**2).sum(axis=1)
        self.stretch = np.sqrt(self.high / norm)
        self.slack = 1e-9 * (1 + norm + self.high)

    def scaled(self, score: np.ndarray) -> np.ndarray:
        """Scores in the shard's terms; one beyond doubles tells nothing."""
        known = np.isfinite(score)
        return np.where(known, np.ldexp(np.where(known, score, 0), -self.power), -np.inf)

    def reach(self, score: np.ndarray) -> np.ndarray:
        """The distance of a point with this score."""
        return np.sqrt(np.maximum(0, 2 * self.high - 2 * self.stretch * self.scaled(score) + self.slack * (1 + self.stretch)))

    def leaf_bounds(self, tile: dict) -> np.ndarray:
        """The least distance that any point of each leaf can have from each query, by the triangle inequality."""
        lower = np.zeros((len(self.vec), len(tile["leaf"]) - 1))
        if len(tile["vantage"]):
            to = (self.vec * self.stretch[:, None]) @ tile["vantage"][:, :-1].T
            to = np.sqrt(np.maximum(0, self.high + (tile["vantage"] ** 2).sum(axis=1) - 2 * to))
            for leaf, node, least, most in tile["bounds"]:
                d = to[:, int(node)]
                np.maximum(lower[:, int(leaf)], np.maximum(least - d, d - most), out=lower[:, int(leaf)])
        return lower


def tree_search(factor: float, seen: list | None = None):
    """A searcher; seen, if given, gets (points compared, points there are) of each block and shard."""

    def search(block: dict, tile: dict, best: Best) -> None:
        """Each query's nearest leaf first, then all whose least possible distance is at most factor times the k-th distance so far."""
        if not len(tile["vec"]):
            return
        query, leaf = Query(block["vec"], tile), tile["leaf"]
        lower = query.leaf_bounds(tile)
        own = np.diff(np.searchsorted(np.sort(tile["ids"]), [block["ids"], block["ids"] + 1]), axis=0)[0]  # rows with each query's id: none of them is a candidate
        done = np.zeros(lower.shape, bool)

        def compare(at: int, rows: np.ndarray) -> None:
            low, up = leaf[at], leaf[at + 1]
            score = query.vec[rows] @ tile["vec"][low:up].T
            need = (query.scaled(best.least) - query.slack)[rows]
            q, c = np.nonzero(score >= need[:, None])
            if not len(q):
                return
            q, c = rows[q], low + c
            exact = np.ldexp(np.einsum("ij,ij->i", query.vec[q], tile["vec"][c]), query.power[q])
            copies = np.minimum(tile["stop"][c] - tile["first"][c], best.k + own[q])
            at_ = np.repeat(tile["first"][c], copies) + np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
            best.add(np.repeat(q, copies), np.repeat(exact, copies), tile["ids"][at_])

        if np.isneginf(best.least).any():  # nothing known yet: the nearest leaf of each query
            first = lower.argmin(axis=1)
            for at in np.unique(first):
                compare(at, np.flatnonzero(first == at))
            done[np.arange(len(first)), first] = True
        for at in np.argsort(lower.mean(axis=0), kind="stable"):
            rows = np.flatnonzero((lower[:, at] <= factor * query.reach(best.least)) & ~done[:, at])
            if len(rows):
                compare(at, rows)
                done[rows, at] = True
        if seen is not None:
            seen.append((int((done * np.diff(leaf)).sum()), len(block["ids"]) * int(leaf[-1])))

    return search


def _measure(k: int, shared):
    """For each shard and sampled query: its k best points there, with the least distance that the tree allows to their leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = shared.value
        for batch in batches:
            for data in batch.column("data"):
                tile = widened(load(data.as_py()))
                which = np.array([n for n, v in enumerate(vectors) if len(v) == tile["vec"].shape[1]], np.int64)
                if not len(which) or not len(tile["vec"]):
                    continue
                query = Query(np.array([vectors[n] for n in which]), tile)
                point = np.repeat(np.arange(len(tile["vec"])), tile["stop"] - tile["first"])  # of each row, in order of rows from here on
                rows = np.concatenate([np.arange(a, b) for a, b in zip(tile["first"], tile["stop"], strict=True)])
                score = np.ldexp(query.vec @ tile["vec"].T, query.power[:, None])[:, point]
                score[ids[which][:, None] == tile["ids"][rows]] = -np.inf
                at = np.argsort(-score, axis=1, kind="stable")[:, :k]
                leaf_of = np.repeat(np.arange(len(tile["leaf"]) - 1), np.diff(tile["leaf"]))
                q = np.repeat(np.arange(len(which)), at.shape[1])
                at = at.ravel()
                keep = score[q, at] > -np.inf
                q, at = q[keep], at[keep]
                lower = query.leaf_bounds(tile)[q, leaf_of[point[at]]]
                columns = (which[q], score[q, at], lower, np.full(len(q), 2 * query.high), 2 * query.stretch[q], query.power[q].astype(np.int64))
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["query", "score", "lower", "square", "stretch", "power"])

    return run


def measured_factor(tiles: DataFrame, queries: DataFrame, k: int, key: str, vec: str, recall: float = RECALL, sampled: int = SAMPLED) -> float:
    """The pruning factor at which this share of the sampled queries' true neighbours lies in leaves that are kept.

    The sample is at most so many queries, by hash; each is compared with every point. A neighbour's leaf is kept if its least
    distance is at most factor times the distance of the k-th neighbour, so the factor is a quantile of their ratio.
    """
    x = F.col("v")
    usable_ = F.col("i").isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0)
    sample = queries.select(F.col(key).cast("long").alias("i"), F.col(vec).cast("array<double>").alias("v")).where(usable_)
    taken = sample.orderBy(F.xxhash64("i", "v")).limit(sampled).collect()
    if not taken:
        return 1.0
    shared = tiles.sparkSession.sparkContext.broadcast((np.array([r["i"] for r in taken]), [np.array(r["v"]) for r in taken]))
    found = tiles.select("data").mapInArrow(_measure(k, shared), "query bigint, score double, lower double, square double, stretch double, power bigint")
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score")))
    best: dict[int, list] = {}
    for r in found.withColumn("rank", rank).where(F.col("rank") <= k).collect():  # at most k rows a sampled query
        best.setdefault(r["query"], []).append(r)
    ratios = []
    for rows in best.values():
        kth = min(r["score"] for r in rows)
        for r in rows:
            near = np.ldexp(kth, -r["power"]) if np.isfinite(kth) else -np.inf
            reach = np.sqrt(max(0.0, r["square"] - r["stretch"] * near))
            ratios.append(min(1.0, r["lower"] / reach) if reach > 0 else float(r["lower"] > 0))
    return float(np.sort(ratios)[min(len(ratios) - 1, int(recall * len(ratios)))]) if ratios else 1.0


def nearest(df: DataFrame, queries: Column, k: int = 20, factor: float | None = None, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """Each query's k largest inner products in double precision, found in vantage-point trees.

    factor: 1 is exact; less also leaves out leaves whose least possible distance is more than that share of the k-th distance.
    None measures the factor that ``RECALL`` needs on at most ``SAMPLED`` queries.
    """
    read = df.select(key, vec)
    with common.Scratch(df.sparkSession) as scratch:
        tiles = pack(read, key, vec, SHARD, False, tree_tile, "shards")
        blocks = pack(read.where(queries), key, vec, BLOCK, False, plain_tile, "query-blocks")
        if factor is None:
            factor = measured_factor(tiles, read.where(queries), k, key, vec)
        out = common.saved(top(tiles, blocks, k, tree_search(factor), np.float64, key), "top-lists")
        scratch.keep(out)
        return out


def op1_vantage_trees(spark, sf_dir: str) -> DataFrame:
    return nearest(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
