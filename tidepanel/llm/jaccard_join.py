"""N-gram Jaccard join with adaptive multi-match prefixes.

Documents are sets of word shingles. Tokens are ordered by estimated frequency, rarest first. A document whose
overlap with a partner is at least a must share l tokens within the first |x| - a + l of this order, for any l; a
document takes the l (1 to ``MOST``) with the least estimated cost of lists to scan and candidates to verify. A pair with
l and m is a candidate if it shares min(l, m) prefix tokens, and candidates are verified on whole sets.

What is joined:

1. Equal sets are one class; from here on a class is its smallest document. A fixed-size sketch of frequencies is
   summed over all documents (``BINS`` counters; only the order of tokens and the choice of l depend on it, no result does).
2. In every prefix token's list, each class is paired with the list's leader, so lists give as many pairs as they
   have members; each class verifies its likeliest leader. Linked classes form components. In further rounds, lists
   fall into small groups by hash and a class verifies its likeliest partners of other components there.
3. The rest: only pairs of different components can still add anything. In lists that hold several components, all
   members outside the list's largest component meet the others, and every pair that shares enough tokens is verified.
   Lists that are still long (families of documents around the threshold) are compared two blocks at a time by
   products of incidence matrices, which give back spanning forests and no pairs.

So no link between different texts is lost, a group of thousands of near copies costs its size and not its
square, and lists are never gathered: they are equi-joins. A token in very many prefixes, and a document that very many
candidates share, are dealt over salts (``HOT_LIST`` rows each, or more in proportion to a large table, so salted keys stay few enough to broadcast).

Tables written on the way are deleted once the result is written.

Defined cases: null text or no words give an empty set, linked with nothing; fewer words than a shingle count as one
shingle; rows that repeat an identifier with different texts are nodes of their own and share no link by that;
a null identifier has a null component unless linked with another; an empty table gives no rows; other
columns are not touched. Shingles are compared by 64-bit hashes, equal sets by 128 bits.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepanel.llm import common, graphs, shingles

#: Counters of the frequency sketch, and pieces it travels in. Its broadcast is 4 * BINS bytes at any scale.
BINS, PIECES = 1 << 20, 64
#: Longest multi-match; costs of a prefix token, of a list entry and of a candidate.
MOST, TOKEN_COST, ENTRY_COST, CANDIDATE_COST = 3, 1.0, 0.1, 5.0
#: Sketches that one task adds up.
FAN = 32
#: Rounds of likely partners before the rest is joined, members of their groups, and partners that a class verifies.
ROUNDS, GROUP, BEST = 1, 8, 2
#: Open lists longer than HOT are compared in blocks of BLOCK members; columns of a block's matrix that are multiplied at once.
HOT, BLOCK, COLUMNS = 128, 256, 4096
#: Rows of a token, or candidates of a document, that one task of a join takes at most.
HOT_LIST = 1000
#: Texts that a worker holds the sets of at once.
TOGETHER = 50


def _trim(run):
    return lambda batches: common.trimmed(run(batches))


def overlap_needed(n: int, percent: int) -> int:
    """Least intersection of a set of n with any set it links with."""
    return -(-percent * n // 100)


def _first_pass(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counts = np.zeros(BINS, np.uint32)
        names = ["node", "key", "n", "set_key", "task", "piece", "counts"]
        for batch in common.slices(batches, TOGETHER):
            n, keys = [], []
            for found in shingles.sets(batch.column("text").to_pylist(), words):
                n.append(len(found))
                keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                counts += np.bincount((found & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS).astype(np.uint32) if len(found) > BINS // 8 else 0
                if len(found) <= BINS // 8:
                    at, times = np.unique((found & np.uint64(BINS - 1)).astype(np.int64), return_counts=True)
                    counts[at] += times.astype(np.uint32)
            rows = len(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("key"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())],
                names=names,
            )
        task = TaskContext.get().partitionId()
        pieces = [zlib.compress(p.tobytes(), 1) for p in np.split(counts, PIECES)]
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(PIECES, pa.int64()), pa.nulls(PIECES, pa.int64()), pa.nulls(PIECES, pa.int64()), pa.nulls(PIECES, pa.binary()), pa.array([task] * PIECES, pa.int64()), pa.array(range(PIECES), pa.int32()), pa.array(pieces, pa.binary())],
            names=names,
        )

    return run


def _added(table: pa.Table) -> pa.Table:
    total = np.zeros(BINS // PIECES, np.uint64)
    for raw in table.column("counts"):
        total += np.frombuffer(zlib.decompress(raw.as_py()), np.uint32)
    out = zlib.compress(np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes(), 1)
    return pa.table({"task": table.column("task").slice(0, 1), "piece": table.column("piece").slice(0, 1), "counts": pa.array([out], pa.binary())})


def sketch_of(parts: DataFrame) -> np.ndarray:
    """Add the tasks' sketches, FAN at a time; the driver gets the PIECES of the sum."""
    tasks = parts.agg(F.max("task")).first()[0]
    tasks = 1 if tasks is None else tasks + 1
    while True:
        parts = parts.withColumn("task", F.floor(F.col("task") / FAN)).groupBy("task", "piece").applyInArrow(_added, "task bigint, piece int, counts binary")
        tasks = -(-tasks // FAN)
        if tasks == 1:
            break
        parts = common.saved(parts, "sketches")
    out = np.zeros(BINS, np.uint32)
    for row in parts.collect():
        out.reshape(PIECES, -1)[row["piece"]] = np.frombuffer(zlib.decompress(row["counts"]), np.uint32)
    return out


def prefix(found: np.ndarray, sketch: np.ndarray, usual: float, percent: int) -> tuple[np.ndarray, int]:
    """The prefix tokens and the number of them that a partner must share."""
    n = len(found)
    often = sketch[(found & np.uint64(BINS - 1)).astype(np.int64)]
    need = overlap_needed(n, percent)
    most = min(MOST, need)
    size = n - need + most
    order = np.lexsort((found, often))[:size] if size < n else np.lexsort((found, often))
    lists = np.cumsum(np.maximum(0.0, often[order] - usual))
    best = min(range(1, most + 1), key=lambda m: (TOKEN_COST * (n - need + m) + (ENTRY_COST + CANDIDATE_COST / m) * lists[n - need + m - 1], m))
    return found[order[: n - need + best]], best


def _prefixes(words: int, percent: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = shared.value
        usual = float(sketch.mean() + 3 * np.sqrt(sketch.mean()) + 1)
        for part in common.slices(batches, TOGETHER):
            tokens, sizes, need, total, nodes = [], [], [], [], []
            for node, found in zip(part.column("node").to_pylist(), shingles.sets(part.column("text").to_pylist(), words), strict=True):
                if len(found):
                    own, least = prefix(found, sketch, usual, percent)
                    tokens.append(own)
                    sizes.append(len(own))
                    need.append(least)
                    total.append(len(found))
                    nodes.append(node)
            if tokens:
                spread = lambda x, kind: pa.array(np.repeat(np.array(x, kind), sizes))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(tokens).view(np.int64)), spread(nodes, np.int64), spread(total, np.int32), spread(need, np.int8), spread(sizes, np.int32)],
                    names=["token", "node", "n", "need", "size"],
                )

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, TOGETHER):
            found = [x.tobytes() for x in shingles.sets(part.column("text").to_pylist(), words)]
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(found, pa.binary())], names=["node", "set"])

    return run


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if len(x) > len(y):
        x, y = y, x
    if not len(x) or 100 * len(x) < percent * len(y):
        return False
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = [linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(hit, pa.bool_())], names=["a", "b", "hit"])

    return run


def _block_links(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """A spanning forest of the links between two blocks (or within one), from the product of their incidence matrices."""
        node, comp = (np.array(table.column(c)) for c in ("node", "comp"))
        own = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("set")]
        size = np.array(list(map(len, own)), np.int64)
        tokens = np.concatenate(own)
        order = np.argsort(tokens, kind="stable").astype(np.int32)
        tokens = tokens[order]
        new = np.ones(len(tokens), bool)
        new[1:] = tokens[1:] != tokens[:-1]
        alone = new.copy()
        alone[:-1] &= new[1:]  # a token of one set alone is in no intersection
        row = np.repeat(np.arange(len(own), dtype=np.int32), size)[order][~alone]
        col = (np.cumsum(new[~alone], dtype=np.int32) - 1).astype(np.int32)
        width = int(col[-1]) + 1 if len(col) else 0
        del tokens, order, new, alone
        both = np.zeros((len(own), len(own)), np.float32)
        for low in range(0, width, COLUMNS):
            a, b = np.searchsorted(col, [low, low + COLUMNS])
            part = np.zeros((len(own), COLUMNS), np.float32)
            part[row[a:b], col[a:b] - low] = 1
            both += part @ part.T  # counts below 2^24: exact
        both = both.astype(np.int64)
        hit = 100 * both >= percent * (size[:, None] + size[None, :] - both)
        x, y = np.nonzero(np.triu(hit, 1) & (comp[:, None] != comp[None, :]))
        root = {}

        def find(v):
            while root.setdefault(v, v) != v:
                root[v] = v = root[root[v]]
            return v

        edges = []
        for k, m in zip(x.tolist(), y.tolist(), strict=True):
            p, q = find(("c", comp[k])), find(("c", comp[m]))
            if p != q:
                root[max(p, q)] = min(p, q)
                edges.append((node[k], node[m]))
        return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})

    return run


def with_nodes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows(key, text, ...) with node: the key, but for keys that are null, negative or repeat a hash of key and text, below 0. And a table it reads."""
    again = rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1 OR key IS NULL OR key < 0")
    again = common.saved(again.select(F.col("key").alias("_again")), "repeated-keys")
    if again.limit(1).count() == 0:
        return rows.withColumn("node", F.col("key")), again
    own = -(F.xxhash64("key", "text").bitwiseAND(F.lit(2**62 - 1))) - 1
    odd = F.col("key").eqNullSafe(F.col("_again"))
    return (
        rows.join(common.small(again), odd, "left_semi").withColumn("node", own)
        .unionByName(rows.join(common.small(again), odd, "left_anti").withColumn("node", F.col("key")))
    ), again


class Join:
    """One similarity join: classes, links of classes, and documents' components."""

    def __init__(self, docs: DataFrame, words: int, percent: int, key: str = "doc_id", text: str = "text"):
        self.words, self.percent = words, percent
        self.docs, _ = with_nodes(docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")))
        first = common.saved(
            self.docs.mapInArrow(_trim(_first_pass(words)), "node bigint, key bigint, n bigint, set_key binary, task bigint, piece int, counts binary"), "shingle-sets"
        )
        #: One row a document: node, key, n, set_key.
        self.rows = first.where("task IS NULL").select("node", "key", "n", "set_key")
        self.sketch = sketch_of(first.where("task IS NOT NULL").select("task", "piece", "counts"))
        self.classes = common.saved(self.rows.where("n > 0").groupBy("set_key").agg(F.min("node").alias("rep"), F.min("key").alias("least"), F.count(F.lit(1)).alias("copies")), "classes")
        self.links = None
        self.repeats = self.rows.where("node < 0").limit(1).count() > 0

    def _prefix_rows(self) -> DataFrame:
        copies = common.saved(self.rows.join(self.classes, "set_key", "left").where("rep IS NULL OR node <> rep").select("node"), "not-representatives")
        reps = self.docs.join(common.small(copies), "node", "left_anti").select("node", "text")
        shared = reps.sparkSession.sparkContext.broadcast(self.sketch)
        return common.saved(reps.mapInArrow(_trim(_prefixes(self.words, self.percent, shared)), "token bigint, node bigint, n int, need tinyint, size int"), "prefixes")

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """pairs(a, b) that are links; sets are made again for the documents in question alone."""
        pairs = common.saved(pairs.select("a", "b").distinct(), "pairs")
        wanted = common.saved(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "wanted")
        made = self._sets_of(wanted)
        hot_a, hot_b = (common.salts(pairs, c, HOT_LIST) for c in "ab")
        one, two = (made.select(F.col("node").alias(c), F.col("set").alias(f"s{c}")) for c in "ab")
        left = common.dealt(pairs, "a", hot_a, "b").join(common.copied(one, "a", hot_a), ["a", "salt"]).drop("salt")
        whole = common.dealt(left, "b", hot_b, "a").join(common.copied(two, "b", hot_b), ["b", "salt"]).select("a", "b", "sa", "sb")
        hits = common.saved(whole.mapInArrow(_trim(_verify(self.percent)), "a bigint, b bigint, hit boolean"), "verified")
        return hits.where("hit").select("a", "b")

    def _near_sizes(self, x, y):
        return 100 * F.least(x, y).cast("long") >= self.percent * F.greatest(x, y).cast("long")

    def components(self) -> DataFrame:
        """(node, comp) of the classes that have links, comp the smallest node reachable."""
        if self.links is not None:
            return self.links
        rows = self._prefix_rows()
        lists = rows.groupBy("token").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("n", "node")).alias("_lead")).where("_n > 1")
        lists = common.saved(lists.select("token", "_n", F.col("_lead.node").alias("lead"), F.col("_lead.n").alias("lead_n")), "lists")
        per = max(HOT_LIST, -(-rows.count() // common.HOT_KEYS))  # so fewer than HOT_KEYS tokens are hot
        heavy = lists.where(F.col("_n") > per).select("token", F.ceil(F.col("_n") / per).cast("int").alias("salts"))
        led = common.copied(lists.drop("_n"), "token", heavy)
        met = common.saved(common.dealt(rows, "token", heavy, "node").join(led, ["token", "salt"]).drop("salt"), "shared-prefixes")
        edges = self._star(met)
        labels = graphs.components(edges)
        open_ = self._labelled(met.drop("lead", "lead_n"), labels)
        for turn in range(ROUNDS):
            more = self._verified(self._partners(open_, turn))
            if more.limit(1).count() == 0:
                break
            edges = edges.unionByName(more)
            labels = graphs.components(edges)
            open_ = self._labelled(open_.drop("comp"), labels)
        rest = self._rest(open_)
        self.links = graphs.components(edges.unionByName(rest)) if rest.limit(1).count() else labels
        return self.links

    def _star(self, met: DataFrame) -> DataFrame:
        """Links of the classes with the leader that they share most of their prefix with, in lists that it leads."""
        likely = (
            met.where((F.col("node") != F.col("lead")) & self._near_sizes(F.col("n"), F.col("lead_n")))
            .groupBy("node", "lead").agg(F.count(F.lit(1)).alias("_c"), F.max("size").alias("size"))
            .where("3 * _c >= size")
            .groupBy("node").agg(F.max(F.struct(F.col("_c"), (-F.col("lead")).alias("_l"))).alias("_best"))
        )
        return self._verified(likely.select(F.col("node").alias("a"), (-F.col("_best._l")).alias("b")))

    def _labelled(self, lists: DataFrame, labels: DataFrame) -> DataFrame:
        """Lists that hold several components, with each member's component."""
        named = lists.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        several = named.groupBy("token").agg(F.min("comp").alias("_low"), F.max("comp").alias("_high")).where("_low <> _high").select("token")
        return common.saved(named.join(several, "token"), "open-lists")

    def _partners(self, open_: DataFrame, turn: int) -> DataFrame:
        """Likely links between components: lists fall apart into groups of about GROUP by a seeded hash, and each class takes the
        BEST of its groups' members that it shares most tokens with. A group's pairs are GROUP times its members."""
        sizes = open_.groupBy("token").agg(F.count(F.lit(1)).alias("_n"))
        groups = F.pow(F.lit(2.0), F.greatest(F.lit(0.0), F.ceil(F.log2(F.col("_n") / GROUP)))).cast("long")
        dealt = open_.join(sizes, "token").withColumn("group", F.pmod(F.xxhash64("node", F.lit(turn)), groups))
        dealt = common.saved(dealt.select("token", "group", "node", "n", "size", "comp"), "groups")
        x = dealt.select("token", "group", F.col("node").alias("a"), F.col("n").alias("an"), F.col("size").alias("asize"), F.col("comp").alias("ac"))
        y = dealt.select("token", "group", F.col("node").alias("b"), F.col("n").alias("bn"), F.col("size").alias("bsize"), F.col("comp").alias("bc"))
        pairs = x.join(y, ["token", "group"]).where((F.col("ac") < F.col("bc")) & self._near_sizes(F.col("an"), F.col("bn")))
        counted = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.max(F.least("asize", "bsize")).alias("size"))
        counted = common.saved(counted.where("3 * c >= size"), "partners")
        both = counted.select(F.col("a").alias("me"), "a", "b", "c").unionByName(counted.select(F.col("b").alias("me"), "a", "b", "c"))
        best = both.withColumn("_r", F.row_number().over(W.partitionBy("me").orderBy(F.desc("c"), "a", "b"))).where(F.col("_r") <= BEST)
        return best.select("a", "b")

    def _rest(self, named: DataFrame) -> DataFrame:
        """Links between different components: short lists as pairs that share enough prefix tokens, long lists in blocks.

        A pair that shares a token of a long list is compared there; any other shares tokens of short lists alone.
        """
        sizes = named.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("_n"))
        big = sizes.groupBy("token").agg(F.max(F.struct("_n", "comp")).alias("_b"), F.sum("_n").alias("members")).select("token", F.col("_b.comp").alias("big"), "members")
        flagged = common.saved(named.join(big, "token"), "flagged-lists")
        short = flagged.where(F.col("members") <= HOT)
        x = short.where("comp <> big").select("token", F.col("node").alias("a"), F.col("n").alias("an"), F.col("need").alias("al"), F.col("size").alias("asize"), F.col("comp").alias("ac"))
        y = short.select("token", F.col("node").alias("b"), F.col("n").alias("bn"), F.col("need").alias("bl"), F.col("size").alias("bsize"), F.col("comp").alias("bc"), "big")
        apart = (F.col("ac") != F.col("bc")) & ((F.col("bc") == F.col("big")) | (F.col("a") < F.col("b")))
        pairs = x.join(y, "token").where(apart & self._near_sizes(F.col("an"), F.col("bn")))
        pairs = pairs.select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.least("al", "bl").alias("l"),
            F.greatest(F.col("an") - F.col("asize"), F.col("bn") - F.col("bsize")).alias("others"), (F.col("an") + F.col("bn")).cast("long").alias("both"),
        )
        counted = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("_c"), F.max("l").alias("l"), F.max("others").alias("others"), F.max("both").alias("both"))
        # The prefix that ends first holds all that the other has of it: the rest of either bounds what else they share.
        enough = (F.col("_c") >= F.col("l")) & ((F.col("_c") + F.col("others")) * (100 + self.percent) >= self.percent * F.col("both"))
        return self._verified(counted.where(enough)).unionByName(self._blocks(flagged.where(F.col("members") > HOT)))

    def _sets_of(self, nodes: DataFrame) -> DataFrame:
        """(node, set) of the given nodes, made again from their texts alone."""
        texts = self.docs.join(common.small(nodes), "node", "left_semi").select("node", "text")
        if self.repeats:
            texts = texts.dropDuplicates(["node"])
        return common.saved(texts.mapInArrow(_trim(_sets(self.words)), "node bigint, set binary"), "sets")

    def _blocks(self, lists: DataFrame) -> DataFrame:
        """Links within long lists. Members are dealt to blocks by hash; every two blocks meet in one group of at most about
        2 * BLOCK sets, which gives back a spanning forest of its links, never its pairs."""
        wanted = common.saved(lists.select("node").distinct(), "wanted")
        if wanted.limit(1).count() == 0:
            return wanted.select(F.col("node").alias("a"), F.col("node").alias("b"))
        count = F.ceil(F.col("members") / BLOCK).cast("int")
        mine = F.pmod(F.xxhash64("node"), count).cast("int")
        placed = lists.select("token", "node", "comp", "n", mine.alias("mine"), F.explode(F.sequence(F.lit(0), count - 1)).alias("other"))
        placed = placed.select("token", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node", "comp")
        rows = placed.join(self._sets_of(wanted), "node")
        found = rows.groupBy("token", "i", "j").applyInArrow(_block_links(self.percent), "a bigint, b bigint")
        return common.saved(found.distinct(), "block-links")

    def labelled(self) -> DataFrame:
        """One row a document: node, key, n, rep (its class) and least (smallest key of its component; its own without links)."""
        links = self.components()
        named = self.classes.join(links, F.col("rep") == F.col("node"), "left").select("set_key", "rep", "least", F.coalesce("comp", "rep").alias("comp"))
        least = named.groupBy("comp").agg(F.min("least").alias("component_least"))
        classes = common.saved(named.join(least, "comp").select("set_key", "rep", "comp", "component_least"), "class-components")
        return self.rows.join(classes, "set_key", "left")


def join(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles and component_id of every document."""
    with common.Scratch(docs.sparkSession) as scratch:
        found = Join(docs, words, percent, key, text).labelled()
        found = found.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_least", "key").alias("component_id"))
        out = common.saved(found, "document-components")
        scratch.keep(out)
        return out


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each component, the one with the smallest node; documents without words all stay."""
    with common.Scratch(docs.sparkSession) as scratch:
        made = Join(docs, words, percent, key, text)
        drop = common.saved(made.labelled().where("comp IS NOT NULL AND node <> comp").select("node").distinct(), "dropped")
        rows, again = with_nodes(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(key).cast("long").alias("key"), F.col(text).alias("text")))
        kept = rows.join(common.small(drop), "node", "left_anti")
        if made.repeats:  # rows that repeat key and text are one node
            kept = kept.where("node >= 0").unionByName(kept.where("node < 0").dropDuplicates(["node"]))
        scratch.keep(drop, again)
        return kept.select("row.*")


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return join(common.table(spark, sf_dir, "documents"), 3, 90)
