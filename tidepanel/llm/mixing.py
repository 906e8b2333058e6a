"""Mixing sources to target weights by capped water-filling.

Every source has a weight and a size (words). Targets share the mix by weight; a source whose target would
exceed ``max_epochs`` times its size is clamped there and the excess is shared again by weight until no source
is above its cap. A target of r sizes takes each document floor(r) times whole; the fractional repetition takes
documents in the order of a seeded hash until the rest of the target is met.

The fractional pass never orders a source's documents: their hashes fall into ``BUCKETS`` buckets, sizes are
summed by (source, bucket), and a source takes all buckets below its cutoff (whichever cutoff lies nearest the
target). So a source that holds a third of all rows costs as many rows as buckets, and what is joined back is
one row a source. Running sums over sources are made by ranges of their order, so sources are never all in one task either.

Defined cases: null text has size 0 and is taken 0 times its words; a null source is a source of its own, last
in order; rows that repeat entirely fall into one bucket and share their fate; an empty table gives no rows; sources of
size 0 get target 0. Other columns pass through untouched, whatever their names: the struct that ``mix`` adds is called
``mix_``, with more underscores if docs has such a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepanel.llm import common

#: Hash buckets a source's documents fall into for the fractional repetition.
BUCKETS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running(rows: DataFrame, order: list[Column], sums: list[str]) -> DataFrame:
    """rows with n_before (rows before, in the order) and <c>_before (their sum) of some columns: ranges of the order are summed each in a task of its own,
    and only a row a range meets in one place. The order has to be total."""
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = common.saved(rows.repartitionByRange(ranges, *order).withColumn("_part", F.spark_partition_id()), "mix-ranges")
    parts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in sums])
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    base = parts.select(F.col("_part"), *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}_base") for c in ("n", *sums)])
    inside = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    own = placed.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_{c}_own") for c in sums], (F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1).alias("_n_own"))
    out = own.join(F.broadcast(base), "_part")
    return out.select(*rows.columns, *[(F.col(f"_{c}_base") + F.col(f"_{c}_own")).alias(f"{c}_before") for c in ("n", *sums)])


def water_fill(sources: DataFrame, budget: float, max_epochs: float) -> DataFrame:
    """sources(source, weight, source_size) with target. One row a source.

    Sorted by cap over weight, the clamped sources are a prefix: a source is clamped when its fair share, of what the
    sources before it have left, reaches its cap. This is the fixed point of clamping and resharing.
    """
    capped = sources.withColumn("_cap", F.col("source_size") * F.lit(float(max_epochs)))
    weights = capped.agg(F.sum("weight")).first()[0] or 0.0
    summed = running(capped, [F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last()], ["_cap", "weight"])
    level = (F.lit(float(budget)) - F.col("_cap_before")) / (F.lit(float(weights)) - F.col("weight_before"))
    shares = common.saved(summed.withColumn("_level", level).withColumn("_clamped", F.col("_level") * F.col("weight") >= F.col("_cap")), "mix-levels")
    all_ = shares.agg(F.max(F.when(~F.col("_clamped"), F.col("_level")))).first()[0]
    open_ = F.lit(None).cast("double") if all_ is None else F.lit(float(all_)) * F.col("weight")
    return shares.select(*sources.columns, F.when(F.col("_clamped"), F.col("_cap")).otherwise(open_).alias("target"))


def cycle_weights(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Weights in the order of the sources' code points, null last, repeating."""
    values = F.array(*[F.lit(float(w)) for w in weights])
    ranked = running(sources, [F.col("source").asc_nulls_last()], [])
    return ranked.select(*sources.columns, F.element_at(values, (F.col("n_before") % len(weights) + 1).cast("int")).alias("weight"))


def plan(thin: DataFrame, weights, share: float, max_epochs: float) -> DataFrame:
    """One row a source: source, source_size, target, _whole, _cut (buckets below it repeat once more).

    thin has source, size and bucket of every document.
    """
    buckets = common.saved(thin.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "mix-buckets")
    sources = buckets.groupBy("source").agg(F.sum("words").alias("source_size"))
    total = buckets.agg(F.sum("words")).first()[0] or 0
    filled = water_fill(cycle_weights(sources, weights), total * share, max_epochs).drop("weight")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    filled = filled.withColumn("_whole", F.floor(ratio)).withColumn("_need", F.col("target") - F.col("_whole") * F.col("source_size"))
    running = W.partitionBy("source").orderBy("bucket")
    sums = (
        buckets.join(filled.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
        .drop("_source")
        .withColumn("_upto", F.sum("words").over(running))
    )
    # A bucket is in when more than half of it lies below what is needed.
    inside = F.col("_upto") - F.col("words") / 2 < F.col("_need")
    cuts = sums.groupBy("source").agg(
        F.max("source_size").alias("source_size"),
        F.max("target").alias("target"),
        F.max("_whole").alias("_whole"),
        F.coalesce(F.max(F.when(inside, F.col("bucket"))), F.lit(-1)).alias("_cut"),
    )
    return common.saved(cuts, "mix-sources")


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 17,
    source: str = "source",
    text: str = "text",
    key: str = "doc_id",
) -> DataFrame:
    """docs with the struct column mix_: size, source_size, target, times (how often the mix takes the document)."""
    mixed = _mixed(docs, weights, share, max_epochs, seed, source, text, key)
    return mixed.select("row.*", F.col("mix").alias(common.free_name("mix_", docs.columns)))


def _mixed(docs: DataFrame, weights, share: float, max_epochs: float, seed: int, source: str, text: str, key: str) -> DataFrame:
    """row (all of docs' columns) and mix."""
    bucket = common.md5_unit(F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit(""))) % BUCKETS
    sized = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(source).alias("source"),
        word_count(F.col(text)).alias("size"), bucket.cast("int").alias("bucket"),
    )
    with common.Scratch(docs.sparkSession) as scratch:
        cuts = plan(sized.select("source", "size", "bucket"), weights, share, max_epochs)
        scratch.keep(cuts)
    joined = sized.join(common.small(cuts.withColumnRenamed("source", "_source")), F.col("source").eqNullSafe(F.col("_source")), "left")
    times = F.col("_whole") + (F.col("bucket") <= F.col("_cut")).cast("long")
    return joined.select("row", F.struct("size", "source_size", "target", times.cast("long").alias("times")).alias("mix"))


def repeated(
    docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: int = 17,
    source: str = "source", text: str = "text", key: str = "doc_id",
) -> DataFrame:
    """The mix itself: each document as many times as it is taken, in docs' own columns."""
    mixed = _mixed(docs, weights, share, max_epochs, seed, source, text, key)
    return mixed.select("row", F.explode(F.array_repeat(F.lit(0), F.col("mix.times").cast("int")))).select("row.*")


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    mixed = mix(common.table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select(
        "doc_id", "mix_.size", "mix_.source_size", "mix_.target",
        (F.col("mix_.size") * F.col("mix_.times")).alias("taken"),
    )


#: The targets by recursion over clamped sources: sort by cap over weight, as fractions of the same integers.
OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % 4096)::INT AS bucket
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0 ELSE 2.0 END AS weight
  FROM d GROUP BY source),
c AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM s),
l AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM c),
t AS (
  SELECT source, source_size, CASE WHEN level * weight >= cap THEN cap
         ELSE weight * max(CASE WHEN level * weight < cap THEN level END) OVER () END AS target
  FROM l),
n AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
b AS (
  SELECT source, bucket, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY source ORDER BY bucket) AS upto
  FROM d GROUP BY source, bucket),
k AS (
  SELECT n.source, any_value(source_size) AS source_size, any_value(target) AS target, any_value(whole) AS whole,
         coalesce(max(CASE WHEN upto - words / 2.0 < target - whole * source_size THEN bucket END), -1) AS cut
  FROM n JOIN b ON n.source IS NOT DISTINCT FROM b.source GROUP BY n.source)
SELECT d.doc_id, d.size, k.source_size, k.target,
       (d.size * (k.whole + CASE WHEN d.bucket <= k.cut THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source
"""
