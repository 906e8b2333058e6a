"""Helpers that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.operators.work import Scratch, fresh_path, saved, shared_dir  # noqa: F401

#: Bytes of rows that a broadcast may hold; larger sides take a shuffled join.
BROADCAST_BYTES = 64 << 20
#: Bytes of text that a sample may bring to the driver, and of any one text in it.
SAMPLE_BYTES, SAMPLE_TEXT = 64 << 20, 4 << 20
#: Rows of a key from which on a join deals it over salts, and keys that can have so many at all.
HOT_ROWS, HOT_KEYS = 20_000, 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(name: str, taken: list[str]) -> str:
    """name, with more underscores as long as a column is called so."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2; a null id is no held-out row."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df (already saved), marked for broadcast only if its bytes are counted and few; else Spark shuffles."""
    fixed = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    loose = [F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, fixed)]
    size = F.count(F.lit(1)) * 8 * len(df.columns)
    if loose:
        size = size + F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*[c.cast("string") if isinstance(f.dataType, T.BinaryType) else c for c, f in zip(
            loose, [f for f in df.schema.fields if not isinstance(f.dataType, fixed)], strict=True)])))), F.lit(0))
    return F.broadcast(df) if df.agg(size.alias("bytes")).first()[0] <= most else df


def salts(rows: DataFrame, key: str, hot: int = HOT_ROWS) -> DataFrame:
    """(key, salts) of the keys that more than ``hot`` of the (saved) rows have, or more than one in ``HOT_KEYS`` of all.

    There are fewer than ``HOT_KEYS`` of them at any size, so they may be broadcast.
    """
    per = max(hot, -(-rows.count() // HOT_KEYS))
    return saved(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > per).select(key, F.ceil(F.col("_n") / per).cast("int").alias("salts")), "hot-keys")


def dealt(rows: DataFrame, key: str, heavy: DataFrame, by: str) -> DataFrame:
    """rows with salt: rows of a hot key fall on its salts by the hash of another column."""
    return rows.join(F.broadcast(heavy), key, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(by), F.col("salts")).cast("int"), F.lit(0))).drop("salts")


def copied(rows: DataFrame, key: str, heavy: DataFrame) -> DataFrame:
    """rows with salt, one copy for each salt of its key."""
    each = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts"), F.lit(1)) - 1))
    return rows.join(F.broadcast(heavy), key, "left").withColumn("salt", each).drop("salts")


def salted_join(rows: DataFrame, other: DataFrame, key: str, by: str, hot: int = HOT_ROWS) -> DataFrame:
    """(Saved) rows joined with other, which has a row a key; no task gets all rows of a hot key."""
    heavy = salts(rows, key, hot)
    return dealt(rows, key, heavy, by).join(copied(other, key, heavy), [key, "salt"]).drop("salt")


def md5_unit(*cols: Column) -> Column:
    """A number in [0, 2^32) that any engine with md5 can make from the same columns."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 8), 16, 10).cast("long")


def hashed_sample(rows: DataFrame, most: int, by: str, text: str = "text", bytes_: int = SAMPLE_BYTES) -> dict:
    """For each value of ``by``: its rows with distinct texts, ``most`` of least hash or all if there are fewer.

    All values together bring at most about ``bytes_`` of text; texts over ``SAMPLE_TEXT`` bytes are not sampled. Distinct hashes are counted first,
    so copies don't thin the sample. A bound on the hash then leaves about 1.25 times what a value may have, so tasks send
    the driver no more than that together; values left short are read again with a wider one.
    """
    size = F.coalesce(F.octet_length(text), F.lit(0))
    hashed = rows.where(size <= SAMPLE_TEXT).select(by, text, F.xxhash64(text).alias("_hash"))
    distinct = {
        r[by]: (r["n"], r["size"])
        for r in hashed.groupBy(by, "_hash").agg(F.max(size).alias("size")).groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).collect()
    }
    own = bytes_ / max(1, len(distinct))
    share = {v: 1.25 * min(most / n, own / max(1, size)) for v, (n, size) in distinct.items()}
    got, open_ = {}, sorted(distinct)
    kind = T.StructType([T.StructField(by, rows.schema[by].dataType), T.StructField("_bound", T.LongType())])
    while open_:
        bounds = [(v, int(-(2**63) + share[v] * (2**64 - 1)) if share[v] < 1 else 2**63 - 1) for v in open_]
        low = hashed.join(F.broadcast(rows.sparkSession.createDataFrame(bounds, kind)), by).where("_hash <= _bound").select(by, text, "_hash").distinct()
        found: dict = {v: [] for v in open_}
        for r in low.collect():
            found[r[by]].append(r)
        short = []
        for v, some in found.items():
            left, got[v] = own, []
            for r in sorted(some, key=lambda r: (r["_hash"], (r[text] or "").encode())):
                left -= len((r[text] or "").encode())
                if len(got[v]) == most or left < 0 and got[v]:
                    break
                got[v].append(r)
            else:
                if share[v] < 1:
                    short.append(v)
        open_ = short
        share.update({v: 4 * share[v] for v in open_})
    return got


def trimmed(batches):
    """The same batches; when they end, freed memory goes back to the system, for workers live on."""
    import ctypes

    import pyarrow as pa

    yield from batches
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batches, rows: int = 500):
    """The batches, at most so many rows at a time."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def sparing(run):
    """A batch function that sees few rows at a time and gives memory back at the end of its task."""
    return lambda batches: trimmed(run(slices(batches)))
