"""Tables written on the way, in the folder that driver and executors share, and connected components over them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A session on one machine that names none gets one of its own; a cluster's is refused."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    now = spark.sparkContext._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get().rstrip("/")
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
    own = tempfile.mkdtemp(prefix="tidepanel-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


class Scratch:
    """Tables written inside a ``with`` are deleted at its end, but for those that what is returned still reads (``keep``).

    Scopes nest: what an inner one keeps belongs to the outer one. Tables kept by the outermost, and those written outside of
    any, stay in the shared folder.
    """

    open: list[Scratch] = []

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        Scratch.open.append(self)
        return self

    def keep(self, *tables: DataFrame) -> None:
        for df in tables:
            path = getattr(df, "_written", None)
            if path in self.paths:
                self.paths.remove(path)
                if len(Scratch.open) > 1:
                    Scratch.open[-2].paths.append(path)

    def drop(self, df: DataFrame) -> None:
        """Delete one table now."""
        if (path := getattr(df, "_written", None)) in self.paths:
            self.paths.remove(path)
            self._delete(path)

    def _delete(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def __exit__(self, *error) -> None:
        Scratch.open.pop()
        for path in self.paths:
            self._delete(path)


def saved(df: DataFrame, what: str = "saved") -> DataFrame:
    """Cut the lineage by a written table in the shared folder; lost executors can't lose it."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    # What was shuffled for a written table isn't needed once it is written; batches of long texts stay small.
    own = {CLEANUP: "true", BATCH_BYTES: str(2 << 20)}
    was = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    if Scratch.open:
        Scratch.open[-1].paths.append(path)
    return out


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """edges(a, b) to (node, comp), comp the smallest node reachable; nodes without an edge are absent.

    Every round a node takes the least label of its neighbours and then its label's label, so rounds are as many as the logarithm of the longest path.
    """
    with Scratch(edges.sparkSession) as scratch:
        both = saved(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
        labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("comp")), "labels")
        for _ in range(most_rounds):
            near = both.join(labels.select(F.col("node").alias("a"), "comp"), "a").groupBy(F.col("b").alias("node")).agg(F.min("comp").alias("near"))
            step = labels.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
            jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
            new = saved(step.join(jump, "comp", "left").select("node", "was", F.least("comp", F.coalesce("further", "comp")).alias("comp")), "labels")
            scratch.drop(labels)
            done = new.where(F.col("was") != F.col("comp")).limit(1).count() == 0
            labels = new.select("node", "comp")
            labels._written = new._written
            if done:
                scratch.keep(labels)
                return labels
    raise RuntimeError(f"labels still changed after {most_rounds} rounds")
