"""Streams: records into parsed rows with counters, first sightings of texts, sessions and their daily aggregates.

Every stream runs to the end of what is there and resumes from its checkpoint; results are written a batch at a time, so a batch that runs again replaces itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidepanel.operators import sessions
from tidepanel.sources import news


def files(spark: SparkSession, folder: str, schema: str, name: str = "*.parquet", per_batch: int = 1000) -> DataFrame:
    """Parquet files of a folder, as they come."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", per_batch).parquet(folder)


def finished(writer) -> None:
    """Run a stream over all there is."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def ingest(raw: DataFrame, out: str, checkpoint: str, domains: list[str] = (), start: str | None = None, end: str | None = None) -> None:
    """raw(stamp, text, tickers, url) to out/rows and out/counters, a folder a batch each."""

    def batch(df: DataFrame, number: int) -> None:
        flagged = news.flagged(df, domains, start, end).persist()
        news.parsed(flagged).write.mode("overwrite").parquet(f"{out}/rows/batch={number}")
        news.counters(flagged).write.mode("overwrite").parquet(f"{out}/counters/batch={number}")
        flagged.unpersist()

    finished(raw.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint))


def counters(spark: SparkSession, out: str) -> DataFrame:
    """Running counts over all batches."""
    return spark.read.parquet(f"{out}/counters").groupBy("reason").agg(F.sum("n").alias("n"))


def first_seen(rows: DataFrame, days: int = 3, late: str = "1 day") -> DataFrame:
    """rows(id, ts, text_norm) to (id, ts, kept, anchor): a row is kept if its text has no kept row in the ``days`` up to it.

    A text's state is its last kept row, and is forgotten once the watermark is ``days`` past it. Rows that come in time order get what
    the batch operator gives; a row behind its text's anchor is dropped to it.
    """

    def step(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        anchor, since = state.get if state.exists else (None, None)
        frame = pd.concat(list(parts)).sort_values(["ts", "id"], kind="stable")  # a batch's rows of one text
        out = []
        for i, ts in zip(frame["id"], frame["ts"], strict=True):
            if since is None or ts > since + pd.Timedelta(days=days):
                anchor, since = int(i), ts
            out.append((int(i), ts, int(i) == anchor, anchor))
        state.update((anchor, since))
        state.setTimeoutTimestamp(max(int(since.timestamp() * 1000) + days * 86_400_000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["id", "ts", "kept", "anchor"])

    own = rows.select(F.md5(F.col("text_norm").cast("binary")).alias("hash"), "id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    return own.groupBy("hash").applyInPandasWithState(
        step, "id long, ts timestamp, kept boolean, anchor long", "anchor long, since timestamp", "append", GroupStateTimeout.EventTimeTimeout
    )


def daily(events: DataFrame, days: DataFrame, ts: str, score: Column, late: str = "10 days", defer: bool = True) -> DataFrame:
    """(session, n, s) by a stream-static join with the calendar. Events on days that map to no session are left out, as are those that come
    more than ``late`` behind; a session is told once the watermark is past it."""
    mapped = sessions.map_dates(events, days, ts, defer).where("session IS NOT NULL").withColumn("at", F.col("session").cast("timestamp"))
    by = mapped.withWatermark("at", late).groupBy(F.window("at", "1 day"), "session")
    return by.agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("s")).select("session", "n", "s")


def totals(events: DataFrame, days: DataFrame, ts: str, score: Column, out: str, checkpoint: str, defer: bool = True) -> None:
    """Running daily aggregates: every batch writes the sessions that it changed; ``latest`` gives the last state of each."""
    mapped = sessions.map_dates(events, days, ts, defer).where("session IS NOT NULL")
    by = mapped.groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("s"))  # as many states as sessions

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={number}")

    finished(by.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint))


def latest(spark: SparkSession, out: str) -> DataFrame:
    rows = spark.read.parquet(out)
    return rows.groupBy("session").agg(F.max_by(F.struct("n", "s"), "batch").alias("r")).select("session", "r.*")
