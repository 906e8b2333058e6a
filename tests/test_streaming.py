"""Streams against their batch counterparts, file by file, with a stop between."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidepanel import streaming
from tidepanel.operators import dedup, sessions
from tidepanel.sources import news


def test_ingest_resumes_and_counts_as_the_batch(spark, tmp_path):
    rows = [(f"2024-01-{1 + k % 28:02} 10:00:00 UTC" if k % 5 else "bad", f"Text {k}", "a", "https://example.com/x" if k % 3 else None) for k in range(90)]
    kind = "stamp string, text string, tickers string, url string"
    for part in range(3):
        spark.createDataFrame(rows[part::3], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        raw = streaming.files(spark, f"{tmp_path}/in", kind, per_batch=1)
        streaming.ingest(raw, f"{tmp_path}/out", f"{tmp_path}/check", ["example.com"], "2024-01-03")
    whole = news.flagged(spark.createDataFrame(rows, kind), ["example.com"], "2024-01-03")
    want = {r["reason"]: r["n"] for r in news.counters(whole).collect()}
    assert {r["reason"]: r["n"] for r in streaming.counters(spark, f"{tmp_path}/out").collect()} == want
    assert spark.read.parquet(f"{tmp_path}/out/rows").count() == want["kept"]


def test_first_sightings_in_time_order_are_the_batch_s(spark, tmp_path):
    r = random.Random(2)
    rows = sorted((dt.datetime(2024, 1, 1) + dt.timedelta(hours=r.randint(0, 24 * 20)), r.choice("abc")) for _ in range(120))
    rows = [(k, ts, t) for k, (ts, t) in enumerate(rows)]
    kind = "id long, ts timestamp, text_norm string"
    for low in range(0, 120, 30):
        spark.createDataFrame(rows[low : low + 30], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = streaming.first_seen(streaming.files(spark, f"{tmp_path}/in", kind, per_batch=1))
        streaming.finished(stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check"))
    batch = dedup.exact(spark.createDataFrame(rows, kind).withColumn("ts", F.col("ts").cast("timestamp_ntz")))
    want = {x["id"]: (x["anchor"], x["kept"]) for x in batch.collect()}
    assert {x["id"]: (x["anchor"], x["kept"]) for x in spark.read.parquet(f"{tmp_path}/out").collect()} == want


def test_daily_totals_and_late_events(spark, tmp_path):
    days = sessions.calendar(spark, "2024-01-01", "2024-03-29")
    kind = "ts timestamp_ntz, score double"
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(hours=7 * k), float(k % 9)) for k in range(250)]
    for low in (0, 100, 200):
        spark.createDataFrame(rows[low : low + 100], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        streaming.totals(streaming.files(spark, f"{tmp_path}/in", kind, per_batch=1), days, "ts", F.col("score"), f"{tmp_path}/out", f"{tmp_path}/check")
    batch = sessions.daily(sessions.map_dates(spark.createDataFrame(rows, kind), days, "ts"), days, F.col("score")).where("n > 0")
    want = {str(x["session"]): (x["n"], round(x["s"], 9)) for x in batch.collect()}
    assert {str(x["session"]): (x["n"], round(x["s"], 9)) for x in streaming.latest(spark, f"{tmp_path}/out").collect()} == want
    # Appended once the watermark is past a session; an event far behind is left out.
    spark.createDataFrame([(dt.datetime(2024, 1, 3), 100.0)], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    told = streaming.daily(streaming.files(spark, f"{tmp_path}/in", kind, per_batch=1), days, "ts", F.col("score"), "10 days")
    streaming.finished(told.writeStream.format("parquet").option("path", f"{tmp_path}/told").option("checkpointLocation", f"{tmp_path}/check2"))
    got = {str(x["session"]): (x["n"], round(x["s"], 9)) for x in spark.read.parquet(f"{tmp_path}/told").collect()}
    assert len(got) > 20 and all(want[s] == v for s, v in got.items())
