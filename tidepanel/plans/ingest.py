"""Queries of the ingest and of the bootstrap over groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.operators import inference, stats
from tidepanel.plans import queries as Q
from tidepanel.plans.registry import query
from tidepanel.sources import news

#: Pages as raw records: the stamp is made from the identifier, and some are no dates.
RAW_SQL = """raw AS (SELECT *, CASE page_id % 7 WHEN 0 THEN 'n/a' WHEN 1 THEN '2024-01-02' WHEN 2 THEN '2024-01-02 UTC' WHEN 3 THEN '2024-01-02 00:00:00' ELSE '2024-01-' || lpad((1 + page_id % 31)::VARCHAR, 2, '0') || ' 10:00:00 UTC' END AS stamp FROM pages)"""
FLAGGED_SQL = rf"""{RAW_SQL}, hosts AS (SELECT page_id, stamp, 1 + page_id % 31 AS day, {Q.HOST_SQL} AS host FROM raw),
flagged AS (SELECT page_id, CASE WHEN NOT regexp_full_match(stamp, '\d{{4}}-\d{{2}}-\d{{2}} \d{{2}}:\d{{2}}:\d{{2}} UTC') THEN 'bad_stamp' WHEN host IS NULL OR NOT (host IN ('example.com', 'example.net') OR host LIKE '%.example.com' OR host LIKE '%.example.net') THEN 'wrong_host'
  WHEN day > 20 THEN 'out_of_window' END AS reason, day FROM hosts)"""


def raw_pages(spark, sf_dir):
    day = F.lpad((1 + F.col("page_id") % 31).cast("string"), 2, "0")
    odd = F.col("page_id") % 7
    stamp = F.when(odd == 0, "n/a").when(odd == 1, "2024-01-02").when(odd == 2, "2024-01-02 UTC").when(odd == 3, "2024-01-02 00:00:00").otherwise(F.concat(F.lit("2024-01-"), day, F.lit(" 10:00:00 UTC")))
    raw = Q.read(spark, sf_dir, "pages").select("page_id", stamp.alias("stamp"), F.col("url").alias("text"), F.lit("a, b,,").alias("tickers"), "url")
    return news.flagged(raw, Q.DOMAINS, "2024-01-01", "2024-01-20")


@query("ingest_counters", f"WITH {FLAGGED_SQL} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM flagged GROUP BY 1")
def ingest_counters(spark, sf_dir):
    return news.counters(raw_pages(spark, sf_dir))


@query("ingest_rows", f"WITH {FLAGGED_SQL} SELECT page_id, '2024-01-' || lpad(day::VARCHAR, 2, '0') AS day, 'A|B' AS tickers FROM flagged WHERE reason IS NULL")
def ingest_rows(spark, sf_dir):
    return news.parsed(raw_pages(spark, sf_dir)).select("page_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.array_join("tickers", "|").alias("tickers"))


@query("bad_stamps", f"WITH {RAW_SQL} SELECT stamp, count(*) AS n FROM raw WHERE page_id % 7 < 4 GROUP BY 1 ORDER BY 1 LIMIT 3")
def bad_stamps(spark, sf_dir):
    return news.bad_stamps(raw_pages(spark, sf_dir))


@query("group_bootstrap")
def group_bootstrap(spark, sf_dir):
    """10,000 draws of whole groups (stand-ins: the identifier modulo 50), three classes; the interval of either difference."""
    from tidepanel.plans import corpus

    rows = corpus.truths(spark, sf_dir).select("truth", stats.banded(F.col("score"), -0.1, 0.1).alias("first"), F.col("other").alias("second"), (F.col("doc_id") % 50).alias("g"))
    drawn = inference.group_bootstrap(rows, "truth", "first", "second", "g", [-1, 0, 1])
    ends = lambda c: [F.max(F.when(F.col("draw") < 0, F.col(c))).alias(c), *[F.expr(f"percentile(CASE WHEN draw >= 0 THEN {c} END, {q})").alias(f"{c}_{n}") for n, q in (("low", 0.025), ("high", 0.975))]]
    return drawn.agg(*ends("difference"), *ends("accuracy"))
