"""Raw text records, all strings, to parsed rows; what is left out is counted by its reason.

Every record gets one reason at most, the first that holds: a stamp that breaks the pattern, a host outside the domains,
an empty text, a day outside the window, a text without words. Null stamps, hosts and texts count under these reasons.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.functions import text as T

#: The raw columns by their role, and the only form of a stamp that is taken.
COLUMNS = {"stamp": "Date", "text": "Article_title", "tickers": "Stock_symbol", "url": "Url"}
STAMP = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2} UTC$"
REASONS = ("bad_stamp", "wrong_host", "empty_text", "out_of_window", "no_words")


def scan(spark: SparkSession, path: str, columns: dict[str, str] = COLUMNS) -> DataFrame:
    """The roles' columns of a CSV file (quoted line breaks allowed, so a file is one split: deal large dumps over many
    files) or of Parquet, by suffix. A column the file lacks is an error, but for tickers and url, which are then null."""
    if path.rstrip("/").endswith((".parquet", ".pq")):
        raw = spark.read.parquet(path)
    else:
        raw = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    lacking = [c for role, c in columns.items() if role in ("stamp", "text") and c not in raw.columns]
    if lacking:
        raise ValueError(f"{path} lacks {', '.join(lacking)}")
    own = [(F.col(f"`{c}`") if c in raw.columns else F.lit(None)).cast("string").alias(role) for role, c in columns.items()]
    return raw.select(*own)


def flagged(raw: DataFrame, domains: list[str] = (), start: str | None = None, end: str | None = None) -> DataFrame:
    """raw(stamp, text, tickers, url, ...) with ts, host, text_norm and reason (null for rows that stay); end's whole day is in."""
    out = raw.withColumns({
        "ts": F.when(F.col("stamp").rlike(STAMP), F.try_to_timestamp(F.regexp_replace("stamp", " UTC$", ""))),
        "host": T.host(F.col("url")), "text": F.trim("text"),
    }).withColumn("text_norm", T.normalized(F.col("text")))
    outside = F.lit(False)
    if start is not None:
        outside = outside | (F.col("ts") < F.lit(start).cast("date"))
    if end is not None:
        outside = outside | (F.col("ts") >= F.date_add(F.lit(end).cast("date"), 1))
    tests = [F.col("ts").isNull(), ~T.host_matches(F.col("host"), domains) if domains else F.lit(False), F.coalesce(F.col("text") == "", F.lit(True)), outside, F.col("text_norm") == ""]
    reason = F.lit(None).cast("string")
    for name, test in reversed([*zip(REASONS, tests, strict=True)]):
        reason = F.when(test, name).otherwise(reason)
    return out.withColumn("reason", reason)


def bad_stamps(rows: DataFrame, k: int = 3) -> DataFrame:
    """The k smallest stamps that break the pattern, with their number."""
    return rows.where("reason = 'bad_stamp' AND stamp IS NOT NULL").groupBy("stamp").agg(F.count(F.lit(1)).alias("n")).orderBy("stamp").limit(k)


def counters(rows: DataFrame) -> DataFrame:
    """(reason, n) of flagged rows; kept for those that stay."""
    return rows.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def parsed(rows: DataFrame) -> DataFrame:
    """The rows that stay, with their identity and tickers (split at commas, trimmed, upper case, blanks dropped)."""
    tickers = F.filter(F.transform(F.split(F.coalesce("tickers", F.lit("")), ","), lambda t: F.upper(F.trim(t))), lambda t: t != "")
    return rows.where("reason IS NULL").withColumns({"tickers": tickers, "headline_id": T.identity(F.col("text_norm"), F.col("ts"))}).drop("reason", "stamp", "url")


def load(spark: SparkSession, path: str, domains: list[str] = (), start: str | None = None, end: str | None = None, zone: str = "America/New_York") -> DataFrame:
    """The rows that stay, in time order: source_row_id counts them from 0 by stamp and then by the hash of the record, and ts_et is the market's clock."""
    from tidepanel.operators import dedup

    rows = parsed(flagged(scan(spark, path), domains, start, end))
    rows = rows.withColumn("_tie", F.md5(F.concat_ws("|", "headline_id", "host", F.array_join("tickers", ","))))
    return dedup.numbered(rows, "ts", "_tie").drop("_tie").withColumn("ts_et", F.from_utc_timestamp(F.col("ts").cast("timestamp"), zone))


def lenient(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Some columns of a CSV slice; records that break its form are left out."""
    head = spark.read.option("header", True).csv(path).schema
    return spark.read.schema(head).option("header", True).option("multiLine", True).option("escape", '"').option("mode", "DROPMALFORMED").csv(path).select(*[F.col(f"`{c}`") for c in columns])
