"""Profiles of a corpus by source, hour, year and tag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepanel.functions import text as T

#: Thresholds of the verdicts: share of one minute, minutes a feed has at least, share of texts in another script.
DATE_ONLY_SHARE, LEAST_MINUTES, SCRIPT_SHARE = 0.5, 60, 0.05
OPEN, CLOSE, MARKET_ZONE = 9 * 60 + 30, 16 * 60, "America/New_York"


def source_profile(rows: DataFrame, source: str, ts: str) -> DataFrame:
    """One row a source: rows, midnight share, modal minute (smallest of the most frequent), its share, minutes, first, last."""
    minute = F.hour(ts) * 60 + F.minute(ts)
    by = rows.groupBy(F.col(source).alias("source"), minute.alias("minute")).agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.date_trunc("day", ts) == F.col(ts).cast("timestamp")).cast("int")).alias("midnight"), F.min(ts).alias("first"), F.max(ts).alias("last")
    )
    return by.groupBy("source").agg(
        F.sum("n").alias("rows"), (F.sum("midnight") / F.sum("n")).alias("midnight_share"),
        F.max(F.struct("n", (-F.col("minute")).alias("m"))).alias("_mode"), F.count(F.lit(1)).alias("minutes"),
        F.min("first").alias("first_ts"), F.max("last").alias("last_ts"),
    ).select("source", "rows", "midnight_share", (-F.col("_mode.m")).alias("modal_minute"), (F.col("_mode.n") / F.col("rows")).alias("modal_share"), "minutes", "first_ts", "last_ts")


def hour_histogram(spark: SparkSession, rows: DataFrame, ts: str) -> DataFrame:
    hours = spark.range(24).select(F.col("id").cast("int").alias("hour"))
    counts = rows.groupBy(F.hour(ts).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return hours.join(F.broadcast(counts), "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"))


def share_by_year(rows: DataFrame, ts: str, flag: Column, by: str, values: list[str]) -> DataFrame:
    """Year by value pivot of a flag's mean."""
    return rows.groupBy(F.year(ts).alias("year")).pivot(by, values).agg(F.avg(flag.cast("double")))


def concentration(tags: DataFrame, tag: str) -> DataFrame:
    """Tags, share of the top 10, 50 and 100, sum of squared shares and its inverse. Ranks are those of the 100 most frequent alone."""
    counts = tags.groupBy(tag).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.count(F.lit(1)).alias("tags"), F.sum("n").alias("all"), F.sum(F.col("n").cast("double") * F.col("n")).alias("square"))
    most = counts.orderBy(F.desc("n"), tag).limit(100).withColumn("r", F.row_number().over(W.orderBy(F.desc("n"), tag)))
    sums = most.agg(*[F.sum(F.when(F.col("r") <= k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in (10, 50, 100)])
    all_ = F.col("all").cast("double")
    return whole.join(F.broadcast(sums)).select("tags", *[(F.col(f"n{k}") / all_).alias(f"top{k}") for k in (10, 50, 100)], (F.col("square") / (all_ * all_)).alias("hhi"), (all_ * all_ / F.col("square")).alias("effective"))


def stability(day: DataFrame) -> DataFrame:
    """day(session, n) by year: sessions, events, mean, median, shares without and with under 5, ratio to the median of medians."""
    by = day.groupBy(F.year("session").alias("year")).agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("events"), F.avg("n").alias("mean"), F.median("n").alias("median"),
        F.avg((F.col("n") == 0).cast("double")).alias("zero_share"), F.avg((F.col("n") < 5).cast("double")).alias("thin_share"),
    )
    middle = by.agg(F.median("median").alias("_m"))
    return by.join(F.broadcast(middle)).withColumn("ratio", F.col("median") / F.col("_m")).drop("_m")


def longest_run(years: DataFrame, ok: Column) -> DataFrame:
    """Longest run of consecutive qualifying years; of equals, the latest."""
    good = years.where(ok).select("year", (F.col("year") - F.row_number().over(W.orderBy("year"))).alias("island"))
    runs = good.groupBy("island").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count(F.lit(1)).alias("years"))
    return runs.orderBy(F.desc("years"), F.desc("last_year")).limit(1).drop("island")


def coverage(day: DataFrame) -> DataFrame:
    return day.agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("events"), F.avg("n").alias("mean"), F.median("n").alias("median"),
        F.avg((F.col("n") == 0).cast("double")).alias("zero_share"), F.avg((F.col("n") < 5).cast("double")).alias("thin_share"),
    )


def repeated_texts(rows: DataFrame, text: str, k: int = 10) -> DataFrame:
    """The k texts that repeat most, ties by text."""
    return rows.groupBy(text).agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), text).limit(k)


def evidence(rows: DataFrame, source: str = "source", ts: str = "ts", text: str = "text", tags: str = "tickers", zone: str = MARKET_ZONE) -> DataFrame:
    """One row a source, most rows first: how its stamps cluster (UTC clock), where they lie in the session (market clock), tags, script, span, verdict.

    Counts are made by (source, minute) first, so a source of any size meets in at most 1,440 rows. Of equally frequent minutes the smallest is the mode.
    """
    minute = F.hour(ts) * 60 + F.minute(ts)
    local = F.from_utc_timestamp(F.col(ts).cast("timestamp"), zone)
    market = F.hour(local) * 60 + F.minute(local)
    body = F.coalesce(F.col(text), F.lit(""))
    by = rows.groupBy(F.col(source).alias("source"), minute.alias("minute")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(market < OPEN).alias("before"), F.count_if(market > CLOSE).alias("after"), F.count_if(F.size(tags) > 0).alias("tagged"),
        F.count_if(body.rlike("[\u0400-\u04FF]")).alias("cyrillic"), F.count_if(body.rlike("[^\\x00-\\x7F]")).alias("other"), F.min(ts).alias("first"), F.max(ts).alias("last"),
    )
    n = F.sum("n")
    out = by.groupBy("source").agg(
        n.alias("rows"), (F.sum(F.when(F.col("minute") == 0, F.col("n")).otherwise(0)) / n).alias("midnight_share"), F.max(F.struct("n", (-F.col("minute")).alias("m"))).alias("mode"),
        F.count(F.lit(1)).alias("minutes"), *[(F.sum(c) / n).alias(f"{c}_share") for c in ("before", "after", "tagged", "cyrillic", "other")], F.min("first").alias("first_ts"), F.max("last").alias("last_ts"),
    )
    modal, share = -F.col("mode.m"), F.col("mode.n") / F.col("rows")
    out = out.withColumns({"modal_time": T.clock(modal), "modal_share": share, "in_session_share": F.lit(1.0) - F.col("before_share") - F.col("after_share")}).drop("mode")
    out = out.withColumns({"date_only": (F.col("modal_share") >= DATE_ONLY_SHARE) | (F.col("minutes") < LEAST_MINUTES), "likely_non_english": F.col("cyrillic_share") > SCRIPT_SHARE})
    return out.withColumn("verdict", F.when(F.col("date_only"), "date-only").otherwise("intraday")).orderBy(F.desc("rows"), "source")


def screened(profile: DataFrame, least_rows: int = 1000, least_tagged: float = 0.5) -> DataFrame:
    """(source, intraday, english, tagged) of sources with enough rows: mechanical tests only, whether a source belongs is no test's to say."""
    return profile.where(F.col("rows") >= least_rows).select("source", (~F.col("date_only")).alias("intraday"), (~F.col("likely_non_english")).alias("english"), (F.col("tagged_share") >= least_tagged).alias("tagged"))


def screen_notes(screen: DataFrame) -> list[str]:
    """What the tests together say, in words."""
    rows = [r for r in screen.collect()]  # a row a source
    out = []
    if foreign := sorted(r["source"] for r in rows if not r["english"]):
        out.append(f"not English, to be filtered out: {', '.join(foreign)}")
    if not any(r["intraday"] for r in rows):
        out.append("no source has intraday stamps: map by date")
    elif not any(r["intraday"] and r["tagged"] for r in rows):
        out.append("no source has both intraday stamps and tags")
    return [*out, "relevance is not tested"]


def refuse_dates(rows: DataFrame, ts: str, least: int = 200) -> None:
    """An intraday mapping refuses stamps that are dates; fewer than ``least`` rows are let through."""
    found = evidence(rows.select(F.lit("all").alias("source"), ts, F.lit("").alias("text"), F.array().cast("array<string>").alias("tickers")), ts=ts).first()
    if found is not None and found["rows"] >= least and found["date_only"]:
        raise ValueError(f"{found['modal_share']:.1%} of stamps are at {found['modal_time']}, {found['minutes']} minutes in all: these are dates")


def refuse_times(rows: DataFrame, ts: str, least: int = 200) -> None:
    """A mapping by date refuses stamps with a time of day."""
    found = evidence(rows.select(F.lit("all").alias("source"), ts, F.lit("").alias("text"), F.array().cast("array<string>").alias("tickers")), ts=ts).first()
    if found is not None and found["rows"] >= least and not found["date_only"]:
        raise ValueError(f"{found['minutes']} different minutes: these stamps have a time of day")


def coverage_by_year(rows: DataFrame, ts: str) -> DataFrame:
    return rows.groupBy(F.year(ts).alias("year")).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def zero_sessions(day: DataFrame) -> DataFrame:
    """(kind, n): sessions without events; the first of the calendar can have none and is a boundary, the others lack news."""
    first = day.agg(F.min("session").alias("_first"))
    return day.where("n = 0").join(F.broadcast(first)).groupBy(F.when(F.col("session") == F.col("_first"), "boundary").otherwise("no_news").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def withheld(rates: DataFrame, clustered: bool, names: list[str]) -> DataFrame:
    """Rates that a sample of neighbouring blocks can't give are null, with the reason."""
    if not clustered:
        return rates.withColumn("withheld", F.lit(None).cast("string"))
    return rates.withColumns({n: F.lit(None).cast(dict(rates.dtypes)[n]) for n in names}).withColumn("withheld", F.lit("a sample of neighbouring blocks says nothing of the corpus"))


def repeated_share(rows: DataFrame, text: str) -> DataFrame:
    """Rows, texts, and the share of rows whose text another row has too. Texts meet as hashes."""
    counts = rows.groupBy(F.md5(F.col(text).cast("binary")).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("texts"), (F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("repeated_share"))


def top_tags(rows: DataFrame, tags: str = "tickers", k: int = 15) -> DataFrame:
    return rows.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tag").limit(k)


def content_sample(rows: DataFrame, n: int, seed: int = 7, key: str = "id") -> DataFrame:
    """n rows in the order of a seeded hash of their id."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), key).limit(n)


def first_days(rows: DataFrame, ts: str, n: int) -> DataFrame:
    """All rows of the first n days there are."""
    day = F.to_date(ts)
    days = rows.select(day.alias("_day")).distinct().orderBy("_day").limit(n)
    return rows.join(F.broadcast(days), day == F.col("_day"), "left_semi")


def calendar_difference(own: DataFrame, calendar: DataFrame) -> DataFrame:
    """(session, side): sessions that only one of the two has."""
    a, b = own.select("session").distinct(), calendar.select("session").distinct()
    return a.join(b, "session", "left_anti").withColumn("side", F.lit("extra")).unionByName(b.join(a, "session", "left_anti").withColumn("side", F.lit("lacking")))


def trailing(day: DataFrame, value: str, windows: tuple[int, ...] = (21, 63)) -> DataFrame:
    """session, value and its trailing means over what the last so many sessions have (for plots). A row a session."""
    order = W.orderBy("session")
    return day.select("session", value, *[F.avg(value).over(order.rowsBetween(-(w - 1), 0)).alias(f"mean{w}") for w in windows])


def line(rows: DataFrame, y: str, x: str) -> DataFrame:
    """Slope, intercept, correlation and rows of a straight line."""
    return rows.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(y, x).alias("corr"), F.regr_count(y, x).alias("n"))


def census(events: DataFrame, days: DataFrame, tags: str = "tickers", ok: Column | None = None) -> dict[str, DataFrame]:
    """Coverage, concentration of tags, stability by year and the suggested window, all from one mapping of events(session, ...) to sessions."""
    events = events.persist()
    counts = events.where("session IS NOT NULL").groupBy("session").agg(F.count(F.lit(1)).alias("n"))
    day = days.select("session").join(counts, "session", "left").withColumn("n", F.coalesce("n", F.lit(0))).persist()  # a row a session
    years = stability(day)
    return {
        "coverage": coverage(day), "zero_sessions": zero_sessions(day), "concentration": concentration(events.select(F.explode(tags).alias("tag")), "tag"),
        "stability": years, "window": longest_run(years, F.col("thin_share") < 0.3 if ok is None else ok),
        "assigned": events.agg(F.count("session").alias("assigned"), F.count_if(F.col("session").isNull()).alias("unassignable")),
    }
