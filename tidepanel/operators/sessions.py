"""Trading sessions: the calendar, forward as-of mappings, daily aggregation, the panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Events a session needs for a dispersion.
LEAST_FOR_SD = 5
VOLUME_WINDOW = 63
HORIZONS = (1, 2, 3, 4, 5)


def calendar(spark: SparkSession, start: str, end: str, holidays: list[str] = ()) -> DataFrame:
    """Weekdays but for the listed holidays: session, prev, pos. One row a session, small at any scale of events."""
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("session"))
    days = days.where(F.weekday("session") < 5)
    if holidays:
        days = days.where(~F.date_format("session", "yyyy-MM-dd").isin(list(holidays)))
    order = W.orderBy("session")
    return days.select("session", F.lag("session").over(order).alias("prev"), (F.row_number().over(order) - 1).alias("pos"))


def trading_calendar(spark: SparkSession, start: str, end: str, holidays: DataFrame | None) -> DataFrame:
    """As calendar, with holidays(day) from a table; without one there is no trading calendar, and that is an error."""
    if holidays is None:
        raise ValueError("a trading calendar needs its holidays")
    days = [str(r[0]) for r in holidays.select(F.col("day").cast("date").alias("day")).where(F.col("day").between(start, end)).distinct().collect()]  # some ten a year
    return calendar(spark, start, end, days)


def require_same_sessions(own: DataFrame, calendar_: DataFrame) -> None:
    """Refuse a frame whose sessions aren't exactly the calendar's."""
    from tidepanel.operators import audit

    odd = {r["side"]: r["n"] for r in audit.calendar_difference(own, calendar_).groupBy("side").agg(F.count(F.lit(1)).alias("n")).collect()}
    if odd:
        raise ValueError("sessions differ from the calendar: " + ", ".join(f"{n} {side}" for side, n in sorted(odd.items())))


def session_closes(sessions: DataFrame, zone: str = "America/New_York", hour: int = 16) -> DataFrame:
    """sessions with close, the moment (UTC) of the local closing hour."""
    return sessions.withColumn("close", F.to_utc_timestamp(F.col("session").cast("timestamp") + F.expr(f"INTERVAL '{hour}' HOUR"), zone))


def date_dimension(sessions: DataFrame, defer: bool = True, prior: str | None = None) -> DataFrame:
    """(day, session): each calendar day to the first session after it (defer) or on or after it.

    Exploded days make the as-of mapping an equi-join on a broadcast calendar instead of a range join. prior is the session before the
    calendar's first, if there was one: then the first session takes the days since as any other does.
    """
    if prior is not None:
        sessions = sessions.withColumn("prev", F.coalesce("prev", F.lit(prior).cast("date")))
    low, high = (F.col("prev"), F.date_sub("session", 1)) if defer else (F.date_add("prev", 1), F.col("session"))
    out = sessions.where("prev IS NOT NULL").select("session", F.explode(F.sequence(low, high)).alias("day"))
    if not defer:
        out = out.unionByName(sessions.where("prev IS NULL").select("session", F.col("session").alias("day")))
    return out


def map_dates(events: DataFrame, sessions: DataFrame, ts: str, defer: bool = True, prior: str | None = None) -> DataFrame:
    """events with session, null at both edges of the calendar."""
    return events.join(F.broadcast(date_dimension(sessions, defer, prior)), F.to_date(ts) == F.col("day"), "left").drop("day")


def map_intraday(events: DataFrame, sessions: DataFrame, ts: str, close_hour: int = 16, prior: str | None = None, zone: str | None = None) -> DataFrame:
    """events with the first session whose close is at or after ts; the first session takes nothing, for no close precedes it, unless
    the session before (prior) is told. With a zone, ts is UTC and the close is that zone's hour."""
    if zone is not None:
        local = F.from_utc_timestamp(F.col(ts).cast("timestamp"), zone).cast("timestamp_ntz")
        return map_intraday(events.withColumn("_local", local), sessions, "_local", close_hour, prior).drop("_local")
    if prior is not None:
        sessions = sessions.withColumn("prev", F.coalesce("prev", F.lit(prior).cast("date")))
    after = F.expr(f"make_interval(0, 0, 0, 0, {24 - close_hour}, 0, 0)")
    # A stamp on the close belongs to it: shifted a microsecond back, the shifted day is the first day whose close isn't over.
    day = F.to_date(F.col(ts).cast("timestamp_ntz") - F.expr("INTERVAL '0.000001' SECOND") + after)
    days = date_dimension(sessions.where("prev IS NOT NULL"), False)
    return events.join(F.broadcast(days), day == F.col("day"), "left").drop("day")


def daily(scored: DataFrame, sessions: DataFrame, score: Column, agg: str = "mean") -> DataFrame:
    """Dense on the calendar: n, s (mean or median) and d (sample deviation from LEAST_FOR_SD events on)."""
    one = F.median(score) if agg == "median" else F.avg(score)
    by = scored.where("session IS NOT NULL").groupBy("session").agg(
        F.count(F.lit(1)).alias("n"), one.alias("s"), F.when(F.count(F.lit(1)) >= LEAST_FOR_SD, F.stddev_samp(score)).alias("d")
    )
    return sessions.select("session").join(by, "session", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def bars(trades: DataFrame, day: str, price: Column, volume: str) -> DataFrame:
    return trades.groupBy(F.to_date(day).alias("session")).agg(
        F.avg(price).alias("close"), F.max(price).alias("high"), F.min(price).alias("low"), F.sum(volume).alias("volume")
    )


def market(prices: DataFrame, sessions: DataFrame) -> DataFrame:
    """Bars on the calendar with returns, range variance and log volume; a return needs both neighbours."""
    order = W.orderBy("session")
    out = sessions.select("session").join(prices, "session", "left")
    return out.select(
        "session", "close",
        (F.ln("close") - F.lag(F.ln("close")).over(order)).alias("ret"),
        (F.pow(F.ln(F.col("high") / F.col("low")), 2) / (4 * F.ln(F.lit(2.0)))).alias("range_var"),
        F.ln(F.nullif("volume", F.lit(0.0))).alias("log_volume"),
    )


def checked_panel(day: DataFrame, bars_: DataFrame, window: int = VOLUME_WINDOW) -> DataFrame:
    """As panel; sessions that repeat, market columns that lack, or a join that changes the number of rows are refused."""
    lacking = [c for c in ("close", "ret", "range_var", "log_volume") if c not in bars_.columns]
    if lacking:
        raise ValueError(f"the market lacks {', '.join(lacking)}")
    for name, df in (("daily scores", day), ("the market", bars_)):
        if df.groupBy("session").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR session IS NULL").limit(1).count():
            raise ValueError(f"{name} repeat a session")
    out = panel(day, bars_, window)
    if out.count() != day.count():
        raise ValueError("the join changed the number of sessions")
    return out


def complete_sessions(events: DataFrame, score: str) -> DataFrame:
    """(session, complete): whether all of a session's events have a score."""
    return events.where("session IS NOT NULL").groupBy("session").agg(F.every(F.col(score).isNotNull()).alias("complete"))


def panel(day: DataFrame, bars_: DataFrame, window: int = VOLUME_WINDOW) -> DataFrame:
    """Daily scores and market with lags, leads and the volume's distance from its full trailing mean.

    Windows run over one row a session: calendar-sized, whatever the number of events."""
    order = W.orderBy("session")
    trail = order.rowsBetween(-(window - 1), 0)
    mean = F.when(F.count("log_volume").over(trail) == window, F.avg("log_volume").over(trail))
    out = day.join(bars_, "session", "left")
    return out.select(
        "*", (F.col("log_volume") - mean).alias("volume_gap"),
        *[F.lag(c).over(order).alias(f"{c}_lag1") for c in ("ret", "range_var", "log_volume")],
        *[F.lead("ret", h).over(order).alias(f"ret_lead{h}") for h in HORIZONS],
        *[F.lead(c).over(order).alias(f"{c}_lead1") for c in ("range_var", "log_volume")],
    )
