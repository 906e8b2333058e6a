"""Market bars on the trading calendar, and labels from sheets."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepanel.operators import annotate, evaluate, sessions
from tidepanel.sources import files


def with_warm_up(spark: SparkSession, start: str, end: str, holidays: DataFrame, warm_up: int) -> DataFrame:
    """The calendar from ``warm_up`` sessions before start to end (included), with in_window."""
    whole = sessions.trading_calendar(spark, str(spark.sql(f"SELECT date_sub(DATE '{start}', {warm_up * 2 + 20})").first()[0]), end, holidays)
    rank = F.sum((F.col("session") < F.lit(start).cast("date")).cast("int")).over(W.orderBy(F.desc("session")))
    own = whole.withColumn("in_window", F.col("session") >= F.lit(start).cast("date")).withColumn("_back", rank).where(F.col("_back") <= warm_up)
    order = W.orderBy("session")
    return own.select("session", F.lag("session").over(order).alias("prev"), (F.row_number().over(order) - 1).alias("pos"), "in_window")


def load(bars: DataFrame, index: DataFrame | None, calendar: DataFrame) -> DataFrame:
    """bars(session, close, high, low, volume) and an index(session, close) on the calendar: close, ret, range_var, volume, log_volume, index_close, in_window.

    Prices are put on the calendar before returns are made, so none spans a missing session; sessions without bars keep nulls.
    """
    market = sessions.market(bars, calendar).join(calendar.select("session", *[c for c in ("in_window",) if c in calendar.columns]), "session")
    market = market.join(bars.select("session", "volume"), "session", "left")
    if index is None:
        return market.withColumn("index_close", F.lit(None).cast("double"))
    return market.join(index.select("session", F.col("close").alias("index_close")), "session", "left")


def missing(market: DataFrame) -> DataFrame:
    """(sessions, warm_up, without_price)."""
    return market.agg(F.count(F.lit(1)).alias("sessions"), F.count_if(~F.col("in_window")).alias("warm_up"), F.count_if(F.col("close").isNull()).alias("without_price"))


def write(market: DataFrame, path: str, settings: dict) -> None:
    files.write_with_provenance(market, path, {"settings": settings, "counts": missing(market).first().asDict()})


def load_split(spark: SparkSession, path: str) -> DataFrame:
    """split(id, group_id, part) of a frozen set: ids of their own, two parts, no group in both."""
    rows = spark.read.option("header", True).csv(path).select("id", "group_id", "part")
    odd = rows.where("id IS NULL OR group_id IS NULL OR part IS NULL OR part NOT IN ('calibration', 'evaluation')").limit(1).count()
    if odd or rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        raise ValueError("the split has ids that repeat, or rows without a part")
    if rows.groupBy("group_id").agg(F.count_distinct("part").alias("n")).where("n > 1").limit(1).count():
        raise ValueError("a group is in both parts")
    return rows


def load_labels(spark: SparkSession, sheet: str, declaration: str, split: DataFrame, part: str, blind: DataFrame) -> DataFrame:
    """Labels(id, label, mixed, hard) of one part with group_id, part and text: declared as human, complete, and on the texts that were handed out.

    Labels are negative, neutral, positive (-1, 0, 1) or unusable (null); blank ones are refused.
    """
    evaluate.check_declaration(json.loads(Path(declaration).read_text()))
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(sheet)
    lacking = {"id", "label", "mixed", "hard"} - set(raw.columns)
    if lacking:
        raise ValueError(f"the sheet lacks {', '.join(sorted(lacking))}")
    if raw.join(split, "id", "left_anti").limit(1).count():
        raise ValueError("labels of items outside the set")
    own = annotate.joined_labels(raw.join(split.where(F.col("part") == part), "id", "left_semi"), split.where(F.col("part") == part), ("negative", "neutral", "positive", "unusable"))
    if own.where(~F.coalesce(F.col("mixed").isin("0", "1") & F.col("hard").isin("0", "1"), F.lit(False))).limit(1).count():
        raise ValueError("mixed and hard are 0 or 1")
    texts = blind.select("id", F.col("text").alias("_text"))
    met = own.join(texts, "id", "left")
    other = F.col("_text").isNull() | (~F.col("text").eqNullSafe(F.col("_text")) if "text" in raw.columns else F.lit(False))
    if met.where(other).limit(1).count():
        raise ValueError("the sheet's texts aren't those handed out")
    value = F.when(F.col("label") == "negative", -1).when(F.col("label") == "neutral", 0).when(F.col("label") == "positive", 1)
    return met.select("id", "group_id", "part", value.alias("label"), F.col("mixed").cast("int").alias("mixed"), F.col("hard").cast("int").alias("hard"), F.col("_text").alias("text"))


def build_annotation_set(rows: DataFrame, folder: str, total: int, calibration: int, pilot: int, scores_exist: bool = False, seed: int = 7) -> dict:
    """Draw rows(id, text, text_norm, stratum) by stratum, group them, split them by group and write the sheets, with a manifest last."""
    from tidepanel.operators import dedup, stats, work

    sizes = rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    take = stats.allocation(sizes, total).select("stratum", "take")
    rank = F.row_number().over(W.partitionBy("stratum").orderBy(annotate.shuffled(seed), "id"))
    drawn = work.saved(rows.withColumn("_r", rank).where(F.col("_r") <= total).join(F.broadcast(take), "stratum").where("_r <= take").drop("_r", "take"), "drawn")
    assigned = work.saved(annotate.parts(drawn.join(dedup.article_groups(drawn), "id"), calibration), "assigned")
    first, second = annotate.pilot(assigned, pilot), annotate.second_annotator(assigned)
    with files.StagedRun({"set": folder}, settings={"seed": seed, "total": total, "scores_exist": scores_exist}) as run:
        run.csv("set", "split_assignment.csv", assigned.select("id", "group_id", "part").orderBy("id"))
        run.csv("set", "to_label_primary.csv", annotate.blind(assigned).orderBy("place").select(*annotate.BLIND))
        run.csv("set", "to_label_second.csv", annotate.blind(second).orderBy("place").select(*annotate.BLIND))
        run.csv("set", "pilot_items.csv", first.select("id").orderBy("id"))
    return assigned.agg(F.count(F.lit(1)).alias("drawn"), F.count_if(F.col("part") == "calibration").alias("calibration"), F.count_distinct("group_id").alias("groups")).first().asDict()
