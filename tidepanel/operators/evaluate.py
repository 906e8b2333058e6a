"""Evaluation of scorers on labelled items: bands from one part, figures from the other, agreement of annotators. Labels are -1, 0, 1, or ``unusable`` (null)."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.operators import annotate, inference, stats

LABELS = (-1, 0, 1)


def check_declaration(record: dict) -> None:
    """Refuse a declaration of how labels were made that lacks a statement, or whose sessions have no zone or order."""
    for key in ("rubric_version", "rubric_sha256", "annotator_role", "instrument"):
        if not isinstance(record.get(key), str) or not record[key].strip():
            raise ValueError(f"the declaration lacks {key}")
    if not re.fullmatch("[0-9a-f]{64}", record["rubric_sha256"]):
        raise ValueError("the rubric's digest is no SHA-256")
    if record.get("label_source") != "human" or record.get("blind_to_model_outputs") is not True:
        raise ValueError("labels have to be human and blind to what models say")
    if any(type(record.get(k)) is not bool for k in ("independent_of_analyst", "scores_existed")) or type(record.get("presentation_order_seed")) is not int or not isinstance(record.get("deviations"), list):
        raise ValueError("the declaration lacks a yes or no, a seed or a list of deviations")
    sessions = record.get("sessions") or []
    for s in sessions:
        begin, end = dt.datetime.fromisoformat(s["start"]), dt.datetime.fromisoformat(s["end"])
        if begin.tzinfo is None or end.tzinfo is None or end < begin:
            raise ValueError("sessions are moments with a zone, in order")
    if not sessions:
        raise ValueError("no session was declared")


def confident(labels: DataFrame) -> DataFrame:
    """Items that weren't marked as hard."""
    return labels.where("hard = 0")


def calibrate(labels: DataFrame, scores: DataFrame, names: list[str], points: int = 81) -> dict[str, tuple[float, float]]:
    """The band of each score, from labels(id, part, label) of the calibration part alone, all three classes of them."""
    if labels.limit(1).count() == 0 or labels.where("part <> 'calibration' OR part IS NULL").limit(1).count():
        raise ValueError("bands are fitted on calibration items only")
    rows = annotate.joined_measurements(labels, scores).where("label IS NOT NULL")
    if {r[0] for r in rows.select("label").distinct().collect()} != set(LABELS):
        raise ValueError("calibration needs all three classes and no other")
    for name in names:
        if rows.where(F.col(name).isNull() | F.isnan(name) | (F.abs(name) > 1)).limit(1).count():
            raise ValueError(f"{name} has values that are null or outside [-1, 1]")
    return {n: tuple(stats.best_band(stats.threshold_grid(rows, "label", n, points)).select("low", "high").first()) for n in names}


def per_class(rows: DataFrame, names: list[str], truth: str = "label") -> DataFrame:
    """(scorer, class, precision, recall, f1, support) of predictions in columns of their own."""
    each = F.array(*[F.struct(F.lit(n).alias("scorer"), F.col(n).alias("pred")) for n in names])
    cells = rows.select(F.col(truth).alias("truth"), F.inline(each)).groupBy("scorer", "truth", "pred").agg(F.count(F.lit(1)).alias("n"))
    named = cells.select("scorer", "truth", "pred", "n", F.explode(F.array(*map(F.lit, LABELS))).alias("class"))
    one = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    hit, said, there = one((F.col("truth") == F.col("class")) & (F.col("pred") == F.col("class"))), one(F.col("pred") == F.col("class")), one(F.col("truth") == F.col("class"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return named.groupBy("scorer", "class").agg(share(hit, said).alias("precision"), share(hit, there).alias("recall"), share(2 * hit, said + there).alias("f1"), there.alias("support"))


def evaluate(labels: DataFrame, predictions: DataFrame, names: list[str], draws: int = 10_000) -> dict:
    """Figures from labels(id, group_id, part, label) of the evaluation part alone and predictions(id, *names) of three classes for exactly these ids."""
    if labels.limit(1).count() == 0 or labels.where("part <> 'evaluation' OR part IS NULL").limit(1).count():
        raise ValueError("figures are of evaluation items only")
    joined = annotate.joined_measurements(labels, predictions)
    for n in names:
        if joined.where(~F.coalesce(F.col(n).isin(*LABELS), F.lit(False))).limit(1).count():
            raise ValueError(f"{n} predicts something else than three classes")
    rows = joined.where("label IS NOT NULL").persist()
    usable = rows.count()
    if not usable:
        raise ValueError("no usable labels")
    each = F.array(*[F.struct(F.lit(n).alias("scorer"), F.col(n).alias("pred")) for n in names])
    cells = rows.select(F.col("label").alias("truth"), F.inline(each)).groupBy("scorer", "truth", "pred").agg(F.count(F.lit(1)).alias("n"))
    ladder = {r["scorer"]: r.asDict() for r in stats.macro_f1(cells, ["scorer"]).collect()}
    contrasts = {}
    for k, a in enumerate(names):
        for b in names[k + 1 :]:
            drawn = inference.group_bootstrap(rows, "label", a, b, "group_id", list(LABELS), draws)
            r = drawn.agg(F.max(F.when(F.col("draw") < 0, F.col("difference"))).alias("d"), *[F.expr(f"percentile(CASE WHEN draw >= 0 THEN difference END, {q})").alias(n) for n, q in (("low", 0.025), ("high", 0.975))]).first()
            cell = stats.mcnemar_cells(rows, F.col(a) == F.col("label"), F.col(b) == F.col("label")).first()
            contrasts[a, b] = {"difference": r["d"], "low": r["low"], "high": r["high"], "mcnemar_p": stats.mcnemar_p(cell["first_only"], cell["second_only"])}
    out = {"requested": labels.count(), "usable": usable, "ladder": ladder, "contrasts": contrasts, "classes": [r.asDict() for r in per_class(rows, names).collect()]}
    rows.unpersist()
    return out


def evaluate_frozen(labels: DataFrame, scores: DataFrame, bands: dict, registered: dict, classifiers: list[str] = (), draws: int = 10_000) -> dict:
    """As evaluate, with bands that were registered before: scores by their bands, classifiers' columns as they are."""
    if {k: tuple(v) for k, v in bands.items()} != {k: tuple(v) for k, v in registered.items()}:
        raise ValueError("register the calibrated bands before the evaluation")
    if any(not -1 <= low <= high <= 1 for low, high in registered.values()):
        raise ValueError("a band lies in [-1, 1], low end first")
    cols = [stats.banded(F.col(n), *registered[n]).alias(n) for n in registered] + [F.col(c) for c in classifiers]
    return evaluate(labels, scores.select("id", *cols), [*classifiers, *registered], draws)


def agreement(first: DataFrame, second: DataFrame) -> DataFrame:
    """(matched, usable, agreement, kappa) of a second annotator's labels(id, label), whose ids are some of the first's. Kappa is null if both only ever say
    one and the same class."""
    for rows in (first, second):
        if rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR id IS NULL").limit(1).count():
            raise ValueError("ids repeat or are null")
    if second.join(first, "id", "left_anti").limit(1).count():
        raise ValueError("the second annotator has items that the first hasn't")
    both = first.select("id", F.col("label").alias("a")).join(second.select("id", F.col("label").alias("b")), "id")
    usable = both.where("a IS NOT NULL AND b IS NOT NULL")
    matched = both.agg(F.count(F.lit(1)).alias("matched"))
    found = stats.kappa(usable, "a", "b").select(F.col("rows").alias("usable"), "agreement", "kappa")
    return matched.join(F.broadcast(found))
