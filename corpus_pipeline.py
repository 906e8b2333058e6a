"""The corpus pipeline: toxicity, near duplicates, secrets, mixing, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs;
all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm import common, jaccard_join, mixing, pieces, secret_scan, toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the cut. Labels of this input's documents teach; held-out rows teach nothing."""
    labels = common.table(spark, sf_dir, "labels")
    model = toxicity.learn(toxicity.with_labels(docs, labels))
    return toxicity.score(docs, model, [F.col(c) for c in COLUMNS]).where(F.col("score") < toxicity.CUT).select("row.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more over five-word shingles."""
    return jaccard_join.keep_one(docs).select(*COLUMNS)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret replaced by its label; all stay."""
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as they are taken."""
    return mixing.repeated(docs).select(*COLUMNS)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Counts and digests of the pieces that every document of the mix has. Executors hold what earlier stages left, so workers remember less."""
    return pieces.digests(docs, pieces.default_model(), remembered=40_000)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secret_stage),
    ("mixing", mixing_stage),
    ("pieces", pieces_stage),
]

#: A trained classifier and a learned vocabulary are no SQL: tests hold the stages and the whole against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    with common.Scratch(spark) as scratch:  # a stage's tables are deleted once its result is written
        for name, stage in STAGES:
            with common.Scratch(spark) as own:
                made = common.saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
                own.keep(made)
            scratch.drop(docs)
            docs = made
        scratch.keep(docs)
        return docs
