"""Scorers, and a score store that is extended by what it lacks.

A scorer has a name, a fingerprint (whatever changes its numbers) and a Column for a text. The store is a folder of generations (Parquet: headline_id,
text_sha256, score_<name>) and a pointer that names the current one with its fingerprints and rows; the pointer is replaced last, so readers see a whole
generation or the one before. One writer at a time holds a lock file.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.functions import text as T


class IncompatibleScores(RuntimeError):
    """Stored scores are of another measurement, another text, or of unknown origin."""


class IncompleteScores(RuntimeError):
    """Scores that don't cover their headlines one to one, or lie outside [-1, 1]."""


class LexiconScorer:
    """Positive less negative hits over hits, 0 without one; a plain expression. The fingerprint holds a digest of the words."""

    def __init__(self, name: str, positive: list[str], negative: list[str]):
        if not positive or not negative:
            raise ValueError("a lexicon needs words of both kinds")
        self.name, self.positive, self.negative = name, sorted({w.lower() for w in positive}), sorted({w.lower() for w in negative})
        digest = hashlib.sha256(json.dumps([self.positive, self.negative]).encode()).hexdigest()
        self.fingerprint = {"kind": "lexicon", "words": digest, "token": "[a-z']+"}

    def column(self, text: Column) -> Column:
        return T.lexicon_score(text, self.positive, self.negative)


class BatchScorer:
    """A function from texts to numbers in [-1, 1] (a model that is loaded once a worker), asked in batches of texts of like length."""

    def __init__(self, name: str, fingerprint: dict, load: Callable[[], Callable[[list[str]], list[float]]], batch: int = 32):
        self.name, self.fingerprint, self.load, self.batch = name, fingerprint, load, batch

    def column(self, text: Column) -> Column:
        load, size = self.load, self.batch

        @F.pandas_udf("float")
        def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for texts in parts:
                order = texts.fillna("").str.len().argsort(kind="stable").to_numpy()
                out = pd.Series(0.0, index=range(len(texts)))
                for low in range(0, len(order), size):
                    at = order[low : low + size]
                    out.iloc[at] = model(texts.iloc[at].fillna("").tolist())
                yield out.astype("float32")

        return score(text)


class Classifier:
    """A function from texts to rows of probabilities in the order of ``labels``; predicts the label of the largest, ties to the first."""

    def __init__(self, name: str, labels: list[str], fingerprint: dict, load: Callable[[], Callable[[list[str]], list[list[float]]]]):
        self.name, self.labels, self.fingerprint, self.load = name, labels, fingerprint, load

    def probabilities(self, text: Column) -> Column:
        load = self.load

        @F.pandas_udf("array<float>")
        def ask(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for texts in parts:
                yield pd.Series(list(model(texts.fillna("").tolist())))

        return ask(text)

    def predict(self, text: Column) -> Column:
        p = self.probabilities(text)
        return F.element_at(F.array(*map(F.lit, self.labels)), F.array_position(p, F.array_max(p)).cast("int"))


def predictions(scorer, text: Column, band: tuple[float, float] | None = None) -> Column:
    """A classifier predicts by itself and takes no band; a scorer needs one: -1 up to its low end, 1 above its high end, else 0."""
    from tidepanel.operators import stats

    if isinstance(scorer, Classifier):
        if band is not None:
            raise ValueError(f"{scorer.name} predicts by its probabilities; a band has no part in that")
        return scorer.predict(text)
    if band is None:
        raise ValueError(f"{scorer.name} gives one number; classes need a band")
    return stats.banded(scorer.column(text), *band)


REGISTRY: dict[str, Callable[[], object]] = {}


def register(name: str, factory: Callable[[], object]) -> None:
    """A scorer under a name; it is built only when it is asked for."""
    REGISTRY[name] = factory


def build(names: list[str]) -> list:
    lacking = [n for n in names if n not in REGISTRY]
    if lacking:
        raise KeyError(f"no scorer is registered as {', '.join(lacking)}")
    return [REGISTRY[n]() for n in names]


def dictionary(spark: SparkSession, path: str, word: str = "word", positive: str = "positive", negative: str = "negative") -> tuple[list[str], list[str]]:
    """Word lists of a CSV; columns by name in any case; a word belongs to a list if its number there is above 0."""
    raw = spark.read.option("header", True).csv(path)
    by = {c.lower(): c for c in raw.columns}
    lacking = [c for c in (word, positive, negative) if c.lower() not in by]
    if lacking:
        raise ValueError(f"{path} lacks {', '.join(lacking)}")
    own = raw.select(F.lower(F.trim(F.col(f"`{by[word.lower()]}`"))).alias("w"), *[F.expr(f"try_cast(`{by[c.lower()]}` AS double) > 0").alias(n) for c, n in ((positive, "p"), (negative, "n"))]).where("w <> ''")
    rows = own.where("p OR n").distinct().collect()  # a dictionary of thousands of words
    found = sorted(r["w"] for r in rows if r["p"]), sorted(r["w"] for r in rows if r["n"])
    if not all(found):
        raise ValueError(f"{path} gives an empty list")
    return found


# Checks


def validate(headlines: DataFrame, scores: DataFrame, columns: list[str]) -> None:
    """Refuse scores that repeat an id, lack a headline, or hold values that are null, not finite or outside [-1, 1]; all counts are told."""
    lacking = [c for c in columns if c not in scores.columns]
    if lacking:
        raise IncompleteScores(f"no columns {', '.join(lacking)}")
    problems = check(headlines, scores, columns).where("n > 0").collect()
    if problems:
        raise IncompleteScores("; ".join(f"{r['problem']}: {r['n']}" for r in sorted(problems, key=lambda r: r["problem"])))


def check(headlines: DataFrame, scores: DataFrame, columns: list[str]) -> DataFrame:
    """(problem, n) of what ``validate`` refuses."""
    count = lambda df, name: df.agg(F.lit(name).alias("problem"), F.count(F.lit(1)).alias("n"))
    own = scores.join(headlines.select("headline_id").distinct(), "headline_id", "left_semi")
    out = count(scores.groupBy("headline_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1 OR headline_id IS NULL"), "repeated or null ids")
    out = out.unionByName(count(headlines.join(scores, "headline_id", "left_anti"), "headlines without scores"))
    for c in columns:
        bad = F.col(c).isNull() | F.isnan(c) | (F.abs(c) > 1)
        out = out.unionByName(count(own.where(bad), f"values of {c} that are null or outside [-1, 1]"))
    return out


def joined(headlines: DataFrame, scores: DataFrame) -> DataFrame:
    """headlines with their scores, one to one by an id that neither side repeats; headlines without scores keep nulls."""
    for name, df in (("headlines", headlines), ("scores", scores)):
        if df.groupBy("headline_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
            raise IncompleteScores(f"{name} repeat an id")
    return headlines.join(scores, "headline_id", "left")


# The store


class Store:
    """A score store at a path of any file system that Spark reads."""

    POINTER, LOCK = "CURRENT.json", "LOCK"

    def __init__(self, spark: SparkSession, root: str, names: list[str]):
        self.spark, self.root, self.names = spark, root.rstrip("/"), list(names)
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _read(self, name: str) -> str | None:
        path = self._path(f"{self.root}/{name}")
        if not self.fs.exists(path):
            return None
        return "\n".join(r[0] for r in self.spark.read.text(f"{self.root}/{name}").collect())  # a pointer of a few lines

    def _write(self, name: str, text: str) -> None:
        """To a temporary name, then renamed over the old one."""
        temporary = self._path(f"{self.root}/.{name}-{uuid.uuid4().hex}")
        out = self.fs.create(temporary, True)
        out.write(bytearray(text.encode()))
        out.close()
        target = self._path(f"{self.root}/{name}")
        self.fs.delete(target, False)
        if not self.fs.rename(temporary, target):
            raise OSError(f"{target} was not replaced")

    def state(self) -> dict:
        raw = self._read(self.POINTER)
        return {} if raw is None else json.loads(raw)

    def schema(self) -> str:
        return "headline_id string, text_sha256 string, " + ", ".join(f"score_{n} float" for n in self.names)

    def load(self) -> tuple[DataFrame, dict]:
        """The current scores and fingerprints; of unknown origin or broken form they are refused."""
        state = self.state()
        if not state:
            return self.spark.createDataFrame([], self.schema()), {}
        scores = self.spark.read.parquet(f"{self.root}/{state['generation']}")
        lacking = {"headline_id", "text_sha256", *(f"score_{n}" for n in self.names)} - set(scores.columns)
        if lacking:
            raise IncompatibleScores(f"stored scores lack {', '.join(sorted(lacking))}")
        odd = [f"score_{n}" for n in self.names if dict(scores.dtypes)[f"score_{n}"] != "float"]
        if odd:
            raise IncompatibleScores(f"{', '.join(odd)} aren't float")
        unknown = set(state["fingerprints"]) - set(self.names)
        if unknown:
            raise IncompatibleScores(f"stored scorers that nobody declared: {', '.join(sorted(unknown))}")
        any_ = F.coalesce(*[F.col(f"score_{n}") for n in self.names]).isNotNull()
        sums = scores.agg(
            F.count(F.lit(1)).alias("rows"), F.count_if(F.col("headline_id").isNull()).alias("nulls"), F.count_if(any_ & ~T.is_digest(F.col("text_sha256"))).alias("digests"),
            *[F.count(f"score_{n}").alias(n) for n in self.names],
        ).first()
        if sums["rows"] != state["rows"]:
            raise IncompatibleScores("the pointer counts other rows than the generation has")
        if sums["nulls"] or scores.groupBy("headline_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
            raise IncompatibleScores("stored ids are null or repeat")
        if sums["digests"]:
            raise IncompatibleScores("stored scores without a digest of their text")
        nameless = [n for n in self.names if sums[n] and not state["fingerprints"].get(n)]
        if nameless:
            raise IncompatibleScores(f"stored scores of unknown origin: {', '.join(nameless)}")
        return scores, state["fingerprints"]

    def commit(self, scores: DataFrame, fingerprints: dict) -> None:
        name = f"generation-{uuid.uuid4().hex}"
        scores.write.parquet(f"{self.root}/{name}")
        rows = self.spark.read.parquet(f"{self.root}/{name}").count()
        before = self.state().get("generation")
        self._write(self.POINTER, json.dumps({"generation": name, "rows": rows, "fingerprints": fingerprints}, sort_keys=True))
        if before:
            self.fs.delete(self._path(f"{self.root}/{before}"), True)

    def __enter__(self) -> Store:
        self.fs.mkdirs(self._path(self.root))
        try:
            self.fs.create(self._path(f"{self.root}/{self.LOCK}"), False).close()
        except Exception as error:  # whatever the file system raises for a file that is there
            raise IncompatibleScores(f"{self.root} has a writer already") from error
        return self

    def __exit__(self, *error) -> None:
        self.fs.delete(self._path(f"{self.root}/{self.LOCK}"), False)


def canonical(fingerprint: dict) -> dict:
    """As JSON gives it back; empty or odd ones are refused."""
    if not isinstance(fingerprint, dict) or not fingerprint:
        raise ValueError("a fingerprint is a dictionary that isn't empty")
    return json.loads(json.dumps(fingerprint, allow_nan=False))


def lacking(headlines: DataFrame, scores: DataFrame, names: list[str]) -> DataFrame:
    """headlines(headline_id, text) with digest, stored scores (null where the text has changed) and whether it changed."""
    digest = F.sha2(F.col("text").cast("binary"), 256)
    heads = headlines.select("headline_id", "text", digest.alias("text_sha256"))
    stored = scores.select("headline_id", F.col("text_sha256").alias("_was"), *[F.col(f"score_{n}").alias(f"_{n}") for n in names])
    met = heads.join(stored, "headline_id", "left")
    same = F.col("_was").isNull() | (F.col("_was") == F.col("text_sha256"))
    return met.select("headline_id", "text", "text_sha256", (~same).alias("changed"), *[F.when(same, F.col(f"_{n}")).alias(f"score_{n}") for n in names])


def score_all(headlines: DataFrame, store: Store, scorers: list, on_change: str = "raise", batch_rows: int = 50_000_000) -> DataFrame:
    """headline_id and all scores; only what the store lacks is scored, and the store is extended by it, in batches of about ``batch_rows``.

    Every identity is checked before anything is written: another fingerprint, or another text under a stored id, is refused, or
    (``on_change="rescore"``) all it touches is scored again: a whole column, or all columns of a headline.
    """
    if on_change not in ("raise", "rescore"):
        raise ValueError("on_change is raise or rescore")
    by_name = {s.name: s for s in scorers}
    if len(by_name) != len(scorers) or not set(by_name) <= set(store.names):
        raise ValueError("scorers need different declared names")
    bad = headlines.agg(F.count(F.lit(1)).alias("n"), F.count("text").alias("texts"), F.count("headline_id").alias("ids")).first()
    if bad["texts"] != bad["n"] or bad["ids"] != bad["n"] or headlines.groupBy("headline_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").limit(1).count():
        raise ValueError("headlines need an id of their own and a text")
    with store:
        scores, known = store.load()
        known, stale = dict(known), []
        for name, s in by_name.items():
            now = canonical(s.fingerprint)
            if known.get(name) and canonical(known[name]) != now:
                stale.append(name)
            known[name] = now
        if stale and on_change == "raise":
            raise IncompatibleScores(f"other measurements than those stored: {', '.join(stale)}")
        for name in stale:
            scores = scores.withColumn(f"score_{name}", F.lit(None).cast("float"))
        whole = lacking(headlines, scores, store.names)
        todo = [F.col(f"score_{n}").isNull() for n in by_name]
        some = todo[0]
        for c in todo[1:]:
            some = some | c
        sums = whole.agg(F.count_if("changed").alias("changed"), F.count_if(some).alias("todo")).first()
        if sums["changed"] and on_change == "raise":
            raise IncompatibleScores(f"{sums['changed']} stored headlines have another text now")
        parts = max(1, -(-sums["todo"] // batch_rows))
        for part in range(parts if sums["todo"] or stale or sums["changed"] else 0):
            scores, _ = store.load() if part else (scores, None)
            whole = lacking(headlines, scores, store.names)
            mine = F.pmod(F.xxhash64("headline_id"), F.lit(parts)) == part
            fresh = {f"score_{n}": F.when(F.col(f"score_{n}").isNull() & mine, s.column(F.col("text"))).otherwise(F.col(f"score_{n}")).cast("float") for n, s in by_name.items()}
            made = whole.withColumns(fresh).select("headline_id", "text_sha256", *[f"score_{n}" for n in store.names])
            rest = scores.join(headlines.select("headline_id"), "headline_id", "left_anti")
            store.commit(rest.select(made.columns).unionByName(made), known)
        scores, _ = store.load()
    return headlines.select("headline_id").join(scores.drop("text_sha256"), "headline_id")
