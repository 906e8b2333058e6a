"""Toxicity by a counterfactual-regularised classifier.

A logistic model over the distinct words of a text. A word's weight is the sum over its features: the word itself and
its prefixes and suffixes of four to six letters. Training minimises log loss with a sparse (L1) penalty and, for every labelled
text that has an identity term, the squared difference between its score and that of the same text with the term swapped for each other term of
its set. The swap term pulls the weights of all terms of a set together, so a neutral mention costs nothing.

Terms that may stand for one another are declared (``IDENTITY_TERMS``, or a caller's sets). Where fewer than ``LEAST_MENTIONS`` of the sampled texts
hold any (invented or unforeseen languages), sets of mentions are found in the sample itself: words about as frequent in texts of label 1 as in others,
put together with those that occur beside them (``mentions``).

Labels come from a bounded sample: at most ``PER_LABEL`` whole texts of each label, chosen by hash and reweighted to
the labels' shares (see ``common.hashed_sample`` for its bytes). Scoring takes whole texts, one pass, no shuffle; word weights are remembered by each worker.

Defined cases: null and empty texts have no words and score as the intercept says; a document without label teaches
nothing; with no labels or one class the score is the share of label 1 (0 without labels); rows that repeat score alike;
an empty table gives no rows; other columns are not touched, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm import common

#: Whole labelled texts of each label that a model learns from at most.
PER_LABEL = 1500
#: Score from which on a text is toxic.
CUT = 0.3
#: Words a worker remembers.
REMEMBERED = 150_000
SLOTS = 1 << 20
WORD = re.compile(r"[^\W\d_]+")
#: Sets of terms that name groups; terms of a set may stand for one another.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("disabled", "deaf", "blind", "elderly", "young"),
    ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"),
    ("juden", "christen", "muslime"), ("juifs", "chrétiens", "musulmans"), ("judíos", "cristianos", "musulmanes"),
)
#: Sampled texts that must hold declared terms, else sets are found; sets found, terms of each, and texts of either label that a found term is in.
LEAST_MENTIONS, FOUND_SETS, FOUND_TERMS, FOUND_TEXTS = 20, 40, 4, 8


def slot(feature: str) -> int:
    return zlib.crc32(feature.encode()) % SLOTS


def features(word: str) -> list[int]:
    found = [slot("w " + word)]
    for n in (4, 5, 6):
        if len(word) > n:
            found += [slot("p " + word[:n]), slot("s " + word[-n:])]
    return found


def words(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


class Model:
    """Intercept and the slots with a weight other than 0."""

    def __init__(self, intercept: float, slots: np.ndarray, weights: np.ndarray):
        self.intercept, self.weights = intercept, dict(zip(slots.tolist(), weights.tolist(), strict=True))
        self.known: dict[str, float] = {}

    def __getstate__(self):
        return self.intercept, self.weights

    def __setstate__(self, state):
        self.intercept, self.weights = state
        self.known = {}

    def word(self, word: str) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in features(word))

    def score(self, text: str | None) -> float:
        own = words(text)
        known = self.known
        for w in own.difference(known):
            known[w] = self.word(w)
        z = self.intercept + sum([known[w] for w in sorted(own) if known[w]])
        if len(known) > REMEMBERED:
            known.clear()
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def mentions(texts: list[set[str]], y: np.ndarray) -> list[tuple[str, ...]]:
    """Sets of words that tell nothing of the label: within a quarter as frequent in either kind of text, and found beside one another."""
    held: dict[str, list[int]] = {}
    for k, own in enumerate(texts):
        for w in own:
            held.setdefault(w, []).append(k)
    ones = max(1, int(y.sum()))
    rest, neutral = max(1, len(y) - ones), []
    for w, where in held.items():
        hit = int(y[where].sum())
        if min(hit, len(where) - hit) >= FOUND_TEXTS and 0.75 <= (hit / ones) / ((len(where) - hit) / rest) <= 1.25:
            neutral.append((-len(where), w))
    neutral = [w for _, w in sorted(neutral)[: FOUND_SETS * FOUND_TERMS * 2]]
    sets, left = [], dict.fromkeys(neutral)
    while left and len(sets) < FOUND_SETS:
        seed = next(iter(left))
        own = set(held[seed])
        near = sorted(((-len(own & set(held[w])) / len(own | set(held[w])), w) for w in left if w != seed))[: FOUND_TERMS - 1]
        sets.append((seed, *(w for _, w in near)))
        for w in sets[-1]:
            del left[w]
    return [x for x in sets if len(x) > 1]


def swapped(texts: list[set[str]], sets) -> dict[tuple[str, str], int]:
    """How many texts hold a term and not the other of its set that may stand for it."""
    set_of: dict[str, list[int]] = {}
    for k, terms in enumerate(sets):
        for t in terms:
            set_of.setdefault(t, []).append(k)
    out: dict[tuple[str, str], int] = {}
    for own in texts:
        for term in own & set_of.keys():
            for k in set_of[term]:
                for other in sets[k]:
                    if other not in own:
                        out[term, other] = out.get((term, other), 0) + 1
    return out


def fit(
    texts: list[str | None], labels: list[int], share: float, l1: float = 2e-4, swap: float = 1.0, rounds: int = 150, least: int = 3, terms=IDENTITY_TERMS
) -> Model:
    """Proximal gradient with momentum. share: of label 1 among all labelled rows; least: texts a feature is in at least."""
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():
        p = float(np.clip(share, 1e-9, 1 - 1e-9)) if len(y) else 1e-9
        return Model(float(np.log(p / (1 - p))), np.array([], np.int64), np.array([]))
    index: dict[str, np.ndarray] = {}  # slots of each word

    def row(own: set[str]) -> np.ndarray:
        for w in own:
            if w not in index:
                index[w] = np.array(features(w), np.int64)
        parts = [index[w] for w in sorted(own)]
        slots, times = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.array([]), np.array([]))
        return slots.astype(np.int32), times.astype(np.int16)

    own_words = [words(t) for t in texts]
    rows = [row(o) for o in own_words]
    declared = {t for own in terms for t in own}
    if sum(not own.isdisjoint(declared) for own in own_words) < LEAST_MENTIONS:
        terms = [*terms, *mentions(own_words, y)]
    swaps = swapped(own_words, terms)
    held = np.bincount(np.concatenate([r[0] for r in rows]), minlength=SLOTS)
    used = np.flatnonzero(held >= least)
    place = np.full(SLOTS, -1, np.int64)
    place[used] = np.arange(len(used))

    def matrix(found: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r = np.repeat(np.arange(len(found), dtype=np.int32), [len(x[0]) for x in found])
        c = place[np.concatenate([x[0] for x in found])].astype(np.int32)
        v = np.concatenate([x[1] for x in found]).astype(np.float32)
        keep = c >= 0
        return r[keep], c[keep], v[keep]

    r, c, v = matrix(rows)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean())) / len(y)
    pairs = []  # a swap changes a score by the weights of its two words alone: columns, their signs, texts
    for (term, other), times in sorted(swaps.items()):
        change = np.bincount(place[features(term)] + 1, minlength=len(used) + 1) - np.bincount(place[features(other)] + 1, minlength=len(used) + 1)
        cols = np.flatnonzero(change[1:])
        if len(cols):
            pairs.append((cols, change[1:][cols].astype(np.float64), times))
    del rows, index, own_words
    # A step for each feature by its own curvature: sums of squares, and length of the longest rows.
    w, b = np.zeros(len(used)), float(np.log(share / (1 - share)))
    length = np.bincount(r, v, minlength=len(y))
    curve = 0.25 * np.bincount(c, weight[r] * v * np.minimum(length[r], 64), minlength=len(used)) + 1e-6
    ahead, t = w.copy(), 1.0
    for _ in range(rounds):
        z = b + np.bincount(r, v * ahead[c], minlength=len(y))
        gap = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        grad = np.bincount(c, v * gap[r], minlength=len(used))
        new = ahead - grad / curve
        new = np.sign(new) * np.maximum(np.abs(new) - l1 / curve, 0)
        if pairs:
            new = _swap_step(new, pairs, swap)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / nt * (new - w), new, nt
        b -= gap.sum() / (0.25 * weight.sum())
    keep = w != 0
    return Model(float(b), used[keep], w[keep])


def _swap_step(w: np.ndarray, pairs: list, strength: float) -> np.ndarray:
    """Minimise half the squared distance to w plus strength/2 times each text's squared score change, swap by swap."""
    w = w.copy()
    for cols, vals, times in pairs:
        by = strength * times
        w[cols] -= by * (vals @ w[cols]) / (1 + by * (vals @ vals)) * vals
    return w


def learn(labelled: DataFrame, per_label: int = PER_LABEL, text: str = "text", label: str = "toxic", **options) -> Model:
    """A model from labelled (text, label in 0, 1). Samples distinct texts by hash, a bounded set a label."""
    rows = labelled.select(F.col(text).alias("text"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1))
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    found = common.hashed_sample(rows, per_label, "label")
    sample = [r for k in sorted(found) for r in found[k]]
    return fit([r["text"] for r in sample], [r["label"] for r in sample], share, **options)


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            score = [model.score(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(score, pa.float64())], names=["row", "score"])
        model.known.clear()  # the worker keeps the broadcast model for as long as it lives

    return run


def score(docs: DataFrame, model: Model, keep: list[Column], text: str = "text") -> DataFrame:
    """row (a struct of the kept columns) and score. The model that is broadcast has at most SLOTS weights."""
    read = docs.select(F.struct(*keep).alias("row"), F.col(text).alias("text"))
    row = read.schema["row"].dataType.simpleString()
    return read.mapInArrow(common.sparing(_scorer(docs.sparkSession.sparkContext.broadcast(model))), f"row {row}, score double")


def with_labels(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """Texts with a label (text, toxic), from rows that aren't held out. Keys that labels repeat count once, with their largest label."""
    own = labels.select(F.col(key).alias("_key"), F.col(label).alias("toxic")).where(~common.held_out(F.col("_key")) & F.col("_key").isNotNull())
    own = common.small(common.saved(own.groupBy("_key").agg(F.max("toxic").alias("toxic")), "labels"))
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(own, F.col("key") == F.col("_key")).select("text", "toxic")


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    with common.Scratch(spark):
        model = learn(with_labels(docs, common.table(spark, sf_dir, "labels")))
    key = F.col("doc_id")
    scored = score(docs, model, [key, common.held_out(key).alias("held_out")]).select("row.*", "score")
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
