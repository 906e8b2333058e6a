"""Language identification by a linear-chain conditional random field over words.

Each word of a text gets a label. Emissions come from affixes, letter n-grams and membership in lexicons; learned
transitions tie neighbours, so code-switched texts split into runs. A word's marginal by forward-backward is its
share of each language, and a text's language is the one with the most words in expectation.

Learning: every language there is, at most ``PER_LANGUAGE`` whole texts of each, chosen by hash; more than ``LANGUAGES``
of them are an error, none is left out. Lexicons are the words
typical of a language in them; windows of ``WINDOW`` words are put together from runs of texts of several languages, so
transitions between languages are seen as well as runs. Everything else takes whole texts of all documents, in one
pass without a shuffle. Long texts cost their length; chains of similar length advance together.

Defined cases: a null text or one without a letter is `und` with score 0; ties go to the first language by
code point; without anything to learn from every text is `und`; rows that repeat are labelled alike; an empty table
gives no rows; other columns are not touched.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm import common

#: Whole texts of each language that a model learns from at most, and of all of many languages; languages beyond which
#: an input is refused, for moves between languages cost their square.
PER_LANGUAGE, TEXTS, LANGUAGES = 400, 80_000, 1000
#: Slots of features, fewer for many languages: slots times languages are at most WEIGHTS.
SLOTS, WEIGHTS = 1 << 16, 1 << 24
WINDOW, WINDOWS, EPOCHS, BATCH = 48, 6000, 3, 200
LEXICON = 300
#: Words a worker remembers; words of chains that advance together.
REMEMBERED, TOGETHER = 400_000, 200_000
WORD = re.compile(r"[^\W\d_]+")


def slot(feature: str) -> int:
    return zlib.crc32(feature.encode()) % SLOTS


def features(word: str, lexicon: dict[str, list[int]]) -> list[int]:
    """Slots of affixes of 1 to 4 letters, bigrams and trigrams with edges, and lexicons."""
    edged = f"<{word}>"
    found = {edged[: n + 1] for n in (1, 2, 3, 4)} | {edged[-n - 1 :] for n in (1, 2, 3, 4)}
    found.update(edged[i : i + 2] for i in range(len(edged) - 1))
    found.update(edged[i : i + 3] for i in range(len(edged) - 2))
    return [slot(f) for f in found] + [slot(f"lexicon {k}") for k in lexicon.get(word, ())]


class Model:
    """Weights (SLOTS x labels), log transitions and starts, lexicons."""

    def __init__(self, labels: list[str], weights: np.ndarray, moves: np.ndarray, start: np.ndarray, lexicon: dict[str, list[int]]):
        self.labels, self.weights, self.moves, self.start, self.lexicon = labels, weights, moves, start, lexicon
        self.reset()

    def reset(self) -> None:
        self.place: dict[str, int] = {}
        self.remembered = min(REMEMBERED, 20 * REMEMBERED // max(1, len(self.labels)))
        self.emission = np.zeros((1024, len(self.labels)))

    def __getstate__(self):
        return self.labels, self.weights.astype(np.float32), self.moves, self.start, self.lexicon

    def __setstate__(self, state):
        self.labels, weights, self.moves, self.start, self.lexicon = state
        self.weights = weights.astype(np.float64)
        self.reset()

    def learn_words(self, words: list[str]) -> None:
        """Emissions of words not yet known, as exponentials scaled to a largest of 1."""
        step = max(1, 80_000 // len(self.labels))
        for low in range(0, len(words), step):
            self._learn(words[low : low + step])

    def _learn(self, words: list[str]) -> None:
        found = [features(w, self.lexicon) for w in words]
        starts = np.concatenate([[0], np.cumsum([len(f) for f in found])[:-1]])
        score = np.add.reduceat(self.weights[np.fromiter((s for f in found for s in f), np.int64) % len(self.weights)], starts, axis=0)
        score = np.exp(np.maximum(score - score.max(axis=1, keepdims=True), -30))
        n = len(self.place)
        while len(self.emission) < n + len(words):
            self.emission = np.vstack([self.emission, np.zeros_like(self.emission)])
        self.emission[n : n + len(words)] = score
        self.place.update((w, n + k) for k, w in enumerate(words))

    def shares(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, share of its words in expectation) of each text."""
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        if not self.labels:
            return out
        if len(self.place) > self.remembered:
            self.reset()
        chains, which = [], []
        for k, text in enumerate(texts):
            words = WORD.findall(text.lower()) if text else []
            if any(c.isalpha() for w in words for c in w):
                place = self.place
                self.learn_words(list(set(words).difference(place)))
                chains.append(np.array([place[w] for w in words], np.int32))
                which.append(k)
        order = sorted(range(len(chains)), key=lambda j: len(chains[j]))
        low, together = 0, min(TOGETHER, 4 * TOGETHER // len(self.labels))
        while low < len(order):
            high = low + 1
            while high < len(order) and (high - low + 1) * len(chains[order[high]]) <= together:
                high += 1
            part = order[low:high]
            for j, share in zip(part, self._marginals([chains[j] for j in part]), strict=True):
                best = int(share.argmax())
                out[which[j]] = (self.labels[best], float(min(1.0, share[best])))
            low = high
        return out

    def _marginals(self, chains: list[np.ndarray]) -> np.ndarray:
        """Mean marginals of chains, by forward-backward side by side (sorted by length; shorter ones start later)."""
        n, longest, size = len(chains), len(chains[-1]), len(self.labels)
        index = np.full((longest, n), -1, np.int64)
        for k, c in enumerate(chains):
            index[longest - len(c) :, k] = c
        emit = self.emission[index]
        begins = longest - np.array([len(c) for c in chains])
        live = np.searchsorted(-begins, -np.arange(longest), side="left")  # chains from here on have begun
        moves, start = np.exp(self.moves), np.exp(self.start)
        forward = np.zeros((longest, n, size))
        now = np.ones((n, size))
        for t in range(longest):
            a = live[t]
            now[a:] = now[a:] @ moves
            fresh = begins[a:] == t
            if fresh.any():
                now[a:][fresh] = start
            now[a:] *= emit[t, a:]
            now[a:] /= now[a:].sum(axis=1, keepdims=True)
            forward[t, a:] = now[a:]
        total, back = np.zeros((n, size)), np.ones((n, size))
        for t in range(longest - 1, -1, -1):
            a = live[t]
            both = forward[t, a:] * back[a:]
            total[a:] += both / both.sum(axis=1, keepdims=True)
            back[a:] = (back[a:] * emit[t, a:]) @ moves.T
            back[a:] /= back[a:].sum(axis=1, keepdims=True)
        return total / np.array([len(c) for c in chains])[:, None]


def fit(texts: list[str], languages: list[str], seed: int = 5) -> Model:
    labels = sorted(set(languages), key=lambda x: x.encode())
    size = len(labels)
    at, by, seen = {name: k for k, name in enumerate(labels)}, [[] for _ in labels], {}
    for t, l in zip(texts, languages, strict=True):
        if own := [seen.setdefault(w, w) for w in WORD.findall(t.lower())]:
            by[at[l]].append(own)
    if not size or not any(by):
        return Model([], np.zeros((SLOTS, 0)), np.zeros((0, 0)), np.zeros(0), {})
    counts = [Counter(w for doc in docs for w in doc) for docs in by]
    overall = Counter()
    for c in counts:
        overall.update(c)
    lexicon: dict[str, list[int]] = {}
    for k, c in enumerate(counts):
        typical = sorted(c, key=lambda w: (-c[w] * c[w] / overall[w], w))[:LEXICON]
        for w in typical:
            lexicon.setdefault(w, []).append(k)
    rng = np.random.default_rng(seed)
    have = [k for k in range(size) if by[k]]
    words: dict[str, int] = {}
    windows, together = max(WINDOWS, 30 * len(have)), max(1, min(BATCH, 40 * BATCH // size))
    x = np.zeros((windows, WINDOW), np.int64)
    y = np.zeros((windows, WINDOW), np.int64)
    for r in range(windows):
        # The first languages are a round of all, so that each has windows of its own.
        at, lang = 0, have[rng.integers(len(have))] if len(have) <= 40 else have[r % len(have)]
        while at < WINDOW:
            doc = by[lang][rng.integers(len(by[lang]))]
            run = min(WINDOW - at, int(rng.integers(4, WINDOW + 1)), len(doc))
            s = int(rng.integers(len(doc) - run + 1))
            x[r, at : at + run] = [words.setdefault(w, len(words)) for w in doc[s : s + run]]
            y[r, at : at + run] = lang
            at += run
            lang = have[rng.integers(len(have))]
    found = [features(w, lexicon) for w in words]
    width = np.array([len(f) for f in found])
    begin = np.concatenate([[0], np.cumsum(width)])
    slots_all = SLOTS
    while slots_all * size > WEIGHTS:
        slots_all //= 2
    flat = np.fromiter((s for f in found for s in f), np.int64) % slots_all
    weights, moves, start = np.zeros((slots_all, size)), np.zeros((size, size)), np.zeros(size)
    square = [np.full_like(p, 1e-8) for p in (weights, moves, start)]
    for epoch in range(EPOCHS):
        for rows in np.array_split(rng.permutation(windows), max(1, windows // together)):
            used, place = np.unique(x[rows], return_inverse=True)
            place = place.reshape(len(rows), WINDOW)
            slots = np.concatenate([flat[begin[w] : begin[w + 1]] for w in used])
            starts = np.concatenate([[0], np.cumsum(width[used])[:-1]])
            emit = np.add.reduceat(weights[slots], starts, axis=0)[place]
            g_emit, g_moves, g_start = _gradient(emit, moves, start, y[rows])
            by_word = np.stack([np.bincount(place.ravel(), g_emit[:, :, k].ravel(), minlength=len(used)) for k in range(size)], axis=1)
            touched, back = np.unique(slots, return_inverse=True)
            g = np.stack([np.bincount(back, np.repeat(by_word[:, k], width[used]), minlength=len(touched)) for k in range(size)], axis=1) + 1e-3 * weights[touched]
            square[0][touched] += g * g
            weights[touched] -= 0.2 * g / np.sqrt(square[0][touched])
            for p, grad, s in ((moves, g_moves, square[1]), (start, g_start, square[2])):
                grad = grad + 1e-3 * p
                s += grad * grad
                p -= 0.2 * grad / np.sqrt(s)
    return Model(labels, weights, moves, start, lexicon)


def _gradient(emit: np.ndarray, moves: np.ndarray, start: np.ndarray, y: np.ndarray):
    """Gradients of the mean negative log likelihood of label chains (rows x words), by forward-backward."""
    n, length, size = emit.shape
    e = np.exp(emit - emit.max(axis=2, keepdims=True))
    m = np.exp(moves)
    forward, backward = np.zeros_like(e), np.ones_like(e)
    now = np.exp(start) * e[:, 0]
    forward[:, 0] = now / now.sum(axis=1, keepdims=True)
    for t in range(1, length):
        now = (forward[:, t - 1] @ m) * e[:, t]
        forward[:, t] = now / now.sum(axis=1, keepdims=True)
    for t in range(length - 2, -1, -1):
        now = (backward[:, t + 1] * e[:, t + 1]) @ m.T
        backward[:, t] = now / now.sum(axis=1, keepdims=True)
    share = forward * backward
    share /= share.sum(axis=2, keepdims=True)
    after, before = (e * backward)[:, 1:], forward[:, :-1]
    before = before / ((before @ m) * after).sum(axis=2, keepdims=True)
    pairs = m * (before.reshape(-1, size).T @ after.reshape(-1, size))  # no array of size by size a word
    gold = np.eye(size)[y]
    g_moves = (pairs - np.bincount((y[:, :-1] * size + y[:, 1:]).ravel(), minlength=size * size).reshape(size, size)) / n
    return (share - gold) / n, g_moves, (share[:, 0] - gold[:, 0]).sum(axis=0) / n


def learn(rows: DataFrame, per_language: int = PER_LANGUAGE, text: str = "text", lang: str = "lang") -> Model:
    """A model from (text, lang): distinct whole texts by hash, a bounded set of every language."""
    own = rows.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    many = own.select("lang").distinct().count()
    if many > LANGUAGES:
        raise ValueError(f"{many} languages to learn, {LANGUAGES} are possible; none is dropped in silence")
    found = common.hashed_sample(own, min(per_language, max(1, TEXTS // max(1, many))), "lang")
    sample = [r for name in sorted(found) for r in found[name]]
    return fit([r["text"] for r in sample], [r["lang"] for r in sample])


def _labeller(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = model.shares(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["row", "lang_pred", "score"])

    return run


def label(docs: DataFrame, model: Model, keep: list[Column], text: str = "text") -> DataFrame:
    """The kept columns, lang_pred and score. The model that is broadcast has at most SLOTS weights a language, and WEIGHTS in all."""
    read = docs.select(F.struct(*keep).alias("row"), F.col(text).alias("text"))
    row = read.schema["row"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return read.mapInArrow(common.sparing(_labeller(shared)), f"row {row}, lang_pred string, score double").select("row.*", "lang_pred", "score")


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    key = F.col("doc_id")
    model = learn(docs.where(~common.held_out(key)))
    return label(docs, model, [key, common.held_out(key).alias("held_out")])
