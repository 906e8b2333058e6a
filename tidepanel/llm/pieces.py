"""SentencePiece encoding and decoding of merge-type vocabularies.

A segment's characters are symbols; every adjacent pair whose concatenation is a piece waits in an agenda ordered by
score, ties by place from the left. The best pair is merged, its new neighbours join the agenda, until the agenda
is empty. Symbols that are no piece fall back to bytes.

Texts are cut where no piece of the vocabulary reaches over (``SEGMENTS``, checked against every piece when the model
is loaded; else texts stay whole), so segments are independent and each distinct one is encoded once a worker
while it is remembered. New segments of an Arrow batch have their agendas popped side by side, and are also encoded by
the sentencepiece library: those that begin with the space mark as they are, others behind a prefix that ends in a cut. One text in
``WHOLE_EVERY`` of a batch, its first at least, is also encoded and decoded whole by the library. A difference stops the job.

Defined cases: null text is empty, an empty text has no ids; texts of any length are taken whole; rows that repeat
give the same ids; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm import common

MARK = "▁"
#: Segments a worker remembers in each of two generations; those met again move to the younger one.
REMEMBERED = 110_000
BYTE = re.compile(r"<0x([0-9A-F]{2})>$")
#: Ways to cut a text, finest first; a vocabulary takes the first that cuts none of its pieces.
SEGMENTS = [
    re.compile(rf"{MARK}*[^\W\d_²]+|{MARK}*(?:[^{MARK}\w]|[_²])+|{MARK}*\d|{MARK}+"),
    re.compile(f"{MARK}*[^{MARK}]+|{MARK}+"),
]
LETTER = re.compile(r"[^\W\d_²]")
#: A rank after all others; symbols from which on a segment gets an agenda of its own; segments merged at once.
LATE, LONG, TOGETHER = 1 << 40, 64, 10_000
#: Texts whose new segments are learnt together; every so many texts of a batch one is held whole against the library.
CHUNK, WHOLE_EVERY = 100, 500


class Pieces:
    """A merge-type model: agenda encoding and decoding."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib, n = self.library, self.library.get_piece_size()
        self.pieces = [lib.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i) or lib.is_byte(i))]
        self.id = {self.pieces[i]: i for i in normal}
        places = {x: k for k, x in enumerate(sorted({-lib.get_score(i) for i in normal}))}
        self.rank = {self.pieces[i]: places[-lib.get_score(i)] for i in normal}
        self.bytes = {int(m[1], 16): i for i in range(n) if lib.is_byte(i) and (m := BYTE.match(self.pieces[i]))}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown = lib.unk_id()
        self.names = list(map(str, range(n)))
        self.segment = next((r for r in SEGMENTS if all(r.fullmatch(p) and len(r.findall(p)) == 1 for p in self.id)), None)
        self.char = np.full(0x110000, -1, np.int32)
        for p, i in self.id.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        splits = sorted((self.id[a] << 32 | self.id[b], self.rank[p], i) for p, i in self.id.items() for k in range(1, len(p)) if (a := p[:k]) in self.id and (b := p[k:]) in self.id)
        self.pair, self.pair_rank, self.pair_id = (np.array(x, np.int64) for x in zip(*splits, strict=True))
        self.remembered = REMEMBERED
        self.known: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.respelled: set[str] = set()  # segments that don't decode to themselves (unknown symbols)
        #: What a segment without a mark stands behind in the library's check: a letter, or for letters a letter and a dot.
        self.prefixes = {letter: (p, lib.encode(p)) for letter, p in ((False, "a"), (True, "a."))}

    def merge(self, segment: str) -> list[int]:
        """Ids of one segment by an agenda of its own."""
        symbols: list[str] = list(segment)
        n, rank = len(symbols), self.rank
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(rank[pair], i, pair) for i in range(n - 1) if (pair := symbols[i] + symbols[i + 1]) in rank]
        heapq.heapify(agenda)
        while agenda:
            _, left, pair = heapq.heappop(agenda)
            right = after[left]
            if right >= n or symbols[left] + symbols[right] != pair or not symbols[left]:
                continue  # one of them has merged meanwhile
            symbols[left], symbols[right] = pair, ""
            after[left] = nxt = after[right]
            if nxt < n:
                before[nxt] = left
                if (new := pair + symbols[nxt]) in rank:
                    heapq.heappush(agenda, (rank[new], left, new))
            if (prev := before[left]) >= 0 and (new := symbols[prev] + pair) in rank:
                heapq.heappush(agenda, (rank[new], prev, new))
        ids: list[int] = []
        for s in symbols:
            if s:
                if (found := self.id.get(s)) is not None:
                    ids.append(found)
                elif self.bytes:
                    ids += [self.bytes[b] for b in s.encode()]
                elif not ids or ids[-1] != self.unknown:
                    ids.append(self.unknown)
        return ids

    def _agenda(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of the piece that each pair makes; LATE where it makes none."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        hit = (self.pair[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.pair_rank[at], LATE), self.pair_id[at]

    def merge_all(self, segments: list[str]) -> list[list[int]]:
        """Ids of many segments. All agendas are popped at once: every round merges each segment's best pair."""
        out: list[list[int]] = [[]] * len(segments)
        short = []
        for k, s in enumerate(segments):
            if len(s) > LONG:
                out[k] = self.merge(s)
            else:
                short.append(k)
        for low in range(0, len(short), TOGETHER):
            which = np.array(short[low : low + TOGETHER], np.int64)
            own = [segments[k] for k in which]
            sizes = np.array(list(map(len, own)), np.int64)
            sym = self.char[np.frombuffer("".join(own).encode("utf-32-le"), "<u4")].astype(np.int64)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            if (sym < 0).any():  # characters outside the vocabulary fall back to bytes
                odd = np.minimum.reduceat(sym, starts) < 0
                for k in which[odd]:
                    out[k] = self.merge(segments[k])
                keep = ~odd
                sym, which, sizes = sym[np.repeat(keep, sizes)], which[keep], sizes[keep]
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            if not len(which):
                continue
            last = np.zeros(len(sym), bool)
            last[starts + sizes - 1] = True
            rank, made = self._agenda(sym, np.append(sym[1:], -1))
            rank[last] = LATE
            while len(which):
                best = np.minimum.reduceat(rank << 20 | np.arange(len(sym)), starts)
                done = best >> 20 >= LATE
                if done.any():
                    flat, ends = sym.tolist(), (starts + sizes).tolist()
                    for j in np.flatnonzero(done).tolist():
                        out[which[j]] = flat[starts[j] : ends[j]]
                    keep = np.repeat(~done, sizes)
                    shift = np.cumsum(~keep)
                    at = best[~done] & (1 << 20) - 1
                    at = at - shift[at]
                    sym, rank, made, last = sym[keep], rank[keep], made[keep], last[keep]
                    which, sizes = which[~done], sizes[~done]
                else:
                    at = best & (1 << 20) - 1
                if not len(which):
                    break
                sym[at] = made[at]
                keep = np.ones(len(sym), bool)
                keep[at + 1] = False
                last[at] = last[at + 1]
                at = at - np.arange(len(at))  # one symbol has gone from each segment before
                sym, rank, made, last = sym[keep], rank[keep], made[keep], last[keep]
                sizes = sizes - 1
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                touched = np.concatenate([at, at[at > starts] - 1])
                after = np.minimum(touched + 1, len(sym) - 1)
                rank[touched], made[touched] = self._agenda(sym[touched], sym[after])
                rank[last] = LATE
        return out

    def segments(self, text: str) -> list[str]:
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        return [marked] if self.segment is None else self.segment.findall(marked)

    def spelled(self, ids: list[int]) -> str:
        """What ids stand for, space marks kept; runs of bytes are UTF-8."""
        parts, run = [], bytearray()
        for i in ids:
            if (b := self.byte_of.get(i)) is not None:
                run.append(b)
                continue
            if run:
                parts.append(run.decode("utf-8", "replace"))
                run = bytearray()
            parts.append(" ⁇ " if i == self.unknown else self.pieces[i])
        return "".join([*parts, run.decode("utf-8", "replace")])

    def learn(self, segments: set[str]) -> None:
        """Encode the segments not yet remembered, and hold them against the library."""
        if len(self.known) > self.remembered:
            self.known, self.older = {}, self.known
        new = segments.difference(self.known)
        again = {s for s in new if s in self.older}
        self.known.update((s, self.older[s]) for s in again)
        todo = list(new - again)
        # The library puts a mark before every text: after one, a segment stands as it does here. Others stand behind a prefix.
        before = [None if s[0] == MARK else self.prefixes[LETTER.match(s) is not None] for s in todo]
        theirs = self.library.encode([s[1:].replace(MARK, " ") if p is None else p[0] + s for s, p in zip(todo, before, strict=True)], num_threads=1)
        for s, ids, other, p in zip(todo, self.merge_all(todo), theirs, before, strict=True):
            if ids != other and s != MARK if p is None else p[1] + ids != other:
                raise ValueError(f"the agenda and the sentencepiece library differ on {s!r}: {ids} and {other}")
            if "".join([self.pieces[i] for i in ids]) != s and self.spelled(ids) != s:
                self.respelled.add(s)
            self.known[s] = ",".join([self.names[i] for i in ids])

    def encode(self, text: str) -> tuple[str, str]:
        """Ids joined by commas, and the text that they decode to (each segment's ids were decoded when it was learnt)."""
        segments = self.segments(text)
        self.learn(set(segments))
        return self._joined(segments)

    def _joined(self, segments: list[str]) -> tuple[str, str]:
        known = self.known
        ids = ",".join([known[s] for s in segments])
        if self.respelled and not self.respelled.isdisjoint(segments):
            return ids, self.decode(list(map(int, ids.split(","))))
        return ids, "".join(segments).removeprefix(MARK).replace(MARK, " ")

    def encode_batch(self, texts: list[str]) -> list[tuple[str, str]]:
        """As encode; new segments of CHUNK texts are learnt together, and some whole texts are held against the library."""
        out = []
        for low in range(0, len(texts), CHUNK):
            part = [self.segments(t) for t in texts[low : low + CHUNK]]
            self.learn(set().union(*part))
            out += map(self._joined, part)
        for k in range(0, len(texts), WHOLE_EVERY):
            ids = self.library.encode(texts[k])
            if out[k] != (",".join(map(str, ids)), self.library.decode(ids)):
                raise ValueError(f"the agenda and the sentencepiece library differ on text {k} of a batch")
        return out

    def decode(self, ids: list[int]) -> str:
        return self.spelled(ids).removeprefix(MARK).replace(MARK, " ")


_LOADED: dict[str, Pieces] = {}


def loaded(path: str) -> Pieces:
    """One model a worker process, kept from task to task."""
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def _digests(path: str, remembered: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(path)
        model.remembered = remembered
        for batch in batches:
            counts, ids_sha, decoded_sha = [], [], []
            for ids, decoded in model.encode_batch([t or "" for t in batch.column("text").to_pylist()]):
                counts.append(ids.count(",") + 1 if ids else 0)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())],
                names=[*keep, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def _ids(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(path)
        for batch in batches:
            ids, decoded = [], []
            for joined, text in model.encode_batch([t or "" for t in batch.column("text").to_pylist()]):
                ids.append([int(i) for i in joined.split(",")] if joined else [])
                decoded.append(text)
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], names=[*keep, "ids", "decoded"])

    return run


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids (array of int) and decoded of every document."""
    read = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return read.mapInArrow(common.sparing(_ids(path)), f"key {dict(read.dtypes)['key']}, ids array<int>, decoded string").withColumnRenamed("key", key)


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """key, n_tokens, ids_sha256 and decoded_sha256, without the ids leaving the worker. remembered: segments a worker keeps, memory for time."""
    read = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return read.mapInArrow(common.sparing(_digests(path, remembered)), f"key {dict(read.dtypes)['key']}, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op4_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents"), default_model())
