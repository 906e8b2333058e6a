"""Word shingles as 64-bit hashes, by array operations over many texts at once."""

from __future__ import annotations

import hashlib
import re

import numpy as np

#: Bytes of text that are hashed together.
CHUNK = 1 << 16
#: Bytes from which on a word is hashed by blake2b: sums modulo 2^64 of long words can be made to meet.
LONG_WORD = 256
_RNG = np.random.default_rng(20240607)
_TABLE = _RNG.integers(0, 2**64, 256, np.uint64) | np.uint64(1)
_P = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_P, -1, 2**64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    if base not in _POWERS or len(_POWERS[base]) < n:
        out = np.full(max(n, CHUNK + 1), base, np.uint64)
        out[0] = 1
        _POWERS[base] = np.multiply.accumulate(out)
    return _POWERS[base][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BLANK = re.compile(rb"[\x20\x09-\x0d]")


def _pieces(raw: bytes):
    """The bytes in pieces of about CHUNK that end behind a word."""
    low = 0
    while low < len(raw):
        found = _BLANK.search(raw, low + CHUNK)
        high = found.end() if found else len(raw)
        yield low, raw[low:high]
        low = high


def _words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word [^\\x20\\x09-\\x0D]+ of lower-cased bytes."""
    hashes, starts = [], []
    for low, part in _pieces(raw):
        data = np.frombuffer(part, np.uint8)
        blank = np.concatenate([[True], (data == 32) | ((data >= 9) & (data <= 13)), [True]])
        edge = np.flatnonzero(blank[1:] != blank[:-1])
        start, stop = edge[::2], edge[1::2]
        long_ = np.flatnonzero(stop - start > LONG_WORD)
        if len(data) <= 2 * CHUNK:
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_TABLE[data] * _powers(_P, len(data)), out=sums[1:])
            found = mix((sums[stop] - sums[start]) * _powers(_INVERSE, len(data) + 1)[start])
        else:  # one word is longer than a piece: the others are hashed apart
            found = np.zeros(len(start), np.uint64)
            for k in np.setdiff1d(np.arange(len(start)), long_):
                own = data[start[k] : stop[k]]
                found[k] = mix(np.array([(_TABLE[own] * _powers(_P, len(own))).sum(dtype=np.uint64)]))[0]
        for k in long_.tolist():
            found[k] = int.from_bytes(hashlib.blake2b(part[start[k] : stop[k]], digest_size=8).digest(), "little")
        hashes.append(found)
        starts.append(start + low)
    return np.concatenate(hashes) if hashes else np.array([], np.uint64), np.concatenate(starts) if starts else np.array([], np.int64)


def _combined(words: list[np.ndarray]) -> np.ndarray:
    h = np.full(len(words[0]), len(words), np.uint64)
    for w in words:
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + w)
    return h


def sets(texts: list[str | None], n: int):
    """For each text the sorted distinct hashes of its n-word shingles; fewer words count as one; no words, none."""
    low = 0
    while low < len(texts):
        parts, size = [], 0
        while low < len(texts) and (not parts or size < CHUNK):
            raw = (texts[low] or "").encode().lower() + b"\n"  # bytes.lower changes A-Z alone
            parts.append(raw)
            size += len(raw)
            low += 1
        words, start = _words(b"".join(parts))
        at = np.searchsorted(start, np.concatenate([[0], np.cumsum([len(p) for p in parts])])).tolist()
        every = _combined([words[k : len(words) - n + 1 + k] for k in range(n)]) if len(words) >= n else np.array([], np.uint64)
        for a, b in zip(at, at[1:], strict=False):
            if b - a >= n:
                found = np.sort(every[a : b - n + 1])
                keep = np.ones(len(found), bool)
                keep[1:] = found[1:] != found[:-1]
                yield found[keep]
            elif b > a:
                yield _combined([words[k : k + 1] for k in range(a, b)])
            else:
                yield np.array([], np.uint64)
