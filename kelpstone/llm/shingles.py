"""Weighted word shingles of texts, in bulk, with numpy."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

WORDS = 5
#: Bytes of text that are hashed at a time, and texts at most (their number must fit into 12 bits).
BLOCK, TEXTS = 1 << 20, 4000
#: Document frequencies are counted by 2**DF_BITS hash buckets.
DF_BITS = 20
#: Shingles in less than this share of the documents are rare and weigh most; the heaviest weigh 1 + IDF_GAIN times what a shingle of every document weighs.
RARE, IDF_GAIN = 1e-3, 0.2

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MULTIPLIERS = [_U(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of them at least."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK + (1 << 12))
        made = []
        for x in (_BASE, _INVERSE):
            p = np.full(size, x, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _powers[:] = made
    return _powers[0], _powers[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values, in place."""
    h ^= h >> _U(30)
    h *= _MULTIPLIERS[0]
    h ^= h >> _U(27)
    h *= _MULTIPLIERS[1]
    h ^= h >> _U(31)
    return h


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word (bytes other than white space, A-Z in lower case)."""
    raw = np.frombuffer(data, np.uint8)
    word = ~_SPACE[raw]
    edges = np.flatnonzero(np.diff(word, prepend=False, append=False))
    starts, ends = edges[0::2], edges[1::2]
    powers, inverses = _tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((_LOWER[raw].astype(np.uint64) + _U(1)) * powers[: len(raw)], out=sums[1:])
    return starts, mixed((sums[ends] - sums[starts]) * inverses[starts])


def _long_word_hashes(data: bytes) -> np.ndarray:
    """Hashes of the words of one long text, a block at a time."""
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + BLOCK)
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        out.append(_word_hashes(data[at:end])[1])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def blocks(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, words' texts counted from it, words' hashes) for stretches of texts."""
    held: list[bytes] = []
    size = first = 0

    def flush() -> tuple[int, np.ndarray, np.ndarray]:
        data = b" ".join(held)
        begins = np.cumsum([0, *(len(h) + 1 for h in held)])
        starts, hashes = _word_hashes(data)
        return first, np.searchsorted(begins, starts, side="right") - 1, hashes

    for i, text in enumerate(texts):
        data = (text or "").encode()
        if held and (size + len(data) > BLOCK or len(held) == TEXTS):
            yield flush()
            held, size = [], 0
        if len(data) > BLOCK:
            hashes = _long_word_hashes(data)
            yield i, np.zeros(len(hashes), np.int64), hashes
            continue
        if not held:
            first = i
        held.append(data)
        size += len(data) + 1
    if held:
        yield flush()


def elements(of: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, times), distinct and sorted, from the words of a block. A text of one to four words has one shingle of all of them."""
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    shingle = np.zeros(max(0, n - WORDS + 1), np.uint64)
    for k in range(WORDS):
        for at in range(0, len(shingle), BLOCK):
            to = min(len(shingle), at + BLOCK)
            shingle[at:to] += hashes[at + k : to + k] * _MULTIPLIERS[k]
    if n >= WORDS and of[0] == of[-1]:  # one text: no arrays of owners
        keys = mixed(shingle)
        keys >>= _U(12)
        keys.sort()
        new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        return np.full(len(new), of[0]), keys[new], np.diff(np.append(new, len(keys)))
    whole = of[: max(0, n - WORDS + 1)] == of[WORDS - 1 :]
    owner, shingle = of[: len(whole)][whole], shingle[whole]
    counts = np.bincount(of)
    short = np.flatnonzero((counts > 0) & (counts < WORDS))
    if len(short):
        starts = np.searchsorted(of, short)
        extra = np.array([sum((int(hashes[s + k]) * int(_MULTIPLIERS[k]) for k in range(counts[t])), int(counts[t])) & 0xFFFFFFFFFFFFFFFF for t, s in zip(short, starts, strict=True)], np.uint64)
        owner, shingle = np.concatenate((owner, short)), np.concatenate((shingle, extra))
    # 52 bits of the hash under 12 of the text's number: one sort finds repeats.
    keys = np.sort((owner.astype(np.uint64) << _U(52)) | (mixed(shingle) >> _U(12)))
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    times = np.diff(np.append(new, len(keys)))
    keys = keys[new]
    return (keys >> _U(52)).astype(np.int64), keys & _U((1 << 52) - 1), times


def bucket(shingle: np.ndarray) -> np.ndarray:
    return (shingle >> _U(52 - DF_BITS)).astype(np.int64)


def idf_table(counts: np.ndarray, n_docs: int) -> np.ndarray:
    """Weight factor by bucket: from 1 (in every document) to 1 + IDF_GAIN (rare)."""
    share = np.maximum(counts, 1) / max(1, n_docs)
    return (1 + IDF_GAIN * np.clip(np.log(np.minimum(share, 1.0)) / math.log(RARE), 0, 1)).astype(np.float32)


def weights(shingle: np.ndarray, times: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return (1 + np.log(times.astype(np.float32))) * idf[bucket(shingle)]
