"""Vectorized 64-bit hashes of words and byte strings, for use inside tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

#: Texts are handled in runs of about this many bytes, so working arrays stay small whatever the text's length.
CHUNK = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_RNG = np.random.default_rng(20240521)
BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole 64-bit value (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> np.ndarray:
    p = np.full(n, BASE, np.uint64)
    if n:
        p[0] = 1
    return np.multiply.accumulate(p)


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each of the disjoint, sorted, non-empty spans of a byte array."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    total = int(lengths.sum())
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    inner = np.arange(total) - np.repeat(first, lengths)
    at = inner + np.repeat(starts, lengths)
    terms = BYTE[buf[at]] * powers(int(lengths.max()))[inner]
    return mix(np.add.reduceat(terms, first) + lengths.astype(np.uint64))


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([True], IS_SPACE[buf], [True])).view(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def _runs(texts: list[bytes]) -> Iterator[list[tuple[int, bytes]]]:
    """Texts, or parts of long ones cut at white space, in runs of about CHUNK bytes."""
    run: list[tuple[int, bytes]] = []
    size = 0
    for i, text in enumerate(texts):
        at = 0
        while True:
            cut = len(text)
            if cut - at > 2 * CHUNK and (m := _SPACE.search(text, at + CHUNK)):
                cut = m.start()
            run.append((i, text[at:cut]))
            size += cut - at
            if size >= CHUNK:
                yield run
                run, size = [], 0
            if cut == len(text):
                break
            at = cut
    if run:
        yield run


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one after the other, and the number of words of each."""
    counts = np.zeros(len(texts), np.int64)
    out = [np.zeros(0, np.uint64)]
    for run in _runs(texts):
        buf = np.frombuffer(b"\n".join([t for _, t in run]), np.uint8)
        starts, ends = word_spans(buf)
        out.append(hash_spans(buf, starts, ends))
        bounds = np.cumsum([len(t) + 1 for _, t in run])
        np.add.at(counts, [i for i, _ in run], np.diff(np.searchsorted(starts, bounds), prepend=0))
    return np.concatenate(out), counts


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` consecutive values (over text borders too: callers leave those out)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    step = 1 << 16  # runs that stay in the processor's cache
    return np.concatenate([_grams(words[a : a + step + n - 1], n) for a in range(0, m, step)])


def _grams(words: np.ndarray, n: int) -> np.ndarray:
    """Doubling: a run of 2k values from two runs of k."""
    m = len(words) - n + 1
    total, done, acc = np.zeros(m, np.uint64), 0, words
    size, factor = 1, int(BASE)
    while True:
        if n & size:
            total = total * np.uint64(factor) + acc[done : done + m]  # factor is BASE ** size
            done += size
        size *= 2
        if size > n:
            return mix(total)
        half = size // 2
        acc = acc[:-half] * np.uint64(factor) + acc[half:]
        factor = factor * factor % (1 << 64)
