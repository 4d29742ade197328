"""Runs of periodic words in documents, found through suffix trees.

A run is a stretch of words with smallest period ``q`` and a length of at least ``2 * q`` (and :data:`LEAST`) that no neighbour extends. A
run's words are all covered by :data:`GRAM`-word windows that occur twice in the stretch, so a vectorised pass over word hashes first
finds the stretches covered by repeated windows, and repeats that inside each until nothing falls away; a run lies in one stretch, whole, and its neighbours outside break
it too. Equal hashes of different words only lengthen a stretch.

In a stretch (:class:`SuffixTree`): Ukkonen's trees of its words and of their reversal; the longest common extension of two places is the string
depth of the lowest common ancestor of their leaves, which the minimum over a range of the tree's Euler tour gives in constant time (sparse table). Every run has a
Lyndon root that is the longest Lyndon word at its first place in one of the two orders of the alphabet; those words end at the next
smaller suffix. So there are two candidates a place: the root's length is the period, and it is extended to the right by the tree and to the left by the tree of the
reversal.

A document is one row of one task; its memory is that of the trees of its longest stretch (about 600 bytes a word), one tree at a time.

Defined results: words are compared byte by byte; a null text has no words; a text without runs has null for the greatest run; of runs of one
length the smallest start comes first, then the smallest period; repeated rows are separate; an empty table gives an empty table; columns named as in
:data:`ADDED` are replaced, others pass through.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.llm.common import WORD, give_back, words
from keelson.llm.hashing import gram_hashes, word_hashes

LEAST = 12
#: A run has this many words that recur one period later, or more: ``length - q >= max(12 - q, q) >= 6``.
GRAM = 6
#: Texts are worked on together up to about so many bytes.
BYTES = 1 << 20
ADDED = ("n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
_WORD = re.compile(WORD.encode())


class SuffixTree:
    """Ukkonen's suffix tree of whole numbers from 1 on, closed by a 0 of its own."""

    def __init__(self, symbols: list[int]):
        s = self.symbols = [*symbols, 0]
        n = self.n = len(s)
        first, last, link, child = [0], [0], [0], {}  # edges end before ``last``; a leaf's is open (n)
        width = max(s) + 1
        node, edge, length, left = 0, 0, 0, 0  # the active point, and suffixes still to be inserted
        for i in range(n):
            c = s[i]
            left += 1
            fresh = 0  # inner node made in this step that waits for its link
            while left:
                if not length:
                    edge = i
                key = node * width + s[edge]
                to = child.get(key)
                if to is None:
                    child[key] = len(first)
                    first.append(i)
                    last.append(n)
                    link.append(0)
                    if fresh:
                        link[fresh] = node
                        fresh = 0
                else:
                    start = first[to]
                    span = min(last[to], i + 1) - start
                    if length >= span:
                        edge += span
                        length -= span
                        node = to
                        continue
                    if s[start + length] == c:
                        length += 1
                        if fresh:
                            link[fresh] = node
                        break
                    split = len(first)
                    child[key] = split
                    first += [start, i]
                    last += [start + length, n]
                    link += [0, 0]
                    first[to] = start + length
                    child[split * width + s[start + length]] = to
                    child[split * width + c] = split + 1
                    if fresh:
                        link[fresh] = split
                    fresh = split
                left -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - left + 1
        self._tour(np.array(first), np.array(last), child, width)

    def _tour(self, first: np.ndarray, last: np.ndarray, child: dict[int, int], width: int) -> None:
        """Euler tour in both orders of the alphabet: ranks of the suffixes, and depths between neighbouring leaves."""
        n, nodes = self.n, len(first)
        keys = np.fromiter(child.keys(), np.int64, len(child))
        to = np.fromiter(child.values(), np.int64, len(child))
        parent, symbol = keys // width, keys % width
        self.rank = np.zeros(n, np.int64)
        self.rank_back = np.zeros(n, np.int64)
        for back, rank in ((False, self.rank), (True, self.rank_back)):
            # The closing 0 is the smallest in both orders: a prefix comes before what it begins.
            turned = np.where(symbol > 0, width - symbol, 0) if back else symbol
            order = np.lexsort((turned, parent))
            kids = to[order].tolist()
            at = np.searchsorted(parent[order], np.arange(nodes + 1)).tolist()
            edge = (last - first).tolist()
            leaf_at, between, meet = [], [], 0
            stack = [(0, 0)]
            while stack:
                node, depth = stack.pop()
                if node < 0:  # back at an inner node between two of its children
                    meet = depth
                    continue
                a, b = at[node], at[node + 1]
                if a == b:
                    leaf_at.append(n - depth)
                    between.append(meet)
                    continue
                for j in range(b - 1, a - 1, -1):
                    k = kids[j]
                    stack.append((k, depth + edge[k]))
                    if j > a:
                        stack.append((-1, depth))
            rank[leaf_at] = np.arange(n)
            if not back:
                # What the tour passes between two leaves next to each other is least at their ancestor, so one depth a leaf is kept.
                rows = [np.array(between, np.int32)]
                while 2 << (len(rows) - 1) <= n:
                    half = 1 << (len(rows) - 1)
                    rows.append(np.minimum(rows[-1][:-half], rows[-1][half:]))
                self.least = rows

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Longest common prefix of the suffixes at ``i`` and ``j`` (different places; the closing place has none)."""
        a, b = self.rank[i], self.rank[j]
        lo, hi = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((hi - lo).astype(float))[1] - 1
        out = np.empty(len(lo), np.int64)
        for k in np.unique(level).tolist():
            m = level == k
            row = self.least[k]
            out[m] = np.minimum(row[lo[m]], row[hi[m] - (1 << k)])
        return out


def _next_smaller(rank: np.ndarray) -> np.ndarray:
    """The next place with a smaller rank, for all places but the closing one (which has the smallest)."""
    values = rank.tolist()
    out = [0] * (len(values) - 1)
    stack = [len(values) - 1]
    for i in range(len(values) - 2, -1, -1):
        r = values[i]
        while values[stack[-1]] > r:
            stack.pop()
        out[i] = stack[-1]
        stack.append(i)
    return np.array(out, np.int64)


def maximal_runs(symbols: list[int]) -> np.ndarray:
    """All runs ``(start, length, period)`` of at least two periods, by start, then period."""
    n = len(symbols)
    if n < 2:
        return np.zeros((0, 3), np.int64)
    tree = SuffixTree(symbols)
    place = np.arange(n)
    i = np.concatenate([place, place])
    j = np.concatenate([_next_smaller(tree.rank), _next_smaller(tree.rank_back)])
    fits = j < n
    i, j = i[fits], j[fits]
    right = tree.extension(i, j)
    del tree
    long = right + j - i  # without the extension to the left
    back = SuffixTree(symbols[::-1])
    left = np.zeros(len(i), np.int64)
    m = i > 0
    left[m] = back.extension(n - i[m], n - j[m])
    start, length, period = i - left, long + left, j - i
    found = np.stack([start, period, length], axis=1)[length >= 2 * period]
    return np.unique(found, axis=0)[:, [0, 2, 1]] if len(found) else found


def stretches(hashes: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int]]:
    """Stretches (start, end) inside the parts ``bounds`` cuts, every word of which a repeated window covers."""
    if len(hashes) < GRAM:
        return []
    grams = gram_hashes(hashes, GRAM)
    part = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    while True:
        number = part[: len(grams)]
        at = np.flatnonzero((number >= 0) & (number == part[GRAM - 1 :]))
        order = at[np.lexsort((grams[at], number[at]))]
        same = (grams[order][1:] == grams[order][:-1]) & (number[order][1:] == number[order][:-1])
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        edge = np.zeros(len(hashes) + 1, np.int32)
        edge[order[twice]] += 1
        edge[order[twice] + GRAM] -= 1
        covered = np.cumsum(edge[:-1]) > 0
        new = np.concatenate(([True], (part[1:] != part[:-1]) | (covered[1:] != covered[:-1])))
        now = np.where(covered, np.cumsum(new) - 1, -1)
        if (covered == (part >= 0)).all():
            starts = np.flatnonzero(covered & new)
            ends = np.flatnonzero(covered & np.append(new[1:], True)) + 1
            return list(zip(starts.tolist(), ends.tolist()))
        part = now


def document_runs(found: list[bytes], spans: list[tuple[int, int]]) -> np.ndarray:
    """Runs of a document's words, of :data:`LEAST` words or more, given its stretches."""
    out = [np.zeros((0, 3), np.int64)]
    for a, b in spans:
        numbers: dict[bytes, int] = {}
        runs = maximal_runs([numbers.setdefault(w, len(numbers) + 1) for w in found[a:b]])
        runs = runs[runs[:, 1] >= LEAST]
        out.append(runs + np.array([a, 0, 0]))
    return np.concatenate(out)


def _describe(texts: list[bytes]) -> Iterator[tuple]:
    hashes, counts = word_hashes(texts)
    bounds = np.concatenate(([0], np.cumsum(counts)))
    held: list[list[tuple[int, int]]] = [[] for _ in texts]
    for a, b in stretches(hashes, bounds):
        k = int(np.searchsorted(bounds, a, side="right")) - 1
        held[k].append((a - int(bounds[k]), b - int(bounds[k])))
    del hashes
    for text, n, spans in zip(texts, counts.tolist(), held):
        found = _WORD.findall(text)
        runs = document_runs(found, spans) if spans else np.zeros((0, 3), np.int64)
        best = (None,) * 4
        if len(runs):
            start, length, period = min(runs.tolist(), key=lambda r: (-r[1], r[0], r[2]))
            best = (start, length, period, 1000 * length // period)
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
            np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
            found = [w for w, gone in zip(found, (np.cumsum(edge[:-1]) > 0).tolist()) if not gone]
        listed = "".join(f"{s},{l},{p}\n" for s, l, p in runs.tolist())
        yield n, len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(found)).hexdigest()


def periodic_runs(df: DataFrame, text: str = "text", carry_text: bool = True) -> DataFrame:
    """``df`` with :data:`ADDED`; without ``carry_text`` the text itself is left out."""
    keep = [c for c in df.columns if c not in ADDED and (carry_text or c != text)]
    kinds = [T.LongType()] * 6 + [T.StringType()] * 2
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(c, k) for c, k in zip(ADDED, kinds)])
    arrow = [pa.int64()] * 6 + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(whole.column(len(keep))), 0).to_numpy(zero_copy_only=False))
            cuts = np.flatnonzero(np.diff(sizes // BYTES, prepend=0)) + 1 if len(sizes) else []
            for at, to in zip([0, *cuts], [*cuts, whole.num_rows]):
                b = whole.slice(at, to - at)
                if not b.num_rows:
                    continue
                texts = [t or b"" for t in b.column(len(keep)).cast(pa.binary()).to_pylist()]
                rows = list(zip(*_describe(texts)))
                added = [pa.array(list(v), k) for v, k in zip(rows, arrow)]
                yield pa.record_batch([*(b.column(i) for i in range(len(keep))), *added], names=[*keep, *ADDED])
        give_back()

    return df.select(*keep, F.col(text).alias("_p_text")).mapInArrow(run, schema)


def planted(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with a period written into every tenth text, chosen and shaped by a hash of its id (a null id: unchanged)."""
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    g = F.floor(h / 10)
    w = F.col("_p_words")
    n = F.size(w)
    a = F.pmod(g, n).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8))))).cast("int")
    times = F.ceil((n - a) / p).cast("int")
    again = F.slice(F.flatten(F.array_repeat(F.slice(w, a + 1, p), times)), F.lit(1), n - a)
    changed = F.array_join(F.concat(F.slice(w, F.lit(1), a), again), " ")
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    inner = df.withColumn("_p_words", F.when(chosen, words(F.col(text))))
    return inner.withColumn(text, F.when(n > 0, changed).otherwise(F.col(text))).drop("_p_words")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = periodic_runs(planted(docs), carry_text=False)
    return out.select("doc_id", *ADDED[1:], ADDED[0])
