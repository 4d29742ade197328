"""Substring deduplication of words by difference-cover anchors.

A window is ``length`` consecutive words of a document. Every word covered by a window whose words
also start somewhere in a document with a smaller id is removed.

Windows are not all hashed. With a difference cover D of a period v, any two positions i, j have
an offset below v that brings both onto D modulo v. So each document hashes the anchors, runs of
``length - v + 1`` words, only where they start on D modulo v (6 of 31 positions), and any two equal windows
share an aligned anchor. The corpus is asked which anchors occur in more than one document; those are
extended to the windows that hold them, and only these windows are hashed and compared: the
corpus is asked for each one's smallest document. Both questions go through ``keelson.llm.runs``, so
no group of copies, however large, meets in one task, and a passage costs one key per group of documents.

Windows are compared by 64-bit hashes of 64-bit word hashes within ranges of the key space.

Defined results: a null or blank text has no words; a null id counts as larger than every other; rows with the same id are
never removed for each other; repeated rows are judged one by one; an empty table gives an empty table; columns of the input
that share a name with a result column are replaced by it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.llm import runs
from keelson.llm.common import give_back
from keelson.llm.hashing import gram_hashes, word_hashes
from keelson.llm.runs import GROUP

LENGTH = 50
PERIOD = 31
#: Every number below 31 is a difference of two of these modulo 31.
COVER = (0, 1, 3, 8, 12, 18)
ADDED = ("n_words", "n_removed", "kept_text")
_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b" " * 5)


class _Group:
    """A group's words, anchors and windows, the same in every pass."""

    def __init__(self, table: pa.Table, doc_id: str, text: str, length: int, period: int, cover: tuple[int, ...]):
        self.ids = runs.doc_ids(table, doc_id)
        self.texts = runs.texts(table, text)
        words, self.counts = word_hashes(self.texts)
        self.words, self.length, self.period = words, length, period
        self.starts = np.cumsum(self.counts) - self.counts
        self.doc = np.repeat(np.arange(len(self.ids)), self.counts)
        inner = np.arange(len(words)) - np.repeat(self.starts, self.counts)
        left = np.repeat(self.counts, self.counts) - inner  # words from here to the document's end
        n = length - period + 1
        on = np.isin(inner % period, cover) & (left >= n)
        self.anchor_at = np.flatnonzero(on)
        self.anchors = gram_hashes(words, n)[self.anchor_at]
        self.fits = left >= length

    def windows(self, replies: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, hashes and document ids of the windows that hold a shared anchor."""
        distinct, which = np.unique(self.anchors, return_inverse=True)
        shared = runs.read_bits(runs.answers(replies, 1), runs.cuts(distinct, buckets))[which]
        at = self.anchor_at[shared]
        low = np.maximum(at - (self.period - 1), self.starts[self.doc[at]] if len(at) else at)
        edge = np.zeros(len(self.words) + 1, np.int32)
        np.add.at(edge, low, 1)
        np.add.at(edge, at + 1, -1)
        starts = np.flatnonzero((np.cumsum(edge[:-1]) > 0) & self.fits)
        return starts, self._hash(starts), self.ids[self.doc[starts]]

    def _hash(self, starts: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0, np.uint64)
        breaks = np.flatnonzero(np.diff(starts) > self.length) + 1  # hash stretches of windows, not what lies between
        out = []
        for part in np.split(starts, breaks):
            every = gram_hashes(self.words[part[0] : part[-1] + self.length], self.length)
            out.append(every[part - part[0]])
        return np.concatenate(out)


def smallest(hashes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, each one's smallest id, and the place of every hash among them."""
    distinct, which = np.unique(hashes, return_inverse=True)
    least = np.full(len(distinct), np.iinfo(np.int64).max, np.int64)
    np.minimum.at(least, which, ids)
    return distinct, least, which


def _planes(x: np.ndarray) -> bytes:
    """Eight byte planes, most of them zero: these compress, the numbers side by side don't."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes()


def _from_planes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def _earlier(table: pa.Table) -> pa.Table:
    """One bucket of windows: whether another group has each one in a smaller document."""
    groups = table.column(GROUP).to_pylist()
    keys = [np.frombuffer(k, np.uint64) for k in table.column("keys").to_pylist()]
    mins = [_from_planes(m) for m in table.column("mins").to_pylist()]
    _, least, which = smallest(np.concatenate(keys), np.concatenate(mins))
    before = least[which] < np.concatenate(mins)
    ends = np.cumsum([len(k) for k in keys])
    rows = [(g, np.packbits(before[e - len(k) : e]).tobytes()) for g, k, e in zip(groups, keys, ends) if before[e - len(k) : e].any()]
    bucket = table.column("bucket")[0].as_py()
    return pa.Table.from_arrays(
        [pa.array([g for g, _ in rows], pa.int32()), pa.array([2] * len(rows), pa.int32()),
         pa.array([bucket] * len(rows), pa.int32()), pa.array([a for _, a in rows], pa.binary())],
        schema=runs.REPLY_SCHEMA,
    )


def joined_words(text: bytes) -> bytes:
    """All words of a text, joined by one space."""
    out = text.translate(_SPACES)
    while b"  " in out:
        out = out.replace(b"  ", b" ")
    return out.strip(b" ")


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def dedup_substrings(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    period: int = PERIOD,
    cover: tuple[int, ...] = COVER,
    group_bytes: int = runs.GROUP_BYTES,
    bucket_bytes: int = runs.BUCKET_BYTES,
    finish: Callable[[list[bytes], list[np.ndarray]], dict[str, pa.Array]] | None = None,
    finish_schema: str = "kept_text string",
) -> DataFrame:
    """``df`` with ``n_words``, ``n_removed`` and ``kept_text``: the kept words joined by one space.

    ``finish`` replaces ``kept_text`` by other columns made from the texts and the kept word masks.
    """
    make = finish or (lambda texts, kept: {"kept_text": pa.array([kept_words(t, k).decode() for t, k in zip(texts, kept)], pa.string())})
    added = T.StructType.fromDDL(f"n_words long, n_removed long, {finish_schema}")
    keep = [c for c in df.columns if c not in added.names]
    docs, buckets = runs.grouped(df.select(*keep), text, group_bytes, bucket_bytes)

    def group(table: pa.Table) -> _Group:
        give_back()  # what the group before left
        return _Group(table, doc_id, text, length, period, cover)

    def ask(table: pa.Table) -> pa.Table:
        g = group(table)
        return runs.key_runs(table.column(GROUP)[0].as_py(), g.anchors, g.ids[g.doc[g.anchor_at]], buckets)

    def extend(table: pa.Table, replies: pa.Table) -> pa.Table:
        names, kinds = ["bucket", GROUP, "keys", "mins"], [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        if not table.num_rows or not replies.num_rows:
            return pa.Table.from_arrays([pa.array([], k) for k in kinds], names=names)
        _, hashes, ids = group(table).windows(replies, buckets)
        keys, least, _ = smallest(hashes, ids)
        at = runs.cuts(keys, buckets)
        number = table.column(GROUP)[0].as_py()
        rows = [
            (b, number, keys[at[b] : at[b + 1]].tobytes(), _planes(least[at[b] : at[b + 1]]))
            for b in range(buckets)
            if at[b] < at[b + 1]
        ]
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    def finished(table: pa.Table, replies: pa.Table) -> pa.Table:
        g = group(table)
        removed = np.zeros(len(g.words), bool)
        if replies.num_rows:
            starts, hashes, ids = g.windows(replies, buckets)
            keys, least, which = smallest(hashes, ids)
            earlier = runs.read_bits(runs.answers(replies, 2), runs.cuts(keys, buckets))
            bad = starts[earlier[which] | (least[which] < ids)]
            edge = np.zeros(len(g.words) + 1, np.int32)
            edge[bad] += 1
            np.add.at(edge, bad + length, -1)
            removed = np.cumsum(edge[:-1]) > 0
        kept = np.split(~removed, g.starts[1:]) if len(g.ids) else []
        n_removed = [len(k) - int(k.sum()) for k in kept]
        out = {c: table.column(c) for c in keep}
        out |= {"n_words": pa.array(g.counts, pa.int64()), "n_removed": pa.array(n_removed, pa.int64())}
        return pa.table(out | make(g.texts, kept))

    asked = docs.groupBy(GROUP).applyInArrow(ask, runs.RUNS)
    shared = asked.groupBy("bucket").applyInArrow(runs.shared_keys, runs.REPLIES)
    windows = docs.groupBy(GROUP).cogroup(shared.groupBy(GROUP)).applyInArrow(extend, f"bucket int, {GROUP} int, keys binary, mins binary")
    before = windows.groupBy("bucket").applyInArrow(_earlier, runs.REPLIES)
    schema = T.StructType([df.schema[c] for c in keep] + added.fields)
    return docs.groupBy(GROUP).cogroup(shared.unionByName(before).groupBy(GROUP)).applyInArrow(finished, schema)


def kept_words(text: bytes, kept: np.ndarray) -> bytes:
    if kept.all():
        return joined_words(text)
    return b" ".join([w for w, k in zip(_WORD.findall(text), kept.tolist()) if k])


def digest(texts: list[bytes], kept: list[np.ndarray]) -> dict[str, pa.Array]:
    return {"kept_sha256": pa.array([hashlib.sha256(kept_words(t, k)).hexdigest() for t, k in zip(texts, kept)], pa.string())}


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``df`` with the repeated words taken out of its texts.

    A text that lost words becomes its kept words joined by one space, and ``n_chars``, if there is such a column, its
    length; other rows stay as they are.
    """

    def lost(texts: list[bytes], kept: list[np.ndarray]) -> dict[str, pa.Array]:
        return {"kept_text": pa.array([None if k.all() else kept_words(t, k).decode() for t, k in zip(texts, kept)], pa.string())}

    # Column names of the input that the result needs for itself are out of the way meanwhile.
    names = {c: f"_s{i}_{c}" for i, c in enumerate(df.columns)}
    out = dedup_substrings(df.withColumnsRenamed(names), names[doc_id], names[text], finish=lost)
    changed = {text: F.coalesce("kept_text", names[text])}
    if n_chars in names:
        length = F.length("kept_text").cast(df.schema[n_chars].dataType)
        changed[n_chars] = F.when(F.col("kept_text").isNotNull(), length).otherwise(F.col(names[n_chars]))
    return out.select(*[changed.get(c, F.col(names[c])).alias(c) for c in df.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_substrings(docs, finish=digest, finish_schema="kept_sha256 string")
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL = rf"""
WITH t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + {LENGTH - 1}], ' ')) AS k
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - {LENGTH - 2})) AS i FROM t)),
bad AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first FROM win) WHERE first < doc_id),
gone AS (SELECT doc_id, list(DISTINCT p) AS p FROM (SELECT doc_id, unnest(range(i, i + {LENGTH})) AS p FROM bad) GROUP BY doc_id)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(p), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN p IS NULL THEN w ELSE
         list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(p, x[2])), lambda x: x[1]) END, ' ')) AS kept_sha256
FROM t LEFT JOIN gone ON gone.doc_id = t.doc_id
"""
