"""Byte-level deduplication by a distributed, common-prefix-aware merge sort of suffixes.

Every byte covered by a ``LENGTH``-byte string that also starts in a document with a smaller id is removed.

Sorting all suffixes of the corpus would ship fifty times the corpus. Two facts shrink it without loss. A string's
smallest hash of ``GRAM`` consecutive bytes marks a position, its anchor, which equal strings share; so the suffixes
from anchors, each with the few bytes before it that its strings reach back to, hold every string exactly once. And a
string can only repeat in another document if its anchor's hash does; the corpus is asked for those first
(``keelson.llm.runs``).

Sort. A task sorts its group's anchored suffixes, merges equal ones, and exchanges them as front-coded runs: the length
of the prefix shared with the suffix before, and the rest. Each bucket of the hash space combines its runs by a loser tree
that keeps, for every loser, its common prefix with the last winner: longer prefixes win unseen, and only equal ones
are compared, from their known end on. The merged order with its common prefixes then says which suffixes agree far enough,
and with the bytes before them, which strings are equal and where the smallest document is. One mask per suffix goes
back. Equal suffixes of one group are one row, so no group of copies is hot.

Strings are compared by their bytes after the anchor and by a 64-bit hash of the (at most 30) bytes before it.

Defined results: a null text is empty; a null id counts as larger than every other; rows with the same id are never removed for each
other; repeated rows are judged one by one; an empty table gives an empty table; columns of the input that share a
name with a result column are replaced by it.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from keelson.llm import runs
from keelson.llm.hashing import BYTE, gram_hashes, mix
from keelson.llm.runs import GROUP

LENGTH = 50
GRAM = 20
#: Anchors are smallest of so many hashes; a string reaches back at most one less.
SPAN = LENGTH - GRAM + 1
BACK = SPAN - 1
#: A row: the bytes from the anchor on, those before it backwards, and the reach of its strings, lowest and highest.
WIDTH = LENGTH + BACK + 2
SEGMENT = 1 << 18
#: The bits that hold a place in a segment.
_PLACE = np.uint64((1 << 19) - 1)
_POWER = mix(np.arange(1, BACK + 1, dtype=np.uint64)) | np.uint64(1)
SUFFIX_RUNS = f"bucket int, {GROUP} int, prefixes binary, rest binary, mins binary"


def _slide(h: np.ndarray, span: int) -> np.ndarray:
    """Smallest of every ``span`` consecutive values."""
    width = 1
    while 2 * width <= span:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    return h if width == span else np.minimum(h[: len(h) - (span - width)], h[span - width :])


def _in_order(table: pa.Table, doc_id: str, text: str) -> pa.Table:
    """The group's rows by id and text: segments are cut from the group's bytes, so every pass needs one order."""
    ids, texts = runs.doc_ids(table, doc_id).tolist(), runs.texts(table, text)
    return table.take(pa.array(sorted(range(len(ids)), key=lambda i: (ids[i], texts[i])), pa.int64()))


class _Group:
    """A group's bytes, anchor hashes and anchored suffixes, the same in every pass."""

    def __init__(self, table: pa.Table, doc_id: str, text: str):
        self.ids = runs.doc_ids(table, doc_id)
        texts = runs.texts(table, text)
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.buf = np.frombuffer(b"".join(texts), np.uint8)
        self._found = None

    def _stretches(self):
        """(anchor place, first and last start, anchor hash) of every stretch of starts that share an anchor and whose strings
        each lie in one document, found once."""
        if self._found is None:
            parts = [[np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)]]
            for a in range(0, len(self.buf), SEGMENT):
                grams = gram_hashes(BYTE[self.buf[a : a + SEGMENT + LENGTH - 1]], GRAM)
                if len(grams) < SPAN:
                    break
                # A hash's low bits make room for its place, so the smallest is the first of the smallest.
                anchor = _slide((grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64), SPAN) & _PLACE
                whole = self._whole(a, len(anchor))
                first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1]))))
                last = np.concatenate((first[1:], [len(anchor)])) - 1
                first, last = first[whole[first]], last[whole[first]]
                place = anchor[first].astype(np.int64)
                # Smallest hashes crowd at the low end, buckets are ranges.
                parts.append([place + a, first + a, last + a, mix(grams[place])])
            self._found = [np.concatenate(c) for c in zip(*parts)]
        return self._found

    def _whole(self, a: int, n: int) -> np.ndarray:
        """Whether the string at each of ``n`` starts from ``a`` on lies in one document."""
        ends = self.ends[slice(*np.searchsorted(self.ends, [a, a + n + LENGTH], "right"))] - a
        over = np.zeros(n + 1, np.int32)
        np.add.at(over, np.clip(ends - LENGTH + 1, 0, n), 1)
        np.add.at(over, np.clip(ends, 0, n), -1)
        return np.cumsum(over[:-1]) == 0

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchor hashes of the documents, and the documents' ids."""
        _, first, _, keys = self._stretches()
        docs = self.ids[np.searchsorted(self.ends, first, "right")] if len(first) else np.zeros(0, np.int64)
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
        return keys[new], docs[new]

    def suffixes(self, replies: pa.Table, buckets: int) -> "_Suffixes":
        place, first, last, keys = self._stretches()
        distinct, which = np.unique(keys, return_inverse=True)
        some = runs.read_bits(runs.answers(replies, 1), runs.cuts(distinct, buckets))[which]
        return _Suffixes(self, place[some], first[some], last[some], keys[some])


class _Suffixes:
    """Anchored suffixes of a group: anchor place, first and last start of its strings, hash; rows sorted by bucket and bytes."""

    def __init__(self, group: _Group, place: np.ndarray, first: np.ndarray, last: np.ndarray, key: np.ndarray):
        self.first, self.last, self.place, self.key = first, last, place, key
        n = len(group.buf)
        high, low = place - first, place - last
        self.low = low
        rows = np.zeros((len(place), WIDTH), np.uint8)
        if n:
            around = np.concatenate((np.zeros(BACK, np.uint8), group.buf, np.zeros(LENGTH, np.uint8)))
            window = np.lib.stride_tricks.sliding_window_view
            rows[:, :LENGTH] = window(around[BACK:], LENGTH)[place]
            rows[:, :LENGTH] *= np.arange(LENGTH) < (LENGTH - low)[:, None]
            rows[:, LENGTH : LENGTH + BACK] = window(around, BACK)[place][:, ::-1]
            rows[:, LENGTH : LENGTH + BACK] *= np.arange(BACK) < high[:, None]
        rows[:, -2], rows[:, -1] = low + 1, high + 1
        self.rows = rows
        self.ids = group.ids[np.searchsorted(group.ends, place, "right")] if len(place) else np.zeros(0, np.int64)

    def by_bucket(self, buckets: int):
        """(bucket, sorted distinct rows, smallest id of each, members, which row each is) of each bucket that has some."""
        edges = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)
        bucket = np.searchsorted(edges, self.key, "right")
        order = np.argsort(bucket, kind="stable")
        at = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in range(buckets):
            members = order[at[b] : at[b + 1]]
            if len(members):
                flat = np.ascontiguousarray(self.rows[members]).view(f"S{WIDTH}").ravel()
                distinct, which = np.unique(flat, return_inverse=True)
                least = np.full(len(distinct), np.iinfo(np.int64).max, np.int64)
                np.minimum.at(least, which, self.ids[members])
                yield b, distinct.view(np.uint8).reshape(-1, WIDTH), least, members, which


def front_code(rows: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted distinct rows as the lengths of the prefixes shared with the row before, and the rests."""
    shared = np.zeros(len(rows), np.uint8)
    shared[1:] = (rows[1:] != rows[:-1]).argmax(axis=1)
    return shared.tobytes(), zlib.compress(rows[np.arange(rows.shape[1]) >= shared[:, None]].tobytes(), 1)


def front_decode(prefixes: bytes, rest: bytes, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The rows, and the shared prefix lengths."""
    shared = np.frombuffer(prefixes, np.uint8).astype(np.int64)
    own = np.frombuffer(zlib.decompress(rest), np.uint8)
    sizes = width - shared
    offset = np.cumsum(sizes) - sizes
    column = np.arange(width)
    # A byte comes from the last row that spells its column out.
    source = np.where(column >= shared[:, None], np.arange(len(shared))[:, None], 0)
    source = np.maximum.accumulate(source, axis=0)
    return own[offset[source] + column - shared[source]], shared


def merge(found: list[tuple[bytes, list[int]]], width: int = WIDTH) -> tuple[list[int], list[int]]:
    """Order of all rows of sorted runs, and each one's common prefix with the row before it.

    A run is its rows' bytes, one after the other, and the prefixes shared with the row before in the run.
    Rows count through all runs. A loser tree: ``lost[node]`` is the run that lost there, ``lcp[run]`` the prefix its head
    shares with the last row put out. The head with the longer one is smaller; only heads with equal ones are compared, from there on.
    """
    k = len(found)
    size = 1 << max(0, (k - 1).bit_length())
    base, total = [], 0
    for data, shared in found:
        base.append(total)
        total += len(shared)
    counts = [len(shared) for _, shared in found] + [0] * (size - k)
    datas = [data for data, _ in found] + [b""] * (size - k)
    shares = [shared for _, shared in found] + [[]] * (size - k)
    base += [total] * (size - k)
    at = [0] * size
    head: list[bytes | None] = [d[:width] if c else None for d, c in zip(datas, counts)]
    lcp = [0] * size
    lost = [-1] * size

    def play(c: int, node: int) -> int:
        """The winner of ``c`` and the loser kept at ``node``; the other one stays there."""
        o = lost[node]
        a, b = head[c], head[o]
        if b is None:
            return c
        if a is None:
            lost[node] = c
            return o
        p, q = lcp[c], lcp[o]
        if p > q:
            return c
        if p < q:
            lost[node] = c
            return o
        x, y = a[p:], b[p:]
        if x == y:
            lcp[o] = width
            return c
        same = width - (((int.from_bytes(x) ^ int.from_bytes(y)).bit_length() + 7) >> 3)
        if x < y:
            lcp[o] = same
            return c
        lcp[c] = same
        lost[node] = c
        return o

    # Fill the tree: the first runner to reach a node waits there for the other.
    winner = 0
    for run in range(size):
        c, node = run, (run + size) >> 1
        while node and lost[node] >= 0:
            c = play(c, node)
            node >>= 1
        if node:
            lost[node] = c
        else:
            winner = c
    order, prefixes = [], []
    for _ in range(total):
        order.append(base[winner] + at[winner])
        prefixes.append(lcp[winner])
        at[winner] = n = at[winner] + 1
        if n < counts[winner]:
            head[winner] = datas[winner][n * width : (n + 1) * width]
            lcp[winner] = shares[winner][n]
        else:
            head[winner] = None
        node = (winner + size) >> 1
        while node:
            winner = play(winner, node)
            node >>= 1
    return order, prefixes


def earlier(rows: np.ndarray, prefixes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For sorted rows (equal ones adjacent) with their common prefixes: the mask of reaches (anchor less start)
    whose string occurs in a document with a smaller id than the row's."""
    new = prefixes < WIDTH
    which = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    least = np.minimum.reduceat(ids, first)
    distinct, shared = rows[first], prefixes[first]
    low, high = distinct[:, -2].astype(np.int64) - 1, distinct[:, -1].astype(np.int64) - 1
    # Distinct rows that share no anchor with a neighbour have no strings in common with another.
    gram = np.cumsum(shared < GRAM)
    alone = np.bincount(gram)[gram] == 1
    some = np.flatnonzero(~alone)
    every = np.where(alone, least, 0)[which] < ids
    mask = np.where(every, np.uint32((1 << SPAN) - 1), np.uint32(0))
    before = np.zeros(len(some), np.uint64)
    least_at = np.full((len(first), SPAN), np.iinfo(np.int64).max, np.int64)
    for reach in range(SPAN):
        if reach:
            before = before + (distinct[some, LENGTH + reach - 1].astype(np.uint64) + np.uint64(1)) * _POWER[reach - 1]
        inside = (low[some] <= reach) & (reach <= high[some])
        at = some[inside]
        if len(at) < 2:
            least_at[at, reach] = least[at]
            continue
        agree = np.cumsum(shared < LENGTH - reach)[at]  # rows that agree on all bytes the string has after the anchor
        back = mix(before[inside])
        order = np.lexsort((back, agree))
        a, b = agree[order], back[order]
        start = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        best = np.minimum.reduceat(least[at[order]], np.flatnonzero(start))
        least_at[at[order], reach] = best[np.cumsum(start) - 1]
    busy = np.flatnonzero(~alone[which])
    bits = least_at[which[busy]] < ids[busy][:, None]
    mask[busy] = (bits * (np.uint32(1) << np.arange(SPAN, dtype=np.uint32))).sum(axis=1, dtype=np.uint32)
    return mask


def _combine(table: pa.Table) -> pa.Table:
    """One bucket: its runs merged, and the mask of every row sent back to its group."""
    groups = table.column(GROUP).to_pylist()
    decoded = [front_decode(p, r) for p, r in zip(table.column("prefixes").to_pylist(), table.column("rest").to_pylist())]
    ids = np.concatenate([np.frombuffer(zlib.decompress(m), np.int64) for m in table.column("mins").to_pylist()])
    order, prefixes = merge([(rows.tobytes(), shared.tolist()) for rows, shared in decoded])
    order = np.array(order)
    rows = np.concatenate([rows for rows, _ in decoded])
    mask = np.empty(len(order), np.uint32)
    mask[order] = earlier(rows[order], np.array(prefixes), ids[order])
    ends = np.cumsum([len(rows) for rows, _ in decoded])
    out = [(g, mask[e - len(rows) : e]) for g, (rows, _), e in zip(groups, decoded, ends)]
    out = [(g, zlib.compress(m.tobytes(), 1)) for g, m in out if m.any()]
    bucket = table.column("bucket")[0].as_py()
    return pa.Table.from_arrays(
        [pa.array([g for g, _ in out], pa.int32()), pa.array([2] * len(out), pa.int32()),
         pa.array([bucket] * len(out), pa.int32()), pa.array([m for _, m in out], pa.binary())],
        schema=runs.REPLY_SCHEMA,
    )


def dedup_bytes(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    group_bytes: int = runs.GROUP_BYTES,
    bucket_bytes: int = runs.GROUP_BYTES,
    finish=None,
    finish_schema: str = "kept binary",
) -> DataFrame:
    """``df`` with ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept``, the remaining bytes.

    ``finish`` replaces ``kept`` by other columns made from the list of remaining bytes.
    """
    make = finish or (lambda kept: {"kept": pa.array(kept, pa.binary())})
    added = T.StructType.fromDDL(f"n_bytes long, n_removed long, n_spans long, {finish_schema}")
    keep = [c for c in df.columns if c not in added.names]
    docs, buckets = runs.grouped(df.select(*keep), text, group_bytes, bucket_bytes)

    def ask(table: pa.Table) -> pa.Table:
        g = _Group(_in_order(table, doc_id, text), doc_id, text)
        return runs.key_runs(table.column(GROUP)[0].as_py(), *g.anchors(), buckets)

    def send(table: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        if table.num_rows and replies.num_rows:
            number = table.column(GROUP)[0].as_py()
            for b, rows, least, _, _ in _Group(_in_order(table, doc_id, text), doc_id, text).suffixes(replies, buckets).by_bucket(buckets):
                out.append((b, number, *front_code(rows), zlib.compress(least.tobytes(), 1)))
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.Table.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["bucket", GROUP, "prefixes", "rest", "mins"])

    def finished(table: pa.Table, replies: pa.Table) -> pa.Table:
        table = _in_order(table, doc_id, text)
        g = _Group(table, doc_id, text)
        edge = np.zeros(len(g.buf) + 1, np.int32)
        if replies.num_rows:
            s = g.suffixes(replies, buckets)
            masks = runs.answers(replies, 2)
            for b, rows, least, members, which in s.by_bucket(buckets):
                mask = np.frombuffer(zlib.decompress(masks[b]), np.uint32) if b in masks else np.zeros(len(rows), np.uint32)
                own = np.where(least[which] < s.ids[members], np.uint32((1 << SPAN) - 1), mask[which])
                some = np.flatnonzero(own)
                starts = s.place[members[some], None] - np.arange(SPAN)
                gone = (own[some, None] >> np.arange(SPAN, dtype=np.uint32)) & np.uint32(1) != 0
                gone &= (starts >= s.first[members[some], None]) & (starts <= s.last[members[some], None])
                np.add.at(edge, starts[gone], 1)
                np.add.at(edge, starts[gone] + LENGTH, -1)
        removed = np.cumsum(edge[:-1]) > 0
        starts = g.ends - g.sizes
        inner = removed.copy()
        inner[1:] &= ~removed[:-1]
        inner[starts[g.sizes > 0]] = removed[starts[g.sizes > 0]]  # a run does not go on over a document's end
        count = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[np.concatenate(([0], g.ends))])
        kept = [g.buf[a:e][~removed[a:e]].tobytes() for a, e in zip(starts, g.ends)]
        out = {c: table.column(c) for c in keep}
        out |= {"n_bytes": pa.array(g.sizes), "n_removed": pa.array(count(removed)), "n_spans": pa.array(count(inner))}
        return pa.table(out | make(kept))

    asked = docs.groupBy(GROUP).applyInArrow(ask, runs.RUNS)
    shared = asked.groupBy("bucket").applyInArrow(runs.shared_keys, runs.REPLIES)
    sent = docs.groupBy(GROUP).cogroup(shared.groupBy(GROUP)).applyInArrow(send, SUFFIX_RUNS)
    masks = sent.groupBy("bucket").applyInArrow(_combine, runs.REPLIES)
    schema = T.StructType([df.schema[c] for c in keep] + added.fields)
    return docs.groupBy(GROUP).cogroup(shared.unionByName(masks).groupBy(GROUP)).applyInArrow(finished, schema)


def digest(kept: list[bytes]) -> dict[str, pa.Array]:
    return {"kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())}


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_bytes(docs, finish=digest, finish_schema="kept_sha256 string")
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


SQL = f"""
WITH t AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
win AS (SELECT doc_id, i, substr(h, 2 * i + 1, {2 * LENGTH}) AS k
        FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - {LENGTH - 1})) AS i FROM t)),
bad AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first FROM win) WHERE first < doc_id),
step AS (SELECT doc_id, i, i - lag(i) OVER w > {LENGTH} OR lag(i) OVER w IS NULL AS new FROM bad WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
span AS (SELECT doc_id, min(i) AS a, max(i) + {LENGTH} AS e
         FROM (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM step) GROUP BY doc_id, s),
gap AS (SELECT doc_id, coalesce(lag(e) OVER w, 0) AS a, a AS e, 0 AS n, 0 AS s FROM span WINDOW w AS (PARTITION BY doc_id ORDER BY a)
        UNION ALL SELECT doc_id, max(e), NULL, sum(e - a), count(*) FROM span GROUP BY doc_id),
kept AS (SELECT g.doc_id, string_agg(substr(h, 2 * g.a + 1, 2 * (coalesce(g.e, len(h) // 2) - g.a)), '' ORDER BY g.a) AS k, sum(n) AS n, sum(s) AS s
         FROM gap g JOIN t ON t.doc_id = g.doc_id GROUP BY g.doc_id)
SELECT t.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(s, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM t LEFT JOIN kept ON kept.doc_id = t.doc_id
"""
