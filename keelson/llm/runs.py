"""Asking the whole corpus about keys: grouped documents, one binary run per group and bucket, bit replies.

Documents are dealt into groups of bounded size by a hash of where the row is stored (file and row number), so equal rows
part too; a table that is not read from files as it is, is written first. For each group a task makes the sorted distinct 64-bit keys it asks about and sends every bucket of the key space one run of them; a task
per bucket sees that part of the key space from all groups and answers with one bit (or a small
number) per key, in the order of the run. Since the keys of a group are a function of its documents, a
reply needs no keys: the asking side makes them again. A key that all documents share is sent once
per group, so no bucket is hot, and both group and bucket counts grow with the input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import NULL_ID
from keelson.session import materialize

GROUP_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20
#: What a row counts beside its text, so that rows without text fill groups too.
ROW_BYTES = 64
GROUP = "_r_group"
REPLIES = f"{GROUP} int, phase int, bucket int, answer binary"
REPLY_SCHEMA = pa.schema([(GROUP, pa.int32()), ("phase", pa.int32()), ("bucket", pa.int32()), ("answer", pa.binary())])


def _place(df: DataFrame) -> Column | None:
    """A hash of each row's file and number in it; none if ``df`` is not a projection or filter of files."""
    try:
        stored = df.metadataColumn("_metadata")
        place = F.xxhash64(stored["file_path"], stored["row_index"])
        df.select(place)
    except AnalysisException:
        return None
    return place


def grouped(df: DataFrame, text: str, group_bytes: int, bucket_bytes: int) -> tuple[DataFrame, int]:
    """``df`` with its group number, one exchange that all passes share, and the number of buckets.

    A row's place is a function of the stored files, so a task that runs again deals its rows as before.
    """
    place = _place(df)
    if place is None:
        df = materialize(df, "rows")
        place = _place(df)
    size = df.agg(F.sum(F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + ROW_BYTES)).first()[0] or 0
    groups, buckets = (max(1, -(-size // n)) for n in (group_bytes, bucket_bytes))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return df.withColumn(GROUP, F.pmod(place, F.lit(groups)).cast("int")).repartition(n, GROUP), buckets


def doc_ids(table: pa.Table, column: str) -> np.ndarray:
    return np.array([NULL_ID if x is None else x for x in table.column(column).to_pylist()], np.int64)


def texts(table: pa.Table, column: str) -> list[bytes]:
    return [x or b"" for x in table.column(column).cast(pa.binary()).to_pylist()]


def cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's part of sorted keys begins, and the end: buckets are ranges of the key space."""
    edges = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)]))


def answers(replies: pa.Table, phase: int) -> dict[int, bytes]:
    """Bucket to answer, of one phase."""
    found = zip(*[replies.column(c).to_pylist() for c in ("phase", "bucket", "answer")])
    return {b: a for p, b, a in found if p == phase}


def read_bits(found: dict[int, bytes], at: np.ndarray) -> np.ndarray:
    """The bit of every key; a bucket that sent nothing says no."""
    out = np.zeros(int(at[-1]), bool)
    for b, answer in found.items():
        n = int(at[b + 1] - at[b])
        out[at[b] : at[b + 1]] = np.unpackbits(np.frombuffer(answer, np.uint8), count=n).view(bool)
    return out


def shared_keys(table: pa.Table) -> pa.Table:
    """One bucket: which keys were sent by two groups, or by one that saw them in two documents.

    ``keys`` are sorted distinct 64-bit numbers, ``twice`` one bit for each.
    """
    groups = table.column(GROUP).to_pylist()
    keys = [np.frombuffer(k, np.uint64) for k in table.column("keys").to_pylist()]
    twice = [np.unpackbits(np.frombuffer(t, np.uint8), count=len(k)) for t, k in zip(table.column("twice").to_pylist(), keys)]
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    ordered = every[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    count = np.add.reduceat(1 + np.concatenate(twice)[order].astype(np.int64), np.flatnonzero(new))
    shared = np.empty(len(every), bool)
    shared[order] = (count > 1)[np.cumsum(new) - 1]
    ends = np.cumsum([len(k) for k in keys])
    rows = [
        (g, np.packbits(shared[e - len(k) : e]).tobytes())
        for g, k, e in zip(groups, keys, ends)
        if shared[e - len(k) : e].any()
    ]
    bucket = table.column("bucket")[0].as_py()
    return pa.Table.from_arrays(
        [pa.array([g for g, _ in rows], pa.int32()), pa.array([1] * len(rows), pa.int32()),
         pa.array([bucket] * len(rows), pa.int32()), pa.array([a for _, a in rows], pa.binary())],
        schema=REPLY_SCHEMA,
    )


def key_runs(group: int, keys: np.ndarray, docs: np.ndarray, buckets: int) -> pa.Table:
    """The runs of a group for ``shared_keys``, from keys and the documents (numbers) they occur in."""
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    new = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(keys)]))[: len(first)] - 1
    twice = docs[first] != docs[last]
    keys = keys[first]
    at = cuts(keys, buckets)
    some = [b for b in range(buckets) if at[b] < at[b + 1]]
    return pa.table(
        {
            "bucket": pa.array(some, pa.int32()),
            GROUP: pa.array([group] * len(some), pa.int32()),
            "keys": pa.array([keys[at[b] : at[b + 1]].tobytes() for b in some], pa.binary()),
            "twice": pa.array([np.packbits(twice[at[b] : at[b + 1]]).tobytes() for b in some], pa.binary()),
        }
    )


RUNS = f"bucket int, {GROUP} int, keys binary, twice binary"
