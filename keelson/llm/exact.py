"""Exact dedup against a minimal perfect hash of historical digests.

Rows are reduced to the SHA-256 of their whole text, numbered and written once. Half of them, by a hash of the row number, are the
history (or an index built earlier is given). The history's distinct digests are dealt into shards of bounded size; the task of a shard
builds a minimal perfect hash over them (:class:`PerfectHash`): a cascade of bit tables, in each of which the keys that are alone at
their place settle, so that a key's slot is the number of set bits before its own, and ``n`` keys fill ``n`` slots. A slot holds the full digest, the locator
of its winner (id and row number) and how many rows had it. Shards and slots are a table in the shared checkpoint folder.

Arrivals are grouped by digest before they are shuffled and look their digest up in the shard: the slot they are led to
holds their digest byte by byte, or they are new. A member joins its slot's group, nonmembers are groups of their own. The row with the largest
id of a group stays.

Rows find their group by a join on the digest. Groups of more than a ``HOT``-th of all rows, of which there are fewer than ``HOT``, are broadcast, so that
no task gets a hot group's rows; the others meet in a shuffle.

Defined results: null counts as the empty text; a null id is smaller than any other, so it stays only where all ids of a group are null; of rows that
share text and id one stays (the last in the written order); an empty table gives an empty table; columns named as in :data:`ADDED` are replaced,
others pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.hashing import mix
from keelson.session import materialize

#: Distinct digests of a shard, about.
SHARD = 200_000
HOT = 1000
#: Bits of a table of the cascade per key that reaches it, and the most tables.
LOAD = 2
LEVELS = 200
ADDED = ("keep_id", "group_size", "kept", "text_sha256")
INDEX = "shard int, shards int, tables array<int>, bits binary, digests binary, ids array<bigint>, places array<bigint>, sizes array<bigint>"
GROUPS = "digest binary, id bigint, place bigint, size bigint, came bigint, fresh boolean"
_DIGEST = 32


class PerfectHash:
    """A minimal perfect hash of distinct 32-byte digests: :meth:`slots` maps ``n`` keys onto ``0 .. n - 1``."""

    def __init__(self, tables: list[int], bits: np.ndarray):
        self.tables, self.bits = tables, bits
        self.rank = np.concatenate(([0], np.cumsum(bits, dtype=np.int64)))

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        """Place of each digest (four 64-bit words) in a table."""
        words = keys[:, level % 4] + keys[:, (level + 1) % 4] * np.uint64(2 * level + 1)
        return (mix(words + np.uint64(level)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, digests: np.ndarray) -> PerfectHash:
        tables, bits = [], [np.zeros(0, bool)]
        rest = digests
        while len(rest):
            if len(tables) == LEVELS:
                raise ArithmeticError("equal digests in the history")
            size = LOAD * len(rest) + 1
            at = cls._place(rest, len(tables), size)
            alone = np.bincount(at, minlength=size) == 1
            tables.append(size)
            bits.append(alone)
            rest = rest[~alone[at]]
        return cls(tables, np.concatenate(bits))

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """The slot each digest is led to; -1 for one that is certainly no key. Others may be led to a key's slot."""
        out = np.full(len(digests), -1, np.int64)
        rest, base = np.arange(len(digests)), 0
        for level, size in enumerate(self.tables):
            at = base + self._place(digests[rest], level, size)
            here = self.bits[at]
            out[rest[here]] = self.rank[at[here]]
            rest, base = rest[~here], base + size
        return out


def _digests(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, _DIGEST // 8)


def _longs(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and whether they are there."""
    return column.fill_null(0).to_numpy().astype(np.int64), column.is_valid().to_numpy()


def digested(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``text_sha256``, of the whole text."""
    return df.withColumn("text_sha256", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def groups_of(rows: DataFrame) -> DataFrame:
    """``digest, id, place, size`` of each distinct digest of ``digest, id, place``: its winner and its number of rows."""
    best = F.max(F.struct("id", "place"))  # null is the smallest
    found = rows.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("size"))
    return found.select("digest", "best.id", "best.place", "size")


def _shard(shards: int):
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int").alias("shard")


def build_index(groups: DataFrame, shards: int) -> DataFrame:
    """The index over distinct digests, a row per shard that has any, written to the shared folder."""

    def build(table: pa.Table) -> pa.Table:
        keys = _digests(table.column("digest"))
        found = PerfectHash.build(keys)
        order = pa.array(np.argsort(found.slots(keys)))
        slots = table.take(order)
        row = {
            "shard": table.column("shard")[0].as_py(),
            "shards": shards,
            "tables": found.tables,
            "bits": np.packbits(found.bits).tobytes(),
            "digests": b"".join(slots.column("digest").to_pylist()),
            **{to: slots.column(c).to_pylist() for c, to in (("id", "ids"), ("place", "places"), ("size", "sizes"))},
        }
        kinds = [pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.binary(), *[pa.list_(pa.int64())] * 3]
        return pa.table([pa.array([v], k) for v, k in zip(row.values(), kinds)], names=list(row))

    sharded = groups.select("digest", "id", "place", "size", _shard(shards))
    return materialize(sharded.groupBy("shard").applyInArrow(build, INDEX), "digest_index")


def look_up(arrivals: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """All groups after ``arrivals`` (one row a digest) met the index: joined members, nonmembers, and slots nobody asked for.

    ``came`` counts the group's arrivals, ``fresh`` says that its winner is one.
    """

    def meet(new: pa.Table, shard: pa.Table) -> pa.Table:
        names = ["digest", "id", "place", "size"]
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        digests = new.column("digest").to_pylist()
        member = np.zeros(len(digests), bool)
        if not shard.num_rows:
            old = pa.table([pa.array([], k) for k in kinds], names=names)
            slot = np.zeros(0, np.int64)
        else:
            row = {c: shard.column(c)[0] for c in shard.column_names}
            tables, held = row["tables"].as_py(), row["digests"].as_py()
            bits = np.unpackbits(np.frombuffer(row["bits"].as_py(), np.uint8), count=sum(tables)).astype(bool)
            slots = np.frombuffer(held, np.uint64).reshape(-1, _DIGEST // 8)
            asked = _digests(new.column("digest"))
            slot = PerfectHash(tables, bits).slots(asked)
            member = slot >= 0
            member[member] = (slots[slot[member]] == asked[member]).all(1)  # every byte
            slot = slot[member]
            old = pa.table(
                [
                    pa.array([held[i : i + _DIGEST] for i in range(0, len(held), _DIGEST)], pa.binary()),
                    *[pa.array(row[c].values, pa.int64()) for c in ("ids", "places", "sizes")],
                ],
                names=names,
            )
        came, stay = new.select(names).filter(pa.array(member)), new.select(names).filter(pa.array(~member))
        there = old.take(pa.array(slot))
        (i, i_is), (j, j_is) = _longs(came.column("id")), _longs(there.column("id"))
        p, q = _longs(came.column("place"))[0], _longs(there.column("place"))[0]
        later = (i_is > j_is) | ((i_is == j_is) & ((i > j) | ((i == j) & (p > q))))
        counts = [_longs(t.column("size"))[0] for t in (came, there, stay)]
        joined = [
            came.column("digest"),
            pa.array(np.where(later, i, j), mask=~np.where(later, i_is, j_is)),
            pa.array(np.where(later, p, q)),
            pa.array(counts[0] + counts[1]),
        ]
        idle = np.ones(old.num_rows, bool)
        idle[slot] = False
        parts = [pa.table(joined, names=names), stay, old.filter(pa.array(idle))]
        out = pa.concat_tables([t.cast(pa.schema(list(zip(names, kinds)))) for t in parts])
        none = np.zeros(parts[2].num_rows, np.int64)
        out = out.append_column("came", pa.array(np.concatenate([counts[0], counts[2], none])))
        return out.append_column("fresh", pa.array(np.concatenate([later, np.ones(stay.num_rows, bool), none > 0])))

    sharded = arrivals.select("digest", "id", "place", "size", _shard(shards))
    return sharded.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(meet, GROUPS)


def mark_repeats(df: DataFrame, doc_id: str = "doc_id", history: DataFrame | None = None) -> DataFrame:
    """``df``, which has ``text_sha256`` (:func:`digested`), with :data:`ADDED`.

    ``history`` is an index of :func:`build_index` over earlier rows: those count in ``group_size``, and where one of them has the largest id, no row of
    ``df`` stays. Without it half of ``df``, by a hash of the row number, is indexed first.
    """
    keep = [c for c in df.columns if c not in ADDED]
    digest = F.unhex("text_sha256").alias("_x_digest")
    number = F.monotonically_increasing_id().alias("_x_place")
    rows = materialize(df.select(*keep, digest, number), "exact_rows")  # numbers are drawn once
    n = rows.count()
    slim = rows.select(F.col("_x_digest").alias("digest"), F.col(doc_id).cast("long").alias("id"), F.col("_x_place").alias("place"))
    old = F.xxhash64("place").bitwiseAND(F.lit(1)) == 0
    own, ours = F.col("came"), F.col("fresh")  # rows of ``df`` in the group, and whether one of them wins
    if history is None:
        own, ours = F.col("size"), F.lit(True)
        shards = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), -(-n // SHARD))
        history, slim = build_index(groups_of(slim.where(old)), shards), slim.where(~old)
    else:
        head = history.select("shards").first()
        shards = head.shards if head else 1
    groups = materialize(look_up(groups_of(slim), history, shards), "exact_groups")
    groups = groups.select(
        F.col("digest").alias("_x_key"),
        F.col("id").alias("keep_id"),
        F.when(ours, F.col("place")).alias("_x_best"),
        F.col("size").alias("group_size"),
        own.alias("_x_own"),
    )
    same = F.col("_x_digest") == F.col("_x_key")
    hot = F.broadcast(groups.where(F.col("_x_own") * HOT > n))  # fewer than HOT, since they hold n rows at most
    found = rows.join(hot, same).unionByName(rows.join(hot, same, "left_anti").join(groups, same))
    return found.select(
        *keep,
        "keep_id",
        "group_size",
        F.coalesce(F.col("_x_place") == F.col("_x_best"), F.lit(False)).alias("kept"),
        F.lower(F.hex("_x_digest")).alias("text_sha256"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mark_repeats(digested(docs.select("doc_id", "text")).drop("text"))


SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WINDOW same AS (PARTITION BY t)
"""
