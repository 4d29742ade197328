"""Near-duplicate components by b-bit MinHash, confirmed on full shingle sets.

1. A task turns whole texts into the set of word shingles (64-bit hashes; five words, unless told otherwise), ``BANDS * ROWS`` minima, one
   key per band of minima, and a packed signature of the low ``BITS`` bits of every minimum.
2. Documents with the same set are one class with a number of its own; only classes go on, so a group of copies
   of any size is one row after the partial aggregate. The text that stands for a class is found again by its id and its 64-bit hash.
3. Classes that share a band key are candidates. Each is paired with the smallest class of its bucket; the
   signatures give the collision-corrected similarity by counting equal low bits, pairs that cannot reach the
   threshold go, and the others are confirmed on full sets.
4. Components of the confirmed links: labels go to neighbours and jump to their label's label until none changes.
5. A bucket whose classes now lie in several components may hold links that the stars missed. Its members are compared
   across components by their signatures, in blocks of bounded size; the full sets of those that may have a link meet in the
   same blocks, and with the links found the components are made again. So every pair that shares a band key is linked, or compared, or already connected.

A pair at the threshold shares one of 24 bands of 4 minima except with probability 3e-8 (threshold 0.85) or 3e-6 (0.8),
and the estimate drops it with less than 1e-9.

Every step's small tables are written to the shared checkpoint folder, which lets skewed joins split. Ids of texts to confirm are
broadcast if there are no more than ``BROADCAST_IDS`` of them; beyond that the texts are joined by a shuffle.

Defined results: a document without words has an empty set, no links, and is a component of its own; a null id counts
as larger than every other and is read back as null; rows that share an id, or have none, are documents of their own, linked by
their texts only; a component is named by its smallest id, and of the rows with that id one is kept; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import NULL_ID, give_back
from keelson.llm.hashing import CHUNK, gram_hashes, mix, word_hashes
from keelson.session import materialize

SHINGLE = 5
BANDS, ROWS, BITS = 24, 4, 4
#: Linked if 100 * intersection >= PERCENT * union.
PERCENT = 80
#: The same for the query.
QUERY_SHINGLE, QUERY_PERCENT = 3, 85
BROADCAST_IDS = 200_000
BLOCK = 512
LANES = 64 // BITS
_RNG = np.random.default_rng(7)
_XOR = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_ODD = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SIGNED = "doc long, mark long, n_shingles long, set_key binary, bands array<long>, sig array<long>"


def least_equal(percent: int) -> int:
    """A pair with fewer equal minima is not confirmed: over 7 standard deviations below a pair at the threshold."""
    p = percent / 100 + (1 - percent / 100) * 2.0**-BITS
    n = BANDS * ROWS
    return math.floor(n * p - 7.4 * math.sqrt(n * p * (1 - p)))


def shingle_sets(texts: list[bytes], n: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, counts = word_hashes([t.lower() for t in texts])
    grams = gram_hashes(words, n)
    out, at = [], 0
    for c in counts.tolist():
        if c >= n:
            out.append(np.unique(grams[at : at + c - n + 1]))
        elif c:  # the whole sequence as one; its length keeps it apart from the shingles
            out.append(mix(gram_hashes(words[at : at + c], c) ^ np.uint64(c)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and packed low bits of the minima, a row for each (non-empty) set."""
    every = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    minima = np.empty((len(sets), BANDS * ROWS), np.uint64)
    for k in range(BANDS * ROWS):
        minima[:, k] = np.minimum.reduceat((every ^ _XOR[k]) * _ODD[k], starts)
    bands = np.empty((len(sets), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(sets), b + 1, np.uint64)
        for r in range(ROWS):
            key = mix(key ^ minima[:, b * ROWS + r])
        bands[:, b] = key
    # The product's high bits decide the minimum; mixing makes its low bits follow all of it.
    low = (mix(minima) & np.uint64((1 << BITS) - 1)).reshape(len(sets), -1, LANES)
    return bands, np.bitwise_or.reduce(low << (np.arange(LANES, dtype=np.uint64) * np.uint64(BITS)), axis=2)


def _runs(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _slices(iterator: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Short batches, so that few texts are Python objects at a time."""
    return (b.slice(at, rows) for b in iterator for at in range(0, b.num_rows, rows))


def _binary(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _set_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _named(doc_id: str, text: str) -> list:
    """``doc`` and ``mark``: the id, and the hash that tells apart texts that share it."""
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("doc"), F.xxhash64(F.col(text)).alias("mark")]


def signed(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per document with the columns of :data:`SIGNED`; empty sets have nulls."""

    def sign(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = pa.list_(pa.int64())
        for batch in _slices(iterator):
            texts = _binary(batch.column(2))
            for a, b in _runs(texts):
                sets = shingle_sets(texts[a:b], shingle)
                full = [i for i, s in enumerate(sets) if len(s)]
                keys: list = [None] * len(sets)
                bands: list = [None] * len(sets)
                sigs: list = [None] * len(sets)
                if full:
                    made = signatures([sets[i] for i in full])
                    for i, band, sig in zip(full, *[m.view(np.int64) for m in made]):
                        keys[i] = _set_key(sets[i])
                        bands[i], sigs[i] = band, sig
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array(keys, pa.binary()), pa.array(bands, longs), pa.array(sigs, longs)],
                    names=["doc", "mark", "n_shingles", "set_key", "bands", "sig"],
                )
        give_back()

    return df.select(*_named(doc_id, text), F.col(text).alias("text")).mapInArrow(sign, SIGNED)


def equal_minima(a: F.Column, b: F.Column) -> F.Column:
    """How many lanes of two packed signatures are equal, by bit counts."""
    ones = int("1" * LANES, 16) if BITS == 4 else sum(1 << (BITS * i) for i in range(LANES))
    ones = ones - (1 << 64) if ones >= 1 << 63 else ones

    def differing(x, y):
        d = x.bitwiseXOR(y)
        fold = d
        for s in range(1, BITS):
            fold = fold.bitwiseOR(F.shiftrightunsigned(d, s))
        return F.bit_count(fold.bitwiseAND(F.lit(ones).cast("long")))

    words = BANDS * ROWS // LANES
    total = F.lit(BANDS * ROWS)
    for w in range(words):
        total = total - differing(F.get(a, F.lit(w)), F.get(b, F.lit(w)))
    return total


def estimate(equal: F.Column) -> F.Column:
    """Similarity estimate, corrected for low bits that are equal by chance."""
    chance = 2.0**-BITS
    return (equal / F.lit(float(BANDS * ROWS)) - chance) / (1 - chance)


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct pairs (a, b) whose signatures allow a link."""
    sig = classes.select("rep", "sig")
    both = pairs.join(sig.withColumnsRenamed({"rep": "a", "sig": "_a"}), "a").join(sig.withColumnsRenamed({"rep": "b", "sig": "_b"}), "b")
    return both.where(equal_minima(F.col("_a"), F.col("_b")) >= least_equal(percent)).select("a", "b")


def full_sets(reps: DataFrame, classes: DataFrame, df: DataFrame, doc_id: str, text: str, shingle: int, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """(rep, shingles) of the classes with the distinct numbers ``rep``, from one of the texts of each."""
    ids = materialize(reps.join(classes.select("rep", "head.doc", "head.mark", "set_key"), "rep"), "confirm_ids")
    n = ids.count()
    docs = df.select(*_named(doc_id, text), F.col(text).alias("text"))
    wanted = docs.join(F.broadcast(ids) if n <= broadcast_ids else ids.hint("shuffle_hash"), ["doc", "mark"])

    def sets(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies of a text under one id
        for batch in _slices(iterator):
            batch = batch.take(pa.array([i for i, r in enumerate(batch.column(0).to_pylist()) if r not in seen], pa.int64()))
            reps, keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), _binary(batch.column(2))
            for a, b in _runs(texts):
                own, found = [], []
                for r, key, s in zip(reps[a:b], keys[a:b], shingle_sets(texts[a:b], shingle)):
                    if r not in seen and _set_key(s) == key:
                        seen.add(r)
                        own.append(r)
                        found.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(found, pa.binary())], names=["rep", "shingles"])
        give_back()

    full = materialize(wanted.select("rep", "set_key", "text").mapInArrow(sets, "rep long, shingles binary"), "shingle_sets")
    if full.count() > n:  # copies in several tasks
        full = materialize(full.dropDuplicates(["rep"]), "shingle_sets_once")
    return full


def confirmed(pairs: DataFrame, classes: DataFrame, df: DataFrame, doc_id: str, text: str, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) that the full sets link."""
    full = full_sets(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct(), classes, df, doc_id, text, shingle)

    def compare(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in iterator:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                if 100 * len(p) < percent * len(q) or not len(p):
                    linked.append(False)
                    continue
                at = np.searchsorted(q, p)
                at[at == len(q)] = 0
                common = int((q[at] == p).sum())
                linked.append(100 * common >= percent * (len(p) + len(q) - common))
            mask = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])
        give_back()

    both = pairs.join(full.withColumnsRenamed({"rep": "a", "shingles": "x"}), "a").join(full.withColumnsRenamed({"rep": "b", "shingles": "y"}), "b")
    return both.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long").distinct()


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable over the undirected links (a, b)."""
    both = materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    # Only nodes that have links take part in the rounds.
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label")), "labels")
    while True:
        lower = both.join(labels.select(F.col("node").alias("a"), "label"), "a").groupBy(F.col("b").alias("node")).agg(F.min("label").alias("low"))
        heard = materialize(labels.join(lower, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "low").alias("label")), "heard")
        jump = heard.select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels = materialize(heard.join(jump, "label", "left").select("node", "old", F.least("label", "next").alias("label")), "labels")
        if labels.where(F.col("label") < F.col("old")).isEmpty():
            break
    done = labels.select("node", "label")
    return nodes.join(done, "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def _cells(iterator: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[list]]]:
    """Runs of rows that agree on the first ``keys`` columns, also over batch borders: key and the other columns."""
    cell, held = None, []
    for batch in iterator:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if row[:keys] != cell:
                if held:
                    yield cell, [list(c) for c in zip(*held)]
                cell, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield cell, [list(c) for c in zip(*held)]


def _maybe(cell: tuple, own: list, label: list, sig: list, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the cell's two blocks, and which pairs of them may be links between components."""
    own, label, sig = np.array(own), np.array(label), np.array(sig, np.int64).view(np.uint64)
    left, right = np.flatnonzero(own == cell[1]), np.flatnonzero(own == cell[2])
    ones = np.uint64(sum(1 << (BITS * k) for k in range(LANES)))
    equal = np.full((len(left), len(right)), BANDS * ROWS)
    for w in range(sig.shape[1]):
        d = sig[left, w][:, None] ^ sig[right, w][None, :]
        fold = d
        for s in range(1, BITS):
            fold = fold | (d >> np.uint64(s))
        equal -= np.bitwise_count(fold & ones)
    return left, right, (equal >= least) & (label[left][:, None] != label[right][None, :])


def _linked(x: list[np.ndarray], y: list[np.ndarray], pairs: np.ndarray, percent: int) -> np.ndarray:
    """Of the marked pairs of sets those that link; intersections come from a product of incidence matrices, by stretches of the words."""
    words = np.unique(np.concatenate([*x, *y]))
    common = np.zeros(pairs.shape, np.float64)  # each stretch's product is exact in single precision, their sum in double
    step = max(1, (8 << 20) // (len(x) + len(y)))

    def incidence(sets: list[np.ndarray], low: int, part: np.ndarray) -> np.ndarray:
        m = np.zeros((len(sets), len(part)), np.float32)
        for i, s in enumerate(sets):
            inside = s[np.searchsorted(s, part[0]) : np.searchsorted(s, part[-1], "right")]
            m[i, np.searchsorted(part, inside)] = 1
        return m

    for low in range(0, len(words), step):
        part = words[low : low + step]
        common += incidence(x, low, part) @ incidence(y, low, part).T
    union = np.array([len(s) for s in x])[:, None] + np.array([len(s) for s in y])[None, :] - common
    return pairs & (100 * common >= percent * union)


def _missed(
    members: DataFrame, labels: DataFrame, classes: DataFrame, df: DataFrame, doc_id: str, text: str, shingle: int, percent: int
) -> DataFrame:
    """Links (a, b) between components inside a bucket, compared in blocks.

    First the signatures say which members may have a link into another component; their full sets then meet in
    the same blocks. A pair is compared in the first band that it shares, and a block emits no more links than join its
    components, so links made do not grow with the pairs. A member is shipped to every block of its bucket: n * n / BLOCK rows for n members.
    """
    least = least_equal(percent)
    marked = materialize(members.join(labels.withColumnRenamed("node", "rep"), "rep"), "bucket_labels")
    mixed = marked.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high")
    mixed = materialize(mixed.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "mixed_buckets")
    rows = marked.join(mixed, "key").join(classes.select("rep", "sig"), "rep")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    # A member meets every block of its bucket: as first block up to its own number, as second from it on.
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "label", "sig", "rep")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))

    def suspects(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, (own, label, sig, rep) in _cells(iterator, 3):
            left, right, maybe = _maybe(cell, own, label, sig, least)
            some = np.unique(np.concatenate([left[maybe.any(axis=1)], right[maybe.any(axis=0)]]))
            if len(some):
                columns = [[v] * len(some) for v in cell] + [[c[r] for r in some] for c in (own, label, rep)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))],
                    names=["key", "i", "j", "own", "label", "rep"],
                )

    found = rows.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(
        suspects, "key long, i int, j int, own int, label long, rep long"
    )
    found = materialize(found, "suspects")
    full = full_sets(found.select("rep").distinct(), classes, df, doc_id, text, shingle)
    rows = found.join(classes.select("rep", "sig", "bands"), "rep").join(full, "rep")
    rows = rows.select("key", "i", "j", "own", "label", "sig", "rep", "bands", "shingles")

    def compare(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, (own, label, sig, rep, bands, shingles) in _cells(iterator, 3):
            left, right, maybe = _maybe(cell, own, label, sig, least)
            bands = np.array(bands, np.int64)
            k = int(np.flatnonzero(bands[0] == cell[0])[0])
            for e in range(k):
                maybe &= bands[left, e][:, None] != bands[right, e][None, :]
            x, y = left[maybe.any(axis=1)], right[maybe.any(axis=0)]
            if not len(x):
                continue
            sets = {r: np.frombuffer(shingles[r], np.uint64) for r in {*x.tolist(), *y.tolist()}}
            maybe = maybe[maybe.any(axis=1)][:, maybe.any(axis=0)]
            yes = _linked([sets[r] for r in x.tolist()], [sets[r] for r in y.tolist()], maybe, percent)
            joins, group = [], {l: l for l in label}
            for p, q in zip(*[v.tolist() for v in np.nonzero(yes)]):
                a, b = int(x[p]), int(y[q])
                u, v = label[a], label[b]
                while group[u] != u:
                    u = group[u]
                while group[v] != v:
                    v = group[v]
                if u != v:
                    group[max(u, v)] = min(u, v)
                    joins.append((rep[a], rep[b]))
            if joins:
                yield pa.RecordBatch.from_arrays([pa.array([j[i] for j in joins], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return rows.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(compare, "a long, b long").distinct()


def _found(df: DataFrame, doc_id: str, text: str, shingle: int, percent: int) -> DataFrame:
    """One row per document: ``doc``, ``mark``, ``n_shingles``, its component's smallest id ``c``, ``kept``."""
    docs = materialize(signed(df, doc_id, text, shingle).withColumn("row", F.monotonically_increasing_id()), "signed")
    head = F.min(F.struct("doc", "row", "mark")).alias("head")
    classes = docs.where("n_shingles > 0").groupBy("set_key").agg(head, F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    # The numbers hold since the table is written once.
    classes = materialize(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    bands = classes.select(F.explode("bands").alias("key"), "rep")
    buckets = bands.groupBy("key").agg(F.min("rep").alias("center"), F.max("rep").alias("last")).where("center < last").select("key", "center")
    members = materialize(bands.join(materialize(buckets, "buckets"), "key"), "bucket_members")
    stars = members.where("center < rep").select(F.col("center").alias("a"), F.col("rep").alias("b")).distinct()
    stars = materialize(_likely(stars, classes, percent), "star_pairs")
    links = materialize(confirmed(stars, classes, df, doc_id, text, shingle, percent), "star_links")
    nodes = classes.select(F.col("rep").alias("node"))
    labels = materialize(components(nodes, links), "star_components")
    more = materialize(_missed(members.select("key", "rep"), labels, classes, df, doc_id, text, shingle, percent), "missed_links")
    if not more.isEmpty():
        labels = materialize(components(nodes, links.union(more)), "components")
    named = materialize(classes.select("set_key", "head", F.col("rep").alias("node")).join(labels, "node").select("set_key", "label", "head"), "class_labels")
    first = named.groupBy("label").agg(F.min("head").alias("first"))
    named = materialize(named.select("set_key", "label").join(first, "label").select("set_key", "first.doc", "first.row"), "component_heads")
    named = named.withColumnsRenamed({"doc": "c", "row": "_first"})
    out = docs.select("doc", "mark", "row", "n_shingles", "set_key").join(named, "set_key", "left")
    kept = F.coalesce(F.col("row") == F.col("_first"), F.lit(True))
    return out.select("doc", "mark", "n_shingles", F.coalesce("c", "doc").alias("c"), kept.alias("kept"))


def near_duplicates(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``."""
    back = lambda c: F.nullif(F.col(c), F.lit(NULL_ID))
    return _found(df, doc_id, text, shingle, percent).select(back("doc").alias("doc_id"), "n_shingles", back("c").alias("component_id"), "kept")


def drop_near_duplicates(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT,
    broadcast_ids: int = BROADCAST_IDS,
) -> DataFrame:
    """The rows of ``df`` that stay: one with the smallest id of each component, all columns unchanged."""
    found = _found(df, doc_id, text, shingle, percent).groupBy(F.col("doc").alias("_n_doc"), F.col("mark").alias("_n_mark"))
    gone = found.agg(F.max("kept").alias("_n_once"), F.min("kept").alias("_n_all")).where("not _n_all").drop("_n_all")
    gone = materialize(gone, "near_duplicates")
    few = gone.count() <= broadcast_ids
    doc, mark = _named(doc_id, text)
    held = lambda t: F.broadcast(t) if few else t.hint("shuffle_hash")
    marked = df.withColumns({"_n_doc": doc, "_n_mark": mark})
    stay = marked.join(held(gone), ["_n_doc", "_n_mark"], "left_anti")
    once = gone.where("_n_once").drop("_n_once")
    if not once.isEmpty():  # equal texts under one id, of which one stays
        stay = stay.unionByName(marked.join(held(once), ["_n_doc", "_n_mark"], "left_semi").dropDuplicates(["_n_doc", "_n_mark"]))
    return stay.drop("_n_doc", "_n_mark")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, shingle=QUERY_SHINGLE, percent=QUERY_PERCENT)


SQL = rf"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {QUERY_SHINGLE - 1}], ' ') AS k
      FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - {QUERY_SHINGLE - 2}))) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {QUERY_PERCENT} * (x.n + y.n - c)),
r AS (SELECT doc_id AS v, doc_id AS c FROM t UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.v)
SELECT t.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.c) AS component_id, t.doc_id = min(r.c) AS kept
FROM t JOIN r ON r.v = t.doc_id LEFT JOIN n ON n.doc_id = t.doc_id GROUP BY t.doc_id
"""
