"""Nearest neighbours by inner product over balanced posting lists.

Index. Vectors get one more component, ``sqrt(M^2 - |x|^2)`` with M the largest norm, after which the largest inner product is the
smallest distance. Centroids are fitted on a bounded sample (``SAMPLE`` vectors, by hash) by hierarchical balanced
clustering: clusters are split until none is larger than its share. Every vector is indexed: in its nearest list and, near
a boundary, in every list whose centroid is not farther than ``1 + CLOSURE`` times the nearest, up to ``REPLICAS``.

Search. Centroids are searched by a beam over an in-memory neighbour graph. A query reads every list whose
centroid is within ``1 + PRUNE`` times the nearest one's distance, and more if these hold too few vectors: no fixed number of lists.

Lists are dealt into bins of about ``BIN`` vectors, a larger list into several by a hash of the id, and the queries of a bin into
blocks, so neither a hot list nor a popular one meets in one task. A bin keeps each query's ``k`` best, and
these are merged; a bin is read deeper while a query has fewer than ``k`` ids from it, and a query that ends with
fewer than ``k`` reads every list. Scores are recomputed in double precision, component by component, so equal vectors tie exactly.

What is broadcast is the graph and the list-to-bin map, of at most ``MOST_LISTS`` centroids.

Defined results: vectors that are null, zero, hold a null or non-finite component, or have another length than
most vectors take no part, neither do null ids; equal rows are indexed once, rows that repeat an id are one candidate, with its best score; a
query with repeated rows searches with the smallest of its vectors; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keelson.session import materialize

K = 20
EVERY = 20
SAMPLE = 20_000
MOST_LISTS = 2048
REPLICAS = 4
CLOSURE = 0.05
PRUNE = 0.1
#: Added to the distance bounds, as a share of the sample's median distance to its nearest centroid: in a crowd of almost
#: equal vectors the nearest distance is almost nothing, and a ratio alone would read one of the crowd's lists only.
SLACK = 0.07
DEGREE = 24
BIN = 16_384
QUERY_BLOCK = 8192


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :]))


def balanced_centroids(x: np.ndarray, lists: int, seed: int = 5) -> np.ndarray:
    """Centroids of clusters split until each has at most 1.3 times its share of the points.

    A split leaves small clusters too; those under a quarter of the limit are given up to their neighbours.
    """
    rng = np.random.default_rng(seed)
    cap = max(1, int(1.3 * len(x) / lists))
    out, todo = [], [x]
    while todo:
        part = todo.pop()
        ways = min(8, -(-len(part) // cap))
        if ways < 2:
            out.append((part.mean(0), len(part)))
            continue
        c = part[rng.choice(len(part), ways, replace=False)]
        for _ in range(8):
            d = _distances(part, c)
            # Balance: a cluster that is too full looks farther away.
            size = np.bincount(d.argmin(1), minlength=ways)
            near = (d * (0.9 + 0.1 * size * ways / len(part))).argmin(1)
            c = np.array([part[near == k].mean(0) if (near == k).any() else c[k] for k in range(ways)])
        near = _distances(part, c).argmin(1)
        pieces = [part[near == k] for k in range(ways) if (near == k).any()]
        if len(pieces) == 1:  # all alike
            out.append((part.mean(0), len(part)))
        else:
            todo += pieces
    return np.array([c for c, n in out if 4 * n >= min(cap, max(n for _, n in out))])


class Graph:
    """Centroids with links to their nearest neighbours, and a ring that keeps it connected."""

    def __init__(self, centroids: np.ndarray):
        self.c = centroids
        n = len(centroids)
        degree = min(DEGREE, n - 1)
        d = _distances(centroids, centroids)
        np.fill_diagonal(d, np.inf)
        near = np.argsort(d, axis=1)[:, :degree] if degree else np.zeros((n, 0), np.int64)
        ring = np.stack([(np.arange(n) + s) % n for s in (1, n // 2 or 1)], axis=1)
        self.links = np.concatenate([near, ring], axis=1)
        self.slack = 0.0
        self.entries = np.unique(np.linspace(0, n - 1, min(n, 8)).astype(int))

    def nearest(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` nearest centroids found for each row of ``x``: distances, numbers, sorted."""
        n = len(self.c)
        beam = min(beam, n)
        rows = np.arange(len(x))
        found = np.full((len(x), n), np.inf)
        fresh = np.zeros((len(x), n), bool)  # found and not expanded
        found[:, self.entries] = _distances(x, self.c[self.entries])
        fresh[:, self.entries] = True
        width = min(4, n)
        while len(rows):
            f = found[rows]
            worst = np.partition(f, beam - 1, axis=1)[:, beam - 1]
            open_ = np.where(fresh[rows], f, np.inf)
            pick = np.argpartition(open_, width - 1, axis=1)[:, :width]
            best = np.take_along_axis(open_, pick, axis=1)
            go = (best < np.inf) & (best <= worst[:, None])
            alive = go.any(axis=1)
            if not alive.any():
                break
            rows, pick, go = rows[alive], pick[alive], go[alive]
            r, p = rows[np.nonzero(go)[0]], pick[go]
            fresh[r, p] = False
            r2, p2 = np.repeat(r, self.links.shape[1]), self.links[p].ravel()
            new = np.isinf(found[r2, p2])
            flat = np.unique(r2[new] * n + p2[new])
            r2, p2 = flat // n, flat % n
            found[r2, p2] = np.sqrt(((x[r2] - self.c[p2]) ** 2).sum(1))
            fresh[r2, p2] = True
        order = np.argpartition(found, beam - 1, axis=1)[:, :beam]
        d = np.take_along_axis(found, order, axis=1)
        by = np.argsort(d, axis=1, kind="stable")
        return np.take_along_axis(d, by, axis=1), np.take_along_axis(order, by, axis=1)

    def within(self, x: np.ndarray, ratio: float, sizes: np.ndarray, least: int) -> list[np.ndarray]:
        """Of each row the centroids whose distance is at most ``ratio`` times the nearest one's, and
        the next ones until their lists hold ``least`` vectors."""
        out: list = [None] * len(x)
        todo, beam = np.arange(len(x)), 32
        while len(todo):
            d, c = self.nearest(x[todo], beam)
            before = np.cumsum(sizes[c], axis=1) - sizes[c]
            inside = (d <= ratio * d[:, :1] + self.slack) | (before < least)
            done = ~inside[:, -1] if beam < len(self.c) else np.ones(len(todo), bool)
            for i in np.flatnonzero(done):
                out[todo[i]] = c[i][inside[i]]
            todo, beam = todo[~done], 2 * beam
        return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _lifted(x: np.ndarray, most: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(0, most * most - (x * x).sum(1)))
    return np.concatenate([x, rest[:, None]], axis=1)


def usable(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, vec): the vectors that take part."""
    v = F.col("vec")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("vec"))
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull() & fine & F.exists(v, lambda x: x != 0))
    usual = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vec") == (usual["n"] if usual else 0))


def nearest(df: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """The ``k`` largest inner products of each query: ``query_id``, ``rank``, ``vec_id``, ``score``.

    ``df`` and ``queries`` are (id, vec) as :func:`usable` gives them; a query's own id is no candidate.
    """
    spark = df.sparkSession
    df = materialize(df.distinct(), "vectors")
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    n, most = df.agg(F.count(F.lit(1)), F.max(norm)).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = np.array([r[0] for r in df.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vec").collect()])
    dim = sample.shape[1]
    lists = max(1, min(MOST_LISTS, round(n**0.5 / 2), len(sample)))
    graph = Graph(balanced_centroids(_lifted(sample, most), lists))
    graph.slack = SLACK * float(np.median(_distances(_lifted(sample[:2048], most), graph.c).min(1))) + 1e-12

    def index(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in iterator:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                d, c = graph.nearest(_lifted(_matrix(part.column("vec"), dim), most), REPLICAS)
                row, col = np.nonzero(d <= (1 + CLOSURE) * d[:, :1] + graph.slack / 2)
                part = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(c[row, col], pa.int32()), *part.columns], names=["list", "id", "vec"])

    postings = materialize(df.mapInArrow(index, "list int, id long, vec array<double>"), "postings")
    first, shards, at, room = {}, {}, 0, 0
    sizes = dict(postings.groupBy("list").count().collect())  # a row per list
    for number, count in sorted(sizes.items()):
        shards[number] = -(-count // BIN)
        if shards[number] > 1 or count > room:
            first[number], at, room = at, at + shards[number], BIN - count if shards[number] == 1 else 0
        else:
            first[number], room = at - 1, room - count
    held = np.zeros(len(graph.c), np.int64)
    for number in first:
        held[number] = sizes[number]
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))

    def ask(iterator: Iterator[pa.RecordBatch], every: bool = False) -> Iterator[pa.RecordBatch]:
        for batch in iterator:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                q = _matrix(part.column("vec"), dim)
                if every:
                    wanted = [np.arange(len(graph.c))] * len(q)
                else:
                    wanted = graph.within(np.concatenate([q, np.zeros((len(q), 1))], axis=1), 1 + PRUNE, held, 4 * k * REPLICAS)
                bins, rows, chosen = [], [], []
                for i, cells in enumerate(wanted):
                    of: dict[int, list[int]] = {}
                    for c in cells.tolist():
                        for b in range(first[c], first[c] + shards[c]) if c in first else ():
                            of.setdefault(b, []).append(c)
                    bins += of
                    rows += [i] * len(of)
                    chosen += of.values()
                part = part.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bins, pa.int32()), *part.columns, pa.array(chosen, pa.list_(pa.int32()))], names=["bin", "query", "qvec", "lists"]
                )

    # The list-to-bin map as columns: an array indexed by list number.
    size = max(first) + 1
    start = F.array(*[F.lit(first.get(i, 0)) for i in range(size)])
    parts = F.array(*[F.lit(shards.get(i, 1)) for i in range(size)])
    spot = F.get(start, F.col("list")) + F.pmod(F.xxhash64("id"), F.get(parts, F.col("list"))).cast("int")
    stored = postings.withColumn("bin", spot).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(have: pa.Table, want: pa.Table) -> pa.Table:
        have, want = have.combine_chunks(), want.combine_chunks()
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if have.num_rows and want.num_rows:
            vectors, ids, of = _matrix(have.column("vec").chunk(0), dim), have.column("id").to_numpy(), have.column("list").to_numpy()
            name = np.unique(ids, return_inverse=True)[1]
            names = int(name.max()) + 1
            for at in range(0, want.num_rows, 128):
                part = want.slice(at, 128)
                q, number = _matrix(part.column("qvec").combine_chunks(), dim), part.column("query").to_numpy()
                reads = np.zeros((len(q), size), bool)
                for i, chosen in enumerate(part.column("lists").to_pylist()):
                    reads[i, chosen] = True
                score = np.where(reads[:, of] & (number[:, None] != ids[None, :]), q @ vectors.T, -np.inf)
                # A replica or another vector of an id takes a place, so look k times the replicas deep, and twice as deep until
                # k ids are found or the bin is exhausted; the margin is far above rounding.
                deep, open_ = min(k * REPLICAS, score.shape[1]), np.arange(len(q))
                rows, cols = [], []
                while len(open_):
                    some = score if len(open_) == len(q) else score[open_]
                    least = np.partition(some, score.shape[1] - deep, axis=1)[:, -deep]
                    edge = np.where(np.isfinite(least), least - 1e-9 * (most * most + 1), -np.inf)
                    row, col = np.nonzero((some >= edge[:, None]) & np.isfinite(some))
                    sure = some[row, col] >= least[row]
                    ahead = np.unique(row[sure] * names + name[col[sure]]) // names
                    done = (np.bincount(ahead, minlength=len(open_)) >= k) | ~np.isfinite(least) | (deep == score.shape[1])
                    rows.append(open_[row[done[row]]])
                    cols.append(col[done[row]])
                    open_, deep = open_[~done], min(2 * deep, score.shape[1])
                row, col = np.concatenate(rows), np.concatenate(cols)
                exact = np.zeros(len(row))
                for d in range(dim):
                    exact += q[row, d] * vectors[col, d]
                # The best score of each id, then the ids by score.
                order = np.lexsort((-exact, ids[col], row))
                row, exact, own = row[order], exact[order], ids[col][order]
                if len(row):
                    again = np.concatenate(([False], (row[1:] == row[:-1]) & (own[1:] == own[:-1])))
                    row, exact, own = row[~again], exact[~again], own[~again]
                    order = np.lexsort((own, -exact, row))
                    row, exact, own = row[order], exact[order], own[order]
                    place = np.arange(len(row)) - np.searchsorted(row, row)
                    top = place < k
                    for o, v in zip(out, (number[row[top]], own[top], exact[top])):
                        o.append(v)
        return pa.table({n: np.concatenate(o) for n, o in zip(("query_id", "vec_id", "score"), out)})

    def answered(queries: DataFrame, ask) -> DataFrame:
        asked = queries.mapInArrow(ask, "bin int, query long, qvec array<double>, lists array<int>")
        asked = asked.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int"))
        found = stored.groupBy("bin", "block").cogroup(asked.groupBy("bin", "block")).applyInArrow(search, "query_id long, vec_id long, score double")
        best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    best = materialize(answered(queries, ask), "neighbours")
    # Lists full of a few ids leave a query short although they hold enough vectors: it then reads every list.
    whole = df.select("id").distinct().limit(k).count()
    full = best.groupBy(F.col("query_id").alias("id")).count().where(F.col("count") >= whole).select("id")
    short = materialize(queries.join(full, "id", "left_anti").select("id", "vec"), "short_queries")
    if short.isEmpty():
        return best
    again = answered(short, lambda rows: ask(rows, True))
    return best.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").select(best.columns).unionByName(again)


def query(spark, sf_dir: str) -> DataFrame:
    vectors = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    queries = vectors.where(F.col("id") % EVERY == 0).groupBy("id").agg(F.min("vec").alias("vec"))
    return nearest(vectors, queries)
