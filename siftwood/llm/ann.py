"""Approximate nearest neighbours over balanced posting lists.

Centroids come from a bounded sample that is halved until its parts are even. Every vector is stored in the list of its
nearest centroid and, near a boundary, in the next ones too. A query walks a neighbour graph of the centroids that each
task holds in memory, and keeps the lists within a distance ratio of its nearest; the ratio is set on the sample
so that it reaches a wanted recall there. Answers come from the lists alone. Neighbouring lists lie together in shards of
bounded size, so a query travels once to a shard however many of its lists it asks; a list that outgrows a shard is
dealt out by rows. Where a list holds many more rows than LIST_ROWS, the task that holds it splits it into lists of
its own by the same rules, so the number of lists follows the rows although the sample is bounded.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textkit import ensure_checkpoint_dir
from .vectors import bounded_sample, cosine, dimensions, matrix, one_per_id, spherical_kmeans, unit, usable

#: Vectors that the centroids and the ratio are fitted on (every vector is indexed), and bytes of them at most.
SAMPLE, SAMPLE_BYTES = 16_000, 128 << 20
#: Rows of a list; a list of several times as many is split where it is held.
LIST_ROWS, SPLIT_FROM = 512, 8
#: Bytes of double precision vectors that a shard should hold, and queries that a task compares with them.
SHARD_BYTES, ASKED_ROWS = 32 << 20, 32_768
#: A vector is also stored in lists at most this much farther than its nearest, and in this many at most.
REPLICA_RATIO, REPLICAS = 1.02, 4
DEGREE = 24
WANTED_RECALL = 0.97


class CentroidGraph:
    """Each centroid's nearest others, walked from fixed entry points."""

    def __init__(self, centroids: np.ndarray, degree: int = DEGREE):
        self.c = centroids
        n = len(centroids)
        near = centroids @ centroids.T
        np.fill_diagonal(near, -np.inf)
        k = min(degree, n - 1)
        own = np.argsort(-near, axis=1, kind="stable")[:, :k] if k else np.zeros((n, 0), int)
        # a ring over all keeps the graph in one piece
        self.next = np.concatenate([own, ((np.arange(n) + 1) % n)[:, None], ((np.arange(n) - 1) % n)[:, None]], axis=1)
        self.entry = np.unique(np.linspace(0, n - 1, min(n, 16)).astype(int))

    def within(self, q: np.ndarray, ratio: float, width: int = 32) -> np.ndarray:
        """Boolean (queries x lists): reached lists whose distance is at most ratio times the least."""
        rows, n = np.arange(len(q)), len(self.c)
        dist = np.full((len(q), n), np.inf)
        opened = np.zeros((len(q), n), bool)
        dist[:, self.entry] = np.sqrt(np.maximum(2 - 2 * q @ self.c[self.entry].T, 0))
        live = rows
        for _ in range(n):
            waiting = np.where(opened[live], np.inf, dist[live])
            pick = waiting.argmin(1)
            best = waiting[np.arange(len(live)), pick]
            # go on while something unopened is within the ratio, or among the nearest few of those seen
            kth = np.partition(dist[live], min(width, n) - 1, axis=1)[:, min(width, n) - 1]
            go = (best < np.inf) & ((best <= ratio * dist[live].min(1)) | (best <= kth))
            live, pick = live[go], pick[go]
            if not len(live):
                break
            opened[live, pick] = True
            to = self.next[pick]
            new = np.sqrt(np.maximum(2 - 2 * np.einsum("qd,qkd->qk", q[live], self.c[to]), 0))
            np.put_along_axis(slab := dist[live], to, new, axis=1)
            dist[live] = slab
        return dist <= ratio * dist.min(1, keepdims=True) + 1e-12


def stored_in(x: np.ndarray, c: np.ndarray, ratio: float = REPLICA_RATIO, most: int = REPLICAS) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of every list that holds a unit vector, nearest first."""
    rows, lists = [], []
    for a in range(0, len(x), 4096):
        dist = np.sqrt(np.maximum(2 - 2 * x[a : a + 4096] @ c.T, 0))
        order = np.argsort(dist, axis=1, kind="stable")[:, : min(most, len(c))]
        r, k = np.nonzero(np.take_along_axis(dist, order, 1) <= ratio * dist.min(1, keepdims=True) + 1e-12)
        rows.append(r + a)
        lists.append(order[r, k])
    return (np.concatenate(rows), np.concatenate(lists)) if rows else (np.zeros(0, int), np.zeros(0, int))


class ListIndex:
    """Centroids, the ratio, and where each list lies: its first shard and the number of shards it is dealt out to."""

    def __init__(self, sample: np.ndarray, rows: int, queries: int, k: int, shard_bytes: int = SHARD_BYTES, list_rows: int = LIST_ROWS):
        lists = max(1, min(rows // list_rows, len(sample) // 16))
        self.centroids = spherical_kmeans(sample, lists, rounds=4)
        self.list_rows = list_rows
        self.ratio = self._ratio(sample, k)
        n, dim = self.centroids.shape
        shard_rows = max(list_rows, shard_bytes // (8 * max(1, dim)))
        home = (sample @ self.centroids.T).argmax(1) if len(sample) else np.zeros(0, int)
        expected = np.bincount(home, minlength=n) / max(1, len(sample)) * rows
        # replicas of one vector mostly lie in one shard and are held once there
        self.first, self.parts = np.zeros(n, int), np.ones(n, int)
        shard, filled = 0, 0.0
        for i, size in enumerate(expected):
            if filled and filled + size > shard_rows:
                shard, filled = shard + 1, 0.0
            self.first[i], self.parts[i] = shard, max(1, math.ceil(size / shard_rows))
            filled += size
            if self.parts[i] > 1:
                shard, filled = shard + int(self.parts[i]), 0.0
        self.shards = int((self.first + self.parts).max())
        # queries of a shard are compared in blocks; how many a shard needs follows from the sample's own ways
        some = sample[:: max(1, len(sample) // 500)]
        row, to = np.nonzero(CentroidGraph(self.centroids).within(some, self.ratio)) if len(some) else (home, home)
        seen = np.unique(row * self.shards + self.first[to]) % self.shards if len(row) else row
        asked = np.bincount(seen, minlength=self.shards)[self.first] / max(1, len(some)) * queries
        self.blocks = np.ones(self.shards, int)
        for i in range(n):
            self.blocks[self.first[i] : self.first[i] + self.parts[i]] = max(1, math.ceil(asked[i] / ASKED_ROWS))

    def _ratio(self, sample: np.ndarray, k: int) -> float:
        """The least ratio with which a few hundred sample vectors find their neighbours within the sample."""
        if len(sample) < 2 or len(self.centroids) == 1:
            return 2.0
        step = max(1, len(sample) // 400)
        some = sample[::step]
        near = some @ sample.T
        near[np.arange(len(some)), np.arange(0, len(sample), step)] = -np.inf
        top = np.argsort(-near, axis=1)[:, :k]
        dist = np.sqrt(np.maximum(2 - 2 * some @ self.centroids.T, 0))
        row, lists = stored_in(sample, self.centroids)
        cut = np.searchsorted(row, np.arange(len(sample) + 1))
        need = np.array([[dist[i, lists[cut[j] : cut[j + 1]]].min() / max(dist[i].min(), 1e-9) for j in top[i]] for i in range(len(some))]).ravel()
        return float(np.quantile(need, WANTED_RECALL)) + 1e-9


def _pairs(rows: np.ndarray, shards: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, shard, lists as an array) with one entry per row and shard."""
    order = np.lexsort((lists, shards, rows))
    rows, shards, lists = rows[order], shards[order], lists[order]
    fresh = np.concatenate([[True], (rows[1:] != rows[:-1]) | (shards[1:] != shards[:-1])]) if len(rows) else np.zeros(0, bool)
    starts = np.flatnonzero(fresh)
    return rows[starts], shards[starts], pa.ListArray.from_arrays(pa.array(np.append(starts, len(rows)), pa.int32()), pa.array(lists, pa.int32()))


def _expanded(col) -> tuple[np.ndarray, np.ndarray]:
    """(row, list), sorted by list."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    lists = col.flatten().to_numpy()
    rows = np.repeat(np.arange(len(col)), col.value_lengths().to_numpy())
    order = np.argsort(lists, kind="stable")
    return rows[order], lists[order]


class _Shard:
    """The lists that one task holds."""

    def __init__(self, y: np.ndarray, y_ids: np.ndarray, k: int, ratio: float, list_rows: int):
        self.y, self.ids, self.k, self.ratio, self.list_rows = unit(y), y_ids, k, ratio, list_rows
        self.found: list[tuple[np.ndarray, np.ndarray]] = []

    def ask(self, x: np.ndarray, x_ids: np.ndarray, q: np.ndarray, held: np.ndarray, split: bool = True) -> None:
        """Compare queries q with the rows of one list; what may be among the k nearest is noted."""
        if split and len(held) > SPLIT_FROM * self.list_rows:
            lists = len(held) // self.list_rows
            c = spherical_kmeans(self.y[held[:: max(1, len(held) // (16 * lists))]], lists, rounds=3)
            row, at = stored_in(self.y[held], c)
            order = np.argsort(at, kind="stable")
            row, bounds = row[order], np.searchsorted(at[order], np.arange(len(c) + 1))
            graph = CentroidGraph(c)
            for a in range(0, len(q), 256):
                near = graph.within(x[q[a : a + 256]], self.ratio)
                for i in np.flatnonzero(near.any(0)):
                    self.ask(x, x_ids, q[a : a + 256][near[:, i]], held[row[bounds[i] : bounds[i + 1]]], False)
            return
        if not len(held):
            return
        for a in range(0, len(q), 512):
            some = q[a : a + 512]
            near = x[some] @ self.y[held].T
            near[x_ids[some][:, None] == self.ids[held][None, :]] = -np.inf
            kth = np.partition(near, max(0, len(held) - self.k), axis=1)[:, max(0, len(held) - self.k)]
            row, col = np.nonzero((near >= kth[:, None] - 1e-12) & (near > -np.inf))
            self.found.append((some[row], held[col]))

    def best(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) of the k nearest noted of each query, ties to the smaller id."""
        if not self.found:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        both = np.unique(np.concatenate([q * len(y) + h for q, h in self.found]))
        q, h = both // len(y), both % len(y)
        score = np.concatenate([cosine(x[q[a : a + 65536]], y[h[a : a + 65536]]) for a in range(0, len(q), 65536)])
        order = np.lexsort((self.ids[h], -score, q))
        q, h, score = q[order], h[order], score[order]
        kept = np.arange(len(q)) - np.searchsorted(q, q) < self.k
        return q[kept], h[kept], score[kept]


def nearest(table: DataFrame, queries, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", sample: int = SAMPLE, shard_bytes: int = SHARD_BYTES, list_rows: int = LIST_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row for which queries (a condition on table) holds, its k nearest other rows.

    score: cosine in double precision of the original vectors; ties go to the smaller id. Vectors that are null, zero or
    hold null or non-finite components take no part; vectors of each length are searched among themselves. Of rows with
    one id one counts (the first in order of the condition, then the vector); null ids take no part. Fewer candidates
    than k: all of them. An empty table gives no rows; other columns are ignored.
    """
    ensure_checkpoint_dir(table.sparkSession)
    flagged = table.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), F.coalesce(queries, F.lit(False)).alias("asks")).where(usable("vec"))
    rows = one_per_id(flagged, "id", "vec", "asks").checkpoint()
    found = [_nearest(rows.where(F.size("vec") == dim), dim, k, sample, shard_bytes, list_rows) for dim in dimensions(rows) or [0]]
    return functools.reduce(DataFrame.unionByName, found)


def _nearest(rows: DataFrame, dim: int, k: int, sample: int, shard_bytes: int, list_rows: int) -> DataFrame:
    spark = rows.sparkSession
    raw = bounded_sample(rows, dim, min(sample, SAMPLE_BYTES // (8 * max(1, dim))))[1]
    n, asking = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("asks"), 1))).first()
    index = ListIndex(unit(raw) if len(raw) else raw, n, asking, k, shard_bytes, list_rows)
    # bounded by the sample: one centroid to 16 rows of it
    shared = spark.sparkContext.broadcast((index.centroids, index.first, index.parts, index.blocks, index.ratio))
    kind = dict(rows.dtypes)["vec"]
    dealt = lambda ids, n: (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % n
    names = ["shard", "block", "id", "vec", "lists"]

    def store(batches):
        c, first, parts, blocks, _ = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, vecs = batch.column(0).to_numpy(), batch.column(1)
            row, lists = stored_in(unit(matrix(vecs, dim)), c)
            row, shard, held = _pairs(row, first[lists] + dealt(ids[row], parts[lists]), lists)
            # a row is held for every block of queries of its shard
            copies = blocks[shard]
            at = np.repeat(np.arange(len(row)), copies)
            block = np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies)
            yield pa.RecordBatch.from_arrays([pa.array(shard[at], pa.int32()), pa.array(block, pa.int32()), pa.array(ids[row[at]]), vecs.take(pa.array(row[at])), held.take(pa.array(at))], names)

    def route(batches):
        c, first, parts, blocks, ratio = shared.value
        graph = CentroidGraph(c)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                ids, vecs = batch.slice(a, 256).column(0).to_numpy(), batch.slice(a, 256).column(1)
                row, lists = np.nonzero(graph.within(unit(matrix(vecs, dim)), ratio))
                n = parts[lists]
                part = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                row, lists = np.repeat(row, n), np.repeat(lists, n)
                row, shard, asked = _pairs(row, first[lists] + part, lists)
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(dealt(ids[row], blocks[shard]), pa.int32()), pa.array(ids[row]), vecs.take(pa.array(row)), asked], names)

    def compare(asked: pa.Table, held: pa.Table) -> pa.Table:
        cols = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if asked.num_rows and held.num_rows:
            ratio = shared.value[4]
            y, x = matrix(held["vec"], dim), matrix(asked["vec"], dim)
            y_ids, x_ids, xu = held["id"].to_numpy(), asked["id"].to_numpy(), unit(x)
            shard = _Shard(y, y_ids, k, ratio, list_rows)
            (q_row, q_list), (h_row, h_list) = _expanded(asked["lists"]), _expanded(held["lists"])
            for i in np.unique(q_list):
                q, h = (r[np.searchsorted(at, i) : np.searchsorted(at, i, "right")] for r, at in ((q_row, q_list), (h_row, h_list)))
                shard.ask(xu, x_ids, q, h)
            q, h, score = shard.best(x, y)
            cols = [x_ids[q], y_ids[h], score]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    schema = f"shard int, block int, id long, vec {kind}, lists array<int>"
    asked = rows.where("asks").select("id", "vec").mapInArrow(route, schema).groupBy("shard", "block")
    held = rows.select("id", "vec").mapInArrow(store, schema).groupBy("shard", "block")
    # a vector that is stored in lists of several shards comes back from each
    found = asked.cogroup(held).applyInArrow(compare, "query_id long, vec_id long, score double").distinct()
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
