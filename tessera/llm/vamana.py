"""Approximate nearest neighbours by cosine: robust-pruned directed graphs, one per shard, searched by beam.

Vectors of one direction are one node that carries its smallest ids, so large groups of copies neither fill a graph's
edges nor a task. Nodes are numbered by their smallest id. Nodes are hashed into shards of about ``shard_rows``. A task holds one shard: it builds the
graph in batches (greedy searches on the graph so far propose neighbours; pruning keeps a candidate only if no
kept neighbour is ``alpha`` times nearer to it; edges are added back and pruned again) and then streams every
query through a beam search. The best of all shards are ranked by the cosine in double precision on the
original vectors.

Every query visits every shard, so the search part costs queries times shards; with a fixed set of queries it grows with
the rows, with a fixed share of them as queries with their square.

Defined results: null, zero, empty and non-finite vectors take no part, nor do rows without an id; vectors
are compared with those of their own dimension only; a row repeated with the same id and vector counts once;
ties among the nodes found go to the smaller id (a beam holds ``search_beam`` nodes, so of more directions than that at
one distance, in one shard, some are not seen); queries get fewer rows when there are fewer candidates; empty tables give empty
results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

BLOCK = 256


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distance of unit vectors: a (r, d) to b (r, c, d)."""
    return np.maximum(2.0 - 2.0 * np.matmul(b, a[:, :, None])[:, :, 0], 0.0)


class Graph:
    """A robust-pruned graph over unit vectors."""

    def __init__(self, x: np.ndarray, degree: int = 24, beam: int = 48, alpha: float = 1.2, seed: int = 5):
        self.x = np.ascontiguousarray(x, np.float32)
        self.n, self.degree, self.beam, self.alpha = len(x), degree, beam, alpha
        rng = np.random.default_rng(seed)
        self.edges = np.full((self.n, degree), -1, np.int32)
        if self.n <= beam:  # the start set below is then the whole shard
            self.starts = np.arange(self.n)
            return
        centre = self.x.mean(0)
        self.starts = np.unique(np.append(rng.choice(self.n, min(12, self.n), replace=False), np.argmax(self.x @ centre)))
        half = degree // 2
        self.edges[:, :half] = rng.integers(0, self.n, (self.n, half))
        for a in (1.0, alpha):
            order = rng.permutation(self.n)
            for k in range(0, self.n, BLOCK):
                self._insert(order[k : k + BLOCK], a)

    def _insert(self, points: np.ndarray, alpha: float) -> None:
        found, _, visited = self.search(self.x[points], self.beam, trace=True)
        candidates = np.concatenate([found, visited, self.edges[points]], 1)
        self.edges[points] = new = self._prune(points, candidates, alpha)
        targets, sources = new.ravel(), np.repeat(points, self.degree)
        sources, targets = sources[targets >= 0], targets[targets >= 0]
        by = np.argsort(targets, kind="stable")
        sources, targets = sources[by], targets[by]
        first = np.searchsorted(targets, targets)
        place = np.arange(len(targets)) - first
        width = 32
        for k in range(0, int(place.max(initial=-1)) + 1, width):
            part = (place >= k) & (place < k + width)
            nodes, row = np.unique(targets[part], return_inverse=True)
            added = np.full((len(nodes), width), -1, np.int32)
            added[row, place[part] - k] = sources[part]
            have = np.concatenate([self.edges[nodes], added], 1)
            for a in range(0, len(nodes), BLOCK):
                self.edges[nodes[a : a + BLOCK]] = self._prune(nodes[a : a + BLOCK], have[a : a + BLOCK], alpha)

    def _prune(self, points: np.ndarray, candidates: np.ndarray, alpha: float) -> np.ndarray:
        candidates = np.sort(candidates, 1)
        candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
        candidates[candidates == points[:, None]] = -1
        xc = self.x[candidates]
        left = _distances(self.x[points], xc)
        own = left.copy()
        left[candidates < 0] = np.inf
        out = np.full((len(points), self.degree), -1, np.int32)
        rows = np.arange(len(points))
        for k in range(self.degree):
            pick = left.argmin(1)
            open_rows = np.isfinite(left[rows, pick])
            if not open_rows.any():
                break
            out[open_rows, k] = candidates[open_rows, pick[open_rows]]
            near = _distances(xc[rows, pick], xc) * alpha <= own
            left[near] = np.inf
            left[rows, pick] = np.inf
        return out

    def search(self, q: np.ndarray, beam: int, width: int = 4, trace: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, distances, expanded ids) of the ``beam`` nearest found for each query; -1 fills up."""
        size, n, x, edges = len(q), self.n, self.x, self.edges
        q = np.ascontiguousarray(q, np.float32)
        beam = max(beam, len(self.starts))
        ids = np.full((size, beam), -1, np.int32)
        dist = np.full((size, beam), np.inf, np.float32)
        done = np.ones((size, beam), bool)
        seen = np.zeros((size, n + 1), bool)  # the last column takes the fillers
        s = len(self.starts)
        ids[:, :s] = self.starts
        dist[:, :s] = np.maximum(2 - 2 * (q @ x[self.starts].T), 0)
        done[:, :s] = False
        seen[:, self.starts] = True
        visited = []
        rows = np.arange(size)
        width = min(width, beam)
        while len(rows):
            open_dist = np.where(done[rows], np.inf, dist[rows])
            pick = np.argpartition(open_dist, width - 1, 1)[:, :width]
            going = np.isfinite(np.take_along_axis(open_dist, pick, 1))
            alive = going.any(1)
            if not alive.any():
                break
            rows, pick, going = rows[alive], pick[alive], going[alive]
            nodes = np.where(going, np.take_along_axis(ids[rows], pick, 1), -1)
            done[rows[:, None], pick] = True
            if trace:
                v = np.full((size, width), -1, np.int32)
                v[rows] = nodes
                visited.append(v)
            near = np.where(nodes[:, :, None] >= 0, edges[nodes], -1).reshape(len(rows), -1)
            near.sort(1)
            fresh = near >= 0
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
            fresh &= ~seen[rows[:, None], near]
            seen[rows[:, None], near] = True
            d = _distances(q[rows], x[near]).astype(np.float32)
            d[~fresh] = np.inf
            all_d = np.concatenate([dist[rows], d], 1)
            all_i = np.concatenate([ids[rows], np.where(fresh, near, -1)], 1)
            all_done = np.concatenate([done[rows], ~fresh], 1)
            best = np.argpartition(all_d, beam - 1, 1)[:, :beam]
            dist[rows] = np.take_along_axis(all_d, best, 1)
            ids[rows] = np.take_along_axis(all_i, best, 1)
            done[rows] = np.take_along_axis(all_done, best, 1)
        order = np.lexsort((ids, dist), 1)
        return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1), np.concatenate(visited, 1) if visited else np.zeros((size, 0), np.int32)


def valid(vec: Column) -> Column:
    """Not null, not empty, no null or non-finite component, not all zero."""
    ok = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(vec.isNotNull() & (F.size(vec) > 0) & ok & F.exists(vec, lambda v: v != 0), F.lit(False))


_FOUND = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("members", T.ArrayType(T.LongType())), T.StructField("score", T.DoubleType())])


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # large and tiny values square without overflow
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def neighbours(
    vectors: DataFrame, queries: DataFrame, k: int = 5, degree: int = 24, beam: int = 64, search_beam: int = 128, alpha: float = 1.2, shard_rows: int = 4096, vec_id: str = "vec_id", vec: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score: each query row's ``k`` nearest other ids among ``vectors``."""
    spark = vectors.sparkSession
    shaped = lambda df: df.where(F.col(vec_id).isNotNull() & valid(F.col(vec))).select(F.col(vec_id).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("vec")).withColumn("dim", F.size("vec"))
    # a node is a direction: the vector over its largest component
    data = shaped(vectors).withColumn("key", F.transform(F.array(F.array_max(F.transform("vec", F.abs))), lambda most: F.transform("vec", lambda v: v / most))[0]).dropDuplicates(["dim", "key", "id"])
    first = Window.partitionBy("dim", "key").orderBy("id")
    data = data.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    nodes = data.groupBy("dim", "key").agg(F.min(F.struct("id", "vec"))["vec"].alias("vec"), F.sort_array(F.collect_list("id")).alias("members"))
    nodes = materialize(nodes.drop("key"), "ann-nodes")
    shards = max(1, -(-nodes.count() // shard_rows))
    where = F.pmod(F.xxhash64("vec"), F.lit(shards)).cast("int")
    nodes = nodes.select("dim", where.alias("shard"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"), "vec", "members")
    asked = shaped(queries).distinct().select("dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "id", "vec", F.lit(None).cast("array<long>").alias("members"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, members, graph, unit, least = None, [], [], None, None, None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "shard", "kind")], 1) if batch.num_rows else np.zeros((0, 3), int)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                dim, shard, kind = key[a].tolist()
                piece = batch.slice(a, b - a)
                x = piece.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                if (dim, shard) != at:
                    at, parts, members, graph = (dim, shard), [], [], None
                if kind == 0:
                    parts.append(x)
                    members += piece.column("members").to_pylist()
                    continue
                if not parts:
                    continue
                if graph is None:
                    unit = _unit(np.concatenate(parts))
                    graph = Graph(unit, degree, beam, alpha)
                    least = np.array([m[0] for m in members], np.int64)
                ids = piece.column("id").to_numpy(zero_copy_only=False)
                for c in range(0, len(x), BLOCK):
                    q = _unit(x[c : c + BLOCK])
                    found = graph.search(q, search_beam)[0]
                    score = np.where(found >= 0, np.einsum("qd,qkd->qk", q, unit[found]), -np.inf)
                    # a row among the k nearest is in one of the first k nodes by score and smallest id, the query's own aside
                    best = np.lexsort((np.where(found >= 0, least[found], np.iinfo(np.int64).max), -score), 1)[:, : k + 1]
                    row, column = np.nonzero(np.isfinite(np.take_along_axis(score, best, 1)))
                    hit = best[row, column]
                    node = found[row, hit]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[c : c + BLOCK][row]), pa.array([members[i] for i in node], pa.list_(pa.int64())), pa.array(score[row, hit])], names=_FOUND.names
                    )

    both = nodes.unionByName(asked).repartitionByRange(shards, "shard").sortWithinPartitions("dim", "shard", "kind", F.col("members")[0])
    found = both.mapInArrow(run, _FOUND)
    each = found.select("query_id", F.explode("members").alias("vec_id"), "score").where("vec_id <> query_id")
    rank = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return each.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
