"""Approximate nearest neighbours over balanced posting lists.

A bounded sample is split by repeated 2-means until parts are small and even; part means are the
centroids, more of them for larger tables. A graph of near centroids, held in memory, is searched by
a beam for the centroids near a vector. Every vector goes to the list of its nearest centroid and,
if it lies near a border, to those of further ones. A query reads the lists whose centroid is within
a ratio of its nearest one's distance, up to a budget; both are tuned on the sample to a recall.

Lists stay where they are: each is cut in chunks, a chunk is held by one task, and the queries that
read it are streamed past. Each chunk returns its ten best per query, which is all that a later
merge can need.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .arrays import tidy

#: Vectors that the centroids may be fitted on, about, vectors of a list while the sample allows as
#: many lists, and sample vectors that a centroid needs.
SAMPLE, LIST, PART = 1 << 17, 100, 16
#: A vector is repeated in lists whose centroid is within this ratio of its nearest, 4 at most.
BORDER, REPLICAS = 1.05, 4
#: Neighbours of sample queries that the lists read have to hold, and how many queries tell.
RECALL, TRIALS = 0.95, 128
LINKS, ENTRIES = 16, 24
#: Vectors of a chunk, and queries compared with it at a time.
CHUNK, ASKS = 4096, 256


def balanced_centroids(x: np.ndarray, part: int = PART, seed: int = 5) -> np.ndarray:
    """Means of parts of at most ``part`` rows made by even 2-means splits; copies that can't be
    told apart stay together."""
    rng, todo, out = np.random.default_rng(seed), [np.arange(len(x))], []
    while todo:
        rows = todo.pop()
        v = x[rows]
        if len(rows) <= part or (v == v[0]).all():
            out.append(v.mean(0))
            continue
        a, b = v[rng.integers(len(v))], v[rng.integers(len(v))]
        if (a == b).all():
            b = v[np.argmax(((v - a) ** 2).sum(1))]
        for _ in range(6):
            lean = v @ (b - a)  # up to a constant, how much nearer b is than a
            left = np.zeros(len(v), bool)
            left[np.argsort(lean, kind="stable")[: len(v) // 2]] = True
            a, b = v[left].mean(0), v[~left].mean(0)
        todo += [rows[left], rows[~left]]
    return np.unique(np.array(out), axis=0)


class CentroidGraph:
    """Centroids linked to near ones, searched from a few spread entries by a beam."""

    def __init__(self, centroids: np.ndarray, links: int = LINKS, entries: int = ENTRIES, seed: int = 7):
        self.c = centroids
        n, rng = len(centroids), np.random.default_rng(seed)
        self.square, near = (centroids**2).sum(1), []
        m = min(links, max(n - 1, 0))
        for i in range(0, n, 1024):
            d = self.square[None] - 2 * centroids[i : i + 1024] @ centroids.T
            d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
            near.append(np.argpartition(d, m - 1, 1)[:, :m] if m else np.zeros((len(d), 0), np.int64))
        far = rng.integers(0, n, (n, 2))  # a few long links keep far regions reachable
        self.near = np.hstack([np.concatenate(near), far]).astype(np.int64)
        self.entry = rng.permutation(n)[: min(entries, n)]
        self.ratio, self.budget = math.inf, n

    def _away(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return self.square[ids] - 2 * np.einsum("ij,ikj->ik", q, self.c[ids])

    def search(self, q: np.ndarray, beam: int, at_once: int = 2) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of about the nearest ``beam`` centroids of each row, nearest first;
        infinite distances pad."""
        n, rows = len(q), np.arange(len(q))[:, None]
        beam = min(beam, len(self.c))
        at_once = min(max(at_once, beam // 16), 8)
        ids = np.tile(self.entry, (n, 1))
        d = self._away(q, ids)
        met = np.zeros((n, len(self.c)), bool)
        met[:, self.entry] = True
        done = np.zeros(ids.shape, bool)
        while True:
            wait = np.where(done, np.inf, d)
            e = min(at_once, wait.shape[1])
            best = np.argpartition(wait, e - 1, 1)[:, :e]
            if np.isinf(wait[rows, best]).all():
                break
            done[rows, best] = True
            new = np.sort(self.near[ids[rows, best]].reshape(n, -1), 1)
            old = met[rows, new]
            old[:, 1:] |= new[:, 1:] == new[:, :-1]
            met[rows, new] = True
            dn = self._away(q, new)
            dn[old] = np.inf
            ids, d, done = np.hstack([ids, new]), np.hstack([d, dn]), np.hstack([done, old])
            if d.shape[1] > beam:
                keep = np.argpartition(d, beam - 1, 1)[:, :beam]
                ids, d, done = ids[rows, keep], d[rows, keep], done[rows, keep]
        order = np.argsort(d, 1, kind="stable")
        return ids[rows, order], np.sqrt(np.maximum(d[rows, order] + (q**2).sum(1)[:, None], 0))

    def borders(self, x: np.ndarray, ratio: float = BORDER, most: int = REPLICAS) -> list[np.ndarray]:
        """Lists that hold each row: the nearest one and, across borders, further ones."""
        ids, d = self.search(x, 2 * most)
        return [i[:most][r[:most] <= ratio * r[0]] for i, r in zip(ids, d, strict=True)]

    def tune(self, x: np.ndarray, k: int, recall: float = RECALL, trials: int = TRIALS) -> None:
        """Set ratio and budget so that lists read hold ``recall`` of the k nearest of sample rows."""
        asked = np.unique(np.linspace(0, len(x) - 1, min(trials, len(x))).astype(int))
        k = min(k, len(x) - 1)
        if k < 1:
            return
        square, near = (x**2).sum(1), []
        for i in range(0, len(asked), 32):
            rows = asked[i : i + 32]
            d = square[None] - 2 * x[rows] @ x.T
            d[np.arange(len(rows)), rows] = np.inf
            near.append(np.argpartition(d, k - 1, 1)[:, :k])
        near = np.concatenate(near)
        homes = self.borders(x[near.ravel()])
        beam = min(len(self.c), max(64, len(self.c) // 8))
        while True:
            ids, d = self.search(x[asked], beam)
            place = np.full((len(asked), len(self.c)), len(self.c))
            np.put_along_axis(place, ids, np.broadcast_to(np.arange(ids.shape[1]), ids.shape), 1)
            rank = np.sort([place[j // k, h].min() for j, h in enumerate(homes)])
            budget = int(rank[min(int(math.ceil((recall + 0.02) * len(rank))), len(rank)) - 1]) + 1
            if budget <= beam or beam == len(self.c):
                break
            beam = min(2 * beam, len(self.c))
        self.budget = min(budget, len(self.c))
        first = np.array([place[j // k, h].min() for j, h in enumerate(homes)])
        owner = np.arange(len(homes)) // k
        need = d[owner, np.minimum(first, d.shape[1] - 1)] / np.maximum(d[owner, 0], 1e-300)
        need = np.sort(need[first < self.budget])
        self.ratio = float(need[int(0.98 * (len(need) - 1))]) * (1 + 1e-6) if len(need) else math.inf

    def lists(self, q: np.ndarray, sizes: np.ndarray, k: int) -> list[np.ndarray]:
        """Lists that each query reads, further ones while they may hold fewer than k other vectors."""
        ids, d = self.search(q, self.budget)
        out, enough = [], (k + 1) * REPLICAS
        for i, (mine, r) in enumerate(zip(ids, d, strict=True)):
            keep = mine[r <= self.ratio * r[0] + 1e-12]
            if sizes[keep].sum() < enough:
                order = np.argsort(self._away(q[i : i + 1], np.arange(len(self.c))[None])[0], kind="stable")
                order = order[~np.isin(order, keep)]
                more = int(np.searchsorted(np.cumsum(sizes[order]), enough - sizes[keep].sum())) + 1
                keep = np.concatenate([keep, order[:more]])
            out.append(keep)
        return out


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(id, v) without vectors that are null, zero, or hold null or non-finite components, and their
    number; of vectors of several lengths those of the most frequent one (the shorter on a tie) take part."""
    kind = vectors.schema[vector_col].dataType.elementType.typeName()
    v = F.col(vector_col) if kind in ("float", "double") else F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & fine)
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == (length.n if length else 0)), length["count"] if length else 0


def _matrix(column) -> np.ndarray:
    values = np.asarray(column.flatten())
    return values.reshape(len(column), len(values) // max(len(column), 1)).astype(np.float64)


def _routes(choose):
    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(1))
            lists = [r for i in range(0, len(x), 256) for r in choose(x[i : i + 256])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int64()))], names=["id", "v", "lists"])

    return run


def nearest_in(ids: np.ndarray, x: np.ndarray, asks: np.ndarray, q: np.ndarray, k: int):
    """(query, vector, distance) of the k nearest rows of ``x`` for each row of ``q``, those with the
    query's own id left out; ties go to the smaller id."""
    square, mine = (x**2).sum(1), (q**2).sum(1)
    rough = square[None] + mine[:, None] - 2 * (q @ x.T)  # tells who is near, within rounding
    rough[asks[:, None] == ids[None]] = np.inf
    last = np.partition(rough, k - 1, 1)[:, k - 1] if rough.shape[1] > k else np.full(len(q), np.inf)
    row, col = np.nonzero((rough <= (last + 1e-12 * (square.max() + mine))[:, None]) & np.isfinite(rough))
    d = np.sqrt(((x[col] - q[row]) ** 2).sum(1))
    order = np.lexsort((ids[col], d, row))
    row, col, d = row[order], col[order], d[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return asks[row[place < k]], ids[col[place < k]], d[place < k]


def _scan(k: int):
    """Arrow batches of (list, chunk, kind, id, v), sorted by the first three: a chunk's vectors (kind
    0) are held while its queries (kind 1) come past."""

    def run(batches):
        now, ids, x = None, [], []
        for batch in batches:
            key = np.stack([np.asarray(c).astype(np.int64) for c in batch.columns[:3]], 1)
            who, v = np.asarray(batch.column(3)), _matrix(batch.column(4))
            edge = np.flatnonzero(np.any(key[1:] != key[:-1], axis=1)) + 1
            for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(key)], strict=True):
                if a == b:
                    continue
                if (key[a, 0], key[a, 1]) != now:
                    now, ids, x = (key[a, 0], key[a, 1]), [], []
                if key[a, 2] == 0:
                    ids.append(who[a:b])
                    x.append(v[a:b])
                elif x:
                    if len(x) > 1:
                        ids, x = [np.concatenate(ids)], [np.concatenate(x)]
                    for i in range(a, b, ASKS):
                        j = min(i + ASKS, b)
                        found = nearest_in(ids[0], x[0], who[i:j], v[i:j], k)
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["query_id", "vec_id", "score"])

    return run


def nearest_neighbours(vectors: DataFrame, queries=None, k: int = 10, sample: int = SAMPLE, list_size: int = LIST, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found by Euclidean distance.

    * ``queries``: a condition on the id, by default those divisible by 100. A query is compared
      with every other row of the lists it reads; with fewer than k rows it gets all found.
    * Ties go to the smaller id. Rows that share an id are one vector or, where their vectors differ,
      a set of vectors, and the distance of two sets is that of their nearest members. Scores are
      computed from the original vectors in double precision.
    * Ids are whole numbers; rows of null id and the vectors that ``usable`` names take no part.
      Empty tables give an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows, total = usable(vectors, id_col, vector_col)
    if not total:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    part = F.shiftrightunsigned(F.xxhash64("id"), 11) < int(min(1.0, sample / total) * (1 << 53))  # a share of ids, in one pass
    fitted = rows.filter(part).groupBy("id").agg(F.min("v").alias("v")).orderBy("id").select("v").toArrow()
    if not fitted.num_rows:
        fitted = rows.limit(1).select("v").toArrow()
    x = _matrix(fitted.column("v").combine_chunks())
    lists = max(1, min(total // list_size, len(x) // PART))
    graph = CentroidGraph(balanced_centroids(x, -(-len(x) // lists)))
    graph.tune(x, k, recall)
    kind = rows.schema["v"].dataType.simpleString()
    routed = materialise(rows.mapInArrow(tidy(_routes(graph.borders)), f"id bigint, v {kind}, lists array<bigint>"), "posts")
    posts = routed.select("id", "v", F.explode("lists").alias("list"))
    sizes = np.zeros(len(graph.c), np.int64)
    for r in posts.groupBy("list").count().collect():  # a row per list
        sizes[r.list] = r["count"]
    wanted = (F.col("id") % 100 == 0) if queries is None else queries
    asks = rows.filter(wanted).mapInArrow(tidy(_routes(lambda q: graph.lists(q, sizes, k))), f"id bigint, v {kind}, lists array<bigint>").select("id", "v", F.explode("lists").alias("list"))
    chunks = F.broadcast(spark.createDataFrame([(i, int(-(-n // CHUNK))) for i, n in enumerate(sizes.tolist()) if n], "list bigint, chunks int"))
    posts = posts.join(chunks, "list").select("list", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("chunk"), F.lit(0).alias("kind"), "id", "v")
    asks = asks.join(chunks, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(1).alias("kind"), "id", "v")
    work = posts.unionByName(asks).repartition("list", "chunk").sortWithinPartitions("list", "chunk", "kind")
    found = work.mapInArrow(tidy(_scan(k)), "query_id bigint, vec_id bigint, score double")
    found = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))  # replicas, repeated ids
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
