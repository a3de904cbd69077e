"""Approximate nearest neighbours from balanced posting lists.

A bounded sample is clustered with a penalty on crowded clusters; every vector is
written to the posting list of its nearest centroid and, if it lies near a boundary,
to those of further centroids. Centroids are found by a best-first walk over a
neighbour graph that every task holds in memory. A query reads the lists whose centroid is at most a
ratio farther than the nearest one; the ratio is learned from the sample, where the
true neighbours are known. Long lists are cut into chunks, queries into packs, and
chunks and packs of a list meet in a join: no task holds a whole list, and a common vector's list is
many chunks.

Scores are sums of products in double precision, in the order of the components, so
that equal vectors have equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrascore.llm.base import stage, table
from terrascore.llm.registry import query

#: Bounds of what the driver holds and sends: vectors in the sample, and lists.
SAMPLE, LISTS_MOST = 16_384, 4_096
#: Rows of a chunk of a list and of a pack of queries; vectors worked on at a time.
CHUNK, PACK, BLOCK = 1_024, 512, 512
#: Lists a vector is written to at most, and how much farther than its nearest centroid the others may be.
REPLICAS, BOUNDARY = 4, 1.03
#: Neighbours of a centroid in the graph; part of the true neighbours that the ratio must reach in the sample.
DEGREE, RECALL = 16, 0.95
ROUNDS, SEED = 8, 7


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances between rows of ``x`` and of ``c``."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :], 0)


def balanced_centroids(x: np.ndarray, lists: int, seed: int = SEED) -> np.ndarray:
    """Centroids of a sample: Lloyd's rounds in which a crowded cluster seems farther away than it is."""
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), lists, replace=False)].copy()
    fair = len(x) / lists
    counts = np.full(lists, fair)
    for _ in range(ROUNDS):
        d = squared(x, centroids)
        d += np.median(d.min(axis=1)) * 0.25 * (counts / fair - 1)
        own = d.argmin(axis=1)
        counts = np.bincount(own, minlength=lists).astype(float)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        filled = counts > 0
        centroids[filled] = sums[filled] / counts[filled, None]
        empty = np.flatnonzero(~filled)
        if len(empty):  # an empty cluster starts again at a vector of the fullest ones
            crowded = np.argsort(-counts[own], kind="stable")[: len(empty)]
            centroids[empty] = x[crowded]
    return centroids


@dataclass
class Index:
    """Centroids, their neighbour graph and what the search has learned; at most ``LISTS_MOST`` rows each."""

    centroids: np.ndarray
    graph: np.ndarray
    entries: np.ndarray
    floor: float = 0.0  # a usual distance to the nearest centroid: the ratio is never taken to less
    ratio: float = 1.0
    filled: np.ndarray | None = None  # vectors whose nearest centroid this is, of the whole table

    def walk(self, x: np.ndarray, ratio: float, least: int, candidates: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Lists for each row of ``x``: which were visited with a distance inside the ratio, and all distances found.

        A best-first walk from the entries: the nearest unvisited centroids of each row
        are opened until none is left that is within the ratio, among the ``least`` nearest, or needed to hold ``candidates``.
        """
        lists, rows = len(self.centroids), len(x)
        found = np.full((rows, lists), np.inf)
        opened = np.zeros((rows, lists), bool)
        found[:, self.entries] = np.sqrt(squared(x, self.centroids[self.entries]))
        held = np.zeros(rows)
        least = min(least, lists)
        while True:
            nearest = np.maximum(found.min(axis=1), self.floor)
            limit = np.maximum(ratio * nearest, np.partition(found, least - 1, axis=1)[:, least - 1])
            if candidates and self.filled is not None:
                limit = np.where(held < candidates, np.inf, limit)
            waiting = np.where(opened | ~np.isfinite(found), np.inf, found)
            pick = waiting.argmin(axis=1)
            best = waiting[np.arange(rows), pick]
            go = np.flatnonzero(np.isfinite(best) & (best <= limit))
            if not len(go):
                return opened, found
            step = [pick[go]]
            wide = np.argpartition(waiting[go], min(7, lists - 1), axis=1)[:, :8]  # some more of the nearest at once
            for column in wide.T:
                inside = waiting[go, column] <= ratio * nearest[go]
                step.append(np.where(inside, column, pick[go]))
            for nodes in step:
                new = ~opened[go, nodes]
                opened[go, nodes] = True
                if self.filled is not None:
                    held[go] += np.where(new, self.filled[nodes], 0)
                r, n = np.repeat(go, self.graph.shape[1]), self.graph[nodes].reshape(-1)
                unseen = ~np.isfinite(found[r, n])
                r, n = r[unseen], n[unseen]
                found[r, n] = np.sqrt(((x[r] - self.centroids[n]) ** 2).sum(axis=1))


def build_index(sample: np.ndarray, rows: int, k: int) -> Index:
    """Cluster a sample of a table of ``rows`` vectors, link the centroids and learn the ratio."""
    x = sample.astype(np.float32)
    lists = int(max(1, min(LISTS_MOST, round(rows**0.5), len(x) // 4)))
    centroids = balanced_centroids(x, lists)
    d = squared(centroids, centroids)
    order = np.argsort(d, axis=1, kind="stable")[:, 1 : DEGREE + 1]
    ring = (np.arange(lists)[:, None] + np.array([1, -1])) % lists  # keeps the graph in one piece
    entries = np.unique(np.linspace(0, lists - 1, min(lists, 8)).astype(int))
    index = Index(centroids, np.concatenate([order, ring], axis=1) if lists > 1 else np.zeros((1, 1), int), entries)
    own = squared(x, centroids)
    index.floor = float(np.sqrt(np.median(own.min(axis=1))))
    if lists == 1:
        return index
    # queries of the sample, their true neighbours in it, and how far the lists are that hold these
    asked = np.linspace(0, len(x) - 1, min(len(x), 512)).astype(int)
    scores = x[asked] @ x.T
    scores[np.arange(len(asked)), asked] = -np.inf
    near = np.argsort(-scores, axis=1)[:, : min(k, len(x) - 1)]
    home = own.argmin(axis=1)
    to = np.sqrt(squared(x[asked], centroids))
    need = np.take_along_axis(to, home[near], axis=1) / np.maximum(to.min(axis=1), index.floor)[:, None]
    index.ratio = float(max(1.0, np.quantile(need, RECALL)))
    return index


def valid_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """``id, v`` (array of doubles) of vectors that take part: one per id, of the table's most common length.

    Null vectors, zero vectors, those with null or non-finite components and rows
    without an id take no part; of an id's vectors the smallest in array order does.
    """
    v = F.col(f"`{vector}`").cast("array<double>")
    sound = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    good = rows.select(F.col(f"`{key}`").cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & sound)
    one = stage(good.groupBy("id").agg(F.min("v").alias("v")), "vectors")
    sizes = one.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return one.where(F.size("v") == sizes[0]["n"]) if sizes else one


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten()).reshape(len(column), -1)


def nearest(
    rows: DataFrame, k: int = 20, every: int = 20, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each id divisible by ``every`` its ``k`` neighbours of largest inner product.

    A query's own id is no candidate; ties go to the smaller id; with fewer than ``k``
    candidates all are returned. Of the lists that a query reads nothing is left out.
    """
    spark = rows.sparkSession
    vectors = valid_vectors(rows, key, vector)
    count = vectors.count()
    out = "query_id long, rank int, vec_id long, score double"
    if count < 2:
        return spark.createDataFrame([], out)
    steps = 1 << 40
    share = int(min(1.0, SAMPLE / count) * steps)
    in_sample = F.pmod(F.xxhash64("id"), F.lit(steps)) < share
    drawn = vectors.where(in_sample).orderBy("id").toArrow()
    sample_ids, sample = np.array(drawn["id"]), _matrix(drawn["v"].combine_chunks())
    index = build_index(sample, count, k)
    context = spark.sparkContext

    # postings: a row per vector and list; the nearest list is its home
    sent = context.broadcast(index)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = _matrix(part.column(1))
                _, found = sent.value.walk(x.astype(np.float32), BOUNDARY, REPLICAS)
                some = np.argsort(found, axis=1, kind="stable")[:, :REPLICAS]
                away = np.take_along_axis(found, some, axis=1)
                row, place = np.nonzero(away <= BOUNDARY * away[:, :1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some[row, place].astype(np.int32)), pa.array(place == 0), part.column(0).take(pa.array(row)),
                     part.column(1).take(pa.array(row))], ["list", "home", "id", "v"])

    postings = stage(vectors.select("id", "v").mapInArrow(post, "list int, home boolean, id long, v array<double>"), "postings")
    held = postings.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.count_if("home").alias("home")).collect()
    index.filled = np.zeros(len(index.centroids))
    chunks = [1] * len(index.centroids)
    for r in held:  # a row per list
        index.filled[r["list"]] = r["home"]
        chunks[r["list"]] = -(-r["n"] // CHUNK)
    homes = dict(postings.where(F.col("home") & in_sample).select("id", "list").toArrow().to_pandas().itertuples(index=False))
    sample_homes = np.array([homes[i] for i in sample_ids])
    routed = context.broadcast((index, sample_ids, sample.astype(np.float32), sample_homes))

    # queries: the lists they read, and a score that their k-th neighbour reaches for sure
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, ids, known, homes = routed.value
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                q = _matrix(part.column(1)).astype(np.float32)
                scores = q @ known.T
                opened, _ = index.walk(q, index.ratio, 2, 50 * k)
                # the k-th of those that stand in a list it reads; they will be found
                scores[(np.array(part.column(0))[:, None] == ids[None, :]) | ~opened[:, homes]] = -np.inf
                bound = np.full(len(q), -np.inf)
                if len(ids) > k:
                    bound = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k].astype(np.float64)
                    bound -= 1e-4 * np.linalg.norm(q, axis=1) * np.linalg.norm(known, axis=1).max()  # single precision
                row, lists = np.nonzero(opened)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lists.astype(np.int32)), part.column(0).take(pa.array(row)), pa.array(bound[row]),
                     part.column(1).take(pa.array(row))], ["list", "query_id", "bound", "q"])

    queries = vectors.where(F.pmod("id", F.lit(every)) == 0)
    reads = queries.select("id", "v").repartition(F.xxhash64("id")).mapInArrow(
        route, "list int, query_id long, bound double, q array<double>")
    reads = stage(reads, "reads")
    asked = {r["list"]: -(-r["n"] // PACK) for r in reads.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
    packs = [asked.get(i, 1) for i in range(len(chunks))]

    def packed(frame: DataFrame, name: str, sizes: list[int], *columns: str) -> DataFrame:
        """Rows of a list in packs, each one row of arrays: sizes have about a bounded mean, by a hash of the id."""
        number = F.pmod(F.xxhash64(columns[0]), F.element_at(F.lit(sizes), F.col("list") + 1)).cast("int")
        return frame.groupBy("list", number.alias(name)).agg(F.collect_list(F.struct(*columns)).alias(f"{name}s"))

    block = packed(postings, "chunk", chunks, "id", "v")
    asking = packed(reads, "pack", packs, "query_id", "bound", "q")
    met = block.join(asking, "list").select(
        F.col("chunks.id").alias("id"), F.flatten("chunks.v").alias("v"), F.col("packs.query_id").alias("query_id"),
        F.col("packs.bound").alias("bound"), F.flatten("packs.q").alias("q"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, v, queries, bound, q = (np.array(batch.column(i)[row].values) for i in range(5))
                yield best_of(queries, q.reshape(len(queries), -1), bound, ids, v.reshape(len(ids), -1), k)

    # a joined row holds a chunk and a pack: few of them make a batch
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    scored = stage(met.mapInArrow(score, "query_id long, vec_id long, score double"), "scored")
    best = scored.groupBy("query_id").agg(F.sort_array(F.collect_set(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("all"))
    ranked = best.select("query_id", F.posexplode(F.slice("all", 1, k)).alias("at", "hit"))
    return ranked.select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"),
        (-F.col("hit.s")).alias("score"))


def best_of(queries, q, bound, ids, v, k) -> pa.RecordBatch:
    """The ``k`` best candidates of each query among ``ids`` that reach its bound, with exact scores."""
    rough = q @ v.T
    slack = 1e-9 * (1 + np.abs(rough).max(initial=0))
    own = queries[:, None] == ids[None, :]
    rough[own] = -np.inf
    if len(ids) > k:  # the k-th of this chunk is a bound as well
        bound = np.maximum(bound, np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k])
    row, at = np.nonzero((rough >= (bound - slack)[:, None]) & ~own)
    exact = np.zeros(len(row))
    for d in range(q.shape[1]):  # always in the same order, so that equal vectors score equally
        exact += q[row, d] * v[at, d]
    order = np.lexsort((ids[at], -exact, row))
    row, at, exact = row[order], at[order], exact[order]
    start = np.searchsorted(row, row)
    top = np.arange(len(row)) - start < k
    return pa.RecordBatch.from_arrays(
        [pa.array(queries[row[top]]), pa.array(ids[at[top]]), pa.array(exact[top])], ["query_id", "vec_id", "score"])


@query("op1_nearest_vectors")
def op1_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
