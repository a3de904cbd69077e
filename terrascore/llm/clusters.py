"""Exact k-means over whole numbers, with vectors cut into blocks of dimensions (dimension-sharded Lloyd).

Vectors are packed into chunks of rows, and a chunk into one matrix for each block of
dimensions. In a round, a task with a matrix needs only its own slice of the centroids:
it computes the exact partial squared distances of its rows to all of them. The blocks
of a chunk are then added, which gives every row its nearest centroid, and these go back
to the matrices, so that each block sums its own dimensions of every cluster and updates
its own slice.

The matrices are written once, bucketed by chunk and block. A round moves partial
distances and assignments, never vectors; only the centroids, clusters times dimensions,
are written after each round.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrascore.llm.base import stage, table
from terrascore.llm.registry import query
from terrascore.session import scratch_path

CLUSTERS, ROUNDS, DIMENSIONS, SCALE = 8, 10, 64, 1024
#: Dimensions of a block, and most rows of a chunk.
WIDTH, CHUNK = 16, 4096
#: Components beyond this have it: squared distances over 64 dimensions of whole numbers within it fit a long.
FARTHEST = 1 << 27
LONGEST = (1 << 63) - 1


def whole_vectors(rows: DataFrame, key: str, vector: str, dimensions: int, scale: float) -> DataFrame:
    """``id, x``: the vectors that take part, each component ``c`` as ``floor(scale * c)``, held to ``FARTHEST``."""
    finite = f"size(v) = {dimensions} and forall(v, c -> c is not null and not isnan(c) and abs(c) < double('inf'))"
    held = f"greatest(least(c * {float(scale)!r}D, {FARTHEST}D), -{FARTHEST}D)"
    vectors = rows.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    return vectors.where(finite).select("id", F.expr(f"transform(v, c -> floor({held}))").alias("x"))


def _packed(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Matrices of chunks, one row for each block; a chunk is named by the number of its first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                whole = part.column(1).flatten().to_numpy().reshape(part.num_rows, -1)
                cuts = [np.ascontiguousarray(whole[:, i : i + width]).tobytes() for i in range(0, whole.shape[1], width)]
                # the keys go with the first block
                keys = pa.ListArray.from_arrays(
                    pa.array([0, *[part.num_rows] * len(cuts)], pa.int32()), pa.concat_arrays([part.column(0)]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.column(2)[0].as_py()] * len(cuts), pa.int64()),
                     pa.array(range(len(cuts)), pa.int32()), keys, pa.array(cuts, pa.binary())],
                    ["chunk", "block", "keys", "part"])

    return run


def _partial(clusters: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Squared distances of a matrix's rows to all centroids, over its own dimensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                centres = row.column(2)[0].values.to_numpy().reshape(clusters, -1)
                part = np.frombuffer(row.column(1)[0].as_buffer(), np.int64).reshape(-1, centres.shape[1])
                found = np.empty((len(part), clusters), np.int64)
                for cluster, centre in enumerate(centres):
                    away = part - centre
                    found[:, cluster] = np.einsum("ij,ij->i", away, away)
                yield pa.RecordBatch.from_arrays([row.column(0), pa.array([found.tobytes()], pa.binary())], ["chunk", "partial"])

    return run


def _nearest(clusters: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The blocks of a chunk added: each row's nearest centroid, the first of equally near ones, and its distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                parts = batch.column(1)[at].values
                whole = sum(np.frombuffer(p.as_buffer(), np.int64) for p in parts).reshape(-1, clusters)
                near = whole.argmin(axis=1).astype(np.int32)
                least = whole[np.arange(len(whole)), near]
                cuts = pa.array([0, len(near)], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, 1), pa.ListArray.from_arrays(cuts, pa.array(near)),
                     pa.ListArray.from_arrays(cuts, pa.array(least))], ["chunk", "near", "away"])

    return run


def _totals(clusters: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums of every cluster's components and its number of rows, one row for each cluster and dimension that a task met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for at in range(batch.num_rows):
                block, near = batch.column(0)[at].as_py(), batch.column(2)[at].values.to_numpy()
                part = np.frombuffer(batch.column(1)[at].as_buffer(), np.int64).reshape(len(near), -1)
                if block not in met:
                    met[block] = np.zeros((clusters, part.shape[1]), np.int64), np.zeros(clusters, np.int64)
                np.add.at(met[block][0], near, part)
                met[block][1][:] += np.bincount(near, minlength=clusters)
        for block, (total, members) in met.items():
            size = total.shape[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(clusters, dtype=np.int32), size)),
                 pa.array(np.tile(np.arange(block * width, block * width + size, dtype=np.int32), clusters)),
                 pa.array(total.reshape(-1)), pa.array(np.repeat(members, size))], ["cluster", "dimension", "total", "members"])

    return run


def cluster_vectors(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS, scale: float = SCALE, start: str = "3:", width: int = WIDTH,
) -> tuple[DataFrame, DataFrame]:
    """Assignments ``<key>, cluster, distance``, one for each vector, and the centroids ``cluster, dimension, value``.

    Vectors of another length than ``dimensions`` and those with null or non-finite
    components take no part. The rest are whole numbers, ``floor(scale * component)``,
    held to ±2^27 (so that every squared distance fits a long), and all sums are exact.
    Centroids start as the vectors whose keys after ``start`` have the smallest
    SHA-256, in that order; rows that share a key start in the order of their vectors,
    rows without one come last. Fewer vectors than ``clusters`` give as many centroids.
    Each of ``rounds`` rounds assigns every vector to its nearest centroid (the first
    of equally near ones) and moves each centroid with vectors to the floor of their
    mean; a last assignment follows. Repeated rows count as often as they occur. No
    vectors give no rows. Other columns of ``rows`` are not looked at.
    """
    spark = rows.sparkSession
    vectors = whole_vectors(rows, key, vector, dimensions, scale)
    first = vectors.withColumn("by", F.sha2(F.concat(F.lit(start), F.col("id").cast("string")), 256)).orderBy(
        F.col("by").asc_nulls_last(), "x").limit(clusters)
    numbered = stage(first.select("by", "x"), "starts").selectExpr(
        "row_number() over (order by by asc nulls last, x) - 1 as cluster", "x")  # a window over the few first vectors
    centres = stage(numbered.select("cluster", F.posexplode("x").alias("dimension", "value")), "centres")
    key_type = vectors.schema["id"].dataType.simpleString()
    found = centres.agg(F.max("cluster")).first()[0]
    if found is None:
        return spark.createDataFrame([], f"`{key}` {key_type}, cluster int, distance long"), centres
    clusters, blocks = found + 1, -(-dimensions // width)

    packed = vectors.withColumn("number", F.monotonically_increasing_id()).mapInArrow(
        _packed(width), f"chunk long, block int, keys array<{key_type}>, part binary")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"clusters_{uuid.uuid4().hex}"
    packed.repartition(buckets, "chunk", "block").write.bucketBy(buckets, "chunk", "block").format("parquet").option(
        "path", scratch_path(spark, "matrices")).saveAsTable(name)
    matrices = spark.table(name)

    def assigned() -> DataFrame:
        slices = centres.groupBy(F.expr(f"dimension div {width}").cast("int").alias("block")).agg(
            F.sort_array(F.collect_list(F.struct("cluster", "dimension", "value"))).getField("value").alias("slice"))
        partial = matrices.join(slices, "block").select("chunk", "part", "slice").mapInArrow(
            _partial(clusters), "chunk long, partial binary")
        return partial.groupBy("chunk").agg(F.collect_list("partial").alias("partials")).mapInArrow(
            _nearest(clusters), "chunk long, near array<int>, away array<long>")

    for _ in range(rounds):
        near = assigned().select("chunk", "near", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        totals = near.join(matrices, ["chunk", "block"]).select("block", "part", "near").mapInArrow(
            _totals(clusters, width), "cluster int, dimension int, total long, members long")
        moved = totals.groupBy("cluster", "dimension").agg(F.sum("total").alias("total"), F.sum("members").alias("members"))
        mean = F.expr("case when members > 0 then (total - pmod(total, members)) div members else value end")
        centres = stage(centres.join(moved, ["cluster", "dimension"]).select("cluster", "dimension", mean.alias("value")), "centres")

    keys = matrices.where("block = 0").select("chunk", "keys")
    pairs = assigned().join(keys, "chunk").select(F.inline(F.arrays_zip("keys", "near", "away")))
    result = stage(pairs.toDF(key, "cluster", "distance"), "assigned")
    spark.sql(f"drop table {name}")
    return result, centres


@query("op11_cluster_vectors")
def op11_cluster_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centres = cluster_vectors(table(spark, sf_dir, "embeddings"))
    digests = centres.groupBy("cluster").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(
        F.struct("dimension", "value"))).getField("value").cast("array<string>"), ","), 256).alias("centroid_sha256"))
    fits = lambda total: F.least(total, F.lit(LONGEST).cast("decimal(38,0)")).cast("long")
    sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(28,0)")).alias("total"))
    whole = sums.agg(fits(F.sum("total"))).first()[0]
    # a row for each cluster, written so that its size is known before it meets the vectors
    summary = stage(sums.join(digests, "cluster").select(
        "cluster", fits(F.col("total")).alias("cluster_inertia"), F.lit(whole).cast("long").alias("inertia"), "centroid_sha256"), "summary")
    return rows.join(summary, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
