"""Writers: delimited text, and the long fact tables kept by key."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import ExitStack, contextmanager
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from terrascore.operators.keyed import merge_upsert
from terrascore.session import staged
from terrascore.tables import KEYS, PARTITIONS, defaults_of, schema_of


def write_delimited(df: DataFrame, path: str, sep: str = ",", mode: str = "errorifexists") -> None:
    """A folder of delimited part files, each with a header."""
    df.write.mode(mode).options(sep=sep, header=True, quote='"', escape='"', emptyValue="").csv(path)


def read_table(spark: SparkSession, path: str, table: str | None = None) -> DataFrame | None:
    """The stored table, or None where nothing has been written yet.

    With the name of a ``table`` its full schema is read: a column that older
    files lack is null, and an id that looks like a number stays a text.
    """
    try:
        found = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    if table is None:
        return found
    partitions = list(PARTITIONS.get(table, ()))
    if partitions and found.columns[-len(partitions) :] != partitions:  # folders come last in what is read
        raise ValueError(f"{path}: {table} is stored in folders by {partitions}, this one is not")
    wanted = schema_of(table)
    return spark.read.schema(wanted).parquet(path).select(*wanted.fieldNames())


class Merge(NamedTuple):
    """A batch merged into what is stored, not written yet."""

    keys: int  # of the batch
    rows: DataFrame | None  # None where the batch is empty
    found: Sequence[Row]  # the partition values that the rows replace


@contextmanager
def merged(
    path: str,
    updates: DataFrame,
    keys: Sequence[str],
    sequence: str | None,
    partition: str | Sequence[str] = "annee",
    table: str | None = None,
) -> Iterator[Merge]:
    """The rows that ``upsert_table`` writes; where something is stored they are staged, so it may be replaced inside.

    The staged copies are deleted at the end.
    """
    partitions = [partition] if isinstance(partition, str) else list(partition)
    if not set(partitions) <= set(keys):
        raise ValueError(f"partition columns {partitions!r} must be among the keys")
    with ExitStack() as copies:
        batch = copies.enter_context(staged(updates, "batch"))
        per_key = batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
        found = per_key.groupBy(*partitions).agg(F.count(F.lit(1)).alias("_keys"), F.max("_rows").alias("_most")).collect()
        n_keys = sum(row["_keys"] for row in found)
        if not n_keys:
            yield Merge(0, None, [])
            return
        if sequence is None:
            if any(row["_most"] > 1 for row in found):
                repeated = per_key.where(F.col("_rows") > 1).select(*keys).limit(5).collect()
                raise ValueError(f"keys given twice and no order between them: {[tuple(r) for r in repeated]}")
            sequence = "_sequence"
            batch = batch.withColumn(sequence, F.lit(0))
        current = read_table(updates.sparkSession, path, table)
        defaults = defaults_of(table) if table else None
        if current is not None and partitions:
            current = current.where(_one_of(partitions, found))
        rows = merge_upsert(current, batch, keys, sequence, defaults)
        if table:
            rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in schema_of(table).fields])
        if current is not None:  # a first load reads nothing that it overwrites, so it is written straight away
            rows = copies.enter_context(staged(rows, "merged"))
        yield Merge(n_keys, rows, found)


def upsert_table(
    path: str,
    updates: DataFrame,
    keys: Sequence[str],
    sequence: str | None,
    partition: str | Sequence[str] = "annee",
    table: str | None = None,
) -> int:
    """Merge a batch into a parquet table, partitioned by some of its key columns (or by none).

    The batch is staged once. One job over it counts its keys and finds repeated ones and the few partition
    values that it has: these name, as literals, the folders that are read and rewritten; all others are left
    alone. The merged rows are written to the shared folder first, so the table is
    never overwritten while it is being read and a lost executor costs only a retry. Both copies are
    deleted at the end. One job at a time may write a partition. ``sequence`` tells which row of a key is the
    last; without one a repeated key is an error. With the name of a stored ``table``
    the table has its full schema from the first batch on, whatever columns that brings.
    Returns the number of keys in the batch.
    """
    with merged(path, updates, keys, sequence, partition, table) as merge:
        if merge.rows is not None:
            write_merged(merge.rows, path, partition)
    return merge.keys


def upsert_stored(path: str, batch: DataFrame, table: str, sequence: str | None = None) -> int:
    """Upsert into one of the library's stored tables, in its keys, schema and folders."""
    return upsert_table(path, batch, KEYS[table], sequence, PARTITIONS.get(table, ()), table)


def read_touched(spark: SparkSession, path: str, table: str, batch: DataFrame) -> DataFrame | None:
    """The folders of a stored table that a batch has rows for, or None where nothing has been written yet."""
    stored, partitions = read_table(spark, path, table), PARTITIONS[table]
    if stored is None:
        return None
    return stored.where(_one_of(partitions, batch.select(*partitions).distinct().collect()))


def _one_of(partitions: Sequence[str], values: Sequence[Row]) -> Column:
    """A filter of literals that picks just these partitions, so that the scan lists no others."""
    first, *rest = partitions
    by_first: dict = {}
    for row in values:
        by_first.setdefault(row[first], []).append(row)

    def test(name: str, found: list) -> Column:
        filled = sorted({v for v in found if v is not None})
        known = F.col(name).isin(filled) if filled else F.lit(False)
        return known | F.col(name).isNull() if None in found else known

    whole = F.lit(False)
    for value, group in by_first.items():
        inner = _one_of(rest, group) if rest else F.lit(True)
        whole = whole | (test(first, [value]) & inner)
    # one test over all values of each column prunes folders where the exact one is too long to be pushed down
    return test(first, list(by_first)) & whole


def write_merged(df: DataFrame, path: str, partition: str | Sequence[str]) -> None:
    """Replace the partitions ``df`` has rows for (or all); files of even size, a hot partition split over tasks."""
    partitions = [partition] if isinstance(partition, str) else list(partition)
    writer = df.hint("rebalance", *partitions).write.mode("overwrite")
    if partitions:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partitions)
    writer.parquet(path)
