"""What the operators of this package share: reading a table, scratch tables, small expressions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import count

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrascore.session import configure, stage

__all__ = ["batch_rows", "fresh", "slices", "stage", "table", "text_or_empty"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, with the session settings the operators rely on."""
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names made from ``wanted`` that ``df`` has not, so that helpers never clash with a user's columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        free = next(n for n in (f"__{name}{i or ''}" for i in count()) if n.lower() not in taken)
        taken.add(free.lower())
        out.append(free)
    return out


def batch_rows(spark: SparkSession, rows: int = 512) -> None:
    """Bound the Arrow batches that Python tasks get: texts can be long, and a batch is held whole."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows whose texts hold about ``most`` bytes; a longer text is a run of its own."""
    for batch in batches:
        column_at = batch.schema.get_field_index(column)
        lengths = pc.fill_null(pc.binary_length(batch.column(column_at)), 0).to_pylist()
        start, held = 0, 0
        for row, size in enumerate(lengths):
            if row > start and held + size > most:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        if batch.num_rows > start:
            yield batch.slice(start)
