"""Set-based forms of keyed writes: upsert, insert-ignore, reference checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrascore.operators.aggregates import dedup_last


def _same_keys(keys: Sequence[str]) -> Column:
    return reduce(and_, [F.col(f"t.{k}").eqNullSafe(F.col(f"u.{k}")) for k in keys])


def merge_upsert(
    target: DataFrame | None,
    updates: DataFrame,
    keys: Sequence[str],
    sequence: str,
    defaults: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Last write wins on ``keys``; columns the batch lacks keep their old value.

    ``sequence`` orders the batch and is not stored. An explicit null in the
    batch overwrites. In a new row a column the batch lacks has its value in
    ``defaults`` (null without one); without a target, these columns are added. Both sides hold
    each key once when they meet, so no key can be hot in the join.
    """
    latest = dedup_last(updates, keys, sequence).drop(sequence)
    defaults = dict(defaults or {})
    if target is None:
        absent = {name: value for name, value in defaults.items() if name not in latest.columns}
        return latest.withColumns(absent) if absent else latest
    unknown = set(latest.columns) - set(target.columns)
    if unknown:
        raise ValueError(f"columns not in the target: {sorted(unknown)}")
    old = target.withColumn("_old", F.lit(True)).alias("t")
    new = latest.withColumn("_new", F.lit(True)).alias("u")
    given = set(latest.columns)

    def value(name: str) -> Column:
        if name in given:
            merged = F.when(F.col("u._new"), F.col(f"u.{name}")).otherwise(F.col(f"t.{name}"))
        elif name in defaults:
            merged = F.when(F.col("t._old"), F.col(f"t.{name}")).otherwise(defaults[name])
        else:
            merged = F.col(f"t.{name}")
        return merged.cast(target.schema[name].dataType).alias(name)

    return old.join(new, _same_keys(keys), "full").select(*[value(c) for c in target.columns])


def insert_new(target: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Append only keys the target lacks; one row per new key.

    Where the batch repeats a key, the smallest row is taken, so a retried task
    gives the same result.
    """
    rest = [c for c in rows.columns if c not in keys]
    if rest:
        picked = rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row"))
        unique = picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
    else:
        unique = rows.select(*keys).distinct()
    fresh = unique.join(target.select(*keys), list(keys), "left_anti")
    return target.unionByName(fresh, allowMissingColumns=True)


def missing_ids(facts: DataFrame, column: str, dimension: DataFrame, key: str) -> DataFrame:
    """Distinct ids of the facts that the dimension lacks.

    The distinct comes first: the facts are reduced in the map phase, whatever
    share of them one id has.
    """
    ids = facts.select(F.col(column).alias(key)).where(F.col(key).isNotNull()).distinct()
    return ids.join(dimension.select(key).distinct(), key, "left_anti")


def with_placeholders(
    dimension: DataFrame, facts: DataFrame, column: str, key: str, label: str, prefix: str = "Indicateur "
) -> DataFrame:
    """Dimension plus a placeholder row "<prefix><id>" per unknown fact id."""
    fresh = missing_ids(facts, column, dimension, key).withColumn(label, F.concat(F.lit(prefix), F.col(key)))
    return dimension.unionByName(fresh, allowMissingColumns=True)


def require_ids(facts: DataFrame, column: str, dimension: DataFrame, key: str, show: int = 20) -> DataFrame:
    """The facts unchanged, or an error that names unknown ids."""
    unknown = [row[0] for row in missing_ids(facts, column, dimension, key).limit(show).collect()]
    if unknown:
        raise ValueError(f"unknown {key}: {', '.join(sorted(map(str, unknown)))}")
    return facts


def split_by_reference(
    facts: DataFrame, references: Sequence[tuple[str, DataFrame, str]]
) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rows; references are (fact column, dimension, key).

    One pass attaches a "known" mark per dimension; a null id is a rejection.
    """
    marks = []
    for i, (column, dimension, key) in enumerate(references):
        ids = dimension.select(F.col(key).alias(f"_k{i}")).distinct()
        facts = facts.join(ids, F.col(column) == F.col(f"_k{i}"), "left")
        marks.append(f"_k{i}")
    known = reduce(and_, [F.col(m).isNotNull() for m in marks])
    return facts.where(known).drop(*marks), facts.where(~known).drop(*marks)
