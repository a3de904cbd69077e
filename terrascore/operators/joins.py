"""Joins between areas, facts and dimensions.

No join here carries a broadcast hint. A side below Spark's broadcast threshold
is broadcast by its measured or estimated size; otherwise both sides are
shuffled and adaptive execution splits the partition of a hot key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unmatched_both(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Keys that exist on one side only: (left_key, right_key) with one null.

    Each side is reduced to its distinct keys before the join, so a key that
    fills a third of a table is one row there.
    """
    a = left.select(F.col(left_key).alias("_l")).distinct()
    b = right.select(F.col(right_key).alias("_r")).distinct()
    return (
        a.join(b, F.col("_l") == F.col("_r"), "full")
        .where(F.col("_l").isNull() | F.col("_r").isNull())
        .select(F.col("_l").alias(left_key), F.col("_r").alias(right_key))
    )


def exclude_listed(df: DataFrame, column: str, listed: DataFrame, listed_column: str) -> DataFrame:
    """Rows whose value is not in the list; nulls in the list exclude nothing."""
    names = listed.select(F.col(listed_column).alias("_listed")).where(F.col("_listed").isNotNull()).distinct()
    return df.join(names, F.col(column) == F.col("_listed"), "left_anti")


def keep_known(df: DataFrame, column: str, known: DataFrame, known_column: str) -> DataFrame:
    """Rows whose value exists in the dimension."""
    ids = known.select(F.col(known_column).alias("_known")).distinct()
    return df.join(ids, F.col(column) == F.col("_known"), "left_semi")


def star_lookup(
    facts: DataFrame,
    required: Sequence[tuple[DataFrame, str, str]],
    optional: Sequence[tuple[DataFrame, str, str]] = (),
) -> DataFrame:
    """Attach dimensions: (dimension, fact column, dimension key).

    Rows without a required dimension are dropped; optional ones leave nulls.
    The dimension key column is not kept twice.
    """
    for how, dims in (("inner", required), ("left", optional)):
        for dim, column, key in dims:
            renamed = dim.withColumnRenamed(key, "_key")
            facts = facts.join(renamed, F.col(column) == F.col("_key"), how).drop("_key")
    return facts


def unnest_links(df: DataFrame, id_column: str, array_column: str, item: str) -> DataFrame:
    """One row per (id, array element); empty and null arrays give none."""
    return df.select(id_column, F.explode(array_column).alias(item))


def flags_to_links(df: DataFrame, id_column: Column, flags: Mapping[str, Column], item: str) -> DataFrame:
    """One row (id, code) per raised flag of a wide row."""
    raised = F.array(*[F.when(flag, F.lit(code)) for code, flag in flags.items()])
    rows = df.select(id_column, F.explode(raised).alias(item))
    return rows.where(F.col(item).isNotNull())


def link_arrays(links: DataFrame, key: str, item: str, array_name: str) -> DataFrame:
    """Sorted distinct items per key.

    Duplicates go before anything is collected, so an array holds at most one
    entry per member of the (small) dimension on the other side.
    """
    return (
        links.select(key, item)
        .where(F.col(key).isNotNull() & F.col(item).isNotNull())
        .distinct()
        .groupBy(key)
        .agg(F.sort_array(F.collect_list(item)).alias(array_name))
    )


def fill_code(df: DataFrame, missing: str, by: str, lookup: DataFrame, lookup_key: str, lookup_value: str) -> DataFrame:
    """Fill a missing code from a lookup on another code; one row in, one row out.

    The lookup is reduced to one value per key first, so it can neither fan out
    the rows nor drop any.
    """
    table = (
        lookup.select(F.col(lookup_key).alias("_k"), F.col(lookup_value).alias("_v"))
        .where(F.col("_k").isNotNull())
        .groupBy(F.col("_k").cast("string").alias("_k"))
        .agg(F.min("_v").alias("_v"))
    )
    # rows that need no lookup get a key that matches nothing and is spread evenly:
    # as nulls they would all be sent to one task of a shuffled join
    needed = F.col(missing).isNull() & F.col(by).isNotNull()
    spread = F.concat(F.lit("\u0000"), F.xxhash64(*df.columns).cast("string"))
    probe = F.when(needed, F.col(by).cast("string")).otherwise(spread)
    joined = df.join(table, probe == F.col("_k"), "left")
    return joined.withColumn(missing, F.coalesce(missing, "_v")).select(*df.columns)


def one_group_per_code(catalogue: DataFrame, code: str, group: str) -> DataFrame:
    """Catalogue with a single group per shared code (the smallest)."""
    return catalogue.groupBy(code).agg(F.min(group).alias(group))
