"""Roll-ups, distinct and keyed de-duplication, bands, facets and neighbours.

Facts are always aggregated per fine code before they meet the catalogue: the
map side combines a hot code to one row per task, and the join that follows
sees at most one fact row per code.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrascore.functions.bands import CRITICAL_BELOW, GOOD_FROM
from terrascore.operators.shape import mean_of
from terrascore.session import stage


def rollup_two_level(
    facts: DataFrame,
    catalogue: DataFrame,
    code: str,
    group: str,
    measures: Mapping[str, Column],
    weights: Sequence[str] = (),
) -> DataFrame:
    """Facts per code, then per group; groups without facts keep a null total.

    ``measures`` are additive aggregates over facts (count, sum); ``weights`` are
    catalogue columns summed per group, such as a surface.
    """
    fine = facts.groupBy(code).agg(*[expr.alias(name) for name, expr in measures.items()])
    joined = catalogue.select(code, group, *weights).join(fine, code, "left")
    return joined.groupBy(group).agg(*[F.sum(c).alias(c) for c in (*measures, *weights)])


def mean_over_units(values: DataFrame, catalogue: DataFrame, code: str, group: str, value: str, name: str) -> DataFrame:
    """Mean of all values of a group's codes; null for a group without values."""
    totals = rollup_two_level(
        values, catalogue, code, group, {"_total": F.sum(value), "_count": F.count(value)}
    )
    return totals.select(group, F.try_divide(F.col("_total"), F.col("_count")).alias(name))


def count_through_shared_code(
    facts: DataFrame, catalogue: DataFrame, code: str, group: str, name: str
) -> DataFrame:
    """Facts per group over a code that several catalogue rows may share.

    As with the plain join, a fact counts once per catalogue row with its code;
    counting per code first gives the same total without the blown-up rows.
    Groups without facts do not appear.
    """
    fine = facts.where(F.col(code).isNotNull()).groupBy(code).agg(F.count(F.lit(1)).alias(name))
    return catalogue.select(code, group).join(fine, code, "inner").groupBy(group).agg(F.sum(name).alias(name))


def per(numerator: Column, denominator: Column, scale: float = 1.0, digits: int | None = None) -> Column:
    """``numerator / denominator * scale``; null for a zero or missing denominator."""
    ratio = F.try_divide(numerator.cast("double"), denominator.cast("double")) * scale
    return ratio if digits is None else F.round(ratio, digits)


def rate_per(
    denominators: DataFrame,
    numerators: DataFrame,
    key: str,
    numerator: str,
    denominator: str,
    scale: float,
    digits: int,
    name: str = "valeur_brute",
    how: str = "left",
) -> DataFrame:
    """Rate per key; with ``how='left'`` keys without a numerator get null."""
    return denominators.join(numerators, key, how).withColumn(
        name, per(F.col(numerator), F.col(denominator), scale, digits)
    )


def dedup_first(df: DataFrame, keys: Sequence[str], sequence: str | Sequence[str]) -> DataFrame:
    """One row per key: the first in ``sequence`` order (must be unique per key)."""
    return _pick(df, keys, sequence, F.min_by)


def dedup_last(df: DataFrame, keys: Sequence[str], sequence: str | Sequence[str]) -> DataFrame:
    """One row per key: the last in ``sequence`` order (must be unique per key)."""
    return _pick(df, keys, sequence, F.max_by)


def _pick(df, keys, sequence, choose) -> DataFrame:
    # an aggregate, not row_number(): every task first reduces a hot key to one row
    order = [sequence] if isinstance(sequence, str) else list(sequence)
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(choose(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*[c if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def band_counts(df: DataFrame, by: Sequence[str], score: str, low: float = CRITICAL_BELOW, high: float = GOOD_FROM) -> DataFrame:
    """Number of critical, middling and good scores; a missing score counts as 0."""
    value = F.coalesce(F.col(score), F.lit(0.0))
    return df.groupBy(*by).agg(
        F.count_if(value < low).alias("n_critique"),
        F.count_if((value >= low) & (value < high)).alias("n_moyen"),
        F.count_if(value >= high).alias("n_bon"),
    )


def distinct_labels(links: DataFrame, key: str, label: str, name: str) -> DataFrame:
    """Sorted distinct labels per key (bounded by the label dimension)."""
    return (
        links.select(key, label)
        .where(F.col(label).isNotNull())
        .distinct()
        .groupBy(key)
        .agg(F.sort_array(F.collect_list(label)).alias(name))
    )


def group_means(df: DataFrame, ids: Sequence[str], groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """One column per group: row-wise mean of its columns, 0 when all are missing."""
    return df.select(
        *ids,
        *[
            F.coalesce(mean_of([F.col(c).cast("double") for c in columns]), F.lit(0.0)).alias(name)
            for name, columns in groups.items()
        ],
    )


def facet_counts(
    catalogue: DataFrame, primary: str, secondary: str | None = None, needs: DataFrame | None = None, key: str = "id_besoin"
) -> DataFrame:
    """Rows per need, counting primary and secondary membership once, plus "all".

    With the dimension of ``needs`` every one of them has a row, with 0 where nothing
    belongs to it.
    """
    members = F.array(F.col(primary))
    if secondary:
        members = F.array_union(members, F.coalesce(F.col(secondary), F.array().cast("array<string>")))
    # "all" rides along as one more label, so the catalogue is read once
    labels = F.array_union(F.array(F.lit("all")), members)
    counts = (
        catalogue.select(F.explode(labels).alias("besoin"))
        .where(F.col("besoin").isNotNull())
        .groupBy("besoin")
        .agg(F.count(F.lit(1)).alias("n_indicateurs"))
    )
    if needs is None:
        return counts
    every = needs.select(F.col(key).cast("string").alias("besoin"), F.lit(0).cast("long").alias("n_indicateurs"))
    return counts.union(every).groupBy("besoin").agg(F.sum("n_indicateurs").alias("n_indicateurs"))


def neighbours(df: DataFrame, by: Sequence[str], order: Sequence[str], item: str) -> DataFrame:
    """Previous and next item of every row, and its rank, within ``by`` in ``order``.

    A window over a whole group would sort a hot group in one task. Here all rows are
    dealt into ranges of ``by`` and ``order`` by Spark, as many as the session has
    shuffle partitions, so that a hot group covers many ranges whatever its place in
    the order. The dealt rows are staged with the number of their range, so every
    reading agrees on it; the window runs per range and group, and its edges take their neighbours from
    a summary with one row per range and group. ``order`` must be unique within a group and free of nulls.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *by, *order).withColumn("_slice", F.spark_partition_id())
    sliced = stage(dealt, "ranges")
    key = F.struct(*[F.col(c) for c in order])

    inside = Window.partitionBy(*by, "_slice").orderBy(*order)
    local = sliced.withColumns(
        {
            "_prev": F.lag(item).over(inside),
            "_next": F.lead(item).over(inside),
            "_pos": F.row_number().over(inside),
        }
    )
    across = Window.partitionBy(*by).orderBy("_slice")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    edges = (
        sliced.groupBy(*by, "_slice")
        .agg(
            F.min_by(item, key).alias("_first"),
            F.max_by(item, key).alias("_last"),
            F.count(F.lit(1)).alias("_size"),
        )
        .select(
            *[F.col(c).alias(f"_by_{c}") for c in by],
            F.col("_slice").alias("_edge"),
            F.lag("_last").over(across).alias("_before"),
            F.lead("_first").over(across).alias("_after"),
            F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"),
        )
    )
    same_slice = F.col("_slice") == F.col("_edge")
    for c in by:
        same_slice = same_slice & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    joined = local.join(edges, same_slice)
    return joined.select(
        *df.columns,
        F.coalesce("_prev", "_before").alias("precedent"),
        F.coalesce("_next", "_after").alias("suivant"),
        (F.col("_pos") + F.col("_offset")).cast("long").alias("rang"),
    )
