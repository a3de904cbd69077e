"""Renames, projections, wide to long and long to wide."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrascore.functions.cleaning import clean_code, clean_indicator_id, clean_text, to_float

# Normalised header names of the grouping id and its label.
ID_HEADERS = ("id_epci", "code_epci")
LABEL_HEADERS = ("libelle_epci",)

# Need id and the wide score column that holds it.
NEED_COLUMNS = {
    "BV1": "score_water", "BV2": "score_food", "BV3": "score_housing", "BV4": "score_healthcare",
    "BV5": "score_security", "BE1": "score_education", "BE2": "score_social_cohesion", "BE3": "score_nature",
    "BI1": "score_local_economy", "BI2": "score_energy", "BI3": "score_mobility",
}


def rename_known(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename by mapping; names that are absent are ignored."""
    return df.withColumnsRenamed(dict(mapping))


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def all_but(df: DataFrame, *names: str) -> DataFrame:
    """Every column except the named ones; naming an absent one is an error."""
    missing = set(names) - set(df.columns)
    if missing:
        raise ValueError(f"no such columns: {sorted(missing)}")
    return df.drop(*names)


def pick_positions(df: DataFrame, positions: Mapping[int, str]) -> DataFrame:
    """Select columns by position and name them."""
    return df.select(*[F.col(f"`{df.columns[i]}`").alias(name) for i, name in positions.items()])


def with_constants(df: DataFrame, **values) -> DataFrame:
    return df.withColumns({name: F.lit(value) for name, value in values.items()})


def trim_headers(df: DataFrame, lower: bool = False) -> DataFrame:
    names = [c.strip() for c in df.columns]
    return df.toDF(*[n.lower() for n in names] if lower else names)


def normalise_header(name: str) -> str:
    """Accent-free, lower-case, single underscores for spaces and hyphens."""
    plain = "".join(ch for ch in unicodedata.normalize("NFKD", name) if not unicodedata.combining(ch))
    return re.sub("_{2,}", "_", re.sub("[ -]", "_", plain).lower())


def find_header(df: DataFrame, candidates: Sequence[str]) -> str | None:
    return next((c for c in df.columns if normalise_header(c) in candidates), None)


def measure_headers(df: DataFrame) -> list[str]:
    """Columns named like an indicator: i followed by digits."""
    return [c for c in df.columns if re.fullmatch(r"i\s*\d+", c.strip().lower())]


def unpivot_values(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str, value: str) -> DataFrame:
    """Wide to long; rows with a null id or a null value are dropped."""
    if not values:
        raise ValueError("no value columns to unpivot")
    # one narrow pass: each row is expanded in place, nothing is shuffled
    long = df.unpivot([F.col(f"`{c}`") for c in ids], [F.col(f"`{c}`") for c in values], name, value)
    return long.where(F.col(f"`{ids[0]}`").isNotNull() & F.col(value).isNotNull())


def wide_sheet_to_long(df: DataFrame, value: str, keep: Sequence[str] = ()) -> DataFrame:
    """Wide sheet with discovered columns to (id_epci, id_indicateur, libelle_epci, value).

    The label travels with the id through the unpivot, so no join is needed to
    attach it again. A missing id column is an error, a missing label is null.
    ``keep`` columns are carried along, with ``_position`` of the source column.
    """
    sheet = trim_headers(df)
    id_header = find_header(sheet, ID_HEADERS)
    if id_header is None:
        raise ValueError("no column for the grouping id in the sheet")
    label_header = find_header(sheet, LABEL_HEADERS)
    measures = measure_headers(sheet)
    if not measures:
        raise ValueError("no indicator columns in the sheet")
    ids = [id_header, *([label_header] if label_header else []), *keep]
    long = unpivot_values(sheet, ids, measures, "_name", "_value")
    label = clean_text(F.col(f"`{label_header}`")) if label_header else F.lit(None).cast("string")
    position = F.array_position(F.array(*[F.lit(m) for m in measures]), F.col("_name"))
    return long.select(
        clean_code(F.col(f"`{id_header}`")).alias("id_epci"),
        clean_indicator_id("_name").alias("id_indicateur"),
        label.alias("libelle_epci"),
        to_float("_value").alias(value),
        *keep,
        *([position.alias("_position")] if keep else []),
    ).where(F.col("id_epci").isNotNull())


def pivot_needs(
    scores: DataFrame, by: Sequence[str], need: str, score: str, columns: Mapping[str, str] | None = None
) -> DataFrame:
    """Long need scores to one wide row, plus the mean of all of them.

    The pivot values are given, so there is no extra pass to discover them and
    the width of the result is fixed.
    """
    columns = columns or NEED_COLUMNS
    wide = scores.groupBy(*by).pivot(need, list(columns)).agg(F.avg(score))
    return wide.select(
        *by,
        mean_of([F.col(f"`{n}`") for n in columns]).alias("score"),
        *[F.col(f"`{n}`").alias(c) for n, c in columns.items()],
    )


def mean_of(columns: Sequence[Column]) -> Column:
    """Row-wise mean that skips nulls; null when all are null."""
    filled = F.filter(F.array(*columns), lambda x: x.isNotNull())
    total = F.aggregate(filled, F.lit(0.0), lambda acc, x: acc + x)
    return F.try_divide(total, F.size(filled))


def move_column_values(df: DataFrame, source: str, target: str) -> DataFrame:
    """Overwrite ``target`` by ``source`` where that has a value, then drop ``source``."""
    return df.withColumn(target, F.when(F.col(source).isNotNull(), F.col(source)).otherwise(F.col(target))).drop(source)
