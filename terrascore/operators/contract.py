"""The common output of every indicator job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrascore.functions.cleaning import json_object

RAW_VALUE_COLUMNS = ("id_epci", "id_indicateur", "annee", "valeur_brute", "unite", "source", "meta")


def to_raw_values(
    df: DataFrame,
    indicator_id: str,
    year: int | Column,
    unit: str | None = None,
    source: str | None = None,
    group: str = "id_epci",
    value: str = "valeur_brute",
    note: str | None = None,
) -> DataFrame:
    """(id_epci, id_indicateur, annee, valeur_brute, unite, source, meta).

    Rows without a value are dropped, never turned into 0. ``meta`` keeps the
    computed row as JSON, or a fixed note.
    """
    number = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    raw = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("raw")
    meta = json_object(F.lit(note).alias("note")) if note else json_object(raw)
    return df.where(number.isNotNull()).select(
        F.col(group).cast("string").alias("id_epci"),
        F.lit(indicator_id).alias("id_indicateur"),
        (year if isinstance(year, Column) else F.lit(year)).cast("int").alias("annee"),
        number.alias("valeur_brute"),
        F.lit(unit).cast("string").alias("unite"),
        F.lit(source).cast("string").alias("source"),
        meta.alias("meta"),
    )
