"""From raw values to 0-100 scores, and from scores to group means."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrascore.functions.bands import band
from terrascore.functions.cleaning import json_object
from terrascore.operators.aggregates import group_means
from terrascore.operators.shape import NEED_COLUMNS

MIN_SPAN = 1e-9

# Wide score column groups for objectives and for indicator types.
OBJECTIVE_GROUPS = {
    "Subsistance": ("score_water", "score_food", "score_housing", "score_healthcare", "score_security"),
    "Gestion de crise": ("score_education", "score_social_cohesion", "score_nature"),
    "Soutenabilité": ("score_local_economy", "score_energy", "score_mobility"),
}
TYPE_GROUPS = {
    "Action": ("score_water", "score_food", "score_education", "score_local_economy", "score_energy"),
    "État": (
        "score_housing", "score_healthcare", "score_security", "score_social_cohesion", "score_nature",
        "score_mobility",
    ),
}
# Label of each need in a flash report.
FLASH_LABELS = {
    "BV1": "Accès à l'eau", "BV2": "Alimentation", "BV3": "Logement", "BV4": "Santé", "BV5": "Sécurité",
    "BE1": "Éducation", "BE2": "Cohésion sociale", "BE3": "Relation à la nature", "BI1": "Économie locale",
    "BI2": "Énergie", "BI3": "Mobilité",
}
# Name of each need on a territory sheet.
NEED_NAMES = {
    "BV1": "Avoir accès à l'eau douce", "BV2": "Se nourrir", "BV3": "Se loger", "BV4": "Se soigner",
    "BV5": "Être en sécurité", "BE1": "S'informer et s'instruire", "BE2": "Vivre ensemble et faire société",
    "BE3": "Être en lien avec la nature", "BI1": "Produire et s'approvisionner localement",
    "BI2": "Avoir accès à l'énergie", "BI3": "Se déplacer",
}


def min_max_scores(
    values: DataFrame,
    by: Sequence[str] = ("id_indicateur", "annee"),
    value: str = "valeur_brute",
    score: str = "score_indicateur",
) -> DataFrame:
    """Adds the min-max score of each value within its indicator, and min and max.

    The extremes come from an aggregate that every task starts on its own rows,
    joined back; a window per indicator would send a whole indicator to one task.
    """
    known = values.where(F.col(value).isNotNull())
    extremes = known.groupBy(*by).agg(F.min(value).alias("minimum"), F.max(value).alias("maximum"))
    span = F.greatest(F.col("maximum") - F.col("minimum"), F.lit(MIN_SPAN))
    normalised = (F.col(value) - F.col("minimum")) / span
    return known.join(extremes, list(by)).withColumn(score, F.round(normalised * 100, 2))


def score_rows(values: DataFrame, value: str = "valeur_brute") -> DataFrame:
    """Rows of the score table: score, the same global score, and a JSON report."""
    scored = min_max_scores(values, value=value)
    stored = F.col("score_indicateur").cast("decimal(5,2)")
    return scored.select(
        "id_epci",
        "id_indicateur",
        "annee",
        stored.alias("score_indicateur"),
        stored.alias("score_global"),
        json_object(
            F.col(value).alias("valeur_brute"), F.col("minimum").alias("min"), F.col("maximum").alias("max")
        ).alias("rapport"),
    )


def mean_score_by_link(
    scores: DataFrame, links: DataFrame, by: Sequence[str], indicator: str, item: str, score: str, name: str
) -> DataFrame:
    """Mean score per (by, linked item): needs, objectives or types of an indicator."""
    return (
        scores.select(*by, indicator, score)
        .where(F.col(score).isNotNull())
        .join(links.select(indicator, item).distinct(), indicator)
        .groupBy(*by, item)
        .agg(F.avg(F.col(score).cast("double")).alias(name))
    )


def global_scores(
    scores: DataFrame,
    by: Sequence[str],
    indicator: str,
    score: str,
    links: Mapping[str, tuple[DataFrame, str]],
) -> DataFrame:
    """One row per ``by``: mean indicator score, and per link table the mean of its item means.

    ``links`` maps a result column to (link table, item column).
    """
    result = scores.groupBy(*by).agg(F.avg(F.col(score).cast("double")).alias("score_global"))
    for name, (table, item) in links.items():
        per_item = mean_score_by_link(scores, table, by, indicator, item, score, "_mean")
        result = result.join(per_item.groupBy(*by).agg(F.avg("_mean").alias(name)), list(by), "left")
    return result


def wide_to_functions(
    territories: DataFrame, ids: Sequence[str], columns: Mapping[str, str] | None = None, fill: float | None = 0.0
) -> DataFrame:
    """One row per territory and need: field, code, score (missing shown as ``fill``)."""
    columns = columns or NEED_COLUMNS
    code_of = F.create_map(*[F.lit(x) for code, field in columns.items() for x in (field, code)])
    typed = territories.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns.values()])
    long = typed.unpivot(list(ids), list(columns.values()), "champ", "score")
    filled = F.col("score") if fill is None else F.coalesce(F.col("score"), F.lit(fill))
    return long.select(*ids, "champ", F.element_at(code_of, F.col("champ")).alias("code"), filled.alias("score"))


def group_means_of_needs(territories: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Mean of the need scores of every objective and of every indicator type."""
    return group_means(territories, ids, {**OBJECTIVE_GROUPS, **TYPE_GROUPS})


def flash_metrics(
    territories: DataFrame, overrides: DataFrame, key: str, columns: Mapping[str, str] | None = None
) -> DataFrame:
    """Per territory and need: override, else baseline, else 0, with its level.

    ``overrides`` is long: (key, champ, valeur), at most one row per pair.
    """
    base = wide_to_functions(territories, [key], columns)
    label_of = F.create_map(*[F.lit(x) for pair in FLASH_LABELS.items() for x in pair])
    joined = base.join(overrides.select(key, "champ", "valeur"), [key, "champ"], "left")
    return joined.select(
        key,
        "champ",
        "code",
        F.try_element_at(label_of, F.col("code")).alias("libelle"),
        F.col("score").alias("base"),
        F.coalesce("valeur", "score").alias("valeur"),
        band(F.coalesce("valeur", "score")).alias("interpretation"),
    )


def flash_summary(metrics: DataFrame, key: str) -> DataFrame:
    """Baseline mean and adjusted mean of every territory."""
    return metrics.groupBy(key).agg(F.avg("base").alias("score_base"), F.avg("valeur").alias("score_ajuste"))
