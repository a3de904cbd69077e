"""The two territory dimensions every indicator job uses."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrascore.functions.cleaning import pad_code, spaced_number
from terrascore.operators.aggregates import per
from terrascore.operators.filters import in_group_like, in_real_group
from terrascore.operators.shape import drop_columns, rename_known
from terrascore.sources.files import read_delimited

# Headers of the grouping spreadsheet and their column names.
PROFILE_HEADERS = {
    "Nom du groupement": "epci_nom", "Nature juridique": "nature_juridique", "N° SIREN": "siren",
    "Département": "dept", "Population totale": "total_pop_mun", "Population DGF": "total_pop_tot",
    "Densité démographique (hab/km²)": "densite_par_km2", "Superficie": "superficie_km2",
    "Nombre de membres": "nb_membres", "Nombre total des délégués": "nb_delegues",
    "Nombre de compétences exercées": "nb_competences", "Potentiel fiscal": "potentiel_fiscal",
    "Dotation globale": "dotation_globale", "Dotation de compensation": "dotation_compensation",
    "Dotation d'intercommunalité": "dotation_intercommunalite", "Ville du siège": "ville_siege",
    "Nom membre": "nom_membre", "Siren membre": "siren_membre",
    "Population totale du membre du groupement": "pop_totale_membre",
}
MEMBER_COLUMNS = ("dept", "superficie_km2", "nom_membre", "siren_membre", "pop_totale_membre")


@dataclass(frozen=True)
class Territory:
    """``communes``: one row per commune. ``perimeter``: one row per member commune of a grouping."""

    communes: DataFrame
    perimeter: DataFrame


def load_territory(spark: SparkSession, communes_path: str, perimeter_path: str) -> Territory:
    communes = read_delimited(spark, communes_path, sep=",")
    perimeter = read_delimited(spark, perimeter_path, sep=";", encoding="ISO-8859-1")
    return Territory(clean_communes(communes), perimeter)


def clean_communes(communes: DataFrame) -> DataFrame:
    """Padded postal code and numeric measures."""
    numbers = [c for c in ("population", "superficie_hectare", "superficie_km2", "densite") if c in communes.columns]
    return communes.withColumn("code_postal", pad_code("code_postal")).withColumns(
        {c: spaced_number(c) for c in numbers}
    )


def populations(perimeter: DataFrame, column: str = "total_pop_tot") -> DataFrame:
    """(siren, population): one row per grouping.

    The perimeter repeats the population on every member row, at times written
    differently; comparing after the cast leaves one value, else the largest.
    """
    return (
        perimeter.where(F.col("siren").isNotNull())
        .groupBy("siren")
        .agg(F.max(spaced_number(column)).alias("population"))
    )


def surfaces(communes: DataFrame) -> DataFrame:
    """(siren, superficie_km2) summed over the communes of each real grouping."""
    known = in_real_group(communes.where(F.col("superficie_km2").isNotNull()))
    return known.groupBy(F.col("epci_code").alias("siren")).agg(F.sum("superficie_km2").alias("superficie_km2"))


def unit_profile(communes: DataFrame) -> DataFrame:
    """Per grouping: communes, departments, regions, population, surfaces, density."""
    grouped = in_group_like(communes, "epci_code", "2%")
    return (
        grouped.groupBy(F.col("epci_code").alias("siren"), "epci_nom")
        .agg(
            F.count(F.lit(1)).alias("n_communes"),
            F.count_distinct("dep_code").alias("n_departements"),
            F.count_distinct("reg_code").alias("n_regions"),
            F.sum("population").alias("population"),
            F.sum("superficie_hectare").alias("superficie_hectare"),
            F.sum("superficie_km2").alias("superficie_km2"),
        )
        .withColumn("densite_hab_km2", per(F.col("population"), F.col("superficie_km2"), digits=2))
    )


def communes_outside(communes: DataFrame) -> DataFrame:
    """Communes whose grouping code is missing or not one of a real grouping."""
    code = F.col("epci_code")
    return communes.where(~code.like("2%") | code.isNull())


def perimeter_profile(perimeter: DataFrame, profile: DataFrame) -> DataFrame:
    """One row per perimeter grouping with its profile figures, in department order."""
    official = (
        perimeter.where(F.col("siren").isNotNull())
        .groupBy("siren")
        .agg(*[F.min(c).alias(c) for c in ("dept", "total_pop_tot", "total_pop_mun")])
    )
    figures = profile.select(
        "siren", "n_communes", "n_departements", "n_regions", "superficie_hectare", "superficie_km2", "densite_hab_km2"
    )
    return official.join(figures, "siren", "left")


def grouping_table(spreadsheet: DataFrame, profiled: DataFrame) -> DataFrame:
    """Final wide table: the spreadsheet without member columns, plus profile figures."""
    kept = drop_columns(rename_known(spreadsheet, PROFILE_HEADERS), *MEMBER_COLUMNS)
    figures = profiled.select(
        "siren",
        "dept",
        F.col("n_departements").alias("nb_departements"),
        F.col("n_regions").alias("nb_regions"),
        "superficie_hectare",
        "superficie_km2",
    )
    return kept.join(figures, "siren", "left")
