"""Reference sheets to tables: dimensions, links, territories, values and scores.

A sheet arrives as a frame of text columns. Repeated ids are settled by the last
row, so every sheet needs an explicit row number (``sheet_rows`` adds one).
"""

from __future__ import annotations

import logging
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrascore.functions.cleaning import (
    clean_code, clean_indicator_id, clean_text, is_flagged, is_present, to_float, to_int,
)
from terrascore.operators.aggregates import dedup_last
from terrascore.operators.joins import flags_to_links, keep_known, link_arrays
from terrascore.operators.keyed import missing_ids
from terrascore.operators.shape import trim_headers, wide_sheet_to_long
from terrascore.session import stage
from terrascore.sources.files import load_sheets
from terrascore.sources.tables import read_table
from terrascore.sources.together import recover, upsert_together
from terrascore.tables import KEYS, UNDATED, conform

logger = logging.getLogger(__name__)

ROW = "_ligne"

# Sheet names in the order they depend on each other.
NEEDS, OBJECTIVES, TYPES, INDICATORS = (
    "Table Besoins", "Table Objectifs", "Table Type indicateurs", "Table Indicateurs-Sources",
)
NEED_LINKS, OBJECTIVE_LINKS, TYPE_LINKS = (
    "Correspondance Indicateurs-Beso", "Correspondance Indicateurs-Obje", "Correspondance Indicateurs-Type",
)
AREAS, VALUES, SCORES = "Table EPCI", "Table Valeurs", "Table Scores indicateurs"
SHEETS = (NEEDS, OBJECTIVES, TYPES, INDICATORS, NEED_LINKS, OBJECTIVE_LINKS, TYPE_LINKS, AREAS, VALUES, SCORES)

# Headers of the link sheets and the ids their flags stand for.
NEED_CHOICES = ("Besoin 1", "Besoin 2", "Besoin 3", "Besoin 4", "Besoin 5")
OBJECTIVE_FLAGS = {"o1": "o1_Subsistance", "o2": "o2_Gestion-de-crise", "o3": "o3_Soutenabilité"}
TYPE_FLAGS = {"Typ1": "Typ1_Etat", "Typ2": "Typ2_Action"}
# Table column and sheet header of the area codes, counts and measures.
AREA_CODES = {"id_epci": "siren", "departement_code": "dept"}
AREA_COUNTS = {
    "population_commune": "total_pop_mun", "population_totale": "total_pop_tot",
    "nb_departements": "nb_departements", "nb_regions": "nb_regions", "nb_membres": "nb_membres",
    "nb_delegues": "nb_delegues", "nb_competences": "nb_competences",
}
AREA_MEASURES = {
    "surface_km2": "superficie_km2", "surface_urbanisee_km2": "superficie_urbanisee_km2",
    "densite_km2": "densite_par_km2", "potentiel_fiscal": "potentiel_fiscal",
    "dotation_globale": "dotation_globale", "dotation_compensation": "dotation_compensation",
    "dotation_intercommunalite": "dotation_intercommunalite",
}
# Source marks of imported rows.
AREA_SOURCE, VALUE_SOURCE = "Excel/Table EPCI", "Excel/Table Valeurs"


def sheet_rows(sheet: DataFrame) -> DataFrame:
    """Trimmed headers and a row number that follows the file order.

    The number is unique and grows along the file (partition, then line), which
    is all "the last row wins" needs; no global count is made.
    """
    return trim_headers(sheet).withColumn(ROW, F.monotonically_increasing_id())


def _text(sheet: DataFrame, *names: str) -> Column:
    """First usable text among the columns that exist."""
    present = [clean_text(F.col(f"`{n}`")) for n in names if n in sheet.columns]
    return F.coalesce(*present) if present else F.lit(None).cast("string")


def _cell(sheet: DataFrame, name: str) -> Column:
    return F.col(f"`{name}`") if name in sheet.columns else F.lit(None).cast("string")


def _label(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def _finish(rows: DataFrame, key: str) -> DataFrame:
    return dedup_last(rows.where(F.col(key).isNotNull()), [key], ROW).drop(ROW)


def ingest_needs(sheet: DataFrame) -> DataFrame:
    rows = sheet.select(
        _text(sheet, "ID_besoins").alias("id_besoin"),
        _label(_text(sheet, "Libellé")).alias("libelle"),
        _text(sheet, "Type_de_besoins", "Catégorie").alias("categorie"),
        _text(sheet, "Description").alias("description"),
        ROW,
    )
    return _finish(rows, "id_besoin")


def ingest_objectives(sheet: DataFrame) -> DataFrame:
    rows = sheet.select(
        _text(sheet, "ID_Objectifs").alias("id_objectif"),
        _label(_text(sheet, "Libellé")).alias("libelle"),
        _text(sheet, "Description").alias("description"),
        ROW,
    )
    return _finish(rows, "id_objectif")


def ingest_types(sheet: DataFrame) -> DataFrame:
    rows = sheet.select(
        _text(sheet, "ID_", "ID_Type").alias("id_type"),
        _label(_text(sheet, "Libellé")).alias("libelle"),
        _text(sheet, "Description").alias("description"),
        ROW,
    )
    return _finish(rows, "id_type")


def ingest_indicators(sheet: DataFrame) -> DataFrame:
    rows = sheet.select(
        clean_indicator_id(_cell(sheet, "ID_indicateurs")).alias("id_indicateur"),
        _label(_text(sheet, "Libellé_indicateurs")).alias("libelle"),
        _text(sheet, "Description").alias("description"),
        _text(sheet, "Domaine_Source_principale").alias("source_principale"),
        _text(sheet, "URL Source_Principale").alias("url_principale"),
        is_present(_cell(sheet, "API disponible")).alias("api_disponible"),
        _text(sheet, "Domaine_Source_secondaire").alias("source_secondaire"),
        _text(sheet, "URL_Source_Secondaire").alias("url_secondaire"),
        _text(sheet, "TYPE DE VALEUR").alias("type_valeur"),
        _text(sheet, "Unité").alias("unite"),
        ROW,
    )
    return _finish(rows, "id_indicateur")


def ingest_areas(sheet: DataFrame) -> DataFrame:
    sheet = trim_headers(sheet, lower=True)
    rows = sheet.select(
        *[clean_code(_cell(sheet, header)).alias(name) for name, header in AREA_CODES.items()],
        _label(_text(sheet, "epci_libellé")).alias("libelle"),
        _text(sheet, "nature_juridique").alias("forme_juridique"),
        *[to_int(_cell(sheet, header)).alias(name) for name, header in AREA_COUNTS.items()],
        *[to_float(_cell(sheet, header)).alias(name) for name, header in AREA_MEASURES.items()],
        _text(sheet, "ville_siege").alias("ville_siege"),
        F.lit(AREA_SOURCE).alias("source"),
        ROW,
    )
    return _finish(rows, "id_epci")


# --- links -------------------------------------------------------------------


def need_links(sheet: DataFrame, needs: DataFrame) -> DataFrame:
    """(id_indicateur, id_besoin, categorie, row) of every known need named in a row."""
    category = _text(sheet, "Type_de_besoins", "Type de besoins")
    choices = F.array(_text(sheet, "ID_Besoin", "Besoin 1"), *[_text(sheet, c) for c in NEED_CHOICES])
    rows = sheet.select(
        clean_indicator_id(_cell(sheet, "ID_Indicateurs")).alias("id_indicateur"),
        category.alias("categorie"),
        ROW,
        F.explode(F.array_distinct(choices)).alias("id_besoin"),
    ).where(F.col("id_indicateur").isNotNull() & F.col("id_besoin").isNotNull())
    return keep_known(rows, "id_besoin", needs, "id_besoin")


def objective_links(sheet: DataFrame, objectives: DataFrame) -> DataFrame:
    return _flag_links(sheet, "ID_Indicateurs", OBJECTIVE_FLAGS, "id_objectif", objectives)


def type_links(sheet: DataFrame, types: DataFrame) -> DataFrame:
    return _flag_links(sheet, "ID_indicateurs", TYPE_FLAGS, "id_type", types)


def _flag_links(sheet: DataFrame, id_header: str, flags: Mapping[str, str], key: str, dim: DataFrame) -> DataFrame:
    raised = {code: is_flagged(_cell(sheet, header)) for code, header in flags.items()}
    rows = flags_to_links(sheet, clean_indicator_id(_cell(sheet, id_header)).alias("id_indicateur"), raised, key)
    return keep_known(rows.where(F.col("id_indicateur").isNotNull()), key, dim, key)


def attach_links(dim: DataFrame, links: DataFrame, key: str, item: str, name: str) -> DataFrame:
    """Dimension with its sorted array of linked ids (empty where there are none)."""
    arrays = link_arrays(links, key, item, name)
    return dim.join(arrays, key, "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))


def settle_categories(needs: DataFrame, links: DataFrame) -> DataFrame:
    """A need takes the category of the first link row that names one."""
    named = links.where(F.col("categorie").isNotNull())
    first = named.groupBy("id_besoin").agg(F.min_by("categorie", ROW).alias("_cat"))
    joined = needs.join(first, "id_besoin", "left")
    return joined.withColumn("categorie", F.coalesce("_cat", "categorie")).drop("_cat")


# --- wide values and scores --------------------------------------------------


def ingest_values(sheet: DataFrame) -> DataFrame:
    """Long undated values; a cell that is not a number keeps a null value."""
    long = _long_sheet(sheet, "valeur_brute")
    return long.withColumn("source", F.lit(VALUE_SOURCE))


def ingest_scores(sheet: DataFrame) -> DataFrame:
    """Long undated scores: a partial row of the score table (score and label only)."""
    return _long_sheet(sheet, "score_indicateur")


def _long_sheet(sheet: DataFrame, value: str) -> DataFrame:
    long = wide_sheet_to_long(sheet, value, keep=(ROW,)).withColumn("annee", F.lit(UNDATED))
    # the sheet is read column by column: of an area and indicator named twice, the later column wins, then the later row
    order = F.struct("_position", ROW).alias(ROW)
    ordered = long.select(*[c for c in long.columns if c not in (ROW, "_position")], order)
    return dedup_last(ordered, ["id_epci", "id_indicateur", "annee"], ROW).drop(ROW)


# --- the whole import --------------------------------------------------------


def ingest_sheets(sheets: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """All tables of an import, as lazy frames, from whichever sheets exist."""
    frames = {name: sheet_rows(df) for name, df in sheets.items()}
    tables: dict[str, DataFrame] = {}
    for name, table, ingest in (
        (NEEDS, "besoin", ingest_needs),
        (OBJECTIVES, "objectif", ingest_objectives),
        (TYPES, "type_indicateur", ingest_types),
        (INDICATORS, "indicateur", ingest_indicators),
        (AREAS, "epci", ingest_areas),
        (VALUES, "valeur_indicateur", ingest_values),
        (SCORES, "score_indicateur", ingest_scores),
    ):
        if name in frames:
            tables[table] = ingest(frames[name])

    for name, dim, key, array, make, bridge in (
        (NEED_LINKS, "besoin", "id_besoin", "ids_besoins", need_links, "indicateur_besoin"),
        (OBJECTIVE_LINKS, "objectif", "id_objectif", "ids_objectifs", objective_links, "indicateur_objectif"),
        (TYPE_LINKS, "type_indicateur", "id_type", "ids_types", type_links, "indicateur_type"),
    ):
        if name not in frames or dim not in tables or "indicateur" not in tables:
            continue
        links = make(frames[name], tables[dim])
        if dim == "besoin":
            tables[dim] = settle_categories(tables[dim], links)
        tables[dim] = attach_links(tables[dim], links, key, "id_indicateur", "ids_indicateurs")
        tables["indicateur"] = attach_links(tables["indicateur"], links, "id_indicateur", key, array)
        known = keep_known(links, "id_indicateur", tables["indicateur"], "id_indicateur")
        tables[bridge] = known.select("id_indicateur", key).distinct()
    return tables


def check_references(tables: Mapping[str, DataFrame], stored: Mapping[str, DataFrame] | None = None) -> None:
    """Every value and score must name an area and an indicator of the import or of what is stored."""
    known = {
        name: [df.select(KEYS[name][0]) for df in (tables.get(name), (stored or {}).get(name)) if df is not None]
        for name in ("epci", "indicateur")
    }
    for fact in ("valeur_indicateur", "score_indicateur"):
        for dim, key in (("epci", "id_epci"), ("indicateur", "id_indicateur")):
            if fact in tables and known[dim]:
                ids = reduce(DataFrame.union, known[dim])
                unknown = [r[0] for r in missing_ids(tables[fact], key, ids, key).limit(20).collect()]
                if unknown:
                    raise ValueError(f"{fact}: unknown {key} {sorted(unknown)}")


def import_folder(spark: SparkSession, folder: str, target: str) -> dict[str, DataFrame]:
    """Load exported sheets, check them, and merge them into one stored table each below ``target``.

    Rows are merged by key: what the sheets do not name stays, and so do the columns
    they do not bring (of a score row everything but score and label). Every table is computed and
    checked before the first one is written, so a faulty workbook leaves the target untouched, and all
    tables are changed or none: a failure between two of them takes back what was written.
    Returns the stored tables that the import touched.
    """
    recover(spark, target)
    tables = {
        name: stage(conform(df, name, partial=True), name)
        for name, df in ingest_sheets(load_sheets(spark, folder, SHEETS)).items()
    }
    stored = {name: read_table(spark, f"{target}/{name}", name) for name in ("epci", "indicateur")}
    check_references(tables, stored)
    for name, rows in upsert_together(spark, target, tables).items():
        logger.info("table %s: %d rows merged", name, rows)
    found = {name: read_table(spark, f"{target}/{name}", name) for name in tables}
    return {name: tables[name] if df is None else df for name, df in found.items()}
