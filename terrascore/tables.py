"""The stored tables: columns, types, keys and defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column names and types of the stored tables, in order.
COLUMNS = {
    "epci": """id_epci string, libelle string, departement_code string, region_code string, forme_juridique string,
        population_commune int, population_totale int, surface_km2 double, surface_urbanisee_km2 double,
        densite_km2 double, nb_departements int, nb_regions int, nb_membres int, nb_delegues int, nb_competences int,
        potentiel_fiscal double, dotation_globale double, dotation_compensation double,
        dotation_intercommunalite double, ville_siege string, source string, date_import timestamp, meta string""",
    "indicateur": """id_indicateur string, libelle string, description string, source_principale string,
        url_principale string, api_disponible boolean, source_secondaire string, url_secondaire string,
        type_valeur string, unite string, ids_besoins array<string>, ids_objectifs array<string>,
        ids_types array<string>, meta string, created_at timestamp, updated_at timestamp""",
    "besoin": """id_besoin string, libelle string, categorie string, description string,
        ids_indicateurs array<string>, meta string, created_at timestamp, updated_at timestamp""",
    "objectif": """id_objectif string, libelle string, description string, ids_indicateurs array<string>,
        meta string, created_at timestamp, updated_at timestamp""",
    "type_indicateur": """id_type string, libelle string, description string, ids_indicateurs array<string>,
        meta string, created_at timestamp, updated_at timestamp""",
    "indicateur_besoin": "id_indicateur string, id_besoin string",
    "indicateur_objectif": "id_indicateur string, id_objectif string",
    "indicateur_type": "id_indicateur string, id_type string",
    "valeur_indicateur": """id_epci string, id_indicateur string, annee int, libelle_epci string,
        valeur_brute double, unite string, source string, date_import timestamp, meta string""",
    "score_indicateur": """id_epci string, id_indicateur string, annee int, libelle_epci string,
        score_indicateur decimal(5,2), id_besoin string, score_besoin decimal(5,2), id_objectif string,
        score_objectif decimal(5,2), id_type string, score_type decimal(5,2), score_global decimal(5,2),
        rapport string, updated_at timestamp""",
    "score_global": """id_epci string, annee int, score_global decimal(5,2), score_besoin decimal(5,2),
        score_objectif decimal(5,2), score_type decimal(5,2), rapport string, updated_at timestamp""",
    "territories": """code_siren string, name string, type string, population int, department string, region string,
        score decimal(5,2), score_water decimal(5,2), score_food decimal(5,2), score_housing decimal(5,2),
        score_healthcare decimal(5,2), score_security decimal(5,2), score_education decimal(5,2),
        score_social_cohesion decimal(5,2), score_nature decimal(5,2), score_local_economy decimal(5,2),
        score_energy decimal(5,2), score_mobility decimal(5,2), data_year int, created_at timestamp,
        updated_at timestamp""",
}
KEYS = {
    "epci": ("id_epci",), "indicateur": ("id_indicateur",), "besoin": ("id_besoin",), "objectif": ("id_objectif",),
    "type_indicateur": ("id_type",), "indicateur_besoin": ("id_indicateur", "id_besoin"),
    "indicateur_objectif": ("id_indicateur", "id_objectif"), "indicateur_type": ("id_indicateur", "id_type"),
    "valeur_indicateur": ("id_epci", "id_indicateur", "annee"),
    "score_indicateur": ("id_epci", "id_indicateur", "annee"), "score_global": ("id_epci", "annee"),
    "territories": ("code_siren",),
}
# the year of rows without a date
UNDATED = 0
# folders of the stored tables: a job replaces only those of its own indicator and year, so two jobs never meet
PARTITIONS = {
    "valeur_indicateur": ("annee", "id_indicateur"), "score_indicateur": ("annee", "id_indicateur"),
    "score_global": ("annee",),
}


def schema_of(table: str) -> T.StructType:
    return T.StructType.fromDDL(COLUMNS[table])


def defaults_of(table: str) -> dict[str, Column]:
    """What a new row has in the columns that its batch does not bring."""
    return {f.name: _default(table, f).cast(f.dataType) for f in schema_of(table).fields}


def _default(table: str, field: T.StructField) -> Column:
    """Value of a column the rows do not bring."""
    if field.name in ("date_import", "created_at", "updated_at"):
        return F.current_timestamp()
    if field.name == "annee":
        return F.lit(UNDATED)
    if field.name == "meta":
        return F.lit("{}")
    if field.name == "api_disponible":
        return F.lit(False)
    if field.name == "score" and table == "territories":
        return F.lit(0)
    if isinstance(field.dataType, T.ArrayType):
        return F.array()
    return F.lit(None)


def conform(df: DataFrame, table: str, partial: bool = False) -> DataFrame:
    """Rows in the columns, order and types of a stored table.

    Missing columns get their default; with ``partial`` they are left out, so an
    upsert keeps what is stored. An unknown column or a missing key is an error.
    """
    fields = {f.name: f for f in schema_of(table).fields}
    unknown = set(df.columns) - set(fields)
    lacking = set(KEYS[table]) - set(df.columns) - {"annee"}
    if unknown or lacking:
        raise ValueError(f"{table}: unknown columns {sorted(unknown)}, missing keys {sorted(lacking)}")
    given = set(df.columns)
    wanted = [f for f in fields.values() if not partial or f.name in given or f.name == "annee"]
    return df.select(
        *[
            (F.col(f.name) if f.name in given else _default(table, f)).cast(f.dataType).alias(f.name)
            for f in wanted
        ]
    )
