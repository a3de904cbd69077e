"""Runs of the jobs: landed files to stored values, stored values to stored scores."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrascore.operators.filters import indicators_of_year
from terrascore.operators.keyed import require_ids, with_placeholders
from terrascore.operators.scoring import global_scores, score_rows
from terrascore.plans import indicators as ind
from terrascore.plans.territory import Territory
from terrascore.session import staged
from terrascore.sources.files import (
    read_after_header_line, read_columnar, read_delimited, read_folder, read_link_entities,
)
from terrascore.sources.records import explode_results, read_pages
from terrascore.sources.tables import read_touched, upsert_stored
from terrascore.tables import conform

Compute = Callable[[SparkSession, str, Territory], DataFrame]


def _lines(rows: DataFrame) -> DataFrame:
    """Rows with the order of their file and line, taken before anything is shuffled."""
    return rows.withColumn(ind.LINE, F.struct(F.input_file_name(), F.monotonically_increasing_id()))


# the fields of the paged records that the job reads; naming them saves a pass that infers all
COVERAGE_PAGES = "results array<struct<numepci: string, txcouv_epci: string>>"


def _preamble(spark: SparkSession, path: str, sep: str, order: str | None = None) -> DataFrame:
    return read_after_header_line(spark, path, skip=2, sep=sep, order=order)


# Landed files below one folder, and the job that reads them.
LANDED: dict[str, Compute] = {
    "i032": lambda s, d, t: ind.indicator_i032(_preamble(s, f"{d}/i032.csv", ";", ind.LINE)),
    "i058": lambda s, d, t: ind.indicator_i058(
        read_delimited(s, f"{d}/i058.csv"), read_columnar(s, f"{d}/amenagement_cyclable.parquet"), t
    ),
    "i066": lambda s, d, t: ind.indicator_i066(read_delimited(s, f"{d}/pharmacies.csv", sep=";"), t),
    "i096": lambda s, d, t: ind.indicator_i096(
        read_link_entities(s, f"{d}/medias.html"), _preamble(s, f"{d}/medias.tsv", "\t"), t
    ),
    "i113": lambda s, d, t: ind.indicator_i113(_lines(read_delimited(s, f"{d}/sau_2025.csv")), t),
    "i130": lambda s, d, t: ind.indicator_i130(_lines(explode_results(read_pages(s, f"{d}/i130", COVERAGE_PAGES)))),
    "i131": lambda s, d, t: ind.indicator_i131(
        read_folder(
            s, d, "rna_waldec*.csv", ["id", "position", "adrs_codeinsee", "adrs_codepostal"],
            where=F.col("position") == "A", sep=";", multi_line=True,
        ),
        t,
    ),
    "i147": lambda s, d, t: ind.indicator_i147(_preamble(s, f"{d}/i147.csv", ","), t),
    "i148": lambda s, d, t: ind.indicator_i148(_preamble(s, f"{d}/i148.csv", ","), t),
    "i149": lambda s, d, t: ind.indicator_i149(read_delimited(s, f"{d}/i149.csv"), t),
    "i150": lambda s, d, t: ind.indicator_i150(_lines(read_delimited(s, f"{d}/i150.csv")), t),
    "i158": lambda s, d, t: ind.indicator_i158(read_delimited(s, f"{d}/catnat_gaspar.csv", sep=";"), t),
}


def compute_indicator(spark: SparkSession, indicator_id: str, folder: str, territory: Territory) -> DataFrame:
    """Values of one indicator from its landed files."""
    return LANDED[indicator_id](spark, folder, territory)


def _store(rows: DataFrame, table: str, path: str) -> int:
    return upsert_stored(path, conform(rows, table, partial=True), table)


def store_values(values: DataFrame, path: str, indicators: DataFrame | None = None) -> int:
    """Upsert values into the value table; with ``indicators`` unknown ids are an error. Returns the values stored.

    The job runs once: its rows are staged, then checked, then merged.
    """
    with staged(values.withColumn("date_import", F.current_timestamp()), "values") as rows:
        if indicators is not None:
            rows = require_ids(rows, "id_indicateur", indicators, "id_indicateur")
        return _store(rows, "valeur_indicateur", path)


def register_indicators(indicators: DataFrame, values: DataFrame) -> DataFrame:
    """Indicator dimension with a placeholder for every indicator the values bring."""
    return with_placeholders(indicators, values, "id_indicateur", "id_indicateur", "libelle")


def score_year(values: DataFrame, indicator_ids: Sequence[str], year: int) -> DataFrame:
    """Min-max scores of some indicators for one year."""
    return score_rows(indicators_of_year(values, indicator_ids, year))


def store_scores(scores: DataFrame, path: str) -> int:
    """Upsert score rows; columns they lack keep what is stored."""
    return _store(scores.withColumn("updated_at", F.current_timestamp()), "score_indicateur", path)


def rescore_changed(batch: DataFrame, values_path: str, scores_path: str) -> int:
    """Score again the indicators and years that a stored batch of values names, and no others.

    A value moves the scores of its own indicator and year only, and both tables lie in folders by these two:
    just the named folders are read and rewritten, whatever else is stored. A value that the batch set to null
    loses its score. Returns the number of scores written; 0 where nothing is stored.
    """
    spark, keys = batch.sparkSession, ["id_epci", "id_indicateur", "annee"]
    with staged(conform(batch, "valeur_indicateur", partial=True).select(*keys), "changes") as changes:
        touched = read_touched(spark, values_path, "valeur_indicateur", changes)
        if touched is None:
            return 0
        scored = score_rows(touched)
        stored = read_touched(spark, scores_path, "score_indicateur", changes)
        if stored is not None:  # only a score that exists can be lost
            gone = touched.where(F.col("valeur_brute").isNull()).select(*keys)
            scored = scored.unionByName(gone.join(stored.select(*keys), keys, "left_semi"), allowMissingColumns=True)
        return store_scores(scored, scores_path)


def score_areas(
    scores: DataFrame, needs: DataFrame, objectives: DataFrame, types: DataFrame
) -> DataFrame:
    """Rows of the global score table from indicator scores and the three link tables."""
    rows = global_scores(
        scores, ["id_epci", "annee"], "id_indicateur", "score_indicateur",
        {
            "score_besoin": (needs, "id_besoin"),
            "score_objectif": (objectives, "id_objectif"),
            "score_type": (types, "id_type"),
        },
    )
    return conform(rows, "score_global")
