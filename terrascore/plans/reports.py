"""The analysts' tables: landed files to one exported CSV folder each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrascore.plans import indicators as ind
from terrascore.plans.territory import Territory, grouping_table, perimeter_profile, unit_profile
from terrascore.sources.files import read_after_header_line, read_columnar, read_delimited, read_folder
from terrascore.sources.tables import write_delimited

Report = Callable[[SparkSession, str, Territory], DataFrame]


def _distances(spark: SparkSession, path: str) -> DataFrame:
    return read_after_header_line(spark, path, skip=2)


# Landed files below one folder, and the table made of them.
REPORTS: dict[str, Report] = {
    "associations": lambda s, d, t: ind.associations_report(
        read_folder(
            s, d, "rna_waldec*.csv", ["id", "position", "adrs_codeinsee", "adrs_codepostal"],
            where=F.col("position") == "A", sep=";", multi_line=True,
        ),
        t,
    ),
    "catastrophes": lambda s, d, t: ind.disasters_report(_distances(s, f"{d}/cat_nat.csv"), t),
    "groupements": lambda s, d, t: grouping_table(
        read_delimited(s, f"{d}/tableur_epci.csv"), perimeter_profile(t.perimeter, unit_profile(t.communes))
    ),
    "covoiturage": lambda s, d, t: ind.carpool_report(
        read_delimited(s, f"{d}/lieux_covoiturage.csv"), read_delimited(s, f"{d}/trajets_covoiturage.csv"), t
    ),
    "distances_soin": lambda s, d, t: ind.distance_report(
        _distances(s, f"{d}/dist_urgence.csv"), _distances(s, f"{d}/dist_pharma.csv"), t.communes
    ),
    "mediation_numerique": lambda s, d, t: ind.mediation_report(
        read_delimited(s, f"{d}/mediation_numerique.csv"), t.communes, unit_profile(t.communes)
    ),
    "phyto": lambda s, d, t: ind.substances_report(
        read_delimited(s, f"{d}/phyto_relatif.csv"), ind.farmland_by_group(read_delimited(s, f"{d}/sau.csv"), t.perimeter)
    ),
    "phyto_annuel": lambda s, d, t: ind.substances_by_year(read_delimited(s, f"{d}/ventes_substances.csv"), t.perimeter),
    "zones_urbanisees": lambda s, d, t: ind.cycleway_count_report(
        read_delimited(s, f"{d}/zones_urbaines.csv"), read_columnar(s, f"{d}/amenagement_cyclable.parquet"), t.communes,
        unit_profile(t.communes),
    ),
}


def run_report(spark: SparkSession, name: str, folder: str, territory: Territory, target: str) -> str:
    """Compute one report from its landed files and export it as ``<target>/<name>``, replacing an earlier export."""
    path = f"{target}/{name}"
    write_delimited(REPORTS[name](spark, folder, territory), path, mode="overwrite")
    return path
