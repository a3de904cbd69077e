"""Indicator jobs on a small territory with every awkward row."""

import struct

import pytest
from pyspark.sql import functions as F

from terrascore.plans import indicators as ind
from terrascore.plans.territory import (
    Territory, clean_communes, communes_outside, grouping_table, load_territory, perimeter_profile, populations,
    surfaces, unit_profile,
)
from terrascore.sources.files import link_entities

A, B, C, NONE = "200000001", "200000002", "200000003", "ZZZZZZZZZ"
COMMUNE_COLUMNS = [
    "code_insee", "nom_standard", "code_postal", "reg_code", "dep_code", "epci_code", "epci_nom", "population",
    "superficie_hectare", "superficie_km2",
]
COMMUNES = [
    ["01001", "Alpha", "1400.0", "84", "01", A, "Epci A", "1 000", "1000", "10"],
    ["01002", "Beta", "1400.0", "84", "01", A, "Epci A", "500", "2000", "20"],  # shares its postal code
    ["02001", "Moulins", "02000", "32", "02", B, "Epci B", "300", "3000", "30"],
    ["03001", "Moulins", "03000", "84", "03", B, "Epci B", "200", "1000", "10"],
    ["04001", "Delta", "04000", "93", "04", NONE, "Sans", "100", "500", "5"],  # in no grouping
    ["05001", "Eta", "05000", "93", "05", None, None, "50", "500", "5"],
    ["2A004", "Ajaccio", "20000", "94", "2A", C, "Epci C", "70", None, None],  # no surface, no facts
]
# one row per member commune; C has a zero population, A is written in two ways
PERIMETER = [
    ["01", A, "01001", "12 345", "10 000"],
    ["01", A, "01002", "12 345", "10 000"],
    ["02", B, "02001", "2 000", "2 000"],
    ["02", B, "03001", "2 000", "2 000"],
    ["2A", C, "2A004", "0", "0"],
]


@pytest.fixture
def territory(spark, texts):
    communes = clean_communes(texts(COMMUNE_COLUMNS, *COMMUNES))
    return Territory(communes, texts(["dept", "siren", "insee", "total_pop_tot", "total_pop_mun"], *PERIMETER))


@pytest.fixture
def values(rows):
    return lambda df: [(r[0], r[1]) for r in rows(df, "id_epci", "valeur_brute")]


def test_dimensions(territory, rows):
    assert rows(populations(territory.perimeter)) == [(A, 12345.0), (B, 2000.0), (C, 0.0)]
    assert rows(surfaces(territory.communes)) == [(A, 30.0), (B, 40.0)]
    assert rows(territory.communes.where("code_insee = '01001'"), "code_postal", "population") == [("01400", 1000.0)]
    assert rows(communes_outside(territory.communes), "code_insee") == [("04001",), ("05001",)]


def test_profile(spark, territory, rows, texts):
    profile = unit_profile(territory.communes)
    assert rows(profile, "siren", "n_communes", "n_departements", "n_regions", "population", "densite_hab_km2") == [
        (A, 2, 1, 1, 1500.0, 50.0), (B, 2, 2, 2, 500.0, 12.5), (C, 1, 1, 1, 70.0, None),
    ]
    official = perimeter_profile(territory.perimeter, profile)
    assert rows(official, "siren", "dept", "n_communes") == [(A, "01", 2), (B, "02", 2), (C, "2A", 1)]
    sheet = texts(["N° SIREN", "Nom du groupement", "Département", "Superficie", "Nom membre"], [A, "Epci A", "?", "?", "m"])
    table = grouping_table(sheet, official)
    assert rows(table, "siren", "epci_nom", "dept", "nb_departements", "superficie_km2") == [(A, "Epci A", "01", 1, 30.0)]


def test_load_territory(spark, rows, tmp_path):
    (tmp_path / "c.csv").write_text("code_insee,code_postal,epci_code,superficie_km2\n01001,1400.0,200000001,10\n")
    (tmp_path / "p.csv").write_bytes("dept;siren;insee;nom;total_pop_tot\n01;200000001;01001;Évêché;12 345\n".encode("latin-1"))
    loaded = load_territory(spark, str(tmp_path / "c.csv"), str(tmp_path / "p.csv"))
    assert rows(loaded.communes, "code_postal", "superficie_km2") == [("01400", 10.0)]
    assert rows(loaded.perimeter, "nom") == [("Évêché",)]


def test_i032(values, texts):
    sheet = texts(["Code", "Libellé", ind.OVERCROWDING_VALUE], [A, "a", "3.5"], [B, "b", "N/A"], [C, "c", None])
    assert values(ind.indicator_i032(sheet)) == [(A, 3.5)]


def test_i130(values, texts):
    assert values(ind.indicator_i130(texts(["numepci", "txcouv_epci"], [A, "57.2"], [B, None]))) == [(A, 57.2)]


def zones_sheet(texts):
    return texts(
        list(ind.URBAN_ZONE_HEADERS) + ["Unnamed: 6"],
        [A, "a", "CA", "30,5", "2,5", "8,2 %", None], [B, "b", "CC", "40", "0", "0 %", None],
    )


def wkb(*points):
    return bytearray(struct.pack("<BII", 1, 2, len(points)) + b"".join(struct.pack("<dd", *p) for p in points))


def test_i058_and_count_report(spark, territory, values, rows, texts):
    line, point = wkb((3.0, 46.5), (3.0, 46.6)), bytearray(struct.pack("<BIdd", 1, 1, 3.0, 46.5))
    ways = spark.createDataFrame(
        [(1, "01001", line), (2, "01002", line), (3, "02001", line), (4, "01001", point), (5, "04001", line), (6, "99999", line)],
        "id_osm long, code_com_d string, geometry binary",
    )
    # about 11.1 km of meridian per line, on 2.5 km²; B has no built-up area, so no value
    (got,) = values(ind.indicator_i058(zones_sheet(texts), ways, territory))
    assert got[0] == A and got[1] == pytest.approx(2 * 11.11 / 2.5, abs=0.05)
    report = ind.cycleway_count_report(zones_sheet(texts), ways, territory.communes, unit_profile(territory.communes))
    assert rows(report, "siren", "total_amenagements", "amenagements_per_km2") == sorted(
        [(A, 3, 1.2), (B, 1, None), (C, None, None)], key=repr
    )


def test_i066_counts_once_per_commune_of_a_postcode(territory, values, texts):
    def line(address, kind):
        cells = ["x"] * 20
        cells[15], cells[19] = address, kind
        return cells

    sheet = texts(
        [f"c{i}" for i in range(20)],
        line("01400 ALPHA", "Pharmacie d'officine"), line(" 02000 MOULINS", "Pharmacie"), line("02000", "Laboratoire"),
        line(None, "Pharmacie"), line("04000 DELTA", "Pharmacie"), line("20000 AJACCIO", "Pharmacie"), line("01400", None),
    )
    # A: one pharmacy, two communes; C has no population, so no value
    assert values(ind.indicator_i066(sheet, territory)) == [(A, 1.62), (B, 5.0)]
    assert values(ind.indicator_i066(sheet, territory, one_group_per_postcode=True)) == [(A, 0.81), (B, 5.0)]


def test_i096(spark, territory, values, texts):
    lines = texts(
        ["value"],
        ['<a href="#">Radio (FM) (Alpha)</a><a href="#">Le Mag (Alpha)</a><a href="#">Le Mag (Alpha)</a>'],
        ['<a href="#">Info (Moulins)</a><a href="#">Sans ville</a><a href="#">Gros Titre (Beta)</a>'],
    )
    dependent = texts(["Nom"], ["Gros Titre"], [None])
    # Moulins exists twice, only the one in department 03 is meant
    assert values(ind.indicator_i096(link_entities(lines, "value"), dependent, territory)) == [(A, 2.0), (B, 1.0)]


def test_i113(territory, values, texts):
    sheet = texts(
        ["date_mesure", "geocode_epci", "valeur"], ["2020-01-01", A, "1500"], ["2019-01-01", B, "900"], ["2020", "9", "1"]
    )
    assert values(ind.indicator_i113(sheet, territory)) == [(A, 50.0)]


def associations_sheet(texts):
    return texts(
        ["id", "position", "adrs_codeinsee", "adrs_codepostal"],
        ["W1", "A", "1001.0", "1400.0"], ["W2", "A", "1001.0", None], ["W3", "A", "01001", "nan"],
        ["W4", "D", "01001", "01400"], ["W5", "A", "INSEE", "01400"], ["W6", "A", "02001", "0"],
        ["W6", "A", "02001", "2000"], ["W7", "A", "99999", ""], ["W8", "A", "04001", "04000"],
    )


def test_i131(territory, values, rows, texts):
    # three in A (two with a recovered postal code), W6 twice in B, none in C with no population
    assert values(ind.indicator_i131(associations_sheet(texts), territory)) == [(A, 0.24), (B, 0.5)]
    assert rows(ind.associations_report(associations_sheet(texts), territory), "siren", "nb_asso", "asso_per_1000_habitants") == [
        (A, 3, 0.3), (B, 2, 1.0),
    ]


def test_i131_gives_zero_to_a_grouping_without_associations(territory, values, texts):
    sheet = texts(["id", "position", "adrs_codeinsee", "adrs_codepostal"], ["W1", "A", "1001.0", "1400.0"])
    assert values(ind.indicator_i131(sheet, territory)) == [(A, 0.08), (B, 0.0)]


def distance_sheet(texts, header):
    return texts(["Code", "Libellé", header], ["01001", "x", "2.5"], ["01002", "x", "N/A"], ["02001", "x", "4"], ["03001", "x", "5.01"], ["04001", "x", "9"])


def test_i147_i148_and_report(territory, values, rows, texts):
    assert values(ind.indicator_i147(distance_sheet(texts, ind.PHARMACY_DISTANCE), territory)) == [(A, 2.5), (B, 4.51)]
    assert values(ind.indicator_i148(distance_sheet(texts, ind.EMERGENCY_DISTANCE), territory)) == [(A, 2.5), (B, 4.51)]
    both = ind.distance_report(
        distance_sheet(texts, ind.EMERGENCY_DISTANCE), distance_sheet(texts, ind.PHARMACY_DISTANCE), territory.communes
    )
    assert rows(both) == sorted([(A, 2.5, 2.5), (B, 4.51, 4.51), (C, None, None)], key=repr)


def test_i149_i150_and_report(territory, values, rows, texts):
    areas = texts(
        ["territoryid", "type_lieu", "valeur"], [A, ind.CARPOOL_AREA, "2"], [A, ind.CARPOOL_AREA, "1"], [A, "Autre", "9"],
        [C, ind.CARPOOL_AREA, "4"],
    )
    trips = texts(["territoryid", "valeur"], [B, "30"], [A, "x"])
    assert values(ind.indicator_i149(areas, territory)) == [(A, 2.43)]
    assert values(ind.indicator_i150(trips, territory)) == [(B, 150.0)]
    report = ind.carpool_report(areas, trips, territory)
    assert rows(report, "siren", "aires_covoit_pour_10k_hab", "nb_covoit_per_10k_hab") == sorted(
        [(A, 2.43, None), (B, None, 150.0), (C, None, None)], key=repr
    )


def test_i158_and_report(territory, values, rows, texts):
    orders = texts(["cod_commune"], ["01001"], ["01001"], ["01002"], ["04001"], ["2A004"], [None])
    assert values(ind.indicator_i158(orders, territory)) == [(A, 0.1)]
    counts = texts(["Code", "Libellé", ind.DISASTER_COUNT], [A, "a", "6"], ["75056", "p", "3"])
    perimeter = territory.perimeter.withColumn("nb_membres", F.lit("2"))
    report = ind.disasters_report(counts, Territory(territory.communes, perimeter))
    assert rows(report, "siren", "nb_cat_nat", "cat_nat_per_km2") == sorted(
        [(A, 6.0, 0.2), (B, None, None), (C, None, None)], key=repr
    )


def test_mediation(territory, rows, texts):
    places = texts(["id", "code_insee"], ["1", "01001"], ["2", "01001"], [None, "01001"], ["3", "04001"])
    report = ind.mediation_report(places, territory.communes, unit_profile(territory.communes))
    assert rows(report) == sorted([(A, 2, 13.33), (B, None, None), (C, None, None)], key=repr)


def test_substances(territory, rows, texts):
    sales = texts(
        ["annee", "code_insee", "quantite_substance"], ["2020", "01001", "1.5"], ["2020", "01002", "2"],
        ["2020", "02001", "nc"], ["2021", "03001", "4"], ["2021", "99999", "7"],
    )
    assert rows(ind.substances_by_year(sales, territory.perimeter)) == sorted(
        [("2020", "01", A, 3.5), ("2020", "02", B, None), ("2021", "02", B, 4.0)], key=repr
    )
    farmland = ind.farmland_by_group(texts(["codgeo", "sau2020"], ["01001", "10"], ["01002", "5.5"]), territory.perimeter)
    assert rows(farmland) == [("01", A, 15.5)]
    relative = texts(["siren", "pop_tot", "total_relatif"], [A, "12 345", "0.5"], [B, "1", "2"])
    assert rows(ind.substances_report(relative, farmland)) == [("01", A, 12345.0, "0.5", 15.5)]
