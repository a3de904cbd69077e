"""Landed files to stored values to stored scores to a served list."""

import json

import pytest
from pyspark.sql import functions as F

from terrascore.plans import jobs, serving
from terrascore.plans import indicators as ind
from terrascore.plans.territory import Territory, clean_communes
from terrascore.sources.files import read_after_header_line
from terrascore.sources.tables import read_table
from terrascore.tables import COLUMNS, KEYS, conform, schema_of

A, B = "200000001", "200000002"


@pytest.fixture
def territory(texts):
    communes = texts(
        ["code_insee", "nom_standard", "code_postal", "dep_code", "epci_code", "epci_nom", "superficie_km2"],
        ["01001", "Alpha", "01400", "01", A, "a", "10"], ["02001", "Beta", "02000", "02", B, "b", "20"],
    )
    perimeter = texts(
        ["dept", "siren", "insee", "total_pop_tot"], ["01", A, "01001", "1 000"], ["02", B, "02001", "2 000"]
    )
    return Territory(clean_communes(communes), perimeter)


@pytest.fixture
def landed(spark, tmp_path):
    d = tmp_path / "landed"
    (d / "i130").mkdir(parents=True)

    def put(name, body):
        (d / name).write_text(body, encoding="utf-8")

    put("i032.csv", f"Titre\nSource;x\nCode;Libellé;{ind.OVERCROWDING_VALUE}\n{A};a;3.5\n{B};b;N/A\n")
    for name, header in (("i147", ind.PHARMACY_DISTANCE), ("i148", ind.EMERGENCY_DISTANCE)):
        put(f"{name}.csv", f'Titre, "cité"\n\nCode,Libellé,{header}\n01001,"Alpha, la",2.5\n02001,Beta,4\n')
    put("i149.csv", f"territoryid,type_lieu,valeur\n{A},{ind.CARPOOL_AREA},3\n{B},Autre,5\n")
    put("i150.csv", f"territoryid,valeur\n{A},30\n{B},10\n")
    put("sau_2025.csv", f"date_mesure,geocode_epci,valeur\n2020-01-01,{A},500\n")
    put("catnat_gaspar.csv", "cod_commune;x\n01001;1\n01001;2\n")
    put("rna_waldec_1.csv", "id;position;adrs_codeinsee;adrs_codepostal\nW1;A;01001;01400\nW2;D;01001;01400\n")
    put("pharmacies.csv", ";".join(f"c{i}" for i in range(20)) + "\n" + ";".join(["x"] * 15 + ["01400 A", "x", "x", "x", "Pharmacie"]) + "\n")
    put("medias.html", '<a href="#">Radio (Alpha)</a>\n<a href="#">Mag (Beta)</a>\n')
    put("medias.tsv", "x\ny\nNom\tType\nMag\tp\n")
    put("i058.csv", ",".join(f'"{h}"' for h in ind.URBAN_ZONE_HEADERS) + f'\n{A},a,CA,"10","2,5","25 %"\n')
    for i, siren in enumerate((A, B)):
        (d / "i130" / f"{i}.json").write_text(json.dumps({"results": [{"numepci": siren, "txcouv_epci": 50.0 + i}]}, indent=1))
    import struct

    line = struct.pack("<BII", 1, 2, 2) + struct.pack("<4d", 3.0, 46.5, 3.0, 46.6)
    spark.createDataFrame([(1, "01001", bytearray(line))], "id_osm long, code_com_d string, geometry binary").write.parquet(
        str(d / "amenagement_cyclable.parquet")
    )
    return str(d)


EXPECTED = {
    "i032": [(A, 3.5)], "i058": [(A, 4.45)], "i066": [(A, 10.0)], "i096": [(A, 1.0)], "i113": [(A, 50.0)],
    "i130": [(A, 50.0), (B, 51.0)], "i131": [(A, 1.0), (B, 0.0)], "i147": [(A, 2.5), (B, 4.0)],
    "i148": [(A, 2.5), (B, 4.0)], "i149": [(A, 30.0)], "i150": [(A, 300.0), (B, 50.0)], "i158": [(A, 0.2)],
}


def test_landed_files_to_a_served_list(spark, rows, texts, territory, landed, tmp_path):
    path, scores_path = str(tmp_path / "valeurs"), str(tmp_path / "scores")
    for indicator_id, expected in EXPECTED.items():
        values = jobs.compute_indicator(spark, indicator_id, landed, territory)
        got = [(r[0], r[1]) for r in rows(values, "id_epci", "valeur_brute")]
        assert got == [(k, pytest.approx(v, abs=0.01)) for k, v in expected], indicator_id
        jobs.store_values(values, path)
    stored = read_table(spark, path)
    assert stored.count() == sum(len(v) for v in EXPECTED.values())
    assert set(jobs.LANDED) == set(EXPECTED) == set(ind.YEAR_AND_UNIT)

    known = texts(["id_indicateur", "libelle"], ["i150", "Trajets"])
    with pytest.raises(ValueError, match="i147"):
        jobs.store_values(stored, path, known)
    assert jobs.register_indicators(known, stored).count() == len(EXPECTED)

    jobs.store_scores(jobs.score_year(stored, ["i147", "i150"], 2024), scores_path)
    scores = read_table(spark, scores_path)
    assert rows(scores, "id_epci", "id_indicateur", F.col("score_global").cast("double")) == [
        (A, "i147", 0.0), (A, "i150", 100.0), (B, "i147", 100.0), (B, "i150", 0.0),
    ]
    areas = texts(["id_epci", "libelle", "departement_code", "region_code"], [A, "Aa", "01", "84"], [B, "Bb", "02", "32"])
    page = serving.list_scores(scores, areas, order_by="score")
    assert [tuple(r) for r in page.select("libelle", "score_global").collect()] == [("Aa", 50.0), ("Bb", 50.0)]

    def links(key, *pairs):
        return texts(["id_indicateur", key], *pairs)

    totals = jobs.score_areas(
        scores, links("id_besoin", ["i147", "n1"], ["i150", "n2"], ["i150", "n1"]), links("id_objectif", ["i147", "o1"]),
        links("id_type", ["i150", "t1"]),
    )
    assert totals.schema["score_global"].dataType.simpleString() == "decimal(5,2)"
    assert [tuple(map(str, r)) for r in totals.orderBy("id_epci").select("id_epci", "score_global", "score_besoin", "score_objectif", "score_type").collect()] == [
        (A, "50.00", "75.00", "0.00", "100.00"), (B, "50.00", "25.00", "100.00", "0.00"),
    ]


def test_a_second_run_replaces_values(spark, rows, territory, landed, tmp_path):
    path = str(tmp_path / "valeurs")
    values = jobs.compute_indicator(spark, "i150", landed, territory)
    jobs.store_values(values, path)
    jobs.store_values(values.withColumn("valeur_brute", F.col("valeur_brute") + 1), path)
    assert rows(read_table(spark, path), "id_epci", "valeur_brute") == [(A, 301.0), (B, 51.0)]


def test_header_line_reader(spark, rows, tmp_path):
    (tmp_path / "x.tsv").write_text("a\nb\nNom\tType\n\nX \"q\"\tp\nY\n", encoding="utf-8")
    df = read_after_header_line(spark, str(tmp_path / "x.tsv"), 2, "\t")
    assert rows(df) == sorted([('X "q"', "p"), ("Y", None)], key=repr)
    (tmp_path / "y.tsv").write_text("a\n")
    with pytest.raises(ValueError):
        read_after_header_line(spark, str(tmp_path / "y.tsv"), 2, "\t")


def test_tables(texts):
    assert set(COLUMNS) == set(KEYS)
    for table, keys in KEYS.items():
        assert set(keys) <= set(schema_of(table).fieldNames())
    full = conform(texts(["id_epci", "libelle"], ["1", "a"]), "epci")
    assert full.schema.fieldNames() == schema_of("epci").fieldNames() and full.first()["meta"] == "{}"
    part = conform(texts(["id_epci", "id_indicateur", "valeur_brute"], ["1", "i1", "2.5"]), "valeur_indicateur", partial=True)
    assert tuple(part.first()) == ("1", "i1", 0, 2.5)
    for bad in (texts(["id_epci", "x"], ["1", "2"]), texts(["libelle"], ["a"])):
        with pytest.raises(ValueError):
            conform(bad, "epci")
