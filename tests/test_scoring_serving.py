import json

import pytest
from pyspark.sql import functions as F

from terrascore.operators import scoring
from terrascore.plans import serving

SCHEMA = "id_epci string, id_indicateur string, annee int, valeur_brute double"


@pytest.fixture
def values(spark):
    return spark.createDataFrame(
        [
            ("a", "i001", 2024, 10.0), ("b", "i001", 2024, 20.0), ("c", "i001", 2024, 13.0), ("d", "i001", 2024, None),
            ("a", "i002", 2024, 5.0), ("b", "i002", 2024, 5.0), ("a", "i001", 2023, 7.0),
        ],
        SCHEMA,
    )


def test_min_max_scores(values, rows):
    scored = scoring.min_max_scores(values)
    assert rows(scored, "id_epci", "id_indicateur", "annee", "score_indicateur") == [
        ("a", "i001", 2023, 0.0), ("a", "i001", 2024, 0.0), ("a", "i002", 2024, 0.0), ("b", "i001", 2024, 100.0),
        ("b", "i002", 2024, 0.0), ("c", "i001", 2024, 30.0),
    ]
    row = scoring.score_rows(values).where("id_epci = 'c'").first()
    assert json.loads(row["rapport"]) == {"valeur_brute": 13.0, "min": 10.0, "max": 20.0}
    assert float(row["score_global"]) == 30.0


def test_scores_by_link_and_global(spark, rows):
    scores = spark.createDataFrame(
        [("a", 0, "i1", 10.0, "n1"), ("a", 0, "i2", 30.0, "n1"), ("a", 0, "i3", None, "n2"), ("b", 0, "i3", 50.0, None)],
        "id_epci string, annee int, id_indicateur string, score_indicateur double, id_besoin string",
    )
    links = spark.createDataFrame(
        [("i1", "n1"), ("i1", "n1"), ("i2", "n1"), ("i2", "n2"), ("i3", "n2")], "id_indicateur string, id_besoin string"
    )
    by = ["id_epci", "annee"]
    means = scoring.mean_score_by_link(scores, links, by, "id_indicateur", "id_besoin", "score_indicateur", "m")
    assert rows(means) == [("a", 0, "n1", 20.0), ("a", 0, "n2", 30.0), ("b", 0, "n2", 50.0)]
    total = scoring.global_scores(scores, by, "id_indicateur", "score_indicateur", {"score_besoin": (links, "id_besoin")})
    assert rows(total) == [("a", 0, 20.0, 25.0), ("b", 0, 50.0, 50.0)]


def test_flash_report(spark, rows):
    columns = {"BV1": "score_water", "BV2": "score_food"}
    areas = spark.createDataFrame([("200", 85.0, None), ("300", 10.0, 50.0)], "siren string, score_water double, score_food double")
    overrides = spark.createDataFrame([("200", "score_food", 60.0), ("300", "score_water", 0.0)], "siren string, champ string, valeur double")
    metrics = scoring.flash_metrics(areas, overrides, "siren", columns)
    assert rows(metrics, "siren", "code", "libelle", "base", "valeur", "interpretation") == [
        ("200", "BV1", "Accès à l'eau", 85.0, 85.0, "Excellent"), ("200", "BV2", "Alimentation", 0.0, 60.0, "Bon"),
        ("300", "BV1", "Accès à l'eau", 10.0, 0.0, "Critique"), ("300", "BV2", "Alimentation", 50.0, 50.0, "Moyen"),
    ]
    assert rows(scoring.flash_summary(metrics, "siren")) == [("200", 42.5, 72.5), ("300", 30.0, 25.0)]


def test_group_means(spark, rows):
    wide = spark.createDataFrame([("a", *[10.0] * 5, None, None, None, 30.0, None, 60.0)], "id string, " + ", ".join(
        f"{c} double" for c in scoring.NEED_COLUMNS.values()
    ))
    means = scoring.group_means_of_needs(wide, ["id"]).first().asDict()
    assert means["Subsistance"] == 10.0 and means["Gestion de crise"] == 0.0 and means["Soutenabilité"] == 45.0
    assert means["État"] == pytest.approx((10 * 3 + 60) / 4)


@pytest.fixture
def tables(spark):
    scores = spark.createDataFrame(
        [
            ("1", "i1", 2024, 10.0, "n1", 40.0, "o1", 1.0, "t1", 2.0, "2024-01-01"),
            ("1", "i2", 2024, 30.0, None, None, None, None, "t9", 8.0, "2024-03-01"),
            ("2", "i1", 2024, 20.0, "n1", 60.0, "o1", 1.0, "t1", 2.0, "2024-02-01"),
            ("3", "i1", 2024, None, "n1", 80.0, "o1", 1.0, "t1", 2.0, "2024-02-01"),
            ("2", "i1", 2023, 99.0, "n1", 99.0, "o1", 9.0, "t1", 9.0, "2023-02-01"),
        ],
        "id_epci string, id_indicateur string, annee int, score_global double, id_besoin string, score_besoin double, "
        "id_objectif string, score_objectif double, id_type string, score_type double, updated_at string",
    ).withColumn("score_indicateur", F.col("score_global"))
    areas = spark.createDataFrame(
        [("1", "Beta", "01", "r"), ("2", "Alpha", "02", "r"), ("3", "alphonse", "03", "r"), ("4", "Vide", "04", "r")],
        "id_epci string, libelle string, departement_code string, region_code string",
    )

    def dim(key, *pairs):
        return spark.createDataFrame(pairs, f"{key} string, libelle string")

    return {
        "scores": scores, "areas": areas, "indicators": dim("id_indicateur", ("i1", "Zone"), ("i2", "Accès")),
        "needs": dim("id_besoin", ("n1", "Eau")), "objectives": dim("id_objectif", ("o1", "Crise")),
        "types": dim("id_type", ("t1", "État")),
    }


def ordered(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_list_of_scores(tables):
    scores, areas = tables["scores"], tables["areas"]
    by_name = serving.list_scores(scores, areas)
    assert ordered(by_name, "id_epci", "score_global", "n_indicateurs", "updated_at") == [
        ("2", 20.0, 1, "2024-02-01"), ("1", 20.0, 2, "2024-03-01"), ("3", None, 1, "2024-02-01"),
    ]
    # equal scores are ordered by id, a missing score comes last
    assert ordered(serving.list_scores(scores, areas, order_by="score"), "id_epci") == [("1",), ("2",), ("3",)]
    assert ordered(serving.list_scores(scores, areas, order_by="code", offset=1, limit=1), "id_epci") == [("2",)]
    assert ordered(serving.list_scores(scores, areas, search="ALPH"), "id_epci") == [("2",), ("3",)]
    assert ordered(serving.list_scores(scores, areas, year=2023), "id_epci", "score_global") == [("2", 99.0)]
    assert serving.score_summaries(scores, areas).count() == 3
    with pytest.raises(ValueError):
        serving.list_scores(scores, areas, limit=2001)


def test_latest_year_of_nothing_is_zero(tables):
    assert serving.latest_year(tables["scores"].where("annee > 3000")).first()[0] == 0


def test_score_detail(tables, rows):
    detail = serving.score_detail(**tables, id_epci="1")
    assert rows(detail["summary"], "libelle", "score_global") == [("Beta", 20.0)]
    assert rows(detail["needs"], "id", "label", "score") == [("n1", "Eau", 40.0)]
    assert rows(detail["types"], "id", "label", "score") == [("t1", "État", 2.0), ("t9", None, 8.0)]
    assert ordered(detail["indicators"], "id_indicateur", "indicateur_libelle", "besoin_libelle", "type_libelle") == [
        ("i2", "Accès", None, None), ("i1", "Zone", "Eau", "État"),
    ]
    with pytest.raises(ValueError):
        serving.score_detail(**tables, id_epci="4")


def test_the_whole_drill_down(tables, rows):
    found = {r["id_epci"]: r for r in serving.score_detail_all(**tables).collect()}
    assert found.keys() == {"1", "2", "3"}
    one = found["1"]
    assert (one["score_global"], one["n_indicateurs"], one["updated_at"]) == (20.0, 2, "2024-03-01")
    assert [tuple(g) for g in one["types"]] == [("t1", "État", 2.0), ("t9", None, 8.0)]
    assert [i["id_indicateur"] for i in one["indicators"]] == ["i2", "i1"]
    assert [tuple(g) for g in found["3"]["needs"]] == [("n1", "Eau", 80.0)] and found["3"]["score_global"] is None
    # an indicator that the dimension lacks counts in the means and is no line; the area's groups stay
    fewer = tables | {"indicators": tables["indicators"].where("id_indicateur = 'i1'")}
    one = serving.score_detail_all(**fewer).where("id_epci = '1'").first()
    assert [i["id_indicateur"] for i in one["indicators"]] == ["i1"] and one["n_indicateurs"] == 2 and len(one["types"]) == 2
    # without a need there is no group; scores that are null give a null mean
    bare = tables | {"scores": tables["scores"].withColumns({"id_besoin": F.lit(None).cast("string"), "score_type": F.lit(None).cast("double")})}
    one = serving.score_detail_all(**bare).where("id_epci = '1'").first()
    assert one["needs"] == [] and [g["score"] for g in one["types"]] == [None, None]
    assert serving.score_detail_all(**(tables | {"scores": tables["scores"].where("false")})).count() == 0


def test_the_drill_down_reads_the_scores_once(spark, tables, tmp_path):
    path = str(tmp_path / "scores")
    tables["scores"].write.parquet(path)
    stored = tables | {"scores": spark.read.parquet(path)}
    plan = serving.score_detail_all(**stored, year=2024)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


@pytest.mark.parametrize("order_by,key", [("name", "libelle"), ("score", "score_global"), ("code", "id_epci")])
def test_pages_that_continue(spark, order_by, key):
    # repeated and missing names and scores
    places = [(str(k), None if k % 5 == 0 else f"n{k % 3}", "d", "r") for k in range(23)]
    areas = spark.createDataFrame(places, "id_epci string, libelle string, departement_code string, region_code string")
    lines = [(str(k), "i", 2024, None if k % 7 == 0 else float(k % 4), "u") for k in range(23)]
    scores = spark.createDataFrame(lines, "id_epci string, id_indicateur string, annee int, score_global double, updated_at string")
    whole = [r["id_epci"] for r in serving.list_scores(scores, areas, limit=100, order_by=order_by).collect()]
    seen, after = [], None
    for _ in range(20):
        page = serving.list_scores_after(scores, areas, after, limit=4, order_by=order_by).collect()
        if not page:
            break
        seen += [r["id_epci"] for r in page]
        after = (page[-1][key], page[-1]["id_epci"])
    assert seen == whole and len(whole) == 23
    with pytest.raises(ValueError):
        serving.list_scores_after(scores, areas, limit=0)


def test_views(spark, tables, rows):
    links = spark.createDataFrame([("i1", "n1"), ("i1", "n2")], "id_indicateur string, id_besoin string")
    needs = spark.createDataFrame([("n1", "Eau"), ("n2", "Air")], "id_besoin string, libelle string")
    view = serving.indicator_labels_view(tables["indicators"], {"besoins": (links, needs, "id_besoin")})
    assert rows(view, "id_indicateur", "besoins") == [("i1", ["Air", "Eau"]), ("i2", None)]
    stored = spark.createDataFrame(
        [("1", 2024, 1.0, 2.0, 3.0, 4.0, "x")],
        "id_epci string, annee int, score_global double, score_besoin double, score_objectif double, score_type double, updated_at string",
    )
    got = serving.area_scores_view(tables["scores"], tables["areas"], stored)
    assert rows(got, "id_epci", "annee", "score_global", "indicator_count", "avg_indicator_score") == [
        ("1", 2024, 1.0, 2, 20.0), ("2", 2023, None, 1, 99.0), ("2", 2024, None, 1, 20.0), ("3", 2024, None, 1, None),
    ]


def test_orderings(spark):
    df = spark.createDataFrame([("a", None), ("b", 5.0), ("c", 1.0)], "k string, s double")
    assert ordered(serving.weakest_first(df, "s"), "k") == [("a",), ("c",), ("b",)]
    assert ordered(serving.best_first(df, "s"), "k") == [("b",), ("c",), ("a",)]
