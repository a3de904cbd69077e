import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from terrascore.operators import aggregates as agg
from terrascore.operators import filters, joins, keyed, shape
from terrascore.operators.contract import RAW_VALUE_COLUMNS, to_raw_values


# --- keyed writes ------------------------------------------------------------


def test_upsert_semantics(spark, rows):
    target = spark.createDataFrame([("a", 1.0, "x"), ("b", 2.0, "y")], "id string, v double, note string")
    batch = spark.createDataFrame([("a", 5.0, 1), ("a", None, 2), ("c", 7.0, 1)], "id string, v double, seq int")
    merged = keyed.merge_upsert(target, batch, ["id"], "seq")
    expected = [("a", None, "x"), ("b", 2.0, "y"), ("c", 7.0, None)]
    assert rows(merged) == expected
    assert rows(keyed.merge_upsert(merged, batch, ["id"], "seq")) == expected
    with pytest.raises(ValueError):
        keyed.merge_upsert(target.drop("v"), batch, ["id"], "seq")


def test_insert_ignore_and_placeholders(spark, rows, texts):
    links = texts(["a", "b"], ["1", "x"])
    assert rows(keyed.insert_new(links, texts(["a", "b"], ["1", "x"], ["2", "y"], ["2", "y"]), ["a", "b"])) == [
        ("1", "x"), ("2", "y"),
    ]
    dim, facts = texts(["id", "libelle"], ["i001", "L"]), texts(["ind"], ["i001"], ["i002"], ["i002"], [None])
    assert rows(keyed.with_placeholders(dim, facts, "ind", "id", "libelle")) == [
        ("i001", "L"), ("i002", "Indicateur i002"),
    ]
    with pytest.raises(ValueError, match="i002"):
        keyed.require_ids(facts, "ind", dim, "id")
    assert keyed.require_ids(facts.where("ind = 'i001'"), "ind", dim, "id").count() == 1


def test_reference_split(spark, rows, texts):
    facts = texts(["e", "i"], ["1", "a"], ["9", "a"], ["1", None], ["1", "z"])
    good, bad = keyed.split_by_reference(facts, [("e", texts(["id"], ["1"], ["1"]), "id"), ("i", texts(["id"], ["a"]), "id")])
    assert rows(good) == [("1", "a")]
    assert rows(bad) == sorted([("1", None), ("1", "z"), ("9", "a")], key=repr)


# --- joins -------------------------------------------------------------------


def test_fill_code_keeps_one_row_per_row(spark, rows, texts):
    df = texts(["id", "insee", "postal"], ["1", "01", None], ["2", "01", None], ["3", "02", "9"], ["4", "03", None])
    lookup = texts(["k", "v"], ["01", "5"], ["01", "6"], ["02", "7"])
    assert rows(joins.fill_code(df, "postal", "insee", lookup, "k", "v")) == [
        ("1", "01", "5"), ("2", "01", "5"), ("3", "02", "9"), ("4", "03", None),
    ]


def test_list_exclusion_ignores_nulls(spark, rows, texts):
    assert rows(joins.exclude_listed(texts(["n"], ["a"], ["b"], [None]), "n", texts(["l"], ["a"], [None]), "l")) == [
        ("b",), (None,),
    ]


def test_unmatched_and_arrays(spark, rows, texts):
    assert rows(joins.unmatched_both(texts(["a"], ["1"], ["2"], ["2"]), texts(["b"], ["1"], ["3"]), "a", "b")) == [
        ("2", None), (None, "3"),
    ]
    links = texts(["i", "n"], ["i1", "B"], ["i1", "A"], ["i1", "A"], ["i2", None])
    assert rows(joins.link_arrays(links, "i", "n", "ns")) == [("i1", ["A", "B"])]
    assert rows(joins.one_group_per_code(texts(["c", "g"], ["1", "b"], ["1", "a"]), "c", "g")) == [("1", "a")]


# --- filters -----------------------------------------------------------------


def test_city_rules(spark, rows, texts):
    df = texts(
        ["city", "dep", "name"],
        ["Lyon", "69", "a"], ["Moulins", "03", "b"], ["Moulins", "35", "c"], ["Blanquefort", "33", "R.I.G"],
        ["Blanquefort", "33", "x"], ["Valence", "82", "VFM"], ["Valence", "26", "VFM"], ["Valence", "26", "y"],
        ["Valence", "26", None], [None, "1", "z"],
    )
    keep = filters.passes_city_rules(F.col("city"), F.col("dep"), F.col("name"), filters.city_rule_table())
    assert rows(df.where(keep)) == sorted(
        [
            ("Lyon", "69", "a"), ("Moulins", "03", "b"), ("Blanquefort", "33", "R.I.G"), ("Valence", "82", "VFM"),
            ("Valence", "26", "y"), ("Valence", "26", None), (None, "1", "z"),
        ],
        key=repr,
    )


def test_facets(spark, rows):
    df = spark.createDataFrame(
        [("i1", "Eau", "water", ["food"], "S"), ("i2", "Pain", "food", None, "S"), ("i3", "Toit", "home", [], "G")],
        "id_indicateur string, libelle string, besoin string, besoins_secondaires array<string>, objectif string",
    )
    assert rows(filters.facet_filter(df, need="food"), "id_indicateur") == [("i1",), ("i2",)]
    assert rows(filters.facet_filter(df, need="food", search="PA"), "id_indicateur") == [("i2",)]
    assert rows(filters.facet_filter(df, objective="G"), "id_indicateur") == [("i3",)]
    assert filters.facet_filter(df).count() == 3
    assert rows(agg.facet_counts(df, "besoin", "besoins_secondaires")) == [("all", 3), ("food", 2), ("home", 1), ("water", 1)]


def test_search(spark, rows, texts):
    areas = texts(["code", "nom"], ["200", "Lyon"], ["300", "Lyon 200"], ["400", "Nice"])
    assert rows(filters.suggest(areas, "2", "code", "nom")) == []
    assert rows(filters.suggest(areas, "20", "code", "nom")) == [("200", "Lyon"), ("300", "Lyon 200")]
    assert rows(filters.find_one(areas, "200", "code", "nom")) == [("200", "Lyon")]
    assert rows(filters.find_one(areas, "lyon 2", "code", "nom")) == [("300", "Lyon 200")]


# --- aggregates --------------------------------------------------------------


def test_rollup_conserves_totals_and_keeps_empty_groups(spark, rows, texts):
    facts = texts(["code"], ["1"], ["1"], ["2"], ["9"], [None])
    catalogue = texts(["code", "grp"], ["1", "A"], ["2", "A"], ["3", "B"], ["4", None])
    rolled = agg.rollup_two_level(facts, catalogue, "code", "grp", {"n": F.count(F.lit(1))})
    assert rows(rolled) == sorted([("A", 3), ("B", None), (None, None)], key=repr)


def test_mean_over_units_is_unweighted(spark, rows):
    values = spark.createDataFrame([("1", 2.0), ("2", None), ("3", 4.0), ("3", 9.0)], "code string, v double")
    catalogue = spark.createDataFrame([("1", "A"), ("2", "A"), ("3", "A"), ("4", "B")], "code string, g string")
    assert rows(agg.mean_over_units(values, catalogue, "code", "g", "v", "m")) == [("A", 5.0), ("B", None)]


def test_shared_code_counts_like_the_plain_join(spark, rows, texts):
    facts = texts(["cp"], ["10"], ["10"], ["20"], [None])
    catalogue = texts(["cp", "grp"], ["10", "A"], ["10", "A"], ["10", "B"], ["20", "B"], ["30", "C"])
    plain = facts.join(catalogue, "cp").groupBy("grp").count()
    assert rows(agg.count_through_shared_code(facts, catalogue, "cp", "grp", "n")) == rows(plain)


def test_zero_denominator_gives_null(spark, rows):
    df = spark.createDataFrame([(1, 0), (1, None), (1, 4)], "a int, b int")
    assert [r[0] for r in df.select(agg.per(F.col("a"), F.col("b"), 100, 1)).collect()] == [None, None, 25.0]


def test_dedup_first_and_last(spark, rows):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 1, "z")], "k string, seq int, v string")
    assert rows(agg.dedup_first(df, ["k"], "seq"), "k", "v") == [("a", "x"), ("b", "z")]
    assert rows(agg.dedup_last(df, ["k"], "seq"), "k", "v") == [("a", None), ("b", "z")]


def test_band_counts_treat_missing_as_zero(spark, rows):
    df = spark.createDataFrame([("a", None), ("a", 40.0), ("a", 69.9), ("a", 70.0), ("a", 39.9)], "k string, s double")
    assert rows(agg.band_counts(df, ["k"], "s")) == [("a", 2, 2, 1)]


@pytest.mark.parametrize("parts", [1, 4, 50])
def test_neighbours_match_a_plain_walk(spark, rows, parts):
    random.seed(3)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    # one group has most of the rows; one label is null
    data = [(random.choice(["hot"] * 8 + ["b", "c", None]), random.choice("pqr"), i) for i in range(400)]
    got = agg.neighbours(
        spark.createDataFrame(data, "g string, t string, id int").repartition(5), ["g"], ["t", "id"], "id"
    )
    found = rows(got)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    groups = defaultdict(list)
    for g, t, i in data:
        groups[g].append((t, i))
    expected = []
    for g, items in groups.items():
        items.sort()
        for pos, (t, i) in enumerate(items):
            before = items[pos - 1][1] if pos else None
            after = items[pos + 1][1] if pos + 1 < len(items) else None
            expected.append((g, t, i, before, after, pos + 1))
    assert found == sorted(expected, key=repr)


def test_a_hot_group_low_in_the_order_covers_many_ranges(spark, monkeypatch):
    staged = []
    real = agg.stage
    monkeypatch.setattr(agg, "stage", lambda df, label: staged.append(real(df, label)) or staged[-1])
    hot = spark.range(6000).selectExpr("'hot' as g", "id")
    rest = spark.range(3000).selectExpr("concat('g', id % 50) as g", "100000 + id as id")
    assert agg.neighbours(hot.union(rest), ["g"], ["id"], "id").count() == 9000
    sizes = [r["count"] for r in staged[0].where("g = 'hot'").groupBy("_slice").count().collect()]
    assert len(sizes) >= 4 and max(sizes) <= 6000 / 3


# --- shape -------------------------------------------------------------------


def test_headers():
    assert shape.normalise_header("Libellé - EPCI") == "libelle_epci"
    assert shape.normalise_header("ID EPCI") == "id_epci"


def test_wide_sheet(spark, rows, texts):
    sheet = texts(
        [" Code EPCI", "Libellé EPCI ", "ID_note", "i1", "I 02", "Indice"],
        ["200.0", "A", "n", "1.5", None, "z"], ["300", None, "n", "x", "4", "z"], [None, "C", "n", "1", "1", "z"],
    )
    assert rows(shape.wide_sheet_to_long(sheet, "v")) == sorted(
        [("200", "i001", "A", 1.5), ("300", "i001", None, None), ("300", "i002", None, 4.0)], key=repr
    )
    with pytest.raises(ValueError):
        shape.wide_sheet_to_long(texts(["x", "i1"], ["1", "2"]), "v")
    with pytest.raises(ValueError):
        shape.wide_sheet_to_long(texts(["ID_EPCI", "Indice"], ["1", "2"]), "v")


def test_pivot_then_unpivot_is_the_identity(spark, rows):
    long = spark.createDataFrame([("a", "BV1", 1.0), ("a", "BI3", 3.0), ("b", "BE2", 2.0)], "id string, n string, s double")
    wide = shape.pivot_needs(long, ["id"], "n", "s")
    assert wide.columns == ["id", "score", *shape.NEED_COLUMNS.values()]
    assert rows(wide, "id", "score") == [("a", 2.0), ("b", 2.0)]
    back = shape.unpivot_values(wide, ["id"], list(shape.NEED_COLUMNS.values()), "c", "s")
    need_of = {v: k for k, v in shape.NEED_COLUMNS.items()}
    assert sorted((i, need_of[c], s) for i, c, s in rows(back)) == rows(long)


def test_projection_helpers(spark, texts):
    df = texts(["a", "b", "c"], ["1", "2", "3"])
    assert shape.rename_known(df, {"a": "x", "absent": "y"}).columns == ["x", "b", "c"]
    assert shape.all_but(df, "b").columns == ["a", "c"]
    with pytest.raises(ValueError):
        shape.all_but(df, "absent")
    assert tuple(shape.pick_positions(df, {2: "z", 0: "w"}).first()) == ("3", "1")
    moved = shape.move_column_values(texts(["old", "new"], ["1", "0"], [None, "0"]), "old", "new")
    assert sorted(r[0] for r in moved.collect()) == ["0", "1"]


def test_contract(spark, rows):
    df = spark.createDataFrame([(200, 1.5), (300, None), (400, float("nan"))], "siren int, v double")
    out = to_raw_values(df, "i001", 2024, "km", "src", group="siren", value="v")
    assert tuple(out.columns) == RAW_VALUE_COLUMNS
    assert rows(out) == [("200", "i001", 2024, 1.5, "km", "src", '{"raw":{"siren":200,"v":1.5}}')]
