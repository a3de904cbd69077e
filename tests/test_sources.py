import json
from random import Random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrascore.session import scratch_path, settings, shared_dir, stage
from terrascore.sources import files, records
from terrascore.sources.tables import read_table, upsert_table, write_delimited


def test_delimited_keeps_quotes_and_line_breaks(spark, rows, texts, tmp_path):
    df = texts(["id", "texte"], ["1", 'a "b"; c'], ["2", "deux\nlignes"], ["3", None])
    path = str(tmp_path / "out")
    write_delimited(df, path, sep=";")
    assert rows(files.read_delimited(spark, path, sep=";", multi_line=True)) == rows(df)


def test_preamble_rows_and_header_are_left_out(spark, rows, tmp_path):
    body = "Titre libre\nSource,2024\nCode,Libellé,Distance\n01001,L'Abergement,3.5\n2A004,Ajaccio,N/A\n"
    for name in ("a.csv", "b.csv"):
        (tmp_path / name).write_text(body.replace("01001", "01002") if name == "b.csv" else body, encoding="utf-8")
    df = files.read_after_preamble(spark, str(tmp_path), ["Code", "Libellé", "Distance"])
    assert rows(df, "Code", "Distance") == [("01001", "3.5"), ("01002", "3.5"), ("2A004", "N/A"), ("2A004", "N/A")]


def test_tolerant_scan_and_quarantine(spark, rows, tmp_path):
    (tmp_path / "x.csv").write_text("id;v\n1;2.5\ndeux;3\n4\n5;6;7\n8;9\n")
    df = files.read_tolerant(spark, str(tmp_path), "id int, v double", sep=";")
    assert rows(df) == [(1, 2.5), (8, 9.0)]
    assert df.select("v").count() == 2 and df.count() == 2  # not only when all columns are used
    good, bad = files.read_with_quarantine(spark, str(tmp_path), "id int, v double", sep=";")
    assert rows(good) == [(1, 2.5), (8, 9.0)]
    assert rows(bad, "id", files.CORRUPT) == sorted([("deux", None), ("4", "4"), ("5", "5;6;7")], key=repr)
    assert bad.count() == 3


def test_latin1(spark, rows, tmp_path):
    (tmp_path / "e.csv").write_bytes("siren;nom\n200;Évêché\n".encode("latin-1"))
    assert rows(files.read_delimited(spark, str(tmp_path), sep=";", encoding="ISO-8859-1")) == [("200", "Évêché")]


def test_folder_reads_matching_files_by_header(spark, rows, tmp_path):
    (tmp_path / "rna_waldec_01.csv").write_text("id;position;adrs_codeinsee\n1;A;01001\n2;D;01001\n")
    (tmp_path / "rna_waldec_02.csv").write_text("id;position;adrs_codeinsee\n3;A;02001\n")
    (tmp_path / "autre.csv").write_text("id;position;adrs_codeinsee\n9;A;09001\n")
    df = files.read_folder(spark, str(tmp_path), "rna_waldec*.csv", ["id", "adrs_codeinsee"], F.col("position") == "A", ";")
    assert rows(df) == [("1", "01001"), ("3", "02001")]
    assert (tmp_path / "rna_waldec_01.csv").exists()


def test_missing_sheet_is_skipped(spark, tmp_path, caplog):
    (tmp_path / "Un.csv").write_text("a,b\n1,2\n")
    sheets = files.load_sheets(spark, str(tmp_path), ["Un", "Deux"])
    assert set(sheets) == {"Un"} and "Deux" in caplog.text
    assert [f.dataType for f in sheets["Un"].schema] == [T.StringType(), T.StringType()]


def test_pages_are_flattened(spark, rows, tmp_path):
    for i in range(2):
        page = {"total": 2, "results": [{"numepci": f"20{i}", "txcouv_epci": 50.5 + i, "geo": {"dep": {"code": "01"}}}]}
        (tmp_path / f"p{i}.json").write_text(json.dumps(page, indent=1))
    flat = records.explode_results(records.read_pages(spark, str(tmp_path)))
    assert sorted(flat.columns) == ["geo.dep.code", "numepci", "txcouv_epci"]
    assert rows(flat, "numepci", "`geo.dep.code`") == [("200", "01"), ("201", "01")]


def test_record_fallbacks(spark, rows):
    data = [("", "200", 1.5, None, "s"), (None, None, 2.0, "u", None), ("300", "x", None, "u", "s"), ("400", None, 3.0, "u", None)]
    df = spark.createDataFrame(data, "id_epci string, siren string, value double, unit string, source string")
    got = records.extract_records(df, "i130", 2023, default_source="API")
    assert rows(got, "id_epci", "valeur_brute", "unite", "source") == [("200", 1.5, None, "s"), ("400", 3.0, "u", "API")]
    assert json.loads(got.where("id_epci = '400'").first()["meta"]) == {
        "id_epci": "400", "siren": None, "value": 3.0, "unit": "u", "source": None,
    }


def test_geojson_features(spark, rows, tmp_path):
    def feature(props, coords):
        return {"type": "Feature", "properties": props, "geometry": {"type": "Polygon", "coordinates": coords}}

    collection = {
        "type": "FeatureCollection",
        "features": [
            feature({"epci_code": ["200"], "nom": "A"}, [[[2.0, 48.0], [2.1, 48.0]]]),
            feature({"siren": "300", "epci_name": ["B"], "nature": "CC"}, [[[-61.0, 16.0]]]),
            feature({"x": 1}, []),
        ],
    }
    (tmp_path / "a.geojson").write_text(json.dumps(collection))
    df = records.describe_features(records.read_features(spark, str(tmp_path)))
    assert rows(df, "code", "nom", "nature") == [("", "Inconnu", "EPCI"), ("200", "A", "EPCI"), ("300", "B", "CC")]


def test_pages_of_several_shapes_are_read_once(spark, rows, tmp_path):
    pages = [
        {"results": [{"a": 1, "geo": {"dep": "01"}, "x": 1.5, "only": None}, {"a": 2}]},
        {"results": [{"a": "trois", "geo": {"reg": 84}, "x": 2, "OBJECT<": True, "tags": ["u", 1]}], "total": 1},
        {"results": []}, {"total": 0}, {"results": None},
    ]
    for i, page in enumerate(pages):
        (tmp_path / f"{i}.json").write_text(json.dumps(page, indent=1))
    spark.sparkContext.setJobGroup("results", "")
    flat = records.read_results(spark, str(tmp_path))
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("results")) == 1
    spark.sparkContext.setJobGroup("tests", "")
    assert dict(flat.dtypes) == {
        "OBJECT<": "boolean", "a": "string", "geo.dep": "string", "geo.reg": "bigint", "only": "string",
        "tags": "array<string>", "x": "double",
    }
    assert rows(flat, "a", "x", "`geo.dep`", "`geo.reg`", "`OBJECT<`", "tags") == sorted(
        [("1", 1.5, "01", None, None, None), ("2", None, None, None, None, None), ("trois", 2.0, None, 84, True, ["u", "1"])],
        key=repr,
    )
    given = records.read_results(spark, str(tmp_path), "results array<struct<x: double>>")
    assert rows(given) == [(1.5,), (2.0,), (None,)]


def test_pages_without_records_or_without_sense(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"results": []}')
    assert records.read_results(spark, str(tmp_path)).columns == []
    (tmp_path / "b.json").write_text('{"results": [1, "x"]}')
    with pytest.raises(ValueError, match="no objects"):
        records.read_results(spark, str(tmp_path))
    (tmp_path / "b.json").write_text('{"results": [')
    with pytest.raises(Exception, match="(?i)malformed"):
        records.read_results(spark, str(tmp_path))


def _collection(random, n, indent=None):
    """A collection whose strings hold all that could be taken for structure."""
    words = ['}', '{', '"', "\\", '\\"', "[", "]", "Feature", '"features":[{', "é", "\n", '}],"x":[{', ""]
    features = []
    for i in range(n):
        texts = {random.choice("abc") + str(k): "".join(random.choices(words, k=random.randrange(5))) for k in range(3)}
        shape = {"type": "Polygon", "coordinates": [[[i / 2, 1.0], [2.0, 3.0]]]} if i % 3 else None
        feature = {"type": "Feature", "properties": {"code": str(i), **texts}, "geometry": shape}
        features.append(dict(sorted(feature.items(), reverse=i % 2 == 0)))
    named = {"type": "name", "properties": {"name": "}{", "list": [{"type": "Feature", "properties": {"code": "no"}}]}, "b": {"type": "Feature"}}
    return json.dumps(
        {
            "type": "FeatureCollection", "name": "a}b", "crs": named, "links": [{"rel": "}"}, {}], "features": features,
            "after": [{"type": "Other", "x": [{}]}],
        },
        indent=indent, ensure_ascii=False,
    )


@pytest.mark.parametrize("block", [100, 3000, 1 << 20])
def test_one_collection_over_many_tasks(spark, rows, tmp_path, block):
    random = Random(block)
    bodies = [_collection(random, 25), _collection(random, 15, indent=2) + "\n", _collection(random, 0), '{"features":[]}']
    for i, body in enumerate(bodies):
        (tmp_path / f"{i}.geojson").write_text(body, encoding="utf-8")
    expected = [
        (json.dumps(f["properties"], sort_keys=True), (f["geometry"] or {}).get("type"))
        for body in bodies for f in json.loads(body)["features"]
    ]
    with settings(spark, {"spark.sql.files.maxPartitionBytes": block, "spark.sql.files.openCostInBytes": 0}):
        df = records.read_features(spark, str(tmp_path))
        got = [(json.dumps(p, sort_keys=True), kind) for p, kind in df.select("properties", "geometry_type").collect()]
        spread = spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions()
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert block > 3000 or spread > len(bodies)


def test_a_collection_that_ends_too_soon_is_an_error(spark, tmp_path):
    (tmp_path / "a.geojson").write_text('{"features":[{"type":"Feature","properties":{"a":"1"},"geometry":null},{"type":"Fea')
    with pytest.raises(Exception, match="ends inside an element"):
        records.read_features(spark, str(tmp_path)).collect()


def test_shared_folder_and_stage(spark, rows, texts):
    assert scratch_path(spark, "x").startswith(shared_dir(spark))
    df = texts(["a"], ["1"], ["2"])
    assert rows(stage(df, "t")) == rows(df)


def test_upsert_table_rewrites_only_touched_years(spark, rows, tmp_path):
    path = str(tmp_path / "valeurs")
    schema = "id string, annee int, v double, seq long"
    first = spark.createDataFrame([("a", 2023, 1.0, 1), ("a", 2024, 2.0, 1), ("b", 2024, 3.0, 1)], schema)
    assert read_table(spark, path) is None
    upsert_table(path, first, ["id", "annee"], "seq")
    before = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "valeurs" / "annee=2023").iterdir()}
    second = spark.createDataFrame([("b", 2024, 9.0, 1), ("b", 2024, None, 2), ("c", 2024, 4.0, 1)], schema)
    for _ in range(2):  # a repeated batch changes nothing
        upsert_table(path, second, ["id", "annee"], "seq")
        assert rows(read_table(spark, path), "id", "annee", "v") == [
            ("a", 2023, 1.0), ("a", 2024, 2.0), ("b", 2024, None), ("c", 2024, 4.0),
        ]
    assert before == {p.name: p.stat().st_mtime_ns for p in (tmp_path / "valeurs" / "annee=2023").iterdir()}


def test_upsert_table_needs_its_partition_in_the_key(spark, texts, tmp_path):
    with pytest.raises(ValueError):
        upsert_table(str(tmp_path / "t"), texts(["id", "seq"], ["1", "1"]), ["id"], "seq")
