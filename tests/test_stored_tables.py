"""Stored tables: one layout, full schema, only the named partitions touched; imports merge."""

import pathlib
import struct

import pytest
from pyspark.sql import functions as F

from terrascore.functions.cleaning import clean_code, decimal_comma_number, to_float
from terrascore.functions.geometry import is_line, wkb_length_km
from terrascore.functions.labels import like_ci
from terrascore.plans import jobs, sheets
from terrascore.plans.serving import score_summaries
from terrascore.sources import files
from terrascore.session import settings, shared_dir
from terrascore.sources.tables import _one_of, read_table, upsert_stored
from terrascore.tables import schema_of

VALUES = "id_epci string, id_indicateur string, annee int, valeur_brute double"


def values(spark, *rows, columns=VALUES):
    return spark.createDataFrame(rows, columns)


def files_below(path, part):
    return {p.name: p.stat().st_mtime_ns for p in path.rglob("*.parquet") if part in str(p)}


def test_another_indicator_of_the_year_is_left_alone(spark, rows, tmp_path):
    path = tmp_path / "v"
    assert jobs.store_values(values(spark, ("1", "i001", 2025, 1.0), ("1", "i002", 2025, 2.0), ("1", "007", 2024, 5.0)), str(path)) == 3
    before = files_below(path, "i001")
    assert jobs.store_values(values(spark, ("1", "i002", 2025, 3.0), ("2", "i002", 2025, 4.0)), str(path)) == 2
    assert files_below(path, "i001") == before and before
    stored = read_table(spark, str(path), "valeur_indicateur")
    assert stored.schema.fieldNames() == schema_of("valeur_indicateur").fieldNames()
    assert rows(stored, "id_epci", "id_indicateur", "valeur_brute", "meta") == [
        ("1", "007", 5.0, "{}"), ("1", "i001", 1.0, "{}"), ("1", "i002", 3.0, "{}"), ("2", "i002", 4.0, "{}")]


def test_a_later_batch_may_bring_other_columns(spark, rows, tmp_path):
    path = str(tmp_path / "v")
    upsert_stored(path, values(spark, ("1", "i1", 2024, 1.0), ("2", "i1", 2024, 2.0)), "valeur_indicateur")
    more = values(spark, ("1", "i1", 2024, "Un"), ("3", "i1", 2024, "Trois"), columns="id_epci string, id_indicateur string, annee int, libelle_epci string")
    upsert_stored(path, more, "valeur_indicateur")
    assert rows(read_table(spark, path, "valeur_indicateur"), "id_epci", "valeur_brute", "libelle_epci", "meta") == [
        ("1", 1.0, "Un", "{}"), ("2", 2.0, None, "{}"), ("3", None, "Trois", "{}")]


def test_the_scan_names_the_partitions(spark, tmp_path):
    path = str(tmp_path / "v")
    upsert_stored(path, values(spark, *((str(k), f"i{k % 5}", 2020 + k % 3, 1.0) for k in range(30))), "valeur_indicateur")
    touched = values(spark, ("1", "i1", 2021, 1.0)).select("annee", "id_indicateur").collect()
    plan = read_table(spark, path, "valeur_indicateur").where(_one_of(["annee", "id_indicateur"], touched))
    with settings(spark, {"spark.sql.maxMetadataStringLength": 5000}):  # else filters are printed in part
        scan = plan._jdf.queryExecution().executedPlan().toString()
    pushed = scan[scan.index("PartitionFilters") :]
    assert "2021" in pushed and "i1" in pushed
    assert len({f for (f,) in plan.select(F.input_file_name()).distinct().collect()}) <= 1


def test_repeated_keys_need_an_order(spark, rows, tmp_path):
    path = str(tmp_path / "v")
    twice = values(spark, ("1", "i1", 2024, 1.0), ("1", "i1", 2024, 2.0))
    with pytest.raises(ValueError, match="given twice"):
        upsert_stored(path, twice, "valeur_indicateur")
    upsert_stored(path, twice.withColumn("seq", F.col("valeur_brute")), "valeur_indicateur", "seq")
    assert rows(read_table(spark, path, "valeur_indicateur"), "valeur_brute") == [(2.0,)]
    assert upsert_stored(path, twice.where("false"), "valeur_indicateur") == 0


def test_another_layout_is_refused(spark, tmp_path):
    path = str(tmp_path / "v")
    values(spark, ("1", "i1", 2024, 1.0)).write.parquet(path)
    with pytest.raises(ValueError, match="folders"):
        upsert_stored(path, values(spark, ("1", "i1", 2024, 1.0)), "valeur_indicateur")


def test_import_and_store_in_either_order(spark, rows, tmp_path):
    folder, target = tmp_path / "s", str(tmp_path / "t")
    folder.mkdir()
    (folder / f"{sheets.VALUES}.csv").write_text('ID_EPCI,i007,I 8\n200,1.5,"2"\n201,,4\n', encoding="utf-8")
    (folder / f"{sheets.SCORES}.csv").write_text("Code EPCI,i007\n200,55.5\n", encoding="utf-8")
    (folder / f"{sheets.NEEDS}.csv").write_text('ID_besoins,Libellé\nn1,"Eau\nb"\n', encoding="utf-8")
    jobs.store_values(values(spark, ("200", "i007", 2024, 9.0), ("200", "i007", 0, 8.0)), f"{target}/valeur_indicateur")
    report = values(spark, ("200", "i007", 0, "r"), columns="id_epci string, id_indicateur string, annee int, rapport string")
    jobs.store_scores(report, f"{target}/score_indicateur")
    found = sheets.import_folder(spark, str(folder), target)
    assert rows(found["besoin"], "id_besoin", "libelle") == [("n1", "Eau\nb")]
    assert rows(found["score_indicateur"], "id_epci", F.col("score_indicateur").cast("double"), "rapport") == [("200", 55.5, "r")]
    jobs.store_values(values(spark, ("201", "i007", 2024, 7.0)), f"{target}/valeur_indicateur")
    stored = read_table(spark, f"{target}/valeur_indicateur", "valeur_indicateur")
    assert rows(stored, "id_epci", "id_indicateur", "annee", "valeur_brute") == [
        ("200", "i007", 0, 1.5), ("200", "i007", 2024, 9.0), ("200", "i008", 0, 2.0), ("201", "i007", 2024, 7.0), ("201", "i008", 0, 4.0)]


def test_later_column_wins_over_later_row(spark, rows, texts):
    sheet = texts(["ID_EPCI", "i7", "i007"], ["1", "1", "2"], ["1", "3", None])
    # read column by column: (1), (3), then (2); an empty cell gives no row
    assert rows(sheets.ingest_scores(sheets.sheet_rows(sheet)), "score_indicateur") == [(2.0,)]


def test_header_lines_of_several_files(spark, rows, tmp_path):
    (tmp_path / "a.csv").write_text("Titre A\n\nCode;Nom\n1;x\nTitre B;y\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("Titre B\nautre\nNom;Code\nz;2\nTitre A;3\n", encoding="utf-8")
    got = files.read_after_header_line(spark, str(tmp_path), 2, ";")
    assert rows(got, "Code", "Nom") == [("1", "x"), ("2", "z"), ("3", "Titre A"), ("Titre B", "y")]


def test_folder_with_other_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,n\n1,2\n")
    (tmp_path / "b.csv").write_text("id,m\n1,2\n")
    with pytest.raises(ValueError, match="no column"):
        files.read_folder(spark, str(tmp_path), "*.csv", ["id", "n"])
    with pytest.raises(ValueError, match="no file"):
        files.read_folder(spark, str(tmp_path), "*.txt", ["id"])


def test_damaged_codes_are_repaired_or_rejected(spark, rows, tmp_path):
    (tmp_path / "d.csv").write_text("Titre, long\nCode,Nom\n 01001,a\n1400,b\n01400.0,c\n01002,d\nzz,e\n,f\nfin\n", encoding="utf-8")
    data, rejects = files.read_after_preamble_with_rejects(spark, str(tmp_path), ["Code", "Nom"])
    assert rows(data) == [("01001", "a"), ("01002", "d"), ("01400", "b"), ("01400", "c")]
    assert ("zz", "e") in rows(rejects) and ("Code", "Nom") not in rows(rejects)


def test_wide_numbers(texts, rows):
    df = texts(["v"], ["1e305"], ["1e0007"], ["1.99999999999e0"], ["1e40"], ["1e400"], ["-1.29e1"], ["00"], ["2A004"])
    got = {r[0]: tuple(r)[1:] for r in df.select("v", clean_code("v"), to_float("v"), decimal_comma_number("v")).collect()}
    assert got["1e305"][1] == 1e305 and got["1e0007"] == ("10000000", 1e7, 1e7)
    assert got["1.99999999999e0"][0] == "1" and got["1e40"][0] == "1" + "0" * 40
    assert got["1e400"][1:] == (None, None) and got["-1.29e1"][0] == "-12"
    assert got["00"][0] == "0" and got["2A004"] == ("2A004", None, None)


def line(order, word, points, srid=None):
    head = struct.pack(order + "BI", order == "<", word) + (b"" if srid is None else struct.pack(order + "I", srid))
    return head + struct.pack(order + "I", len(points)) + b"".join(struct.pack(order + f"{len(p)}d", *p) for p in points)


def test_every_form_of_wkb(spark):
    flat, high = [(3.0, 46.5), (3.0, 46.6)], [(3.0, 46.5, 7.0), (3.0, 46.6, 9.0)]
    forms = {
        "plain": line("<", 2, flat), "big": line(">", 2, flat), "iso_z": line("<", 1002, high), "iso_m": line(">", 2002, high),
        "flag_z": line("<", 2 | 0x80000000, high), "flag_m": line(">", 2 | 0x40000000, high), "srid": line("<", 2 | 0x20000000, flat, 4326),
        "srid_z": line(">", 2 | 0xA0000000, high, 4326),
        "multi": struct.pack("<BIII", 1, 5 | 0x20000000, 4326, 2) + line("<", 2, flat) + line(">", 2, flat),
    }
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in forms.items()] + [("point", bytearray(struct.pack("<BI2d", 1, 1, 0, 0)))],
                               "k string, g binary")
    lines = df.where(is_line("g"))
    got = {r["k"]: r["km"] for r in lines.select("k", wkb_length_km("g").alias("km")).collect()}
    assert got.keys() == forms.keys()
    assert got.pop("multi") == pytest.approx(2 * got["plain"])
    assert set(got.values()) == {got["plain"]} and got["plain"] > 11


def test_a_backslash_in_a_search(texts, rows):
    df = texts(["v"], ["A\\b"], ["ab"])
    assert rows(df.where(like_ci("v", "a\\B"))) == [("A\\b",)]


def test_search_filters_before_it_sums(spark, texts):
    scores = spark.createDataFrame([("1", "i", 2024, 1.0, None)], "id_epci string, id_indicateur string, annee int, score_global double, updated_at timestamp")
    areas = texts(["id_epci", "libelle", "departement_code", "region_code"], ["1", "Un", "01", "84"])
    plan = score_summaries(scores, areas, 2024, "un")._jdf.queryExecution().optimizedPlan().toString()
    # the deepest aggregate stands above a semi join
    assert plan.rindex("LeftSemi") > plan.index("Aggregate")


def test_headers_of_many_files_are_one_job(spark, rows, tmp_path):
    tracker, group = spark.sparkContext.statusTracker(), "heads"
    for i in range(500):
        header = "Code;Nom" if i % 2 else "Nom;Code"
        cells = f"{i:05d};n{i}" if i % 2 else f"n{i};{i:05d}"
        (tmp_path / f"f {i}.csv").write_text(f"Edition {i}\n{header}\n{cells}\n" + "Edition 7\n" * (i == 9))
    spark.sparkContext.setJobGroup(group, "")
    got = files.read_after_header_line(spark, str(tmp_path), 1, ";")
    jobs = len(tracker.getJobIdsForGroup(group))
    plan = got._jdf.queryExecution().optimizedPlan().treeString().count("\n")
    spark.sparkContext.setJobGroup("", "")
    assert jobs <= 12 and plan <= 60  # however many files there are
    found = rows(got, "Code", "Nom")
    assert len(found) == 501 and ("00499", "n499") in found and ("00000", "n0") in found
    assert ("Edition 7", None) in found  # a line of another file's head is data here


def test_only_changed_indicators_are_scored_again(spark, rows, tmp_path):
    stored, scores = str(tmp_path / "v"), tmp_path / "s"
    first = values(spark, *((str(k), i, 2024, float(k)) for k in range(3) for i in ("i1", "i2")))
    assert jobs.rescore_changed(first, stored, str(scores)) == 0  # nothing is stored yet
    jobs.store_values(first, stored)
    assert jobs.rescore_changed(first, stored, str(scores)) == 6
    before = files_below(scores, "i2")
    batch = values(spark, ("1", "i1", 2024, 4.0), ("2", "i1", 2024, None))
    jobs.store_values(batch, stored)
    assert jobs.rescore_changed(batch, stored, str(scores)) == 3
    assert files_below(scores, "i2") == before and before
    got = read_table(spark, str(scores), "score_indicateur").select("id_indicateur", "id_epci", F.col("score_global").cast("double"))
    assert rows(got.where("id_indicateur = 'i1'"), "id_epci", "score_global") == [("0", 0.0), ("1", 100.0), ("2", None)]
    assert rows(got.where("id_indicateur = 'i2'"), "id_epci", "score_global") == [("0", 0.0), ("1", 50.0), ("2", 100.0)]


def test_an_upsert_leaves_no_scratch_files(spark, tmp_path):
    folder = pathlib.Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.rglob("*.parquet"))
    for value in (1.0, 2.0):
        jobs.store_values(values(spark, ("1", "i1", 2024, value)), str(tmp_path / "v"))
    with pytest.raises(ValueError):
        jobs.store_values(values(spark, ("1", "i1", 2024, 1.0), ("1", "i1", 2024, 2.0)), str(tmp_path / "v"))
    assert set(folder.rglob("*.parquet")) == before


def test_a_local_session_without_a_folder_gets_one(spark, monkeypatch):
    real = type(spark.conf).get
    monkeypatch.setattr(type(spark.conf), "get", lambda conf, key, *rest: None if key == "spark.checkpoint.dir" else real(conf, key, *rest))
    own = shared_dir(spark)
    assert own == shared_dir(spark) and pathlib.Path(own).is_dir()
