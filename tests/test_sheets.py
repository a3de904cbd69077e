import pytest
from pyspark.sql import functions as F

from terrascore.plans import sheets as s
from terrascore.sources import together
from terrascore.sources.tables import read_table

SHEETS = {
    s.NEEDS: "ID_besoins ,Libellé,Type_de_besoins,Catégorie,Description\nn1,Eau,,Vitaux,d\nn2,Air,Induits,Vitaux,\n,x,,,\nn1,Eau douce,,Vitaux,d2\n",
    s.OBJECTIVES: "ID_Objectifs,Libellé,Description\no1,Subsistance,\no3,Soutenabilité,\n",
    s.TYPES: "ID_,ID_Type,Libellé,Description\n,Typ1,État,\nTyp2,,Action,\n",
    s.INDICATORS: "ID_indicateurs,Libellé_indicateurs,API disponible,Unité\nI 7,Taux,x,%\n8,,nan,\n9,Seul,,\n",
    s.NEED_LINKS: (
        "ID_Indicateurs,ID_Besoin,Besoin 1,Besoin 2,Type de besoins\ni007,,n2,n1,Essentiels\n7,n1,n9,,Autres\ni8,n1,,,\n"
        "i99,n1,,,\n"
    ),
    s.OBJECTIVE_LINKS: "ID_Indicateurs,o1_Subsistance,o2_Gestion-de-crise,o3_Soutenabilité\n7,X,oui,0\n8,,,true\n",
    s.TYPE_LINKS: "ID_indicateurs,Typ1_Etat,Typ2_Action\n7,1,\n8,non,X\n",
    s.AREAS: "SIREN,dept,EPCI_libellé,total_pop_tot,superficie_km2\n200.0,01,A,1200.0,12.5\n2.01E2,2A,,x,1\n,9,z,1,1\n",
    s.VALUES: "ID_EPCI,Libellé EPCI,i007,I 8,Indice\n200,A,1.5,2,z\n201,,n.d.,,z\n200,A2,9,,z\n",
    s.SCORES: "Code EPCI,i007\n200,55.5\n201,\n",
}


@pytest.fixture
def folder(tmp_path):
    def write(**changes):
        for name, body in {**SHEETS, **changes}.items():
            if body is not None:
                (tmp_path / f"{name}.csv").write_text(body, encoding="utf-8")
        return str(tmp_path)

    return write


def test_import(spark, rows, folder, tmp_path):
    t = s.import_folder(spark, folder(), str(tmp_path / "out"))
    # the last row of n1 wins, its category is the first one a link row names
    assert rows(t["besoin"], "id_besoin", "libelle", "categorie", "ids_indicateurs") == [
        ("n1", "Eau douce", "Essentiels", ["i007", "i008", "i099"]), ("n2", "Air", "Essentiels", ["i007"]),
    ]
    assert rows(t["objectif"], "id_objectif", "ids_indicateurs") == [("o1", ["i007"]), ("o3", ["i008"])]
    assert rows(t["type_indicateur"], "id_type", "libelle", "ids_indicateurs") == [
        ("Typ1", "État", ["i007"]), ("Typ2", "Action", ["i008"]),
    ]
    assert rows(t["indicateur"], "id_indicateur", "libelle", "api_disponible", "ids_besoins", "ids_objectifs", "ids_types") == [
        ("i007", "Taux", True, ["n1", "n2"], ["o1"], ["Typ1"]), ("i008", "", False, ["n1"], ["o3"], ["Typ2"]),
        ("i009", "Seul", False, [], [], []),
    ]
    assert rows(t["indicateur_besoin"]) == [("i007", "n1"), ("i007", "n2"), ("i008", "n1")]
    assert rows(t["epci"], "id_epci", "departement_code", "libelle", "population_totale", "surface_km2") == [
        ("200", "1", "A", 1200, 12.5), ("201", "2A", "", None, 1.0),
    ]
    assert rows(t["valeur_indicateur"], "id_epci", "id_indicateur", "annee", "valeur_brute", "libelle_epci") == [
        ("200", "i007", 0, 9.0, "A2"), ("200", "i008", 0, 2.0, "A"), ("201", "i007", 0, None, None),
    ]
    assert rows(t["score_indicateur"], "id_epci", "id_indicateur", "score_indicateur", "libelle_epci") == [
        ("200", "i007", 55.5, None)
    ]


def test_nothing_is_written_when_a_reference_is_unknown(spark, folder, tmp_path):
    target = tmp_path / "out"
    with pytest.raises(ValueError, match="999"):
        s.import_folder(spark, folder(**{s.VALUES: "ID_EPCI,i007\n999,1\n"}), str(target))
    assert not target.exists()


def _stored(spark, target):
    dated = ("date_import", "created_at", "updated_at")
    found = {p.name: read_table(spark, str(p), p.name) for p in sorted(target.iterdir()) if not p.name.startswith("_")}
    return {name: sorted(map(repr, df.drop(*dated).collect())) for name, df in found.items() if df is not None}


CHANGED = {s.AREAS: SHEETS[s.AREAS].replace("200.0,01,A", "200.0,01,B"), s.VALUES: "ID_EPCI,i007,I 9\n200,5,6\n201,7,8\n"}


FACTS = {name: None for name in SHEETS if name not in (s.INDICATORS, s.AREAS, s.VALUES)}


@pytest.mark.parametrize("writes, lost_driver", [(1, False), (2, True)])
def test_an_import_that_fails_half_way_changes_nothing(spark, folder, tmp_path, monkeypatch, writes, lost_driver):
    target, done = tmp_path / "out", []
    s.import_folder(spark, folder(**FACTS), str(target))
    before = _stored(spark, target)
    write, recover = together.write_merged, together.recover

    def failing(rows, path, partition):
        if len(done) == writes:
            if lost_driver:  # nobody is left to put anything back
                monkeypatch.setattr(together, "recover", lambda *_: 0)
            raise OSError("disk full")
        done.append(path)
        write(rows, path, partition)

    monkeypatch.setattr(together, "write_merged", failing)
    with pytest.raises(OSError, match="disk full"):
        s.import_folder(spark, folder(**FACTS, **CHANGED), str(target))
    if lost_driver:
        assert recover(spark, str(target)) == 1
    assert _stored(spark, target) == before
    assert list((target / "_aside").iterdir()) == []

    monkeypatch.undo()
    s.import_folder(spark, folder(**FACTS, **CHANGED), str(target))
    after = _stored(spark, target)
    assert after != before and len(after["valeur_indicateur"]) == 5
    assert recover(spark, str(target)) == 0 and _stored(spark, target) == after


def test_a_first_import_that_fails_leaves_no_table(spark, folder, tmp_path, monkeypatch):
    target, write = tmp_path / "out", together.write_merged

    def failing(rows, path, partition):
        if path.endswith("valeur_indicateur"):
            raise OSError("disk full")
        write(rows, path, partition)

    monkeypatch.setattr(together, "write_merged", failing)
    with pytest.raises(OSError):
        s.import_folder(spark, folder(**FACTS), str(target))
    assert _stored(spark, target) == {}


def test_missing_sheets_are_left_out(spark, folder, tmp_path):
    missing = {name: None for name in SHEETS if name not in (s.NEEDS, s.AREAS)}
    assert set(s.import_folder(spark, folder(**missing), str(tmp_path / "out"))) == {"besoin", "epci"}


def test_columns_of_one_indicator_in_two_spellings(spark, rows, texts):
    sheet = texts(["ID_EPCI", "i7", "i007"], ["1", "2", "3"])
    got = s.ingest_values(s.sheet_rows(sheet))
    assert rows(got, "id_indicateur", "valeur_brute", F.col("source")) == [("i007", 3.0, "Excel/Table Valeurs")]
