"""Searches over the stored index against scans of all areas."""

import random

import pytest

from terrascore.operators.filters import find_one, suggest
from terrascore.sources.search import candidates, find_one_indexed, runs_of, suggest_indexed, write_search_index

NAMES = ["Lyon", "Saint-Étienne", "SAINT-Malo", "L'Île-d'Yeu", "Aÿ", "Y", "100% Bio", "under_score", "back\\slash", "Nice", "nice", "ΑΣ", "İzmir", "Œuvre", "", None]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = random.Random(2)
    rows = [(str(i), n) for i, n in enumerate(NAMES)] + [(None, "Lyon"), ("7", "Lyon"), ("7", "Lyon"), ("%", "sign"), ("A_b", "code")]
    rows += [(str(rng.randrange(10_000, 99_999)), "".join(rng.choice("abé -X") for _ in range(rng.randrange(1, 12)))) for _ in range(300)]
    areas = spark.createDataFrame(rows, "code string, name string").cache()
    path = str(tmp_path_factory.mktemp("search") / "index")
    write_search_index(areas, path, "code", "name")
    yield areas, path, [t for row in rows for t in row if t]
    areas.unpersist()


def test_runs():
    assert runs_of("Lyon") == ["lyo", "yon"] and runs_of("ly") == ["ly"] and runs_of("y") == runs_of("") == runs_of("%é_") == []
    assert runs_of("a%bcd_e") == ["bcd"] and runs_of("Étienne%zz") == ["enn", "ien", "nne", "tie"]


def test_the_same_as_a_scan(spark, stored, rows):
    areas, path, known = stored
    rng = random.Random(4)
    texts = ["saint", "SAINT", "étie", "Île", "aÿ", "y", "%", "100%", "r_s", "_", "k\\s", "\\", "zzz", "l%n", "7", "a_b", "A_b", "ΑΣ", "ας", "iz", "œu", "é ", "nic"]
    for _ in range(12):
        t = rng.choice(known)
        a = rng.randrange(len(t))
        texts.append(t[a : a + rng.randrange(1, 5)])
    for text in texts:
        assert rows(suggest_indexed(spark, path, text)) == rows(suggest(areas, text, "code", "name")), text
        assert rows(find_one_indexed(spark, path, text)) == rows(find_one(areas, text, "code", "name")), text


def test_one_folder_is_read_and_nothing_is_shuffled(spark, stored):
    _, path, _ = stored
    found = suggest_indexed(spark, path, "saint")
    assert len({f.split("folder=")[1].split("/")[0] for f in candidates(spark, path, "saint").inputFiles()}) == 1
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    # the rarest run decides: few candidates where one run of the text is common
    assert candidates(spark, path, "saint-m").count() == 1


def test_no_areas(spark, stored, tmp_path):
    areas, _, _ = stored
    write_search_index(areas.where("false"), str(tmp_path / "none"), "code", "name")
    assert suggest_indexed(spark, str(tmp_path / "none"), "lyon").collect() == []
    assert find_one_indexed(spark, str(tmp_path / "none"), "y").collect() == []
