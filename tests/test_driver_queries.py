"""Every registered query against its SQL, and what its plan must not contain."""

import contextlib
import io
import pathlib

import pytest
from compare import check, duck

import __spark_entry__ as entry
from terrascore.plans.driver import QUERIES, SQL  # the llm queries have tests of their own

TESTDATA = pathlib.Path("/root/testdata")
FOLDER = str(TESTDATA / "sf0.001")

pytestmark = pytest.mark.skipif(not TESTDATA.exists(), reason="driver tables not found")
PYTHON_QUERIES = {"wkb_line_length", "ind_density_per_area"}


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, con, key):
    seen = []

    def run(session, folder):
        seen.append(QUERIES[key](session, folder))
        return seen[0]

    assert check(spark, con, FOLDER, key, run, SQL[key]) is None
    plan = plan_of(seen[0])
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert ("ArrowEvalPython" in plan) == (key in PYTHON_QUERIES)
    assert "BatchEvalPython" not in plan


def test_entry_is_the_flagship(spark):
    df = entry.entry(spark)
    assert df.columns[:4] == ["id_epci", "id_indicateur", "annee", "valeur_brute"] and df.count() > 0


def test_scan_is_pruned_and_filtered(spark):
    plan = plan_of(QUERIES["src_parquet"](spark, FOLDER))
    assert "GreaterThanOrEqual(l_quantity,40.0)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double>" in plan


def test_a_page_is_a_top_k_not_a_global_sort(spark):
    plan = plan_of(QUERIES["list_scores"](spark, FOLDER))
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan
