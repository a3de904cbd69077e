"""Queries that join, with broadcasts off and skew splitting forced: same rows, split plans."""

import contextlib
import io
import pathlib

import pytest
from compare import check, duck
from pyspark.sql import functions as F

import __spark_entry__ as entry
from terrascore.operators import aggregates as agg
from terrascore.operators import joins

TESTDATA = pathlib.Path("/root/testdata")
FOLDER = str(TESTDATA / "sf0.001")
SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1",
}
KEYS = (
    "upsert_merge insert_ignore ensure_dim_rows fk_semi fk_rejects join_left join_full_unmatched join_anti join_semi "
    "star_lookup code_fill join_fanout rollup_two_level nav_lag_lead minmax_score view_scores flash_metrics "
    "ind_density_per_area ind_distinct_rate ind_mean_over_units_all ind_rate_per_pop ind_text_entities "
    "ind_year_unit_sum view_indicator_labels"
).split()


@pytest.fixture(scope="module")
def shuffled(spark):
    before = {key: spark.conf.get(key) for key in SETTINGS}
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in before.items():
        spark.conf.set(key, value)


@pytest.mark.skipif(not TESTDATA.exists(), reason="driver tables not found")
@pytest.mark.parametrize("key", KEYS)
def test_same_rows(shuffled, key):
    assert check(shuffled, duck(FOLDER), FOLDER, key, entry.queries()[key], entry.oracle_sql()[key]) is None


def test_a_hot_key_is_split(shuffled):
    """A third of the facts share one key: its partition is read in several pieces."""
    facts = shuffled.range(60000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v")
    )
    dim = shuffled.range(60000).select(F.col("id").alias("d"))
    kept = joins.keep_known(facts.repartition(8), "k", dim, "d")
    assert len(kept.collect()) == 60000
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        kept.explain()
    assert "skew=true" in out.getvalue()


def test_a_hot_code_reaches_the_catalogue_join_once(shuffled):
    """The facts below the join are already one row per code."""
    facts = shuffled.range(50000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 100).alias("code"))
    catalogue = shuffled.range(120).select(F.col("id").alias("code"), (F.col("id") % 4).alias("grp"))
    rolled = agg.rollup_two_level(facts, catalogue, "code", "grp", {"n": F.count(F.lit(1))})
    assert sum(r["n"] for r in rolled.collect()) == 50000
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        rolled.explain()
    final = out.getvalue().split("Initial Plan")[0]
    join_side = final[final.index("SortMergeJoin"):]
    assert join_side.count("Exchange hashpartitioning(code") == 2  # one per side: the aggregate's own is reused
