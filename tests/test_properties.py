"""Properties that hold for any input: conserved totals, bounds, idempotent merges."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terrascore.operators import aggregates as agg
from terrascore.operators.keyed import merge_upsert
from terrascore.operators.scoring import min_max_scores

few = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
codes = st.sampled_from(["1", "2", "3", "4"])
numbers = st.one_of(st.none(), st.integers(-1000, 1000).map(float))


@few
@given(facts=st.lists(st.tuples(codes, numbers), min_size=1, max_size=30))
def test_rollup_conserves_sums(spark, facts):
    df = spark.createDataFrame(facts, "code string, v double")
    catalogue = spark.createDataFrame([("1", "A"), ("2", "A"), ("3", "B"), ("4", "B")], "code string, g string")
    rolled = agg.rollup_two_level(df, catalogue, "code", "g", {"n": F.count(F.lit(1)), "s": F.sum("v")}).collect()
    assert sum(r["n"] or 0 for r in rolled) == len(facts)
    assert sum(r["s"] or 0 for r in rolled) == sum(v or 0 for _, v in facts)


@few
@given(values=st.lists(st.tuples(codes, numbers), min_size=1, max_size=30))
def test_scores_reach_both_ends(spark, values):
    rows = [(str(i), code, 2024, v) for i, (code, v) in enumerate(values)]
    df = spark.createDataFrame(rows, "id_epci string, id_indicateur string, annee int, valeur_brute double")
    scored = min_max_scores(df).collect()
    assert len(scored) == sum(v is not None for _, v in values)
    for code in {c for c, v in values if v is not None}:
        scores = [r["score_indicateur"] for r in scored if r["id_indicateur"] == code]
        own = {v for c, v in values if c == code and v is not None}
        assert min(scores) == 0 and max(scores) == (100 if len(own) > 1 else 0)


@few
@given(
    target=st.dictionaries(codes, numbers, max_size=4),
    batch=st.lists(st.tuples(codes, numbers), max_size=12),
)
def test_upsert_is_last_write_wins_and_idempotent(spark, target, batch):
    t = spark.createDataFrame(list(target.items()), "k string, v double")
    u = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(batch)], "k string, v double, seq int")
    expected = {**target, **dict(batch)}
    once = merge_upsert(t, u, ["k"], "seq")
    assert {r["k"]: r["v"] for r in once.collect()} == expected
    assert {r["k"]: r["v"] for r in merge_upsert(once, u, ["k"], "seq").collect()} == expected
