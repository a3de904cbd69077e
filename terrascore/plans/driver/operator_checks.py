"""Filters, joins, aggregates, facets and orderings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrascore.functions.cleaning import to_float
from terrascore.operators import aggregates as agg
from terrascore.operators.filters import (
    NO_GROUP, all_missing, any_missing, facet_filter, find_one, in_real_group, indicators_of_year, passes_city_rules,
    suggest,
)
from terrascore.operators.joins import (
    exclude_listed, fill_code, keep_known, link_arrays, star_lookup, unmatched_both, unnest_links,
)
from terrascore.operators.scoring import group_means_of_needs
from terrascore.plans.driver.registry import Tables, query
from terrascore.plans.driver.scoring_checks import TERRITORIES_SQL, territories
from terrascore.plans.serving import area_by_code, weakest_first
from terrascore.sources.search import find_one_indexed, suggest_indexed, write_search_index

# --- filters -----------------------------------------------------------------


@query(
    "filt_sentinel",
    """SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS epci_code FROM customer
       WHERE c_mktsegment NOT IN ('MACHINERY', 'BUILDING') AND c_acctbal <> 0""",
)
def filt_sentinel(t: Tables) -> DataFrame:
    segment = F.col("c_mktsegment")
    code = F.when(segment == "MACHINERY", NO_GROUP).when(segment != "BUILDING", F.col("c_nationkey").cast("string"))
    communes = t.customer.select("c_custkey", code.alias("epci_code"), F.nullif("c_acctbal", F.lit(0.0)).alias("s"))
    return in_real_group(communes.where(F.col("s").isNotNull())).select("c_custkey", "epci_code")


@query("filt_eq", "SELECT * FROM customer WHERE c_name = 'Customer#000000042'")
def filt_eq(t: Tables) -> DataFrame:
    return area_by_code(t.customer, "c_name", "Customer#000000042")


@query(
    "filt_in_year",
    """SELECT o_orderkey, o_orderpriority AS id_indicateur FROM orders
       WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND year(o_orderdate) = 1997""",
)
def filt_in_year(t: Tables) -> DataFrame:
    values = t.orders.select(
        "o_orderkey", F.col("o_orderpriority").alias("id_indicateur"), F.year("o_orderdate").alias("annee")
    )
    return indicators_of_year(values, ["1-URGENT", "2-HIGH"], 1997).drop("annee")


@query(
    "filt_na_all_any",
    """WITH l AS (SELECT nullif(l_discount, 0) AS a, nullif(l_tax, 0) AS b FROM lineitem)
       SELECT 'all' AS cas, CAST(count(*) AS BIGINT) AS n FROM l WHERE a IS NULL AND b IS NULL
       UNION ALL SELECT 'any', count(*) FROM l WHERE a IS NULL OR b IS NULL
       UNION ALL SELECT 'none', count(*) FROM l WHERE a IS NOT NULL AND b IS NOT NULL
       UNION ALL SELECT 'some', count(*) FROM l WHERE a IS NOT NULL OR b IS NOT NULL""",
)
def filt_na_all_any(t: Tables) -> DataFrame:
    """The four tests on one scan; the filters built on them are in the fixture tests."""
    zero = F.lit(0.0)
    rows = t.lineitem.select(F.nullif("l_discount", zero).alias("a"), F.nullif("l_tax", zero).alias("b"))
    pair = ["a", "b"]
    tests = {"all": all_missing(pair), "any": any_missing(pair), "none": ~any_missing(pair), "some": ~all_missing(pair)}
    counts = rows.agg(*[F.count_if(test).alias(name) for name, test in tests.items()])
    cases = F.array(*[F.struct(F.lit(name).alias("cas"), F.col(f"`{name}`").alias("n")) for name in tests])
    return counts.select(F.inline(cases))


RULES = (
    ("BUILDING", "5", (), ()),
    ("MACHINERY", "3", ("1-URGENT", "2-HIGH"), ()),
    ("MACHINERY", "7", (), ("5-LOW",)),
)


@query(
    "filt_rules",
    """SELECT o_orderkey, c_mktsegment, c_nationkey, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey
       WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')
          OR (c_mktsegment = 'BUILDING' AND c_nationkey = 5)
          OR (c_mktsegment = 'MACHINERY' AND c_nationkey = 3 AND o_orderpriority IN ('1-URGENT', '2-HIGH'))
          OR (c_mktsegment = 'MACHINERY' AND c_nationkey = 7 AND o_orderpriority <> '5-LOW')""",
)
def filt_rules(t: Tables) -> DataFrame:
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", "c_mktsegment", "c_nationkey", "o_orderpriority"
    )
    department = F.col("c_nationkey").cast("string")
    return rows.where(passes_city_rules(F.col("c_mktsegment"), department, F.col("o_orderpriority"), RULES))


CATALOGUE_NAMES = {
    "id": "p_partkey", "label": "p_name", "primary": "p_brand", "secondary": "autres", "objective": "p_type",
    "kind": "taille", "source": "p_type",
}


def _catalogue(t: Tables) -> DataFrame:
    """Parts as an indicator catalogue: the type is a second membership."""
    return t.part.withColumn("autres", F.array("p_type")).withColumn(
        "taille", F.when(F.col("p_size") > 25, "Action").otherwise("État")
    )


@query(
    "facet_filter",
    """SELECT p_partkey, p_name FROM part
       WHERE (lower(p_name) LIKE '%red%' OR '' || p_partkey LIKE '%red%')
         AND (p_brand = 'PROMO' OR p_type = 'PROMO') AND p_size > 25""",
)
def facets(t: Tables) -> DataFrame:
    rows = facet_filter(_catalogue(t), search="RED", need="PROMO", kind="Action", columns=CATALOGUE_NAMES)
    return rows.select("p_partkey", "p_name")


@query(
    "search_suggest",
    """SELECT '' || c_custkey AS code, c_name AS nom FROM customer
       WHERE lower(c_name) LIKE '%00012%' OR '' || c_custkey LIKE '%00012%' ORDER BY nom, code LIMIT 8""",
)
def search_suggest(t: Tables) -> DataFrame:
    areas = t.customer.select(F.col("c_custkey").cast("string").alias("code"), F.col("c_name").alias("nom"))
    return suggest(areas, "00012", "code", "nom")


@query(
    "search_one",
    """SELECT '' || c_custkey AS code, c_name AS nom FROM customer
       WHERE '' || c_custkey = '12' OR lower(c_name) LIKE '%12%' ORDER BY ('' || c_custkey = '12') DESC, nom LIMIT 1""",
)
def search_one(t: Tables) -> DataFrame:
    areas = t.customer.select(F.col("c_custkey").cast("string").alias("code"), F.col("c_name").alias("nom"))
    return find_one(areas, "12", "code", "nom")


def _search_index(t: Tables) -> str:
    path = t.scratch("search")
    write_search_index(t.customer, path, "c_custkey", "c_name")
    return path


@query(
    "search_suggest_indexed",
    """SELECT '' || c_custkey AS code, c_name AS name FROM customer
       WHERE lower(c_name) LIKE '%er#%042%' OR '' || c_custkey LIKE '%er#%042%' ORDER BY name, code LIMIT 8""",
)
def search_suggest_indexed(t: Tables) -> DataFrame:
    return suggest_indexed(t.spark, _search_index(t), "ER#%042")


@query(
    "search_one_indexed",
    """SELECT '' || c_custkey AS code, c_name AS name FROM customer
       WHERE '' || c_custkey = '42' OR lower(c_name) LIKE '%42%' ORDER BY ('' || c_custkey = '42') DESC, name, code LIMIT 1""",
)
def search_one_indexed(t: Tables) -> DataFrame:
    return find_one_indexed(t.spark, _search_index(t), "42")


# --- joins -------------------------------------------------------------------


@query(
    "join_left",
    """SELECT c_custkey, e.n_evenements, e.total FROM customer LEFT JOIN
         (SELECT user_id, count(*) AS n_evenements, round(sum(value), 2) AS total FROM events GROUP BY 1) e
         ON user_id = c_custkey""",
)
def join_left(t: Tables) -> DataFrame:
    """Every customer, with nulls where there are no events."""
    facts = t.events.groupBy(F.col("user_id").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n_evenements"), F.round(F.sum("value"), 2).alias("total")
    )
    return t.customer.select("c_custkey").join(facts, "c_custkey", "left")


@query(
    "join_full_unmatched",
    """SELECT c_custkey, user_id FROM (SELECT c_custkey FROM customer) c
       FULL JOIN (SELECT DISTINCT user_id FROM events WHERE event_type = 'click') e ON c_custkey = user_id
       WHERE c_custkey IS NULL OR user_id IS NULL""",
)
def join_full_unmatched(t: Tables) -> DataFrame:
    return unmatched_both(t.customer, t.events.where(F.col("event_type") == "click"), "c_custkey", "user_id")


@query("join_anti", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)")
def join_anti(t: Tables) -> DataFrame:
    return exclude_listed(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", t.events, "user_id")


@query("join_semi", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT user_id FROM events)")
def join_semi(t: Tables) -> DataFrame:
    return keep_known(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", t.events, "user_id")


@query(
    "star_lookup",
    """SELECT l_orderkey, l_linenumber, s_name, p_name, q.o_orderpriority FROM lineitem
       JOIN supplier ON l_suppkey = s_suppkey
       LEFT JOIN (SELECT * FROM part WHERE p_size <= 25) p ON l_partkey = p_partkey
       LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') q ON l_orderkey = q.o_orderkey""",
)
def star(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return star_lookup(
        lines,
        required=[(t.supplier.select("s_suppkey", "s_name"), "l_suppkey", "s_suppkey")],
        optional=[
            (t.part.where(F.col("p_size") <= 25).select("p_partkey", "p_name"), "l_partkey", "p_partkey"),
            (
                t.orders.where(F.col("o_orderstatus") == "F").select("o_orderkey", "o_orderpriority"),
                "l_orderkey",
                "o_orderkey",
            ),
        ],
    ).select("l_orderkey", "l_linenumber", "s_name", "p_name", "o_orderpriority")


@query("explode_links", "SELECT DISTINCT l_suppkey, l_returnflag AS lien FROM lineitem")
def explode_links(t: Tables) -> DataFrame:
    arrays = link_arrays(t.lineitem, "l_suppkey", "l_returnflag", "liens")
    return unnest_links(arrays, "l_suppkey", "liens", "lien")


@query(
    "links_both_ways",
    """SELECT 'marque' AS sens, p_brand AS cle, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS liens FROM part GROUP BY 2
       UNION ALL
       SELECT 'type', p_type, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) FROM part GROUP BY 2""",
)
def links_both_ways(t: Tables) -> DataFrame:
    def side(name: str, key: str, item: str) -> DataFrame:
        arrays = link_arrays(t.part, key, item, "a")
        return arrays.select(F.lit(name).alias("sens"), F.col(key).alias("cle"), F.array_join("a", ",").alias("liens"))

    return side("marque", "p_brand", "p_type").unionByName(side("type", "p_type", "p_brand"))


@query(
    "code_fill",
    """SELECT o_orderkey, o_custkey, coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END, c_mktsegment) AS code
       FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0""",
)
def code_fill(t: Tables) -> DataFrame:
    rows = t.orders.select(
        "o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("code")
    )
    lookup = t.customer.where(F.col("c_acctbal") > 0)
    return fill_code(rows, "code", "o_custkey", lookup, "c_custkey", "c_mktsegment")


@query(
    "join_fanout",
    """SELECT s_suppkey AS groupe, CAST(count(*) AS BIGINT) AS n FROM customer JOIN supplier ON c_nationkey = s_nationkey GROUP BY 1""",
)
def join_fanout(t: Tables) -> DataFrame:
    """A customer counts once for every supplier of its nation."""
    facts = t.customer.select(F.col("c_nationkey").alias("code"))
    catalogue = t.supplier.select(F.col("s_nationkey").alias("code"), F.col("s_suppkey").alias("groupe"))
    return agg.count_through_shared_code(facts, catalogue, "code", "groupe", "n")


# --- aggregates --------------------------------------------------------------


@query(
    "agg_count",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, count(nullif(l_discount, 0)) AS n_remises FROM lineitem GROUP BY 1, 2""",
)
def agg_count(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.nullif("l_discount", F.lit(0.0))).alias("n_remises")
    )


@query(
    "agg_count_distinct",
    """SELECT l_returnflag, count(DISTINCT l_partkey) AS n_parts, count(DISTINCT l_suppkey) AS n_suppliers
       FROM lineitem GROUP BY 1""",
)
def agg_count_distinct(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(
        F.count_distinct("l_partkey").alias("n_parts"), F.count_distinct("l_suppkey").alias("n_suppliers")
    )


@query(
    "agg_sum",
    """SELECT l_suppkey, round(sum(l_extendedprice), 2) AS total,
              round(sum(CASE WHEN l_returnflag = 'X' THEN l_tax END), 2) AS vide FROM lineitem GROUP BY 1""",
)
def agg_sum(t: Tables) -> DataFrame:
    """The sum of a group that has only nulls is null."""
    return t.lineitem.groupBy("l_suppkey").agg(
        F.round(F.sum("l_extendedprice"), 2).alias("total"),
        F.round(F.sum(F.when(F.col("l_returnflag") == "X", F.col("l_tax"))), 2).alias("vide"),
    )


@query(
    "agg_avg",
    """SELECT o_orderpriority, round(avg(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END), 2) AS moyenne
       FROM orders GROUP BY 1""",
)
def agg_avg(t: Tables) -> DataFrame:
    text = F.when(F.col("o_orderstatus") == "P", "N/A").otherwise(F.col("o_totalprice").cast("string"))
    return t.orders.groupBy("o_orderpriority").agg(F.round(F.avg(to_float(text)), 2).alias("moyenne"))


@query("agg_minmax", "SELECT o_custkey, min(o_totalprice) AS mini, max(o_totalprice) AS maxi FROM orders GROUP BY 1")
def agg_minmax(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.min("o_totalprice").alias("mini"), F.max("o_totalprice").alias("maxi"))


@query("agg_any_value", "SELECT c_nationkey, any_value(n_name) AS nom FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def agg_any_value(t: Tables) -> DataFrame:
    named = t.customer.select("c_nationkey").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return named.groupBy("c_nationkey").agg(F.any_value("n_name").alias("nom"))


@query(
    "agg_ratio",
    """SELECT l_suppkey, round(sum(l_extendedprice) / nullif(sum(l_quantity), 0), 4) AS prix_moyen FROM lineitem GROUP BY 1""",
)
def agg_ratio(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(
        agg.per(F.sum("l_extendedprice"), F.sum("l_quantity"), digits=4).alias("prix_moyen")
    )


@query(
    "agg_having",
    """SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1 HAVING o_orderpriority <> '5-LOW'""",
)
def agg_having(t: Tables) -> DataFrame:
    counted = t.orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return in_real_group(counted, "o_orderpriority", "5-LOW")


@query(
    "rollup_two_level",
    """SELECT c_nationkey AS groupe, CAST(sum(n) AS BIGINT) AS n, round(sum(montant), 2) AS montant, round(sum(c_acctbal), 2) AS poids
       FROM customer LEFT JOIN (SELECT user_id, count(*) AS n, sum(value) AS montant FROM events GROUP BY 1)
         ON user_id = c_custkey
       GROUP BY 1""",
)
def rollup(t: Tables) -> DataFrame:
    catalogue = t.customer.select(F.col("c_custkey").alias("code"), F.col("c_nationkey").alias("groupe"), "c_acctbal")
    facts = t.events.select(F.col("user_id").alias("code"), "value")
    rolled = agg.rollup_two_level(
        facts, catalogue, "code", "groupe", {"n": F.count(F.lit(1)), "montant": F.sum("value")}, ["c_acctbal"]
    )
    return rolled.select("groupe", "n", F.round("montant", 2).alias("montant"), F.round("c_acctbal", 2).alias("poids"))


@query(
    "agg_array_distinct",
    "SELECT o_custkey, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS libelles FROM orders GROUP BY 1",
)
def agg_array_distinct(t: Tables) -> DataFrame:
    labels = agg.distinct_labels(t.orders, "o_custkey", "o_orderpriority", "a")
    return labels.select("o_custkey", F.array_join("a", "|").alias("libelles"))


@query(
    "rowwise_mean",
    f"""WITH w AS ({TERRITORIES_SQL})
        SELECT id_epci, annee,
               round(coalesce(list_avg(list_filter([score_water, score_food, score_housing, score_healthcare, score_security], lambda x: x IS NOT NULL)), 0), 9) AS subsistance,
               round(coalesce(list_avg(list_filter([score_education, score_social_cohesion, score_nature], lambda x: x IS NOT NULL)), 0), 9) AS crise
        FROM w""",
)
def rowwise_mean(t: Tables) -> DataFrame:
    means = group_means_of_needs(territories(t), ["id_epci", "annee"])
    return means.select(
        "id_epci", "annee", F.round("Subsistance", 9).alias("subsistance"), F.round("Gestion de crise", 9).alias("crise")
    )


@query(
    "facet_counts",
    """SELECT besoin, count(*) AS n_indicateurs FROM (
         SELECT 'all' AS besoin FROM part UNION ALL SELECT p_brand FROM part UNION ALL SELECT p_type FROM part) GROUP BY 1
       UNION ALL SELECT DISTINCT n_name, 0 FROM nation""",
)
def facet_counts(t: Tables) -> DataFrame:
    """Needs without any indicator (here the nations) have a row with 0."""
    return agg.facet_counts(_catalogue(t), "p_brand", "autres", t.nation.select(F.col("n_name").alias("id_besoin")))


@query("set_distinct", "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def set_distinct(t: Tables) -> DataFrame:
    return t.customer.select("c_nationkey", "c_mktsegment").distinct()


DEDUP_SQL = """SELECT o_custkey, o_orderkey, o_totalprice FROM (
    SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate {0}, o_orderkey {0}) AS rn FROM orders) WHERE rn = 1"""


@query("dedup_first", DEDUP_SQL.format(""))
def dedup_first(t: Tables) -> DataFrame:
    rows = t.orders.select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return agg.dedup_first(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("dedup_last", DEDUP_SQL.format("DESC"))
def dedup_last(t: Tables) -> DataFrame:
    rows = t.orders.select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return agg.dedup_last(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query(
    "set_union_all",
    """SELECT c_name AS nom, c_nationkey AS pays, c_mktsegment AS segment FROM customer
       UNION ALL SELECT s_name, s_nationkey, NULL FROM supplier""",
)
def set_union_all(t: Tables) -> DataFrame:
    first = t.customer.select(
        F.col("c_name").alias("nom"), F.col("c_nationkey").alias("pays"), F.col("c_mktsegment").alias("segment")
    )
    second = t.supplier.select(F.col("s_name").alias("nom"), F.col("s_nationkey").alias("pays"))
    return first.unionByName(second, allowMissingColumns=True)


@query(
    "sort_multi",
    """SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate::DATE::VARCHAR AS envoi FROM lineitem
       ORDER BY l_quantity, envoi NULLS LAST, l_orderkey, l_linenumber""",
)
def sort_multi(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_quantity", F.date_format("l_shipdate", "yyyy-MM-dd").alias("envoi")
    )
    return weakest_first(rows, "l_quantity", ["envoi", "l_orderkey", "l_linenumber"])


@query(
    "nav_lag_lead",
    """SELECT p_brand, p_type, p_partkey,
              lag(p_partkey) OVER w AS precedent, lead(p_partkey) OVER w AS suivant,
              CAST(row_number() OVER w AS BIGINT) AS rang
       FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_type, p_partkey)""",
)
def nav_lag_lead(t: Tables) -> DataFrame:
    rows = t.part.select("p_brand", "p_type", "p_partkey")
    return agg.neighbours(rows, ["p_brand"], ["p_type", "p_partkey"], "p_partkey")
