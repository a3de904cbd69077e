"""Scores, bands, flash reports, serving queries and reference sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrascore.functions.bands import SIX_BANDS, band
from terrascore.operators.aggregates import band_counts
from terrascore.operators.keyed import merge_upsert
from terrascore.operators.scoring import (
    flash_metrics, flash_summary, global_scores, mean_score_by_link, min_max_scores, score_rows, wide_to_functions,
)
from terrascore.operators.shape import pivot_needs
from terrascore.plans import serving, sheets
from terrascore.plans.driver.registry import Tables, query
from terrascore.plans.jobs import rescore_changed, store_scores, store_values
from terrascore.session import stage
from terrascore.sources.tables import read_table, upsert_stored, write_delimited

# --- stand-ins: values, scores, dimensions -----------------------------------

VALUES_SQL = """SELECT CAST(c_nationkey AS VARCHAR) AS id_epci, o_orderpriority || '/' || o_orderstatus AS id_indicateur,
        o_orderpriority AS priorite, o_orderstatus AS statut, CAST(year(o_orderdate) AS INTEGER) AS annee,
        CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 100) AS valeur_brute, strftime(max(o_orderdate), '%Y-%m-%d') AS updated_at
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL"""

SCORED_SQL = f"""SELECT *, round((valeur_brute - min(valeur_brute) OVER w)
            / greatest(max(valeur_brute) OVER w - min(valeur_brute) OVER w, 1e-9) * 100, 2) AS score_indicateur,
        min(valeur_brute) OVER w AS minimum, max(valeur_brute) OVER w AS maximum
    FROM ({VALUES_SQL}) WINDOW w AS (PARTITION BY id_indicateur, annee)"""

SCORES_SQL = f"""SELECT id_epci, id_indicateur, annee, score_indicateur, score_indicateur AS score_global,
        CASE WHEN statut <> 'P' THEN statut END AS id_besoin, score_indicateur AS score_besoin,
        priorite AS id_objectif, score_indicateur AS score_objectif,
        CASE WHEN priorite = '1-URGENT' THEN 'Typ2' ELSE 'Typ1' END AS id_type, score_indicateur AS score_type,
        updated_at
    FROM ({SCORED_SQL})"""

AREAS_SQL = """SELECT CAST(n_nationkey AS VARCHAR) AS id_epci, n_name AS libelle,
        CAST(n_regionkey AS VARCHAR) AS departement_code, r_name AS region_code
    FROM nation JOIN region ON n_regionkey = r_regionkey"""

# priorities stand for the five vital needs, statuses for the three essential ones
NEED_OF_PRIORITY = {"1-URGENT": "BV1", "2-HIGH": "BV2", "3-MEDIUM": "BV3", "4-NOT SPECIFIED": "BV4", "5-LOW": "BV5"}
NEED_OF_STATUS = {"F": "BE1", "O": "BE2", "P": "BE3"}

TERRITORIES_SQL = f"""SELECT id_epci, annee,
        avg(CASE WHEN priorite = '1-URGENT' THEN score_indicateur END) AS score_water,
        avg(CASE WHEN priorite = '2-HIGH' THEN score_indicateur END) AS score_food,
        avg(CASE WHEN priorite = '3-MEDIUM' THEN score_indicateur END) AS score_housing,
        avg(CASE WHEN priorite = '4-NOT SPECIFIED' THEN score_indicateur END) AS score_healthcare,
        avg(CASE WHEN priorite = '5-LOW' THEN score_indicateur END) AS score_security,
        avg(CASE WHEN statut = 'F' THEN score_indicateur END) AS score_education,
        avg(CASE WHEN statut = 'O' THEN score_indicateur END) AS score_social_cohesion,
        avg(CASE WHEN statut = 'P' THEN score_indicateur END) AS score_nature
    FROM ({SCORED_SQL}) GROUP BY 1, 2"""


def area_values(t: Tables) -> DataFrame:
    """Mean order price per nation, indicator and year.

    Orders are summed per customer first, so a customer with a third of all
    orders reaches the join as a few rows. Prices are summed in whole cents, so the
    mean does not depend on the order of addition.
    """
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    fine = t.orders.groupBy("o_custkey", "o_orderpriority", "o_orderstatus", F.year("o_orderdate").alias("annee")).agg(
        F.sum(cents).alias("s"), F.count("o_totalprice").alias("n"), F.max("o_orderdate").alias("u")
    )
    placed = fine.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return (
        placed.groupBy("c_nationkey", "o_orderpriority", "o_orderstatus", "annee")
        .agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.max("u").alias("u"))
        .select(
            F.col("c_nationkey").cast("string").alias("id_epci"),
            F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("id_indicateur"),
            F.col("o_orderpriority").alias("priorite"),
            F.col("o_orderstatus").alias("statut"),
            "annee",
            F.try_divide(F.col("s").cast("double"), F.col("n") * 100).alias("valeur_brute"),
            F.date_format("u", "yyyy-MM-dd").alias("updated_at"),
        )
    )


def score_table(t: Tables, staged: bool = True) -> DataFrame:
    """Scores as a stored table, which is what the serving queries read; as a plain frame for a query that reads it once."""
    scored = min_max_scores(area_values(t))
    score = F.col("score_indicateur")
    rows = scored.select(
        "id_epci", "id_indicateur", "annee", "score_indicateur", score.alias("score_global"),
        F.when(F.col("statut") != "P", F.col("statut")).alias("id_besoin"), score.alias("score_besoin"),
        F.col("priorite").alias("id_objectif"), score.alias("score_objectif"),
        F.when(F.col("priorite") == "1-URGENT", "Typ2").otherwise("Typ1").alias("id_type"),
        score.alias("score_type"), "updated_at",
    )
    return stage(rows, "scores") if staged else rows


def areas(t: Tables) -> DataFrame:
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").cast("string").alias("id_epci"), F.col("n_name").alias("libelle"),
        F.col("n_regionkey").cast("string").alias("departement_code"), F.col("r_name").alias("region_code"),
    )


def _dimension(scores: DataFrame, key: str, prefix: str) -> DataFrame:
    """Ids of a score column with a label each."""
    ids = scores.select(key).where(F.col(key).isNotNull()).distinct()
    return ids.withColumn("libelle", F.concat(F.lit(prefix), F.col(key)))


def need_links(scores: DataFrame) -> DataFrame:
    """Every indicator belongs to the need of its priority and that of its status."""
    kinds = scores.select("id_indicateur").distinct()
    parts = F.split("id_indicateur", "/")
    by_priority = F.create_map(*[F.lit(x) for p in NEED_OF_PRIORITY.items() for x in p])
    by_status = F.create_map(*[F.lit(x) for p in NEED_OF_STATUS.items() for x in p])
    needs = F.array(F.try_element_at(by_priority, F.get(parts, 0)), F.try_element_at(by_status, F.get(parts, 1)))
    return kinds.select("id_indicateur", F.explode(needs).alias("id_besoin"))


def territories(t: Tables) -> DataFrame:
    """Wide territory table: mean score per need."""
    scores = score_table(t).select("id_epci", "annee", "id_indicateur", "score_indicateur")
    long = scores.join(need_links(scores), "id_indicateur")
    return pivot_needs(long, ["id_epci", "annee"], "id_besoin", "score_indicateur")


# --- scores ------------------------------------------------------------------


@query("minmax_score", f"SELECT id_epci, id_indicateur, annee, minimum, maximum, score_indicateur FROM ({SCORED_SQL})")
def minmax_score(t: Tables) -> DataFrame:
    scored = min_max_scores(area_values(t))
    return scored.select("id_epci", "id_indicateur", "annee", "minimum", "maximum", "score_indicateur")


@query(
    "minmax_report",
    f"""SELECT id_epci, id_indicateur, annee, CAST(score_indicateur AS DECIMAL(5,2)) AS score_global,
               valeur_brute AS valeur, minimum AS mini, maximum AS maxi FROM ({SCORED_SQL})""",
)
def minmax_report(t: Tables) -> DataFrame:
    """The JSON report is parsed back, so the check does not depend on number formats."""
    rows = score_rows(area_values(t))
    report = F.from_json("rapport", "valeur_brute double, min double, max double")
    return rows.withColumn("r", report).select(
        "id_epci", "id_indicateur", "annee", "score_global",
        F.col("r.valeur_brute").alias("valeur"), F.col("r.min").alias("mini"), F.col("r.max").alias("maxi"),
    )


FIVE_SQL = """CASE WHEN {0} >= 80 THEN 'Excellent' WHEN {0} >= 60 THEN 'Bon' WHEN {0} >= 40 THEN 'Moyen'
    WHEN {0} >= 20 THEN 'Faible' ELSE 'Critique' END"""


@query("band_five", f"SELECT l_orderkey, l_linenumber, {FIVE_SQL.format('(l_quantity * 2)')} AS niveau FROM lineitem")
def band_five(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", band(F.col("l_quantity") * 2).alias("niveau"))


@query(
    "band_six",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity * 2 >= 80 THEN 'Excellent' WHEN l_quantity * 2 >= 70 THEN 'Bon'
         WHEN l_quantity * 2 >= 60 THEN 'Modéré' WHEN l_quantity * 2 >= 50 THEN 'À améliorer'
         WHEN l_quantity * 2 >= 40 THEN 'Insuffisant' ELSE 'Critique' END AS niveau FROM lineitem""",
)
def band_six(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", band(F.col("l_quantity") * 2, SIX_BANDS).alias("niveau"))


@query(
    "agg_band_counts",
    """SELECT l_suppkey, CAST(count(*) FILTER (WHERE coalesce(s, 0) < 40) AS BIGINT) AS n_critique,
              CAST(count(*) FILTER (WHERE s >= 40 AND s < 70) AS BIGINT) AS n_moyen,
              CAST(count(*) FILTER (WHERE s >= 70) AS BIGINT) AS n_bon
       FROM (SELECT l_suppkey, CASE WHEN l_returnflag <> 'A' THEN l_quantity * 2 END AS s FROM lineitem) GROUP BY 1""",
)
def agg_band_counts(t: Tables) -> DataFrame:
    score = F.when(F.col("l_returnflag") != "A", F.col("l_quantity") * 2)
    return band_counts(t.lineitem.select("l_suppkey", score.alias("s")), ["l_suppkey"], "s")


@query(
    "pivot_needs",
    f"""SELECT id_epci, annee, round(score_water, 9) AS score_water, round(score_security, 9) AS score_security,
               round(score_education, 9) AS score_education, CAST(NULL AS DOUBLE) AS score_energy,
               round(list_avg(list_filter([score_water, score_food, score_housing, score_healthcare, score_security,
                   score_education, score_social_cohesion, score_nature], lambda x: x IS NOT NULL)), 9) AS score
        FROM ({TERRITORIES_SQL})""",
)
def pivot(t: Tables) -> DataFrame:
    wide = territories(t)
    shown = ["score_water", "score_security", "score_education", "score_energy", "score"]
    return wide.select("id_epci", "annee", *[F.round(c, 9).alias(c) for c in shown])


@query(
    "unpivot_functions",
    f"""WITH w AS ({TERRITORIES_SQL})
        SELECT id_epci, annee, 'BV1' AS code, 'score_water' AS champ, round(coalesce(score_water, 0), 9) AS score FROM w
        UNION ALL SELECT id_epci, annee, 'BV2', 'score_food', round(coalesce(score_food, 0), 9) FROM w
        UNION ALL SELECT id_epci, annee, 'BV3', 'score_housing', round(coalesce(score_housing, 0), 9) FROM w
        UNION ALL SELECT id_epci, annee, 'BV4', 'score_healthcare', round(coalesce(score_healthcare, 0), 9) FROM w
        UNION ALL SELECT id_epci, annee, 'BV5', 'score_security', round(coalesce(score_security, 0), 9) FROM w
        UNION ALL SELECT id_epci, annee, 'BE1', 'score_education', round(coalesce(score_education, 0), 9) FROM w
        UNION ALL SELECT id_epci, annee, 'BE2', 'score_social_cohesion', round(coalesce(score_social_cohesion, 0), 9) FROM w
        UNION ALL SELECT id_epci, annee, 'BE3', 'score_nature', round(coalesce(score_nature, 0), 9) FROM w
        UNION ALL SELECT id_epci, annee, 'BI1', 'score_local_economy', 0 FROM w
        UNION ALL SELECT id_epci, annee, 'BI2', 'score_energy', 0 FROM w
        UNION ALL SELECT id_epci, annee, 'BI3', 'score_mobility', 0 FROM w""",
)
def unpivot_functions(t: Tables) -> DataFrame:
    long = wide_to_functions(territories(t), ["id_epci", "annee"])
    return long.select("id_epci", "annee", "code", "champ", F.round("score", 9).alias("score"))


FLASH_SQL = """WITH base AS (
        SELECT c_custkey, 'score_water' AS champ, 'BV1' AS code, 'Accès à l''eau' AS libelle, coalesce(nullif(greatest(c_acctbal, 0), 0) / 100, 0) AS base FROM customer
        UNION ALL SELECT c_custkey, 'score_food', 'BV2', 'Alimentation', c_nationkey * 4.0 FROM customer),
    over AS (SELECT o_custkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'score_water' ELSE 'score_food' END AS champ,
                    max(o_totalprice) / 5000 AS valeur
             FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1, 2),
    m AS (SELECT base.*, coalesce(valeur, base) AS valeur FROM base LEFT JOIN over
          ON c_custkey = o_custkey AND base.champ = over.champ)"""


def _flash(t: Tables) -> DataFrame:
    columns = {"BV1": "score_water", "BV2": "score_food"}
    balance = F.greatest("c_acctbal", F.lit(0.0))
    table = t.customer.select(
        "c_custkey", (F.nullif(balance, F.lit(0.0)) / 100).alias("score_water"),
        (F.col("c_nationkey") * 4.0).alias("score_food"),
    )
    field = F.when(F.col("o_orderpriority") == "1-URGENT", "score_water").otherwise("score_food")
    overrides = (
        t.orders.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
        .groupBy(F.col("o_custkey").alias("c_custkey"), field.alias("champ"))
        .agg((F.max("o_totalprice") / 5000).alias("valeur"))
    )
    return flash_metrics(table, overrides, "c_custkey", columns)


@query(
    "flash_metrics",
    f"""{FLASH_SQL} SELECT c_custkey, champ, code, libelle, round(base, 9) AS base, round(valeur, 9) AS valeur,
        {FIVE_SQL.format('valeur')} AS interpretation FROM m""",
)
def flash(t: Tables) -> DataFrame:
    metrics = _flash(t)
    return metrics.withColumns({"base": F.round("base", 9), "valeur": F.round("valeur", 9)})


@query(
    "flash_summary",
    f"{FLASH_SQL} SELECT c_custkey, round(avg(base), 9) AS score_base, round(avg(valeur), 9) AS score_ajuste FROM m GROUP BY 1",
)
def flash_totals(t: Tables) -> DataFrame:
    summary = flash_summary(_flash(t), "c_custkey")
    return summary.withColumns({c: F.round(c, 9) for c in ("score_base", "score_ajuste")})


NEED_LINKS_SQL = """SELECT DISTINCT o_orderpriority || '/' || o_orderstatus AS id_indicateur,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'BV1' WHEN '2-HIGH' THEN 'BV2' WHEN '3-MEDIUM' THEN 'BV3'
             WHEN '4-NOT SPECIFIED' THEN 'BV4' WHEN '5-LOW' THEN 'BV5' END AS id_besoin FROM orders
    UNION ALL
    SELECT DISTINCT o_orderpriority || '/' || o_orderstatus,
        CASE o_orderstatus WHEN 'F' THEN 'BE1' WHEN 'O' THEN 'BE2' WHEN 'P' THEN 'BE3' END FROM orders"""


@query(
    "need_scores",
    f"""SELECT id_epci, annee, id_besoin, round(avg(score_indicateur), 9) AS score_besoin
        FROM ({SCORED_SQL}) JOIN ({NEED_LINKS_SQL}) USING (id_indicateur) GROUP BY 1, 2, 3""",
)
def need_scores(t: Tables) -> DataFrame:
    scores = score_table(t)
    means = mean_score_by_link(
        scores, need_links(scores), ["id_epci", "annee"], "id_indicateur", "id_besoin", "score_indicateur", "m"
    )
    return means.select("id_epci", "annee", "id_besoin", F.round("m", 9).alias("score_besoin"))


@query(
    "global_scores",
    f"""WITH s AS ({SCORED_SQL}),
             n AS (SELECT id_epci, annee, id_besoin, avg(score_indicateur) AS m FROM s
                   JOIN ({NEED_LINKS_SQL}) USING (id_indicateur) GROUP BY 1, 2, 3),
             o AS (SELECT id_epci, annee, priorite, avg(score_indicateur) AS m FROM s GROUP BY 1, 2, 3)
        SELECT id_epci, annee, round(avg(score_indicateur), 9) AS score_global,
               (SELECT round(avg(m), 9) FROM n WHERE n.id_epci = s.id_epci AND n.annee = s.annee) AS score_besoin,
               (SELECT round(avg(m), 9) FROM o WHERE o.id_epci = s.id_epci AND o.annee = s.annee) AS score_objectif
        FROM s GROUP BY 1, 2""",
)
def global_score_rows(t: Tables) -> DataFrame:
    scores = score_table(t)
    objectives = scores.select("id_indicateur", "id_objectif").distinct()
    rows = global_scores(
        scores, ["id_epci", "annee"], "id_indicateur", "score_indicateur",
        {"score_besoin": (need_links(scores), "id_besoin"), "score_objectif": (objectives, "id_objectif")},
    )
    return rows.select(
        "id_epci", "annee", *[F.round(c, 9).alias(c) for c in ("score_global", "score_besoin", "score_objectif")]
    )


# --- serving -----------------------------------------------------------------


@query("latest_year", "SELECT coalesce(max(CAST(year(o_orderdate) AS INTEGER)), 0) AS annee FROM orders")
def latest_year(t: Tables) -> DataFrame:
    return serving.latest_year(t.orders.select(F.year("o_orderdate").alias("annee")))


LIST_SQL = f"""WITH s AS ({SCORES_SQL}), a AS ({AREAS_SQL})
    SELECT id_epci, libelle, departement_code, region_code, round(avg(score_global), 9) AS score_global,
           count(id_indicateur) AS n_indicateurs, max(updated_at) AS updated_at
    FROM s JOIN a USING (id_epci) WHERE annee = (SELECT max(annee) FROM s)"""
GROUP_SQL = " GROUP BY 1, 2, 3, 4"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score_global", F.round("score_global", 9))


@query("list_scores", f"{LIST_SQL}{GROUP_SQL} ORDER BY avg(score_global) DESC NULLS LAST, id_epci LIMIT 10 OFFSET 5")
def list_page(t: Tables) -> DataFrame:
    return _rounded(serving.list_scores(score_table(t), areas(t), limit=10, offset=5, order_by="score"))


@query(
    "list_scores_after",
    f"""SELECT * FROM ({LIST_SQL}{GROUP_SQL}) WHERE libelle > (SELECT max(n_name) FROM nation WHERE n_regionkey = 1)
        OR (libelle = (SELECT max(n_name) FROM nation WHERE n_regionkey = 1) AND id_epci > '12') ORDER BY libelle, id_epci LIMIT 10""",
)
def list_page_after(t: Tables) -> DataFrame:
    """The page after the last name of a region, found without the pages before it."""
    last = t.nation.where(F.col("n_regionkey") == 1).agg(F.max("n_name")).first()[0]
    return _rounded(serving.list_scores_after(score_table(t), areas(t), (last, "12"), limit=10))


@query(
    "list_scores_search",
    f"{LIST_SQL} AND (lower(libelle) LIKE '%n_1%' OR lower(id_epci) LIKE '%n_1%'){GROUP_SQL} ORDER BY libelle, id_epci LIMIT 50",
)
def list_search(t: Tables) -> DataFrame:
    return _rounded(serving.list_scores(score_table(t), areas(t), search="N_1"))


@query("list_scores_total", f"SELECT count(*) AS total FROM ({LIST_SQL}{GROUP_SQL})")
def list_total(t: Tables) -> DataFrame:
    return serving.score_summaries(score_table(t), areas(t)).agg(F.count(F.lit(1)).alias("total"))


@query("detail_summary", f"{LIST_SQL}{GROUP_SQL}")
def detail_summary(t: Tables) -> DataFrame:
    """The summary block of every area at once."""
    return _rounded(serving.score_summaries(score_table(t), areas(t)))


@query(
    "detail_needs",
    f"""WITH s AS ({SCORES_SQL}) SELECT id_epci, id_besoin AS id, 'Besoin ' || id_besoin AS label, round(avg(score_besoin), 9) AS score
        FROM s WHERE annee = (SELECT max(annee) FROM s) AND id_besoin IS NOT NULL GROUP BY 1, 2""",
)
def detail_needs(t: Tables) -> DataFrame:
    scores = score_table(t)
    rows = serving.detail_groups(scores, _dimension(scores, "id_besoin", "Besoin "), "id_besoin", "score_besoin")
    return rows.withColumn("score", F.round("score", 9))


@query(
    "detail_indicators",
    f"""SELECT id_epci, id_indicateur, 'Indicateur ' || id_indicateur AS indicateur_libelle, score_indicateur,
               id_besoin, 'Besoin ' || id_besoin AS besoin_libelle, score_besoin,
               id_objectif, CASE WHEN id_objectif <> '5-LOW' THEN 'Objectif ' || id_objectif END AS objectif_libelle, score_objectif,
               id_type, CASE id_type WHEN 'Typ1' THEN 'État' ELSE 'Action' END AS type_libelle, score_type
        FROM ({SCORES_SQL}) WHERE annee = 1998""",
)
def detail_indicators(t: Tables) -> DataFrame:
    """One objective is missing from its dimension and keeps a null label."""
    scores = score_table(t)
    types = t.spark.createDataFrame([("Typ1", "État"), ("Typ2", "Action")], "id_type string, libelle string")
    return serving.detail_indicators(
        scores,
        _dimension(scores, "id_indicateur", "Indicateur "),
        _dimension(scores, "id_besoin", "Besoin "),
        _dimension(scores.where(F.col("id_objectif") != "5-LOW"), "id_objectif", "Objectif "),
        types,
        1998,
    )


@query(
    "join_inner",
    f"""SELECT id_epci, id_indicateur, annee, score_indicateur, libelle AS epci_libelle, departement_code, region_code
        FROM ({SCORED_SQL}) JOIN ({AREAS_SQL}) USING (id_epci)""",
)
def score_lines(t: Tables) -> DataFrame:
    rows = score_table(t, staged=False).select("id_epci", "id_indicateur", "annee", "score_indicateur")
    return serving.score_lines_view(rows, areas(t))


@query(
    "view_scores",
    f"""WITH s AS ({SCORES_SQL}), g AS (
            SELECT CAST(c_nationkey AS VARCHAR) AS id_epci, CAST(year(o_orderdate) AS INTEGER) AS annee,
                   max(o_totalprice) AS score_global, min(o_totalprice) AS score_besoin
            FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' GROUP BY 1, 2)
        SELECT s.id_epci, libelle AS epci_libelle, departement_code, region_code, s.annee, g.score_global, g.score_besoin,
               count(DISTINCT id_indicateur) AS indicator_count, round(avg(score_indicateur), 9) AS avg_indicator_score
        FROM s JOIN ({AREAS_SQL}) a ON a.id_epci = s.id_epci LEFT JOIN g ON g.id_epci = s.id_epci AND g.annee = s.annee
        GROUP BY ALL""",
)
def view_scores(t: Tables) -> DataFrame:
    """Some area-years have no stored global score and keep nulls."""
    urgent = t.orders.where((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT"))
    fine = urgent.groupBy("o_custkey", F.year("o_orderdate").alias("annee")).agg(
        F.max("o_totalprice").alias("hi"), F.min("o_totalprice").alias("lo")
    )
    stored = (
        fine.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("c_nationkey").cast("string").alias("id_epci"), "annee")
        .agg(F.max("hi").alias("score_global"), F.min("lo").alias("score_besoin"))
        .withColumns(
            {c: F.lit(None).cast("double") for c in ("score_objectif", "score_type")}
            | {"updated_at": F.lit(None).cast("string")}
        )
    )
    view = serving.area_scores_view(score_table(t, staged=False), areas(t), stored)
    return view.select(
        "id_epci", "epci_libelle", "departement_code", "region_code", "annee", "score_global", "score_besoin",
        "indicator_count", F.round("avg_indicator_score", 9).alias("avg_indicator_score"),
    )


@query(
    "view_indicator_labels",
    """WITH l AS (SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus FROM lineitem)
       SELECT s_suppkey AS id_indicateur, s_name AS libelle,
              (SELECT string_agg(DISTINCT 'Retour ' || l_returnflag, ',' ORDER BY 'Retour ' || l_returnflag) FROM l
               WHERE l_suppkey = s_suppkey AND l_returnflag <> 'A') AS besoins,
              (SELECT string_agg(DISTINCT 'Statut ' || l_linestatus, ',' ORDER BY 'Statut ' || l_linestatus) FROM l
               WHERE l_suppkey = s_suppkey) AS objectifs
       FROM supplier""",
)
def view_indicator_labels(t: Tables) -> DataFrame:
    """Suppliers as indicators; one flag is not in the dimension, so it has no label."""
    indicators = t.supplier.select(F.col("s_suppkey").alias("id_indicateur"), F.col("s_name").alias("libelle"))
    lines = t.lineitem.select(F.col("l_suppkey").alias("id_indicateur"), "l_returnflag", "l_linestatus")
    flags = _dimension(t.lineitem.where(F.col("l_returnflag") != "A"), "l_returnflag", "Retour ")
    states = _dimension(t.lineitem, "l_linestatus", "Statut ")
    view = serving.indicator_labels_view(
        indicators,
        {
            "besoins": (lines.select("id_indicateur", "l_returnflag").distinct(), flags, "l_returnflag"),
            "objectifs": (lines.select("id_indicateur", "l_linestatus").distinct(), states, "l_linestatus"),
        },
    )
    return view.select(
        "id_indicateur", "libelle",
        F.array_join("besoins", ",").alias("besoins"), F.array_join("objectifs", ",").alias("objectifs"),
    )


# --- reference sheets --------------------------------------------------------


@query(
    "ingest_dim",
    """SELECT '' || p_partkey AS id_besoin, p_name AS libelle,
              CASE WHEN p_type = 'PROMO' THEN p_brand ELSE p_type END AS categorie, CAST(NULL AS VARCHAR) AS description
       FROM part WHERE p_type <> 'SMALL'""",
)
def ingest_dim(t: Tables) -> DataFrame:
    sheet = t.part.select(
        F.when(F.col("p_type") != "SMALL", F.concat(F.lit(" "), F.col("p_partkey").cast("string"))).alias("ID_besoins "),
        F.col("p_name").alias("Libellé"),
        F.when(F.col("p_type") == "PROMO", F.lit(" nan")).otherwise(F.col("p_type")).alias("Type_de_besoins"),
        F.col("p_brand").alias("Catégorie"),
    )
    return sheets.ingest_needs(sheets.sheet_rows(sheet))


@query(
    "ingest_dim_flags",
    """SELECT 'i' || CASE WHEN p_partkey < 1000 THEN lpad('' || p_partkey, 3, '0') ELSE '' || p_partkey END AS id_indicateur,
              coalesce(CASE WHEN p_type <> 'LARGE' THEN p_name END, '') AS libelle,
              p_type = 'PROMO' AS api_disponible, p_brand AS unite FROM part""",
)
def ingest_dim_flags(t: Tables) -> DataFrame:
    sheet = t.part.select(
        F.concat(F.lit("I "), F.col("p_partkey").cast("string")).alias("ID_indicateurs"),
        F.when(F.col("p_type") != "LARGE", F.col("p_name")).alias("Libellé_indicateurs"),
        F.when(F.col("p_type") == "PROMO", "oui").when(F.col("p_type") == "SMALL", "  ").alias("API disponible"),
        F.col("p_brand").alias("Unité"),
    )
    rows = sheets.ingest_indicators(sheets.sheet_rows(sheet))
    return rows.select("id_indicateur", "libelle", "api_disponible", "unite")


@query(
    "ingest_territory",
    """SELECT '' || c_custkey AS id_epci, '' || c_nationkey AS departement_code, c_name AS libelle,
              c_mktsegment AS forme_juridique, CAST(trunc(c_acctbal) AS INTEGER) AS population_totale,
              CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal END AS surface_km2 FROM customer""",
)
def ingest_territory(t: Tables) -> DataFrame:
    sheet = t.customer.select(
        F.concat(F.lit("0"), F.col("c_custkey").cast("string"), F.lit(".0")).alias(" SIREN"),
        F.concat(F.lit(" "), F.col("c_nationkey").cast("string")).alias("Dept"),
        F.col("c_name").alias("EPCI_libellé"),
        F.col("c_mktsegment").alias("Nature_juridique"),
        F.col("c_acctbal").cast("string").alias("total_pop_tot"),
        F.when(F.col("c_mktsegment") == "BUILDING", "n.d.").otherwise(F.col("c_acctbal").cast("string")).alias(
            "superficie_km2"
        ),
    )
    rows = sheets.ingest_areas(sheets.sheet_rows(sheet))
    return rows.select("id_epci", "departement_code", "libelle", "forme_juridique", "population_totale", "surface_km2")


@query(
    "ingest_links",
    """WITH l AS (SELECT 'i' || lpad('' || p_size, 3, '0') AS ind, p_brand AS id_besoin, p_type FROM part WHERE p_brand <> 'Brand#9'
                  UNION ALL SELECT 'i' || lpad('' || p_size, 3, '0'), p_type, p_type FROM part)
       SELECT id_besoin, CASE WHEN bool_or(p_type <> 'PROMO') THEN 'Vitaux' ELSE 'connu' END AS categorie,
              string_agg(DISTINCT ind, ',' ORDER BY ind) AS indicateurs
       FROM l GROUP BY 1""",
)
def ingest_links(t: Tables) -> DataFrame:
    """Need columns of a link sheet, both ways of the relation, category from the first row that has one."""
    sheet = t.part.select(
        F.concat(F.lit("I "), F.col("p_size").cast("string")).alias("ID_Indicateurs"),
        F.col("p_brand").alias("Besoin 1"), F.col("p_type").alias("Besoin 3"),
        F.when(F.col("p_type") != "PROMO", " Vitaux").alias("Type_de_besoins"),
    )
    known = (
        t.part.where(F.col("p_brand") != "Brand#9").select(F.col("p_brand").alias("id_besoin"))
        .union(t.part.select("p_type")).distinct().withColumn("categorie", F.lit("connu"))
    )
    links = sheets.need_links(sheets.sheet_rows(sheet), known)
    needs = sheets.attach_links(
        sheets.settle_categories(known, links), links, "id_besoin", "id_indicateur", "ids_indicateurs"
    )
    return needs.select("id_besoin", "categorie", F.array_join("ids_indicateurs", ",").alias("indicateurs"))


@query(
    "ingest_flag_links",
    """SELECT DISTINCT 'i' || lpad('' || p_size, 3, '0') AS id_indicateur,
              CASE p_type WHEN 'PROMO' THEN 'o1' ELSE 'o3' END AS id_objectif FROM part WHERE p_type IN ('PROMO', 'LARGE', 'SMALL')""",
)
def ingest_flag_links(t: Tables) -> DataFrame:
    """Flag columns of a link sheet; the second objective is not in the dimension."""
    kind = F.col("p_type")
    sheet = t.part.select(
        F.col("p_size").cast("string").alias("ID_Indicateurs"),
        F.when(kind == "PROMO", " X").otherwise("0").alias("o1_Subsistance"),
        F.lit("oui").alias("o2_Gestion-de-crise"),
        F.when(kind == "LARGE", "Oui").when(kind == "SMALL", "1").otherwise("non").alias("o3_Soutenabilité"),
    )
    known = t.spark.createDataFrame([("o1",), ("o3",)], "id_objectif string")
    return sheets.objective_links(sheets.sheet_rows(sheet), known).distinct()


@query(
    "unpivot_partial_upsert",
    """WITH s AS (SELECT '' || c_custkey AS id_epci, 'i001' AS id_indicateur, c_acctbal AS v, c_name AS libelle_epci FROM customer
                  UNION ALL SELECT '' || c_custkey, 'i002', c_nationkey, c_name FROM customer WHERE c_mktsegment <> 'BUILDING'),
            t AS (SELECT '' || c_custkey AS id_epci, 'i002' AS id_indicateur, 0 AS annee, CAST(50 AS DOUBLE) AS score_indicateur,
                         CAST(NULL AS VARCHAR) AS libelle_epci, c_mktsegment AS rapport FROM customer WHERE c_acctbal > 0)
       SELECT coalesce(t.id_epci, s.id_epci) AS id_epci, coalesce(t.id_indicateur, s.id_indicateur) AS id_indicateur, 0 AS annee,
              coalesce(s.v, t.score_indicateur) AS score_indicateur,
              s.libelle_epci, t.rapport
       FROM t FULL JOIN s ON t.id_epci = s.id_epci AND t.id_indicateur = s.id_indicateur""",
)
def unpivot_partial_upsert(t: Tables) -> DataFrame:
    """A wide score sheet changes score and label of stored rows and leaves the report."""
    key = F.col("c_custkey").cast("string")
    sheet = t.customer.select(
        key.alias("Code EPCI"), F.col("c_name").alias("Libellé EPCI"),
        F.col("c_acctbal").cast("string").alias("i001"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_nationkey").cast("string")).alias("I 2"),
    )
    stored = t.customer.where(F.col("c_acctbal") > 0).select(
        key.alias("id_epci"), F.lit("i002").alias("id_indicateur"), F.lit(0).alias("annee"),
        F.lit(50.0).alias("score_indicateur"), F.lit(None).cast("string").alias("libelle_epci"),
        F.col("c_mktsegment").alias("rapport"),
    )
    batch = sheets.ingest_scores(sheets.sheet_rows(sheet)).withColumn("seq", F.lit(0))
    return merge_upsert(stored, batch, ["id_epci", "id_indicateur", "annee"], "seq")


@query(
    "ingest_objectives",
    """SELECT '' || p_partkey AS id_objectif, CASE WHEN p_type = 'PROMO' THEN '' ELSE p_name END AS libelle,
              CASE WHEN p_type <> 'LARGE' THEN p_brand END AS description FROM part WHERE p_type <> 'SMALL'""",
)
def ingest_objectives(t: Tables) -> DataFrame:
    """Blank ids are left out, a missing label is an empty text, ``none`` is no description."""
    key = F.concat(F.lit(" "), F.col("p_partkey").cast("string"), F.lit(" "))
    sheet = t.part.select(
        F.when(F.col("p_type") != "SMALL", key).otherwise("  ").alias("ID_Objectifs"),
        F.when(F.col("p_type") == "PROMO", "NaN").otherwise(F.col("p_name")).alias(" Libellé"),
        F.when(F.col("p_type") == "LARGE", "None").otherwise(F.col("p_brand")).alias("Description"),
    )
    return sheets.ingest_objectives(sheets.sheet_rows(sheet))


@query(
    "ingest_types",
    """SELECT '' || p_partkey AS id_type, p_name AS libelle, CAST(NULL AS VARCHAR) AS description FROM part WHERE p_type <> 'SMALL'""",
)
def ingest_types(t: Tables) -> DataFrame:
    """The id stands in one of two columns."""
    key = F.col("p_partkey").cast("string")
    sheet = t.part.select(
        F.when(F.col("p_type") == "PROMO", key).alias("ID_"),
        F.when(~F.col("p_type").isin("PROMO", "SMALL"), key).alias("ID_Type"), F.col("p_name").alias("Libellé"),
    )
    return sheets.ingest_types(sheets.sheet_rows(sheet))


@query(
    "ingest_type_links",
    """SELECT DISTINCT 'i' || lpad('' || p_size, 3, '0') AS id_indicateur,
              CASE p_type WHEN 'PROMO' THEN 'Typ1' ELSE 'Typ2' END AS id_type FROM part WHERE p_type IN ('PROMO', 'LARGE')""",
)
def ingest_type_links(t: Tables) -> DataFrame:
    kind = F.col("p_type")
    sheet = t.part.select(
        F.concat(F.lit("i"), F.col("p_size").cast("string")).alias("ID_indicateurs"),
        F.when(kind == "PROMO", "X").otherwise("").alias("Typ1_Etat"), F.when(kind == "LARGE", "1").otherwise("non").alias("Typ2_Action"),
    )
    known = t.spark.createDataFrame([("Typ1",), ("Typ2",)], "id_type string")
    return sheets.type_links(sheets.sheet_rows(sheet), known).distinct()


@query(
    "detail_needs_stored",
    f"""WITH s AS ({SCORES_SQL}) SELECT id_epci, id_besoin AS id, 'Besoin ' || id_besoin AS label, round(avg(CAST(round(score_besoin, 2) AS DOUBLE)), 6) AS score
        FROM s WHERE annee = (SELECT max(annee) FROM s) AND id_besoin IS NOT NULL GROUP BY 1, 2""",
)
def detail_needs_stored(t: Tables) -> DataFrame:
    """Scores stored in two batches, one of them without needs, then served from the stored table."""
    scores = score_table(t).withColumn("updated_at", F.to_timestamp("updated_at"))
    path = t.scratch("stored_scores")
    store_scores(scores.drop("id_besoin", "score_besoin"), path)
    store_scores(scores.select("id_epci", "id_indicateur", "annee", "id_besoin", "score_besoin"), path)
    stored = read_table(t.spark, path, "score_indicateur")
    rows = serving.detail_groups(stored, _dimension(stored, "id_besoin", "Besoin "), "id_besoin", "score_besoin")
    return rows.withColumn("score", F.round("score", 6))


PRICES_SQL = """SELECT CAST(c_nationkey AS VARCHAR) AS id_epci, o_orderpriority AS id_indicateur, CAST(year(o_orderdate) AS INTEGER) AS annee,
        CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 100) AS v
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL"""


@query(
    "rescore_changed",
    f"""WITH p AS (SELECT id_epci, id_indicateur, annee,
                      CASE WHEN id_indicateur <> '1-URGENT' THEN v WHEN id_epci = '2' THEN NULL WHEN id_epci LIKE '1%' THEN 2 * v ELSE v END AS v
               FROM ({PRICES_SQL}))
        SELECT id_epci, id_indicateur, annee, v AS valeur_brute,
               round((v - min(v) OVER w) / greatest(max(v) OVER w - min(v) OVER w, 1e-9) * 100, 2) AS score
        FROM p WINDOW w AS (PARTITION BY id_indicateur, annee)""",
)
def rescore_after_a_batch(t: Tables) -> DataFrame:
    """All values stored and scored; then a batch changes one indicator, and only that one is scored again."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    values = (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("c_nationkey").cast("string").alias("id_epci"), F.col("o_orderpriority").alias("id_indicateur"), F.year("o_orderdate").alias("annee"))
        .agg((F.sum(cents).cast("double") / (F.count(F.lit(1)) * 100)).alias("valeur_brute"))
    )
    values = stage(values, "prices")
    values_path, scores_path = t.scratch("values"), t.scratch("scores")
    store_values(values, values_path)
    rescore_changed(values, values_path, scores_path)
    urgent = values.where(F.col("id_indicateur") == "1-URGENT")
    changed = F.when(F.col("id_epci").like("1%"), 2 * F.col("valeur_brute"))
    batch = urgent.where(F.col("id_epci").like("1%") | (F.col("id_epci") == "2")).withColumn("valeur_brute", changed)
    store_values(batch, values_path)
    rescore_changed(batch, values_path, scores_path)
    keys = ["id_epci", "id_indicateur", "annee"]
    scores = read_table(t.spark, scores_path, "score_indicateur").select(*keys, F.col("score_indicateur").cast("double").alias("score"))
    return read_table(t.spark, values_path, "valeur_indicateur").select(*keys, "valeur_brute").join(scores, keys)


@query(
    "detail_all",
    f"""WITH s AS ({SCORES_SQL}), y AS (SELECT * FROM s WHERE annee = (SELECT max(annee) FROM s)),
             n AS (SELECT id_epci, id_besoin AS id FROM y WHERE id_besoin IS NOT NULL GROUP BY 1, 2),
             o AS (SELECT id_epci, id_objectif AS id FROM y GROUP BY 1, 2)
        SELECT y.id_epci, count(*) AS n_indicateurs,
               (SELECT string_agg(id, ',' ORDER BY 'Besoin ' || id) FROM n WHERE n.id_epci = y.id_epci) AS besoins,
               (SELECT string_agg(id, ',' ORDER BY 'Objectif ' || id) FROM o WHERE o.id_epci = y.id_epci) AS objectifs,
               string_agg(y.id_indicateur, ',' ORDER BY y.id_indicateur) AS indicateurs
        FROM y JOIN nation ON '' || n_nationkey = y.id_epci GROUP BY 1""",
)
def detail_all(t: Tables) -> DataFrame:
    """The whole drill-down of every area, its nested arrays shown as their ids in order."""
    scores = score_table(t)
    dims = {key: _dimension(scores, key, prefix) for key, prefix in (
        ("id_indicateur", ""), ("id_besoin", "Besoin "), ("id_objectif", "Objectif "), ("id_type", "Type "))}
    found = serving.score_detail_all(scores, areas(t), dims["id_indicateur"], dims["id_besoin"], dims["id_objectif"], dims["id_type"])

    def ids(name: str, key: str = "id"):
        return F.array_join(F.transform(name, lambda x: x[key]), ",")

    return found.select(
        "id_epci", "n_indicateurs", F.nullif(ids("needs"), F.lit("")).alias("besoins"), F.nullif(ids("objectives"), F.lit("")).alias("objectifs"),
        ids("indicators", "id_indicateur").alias("indicateurs"))


@query(
    "import_merge",
    """WITH t AS (SELECT '' || c_custkey AS id_epci, 'i001' AS id_indicateur, CASE WHEN c_nationkey % 2 = 0 THEN 2024 ELSE 0 END AS annee,
                         c_acctbal AS valeur_brute, 'api' AS source FROM customer),
            w AS (SELECT '' || c_custkey AS id_epci, 'i001' AS id_indicateur, 0 AS annee, CAST(c_nationkey AS DOUBLE) AS valeur_brute,
                         'Excel/Table Valeurs' AS source FROM customer WHERE c_mktsegment <> 'BUILDING')
       SELECT coalesce(w.id_epci, t.id_epci) AS id_epci, coalesce(w.id_indicateur, t.id_indicateur) AS id_indicateur,
              coalesce(w.annee, t.annee) AS annee, coalesce(w.valeur_brute, t.valeur_brute) AS valeur_brute,
              coalesce(w.source, t.source) AS source, CASE WHEN t.id_epci IS NOT NULL THEN 'euro' END AS unite
       FROM t FULL JOIN w ON t.id_epci = w.id_epci AND t.annee = w.annee""",
)
def import_merge(t: Tables) -> DataFrame:
    """A sheet import into a stored value table: other years stay, and so do the columns that sheets do not bring."""
    target, folder = t.scratch("stored"), t.scratch("sheets")
    key = F.col("c_custkey").cast("string")
    upsert_stored(f"{target}/valeur_indicateur", t.customer.select(
        key.alias("id_epci"), F.lit("i001").alias("id_indicateur"),
        F.when(F.col("c_nationkey") % 2 == 0, 2024).otherwise(0).alias("annee"), F.col("c_acctbal").alias("valeur_brute"),
        F.lit("api").alias("source"), F.lit("euro").alias("unite")), "valeur_indicateur")
    # the indicator has two spellings: the later column wins
    sheet = t.customer.where(F.col("c_mktsegment") != "BUILDING").select(
        key.alias("ID_EPCI"), F.lit("5").alias("I 1"), F.col("c_nationkey").cast("string").alias("i001"))
    write_delimited(sheet, f"{folder}/{sheets.VALUES}.csv")
    return sheets.import_folder(t.spark, folder, target)["valeur_indicateur"].select(
        "id_epci", "id_indicateur", "annee", "valeur_brute", "source", "unite")
