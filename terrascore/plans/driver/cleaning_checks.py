"""Cleaners and projections on text derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrascore.functions import cleaning as c
from terrascore.functions.labels import indicator_kind, like_ci, objective_of, source_kind
from terrascore.operators.shape import (
    all_but, drop_columns, move_column_values, pick_positions, rename_known, unpivot_values, wide_sheet_to_long,
    with_constants,
)
from terrascore.plans.driver.registry import Tables, query


def by_type(**texts: Column) -> Column:
    """A different spelling per part type, to feed every branch of a cleaner."""
    expr = None
    for name, text in texts.items():
        if name == "other":
            continue
        test = F.col("p_type") == name
        expr = F.when(test, text) if expr is None else expr.when(test, text)
    return expr.otherwise(texts["other"])


def part_key() -> Column:
    return F.col("p_partkey").cast("string")


@query(
    "clean_str",
    """SELECT p_partkey, CASE WHEN p_type IN ('PROMO', 'SMALL', 'LARGE') THEN NULL ELSE p_name END AS texte FROM part""",
)
def clean_str(t: Tables) -> DataFrame:
    raw = by_type(
        PROMO=F.lit(" NaN "), SMALL=F.lit("   "), LARGE=F.lit("None"),
        other=F.concat(F.lit("  "), "p_name", F.lit(" \t")),
    )
    return t.part.select("p_partkey", c.clean_text(raw).alias("texte"))


@query(
    "clean_code",
    """SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN p_partkey || 'A' WHEN 'LARGE' THEN '' || p_partkey * 100
              WHEN 'MEDIUM' THEN NULL ELSE '' || p_partkey END AS code FROM part
       UNION ALL SELECT -p_partkey, CASE p_type WHEN 'PROMO' THEN '' || p_partkey || repeat('0', 40) ELSE '1' END FROM part""",
)
def clean_code(t: Tables) -> DataFrame:
    raw = by_type(
        PROMO=F.concat(part_key(), F.lit("A")), SMALL=F.concat(part_key(), F.lit(".0")), LARGE=F.concat(part_key(), F.lit("e2")),
        MEDIUM=F.lit("nan"), other=F.concat(F.lit(" 00"), part_key(), F.lit(" ")),
    )
    # an exponent far beyond any integer type, and digits that must be cut off, not rounded
    wide = F.when(F.col("p_type") == "PROMO", F.concat(part_key(), F.lit("e40"))).otherwise("1.99999999999e0")
    return t.part.select("p_partkey", c.clean_code(raw).alias("code")).union(
        t.part.select(-F.col("p_partkey"), c.clean_code(wide)))


@query(
    "clean_indicator_id",
    """SELECT p_partkey, CASE WHEN p_type = 'LARGE' THEN 'x' || p_partkey
              ELSE 'i' || CASE WHEN p_partkey < 1000 THEN lpad('' || p_partkey, 3, '0') ELSE '' || p_partkey END
              END AS id_indicateur FROM part""",
)
def clean_indicator_id(t: Tables) -> DataFrame:
    raw = by_type(
        PROMO=F.concat(F.lit("I "), part_key()), SMALL=F.concat(F.lit("i00"), part_key()), LARGE=F.concat(F.lit("X"), part_key()), other=part_key()
    )
    return t.part.select("p_partkey", c.clean_indicator_id(raw).alias("id_indicateur"))


PRICE_SQL = "CASE WHEN p_type IN ('PROMO', 'SMALL') THEN NULL ELSE {0} END"


def _price_text() -> Column:
    return by_type(
        PROMO=F.lit("n/a"), SMALL=F.lit("12d"), other=F.concat(F.lit(" "), F.col("p_retailprice").cast("string"))
    )


@query(
    "clean_to_int",
    f"""SELECT p_partkey, {PRICE_SQL.format('CAST(trunc(p_retailprice) AS INTEGER)')} AS n FROM part
        UNION ALL SELECT -p_partkey, CASE WHEN p_size <= 25 THEN p_size * 10000000 END FROM part""",
)
def clean_to_int(t: Tables) -> DataFrame:
    wide = F.concat("p_size", F.when(F.col("p_size") <= 25, "e0007").otherwise("e305"))
    return t.part.select("p_partkey", c.to_int(_price_text()).alias("n")).union(t.part.select(-F.col("p_partkey"), c.to_int(wide)))


@query(
    "clean_to_float",
    f"""SELECT p_partkey, {PRICE_SQL.format('p_retailprice')} AS x FROM part
        UNION ALL SELECT -p_partkey, CASE WHEN p_size <= 25 THEN CAST(p_size || 'e305' AS DOUBLE) END FROM part""",
)
def clean_to_float(t: Tables) -> DataFrame:
    """Large numbers stay; what overflows is no number."""
    wide = F.concat("p_size", F.when(F.col("p_size") <= 25, "e305").otherwise("e0400"))
    return t.part.select("p_partkey", c.to_float(_price_text()).alias("x")).union(t.part.select(-F.col("p_partkey"), c.to_float(wide)))


@query(
    "clean_flag",
    """SELECT p_partkey, p_type IN ('PROMO', 'SMALL', 'LARGE') AS drapeau,
              p_type NOT IN ('ECONOMY') AS present FROM part""",
)
def clean_flag(t: Tables) -> DataFrame:
    raw = by_type(
        PROMO=F.lit(" X "), SMALL=F.lit("Oui"), LARGE=F.lit("TRUE"), MEDIUM=F.lit("0"), ECONOMY=F.lit("  "),
        other=F.lit("non"),
    )
    return t.part.select("p_partkey", c.is_flagged(raw).alias("drapeau"), c.is_present(raw).alias("present"))


PADDED = "CASE WHEN length('' || {0}) < 5 THEN lpad('' || {0}, 5, '0') ELSE '' || {0} END"


@query(
    "clean_postal",
    f"SELECT p_partkey, CASE WHEN p_type = 'LARGE' THEN NULL ELSE {PADDED.format('p_partkey')} END AS code FROM part",
)
def clean_postal(t: Tables) -> DataFrame:
    raw = by_type(PROMO=F.concat(part_key(), F.lit(".0")), LARGE=F.lit(None).cast("string"), other=part_key())
    return t.part.select("p_partkey", c.pad_code(raw).alias("code"))


@query(
    "clean_placeholders",
    f"""SELECT p_partkey, CASE WHEN p_type IN ('PROMO', 'SMALL', 'LARGE', 'MEDIUM') OR p_partkey = 0 THEN NULL
               ELSE {PADDED.format('p_partkey')} END AS code FROM part""",
)
def clean_placeholders(t: Tables) -> DataFrame:
    raw = by_type(
        PROMO=F.lit("INSEE"), SMALL=F.lit(" nan "), LARGE=F.lit("0.0"), MEDIUM=F.lit("commune"),
        other=F.concat(part_key(), F.lit(".0")),
    )
    return t.part.select("p_partkey", c.clean_area_code(raw).alias("code"))


@query(
    "clean_number_fr",
    """SELECT o_orderkey, CAST(floor(o_totalprice) AS DOUBLE) AS n,
              CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS x FROM orders""",
)
def clean_number_fr(t: Tables) -> DataFrame:
    whole = F.floor("o_totalprice")
    spaced = F.concat(
        F.floor(whole / 1000).cast("string"), F.lit(" "), F.lpad((whole % 1000).cast("string"), 3, "0")
    )
    comma = F.concat(F.replace(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(",")), F.lit(" %"))
    return t.orders.select(
        "o_orderkey",
        c.spaced_number(spaced).alias("n"),
        c.decimal_comma_number(F.when(F.col("o_orderstatus") == "P", "12,3,4").otherwise(comma)).alias("x"),
    )


@query("clean_first_token", "SELECT p_partkey, split_part(p_name, ' ', 1) AS jeton FROM part")
def clean_first_token(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", c.first_token("p_name").alias("jeton"))


@query(
    "clean_value_map",
    """SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 'Promotion' WHEN 'SMALL' THEN 'Petit' ELSE p_type END AS genre,
              CASE p_size WHEN 7 THEN 70 ELSE p_size END AS taille FROM part""",
)
def clean_value_map(t: Tables) -> DataFrame:
    return t.part.select(
        "p_partkey",
        c.remap("p_type", {"PROMO": "Promotion", "SMALL": "Petit"}).alias("genre"),
        c.replace_value("p_size", 7, 70).alias("taille"),
    )


@query(
    "coalesce_alternatives",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN o_orderpriority WHEN 'O' THEN '' || o_custkey
              ELSE 'Inconnu' END AS nom FROM orders""",
)
def coalesce_alternatives(t: Tables) -> DataFrame:
    status = F.col("o_orderstatus")
    first = F.when(status == "F", F.col("o_orderpriority")).otherwise("")
    second = c.head_of(F.when(status == "O", F.array(F.col("o_custkey").cast("string"))))
    return t.orders.select("o_orderkey", c.first_non_empty([first, second], "Inconnu").alias("nom"))


@query("filt_like", "SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%red%' AND p_brand NOT LIKE '%9'")
def filt_like(t: Tables) -> DataFrame:
    return t.part.where(like_ci("p_name", "Red") & ~F.col("p_brand").like("%9")).select("p_partkey", "p_name")


@query(
    "filt_prefix",
    """SELECT o_orderkey, o_orderpriority FROM orders
       WHERE strftime(o_orderdate, '%Y-%m-%d') LIKE '1998%' AND o_orderpriority LIKE '1%'""",
)
def filt_prefix(t: Tables) -> DataFrame:
    dated = F.date_format("o_orderdate", "yyyy-MM-dd").startswith("1998")
    return t.orders.where(dated & F.col("o_orderpriority").startswith("1")).select("o_orderkey", "o_orderpriority")


@query(
    "classify_keywords",
    """SELECT p_partkey,
              CASE WHEN p_name LIKE '%red%' OR p_name LIKE '%bolt%' THEN 'Action' ELSE 'État' END AS genre,
              CASE WHEN p_name LIKE '%red%' OR p_name LIKE '%bolt%' THEN 'Enquête territoire'
                   WHEN p_name LIKE '%small%' THEN 'Calcul dérivé' ELSE 'Donnée publique' END AS origine,
              CASE p_type WHEN 'PROMO' THEN 'Subsistance' WHEN 'SMALL' THEN 'Gestion de crise'
                   ELSE 'Soutenabilité' END AS objectif
       FROM part""",
)
def classify_keywords(t: Tables) -> DataFrame:
    words, derived = ("red", "bolt"), ("small",)
    return t.part.select(
        "p_partkey",
        indicator_kind("p_name", words).alias("genre"),
        source_kind("p_name", words, derived).alias("origine"),
        objective_of("p_type", {"PROMO": "Subsistance", "SMALL": "Gestion de crise"}).alias("objectif"),
    )


# --- shape -------------------------------------------------------------------


@query("proj_rename", "SELECT s_suppkey AS code, s_name AS nom, s_nationkey, s_acctbal FROM supplier")
def proj_rename(t: Tables) -> DataFrame:
    return rename_known(t.supplier, {"s_suppkey": "code", "s_name": "nom", "absent": "ignored"})


@query("proj_drop", "SELECT * EXCLUDE (c_acctbal, c_mktsegment) FROM customer")
def proj_drop(t: Tables) -> DataFrame:
    return drop_columns(all_but(t.customer, "c_acctbal"), "c_mktsegment", "absent")


@query("proj_positional", "SELECT o_custkey AS code, o_orderpriority AS type, 'i066' AS id_indicateur, 2025 AS annee FROM orders")
def proj_positional(t: Tables) -> DataFrame:
    return with_constants(pick_positions(t.orders, {1: "code", 5: "type"}), id_indicateur="i066", annee=2025)


@query(
    "unpivot_values",
    """SELECT l_orderkey, l_linenumber, 'quantite' AS mesure, l_quantity AS valeur FROM lineitem
       UNION ALL SELECT l_orderkey, l_linenumber, 'prix', l_extendedprice FROM lineitem
       UNION ALL SELECT l_orderkey, l_linenumber, 'remise', l_discount FROM lineitem WHERE l_discount <> 0""",
)
def unpivot(t: Tables) -> DataFrame:
    wide = t.lineitem.select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantite"), F.col("l_extendedprice").alias("prix"),
        F.nullif("l_discount", F.lit(0.0)).alias("remise"),
    )
    return unpivot_values(wide, ["l_orderkey", "l_linenumber"], ["quantite", "prix", "remise"], "mesure", "valeur")


@query(
    "unpivot_with_label",
    """SELECT '' || p_partkey AS id_epci, 'i007' AS id_indicateur, p_name AS libelle_epci, CAST(p_size AS DOUBLE) AS valeur_brute
       FROM part
       UNION ALL SELECT '' || p_partkey, 'i012', p_name, p_retailprice FROM part WHERE p_type <> 'PROMO'""",
)
def unpivot_with_label(t: Tables) -> DataFrame:
    """Headers as in a sheet: spaces, accents, and id-like names that are not indicators."""
    wide = t.part.select(
        F.concat(F.lit("00"), part_key(), F.lit(".0")).alias(" ID EPCI "),
        F.concat(F.lit(" "), "p_name").alias("Libellé EPCI"),
        F.col("p_brand").alias("Indice"),
        F.col("p_size").cast("string").alias("i 7"),
        F.when(F.col("p_type") != "PROMO", F.col("p_retailprice").cast("string")).alias("I012"),
    )
    return wide_sheet_to_long(wide, "valeur_brute")


@query(
    "schema_evolve",
    "SELECT p_partkey, CASE WHEN p_type <> 'PROMO' THEN p_size ELSE 0 END AS score_nature FROM part",
)
def schema_evolve(t: Tables) -> DataFrame:
    old = t.part.select(
        "p_partkey", F.when(F.col("p_type") != "PROMO", F.col("p_size")).alias("score_ecosystems"),
        F.lit(1).alias("score_waste"),
    )
    grown = with_constants(old, score_nature=0)
    return drop_columns(move_column_values(grown, "score_ecosystems", "score_nature"), "score_waste")
