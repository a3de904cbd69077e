"""Readers, writers and keyed merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrascore.functions.geometry import first_pair, in_box
from terrascore.operators.contract import to_raw_values
from terrascore.operators.keyed import insert_new, merge_upsert, split_by_reference, with_placeholders
from terrascore.plans.driver.registry import Tables, query
from terrascore.sources.files import (
    link_entities, load_sheets, read_after_header_line, read_after_preamble, read_after_preamble_with_rejects,
    read_columnar, read_delimited, read_folder, read_tolerant,
)
from terrascore.sources.records import describe_features, explode_results, extract_records, read_features, read_pages, read_results
from terrascore.sources.tables import read_table, upsert_stored, write_delimited


@query("src_csv_roundtrip", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def csv_roundtrip(t: Tables) -> DataFrame:
    path = t.scratch("csv")
    write_delimited(t.part, path, sep=";")
    return read_delimited(t.spark, path, sep=";", schema=t.part.schema)


@query("src_tsv_infer", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders")
def tsv_inferred(t: Tables) -> DataFrame:
    path = t.scratch("tsv")
    write_delimited(t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"), path, sep="\t")
    df = read_delimited(t.spark, path, sep="\t", infer=True)
    return df.select(
        F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long"), "o_totalprice", "o_orderpriority"
    )


@query("src_preamble", "SELECT CAST(c_custkey AS VARCHAR) AS code, c_name AS nom, c_acctbal AS valeur FROM customer")
def preamble(t: Tables) -> DataFrame:
    path = t.scratch("preamble")
    head = t.spark.createDataFrame(
        [("Observatory of areas, 2024 edition",), ("",), ("Code,Name,Value",)], "value string"
    )
    rows = t.customer.select(F.concat_ws(",", "c_custkey", "c_name", "c_acctbal").alias("value"))
    head.coalesce(1).union(rows).write.text(path)
    df = read_after_preamble(t.spark, path, ["code", "nom", "valeur"], key_pattern="^[0-9]+$")
    return df.select("code", "nom", F.col("valeur").try_cast("double").alias("valeur"))


@query(
    "src_tolerant",
    "SELECT c_custkey AS id, c_acctbal AS valeur FROM customer WHERE c_mktsegment NOT IN ('MACHINERY', 'BUILDING')",
)
def tolerant(t: Tables) -> DataFrame:
    """Lines whose number is text, or that have too many fields, are skipped."""
    path = t.scratch("tolerant")
    line = (
        F.when(F.col("c_mktsegment") == "MACHINERY", F.concat_ws(";", "c_custkey", F.lit("n/a")))
        .when(F.col("c_mktsegment") == "BUILDING", F.concat_ws(";", "c_custkey", "c_acctbal", F.lit("x"), F.lit("y")))
        .otherwise(F.concat_ws(";", "c_custkey", "c_acctbal"))
    )
    t.customer.select(line.alias("value")).write.text(path)
    return read_tolerant(t.spark, path, "id long, valeur double", sep=";", header=False)


@query("src_latin1", "SELECT s_suppkey AS id, 'Évêché ' || s_name AS nom FROM supplier")
def latin1(t: Tables) -> DataFrame:
    path = t.scratch("latin1")
    rows = t.supplier.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("Évêché "), "s_name").alias("nom"))
    rows.write.options(encoding="ISO-8859-1", header=True, sep=";").csv(path)
    return read_delimited(t.spark, path, sep=";", schema="id long, nom string", encoding="ISO-8859-1")


@query(
    "src_glob_union",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'",
)
def glob_union(t: Tables) -> DataFrame:
    """Files with their columns in two orders, and a text cell with a line break."""
    base = t.scratch("folder")
    first = F.col("o_orderstatus") == "F"
    orders = t.orders.withColumn("note", F.concat(F.lit("one\ntwo; "), "o_orderstatus"))
    names = ["o_orderkey", "note", "o_orderpriority", "o_custkey"]
    write_delimited(orders.where(first).select(*names), f"{base}/rna_waldec_1", sep=";")
    write_delimited(orders.where(~first).select(*reversed(names)), f"{base}/rna_waldec_2", sep=";")
    write_delimited(orders.where(first), f"{base}/other_1", sep=";")
    df = read_folder(
        t.spark, f"{base}/rna_waldec_*", "part-*.csv", ["o_orderkey", "o_custkey"],
        where=F.col("o_orderpriority") == "1-URGENT", sep=";", multi_line=True,
    )
    return df.select(F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long"))


@query("src_parquet", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity >= 40")
def parquet_scan(t: Tables) -> DataFrame:
    df = read_columnar(t.spark, f"{t.folder}/lineitem.parquet", ["l_orderkey", "l_partkey", "l_quantity"])
    return df.where(F.col("l_quantity") >= 40)


@query(
    "src_sheets",
    """SELECT 'nation' AS feuille, CAST(n_nationkey AS VARCHAR) AS code, n_name AS nom FROM nation
       UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), s_name || chr(10) || 'b' FROM supplier""",
)
def sheets(t: Tables) -> DataFrame:
    """Two exported sheets are found, one of them with line breaks in its cells; a third one is missing and skipped."""
    base = t.scratch("sheets")
    write_delimited(t.nation.select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("nom")), f"{base}/nation.csv")
    write_delimited(t.supplier.select(F.col("s_suppkey").alias("code"), F.concat("s_name", F.lit("\nb")).alias("nom")), f"{base}/supplier.csv")
    found = load_sheets(t.spark, base, ["nation", "supplier", "absent"])
    nation, supplier = (
        df.select(F.lit(name).alias("feuille"), "code", "nom") for name, df in sorted(found.items())
    )
    return nation.unionByName(supplier)


@query(
    "json_flatten",
    """SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value AS valeur
       FROM events""",
)
def json_flatten(t: Tables) -> DataFrame:
    """Events landed as result pages of at most 100 records, then flattened."""
    path = t.scratch("pages")
    record = F.struct(
        "event_id",
        F.struct(F.col("user_id").alias("id")).alias("user"),
        F.from_json("props", "k long").alias("props"),
        "value",
    )
    pages = t.events.groupBy(F.floor(F.col("event_id") / 100).alias("page")).agg(F.collect_list(record).alias("results"))
    pages.select("results").write.json(path)
    schema = "results array<struct<event_id: bigint, user: struct<id: bigint>, props: struct<k: bigint>, value: double>>"
    flat = explode_results(read_pages(t.spark, path, schema, multi_line=False))
    return flat.select(
        "event_id", F.col("`user.id`").alias("user_id"), F.col("`props.k`").alias("k"), F.col("value").alias("valeur")
    )


@query(
    "json_results",
    """SELECT event_id, CASE WHEN event_type = 'click' THEN '' || user_id ELSE 'u' || user_id END AS code,
              CASE WHEN event_type = 'click' THEN user_id END AS user_id,
              CASE WHEN event_type <> 'error' THEN value END AS valeur
       FROM events""",
)
def json_results(t: Tables) -> DataFrame:
    """Pages whose records have several shapes: fields that only some have, numbers beside texts; no schema is given."""
    path = t.scratch("results")
    click = F.col("event_type") == "click"
    numbered = F.to_json(F.struct("event_id", F.col("user_id").alias("code"), F.struct(F.col("user_id").alias("id")).alias("user"), "value"))
    value = F.when(F.col("event_type") != "error", F.col("value")).alias("value")
    named = F.to_json(F.struct("event_id", F.concat(F.lit("u"), "user_id").alias("code"), value))
    records = t.events.select(F.floor(F.col("event_id") / 100).alias("page"), F.when(click, numbered).otherwise(named).alias("record"))
    pages = records.groupBy("page").agg(F.array_join(F.collect_list("record"), ",").alias("records"))
    pages.select(F.concat(F.lit('{"results":['), "records", F.lit("]}"))).write.text(path)
    flat = read_results(t.spark, path, multi_line=False)
    return flat.select("event_id", "code", F.col("`user.id`").alias("user_id"), F.col("value").alias("valeur"))


@query(
    "json_extract_default",
    """SELECT coalesce(CASE WHEN event_type = 'click' THEN CAST(user_id AS VARCHAR) END,
                       CASE WHEN event_type <> 'error' THEN 's' || user_id END) AS id_epci,
              'i130' AS id_indicateur, 2023 AS annee, value AS valeur_brute,
              CAST(NULL AS VARCHAR) AS unite,
              CASE WHEN event_type = 'signup' THEN 'form' ELSE 'api' END AS source
       FROM events WHERE event_type <> 'error' AND value >= 1""",
)
def json_extract_default(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    records = t.events.select(
        F.when(kind == "click", F.col("user_id").cast("string")).otherwise("").alias("id_epci"),
        F.when(kind != "error", F.concat(F.lit("s"), "user_id")).alias("siren"),
        F.when(F.col("value") >= 1, F.col("value")).alias("value"),
        F.when(kind == "signup", "form").alias("source"),
    )
    return extract_records(records, "i130", 2023, default_source="api").drop("meta")


LINK = "'^(.*)\\s\\(([^)]+)\\)$'"


@query(
    "link_extract",
    f"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="[^"]*">(.*?)</a>', 1)) AS x FROM pages)
        SELECT page_id,
               CASE WHEN regexp_matches(x, {LINK}) THEN trim(regexp_extract(x, {LINK}, 1)) ELSE x END AS nom_media,
               CASE WHEN regexp_matches(x, {LINK}) THEN trim(regexp_extract(x, {LINK}, 2)) ELSE 'Inconnue' END AS ville
        FROM l""",
)
def link_extract(t: Tables) -> DataFrame:
    return link_entities(t.pages, "html", href='[^"]*', keep=("page_id",))


FEATURES_SQL = """SELECT CAST(c_custkey AS VARCHAR) AS code,
               CASE WHEN c_mktsegment = 'BUILDING' THEN 'Inconnu' ELSE c_name END AS nom,
               CASE WHEN c_mktsegment = 'MACHINERY' THEN 'CC' ELSE 'EPCI' END AS nature"""


@query("src_geojson", f"{FEATURES_SQL} FROM customer")
def geojson(t: Tables) -> DataFrame:
    return describe_features(_features(t)).select("code", "nom", "nature")


@query(
    "filt_bbox",
    f"""{FEATURES_SQL}, c_acctbal / 100 AS lon FROM customer
        WHERE c_acctbal / 100 BETWEEN -6 AND 10 AND 40 + c_nationkey / 2.0 BETWEEN 41 AND 51.5""",
)
def bounding_box(t: Tables) -> DataFrame:
    """Mainland features: the first coordinate pair lies in the box."""
    placed = _features(t).withColumn("p", first_pair("coordinates"))
    inside = placed.where(in_box("p.lon", "p.lat"))
    return describe_features(inside).select("code", "nom", "nature", F.col("p.lon").alias("lon"))


def _features(t: Tables) -> DataFrame:
    """Customers as GeoJSON collections of at most 100 features."""
    path = t.scratch("geojson")
    segment = F.col("c_mktsegment")
    lon, lat = F.col("c_acctbal") / 100, F.col("c_nationkey") / 2 + 40
    pair = F.array(lon, lat)
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(
            F.array(F.col("c_custkey").cast("string")).alias("epci_code"),
            F.when(segment == "BUILDING", "").otherwise(F.col("c_name")).alias("nom"),
            F.when(segment == "MACHINERY", "CC").alias("nature"),
        ).alias("properties"),
        F.struct(
            F.lit("MultiPolygon").alias("type"), F.array(F.array(pair, F.array(lon + 1, lat), pair)).alias("coordinates")
        ).alias("geometry"),
    )
    pages = t.customer.groupBy(F.floor(F.col("c_custkey") / 100).alias("page")).agg(
        F.collect_list(feature).alias("features")
    )
    pages.select(F.lit("FeatureCollection").alias("type"), "features").write.json(path)
    return read_features(t.spark, path, multi_line=False)


@query("src_geojson_split", """SELECT 'c' || c_custkey AS code, c_name AS nom, c_mktsegment || '}' AS nature,
              CASE WHEN c_nationkey > 3 THEN 'Point' END AS forme FROM customer""")
def geojson_split(t: Tables) -> DataFrame:
    """Whole files of one collection each, one feature a line, read in as many tasks as the files have blocks."""
    path = t.scratch("geojson_split")
    point = F.when(F.col("c_nationkey") > 3, F.struct(F.lit("Point").alias("type"), F.array("c_acctbal", "c_acctbal").alias("coordinates")))
    kind = F.concat("c_mktsegment", F.lit("}"))  # a brace that closes nothing
    properties = F.struct(F.concat(F.lit("c"), "c_custkey").alias("code"), F.col("c_name").alias("nom"), kind.alias("nature"))
    feature = F.to_json(F.struct(point.alias("geometry"), properties.alias("properties"), F.lit("Feature").alias("type")), {"ignoreNullFields": "false"})
    dealt = t.customer.select(F.floor(F.col("c_custkey") / 5000).alias("file"), F.lit(1).alias("n"), F.concat(F.lit(","), feature).alias("value"))
    # the first element is no feature, so that every line of features can begin with a comma
    frame = F.inline(F.array(
        F.struct(F.lit(0).alias("n"), F.lit('{"type":"FeatureCollection","crs":{"properties":{"name":"x"}},"features":[{"type":"Note"}').alias("value")),
        F.struct(F.lit(2).alias("n"), F.lit("]}").alias("value")),
    ))
    lines = dealt.union(dealt.select("file").distinct().select("file", frame))
    lines.repartition("file").sortWithinPartitions("file", "n").select("value", "file").write.partitionBy("file").text(path)
    found = describe_features(read_features(t.spark, f"{path}/*"))
    return found.select("code", "nom", "nature", F.col("geometry_type").alias("forme"))


# --- keyed writes ------------------------------------------------------------


@query(
    "upsert_merge",
    """WITH u AS (SELECT o_custkey AS id, o_totalprice AS valeur,
                         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders),
            t AS (SELECT c_custkey AS id, c_name AS libelle, c_acctbal AS valeur FROM customer WHERE c_acctbal >= 1000)
       SELECT coalesce(t.id, u.id) AS id, t.libelle,
              CASE WHEN u.id IS NOT NULL THEN u.valeur ELSE t.valeur END AS valeur
       FROM t FULL JOIN (SELECT * FROM u WHERE rn = 1) u ON t.id = u.id""",
)
def upsert_merge(t: Tables) -> DataFrame:
    """The last order of a customer replaces the value and leaves the label."""
    target = t.customer.where(F.col("c_acctbal") >= 1000).select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("libelle"), F.col("c_acctbal").alias("valeur")
    )
    updates = t.orders.select(
        F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("valeur"), F.col("o_orderkey").alias("seq")
    )
    return merge_upsert(target, updates, ["id"], "seq")


@query(
    "upsert_table",
    """WITH o AS (SELECT '' || o_custkey AS id_epci, o_orderpriority AS id_indicateur, CAST(year(o_orderdate) AS INTEGER) AS annee,
                         o_totalprice, o_orderstatus, o_orderkey FROM orders),
            f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id_epci, id_indicateur, annee ORDER BY o_orderkey DESC) AS rn
                                 FROM o WHERE o_orderstatus = 'F') WHERE rn = 1),
            n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id_epci, id_indicateur, annee ORDER BY o_orderkey DESC) AS rn
                                 FROM o WHERE o_orderstatus <> 'F') WHERE rn = 1)
       SELECT coalesce(n.id_epci, f.id_epci) AS id_epci, coalesce(n.id_indicateur, f.id_indicateur) AS id_indicateur,
              coalesce(n.annee, f.annee) AS annee, coalesce(n.o_totalprice, f.o_totalprice) AS valeur_brute,
              CASE WHEN f.id_epci IS NOT NULL THEN 'euro' END AS unite,
              CASE WHEN n.id_epci IS NOT NULL THEN 'Zone ' || n.id_epci END AS libelle_epci, '{}' AS meta
       FROM f FULL JOIN n ON f.id_epci = n.id_epci AND f.id_indicateur = n.id_indicateur AND f.annee = n.annee""",
)
def upsert_stored_values(t: Tables) -> DataFrame:
    """Two batches with different columns into the value table; the second one wins where it has a column."""
    path = t.scratch("table")
    rows = t.orders.select(
        F.col("o_custkey").cast("string").alias("id_epci"), F.col("o_orderpriority").alias("id_indicateur"),
        F.year("o_orderdate").alias("annee"), F.col("o_totalprice").alias("valeur_brute"),
        F.col("o_orderkey").alias("seq"), "o_orderstatus",
    )
    first = F.col("o_orderstatus") == "F"
    label = F.concat(F.lit("Zone "), "id_epci")
    for batch in (rows.where(first).withColumn("unite", F.lit("euro")), rows.where(~first).withColumn("libelle_epci", label)):
        upsert_stored(path, batch.drop("o_orderstatus"), "valeur_indicateur", "seq")
    return read_table(t.spark, path, "valeur_indicateur").select(
        "id_epci", "id_indicateur", "annee", "valeur_brute", "unite", "libelle_epci", "meta")


@query(
    "insert_ignore",
    """WITH t AS (SELECT s_suppkey AS k, s_nationkey AS nation, s_name AS libelle FROM supplier),
            n AS (SELECT c_custkey AS k, c_nationkey AS nation, min(c_name) AS libelle FROM customer GROUP BY 1, 2)
       SELECT * FROM t
       UNION ALL
       SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.k = n.k AND t.nation = n.nation)""",
)
def insert_ignore(t: Tables) -> DataFrame:
    target = t.supplier.select(
        F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("nation"), F.col("s_name").alias("libelle")
    )
    rows = t.customer.select(
        F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nation"), F.col("c_name").alias("libelle")
    )
    return insert_new(target, rows, ["k", "nation"])


@query(
    "ensure_dim_rows",
    """WITH d AS (SELECT p_partkey AS id, p_name AS libelle FROM part WHERE p_size <= 25)
       SELECT * FROM d
       UNION ALL
       SELECT DISTINCT l_partkey, 'Indicateur ' || l_partkey FROM lineitem
       WHERE l_partkey NOT IN (SELECT id FROM d)""",
)
def ensure_dim_rows(t: Tables) -> DataFrame:
    dim = t.part.where(F.col("p_size") <= 25).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("libelle"))
    return with_placeholders(dim, t.lineitem, "l_partkey", "id", "libelle")


def _reference_split(t: Tables) -> tuple[DataFrame, DataFrame]:
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    parts = t.part.where(F.col("p_size") <= 25)
    suppliers = t.supplier.where(F.col("s_acctbal") > 0)
    return split_by_reference(lines, [("l_partkey", parts, "p_partkey"), ("l_suppkey", suppliers, "s_suppkey")])


REFERENCE_SQL = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE {0} (
    l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 25)
    AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0))"""


@query("fk_semi", REFERENCE_SQL.format(""))
def fk_accepted(t: Tables) -> DataFrame:
    return _reference_split(t)[0]


@query("fk_rejects", REFERENCE_SQL.format("NOT"))
def fk_rejected(t: Tables) -> DataFrame:
    return _reference_split(t)[1]


@query(
    "raw_value_contract",
    """SELECT CAST(o_custkey AS VARCHAR) AS id_epci, 'i042' AS id_indicateur, CAST(year(o_orderdate) AS INTEGER) AS annee,
              o_totalprice AS valeur_brute, 'eur' AS unite, 'orders' AS source,
              '{"note":"as ordered"}' AS meta
       FROM orders WHERE o_orderstatus <> 'P'""",
)
def raw_value_contract(t: Tables) -> DataFrame:
    valued = t.orders.withColumn("v", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")))
    return to_raw_values(
        valued, "i042", F.year("o_orderdate"), "eur", "orders", group="o_custkey", value="v", note="as ordered"
    )


FILES = 4


@query(
    "src_header_line",
    """SELECT '' || c_custkey AS code, c_name AS nom, '' || c_nationkey AS pays FROM customer""",
)
def header_line(t: Tables) -> DataFrame:
    """Files of two shapes: free text of their own, and their columns in another order."""
    base = t.scratch("header_line")
    first = F.col("c_nationkey") < 12
    shapes = {"a": ("Code;Nom;Pays", ("c_custkey", "c_name", "c_nationkey"), first), "b": ("Pays;Code;Nom", ("c_nationkey", "c_custkey", "c_name"), ~first)}
    for name, (header, columns, part) in shapes.items():
        # a few files of each shape, written side by side, each with its leading lines first
        dealt = t.customer.where(part).select(F.pmod("c_custkey", F.lit(FILES)).alias("file"), F.concat_ws(";", *columns).alias("value"), F.lit(3).alias("n"))
        head = t.spark.range(FILES).select(
            F.col("id").alias("file"), F.posexplode(F.array(F.lit(f"Edition {name}"), F.lit(""), F.lit(header))).alias("n", "value"))
        lines = head.select("file", "value", "n").union(dealt.select("file", "value", "n"))
        lines.repartition(FILES, "file").sortWithinPartitions("file", "n").select("value", "file").write.partitionBy("file").text(f"{base}/{name}")
    df = read_after_header_line(t.spark, f"{base}/*/*", 2, ";")
    return df.select(F.col("Code").alias("code"), F.col("Nom").alias("nom"), F.col("Pays").alias("pays"))


@query(
    "src_preamble_rejects",
    """SELECT CASE WHEN c_mktsegment = 'FURNITURE' OR c_custkey % 90000 = 0 AND c_mktsegment <> 'BUILDING'
                   THEN 'rejet' ELSE 'ligne' END AS sort,
              CASE WHEN c_mktsegment = 'FURNITURE' THEN 'x' || c_custkey
                   WHEN c_custkey % 90000 = 0 AND c_mktsegment = 'MACHINERY' THEN '0.0'
                   WHEN c_custkey % 90000 = 0 AND c_mktsegment <> 'BUILDING' THEN '0'
                   ELSE lpad('' || c_custkey % 90000, 5, '0') END AS code, c_name AS nom
       FROM customer""",
)
def preamble_rejects(t: Tables) -> DataFrame:
    """Codes with blanks, without leading zeros or with a trailing ``.0`` are repaired; the rest is rejected, not lost.

    A bare ``0`` or ``0.0`` stands for a missing code and is rejected; ``00000`` is a code.
    """
    path = t.scratch("rejects")
    head = t.spark.createDataFrame([("Edition",), ("Code,Nom",)], "value string")
    number = F.col("c_custkey") % 90000
    code = (
        F.when(F.col("c_mktsegment") == "FURNITURE", F.concat(F.lit("x"), "c_custkey"))
        .when(F.col("c_mktsegment") == "MACHINERY", F.concat(number.cast("string"), F.lit(".0")))
        .when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit(" "), F.lpad(number.cast("string"), 5, "0")))
        .otherwise(number.cast("string"))
    )
    head.coalesce(1).union(t.customer.select(F.concat_ws(",", code, "c_name"))).write.text(path)
    rows, rejects = read_after_preamble_with_rejects(t.spark, path, ["Code", "Nom"])
    return rows.select(F.lit("ligne").alias("sort"), F.col("Code").alias("code"), F.col("Nom").alias("nom")).union(
        rejects.select(F.lit("rejet"), "Code", "Nom"))
