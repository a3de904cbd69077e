"""Indicator jobs on stand-ins: customers are communes, nations are groupings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrascore.functions import geometry
from terrascore.operators.contract import RAW_VALUE_COLUMNS
from terrascore.plans import indicators as ind
from terrascore.plans.driver.registry import Tables, query
from terrascore.plans.territory import Territory, communes_outside, grouping_table, perimeter_profile, unit_profile
from terrascore.sources.files import link_entities
from terrascore.sources.records import explode_results

CONTRACT = [c for c in RAW_VALUE_COLUMNS if c != "meta"]


def custkey() -> Column:
    return F.col("c_custkey").cast("string")


def nation() -> Column:
    return F.col("c_nationkey").cast("string")


def communes(t: Tables) -> DataFrame:
    """Customers as communes; one segment belongs to no grouping."""
    return t.customer.select(
        custkey().alias("code_insee"),
        custkey().alias("code_postal"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "ZZZZZZZZZ").otherwise(nation()).alias("epci_code"),
        (F.col("c_acctbal") + 1000).alias("superficie_km2"),
    )


def spaced(number: Column) -> Column:
    """A whole number written with a space before the last three digits."""
    return F.concat(F.floor(number / 1000).cast("string"), F.lit(" "), F.lpad((number % 1000).cast("string"), 3, "0"))


def perimeter(t: Tables) -> DataFrame:
    """One row per customer; the population of a nation is its number of customers."""
    people = t.customer.groupBy("c_nationkey").agg(spaced(F.count(F.lit(1))).alias("total_pop_tot"))
    return t.customer.join(people, "c_nationkey").select(
        nation().alias("siren"), custkey().alias("insee"), "total_pop_tot", F.col("total_pop_tot").alias("total_pop_mun"),
        F.col("c_mktsegment").alias("dept"),
    )


def territory(t: Tables) -> Territory:
    return Territory(communes(t), perimeter(t))


COMMUNES_SQL = """SELECT CAST(c_custkey AS VARCHAR) AS code, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'ZZZZZZZZZ'
        ELSE CAST(c_nationkey AS VARCHAR) END AS epci, c_acctbal + 1000 AS km2 FROM customer"""
PEOPLE_SQL = "SELECT CAST(c_nationkey AS VARCHAR) AS siren, CAST(count(*) AS DOUBLE) AS pop FROM customer GROUP BY 1"


def contract_sql(indicator: str, year: int, unit: str | None, source: str | None, rows: str) -> str:
    """The value contract around a query that yields (id, v)."""

    def text(value):
        return "CAST(NULL AS VARCHAR)" if value is None else f"'{value}'"

    return f"""SELECT id AS id_epci, '{indicator}' AS id_indicateur, {year} AS annee, v AS valeur_brute,
        {text(unit)} AS unite, {text(source)} AS source FROM ({rows}) WHERE v IS NOT NULL"""


# --- passed through ----------------------------------------------------------


@query(
    "ind_passthrough",
    contract_sql(
        "i032", 2021, None, "Observatoire des territoires",
        "SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS v FROM orders",
    ),
)
def passthrough(t: Tables) -> DataFrame:
    text = F.when(F.col("o_orderstatus") == "P", "n.c.").otherwise(F.col("o_totalprice").cast("string"))
    sheet = t.orders.select(
        F.col("o_orderkey").cast("string").alias("Code"), F.lit("x").alias("Libellé"), text.alias(ind.OVERCROWDING_VALUE)
    )
    return ind.indicator_i032(sheet).select(*CONTRACT)


# --- per area ----------------------------------------------------------------


def line_start() -> tuple[Column, Column]:
    """Longitude and latitude given by the keys of an order."""
    return F.lit(-1.0) + (F.col("o_custkey") % 97) / 20, F.lit(43.0) + (F.col("o_orderkey") % 83) / 20


def line_end() -> tuple[Column, Column]:
    """Longitude given by the price, latitude by the key."""
    return F.lit(0.5) + F.col("o_totalprice") / 100000, F.lit(45.0) + (F.col("o_orderkey") % 59) / 20


POINTS_SQL = """SELECT *, -1.0 + (o_custkey % 97) / 20.0 AS lon1, 43.0 + (o_orderkey % 83) / 20.0 AS lat1,
        0.5 + o_totalprice / 100000 AS lon2, 45.0 + (o_orderkey % 59) / 20.0 AS lat2 FROM orders"""


def _projected(i: int) -> str:
    """x and y of one end of the line, as SQL."""
    e = repr(geometry.ECCENTRICITY)
    phi = f"radians(lat{i})"
    s = f"({e} * sin({phi}))"
    tangent = f"tan(pi() / 4 - {phi} / 2) / pow((1 - {s}) / (1 + {s}), {e} / 2)"
    radius = f"({geometry.SCALE!r} * pow({tangent}, {geometry.CONE!r}))"
    angle = f"({geometry.CONE!r} * radians(lon{i} - {geometry.LON_ORIGIN!r}))"
    return f"{radius} * sin({angle}) AS x{i}, -{radius} * cos({angle}) AS y{i}"


LENGTHS_SQL = f"""SELECT o_orderkey, o_custkey, o_orderpriority, sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) / 1000 AS km
    FROM (SELECT *, {_projected(1)}, {_projected(2)} FROM ({POINTS_SQL}))"""


def _double_bytes(value: Column) -> Column:
    """Big-endian hexadecimal form of a double."""
    return F.lpad(F.hex(F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value).cast("long")), 16, "0")


def _wkb_line(*coordinates: Column) -> Column:
    head = F.lit("0000000002" + f"{len(coordinates) // 2:08x}")
    return F.unhex(F.concat(head, *[_double_bytes(c.cast("double")) for c in coordinates]))


def cycleways(t: Tables) -> DataFrame:
    """Orders as cycleways with a WKB line; low priorities are points and do not count."""
    point = F.unhex(F.concat(F.lit("0000000001"), *[_double_bytes(c.cast("double")) for c in line_start()]))
    shape = F.when(F.col("o_orderpriority") == "5-LOW", point).otherwise(_wkb_line(*line_start(), *line_end()))
    return t.orders.select(
        F.col("o_orderkey").alias("id_osm"), F.col("o_custkey").cast("string").alias("code_com_d"),
        shape.alias("geometry"),
    )


@query("line_length", f"SELECT o_orderkey, round(km, 5) AS km FROM ({LENGTHS_SQL})")
def line_length(t: Tables) -> DataFrame:
    points = F.array(*[F.struct(lon.alias("lon"), lat.alias("lat")) for lon, lat in (line_start(), line_end())])
    return t.orders.select("o_orderkey", F.round(geometry.line_length_km(points), 5).alias("km"))


@query(
    "wkb_line_length",
    f"SELECT CAST(o_custkey AS VARCHAR) AS code_insee, round(sum(km), 4) AS km FROM ({LENGTHS_SQL}) WHERE o_orderpriority <> '5-LOW' GROUP BY 1",
)
def wkb_line_length(t: Tables) -> DataFrame:
    return ind.cycleway_lengths(cycleways(t)).groupBy("code_insee").agg(F.round(F.sum("km"), 4).alias("km"))


def zones(t: Tables) -> DataFrame:
    """Urban zones of the nations, numbers with a decimal comma."""

    def comma(number: Column) -> Column:
        return F.replace(number.cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(","))

    size = t.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return size.select(
        nation().alias("SIREN"), F.lit("x").alias("Nom de l'EPCI"), F.lit("CC").alias("Nature de l'EPCI"),
        comma(F.col("n") * 2.5).alias("Superficie de l'EPCI (km²)"),
        comma(F.col("n") * 1.25).alias("Superficie des territoires artificialisés* (km²)"),
        F.concat(comma(F.col("n") / 10), F.lit(" %")).alias("Part de la superficie artificialisée"),
    )


BUILT_SQL = """SELECT CAST(c_nationkey AS VARCHAR) AS siren, CAST(CAST(count(*) * 1.25 AS DECIMAL(18,2)) AS DOUBLE) AS built,
        CAST(CAST(count(*) / 10.0 AS DECIMAL(18,2)) AS DOUBLE) AS share FROM customer GROUP BY 1"""


@query(
    "ind_density_per_area",
    contract_sql(
        "i058", 2025, "km_amenagements/km2_urbanise", "i058.csv",
        f"""SELECT epci AS id, round(sum(l.km) / max(built), 2) AS v FROM ({COMMUNES_SQL}) c
            LEFT JOIN (SELECT CAST(o_custkey AS VARCHAR) AS k, sum(km) AS km FROM ({LENGTHS_SQL})
                       WHERE o_orderpriority <> '5-LOW' GROUP BY 1) l ON l.k = c.code
            LEFT JOIN ({BUILT_SQL}) b ON b.siren = epci WHERE epci <> 'ZZZZZZZZZ' GROUP BY 1""",
    ),
)
def density_per_area(t: Tables) -> DataFrame:
    return ind.indicator_i058(zones(t), cycleways(t), territory(t)).select(*CONTRACT)


@query(
    "ind_density_rollup",
    f"""SELECT epci AS siren, sum(n)::BIGINT AS total_amenagements, max(built) AS superficie_artificialisee,
               max(share) AS part_superficie_artificialisee, round(sum(n) / max(built), 2) AS amenagements_per_km2
        FROM ({COMMUNES_SQL}) c LEFT JOIN (SELECT CAST(o_custkey AS VARCHAR) AS k, count(*) AS n FROM orders GROUP BY 1) o ON k = code
        LEFT JOIN ({BUILT_SQL}) b ON b.siren = epci WHERE epci NOT LIKE '%Z' GROUP BY 1""",
)
def density_rollup(t: Tables) -> DataFrame:
    profile = perimeter(t).select("siren", F.lit(1.0).alias("superficie_km2")).distinct()
    report = ind.cycleway_count_report(zones(t), cycleways(t), communes(t), profile)
    return report.select(
        "siren", "total_amenagements", "superficie_artificialisee", "part_superficie_artificialisee",
        "amenagements_per_km2",
    )


def farmland(t: Tables) -> DataFrame:
    """One measure per nation and year; years are shifted so that some are 2020."""
    fine = t.orders.groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.sum("o_totalprice").alias("s"))
    return (
        fine.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey", "y")
        .agg(F.round(F.sum("s") / 1000, 1).alias("valeur"))
        .select(
            F.concat((F.col("y") + 20).cast("string"), F.lit("-01-01")).alias("date_mesure"),
            nation().alias("geocode_epci"), F.col("valeur").cast("string").alias("valeur"),
        )
    )


@query(
    "ind_share",
    contract_sql(
        "i113", 2025, "%", None,
        f"""SELECT epci AS id, round(v / 100 / km2 * 100, 1) AS v FROM
              (SELECT epci, sum(km2) AS km2 FROM ({COMMUNES_SQL}) WHERE epci <> 'ZZZZZZZZZ' GROUP BY 1)
            LEFT JOIN (SELECT CAST(c_nationkey AS VARCHAR) AS n, round(sum(o_totalprice) / 1000, 1) AS v
                       FROM orders JOIN customer ON o_custkey = c_custkey WHERE year(o_orderdate) = 2000 GROUP BY 1) ON n = epci""",
    ),
)
def share(t: Tables) -> DataFrame:
    return ind.indicator_i113(farmland(t), territory(t)).select(*CONTRACT)


@query(
    "ind_density_two_level",
    contract_sql(
        "i158", 2025, "nb_cat_nat/km2", None,
        f"""SELECT epci AS id, round(sum(n) / sum(km2), 3) AS v FROM ({COMMUNES_SQL}) c
            LEFT JOIN (SELECT CAST(user_id AS VARCHAR) AS k, count(*) AS n FROM events GROUP BY 1) ON k = code
            WHERE epci <> 'ZZZZZZZZZ' GROUP BY 1 HAVING sum(n) IS NOT NULL""",
    ),
)
def density_two_level(t: Tables) -> DataFrame:
    orders = t.events.select(F.col("user_id").cast("string").alias("cod_commune"))
    return ind.indicator_i158(orders, territory(t)).select(*CONTRACT)


@query(
    "ind_density_keyed",
    """WITH s AS (SELECT CASE c_nationkey WHEN 0 THEN '200054781' ELSE CAST(c_nationkey AS VARCHAR) END AS siren,
                         c_mktsegment, c_acctbal, c_custkey FROM customer),
            p AS (SELECT siren, count(*) AS pop, sum(c_acctbal + 1000) AS km2 FROM s GROUP BY 1),
            n AS (SELECT siren, CAST(count(*) AS DOUBLE) AS n FROM orders JOIN s ON o_custkey = c_custkey GROUP BY 1)
       SELECT p.siren, 'd' AS dept, CAST(pop AS DOUBLE) AS total_pop_tot, n AS nb_cat_nat, round(n / km2, 3) AS cat_nat_per_km2
       FROM p LEFT JOIN n ON p.siren = n.siren""",
)
def density_keyed(t: Tables) -> DataFrame:
    """One grouping has the wrong code in the counts and is corrected."""
    fixed = F.when(F.col("c_nationkey") == 0, ind.RIGHT_SIREN).otherwise(nation())
    wrong = F.when(F.col("c_nationkey") == 0, ind.WRONG_SIREN).otherwise(nation())
    units = t.customer.select(
        custkey().alias("code_insee"), fixed.alias("epci_code"), (F.col("c_acctbal") + 1000).alias("superficie_km2")
    )
    people = t.customer.groupBy("c_nationkey").agg(spaced(F.count(F.lit(1))).alias("total_pop_tot"))
    members = people.select(fixed.alias("siren"), F.lit("d").alias("dept"), "total_pop_tot", F.lit(1).alias("nb_membres"))
    fine = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    counts = (
        fine.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(wrong.alias("Code"))
        .agg(F.sum("n").cast("string").alias(ind.DISASTER_COUNT))
    )
    report = ind.disasters_report(counts, Territory(units, members))
    return report.select("siren", "dept", "total_pop_tot", "nb_cat_nat", "cat_nat_per_km2")


# --- per inhabitant ----------------------------------------------------------


@query(
    "ind_rate_per_pop",
    contract_sql(
        "i066", 2025, "nb_pharmacies/10000hab", None,
        f"""SELECT epci AS id, round(sum(n) / max(pop) * 10000, 2) AS v FROM ({COMMUNES_SQL})
            JOIN (SELECT CAST(o_custkey AS VARCHAR) AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON k = code
            JOIN ({PEOPLE_SQL}) ON siren = epci GROUP BY 1""",
    ),
)
def rate_per_pop(t: Tables) -> DataFrame:
    """Columns 15 and 19 of a wide file: postal code and city, kind of establishment."""
    kind = F.when(F.col("o_orderstatus") == "F", "Pharmacie").otherwise("Laboratoire")
    address = F.concat_ws(" ", "o_custkey", F.lit("VILLE"), "o_orderpriority")
    wide = [F.lit("").alias(f"c{i}") for i in range(20)]
    wide[15], wide[19] = address.alias("c15"), kind.alias("c19")
    return ind.indicator_i066(t.orders.select(*wide), territory(t)).select(*CONTRACT)


PADDED = "CASE WHEN length({0}) < 5 THEN lpad({0}, 5, '0') ELSE {0} END"
KEY_SQL = PADDED.format("CAST(c_custkey AS VARCHAR)")


def _padded(column: str) -> Column:
    text = F.col(column).cast("string")
    return F.lpad(text, F.greatest(F.lit(5), F.length(text)), F.lit("0"))


def associations(t: Tables) -> DataFrame:
    """Orders as associations: damaged postal codes, placeholders, inactive rows."""
    code = F.col("o_custkey").cast("string")
    postal = (
        F.when(F.col("o_orderpriority") == "5-LOW", "0.0")
        .when(F.col("o_orderpriority") == "1-URGENT", F.lit(None).cast("string"))
        .otherwise(F.concat(code, F.lit(".0")))
    )
    insee = F.when(F.col("o_orderpriority") == "2-HIGH", "INSEE").otherwise(F.concat(code, F.lit(".0")))
    return t.orders.select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.when(F.col("o_orderstatus") == "O", "D").otherwise("A").alias("position"),
        insee.alias("adrs_codeinsee"), postal.alias("adrs_codepostal"),
    )


def padded_territory(t: Tables) -> Territory:
    """Only customers with a positive balance are in the commune catalogue."""
    people = t.customer.groupBy("c_nationkey").agg(spaced(F.count(F.lit(1))).alias("total_pop_tot"))
    members = t.customer.join(people, "c_nationkey").select(
        F.lit("d").alias("dept"), nation().alias("siren"), _padded("c_custkey").alias("insee"), "total_pop_tot",
        F.col("total_pop_tot").alias("total_pop_mun"),
    )
    known = t.customer.where(F.col("c_acctbal") > 0).select(
        _padded("c_custkey").alias("code_insee"), _padded("c_custkey").alias("code_postal")
    )
    return Territory(known, members)


# a code of 0 is a placeholder; without a postal code the commune must be in the catalogue
ASSOCIATIONS_SQL = """SELECT c_nationkey, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey
    WHERE o_orderstatus <> 'O' AND o_orderpriority <> '2-HIGH' AND o_custkey <> 0
      AND (o_orderpriority NOT IN ('5-LOW', '1-URGENT') OR c_acctbal > 0)"""


@query(
    "ind_distinct_rate",
    contract_sql(
        "i131", 2025, "nb_asso/1000_habitants", None,
        f"""SELECT siren AS id, round(coalesce(n, 0) / pop * 1000, 2) AS v FROM ({PEOPLE_SQL})
            LEFT JOIN (SELECT CAST(c_nationkey AS VARCHAR) AS k, count(DISTINCT o_orderkey) AS n FROM ({ASSOCIATIONS_SQL}) GROUP BY 1)
            ON k = siren""",
    ),
)
def distinct_rate(t: Tables) -> DataFrame:
    return ind.indicator_i131(associations(t), padded_territory(t)).select(*CONTRACT)


@query(
    "ind_rate_counted",
    f"""SELECT 'd' AS dept, siren, pop AS population, CAST(n AS BIGINT) AS nb_asso, round(n / pop * 1000, 2) AS asso_per_1000_habitants
        FROM ({PEOPLE_SQL}) JOIN (SELECT CAST(c_nationkey AS VARCHAR) AS k, count(*) AS n FROM ({ASSOCIATIONS_SQL}) GROUP BY 1)
        ON k = siren""",
)
def rate_counted(t: Tables) -> DataFrame:
    return ind.associations_report(associations(t), padded_territory(t))


def carpool_places(t: Tables) -> DataFrame:
    kind = F.when(F.col("c_mktsegment") == "BUILDING", ind.CARPOOL_AREA).otherwise("Parking")
    return t.customer.select(
        nation().alias("territoryid"), kind.alias("type_lieu"), F.floor("c_acctbal").cast("string").alias("valeur")
    )


AREAS_SQL = "SELECT CAST(c_nationkey AS VARCHAR) AS k, sum(floor(c_acctbal)) AS n FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1"


@query(
    "ind_rate_filtered",
    contract_sql(
        "i149", 2025, "nb_lieux/10000_habitants", "i149.csv",
        f"SELECT siren AS id, round(n / pop * 10000, 3) AS v FROM ({PEOPLE_SQL}) LEFT JOIN ({AREAS_SQL}) ON k = siren",
    ),
)
def rate_filtered(t: Tables) -> DataFrame:
    return ind.indicator_i149(carpool_places(t), territory(t)).select(*CONTRACT)


TRIPS_SQL = """SELECT CAST(o_custkey AS VARCHAR) AS siren, CAST(max(o_orderkey) AS DOUBLE) AS pop FROM orders GROUP BY 1"""


@query(
    "ind_rate_plain",
    contract_sql(
        "i150", 2024, "nb_trajets/10000_habitants", "i150.csv",
        f"""SELECT siren AS id, round(c_acctbal / nullif(pop, 0) * 10000, 3) AS v FROM ({TRIPS_SQL})
            LEFT JOIN customer ON CAST(c_custkey AS VARCHAR) = siren AND c_mktsegment <> 'BUILDING'""",
    ),
)
def rate_plain(t: Tables) -> DataFrame:
    """Each customer is a grouping of its own; those without trips give no value."""
    members = t.orders.select(
        F.col("o_custkey").cast("string").alias("siren"), F.col("o_orderkey").cast("string").alias("total_pop_tot")
    )
    trips = t.customer.select(
        custkey().alias("territoryid"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal").cast("string")).otherwise("n/a").alias("valeur"),
    )
    return ind.indicator_i150(trips, Territory(communes(t), members)).select(*CONTRACT)


@query(
    "ind_two_rates",
    f"""SELECT p.siren, pop AS population, a.n AS nb_aires_covoiturage, round(a.n / pop * 10000, 3) AS aires_covoit_pour_10k_hab,
               b.n AS nb_trajets_covoiturage_2024, round(b.n / pop * 10000, 3) AS nb_covoit_per_10k_hab
        FROM ({PEOPLE_SQL}) p LEFT JOIN ({AREAS_SQL}) a ON a.k = p.siren
        LEFT JOIN (SELECT CAST(s_nationkey AS VARCHAR) AS k, round(sum(s_acctbal), 2) AS n FROM supplier GROUP BY 1) b ON b.k = p.siren""",
)
def two_rates(t: Tables) -> DataFrame:
    trips = t.supplier.groupBy(F.col("s_nationkey").cast("string").alias("territoryid")).agg(
        F.round(F.sum("s_acctbal"), 2).cast("string").alias("valeur")
    )
    return ind.carpool_report(carpool_places(t), trips, territory(t))


@query(
    "ind_rollup_rate",
    f"""SELECT epci AS siren, CAST(sum(n) AS BIGINT) AS total_mediation_epci, round(10000 * sum(n) / max(pop), 2) AS mediation_per_10k_habs
        FROM ({COMMUNES_SQL}) LEFT JOIN (SELECT CAST(user_id AS VARCHAR) AS k, count(event_id) AS n FROM events GROUP BY 1) ON k = code
        LEFT JOIN ({PEOPLE_SQL}) ON siren = epci WHERE epci NOT LIKE '%ZZZZ' GROUP BY 1""",
)
def rollup_rate(t: Tables) -> DataFrame:
    places = t.events.select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("code_insee"))
    profile = t.customer.groupBy(nation().alias("siren")).agg(F.count(F.lit(1)).alias("population"))
    return ind.mediation_report(places, communes(t), profile)


# --- means over communes -----------------------------------------------------


def distances(t: Tables, header: str, value: str) -> DataFrame:
    """Orders as measures of their customer; some are not numbers."""
    text = F.when(F.col("o_orderstatus") == "P", "N/A").otherwise(F.col(value).cast("string"))
    return t.orders.select(F.col("o_custkey").cast("string").alias("Code"), F.lit("x").alias("Libellé"), text.alias(header))


MEAN_SQL = """SELECT epci AS id, round(avg({0}), 2) AS v FROM ({1}) c
    LEFT JOIN (SELECT CAST(o_custkey AS VARCHAR) AS k, * FROM orders WHERE o_orderstatus <> 'P') ON k = code
    WHERE epci <> 'ZZZZZZZZZ' GROUP BY 1"""


@query(
    "ind_mean_over_units",
    contract_sql("i147", 2024, "km", "i147.csv", MEAN_SQL.format("o_totalprice", COMMUNES_SQL)),
)
def mean_over_units(t: Tables) -> DataFrame:
    return ind.indicator_i147(distances(t, ind.PHARMACY_DISTANCE, "o_totalprice"), territory(t)).select(*CONTRACT)


@query(
    "ind_mean_over_units_all",
    contract_sql("i148", 2024, "km", "i148.csv", MEAN_SQL.format("o_orderkey", COMMUNES_SQL)),
)
def mean_over_units_all(t: Tables) -> DataFrame:
    return ind.indicator_i148(distances(t, ind.EMERGENCY_DISTANCE, "o_orderkey"), territory(t)).select(*CONTRACT)


@query(
    "ind_two_means",
    f"""SELECT a.id AS siren, a.v AS dist_urgence_moyenne, b.v AS dist_pharma_moyenne
        FROM ({MEAN_SQL.format('o_orderkey', COMMUNES_SQL)}) a LEFT JOIN ({MEAN_SQL.format('o_totalprice', COMMUNES_SQL)}) b ON a.id = b.id""",
)
def two_means(t: Tables) -> DataFrame:
    return ind.distance_report(
        distances(t, ind.EMERGENCY_DISTANCE, "o_orderkey"), distances(t, ind.PHARMACY_DISTANCE, "o_totalprice"), communes(t)
    )


# --- entities in text --------------------------------------------------------

@query(
    "ind_text_entities",
    contract_sql(
        "i096", 2024, "nb_medias", None,
        f"""SELECT CAST(n_regionkey AS VARCHAR) AS id, count(DISTINCT c_custkey) AS v
            FROM customer JOIN nation ON n_nationkey = CASE c_nationkey WHEN 3 THEN 2 ELSE c_nationkey END
            WHERE c_acctbal >= 0 GROUP BY 1""",
    ),
)
def text_entities(t: Tables) -> DataFrame:
    """Two customers per line of text; some cities are misspelt, ambiguous or excluded."""
    key = F.col("c_nationkey")
    city = (
        F.when(key == 1, "Valence").when(key.isin(2, 3), "Moulins").when(key == 4, "Bourg Les Valence")
        .otherwise(F.concat(F.lit("NATION_"), key.cast("string")))
    )
    link = F.concat(F.lit('<a href="#">'), "c_name", F.lit(" ("), city, F.lit(")</a>"))
    lines = t.customer.select(F.concat(F.lit("<p>"), link, F.lit(" and "), link, F.lit("</p>")).alias("value"))
    key_of = F.col("n_nationkey")
    name = (
        F.when(key_of == 1, "Valence").when(key_of.isin(2, 3), "Moulins").when(key_of == 4, "Bourg-lès-Valence")
        .otherwise(F.col("n_name"))
    )
    department = F.when(key_of == 1, "26").when(key_of == 2, "03").otherwise("99")
    places = t.nation.select(
        key_of.cast("string").alias("code_insee"), name.alias("nom_standard"), department.alias("dep_code"),
        F.col("n_regionkey").cast("string").alias("epci_code"), F.lit("x").alias("epci_nom"),
    )
    dependent = t.customer.where(F.col("c_acctbal") < 0).select(F.col("c_name").alias("Nom"))
    # both nations named Moulins match the name; only the one in department 03 passes
    media = link_entities(lines, "value")
    rows = ind.indicator_i096(media, dependent, Territory(places, perimeter(t)))
    return rows.select(*CONTRACT)


# --- profiles and other reports ----------------------------------------------


def _profiled(t: Tables) -> DataFrame:
    """Communes whose grouping code starts with 2, except one segment."""
    code = F.when(F.col("c_mktsegment") == "MACHINERY", F.concat(F.lit("9"), nation())).otherwise(F.concat(F.lit("2"), nation()))
    return t.customer.select(
        custkey().alias("code_insee"), code.alias("epci_code"), F.concat(F.lit("n"), nation()).alias("epci_nom"),
        F.col("c_mktsegment").alias("dep_code"), F.substring("c_mktsegment", 1, 1).alias("reg_code"),
        F.floor(F.col("c_acctbal") + 1000).alias("population"), (F.col("c_acctbal") + 1000).alias("superficie_hectare"),
        ((F.col("c_acctbal") + 1000) / 100).alias("superficie_km2"),
    )


PROFILE_SQL = """SELECT '2' || c_nationkey AS siren, 'n' || c_nationkey AS epci_nom, count(*) AS n_communes,
        count(DISTINCT c_mktsegment) AS n_departements, count(DISTINCT substr(c_mktsegment, 1, 1)) AS n_regions,
        CAST(sum(floor(c_acctbal + 1000)) AS BIGINT) AS population, round(sum(c_acctbal + 1000), 2) AS superficie_hectare,
        round(sum((c_acctbal + 1000) / 100), 4) AS superficie_km2,
        round(sum(floor(c_acctbal + 1000)) / sum((c_acctbal + 1000) / 100), 2) AS densite_hab_km2
    FROM customer WHERE c_mktsegment <> 'MACHINERY' GROUP BY c_nationkey"""


@query("unit_profile", PROFILE_SQL)
def profile(t: Tables) -> DataFrame:
    rows = unit_profile(_profiled(t))
    return rows.withColumns(
        {"superficie_hectare": F.round("superficie_hectare", 2), "superficie_km2": F.round("superficie_km2", 4)}
    )


@query("unit_outside", "SELECT CAST(c_custkey AS VARCHAR) AS code_insee FROM customer WHERE c_mktsegment = 'MACHINERY'")
def outside(t: Tables) -> DataFrame:
    return communes_outside(_profiled(t)).select("code_insee")


@query(
    "unit_table",
    f"""WITH p AS ({PROFILE_SQL})
        SELECT '2' || n_nationkey AS siren, n_name AS epci_nom, 'd' AS dept, n_departements AS nb_departements,
               n_regions AS nb_regions, superficie_km2
        FROM nation LEFT JOIN p ON siren = '2' || n_nationkey""",
)
def unit_table(t: Tables) -> DataFrame:
    """The spreadsheet of groupings completed with the profile of the perimeter."""
    siren = F.concat(F.lit("2"), F.col("n_nationkey").cast("string"))
    spreadsheet = t.nation.select(
        siren.alias("N° SIREN"), F.col("n_name").alias("Nom du groupement"), F.lit("?").alias("Département"),
        F.lit("?").alias("Superficie"), F.lit("?").alias("Nom membre"),
    )
    members = t.customer.select(
        F.concat(F.lit("2"), nation()).alias("siren"), F.lit("d").alias("dept"),
        F.lit("1").alias("total_pop_tot"), F.lit("1").alias("total_pop_mun"),
    )
    table = grouping_table(spreadsheet, perimeter_profile(members, unit_profile(_profiled(t))))
    return table.select(
        "siren", "epci_nom", "dept", "nb_departements", "nb_regions", F.round("superficie_km2", 4).alias("superficie_km2")
    )


@query(
    "ind_year_unit_sum",
    """SELECT CAST(year(o_orderdate) AS INTEGER) AS annee, c_mktsegment AS dept, CAST(c_nationkey AS VARCHAR) AS siren,
              round(sum(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END), 2) AS total_quantite_substance
       FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3""",
)
def year_unit_sum(t: Tables) -> DataFrame:
    quantity = F.when(F.col("o_orderstatus") == "P", "secret").otherwise(F.col("o_totalprice").cast("string"))
    sales = t.orders.select(
        F.year("o_orderdate").alias("annee"), F.col("o_custkey").cast("string").alias("code_insee"),
        quantity.alias("quantite_substance"),
    )
    totals = ind.substances_by_year(sales, perimeter(t))
    return totals.withColumn("total_quantite_substance", F.round("total_quantite_substance", 2))


@query(
    "ind_farmland",
    """WITH f AS (SELECT c_mktsegment AS dept, CAST(c_nationkey AS VARCHAR) AS siren, round(sum(c_acctbal), 2) AS total_sau2020
                  FROM customer WHERE c_acctbal > 0 GROUP BY 1, 2)
       SELECT dept, f.siren, pop AS pop_tot, total AS total_relatif, total_sau2020
       FROM f JOIN (SELECT CAST(c_nationkey AS VARCHAR) AS siren, CAST(count(*) AS DOUBLE) AS pop, max(c_acctbal) AS total
                    FROM customer GROUP BY 1) r ON r.siren = f.siren""",
)
def farmland_report(t: Tables) -> DataFrame:
    areas = t.customer.where(F.col("c_acctbal") > 0).select(
        custkey().alias("codgeo"), F.col("c_acctbal").cast("string").alias("sau2020")
    )
    relative = t.customer.groupBy(nation().alias("siren")).agg(
        spaced(F.count(F.lit(1))).alias("pop_tot"), F.max("c_acctbal").alias("total_relatif")
    )
    report = ind.substances_report(relative, ind.farmland_by_group(areas, perimeter(t)))
    return report.withColumn("total_sau2020", F.round("total_sau2020", 2))


@query(
    "ind_paged_passthrough",
    contract_sql(
        "i130", 2023, ind.YEAR_AND_UNIT["i130"][1], None,
        "SELECT CAST(c_custkey AS VARCHAR) AS id, c_acctbal AS v FROM customer WHERE c_mktsegment <> 'BUILDING'",
    ),
)
def paged_passthrough(t: Tables) -> DataFrame:
    """Result pages landed as JSON; a grouping given twice takes the last line, records without a value are left out."""
    path = t.scratch("pages")
    record = F.struct(
        custkey().alias("numepci"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal")).alias("txcouv_epci"))
    earlier = F.struct(custkey().alias("numepci"), F.lit(-1.0).alias("txcouv_epci"))
    pair = F.array(earlier, record)
    pages = t.customer.where(F.col("c_mktsegment") != "BUILDING").select(pair.alias("results")).union(
        t.customer.where(F.col("c_mktsegment") == "BUILDING").select(F.array(record)))
    pages.write.json(path)
    schema = "results array<struct<numepci: string, txcouv_epci: double>>"
    records = explode_results(t.spark.read.schema(schema).json(path))
    ordered = records.withColumn(ind.LINE, F.struct(F.input_file_name(), F.monotonically_increasing_id()))
    return ind.indicator_i130(ordered).select(*CONTRACT)
