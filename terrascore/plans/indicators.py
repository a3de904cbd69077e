"""The indicator jobs: cleaned sources in, rows of the value table out.

Each ``indicator_iNNN`` takes source frames as landed (text columns are fine) and
returns the raw-value contract. ``*_report`` functions return the wider tables
analysts export.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrascore.functions.cleaning import (
    clean_area_code, decimal_comma_number, first_token, remap, replace_value, spaced_number, to_float,
)
from terrascore.functions.geometry import is_line, wkb_length_km
from terrascore.operators.aggregates import (
    dedup_last, count_through_shared_code, mean_over_units, per, rate_per, rollup_two_level,
)
from terrascore.operators.contract import to_raw_values
from terrascore.operators.filters import city_rule_table, in_group_like, in_real_group, passes_city_rules
from terrascore.operators.joins import exclude_listed, fill_code, one_group_per_code
from terrascore.operators.shape import pick_positions, rename_known
from terrascore.plans.territory import Territory, populations, surfaces

# French headers of the landed files and the names used here.
OVERCROWDING_VALUE = "Part des logements sur-occupés hors studios d'une seule personne 2021"
PHARMACY_DISTANCE = "Distance à la pharmacie la plus proche 2024"
EMERGENCY_DISTANCE = "Distance à la structure la plus proche 2024"
DISASTER_COUNT = "Nombre d'Arrêtés de Catastrophes Naturelles publiés au J.O."
URBAN_ZONE_HEADERS = {
    "SIREN": "siren", "Nom de l'EPCI": "nom_epci", "Nature de l'EPCI": "nature_epci",
    "Superficie de l'EPCI (km²)": "superficie_epci",
    "Superficie des territoires artificialisés* (km²)": "superficie_artificialisee",
    "Part de la superficie artificialisée": "part_superficie_artificialisee",
}
CARPOOL_AREA = "Aire de covoiturage"
PHARMACY_PREFIX = "Phar"
HEALTH_POSITIONS = {15: "adresse", 19: "type"}
# Year and unit of each indicator.
YEAR_AND_UNIT = {
    "i032": (2021, None),
    "i058": (2025, "km_amenagements/km2_urbanise"),
    "i066": (2025, "nb_pharmacies/10000hab"),
    "i096": (2024, "nb_medias"),
    "i113": (2025, "%"),
    "i130": (2023, "nb pour 100 enfants de moins de 3 ans"),
    "i131": (2025, "nb_asso/1000_habitants"),
    "i147": (2024, "km"),
    "i148": (2024, "km"),
    "i149": (2025, "nb_lieux/10000_habitants"),
    "i150": (2024, "nb_trajets/10000_habitants"),
    "i158": (2025, "nb_cat_nat/km2"),
}
DISASTER_NOTE = "Calculé sur l'historique total GASPAR"
# Fixed value: the code used for one grouping in the disaster file, and the right one.
WRONG_SIREN, RIGHT_SIREN = "75056", "200054781"
# City spellings of the media list and the official commune names.
CITY_NAMES = {
    "Bourg Les Valence": "Bourg-lès-Valence",
    "Charleville-Mézieres": "Charleville-Mézières",
    "Cherbourg": "Cherbourg-en-Cotentin",
    "Cherbourg-En-Cotentin": "Cherbourg-en-Cotentin",
    "Château du Loir": "Montval-sur-Loir",
    "Cierp Gaud": "Cierp-Gaud",
    "Digne les Bains": "Digne-les-Bains",
    "Echouboulains": "Échouboulains",
    "Inconnue": "Château-Chinon (Ville)",
    "SAINT-AIGNAN DE GRAND LIEU": "Saint-Aignan-Grandlieu",
    "Saint-Quentin-en-Yvelines": "Montigny-le-Bretonneux",
    "Sanary": "Sanary-sur-Mer",
    "St Philbert de Grand-Lieu": "Saint-Philbert-de-Grand-Lieu",
    "Vaux-Sur-Mer": "Vaux-sur-Mer",
    "la Seyne": "La Seyne-sur-Mer",
}


def _publish(df: DataFrame, indicator_id: str, source: str | None, group: str = "siren", note: str | None = None) -> DataFrame:
    year, unit = YEAR_AND_UNIT[indicator_id]
    return to_raw_values(df, indicator_id, year, unit, source, group=group, note=note)


# --- values passed through -------------------------------------------------


# order of a published file's lines, where a job may find a grouping twice
LINE = "_ordre"


def last_line(rows: DataFrame, key: str, value: str) -> DataFrame:
    """One row per grouping, the last line of the file with a value; frames without line order stay as they are."""
    if LINE not in rows.columns:
        return rows
    return dedup_last(rows.where(F.col(value).isNotNull()), [key], LINE).drop(LINE)


def _line(rows: DataFrame) -> list[str]:
    return [LINE] if LINE in rows.columns else []


def indicator_i032(dwellings: DataFrame, source: str = "Observatoire des territoires") -> DataFrame:
    """Share of over-occupied dwellings, as published per grouping."""
    named = rename_known(dwellings, {"Code": "id_epci", OVERCROWDING_VALUE: "valeur_brute"})
    values = named.select("id_epci", to_float("valeur_brute").alias("valeur_brute"), *_line(named))
    return _publish(last_line(values, "id_epci", "valeur_brute"), "i032", source, "id_epci")


def indicator_i130(records: DataFrame, source: str | None = None) -> DataFrame:
    """Childcare coverage, from flattened result pages."""
    values = records.select(
        F.col("numepci").cast("string").alias("id_epci"), F.col("txcouv_epci").try_cast("double").alias("valeur_brute"),
        *_line(records),
    )
    return _publish(last_line(values, "id_epci", "valeur_brute"), "i130", source, "id_epci")


# --- densities and shares per area -----------------------------------------


def urban_zones(zones: DataFrame) -> DataFrame:
    """Urban zone file with numbers; a grouping listed twice keeps its largest figures."""
    named = rename_known(zones, URBAN_ZONE_HEADERS)
    return named.groupBy("siren").agg(
        F.max(decimal_comma_number("superficie_epci")).alias("superficie_epci"),
        F.max(decimal_comma_number("superficie_artificialisee")).alias("superficie_artificialisee"),
        F.max(decimal_comma_number("part_superficie_artificialisee")).alias("part_superficie_artificialisee"),
    )


def cycleway_lengths(cycleways: DataFrame) -> DataFrame:
    """(code_insee, km) of every line or multi-line; other geometries are left out."""
    # filter before the UDF, on the type word: other geometries never leave the JVM
    lines = cycleways.where(is_line("geometry"))
    return lines.select(F.col("code_com_d").alias("code_insee"), wkb_length_km("geometry").alias("km"))


def indicator_i058(zones: DataFrame, cycleways: DataFrame, territory: Territory, source: str = "i058.csv") -> DataFrame:
    """Kilometres of cycleway per km² of built-up area."""
    built = urban_zones(zones).select("siren", "superficie_artificialisee")
    lengths = rollup_two_level(
        cycleway_lengths(cycleways), in_real_group(territory.communes), "code_insee", "epci_code", {"km": F.sum("km")}
    ).withColumnRenamed("epci_code", "siren")
    values = rate_per(lengths, built, "siren", "km", "superficie_artificialisee", 1.0, 2)
    return _publish(values, "i058", source)


def indicator_i113(farmland: DataFrame, territory: Territory, source: str | None = None) -> DataFrame:
    """Share of the surface that is farmland, measured in 2020 (hectares)."""
    measured = farmland.where(F.col("date_mesure").cast("string").startswith("2020")).select(
        F.col("geocode_epci").cast("string").alias("siren"), to_float("valeur").alias("hectares"), *_line(farmland)
    )
    joined = surfaces(territory.communes).join(last_line(measured, "siren", "hectares"), "siren", "left")
    values = joined.select(
        "siren", per(F.col("hectares") / 100, F.col("superficie_km2"), 100, 1).alias("valeur_brute")
    )
    return _publish(values, "i113", source)


def indicator_i158(disasters: DataFrame, territory: Territory, source: str | None = None) -> DataFrame:
    """Natural disaster orders per km²; groupings without any are left out."""
    known = in_real_group(territory.communes.where(F.col("superficie_km2").isNotNull()))
    orders = disasters.select(F.col("cod_commune").alias("code_insee"))
    totals = rollup_two_level(
        orders, known, "code_insee", "epci_code", {"n": F.count(F.lit(1))}, weights=("superficie_km2",)
    )
    values = totals.where(F.col("n").isNotNull()).select(
        F.col("epci_code").alias("id_epci"), per(F.col("n"), F.col("superficie_km2"), digits=3).alias("valeur_brute")
    )
    return _publish(values, "i158", source, "id_epci", DISASTER_NOTE)


# --- rates per inhabitant ----------------------------------------------------


def indicator_i066(
    establishments: DataFrame, territory: Territory, one_group_per_postcode: bool = False, source: str | None = None
) -> DataFrame:
    """Pharmacies per 10 000 inhabitants, through the postal code.

    Communes share postal codes, so a pharmacy counts for each of them unless
    ``one_group_per_postcode`` is set. Groupings without a pharmacy are left out.
    """
    picked = pick_positions(establishments, HEALTH_POSITIONS)
    pharmacies = picked.where(F.col("type").startswith(PHARMACY_PREFIX)).select(
        first_token("adresse").alias("code_postal")
    )
    catalogue = in_real_group(territory.communes).select("code_postal", "epci_code")
    if one_group_per_postcode:
        catalogue = one_group_per_code(catalogue, "code_postal", "epci_code")
    counted = count_through_shared_code(pharmacies, catalogue, "code_postal", "epci_code", "n")
    counted = counted.withColumnRenamed("epci_code", "siren")
    values = rate_per(populations(territory.perimeter), counted, "siren", "n", "population", 10000, 2, how="inner")
    return _publish(values, "i066", source)


def clean_associations(associations: DataFrame, communes: DataFrame) -> DataFrame:
    """Active associations with repaired codes, one row each.

    A missing postal code is looked up by commune code; rows that still lack
    one of the two codes are left out.
    """
    active = associations.where(F.col("position") == "A")
    cleaned = active.withColumns(
        {c: clean_area_code(c) for c in ("adrs_codeinsee", "adrs_codepostal")}
    )
    filled = fill_code(cleaned, "adrs_codepostal", "adrs_codeinsee", communes, "code_insee", "code_postal")
    return filled.na.drop(subset=["adrs_codeinsee", "adrs_codepostal"])


def indicator_i131(associations: DataFrame, territory: Territory, source: str | None = None) -> DataFrame:
    """Active associations per 1 000 inhabitants; 0 where a grouping has none."""
    cleaned = clean_associations(associations, territory.communes)
    members = territory.perimeter.select("siren", "insee").distinct()
    # repeated ids need no distinct of their own: the count combines them per task,
    # then by (siren, id), so neither a hot commune nor a hot grouping is one task
    placed = cleaned.select("id", "adrs_codeinsee").join(members, F.col("adrs_codeinsee") == F.col("insee"))
    counted = placed.groupBy("siren").agg(F.count_distinct("id").alias("n"))
    rated = (
        populations(territory.perimeter)
        .join(counted, "siren", "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .withColumn("valeur_brute", per(F.col("n"), F.col("population"), 1000, 2))
    )
    return _publish(rated, "i131", source)


def associations_report(associations: DataFrame, territory: Territory) -> DataFrame:
    """Per department and grouping: associations and their rate per municipal inhabitant."""
    cleaned = clean_associations(associations, territory.communes)
    per_commune = cleaned.groupBy(F.col("adrs_codeinsee").alias("insee")).agg(F.count(F.lit(1)).alias("nb_asso"))
    members = territory.perimeter.select("dept", "siren", "insee", spaced_number("total_pop_mun").alias("population"))
    counted = (
        members.join(per_commune, "insee")
        .groupBy("dept", "siren", "population")
        .agg(F.sum("nb_asso").alias("nb_asso"))
        .na.drop()
    )
    return counted.withColumn("asso_per_1000_habitants", per(F.col("nb_asso"), F.col("population"), 1000, 2))


def indicator_i149(areas: DataFrame, territory: Territory, source: str = "i149.csv") -> DataFrame:
    """Car-pool areas per 10 000 inhabitants."""
    values = rate_per(populations(territory.perimeter), carpool_areas(areas), "siren", "n", "population", 10000, 3)
    return _publish(values, "i149", source)


def carpool_areas(areas: DataFrame) -> DataFrame:
    kept = areas.where(F.col("type_lieu") == CARPOOL_AREA)
    return kept.groupBy(F.col("territoryid").cast("string").alias("siren")).agg(F.sum(to_float("valeur")).alias("n"))


def indicator_i150(trips: DataFrame, territory: Territory, source: str = "i150.csv") -> DataFrame:
    """Car-pool trips per 10 000 inhabitants, from one published value per grouping."""
    values = rate_per(populations(territory.perimeter), carpool_trips(trips), "siren", "n", "population", 10000, 3)
    return _publish(values, "i150", source)


def carpool_trips(trips: DataFrame) -> DataFrame:
    named = trips.select(F.col("territoryid").cast("string").alias("siren"), to_float("valeur").alias("n"), *_line(trips))
    return last_line(named, "siren", "n")


def carpool_report(areas: DataFrame, trips: DataFrame, territory: Territory) -> DataFrame:
    """Both car-pool figures of every grouping side by side."""
    people = populations(territory.perimeter)
    rated_areas = rate_per(
        people, carpool_areas(areas), "siren", "n", "population", 10000, 3, "aires_covoit_pour_10k_hab"
    ).withColumnRenamed("n", "nb_aires_covoiturage")
    return rate_per(
        rated_areas, carpool_trips(trips), "siren", "n", "population", 10000, 3, "nb_covoit_per_10k_hab"
    ).withColumnRenamed("n", "nb_trajets_covoiturage_2024")


def mediation_report(places: DataFrame, communes: DataFrame, profile: DataFrame) -> DataFrame:
    """Digital help places per 10 000 inhabitants of each grouping."""
    grouped = in_group_like(communes, "epci_code", "%ZZZZ", negate=True)
    totals = rollup_two_level(
        places, grouped, "code_insee", "epci_code", {"total_mediation_epci": F.count("id")}
    ).withColumnRenamed("epci_code", "siren")
    rated = rate_per(
        totals, profile.select("siren", "population"), "siren", "total_mediation_epci", "population", 10000, 2,
        "mediation_per_10k_habs",
    )
    return rated.select("siren", "total_mediation_epci", "mediation_per_10k_habs")


# --- means over communes -----------------------------------------------------


def mean_distance(distances: DataFrame, communes: DataFrame, header: str, name: str, digits: int = 2) -> DataFrame:
    """Unweighted mean of the commune distances of each real grouping."""
    named = rename_known(distances, {"Code": "code_insee", header: "_text"})
    values = named.select("code_insee", to_float("_text").alias("km"))
    means = mean_over_units(values, in_real_group(communes), "code_insee", "epci_code", "km", name)
    return means.select(F.col("epci_code").alias("siren"), F.round(name, digits).alias(name))


def indicator_i147(distances: DataFrame, territory: Territory, source: str = "i147.csv") -> DataFrame:
    """Mean distance to the nearest pharmacy."""
    values = mean_distance(distances, territory.communes, PHARMACY_DISTANCE, "valeur_brute")
    return _publish(values, "i147", source)


def indicator_i148(distances: DataFrame, territory: Territory, source: str = "i148.csv") -> DataFrame:
    """Mean distance to emergency care, for the groupings of the perimeter."""
    means = mean_distance(distances, territory.communes, EMERGENCY_DISTANCE, "valeur_brute")
    listed = territory.perimeter.select("siren").where(F.col("siren").isNotNull()).distinct()
    return _publish(listed.join(means, "siren", "left"), "i148", source)


def distance_report(emergency: DataFrame, pharmacy: DataFrame, communes: DataFrame) -> DataFrame:
    """Both mean distances per grouping."""
    first = mean_distance(emergency, communes, EMERGENCY_DISTANCE, "dist_urgence_moyenne")
    second = mean_distance(pharmacy, communes, PHARMACY_DISTANCE, "dist_pharma_moyenne")
    return first.join(second, "siren", "left")


# --- counts of entities found in text ----------------------------------------


def independent_media(media: DataFrame, dependent: DataFrame, communes: DataFrame) -> DataFrame:
    """(epci_code, nom_media, …) of media that pass the city rules and are independent.

    ``media`` has (nom_media, ville), ``dependent`` the column Nom.
    """
    named = media.withColumn("ville", remap("ville", CITY_NAMES))
    places = communes.select("code_insee", "nom_standard", "dep_code", "epci_code", "epci_nom")
    placed = named.join(places, F.col("ville") == F.col("nom_standard")).drop("ville")
    kept = placed.where(
        passes_city_rules(F.col("nom_standard"), F.col("dep_code"), F.col("nom_media"), city_rule_table())
    )
    return exclude_listed(kept.distinct(), "nom_media", dependent, "Nom")


def indicator_i096(media: DataFrame, dependent: DataFrame, territory: Territory, source: str | None = None) -> DataFrame:
    """Independent local media per grouping."""
    kept = independent_media(media, dependent, territory.communes)
    values = kept.groupBy(F.col("epci_code").alias("id_epci")).agg(F.count("nom_media").alias("valeur_brute"))
    return _publish(values.where(F.col("id_epci").isNotNull()), "i096", source, "id_epci")


# --- analysts' tables --------------------------------------------------------


def disasters_report(counts: DataFrame, territory: Territory) -> DataFrame:
    """Published disaster counts per grouping and per km²."""
    named = rename_known(counts, {"Code": "siren", DISASTER_COUNT: "nb_cat_nat"})
    published = named.select(
        replace_value("siren", WRONG_SIREN, RIGHT_SIREN).alias("siren"), to_float("nb_cat_nat").alias("nb_cat_nat")
    )
    listed = (
        territory.perimeter.where(F.col("total_pop_tot").isNotNull())
        .select("siren", "dept", spaced_number("total_pop_tot").alias("total_pop_tot"), "nb_membres")
        .distinct()
    )
    joined = listed.join(surfaces(territory.communes), "siren", "left").join(published, "siren", "left")
    return joined.select(
        "siren", "dept", "total_pop_tot", "nb_cat_nat",
        per(F.col("nb_cat_nat"), F.col("superficie_km2"), digits=3).alias("cat_nat_per_km2"),
    )


def farmland_by_group(farmland: DataFrame, perimeter: DataFrame) -> DataFrame:
    """Farmland of 2020 per department and grouping, from commune figures."""
    joined = perimeter.join(farmland, F.col("insee") == F.col("codgeo"))
    return joined.groupBy("dept", "siren").agg(F.sum(to_float("sau2020")).alias("total_sau2020"))


def substances_by_year(sales: DataFrame, perimeter: DataFrame) -> DataFrame:
    """Quantity of substances per year, department and grouping.

    Sales are summed per year and commune first, so the join carries one row per
    commune and year instead of every sale.
    """
    fine = sales.groupBy("annee", F.col("code_insee").alias("insee")).agg(
        F.sum(to_float("quantite_substance")).alias("q")
    )
    return (
        perimeter.select("dept", "siren", "insee")
        .join(fine, "insee")
        .groupBy("annee", "dept", "siren")
        .agg(F.sum("q").alias("total_quantite_substance"))
    )


def substances_report(relative: DataFrame, farmland: DataFrame) -> DataFrame:
    """Relative substance totals next to population and farmland."""
    return relative.join(farmland.select("dept", "siren", "total_sau2020"), "siren").select(
        "dept", "siren", spaced_number("pop_tot").alias("pop_tot"), "total_relatif", "total_sau2020"
    )


def cycleway_count_report(zones: DataFrame, cycleways: DataFrame, communes: DataFrame, profile: DataFrame) -> DataFrame:
    """Number of cycleways per km² of built-up area."""
    grouped = in_group_like(communes, "epci_code", "%Z", negate=True)
    facts = cycleways.select("id_osm", F.col("code_com_d").alias("code_insee"))
    totals = rollup_two_level(
        facts, grouped, "code_insee", "epci_code", {"total_amenagements": F.count("id_osm")}
    ).withColumnRenamed("epci_code", "siren")
    built = urban_zones(zones).select("siren", "superficie_artificialisee", "part_superficie_artificialisee")
    areas = profile.select("siren", "superficie_km2").join(built, "siren", "left")
    return rate_per(
        totals, areas, "siren", "total_amenagements", "superficie_artificialisee", 1.0, 2, "amenagements_per_km2"
    )
