"""Predicates over codes, years, rules and catalogue facets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrascore.functions.labels import like_ci

# Fixed value: the code of "belongs to no grouping".
NO_GROUP = "ZZZZZZZZZ"


def in_real_group(df: DataFrame, column: str = "epci_code", sentinel: str = NO_GROUP) -> DataFrame:
    """Rows of a real grouping: neither the sentinel nor null."""
    return df.where(F.col(column) != sentinel)


def in_group_like(df: DataFrame, column: str, pattern: str, negate: bool = False) -> DataFrame:
    hit = F.col(column).cast("string").like(pattern)
    return df.where(~hit if negate else hit)


def indicators_of_year(df: DataFrame, indicator_ids: Sequence[str], year: int) -> DataFrame:
    return df.where(F.col("id_indicateur").isin(*indicator_ids) & (F.col("annee") == year))


def all_missing(columns: Sequence[str]) -> Column:
    """Is every one of the columns null?"""
    return reduce(and_, [F.col(c).isNull() for c in columns])


def any_missing(columns: Sequence[str]) -> Column:
    """Is one of the columns null?"""
    return reduce(or_, [F.col(c).isNull() for c in columns])


def with_all_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.where(all_missing(columns))


def with_any_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.where(any_missing(columns))


def without_missing(df: DataFrame, columns: Sequence[str], how: str = "any") -> DataFrame:
    return df.na.drop(how=how, subset=list(columns))


# Cities whose name exists in several departments, and the one meant.
CITY_DEPARTMENT = {
    "Bailleul": "59", "Castres": "81", "Chaumont": "52", "Clamecy": "58", "Falaise": "14", "Flers": "61",
    "Fontaine": "38", "La Rochelle": "17", "Langon": "33", "Marmagne": "71", "Montreuil": "93", "Moulins": "03",
    "Olivet": "45", "Prades": "66", "Rochefort": "17", "Saint-Claude": "39", "Saint-Nazaire": "44",
    "Saint-Omer": "62", "Saint-Raphaël": "83", "Ussel": "19", "Verdun": "55", "Vernon": "27",
}
# Fixed values: (city, department, names that must match, names that must not).
CITY_NAME_RULES = (
    ("Blanquefort", "33", ("R.I.G",), ()),
    ("Valence", "82", ("VFM", "La Dépêche du Midi"), ()),
    ("Valence", "26", (), ("VFM", "La Dépêche du Midi")),
)


def city_rule_table(departments=None, name_rules=CITY_NAME_RULES) -> list[tuple]:
    """Every rule in one shape; a city passes when any of its rules holds."""
    departments = CITY_DEPARTMENT if departments is None else departments
    plain = [(city, department, (), ()) for city, department in departments.items()]
    return plain + list(name_rules)


def passes_city_rules(city: Column, department: Column, name: Column, rules: Sequence[tuple]) -> Column:
    """True for cities without a rule and for rows that meet a rule of their city."""

    def holds(rule) -> Column:
        rule_city, rule_department, include, exclude = rule
        test = (city == rule_city) & (department == rule_department)
        if include:
            test = test & name.isin(*include)
        if exclude:
            # a missing name is "not one of them"
            test = test & ~F.coalesce(name.isin(*exclude), F.lit(False))
        return F.coalesce(test, F.lit(False))

    ruled = sorted({rule[0] for rule in rules})
    free = ~F.coalesce(city.isin(*ruled), F.lit(False))
    return reduce(or_, [holds(rule) for rule in rules], free)


def facet_filter(
    catalogue: DataFrame,
    search: str | None = None,
    need: str = "all",
    objective: str = "all",
    kind: str = "all",
    source: str = "all",
    columns: dict[str, str] | None = None,
) -> DataFrame:
    """Catalogue rows that meet every chosen facet; "all" leaves a facet open.

    ``columns`` names the catalogue columns: id, label, primary, secondary (an
    array of needs, or absent), objective, kind and source.
    """
    names = {
        "id": "id_indicateur", "label": "libelle", "primary": "besoin", "secondary": "besoins_secondaires",
        "objective": "objectif", "kind": "type", "source": "type_source", **(columns or {}),
    }
    tests: list[Column] = []
    if search:
        # plain containment here: wildcards have no meaning in this search box
        tests.append(
            F.lower(F.col(names["label"])).contains(search.lower())
            | F.lower(F.col(names["id"])).contains(search.lower())
        )
    if need != "all":
        member = F.col(names["primary"]) == need
        if names["secondary"] in catalogue.columns:
            member = member | F.coalesce(F.array_contains(names["secondary"], need), F.lit(False))
        tests.append(member)
    for facet, wanted in (("objective", objective), ("kind", kind), ("source", source)):
        if wanted != "all":
            tests.append(F.col(names[facet]) == wanted)
    return catalogue.where(reduce(and_, tests)) if tests else catalogue


def suggest(areas: DataFrame, text: str, code: str, name: str, limit: int = 8, min_length: int = 2) -> DataFrame:
    """First areas whose name or code contains the text; none for a too short text."""
    if len(text) < min_length:
        return areas.select(code, name).limit(0)
    hits = areas.where(like_ci(name, text) | like_ci(code, text))
    # sort + limit is a top-k: every task keeps ``limit`` rows, nothing is shuffled
    return hits.select(code, name).orderBy(F.col(name).asc_nulls_last(), F.col(code).asc_nulls_last()).limit(limit)


def find_one(areas: DataFrame, text: str, code: str, name: str) -> DataFrame:
    """The area with this code, else the first whose name contains the text."""
    exact = F.col(code) == text
    hits = areas.where(exact | like_ci(name, text))
    best_first = [F.coalesce(exact, F.lit(False)).desc(), F.col(name).asc_nulls_last(), F.col(code).asc_nulls_last()]
    return hits.orderBy(*best_first).limit(1)
