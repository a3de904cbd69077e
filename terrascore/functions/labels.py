"""Predicates and classifiers over labels and link text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrascore.functions.cleaning import ColumnOrName, _col, strip

# Words that mark an indicator about an action, words that mark a
# derived figure, and the objective that goes with each category.
ACTION_WORDS = (
    "Existence", "Identification", "Mise en œuvre", "Reconnaissance", "Plan",
    "Schéma", "Projet", "Stratégie", "Programme",
)
DERIVED_WORDS = ("ratio", "indice")
OBJECTIVE_BY_CATEGORY = {
    "Vitaux": "Subsistance",
    "Essentiels": "Gestion de crise",
    "Induits": "Soutenabilité",
}
DEFAULT_OBJECTIVE = "Soutenabilité"
ACTION, STATE = "Action", "État"
SURVEYED, DERIVED, PUBLISHED = "Enquête territoire", "Calcul dérivé", "Donnée publique"
UNKNOWN_CITY = "Inconnue"


def contains_any(value: ColumnOrName, words) -> Column:
    """Case-sensitive: does the text hold at least one of the words?"""
    found = F.lit(False)
    for word in words:
        found = found | _col(value).contains(word)
    return found


def like_ci(value: ColumnOrName, text: str) -> Column:
    """Case-insensitive "contains"; ``%`` and ``_`` in ``text`` stay wildcards, a backslash is itself."""
    pattern = text.lower().replace("\\", "\\\\")
    return F.lower(_col(value)).like(f"%{pattern}%")


def indicator_kind(label: ColumnOrName, action_words=ACTION_WORDS) -> Column:
    return F.when(contains_any(label, action_words), ACTION).otherwise(STATE)


def source_kind(label: ColumnOrName, action_words=ACTION_WORDS, derived_words=DERIVED_WORDS) -> Column:
    return (
        F.when(contains_any(label, action_words), SURVEYED)
        .when(contains_any(label, derived_words), DERIVED)
        .otherwise(PUBLISHED)
    )


def objective_of(category: ColumnOrName, by_category=None, default: str = DEFAULT_OBJECTIVE) -> Column:
    expr = F.lit(default)
    for name, objective in (by_category or OBJECTIVE_BY_CATEGORY).items():
        expr = F.when(_col(category) == name, objective).otherwise(expr)
    return expr


def link_texts(value: ColumnOrName, href: str = "#") -> Column:
    """All texts of ``<a href="…">text</a>`` links; ``href`` is a pattern."""
    return F.regexp_extract_all(_col(value), F.lit(f'<a href="{href}">(.*?)</a>'), F.lit(1))


_NAME_AND_CITY = r"^(.*)\s\(([^)]+)\)$"


def link_name(text: ColumnOrName) -> Column:
    """Name part of ``name (city)``; the whole text when there is no city."""
    split = strip(F.regexp_extract(_col(text), _NAME_AND_CITY, 1))
    return F.when(_col(text).rlike(_NAME_AND_CITY), split).otherwise(_col(text))


def link_city(text: ColumnOrName) -> Column:
    """City in the last parenthesis, else the "unknown" label."""
    split = strip(F.regexp_extract(_col(text), _NAME_AND_CITY, 2))
    return F.when(_col(text).rlike(_NAME_AND_CITY), split).otherwise(F.lit(UNKNOWN_CITY))
