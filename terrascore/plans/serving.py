"""Ranked, searched and paged lists of scores, drill-downs, and the views.

Tables: ``scores`` (id_epci, id_indicateur, annee, score columns, updated_at),
``areas`` (id_epci, libelle, departement_code, region_code), and the dimensions
of indicators, needs, objectives and types.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrascore.functions.labels import like_ci
from terrascore.operators.aggregates import distinct_labels
from terrascore.operators.joins import star_lookup

MAX_PAGE, DEFAULT_PAGE = 2000, 50
AREA_COLUMNS = ("libelle", "departement_code", "region_code")
# groups of a drill-down: their name, id, label and score
GROUPS = (
    ("needs", "id_besoin", "besoin_libelle", "score_besoin"),
    ("objectives", "id_objectif", "objectif_libelle", "score_objectif"),
    ("types", "id_type", "type_libelle", "score_type"),
)
DETAIL_COLUMNS = (
    "id_indicateur", "indicateur_libelle", "score_indicateur",
    *[name for _, key, label, score in GROUPS for name in (key, label, score)],
)


def latest_year(scores: DataFrame) -> DataFrame:
    """One row: the newest year, 0 when there are no scores."""
    return scores.agg(F.coalesce(F.max("annee"), F.lit(0)).alias("annee"))


def of_year(scores: DataFrame, year: int | None) -> DataFrame:
    """Scores of the given year, else of the newest one (a scalar subquery)."""
    if year is not None:
        return scores.where(F.col("annee") == year)
    return scores.where(F.col("annee") == latest_year(scores).scalar())


def score_summaries(
    scores: DataFrame, areas: DataFrame, year: int | None = None, search: str | None = None
) -> DataFrame:
    """Per area: mean global score, number of indicators, last update."""
    wanted = areas.select("id_epci", *AREA_COLUMNS)
    if search:
        wanted = wanted.where(like_ci("libelle", search) | like_ci("id_epci", search))
    dated = of_year(scores, year)
    if search:  # the areas that are not asked for are left out before anything is summed up
        dated = dated.join(wanted.select("id_epci"), "id_epci", "left_semi")
    per_area = dated.groupBy("id_epci").agg(
        F.avg(F.col("score_global").cast("double")).alias("score_global"),
        F.count("id_indicateur").alias("n_indicateurs"),
        F.max("updated_at").alias("updated_at"),
    )
    return per_area.join(wanted, "id_epci").select(
        "id_epci", *AREA_COLUMNS, "score_global", "n_indicateurs", "updated_at"
    )


def list_order(order_by: str) -> list[Column]:
    """Sort keys of a list, always ended by the id so that pages do not overlap."""
    first = {
        "name": F.col("libelle").asc_nulls_last(),
        "score": F.col("score_global").desc_nulls_last(),
        "code": F.col("id_epci").asc_nulls_last(),
    }
    return [first.get(order_by, first["name"]), F.col("id_epci").asc_nulls_last()]


def list_scores(
    scores: DataFrame,
    areas: DataFrame,
    search: str | None = None,
    limit: int = DEFAULT_PAGE,
    offset: int = 0,
    order_by: str = "name",
    year: int | None = None,
) -> DataFrame:
    """One page of score summaries. ``score_summaries(...).count()`` is the total."""
    if not 1 <= limit <= MAX_PAGE or offset < 0:
        raise ValueError(f"limit must be within 1..{MAX_PAGE} and offset not negative")
    rows = score_summaries(scores, areas, year, search)
    return rows.orderBy(*list_order(order_by)).offset(offset).limit(limit)


def list_scores_after(
    scores: DataFrame,
    areas: DataFrame,
    after: tuple | None = None,
    search: str | None = None,
    limit: int = DEFAULT_PAGE,
    order_by: str = "name",
    year: int | None = None,
) -> DataFrame:
    """The page that follows a row: a page far down costs what the first one costs, and none is read before it.

    ``after`` is (value ordered by, id_epci) of the last row of the page before, None for the first page; the
    value is that row's label, score or code. Areas that come or go between two pages neither repeat nor hide
    others. Scores are ordered and compared to nine places, below which a mean depends on the order of addition.
    """
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"limit must be within 1..{MAX_PAGE}")
    rows = score_summaries(scores, areas, year, search)
    by_score = order_by == "score"
    if by_score:
        key = F.round("score_global", 9)
    else:
        key = F.col("id_epci" if order_by == "code" else "libelle")
    if after is not None:
        value, last = after
        later_id = F.col("id_epci") > last
        if value is None:
            rows = rows.where(key.isNull() & later_id)
        else:
            value = F.round(F.lit(float(value)), 9) if by_score else F.lit(value)
            beyond = key < value if by_score else key > value
            rows = rows.where(beyond | key.isNull() | ((key == value) & later_id))
    return rows.orderBy(key.desc_nulls_last() if by_score else key.asc_nulls_last(), F.col("id_epci").asc_nulls_last()).limit(limit)


def detail_groups(scores: DataFrame, dimension: DataFrame, key: str, score: str, year: int | None = None) -> DataFrame:
    """Mean score per area and need (objective, type): (id_epci, id, label, score).

    Rows without the id are left out; an id the dimension lacks has a null label.
    """
    means = (
        of_year(scores, year)
        .where(F.col(key).isNotNull())
        .groupBy("id_epci", F.col(key).alias("id"))
        .agg(F.avg(F.col(score).cast("double")).alias("score"))
    )
    labels = dimension.select(F.col(key).alias("id"), F.col("libelle").alias("label"))
    return means.join(labels, "id", "left").select("id_epci", "id", "label", "score")


def detail_indicators(
    scores: DataFrame,
    indicators: DataFrame,
    needs: DataFrame,
    objectives: DataFrame,
    types: DataFrame,
    year: int | None = None,
) -> DataFrame:
    """Every indicator score with the labels of its indicator, need, objective and type."""
    joined = star_lookup(
        of_year(scores, year),
        required=[_renamed(indicators, "id_indicateur", "indicateur_libelle")],
        optional=[
            _renamed(needs, "id_besoin", "besoin_libelle"),
            _renamed(objectives, "id_objectif", "objectif_libelle"),
            _renamed(types, "id_type", "type_libelle"),
        ],
    )
    return joined.select("id_epci", *DETAIL_COLUMNS)


def _renamed(dim: DataFrame, key: str, name: str) -> tuple[DataFrame, str, str]:
    return dim.select(key, F.col("libelle").alias(name)), key, key


def score_detail(
    scores: DataFrame,
    areas: DataFrame,
    indicators: DataFrame,
    needs: DataFrame,
    objectives: DataFrame,
    types: DataFrame,
    id_epci: str,
    year: int | None = None,
) -> dict[str, DataFrame]:
    """Drill-down of one area as five frames; an unknown area is an error.

    One action resolves the year over all scores and finds the area; the frames themselves are lazy.
    """
    own = scores.where(F.col("id_epci") == id_epci)
    wanted = F.lit(year) if year is not None else latest_year(scores).scalar()
    known = own.where(F.col("annee") == wanted).join(areas.select("id_epci"), "id_epci", "left_semi").select("annee").first()
    if known is None:
        raise ValueError(f"unknown area: {id_epci}")
    year = known[0]
    summary = score_summaries(own, areas, year)
    by_label = [F.col("label").asc_nulls_last(), F.col("id")]
    return {
        "summary": summary,
        "needs": detail_groups(own, needs, "id_besoin", "score_besoin", year).orderBy(*by_label),
        "objectives": detail_groups(own, objectives, "id_objectif", "score_objectif", year).orderBy(*by_label),
        "types": detail_groups(own, types, "id_type", "score_type", year).orderBy(*by_label),
        "indicators": detail_indicators(own, indicators, needs, objectives, types, year).orderBy(
            F.col("indicateur_libelle").asc_nulls_last(), F.col("id_indicateur")
        ),
    }


def score_detail_all(
    scores: DataFrame,
    areas: DataFrame,
    indicators: DataFrame,
    needs: DataFrame,
    objectives: DataFrame,
    types: DataFrame,
    year: int | None = None,
) -> DataFrame:
    """Drill-down of every area at once: its summary and arrays of its needs, objectives, types and indicators.

    One lazy plan without an action. The scores of a year are read once and cross the network once: an area's
    lines, as many as there are indicators, meet in one array, and the means of its groups are taken inside it,
    in the order of the lines, so that they do not depend on the partitioning. Arrays are sorted by label (null
    labels last), then id. An area without a group of a kind has an empty array. A dimension holds each id once.
    """
    lines = star_lookup(
        of_year(scores, year).select(
            "id_epci", "updated_at", "score_global", "id_indicateur", "score_indicateur", *[c for _, key, _, score in GROUPS for c in (key, score)]
        ),
        required=[],
        optional=[
            (indicators.select("id_indicateur", F.col("libelle").alias("indicateur_libelle"), F.lit(True).alias("_known")),) + 2 * ("id_indicateur",),
            *[_renamed(dim, key, label) for dim, (_, key, label, _) in zip((needs, objectives, types), GROUPS)],
        ],
    )
    line = F.struct(
        F.col("indicateur_libelle").isNull().alias("_last"), F.col("indicateur_libelle").alias("_label"),
        F.col("id_indicateur").alias("_id"), "_known", F.struct(*DETAIL_COLUMNS).alias("item"),
    )
    per_area = lines.groupBy("id_epci").agg(
        F.avg(F.col("score_global").cast("double")).alias("score_global"),
        F.count("id_indicateur").alias("n_indicateurs"),
        F.max("updated_at").alias("updated_at"),
        F.sort_array(F.collect_list(line)).alias("_lines"),
    )
    return per_area.join(areas.select("id_epci", *AREA_COLUMNS), "id_epci").select(
        "id_epci", *AREA_COLUMNS, "score_global", "n_indicateurs", "updated_at",
        *[_group_means("_lines", key, label, score).alias(name) for name, key, label, score in GROUPS],
        F.transform(F.filter("_lines", lambda x: x["_known"]), lambda x: x["item"]).alias("indicators"),
    )


def _group_means(lines: str, key: str, label: str, score: str) -> Column:
    """Mean score per id of a kind of group, from an area's array of lines: structs of id, label, score."""
    items = F.filter(F.transform(lines, lambda x: x["item"]), lambda x: x[key].isNotNull())
    ids = F.transform(items, lambda x: F.struct(x[label].isNull().alias("_last"), x[label].alias("label"), x[key].alias("id")))

    def mean(group: Column) -> Column:
        own = F.filter(items, lambda x: (x[key] == group["id"]) & x[score].isNotNull())
        total = F.aggregate(own, F.lit(0.0), lambda sum_, x: sum_ + x[score].cast("double"))
        return total / F.nullif(F.size(own), F.lit(0))

    return F.transform(
        F.sort_array(F.array_distinct(ids)),
        lambda g: F.struct(g["id"].alias("id"), g["label"].alias("label"), mean(g).alias("score")),
    )


def indicator_labels_view(indicators: DataFrame, links: Mapping[str, tuple[DataFrame, DataFrame, str]]) -> DataFrame:
    """Indicators with sorted label arrays; null where nothing is linked.

    ``links`` maps a result column to (link table, dimension, dimension key).
    """
    view = indicators
    for name, (table, dimension, key) in links.items():
        labelled = table.join(dimension.select(key, "libelle"), key)
        arrays = distinct_labels(labelled.select("id_indicateur", "libelle"), "id_indicateur", "libelle", name)
        view = view.join(arrays, "id_indicateur", "left")
    return view


def score_lines_view(scores: DataFrame, areas: DataFrame) -> DataFrame:
    """Every score row with the label and codes of its area."""
    named = areas.select("id_epci", F.col("libelle").alias("epci_libelle"), "departement_code", "region_code")
    return scores.join(named, "id_epci")


def area_scores_view(scores: DataFrame, areas: DataFrame, global_scores: DataFrame) -> DataFrame:
    """Per area and year: stored global scores, indicator count, mean indicator score."""
    per_area = scores.groupBy("id_epci", "annee").agg(
        F.count_distinct("id_indicateur").alias("indicator_count"),
        F.avg(F.col("score_indicateur").cast("double")).alias("avg_indicator_score"),
    )
    stored = global_scores.select(
        "id_epci", "annee", "score_global", "score_besoin", "score_objectif", "score_type",
        F.col("updated_at").alias("global_updated_at"),
    )
    named = areas.select("id_epci", F.col("libelle").alias("epci_libelle"), "departement_code", "region_code")
    return per_area.join(named, "id_epci").join(stored, ["id_epci", "annee"], "left")


def area_by_code(areas: DataFrame, code_column: str, code) -> DataFrame:
    return areas.where(F.col(code_column) == code)


def rank_order(df: DataFrame, *keys: Column | str) -> DataFrame:
    """Total order with nulls last unless a key says otherwise."""
    return df.orderBy(*[F.col(k).asc_nulls_last() if isinstance(k, str) else k for k in keys])


def weakest_first(df: DataFrame, score: str, ties: Sequence[str] = ()) -> DataFrame:
    return rank_order(df, F.coalesce(F.col(score), F.lit(0.0)).asc(), *ties)


def best_first(df: DataFrame, score: str, ties: Sequence[str] = ()) -> DataFrame:
    return rank_order(df, F.col(score).desc_nulls_last(), *ties)
