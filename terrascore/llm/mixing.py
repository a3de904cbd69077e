"""Mix sources to target weights with nested hash thresholds, found from histograms.

Each row gets a 60-bit hash of its key and text. Per source, sizes are summed by the
top bits of the hash; the running sums name the one bucket in which the budget runs
out, and only that bucket's rows are summed again by the next bits. Three passes pin
the threshold to one hash value, whatever the number of rows: no row is sorted, no
source is collected, and a source with most of the rows costs as many histogram
rows as any other. A row is then taken if its hash is below its source's threshold.

Thresholds are nested: a larger target keeps all that a smaller one took. A target
above the source's size takes every row once and the rows below the threshold again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrascore.llm.base import fresh, stage, table
from terrascore.llm.registry import query

HASH_BITS = 60
LEVELS = (12, 12, 36)  # bits that each pass reads; the last one tells single hash values apart
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text (null: 0): runs of anything but blank, tab, line and page breaks."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_hash(key: Column, text: Column) -> Column:
    """60 bits from the key and the text, the same in every run and engine."""
    digest = F.md5(F.concat_ws("|", key.cast("string"), text.cast("string")))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(
    sizes: DataFrame, source: str, size: str, weights: Sequence[int], share: float, most: float
) -> DataFrame:
    """One row per source with its ``target``.

    ``sizes`` has one row per source with its total ``size``. ``weights`` go round
    over the sources in code point order, null last. The targets add up to ``share``
    times all sizes and none is above ``most`` times its source's size: the level
    that weights are multiplied with is found from running sums over the sources in
    the order in which they reach their limit.
    """
    by_name = Window.orderBy(F.col(source).asc_nulls_last())
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(
        F.row_number().over(by_name) - 1, F.lit(len(weights))).cast("int") + 1))
    by_limit = Window.orderBy(F.col(size) / F.col("weight"), F.col(source).asc_nulls_last())
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    after = by_limit.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    total = F.sum(size).over(everything)
    budget = F.lit(share) * total - F.lit(most) * F.coalesce(F.sum(size).over(before), F.lit(0))
    level = budget / F.sum("weight").over(after)
    marked = ranked.withColumn("level", level).withColumn(
        "open", F.lit(most) * F.col(size) > F.col("level") * F.col("weight")
    )
    # the first source, in order of limits, that stays below its limit sets the level for all after it
    shared = F.min(F.when(F.col("open"), F.struct(F.col(size) / F.col("weight"), F.col("level")))).over(everything)
    rest = marked.withColumn("shared", shared["level"])
    limit = F.lit(most) * F.col(size)
    return rest.select(
        source, size, F.least(F.coalesce(F.col("shared") * F.col("weight"), limit), limit).cast("double").alias("target")
    )


def mix_sources(
    rows: DataFrame,
    weights: Sequence[int],
    share: float = 1.5,
    most: int = 2,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """``rows`` with ``size``, ``source_size``, ``target``, ``repeats`` (times that the mix takes the row) and ``taken``
    (words that it takes of the row).

    Each source takes rows in the order of their hash until its target is met, the
    last row if that comes nearer to the target (at equal distance it stays out). Rows
    equal in key and text have one hash: the mix takes all of them or none. A null
    source is a source of its own; a null text has size 0; an empty table gives an
    empty result. Other columns pass through; columns of ``rows`` that bear the name
    of a result column are replaced. Source, size and hash are staged, so that the passes read no
    text. With ``keep``, only these columns pass through, and they are staged as
    well: then the texts are read once.
    """
    made = ("size", "source_size", "target", "repeats", "taken")
    kept = [F.col(f"`{c}`") for c in (rows.columns if keep is None else keep) if c not in made]
    h, s, of, whole, upto = fresh(rows, "hash", "source", "of", "whole", "upto")
    measured = rows.select(
        *kept,
        word_count(F.col(f"`{text}`")).alias("size"),
        F.col(f"`{source}`").alias(s),
        row_hash(F.col(f"`{key}`"), F.col(f"`{text}`")).alias(h),
    )
    if keep is not None:
        measured = stage(measured, "mix")
    narrow = measured.select(F.col(s).alias("source"), "size", F.col(h).alias("hash"))
    narrow = narrow if keep is not None else stage(narrow, "mix")
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = source_targets(sizes, "source", "source_size", weights, share, most)
    cut = _thresholds(narrow, goals, most).select(  # one row per source
        F.col("source").alias(of), "source_size", "target", F.col("__whole").alias(whole), F.col("__upto").alias(upto))

    joined = measured.join(cut, F.col(s).eqNullSafe(F.col(of)), "left")
    repeats = (F.col(whole) + F.when(F.col(h) <= F.col(upto), 1).otherwise(0)).cast("int")
    return joined.select(
        *kept, "size", "source_size", "target", repeats.alias("repeats"),
        (F.col("size") * repeats).cast("long").alias("taken"),
    )


def _thresholds(narrow: DataFrame, goals: DataFrame, most: int) -> DataFrame:
    """Per source: times that every row is taken, and the largest hash that is taken once more."""
    whole = F.least(
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0), F.lit(most)
    ).cast("int")
    state = goals.withColumn("__whole", whole).withColumn(
        "__rest", F.col("target") - F.col("__whole") * F.col("source_size")
    ).withColumn("__prefix", F.lit(0).cast("long")).withColumn("__upto", F.lit(-1).cast("long"))
    state = stage(state, "mix-cuts")
    left, rows = HASH_BITS, narrow
    for bits in LEVELS:
        left -= bits
        marks = state.select(F.col("source").alias("__s"), "__prefix")
        if left + bits < HASH_BITS:  # after the first level only the rows of one bucket per source remain
            inside = F.col("source").eqNullSafe(F.col("__s")) & (F.shiftright("hash", left + bits) == F.col("__prefix"))
            rows = rows.join(marks, inside, "left_semi")
        histogram = rows.groupBy("source", F.shiftright("hash", left).alias("__bucket")).agg(
            F.sum("size").alias("__words"))
        running = Window.partitionBy("source").orderBy("__bucket")
        summed = histogram.withColumn("__upper", F.sum("__words").over(running))
        found = summed.join(
            state.select(F.col("source").alias("__s"), "__rest"), F.col("source").eqNullSafe(F.col("__s"))
        ).groupBy("source").agg(
            # the first bucket that goes over the rest, and what lies before it
            F.min(F.when(F.col("__upper") > F.col("__rest"), F.struct("__bucket", "__upper", "__words"))).alias("__b")
        ).select(F.col("source").alias("__f"), "__b")
        state = state.join(found, F.col("source").eqNullSafe(F.col("__f")), "left")
        used = F.col("__b.__upper") - F.col("__b.__words")
        if left:
            # a source whose rest is never exceeded keeps all rows below: its rest is all of it
            state = state.select(
                "source", "source_size", "target", "__whole",
                F.when(F.col("__b").isNotNull(), F.col("__rest") - used).otherwise(F.col("__rest")).alias("__rest"),
                F.coalesce(F.col("__b.__bucket"), F.lit(-1)).alias("__prefix"),
                F.when(F.col("__b").isNotNull(), F.shiftleft(F.col("__b.__bucket"), left) - 1)
                .otherwise(F.col("__upto")).alias("__upto"),
            )
        else:
            nearer = F.abs(F.col("__b.__upper") - F.col("__rest")) < F.abs(F.col("__rest") - used)
            state = state.select(
                "source", "source_size", "target", "__whole",
                F.when(F.col("__b").isNull(), F.col("__upto"))
                .when(nearer, F.col("__b.__bucket")).otherwise(F.col("__b.__bucket") - 1).alias("__upto"),
            )
        state = stage(state, "mix-cuts")
    return state


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(concat_ws('|', doc_id::VARCHAR, text)), 1, 15))::BIGINT AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ([5, 2, 1])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM d GROUP BY source
), l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER (
           ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST
           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s
), t AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size,
         weight * (SELECT arg_min(level, source_size::DOUBLE / weight) FROM l
                   WHERE 2.0::DOUBLE * source_size > level * weight)) AS target
  FROM l
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, d.source, d.h,
         CASE WHEN t.source_size > 0 THEN least(2, floor(t.target / t.source_size)) ELSE 0 END AS whole,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE UNBOUNDED PRECEDING) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, target - whole * source_size AS rest,
         coalesce(max(upto) FILTER (upto <= target - whole * source_size) OVER (PARTITION BY source), 0) AS below,
         min(upto) FILTER (upto > target - whole * source_size) OVER (PARTITION BY source) AS above
  FROM r
)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN upto <= rest OR (upto = above AND above - rest < rest - below) THEN 1 ELSE 0 END)
       )::BIGINT AS taken
FROM c
"""

#: Production parameters: words of the mix per word of the corpus, weights by source, most repeats.
SHARE, WEIGHTS, MOST = 1.5, (5, 2, 1), 2


@query("op4_mix_sources", SQL)
def op4_mix_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    mixed = mix_sources(docs, WEIGHTS, SHARE, MOST, keep=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def mix_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    # whole rows in one column, so that no column of theirs bears the name of a result
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "source", "text")
    mixed = mix_sources(rows, WEIGHTS, SHARE, MOST)
    repeated = mixed.select("row", F.explode(F.array_repeat(F.lit(True), F.col("repeats"))))
    return repeated.select("row.*")
