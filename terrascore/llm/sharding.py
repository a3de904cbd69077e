"""Put records into weighted shards by rendezvous hashing of their stable keys.

Every (key, shard) pair has a hash in (0, 1); a record goes to the shard with the
largest ``-weight / ln(hash)``. A shard then gets its weight's part of the keys, and
one more shard takes records only into itself: the scores of the others stay as they
were. Native expressions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrascore.llm.base import fresh, table
from terrascore.llm.registry import query

#: Rows are numbered within parts of a shard, so that no task numbers a whole shard.
PARTS = 4096


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Shard of a key among ``len(weights)`` shards; a null key is hashed as one more key value.

    A shard of weight 0 gets nothing. Ties, which need equal 60-bit hashes, go to the smaller shard.
    """
    text = F.coalesce(key.cast("string"), F.lit("null"))
    best = []
    for shard, weight in enumerate(weights):
        if weight < 0:
            raise ValueError("weights can't be negative")
        if weight:
            bits = F.conv(F.substring(F.md5(F.concat(text, F.lit(f":{shard}"))), 1, 13), 16, 10).cast("double")
            score = F.lit(-float(weight)) / F.log((bits + 0.5) / F.lit(2.0**52))
            best.append(F.struct(score.alias("score"), F.lit(-shard).alias("shard")))
    if not best:
        raise ValueError("at least one shard needs a weight above 0")
    return -(F.greatest(*best) if len(best) > 1 else best[0])["shard"]


def shard_rows(
    rows: DataFrame,
    weights: Sequence[float],
    new_weight: float | None = None,
    key: str = "doc_id",
    text: str = "text",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """``rows`` with ``size``, ``text_crc32``, ``shard``, ``slot`` and ``grown_shard``.

    ``grown_shard`` is the shard with one more shard of ``new_weight`` (null if that is
    None). ``size`` is the UTF-8 bytes of the text plus 1, 1 for a null text, whose
    ``text_crc32`` is that of an empty text. ``slot`` numbers a shard's rows from 0
    without gaps, in the order of a hash of the key, then key, checksum and size: each
    part of a shard is numbered by itself after what the parts before it hold, so a
    hot shard is many tasks. Rows equal in key and text get slots in any order. All
    rows of a null key are in one shard. Columns of ``rows`` with a result's name are
    replaced; an empty table gives an empty result. With ``keep`` only these columns
    pass, and texts stay out of the shuffle.
    """
    made = ("size", "text_crc32", "shard", "slot", "grown_shard")
    kept = [F.col(f"`{c}`") for c in (rows.columns if keep is None else keep) if c not in made]
    order, part, own = fresh(rows, "order", "part", "key")
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    key_col = F.col(f"`{key}`")
    crc = F.crc32(body)
    # the checksum spreads many texts of one key over parts
    spread = F.md5(F.concat_ws(":", key_col.cast("string"), crc.cast("string")))
    grown = rendezvous(key_col, [*weights, new_weight]) if new_weight is not None else F.lit(None)
    placed = rows.select(
        *kept,
        (F.octet_length(body) + 1).cast("long").alias("size"),
        crc.cast("long").alias("text_crc32"),
        rendezvous(key_col, weights).cast("int").alias("shard"),
        grown.cast("int").alias("grown_shard"),
        key_col.alias(own),
        F.conv(F.substring(spread, 1, 15), 16, 10).cast("long").alias(order),
    ).withColumn(part, F.shiftright(F.col(order), 48).cast("int"))  # 60 - 48 bits: PARTS
    counts = placed.groupBy("shard", part).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("shard").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col("shard").alias("__shard"), F.col(part).alias("__p"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"),
    )
    within = Window.partitionBy("shard", part).orderBy(order, F.col(own).asc_nulls_first(), "text_crc32", "size")
    numbered = placed.withColumn("__row", F.row_number().over(within))
    joined = numbered.join(starts, (F.col("shard") == F.col("__shard")) & (F.col(part) == F.col("__p")))
    return joined.select(
        *kept, "size", "text_crc32", "shard", (F.col("__row") - 1 + F.col("__start")).cast("long").alias("slot"),
        "grown_shard",
    )


#: Production parameters: equal shards, and one more of the same weight.
WEIGHTS = (1.0,) * 16


@query("op6_shard_documents")
def op6_shard_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    sharded = shard_rows(docs, WEIGHTS, WEIGHTS[0], keep=["doc_id"])
    return sharded.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
