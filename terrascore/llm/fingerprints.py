"""Document fingerprints from closed syncmers over words.

A text is a run of words, a k-mer is ``K`` words in a row and its inner substrings are
its runs of ``S`` words. A k-mer is a closed syncmer if the smallest hash among its
inner substrings is that of the first or the last one. Whether a k-mer is an anchor
depends on its own words alone, so that a shared passage gives the same anchors in
every text, and one of any ``K - S + 1`` k-mers in a row is an anchor. Native
expressions only: arrays of hashes, with sliding minima made by doubling.

A text of fewer than ``K`` words, or of very long ones (an unspaced script, an encoded
run), is a run of code points instead of words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrascore.llm.base import table, text_or_empty
from terrascore.llm.registry import query

S = 2  # words of an inner substring
SPAN = 8  # inner substrings of a k-mer: a power of two
K = SPAN + S - 1
BLANK = r"\s+"
LONG = 64  # code points of a word, in the mean: from there on a text is taken by code points
#: Neighbouring documents meet in ranges of ids: so many ranges for each shuffle partition, and at most so many.
RANGES_EACH, RANGES_MOST, SAMPLE_EACH = 4, 16384, 24


def _shifted(values: Column, by: int) -> Column:
    """The array from position ``by`` on (0 is the first)."""
    return F.slice(values, F.lit(by + 1), F.greatest(F.size(values) - by, F.lit(0)))


def anchors(text: Column) -> Column:
    """``array<struct<pos int, hash long>>``: closed syncmers in order; ``pos`` is that of their first word, from 0.

    A text of fewer than ``K`` words or of ``LONG`` or more code points a word is taken by code points, blanks
    at its ends left out. A text without anchors (one of fewer than ``K`` code points) has one
    at -1, the hash of the whole text; so do the null and the empty text.
    """
    plain = F.trim(F.coalesce(text, F.lit("")))
    whole = F.array(F.struct(F.lit(-1).alias("pos"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("hash")))

    def of_words(words: Column) -> Column:
        pairs = F.zip_with(words, _shifted(words, 1), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b)))
        cut = F.slice(pairs, F.lit(1), F.greatest(F.size(words) - (S - 1), F.lit(0)))
        return _let(cut, lambda inner: _let(_sliding_least(inner, 1), lambda least: found(words, inner, least)))

    def found(words: Column, inner: Column, least: Column) -> Column:
        count = F.size(inner) - (SPAN - 1)
        starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        edge = F.filter(starts, lambda i: (least[i] == inner[i]) | (least[i] == inner[i + (SPAN - 1)]))
        return F.transform(edge, lambda i: F.struct(
            i.alias("pos"), F.xxhash64(F.slice(words, i + 1, F.lit(K))).alias("hash")))

    def units(words: Column) -> Column:
        by_words = (F.size(words) >= K) & (F.char_length(plain) < LONG * F.size(words))
        return F.when(by_words, words).otherwise(F.split(plain, ""))

    return _let(_let(_let(F.split(plain, BLANK), units), of_words),
                lambda a: F.when(F.size(a) > 0, a).otherwise(whole))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once: a lambda variable, not a repeated expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sliding_least(values: Column, span: int) -> Column:
    """Least of the ``SPAN`` values from each position on; ``values`` holds the least of ``span``."""
    if span == SPAN:
        return values
    # the shifted array is padded with nulls, which `least` ignores; those positions are not looked at
    doubled = F.zip_with(values, _shifted(values, span), lambda a, b: F.least(a, b))
    return _let(doubled, lambda v: _sliding_least(v, 2 * span))


def hashes(found: Column) -> Column:
    """The distinct anchor hashes."""
    return F.array_distinct(F.transform(found, lambda a: a["hash"]))


def likeness(a: Column, b: Column) -> Column:
    """Part of two texts' distinct anchors that both have, from 0 to 1."""
    return _let(F.size(F.array_intersect(a, b)).cast("double"), lambda n: n / (F.size(a) + F.size(b) - n))


def printed(found: Column) -> Column:
    """A fingerprint as text: the last 32 bits of each anchor's hash, in order of position."""
    return F.array_join(F.transform(found, lambda a: F.hex(a["hash"].bitwiseAND(F.lit(0xFFFFFFFF)))), ",")


def _range_cuts(ids: DataFrame, key: str) -> tuple[int | None, list[int]]:
    """The smallest id, and ids that cut the table into ranges of about equal rows (from a sample of bounded size)."""
    spark = ids.sparkSession
    lowest, rows = ids.agg(F.min(key), F.count(key)).first()
    wanted = min(RANGES_MOST, RANGES_EACH * int(spark.conf.get("spark.sql.shuffle.partitions")), rows // SAMPLE_EACH)
    if wanted < 2:
        return lowest, []
    steps = 1 << 40
    share = min(1.0, wanted * SAMPLE_EACH / rows)
    drawn = ids.where(F.pmod(F.xxhash64(key), F.lit(steps)) < int(share * steps)).select(key)
    sample = sorted({r[0] for r in drawn.collect() if r[0] is not None})
    cuts = sorted({sample[len(sample) * i // wanted] for i in range(1, wanted)} - {lowest}) if sample else []
    return lowest, cuts


def _range_of(key: Column, cuts: list[int]) -> Column:
    """How many cuts are at or below the key: looked up in two steps of about the root of their number."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    rows = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    heads = F.lit([r[0] for r in rows])
    above = F.size(F.filter(heads, lambda c: c <= key))
    fine = F.array(*[F.lit(r) for r in rows])
    inside = F.size(F.filter(F.element_at(fine, above), lambda c: c <= key))
    return F.when(key.isNull(), F.lit(len(cuts))).when(key < cuts[0], 0).otherwise((above - 1) * step + inside)


def compare_with_next(rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint every text, its edited text and the next text, and compare them.

    The edited text is the text with its last ``floor(n_chars / 2)`` code points
    replaced by the first as many (or all) of the next row's text, in ascending order
    of the key; the last row is followed by the first. Rows that share a key follow
    each other by a hash of their text; rows without a key come last, and after them the first row with
    a key (nothing, if none has one). A null text is empty. Returns the key, ``n_chars``,
    ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next`` and ``anchors``.

    Texts cross the network once, into ranges of keys. A range's first row is sent to
    the range before it as well, so that every row meets its follower in its own
    range and no join is needed. Keys are expected to be nearly unique: rows that share one are in one range.
    """
    base = rows.select(F.col(f"`{key}`").cast("long").alias("id"), text_or_empty(text).alias("text"))
    lowest, cuts = _range_cuts(base.select("id"), "id")
    at = _range_of(F.col("id"), cuts)
    first_of = F.lit(False)
    if cuts:
        first_of = F.col("id") == F.element_at(F.lit(cuts), F.greatest(F.col("range"), F.lit(1)))
    places = F.concat(
        F.array(F.struct(F.col("range"), F.lit(False).alias("guest"))),
        F.when(F.coalesce(first_of, F.lit(False)), F.array(
            F.struct((F.col("range") - 1).alias("range"), F.lit(True).alias("guest")))).otherwise(F.array()),
        F.when(F.coalesce(F.col("id") == F.lit(lowest).cast("long"), F.lit(False)), F.array(
            F.struct(F.lit(len(cuts)).alias("range"), F.lit(True).alias("guest")))).otherwise(F.array()),
    )
    placed = base.withColumn("range", at.cast("int")).select("id", "text", F.inline(places))
    order = Window.partitionBy("range").orderBy("guest", F.col("id").asc_nulls_last(), F.xxhash64("text"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    follower = F.coalesce(F.lead("text").over(order), F.lit(""))
    found = placed.withColumn("follower", follower).select(
        "range", "guest", "id", "text", n.cast("long").alias("n_chars"), anchors(F.col("text")).alias("anchors"),
        F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring("follower", F.lit(1), half)).alias("edited"),
    )
    # one anchor array travels to the row before it, in the same order and partitioning
    followed = found.withColumn("next_anchors", F.lead("anchors").over(order)).where(~F.col("guest"))
    both = followed.withColumn("edited_anchors", anchors(F.col("edited")))
    own = hashes(F.col("anchors"))
    return both.select(
        F.col("id").alias(key),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        printed(F.col("anchors")).alias("fingerprint"),
        printed(F.col("edited_anchors")).alias("edited_fingerprint"),
        likeness(own, hashes(F.col("edited_anchors"))).alias("near_edited"),
        F.when(F.col("next_anchors").isNull(), 0.0).otherwise(likeness(own, hashes(F.col("next_anchors")))).alias(
            "near_next"),
        "anchors",
    )


@query("op10_fingerprint_documents")
def op10_fingerprint_documents(spark, sf_dir):
    return compare_with_next(table(spark, sf_dir, "documents")).drop("anchors")
