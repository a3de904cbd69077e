"""Near-duplicate texts by DartMinHash signatures and a banded join.

A text is a weighted set: its shingles of five words, each with the number of times
that it occurs. Weight and rank span a plane for every shingle; hashed darts fall on it
as a Poisson process of density one, the same darts for a shingle in every text. A
text throws only at what it covers: its shingles' regions up to their weight, layer
by layer, and up to a rank at which about ``K ln K + 2 K`` darts have fallen in
all, however long the text. Every dart belongs to one of ``K`` coordinates; the earliest of each is the
signature, equal in two texts with the probability of their weighted Jaccard
similarity. A text with an empty coordinate throws on, to twice the rank.

Coordinates are joined in bands. In a bucket every member is first compared with its
central one, which joins most of a group of copies. What links have not joined then is
compared inside bounded leaves: a bucket that fits is a leaf, and all pairs of different
components in it are checked. A leaf gives at most one link less than it has
components. Members of larger buckets are joined by their rarest shingles instead: the
common ones of a similar pair begin early in both texts' shingles, rarest first, so that
a pair which has none there is not similar, and no similar pair is left out.

Every link is checked on the texts' bags of 32-bit shingle hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrascore.llm.base import fresh, slices, stage, table
from terrascore.llm.components import components
from terrascore.llm.registry import query
from terrascore.session import settings

WORDS, SIMILAR = 5, 0.8
#: Bands of the signature and coordinates in each: texts of similarity 0.8 share a band with 0.9996 probability.
BANDS, ROWS = 26, 6
#: What a leaf may hold: members, and bytes of bags; so few members are one whatever their size.
LEAF, LEAF_BYTES, FEW = 1024, 8 << 20, 16
#: Bits of the map of rows that a stage may drop: 4 MB, however many rows there are.
MARKED = 1 << 25
#: What rounding may take from a bound on units of weight.
SLACK = 1e-6
#: Bytes of words worked on at a time, and rows of an Arrow batch (each may hold two bags).
SLICE, BATCH = 1 << 19, 128
SEED = 0x9E3779B97F4A7C15


def words_of(text: Column) -> Column:
    """Lower-case words, letters and digits only, one blank between them; empty for a null text."""
    plain = F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    return F.trim(plain)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of texts of words, and how many each text has; fewer than five words are one shingle."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends = np.flatnonzero(data == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    # a polynomial over all bytes; a word's part of it, moved to the front, is its hash
    with np.errstate(over="ignore"):
        factor = np.uint64(0x100000001B3)
        inverse = np.uint64(pow(0x100000001B3, -1, 1 << 64))
        up = np.cumprod(np.full(len(data), factor))
        sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up)])
        down = np.cumprod(np.full(len(data), inverse))
        word = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        # words of each text: an empty text has one empty word, which is none
        sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        last = np.searchsorted(ends, np.cumsum(sizes + 1) - 1)
        first = np.concatenate([[0], last[:-1] + 1])
        count = np.where(sizes > 0, last - first + 1, 0)
        number = np.where(count >= WORDS, count - WORDS + 1, (count > 0).astype(np.int64))
        at = np.repeat(first, number) + ramp(number)
        span = np.repeat(np.minimum(count, WORDS), number)
        value = np.zeros(len(at), np.uint64)
        for i in range(WORDS):
            inside = span > i
            value[inside] = mix(value[inside] * np.uint64(3) + word[at[inside] + i] + np.uint64(i + 1))
    return value, number


def ramp(counts: np.ndarray) -> np.ndarray:
    """0, 1, … for each count, one after the other."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def layered(value: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every unit of weight its text and a hash of shingle and layer: the n-th time that a text has a shingle."""
    text = np.repeat(np.arange(len(number)), number)
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    run = np.flatnonzero(new)
    layer = np.arange(len(value)) - np.repeat(run, np.diff(np.append(run, len(value))))
    with np.errstate(over="ignore"):
        return text, mix(value + layer.astype(np.uint64) * np.uint64(SEED))


def dart_signatures(value: np.ndarray, number: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """Ranks of the earliest dart of each coordinate, one row of ``size`` per text; infinite for texts without shingles.

    A dart's rank is a hash, so equal ranks mean the same dart.
    """
    text, layer = layered(value, number)
    best = np.full(len(number) * size, np.inf)  # of each text and coordinate
    limit = (size * math.log(size) + 2 * size) / np.maximum(number, 1)
    open_text = number > 0
    # darts of a layer come in the order of their rank: exponential gaps make a Poisson process
    while open_text.any():
        live = np.flatnonzero(open_text[text])
        where, hashes, ranks = text[live], layer[live], np.zeros(len(live))
        darts = [(np.zeros(0, np.int64), np.zeros(0))]
        turn = np.uint64(0)
        while len(where):
            with np.errstate(over="ignore"):
                draw = mix(hashes + (turn + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))
                coordinate = (mix(draw + np.uint64(SEED)) % np.uint64(size)).astype(np.int64)
            ranks = ranks - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53))
            inside = ranks <= limit[where]
            where, hashes, ranks, coordinate = where[inside], hashes[inside], ranks[inside], coordinate[inside]
            darts.append((where * size + coordinate, ranks))
            turn += np.uint64(1)
        cell, at = (np.concatenate(x) for x in zip(*darts, strict=True))
        order = np.lexsort((at, cell))
        cell, at = cell[order], at[order]
        earliest = np.ones(len(cell), bool)
        earliest[1:] = cell[1:] != cell[:-1]
        best[cell[earliest]] = at[earliest]
        open_text &= np.isinf(best.reshape(len(number), size)).any(axis=1)
        limit = np.where(open_text, 2 * limit, limit)
    return best.reshape(len(number), size)


def band_keys(signatures: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One hash per text and band, of the band's number and coordinates."""
    bits = signatures.view(np.uint64).reshape(len(signatures), bands, -1)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), bits.shape[:2]).copy()
        for i in range(bits.shape[2]):
            key = mix(key * np.uint64(SEED) + bits[:, :, i])
    return key.view(np.int64)


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted bags of shingle hashes: common weight over weight of either."""
    values, counts = np.unique(np.concatenate([np.unique(a), np.unique(b)]), return_counts=True)
    common = values[counts == 2]
    least = np.minimum(
        np.searchsorted(a, common, "right") - np.searchsorted(a, common, "left"),
        np.searchsorted(b, common, "right") - np.searchsorted(b, common, "left"),
    ).sum()
    return float(least / (len(a) + len(b) - least)) if len(a) + len(b) else 0.0


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Band keys, which mean nothing for a text without words."""
    for batch in slices(batches, "words", SLICE):
        value, number = shingles([t.encode() for t in batch.column(3).to_pylist()])
        keys = band_keys(dart_signatures(value, number))
        bands = pa.ListArray.from_arrays(
            pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), pa.array(keys.reshape(-1)))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], bands], ["id", "mark", "digest", "bands"])


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "words", SLICE):
        value, number = shingles([t.encode() for t in batch.column(1).to_pylist()])
        short = (value >> np.uint64(32)).astype(np.uint32)
        cuts = np.concatenate([[0], np.cumsum(number)])
        bags = [np.sort(short[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bags, pa.binary())], ["node", "bag"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (batch.column(i).to_pylist() for i in (2, 3))
        found = [weighted_jaccard(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)) for x, y in zip(a, b, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], ["a", "b", "similarity"])


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes with every unit of their weight: a shingle's hash, and below it the times that the text had it before."""
    for batch in slices(batches, "bag", SLICE):
        bags = [np.frombuffer(b, np.uint32) for b in batch.column(1).to_pylist()]
        number = np.array([len(b) for b in bags])
        token, text = np.concatenate(bags), np.repeat(np.arange(len(bags)), number)
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (text[1:] != text[:-1])
        layer = ramp(np.diff(np.append(np.flatnonzero(new), len(token))))
        unit = (token.astype(np.uint64) << np.uint64(32) | layer.astype(np.uint64)).view(np.int64)
        units = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(number)]), pa.int32()), pa.array(unit))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number, pa.int64()), units], ["node", "size", "units"])


def leaf_links(roots: list[int], bags: list[bytes], similar: float) -> list[tuple[int, int, float]]:
    """Links that join the components of a leaf, as places of members; every pair of different components is compared.

    Members outside the largest component are compared with all others at once.
    """
    root = np.array(roots)
    values, counts = np.unique(root, return_counts=True)
    major = values[counts.argmax()]
    tokens = [np.frombuffer(b, np.uint32) for b in bags]
    size = np.array([len(t) for t in tokens])
    known, token = np.unique(np.concatenate(tokens), return_inverse=True)
    # members' distinct tokens one after the other, and how often each occurs
    cell, times = np.unique(np.repeat(np.arange(len(tokens)), size) * len(known) + token, return_counts=True)
    token, starts = cell % len(known), np.searchsorted(cell // len(known), np.arange(len(tokens)))
    ends = np.append(starts[1:], len(cell))
    joined = {int(v): int(v) for v in values}

    def find(x: int) -> int:
        while joined[x] != x:
            joined[x] = joined[joined[x]]
            x = joined[x]
        return x

    out = []
    mine = np.zeros(len(known), np.int64)
    for s in np.flatnonzero(root != major):
        own = slice(starts[s], ends[s])
        mine[token[own]] = times[own]
        common = np.add.reduceat(np.minimum(mine[token], times), starts)
        mine[token[own]] = 0
        near = common / (size + size[s] - common)
        for other in np.flatnonzero((near >= similar) & (root != root[s])):
            x, y = find(int(root[s])), find(int(root[other]))
            if x != y:
                joined[x] = y
                out.append((int(s), int(other), float(near[other])))
    return out


def _in_leaves(similar: float):
    """Links from rows in the order of their leaves; one leaf is held at a time."""

    def links(key: int, held: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        node, root, bag = zip(*held, strict=True)
        found = [(min(node[i], node[j]), max(node[i], node[j]), x) for i, j, x in leaf_links(list(root), list(bag), similar)]
        if found:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)],
                ["a", "b", "similarity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            for key, *member in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if key != current and held:
                    yield from links(current, held)
                    held = []
                current = key
                held.append(tuple(member))
        if held:
            yield from links(current, held)

    return run


def near_duplicates(
    rows: DataFrame, key: str = "doc_id", text: str = "text", similar: float = SIMILAR
) -> tuple[DataFrame, DataFrame]:
    """Membership and links: ``doc_id, class_id`` for every row, and ``a, b, similarity``, smallest keys of two texts.

    A class is a component of links of at least ``similar`` between texts; ``class_id`` is
    the smallest key of its rows, null if none has one. Texts with the same words are one
    text, and only one of them takes part in the join, however many there are. A text without words
    resembles nothing: its class is its own key. A row's class is that of its own text, also where
    rows share a key or have none. The links are those that the classes rest on. An empty table gives empty results.
    """
    columns = [F.col(f"`{c}`") for c in (key, text)]
    signed, classes, links = text_classes(rows, key, text, similar, F.xxhash64(*columns))
    placed = signed.join(classes, "digest", "left")
    return placed.select(F.col("id").alias(key), F.coalesce("class_id", "id").alias("class_id")), links


def text_classes(rows: DataFrame, key: str, text: str, similar: float, mark: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``id, mark, digest`` of every row (the digest of its words, null without any), ``digest, root, class_id``, and links.

    ``mark`` is a hash of the row: rows with the same id and mark have the same text.
    """
    spark = rows.sparkSession
    texts = rows.select(F.col(f"`{key}`").cast("long").alias("id"), mark.alias("mark"), F.col(f"`{text}`").alias("text"))
    said = texts.select("id", "mark", words_of(F.col("text")).alias("words"))
    with settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH}):
        signed = stage(said.select("id", "mark", F.when(F.col("words") != "", F.md5("words")).alias("digest"), "words").mapInArrow(
            _signed, "id long, mark long, digest string, bands array<long>"), "signed")
        nodes = stage(signed.where(F.col("digest").isNotNull()).groupBy("digest").agg(
            F.min("id").alias("least"), F.min(F.struct("id", "mark")).alias("row"), F.first("bands").alias("bands")
        ).withColumn("node", F.monotonically_increasing_id()), "nodes")
        members = nodes.select(F.explode("bands").alias("key"), "node")
        sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
        met = stage(members.join(sizes, "key"), "met")
        links, roots = _linked(texts, nodes, met, similar)
    placed = nodes.select("digest", "node", "least").join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select(
        "digest", "least", F.coalesce("root", "node").alias("root"))
    named = stage(placed, "placed")
    smallest = named.groupBy("root").agg(F.min("least").alias("class_id"))
    keys = nodes.select("node", "least")
    between = links.join(keys.toDF("a", "x"), "a").join(keys.toDF("b", "y"), "b").select(
        F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")
    return signed.select("id", "mark", "digest"), named.join(smallest, "root").select("digest", "root", "class_id"), between


def _linked(texts: DataFrame, nodes: DataFrame, met: DataFrame, similar: float) -> tuple[DataFrame, DataFrame]:
    """Links, and ``node, root`` of all nodes that share a bucket, from the nodes in their buckets."""
    spark = texts.sparkSession
    if not met.limit(1).count():
        return spark.createDataFrame([], "a long, b long, similarity double"), spark.createDataFrame([], "node long, root long")
    wanted = stage(met.select("node").distinct().join(nodes.select("node", "row.*"), "node").select(
        "node", F.col("id").alias("of"), F.col("mark").alias("marked")), "wanted")
    # a Bloom filter of bounded size goes to the other side's scan, so that only texts that are wanted are shuffled;
    # Spark makes one for a side with a filter, this one keeps every row
    with settings(spark, {"spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": 0}):
        found = texts.join(wanted.where(F.pmod("marked", F.lit(2)) < 2), (F.col("mark") == F.col("marked")) & F.col("id").eqNullSafe(F.col("of")))
        bags = found.select("node", words_of(F.col("text")).alias("words")).mapInArrow(_bags, "node long, bag binary")
        bags = stage(bags.groupBy("node").agg(F.first("bag").alias("bag")), "bags")
    links = _verified(bags, _stars(met), similar)
    roots = components(links)
    sizes = bags.select("node", F.octet_length("bag").alias("size"))
    members = _open(met.select("key", "node"), roots, sizes)
    fits = (F.col("n") <= LEAF) & ((F.col("bytes") <= LEAF_BYTES) | (F.col("n") <= FEW))
    leaves = members.where(fits).join(bags, "node").select("key", "node", "root", "bag").repartition("key").sortWithinPartitions("key")
    links, roots = _more(links, roots, stage(leaves.mapInArrow(_in_leaves(similar), "a long, b long, similarity double"), "found"))
    large = members.where(~fits)
    if large.limit(1).count():
        pairs = _by_rare_shingles(_open(large.select("key", "node"), roots, sizes), bags, similar)
        links, roots = _more(links, roots, _verified(bags, pairs, similar))
    return stage(links.dropDuplicates(["a", "b"]), "links"), roots


def _more(links: DataFrame, roots: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    if not found.limit(1).count():
        return links, roots
    return links.union(found), components(found.select("a", "b").union(roots.select("node", "root")))


def _stars(met: DataFrame) -> DataFrame:
    """Each member with the central one of its bucket, as pairs ``a < b``.

    That is the member which shares most buckets with others: in a group of copies the
    text they were made from, which all resemble though they may not resemble each other.
    """
    shared = met.groupBy("node").agg(F.sum("n").alias("shared"))
    central = met.select("key", "node").join(shared, "node").groupBy("key").agg(
        F.max_by("node", F.struct("shared", -F.col("node"))).alias("central"))
    return _paired(met.select("key", "node").join(central, "key"))


def _open(members: DataFrame, roots: DataFrame, sizes: DataFrame) -> DataFrame:
    """All members of the buckets that links haven't joined, with their component, and the bucket's members and bytes."""
    rooted = members.join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select(
        "key", "node", F.coalesce("root", "node").alias("root")).join(sizes, "node")
    several = rooted.groupBy("key").agg(
        F.min("root").alias("x"), F.max("root").alias("y"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")
    ).where(F.col("x") != F.col("y"))
    return stage(rooted.join(several.drop("x", "y"), "key").select("key", "node", "root", "n", "bytes"), "open")


def _by_rare_shingles(members: DataFrame, bags: DataFrame, similar: float) -> DataFrame:
    """Pairs ``a < b`` of the members of open buckets, among them every similar one that shares a bucket and no component.

    Units of weight are put in one order for all members, rarest first. If the first common unit of two texts is at
    places i and j, they have at most ``min(size_a - i, size_b - j)`` in common, of which similar ones need
    ``similar / (1 + similar) * (size_a + size_b)``. Such a pair is found by that unit. One member of each pair is
    outside the largest component of a bucket; only these search.
    """
    counted = members.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    major = counted.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("major"))
    nodes = stage(members.join(major, "key").groupBy("node", "root").agg(
        F.max(F.col("root") != F.col("major")).alias("searches")), "nodes")
    units = stage(bags.join(nodes.select("node"), "node").select("node", "bag").mapInArrow(
        _units, "node long, size long, units array<long>"), "units").select("node", "size", F.explode("units").alias("unit"))
    common = units.groupBy("unit").agg(F.count(F.lit(1)).alias("texts")).where(F.col("texts") > 1)
    of = Window.partitionBy("node")
    # units of one text alone come first in the order and join nothing
    place = F.col("size") - F.count(F.lit(1)).over(of) + F.row_number().over(of.orderBy("texts", "unit")) - 1
    rest = units.join(common, "unit").withColumn("rest", F.col("size") - place)  # units from this one on
    early = rest.where(F.col("rest") >= similar * F.col("size") - SLACK).join(nodes, "node")
    early = stage(early.select("unit", "node", "root", "size", "rest", "searches"), "early")
    one = early.where("searches").drop("searches").toDF("unit", "a", "root_a", "size_a", "rest_a")
    other = early.drop("searches").toDF("unit", "b", "root_b", "size_b", "rest_b")
    enough = (1 + similar) * F.least("rest_a", "rest_b") >= similar * (F.col("size_a") + F.col("size_b")) - SLACK
    met = one.join(other, "unit").where((F.col("root_a") != F.col("root_b")) & enough)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _paired(starred: DataFrame) -> DataFrame:
    """Distinct pairs in order of each node and its bucket's central one."""
    return starred.where(F.col("node") != F.col("central")).select(
        F.least("node", "central").alias("a"), F.greatest("node", "central").alias("b")).distinct()


def _verified(bags: DataFrame, pairs: DataFrame, similar: float) -> DataFrame:
    """The pairs that are similar, with their similarity, from the bags of shingles of their texts."""
    left = bags.select(F.col("node").alias("a"), F.col("bag").alias("bag_a"))
    right = bags.select(F.col("node").alias("b"), F.col("bag").alias("bag_b"))
    # 4 bytes a unit of weight: texts too different in length can't be similar and are not compared
    size_a, size_b = F.octet_length("bag_a"), F.octet_length("bag_b")
    both = pairs.join(left, "a").join(right, "b").where(F.least(size_a, size_b) >= similar * F.greatest(size_a, size_b))
    compared = both.select("a", "b", "bag_a", "bag_b").mapInArrow(_compared, "a long, b long, similarity double")
    return stage(compared.where(F.col("similarity") >= similar), "verified")


@query("op3_near_duplicates")
def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))[0]


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, that of the smallest id (rows without one come last), then of the smallest hash of its row.

    A row goes only if another row of its class stays, whatever ids they have; of rows equal in every column one stays. Texts
    without words stay.
    """
    mark = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    signed, classes, _ = text_classes(docs, "doc_id", "text", SIMILAR, mark)
    smallest = F.struct(F.col("id").isNull(), F.col("id"), F.col("mark"))
    said = signed.where(F.col("digest").isNotNull())
    digests = said.groupBy("digest").agg(F.min(smallest).alias("first")).join(classes, "digest")
    winners = stage(digests.groupBy("root").agg(F.min("first").alias("stays")).select("stays.id", "stays.mark"), "winners")
    own, copy, copy_id, part, bits = fresh(docs, "mark", "copy", "copy_id", "part", "bits")
    wins = winners.select(F.col("id").alias(copy_id), F.col("mark").alias(copy))
    goes = said.join(wins, (F.col("mark") == F.col(copy)) & F.col("id").eqNullSafe(F.col(copy_id)), "left_anti")
    copies = stage(goes.select(F.col("id").alias(copy_id), F.col("mark").alias(copy)).distinct(), "copies")
    repeated = stage(said.groupBy("id", "mark").count().where("count > 1").select(
        F.col("id").alias(copy_id), F.col("mark").alias(copy)), "repeated")
    # a bitmap of bounded size, so always broadcast, knows most rows that stay: only the others' texts are shuffled
    bit = F.pmod(F.col(copy), F.lit(MARKED))
    marked = stage(copies.union(repeated).groupBy(F.bitmap_bucket_number(bit).alias(part)).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias(bits)), "marked")
    bit = F.pmod(F.col(own), F.lit(MARKED))
    at = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    told = docs.withColumn(own, mark).withColumn(part, F.bitmap_bucket_number(bit)).join(F.broadcast(marked), part, "left")
    is_marked = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    same = (F.col(own) == F.col(copy)) & F.col("doc_id").eqNullSafe(F.col(copy_id))
    kept = told.where(is_marked).drop(part, bits).join(copies, same, "left_anti")
    if repeated.limit(1).count():  # rows that are equal in every column
        kept = kept.join(repeated, same, "left_anti").union(kept.join(repeated, same, "left_semi").dropDuplicates([own]))
    kept = told.where(~is_marked).drop(part, bits).unionByName(kept)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
