"""Closed syncmers against a plain Python version."""

import hashlib
import random

from pyspark.sql import functions as F

from terrascore.llm.fingerprints import K, S, SPAN, anchors, compare_with_next, hashes, likeness


def test_anchors_are_closed_syncmers(spark):
    words = [f"w{(i * i) % 37}" for i in range(120)]
    text = " ".join(words)
    row = spark.createDataFrame([(text,)], "t string").select(
        anchors(F.col("t")).alias("a"),
        F.array(*[F.xxhash64(F.lit(a), F.lit(b)) for a, b in zip(words, words[1:], strict=False)]).alias("inner"),
    ).first()
    inner = row["inner"]
    want = []
    for i in range(len(words) - K + 1):
        window = inner[i : i + SPAN]
        if min(window) in (window[0], window[-1]):
            want.append(i)
    assert [a["pos"] for a in row["a"]] == want and S == 2
    gaps = [b - a for a, b in zip(want, want[1:], strict=False)]
    assert max(gaps) <= SPAN  # the window guarantee


def test_a_shared_passage_has_the_same_anchors(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [("a b c " + passage + " x y",), (" ".join(f"q{i}" for i in range(31)) + "\n" + passage,)]
    a, b = (set(r["h"]) for r in spark.createDataFrame(texts, "t string").select(hashes(anchors(F.col("t"))).alias("h")).collect())
    assert len(a & b) >= (60 - K + 1) // SPAN


def test_short_and_empty_texts(spark):
    rows = [("",), (None,), ("one",), ("one two",), (" ",)]
    got = [r["a"] for r in spark.createDataFrame(rows, "t string").select(anchors(F.col("t")).alias("a")).collect()]
    assert all(len(a) == 1 and a[0]["pos"] == -1 for a in got)
    assert got[0][0]["hash"] == got[1][0]["hash"] != got[2][0]["hash"]
    same = spark.range(1).select(likeness(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3))).alias("x")).first()["x"]
    assert same == 1 / 3


def test_short_and_unspaced_texts_have_several_anchors(spark):
    rng = random.Random(1)
    han = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(3200))
    smileys = "".join(chr(rng.randrange(0x1F600, 0x1F640)) for _ in range(200))
    rows = [(0, han), (1, han[:1600] + han[:1600]), (2, "eight words or fewer are a short text"), (3, "x" * 500), (4, smileys), (5, "abcdefgh"), (6, " abcdefgh ")]
    got = {r["i"]: r["a"] for r in spark.createDataFrame(rows, "i int, t string").select("i", anchors(F.col("t")).alias("a")).collect()}
    for i, text in ((0, han), (4, smileys), (2, rows[2][1])):
        inner = [r[0] for r in spark.createDataFrame([(k, *p) for k, p in enumerate(zip(text, text[1:], strict=False))], "k int, a string, b string").orderBy(
            "k").select(F.xxhash64("a", "b")).collect()]
        windows = [inner[k : k + SPAN] for k in range(len(text) - K + 1)]
        assert [a["pos"] for a in got[i]] == [k for k, w in enumerate(windows) if min(w) in (w[0], w[-1])]
    assert len({a["hash"] for a in got[0]} & {a["hash"] for a in got[1]}) > 1600 // SPAN - 2
    assert len(got[3]) == 500 - K + 1 and len({a["hash"] for a in got[3]}) == 1
    assert [a["pos"] for a in got[5]] == [a["pos"] for a in got[6]] == [-1]


def edited(texts):
    out = {}
    ids = sorted(texts)
    for at, i in enumerate(ids):
        a, b = texts[i] or "", texts[ids[(at + 1) % len(ids)]] or ""
        half = len(a) // 2
        out[i] = (len(a), hashlib.sha256((a[: len(a) - half] + b[:half]).encode()).hexdigest())
    return out


def test_edited_texts_cross_all_ranges(docs_of, spark):
    texts = {i * 7 % 1009: f"text {i} " + "é😀 word" * (i % 9) for i in range(600)} | {2000: None, 2001: ""}
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    got = compare_with_next(docs_of(*texts.items(), extra="range guest anchors")).collect()
    assert {r["doc_id"]: (r["n_chars"], r["edited_sha256"]) for r in got} == edited(texts)
    assert len(got) == len(texts) and all(0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1 for r in got)


def test_one_row_and_odd_keys(docs_of):
    alone = compare_with_next(docs_of((5, "abcd"))).first()
    assert alone["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and alone["near_next"] == 1
    rows = compare_with_next(docs_of((None, "ab"), (None, "cd"), (1, "x"), (1, "x"), (1, "yy"))).collect()
    assert len(rows) == 5
    assert len({r["fingerprint"] for r in rows if r["n_chars"] == 1}) == 1
    assert compare_with_next(docs_of((1, "a")).where("false")).collect() == []
    assert len(compare_with_next(docs_of((None, "ab"))).collect()) == 1


def test_query(spark, sf):
    from terrascore.llm.registry import QUERIES

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op10_fingerprint_documents"](spark, sf).collect()
    assert {r["doc_id"]: (r["n_chars"], r["edited_sha256"]) for r in got} == edited(texts)
    equal = {}
    for r in got:
        assert equal.setdefault(texts[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
    nearer = sum(r["near_edited"] > r["near_next"] for r in got)
    assert nearer > 0.9 * len(got)
