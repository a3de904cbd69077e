"""DartMinHash signatures and the banded join against brute force over all pairs."""

import random
from collections import Counter

import numpy as np
import regex

from terrascore.llm import neardup
from terrascore.llm.components import components


def bag(text):
    words = regex.sub(r"[^\p{L}\p{N}]+", " ", (text or "").lower()).split()
    n = max(1, len(words) - neardup.WORDS + 1) if words else 0
    return Counter(tuple(words[i : i + neardup.WORDS]) for i in range(n))


def jaccard(a, b):
    common = sum((a & b).values())
    return common / (sum(a.values()) + sum(b.values()) - common) if a and b else 0.0


def classes_by_brute_force(texts):
    """Components of all pairs of rows with at least the similarity, by union and find."""
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    bags, ids = {i: bag(t) for i, t in texts.items()}, sorted(texts)
    seen = {}
    for i in ids:
        for s in bags[i]:
            seen.setdefault(s, []).append(i)
    pairs = {(a, b) for found in seen.values() for a in found for b in found if a < b}
    links = {(a, b) for a, b in pairs if jaccard(bags[a], bags[b]) >= neardup.SIMILAR}
    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, links


def edited(words, r, times):
    words = list(words)
    for _ in range(times):
        words[r.randrange(len(words))] = f"new{r.randrange(10**9)}"
    return words


def planted():
    r = random.Random(4)
    texts, number = {}, 0
    for group in range(25):
        base = [f"w{r.randrange(4000)}" for _ in range(r.randrange(40, 400))]
        for copy in range(r.randrange(1, 9)):
            words = edited(base, r, copy % 4 * max(1, len(base) // 100)) if copy else base
            texts[number] = (" " if group % 2 else "\n").join(words).capitalize() + "!" * (copy % 2)
            number += 1
    hot = [f"h{r.randrange(500)}" for _ in range(120)]
    for copy in range(120):  # a third of all rows are near copies of one text
        texts[number] = " ".join(edited(hot, r, copy % 3))
        number += 1
    return texts


def test_classes_are_those_of_all_pairs(docs_of):
    texts = planted()
    got, links = neardup.near_duplicates(docs_of(*texts.items(), extra="class_id words id"))
    want, pairs = classes_by_brute_force(texts)
    assert {r["doc_id"]: r["class_id"] for r in got.collect()} == want
    for r in links.collect():
        assert (r["a"], r["b"]) in pairs
        assert abs(r["similarity"] - jaccard(bag(texts[r["a"]]), bag(texts[r["b"]]))) < 1e-9


def test_links_of_copies_of_copies_in_a_large_group(docs_of):
    r, number = random.Random(11), 1
    hub = [f"h{i}" for i in range(300)]
    texts = {0: " ".join(hub)}
    for _ in range(200):  # copies of the hub fill its buckets
        texts[number] = " ".join(edited(hub, r, 2))
        number += 1

    def at(words, places, name):
        return [f"{name}{i}" if i in places else w for i, w in enumerate(words)]

    for pair in range(30):  # one is close to the hub, and its copy resembles it alone
        first = at(hub, {150}, f"a{pair}x")
        second = at(first, {20, 60, 100, 200, 240, 280}, f"b{pair}x")
        texts[number], texts[number + 1] = " ".join(first), " ".join(second)
        number += 2
    want, pairs = classes_by_brute_force(texts)
    assert all((0, 201 + 2 * pair) in pairs and (0, 202 + 2 * pair) not in pairs for pair in range(30))
    got = neardup.near_duplicates(docs_of(*texts.items()))[0]
    assert {r["doc_id"]: r["class_id"] for r in got.collect()} == want


def test_signatures_estimate_weighted_similarity():
    r = random.Random(8)
    words = [f"w{r.randrange(60)}" for _ in range(500)]
    texts = [" ".join(words), " ".join(edited(words, r, 12)), " ".join(words[:350]), "a b c d e " * 30, "a b c d e " * 20, "one", ""]
    value, number = neardup.shingles([t.strip().encode() for t in texts])
    got = neardup.dart_signatures(value, number, 2000)
    for i, j in ((0, 1), (0, 2), (3, 4), (0, 5)):
        assert abs((got[i] == got[j]).mean() - jaccard(bag(texts[i]), bag(texts[j]))) < 0.04
    assert np.isfinite(got[:6]).all() and np.isinf(got[6]).all()
    assert list(number) == [sum(bag(t).values()) for t in texts]


def test_signature_does_not_depend_on_the_batch():
    a, b = b"the quick brown fox jumps over it", b"x y z x y z x y z x y z"
    alone = neardup.dart_signatures(*neardup.shingles([a]))
    both = neardup.dart_signatures(*neardup.shingles([b, b"", a]))
    assert (alone[0] == both[2]).all()


def test_odd_rows(docs_of):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, "!!"), (4, "same few"), (5, "Same, few!"), (None, long), (7, long), (7, long), (8, long + " tail"), (9, "z " * 50_000)]
    got = neardup.near_duplicates(docs_of(*rows))[0].collect()
    assert sorted((r["doc_id"] or 0, r["class_id"]) for r in got if r["doc_id"]) == [
        (1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (7, 7), (7, 7), (8, 7), (9, 9)]
    assert [r["class_id"] for r in got if r["doc_id"] is None] == [7]  # a row without an id is in the class of its text
    empty, links = neardup.near_duplicates(docs_of((1, "a")).where("false"))
    assert empty.collect() == [] and links.collect() == []


def test_stage_keeps_one_of_each_class(docs_of, spark):
    long = " ".join(f"w{i}" for i in range(60))
    docs = docs_of((1, None), (None, "kept"), (7, long), (7, long), (8, long + " tail"), (9, "other words here"))
    out = neardup.dedup_stage(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in out.collect()) == [0, 1, 7, 9]


def test_stage_loses_no_text_where_ids_repeat_or_are_missing(docs_of, spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, "one text of its own"), (1, "another text altogether"), (2, "a third text"), (None, long), (None, long + " tail"), (None, "no id here"),
            (None, "no id here"), (3, "No id; here!"), (4, ""), (4, ""), (5, None), (1, "Another text, altogether")]
    out = [(r["doc_id"], r["text"]) for r in neardup.dedup_stage(spark, docs_of(*rows, extra="mark copy copy_id id digest"), "").collect()]
    left = Counter(out)
    assert left[1, "one text of its own"] == 1 and left[2, "a third text"] == 1 and left[4, ""] == 2 and left[5, None] == 1
    assert left[1, "another text altogether"] + left[1, "Another text, altogether"] == 1
    assert left[None, long] + left[None, long + " tail"] == 1 and left[3, "No id; here!"] == 1 and left[None, "no id here"] == 0
    assert len(out) == 8


def test_a_large_bucket_is_split_into_leaves(docs_of, monkeypatch):
    monkeypatch.setattr(neardup, "LEAF", 24)
    monkeypatch.setattr(neardup, "FEW", 4)
    r, number = random.Random(12), 0
    hub, texts = [f"h{i}" for i in range(200)], {}
    for copy in range(160):  # many are too far from the hub, and near to a few others only
        words = edited(hub, r, 2 + copy % 12)
        for _ in range(r.randrange(1, 3)):
            texts[number] = " ".join(edited(words, r, 2))
            number += 1
    want, pairs = classes_by_brute_force(texts)
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs_of(*texts.items()))[0].collect()}
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.99 * len(pairs)
    assert all(want[i] == want[got[i]] for i in texts)


def test_stage_shuffles_no_text_that_stays(docs_of, spark):
    texts = [(i, f"text {i} has words {i * 7} of {i * 11} its {i * 13} own") for i in range(300)] + [(900, "Text 0 has words 0 of 0 its 0 own")]
    out = neardup.dedup_stage(spark, docs_of(*texts), "")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    stays, checked = plan.split("LeftAnti")[0], plan.split("LeftAnti")[1]
    assert "getbit" in stays and "getbit" in checked  # a row whose bit is not set meets no list
    assert {r["doc_id"] for r in out.collect()} == set(range(300))


def test_no_link_of_a_large_bucket_is_lost(docs_of, monkeypatch):
    monkeypatch.setattr(neardup, "LEAF", 24)
    monkeypatch.setattr(neardup, "FEW", 4)
    r, number = random.Random(21), 0
    hub, texts = [f"h{i % 90}" for i in range(120)], {}  # with shingles that occur twice
    for _ in range(40):
        texts[number] = " ".join(edited(hub, r, 1))
        number += 1
    for _ in range(250):  # unlike the hub, and like one other text, as little as can be
        first = edited(hub, r, 6)
        second = edited(first, r, 2) + first[-(r.randrange(8)):]
        texts[number], texts[number + 1] = " ".join(first), " ".join(second)
        number += 2
    want, pairs = classes_by_brute_force(texts)
    assert len({want[i] for i in range(40, number)}) > 200 and len(pairs) > 300
    got = neardup.near_duplicates(docs_of(*texts.items()))[0]
    assert {r["doc_id"]: r["class_id"] for r in got.collect()} == want


def test_links_of_a_leaf_join_what_brute_force_joins():
    r = random.Random(13)
    for _ in range(40):
        base = [f"w{r.randrange(60)}" for _ in range(50)]
        texts = {i: " ".join(edited(base, r, r.randrange(6))) for i in range(12)}
        value, count = neardup.shingles([t.encode() for t in texts.values()])
        cuts = np.cumsum([0, *count])
        bags = [np.sort((value[a:b] >> np.uint64(32)).astype(np.uint32)).tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
        want, pairs = classes_by_brute_force(texts)
        root = {i: i for i in texts}
        for a, b, similarity in neardup.leaf_links(list(texts), bags, neardup.SIMILAR):
            assert abs(similarity - jaccard(bag(texts[a]), bag(texts[b]))) < 1e-9
            x, y = root[a], root[b]
            root = {i: min(x, y) if v in (x, y) else v for i, v in root.items()}
        assert root == want


def test_components_of_a_long_chain(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(5, 9), (9, 5), (3, 9)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in (3, 5, 9)} == {3}


def test_query(spark, sf):
    from terrascore.llm.registry import QUERIES

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r["class_id"] for r in QUERIES["op3_near_duplicates"](spark, sf).collect()}
    assert got == classes_by_brute_force(texts)[0]
