"""Source mixing and rendezvous sharding, against SQL and plain Python."""

import re
import zlib

import pytest
from compare import check, duck

from terrascore.llm.mixing import mix_sources, mix_stage
from terrascore.llm.registry import QUERIES, SQL
from terrascore.llm.sharding import shard_rows


@pytest.mark.parametrize("key", sorted(SQL))
def test_queries_match_their_sql(spark, sf, key):
    assert check(spark, duck(sf), sf, key, QUERIES[key], SQL[key]) is None


def targets(sizes):
    """Targets by repeated resharing, the way the rule is told."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    out, open_ = {s: 0.0 for s in names}, set(names)
    budget = 1.5 * sum(sizes.values())
    while True:
        left = budget - sum(2 * sizes[s] for s in names if s not in open_)
        for s in open_:
            out[s] = left * weight[s] / sum(weight[t] for t in open_)
        over = {s for s in open_ if out[s] > 2 * sizes[s]}
        if not over:
            return out
        open_ -= over
        out |= {s: 2.0 * sizes[s] for s in over}


def test_mix_meets_targets(docs_of):
    texts = ["one two three", "a", "", None, "w " * 500, "x y z", "t\tt\nt"]
    rows = [(i, texts[i % len(texts)], "en", ("hot", "b", None, "c")[0 if i % 3 else i % 4]) for i in range(400)]
    got = mix_sources(docs_of(*rows, extra="size taken hash"), (5, 2, 1)).collect()
    assert len(got) == 400
    sizes, taken, largest = {}, {}, {}
    for r in got:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        largest[r["source"]] = max(largest.get(r["source"], 0), r["size"])
    want = targets(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
    for s, t in want.items():
        assert abs(taken[s] - t) <= largest[s] / 2 + 1e-6
    again = mix_sources(docs_of(*rows), (5, 2, 1), keep=["doc_id"]).collect()
    assert {r["doc_id"]: r["taken"] for r in again} == {r["doc_id"]: r["taken"] for r in got}


def test_thresholds_are_nested(docs_of):
    rows = [(i, "w " * (i % 7), "en", "s" + str(i % 3)) for i in range(300)]
    small, large = (
        {r["doc_id"]: r["repeats"] for r in mix_sources(docs_of(*rows), (1,), share).collect()} for share in (0.4, 0.7)
    )
    assert all(small[k] <= large[k] for k in small) and small != large


def test_mix_of_nothing(docs_of, spark):
    assert mix_sources(docs_of((1, "a")).where("false"), (5, 2, 1)).collect() == []
    only = mix_sources(docs_of((1, None), (2, "")), (5, 2, 1)).collect()
    assert [(r["target"], r["taken"]) for r in only] == [(0.0, 0), (0.0, 0)]


def test_mix_stage_repeats_documents(docs_of, spark):
    rows = [(i, "w " * 10, "en", "s" + str(i % 4)) for i in range(200)]
    docs = docs_of(*rows)
    out = mix_stage(spark, docs, "")
    assert out.columns == docs.columns
    counts = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    want = {r["doc_id"]: r["repeats"] for r in mix_sources(docs, (5, 2, 1)).collect() if r["repeats"]}
    assert counts == want


def test_shards_move_few_rows(docs_of):
    rows = [(i, ("é" * (i % 5)) if i % 11 else None) for i in range(2000)]
    got = shard_rows(docs_of(*rows, extra="slot"), [1.0] * 16, 1.0).collect()
    assert len(got) == 2000
    by_shard = {}
    for r in got:
        text = (r["text"] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(text) + 1, zlib.crc32(text))
        assert r["grown_shard"] in (r["shard"], 16)
        by_shard.setdefault(r["shard"], []).append(r["slot"])
    assert set(by_shard) == set(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    moved = sum(r["grown_shard"] == 16 for r in got)
    assert 2000 / 17 * 0.6 < moved < 2000 / 17 * 1.5


def test_shard_weights_and_odd_rows(docs_of, spark):
    rows = [(i, "t") for i in range(3000)]
    got = shard_rows(docs_of(*rows), [1.0, 3.0, 0.0]).groupBy("shard").count().collect()
    counts = {r["shard"]: r["count"] for r in got}
    assert set(counts) == {0, 1} and 0.2 < counts[0] / 3000 < 0.3
    odd = shard_rows(docs_of((None, "a"), (None, None), (7, "x"), (7, "x"), (7, "y")), [1.0] * 4).collect()
    assert len({r["shard"] for r in odd if r["doc_id"] == 7}) == 1
    for shard in {r["shard"] for r in odd}:
        slots = sorted(r["slot"] for r in odd if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert all(r["grown_shard"] is None for r in odd)
    assert shard_rows(docs_of((1, "a")).where("false"), [1.0]).count() == 0
    with pytest.raises(ValueError):
        shard_rows(docs_of((1, "a")), [0.0])


def test_columns_named_like_results_pass_the_stage(docs_of, spark):
    docs = docs_of((1, "a b c", "en", "x"), (2, "d e", "en", "x"), (3, "f", "en", None), extra="repeats size target taken row")
    out = mix_stage(spark, docs, "")
    assert out.columns == docs.columns and {r["repeats"] for r in out.collect()} == {"x"}
    mixed = mix_sources(docs, (5, 2, 1), keep=["doc_id", "row"])
    assert mixed.columns == ["doc_id", "row", "size", "source_size", "target", "repeats", "taken"] and mixed.count() == 3
