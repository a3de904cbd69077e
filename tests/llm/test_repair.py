"""Repair of conversations against every sequence of edits, and against a plain table of costs."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from terrascore.llm import repair
from terrascore.llm.registry import QUERIES

GOOD = re.compile("(s?(ua)+)?")
WHITE = "\t\n\x0b\x0c\r "


def faults(rows):
    out, seen = [], set()
    for role, text in rows:
        body = text.rstrip(WHITE)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def best_of_all(rows):
    """Every choice of an edit for each row and of up to two inserts around each, for a few rows."""
    found, best = faults(rows), None
    edits = [[("D", "", 4)] if f in ("blank", "duplicate") else
             [("D", "", 4), ("K", r[0][:1] or "?", 3 * (f == "truncated")), ("R", "u", 3 + 3 * (f == "truncated")), ("R", "a", 3 + 3 * (f == "truncated"))]
             for r, f in zip(rows, found, strict=True)]
    inserts = [("", "", 0), ("I", "u", 3), ("I", "a", 3), ("II", "ua", 6), ("II", "au", 6)]
    for chosen in product(*edits):
        for gaps in product(inserts, repeat=len(rows) + 1):
            parts = [gaps[0]] + [x for e, g in zip(chosen, gaps[1:], strict=True) for x in (e, g)]
            if GOOD.fullmatch("".join(p[1] for p in parts)):
                way = (sum(p[2] for p in parts), "".join(p[0] for p in parts))
                best = min(best or way, way)
    return best


def best_by_table(rows):
    """The cheapest and least audit for each state after each row, whole strings kept."""
    step = {"": "u", "s": "u", "u": "a", "a": "u"}

    def widened(ways):
        for _ in range(2):
            for s, (cost, audit, texts) in list(ways.items()):
                way = (cost + 3, audit + "I", texts + ({"u": "user:", "a": "assistant:"}[step[s]],))
                ways[step[s]] = min(ways.get(step[s], way), way)
        return ways

    ways = {"": (0, "", ())}
    for (role, text), fault in zip(rows, faults(rows), strict=True):
        now = {}
        for s, (cost, audit, texts) in widened(dict(ways)).items():
            options = [(s, cost + 4, "D", texts)]
            if fault in ("", "truncated"):
                extra = 3 * (fault == "truncated")
                options.append((step[s], cost + 3 + extra, "R", (*texts, {"u": "user:", "a": "assistant:"}[step[s]] + text)))
                if role[:1] == step[s] or (s == "" and role[:1] == "s"):
                    options.append((role[:1], cost + extra, "K", (*texts, f"{role}:{text}")))
            for t, c, edit, out in options:
                now[t] = min(now.get(t, (c, audit + edit, out)), (c, audit + edit, out))
        ways = now
    ways = widened(ways)
    return min(ways[s] for s in ("", "a") if s in ways)


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def expected(rows):
    after, out = damaged(rows), {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in after if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        turns = [r[1] for r in mine if r[1] is not None]
        pairs = [r[2:] for r in mine]
        found = faults(pairs)
        initials = [r[:1] for r, _ in pairs]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit, texts = best_by_table(pairs)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(found.count(k) for k in ("blank", "duplicate", "truncated")),
                     illegal, cost, audit, hashlib.sha256("\n".join(texts).encode()).hexdigest())
    return out


def got_of(spark, folder):
    got = QUERIES["op13_repair_conversations"](spark, folder)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = [tuple(r) for r in got.collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:] for r in rows}


def code(role, fault):
    return 4 * {"s": 0, "u": 1, "a": 2}.get(role[:1], 3) + {"": 0, "blank": 1, "duplicate": 2, "truncated": 3}[fault]


def solved(rows, cut=None):
    """Cost and audit by halves, over segments of ``cut`` rows."""
    codes = [code(r, f) for (r, _), f in zip(rows, faults(rows), strict=True)]
    parts = [codes[i : i + (cut or len(codes))] for i in range(0, len(codes), cut or len(codes))]
    summaries = []
    for part in parts:
        summary = []
        for start in range(4):
            least, costs, ranks = repair.reached(part, start)
            summary += [least, *(-1 if x is None else x for x in (*costs, *ranks))]
        summaries.append([*summary, 0, 0, 0])
    ends, cost, _ = repair.joined(summaries)
    return cost, "".join(repair.rebuilt(p, *e) for p, e in zip(parts, ends, strict=True)) + repair._END[ends[-1][1]][1]


def random_rows(r, n):
    roles = ["user", "assistant", "system", "tool", ""]
    texts = ["Yes.", "no", "", "What? ", "cut off", "a!", "b.", "c.", "d", "\x0b"]
    return [(r.choice(roles[: r.choice([2, 3, 5])]), r.choice(texts)) for _ in range(n)]


def test_least_of_the_cheapest_of_all_edits():
    r = random.Random(1)
    for n in (1, 2, 3):
        for _ in range(60 if n < 3 else 25):
            rows = random_rows(r, n)
            assert solved(rows) == best_of_all(rows) == best_by_table(rows)[:2], rows


@pytest.mark.parametrize("cut", [None, 1, 2, 7])
def test_halves_and_segments_give_the_table_s_audit(cut):
    r = random.Random(2)
    for _ in range(300):
        rows = random_rows(r, r.randrange(1, 40))
        assert solved(rows, cut) == best_by_table(rows)[:2], rows


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got_of(spark, sf) == expected(rows)


def test_odd_rows_and_a_hot_conversation_in_segments(spark, frame, monkeypatch):
    monkeypatch.setattr(repair, "SEGMENT", 16)
    r = random.Random(5)
    rows = [(c, t, *x) for c in range(40) for t, x in enumerate(random_rows(r, r.randrange(1, 9)))]
    rows += [(99, t, ("user", "assistant")[t % 2], f"text {t % 300}" + "." * (t % 3 > 0)) for t in range(700)]  # a third of all rows and more
    rows += [(None, 1, "user", "Hello."), (None, None, None, None), (50, None, "user", None), (50, None, None, "Yes."), (50, -(1 << 63), "assistant", "a."),
             (50, (1 << 62) - 1, "assistant", "b."), (51, 3, "user", "same."), (51, 3, "user", "same."), (52, 0, "user", "x" * 300_000 + ".")]
    # of one conversation nothing is left
    gone = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((gone, 0, "user", "Lost."))
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr(
        "*", "'x' as conv", "1 as pos", "'y' as audit", "2 as place", "0 as head")
    got, want = got_of(spark, frame(conversations=table)), expected(rows)
    want[50] = (min(want[50][0], (1 << 63) - 1), *want[50][1:])
    assert got == want
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got_of(spark, frame(conversations=table.where("false"))) == {}


def test_repaired_rows(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "Well?"), (2, 0, "system", "Rules."), (2, 1, "user", ""), (2, 2, "user", "So.")]
    report, repaired = repair.repair_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {r["conv"]: (r["cost"], r["audit"]) for r in report.collect()} == {1: (6, "IKKI"), 2: (7, "KDKI")}
    assert sorted((r["conv"], r["place"], r["edit"], r["role"], r["text"], r["turn"]) for r in repaired.collect()) == [
        (1, 0, "I", "user", "", None), (1, 1, "K", "assistant", "Hi.", 0), (1, 2, "K", "user", "Well?", 1), (1, 3, "I", "assistant", "", None),
        (2, 0, "K", "system", "Rules.", 0), (2, 1, "K", "user", "So.", 2), (2, 2, "I", "assistant", "", None)]
