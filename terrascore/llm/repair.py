"""Repair the structure of conversations at the least cost, by Hirschberg's divide and conquer.

A repaired conversation is empty, or an optional system turn and then user and assistant
in turn. A state machine of four states reads it: nothing yet, after system, after user,
after assistant. An edit keeps, reroles or deletes a row or inserts an empty turn; the
edits' initials in order are the audit.

Instead of a table of decisions for every row and state, vectors of four costs go forward
from the start and backward from the end and meet in the middle: the best crossing splits
the rows in two halves with known ends, and each is solved alike. A forward vector also
ranks the least audits that reach its states, and of equally cheap crossings the least one is
taken. (An audit up to a row ends with that row's edit, so none is the beginning of
another; hence the least whole audit begins with the least audit up to any crossing.)

Rows are dealt into ranges of conversation and turn, and a conversation into segments of
bounded length. A segment is summed up by what it costs to get from each state to each
other, the segments of a conversation are joined by those, and every segment is then
rebuilt between its known ends, by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrascore.llm.base import slices, stage, table
from terrascore.llm.registry import query

#: What edits cost, and what a truncated row adds that is not deleted.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows of a segment, at most; a power of two, so that segments end where ranges end.
SEGMENT = 1 << 16
WHITE = "\t\n\x0b\x0c\r "
BLANK, DUPLICATE, CUT = 1, 2, 3  # faults, 0 is none
NOTHING, SYSTEM, USER, ASSISTANT = range(4)  # states
_NEXT = (USER, USER, ASSISTANT, USER)
_INITIALS = "sua"
_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
#: What is left to pay at the end, and the inserts that pay it.
_END = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))
#: From no state can the rest cost more than from another by as much as this: two inserts and a deletion bridge any two.
_FAR = 2 * INSERT + DELETE


def _steps(initial: int, fault: int) -> list[list[tuple[int, int, str]]]:
    """The ways over a row by the state after it: state before, cost, and edits; inserts come before the row's own edit."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for before in range(4):
        state, inserted = before, ""
        for _ in range(3):
            extra = TRUNCATED if fault == CUT else 0
            ways = [(state, DELETE, "D")]
            if fault in (0, CUT):
                ways.append((_NEXT[state], REROLE + extra, "R"))
                if initial + 1 == _NEXT[state] or (initial, state) == (0, NOTHING):
                    ways.append((initial + 1, extra, "K"))
            for after, cost, edit in ways:
                way = (cost + INSERT * len(inserted), inserted + edit)
                best[before, after] = min(best.get((before, after), way), way)
            state, inserted = _NEXT[state], inserted + "I"
    return [[(s, *way) for (s, after), way in best.items() if after == t] for t in range(4)]


STEPS = [_steps(code // 4, code % 4) for code in range(16)]
Costs = tuple[int | None, ...]


@lru_cache(1 << 16)
def _forward(costs: Costs, ranks: Costs, code: int) -> tuple[int, Costs, Costs]:
    """Costs and ranks of states after a row from those before it; the least cost apart, and states that can't be best gone."""
    found = [min(((costs[s] + c, ranks[s], edits) for s, c, edits in ways if costs[s] is not None), default=None) for ways in STEPS[code]]
    least = min(f[0] for f in found if f)
    found = [f if f and f[0] - least <= _FAR else None for f in found]
    order = sorted((f[1:], t) for t, f in enumerate(found) if f)
    place = {t: n for n, (_, t) in enumerate(order)}
    return least, tuple(f and f[0] - least for f in found), tuple(place.get(t) for t in range(4))


@lru_cache(1 << 16)
def _backward(costs: Costs, code: int) -> tuple[int, Costs]:
    """Costs to the end from the states before a row, from those after it; the least apart."""
    found: list[int | None] = [None] * 4
    for t, ways in enumerate(STEPS[code]):
        if costs[t] is not None:
            for s, c, _ in ways:
                found[s] = c + costs[t] if found[s] is None else min(found[s], c + costs[t])
    least = min(f for f in found if f is not None)
    return least, tuple(f if f is None else f - least for f in found)


def _only(state: int) -> Costs:
    return tuple(0 if s == state else None for s in range(4))


def reached(codes: Sequence[int], start: int, a: int = 0, b: int | None = None) -> tuple[int, Costs, Costs]:
    """What rows ``a`` to ``b`` cost from ``start``: the least cost, what each state costs beyond it, and the ranks of their audits."""
    total, costs, ranks = 0, _only(start), _only(start)
    for at in range(a, len(codes) if b is None else b):
        least, costs, ranks = _forward(costs, ranks, codes[at])
        total += least
    return total, costs, ranks


def rebuilt(codes: Sequence[int], start: int, end: int) -> str:
    """The least of the cheapest audits of rows from one state to another."""
    out: list[str] = []
    open_parts = [(0, len(codes), start, end)]
    while open_parts:
        a, b, s, t = open_parts.pop()
        if b - a == 1:
            out.append(min((cost, edits) for before, cost, edits in STEPS[codes[a]][t] if before == s)[1])
        elif b > a:
            middle = (a + b) // 2
            _, ahead, ranks = reached(codes, s, a, middle)
            back = _only(t)
            for at in range(b - 1, middle - 1, -1):
                _, back = _backward(back, codes[at])
            crossing = min((ahead[x] + back[x], ranks[x], x) for x in range(4) if ahead[x] is not None and back[x] is not None)[2]
            open_parts += [(middle, b, crossing, t), (a, middle, s, crossing)]
    return "".join(out)


def _transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A segment's summary: for each state before it the least cost, and 4 costs and 4 ranks (-1: out of reach); then its initials."""
    for batch in batches:
        out = []
        for codes in batch.column(2).to_pylist():
            summary: list[int] = []
            for start in range(4):
                least, costs, ranks = reached(codes, start)
                summary += [least, *(-1 if x is None else x for x in (*costs, *ranks))]
            initials = [(_INITIALS + "?")[c // 4] for c in codes]
            illegal = sum(pair not in _LEGAL for pair in zip(initials, initials[1:], strict=False))
            out.append([*summary, codes[0] // 4, codes[-1] // 4, illegal])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], ["conv", "head", "summary"])


def joined(segments: Sequence[Sequence[int]]) -> tuple[list[tuple[int, int]], int, int]:
    """States before and after every segment on the way whose audit is the least of the cheapest, its cost, and illegal pairs."""
    costs: list[int | None] = list(_only(NOTHING))
    ranks: list[int | None] = list(_only(NOTHING))
    came: list[list[int | None]] = []
    for summary in segments:
        found: list[tuple[int, int, int, int] | None] = [None] * 4
        for s in range(4):
            if costs[s] is None:
                continue
            least, far, rank = summary[9 * s], summary[9 * s + 1 : 9 * s + 5], summary[9 * s + 5 : 9 * s + 9]
            for t in range(4):
                if far[t] >= 0:
                    way = (costs[s] + least + far[t], ranks[s], rank[t], s)
                    found[t] = way if found[t] is None else min(found[t], way)
        order = sorted((f[1:3], t) for t, f in enumerate(found) if f)
        place = {t: n for n, (_, t) in enumerate(order)}
        costs, ranks = [f and f[0] for f in found], [place.get(t) for t in range(4)]
        came.append([f and f[3] for f in found])
    cost, _, state = min((costs[t] + _END[t][0], ranks[t], t) for t in range(4) if costs[t] is not None)
    ends = []
    for back in reversed(came):
        ends.append((back[state], state))
        state = back[state]
    pairs = zip([s[-2] for s in segments], [s[-3] for s in segments[1:]], strict=False)
    between = sum(((_INITIALS + "?")[x], (_INITIALS + "?")[y]) not in _LEGAL for x, y in pairs)
    return ends[::-1], cost, between + sum(s[-1] for s in segments)


def _crossings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        convs, out = [], []
        for at, parts in enumerate(batch.column(1).to_pylist()):
            ends, cost, illegal = joined([p["summary"] for p in parts])
            for n, (part, (start, end)) in enumerate(zip(parts, ends, strict=True)):
                last = n == len(parts) - 1
                convs.append(at)
                out.append((part["head"], start, end, last, cost if last else 0, illegal if last else 0))
        columns = [pa.array(c, t) for c, t in zip(
            zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(convs)), *columns], ["conv", "head", "start", "end", "last", "cost", "illegal"])


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes, start, end, last = (batch.column(i).to_pylist() for i in range(4))
        audits = [rebuilt(c, s, e) + (_END[e][1] if final else "") for c, s, e, final in zip(codes, start, end, last, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[4:], pa.array(audits, pa.string())], [*batch.schema.names[4:], "audit"])


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired rows from rows in order, each segment's after its audit; nothing but the audit is held."""
    audit, at, state, place = "", 0, NOTHING, 0
    for batch in slices(batches, "text"):
        taken, out = [], []

        def insert(row: int) -> None:
            nonlocal at, state, place
            while at < len(audit) and audit[at] == "I":
                state, at = _NEXT[state], at + 1
                taken.append(row)
                out.append((place, "I", None, ("user", "assistant")[state == ASSISTANT], ""))
                place += 1

        columns = [batch.column(i).to_pylist() for i in range(1, 7)]
        for row, (found, start, first, turn, role, text) in enumerate(zip(*columns, strict=True)):
            if found is not None:
                audit, at, state, place = found, 0, start, 0 if first else place
                continue
            insert(row)
            edit, at = audit[at], at + 1
            if edit != "D":
                initial = _INITIALS.find(role[:1]) + 1 if edit == "K" else _NEXT[state]
                state = initial
                taken.append(row)
                out.append((place, edit, turn, role if edit == "K" else ("user", "assistant")[state == ASSISTANT], text))
                place += 1
            rest = at
            while rest < len(audit) and audit[rest] == "I":
                rest += 1
            if rest == len(audit):  # what no row follows is the end
                insert(row)
        if out:
            types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string())
            made = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(taken)), *made], ["conv", "place", "edit", "turn", "role", "text"])


def _or_space(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(" "))


def repair_conversations(
    rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """What is wrong with each conversation and how it is repaired, and the repaired rows.

    The first frame has for every ``conv`` of ``rows``: ``gaps`` (missing turn numbers), the rows
    whose first fault is to be ``blank``, ``duplicate`` (role and text seen earlier) or
    ``truncated`` (no ``.``, ``!`` or ``?`` at the end), ``illegal`` (adjacent rows whose
    roles can't follow each other), the ``cost`` of the repair and its ``audit``. The
    second has ``conv, place, edit, turn, role, text``, in the order of ``conv`` and ``place`` within its
    partitions, a conversation in one; inserted rows have no turn.

    Rows are in the order of their turns, nulls first; of one turn, by role, the first 64
    characters of the text, and a digest of both. Null roles and texts are one space. A row
    whose role starts with none of ``s``, ``u`` and ``a`` can't be kept.
    Null keys are one conversation. Turns are longs; a count of gaps beyond a long is the
    largest long. An empty table gives no rows.

    A conversation is split over as many tasks as its rows need; only its audit, one
    character for a row and an inserted turn, and the reading of its repaired rows one after the other are in one
    task, which holds a segment's audit and a few texts at a time.
    """
    plain = rows.select(
        F.col(f"`{key}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), _or_space(role).alias("role"),
        _or_space(text).alias("text"), F.monotonically_increasing_id().alias("tie"))
    trimmed = F.rtrim(F.col("text"), F.lit(WHITE))
    fault = F.when(trimmed == "", BLANK).when(F.right(trimmed, F.lit(1)).isin(".", "!", "?"), 0).otherwise(CUT)
    initial = F.substring("role", 1, 1)
    numbered = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    digest = F.unhex(F.sha2(F.concat_ws(":", F.char_length("role"), "role", "text"), 256))
    order = ["conv", "turn", "by_role", "by_text", "digest", "tie"]
    dealt = plain.select(
        "*", F.substring("role", 1, 64).alias("by_role"), F.substring("text", 1, 64).alias("by_text"), digest.alias("digest"),
        fault.alias("fault"), numbered.alias("initial"),
    ).repartitionByRange(*order).sortWithinPartitions(*order)
    # the number of a range in the upper bits, that of its row in the lower: numbers follow the order
    staged = stage(dealt.select("conv", "turn", "role", "text", "digest", "fault", "initial", F.monotonically_increasing_id().alias("pos")), "rows")

    firsts = staged.where(F.col("fault") != BLANK).groupBy("conv", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    seen = (F.col("fault") != BLANK) & F.col("first").isNull()
    coded = stage(staged.select("conv", "pos", "turn", "fault", "initial").join(firsts, "pos", "left").select(
        "conv", "pos", "turn", "initial", F.when(seen, DUPLICATE).otherwise(F.col("fault")).alias("fault")), "coded")
    parts = coded.groupBy("conv", F.expr(f"pos div {SEGMENT}")).agg(
        F.min("pos").alias("head"),
        F.sort_array(F.collect_list(F.struct("pos", (F.col("initial") * 4 + F.col("fault")).alias("code")))).getField("code").alias("codes"))
    segments = stage(parts.select("conv", "head", "codes"), "segments")

    key_type = segments.schema["conv"].dataType.simpleString()
    summed = segments.mapInArrow(_transfers, f"conv {key_type}, head long, summary array<long>")
    ways = summed.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("head", "summary"))).alias("parts")).mapInArrow(
        _crossings, f"conv {key_type}, head long, start int, end int, last boolean, cost long, illegal long")
    audits = stage(segments.select("head", "codes").join(ways, "head").select(
        "codes", F.col("start").alias("from"), F.col("end").alias("to"), "last", "conv", "head", "start", "cost", "illegal").mapInArrow(
        _audits, f"conv {key_type}, head long, start int, cost long, illegal long, audit string"), "audits")

    # turns first, so that a conversation's rows are combined before they are counted
    turns = coded.groupBy("conv", "turn").agg(*[
        F.count_if(F.col("fault") == kind).alias(name) for name, kind in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", CUT))])
    span = (F.max("turn").cast("decimal(20,0)") - F.min("turn") + 1 - F.count("turn"))
    faults = turns.groupBy("conv").agg(
        F.least(F.coalesce(span, F.lit(0)), F.lit((1 << 63) - 1)).cast("long").alias("gaps"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    whole = audits.groupBy("conv").agg(
        F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"),
        F.array_join(F.sort_array(F.collect_list(F.struct("head", "audit"))).getField("audit"), "").alias("audit"))
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    report = faults.unionByName(whole, allowMissingColumns=True).groupBy("conv").agg(
        *[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in numbers], F.coalesce(F.max("audit"), F.lit("")).alias("audit"))

    heads = audits.select("conv", F.col("head").alias("pos"), "audit", "start")
    first = F.col("start") == NOTHING
    lines = heads.unionByName(staged.select("conv", "pos", "turn", "role", "text"), allowMissingColumns=True)
    in_order = lines.repartition("conv").sortWithinPartitions("conv", "pos", F.col("audit").isNull())
    repaired = in_order.select("conv", "audit", "start", first.alias("first"), "turn", "role", "text").mapInArrow(
        _applied, f"conv {key_type}, place long, edit string, turn long, role string, text string")
    return report, repaired


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with planted faults, by a checksum of conversation and turn; of ``rows``, nulls as one space."""
    plain = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), _or_space("role").alias("role"), _or_space("text").alias("text"),
        F.expr("crc32(concat(coalesce(string(conv_id), ' '), ':', coalesce(string(turn), ' '))) % 20").alias("kind"))
    return plain.where("kind != 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each conversation's lines, from rows in order, one line at a time."""
    conv, running = None, None
    for batch in batches:
        done = []
        for first, key, role, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if first == 0:
                if running:
                    done.append((conv, running.hexdigest()))
                conv, running = key, hashlib.sha256()
            running.update(f"{chr(10) if first else ''}{role}:{text}".encode())
        if done:
            yield _digests(done, batch.schema.field(1).type)
        kind = batch.schema.field(1).type
    if running:
        yield _digests([(conv, running.hexdigest())], kind)


def _digests(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (kind, pa.string()), strict=True)], ["conv", "repaired_sha256"])


@query("op13_repair_conversations")
def op13_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    report, repaired = repair_conversations(damaged(rows))
    key = rows.schema["conv_id"].dataType.simpleString()
    digests = repaired.select("place", "conv", "role", "text").mapInArrow(_digested, f"conv {key}, repaired_sha256 string")
    every = rows.select(F.col("conv_id").alias("conv")).distinct()
    one = report.unionByName(digests, allowMissingColumns=True).unionByName(every, allowMissingColumns=True).groupBy("conv").agg(
        *[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
    return one.withColumnRenamed("conv", "conv_id")
