"""Find secrets in texts: stated patterns, and random strings by their token efficiency.

Text that people write falls into few, long tokens of a byte-pair vocabulary; a random
string falls into many short ones. Among runs of the characters that keys are made of,
those with few characters for each token, as a whole or over a stretch, are reported as
``random``, after what is known not to be secret has been left out: digests of the usual
lengths, UUIDs, and identifiers, that is words, paths, dates and numbers joined by
separators.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cache
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrascore.llm.base import batch_rows, slices, table, text_or_empty
from terrascore.llm.registry import query

#: The stated patterns, by kind, with the group and the least length that a match needs.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ACCESS = re.compile("AKIA[A-Z0-9]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
# a run of the class is taken whole, so asking for the least length at once finds the same runs
LONG_HEX = re.compile(f"[0-9a-f]{{{HEX_LEAST},}}")
#: Lengths of hexadecimal digests in common use.
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)

#: Candidates for random strings: their least length, and the characters per token below which they are reported.
RANDOM_LEAST, RATIO, BLOCK = 20, 2.0, 1024
_RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{RANDOM_LEAST},}}")
_UUID = re.compile("[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}")
# a word as long as a candidate may be random
_LETTERS = f"{{1,{RANDOM_LEAST - 1}}}(?![A-Za-z])"
_PART = rf"(?:[A-Z]?[a-z]{_LETTERS}|[A-Z]{_LETTERS}|[0-9]{{1,8}})"
_WORDS = re.compile(rf"[-_/+=]*{_PART}(?:[-_/+=]+{_PART})*[-_/+=]*")  # words and numbers between separators
_DIGEST = "|".join(f"[0-9A-Fa-f]{{{n}}}" for n in DIGEST_LENGTHS)
_INNER = re.compile(rf"(?<![A-Za-z0-9])(?:{_UUID.pattern}|{_DIGEST})(?![A-Za-z0-9])")  # UUIDs and digests within a run
_SEPARATOR = re.compile("[-_/+=]")
_CAMEL = re.compile(r"[a-z]*(?:[A-Z][a-z]{2,})+[0-9]{0,4}")


def is_known(run: str) -> bool:
    """A digest, a UUID or an identifier: nothing to report, however it falls into tokens."""
    if len(run) in DIGEST_LENGTHS and all(c in "0123456789abcdef" for c in run.lower()):
        return True
    return bool(_UUID.fullmatch(run) or _WORDS.fullmatch(run) or _CAMEL.fullmatch(run))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the stated patterns: leftmost matches that do not overlap within a kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(out)


def random_spans(text: str, sizes, taken: list[tuple[int, int, int]], ratio: float = RATIO) -> list[tuple[int, int, int]]:
    """(start, kind, end) of stretches of runs with fewer than ``ratio`` characters per token; ``taken`` spans are cut out.

    ``sizes`` gives the lengths of the tokens of a string. A run is measured whole, in
    blocks, and where that does not report it, stretch by stretch.
    """
    cut: list[tuple[int, int]] = []
    for s, _, e in taken:  # as spans apart from each other
        if cut and s <= cut[-1][1]:
            cut[-1] = (cut[-1][0], max(e, cut[-1][1]))
        else:
            cut.append((s, e))
    out, at = [], 0
    for m in _RUN.finditer(text):
        while at < len(cut) and cut[at][1] <= m.start():
            at += 1
        last = at
        while last < len(cut) and cut[last][0] < m.end():
            last += 1
        for start, end in _rest(m.start(), m.end(), cut[at:last]):
            run = text[start:end]
            if is_known(run):
                continue
            tokens = _sizes(run, sizes)
            if len(run) / len(tokens) < ratio:
                out.append((start, 3, end))
                continue
            for a, b in _rest(0, len(run), [x.span() for x in _INNER.finditer(run)]):
                found = tokens if b - a == len(run) else _sizes(run[a:b], sizes)
                out += [(start + a + s, 3, start + a + e) for s, e in _stretches(run[a:b], found, ratio)]
    return out


def _sizes(run: str, sizes) -> list[int]:
    return [n for at in range(0, len(run), BLOCK) for n in sizes(run[at : at + BLOCK])]


def _rest(start: int, end: int, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What sorted spans leave of ``start`` to ``end``, if long enough for a random string."""
    for s, e in taken:
        if s < end and start < e:
            if s - start >= RANDOM_LEAST:
                yield start, s
            start = max(start, e)
    if end - start >= RANDOM_LEAST:
        yield start, end


def _stretches(run: str, tokens: list[int], ratio: float) -> list[tuple[int, int]]:
    """Stretches where windows of tokens, as short as a random string may be, have fewer than ``ratio`` characters a token.

    A stretch goes on to the separators around it, so that no end of a key is left.
    """
    ends = [0, *accumulate(tokens)]
    found, j = [], 0
    for i in range(len(tokens)):
        while j < len(tokens) and ends[j] - ends[i] < RANDOM_LEAST:
            j += 1
        if ends[j] - ends[i] < RANDOM_LEAST:
            break
        if ends[j] - ends[i] < ratio * (j - i):
            if found and ends[i] <= found[-1][1]:
                found[-1] = (found[-1][0], ends[j])
            else:
                found.append((ends[i], ends[j]))
    if not found:
        return []
    cuts = [x.start() for x in _SEPARATOR.finditer(run)]
    wide: list[tuple[int, int]] = []
    for s, e in found:
        before, after = bisect_right(cuts, s), bisect_left(cuts, e)
        s = cuts[before - 1] + 1 if before else 0
        e = cuts[after] if after < len(cuts) else len(run)
        if wide and s <= wide[-1][1]:
            wide[-1] = (wide[-1][0], max(e, wide[-1][1]))
        else:
            wide.append((s, e))
    return [(s, e) for s, e in wide if not is_known(run[s:e])]


def read_ranks(path: str) -> bytes:
    """A vocabulary file of ranks, under a few MB: it is sent to the tasks as it is."""
    with open(path, "rb") as file:
        return file.read()


@cache
def _encoding(content: bytes, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def find_secrets(
    rows: DataFrame, path: str, pattern: str, text: str = "text", keep: list[str] | None = None, redact: bool = False
) -> DataFrame:
    """``rows`` (or their columns ``keep``) with counts, a digest and the spans of secrets.

    ``n_assign``, ``n_access`` and ``n_hex`` count the stated patterns, ``n_random`` the
    stretches of runs that token efficiency adds; ``base_sha256`` is the digest of the stated spans
    and ``spans`` lists all, each as ``kind:start:end`` in code points, end exclusive,
    by start and then kind, joined by commas. An added span never overlaps a stated
    one. With ``redact``, ``redacted`` is the text with every span (overlapping ones
    together) replaced by ``<secret>``. A null text is empty and has no spans.
    Columns of ``rows`` with a result's name are replaced.
    """
    made = "n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"
    made += ", redacted string" if redact else ""
    names = [f.split(" ")[0] for f in made.split(", ")]
    kept = [c for c in (rows.columns if keep is None else keep) if c not in names]
    sent = rows.sparkSession.sparkContext.broadcast(read_ranks(path))
    batch_rows(rows.sparkSession)
    body = "__text_to_scan"
    source = rows.select(*[F.col(f"`{c}`") for c in kept], text_or_empty(f"`{text}`").alias(body))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(sent.value, pattern)

        def sizes(run: str) -> list[int]:
            return list(map(len, encoding.decode_tokens_bytes(encoding.encode_ordinary(run))))

        for batch in slices(batches, body):
            out = []
            for value in batch.column(batch.num_columns - 1).to_pylist():
                base = base_spans(value)
                spans = sorted(chain(base, random_spans(value, sizes, base)))
                counts = [sum(k == kind for _, k, _ in spans) for kind in range(len(KINDS))]
                digest = hashlib.sha256(_listed(base).encode()).hexdigest()
                out.append((*counts, digest, _listed(spans), *([replaced(value, spans)] if redact else ())))
            columns = [pa.array(c) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(batch.num_columns - 1)] + columns, [*kept, *names])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]]
    return source.mapInArrow(run, ", ".join([*fields, made]))


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def replaced(text: str, spans: list[tuple[int, int, int]], by: str = "<secret>") -> str:
    """The text with sorted spans replaced; spans that overlap are replaced as one."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], by]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def ranks_file() -> tuple[str, str]:
    """Path and splitting pattern of the query's vocabulary, from the installed package of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@query("op7_scan_secrets")
def op7_scan_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find_secrets(docs, *ranks_file(), keep=["doc_id"])


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced, and their length brought up to date; documents without any stay as they are."""
    found = find_secrets(docs, *ranks_file(), redact=True)
    hit = F.col("spans") != ""
    columns = {
        "text": F.when(hit, F.col("redacted")).otherwise(F.col("text")),
        "n_chars": F.when(hit, F.char_length("redacted").cast("long")).otherwise(F.col("n_chars")),
    }
    return found.select(*[columns.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
