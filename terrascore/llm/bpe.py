"""Byte-pair encoding as a bounded-lookahead streaming transducer, and its decoder.

**Lookahead.** A merge can only be kept from happening by an earlier merge that takes
the last symbols of its right part together with what follows. That one can in turn
be kept from happening further to the right, by a still earlier one. Each step of
such a chain goes at most over the right part of its merge, so the longest chain in
the merge list (found once per vocabulary, going through the merges in order) bounds
how far text on the right can change what stands on the left: its *sufficient
lookahead*. Tokens that end that many symbols before the end of what has been read
are final.

**Transducer.** A piece is fed symbol by symbol into a buffer. When it holds twice the
lookahead, the buffer is merged, its stable tokens are emitted and only the rest is
kept: no merge crosses the end of a final token, so the rest goes on by itself. State
is bounded, however long a piece is.

The normaliser, the splitting pattern and the special tokens are those of the
tokenizer file: NFC, runs of white space to one blank, lower case by character; pieces are the contractions, runs of letters, single
digits, and runs of anything else but white space; special tokens are found in the
raw text first.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import cache
from heapq import heapify, heappop, heappush
from itertools import islice, repeat
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrascore.llm.base import batch_rows, slices, table, text_or_empty
from terrascore.llm.registry import query

#: Suffix contractions that the tokenizer splits off.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
#: The characters that are white space to the tokenizer, as a character class.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Letters, decimal digits and capitals that the tokenizer knows and this Python's tables do not (first, last and,
#: for capitals, the distance to the small letter).
NEWER_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5),
    (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA),
    (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEWER_DIGITS = (
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79),
    (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA),
)
NEWER_CAPITALS = (
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1),
    (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC),
    (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B),
)


#: Combining marks that the tokenizer's normaliser does not know as such (first and last): it neither moves nor joins them.
LATER_MARKS = (
    (0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C), (0xEBA, 0xEBA),
    (0x1715, 0x1715), (0x1ABF, 0x1ACE), (0x1DF6, 0x1DFA), (0xA82C, 0xA82C), (0x10D24, 0x10D27), (0x10EAB, 0x10EAC),
    (0x10EFD, 0x10EFF), (0x10F46, 0x10F50), (0x10F82, 0x10F85), (0x11070, 0x11070), (0x1133B, 0x1133B),
    (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x1193D, 0x1193E), (0x11943, 0x11943), (0x119E0, 0x119E0),
    (0x11A34, 0x11A34), (0x11A47, 0x11A47), (0x11A99, 0x11A99), (0x11D42, 0x11D42), (0x11D44, 0x11D45),
    (0x11D97, 0x11D97), (0x11F41, 0x11F42), (0x16FF0, 0x16FF1), (0x1E08F, 0x1E08F), (0x1E130, 0x1E136),
    (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF),
)


@cache
def byte_letters() -> tuple[str, ...]:
    """The letter that stands for each byte: printable bytes for themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = {b: chr(0x100 + i) for i, b in enumerate(b for b in range(0x100) if b not in set(shown))}
    return tuple(hidden.get(b, chr(b)) for b in range(0x100))


@cache
def _category(first: str, last: int) -> str:
    """Character class of the code points up to ``last`` whose general category begins with ``first``, as ranges."""
    out, start = [], None
    for c in range(last + 2):
        inside = c <= last and unicodedata.category(chr(c))[0] == first
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(chr(start) if start == c - 1 else f"{chr(start)}-{chr(c - 1)}")
            start = None
    return "".join(out)


@cache
def _piece_pattern(last: int = sys.maxunicode) -> re.Pattern:
    """Pieces of texts whose code points go up to ``last``: classes within 16 bits are looked up in a table, others in a list."""
    letters, numbers = (
        _category(name, last) + "".join(f"{chr(a)}-{chr(b)}" for a, b in newer if b <= last)
        for name, newer in (("L", NEWER_LETTERS), ("N", NEWER_DIGITS))
    )
    endings = "|".join(c[1:] for c in CONTRACTIONS)
    return re.compile(f"[{letters}]+|[{numbers}]|'(?:{endings})|[^{WHITE}{letters}{numbers}]+")


def _marks(last: int) -> re.Pattern:
    return re.compile("([" + "".join(f"{chr(a)}-{chr(b)}" for a, b in LATER_MARKS if b <= last) + "])")


_MARKS, _ALL_MARKS = _marks(0xFFFF), _marks(sys.maxunicode)
_ASTRAL = re.compile("[\U00010000-\U0010ffff]")


def composed(text: str) -> str:
    """NFC as the tokenizer's normaliser has it: marks it does not know stand between what is put in order."""
    if text.isascii():
        return text
    if _MARKS.search(text) or _ASTRAL.search(text):
        return "".join(unicodedata.normalize("NFC", part) for part in _ALL_MARKS.split(text))
    return unicodedata.normalize("NFC", text)


def pieces_of(text: str) -> Iterator[str]:
    """The pieces of a text without special tokens, one after the other."""
    plain = lowered(composed(text))
    return map(itemgetter(0), _piece_pattern(sys.maxunicode if _ASTRAL.search(plain) else 0xFFFF).finditer(plain))


SHORT = 24  # symbols up to which merging keeps a list of ranks, not a heap


class Vocabulary:
    """Tokens, merges by rank and the sufficient lookahead of one tokenizer file (its content as text)."""

    def __init__(self, content: str):
        model = json.loads(content)
        self.ids: dict[str, int] = model["model"]["vocab"]
        self.end = model["model"]["end_of_word_suffix"] or ""
        self.ranks = {tuple(m): i for i, m in enumerate(map(_pair, model["model"]["merges"]))}
        special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.special = special
        self.tokens = {i: t for t, i in (self.ids | special).items()}
        self.spaced = {i: " " + t for i, t in self.tokens.items()}
        self.packed = {t: i.to_bytes(4, "little") for t, i in (self.ids | special).items()}
        self.special_pattern = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.lookahead = sufficient_lookahead(list(self.ranks), self.end)


def _pair(merge) -> tuple[str, str]:
    return tuple(merge.split(" ")) if isinstance(merge, str) else tuple(merge)


def sufficient_lookahead(merges: list[tuple[str, str]], end: str = "") -> int:
    """Symbols to the right of a token's end that can matter to it, for a list of merges by rank.

    For merge j, the chain length is the length of its right part plus that of the
    longest chain among the earlier merges that take the end of that part: those whose
    left symbol is a symbol at the end of the right part at some time, and that come
    before the merge that uses that symbol up.
    """
    made: dict[str, int] = {}  # symbol: rank of the merge that makes it
    by_left: dict[str, tuple[list[int], list[int]]] = {}  # left symbol: ranks, longest chain up to each
    most = 0

    def symbols(token: str) -> int:
        return len(token.removesuffix(end)) if end and token != end else len(token)

    for rank, (left, right) in enumerate(merges):
        reach, at, before = 0, right, rank
        while at is not None:
            ranks, longest = by_left.get(at, ((), ()))
            n = bisect_left(ranks, before)
            if n:
                reach = max(reach, longest[n - 1])
            before = made.get(at)
            at = merges[before][1] if before is not None else None
        chain = symbols(right) + reach
        ranks, longest = by_left.setdefault(left, ([], []))
        ranks.append(rank)
        longest.append(max(chain, longest[-1] if longest else 0))
        made.setdefault(left + right, rank)
        most = max(most, chain)
    return most


def merged(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Merge a list of symbols: always the pair of least rank, the leftmost among equals."""
    size = len(symbols)
    if size <= SHORT:
        return _merged_short(list(symbols), ranks)
    word, after, before = list(symbols), list(range(1, size + 1)), list(range(-1, size - 1))
    heap = [(r, i, word[i], word[i + 1]) for i in range(size - 1) if (r := ranks.get((word[i], word[i + 1]))) is not None]
    heapify(heap)
    while heap:
        _, i, left, right = heappop(heap)
        j = after[i] if word[i] is not None else size
        if word[i] != left or j >= size or word[j] != right:
            continue
        word[i], word[j] = left + right, None
        after[i] = k = after[j]
        if k < size:
            before[k] = i
            if (r := ranks.get((word[i], word[k]))) is not None:
                heappush(heap, (r, i, word[i], word[k]))
        if (h := before[i]) >= 0 and (r := ranks.get((word[h], word[i]))) is not None:
            heappush(heap, (r, h, word[h], word[i]))
    return [s for s in word if s is not None]


def _merged_short(word: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """The same for few symbols, where looking through a list of ranks is faster than a heap."""
    none = len(ranks)
    get = ranks.get
    found = [get(pair, none) for pair in zip(word, word[1:], strict=False)]
    while found and (best := min(found)) < none:
        at = found.index(best)
        word[at] += word.pop(at + 1)
        del found[at]
        if at:
            found[at - 1] = get((word[at - 1], word[at]), none)
        if at < len(found):
            found[at] = get((word[at], word[at + 1]), none)
    return word


def transduce(symbols: Iterable[str], vocabulary: Vocabulary) -> Iterator[str]:
    """Tokens of one piece, each emitted once nothing that follows can change it."""
    look, buffer, symbols = vocabulary.lookahead, [], iter(symbols)
    room = 2 * look + 64
    while True:
        got = list(islice(symbols, room - len(buffer)))
        buffer += got
        tokens = merged(buffer, vocabulary.ranks)
        if len(buffer) < room:  # the piece has ended
            yield from tokens
            return
        used = 0
        for token in tokens:
            width = len(token)
            if used + width > len(buffer) - look:
                break
            used += width
            yield token
        buffer = buffer[used:]


def piece_symbols(piece: str, end: str) -> Iterator[str]:
    """The symbols of a piece: a letter for each of its bytes, the last one marked as the end of a word."""
    letters = byte_letters()
    for char in piece[:-1]:
        if char < "\x80":
            yield letters[ord(char)]
        else:
            yield from map(letters.__getitem__, char.encode("utf-8", "replace"))
    *rest, last = piece[-1].encode("utf-8", "replace")
    yield from map(letters.__getitem__, rest)
    yield letters[last] + end


@cache
def _newer_capitals() -> tuple[re.Pattern, dict[int, str]]:
    small = {c: chr(c + by) for a, b, by in NEWER_CAPITALS for c in range(a, b + 1)}
    return re.compile("[" + "".join(map(chr, small)) + "]"), small


def lowered(text: str) -> str:
    """Lower case of each character by itself (a final sigma is like any other)."""
    if text.isascii():
        return text.lower()
    newer, small = _newer_capitals()
    if newer.search(text):
        text = text.translate(small)
    return "".join(map(str.lower, text)) if "\u03a3" in text else text.lower()


class Encoder:
    """Encodes texts; keeps the tokens of the pieces seen last, up to a bound."""

    CACHED, LONGEST, BLOCK = 150_000, 64, 1024

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.known, self.before = vocabulary, {}, {}

    def piece(self, piece: str) -> bytes:
        """Ids of a piece of at most ``LONGEST`` characters, as little-endian 32-bit integers."""
        value = self.before.get(piece)
        if value is None:
            value = b"".join(self.tokens(piece))
        if len(self.known) >= self.CACHED:  # the pieces seen last stay for as many more
            self.known, self.before = {}, self.known
        self.known[piece] = value
        return value

    def tokens(self, piece: str) -> Iterator[bytes]:
        packed = self.vocabulary.packed
        return (packed[t] for t in transduce(piece_symbols(piece, self.vocabulary.end), self.vocabulary) if t in packed)  # there is no unknown token

    def pieces(self, text: str) -> Iterator[str | int]:
        """Pieces of a text, and the ids of special tokens, in order."""
        at, v = 0, self.vocabulary
        for match in v.special_pattern.finditer(text) if v.special_pattern else ():
            yield from pieces_of(text[at : match.start()])
            yield v.special[match.group()]
            at = match.end()
        yield from pieces_of(text[at:] if at else text)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text."""
        return np.frombuffer(b"".join(self.blocks(text)), "<u4")

    def blocks(self, text: str) -> Iterator[bytes]:
        """Ids of a text in blocks of bounded size, each given once it is stable."""
        v = self.vocabulary
        special = v.special_pattern and v.special_pattern.search(text)
        pieces = iter(self.pieces(text) if special else pieces_of(text))
        while found := list(islice(pieces, self.BLOCK)):
            parts = list(map(self.known.get, found))
            if None in parts:
                ready = []
                for p, part in zip(found, parts, strict=True):
                    if isinstance(p, int):
                        part = v.packed[v.tokens[p]]
                    elif len(p) > self.LONGEST:
                        yield b"".join(ready)
                        ready, ids = [], self.tokens(p)
                        while block := b"".join(islice(ids, self.BLOCK)):
                            yield block
                        continue
                    elif part is None:
                        part = self.known.get(p)
                        part = self.piece(p) if part is None else part
                    ready.append(part)
                parts = ready
            yield b"".join(parts)

    def digests(self, text: str, keep: bool = True) -> tuple[int, str, str, bytes]:
        """Number of ids, digest of the ids, digest of the text they decode to, and the ids if they are to be kept."""
        count, of_ids, of_text, kept, decoder = 0, hashlib.sha256(), hashlib.sha256(), [], Decoder(self.vocabulary)
        for block in self.blocks(text):
            count += len(block) // 4
            of_ids.update(block)
            of_text.update(decoder.feed_all(np.frombuffer(block, "<u4").tolist()).encode())
            if keep:
                kept.append(block)
        of_text.update(decoder.close().encode())
        return count, of_ids.hexdigest(), of_text.hexdigest(), b"".join(kept)


class Decoder:
    """From ids to text, one id at a time, as a state machine.

    ``plain``: the tokens with a blank between them, which is how a tokenizer file
    without a decoder is decoded. Else the tokens' letters go back to bytes and bytes
    to text: the state is the up to three bytes of a character that has begun; the end
    of a word gives a blank before the next one; bytes that are no UTF-8 give U+FFFD.
    """

    def __init__(self, vocabulary: Vocabulary, plain: bool = True):
        self.vocabulary, self.plain, self.begun = vocabulary, plain, False
        self.bytes = {c: b for b, c in enumerate(byte_letters())}
        self.pending, self.gap = b"", False

    def feed(self, token_id: int) -> str:
        """The text that is certain once this id has been read."""
        token = self.vocabulary.tokens.get(int(token_id))
        if token is None:  # unknown ids decode to nothing
            return ""
        if self.plain:
            out, self.begun = (" " if self.begun else "") + token, True
            return out
        if token in self.vocabulary.special:
            return self.close() + token
        end = self.vocabulary.end
        closed = bool(end) and token.endswith(end)
        raw = bytes(self.bytes[c] for c in (token.removesuffix(end) if closed else token))
        out, self.gap = (" " if self.gap else ""), False
        data, self.pending = self.pending + raw, b""
        keep = _open_tail(data)
        if keep and not closed:
            data, self.pending = data[:-keep], data[-keep:]
        self.gap = closed
        return out + data.decode("utf-8", "replace")

    def feed_all(self, ids: list[int]) -> str:
        """What feeding these ids one by one gives."""
        if not self.plain:
            return "".join(map(self.feed, ids))
        out = "".join(map(self.vocabulary.spaced.get, ids, repeat("")))
        if out and not self.begun:
            self.begun, out = True, out[1:]
        return out

    def close(self) -> str:
        """What is left at the end: a character that has begun but not ended."""
        left, self.pending = self.pending, b""
        return left.decode("utf-8", "replace")


def _open_tail(data: bytes) -> int:
    """Bytes at the end that begin a UTF-8 character without ending it."""
    for back in range(1, min(3, len(data)) + 1):
        byte = data[-back]
        if byte >= 0xC0:
            need = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
            return back if back < need else 0
        if byte < 0x80:
            return 0
    return 0


def read_vocabulary(path: str) -> str:
    """The content of a tokenizer file, a few MB at most: it is sent to the tasks as it is."""
    with open(path, encoding="utf-8") as file:
        return file.read()


@cache
def _encoder(content: str) -> Encoder:
    return Encoder(Vocabulary(content))


RESULT = "n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string"


def encode_texts(rows: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, ids: bool = True) -> DataFrame:
    """``rows`` (or their columns ``keep``) with ``n_tokens``, ``ids`` (left out on request) and two digests.

    ``ids_sha256`` is of the ids as little-endian unsigned 32-bit integers,
    ``decoded_sha256`` of the UTF-8 text that the ids decode to. A null or empty text
    has no tokens and decodes to an empty text. Columns of ``rows`` with a result's
    name are replaced. Whole texts are encoded; a task holds a few MB of texts at a time, a bounded number of known pieces and of ids (all
    of the texts' ids only where they are asked for), and the vocabulary.
    """
    made = [f.split(" ")[0] for f in RESULT.split(", ")]
    kept = [c for c in (rows.columns if keep is None else keep) if c not in made]
    sent = rows.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    batch_rows(rows.sparkSession)
    body = "__text_to_encode"
    source = rows.select(*[F.col(f"`{c}`") for c in kept], text_or_empty(f"`{text}`").alias(body))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(sent.value)
        for batch in slices(batches, body):
            counts, digests, decoded, values = [], [], [], []
            for value in batch.column(batch.num_columns - 1).to_pylist():
                count, digest, text_digest, raw = encoder.digests(value, ids)
                counts.append(count)
                digests.append(digest)
                decoded.append(text_digest)
                if ids:
                    values.append(raw)
            columns = [batch.column(i) for i in range(batch.num_columns - 1)] + [pa.array(counts, pa.int64())]
            if ids:
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                flat = pa.array(np.frombuffer(b"".join(values), "<u4").astype(np.int32))
                columns.append(pa.ListArray.from_arrays(offsets, flat))
            columns += [pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            names = [*kept, *[m for m in made if ids or m != "ids"]]
            yield pa.RecordBatch.from_arrays(columns, names)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]]
    fields += [f for f in RESULT.split(", ") if ids or not f.startswith("ids ")]
    return source.mapInArrow(run, ", ".join(fields))


def vocabulary_path() -> str:
    """Where the tokenizer file of the query lies: the installed package of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op8_bpe_documents")
def op8_bpe_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return encode_texts(docs, vocabulary_path(), keep=["doc_id"], ids=False)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokenised corpus: ids of every document that reached this stage, with its digests."""
    return encode_texts(docs, vocabulary_path(), keep=["doc_id", "lang", "source"])
