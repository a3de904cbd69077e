"""The streaming encoder against the tokenizers library, its lookahead against longer ones, exact round trips."""

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from terrascore.llm import bpe
from terrascore.llm.registry import QUERIES


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.vocabulary_path())


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(bpe.read_vocabulary(bpe.vocabulary_path()))


def samples():
    r = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    yield from ("", " ", "Hello, it's  the WORLD\n ça12 été 😀 <|endoftext|>x\x1cy ΑΣ İ", "a" * 3000, "ab" * 4000)
    yield from ("<|startoftext|>'S 'T it'RE don't''s", "１２½Ⅷ 　x", "é Å")
    yield from ("".join(r.choice(letters) for _ in range(1500)) for _ in range(10))
    yield from ("".join(r.choice("aeinrst") for _ in range(3000)) for _ in range(10))
    yield from ("".join(chr(r.randrange(32, 0x1DC0)) for _ in range(300)) for _ in range(10))


def test_same_as_the_library(library, vocabulary):
    encoder = bpe.Encoder(vocabulary)
    for text in samples():
        ids = encoder.encode(text).tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids, text[:60]
        decoder = bpe.Decoder(vocabulary)
        assert "".join(map(decoder.feed, ids)) == library.decode(ids, skip_special_tokens=False)


def test_digests_are_of_decoded_ids(library):
    own = bpe.Vocabulary(bpe.read_vocabulary(bpe.vocabulary_path()))
    encoder = bpe.Encoder(own)
    for text in samples():
        ids = library.encode(text, add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        plain = library.decode(ids, skip_special_tokens=False)
        want = (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(plain.encode()).hexdigest())
        assert encoder.digests(text) == (*want, raw) and encoder.digests(text, keep=False) == (*want, b"")
        one = bpe.Decoder(own)
        assert bpe.Decoder(own).feed_all(ids) == "".join(map(one.feed, ids))
    before = encoder.digests("hello world")
    own.spaced[encoder.encode("world")[0].item()] = " wrong"  # a wrong step from id to text shows, though the pieces are known
    after = encoder.digests("hello world")
    assert before[1] == after[1] and before[2] != after[2]


def test_ids_come_in_bounded_blocks(vocabulary):
    encoder = bpe.Encoder(vocabulary)
    for text in ("one two three, " * 20_000, "aeinrsto" * 20_000):
        sizes = [len(b) for b in encoder.blocks(text)]
        assert max(sizes) <= 4 * encoder.BLOCK * 4 and sum(sizes) == 4 * len(encoder.encode(text)) and len(sizes) > 10


def test_buffer_is_bounded(vocabulary, monkeypatch):
    seen, real = [], bpe.merged
    monkeypatch.setattr(bpe, "merged", lambda symbols, ranks: seen.append(len(symbols)) or real(symbols, ranks))
    text = "".join(random.Random(1).choice("aeinrsto") for _ in range(20_000))
    tokens = list(bpe.transduce(bpe.piece_symbols(text, vocabulary.end), vocabulary))
    assert max(seen) <= 2 * vocabulary.lookahead + 64 and len(seen) > 50
    assert tokens == real(list(bpe.piece_symbols(text, vocabulary.end)), vocabulary.ranks)


def test_lookahead_of_a_small_list():
    # (b,c) can take the b from (a,b), and (c,d) the c from (b,c): the chain is b, c, d
    assert bpe.sufficient_lookahead([("c", "d"), ("b", "c"), ("a", "b")]) == 3
    assert bpe.sufficient_lookahead([("a", "b"), ("b", "c"), ("c", "d")]) == 1
    assert bpe.sufficient_lookahead([]) == 0


def test_lookahead_is_sufficient(vocabulary):
    r = random.Random(3)
    merges = []
    symbols = list("abc")
    while len(merges) < 25:
        pair = (r.choice(symbols), r.choice(symbols))
        if pair not in merges and pair[0] + pair[1] not in symbols:
            merges.append(pair)
            symbols.append(pair[0] + pair[1])
    small = bpe.Vocabulary.__new__(bpe.Vocabulary)
    small.ranks, small.end, small.lookahead = {m: i for i, m in enumerate(merges)}, "", bpe.sufficient_lookahead(merges)
    for _ in range(300):
        text = [r.choice("abc") for _ in range(r.randrange(200, 900))]
        assert list(bpe.transduce(text, small)) == bpe.merged(text, small.ranks)


def test_decoder_gives_back_text(vocabulary):
    encoder = bpe.Encoder(vocabulary)
    for text in ("grüße 世界 😀 aé", "plain words here"):
        decoder = bpe.Decoder(vocabulary, plain=False)
        out = "".join(map(decoder.feed, encoder.encode(text))) + decoder.close()
        assert out == text
    cut = bpe.Decoder(vocabulary, plain=False)
    first = [vocabulary.ids[bpe.byte_letters()[b]] for b in "😀".encode()[:2]]
    assert "".join(map(cut.feed, first)) == "" and cut.close() == "�"
    assert bpe.Decoder(vocabulary).feed(10**9) == ""


def test_rows(spark, docs_of, library):
    rows = [(1, "Hello world"), (2, None), (3, ""), (None, "x" * 100_000), (1, "Hello world")]
    got = bpe.encode_texts(docs_of(*rows, extra="ids n_tokens"), bpe.vocabulary_path()).collect()
    assert len(got) == 5 and got[0].asDict().keys() >= {"doc_id", "text", "ids", "n_tokens"}
    for r in got:
        assert r["ids"] == library.encode(r["text"] or "", add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])
        raw = np.array(r["ids"], "<u4").tobytes()
        assert r["ids_sha256"] == hashlib.sha256(raw).hexdigest()
    assert bpe.encode_texts(docs_of((1, "a")).where("false"), bpe.vocabulary_path()).collect() == []


def test_query(spark, sf, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op8_bpe_documents"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
