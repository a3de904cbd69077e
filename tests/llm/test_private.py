"""Personal data: stated patterns against plain ``re``, disguises against the texts they hide."""

import hashlib
import random
import re
import time

import pytest

from terrascore.llm import private
from terrascore.llm.registry import QUERIES

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for n, c in enumerate(reversed(digits)):
        d = int(c) * (1 + n % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def by_re(text):
    out = []
    for number, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))
                    or kind == "card" and 14 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 10 <= len(digits) <= 15):
                out.append((m.start(), number, m.end(), kind))
    return [(k, s, e) for s, _, e, k in sorted(out)]


def named(spans):
    return [(private.KINDS[k], s, e) for s, k, e in spans]


def test_stated_patterns_are_those_of_re():
    r = random.Random(7)
    pieces = ["a", "@", ".", "-", "+", " ", "(", "é", "%", "1", "23", "255", "256", "007", "4111 1111 1111 1111", "4111-1111-1111-1112", "+33 6 12 34 56 78", "x@y.z", "10.0.0.1"]
    for _ in range(6000):
        text = "".join(r.choices(pieces, k=r.randrange(1, 14)))
        assert named(private.base_spans(text)) == by_re(text), text


DISGUISED = [
    ("write john [at] example [dot] com now", [("email", "john [at] example [dot] com")]),
    ("john dot smith at mail dot example dot org.", [("email", "john dot smith at mail dot example dot org")]),
    ("jоhn@exаmple.com", [("email", "jоhn@exаmple.com")]),
    ("jo​hn@example.com!", [("email", "jo​hn@example.com")]),
    ("john&#64;example&#46;com", [("email", "john&#64;example&#46;com")]),
    ("mail john at example[.]com", [("email", "john at example[.]com")]),
    ("john arobase exemple point fr", [("email", "john arobase exemple point fr")]),
    ("john @ example.com", [("email", "john @ example.com")]),
    ("a.b@mail.example [dot] com", [("email", "a.b@mail.example [dot] com")]),
    ("＋１ 415 555 ２６７１ ok", [("phone", "＋１ 415 555 ２６７１")]),
    ("plus one four one five five five five two six seven one", [("phone", "plus one four one five five five five two six seven one")]),
    ("+1 four one five 555 two six seven one, yes", [("phone", "+1 four one five 555 two six seven one")]),
    ("quatre un un un un un un un un un un un un un un un", [("card", "quatre un un un un un un un un un un un un un un un")]),
    ("4111​1111 1111−1111", [("card", "4111​1111 1111−1111")]),
    ("at one nine two dot one six eight dot zero dot one", [("ip", "one nine two dot one six eight dot zero dot one")]),
    ("192[.]168[.]0[.]1 and 192 dot 168 dot 0 dot 12", [("ip", "192[.]168[.]0[.]1"), ("ip", "192 dot 168 dot 0 dot 12")]),
    ("İİ\U0001f600 mia (at) example.com", [("email", "mia (at) example.com")]),
]
CLEAN = [
    "look at example.com", "see you @ noon. ok", "at the dot com", "one two three", "un deux trois quatre cinq six sept huit neuf", "",
    "почта@пример.рф", "1 2 3 dot 4", "[at] [dot]", "plus 20 000 000 000 euros", "АВС​ 12",
]


@pytest.mark.parametrize(("text", "hidden"), DISGUISED)
def test_disguised_data_is_found_at_its_place(text, hidden):
    found = private.added_spans(text, private.base_spans(text))
    assert [(private.KINDS[k], text[s:e]) for s, k, e in found] == hidden


@pytest.mark.parametrize("text", CLEAN)
def test_clean_texts_get_nothing_added(text):
    assert private.added_spans(text, private.base_spans(text)) == []


def test_every_disguise_leads_back():
    """A known address among random text, each character disguised at random: its span is the disguise."""
    r = random.Random(9)
    looks = {"a": "а", "e": "е", "o": "о", "c": "с", "p": "р", "1": "１"}
    signs = {"@": ["@", " [at] ", "(at)", "[@]", "&#64;", "＠"], ".": [".", " [dot] ", "(.)", "&period;", "．"]}
    for _ in range(400):
        address = f"{''.join(r.choices('aeocpx1', k=6))}@{''.join(r.choices('aeocp', k=5))}.com"
        hidden = "".join(r.choice(signs[c]) if c in signs else looks[c] if c in looks and r.random() < 0.3 else c for c in address)
        hidden = "".join(c + "​" * (r.random() < 0.1) for c in hidden[:-1]) + hidden[-1] if " " not in hidden and "&" not in hidden else hidden
        text = f"{r.choice(['', 'In​ ', 'İİ '])}to {hidden}, {r.choice(['１ x', 'bye'])}"
        spans = private.base_spans(text)
        spans = spans + private.added_spans(text, spans)
        at = text.index(hidden)
        assert (at, 0, at + len(hidden)) in spans, text


def test_texts_of_a_megabyte_are_read_in_line():
    for piece in ("a", "1", "1.", "a@", "@", " ", "one ", "[ ", "+1(", "a at b dot ", "а", "1​"):
        times = []
        for size in (1 << 18, 1 << 20):
            text, before = piece * (size // len(piece)), time.process_time()
            private.added_spans(text, private.base_spans(text))
            times.append(time.process_time() - before)
        assert times[1] < 9 * times[0] + 1, piece


def test_query(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op12_find_private_data"](spark, sf).collect()
    assert len(got) == len(texts) and sum(r["n_email"] for r in got) and sum(r["n_card"] for r in got)
    for r in got:
        want = by_re(texts[r["doc_id"]])
        listed = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(x[0] == k for x in want) for k in PLAIN]
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert r["spans"] == listed and r["n_added"] == 0  # these texts hide nothing


def test_odd_rows(docs_of):
    rows = [(1, None), (1, ""), (None, "to a@b.co and a [at] b [dot] co"), (2, "x" * 400_000 + " +33 (0)6 12 34 56 78"), (2, "9" * 6000 + ".1.1.1")]
    docs = docs_of(*rows, extra="spans body n_ip __body redacted")
    got = private.find_private(docs, redact=True)
    assert got.columns[:7] == ["doc_id", "text", "lang", "source", "n_chars", "body", "__body"]
    found = {(r["doc_id"], r["spans"]): r["redacted"] for r in got.collect()}
    assert set(found) == {(1, ""), (None, "email:3:9,email:14:31"), (2, "phone:400001:400021"), (2, "")}
    assert found[None, "email:3:9,email:14:31"] == "to <email> and <email>"
    assert private.find_private(docs.where("false")).collect() == []
