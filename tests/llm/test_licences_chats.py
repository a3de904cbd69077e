"""Licence scans on held-out statements, chat formatting on small conversations."""

import json
import random
import time

import pytest

from terrascore.llm import chats, licences
from terrascore.llm.registry import QUERIES

STATEMENTS = {
    "This software is released under the MIT License.": "MIT",
    "All files here are licensed under the Apache License, Version 2.0, see there": "Apache",
    "Ce texte: this work is licensed under the GNU General Public License, version 3. Voilà": "GPL",
    "Photos licensed under CC BY-NC 4.0.": "CC-BY-NC",
    "texts licensed under CC BY-SA 4.0": "CC-BY-SA",
    "redistribution and use in source and binary forms with or without modification are permitted": "BSD",
}
OTHERS = ["the end of the road", "a licence to fish in the river", "Licensed under the Foo License.", "of the and in the", "", "released from prison"]


@pytest.fixture(scope="module")
def model(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return licences.train(licences.sample_paragraphs(docs, "doc_id", "text"))


def test_statements_and_others(docs_of, model):
    filler = "word " * 300
    rows = [*enumerate(STATEMENTS), *enumerate(OTHERS, 100), (200, None), (201, filler + list(STATEMENTS)[0] + filler + "\n\n" + list(STATEMENTS)[3])]
    got = {r["doc_id"]: r for r in licences.scan_licences(docs_of(*rows, extra="spans score"), model).collect()}
    for i, (text, family) in enumerate(STATEMENTS.items()):
        assert got[i]["licences"] == family, text
        name, start, end = got[i]["spans"].split(":")
        assert 0 <= int(start) < int(end) <= len(text)
    assert all(got[i]["licences"] == "" and got[i]["score"] is None for i in [*range(100, 100 + len(OTHERS)), 200])
    assert got[201]["licences"] == "CC-BY-NC,MIT" and got[201]["n_statements"] == 2
    first = got[201]["spans"].split(",")[0].split(":")
    assert "MIT" in got[201]["text"][int(first[1]) : int(first[2])]
    assert licences.scan_licences(docs_of((1, "a")).where("false"), model).collect() == []


def test_several_licences_on_one_line(docs_of, model):
    lines = {
        "Licensed under the Apache License, Version 2.0. Released under the MIT License.": "Apache,MIT",
        "Licensed under the MIT License or the Apache License, Version 2.0, of the two": "Apache,MIT",
        "Code: released under the BSD 3-Clause License. Texts: licensed under CC BY-SA 4.0. Data: licensed under CC BY-NC 4.0.": "BSD,CC-BY-NC,CC-BY-SA",
        " ".join(licences.TEMPLATES["Apache"]): "Apache",
        licences.TEMPLATES["AGPL"][0] + ", either version 3 of the License, or (at your option) any later version.": "AGPL",
        licences.TEMPLATES["LGPL"][0] + ", either version 2.1 of the License, or (at your option) any later version.": "LGPL",
        " ".join(licences.TEMPLATES["GPL"][i] for i in (0, 2)): "GPL",
    }
    got = {r["doc_id"]: r for r in licences.scan_licences(docs_of(*enumerate(lines)), model).collect()}
    for i, (line, want) in enumerate(lines.items()):
        assert got[i]["licences"] == want and got[i]["n_statements"] == want.count(",") + 1, line
    for name, word in (("Apache", "Apache"), ("MIT", "MIT")):
        spans = [x.split(":") for x in got[0]["spans"].split(",")]
        at = next((int(a), int(b)) for f, a, b in spans if f == name)
        text = got[0]["text"][at[0] : at[1]]
        assert word in text and not ("Apache" in text and "MIT" in text)


def test_spans_where_lower_case_is_longer(docs_of, model):
    text = "İİİİ Released under the MIT License."
    assert licences.scan_licences(docs_of((1, text)), model).first()["spans"] == "MIT:5:35"


def test_what_only_speaks_of_licences(docs_of, model):
    texts = [
        "Licensed under the Foo License, Version 2.0.", "Released under the terms of the Bar license.", "Licensed under the Quux Public License 1.5.",
        "The MIT campus and the Apache helicopter are on the photograph", "Mozilla was founded to write a public web browser",
        "You may obtain a copy of the map at the desk", "the general public licence fee was raised by the lesser council",
    ]
    got = licences.scan_licences(docs_of(*enumerate(texts)), model).collect()
    assert [(r["text"], r["spans"]) for r in got if r["licences"]] == []


def test_statements_against_all_windows(model):
    """Every template that stands whole in a line is found at its place, and what is found holds most of one of its family's."""
    rng = random.Random(5)
    every = [(f, licences.words_of(t)) for f, all_of in licences.TEMPLATES.items() for t in all_of]
    loose = sorted({w for _, t in every for w in t})
    for _ in range(60):
        words, planted = [], []
        for family, t in rng.sample(every, 3):
            words += [rng.choice(loose + ["und", "les"] * 40) for _ in range(rng.randrange(70, 90))]
            planted.append((family, len(words), len(words) + len(t) - 1))
            words += t
        found = model.parts(words)
        assert all(x[1] < y[0] for x, y in zip(found, found[1:], strict=False))
        for family, a, b in planted:
            assert any(f == family and x <= b and y >= a for x, y, f, _ in found), (family, words[a : b + 1], found)
        for x, y, f, _ in found:
            pairs = set(zip(words[x:y], words[x + 1 : y + 1], strict=True))
            assert any(len(pairs & t) >= licences.CONFIRM * len(t) for t in model.template_pairs[f])


@pytest.mark.parametrize("kind", ["words of templates in any order", "statements one after the other"])
def test_a_long_line_takes_time_in_proportion(model, kind):
    rng = random.Random(3)
    every = [t for all_of in licences.TEMPLATES.values() for t in all_of]
    loose = [w for t in every for w in t.split()]

    def took(size):
        parts, length = [], 0
        while length < size:
            parts.append(rng.choice(every if kind.startswith("statements") else loose))
            length += len(parts[-1]) + 1
        line, start = " ".join(parts), time.process_time()
        for _, _, words in model.statements(line):
            model.found(words)
        return time.process_time() - start

    took(100_000)
    assert took(1_000_000) < 3.5 * took(500_000)


def test_training_without_documents(docs_of):
    empty = docs_of((1, "a")).where("false")
    found = licences.train(licences.sample_paragraphs(empty, "doc_id", "text")).predict(licences.words_of("Released under the MIT License."))
    assert found[0] == "MIT" and found[2]


def test_licence_query(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    lines = {"Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache", "Licensed under CC BY-NC 4.0.": "CC-BY-NC",
             "This work is licensed under the GNU General Public License, version 3.": "GPL"}
    got = QUERIES["op5_scan_licences"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        want = {f for line, f in lines.items() if line in texts[r["doc_id"]]}
        assert want <= set(r["licences"].split(",")) | {""}


CALL = "conv_id long, turn long, call_id string, name string, arguments string, after string"
SCHEMAS = {"f": {"x": "number", "y": "string?"}}


def test_links_order_and_arguments(spark):
    calls = spark.createDataFrame([
        (1, 0, "a", "f", '{"y":"z" , "x":1}', None), (1, 1, "b", "f", '{"x":2.5}', "a"), (1, 2, "c", "f", "no \"json\"", "b"),
        (1, 3, "d", "g", "{}", "c"), (1, 4, "e", "f", '{"x":1,"w":{"b":1,"a":2}}', "gone"), (1, 5, "h", "f", '{"x":"1"}', None),
        (1, 6, "i", "f", '{"x":1}', None), (1, 7, "a", "f", '{"x":3}', None), (2, 0, "a", "f", '{"x":1}', "b"), (2, 1, "b", "f", '{"x":1}', "a"),
        (None, 0, "n", "f", '{"x":1}', None), (3, 0, None, "f", None, None),
    ], CALL)
    results = spark.createDataFrame([
        (1, 1, "a", "ok"), (1, 2, "a", "again"), (1, 2, "zz", None), (1, 2, "b", 'é "q"\n')], "conv_id long, turn long, call_id string, content string")
    a, b = chats.link_calls(calls, results, SCHEMAS)
    got = {(r["conv_id"], r["call_id"], r["turn"]): r for r in a.collect()}
    status = {k: r["status"] for k, r in got.items()}
    assert status == {
        (1, "a", 0): "linked", (1, "b", 1): "linked", (1, "c", 2): "invalid", (1, "d", 3): "invalid", (1, "e", 4): "invalid", (1, "h", 5): "invalid",
        (1, "i", 6): "unanswered", (1, "a", 7): "duplicate", (2, "a", 0): "cyclic", (2, "b", 1): "cyclic", (None, "n", 0): "unlinked", (3, None, 0): "unlinked"}
    assert [got[1, c, t]["step"] for c, t in (("a", 0), ("b", 1), ("c", 2), ("d", 3), ("e", 4))] == [0, 1, 2, 3, 0]
    assert got[1, "c", 2]["errors"] == "no object" and got[1, "d", 3]["errors"] == "unknown tool"
    assert got[1, "e", 4]["errors"] == "unknown w" and got[1, "h", 5]["errors"] == "type of x"
    assert got[1, "a", 0]["json"] == '{"arguments":{"x":1,"y":"z"},"id":"a","name":"f","type":"call"}'
    assert got[1, "e", 4]["json"].startswith('{"arguments":{"w":{"a":2,"b":1},"x":1}')
    for r in got.values():
        assert list(json.loads(r["json"])) == sorted(json.loads(r["json"]))
    answers = {(r["call_id"], r["turn"]): r for r in b.collect()}
    assert {k: r["status"] for k, r in answers.items()} == {("a", 1): "linked", ("a", 2): "repeated", ("zz", 2): "orphan", ("b", 2): "linked"}
    assert json.loads(answers["b", 2]["json"])["content"] == 'é "q"\n' and answers["b", 2]["step"] == 1


def test_a_long_chain_takes_few_rounds(spark):
    chain = spark.createDataFrame([(1, i, str(i), "f", None, str(i - 1) if i else None) for i in range(500)], CALL)
    got = {int(r["call_id"]): r["step"] for r in chats.call_order(chain).collect()}
    assert got == {i: i for i in range(500)}


def test_nothing_to_link(spark):
    none = spark.createDataFrame([], CALL)
    a, b = chats.link_calls(none, spark.createDataFrame([], "conv_id long, turn long, call_id string, content string"), SCHEMAS)
    assert a.collect() == [] and b.collect() == []


def test_odd_conversations(spark, frame):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "x"), (1, 1, "assistant", "x"), (2, None, "user", "q"), (None, 0, "user", "q"), (3, 0, None, "t"), (3, 1, "tool", None)]
    folder = frame(conversations=spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as status"))
    got = {(r["conv_id"], r["turn"], r["role"]): r["status"] for r in QUERIES["op9_format_chats"](spark, folder).collect()}
    assert got == {(1, 0, "user"): "invalid", (1, 1, "assistant"): "linked", (2, None, "user"): "unlinked", (None, 0, "user"): "unlinked",
                   (3, 0, None): "message", (3, 1, "tool"): "message"}


def test_spans_count_characters_of_the_text_as_it_is(docs_of):
    model = licences.train(["an ordinary paragraph about the weather in the hills", "les uns et les autres vont au marché"])
    notice = "Released under the MIT License."
    text = "İİİİ " + notice
    (row,) = licences.scan_licences(docs_of((1, text)), model).collect()
    family, start, end = row["spans"].split(":")
    assert (family, text[int(start) : int(end)]) == ("MIT", notice[:-1])
