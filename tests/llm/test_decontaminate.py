import re

import pytest

from attestry.llm import decontaminate as D

SCHEMA = "doc_id long, text string, n_hit string, extra int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items, n=10):
    out = {}
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item_id, t in items:
            b = words(t)
            size = min(n, len(b))
            have = {tuple(b[i : i + size]) for i in range(len(b) - size + 1)} if b else set()
            for i in range(len(w) - size + 1 if b else 0):
                if tuple(w[i : i + size]) in have:
                    hit |= set(range(i, i + size))
                    found.add(str(item_id))
        out[doc_id] = (len(w), len(hit), len(found), D.items_digest(sorted(found)), bool(hit))
    return out


BENCH = [(1, "One two, three four five six seven eight nine ten ELEVEN twelve"), (2, "short item"), (10, "Short  ITEM!"), (3, None), (4, "?!"), (5, "É a b c d e f g h i j"), (6, "short item")]
DOCS = [
    (1, "x one two three four five six seven eight nine ten y two three four five six seven eight nine ten eleven"),
    (2, "a SHORT, item and short item"),
    (3, None),
    (4, ""),
    (5, "nothing here"),
    (6, "É a b c d e f g h i and é a b c d e f g h i"),
    (7, "pad " * 5000 + "one two three four five six seven eight nine ten" + " pad" * 5000),
    (8, "item"),
]


@pytest.mark.parametrize("limit", [500_000, 4])
def test_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(D, "MAX_WINDOWS", limit)
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in DOCS], SCHEMA)
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in D.digest(D.contamination(docs, bench)).collect()}
    assert got == brute(DOCS, BENCH)


def test_removal(spark):
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in DOCS] * 2, SCHEMA)
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    assert sorted(r.doc_id for r in D.decontaminate(docs, bench).collect()) == [3, 3, 4, 4, 5, 5, 8, 8]
    spans = {r.doc_id: r.text for r in D.decontaminate(docs, bench, action="spans").collect()}
    assert spans[2] == "a  and " and spans[5] == "nothing here" and spans[3] is None
    assert "a b c" not in spans[6].split("and")[0]


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert D.contamination(none, bench).count() == 0
    docs = spark.createDataFrame([(1, "a b", "", 1)], SCHEMA)
    assert tuple(D.digest(D.contamination(docs, bench)).first())[1:] == (2, 0, 0, D.items_digest([]), False)
