import random
import re

import numpy as np
import pytest

from attestry.llm import _text
from attestry.llm import jaccard_join as J
from attestry.llm._components import components

SCHEMA = "doc_id long, text string, n_shingles string, sid int, component_id int"
WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    if len(w) < 5:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(docs))


def corpus(seed, groups=14, copies=7):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocab) for _ in range(40)]
    docs = []
    for _ in range(groups):
        base = [rng.choice(vocab) for _ in range(rng.choice([4, 5, 6, 9, 30, 90, 200]))]
        if rng.random() < 0.5:
            base[len(base) // 2 : len(base) // 2] = passage
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 8])):
                k = rng.randrange(len(own))
                own[k : k + rng.choice([0, 1, 1])] = [rng.choice(vocab)]
            docs.append(rng.choice([" ", "\n", "\t "]).join(own))
    docs += [None, "", " \n ", "one", "ONE", "one two three four", "é É", "É é", "x " * 3000, "a b c d e", "a b c d e f", "A B C D E"]
    rng.shuffle(docs)
    return [(i * 3 - 5, t) for i, t in enumerate(docs)]


@pytest.mark.parametrize("seed,small,block", [(1, 32, 2048), (2, 2, 3)])
def test_brute_force(spark, monkeypatch, seed, small, block):
    monkeypatch.setattr(J, "SMALL", small)
    monkeypatch.setattr(J, "BLOCK", block)
    docs = corpus(seed)
    got = J.jaccard_components(spark.createDataFrame([(d, t, "c", 1, 2) for d, t in docs], SCHEMA).repartition(3), shards=5).drop("sid").collect()
    assert sorted(map(tuple, got)) == brute(docs)


def test_repeated_rows_and_ids(spark):
    docs = [(1, "a b c d e f g"), (1, "a b c d e f g"), (1, "other words"), (0, "A b c d e f G"), (7, "other  words")]
    got = J.jaccard_components(spark.createDataFrame([(d, t, "c", 1, 2) for d, t in docs], SCHEMA)).drop("sid").collect()
    assert sorted(map(tuple, got)) == [(0, 3, 0), (1, 1, 1), (1, 3, 0), (1, 3, 0), (7, 1, 1)]


def test_empty(spark):
    assert J.jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_bound_is_from_above():
    rng = np.random.default_rng(5)
    for n_a, n_b in [(10, 12), (60, 70), (300, 260), (4, 5), (1000, 900)]:
        pool = rng.integers(0, 1 << 63, n_a + n_b, dtype=np.uint64)
        a = np.unique(pool[:n_a])
        b = np.unique(np.concatenate([a[: n_a // 2], pool[n_a:]])[:n_b])
        bound = J.overlap_bound(J.bitmap(a)[None], J.bitmap(b)[None], np.array([len(a)]), np.array([len(b)]))[0]
        assert bound >= len(np.intersect1d(a, b))


def test_word_hashes_see_words_only():
    raw = "The cat\tTHE\n cät".encode()
    buf = np.frombuffer(raw, np.uint8)
    s, e, first = _text.words(buf, np.array([0, 3, len(raw)]), _text.SPACE_SEP)
    h = _text.word_hashes(buf, s, e)
    assert len(h) == 4 and h[0] == h[2] and len(set(h.tolist())) == 3 and first.tolist() == [0, 1, 4]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100, 160)] + [(5, 9), (9, 5), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 5: 5, 9: 5}


def test_keep_one(spark):
    docs = [(1, "a b c d e f g"), (1, "a b c d e f g"), (1, "other words"), (0, "A b c d e f G"), (7, "other  words"), (8, None), (8, None), (9, "")]
    frame = spark.createDataFrame([(d, t, "c", 1, 2) for d, t in docs], SCHEMA)
    kept = J.keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id, r.text) for r in kept.fillna("", "text").collect()) == [(0, "A b c d e f G"), (1, "other words"), (8, ""), (8, ""), (9, "")]


@pytest.mark.parametrize("seed,small,block", [(1, 32, 2048), (2, 2, 3)])
def test_links_of_connected_pairs(spark, monkeypatch, seed, small, block):
    monkeypatch.setattr(J, "SMALL", small)
    monkeypatch.setattr(J, "BLOCK", block)
    docs = corpus(seed)
    sets = [shingles(t) for _, t in docs]
    linked = lambda a, b: bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)
    want = [(*row, sum(linked(sets[i], sets[j]) for j in range(len(docs)) if j != i)) for row, i in zip(brute(docs), range(len(docs)), strict=True)]
    frame = spark.createDataFrame([(d, t, "c", 1, 2) for d, t in docs], SCHEMA).repartition(3)
    got = J.jaccard_components(frame, shards=5, links=True).drop("sid").collect()
    assert sorted(map(tuple, got)) == want and max(r.n_links for r in got) > 2


def test_links_count_rows(spark):
    words = [f"w{i}" for i in range(60)]
    near = [" ".join([*words[:k], "x", *words[k + 1 :]]) for k in (0, 59)]
    docs = [(1, " ".join(words)), (2, " ".join(words).upper()), (3, near[0]), (4, near[1]), (4, near[1]), (None, "other words"), (6, None)]
    got = J.jaccard_components(spark.createDataFrame([(d, t, "c", 1, 2) for d, t in docs], SCHEMA), links=True).collect()
    assert sorted((r.doc_id or 0, r.n_links) for r in got) == [(0, 0), (1, 4), (2, 4), (3, 4), (4, 4), (4, 4), (6, 0)]


def test_keep_one_of_null_and_repeated_ids(spark):
    docs = [(None, "a b c d e f g"), (None, "A b c d e f g"), (None, "other words"), (5, "first of two texts"), (5, "second"), (None, "mixed ids"), (7, "Mixed ids")]
    kept = J.keep_one(spark.createDataFrame([(d, t, "c", 1, 2) for d, t in docs], SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.text.lower()) for r in kept) == [(0, "a b c d e f g"), (0, "other words"), (5, "first of two texts"), (5, "second"), (7, "mixed ids")]
