import hashlib
import re
from collections import Counter

from attestry.llm import fingerprint as P

SCHEMA = "doc_id long, text string, hash string, form int, id string"


def edits(docs):
    """Next document and edited text of each distinct document."""
    order = sorted(set((d, t or "") for d, t in docs), reverse=True)
    out = {}
    for k, (d, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)]
        cut = len(t) // 3
        out[d] = (len(t), t[: len(t) - cut] + nxt[1][:cut], nxt[0])
    return out


def jaccard(a, b):
    x, y = (Counter(w for w in re.split("[\x20\x09-\x0d]+", t.lower()) if w) for t in (a, b))
    low = sum(min(x[k], y[k]) for k in x | y)
    high = sum(max(x[k], y[k]) for k in x | y)
    return low / high if high else 1.0


def frame(spark, docs):
    return spark.createDataFrame([(d, t, "c", 1, "c") for d, t in docs], SCHEMA)


def test_contract(spark):
    docs = [(5, "one two three four five six"), (9, "Él niño " * 40), (7, None), (1, ""), (3, "short"), (20, "one two three four five six"), (21, "word " * 4000)]
    got = {r.doc_id: r for r in P.fingerprints(frame(spark, docs)).collect()}
    want = edits(docs)
    texts = {d: t or "" for d, t in docs}
    assert got.keys() == want.keys()
    for d, (n, edited, nxt) in want.items():
        r = got[d]
        assert r.n_chars == n and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert len(r.fingerprint) == len(r.edited_fingerprint) and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if jaccard(texts[d], texts[nxt]) == 1:
            assert r.near_next == 1
    assert got[5].fingerprint == got[20].fingerprint and got[7].fingerprint == got[1].fingerprint
    assert got[1].near_next == got[7].near_edited == 1.0 or got[7].n_chars == 0


def test_likeness_estimates_generalised_jaccard(spark):
    pairs = [(" ".join(f"w{i}" for i in range(100)), " ".join(f"w{i}" for i in range(k, 100 + k))) for k in (5, 20, 50, 80)]
    pairs.append(("a a a a b b c " * 3, "a a b b b b c c d " * 2))
    rows = [(2 * i + s, p[s]) for i, p in enumerate(pairs) for s in (0, 1)]
    found = {r.doc_id: r.components for r in P.components(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect()}
    for i, (a, b) in enumerate(pairs):
        same = sum(x == y for x, y in zip(found[2 * i], found[2 * i + 1])) / P.SAMPLES
        assert abs(same - jaccard(a, b)) < 0.2, (i, same, jaccard(a, b))


def test_repeated_null_and_empty(spark):
    got = P.fingerprints(frame(spark, [(1, "a b c"), (1, "a b c"), (1, "d e f"), (None, "null id")])).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "1", "None"]
    one = P.fingerprints(frame(spark, [(4, "abcdef")])).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and one[0].near_next == 1.0
    assert P.fingerprints(frame(spark, [])).count() == 0


def test_native(spark):
    plan = P.fingerprints(frame(spark, [(1, "a"), (2, "b")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
