import random

import pytest
from pyspark.sql import functions as F

from attestry.llm import revisit as R

SCHEMA = "record_id long, url string, ts long, kind string, digest string, headers map<string,string>, _slice int"


def test_canonical_url(spark):
    urls = ["http://WWW.Example.com:80/a/?b=2&a=1&utm_source=x#top", "https://m.example.com/a?a=1&b=2&ref=q", "example.com/a/?", "https://example.com", None, ""]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "url string").select(R.canonical_url(F.col("url"))).collect()]
    assert got == ["example.com/a?a=1&b=2", "example.com/a?a=1&b=2", "example.com/a", "example.com", None, ""]


def brute(rows):
    out = []
    for rid, url, ts, kind, _, headers in rows:
        if kind != "revisit":
            continue
        h = {k.lower(): v for k, v in (headers or {}).items()}
        earlier = [r for r in rows if r[3] == "response" and url is not None and r[1] == url and r[2] < ts]
        if url is None or not earlier:
            out.append((rid, "no_url" if url is None else "no_original", None, None, h))
            continue
        o = max(earlier, key=lambda r: (r[2], r[0]))
        oh = {k.lower(): v for k, v in (o[5] or {}).items()}
        if "etag" in h:
            ok = oh.get("etag", "").removeprefix("W/") == h["etag"].removeprefix("W/") and "etag" in oh
        else:
            ok = "last-modified" not in h or h["last-modified"] == oh.get("last-modified")
        if ok:
            out.append((rid, "resolved", o[0], o[4], {**oh, **{k: v for k, v in h.items() if k in R.MERGED}}))
        else:
            out.append((rid, "validator_mismatch", None, None, h))
    return sorted(out)


@pytest.mark.parametrize("slices", [1, 4, 50])
def test_brute_force(spark, slices):
    rng = random.Random(slices)
    rows = []
    for i in range(300):
        url = rng.choice(["hot.org/x"] * 6 + ["a.org", "b.org/1", None])
        kind = rng.choice(["response", "revisit"])
        headers = {}
        if rng.random() < 0.7:
            headers["ETag"] = rng.choice(['"1"', 'W/"1"', '"2"'])
        if rng.random() < 0.5:
            headers["last-modified"] = rng.choice(["d1", "d2"])
        headers["Date"] = str(i)
        headers["Content-Length"] = str(i)
        rows.append((i, url, rng.randint(0, 200), kind, f"dg{i}" if kind == "response" else None, rng.choice([headers, headers, None])))
    got = R.resolve(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA), slices)
    assert sorted((r.record_id, r.status, r.original_id, r.digest, r.headers) for r in got.collect()) == brute(rows)


def test_empty(spark):
    assert R.resolve(spark.createDataFrame([], SCHEMA)).count() == 0


def test_header_names_that_differ_in_case(spark):
    rows = [(1, "http://a.b/c", 1, "response", "d", {"ETag": "x", "etag": "y", "Server": None, "server": "s"}, 0), (2, "http://a.b/c", 2, "revisit", None, {"etag": "x"}, 0)]
    got = R.resolve(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.status, r.headers["etag"], r.headers["server"]) for r in got] == [("resolved", "x", None)]
