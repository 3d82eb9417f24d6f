"""Resolution of not-modified revisit records of web archives.

A revisit record says that the server answered "not modified": it has headers
but no body, and stands for the latest full response of the same canonical URL
before it.  That is an as-of join, done here without a task that needs all of
one URL's rows: every URL's records are dealt to slices of time; each (URL,
slice) passes its last full response on by one small row, and a window over
those finds what each slice starts from; inside a slice a window of its own
does the rest.  A slice holds a bounded stretch of time, so one very common URL
is spread over as many tasks as it has slices.

The found response is checked against the revisit's validators: its ETag by
weak comparison if the revisit names one, or else its Last-Modified, which
must be equal if named; if neither is named nothing is checked.  Headers that a
not-modified answer may update (``MERGED``) are taken from the revisit, all
others stay those of the response; names compare in lower case.

Defined cases: null URLs resolve to nothing ("no_url"), as do revisits without
an earlier response ("no_original"); a response at the very time of a revisit
isn't earlier; of responses at one time the one of largest record id is the
latest; repeated rows each give a row; null headers are none, and of header
names that differ in case alone the first in code point order counts; a very
long value is taken whole; full responses aren't returned; an empty table gives
none.  More columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Header fields that a not-modified answer updates; fixed values (RFC 9111).
MERGED = ["age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
#: Query parameters that don't change a page; fixed values.
TRACKING = "utm_[a-z]+|ref|gclid|fbclid|sessionid"
#: Records of a URL in a slice, about.
SLICE_ROWS = 10_000


def canonical_url(url: Column) -> Column:
    """Host (lower case, without www. or m. and port 80 or 443), path without a last slash, and sorted query without tracking; no scheme or fragment."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.lower(F.regexp_extract(bare, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^(www|m)\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^({TRACKING})(=|$)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), "^W/", "")


def _lower_keys(headers: Column) -> Column:
    """Headers by lower-case names; of names that differ in case alone, the value of the least (capitals first) counts."""
    names = F.array_distinct(F.transform(F.map_keys(headers), F.lower))
    of = lambda n: F.array_min(F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == n))["value"]
    unique = F.transform(names, lambda n: F.struct(n.alias("key"), of(n).alias("value")))
    return F.coalesce(F.map_from_entries(unique), F.create_map().cast("map<string,string>"))


def resolve(records: DataFrame, slices: int | None = None) -> DataFrame:
    """records: record_id long, url string, ts long, kind string ("response" or "revisit"), digest string, headers map.
    Returns for each revisit: record_id, canonical_url, ts, status, original_id, original_ts, digest, headers."""
    named = records.select("record_id", canonical_url(F.col("url")).alias("canonical_url"), "ts", "kind", "digest", _lower_keys(F.col("headers")).alias("headers"))
    if slices is None:
        slices = max(1, -(-records.count() // SLICE_ROWS))
    low, high = named.agg(F.min("ts"), F.max("ts")).first()
    width = max(1, -(-((high or 0) - (low or 0) + 1) // slices))
    dealt = named.withColumn("_slice", F.floor((F.col("ts") - F.lit(low or 0)) / F.lit(width)).cast("long"))
    known = dealt.filter(F.col("canonical_url").isNotNull())
    full = F.when(F.col("kind") == "response", F.struct("ts", "record_id", "digest", "headers"))
    order = [F.col("ts"), F.when(F.col("kind") == "response", 1).otherwise(0), F.col("record_id")]

    # what each slice of a URL starts from: the last full response of any slice before it
    last = known.groupBy("canonical_url", "_slice").agg(F.max_by(F.struct("ts", "record_id", "digest", F.to_json("headers").alias("headers")), F.when(F.col("kind") == "response", F.struct("ts", "record_id"))).alias("_last"))
    carried = last.select(
        "canonical_url",
        "_slice",
        F.last("_last", ignorenulls=True).over(W.partitionBy("canonical_url").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)).alias("_carried"),
    )
    within = W.partitionBy("canonical_url", "_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    seen = known.withColumn("_own", F.last(full, ignorenulls=True).over(within)).filter(F.col("kind") == "revisit")
    both = seen.join(carried, ["canonical_url", "_slice"], "left").select(
        "record_id",
        "canonical_url",
        "ts",
        "headers",
        F.coalesce(
            F.col("_own"),
            F.when(F.col("_carried").isNotNull(), F.struct(F.col("_carried.ts"), F.col("_carried.record_id"), F.col("_carried.digest"), F.from_json(F.col("_carried.headers"), "map<string,string>").alias("headers"))),
        ).alias("_o"),
    )
    nowhere = dealt.filter(F.col("canonical_url").isNull() & (F.col("kind") == "revisit")).select("record_id", "canonical_url", "ts", "headers", F.lit(None).cast(both.schema["_o"].dataType).alias("_o"))
    tag, when = F.col("headers")["etag"], F.col("headers")["last-modified"]
    ok = F.when(tag.isNotNull(), F.coalesce(_weak(tag) == _weak(F.col("_o.headers")["etag"]), F.lit(False))).otherwise(F.coalesce(when == F.col("_o.headers")["last-modified"], when.isNull()))
    status = F.when(F.col("canonical_url").isNull(), "no_url").when(F.col("_o").isNull(), "no_original").when(ok, "resolved").otherwise("validator_mismatch")
    permitted = F.map_filter("headers", lambda k, v: k.isin(MERGED))
    kept = F.map_filter(F.col("_o.headers"), lambda k, v: ~F.map_contains_key(permitted, k))
    resolved = F.col("status") == "resolved"
    return (
        both.unionByName(nowhere)
        .withColumn("status", status)
        .select(
            "record_id",
            "canonical_url",
            "ts",
            "status",
            F.when(resolved, F.col("_o.record_id")).alias("original_id"),
            F.when(resolved, F.col("_o.ts")).alias("original_ts"),
            F.when(resolved, F.col("_o.digest")).alias("digest"),
            F.when(resolved, F.map_concat(kept, permitted)).otherwise(F.col("headers")).alias("headers"),
        )
    )


def capture_log(pages: DataFrame) -> DataFrame:
    """Records for the pages table, which has no captures of its own: each page is a full response at time 10 x page_id, and a
    later revisit of the same URL whose validator fits that very response (5 of 7), an earlier one's (1 of 7) or is absent."""
    digest = F.md5(F.coalesce(F.col("html"), F.lit("")))
    of = F.pmod("page_id", F.lit(7))
    tag = F.concat(F.lit('"'), digest, F.lit('"'))
    day = F.concat(F.lit("day "), F.floor(F.col("page_id") / 100).cast("string"))
    responses = pages.select(
        (F.col("page_id") * 2).alias("record_id"),
        "url",
        (F.col("page_id") * 10).alias("ts"),
        F.lit("response").alias("kind"),
        digest.alias("digest"),
        F.map_from_arrays(F.array(*(F.lit(k) for k in ("ETag", "Last-Modified", "Content-Type", "Date"))), F.array(tag, day, F.lit("text/html"), (F.col("page_id") * 10).cast("string"))).alias("headers"),
    )
    at = F.col("page_id") * 10 + 5 + F.pmod(F.col("page_id") * 37, F.lit(5000)) * 10
    validator = F.when(of < 5, F.concat(F.lit("W/"), tag)).when(of == 5, F.lit('"stale"'))
    revisits = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"),
        "url",
        at.alias("ts"),
        F.lit("revisit").alias("kind"),
        F.lit(None).cast("string").alias("digest"),
        F.map_filter(
            F.map_from_arrays(F.array(*(F.lit(k) for k in ("ETag", "Date", "Set-Cookie", "Content-Type"))), F.array(validator, at.cast("string"), F.lit("no"), F.lit("none"))),
            lambda k, v: v.isNotNull(),
        ).alias("headers"),
    )
    return responses.unionByName(revisits)


def digest(resolved: DataFrame) -> DataFrame:
    """The columns of query op3: headers as sorted lines."""
    lines = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")
    return resolved.withColumn("headers", lines)
