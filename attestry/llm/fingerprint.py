"""Document fingerprints by consistent weighted sampling, on built-in SQL functions alone.

A text's terms are its lower-cased words, weighted by their counts.  Sample k
of a term of weight w has r and c from Gamma(2, 1) and b from (0, 1), all fixed
by the hash of the term and k:

    t = floor(ln w / r + b)      ln a = ln c - r (t - b) - r

The term of least a in a text, with its t, is the text's k-th component.  Two
texts have equal components with a probability of their generalised Jaccard
similarity: the sum of the lesser over the sum of the greater weights.

Both gamma variables and b take their bits from one hash for each term and k.
A text and its edited text share most terms at the same weight: such a term is
sampled once, for both.

Whole texts are dealt once, by document; the start of the next text is sent
there, and counting terms, sampling and taking the least follow on that
dealing, with only ``SAMPLES`` numbers kept for each document's shared,
own and changed terms.

Defined cases: null text is empty; texts without a word have the fingerprint of
zeros and a likeness of 1 to each other; documents are ordered by id from the
largest (null last), then by the hash of the text; a single document is its own
next one; repeated rows (same id, same text) have one place in the order and are
each returned; an empty table gives none; a very long text costs one row for
each of its words; more columns are dropped, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestry.llm._text import cut, written

SAMPLES = 64
LEAST = -(1 << 63)
#: Bits of a component that the fingerprint keeps.
KEPT_BITS = 15
#: Terms of both texts at one weight, of the own text, of the edited text.
SHARED, OWN, CHANGED = range(3)
_BREAK = "[\\x20\\x09-\\x0D]+"
#: A digest of 64 hexadecimal digits travels as longs of at most this many digits.
_DIGITS = 15


def _gamma(h: Column, place: int) -> Column:
    """A number of Gamma(2, 1), the sum of two exponential ones, from 24 bits of a hash."""
    first, second = (F.shiftrightunsigned(h, p).bitwiseAND(F.lit(0xFFF)) + F.lit(0.5) for p in (place, place + 12))
    return F.lit(24 * math.log(2)) - F.ln(first * second)


def _sample(k: int) -> Column:
    """ln a in the high half of a long and the hashed (term, t) in the low half, so that the least one is the component; never negative."""
    h = F.xxhash64("_term", F.lit(k))
    r, log_c = _gamma(h, 0), F.ln(_gamma(h, 24))
    b = F.shiftrightunsigned(h, 48) * F.lit(1 / 65536)
    t = F.floor(F.col("_log_w") / r + b)
    log_a = log_c - r * (t - b + F.lit(1.0))
    high = F.shiftleft(F.floor((log_a + F.lit(512.0)) * F.lit(float(1 << 20))), 32)
    low = h.bitwiseXOR(F.shiftrightunsigned(h, 29)).bitwiseXOR(t).bitwiseAND(F.lit(0xFFFFFFFF))
    return high.bitwiseOR(low)


def _components(minima: str, samples: int) -> Column:
    """The array of short of the samples' minima; null where there was no term."""
    kept = F.array(*(F.col(f"{minima}{k}").bitwiseAND(F.lit((1 << KEPT_BITS) - 1)).cast("short") for k in range(samples)))
    return F.when(F.col(f"{minima}0").isNotNull(), kept)


def components(texts: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """keys and components (array of short) of every row of texts (keys, text); keys must be unique. Rows without a word are missing."""
    words = texts.select(*keys, F.explode(F.split("text", _BREAK)).alias("_word")).filter("_word <> ''")
    terms = words.groupBy(*keys, F.xxhash64(F.lower("_word")).alias("_term")).count()
    weighted = terms.select(*keys, "_term", F.ln(F.col("count").cast("double")).alias("_log_w"))
    least = weighted.groupBy(*keys).agg(*(F.min(_sample(k)).alias(f"_m{k}") for k in range(samples)))
    return least.select(*keys, _components("_m", samples).alias("components"))


def _paired_components(texts: DataFrame, keys: list[str], samples: int) -> DataFrame:
    """keys, own, changed and edited_sha256 for rows of texts (keys, text, n, head); keys must be unique."""
    kept = F.expr("substring(text, 1, n - cast(floor(n / 3) as int))")
    tail = F.expr("substring(text, n - cast(floor(n / 3) as int) + 1)")
    cut_texts = texts.select(*keys, F.split(kept, _BREAK).alias("_kept"), kept.alias("_start"), tail.alias("_tail"), "head")
    last = F.element_at("_kept", -1)  # the word that the cut is in, if any
    split = cut_texts.select(
        *keys,
        (F.size("_kept") - 1).alias("_shared"),
        F.expr("slice(_kept, 1, size(_kept) - 1)").alias("_common"),
        F.split(F.concat(last, F.col("_tail")), _BREAK).alias("_own"),
        F.split(F.concat(last, F.col("head")), _BREAK).alias("_changed"),
        F.sha2(F.concat("_start", "head"), 256).alias("_sha"),
    )
    flat = split.select(
        *keys,
        "_shared",
        (F.col("_shared") + F.size("_own")).alias("_to_own"),
        (F.col("_shared") + F.size("_own") + F.size("_changed")).alias("_to_changed"),
        F.posexplode(F.concat("_common", "_own", "_changed", F.array("_sha"))).alias("_place", "_word"),
    ).filter("_word <> ''")
    is_term = F.col("_place") < F.col("_to_changed")
    marked = flat.select(
        *keys,
        F.when(is_term, F.xxhash64(F.lower("_word"))).alias("_term"),
        F.when(~is_term, F.col("_word")).alias("_info"),
        F.when(F.col("_place") < F.col("_to_own"), 1).otherwise(0).alias("_in_own"),
        F.when((F.col("_place") < F.col("_shared")) | ((F.col("_place") >= F.col("_to_own")) & is_term), 1).otherwise(0).alias("_in_changed"),
    )
    counted = marked.groupBy(*keys, "_term", "_info").agg(F.sum("_in_own").alias("_w"), F.sum("_in_changed").alias("_v"))
    of = lambda part, weight: F.struct(F.lit(part).alias("part"), F.ln(F.col(weight).cast("double")).alias("log_w"))
    parts = (
        F.when(F.col("_w") == F.col("_v"), F.array(of(SHARED, "_w")))  # the row of the digest too, without weight
        .when(F.col("_v") == 0, F.array(of(OWN, "_w")))
        .when(F.col("_w") == 0, F.array(of(CHANGED, "_v")))
        .otherwise(F.array(of(OWN, "_w"), of(CHANGED, "_v")))
    )
    weighted = counted.select(*keys, "_term", "_info", F.explode(parts).alias("_p")).select(*keys, "_term", "_info", F.col("_p.part").alias("_part"), F.col("_p.log_w").alias("_log_w"))
    at = range(0, 64, _DIGITS)
    digest = [F.max(F.conv(F.expr(f"substring(_info, {a + 1}, {_DIGITS})"), 16, 10).cast("long")).alias(f"_d{a}") for a in at]
    minima = weighted.groupBy(*keys, "_part").agg(*(F.min(_sample(k)).alias(f"_m{k}") for k in range(samples)), *digest)
    of_part = lambda k, part: F.min(F.when(F.col("_part") != part, F.col(f"_m{k}")))
    both = [of_part(k, part).alias(f"{name}{k}") for k in range(samples) for name, part in (("_w", CHANGED), ("_v", OWN))]
    least = minima.groupBy(*keys).agg(*both, *(F.max(f"_d{a}").alias(f"_d{a}") for a in at))
    sha = F.concat(*(F.lpad(F.lower(F.hex(f"_d{a}")), min(_DIGITS, 64 - a), "0") for a in at))
    return least.select(*keys, _components("_w", samples).alias("own"), _components("_v", samples).alias("changed"), sha.alias("edited_sha256"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal components; a text without words is like another one only."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.size(a)
    return F.when(a.isNull() & b.isNull(), F.lit(1.0)).when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(same)


def as_text(c: Column, samples: int = SAMPLES) -> Column:
    """Components as hexadecimal digits."""
    digits = -(-KEPT_BITS // 4)
    return F.coalesce(F.array_join(F.transform(c, lambda x: F.lpad(F.lower(F.hex(x)), digits, "0")), ""), F.lit("0" * digits * samples))


def _next_documents(keyed: DataFrame) -> DataFrame:
    """keyed (id, hash, ...) with next_id and next_hash: the next row by id from the largest, the first row after the last."""
    order = [F.col("id").desc(), F.col("hash").desc()]
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(keyed.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    inside = dealt.withColumn("_next", F.lead(F.struct("id", "hash")).over(W.partitionBy("part").orderBy(*order)))
    firsts = dealt.groupBy("part").agg(F.max(F.struct("id", "hash")).alias("_first"))  # a row for each partition
    across = firsts.select("part", F.lead("_first").over(W.orderBy("part")).alias("_after"), F.first("_first").over(W.orderBy("part")).alias("_start"))
    joined = inside.join(F.broadcast(across), "part").withColumn("_next", F.coalesce("_next", "_after", "_start"))
    return joined.select(*keyed.columns, F.col("_next.id").alias("next_id"), F.col("_next.hash").alias("next_hash"))


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next for each row of docs."""
    # a null id stands after all others, under the least number; its hash tells it from that number
    nothing = F.col("doc_id").isNull()
    rows = docs.select(F.when(nothing, LEAST).otherwise(F.col("doc_id")).alias("id"), F.coalesce("text", F.lit("")).alias("text"), nothing.alias("nothing"))
    rows = rows.withColumn("hash", F.xxhash64("text", "nothing"))
    key = ["id", "hash"]
    texts = rows.groupBy(*key).agg(F.first("text").alias("text"))  # the same dealing for both uses
    keyed = rows.groupBy(*key).agg(F.max(F.length("text")).alias("n"), F.count("*").alias("rows"), F.max("nothing").alias("nothing"))
    order = cut(_next_documents(keyed))

    given = order.select(F.col("next_id").alias("id"), F.col("next_hash").alias("hash"), F.col("id").alias("to_id"), F.col("hash").alias("to_hash"), "n")
    heads = texts.join(given, key).select(F.col("to_id").alias("id"), F.col("to_hash").alias("hash"), "n", F.expr("substring(text, 1, cast(floor(n / 3) as int))").alias("head"))
    found = _paired_components(texts.join(heads, key), key, samples)
    whole = written(found.join(order, key))
    other = whole.select(F.col("id").alias("next_id"), F.col("hash").alias("next_hash"), F.col("own").alias("following"))
    matched = whole.join(other, ["next_id", "next_hash"])
    return matched.select(
        F.when(~F.col("nothing"), F.col("id")).alias("doc_id"),
        F.col("n").cast("long").alias("n_chars"),
        "edited_sha256",
        as_text(F.col("own"), samples).alias("fingerprint"),
        as_text(F.col("changed"), samples).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"),
        F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("_copy"),
    ).drop("_copy")
