"""Column expressions shared by the operators; all of them stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO_HASH = "0" * 64


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


def evidence_score(*parts: Column) -> Column:
    """Mean of the parts, each held to [0, 1], to four places."""
    return F.round(reduce(lambda a, b: a + b, [clamp(p) for p in parts]) / len(parts), 4)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x))


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def array_mean(a: Column) -> Column:
    return array_sum(a) / F.size(a)


def median(a: Column) -> Column:
    """Mean of the two middle values (of an even count)."""
    s = F.array_sort(a)
    half = (F.size(a) / 2).cast("int")
    return F.when(F.size(a) % 2 == 1, F.get(s, half)).otherwise((F.get(s, half - 1) + F.get(s, half)) / 2)


def bits(flags: Column) -> Column:
    """An array of at most 64 booleans as one number, the first being the highest bit."""
    return F.aggregate(flags, F.lit(0).cast("long"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b.cast("long")))


def mean_hash(v: Column) -> Column:
    """A bit for each value above the median."""
    middle = median(v)
    return bits(F.transform(v, lambda x: x > middle))


def difference_hash(v: Column) -> Column:
    """A bit for each value above the one before."""
    return bits(F.zip_with(F.slice(v, 2, F.size(v) - 1), F.slice(v, 1, F.size(v) - 1), lambda right, left: right > left))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def ssim(a: Column, b: Column, span: float = 2.0) -> Column:
    """Structural similarity of two vectors taken as one window."""
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    ma, mb = array_mean(a), array_mean(b)
    n = F.size(a)
    va, vb, cov = dot(a, a) / n - ma * ma, dot(b, b) / n - mb * mb, dot(a, b) / n - ma * mb
    return ((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma * ma + mb * mb + c1) * (va + vb + c2) + 1e-7)


def mean_absolute_error(a: Column, b: Column, span: float = 2.0) -> Column:
    return array_mean(F.zip_with(a, b, lambda x, y: F.abs(x - y))) / span


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    total = array_sum(e)
    return F.transform(e, lambda x: x / total)


def entropy(p: Column) -> Column:
    return -array_sum(F.transform(p, lambda x: x * F.log2(x + 1e-8)))


def argmax(p: Column) -> Column:
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC as two nested SHA-256, for a key known to the driver."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(x ^ pad for x in block)) for pad in (0x36, 0x5C))
    inside = F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(outer, inside), 256)


def base_name(path: Column) -> Column:
    """The part after the last slash or backslash."""
    return F.regexp_extract(path, r"[^\\/]+$", 0)


def contains_any(needle: str, *columns: str) -> Column:
    """Case-insensitive search over several columns; the empty needle and ALL match everything."""
    if needle in ("", "ALL"):
        return F.lit(True)
    return reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(F.col(c)), F.lit(needle.lower())), F.lit(False)) for c in columns])
