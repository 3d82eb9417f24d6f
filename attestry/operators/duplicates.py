"""Exact and near duplicates, and the flooding that they amount to."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.functions import columns as C
from attestry.functions import words

#: Buckets of word hashes whose loads stand for the rarity of words.
LOAD_BITS = 18
#: Rarest tokens that near sets share, by which their pairs are told from others.
MATCHES = 4
#: Vectors of a tile's side, and of the strips in which their hashes are compared; pairs that are sent on at once, about.
TILE_ROWS, STRIP_ROWS, STRIP_PAIRS = 8192, 64, 100_000

_U = np.uint64


def exact_groups(samples: DataFrame) -> DataFrame:
    """Samples whose content another one has: sample_id, contributor, content_hash, group_id (least id), group_size, n_contributors.

    A group costs one row for each of its samples, not one for each pair; the
    join back to the groups can be split by the optimizer where one is large.
    """
    hashed = samples.select("sample_id", "contributor", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))
    groups = hashed.groupBy("content_hash").agg(F.min("sample_id").alias("group_id"), F.count("*").alias("group_size"), F.countDistinct(F.coalesce("contributor", F.lit(""))).alias("n_contributors"))
    return hashed.join(groups.filter("group_size > 1"), "content_hash").select("sample_id", "contributor", "content_hash", "group_id", "group_size", "n_contributors")


def exact_summary(samples: DataFrame) -> DataFrame:
    """One row: totals, exact pairs counted without making them, and the share of samples in any pair."""
    hashed = samples.select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"), "contributor")
    by_contributor = hashed.groupBy("h", "contributor").agg(F.count("*").alias("n"))
    groups = by_contributor.groupBy("h").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("contributor").isNotNull(), F.expr("n * (n - 1) div 2")).otherwise(F.lit(0))).alias("same"))
    pairs = F.sum(F.expr("n * (n - 1) div 2"))
    return groups.agg(
        F.sum("n").alias("total_samples"),
        pairs.alias("exact_pairs"),
        (pairs - F.sum("same")).alias("cross_contributor_pairs"),
        F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(F.lit(0))).alias("flagged_samples"),
        F.round(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(F.lit(0))) / F.sum("n"), 4).alias("flooding_risk"),
    )


def _word_levels(texts: DataFrame) -> np.ndarray:
    """For each bucket of word hashes its load over all texts, on a scale of logarithms; 0 where no two texts meet."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loads = np.zeros(1 << LOAD_BITS, np.int64)
        for batch in batches:
            held, have = [], 0
            for s in words.word_sets(batch.column("text")):
                held.append(s)
                have += len(s)
                if have > len(loads):
                    loads += np.bincount((np.concatenate(held) >> _U(64 - LOAD_BITS)).astype(np.int64), minlength=len(loads))
                    held, have = [], 0
            if held:
                loads += np.bincount((np.concatenate(held) >> _U(64 - LOAD_BITS)).astype(np.int64), minlength=len(loads))
        used = np.flatnonzero(loads)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(loads[used])], names=["bucket", "n"])

    counted = texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # one table, whatever the input
    out = np.zeros(1 << LOAD_BITS, np.uint8)
    out[counted.column("bucket").to_numpy()] = np.minimum(np.round(8 * np.log2(counted.column("n").to_numpy())), 255).astype(np.uint8)
    return out


def near_pairs(samples: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs of different token sets with a Jaccard index of at least ``threshold``.

    a_id, b_id (least ids of the samples with those sets) and similarity. Equal
    sets are taken as one. Tokens, and sets, are 64-bit hashes. Sets are joined
    on those tokens only that are among their first by rarity, enough that
    similar sets share ``MATCHES`` (or all that they must share, if fewer); of a
    pair's shared tokens the first ones in that order leave the most to share
    behind them, so a match with too little behind it isn't counted. Rarity is the load of a token's bucket, from one table of
    ``1 << LOAD_BITS``, so that no token has to be dealt out to be ranked, and
    tokens that are alone in theirs are not sent at all.
    """
    texts = samples.select("sample_id", F.lower("text").alias("text"))
    levels = samples.sparkSession.sparkContext.broadcast(_word_levels(texts))

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, sizes, lefts, keys = [], [], [], []
            for s in words.word_sets(batch.column("text")):
                if not len(s):
                    continue
                rank = np.sort((levels.value[(s >> _U(64 - LOAD_BITS)).astype(np.int64)].astype(_U) << _U(56)) | (s & _U((1 << 56) - 1)))
                rank = rank[: len(s) - math.ceil(len(s) * threshold - 1e-9) + MATCHES]
                alone = int(np.searchsorted(rank, _U(1 << 56)))  # level 0
                if alone < len(rank):
                    numbers.append(words.set_number(s))
                    sizes.append(len(s))
                    lefts.append(len(s) - alone)
                    keys.append(rank[alone:].astype(np.int64))
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            flat = pa.array(np.concatenate([np.zeros(0, np.int64), *keys]))
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(sizes, pa.int32()), pa.array(lefts, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["set", "n", "left", "keys"])

    def all_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(words.word_sets(batch.column("text")))
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = pa.array(np.concatenate([np.zeros(0, _U), *sets]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("sample_id"), pa.array([words.set_number(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["sample_id", "set", "tokens"])

    sent = texts.select("text").mapInArrow(rarest, "set long, n int, left int, keys array<long>")
    first = sent.groupBy("set").agg(F.first("n").alias("n"), F.first("left").alias("left"), F.first("keys").alias("keys")).select("set", "n", "left", F.posexplode("keys").alias("place", "key")).select("set", "n", (F.col("left") - F.col("place")).alias("left"), "key")
    left, right = (first.select(F.col("set").alias(f"{s}_set"), F.col("n").alias(f"{s}_n"), F.col("left").alias(f"{s}_left"), "key") for s in "ab")
    near = F.least("a_n", "b_n") >= F.greatest("a_n", "b_n") * F.lit(threshold) - 1e-9
    needed = F.ceil((F.col("a_n") + F.col("b_n")) * F.lit(threshold / (1 + threshold)) - 1e-6)
    behind = F.least("a_left", "b_left")
    matches = left.join(right, "key").filter((F.col("a_set") < F.col("b_set")) & near & (behind > needed - MATCHES)).select("a_set", "b_set", behind.alias("behind"), needed.cast("int").alias("needed"))
    counted = matches.groupBy("a_set", "b_set").agg(F.count("*").alias("n"), F.max("behind").alias("behind"), F.first("needed").alias("needed"))
    pairs = counted.filter((F.col("behind") >= F.col("needed")) & (F.col("n") >= F.least(F.lit(MATCHES), "needed"))).select("a_set", "b_set")
    id_type = samples.schema["sample_id"].dataType.simpleString()
    sets = texts.mapInArrow(all_tokens, f"sample_id {id_type}, set long, tokens array<long>").groupBy("set").agg(F.min("sample_id").alias("id"), F.first("tokens").alias("tokens"))
    for s in "ab":
        pairs = pairs.join(sets.select(F.col("set").alias(f"{s}_set"), F.col("id").alias(f"{s}_id"), F.col("tokens").alias(f"{s}_tokens")), f"{s}_set")
    both = F.size(F.array_intersect("a_tokens", "b_tokens"))
    similarity = both / (F.size("a_tokens") + F.size("b_tokens") - both)
    return pairs.filter("a_id <> b_id").select(F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id"), F.round(similarity, 6).alias("similarity")).filter(F.col("similarity") >= threshold)


def bit_hash_pairs(vectors: DataFrame, mean_bits: int = 6, difference_bits: int | None = None) -> DataFrame:
    """Pairs of vectors whose mean hashes differ in at most ``mean_bits`` bits and whose difference hashes in two more.

    Every pair is compared, by the bits of its hashes, in square tiles; only pairs within both limits get their
    similarities worked out, in the tile that holds both vectors.
    """
    pairs = _hash_pairs(vectors, mean_bits, mean_bits + 2 if difference_bits is None else difference_bits, True)
    ssim, mae = F.col("ssim"), F.col("mae")
    return pairs.select("a_id", "b_id", "mean_distance", "difference_distance", F.round(ssim, 4).alias("ssim"), F.round(mae, 4).alias("mae"), F.round(0.7 * ssim + 0.3 * (1 - mae), 4).alias("similarity"))


def _hash_pairs(vectors: DataFrame, mean_bits: int, difference_bits: int, similar: bool = False) -> DataFrame:
    """a_id, b_id and both distances of the pairs within both limits; with ``similar`` their ssim and mae too.

    A vector goes to one row and one column of tiles, and each pair meets in one tile. Vectors that are null, empty or
    hold null have no hash and are in no pair.
    """
    id_type = vectors.schema["sample_id"].dataType.simpleString()
    tiles = max(1, -(-vectors.count() // TILE_ROWS))
    other = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    whole = vectors.filter((F.size("vector") > 0) & ~F.exists("vector", F.isnull)).select("sample_id", "vector", F.pmod(F.xxhash64("sample_id"), F.lit(tiles)).cast("int").alias("own"), other.alias("other"))
    dealt = whole.select("sample_id", "vector", "own", F.least("own", "other").alias("row"), F.greatest("own", "other").alias("col"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        ids = table.column("sample_id").combine_chunks()
        packed = table.column("vector").combine_chunks()
        row, col = table.column("row")[0].as_py(), table.column("col")[0].as_py()
        mine = table.column("own").to_numpy()
        size = np.diff(packed.offsets.to_numpy())
        flat, begin = packed.values.to_numpy(zero_copy_only=False).astype(np.float64), packed.offsets.to_numpy()[:-1]
        same_size = {n: (np.flatnonzero(size == n), np.cumsum(size == n) - 1) for n in np.unique(size).tolist()}
        columns = {n: flat[begin[rows][:, None] + np.arange(n)].T for n, (rows, _) in same_size.items()}  # of vectors of one length, by place
        p, d = np.zeros(len(size), _U), np.zeros(len(size), _U)
        for n, (rows, _) in same_size.items():
            p[rows], d[rows] = _hashes(columns[n])

        def made(i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
            a, b = ids.take(pa.array(i)), ids.take(pa.array(j))
            swap = pc.greater(a, b)
            distances = [pa.array(np.bitwise_count(x[i] ^ x[j]).astype(np.int32)) for x in (p, d)]
            likeness = []
            if similar:
                ssim, mae = np.full(len(i), np.nan), np.full(len(i), np.nan)
                for n, (_, place) in same_size.items():
                    at = np.flatnonzero((size[i] == n) & (size[j] == n))
                    ssim[at], mae[at] = _similarities(columns[n], place[i[at]], place[j[at]])
                likeness = [pa.array(x, mask=size[i] != size[j]) for x in (ssim, mae)]
            names = ["a_id", "b_id", "mean_distance", "difference_distance", *["ssim", "mae"][: len(likeness)]]
            return pa.RecordBatch.from_arrays([pc.if_else(swap, b, a), pc.if_else(swap, a, b), *distances, *likeness], names=names).filter(pc.not_equal(a, b))

        left, right = np.flatnonzero(mine == row), np.flatnonzero(mine == col)
        held, have = [], 0
        for at in range(0, len(left), STRIP_ROWS):
            i, j = np.nonzero(np.bitwise_count(p[left[at : at + STRIP_ROWS], None] ^ p[None, right]) <= mean_bits)
            i, j = left[at + i], right[j]
            both = np.bitwise_count(d[i] ^ d[j]) <= difference_bits
            if row == col:
                both &= i < j
            held.append((i[both], j[both]))
            have += len(held[-1][0])
            if have >= STRIP_PAIRS:
                yield made(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, have = [], 0
        if have:
            yield made(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return dealt.groupBy("row", "col").applyInArrow(run, f"a_id {id_type}, b_id {id_type}, mean_distance int, difference_distance int" + ", ssim double, mae double" * similar)


def _hashes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``C.mean_hash`` and ``C.difference_hash`` of vectors of one length by place; not-a-number is above all numbers."""
    above = lambda a, b: (a > b) | (np.isnan(a) & ~np.isnan(b))
    p, d = np.zeros(x.shape[1], _U), np.zeros(x.shape[1], _U)
    ordered = np.sort(x, axis=0)
    middle = ordered[len(x) // 2] if len(x) % 2 else (ordered[len(x) // 2 - 1] + ordered[len(x) // 2]) / 2
    for k, e in enumerate(x):
        p = p << _U(1) | above(e, middle).astype(_U)
        if k:
            d = d << _U(1) | above(e, x[k - 1]).astype(_U)
    return p, d


def _similarities(x: np.ndarray, i: np.ndarray, j: np.ndarray, span: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """``C.ssim`` and ``C.mean_absolute_error`` of pairs of vectors by place, with sums in the order of the elements."""
    n = len(x)
    mean, square, cov, error = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(len(i)), np.zeros(len(i))
    for e in x:
        mean += e
        square += e * e
        a, b = e[i], e[j]
        cov += a * b
        error += np.abs(a - b)
    mean, square = mean / n, square / n
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    ma, mb = mean[i], mean[j]
    va, vb, cov = square[i] - ma * ma, square[j] - mb * mb, cov / n - ma * mb
    return ((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma * ma + mb * mb + c1) * (va + vb + c2) + 1e-7), error / n / span


def least_hash_distance(vectors: DataFrame, margin: float = 0.45, low: int = 4, high: int = 8) -> DataFrame:
    """Calibration on clean data: the least distance of two mean hashes, and the threshold from it.

    Looks for the least number of bits at which the join finds a pair, doubling
    it, so no pair beyond the nearest ones is ever made.
    """
    bits = 8
    while True:
        found = _hash_pairs(vectors, bits, 64).agg(F.min("mean_distance").alias("least")).first().least
        if found is not None or bits >= 32:
            break
        bits = min(32, bits * 2)
    spark = vectors.sparkSession
    threshold = high if found is None else max(low, min(high, int(found * margin)))
    return spark.createDataFrame([(found, threshold)], "least_distance int, threshold int")


def contributor_flooding(samples: DataFrame, ratio: float = 0.20, count: int = 2) -> DataFrame:
    """For each contributor: samples, samples with an exact copy by the same contributor, their share and whether that is flooding.

    A null contributor is a group with totals but, null being no equal of null, no pairs.
    """
    hashed = samples.select("contributor", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    own = hashed.groupBy("contributor", "h").agg(F.count("*").alias("n"))
    counted = own.groupBy("contributor").agg(
        F.sum("n").alias("total_samples"),
        F.sum(F.when((F.col("n") > 1) & F.col("contributor").isNotNull(), F.col("n")).otherwise(F.lit(0))).alias("duplicate_samples"),
        F.max(F.when(F.col("contributor").isNotNull(), F.col("n")).otherwise(F.lit(1))).alias("largest_group"),
    )
    share = F.round(F.col("duplicate_samples") / F.col("total_samples"), 4)
    return counted.select("contributor", "total_samples", "duplicate_samples", "largest_group", share.alias("duplicate_ratio"), ((share >= ratio) & (F.col("duplicate_samples") >= count)).alias("is_flooding"))


def cross_contributor_samples(samples: DataFrame) -> DataFrame:
    """Samples that another contributor's, or a nameless, sample equals."""
    groups = exact_groups(samples)
    nameless = groups.groupBy("group_id").agg(F.max(F.col("contributor").isNull()).alias("nameless"))
    return groups.join(nameless, "group_id").filter("n_contributors > 1 or nameless").select("sample_id", "contributor", "group_id")
