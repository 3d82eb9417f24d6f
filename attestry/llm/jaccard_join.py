"""N-gram Jaccard join over size-banded tiles with bitmap signatures.

A document's set holds the 64-bit hashes of its distinct word n-grams.  Equal
sets are joined by their hash and go on as one.  Of two sets whose Jaccard
index is at least t, each has one of the other's elements among its own first
n - ceil(t n) + 1 elements, in any order common to all sets.  The order here
starts with the elements whose hash bucket is least loaded over all documents
(one table of ``1 << LOAD_BITS`` counts, whatever the input's size), so common
passages come last and hardly ever make candidates.

1. Keys: each set sends its first elements to shards by range of the hash, as
   sorted arrays.  A shard finds the elements that several sets sent, orders
   their sets by size and cuts them where the sizes are too far apart to link:
   these tiles hold all links that there can be.
2. Stars: in each tile every set is compared with one centre, the one that
   meets most others over all of its tiles; of its centres a set takes those
   that it meets most often.  What links is joined to components.
3. Rest: in tiles that still hold several components, every set outside the
   tile's largest is compared with all sets of other components in the tile.
   In small tiles these are pairs; a large tile is cut into square blocks of
   ``BLOCK`` sets a side, and only pairs that their bitmaps let pass leave it.
   So every pair of a tile is either compared or known to be connected.
4. Counts, if asked for: all pairs of each component, in blocks too, since the
   steps before leave out pairs that are connected already.

A comparison first bounds the overlap from above by the bit counts of the two
bitmaps (a bit that only one set has is an element that the other lacks), and
only what passes is intersected exactly, as sorted arrays.

Defined cases: null text, and text without a word, has an empty set and links
with nothing; with fewer than n words the whole sequence is the one element;
repeated rows, and rows of one id with several texts, are each returned; null
ids never become a component's id unless all of its ids are null; more columns
are dropped.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.llm import _text
from attestry.llm._components import components

WORDS, PERCENT = 5, 80
LOAD_BITS = 20
STARS = 3
#: Size of the table that tells which documents any candidate needs.
MARK_BITS = 24
#: Text that makes the keys of one shard, about.
SHARD_BYTES = 8 << 20
_FLUSH = 2_000_000
#: Sets of a tile up to which its pairs are made one by one, and sets of a block's side in larger ones.
SMALL, BLOCK = 32, 2048

_U = np.uint64


def sets_of(buf: np.ndarray, offs: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted set of each row."""
    starts, ends, first = _text.words(buf, offs, _text.SPACE_SEP)
    hashes = _text.word_hashes(buf, starts, ends)
    rolled = _text.windows(hashes, n)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(rolled[a : b - n + 1]))
        else:
            out.append(_text.windows(hashes[a:b], b - a) if b > a else np.zeros(0, _U))
    return out


def set_id(s: np.ndarray) -> int:
    """One signed 64-bit number for equal sets."""
    return int(_text.mix(np.array([_text.mix(s ^ _U(0x6A09E667F3BCC909)).sum(dtype=_U) + _U(len(s))]))[0].astype(np.int64))


def bitmap(s: np.ndarray) -> np.ndarray:
    """At least four bits an element, a power of two; bytes."""
    bits = 1 << max(7, int(4 * len(s) - 1).bit_length())
    out = np.zeros(bits, bool)
    out[(s >> _U(17)).astype(np.int64) & (bits - 1)] = True
    return np.packbits(out, bitorder="little")


def overlap_bound(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Greatest possible overlap of pairs of sets, from rows of bitmaps; the wider ones are folded."""
    while a.shape[1] != b.shape[1]:
        if a.shape[1] > b.shape[1]:
            a = a[:, : a.shape[1] // 2] | a[:, a.shape[1] // 2 :]
        else:
            b = b[:, : b.shape[1] // 2] | b[:, b.shape[1] // 2 :]
    return np.minimum(n_a - np.bitwise_count(a & ~b).sum(1, dtype=np.int64), n_b - np.bitwise_count(b & ~a).sum(1, dtype=np.int64))


def _loads(docs: DataFrame, n: int) -> np.ndarray:
    """Logarithm of the load of each hash bucket, from all documents."""
    chunk = 1 << 16

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loads = np.zeros(1 << LOAD_BITS, np.uint64)
        for batch in batches:
            for _row, _end, buf, offs in _text.text_slices(batch.column("text")):
                every = np.concatenate(sets_of(buf, offs, n))
                loads += np.bincount((every >> _U(64 - LOAD_BITS)).astype(np.int64), minlength=1 << LOAD_BITS).astype(_U)
        parts = range(0, 1 << LOAD_BITS, chunk)
        yield pa.RecordBatch.from_arrays([pa.array([p // chunk for p in parts], pa.int32()), pa.array([zlib.compress(loads[p : p + chunk].tobytes(), 1) for p in parts], pa.binary())], names=["part", "loads"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(x), np.uint64) for x in table.column("loads").to_pylist())
        return pa.table({"part": table.column("part")[:1].cast(pa.int32()), "loads": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    out = np.zeros(1 << LOAD_BITS, np.uint64)
    counted = docs.select("text").mapInArrow(count, "part int, loads binary")
    # pairs of parts first, so that no task holds more than a few hundred tables
    halved = counted.withColumn("_salt", F.spark_partition_id() % 64).groupBy("part", "_salt").applyInArrow(add, "part int, loads binary")
    for r in halved.groupBy("part").applyInArrow(add, "part int, loads binary").collect():  # one table, whatever the input
        out[r.part * chunk : (r.part + 1) * chunk] = np.frombuffer(zlib.decompress(r.loads), np.uint64)
    return np.minimum(np.round(8 * np.log2(out + 1.0)), 255).astype(np.uint8)


def _sketch(docs: DataFrame, n: int, sid: str = "sid", size: str = "n_shingles") -> DataFrame:
    """docs with the set's number and size for every row."""

    def make(batch: pa.RecordBatch) -> list:
        sids, sizes = [], []
        for _row, _end, buf, offs in _text.text_slices(batch.column("text")):
            for s in sets_of(buf, offs, n):
                sids.append(set_id(s))
                sizes.append(len(s))
        return [pa.array(sids, pa.int64()), pa.array(sizes, pa.int64())]

    return _text.append_arrow(docs, T.StructType([T.StructField(sid, T.LongType()), T.StructField(size, T.LongType())]), make)


def _tiles(docs: DataFrame, loads, n: int, percent: int, shards: int) -> DataFrame:
    """tile, sid, n, size: the sets of each tile, and how many it has."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array([(s << 64) // shards for s in range(1, shards)], _U)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        have, seen = 0, set()

        def flush() -> pa.RecordBatch:
            keys, sids, sizes = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(keys, kind="stable")
            keys, sids, sizes = keys[order], sids[order], sizes[order]
            bounds = np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)]))
            used = np.flatnonzero(np.diff(bounds))
            return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *(pa.array([x[bounds[s] : bounds[s + 1]].tobytes() for s in used], pa.binary()) for x in (keys, sids, sizes))], names=["shard", "keys", "sids", "sizes"])

        for batch in batches:
            for _row, _end, buf, offs in _text.text_slices(batch.column("text")):
                for s in sets_of(buf, offs, n):
                    if 100 * len(s) < percent * (len(s) + 1):  # links with equal sets only
                        continue
                    first = len(s) - (percent * len(s) + 99) // 100 + 1
                    sid = set_id(s)
                    if sid in seen:
                        continue
                    seen.add(sid)
                    rank = (loads.value[(s >> _U(64 - LOAD_BITS)).astype(np.int64)].astype(_U) << _U(56)) | (s & _U((1 << 56) - 1))
                    keys = s[np.argpartition(rank, first - 1)[:first]] if first < len(s) else s
                    held.append((keys, np.full(len(keys), sid, np.int64), np.full(len(keys), len(s), np.int32)))
                    have += len(keys)
                if have >= _FLUSH:
                    yield flush()
                    held, have, seen = [], 0, set()
        if held:
            yield flush()

    def meet(table: pa.Table) -> pa.Table:
        keys, sids, sizes = (np.concatenate([np.frombuffer(x, t) for x in table.column(c).to_pylist()]) for c, t in (("keys", _U), ("sids", np.int64), ("sizes", np.int32)))
        order = np.lexsort((sids, sizes, keys))
        keys, sids, sizes = keys[order], sids[order], sizes[order].astype(np.int64)
        fresh = np.ones(len(keys), bool)
        fresh[1:] = (keys[1:] != keys[:-1]) | (sids[1:] != sids[:-1]) | (sizes[1:] != sizes[:-1])
        keys, sids, sizes = keys[fresh], sids[fresh], sizes[fresh]
        begins = np.ones(len(keys), bool)
        begins[1:] = (keys[1:] != keys[:-1]) | (100 * sizes[:-1] < percent * sizes[1:])
        at = np.flatnonzero(begins)
        run = np.cumsum(begins) - 1
        shared = np.diff(np.append(at, len(keys)))[run] > 1
        tile = _text.mix(keys * _U(3) + sizes[at][run].astype(_U)).astype(np.int64)
        size = np.diff(np.append(at, len(keys)))[run]
        return pa.table({"tile": pa.array(tile[shared]), "sid": pa.array(sids[shared]), "n": pa.array(sizes[shared]), "size": pa.array(size[shared].astype(np.int64))})

    sent = docs.select("text").mapInArrow(send, "shard int, keys binary, sids binary, sizes binary")
    return sent.groupBy("shard").applyInArrow(meet, "tile long, sid long, n long, size long")


def _marks(ids: DataFrame) -> np.ndarray:
    """One bit in ``1 << MARK_BITS`` for each id's hash, so that other rows can be left out before any shuffle."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << MARK_BITS, bool)
        for batch in batches:
            bits[_place(batch.column("doc_id"))] = True
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.packbits(bits).tobytes(), 1)], pa.binary())], names=["bits"])

    def join(table: pa.Table) -> pa.Table:
        total = np.zeros(1 << (MARK_BITS - 3), np.uint8)
        for x in table.column("bits").to_pylist():
            total |= np.frombuffer(zlib.decompress(x), np.uint8)
        return pa.table({"bits": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    marked = ids.select("doc_id").mapInArrow(mark, "bits binary").groupBy(F.spark_partition_id() % 64).applyInArrow(join, "bits binary")
    whole = marked.groupBy(F.isnull("bits")).applyInArrow(join, "bits binary").first()  # of at most 64 tables
    return np.frombuffer(zlib.decompress(whole.bits), np.uint8) if whole else np.zeros(1 << (MARK_BITS - 3), np.uint8)


def _marked(marks: np.ndarray, ids: pa.Array) -> np.ndarray:
    place = _place(ids)
    return (marks[place >> 3] >> (7 - (place & 7)) & 1).astype(bool)


def _place(ids: pa.Array) -> np.ndarray:
    return (_text.mix(ids.fill_null(-1).to_numpy(zero_copy_only=False).astype(_U)) >> _U(64 - MARK_BITS)).astype(np.int64)


def _sets(docs: DataFrame, wanted: DataFrame, n: int, elements: bool) -> DataFrame:
    """sid, n and bits, or sid and elements, of the sets whose representative rows are wanted (doc_id, sid), from their texts."""
    marks = docs.sparkSession.sparkContext.broadcast(_marks(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(_marked(marks.value, batch.column("doc_id"))))
            for row, end, buf, offs in _text.text_slices(batch.column("text")):
                sets = sets_of(buf, offs, n)
                data = [s.tobytes() if elements else bitmap(s).tobytes() for s in sets]
                cols = [([set_id(s) for s in sets], pa.int64()), ([len(s) for s in sets], pa.int64()), (data, pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[row:end], *(pa.array(c, t) for c, t in cols)], names=["doc_id", "sid", "n", "data"])

    made = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, sid long, n long, data binary")
    rows = made.join(wanted.select(F.col("doc_id").alias("_id"), F.col("sid").alias("_sid")), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("sid") == F.col("_sid")))
    return rows.dropDuplicates(["sid"]).select("sid", "n", F.col("data").alias("elements" if elements else "bits"))


def _compare(pairs: DataFrame, docs: DataFrame, members: DataFrame, bitmaps: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that link; members: sid and a doc_id of each set."""

    def linked(overlap: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
        return 100 * overlap >= percent * (n_a + n_b - overlap)

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            bits = [batch.column(c).to_pylist() for c in ("bits_a", "bits_b")]
            widths = np.array([[len(x) for x in side] for side in bits]).reshape(2, -1)
            keep = np.zeros(len(n_a), bool)
            for w in set(map(tuple, widths.T.tolist())):
                at = np.flatnonzero((widths[0] == w[0]) & (widths[1] == w[1]))
                for lo in range(0, len(at), max(1, (1 << 24) // max(w))):
                    some = at[lo : lo + max(1, (1 << 24) // max(w))]
                    a, b = (np.frombuffer(b"".join(side[i] for i in some), np.uint8).reshape(len(some), -1) for side in bits)
                    keep[some] = linked(overlap_bound(a, b, n_a[some], n_b[some]), n_a[some], n_b[some])
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("elements_a").to_pylist(), batch.column("elements_b").to_pylist(), strict=True):
                a, b = np.frombuffer(x, _U), np.frombuffer(y, _U)
                overlap = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * overlap >= percent * (len(a) + len(b) - overlap))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def both(of: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
        for side in "ab":
            of = of.join(sets.select(F.col("sid").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns)), side)
        return of

    passed = _text.cut(both(pairs, bitmaps, "n", "bits").mapInArrow(bound, "a long, b long"))
    ends = passed.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    sets = _sets(docs, ends.join(members, "sid"), words, True)
    return both(passed, sets, "elements").mapInArrow(exact, "a long, b long")


def _block_pairs(rows: DataFrame, bitmaps: DataFrame, percent: int, groups: int) -> DataFrame:
    """Pairs (a, b) of large tiles, of a set outside the tile's largest component with one of another component, that their bitmaps let pass."""
    side = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("sid"), side).cast("int")
    every = F.explode(F.sequence(F.lit(0), side - 1))
    known = rows.join(bitmaps.select("sid", "bits"), "sid")
    columns = ["tile", "sid", "n", "component", "major", "bits"]
    outside = known.filter("component <> major").select(*columns, own.alias("row"), every.alias("col"), F.lit(True).alias("outside"))
    inside = known.select(*columns, every.alias("row"), own.alias("col"), F.lit(False).alias("outside"))
    dealt = outside.unionByName(inside).withColumn("_g", F.pmod(F.xxhash64("tile", "row", "col"), F.lit(groups)))

    def run(table: pa.Table) -> pa.Table:
        tile, sid, n, component, major, row, col, out = (table.column(c).to_numpy() for c in ("tile", "sid", "n", "component", "major", "row", "col", "outside"))
        out = out.astype(bool)
        bits = table.column("bits").to_pylist()
        order = np.lexsort((col, row, tile))
        cut = np.flatnonzero((np.diff(tile[order]) != 0) | (np.diff(row[order]) != 0) | (np.diff(col[order]) != 0)) + 1
        found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for block in np.split(order, cut):
            left, right = block[out[block]], block[~out[block]]
            if not len(left) or not len(right):
                continue
            width = min(len(bits[i]) for i in block)
            folded = np.stack([np.bitwise_or.reduce(np.frombuffer(bits[i], np.uint64).reshape(-1, width // 8), axis=0) for i in right])
            for i in left:
                may = (component[right] != component[i]) & ((component[right] == major[i]) | (sid[right] > sid[i])) & (100 * np.minimum(n[right], n[i]) >= percent * np.maximum(n[right], n[i]))
                if not may.any():
                    continue
                others, mine = folded[may], np.bitwise_or.reduce(np.frombuffer(bits[i], np.uint64).reshape(-1, width // 8), axis=0)
                size = n[right][may]
                bound = np.minimum(n[i] - np.bitwise_count(mine & ~others).sum(1, dtype=np.int64), size - np.bitwise_count(others & ~mine).sum(1, dtype=np.int64))
                hit = sid[right][may][100 * bound >= percent * (n[i] + size - bound)]
                found_a.append(np.minimum(hit, sid[i]))
                found_b.append(np.maximum(hit, sid[i]))
        return pa.table({"a": pa.array(np.concatenate(found_a)), "b": pa.array(np.concatenate(found_b))})

    return dealt.groupBy("_g").applyInArrow(run, "a long, b long")


def _shards(docs: DataFrame) -> int:
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))


def _named(docs: DataFrame, words: int, percent: int, shards: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, sid and n_shingles of each row of docs; sid, doc_id (the least), copies (rows) and component (the least sid that it reaches by links) of each set."""
    spark = docs.sparkSession
    sketch = _text.cut(_sketch(docs, words).select("doc_id", "sid", "n_shingles"))
    members = sketch.filter("n_shingles > 0").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    tiles = _text.cut(_tiles(docs, spark.sparkContext.broadcast(_loads(docs, words)), words, percent, shards))
    bitmaps = _text.cut(_sets(docs, tiles.select("sid").distinct().join(members, "sid"), words, False))

    # centres
    weights = tiles.groupBy("sid").agg(F.sum("size").alias("weight"))
    weighed = tiles.join(weights, "sid")
    hubs = weighed.groupBy("tile").agg(F.max_by(F.struct(F.col("sid").alias("hub"), F.col("n").alias("n_hub")), F.struct("weight", "sid")).alias("_h")).select("tile", "_h.*")
    near = 100 * F.least("n", "n_hub") >= percent * F.greatest("n", "n_hub")
    starred = tiles.join(hubs, "tile").filter((F.col("sid") != F.col("hub")) & near).groupBy("sid", "hub").count()
    best = starred.withColumn("_k", F.row_number().over(W.partitionBy("sid").orderBy(F.desc("count"), "hub"))).filter(F.col("_k") <= STARS)
    first = _text.cut(_compare(best.select(F.least("sid", "hub").alias("a"), F.greatest("sid", "hub").alias("b")).distinct(), docs, members, bitmaps, words, percent))
    found = components(first).select(F.col("node").alias("sid"), "component")

    # the rest
    placed = tiles.join(found, "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    split = placed.groupBy("tile", "component").count().groupBy("tile").agg(F.max_by("component", F.struct("count", "component")).alias("major"), F.count("*").alias("_c")).filter("_c > 1").drop("_c")
    mixed = _text.cut(placed.join(split, "tile"))
    few = mixed.filter(F.col("size") <= SMALL)
    left = few.filter("component <> major").select("tile", F.col("sid").alias("a"), F.col("n").alias("n_a"), F.col("component").alias("c_a"))
    right = few.select("tile", F.col("sid").alias("b"), F.col("n").alias("n_b"), F.col("component").alias("c_b"), "major")
    pairs = (
        left.join(right, "tile")
        .filter((F.col("c_a") != F.col("c_b")) & ((F.col("c_b") == F.col("major")) | (F.col("a") < F.col("b"))))
        .filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    )
    rest = pairs.unionByName(_block_pairs(mixed.filter(F.col("size") > SMALL), bitmaps, percent, shards)).distinct()
    second = _compare(rest, docs, members, bitmaps, words, percent)
    joined = components(first.unionByName(second)).select(F.col("node").alias("sid"), "component")

    return sketch, members.join(joined, "sid", "left").withColumn("component", F.coalesce("component", "sid"))


def link_counts(sets: list[np.ndarray], copies: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """For each set the copies of those that it links with, over all pairs of a set of left and one of right; over each pair once if both are the same.

    Elements of many sets are columns of a bit table, the others lists of their sets.
    """
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    fresh = np.ones(len(every), bool)
    fresh[1:] = np.diff(every[order]) != 0
    at = np.flatnonzero(fresh)
    shared = np.diff(np.append(at, len(every)))
    code = np.empty(len(every), np.int64)
    code[order] = np.cumsum(fresh) - 1
    many = shared > max(8, len(sets) // 8)
    column = np.cumsum(many) - 1
    table = np.zeros((len(sets), -(-max(1, int(many.sum())) // 64) * 64), bool)
    common = many[code]
    table[owner[common], column[code[common]]] = True
    table = np.packbits(table, axis=1).view(np.uint64)
    holders, first, few = owner[order], np.concatenate(([0], np.cumsum([len(s) for s in sets]))), ~many & (shared > 1)
    size = np.diff(first)
    links = np.zeros(len(sets), np.int64)
    same = left is right
    for k, i in enumerate(left.tolist()):
        others = right[k + 1 :] if same else right
        mine = code[first[i] : first[i + 1]]
        mine = mine[few[mine]]
        lengths = shared[mine]
        place = np.repeat(at[mine] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        overlap = np.bincount(holders[place], minlength=len(sets))[others] + np.bitwise_count(table[i] & table[others]).sum(1, dtype=np.int64)
        hit = others[100 * overlap >= percent * (size[i] + size[others] - overlap)]
        links[i] += copies[hit].sum()
        links[hit] += copies[i]
    return links


def _link_counts(docs: DataFrame, named: DataFrame, words: int, percent: int, groups: int) -> DataFrame:
    """sid and links (rows of other sets that link with it) of the sets of components of several sets.

    Links are inside components, so a component's pairs hold them all; a large one is cut into square
    blocks, and each of its pairs falls into one block.
    """
    several = named.groupBy("component").agg(F.count("*").alias("size")).filter("size > 1")
    wanted = _text.cut(named.join(several, "component"))
    side = F.ceil(F.col("size") / BLOCK).cast("int")
    known = _sets(docs, wanted, words, True).join(wanted.select("sid", "component", "copies", side.alias("side")), "sid")
    known = known.withColumn("own", F.pmod(F.xxhash64("sid"), F.col("side")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("side") - 1)))
    dealt = known.select("component", "sid", "copies", "own", F.least("own", "other").alias("row"), F.greatest("own", "other").alias("col"), "elements").withColumn("_g", F.pmod(F.xxhash64("component", "row", "col"), F.lit(groups)))

    def run(table: pa.Table) -> pa.Table:
        component, sid, copies, own, row, col = (table.column(c).to_numpy() for c in ("component", "sid", "copies", "own", "row", "col"))
        elements = table.column("elements").to_pylist()
        order = np.lexsort((col, row, component))
        cut = np.flatnonzero((np.diff(component[order]) != 0) | (np.diff(row[order]) != 0) | (np.diff(col[order]) != 0)) + 1
        links = np.zeros(len(sid), np.int64)
        for block in np.split(order, cut):
            left = np.flatnonzero(own[block] == row[block])
            right = left if row[block[0]] == col[block[0]] else np.flatnonzero(own[block] == col[block])
            links[block] = link_counts([np.frombuffer(elements[i], _U) for i in block], copies[block], left, right, percent)
        return pa.table({"sid": pa.array(sid), "links": pa.array(links)})

    return dealt.groupBy("_g").applyInArrow(run, "sid long, links long").groupBy("sid").agg(F.sum("links").alias("links"))


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, shards: int | None = None, links: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id (the least id that the row's document reaches by links) and sid (equal for equal sets) for each row of docs.

    With links also n_links: the other rows whose sets link with the row's own, those of equal sets among them, each pair compared.
    """
    docs = docs.select("doc_id", "text")
    if shards is None:
        shards = _shards(docs)
    sketch, named = _named(docs, words, percent, shards)
    columns = ["component_id"]
    if links:
        named = _text.cut(named)
        named = named.join(_link_counts(docs, named, words, percent, shards), "sid", "left").withColumn("n_links", F.col("copies") - 1 + F.coalesce("links", F.lit(0)))
        columns.append("n_links")
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    ids = named.join(least, "component").select("sid", *columns)
    full = sketch.filter("n_shingles > 0").join(ids, "sid", "left").select("doc_id", "n_shingles", *columns, "sid")
    empty = [F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links")][: len(columns)]
    return full.unionByName(sketch.filter("n_shingles = 0").select("doc_id", "n_shingles", *empty, "sid"))


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component: that of least id (null only if all of its ids are; then of least sid); rows with an empty set all stay.

    Components are told apart by their least sid, since several may have null or one repeated id as theirs.
    """
    pairs = docs.select("doc_id", "text")
    sketch, named = _named(pairs, words, percent, _shards(pairs))
    found = sketch.filter("n_shingles > 0").join(named.select("sid", "component"), "sid")
    kept = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "sid")).alias("_k")).select(F.col("_k.doc_id").alias("_kept_id"), F.col("_k.sid").alias("_kept_sid"))
    rows = _sketch(docs, words, "_sid", "_n")
    full = rows.filter("_n > 0").join(kept, F.col("doc_id").eqNullSafe(F.col("_kept_id")) & (F.col("_sid") == F.col("_kept_sid")), "left_semi").dropDuplicates(["doc_id", "_sid"])
    return full.unionByName(rows.filter("_n = 0")).select(docs.columns)
