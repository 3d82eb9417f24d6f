"""Packing along a space-filling curve.

Every document's token ids are counted into a hashed vector, the unit vector is
projected to ``DIMS`` fixed random directions, and the Hilbert index of the
quantised point is its key.  Documents are range-sorted by key (then id, then
ids), and each range is packed as one stream: documents follow each other along
the curve and are cut where a sequence is full, so no sequence but the last of
a range is short, and that rest is cut into powers of two, which need no
padding.  A range's sequences are numbered from its number times 2**32.

The ids go once to a table in the shared folder, so neither the sampling of
ranges nor a lost executor encodes anything again, and through one shuffle.

Defined cases: null text is empty and gives the end id alone; repeated rows are
each packed; rows of equal key are spread by id, so a large group of copies
doesn't meet in one range, and rows of equal key, id and ids follow each other in
any order; a very long text is cut into as many sequences as it fills; an empty
table gives none; more columns are dropped, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm import _bpe, _text

BUCKETS, DIMS, BITS = 256, 4, 15
SEQUENCE = 1024
END_ID = 0
#: Tokens of a range on average (two or four bytes each), whatever the input's size.
RANGE_TOKENS = 1 << 24

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def _projection() -> np.ndarray:
    """Fixed random directions in the space of buckets."""
    return np.random.default_rng(7).standard_normal((BUCKETS, DIMS)).astype(np.float32)


_PROJECTION = _projection()


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of each row of unsigned coordinates below 2**bits (Skilling's transform, over all rows at once)."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hilbert key of every document from its ids, which follow one another in flat."""
    rows = len(lengths)
    bucket = ((flat.astype(np.int64) * 0x9E3779B1) >> 7) & (BUCKETS - 1)
    counts = np.bincount(np.repeat(np.arange(rows) * BUCKETS, lengths) + bucket, minlength=rows * BUCKETS).reshape(rows, BUCKETS)
    vectors = np.sqrt(counts.astype(np.float32))
    vectors /= np.maximum(np.sqrt((vectors * vectors).sum(1, keepdims=True)), 1e-9)
    points = np.clip(np.round((vectors @ _PROJECTION + 4.0).astype(np.float64) * (1 << BITS) / 8.0), 0, (1 << BITS) - 1)
    return hilbert(points.astype(np.int64))


def _encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _bpe.encoder(tokenizer)
        for batch in batches:
            for row, stop, buf, offs in _text.text_slices(batch.column("text")):
                ids, places = enc.arrays(buf, offs)
                ids = np.insert(ids, places[1:], END_ID)
                lengths = np.diff(places) + 1
                edges = np.append(0, np.cumsum(lengths)) * enc.dtype.itemsize
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), stop - row, [None, pa.py_buffer(edges), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[row:stop], pa.array(curve_keys(ids, lengths)), pa.array(lengths, pa.int64()), raw, pa.array([enc.dtype.itemsize] * (stop - row), pa.int32())],
                    names=["doc_id", "curve_key", "doc_tokens", "ids", "width"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, curve_key long, doc_tokens long, ids binary, width int")


def _fill(batches: Iterator[pa.RecordBatch], part: int, sequence: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    base, at, used = part << 32, 0, 0
    open_: list[list] = []  # the pieces of the sequence that is not yet full
    names = [c.split()[0] for c in PIECES.split(", ")]
    types = [pa.int64()] * 7 + [pa.binary()]

    def table(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    for batch in batches:
        rows: list[list] = []
        for doc_id, tokens, raw, width in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "ids", "width")), strict=True):
            ids = np.frombuffer(raw, f"<u{width}").astype("<u4")
            start = 0
            while start < tokens:
                take = min(tokens - start, sequence - used)
                open_.append([doc_id, start, take, ids[start : start + take], tokens, base + at, used])
                start, used = start + take, used + take
                if used == sequence:
                    rows += [_closed(p, with_ids) for p in open_]
                    open_, at, used = [], at + 1, 0
        if rows:
            yield table(rows)
    if used:
        yield table([_closed(p, with_ids) for p in _powers_of_two(open_, used, base + at)])


def _closed(piece: list, with_ids: bool) -> list:
    doc_id, start, length, ids, tokens, sequence_id, offset = piece
    raw = ids.tobytes()
    return [doc_id, start, length, zlib.crc32(raw), tokens, sequence_id, offset, raw if with_ids else None]


def _powers_of_two(pieces: list[list], total: int, first: int) -> list[list]:
    """The last sequence, cut into sequences whose lengths are the powers of two that make up its own."""
    out, sizes = [], [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]
    k, used = 0, 0
    for doc_id, start, length, ids, tokens, _id, _offset in pieces:
        done = 0
        while done < length:
            take = min(length - done, sizes[k] - used)
            out.append([doc_id, start + done, take, ids[done : done + take], tokens, first + k, used])
            done, used = done + take, used + take
            if used == sizes[k]:
                k, used = k + 1, 0
    return out


def pack(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, with_ids: bool = True, partitions: int | None = None) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (unsigned 32-bit, or null)."""
    spark = docs.sparkSession
    rows = _text.written(_encode(docs, tokenizer))
    tokens = rows.agg(F.sum("doc_tokens")).first()[0] or 0
    parts = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // RANGE_TOKENS))
    ordered = rows.withColumn("_tie", F.crc32("ids")).repartitionByRange(parts, "curve_key", "doc_id", "_tie").sortWithinPartitions("curve_key", "doc_id", "_tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        yield from _fill(batches, TaskContext.get().partitionId(), sequence, with_ids)

    return ordered.select("doc_id", "doc_tokens", "ids", "width").mapInArrow(run, PIECES)
