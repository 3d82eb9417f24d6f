"""Benchmark decontamination: a hash set of normalised test n-grams, scanned over all training windows.

The benchmark's windows are hashed once and broadcast.  Its size is checked
first: beyond ``MAX_WINDOWS`` windows the benchmark is dealt into blocks of
items of that many windows at most, each block is scanned in turn and the
marked words are united, so any benchmark size works with the same memory.
Every hash hit is verified against the words themselves.

Defined cases: null or word-less text has no words and no hit; an item without
words has no window; an item with fewer than ``n`` words is one window; equal
windows of several items count for each of them; repeated rows are each
returned; more columns are kept as they are, but for names that this operator
adds, which are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.llm import _text

#: Windows broadcast at once, about 150 bytes each.
MAX_WINDOWS = 500_000

FIELDS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("item_ids", T.ArrayType(T.StringType())),
    ]
)
_ARROW = [
    pa.int64(),
    pa.int64(),
    pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])),
    pa.list_(pa.string()),
]


def _lower(raw: bytes) -> bytes:
    return raw.lower()  # of bytes: A-Z only


class WindowSet:
    """Windows of benchmark items by length: sorted hashes, their words and their items."""

    def __init__(self, items: list[tuple[object, str | None]], n: int):
        found: dict[int, dict[int, tuple[bytes, set[str]]]] = {}
        for item_id, text in items:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            starts, ends, _ = _text.words(raw, np.array([0, len(raw)]), _text.ALNUM_SEP)
            if not len(starts):
                continue
            size = min(n, len(starts))
            hashes = _text.windows(_text.word_hashes(raw, starts, ends), size)
            tokens = [_lower(raw[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
            for i, h in enumerate(hashes.tolist()):
                entry = found.setdefault(size, {}).setdefault(h, (b" ".join(tokens[i : i + size]), set()))
                if entry[0] == b" ".join(tokens[i : i + size]):
                    entry[1].add("" if item_id is None else str(item_id))
        self.sizes = {size: (np.array(sorted(table), np.uint64), table) for size, table in found.items()}

    def scan(self, buf: np.ndarray, offs: np.ndarray) -> list[tuple[int, np.ndarray, set[str], np.ndarray, np.ndarray]]:
        """For each row: words, mask of words hit, items, and the words' starts and ends in the row."""
        starts, ends, first = _text.words(buf, offs, _text.ALNUM_SEP)
        hit = np.zeros(len(starts) + 1, np.int64)
        items: dict[int, set[str]] = {}
        if len(starts):
            hashes = _text.word_hashes(buf, starts, ends)
            row_end = np.repeat(first[1:], np.diff(first))
            for size, (keys, table) in self.sizes.items():
                rolled = _text.windows(hashes, size)
                at = np.searchsorted(keys, rolled)
                at[at == len(keys)] = 0
                places = np.flatnonzero(keys[at] == rolled)
                places = places[places + size <= row_end[places]]
                for p in places.tolist():
                    words, ids = table[int(rolled[p])]
                    if _lower(b" ".join(buf[starts[k] : ends[k]].tobytes() for k in range(p, p + size))) == words:
                        hit[p] += 1
                        hit[p + size] -= 1
                        items.setdefault(int(np.searchsorted(first, p, "right")) - 1, set()).update(ids)
        mask = np.cumsum(hit[:-1]) > 0
        out = []
        for r in range(len(offs) - 1):
            a, b = int(first[r]), int(first[r + 1])
            out.append((b - a, mask[a:b], items.get(r, set()), starts[a:b] - offs[r], ends[a:b] - offs[r]))
        return out


def _spans(mask: np.ndarray, starts: np.ndarray, ends: np.ndarray, raw: np.ndarray) -> list[dict]:
    """Code point spans of the runs of marked words."""
    if not mask.any():
        return []
    place = _text.code_points(raw)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return [{"start": int(place[starts[a]]), "end": int(place[ends[b - 1]])} for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _items(benchmark: DataFrame, n: int) -> list[list[tuple[object, str | None]]]:
    """The benchmark in blocks of at most MAX_WINDOWS windows (an item of more is a block alone), read block by block."""
    sized = benchmark.select("item_id", "text").withColumn("_w", F.greatest(F.lit(1), F.coalesce(F.octet_length("text"), F.lit(0)) / 2))
    total = sized.agg(F.sum("_w")).first()[0] or 0
    parts = max(1, int(-(-total // MAX_WINDOWS)))
    while True:
        dealt = sized.withColumn("_b", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))
        over = dealt.groupBy("_b").agg(F.sum("_w").alias("_s"), F.count_distinct("item_id", "text").alias("_n")).filter((F.col("_s") > MAX_WINDOWS) & (F.col("_n") > 1))
        if parts == 1 and total <= MAX_WINDOWS or over.isEmpty():
            break
        parts *= 2
    return [dealt.filter(F.col("_b") == b).select("item_id", "text") for b in range(parts)]


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """docs with n_words, n_hit, hit_spans (code points) and item_ids (sorted as strings)."""
    spark = docs.sparkSession
    out, windows = docs, None
    for k, block in enumerate(_items(benchmark, n)):
        if windows is not None:  # one block's windows at a time, here and on the executors
            out = _text.written(out)
            windows.destroy()
        windows = spark.sparkContext.broadcast(WindowSet([tuple(r) for r in block.collect()], n))

        def make(batch: pa.RecordBatch, windows=windows, again=k > 0) -> list:
            cols: list[list] = [[], [], [], []]
            text = batch.column("text")
            for row, _end, buf, offs in _text.text_slices(text):
                for r, (n_words, mask, items, starts, ends) in enumerate(windows.value.scan(buf, offs)):
                    if again and (mask.any() or len(batch.column("hit_spans")[row + r])):
                        place = _text.code_points(buf[offs[r] : offs[r + 1]])
                        for span in batch.column("hit_spans")[row + r].as_py():
                            a, b = (int(np.searchsorted(place, span[x], "right")) - 1 for x in ("start", "end"))
                            mask = mask | ((starts >= a) & (ends <= b))
                        items = items | set(batch.column("item_ids")[row + r].as_py())
                    cols[0].append(n_words)
                    cols[1].append(int(mask.sum()))
                    cols[2].append(_spans(mask, starts, ends, buf[offs[r] : offs[r + 1]]) if mask.any() else [])
                    cols[3].append(sorted(items))
            return [pa.array(c, t) for c, t in zip(cols, _ARROW, strict=True)]

        out = _text.append_arrow(out, FIELDS, make)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, action: str = "documents") -> DataFrame:
    """docs without contaminated documents, or with action "spans" without the hit words in their texts."""
    if action == "documents":
        return contamination(docs, benchmark, n).filter(F.col("n_hit") == 0).select(docs.columns)
    marked = contamination(docs, benchmark, n)
    pieces = F.aggregate(
        "hit_spans",
        F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at")),
        lambda acc, s: F.struct(F.concat(acc["text"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))).alias("text"), s["end"].alias("at")),
        lambda acc: F.concat(acc["text"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.lit(2147483647))),
    )
    return marked.withColumn("text", F.when(F.col("n_hit") > 0, pieces).otherwise(F.col("text"))).select(docs.columns)


def digest(marked: DataFrame) -> DataFrame:
    """The columns of query op10."""
    return marked.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def items_digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
