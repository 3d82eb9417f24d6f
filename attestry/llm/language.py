"""Language identification with hyperdimensional profiles.

Every letter class has a fixed random vector of +1 and -1.  A letter trigram
around a letter of a word (the word's edges count as a blank) is bound as the
product of the three vectors, permuted by place; a document's bundle is the sum
of its trigrams' vectors, and a language's prototype is the sum of the unit
bundles of its training documents.  A document gets the language of the
prototype of largest cosine (ties: the first name).

Prototypes are whole-number sums, so neither order nor partitioning changes
them; only languages x dimensions numbers reach the driver, and more than
``MAX_LANGUAGES`` languages are refused.

Defined cases: null text, or text without a letter (a character of Unicode's
letter categories), is ``und`` with score 0, as is any text when nothing can be
learned; a very long text is bundled whole; repeated rows count each time; rows
of null language teach nothing; an empty table gives none; more columns are
kept, but for the names added here, which replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.llm import _text

DIMENSIONS = 512
CLASSES = 64
SCALE = 1 << 20
MAX_LANGUAGES = 10_000

FIELDS = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

_TABLES: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    """Class of every code point (0: no letter), and the letter vectors permuted for the three places."""
    if not _TABLES:
        kind = np.zeros(0x110000, np.uint8)
        for cp in range(len(kind)):
            c = chr(cp)
            if c.isalpha():
                low = ord(c.lower()[0])
                kind[cp] = low - 96 if 97 <= low <= 122 else 27 + (low * 0x9E3779B1 >> 8) % (CLASSES - 27)
        letters = np.random.default_rng(11).choice(np.array([-1, 1], np.int8), (CLASSES, DIMENSIONS))
        _TABLES.extend([kind, np.roll(letters, 2, 1), np.roll(letters, 1, 1), letters])
    return _TABLES


def bundles(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit bundle of each row (zeros where it has no letter), and whether it has one."""
    kind, first, second, third = _tables()
    rows = len(offs) - 1
    points = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32)
    heads = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))[offs]
    seq = np.zeros(len(points) + rows + 2, np.int64)
    row = np.repeat(np.arange(rows), np.diff(heads))
    place = np.arange(len(points)) + row + 1  # a blank between rows
    seq[place] = kind[points]
    mid = place[seq[place] != 0]
    tri = (seq[mid - 1] << 12) | (seq[mid] << 6) | seq[mid + 1]
    of = row[seq[place] != 0]
    present = np.flatnonzero(np.bincount(tri, minlength=1)) if len(tri) else np.zeros(0, np.int64)
    out = np.zeros((rows, DIMENSIONS), np.float32)
    has = np.bincount(of, minlength=rows) > 0
    if len(present):
        index = np.zeros(int(present[-1]) + 1, np.int64)
        index[present] = np.arange(len(present))
        vectors = (first[present >> 12] * second[(present >> 6) & 63] * third[present & 63]).astype(np.float32)
        step = max(1, (1 << 22) // len(present))
        for a in range(0, rows, step):  # a bounded table of counts at once
            b = min(rows, a + step)
            lo, hi = np.searchsorted(of, (a, b))
            counts = np.bincount((of[lo:hi] - a) * len(present) + index[tri[lo:hi]], minlength=(b - a) * len(present))
            out[a:b] = counts.reshape(b - a, len(present)).astype(np.float32) @ vectors
        norm = np.sqrt((out.astype(np.float64) ** 2).sum(1))
        out /= np.maximum(norm, 1e-9)[:, None].astype(np.float32)
    return out, has


def learn(docs: DataFrame) -> dict[str, np.ndarray]:
    """Prototype of every language, from docs' text and lang."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for row, end, buf, offs in _text.text_slices(batch.column("text")):
                units, has = bundles(buf, offs)
                whole = np.round(units * SCALE).astype(np.int64)
                for lang in set(langs[row:end]):
                    sums[lang] = sums.get(lang, 0) + whole[(langs[row:end] == lang) & has].sum(0)
        names = list(sums)
        places = len(names) * DIMENSIONS
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.array(names, object), DIMENSIONS), pa.string()),
                pa.array(np.tile(np.arange(DIMENSIONS), len(names)), pa.int32()),
                pa.array(np.concatenate(list(sums.values())) if names else np.zeros(places, np.int64), pa.int64()),
            ],
            names=["lang", "place", "total"],
        )

    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    totals = known.mapInArrow(run, "lang string, place int, total long").groupBy("lang", "place").agg(F.sum("total").alias("total"))
    rows = totals.limit(MAX_LANGUAGES * DIMENSIONS + 1).collect()
    if len(rows) > MAX_LANGUAGES * DIMENSIONS:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    out: dict[str, np.ndarray] = {}
    for r in rows:
        out.setdefault(r.lang, np.zeros(DIMENSIONS))[r.place] = r.total
    return {k: v / np.sqrt((v * v).sum()) for k, v in sorted(out.items()) if v.any()}


#: Cosine that a text of unrelated trigrams passes about once in 700: three standard deviations of its distribution around 0.
CHANCE = 3 / DIMENSIONS**0.5


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """docs with lang_pred and score: half of one more than the cosine to that language's prototype."""
    shared = docs.sparkSession.sparkContext.broadcast((list(prototypes), np.array(list(prototypes.values())).reshape(len(prototypes), DIMENSIONS)))

    def make(batch: pa.RecordBatch) -> list:
        names, vectors = shared.value
        langs, scores = [], []
        for _row, _end, buf, offs in _text.text_slices(batch.column("text")):
            units, has = bundles(buf, offs)
            if not names:
                has[:] = False
            cosine = np.round(units.astype(np.float64) @ vectors.T, 6) if names else np.zeros((len(has), 1))
            best = cosine.argmax(1)
            langs += [names[b] if h else "und" for b, h in zip(best, has, strict=True)]
            scores += np.where(has, np.clip((1 + cosine[np.arange(len(best)), best]) / 2, 0, 1), 0.0).tolist()
        return [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]

    return _text.append_arrow(docs, FIELDS, make)


def held_out(mod: int, rest: int) -> Column:
    """Whether crc32 of doc_id as text leaves this remainder."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % mod == rest


def language_id(docs: DataFrame) -> DataFrame:
    """docs with held_out, lang_pred and score; learns from those that are not held out."""
    marked = docs.withColumn("held_out", held_out(4, 2))
    return identify(marked, learn(marked.filter(~F.col("held_out"))))
