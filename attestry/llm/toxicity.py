"""Toxic passages by maximum-scoring segments.

Learning takes a bounded sample of the labelled rows: the ``MAX_LABELLED`` rows
of least hashed id (documented parameter; copies of a text count once).  It
counts, for toxic and for clean texts, each hashed word and each hashed start
of a word (of ``STARTS`` bytes), at most ``PER_TEXT`` times a text, in
``1 << BITS`` buckets.

A word's share of toxic text is estimated from the general to the special: the
base rate is the Dirichlet (two-class: beta) prior of the share for its
shortest start, that of the next longer start, and so on up to the whole word;
a level whose counts don't differ significantly from its prior is passed over.
So inflected and unseen forms get what is known of their stem.  The word's
score is the log-odds of that share against the base rate, less a small
``DRIFT``, so that clean text drifts downwards.

Every text is scanned whole: Ruzzo and Tompa's linear scan finds all maximal
segments of its words.  Karlin and Altschul's statistics, with lambda and K
from the scores of the clean training texts' words, turn the segments into
extreme-value measures: one is significant where its expected count in clean
text of that length is below ``E_VALUE``.  A logistic curve, fitted on
cross-fitted training texts, maps the best segment, the sum over significant
ones and the sum over all of them to a probability.

Defined cases: null text is scored as empty; an empty text has no segment and
gets the curve's value there; without both labels in training the score is the
base rate (0.0 if nothing is labelled); a document labelled both ways counts as
toxic, as do all texts of an id that is labelled so; of equal segments the first
counts; very long texts are scanned whole, one at a time; repeated rows are each
scored; an empty table gives none; more columns are kept, but for the names
added here, which replace columns of the same name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.llm import _text

BITS = 21
STARTS = (4, 5, 6, 7)
PER_TEXT = 3
PRIOR = 4.0
SIGNIFICANT = 4.0
DRIFT = 0.02
E_VALUE = 0.01
MAX_LABELLED = 40_000

FIELDS = T.StructType(
    [
        T.StructField("score", T.DoubleType()),
        T.StructField("predicted", T.IntegerType()),
        T.StructField("passages", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))),
    ]
)
_PASSAGES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def segments(places: np.ndarray, values: np.ndarray, before: np.ndarray, after: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first place, last place, score), from the places of positive values and the running sums around them."""
    kept: list[list] = []  # first, last, sum before, sum after, index of the nearest earlier segment of smaller sum before
    for p, low, high in zip(places.tolist(), before.tolist(), after.tolist(), strict=True):
        first = p
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= low:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= high:
                kept.append([first, p, low, high, j])
                break
            first, low = kept[j][0], kept[j][2]
            del kept[j:]
    return [(a, b, high - low) for a, b, low, high, _ in kept]


def _buckets(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Bucket of every word's starts, from the shortest, and of the word itself."""
    mask = np.uint64((1 << BITS) - 1)
    out = []
    for n in STARTS:
        stems = _text.word_hashes(buf, starts, np.minimum(starts + n, ends))
        out.append((_text.mix(stems + np.uint64(n)) & mask).astype(np.int64))
    out.append((_text.word_hashes(buf, starts, ends) & mask).astype(np.int64))
    return out


class Scorer:
    """Word scores with the constants of their extreme-value law."""

    def __init__(self, toxic: np.ndarray, clean: np.ndarray):
        self.toxic, self.seen = toxic.astype(np.float32), (toxic + clean).astype(np.float32)
        self.base = float(toxic.sum() / max(1.0, toxic.sum() + clean.sum()))
        self.scale, self.k = 1.0, 0.1

    def __getstate__(self) -> dict:
        """Compressed, as broadcasts lie on every executor's disk."""
        return self.__dict__ | {c: zlib.compress(getattr(self, c).tobytes(), 1) for c in ("toxic", "seen")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state | {c: np.frombuffer(zlib.decompress(state[c]), np.float32) for c in ("toxic", "seen")})

    def scores(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(starts) or not 0 < self.base < 1:
            return np.full(len(starts), -DRIFT)
        share = np.full(len(starts), self.base)
        for bucket in _buckets(buf, starts, ends):
            hit, seen = self.toxic[bucket].astype(np.float64), self.seen[bucket].astype(np.float64)
            off = np.abs(hit - seen * share) > SIGNIFICANT * np.sqrt(seen * share * (1 - share) + 0.5)
            share = np.where(off, (hit + PRIOR * share) / (seen + PRIOR), share)
        odds = np.log(share / (1 - share)) - np.log(self.base / (1 - self.base))
        return np.where(np.abs(odds) > 1e-9, odds, 0.0) - DRIFT

    def fit_law(self, values: np.ndarray, counts: np.ndarray) -> None:
        """lambda with E[exp(lambda s)] = 1 and a K, for clean words: values and how often each occurs."""
        w = counts / max(1.0, counts.sum())
        if not counts.sum() or not (w[values > 0] > 0).any() or (values * w).sum() >= 0:
            return
        moment = lambda x: (w * np.exp(np.minimum(x * values, 600))).sum()
        low, high = 1e-3, 1.0
        while moment(high) < 1 and high < 64:
            high *= 2
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if moment(mid) < 1 else (low, mid)
        drift = -(values * w).sum()
        tilted = (values * w * np.exp(np.minimum(low * values, 600))).sum()
        self.scale, self.k = low, float(np.clip(drift * drift / max(tilted, 1e-9) * low, 1e-4, 1.0))

    def measure(self, buf: np.ndarray, offs: np.ndarray) -> list[tuple[float, float, float, list[tuple[int, int, float]]]]:
        """For each row: the best segment's normalised score, the sums over significant and over all segments, and the significant ones with their byte spans."""
        starts, ends, first = _text.words(buf, offs, _text.ALNUM_SEP)
        values = self.scores(buf, starts, ends)
        total = np.concatenate(([0.0], np.cumsum(values)))
        positive = np.flatnonzero(values > 0)
        cuts = np.searchsorted(positive, first)
        out = []
        for r in range(len(offs) - 1):
            n = int(first[r + 1] - first[r])
            places = positive[cuts[r] : cuts[r + 1]]
            best, weight, every, spans = 0.0, 0.0, 0.0, []
            if len(places):
                floor = np.log(self.k * n)
                for a, b, s in segments(places, values[places], total[places], total[places + 1]):
                    raw = self.scale * s - floor  # -log of the expected count of such segments in clean text
                    best, every = max(best, raw), every + self.scale * s
                    if raw > -np.log(E_VALUE):
                        weight += raw
                        spans.append((int(starts[a] - offs[r]), int(ends[b] - offs[r]), round(raw, 6)))
            out.append((best, weight, every, spans))
        return out


def _features(measured: list[tuple]) -> np.ndarray:
    return np.array([[1.0, min(m[0], 50.0), np.log1p(m[1]), np.log1p(m[2])] for m in measured]).reshape(-1, 4)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights by Newton's method under a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = 1e-2 * np.eye(len(w))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The bounded sample: text, toxic and fold, each text once; MAX_LABELLED rows at most."""
    chosen = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    chosen = chosen.groupBy("doc_id").agg(F.max("toxic").alias("_toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    given = docs.filter(F.col("text").isNotNull()).select("doc_id", "text", F.xxhash64("text").alias("_hash"))
    # one id may have any number of texts: the texts are bounded by their hashes, each taken from its least id
    hashes = given.select("doc_id", "_hash").join(F.broadcast(chosen), "doc_id").groupBy("_hash").agg(F.max("_toxic").alias("toxic"), F.min("doc_id").alias("doc_id"))
    bounded = hashes.orderBy("_hash").limit(MAX_LABELLED)  # broadcast below: three numbers for each of MAX_LABELLED rows
    texts = given.join(F.broadcast(bounded), ["doc_id", "_hash"]).groupBy("_hash", "toxic").agg(F.first("text").alias("text"))
    return texts.select("text", "toxic", F.pmod("_hash", F.lit(2)).cast("int").alias("fold"))


def learn(docs: DataFrame, labels: DataFrame) -> tuple[Scorer, np.ndarray]:
    """The scorer and the curve's weights."""
    spark = docs.sparkSession
    sample = _text.written(_sample(docs, labels))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((4, 1 << BITS), np.int32)  # toxic of both folds, then clean of both
        for batch in batches:
            toxic, fold = batch.column("toxic").to_numpy(), batch.column("fold").to_numpy()
            for row, _end, buf, offs in _text.text_slices(batch.column("text")):
                starts, ends, first = _text.words(buf, offs, _text.ALNUM_SEP)
                buckets = np.stack(_buckets(buf, starts, ends))
                for r in range(len(offs) - 1):
                    own, n = np.unique(buckets[:, first[r] : first[r + 1]], return_counts=True)
                    table[fold[row + r] + 2 * (toxic[row + r] == 0), own] += np.minimum(n, PER_TEXT)
        at = np.flatnonzero(table.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(t[at].astype(np.int64)) for t in table)], names=["bucket", "t0", "t1", "c0", "c1"])

    names = ["t0", "t1", "c0", "c1"]
    counted = sample.mapInArrow(count, "bucket long, t0 long, t1 long, c0 long, c1 long").groupBy("bucket").agg(*(F.sum(c).cast("int").alias(c) for c in names))
    rows = counted.withColumn("bucket", F.col("bucket").cast("int")).toArrow()  # a row for each bucket at most
    batch = None
    table = np.zeros((4, 1 << BITS), np.int32)
    for batch in rows.to_batches():
        for k, c in enumerate(names):
            table[k, batch.column("bucket").to_numpy()] = batch.column(c).to_numpy()
    del rows, batch  # the driver's memory is small
    scorers = [Scorer(table[1], table[3]), Scorer(table[0], table[2]), Scorer(table[0] + table[1], table[2] + table[3])]
    del table
    pa.default_memory_pool().release_unused()
    given = spark.sparkContext.broadcast(scorers)
    bins, low, high = 512, -4.0, 12.0

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((3, bins), np.int64)
        for batch in batches:
            toxic, fold = batch.column("toxic").to_numpy(), batch.column("fold").to_numpy()
            for row, _end, buf, offs in _text.text_slices(batch.column("text")):
                starts, ends, first = _text.words(buf, offs, _text.ALNUM_SEP)
                of = row + np.repeat(np.arange(len(offs) - 1), np.diff(first))
                for k, scorer in enumerate(given.value):
                    use = (toxic[of] == 0) & ((fold[of] == k) | (k == 2))
                    place = ((scorer.scores(buf, starts, ends)[use] - low) * (bins / (high - low))).astype(np.int64)
                    found[k] += np.bincount(np.clip(place, 0, bins - 1), minlength=bins)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(3), bins)), pa.array(np.tile(np.arange(bins), 3)), pa.array(found.ravel())], names=["which", "bin", "n"])

    middle = low + (np.arange(bins) + 0.5) * (high - low) / bins
    middle[int((-DRIFT - low) * bins / (high - low))] = -DRIFT  # where most words are
    spreads = np.zeros((3, bins))
    for r in sample.mapInArrow(spread, "which long, bin long, n long").groupBy("which", "bin").agg(F.sum("n").alias("n")).collect():
        spreads[r.which, r.bin] = r.n
    for scorer, n in zip(scorers, spreads, strict=True):
        scorer.fit_law(middle, n)
    halves = spark.sparkContext.broadcast(scorers[:2])  # fold k is measured by what the other fold taught

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, fold = batch.column("toxic").to_numpy(), batch.column("fold").to_numpy()
            found = []
            for row, _end, buf, offs in _text.text_slices(batch.column("text")):
                both = [_features(half.measure(buf, offs)) for half in halves.value]
                found += [both[fold[row + r]][r] for r in range(len(offs) - 1)]
            x = np.array(found).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:, k]) for k in (1, 2, 3)), pa.array((toxic > 0).astype(np.int32))], names=["best", "weight", "every", "toxic"])

    fitted = sample.mapInArrow(fit, "best double, weight double, every double, toxic int").toArrow()  # MAX_LABELLED rows at most
    order = np.lexsort([fitted.column(c).to_numpy() for c in ("toxic", "every", "weight", "best")])
    best, weight, every, y = (fitted.column(c).to_numpy()[order] for c in ("best", "weight", "every", "toxic"))
    if not len(y):
        curve = np.array([-30.0, 0, 0, 0])
    elif y.min() == y.max():
        curve = np.array([30.0 if y[0] else -30.0, 0, 0, 0])
    else:
        curve = _logistic(np.stack([np.ones(len(y)), best, weight, every], 1), y)
    return scorers[2], curve


def score(docs: DataFrame, scorer: Scorer, curve: np.ndarray) -> DataFrame:
    """docs with score, predicted and passages (code point spans of significant segments)."""
    shared = docs.sparkSession.sparkContext.broadcast((scorer, curve))

    def make(batch: pa.RecordBatch) -> list:
        scorer, curve = shared.value
        scores, passages = [], []
        for _row, _end, buf, offs in _text.text_slices(batch.column("text")):
            measured = scorer.measure(buf, offs)
            scores += np.round(1 / (1 + np.exp(-np.clip(_features(measured) @ curve, -30, 30))), 9).tolist()
            for r, (*_, spans) in enumerate(measured):
                place = _text.code_points(buf[offs[r] : offs[r + 1]]) if spans else []
                passages.append([{"start": int(place[a]), "end": int(place[b]), "score": s} for a, b, s in spans])
        return [pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(passages, _PASSAGES)]

    return _text.append_arrow(docs, FIELDS, make)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with score, predicted and passages."""
    return score(docs, *learn(docs, labels))
