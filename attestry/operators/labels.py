"""Label integrity: neighbours, class centroids, suggestions and systematic confusion."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestry.functions import columns as C

#: Rows of a tile's side, so that a task holds two sides and their products.
TILE_ROWS = 2048


def _tile_neighbours(k: int):
    def run(queries: pa.Table, others: pa.Table) -> pa.Table:
        names = ["sample_id", "neighbour_id", "neighbour_label", "distance"]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.float64()]
        if not queries.num_rows or not others.num_rows:
            return pa.table([pa.array([], t) for t in types], names=names)
        q, o = (np.stack(t.column("vector").to_numpy()).astype(np.float64) for t in (queries, others))
        qi, oi = (t.column("sample_id").to_numpy() for t in (queries, others))
        q, o = (x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12) for x in (q, o))
        distance = np.round(1 - q @ o.T, 6)
        distance[qi[:, None] == oi[None, :]] = np.inf
        order = np.lexsort((np.broadcast_to(oi, distance.shape), distance), axis=1)[:, :k]
        rows = np.repeat(np.arange(len(qi)), order.shape[1])
        flat = order.ravel()
        keep = np.isfinite(distance[rows, flat])
        rows, flat = rows[keep], flat[keep]
        labels = others.column("label").to_numpy()
        return pa.table([pa.array(qi[rows]), pa.array(oi[flat]), pa.array(labels[flat].astype(np.int32)), pa.array(distance[rows, flat])], names=names)

    return run


def neighbours(vectors: DataFrame, k: int = 5, tile_rows: int = TILE_ROWS) -> DataFrame:
    """The k nearest other samples by cosine distance (six places; ties: the lesser id): sample_id, neighbour_id, neighbour_label, distance, rank.

    Exact, in square tiles of bounded size; a sample goes to as many tiles as
    there are, and each tile sends on k rows for each of its samples.
    """
    rows = vectors.count()
    tiles = max(1, -(-rows // tile_rows))
    part = F.pmod(F.xxhash64("sample_id"), F.lit(tiles)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    left = vectors.select("sample_id", "vector", part.alias("row"), every.alias("col"))
    right = vectors.select("sample_id", "vector", "label", part.alias("col"), every.alias("row"))
    near = left.groupBy("row", "col").cogroup(right.groupBy("row", "col")).applyInArrow(_tile_neighbours(k), "sample_id long, neighbour_id long, neighbour_label int, distance double")
    rank = F.row_number().over(W.partitionBy("sample_id").orderBy("distance", "neighbour_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k)


def consensus(vectors: DataFrame, k: int = 5) -> DataFrame:
    """Majority label of the neighbours (ties: the label seen nearest) and its share."""
    votes = neighbours(vectors, k).groupBy("sample_id", "neighbour_label").agg(F.count("*").alias("votes"), F.min("rank").alias("nearest"))
    best = votes.groupBy("sample_id").agg(F.max_by(F.struct("neighbour_label", "votes"), F.struct("votes", -F.col("nearest"))).alias("_b"), F.sum("votes").alias("_n"))
    return best.select("sample_id", F.col("_b.neighbour_label").alias("suggested_label"), F.round(F.col("_b.votes") / F.col("_n"), 4).alias("consensus")).join(vectors.select("sample_id", "label"), "sample_id")


def centroids(vectors: DataFrame) -> DataFrame:
    """label, centroid (unit length) and class_count; means by place, so that no task holds a class."""
    places = vectors.select("label", F.posexplode("vector").alias("place", "x")).groupBy("label", "place").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    rows = places.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("place", "m"))).alias("_p"), F.max("n").alias("class_count"))
    mean = rows.select("label", "class_count", F.transform("_p", lambda p: p["m"]).alias("_m"))
    norm = F.sqrt(C.dot(F.col("_m"), F.col("_m"))) + 1e-7
    return mean.withColumn("_n", norm).select("label", "class_count", F.transform("_m", lambda x: x / F.col("_n")).alias("centroid"))


def margins(vectors: DataFrame, suggested: DataFrame) -> DataFrame:
    """Distances to the given and the suggested class' centroids, and given less suggested."""
    classes = F.broadcast(centroids(vectors))  # one row for each class of a declared label set
    given = classes.select("label", F.col("centroid").alias("given_c"), F.col("class_count").alias("given_count"))
    other = classes.select(F.col("label").alias("suggested_label"), F.col("centroid").alias("suggested_c"), F.col("class_count").alias("suggested_count"))
    joined = suggested.join(vectors.select("sample_id", "vector"), "sample_id").join(given, "label").join(other, "suggested_label")
    a, b = C.euclidean(F.col("vector"), F.col("given_c")), C.euclidean(F.col("vector"), F.col("suggested_c"))
    return joined.select("sample_id", "label", "suggested_label", "consensus", "given_count", "suggested_count", F.round(a, 4).alias("given_distance"), F.round(b, 4).alias("suggested_distance"), (F.round(a - b, 4) + 0.0).alias("margin"))


def mislabelled(vectors: DataFrame, k: int = 5, consensus_at: float = 0.6, high_at: float = 0.8, margin_at: float = 0.05, least_class: int = 5) -> DataFrame:
    """Samples whose neighbours and centroids speak for another label, with confidence and score."""
    m = margins(vectors, consensus(vectors, k))
    agree, margin = F.col("consensus"), F.col("margin")
    gate = (F.col("label") != F.col("suggested_label")) & (F.col("given_count") >= least_class) & (F.col("suggested_count") >= least_class)
    gate = gate & ((agree >= high_at) | ((agree >= consensus_at) & (margin >= margin_at)))
    tier = F.when((agree >= high_at) & (margin >= margin_at), "HIGH").when((agree >= consensus_at) | (margin >= 0.02), "MEDIUM").otherwise("LOW")
    score = F.round(0.7 * agree + 0.3 * C.clamp(5 * margin), 4)
    return m.filter(gate).select("sample_id", "label", "suggested_label", "consensus", "margin", tier.alias("confidence"), score.alias("score"))


def systematic_confusion(flagged: DataFrame, totals: DataFrame, least: int = 3, share: float = 0.45) -> DataFrame:
    """For each contributor: flagged, rate, most frequent (given, suggested) pair and whether it is systematic.

    flagged: contributor, label, suggested_label. totals: contributor, total_samples. Ties: the lesser pair.
    """
    pairs = flagged.groupBy("contributor", "label", "suggested_label").agg(F.count("*").alias("n"))
    top = pairs.groupBy("contributor").agg(F.sum("n").alias("flagged"), F.max_by(F.struct("label", "suggested_label", "n"), F.struct(F.col("n"), -F.col("label"), -F.col("suggested_label"))).alias("_t"))
    joined = totals.join(top, "contributor", "left")
    n = F.coalesce("flagged", F.lit(0))
    systematic = F.coalesce((F.col("_t.n") >= least) & (F.col("_t.n") / F.col("flagged") >= share), F.lit(False))
    return joined.select("contributor", "total_samples", n.cast("long").alias("flagged"), F.round(n / F.col("total_samples"), 4).alias("mislabel_rate"), F.col("_t.label").alias("top_given"), F.col("_t.suggested_label").alias("top_suggested"), F.col("_t.n").alias("top_count"), systematic.alias("is_systematic"))
