"""Queries of model integrity over the embeddings, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.operators import generators, labels, model
from attestry.plans.data import _CENTRE
from attestry.sources.tables import vectors

QUERIES = {}
ORACLES = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_LAYERS = """
w AS (SELECT 'weight_' || label AS layer, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
ls AS (SELECT layer, count(*) AS n, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std, round(sqrt(sum(v * v)), 4) AS l2, round(avg(CASE WHEN abs(v) < 1e-8 THEN 1.0 ELSE 0.0 END), 4) AS zero_ratio FROM w GROUP BY 1),
la AS (SELECT *, 0.0::DOUBLE AS deviation, std > 1 OR zero_ratio > 0.95 OR (l2 > 50 AND contains(layer, 'weight')) AS is_anomalous FROM ls)
"""


def _weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select(F.concat(F.lit("weight_"), F.col("label")).alias("layer"), F.explode("vector").alias("value"))


@query(f"WITH {_LAYERS} SELECT * FROM la")
def layer_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.layer_anomalies(model.layer_statistics(_weights(spark, sf_dir)))


@query(f"WITH {_LAYERS} SELECT count(*) AS layers, CAST(sum(n) AS BIGINT) AS parameters, count_if(is_anomalous) AS anomalous_layers, round(avg(CASE WHEN zero_ratio > 0.95 THEN 1.0 ELSE 0.0 END), 4) AS dead_ratio, round(count_if(is_anomalous) / count(*), 4) AS anomaly_ratio, CASE WHEN count_if(is_anomalous) / count(*) >= 0.3 THEN 'HIGH' WHEN count_if(is_anomalous) / count(*) >= 0.1 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM la")
def layer_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.layer_rollup(model.layer_anomalies(model.layer_statistics(_weights(spark, sf_dir))))


_PREDICT = """
cw AS (SELECT list(c ORDER BY label) AS w FROM cn),
lg AS (SELECT id, x, list_transform(w, lambda c: round(10 * list_dot_product(x, c), 6)) AS z FROM v, cw),
ex AS (SELECT id, list_transform(z, lambda e: exp(e - list_max(z))) AS e FROM lg),
pr AS (SELECT id, list_transform(e, lambda q: q / list_sum(e)) AS p FROM ex),
pd AS (SELECT id AS sample_id, CAST(list_position(p, list_max(p)) - 1 AS INT) AS predicted, round(list_max(p), 6) AS confidence, round(-list_sum(list_transform(p, lambda q: q * log2(q + 1e-8))), 6) AS entropy FROM pr)
"""
_BASE = f"v AS (SELECT vec_id AS id, label, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS x FROM embeddings), {_CENTRE}, {_PREDICT}"


def _other(suffix: str, source: str) -> str:
    """The prediction steps again, under other names, over other vectors."""
    out = _PREDICT.replace("FROM v, cw", f"FROM {source}, cw{suffix}")
    for name in ("cw", "lg", "ex", "pr", "pd"):
        out = out.replace(f"{name} AS (SELECT", f"{name}{suffix} AS (SELECT").replace(f"FROM {name})", f"FROM {name}{suffix})").replace(f"FROM {name}\n", f"FROM {name}{suffix}\n")
    return out


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return model.predictions(model.linear_logits(v, labels.centroids(v)))


@query(f"WITH {_BASE} SELECT * FROM pd")
def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predictions(spark, sf_dir)


@query(f"WITH {_BASE} SELECT predicted, count(*) AS samples, round(count(*) / (SELECT count(*) FROM pd), 4) AS share FROM pd GROUP BY 1")
def class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.class_distribution(_predictions(spark, sf_dir))


@query(
    f"""WITH {_BASE}, k AS (SELECT predicted, count(*) AS n FROM pd GROUP BY 1), a AS (SELECT count(*) AS n, avg(confidence) AS c, avg(entropy) AS e, sqrt(greatest(0.0, avg(confidence * confidence) - avg(confidence) ** 2)) AS s FROM pd), t AS (SELECT count(*) AS k, max(n) AS top FROM k)
SELECT n AS samples, k AS classes, round(c, 4) AS mean_confidence, round(e, 4) AS mean_entropy, round(least(1.0, greatest(0.0, 1 - s)), 4) AS stability, round(top / n, 4) AS top_class_share, c < 0.3 OR (k > 1 AND top / n > 0.95) OR (e < 0.3 AND k > 1) AS is_anomalous FROM a, t"""
)
def behaviour_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.fingerprint(_predictions(spark, sf_dir))


def _other_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model whose class vectors have lost every third weight."""
    v = vectors(spark, sf_dir)
    weights = labels.centroids(v).withColumn("centroid", F.transform("centroid", lambda x, i: F.when(i % 3 == 0, 0.0).otherwise(x)))
    return model.predictions(model.linear_logits(v, weights))


@query(
    f"""WITH {_BASE}, cn2 AS (SELECT label, list_transform(c, lambda e, i: CASE WHEN (i - 1) % 3 = 0 THEN 0.0::DOUBLE ELSE e END) AS c FROM cn), {_other("2", "v").replace("FROM cn)", "FROM cn2)").replace("FROM cn2)", "FROM cn2)")},
j AS (SELECT count(*) AS n, avg(CASE WHEN a.predicted = b.predicted THEN 1.0 ELSE 0.0 END) AS a, avg(abs(a.confidence - b.confidence)) AS c, avg(abs(a.entropy - b.entropy)) AS e FROM pd a JOIN pd2 b USING (sample_id)),
k AS (SELECT *, 0.6 * (1 - a) + 0.25 * least(c, 1.0) + 0.15 * least(e / 2, 1.0) AS d FROM j)
SELECT n AS samples, round(a, 4) AS agreement, round(c, 4) AS confidence_change, round(e, 4) AS entropy_change, round(d, 4) AS deviation, round(d, 4) >= 0.2 AS is_anomalous FROM k"""
)
def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.compare(_predictions(spark, sf_dir), _other_model(spark, sf_dir))


@query(
    f"""WITH {_BASE}, vt AS (SELECT id, label, list_transform(x, lambda e, i: CASE WHEN (i - 1) // 8 >= 5 AND (i - 1) % 8 >= 5 THEN CASE WHEN ((i - 1) // 8 + (i - 1) % 8) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END ELSE e END) AS x FROM v), {_other("3", "vt")},
j AS (SELECT count(*) AS n, avg(CASE WHEN a.predicted <> b.predicted THEN 1.0 ELSE 0.0 END) AS ch, avg(CASE WHEN b.predicted = 0 AND a.predicted <> 0 THEN 1.0 ELSE 0.0 END) AS h, avg(b.confidence - a.confidence) AS g FROM pd a JOIN pd3 b USING (sample_id)),
k AS (SELECT *, 0.5 * ch + 0.35 * h + 0.15 * least(1.0, greatest(0.0, g)) AS s FROM j)
SELECT n AS samples, round(ch, 4) AS change_rate, round(h, 4) AS target_rate, round(g, 4) AS mean_gain, round(s, 4) AS score, round(s, 4) >= 0.5 AS is_suspicious FROM k"""
)
def trigger_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    marked = v.transform(generators.corner_trigger())
    return model.probe(_predictions(spark, sf_dir), model.predictions(model.linear_logits(marked, labels.centroids(v))), 0)


@query("""
WITH s AS (SELECT p_partkey AS scenario, p_size % 2 = 0 AS h, CASE WHEN p_size % 7 > 0 THEN p_size % 3 = 0 END AS p, p_size % 11 = 0 AS t, p_size % 5 = 0 AS b FROM part),
e AS (SELECT *, round(least(1.0, CASE WHEN h THEN 0.3 ELSE 0 END + CASE WHEN coalesce(p, false) THEN 0.3 ELSE 0 END + CASE WHEN t THEN 0.4 ELSE 0 END + CASE WHEN b THEN 0.2 ELSE 0 END), 4)::DOUBLE AS evidence FROM s)
SELECT scenario, evidence, CASE WHEN evidence >= 0.6 OR h OR t THEN 'QUARANTINE' WHEN evidence >= 0.2 THEN 'REVIEW' ELSE 'ACCEPT' END AS disposition, round(0.75 * evidence + 0.25 * (CASE WHEN p IS NULL THEN 0.75 ELSE 1.0 END), 4)::DOUBLE AS confidence FROM e
""")
def model_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestry.sources.tables import table

    n = F.col("p_size")
    flags = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("scenario"), (n % 2 == 0).alias("hash_failed"), F.when(n % 7 > 0, n % 3 == 0).alias("params_changed"), (n % 11 == 0).alias("trigger_found"), (n % 5 == 0).alias("behaviour_changed"))
    return model.assessment(flags)


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'UNVERIFIED' WHEN p_size % 3 = 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM part")
def digest_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestry.sources.tables import table

    own = F.sha2(F.col("p_partkey").cast("string"), 256)
    reference = F.when(F.col("p_size") % 5 == 0, F.lit(None)).when(F.col("p_size") % 3 == 0, F.sha2(own, 256)).otherwise(F.concat(F.lit(" "), F.upper(own)))
    return table(spark, sf_dir, "part").select("p_partkey", model.digest_check(own, reference).alias("status"))


@query(None)
def injected_attacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every generator on a share of the samples, by attack: how many samples, and how many of them the trigger cascade names."""
    from functools import reduce

    from attestry.operators import triggers

    v = vectors(spark, sf_dir)
    attacks = {"label_flip": generators.label_flip(10), "systematic_mislabel": generators.systematic_mislabel({0: 5, 1: 6}, 10), "near_duplicate_flood": generators.near_duplicate(3), "ood_insertion": generators.ood_insertion(), "corner": generators.corner_trigger(), "blended": generators.blended_trigger(0.6), "spectral": generators.spectral_trigger(), "shift_noise": generators.operational_shift("noise")}
    made = reduce(DataFrame.unionByName, [generators.inject(v, f, name, 0.2).filter("is_attacked") for name, f in attacks.items()])
    numbered = made.withColumn("sample_id", F.xxhash64("sample_id", "attack_type"))
    found = triggers.cascade(numbered).select("sample_id", "family")
    return numbered.join(found, "sample_id").groupBy("attack_type").agg(F.count("*").alias("samples"), F.count_if(F.col("family") != "none").alias("named"))
