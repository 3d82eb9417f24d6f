"""Queries of full record checks, ledger events and the benchmark validator over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.operators import evaluation, ledger, model, provenance
from attestry.plans import integrity
from attestry.sources.tables import table

QUERIES = {}
ORACLES = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _checked_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed records, each then with one thing changed by its number, some sent twice, some without a nonce."""
    good = integrity._records(spark, sf_dir)
    e = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("record_id"), "props")
    n = F.col("sequence") % 13
    kept = lambda c, k, other: F.when(n == k, other).otherwise(F.col(c)).alias(c)
    iso = F.date_format(F.timestamp_micros("ts_micros"), "yyyy-MM-dd'T'HH:mm:ss")
    rows = good.join(e, "record_id").select(
        "record_id",
        "image_hash",
        F.when(n == 0, F.sha2("image_hash", 256)).when(n != 1, F.col("image_hash")).alias("observed_image_hash"),
        "model_digest",
        F.when(n == 2, F.lit("other")).otherwise(F.col("model_digest")).alias("expected_model_digest"),
        F.when(n == 3, F.concat("props", F.lit(" "))).otherwise(F.col("props")).alias("config_json"),
        "config_hash",
        F.when(n == 4, F.lit("{}")).cast("string").alias("inference_config_json"),
        F.lit(None).cast("string").alias("inference_config_hash"),
        kept("predictions_json", 5, F.concat("predictions_json", F.lit("x"))),
        "predictions_hash",
        "ts_micros",
        F.when(n == 6, F.lit("2000-01-01T00:00:00")).when(n != 7, iso).alias("ts_iso"),
        kept("nonce", 8, F.lit(None).cast("string")),
        "sequence",
        F.when(n == 9, F.col("sequence") + 1).otherwise(F.col("sequence")).alias("expected_sequence"),
        kept("binding_hash", 10, F.reverse("binding_hash")),
        kept("signature", 11, F.lit(None).cast("string")),
    )
    again = rows.filter(F.col("sequence") % 5 == 0).withColumn("arrival", F.lit(1))
    return rows.withColumn("arrival", F.lit(0)).unionByName(again).withColumn("arrival", F.col("arrival") * 10_000_000_000 + F.col("sequence"))


_CHECKED = f"""{integrity._RECORDS}, p AS (SELECT CAST(event_id AS VARCHAR) AS record_id, props FROM events),
k AS (SELECT record_id, image_hash, CASE WHEN sequence % 13 = 0 THEN sha256(image_hash) WHEN sequence % 13 <> 1 THEN image_hash END AS oi, model_digest, CASE WHEN sequence % 13 = 2 THEN 'other' ELSE model_digest END AS em,
  CASE WHEN sequence % 13 = 3 THEN props || ' ' ELSE props END AS cj, config_hash, sequence % 13 = 4 AS inf, CASE WHEN sequence % 13 = 5 THEN predictions_json || 'x' ELSE predictions_json END AS predictions_json, predictions_hash, ts_micros,
  CASE WHEN sequence % 13 = 6 THEN '2000-01-01T00:00:00' WHEN sequence % 13 <> 7 THEN strftime(make_timestamp(ts_micros), '%Y-%m-%dT%H:%M:%S') END AS iso, CASE WHEN sequence % 13 <> 8 THEN nonce END AS nonce, sequence,
  CASE WHEN sequence % 13 = 9 THEN sequence + 1 ELSE sequence END AS es, CASE WHEN sequence % 13 = 10 THEN reverse(binding_hash) ELSE binding_hash END AS binding_hash, CASE WHEN sequence % 13 <> 11 THEN signature END AS signature FROM g JOIN p USING (record_id)),
z AS (SELECT *, sequence AS arrival FROM k UNION ALL SELECT *, 10000000000 + sequence FROM k WHERE sequence % 5 = 0),
y AS (SELECT *, {integrity._bound("sha256(predictions_json)")} AS fresh FROM z),
x AS (SELECT *, list_filter([CASE WHEN oi <> image_hash THEN 'image' END, CASE WHEN lower(trim(em)) <> lower(trim(model_digest)) THEN 'model' END, CASE WHEN sha256(cj) <> config_hash THEN 'config' END, CASE WHEN inf THEN 'inference_config' END,
  CASE WHEN sha256(predictions_json) <> predictions_hash THEN 'predictions' END, CASE WHEN strftime(make_timestamp(ts_micros), '%Y-%m-%dT%H:%M:%S') <> iso THEN 'timestamp' END, CASE WHEN sequence <> es THEN 'sequence' END,
  CASE WHEN fresh <> binding_hash THEN 'binding' END, CASE WHEN signature IS NULL OR {integrity._signed("fresh")} <> signature THEN 'signature' END], lambda v: v IS NOT NULL) AS failed FROM y),
s AS (SELECT *, CASE WHEN len(failed) = 0 THEN 1 ELSE 0 END AS intact FROM x),
w AS (SELECT *, coalesce(sum(intact) OVER (PARTITION BY record_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0
  OR (nonce IS NOT NULL AND coalesce(sum(intact) OVER (PARTITION BY nonce ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0)
  OR coalesce(sum(intact) OVER (PARTITION BY binding_hash ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS replayed FROM s),
v AS (SELECT record_id, intact = 1 AND NOT replayed AS passed, intact = 0 AS tampered, replayed, list_concat(failed, CASE WHEN replayed THEN ['replay'] ELSE [] END) AS tampered_fields FROM w)"""


def _verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.full_verification(_checked_records(spark, sf_dir), integrity._KEY, "arrival")


@query(f"WITH {_CHECKED} SELECT * FROM v")
def record_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verified(spark, sf_dir).drop("checks")


@query(f"WITH {_CHECKED} SELECT count(*) AS total, count(*) FILTER (passed) AS passed, count(*) FILTER (replayed) AS replayed, count(*) FILTER (NOT passed AND NOT replayed) AS tampered FROM v")
def record_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.record_counts(_verified(spark, sf_dir))


def _ledger_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of every kind: suppliers as contributors, parts as models, orders as datasets, line items as inferences."""
    at = F.lit(1_700_000_000_000_000).cast("long")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("contributor_id"), F.col("s_nationkey").cast("string").alias("org"), (at + F.col("s_suppkey") * 1_000_000).alias("ts_micros"), "s_suppkey")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("model_id"), F.col("p_size").cast("string").alias("version"), F.upper(F.sha2("p_name", 256)).alias("model_digest"), (at + F.col("p_partkey") * 1_000_000).alias("ts_micros"), "p_partkey")
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("dataset_id"), F.lit("1").alias("version"), F.sha2("o_orderpriority", 256).alias("manifest_hash"), F.col("o_custkey").cast("string").alias("contributor_id"), F.col("o_custkey").cast("long").alias("sample_count"), (at + F.col("o_orderkey") * 1_000_000).alias("ts_micros"), "o_orderkey"
    )
    risk = s.withColumn("risk_level", F.element_at(F.array(*map(F.lit, ("LOW", "MEDIUM", "HIGH", "CRITICAL"))), (F.col("s_suppkey") % 4 + 1).cast("int"))).withColumn("dominant_factor", F.lit("duplicates")).withColumn("disposition", F.when(F.col("s_suppkey") % 4 == 3, "QUARANTINE").otherwise("REVIEW"))
    checked = p.select("model_id", "version", F.lower("model_digest").alias("trusted_digest"), F.when(F.col("p_partkey") % 3 != 0, F.col("model_digest")).alias("current_digest"), "ts_micros")
    inferred = o.select(F.col("dataset_id").alias("record_id"), F.upper("manifest_hash").alias("binding_hash"), F.concat(F.lit("n"), "dataset_id").alias("nonce"), F.col("o_orderkey").cast("long").alias("sequence"), "ts_micros")
    reports = o.filter("o_orderkey % 4 = 0").select(F.col("dataset_id").alias("report_id"), F.col("manifest_hash").alias("report_hash"), F.lit("ACCEPT").alias("disposition"), "ts_micros")
    heads = s.select(F.col("contributor_id").alias("chain_id"), F.sha2("org", 256).alias("head_hash"), F.col("s_suppkey").cast("long").alias("chain_length"), "ts_micros")
    made = [ledger.contributor_registered(s), ledger.dataset_registered(o), ledger.model_registered(p), ledger.model_verified(checked), ledger.risk_recorded(risk), ledger.inference_recorded(inferred), ledger.report_anchored(reports), ledger.audit_head_anchored(heads)]
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out


_SECOND = "CAST(1700000000 + {} AS VARCHAR)"
_EVENTS = f"""
so AS (SELECT CAST(s_suppkey AS VARCHAR) AS id, s_suppkey AS k, CAST(s_nationkey AS VARCHAR) AS org, 1700000000000000 + CAST(s_suppkey AS BIGINT) * 1000000 AS t FROM supplier),
po AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_partkey AS k, CAST(p_size AS VARCHAR) AS ver, sha256(p_name) AS dg, 1700000000000000 + CAST(p_partkey AS BIGINT) * 1000000 AS t FROM part),
oo AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderkey AS k, sha256(o_orderpriority) AS mh, o_custkey AS cust, 1700000000000000 + CAST(o_orderkey AS BIGINT) * 1000000 AS t FROM orders),
ev AS (
SELECT 'EVT-CONTRIB-' || id || '-' || {_SECOND.format("k")} AS event_id, 'CONTRIBUTOR_REGISTERED' AS event_type, id AS asset_id, id AS contributor_id, NULL::VARCHAR AS hash, NULL::VARCHAR AS severity, NULL::VARCHAR AS disposition, t AS ts_micros, '{{"org":"' || org || '"}}' AS metadata FROM so
UNION ALL SELECT 'EVT-DATASET-' || id || '-' || {_SECOND.format("k")}, 'DATASET_REGISTERED', id, CAST(cust AS VARCHAR), mh, NULL, NULL, t, '{{"sample_count":' || cust || ',"version":"1"}}' FROM oo
UNION ALL SELECT 'EVT-MODEL-' || id || '-' || {_SECOND.format("k")}, 'MODEL_REGISTERED', id, NULL, dg, NULL, NULL, t, '{{"version":"' || ver || '"}}' FROM po
UNION ALL SELECT 'EVT-MODVER-' || id || '-' || {_SECOND.format("k")}, CASE WHEN k % 3 <> 0 THEN 'MODEL_VERIFIED' ELSE 'MODEL_TAMPER_DETECTED' END, id, NULL, CASE WHEN k % 3 <> 0 THEN dg END, CASE WHEN k % 3 <> 0 THEN 'INFO' ELSE 'CRITICAL' END, CASE WHEN k % 3 <> 0 THEN 'ACCEPT' ELSE 'QUARANTINE' END, t, '{{"version":"' || ver || '"}}' FROM po
UNION ALL SELECT 'EVT-RISK-' || id || '-' || {_SECOND.format("k")}, CASE WHEN k % 4 = 3 THEN 'QUARANTINE_RECORDED' ELSE 'CONTRIBUTOR_RISK_RECORDED' END, id, id, NULL, CASE k % 4 WHEN 3 THEN 'CRITICAL' WHEN 2 THEN 'HIGH' ELSE 'MEDIUM' END, CASE WHEN k % 4 = 3 THEN 'QUARANTINE' ELSE 'REVIEW' END, t,
  '{{"dominant_factor":"duplicates","risk_level":"' || CASE k % 4 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HIGH' ELSE 'CRITICAL' END || '"}}' FROM so
UNION ALL SELECT 'EVT-INF-' || id, 'INFERENCE_RECORDED', id, NULL, mh, NULL, NULL, t, '{{"nonce":"n' || id || '","sequence":' || id || '}}' FROM oo
UNION ALL SELECT 'EVT-REPORT-' || id || '-' || {_SECOND.format("k")}, 'REPORT_ANCHORED', id, NULL, mh, NULL, 'ACCEPT', t, NULL FROM oo WHERE k % 4 = 0
UNION ALL SELECT 'EVT-AUDIT-' || id || '-' || {_SECOND.format("k")}, 'AUDIT_HEAD_ANCHORED', id, NULL, sha256(org), NULL, NULL, t, '{{"chain_length":' || id || '}}' FROM so)
"""
_QUOTED = lambda c: f"""coalesce('"' || replace({c}, '"', '\\"') || '"', 'null')"""
_JSON = " || ".join([f"""'{lead}"{c}":' || {"CAST(ts_micros AS VARCHAR)" if c == "ts_micros" else _QUOTED(c)}""" for lead, c in zip(["{", *[","] * (len(ledger.EVENT) - 1)], sorted(ledger.EVENT), strict=True)]) + " || '}'"


@query(f"WITH {_EVENTS} SELECT *, sha256({_JSON}) AS event_hash FROM ev")
def ledger_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _ledger_events(spark, sf_dir)
    return events.withColumn("event_hash", ledger.event_hash(events))


@query(f"WITH {_EVENTS} SELECT asset_id, event_type, event_id, contributor_id, hash, severity, disposition, ts_micros, metadata FROM ev QUALIFY row_number() OVER (PARTITION BY asset_id, event_type ORDER BY ts_micros DESC, event_id DESC) = 1")
def ledger_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.latest_state(_ledger_events(spark, sf_dir))


@query(f"WITH {_EVENTS}, q AS (SELECT 'EVT-INF-' || c_custkey AS event_id FROM customer) SELECT event_id, ev.event_id IS NOT NULL AS found, event_type, hash FROM q LEFT JOIN ev USING (event_id)".replace("ev.event_id IS NOT NULL", "event_type IS NOT NULL"))
def ledger_point_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "customer").select(F.concat(F.lit("EVT-INF-"), F.col("c_custkey").cast("string")).alias("event_id"))
    return ledger.point_get(_ledger_events(spark, sf_dir), wanted)


@query(f"""WITH {_EVENTS}, q AS (SELECT CAST(c_custkey AS VARCHAR) AS asset_id FROM customer UNION ALL SELECT 'EVT-INF-' || CAST(c_custkey AS VARCHAR) FROM customer), h AS (SELECT event_id, hash FROM ev WHERE hash IS NOT NULL)
SELECT asset_id AS request_id, asset_id, CAST(CASE WHEN a.hash IS NOT NULL THEN 1 WHEN b.hash IS NOT NULL THEN 2 END AS INT) AS tier, coalesce(a.event_id, b.event_id) AS anchor_event_id, coalesce(a.hash, b.hash) AS anchor_hash
FROM q LEFT JOIN h a ON a.event_id = 'EVT-INF-' || asset_id LEFT JOIN h b ON b.event_id = asset_id""")
def contract_anchor_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two-tier lookup of the ledger's contract code, by record and by event id."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("k"))
    wanted = c.select("k").unionByName(c.select(F.concat(F.lit("EVT-INF-"), "k").alias("k"))).select(F.col("k").alias("request_id"), F.col("k").alias("asset_id"))
    events = _ledger_events(spark, sf_dir).withColumnRenamed("ts_micros", "position")
    return ledger.latest_anchor(wanted, events, by_asset_too=False)


@query(f"""WITH {integrity._CHAIN} SELECT user_id, position, '{{"event_hash":"' || event_hash || '","payload":"' || replace(replace(payload, '\\', '\\\\'), '"', '\\"') || '","position":' || position || ',"prev_hash":"' || prev_hash || '"}}' AS event FROM c""")
def audit_chain_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.export_chain(ledger.build_chain(integrity._audit_events(spark, sf_dir), "user_id", ["event_id"], "payload"), "user_id")


@query("""SELECT l_returnflag || l_linestatus AS layer, count(l_discount) AS n_values, round(avg(l_discount), 6) AS mean, round(stddev_pop(l_discount), 6) AS std, round(count(*) FILTER (l_discount = 0) / count(l_discount), 6) AS zero_share, min(l_discount) AS least, max(l_discount) AS greatest
FROM lineitem GROUP BY 1""")
def activation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("layer"), F.col("l_discount").alias("value"))
    return model.activation_stats(rows)


@query("""SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, o_orderkey) = 1""")
def preferred_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each customer the first filled order, or the first one."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return evaluation.preferred_first(orders, "o_custkey", F.col("o_orderstatus") == "F", ["o_orderkey"])
