"""Queries of provenance, ledger, validation and search over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions import columns as C
from attestry.operators import evaluation, governance, ledger, provenance
from attestry.sources.tables import table

QUERIES = {}
ORACLES = {}
ZERO = C.ZERO_HASH


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("user_id", "event_id", F.concat_ws("|", F.col("event_id").cast("string"), "event_type", F.unix_micros(F.col("ts").cast("timestamp")).cast("string"), "props").alias("payload"))


_CHAIN = f"""
e AS (SELECT user_id, event_id, concat_ws('|', CAST(event_id AS VARCHAR), event_type, CAST(epoch_us(ts) AS VARCHAR), props) AS payload FROM events),
o AS (SELECT user_id, payload, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS position FROM e),
l AS (SELECT user_id, list(payload ORDER BY position) AS ps FROM o GROUP BY 1),
f AS (SELECT user_id, ps, list_transform(range(0, len(ps) + 1), lambda n: CASE WHEN n = 0 THEN '{ZERO}' ELSE list_reduce(list_concat(['{ZERO}'], ps[1 : n]), lambda acc, x: sha256(acc || '|' || x)) END) AS hs FROM l),
c AS (SELECT user_id, CAST(i AS INT) AS position, ps[i + 1] AS payload, hs[i + 1] AS prev_hash, hs[i + 2] AS event_hash FROM (SELECT *, unnest(range(0, len(ps))) AS i FROM f))
"""


@query(f"WITH {_CHAIN} SELECT * FROM c")
def audit_chain_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.build_chain(_audit_events(spark, sf_dir), "user_id", ["event_id"], "payload")


@query(
    f"""WITH {_CHAIN}, t AS (SELECT user_id, CASE WHEN user_id % 11 = 0 AND position = 2 THEN position + 1 ELSE position END AS position,
  CASE WHEN user_id % 7 = 0 AND position = 1 THEN payload || '!' ELSE payload END AS payload, prev_hash, CASE WHEN user_id % 5 = 0 AND position = 0 THEN sha256(event_hash) ELSE event_hash END AS event_hash FROM c),
r AS (SELECT *, row_number() OVER w - 1 AS place, lag(event_hash, 1, '{ZERO}') OVER w AS lh FROM t WINDOW w AS (PARTITION BY user_id ORDER BY position, event_hash)),
b AS (SELECT user_id, place, CASE WHEN position <> place THEN 'index' WHEN prev_hash <> lh THEN 'link' WHEN event_hash <> sha256(prev_hash || '|' || payload) THEN 'hash' END AS bad FROM r)
SELECT user_id, count(*) AS events, count(bad) = 0 AS valid, min(CASE WHEN bad IS NOT NULL THEN place END) AS broken_index, arg_min(bad, place) FILTER (bad IS NOT NULL) AS reason FROM b GROUP BY 1"""
)
def audit_chain_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = ledger.build_chain(_audit_events(spark, sf_dir), "user_id", ["event_id"], "payload")
    at = lambda n, k: (F.col("user_id") % n == 0) & (F.col("position") == k)
    bad = chain.select(
        "user_id",
        F.when(at(11, 2), F.col("position") + 1).otherwise(F.col("position")).alias("position"),
        F.when(at(7, 1), F.concat("payload", F.lit("!"))).otherwise(F.col("payload")).alias("payload"),
        "prev_hash",
        F.when(at(5, 0), F.sha2("event_hash", 256)).otherwise(F.col("event_hash")).alias("event_hash"),
    )
    return ledger.verify_chain(bad, "user_id")


@query("""
WITH p AS (SELECT l_orderkey, row_number() OVER w AS pos, l_linenumber - lag(l_linenumber) OVER w AS step FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber))
SELECT l_orderkey, count(*) AS n_rows, count(CASE WHEN step <> 1 THEN 1 END) AS breaks, CAST(min(CASE WHEN step <> 1 THEN pos END) AS INT) AS first_break FROM p GROUP BY 1
""")
def sequence_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.sequence_breaks(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", ["l_shipdate", "l_partkey", "l_suppkey", "l_linenumber"])


@query("""
WITH RECURSIVE o AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber) AS k FROM lineitem),
f AS (SELECT l_orderkey, k, s AS last_sequence, 1::BIGINT AS accepted, 0::BIGINT AS rejected FROM o WHERE k = 1
  UNION ALL SELECT o.l_orderkey, o.k, CASE WHEN o.s = f.last_sequence + 1 THEN o.s ELSE f.last_sequence END, f.accepted + CASE WHEN o.s = f.last_sequence + 1 THEN 1 ELSE 0 END, f.rejected + CASE WHEN o.s = f.last_sequence + 1 THEN 0 ELSE 1 END
  FROM f JOIN o ON o.l_orderkey = f.l_orderkey AND o.k = f.k + 1)
SELECT l_orderkey, accepted, rejected, last_sequence FROM f QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY k DESC) = 1
""")
def sequence_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.accepted_sequence(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", ["l_shipdate", "l_partkey", "l_suppkey", "l_linenumber"])


@query("SELECT event_id, user_id, json_extract_string(props, '$.k') AS nonce, row_number() OVER (PARTITION BY user_id, json_extract_string(props, '$.k') ORDER BY event_id) > 1 AS is_replay FROM events")
def nonce_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.get_json_object("props", "$.k").alias("nonce"))
    return provenance.reused(e, ["user_id", "nonce"], ["event_id"])


_KEY = b"demo-key"


def _pad(byte: int) -> str:
    return "".join(f"\\x{b ^ byte:02X}" for b in _KEY.ljust(64, b"\0"))


def _bound(predictions: str, more: str = "") -> str:
    there = [f"coalesce({c}, chr(1))" for c in ("lower(image_hash)", "lower(trim(model_digest))", "lower(config_hash)", predictions, "CAST(ts_micros AS VARCHAR)", "nonce", "CAST(sequence AS VARCHAR)")]
    return f"sha256(concat_ws('|', {', '.join(there)}{more}))"


def _signed(binding: str) -> str:
    return f"sha256('{_pad(0x5C)}'::BLOB || unhex(sha256('{_pad(0x36)}'::BLOB || encode({binding}))))"


_RECORDS = f"""
r AS (SELECT CAST(event_id AS VARCHAR) AS record_id, sha256(event_type) AS image_hash, upper(sha256('model')) AS model_digest, sha256(props) AS config_hash, '[' || props || ']' AS predictions_json, epoch_us(ts) AS ts_micros,
  'n' || event_id AS nonce, event_id AS sequence FROM events),
h AS (SELECT *, sha256(predictions_json) AS predictions_hash FROM r),
b AS (SELECT *, {_bound('predictions_hash')} AS binding_hash FROM h),
g AS (SELECT *, {_signed('binding_hash')} AS signature FROM b)
"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    rows = e.select(
        F.col("event_id").cast("string").alias("record_id"),
        F.sha2("event_type", 256).alias("image_hash"),
        F.upper(F.sha2(F.lit("model"), 256)).alias("model_digest"),
        F.sha2("props", 256).alias("config_hash"),
        F.concat(F.lit("["), "props", F.lit("]")).alias("predictions_json"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_micros"),
        F.concat(F.lit("n"), F.col("event_id")).alias("nonce"),
        F.col("event_id").alias("sequence"),
    )
    return provenance.bind(rows, _KEY)


@query(f"WITH {_RECORDS} SELECT * FROM g")
def binding_and_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir)


@query(
    f"""WITH {_RECORDS}, c AS (SELECT * REPLACE (CASE WHEN sequence % 4 = 0 THEN sha256(image_hash) ELSE image_hash END AS image_hash, CASE WHEN sequence % 4 = 1 THEN nonce || 'x' ELSE nonce END AS nonce,
  CASE WHEN sequence % 4 = 2 THEN reverse(signature) ELSE signature END AS signature) FROM g),
f AS (SELECT *, sha256(predictions_json) AS ph, {_bound('sha256(predictions_json)')} AS bh FROM c),
t AS (SELECT f.record_id, list_sort(list_distinct(list_filter([CASE WHEN ph <> f.predictions_hash THEN 'predictions_hash' END, CASE WHEN bh <> f.binding_hash THEN 'binding_hash' END, CASE WHEN {_signed('bh')} <> f.signature THEN 'signature' END,
  CASE WHEN NOT f.ts_micros > 0 THEN 'ts_micros' END, CASE WHEN length(trim(f.nonce)) = 0 THEN 'nonce' END, CASE WHEN f.sequence < 0 THEN 'sequence' END,
  CASE WHEN f.image_hash <> g.image_hash THEN 'image_hash' END, CASE WHEN f.nonce <> g.nonce THEN 'nonce' END, CASE WHEN f.binding_hash <> g.binding_hash THEN 'binding_hash' END, CASE WHEN f.signature <> g.signature THEN 'signature' END], lambda x: x IS NOT NULL))) AS tampered_fields FROM f JOIN g USING (record_id))
SELECT record_id, len(tampered_fields) = 0 AS passed, tampered_fields FROM t"""
)
def record_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of which three quarters have one field changed after signing."""
    good = _records(spark, sf_dir)
    n = F.col("sequence") % 4
    bad = good.withColumn("image_hash", F.when(n == 0, F.sha2("image_hash", 256)).otherwise(F.col("image_hash"))).withColumn("nonce", F.when(n == 1, F.concat("nonce", F.lit("x"))).otherwise(F.col("nonce"))).withColumn("signature", F.when(n == 2, F.reverse("signature")).otherwise(F.col("signature")))
    return provenance.verify(bad, _KEY, good).select("record_id", "passed", "tampered_fields")


@query("""
WITH d AS (SELECT l_orderkey, l_quantity, l_discount, l_partkey, l_returnflag, l_tax, l_linenumber FROM lineitem),
k AS (SELECT l_orderkey, '{"box":[' || CAST(CAST(l_quantity AS DOUBLE) AS VARCHAR) || '],"category_id":' || l_linenumber || ',"category_name":"' || l_returnflag || '","confidence":' || CAST(CAST(l_discount AS DOUBLE) AS VARCHAR) || '}' AS j, l_linenumber, l_returnflag, l_discount, l_quantity FROM d)
SELECT l_orderkey, sha256('[' || string_agg(j, ',' ORDER BY l_linenumber, l_returnflag, l_discount DESC, l_quantity) || ']') AS predictions_hash FROM k GROUP BY 1
""")
def canonical_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.struct(F.array("l_quantity").alias("box"), F.col("l_discount").alias("confidence"), F.col("l_linenumber").alias("category_id"), F.concat(F.lit(" "), "l_returnflag").alias("category_name"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(p).alias("p"))
    return rows.select("l_orderkey", F.sha2(provenance.canonical_predictions(F.col("p")), 256).alias("predictions_hash"))


def _inference_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.concat_ws("/", F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")).alias("record_id"), "l_orderkey", F.col("l_linenumber").cast("long").alias("sequence"), F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("ts_micros"), F.col("l_returnflag").alias("nonce"), (F.col("l_partkey") * 100000000 + F.col("l_suppkey") * 100 + F.col("l_linenumber")).alias("pos"))


@query("""
WITH r AS (SELECT concat_ws('/', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS record_id, l_orderkey, l_linenumber AS s, epoch_us(l_shipdate) AS t, l_returnflag AS nonce, CAST(l_partkey AS BIGINT) * 100000000 + CAST(l_suppkey AS BIGINT) * 100 + l_linenumber AS pos FROM lineitem)
SELECT record_id, l_orderkey, coalesce(s = lag(s) OVER w + 1, true) AS sequence_ok, coalesce(t >= lag(t) OVER w, true) AS time_ok, row_number() OVER (PARTITION BY l_orderkey, nonce ORDER BY pos, t) = 1 AS nonce_ok FROM r WINDOW w AS (PARTITION BY l_orderkey ORDER BY pos, t)
""")
def inference_chain_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.chain_checks(_inference_chain(spark, sf_dir), "l_orderkey", ["pos", "ts_micros"])


_MERKLE = """
lf AS (SELECT o_custkey AS batch, o_orderkey AS k, sha256(CAST(o_orderkey AS VARCHAR)) AS h FROM orders),
t AS (SELECT batch, 0 AS level, row_number() OVER (PARTITION BY batch ORDER BY k) - 1 AS i, h, count(*) OVER (PARTITION BY batch) AS n FROM lf
  UNION ALL SELECT batch, level + 1, i // 2, sha256(max(CASE WHEN i % 2 = 0 THEN h END) || ':' || coalesce(max(CASE WHEN i % 2 = 1 THEN h END), max(CASE WHEN i % 2 = 0 THEN h END))), (n + 1) // 2 FROM t WHERE n > 1 GROUP BY batch, level, i // 2, n)
"""


def _leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("batch"), "o_orderkey", F.sha2(F.col("o_orderkey").cast("string"), 256).alias("leaf"))


@query(f"WITH RECURSIVE {_MERKLE} SELECT t.batch, a.n_leaves, a.first_leaf, a.last_leaf, t.h AS root FROM t JOIN (SELECT batch, count(*) AS n_leaves, min(k) AS first_leaf, max(k) AS last_leaf FROM lf GROUP BY 1) a USING (batch) WHERE t.n = 1")
def merkle_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.merkle_roots(_leaves(spark, sf_dir), "batch", "o_orderkey", "leaf")


@query(f"WITH RECURSIVE {_MERKLE} SELECT batch, CAST(level AS INT) AS level, i, h AS hash FROM t")
def merkle_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.merkle_levels(_leaves(spark, sf_dir), "batch", "o_orderkey", "leaf").select("batch", "level", "i", "hash")


@query(f"WITH RECURSIVE {_MERKLE} SELECT l.batch, l.i, l.h AS leaf_hash, CAST((SELECT max(level) FROM t m WHERE m.batch = l.batch) AS INT) AS proof_steps, true AS verified FROM t l WHERE l.level = 0")
def merkle_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leaf's proof, folded and compared with the root that is found without proofs."""
    leaves = _leaves(spark, sf_dir)
    levels = ledger.merkle_levels(leaves, "batch", "o_orderkey", "leaf")
    roots = ledger.merkle_roots(leaves, "batch", "o_orderkey", "leaf").select("batch", "root")
    proofs = ledger.merkle_proofs(levels, "batch").join(roots, "batch")
    verified = ledger.proof_root(F.col("hash"), F.col("proof")) == F.col("root")
    return proofs.select("batch", "i", F.col("hash").alias("leaf_hash"), F.coalesce(F.size("proof"), F.lit(0)).alias("proof_steps"), verified.alias("verified"))


def _ledger_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as ledger events: some named after an inference, some after the asset itself, some without a hash."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    asset = F.concat(F.lit("A"), F.col("o_custkey"))
    name = F.when(k % 10 == 0, F.concat(F.lit("EVT-INF-"), asset)).when(k % 10 == 1, asset).otherwise(F.concat(F.lit("EVT-"), k))
    return o.select(name.alias("event_id"), asset.alias("asset_id"), k.alias("position"), F.when(k % 3 > 0, F.upper(F.sha2(k.cast("string"), 256))).alias("hash"))


_ANCHORS = """
ev AS (SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'EVT-INF-A' || o_custkey WHEN o_orderkey % 10 = 1 THEN 'A' || o_custkey ELSE 'EVT-' || o_orderkey END AS event_id, 'A' || o_custkey AS asset_id, o_orderkey AS position,
  CASE WHEN o_orderkey % 3 > 0 THEN sha256(CAST(o_orderkey AS VARCHAR)) END AS hash FROM orders),
rq AS (SELECT c_custkey AS request_id, 'A' || c_custkey AS asset_id FROM customer),
ca AS (SELECT request_id, CASE WHEN event_id = 'EVT-INF-' || rq.asset_id THEN 1 WHEN event_id = rq.asset_id THEN 2 ELSE 3 END AS tier, event_id, hash, position FROM rq JOIN ev ON ev.asset_id = rq.asset_id WHERE hash IS NOT NULL),
c3 AS (SELECT request_id, 3 AS tier, event_id, hash, position FROM ca UNION ALL SELECT * FROM ca WHERE tier < 3),
an AS (SELECT rq.request_id, rq.asset_id, CAST(tier AS INT) AS tier, event_id AS anchor_event_id, hash AS anchor_hash FROM rq LEFT JOIN (SELECT * FROM c3 QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY tier, position DESC) = 1) b USING (request_id))
"""


def _anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request_id"), F.concat(F.lit("A"), F.col("c_custkey")).alias("asset_id"))
    return ledger.latest_anchor(requests, _ledger_events(spark, sf_dir))


@query(f"WITH {_ANCHORS} SELECT * FROM an")
def anchor_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _anchors(spark, sf_dir)


@query(
    f"""WITH {_ANCHORS}, d AS (SELECT request_id, request_id % 5 <> 0 AS ok, CASE WHEN request_id % 4 = 0 THEN sha256(anchor_hash) ELSE anchor_hash END AS lh, anchor_hash AS ah FROM an)
SELECT request_id, CASE WHEN ah IS NULL THEN 'UNANCHORED' WHEN lh <> ah THEN 'TAMPER_DETECTED' WHEN NOT ok THEN 'LOCAL_VERIFICATION_FAILED' ELSE 'TRUST_VERIFIED' END AS status,
  CASE WHEN ah IS NULL AND ok THEN 'local checks passed, no anchor' WHEN ah IS NULL THEN 'local checks failed, no anchor' WHEN lh <> ah THEN 'hash differs from the anchor' WHEN NOT ok THEN 'local checks failed' ELSE 'both layers agree' END AS reason FROM d"""
)
def dual_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _anchors(spark, sf_dir)
    local = a.select("request_id", (F.col("request_id") % 5 != 0).alias("local_ok"), F.when(F.col("request_id") % 4 == 0, F.sha2("anchor_hash", 256)).otherwise(F.upper("anchor_hash")).alias("local_hash"), "anchor_hash")
    return ledger.dual_verification(local)


_BLOCKS = f"""
l AS (SELECT o_custkey, list('tx' || o_orderkey || ':' || sha256(CAST(o_totalprice * 100 AS BIGINT)::VARCHAR) ORDER BY o_orderdate, o_orderkey) AS ps FROM orders GROUP BY 1),
f AS (SELECT o_custkey, ps, list_transform(range(0, len(ps) + 1), lambda n: CASE WHEN n = 0 THEN '{ZERO}' ELSE list_reduce(list_concat(['{ZERO}'], ps[1 : n]), lambda acc, x: sha256(acc || '|' || x)) END) AS hs FROM l),
bl AS (SELECT o_custkey, CAST(i AS INT) AS height, hs[i] AS prev_block_hash, hs[i + 1] AS block_hash FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM f))
"""


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("h", F.sha2(F.round(F.col("o_totalprice") * 100).cast("long").cast("string"), 256))
    return ledger.block_chain(o, "o_custkey", ["o_orderdate", "o_orderkey"], "h")


@query(f"WITH {_BLOCKS} SELECT * FROM bl")
def ledger_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir)


@query(f"WITH {_BLOCKS} SELECT o_custkey, max(height)::BIGINT AS block_height, count(*) AS transactions, arg_max(block_hash, height) AS head_hash FROM bl GROUP BY 1")
def ledger_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.ledger_status(_blocks(spark, sf_dir), "o_custkey")


@query("SELECT event_id, user_id, event_type, value FROM events WHERE event_type = 'purchase' ORDER BY event_id DESC LIMIT 100")
def events_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return ledger.query_events(e, {"event_type": "purchase", "user_id": None}, "event_id")


@query("SELECT event_type, count(*) AS events, count(DISTINCT user_id) AS users, max(event_id) AS newest FROM events GROUP BY 1")
def asset_history_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users"), F.max("event_id").alias("newest"))


def manifest_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and labels as a benchmark manifest, with some faults of each kind."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    n, k = F.col("doc_id"), F.col("doc_id") % 9
    attacked = F.coalesce(F.col("toxic") == 1, F.lit(False))
    return d.select(
        (n - F.when(n % 97 == 1, 1).otherwise(0)).alias("sample_id"),
        F.when(n % 50 == 0, "").otherwise(F.concat(F.lit("orig\\"), n)).alias("original_image"),
        F.concat_ws("/", "source", n.cast("string")).alias("current_image"),
        attacked.alias("is_attacked"),
        (F.col("quality") == 0).alias("is_shifted"),
        F.when(attacked, F.element_at(F.array(*(F.lit(x) for x in ["label_flip", "systematic_mislabel", "corner", "unknown", "ood_insertion", "blended", "spectral", "near_duplicate_flood", "corner"])), (k + 1).cast("int"))).alias("attack_type"),
        F.when(F.col("quality") == 0, F.when(k < 5, "blur").otherwise("fog")).alias("shift_type"),
        F.col("lang").alias("original_label"),
        F.when(k == 0, F.col("lang")).otherwise("xx").alias("modified_label"),
        F.when(k < 8, "{}").otherwise("").alias("parameters"),
    )


_MANIFEST = """
mf AS (SELECT d.doc_id - CASE WHEN d.doc_id % 97 = 1 THEN 1 ELSE 0 END AS sample_id, d.doc_id AS n, d.doc_id % 9 AS k, coalesce(toxic = 1, false) AS att, coalesce(quality = 0, false) AS sh, lang FROM documents d LEFT JOIN labels USING (doc_id)),
ml AS (SELECT *, count(*) OVER (PARTITION BY sample_id) AS c FROM mf)
"""


@query(
    f"""WITH {_MANIFEST} SELECT sample_id, rule FROM (SELECT sample_id, unnest([CASE WHEN c > 1 THEN 'duplicate_id' END, CASE WHEN att AND k = 3 THEN 'invalid_attack_type' END, CASE WHEN sh AND k >= 5 THEN 'invalid_shift_type' END,
  CASE WHEN att AND sh THEN 'attacked_and_shifted' END, CASE WHEN n % 50 = 0 THEN 'missing_original' END, CASE WHEN att AND k = 0 THEN 'label_unchanged' END, CASE WHEN att AND k = 8 THEN 'missing_parameters' END]) AS rule FROM ml) WHERE rule IS NOT NULL"""
)
def manifest_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.manifest_errors(manifest_of(spark, sf_dir))


@query(
    f"""WITH {_MANIFEST}, a AS (SELECT CASE WHEN att THEN ['label_flip', 'systematic_mislabel', 'corner', 'unknown', 'ood_insertion', 'blended', 'spectral', 'near_duplicate_flood', 'corner'][k + 1] WHEN sh THEN 'shift_' || CASE WHEN k < 5 THEN 'blur' ELSE 'fog' END ELSE 'clean' END AS kind FROM mf)
SELECT kind, count(*) AS samples FROM a GROUP BY 1"""
)
def attack_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.attack_summary(manifest_of(spark, sf_dir))


_SPLIT = """
sp AS (SELECT doc_id, source, CAST('0x' || substr(md5('42:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS s FROM documents),
pt AS (SELECT doc_id, source, CASE WHEN s < 0.25 THEN 'calibration' WHEN s < 0.5 THEN 'clean' ELSE 'attack_' || CAST(floor((s - 0.5) * 10) + 1 AS BIGINT) END AS part FROM sp)
"""


@query(f"WITH {_SPLIT} SELECT doc_id, part FROM pt")
def three_way_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.three_way_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query("SELECT item_id, CAST(ntile(4) OVER (ORDER BY md5('42:' || CAST(item_id AS VARCHAR)), item_id) AS INT) AS part FROM benchmark")
def exact_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.exact_split(table(spark, sf_dir, "benchmark").select("item_id"), "item_id")


@query(f"WITH {_SPLIT}, m AS (SELECT DISTINCT part, md5(text) AS m FROM pt JOIN documents USING (doc_id)) SELECT a.part AS left_part, b.part AS right_part, count(*) AS shared FROM m a JOIN m b ON a.m = b.m AND a.part < b.part GROUP BY ALL")
def leakage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts in several parts of the split, under paths of either kind of slash."""
    parts = evaluation.three_way_split(table(spark, sf_dir, "documents"), "doc_id")
    return evaluation.leakage(parts.select("part", F.concat("part", F.lit("\\"), F.md5("text")).alias("path")), "part", "path")


@query("SELECT doc_id, source, lang FROM documents WHERE contains(lower(text), 'worthless') OR contains(lower(source), 'worthless') OR contains(lower(lang), 'worthless')")
def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter(C.contains_any("Worthless", "text", "source", "lang")).select("doc_id", "source", "lang")


@query("""
WITH r AS (SELECT c_custkey AS k, c_nationkey AS c, c_acctbal AS v FROM customer)
SELECT n_name AS contributor, count(*) AS samples, list_sort(list_distinct(list(coalesce(c_mktsegment, '')))) AS affected_batches FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal < 0 GROUP BY 1
""")
def affected_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestry.operators.risk import affected_batches as batches

    rows = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("sample_id"), F.col("n_name").alias("contributor"), F.col("c_mktsegment").alias("batch"), "c_acctbal")
    flagged = rows.filter("c_acctbal < 0")
    return flagged.groupBy("contributor").agg(F.count("*").alias("samples")).join(batches(rows, flagged), "contributor")


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS finding_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'CRITICAL' WHEN '2-HIGH' THEN 'HIGH' WHEN '3-MEDIUM' THEN 'MEDIUM' ELSE 'LOW' END AS severity, CAST(row_number() OVER (PARTITION BY severity ORDER BY o_orderkey) AS INT) AS rank,
  CASE severity WHEN 'CRITICAL' THEN CASE rank WHEN 1 THEN 18 WHEN 2 THEN 12 ELSE 6 END WHEN 'HIGH' THEN CASE rank WHEN 1 THEN 10 WHEN 2 THEN 6 ELSE 3 END WHEN 'MEDIUM' THEN CASE rank WHEN 1 THEN 5 ELSE 3 END ELSE 2 END AS points FROM orders WHERE o_totalprice > 450000
""")
def ranked_penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_penalties(table(spark, sf_dir, "orders").filter("o_totalprice > 450000"))


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS finding_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'CRITICAL' WHEN '2-HIGH' THEN 'HIGH' WHEN '3-MEDIUM' THEN 'MEDIUM' ELSE 'LOW' END AS severity, CAST(row_number() OVER (PARTITION BY severity ORDER BY o_orderkey) AS INT) AS rank,
  CASE severity WHEN 'CRITICAL' THEN CASE rank WHEN 1 THEN 18 WHEN 2 THEN 12 ELSE 6 END WHEN 'HIGH' THEN CASE rank WHEN 1 THEN 10 WHEN 2 THEN 6 ELSE 3 END WHEN 'MEDIUM' THEN CASE rank WHEN 1 THEN 5 ELSE 3 END ELSE 2 END AS points FROM orders
""")
def ranked_penalties_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The penalties of every order, where ranked_penalties takes the dear ones alone."""
    return _order_penalties(table(spark, sf_dir, "orders"))


def _order_penalties(orders: DataFrame) -> DataFrame:
    p = F.col("o_orderpriority")
    severity = F.when(p == "1-URGENT", "CRITICAL").when(p == "2-HIGH", "HIGH").when(p == "3-MEDIUM", "MEDIUM").otherwise("LOW")
    rows = orders.select(F.col("o_orderkey").cast("string").alias("finding_id"), severity.alias("severity"), "o_orderkey")
    return governance.ranked_penalties(rows, "o_orderkey").drop("o_orderkey")


@query(None)
def stream_sequence_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming sequence rule over events as a file stream, run to its end; its verdicts by key and reason."""
    from attestry.streaming.replay import sequence_guard

    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    keyed = stream.select(F.col("event_type").alias("key"), "event_id", F.get_json_object("props", "$.k").cast("long").alias("sequence"))
    return _run_stream(spark, sequence_guard(keyed), "guard").groupBy("key", "accepted", "reason").agg(F.count("*").alias("events"))


@query("SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestry.streaming.replay import windowed

    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = windowed(e, "ts", "1 hour", by=("event_type",))
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).withColumn("window_end", F.col("window_end").cast("timestamp_ntz"))


def _run_stream(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    import uuid

    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    base = f"{folder}/streams/{name}-{uuid.uuid4().hex}"
    run = stream.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{base}/rows")
