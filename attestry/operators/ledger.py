"""Hash chains, Merkle trees, and lookups in an append-only event ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestry.functions.columns import ZERO_HASH


def link_hash(previous: Column, payload: Column) -> Column:
    return F.sha2(F.concat_ws("|", previous, payload), 256)


def build_chain(events: DataFrame, key: str, order: list[str], payload: str) -> DataFrame:
    """events as (key, position from 0, payload, prev_hash, event_hash): one chain for each key, folded in order."""
    listed = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(payload).alias("_p")))).alias("_rows"))
    start = F.array(F.lit(ZERO_HASH))
    chain = F.aggregate("_rows", start, lambda acc, row: F.concat(acc, F.array(link_hash(F.element_at(acc, -1), row["_p"]))))
    return listed.select(key, F.arrays_zip(F.col("_rows._p").alias("payload"), F.slice(chain, 2, F.size("_rows")).alias("event_hash"), F.slice(chain, 1, F.size("_rows")).alias("prev_hash")).alias("_z")).select(key, F.posexplode("_z").alias("position", "_e")).select(key, "position", F.col("_e.payload").alias("payload"), F.col("_e.prev_hash").alias("prev_hash"), F.col("_e.event_hash").alias("event_hash"))


def verify_chain(chain: DataFrame, key: str) -> DataFrame:
    """For each key: events, the first failing place and which check failed there (index, link, then hash). No fold: each event needs its neighbour only."""
    w = W.partitionBy(key).orderBy("position")
    place = F.row_number().over(w) - 1
    bad = F.when(F.col("position") != place, "index").when(F.col("prev_hash") != F.lag("event_hash", 1, ZERO_HASH).over(w), "link").when(F.col("event_hash") != link_hash(F.col("prev_hash"), F.col("payload")), "hash")
    rows = chain.select(key, place.alias("_place"), bad.alias("_bad"))
    first = F.min(F.when(F.col("_bad").isNotNull(), F.struct("_place", "_bad")))
    return rows.groupBy(key).agg(F.count("*").alias("events"), first.alias("_f")).select(key, "events", F.col("_f").isNull().alias("valid"), F.col("_f._place").cast("long").alias("broken_index"), F.col("_f._bad").alias("reason"))


def pair_hash(left: Column, right: Column) -> Column:
    return F.sha2(F.concat(left, F.lit(":"), right), 256)


def merkle_levels(leaves: DataFrame, batch: str, index: str, leaf: str) -> DataFrame:
    """(batch, level, i, hash) for all levels, as joins by halved index: one batch may be of any size.

    Leaves are taken in lower case, empty ones dropped and the rest numbered by index; a last odd node is paired with itself.
    """
    kept = leaves.filter(F.coalesce(F.length(leaf), F.lit(0)) > 0)
    level = kept.select(batch, (F.row_number().over(W.partitionBy(batch).orderBy(index)) - 1).cast("long").alias("i"), F.lower(leaf).alias("hash"))
    depth = 0
    out = level.withColumn("level", F.lit(0))
    most = level.agg(F.max("i")).first()[0] or 0
    while most > 0:
        depth += 1
        most //= 2
        left, right = F.max(F.when(F.col("i") % 2 == 0, F.col("hash"))), F.max(F.when(F.col("i") % 2 == 1, F.col("hash")))
        # a tree that has its root already doesn't grow on
        whole = level.withColumn("_n", F.max("i").over(W.partitionBy(batch)))
        level = whole.filter("_n > 0").groupBy(batch, F.floor(F.col("i") / 2).alias("i")).agg(left.alias("_l"), right.alias("_r")).select(batch, "i", pair_hash(F.col("_l"), F.coalesce("_r", "_l")).alias("hash"))
        out = out.unionByName(level.withColumn("level", F.lit(depth)))
    return out


def merkle_fold(leaves: Column) -> Column:
    """Root of an array of leaves, as one expression, for batches of bounded size."""

    def up(nodes: Column, _: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(nodes) / 2).cast("int") - 1)), lambda k: pair_hash(F.get(nodes, 2 * k), F.coalesce(F.get(nodes, 2 * k + 1), F.get(nodes, 2 * k))))
        return F.when(F.size(nodes) > 1, pairs).otherwise(nodes)

    return F.get(F.aggregate(F.sequence(F.lit(1), F.lit(31)), F.transform(leaves, lambda x: F.lower(x)), up), 0)


def merkle_roots(leaves: DataFrame, batch: str, index: str, leaf: str) -> DataFrame:
    """(batch, n_leaves, first_leaf, last_leaf, root): what a batch is anchored by. Batches are of bounded size (see merkle_levels for others)."""
    kept = leaves.filter(F.coalesce(F.length(leaf), F.lit(0)) > 0)
    listed = kept.groupBy(batch).agg(F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.col(leaf).alias("h")))).alias("_l"))
    hashes = F.col("_l.h")
    return listed.select(batch, F.size("_l").cast("long").alias("n_leaves"), F.get(F.col("_l.i"), 0).alias("first_leaf"), F.element_at(F.col("_l.i"), -1).alias("last_leaf"), merkle_fold(hashes).alias("root"))


def merkle_proofs(levels: DataFrame, batch: str) -> DataFrame:
    """(batch, i, hash, proof): for each leaf its siblings from the bottom, each with its side; an odd node is its own."""
    heights = levels.groupBy(batch).agg(F.max("level").alias("_top"))
    leaves = levels.filter("level = 0").select(batch, "i", "hash").join(heights, batch)
    steps = leaves.select(batch, "i", "hash", F.explode(F.when(F.col("_top") > 0, F.sequence(F.lit(0), F.col("_top") - 1)).otherwise(F.array().cast("array<int>"))).alias("level"))
    steps = steps.withColumn("_at", F.floor(F.col("i") / F.pow(F.lit(2), F.col("level"))).cast("long"))
    sib = levels.select(batch, "level", F.col("i").alias("_s"), F.col("hash").alias("_sh"))
    own = levels.select(batch, "level", F.col("i").alias("_at"), F.col("hash").alias("_oh"))
    found = steps.withColumn("_s", F.col("_at").bitwiseXOR(F.lit(1))).join(sib, [batch, "level", "_s"], "left").join(own, [batch, "level", "_at"])
    step = F.struct("level", F.when(F.col("_at") % 2 == 0, "right").otherwise("left").alias("side"), F.coalesce("_sh", "_oh").alias("hash"))
    proofs = found.groupBy(batch, "i").agg(F.array_sort(F.collect_list(step)).alias("proof"))
    return leaves.drop("_top").join(proofs, [batch, "i"], "left")


def proof_root(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(F.coalesce(proof, F.array().cast("array<struct<level:int,side:string,hash:string>>")), F.lower(leaf), lambda acc, p: F.when(p["side"] == "left", pair_hash(p["hash"], acc)).otherwise(pair_hash(acc, p["hash"])))


def latest_anchor(requests: DataFrame, events: DataFrame, by_asset_too: bool = True) -> DataFrame:
    """For each request (request_id, asset_id) its anchor: the event EVT-INF-<asset>, else the event of that very id, else the newest of the asset with a hash.

    events: event_id, asset_id, position, hash. Each tier is an equality join; the best of at most three rows stays.
    Without by_asset_too there is no third tier, as in the ledger's own contract code.
    """
    hashed = events.filter(F.col("hash").isNotNull())
    by_id = hashed.groupBy("event_id").agg(F.max_by(F.struct("event_id", "hash"), "position").alias("e"))
    by_asset = hashed.groupBy("asset_id").agg(F.max_by(F.struct("event_id", "hash"), "position").alias("e"))
    named = requests.withColumn("_k", F.concat(F.lit("EVT-INF-"), F.col("asset_id"))).join(by_id, F.col("_k") == F.col("event_id")).select("request_id", F.lit(1).alias("tier"), "e")
    same = requests.join(by_id, F.col("asset_id") == F.col("event_id")).select("request_id", F.lit(2).alias("tier"), "e")
    newest = requests.join(by_asset, "asset_id").select("request_id", F.lit(3).alias("tier"), "e")
    tiers = named.unionByName(same).unionByName(newest) if by_asset_too else named.unionByName(same)
    best = tiers.groupBy("request_id").agg(F.min_by(F.struct("tier", "e.event_id", "e.hash"), "tier").alias("b"))
    return requests.join(best, "request_id", "left").select("request_id", "asset_id", F.col("b.tier").alias("tier"), F.col("b.event_id").alias("anchor_event_id"), F.lower(F.col("b.hash")).alias("anchor_hash"))


def dual_verification(anchored: DataFrame) -> DataFrame:
    """anchored (request_id, local_ok, local_hash, anchor_hash) with status and reason; the anchor is judged before the local result."""
    anchor, match = F.col("anchor_hash").isNotNull(), F.lower("local_hash") == F.lower("anchor_hash")
    status = F.when(~anchor, "UNANCHORED").when(~match, "TAMPER_DETECTED").when(~F.col("local_ok"), "LOCAL_VERIFICATION_FAILED").otherwise("TRUST_VERIFIED")
    reason = F.when(~anchor & F.col("local_ok"), "local checks passed, no anchor").when(~anchor, "local checks failed, no anchor").when(~match, "hash differs from the anchor").when(~F.col("local_ok"), "local checks failed").otherwise("both layers agree")
    return anchored.select("request_id", status.alias("status"), reason.alias("reason"))


def query_events(events: DataFrame, filters: dict[str, object], order: str, limit: int = 100) -> DataFrame:
    """The newest events that fit all filters (a null value or ALL fits everything)."""
    rows = events
    for name, value in filters.items():
        if value not in (None, "ALL"):
            rows = rows.filter(F.col(name) == value)
    return rows.orderBy(F.desc(order)).limit(limit)


def block_chain(events: DataFrame, key: str, order: list[str], event_hash: str) -> DataFrame:
    """Ledger blocks for each channel: height from 1, block_hash over the block before, the transaction and the event's hash."""
    named = events.withColumn("_payload", F.concat_ws(":", F.concat(F.lit("tx"), F.col(order[-1]).cast("string")), F.col(event_hash)))
    return build_chain(named, key, order, "_payload").select(key, (F.col("position") + 1).alias("height"), F.col("prev_hash").alias("prev_block_hash"), F.col("event_hash").alias("block_hash"))


def ledger_status(blocks: DataFrame, key: str) -> DataFrame:
    return blocks.groupBy(key).agg(F.max("height").cast("long").alias("block_height"), F.count("*").alias("transactions"), F.max_by("block_hash", "height").alias("head_hash"))


def asset_history(events: DataFrame, asset: str, order: str) -> DataFrame:
    return events.filter(F.col("asset_id") == asset).orderBy(order)


#: Columns of a ledger event, besides those that the ledger itself sets when it takes the event (tx_id, block_number).
EVENT = ["event_id", "event_type", "asset_id", "contributor_id", "hash", "severity", "disposition", "ts_micros", "metadata"]


def event_hash(events: DataFrame) -> Column:
    """SHA-256 of the event's compact JSON with its names in order, nulls included, without what the ledger sets."""
    return F.sha2(F.to_json(F.struct(*sorted(c for c in events.columns if c not in ("tx_id", "block_number"))), {"ignoreNullFields": "false"}), 256)


def _event(rows: DataFrame, prefix: str, event_type: Column | str, asset: str, **more: Column) -> DataFrame:
    """Events of rows (ts_micros and what the columns name); ids are prefix, asset and the time in seconds."""
    kind = F.lit(event_type) if isinstance(event_type, str) else event_type
    given = {"event_type": kind, "asset_id": F.col(asset).cast("string"), "ts_micros": F.col("ts_micros")} | more
    given["event_id"] = F.concat_ws("-", F.lit(f"EVT-{prefix}"), F.col(asset).cast("string"), F.floor(F.col("ts_micros") / 1_000_000).cast("string"))
    return rows.select(*(given.get(c, F.lit(None).cast("string")).alias(c) for c in EVENT))


def _metadata(*names: str) -> Column:
    return F.to_json(F.struct(*sorted(names)), {"ignoreNullFields": "false"})


def contributor_registered(rows: DataFrame) -> DataFrame:
    """rows: contributor_id, org, ts_micros."""
    return _event(rows, "CONTRIB", "CONTRIBUTOR_REGISTERED", "contributor_id", contributor_id=F.col("contributor_id").cast("string"), metadata=_metadata("org"))


def dataset_registered(rows: DataFrame) -> DataFrame:
    """rows: dataset_id, version, manifest_hash, contributor_id, sample_count, ts_micros."""
    return _event(rows, "DATASET", "DATASET_REGISTERED", "dataset_id", contributor_id=F.col("contributor_id").cast("string"), hash=F.lower("manifest_hash"), metadata=_metadata("version", "sample_count"))


def model_registered(rows: DataFrame) -> DataFrame:
    """rows: model_id, version, model_digest, ts_micros."""
    return _event(rows, "MODEL", "MODEL_REGISTERED", "model_id", hash=F.lower(F.trim("model_digest")), metadata=_metadata("version"))


def model_verified(rows: DataFrame) -> DataFrame:
    """rows: model_id, version, trusted_digest, current_digest, ts_micros; a missing or other digest is tampering."""
    match = F.coalesce(F.lower(F.trim("current_digest")) == F.lower(F.trim("trusted_digest")), F.lit(False))
    pick = lambda yes, no: F.when(match, yes).otherwise(no)
    return _event(rows, "MODVER", pick("MODEL_VERIFIED", "MODEL_TAMPER_DETECTED"), "model_id", hash=F.lower(F.trim("current_digest")), severity=pick("INFO", "CRITICAL"), disposition=pick("ACCEPT", "QUARANTINE"), metadata=_metadata("version"))


def risk_recorded(rows: DataFrame) -> DataFrame:
    """rows: contributor_id, risk_score, risk_level, dominant_factor, disposition, ts_micros."""
    kind = F.when(F.col("disposition") == "QUARANTINE", "QUARANTINE_RECORDED").otherwise("CONTRIBUTOR_RISK_RECORDED")
    severity = F.when(F.col("risk_level").isin("CRITICAL", "HIGH"), F.col("risk_level")).otherwise("MEDIUM")
    return _event(rows, "RISK", kind, "contributor_id", contributor_id=F.col("contributor_id").cast("string"), severity=severity, disposition=F.col("disposition"), metadata=_metadata("risk_level", "dominant_factor"))


def inference_recorded(rows: DataFrame) -> DataFrame:
    """rows: record_id, binding_hash, nonce, sequence, ts_micros; the id has no time, so that a record is found by it."""
    made = _event(rows, "INF", "INFERENCE_RECORDED", "record_id", hash=F.lower("binding_hash"), metadata=_metadata("nonce", "sequence"))
    return made.withColumn("event_id", F.concat(F.lit("EVT-INF-"), F.col("asset_id")))


def report_anchored(rows: DataFrame) -> DataFrame:
    """rows: report_id, report_hash, disposition, ts_micros."""
    return _event(rows, "REPORT", "REPORT_ANCHORED", "report_id", hash=F.lower("report_hash"), disposition=F.col("disposition"))


def audit_head_anchored(rows: DataFrame) -> DataFrame:
    """rows: chain_id, head_hash, chain_length, ts_micros."""
    return _event(rows, "AUDIT", "AUDIT_HEAD_ANCHORED", "chain_id", hash=F.lower("head_hash"), metadata=_metadata("chain_length"))


def latest_state(events: DataFrame) -> DataFrame:
    """Of each asset and event type the newest event, as a registry shows it; of equal times the largest id."""
    newest = F.max_by(F.struct(*(c for c in EVENT if c not in ("asset_id", "event_type"))), F.struct("ts_micros", "event_id"))
    return events.groupBy("asset_id", "event_type").agg(newest.alias("_e")).select("asset_id", "event_type", "_e.*")


def point_get(events: DataFrame, requests: DataFrame) -> DataFrame:
    """For each request (event_id) whether the ledger has it, and the event's type and hash (the newest of its id)."""
    found = events.groupBy("event_id").agg(F.max_by(F.struct("event_type", "hash"), "ts_micros").alias("_e"))
    return requests.join(found, "event_id", "left").select("event_id", F.col("_e").isNotNull().alias("found"), "_e.event_type", "_e.hash")


def export_chain(chain: DataFrame, key: str) -> DataFrame:
    """key, position and the event as JSON that needs nothing but itself to be verified."""
    return chain.select(key, "position", F.to_json(F.struct("event_hash", "payload", "position", "prev_hash"), {"ignoreNullFields": "false"}).alias("event"))
