import hashlib
import hmac
import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestry.functions import columns as C
from attestry.operators import duplicates, evaluation, generators, governance, labels, ledger, model, outliers, provenance, risk, shift


def test_binary_metrics_exact(spark):
    rows = [("a", True, True), ("b", True, False), ("c", False, True), ("d", False, False)]
    m = evaluation.binary_metrics(spark.createDataFrame(rows, "id string, actual boolean, predicted boolean")).first()
    assert (m.tp, m.fp, m.fn, m.tn, m.fnr, m.accuracy) == (1, 1, 1, 1, 0.5, 0.5)
    none = evaluation.binary_metrics(spark.createDataFrame([(False, False)], "actual boolean, predicted boolean")).first()
    assert none.fnr is None and none.detection_rate is None and none.specificity == 1.0
    empty = evaluation.binary_metrics(spark.createDataFrame([], "actual boolean, predicted boolean")).first()
    assert empty.accuracy == 0.0 and empty.specificity == 1.0


def test_three_identical_items(spark):
    s = spark.createDataFrame([(1, "A", "x"), (2, "A", "x"), (3, "B", "x"), (4, None, "y"), (5, None, "y")], "sample_id long, contributor string, text string")
    got = duplicates.exact_summary(s).first()
    assert (got.exact_pairs, got.cross_contributor_pairs, got.flagged_samples) == (4, 3, 5)
    flood = {r.contributor: r.is_flooding for r in duplicates.contributor_flooding(s).collect()}
    assert flood == {"A": True, "B": False, None: False}
    assert {r.sample_id for r in duplicates.cross_contributor_samples(s).collect()} == {1, 2, 3, 4, 5}


def test_near_pairs_against_all_pairs(spark):
    rng = random.Random(1)
    docs = []
    for i in range(60):
        base = rng.sample(range(80), 20) if i % 3 == 0 else list(base)  # noqa: F821
        if i % 3:
            base[rng.randrange(20)] = rng.randrange(80)
        docs.append((i, "s", " ".join(f"w{x}" for x in base)))
    got = {(r.a_id, r.b_id): r.similarity for r in duplicates.near_pairs(spark.createDataFrame(docs, "sample_id long, contributor string, text string")).collect()}
    sets, first = {}, {}
    for i, _, t in docs:
        first.setdefault(frozenset(t.split()), i)
    sets = {i: s for s, i in first.items()}
    want = {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    assert got == want and want


def _shuffled(spark):
    """Bytes of shuffle that the session's stages have written."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none, numbers = sc._jvm.java.util.ArrayList(), sc._gateway.new_array(sc._jvm.double, 0)
    stages = sc._jsc.sc().statusStore().stageList(none, False, False, numbers, none)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_near_pairs_deal_out_little_more_than_the_texts(spark):
    rng = random.Random(7)
    docs, want = [], set()
    for i in range(0, 1500, 3):
        base = [f"Word{int(4000 * rng.random() ** 3)}é" for _ in range(150)]
        near = [*base[:-1], f"new{i}"]
        far = base[:75] + [f"word{int(4000 * rng.random() ** 3)}é" for _ in range(75)]
        docs += [(i, "s", " ".join(base)), (i + 1, "s", " ".join(near)), (i + 2, "s", " ".join(far))]
        want.add((i, i + 1))
    docs += [(1500, "s", None), (1501, "s", " -- "), (1502, "s", "one"), (1503, "s", "ONE, one"), (1504, "s", "a b c d"), (1505, "s", "a b c d e"), (1506, "s", "x" * 20), (1507, "s", "x" * 21)]
    want.add((1504, 1505))
    before = _shuffled(spark)
    got = duplicates.near_pairs(spark.createDataFrame(docs, "sample_id long, contributor string, text string").repartition(4)).collect()
    assert {(r.a_id, r.b_id) for r in got} == want and {(r.a_id, r.b_id): r.similarity for r in got}[1504, 1505] == 0.8
    assert _shuffled(spark) - before < 2.5 * sum(len((t or "").encode()) for _, _, t in docs)


@pytest.mark.parametrize("bits", [3, 6])
def test_bit_hash_pairs_against_all_pairs(spark, bits):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, 64))
    rows = [(i, 0, (base[i % 6] + rng.normal(scale=0.03, size=64)).tolist()) for i in range(24)]
    v = spark.createDataFrame(rows, "sample_id long, label int, vector array<double>")

    def code(x):
        return [a > np.median(x) for a in x], [b > a for a, b in zip(x, x[1:])]

    codes = {i: code(x) for i, _, x in rows}
    dist = lambda k, a, b: sum(x != y for x, y in zip(codes[a][k], codes[b][k]))
    want = {(a, b) for a in codes for b in codes if a < b and dist(0, a, b) <= bits and dist(1, a, b) <= bits + 2}
    assert {(r.a_id, r.b_id) for r in duplicates.bit_hash_pairs(v, bits).collect()} == want


def test_bit_hash_pairs_compare_each_pair_once(spark, monkeypatch):
    rng = np.random.default_rng(11)
    base = rng.normal(size=64)
    rows = [(i, 0, rng.normal(size=64).tolist() if i % 2 else (base + rng.normal(scale=0.3, size=64)).tolist()) for i in range(300)]
    odd = [(300, 0, None), (301, 0, [1.0, None]), (302, 0, []), (303, 0, [1.0]), (304, 0, [float("nan"), *base[1:].tolist()]), (305, 0, base.tolist()), (None, 0, base.tolist())]
    v = spark.createDataFrame(rows + odd, "sample_id long, label int, vector array<double>")
    monkeypatch.setattr(duplicates, "TILE_ROWS", 100)
    monkeypatch.setattr(duplicates, "STRIP_PAIRS", 50)
    found = duplicates.bit_hash_pairs(v, 20)
    got = {(r.a_id, r.b_id): tuple(r)[2:] for r in found.collect()}
    x = v.filter("sample_id is not null and size(vector) > 0").select("sample_id", C.mean_hash(F.col("vector")).alias("p"), C.difference_hash(F.col("vector")).alias("d"), "vector").localCheckpoint()
    a, b = (x.select(*(F.col(c).alias(f"{s}_{c}") for c in x.columns)) for s in "ab")
    near = a.crossJoin(b).filter("a_sample_id < b_sample_id and bit_count(a_p ^ b_p) <= 20 and bit_count(a_d ^ b_d) <= 22")
    ssim, mae = C.ssim(F.col("a_vector"), F.col("b_vector")), C.mean_absolute_error(F.col("a_vector"), F.col("b_vector"))
    columns = [F.col("a_sample_id"), F.col("b_sample_id"), C.hamming(F.col("a_p"), F.col("b_p")), C.hamming(F.col("a_d"), F.col("b_d")), F.round(ssim, 4), F.round(mae, 4)]
    want = {(r[0], r[1]): tuple(r)[2:] for r in near.select(*columns).collect()}
    assert {k: repr(r[:4]) for k, r in got.items()} == {k: repr(r) for k, r in want.items()} and len(got) > 5000
    # no join of rows on slices of hashes, whose values are so few that each pair would meet again and again
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_neighbours_do_not_depend_on_tiles(spark):
    rng = np.random.default_rng(5)
    v = spark.createDataFrame([(i, i % 3, rng.normal(size=8).tolist()) for i in range(50)], "sample_id long, label int, vector array<double>")
    one, many = (sorted(map(tuple, labels.neighbours(v, 4, t).collect())) for t in (1000, 7))
    assert one == many and len(one) == 200
    copies = spark.createDataFrame([(i, i, [1.0, 0.0]) for i in range(4)], "sample_id long, label int, vector array<double>")
    assert all(r.sample_id != r.neighbour_id for r in labels.neighbours(copies, 3).collect())


def test_hmac_and_binding(spark):
    for key in (b"k", b"x" * 100):
        got = spark.createDataFrame([("messé",)], "m string").select(C.hmac_sha256(key, F.col("m"))).first()[0]
        assert got == hmac.new(key, "messé".encode(), hashlib.sha256).hexdigest()
    parts = ["AB", "cd", "EF", "ab", "5", "n"]
    row = spark.createDataFrame([(*parts, 7)], "a string, b string, c string, d string, e string, f string, g long")
    got = row.select(provenance.binding_hash(*(F.col(c) for c in "abcdefg"))).first()[0]
    assert got == hashlib.sha256(b"ab|cd|ef|ab|5|n|7").hexdigest()


def test_prediction_order_does_not_matter(spark):
    p = [([1.00001, 2.0], 0.5, 2, " b "), ([0.0], 0.9, 1, "a"), ([0.0], 0.95, 1, "a")]
    kind = "p array<struct<box:array<double>,confidence:double,category_id:int,category_name:string>>"
    a, b = (spark.createDataFrame([(q,)], kind).select(provenance.canonical_predictions(F.col("p"))).first()[0] for q in (p, p[::-1]))
    assert a == b and [x["confidence"] for x in json.loads(a)] == [0.95, 0.9, 0.5] and json.loads(a)[2]["category_name"] == "b"


def test_canonical_config(spark):
    got = [r[0] for r in spark.createDataFrame([('{"b": {"d": 1, "c": [2]}, "a": null}',), ("nope",), (None,)], "t string").select(provenance.canonical_config("t")).collect()]
    assert got == ['{"a":null,"b":{"c":[2],"d":1}}', "nope", None]


MUTATIONS = ["image_hash", "model_digest", "config_hash", "predictions_json", "ts_micros", "nonce", "sequence", "signature", "binding_hash"]


@pytest.mark.parametrize("field", MUTATIONS)
def test_one_changed_field_fails(spark, field):
    rows = spark.createDataFrame([("r1", "aa", "bb", "cc", "[]", 5, "n1", 1)], "record_id string, image_hash string, model_digest string, config_hash string, predictions_json string, ts_micros long, nonce string, sequence long")
    good = provenance.bind(rows, b"key")
    assert provenance.verify(good, b"key", good).first().passed
    other = F.col(field) + 1 if field in ("ts_micros", "sequence") else F.concat(F.col(field), F.lit("0"))
    bad = provenance.verify(good.withColumn(field, other), b"key", good).first()
    assert not bad.passed and field in bad.tampered_fields
    assert not provenance.verify(good, b"other").first().passed


def test_key_ladder(tmp_path, monkeypatch):
    monkeypatch.delenv(provenance.KEY_VARIABLE, raising=False)
    assert provenance.resolve_key() == provenance.DEMO_KEY and provenance.resolve_key("k") == b"k"
    (tmp_path / "key").write_bytes(b"filed\n")
    assert provenance.resolve_key(key_file=str(tmp_path / "key")) == b"filed"
    with pytest.raises(ValueError):
        provenance.resolve_key("k", str(tmp_path / "key"))
    (tmp_path / "empty").write_bytes(b"")
    with pytest.raises(ValueError):
        provenance.resolve_key(key_file=str(tmp_path / "empty"))


def test_registry_fold_and_replay(spark):
    rows = spark.createDataFrame([("a", i, s) for i, s in enumerate([1, 1, 2, 4, 3])], "key string, pos int, seq long")
    got = provenance.accepted_sequence(rows, "key", "seq", ["pos"]).first()
    assert (got.accepted, got.rejected, got.last_sequence) == (3, 2, 3)
    records = spark.createDataFrame([(1, "r1", "n1", "b1"), (2, "r1", "n2", "b2"), (3, "r2", "n1", "b3"), (4, "r3", "n3", "b1")], "pos int, record_id string, nonce string, binding_hash string")
    assert [r.reason for r in provenance.replay_reason(records, "pos").orderBy("pos").collect()] == [None, "record_id", "nonce", "binding_hash"]


def root(leaves):
    level = [x.lower() for x in leaves if x]
    while len(level) > 1:
        level = [hashlib.sha256(f"{level[i]}:{level[i + 1] if i + 1 < len(level) else level[i]}".encode()).hexdigest() for i in range(0, len(level), 2)]
    return level[0]


@pytest.mark.parametrize("n", [1, 2, 3, 8, 16, 13])
def test_merkle(spark, n):
    leaves = [hashlib.sha256(str(i).encode()).hexdigest().upper() for i in range(n)]
    rows = spark.createDataFrame([("b", i, x) for i, x in enumerate(leaves)] + [("b", 99, ""), ("c", 0, leaves[0])], "batch string, i long, leaf string")
    roots = {r.batch: r for r in ledger.merkle_roots(rows, "batch", "i", "leaf").collect()}
    assert roots["b"].root == root(leaves) and roots["b"].n_leaves == n
    levels = ledger.merkle_levels(rows, "batch", "i", "leaf")
    top = levels.filter("batch = 'b'").orderBy(F.desc("level")).first()
    assert top.hash == root(leaves) and top.i == 0
    proofs = ledger.merkle_proofs(levels, "batch").withColumn("found", ledger.proof_root(F.col("hash"), F.col("proof")))
    wrong = ledger.proof_root(F.sha2("hash", 256), F.col("proof"))
    for r in proofs.withColumn("wrong", wrong).filter("batch = 'b'").collect():
        assert r.found == root(leaves) and r.wrong != root(leaves)


def test_chain(spark):
    rows = spark.createDataFrame([("k", i, f"p{i}") for i in range(3)], "key string, i int, payload string")
    chain = ledger.build_chain(rows, "key", ["i"], "payload")
    assert ledger.verify_chain(chain, "key").first().valid
    for column, place, reason, at in [("payload", 0, "hash", 0), ("event_hash", 0, "hash", 0), ("position", 1, "index", 1), ("prev_hash", 2, "link", 2)]:
        bad = chain.withColumn(column, F.when(F.col("position") == place, F.col("position") + 7 if column == "position" else F.lit("x")).otherwise(F.col(column)))
        got = ledger.verify_chain(bad, "key").first()
        assert not got.valid and (got.reason, got.broken_index) == (reason, at) or column == "position"


def test_query_events(spark):
    e = spark.createDataFrame([(i, "a" if i % 2 else "b") for i in range(10)], "pos int, kind string")
    assert [r.pos for r in ledger.query_events(e, {"kind": "a", "pos": None}, "pos", 3).collect()] == [9, 7, 5]
    assert ledger.query_events(e, {"kind": "ALL"}, "pos", 3).count() == 3


def test_health(spark):
    rows = [("1", "CRITICAL"), ("2", "CRITICAL"), ("3", "CRITICAL"), ("4", "MEDIUM"), ("FND-CONTRIB-x", "HIGH"), ("5", "INFO")]
    got = governance.health(spark.createDataFrame(rows, "finding_id string, severity string")).first()
    assert (got.health_score, got.critical_count, got.high_count, got.disposition) == (59.0, 3, 1, "QUARANTINE")
    assert governance.health(spark.createDataFrame([], "finding_id string, severity string")).first().disposition == "ACCEPT"


def test_risk_of_a_clean_contributor(spark):
    s = spark.createDataFrame([(i, None if i == 9 else "A", f"t{i}") for i in range(10)], "sample_id long, contributor string, text string")
    none = spark.createDataFrame([], "sample_id long, confidence string")
    trig = spark.createDataFrame([(9, 0.8)], "sample_id long, confidence double")
    got = {r.contributor: r for r in risk.risk(risk.contributor_evidence(s, duplicates.contributor_flooding(s), none, none, trig)).collect()}
    assert got["A"].risk_level == "CLEAN" and got["A"].dominant_factor == "None"
    assert got[None].risk_level == "CRITICAL" and got[None].risk_score >= 0.6 and got[None].dominant_factor == "Backdoor"


def statistic(a, b):
    every = np.unique(np.concatenate([a, b]))
    f, g = (np.searchsorted(np.sort(x), every, "right") / len(x) for x in (a, b))
    return np.abs(f - g).max(), (np.abs(f - g)[:-1] * np.diff(every)).sum()


def test_two_sample(spark):
    rng = np.random.default_rng(2)
    a, b = np.round(rng.normal(0, 1, 300), 2), np.round(rng.normal(0.5, 2, 200), 2)
    rows = [("x", False, float(v)) for v in a] + [("x", True, float(v)) for v in b] + [("same", t, 5.0) for t in (True, False)] + [("x", True, None)]
    got = {r.dimension: r for r in shift.two_sample(spark.createDataFrame(rows, "dimension string, is_target boolean, value double")).collect()}
    ks, w = statistic(a, b)
    assert got["x"].ks_statistic == pytest.approx(ks, abs=1e-6) and got["x"].wasserstein == pytest.approx(w, abs=1e-6) and got["x"].p_value < 0.01
    assert got["same"].ks_statistic == 0 and got["same"].p_value == 1


STATS = "dimension string, n_reference long, n_target long, ks_statistic double, p_value double, wasserstein double"


@pytest.mark.parametrize(
    "rows,verdict,score",
    [
        ([("sensor", 10, 10, 0.0, 1.0, 0.0), ("season", 10, 10, 0.0, 1.0, 0.0)], "NO_SHIFT", 0.0),
        ([("sensor", 25, 25, 1.0, 0.0, 30.0), ("season", 25, 25, 0.0, 1.0, 0.0)], "SUSPICIOUS_MANIPULATION", 0.5),
        ([("light", 30, 30, 1.0, 0.0, 85.0), ("season", 30, 30, 1.0, 0.0, 30.0)], "OPERATIONAL_DRIFT", 1.0),
        ([], "NO_SHIFT", 0.0),
    ],
)
def test_shift_verdicts(spark, rows, verdict, score):
    got = shift.classify(spark.createDataFrame(rows, STATS), "sensor", "season", "light").first()
    assert got.verdict == verdict and got.drift_score == score


def test_isolation_forest_finds_strangers(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(0, 1, 6).tolist()) for i in range(300)] + [(1000 + i, rng.normal(9, 1, 6).tolist()) for i in range(5)]
    got = outliers.isolation_forest(spark.createDataFrame(rows, "sample_id long, vector array<double>"), contamination=0.05)
    assert {r.sample_id for r in got.orderBy(F.desc("score")).limit(5).collect()} == set(range(1000, 1005))
    assert got.filter("sample_id >= 1000 and is_ood").count() == 5


def test_generators_are_fixed_by_their_seed(spark):
    v = spark.createDataFrame([(i, i % 4, [float(i + k) / 50 for k in range(64)]) for i in range(20)], "sample_id long, label int, vector array<double>")
    for f in (generators.label_flip(4), generators.ood_insertion(), generators.corner_trigger(), generators.blended_trigger(), generators.spectral_trigger(), generators.near_duplicate(2)):
        assert v.transform(f).collect() == v.transform(f).collect()
    flipped = v.transform(generators.label_flip(4)).join(v.withColumnRenamed("label", "old"), "sample_id")
    assert flipped.filter("label = old or label < 0 or label > 3").count() == 0
    made = generators.inject(v, generators.ood_insertion(), "ood_insertion", 0.5)
    assert made.count() == 20 and 0 < made.filter("is_attacked").count() < 20
    assert made.filter("is_attacked <> (label = -1)").count() == 0
    for kind in ("illumination", "blur", "noise", "weather", "compression"):
        assert v.transform(generators.operational_shift(kind)).select(F.size("vector")).distinct().first()[0] == 64


def test_predictor_failures_cost_one_sample(spark):
    def predictor(batch):
        if (batch["sample_id"] == 3).any():
            raise ValueError("unreadable")
        return batch["sample_id"].map(lambda i: [float(i), 0.0])

    got = model.predict(spark.range(6).withColumnRenamed("id", "sample_id"), predictor)
    assert sorted(r.sample_id for r in got.collect()) == [0, 1, 2, 4, 5]


def test_model_digests(spark, tmp_path):
    (tmp_path / "m.safetensors").write_bytes(b"abc")
    (tmp_path / "x.bin").write_bytes(b"x")
    got = {r.path.rsplit("/")[-1]: r for r in model.artefact_digests(spark, str(tmp_path)).collect()}
    assert got["m.safetensors"].format == "pytorch_pt" and got["m.safetensors"].sha256 == hashlib.sha256(b"abc").hexdigest() and got["x.bin"].format is None


def test_leakage_and_split(spark):
    rows = spark.createDataFrame([("a", "x\\1.png"), ("b", "y/1.png"), ("c", "z/2.png"), ("a", "q/2.png"), ("b", "3.png")], "part string, path string")
    assert {(r.left_part, r.right_part, r.shared) for r in evaluation.leakage(rows, "part", "path").collect()} == {("a", "b", 1), ("a", "c", 1)}
    parts = evaluation.three_way_split(spark.range(2000), "id").groupBy("part").count().collect()
    assert len(parts) == 7 and all(100 < r["count"] < 600 for r in parts)
    sizes = [r["count"] for r in evaluation.exact_split(spark.range(10), "id").groupBy("part").count().collect()]
    assert sorted(sizes) == [2, 2, 3, 3]


def test_ranks_of_one_severity_come_from_many_tasks(spark):
    rows = [(str(i), "HIGH" if i % 3 else None, i) for i in range(2000)] + [("x", "HIGH", None)]
    ranked = governance.ranked_penalties(spark.createDataFrame(rows, "finding_id string, severity string, k long").repartition(7), "k")
    got = {r.finding_id: (r.rank, r.points) for r in ranked.collect()}
    assert len(got) == 2001 and [got[k] for k in ("x", "1", "2", "4")] == [(1, 10), (2, 6), (3, 3), (4, 3)]
    assert sorted(v[0] for v in got.values()) == sorted([*range(1, 1335), *range(1, 668)])
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("row_number() windowspecdefinition(") == len(re.findall(r"row_number\(\) windowspecdefinition\(severity#\d+, _slice#\d+", plan)) > 0
