"""Queries of the data detectors over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions import columns as C
from attestry.operators import duplicates, evaluation, governance, labels, outliers, risk, shift, triggers
from attestry.sources.tables import samples, table, vectors

QUERIES = {}
ORACLES = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""
WITH h AS (SELECT doc_id, source, sha256(coalesce(text, '')) AS content_hash FROM documents),
g AS (SELECT content_hash, min(doc_id) AS group_id, count(*) AS group_size, count(DISTINCT coalesce(source, '')) AS n_contributors FROM h GROUP BY 1 HAVING count(*) > 1)
SELECT doc_id AS sample_id, source AS contributor, content_hash, group_id, group_size, n_contributors FROM h JOIN g USING (content_hash)
""")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.exact_groups(samples(spark, sf_dir))


@query("""
WITH c AS (SELECT sha256(coalesce(text, '')) AS h, source, count(*) AS n FROM documents GROUP BY 1, 2),
g AS (SELECT h, sum(n) AS n, sum(CASE WHEN source IS NOT NULL THEN n * (n - 1) // 2 ELSE 0 END) AS same FROM c GROUP BY h)
SELECT CAST(sum(n) AS BIGINT) AS total_samples, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS exact_pairs, CAST(sum(n * (n - 1) // 2) - sum(same) AS BIGINT) AS cross_contributor_pairs,
  CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS flagged_samples, round(sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n), 4) AS flooding_risk FROM g
""")
def exact_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.exact_summary(samples(spark, sf_dir))


@query(r"""
WITH t AS (SELECT doc_id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9\x{80}-\x{10FFFF}]+'), lambda x: x <> ''))) AS tokens FROM documents),
s AS (SELECT tokens, min(doc_id) AS id, len(tokens) AS n FROM t WHERE len(tokens) > 0 GROUP BY tokens),
e AS (SELECT id, n, unnest(tokens) AS token FROM s),
o AS (SELECT a.id AS a_id, b.id AS b_id, a.n AS an, b.n AS bn, count(*) AS k FROM e a JOIN e b ON a.token = b.token AND a.id < b.id AND least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) - 1e-9 GROUP BY ALL)
SELECT a_id, b_id, round(k / (an + bn - k), 6) AS similarity FROM o WHERE round(k / (an + bn - k), 6) >= 0.8
""")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.near_pairs(samples(spark, sf_dir))


_BITS = """
v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings),
m AS (SELECT id, x, (list_sort(x)[32] + list_sort(x)[33]) / 2 AS med FROM v),
h AS (SELECT id, x, list_transform(x, lambda e: CASE WHEN e > med THEN 1 ELSE 0 END) AS p, list_transform(range(1, 64), lambda i: CASE WHEN x[i + 1] > x[i] THEN 1 ELSE 0 END) AS d FROM m)
"""


@query(
    "WITH "
    + _BITS
    + """,
q AS (SELECT a.id AS a_id, b.id AS b_id, a.x AS ax, b.x AS bx, list_sum(list_transform(list_zip(a.p, b.p), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) AS pd,
  list_sum(list_transform(list_zip(a.d, b.d), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) AS dd FROM h a JOIN h b ON a.id < b.id),
k AS (SELECT *, list_avg(ax) AS ma, list_avg(bx) AS mb, list_dot_product(ax, ax) / 64 - list_avg(ax) ** 2 AS va, list_dot_product(bx, bx) / 64 - list_avg(bx) ** 2 AS vb, list_dot_product(ax, bx) / 64 - list_avg(ax) * list_avg(bx) AS cov,
  list_avg(list_transform(list_zip(ax, bx), lambda z: abs(z[1] - z[2]))) / 2 AS e FROM q WHERE pd <= 20 AND dd <= 22),
s AS (SELECT *, ((2 * ma * mb + 0.0004) * (2 * cov + 0.0036)) / ((ma * ma + mb * mb + 0.0004) * (va + vb + 0.0036) + 1e-7) AS ssim FROM k)
SELECT a_id, b_id, CAST(pd AS INT) AS mean_distance, CAST(dd AS INT) AS difference_distance, round(ssim, 4) AS ssim, round(e, 4) AS mae, round(0.7 * ssim + 0.3 * (1 - e), 4) AS similarity FROM s
"""
)
def bit_hash_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.bit_hash_pairs(vectors(spark, sf_dir), 20)


@query("""
WITH o AS (SELECT source AS contributor, sha256(coalesce(text, '')) AS h, count(*) AS n FROM documents GROUP BY 1, 2),
c AS (SELECT contributor, CAST(sum(n) AS BIGINT) AS total_samples, CAST(sum(CASE WHEN n > 1 AND contributor IS NOT NULL THEN n ELSE 0 END) AS BIGINT) AS duplicate_samples, max(CASE WHEN contributor IS NOT NULL THEN n ELSE 1 END) AS largest_group FROM o GROUP BY 1)
SELECT *, round(duplicate_samples / total_samples, 4) AS duplicate_ratio, round(duplicate_samples / total_samples, 4) >= 0.2 AND duplicate_samples >= 2 AS is_flooding FROM c
""")
def contributor_flooding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.contributor_flooding(samples(spark, sf_dir))


@query("""
WITH h AS (SELECT doc_id, source, sha256(coalesce(text, '')) AS h FROM documents),
g AS (SELECT h, min(doc_id) AS group_id FROM h GROUP BY h HAVING count(*) > 1 AND (count(DISTINCT coalesce(source, '')) > 1 OR count(*) > count(source)))
SELECT doc_id AS sample_id, source AS contributor, group_id FROM h JOIN g USING (h)
""")
def cross_contributor_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.cross_contributor_samples(samples(spark, sf_dir))


_KNN = """
v AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings),
n AS (SELECT id, label, x, list_transform(x, lambda e: e / sqrt(list_dot_product(x, x))) AS u FROM v),
p AS (SELECT a.id, b.id AS nid, b.label AS nl, round(1 - list_dot_product(a.u, b.u), 6) AS d FROM n a JOIN n b ON a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, nid) AS k FROM p QUALIFY k <= 5),
w AS (SELECT id, nl, count(*) AS c, min(k) AS f FROM r GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c DESC, f) AS j, sum(c) OVER (PARTITION BY id) AS t FROM w),
s AS (SELECT b.id AS sample_id, label, nl AS suggested_label, round(c / t, 4) AS consensus FROM b JOIN v ON b.id = v.id WHERE j = 1)
"""
_CENTRE = """
pl AS (SELECT label, i, avg(e) AS m, count(*) AS n FROM (SELECT label, unnest(range(1, 65)) AS i, unnest(x) AS e FROM v) GROUP BY 1, 2),
ce AS (SELECT label, list(m ORDER BY i) AS m, max(n) AS n FROM pl GROUP BY 1),
cn AS (SELECT label, n, list_transform(m, lambda e: e / (sqrt(list_dot_product(m, m)) + 1e-7)) AS c FROM ce)
"""
_MARGIN = """
g AS (SELECT s.sample_id, s.label, suggested_label, consensus, a.n AS gn, b.n AS sn, list_distance(v.x, a.c) AS da, list_distance(v.x, b.c) AS db FROM s JOIN v ON s.sample_id = v.id JOIN cn a ON a.label = s.label JOIN cn b ON b.label = suggested_label),
mg AS (SELECT sample_id, label, suggested_label, consensus, gn AS given_count, sn AS suggested_count, round(da, 4) AS given_distance, round(db, 4) AS suggested_distance, round(da - db, 4) + 0.0 AS margin FROM g)
"""
_FLAGGED = """
fl AS (SELECT sample_id, label, suggested_label, consensus, margin, CASE WHEN consensus >= 0.8 AND margin >= 0.05 THEN 'HIGH' WHEN consensus >= 0.6 OR margin >= 0.02 THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
  round(0.7 * consensus + 0.3 * least(1.0, greatest(0.0, 5 * margin)), 4) AS score FROM mg WHERE label <> suggested_label AND given_count >= 5 AND suggested_count >= 5 AND (consensus >= 0.8 OR (consensus >= 0.6 AND margin >= 0.05)))
"""


@query(f"WITH {_KNN} SELECT * FROM s")
def knn_label_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.consensus(vectors(spark, sf_dir))


@query(f"WITH {_KNN}, {_CENTRE}, {_MARGIN} SELECT * FROM mg")
def centroid_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return labels.margins(v, labels.consensus(v))


@query(f"WITH {_KNN}, {_CENTRE}, {_MARGIN}, {_FLAGGED} SELECT * FROM fl")
def mislabelled_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.mislabelled(vectors(spark, sf_dir))


@query(
    f"""WITH {_KNN}, {_CENTRE}, {_MARGIN}, {_FLAGGED},
t AS (SELECT id % 5 AS contributor, count(*) AS total_samples FROM v GROUP BY 1),
pr AS (SELECT sample_id % 5 AS contributor, label, suggested_label, count(*) AS n FROM fl GROUP BY ALL),
tp AS (SELECT *, sum(n) OVER (PARTITION BY contributor) AS f, row_number() OVER (PARTITION BY contributor ORDER BY n DESC, label, suggested_label) AS k FROM pr)
SELECT t.contributor, total_samples, CAST(coalesce(f, 0) AS BIGINT) AS flagged, round(coalesce(f, 0) / total_samples, 4) AS mislabel_rate, label AS top_given, suggested_label AS top_suggested, n AS top_count,
  coalesce(n >= 3 AND n / f >= 0.45, false) AS is_systematic FROM t LEFT JOIN tp ON t.contributor = tp.contributor AND k = 1"""
)
def confusion_systematic(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    flagged = labels.mislabelled(v).select((F.col("sample_id") % 5).alias("contributor"), "label", "suggested_label")
    return labels.systematic_confusion(flagged, v.groupBy((F.col("sample_id") % 5).alias("contributor")).agg(F.count("*").alias("total_samples")))


_OOD = f"""v AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings), {_CENTRE},
sc AS (SELECT v.id AS sample_id, round(list_distance(v.x, c), 6) AS score FROM v JOIN cn USING (label)),
nm AS (SELECT sample_id, score, round(CASE WHEN max(score) OVER () > min(score) OVER () THEN (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) ELSE 0.0 END, 4) AS norm_score FROM sc)
"""


def _centroid_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return v.join(F.broadcast(labels.centroids(v)), "label").select("sample_id", F.round(C.euclidean(F.col("vector"), F.col("centroid")), 6).alias("score"))


@query(f"WITH {_OOD} SELECT *, norm_score >= 0.7 AS is_ood FROM nm")
def ood_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.min_max_scores(_centroid_distance(spark, sf_dir))


@query(f"WITH {_OOD} SELECT count(*) AS total_samples, count_if(norm_score >= 0.7) AS ood_samples, round(count_if(norm_score >= 0.7) / count(*), 4) AS ood_ratio FROM nm")
def ood_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.ratio(outliers.min_max_scores(_centroid_distance(spark, sf_dir)))


@query(None)
def ood_isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.isolation_forest(vectors(spark, sf_dir))


def _grid_sql() -> str:
    """The trigger cascade's expressions over x, a list of 64 numbers."""
    import math

    at = lambda r, c: f"x[{r * 8 + c + 1}]"
    size, parts = 3, []
    for name, (r0, c0) in {"top_left": (0, 0), "top_right": (0, 5), "bottom_left": (5, 0), "bottom_right": (5, 5)}.items():
        cells = ", ".join(at(r, c) for r in range(r0, r0 + size) for c in range(c0, c0 + size))
        lap = ", ".join(f"{at(r - 1, c)} + {at(r + 1, c)} + {at(r, c - 1)} + {at(r, c + 1)} - 4 * {at(r, c)}" for r in range(max(1, r0), min(7, r0 + size)) for c in range(max(1, c0), min(7, c0 + size)))
        parts.append(f"SELECT id, '{name}' AS corner, list_var_pop([{lap}]) AS lv, list_stddev_pop([{cells}]) AS sp FROM v")
    diagonal = ", ".join([f"abs({at(i, i)})" for i in range(8)] + [f"abs({at(i, 7 - i)})" for i in range(8)])
    power = []
    for u in range(5):
        for w in range(8):
            if (u, w) != (0, 0):
                a = [2 * math.pi * (u * r + w * c) / 8 for r in range(8) for c in range(8)]
                re = ", ".join(f"{math.cos(t)!r}::DOUBLE" for t in a)
                im = ", ".join(f"{math.sin(t)!r}::DOUBLE" for t in a)
                power.append(f"20 * ln(sqrt(list_dot_product(x, [{re}]) ** 2 + list_dot_product(x, [{im}]) ** 2) + 1e-7)")
    return f"""v AS (SELECT vec_id AS id, label, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS x FROM embeddings),
co AS ({" UNION ALL ".join(parts)}),
cb AS (SELECT id, max(CASE WHEN lv > 0.25 AND sp > 0.1 THEN round(least(1.0, 0.5 + lv), 4) ELSE 0.0 END) AS corner_confidence FROM co GROUP BY id),
pw AS (SELECT id, [{", ".join(power)}] AS p FROM v),
pz AS (SELECT id, round((list_max(p) - list_avg(p)) / (list_stddev_pop(p) + 1e-7), 4) AS peak_z FROM pw),
al AS (SELECT v.id AS sample_id, label, corner_confidence, round(list_avg([{diagonal}]) / (list_avg(list_transform(x, lambda e: abs(e))) + 1e-7), 4) AS blended_ratio, peak_z FROM v JOIN cb USING (id) JOIN pz USING (id)),
ca AS (SELECT *, CASE WHEN corner_confidence >= 0.65 THEN 'corner' WHEN blended_ratio > 1.65 THEN 'blended' WHEN peak_z > 2.5 THEN 'spectral' ELSE 'none' END AS family,
  round(CASE WHEN corner_confidence >= 0.65 THEN corner_confidence WHEN blended_ratio > 1.65 THEN least(1.0, 0.70 + 0.25 * least(1.0, blended_ratio / 2.8)) WHEN peak_z > 2.5 THEN least(1.0, 0.65 + peak_z / 8) ELSE 0.0 END, 4) AS confidence FROM al)"""


_GRID = _grid_sql()


@query(f"WITH {_GRID} SELECT * FROM ca")
def trigger_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triggers.cascade(vectors(spark, sf_dir))


@query(f"WITH {_GRID} SELECT family, count(*) AS samples, round(avg(confidence), 4) AS mean_confidence, round(count(*) / (SELECT count(*) FROM ca), 4) AS share FROM ca GROUP BY family")
def trigger_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triggers.family_breakdown(triggers.cascade(vectors(spark, sf_dir)))


@query(f"WITH {_GRID} SELECT id AS sample_id, peak_z, round((peak_z - avg(peak_z) OVER ()) / (stddev_pop(peak_z) OVER () + 1e-7), 4) AS z FROM pz")
def spectral_population_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triggers.population_z(triggers.peak_z(vectors(spark, sf_dir)), "peak_z")


def risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contributors are the documents' sources in each language; low quality stands for a flagged label, toxicity for a trigger, extreme length for a stranger."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), F.concat_ws("/", "source", "lang").alias("contributor"), "text", "n_chars")
    lab = table(spark, sf_dir, "labels")
    flagged = lab.filter("quality = 0").select(F.col("doc_id").alias("sample_id"), F.when(F.col("doc_id") % 3 == 0, "HIGH").when(F.col("doc_id") % 3 == 1, "MEDIUM").otherwise("LOW").alias("confidence"))
    poisoned = lab.filter("toxic = 1").select(F.col("doc_id").alias("sample_id"), (0.65 + (F.col("doc_id") % 10) / 100.0).alias("confidence"))
    strange = outliers.min_max_scores(docs.select("sample_id", F.col("n_chars").cast("double").alias("score"))).filter("is_ood")
    return risk.risk(risk.contributor_evidence(docs, duplicates.contributor_flooding(docs), flagged, strange, poisoned))


RISK_SQL = """
d AS (SELECT doc_id, source || '/' || lang AS contributor, sha256(coalesce(text, '')) AS h, n_chars FROM documents),
fo AS (SELECT contributor, sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS dup, sum(n) AS t FROM (SELECT contributor, h, count(*) AS n FROM d GROUP BY 1, 2) GROUP BY 1),
mm AS (SELECT min(n_chars) AS lo, max(n_chars) AS hi FROM d),
ev AS (SELECT contributor, count(*) AS total_samples, count(CASE WHEN quality = 0 THEN 1 END) AS lc, coalesce(sum(CASE WHEN quality = 0 THEN CASE d.doc_id % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END END), 0) AS lw,
  count(CASE WHEN round((n_chars - lo) / (hi - lo), 4) >= 0.7 THEN 1 END) AS oc, count(CASE WHEN toxic = 1 THEN 1 END) AS tc, coalesce(sum(CASE WHEN toxic = 1 THEN 0.65::DOUBLE + (d.doc_id % 10) / 100.0::DOUBLE END), 0) AS tw,
  coalesce(max(CASE WHEN toxic = 1 THEN 0.65::DOUBLE + (d.doc_id % 10) / 100.0::DOUBLE END), 0) AS tb,
  count(CASE WHEN quality = 0 OR toxic = 1 OR round((n_chars - lo) / (hi - lo), 4) >= 0.7 THEN 1 END) AS fc
  FROM d CROSS JOIN mm LEFT JOIN labels USING (doc_id) GROUP BY 1),
ra AS (SELECT ev.*, dup, dup / total_samples AS sh FROM ev JOIN fo USING (contributor)),
rb AS (SELECT *, (sh >= 0.2 AND dup >= 2) OR (round(sh, 4) >= 0.2 AND dup >= 2) AS fl, round(sh, 4) >= 0.2 AND dup >= 2 AS isf FROM ra),
rc AS (SELECT *, round(CASE WHEN fl THEN least(1.0, 2 * sh) ELSE least(0.3, sh) END, 4) AS duplicate_evidence, round(least(1.0, 2.5 * lw / total_samples), 4) AS label_evidence,
  round(least(1.0, 1.5 * oc / total_samples), 4) AS ood_evidence, round(least(1.0, 4 * tw / total_samples), 4) AS trigger_evidence FROM rb),
rd AS (SELECT *, 0.4 * trigger_evidence + 0.3 * label_evidence + 0.2 * duplicate_evidence + 0.1 * ood_evidence AS raw FROM rc),
re AS (SELECT *, round(least(1.0, greatest(0.0, CASE WHEN tb >= 0.75 THEN greatest(raw, 0.6) WHEN fc / total_samples >= 0.4 AND (duplicate_evidence >= 0.5 OR label_evidence >= 0.5) THEN greatest(raw, 0.35) ELSE raw END)) + 1e-9, 4) AS risk_score FROM rd),
ri AS (SELECT contributor, total_samples, duplicate_evidence, label_evidence, ood_evidence, trigger_evidence, risk_score,
  CASE WHEN risk_score >= 0.5 OR tc >= 2 THEN 'CRITICAL' WHEN risk_score >= 0.28 OR (isf AND dup >= 3) THEN 'HIGH' WHEN risk_score >= 0.12 THEN 'MEDIUM' ELSE 'CLEAN' END AS risk_level,
  CASE WHEN greatest(trigger_evidence, label_evidence, duplicate_evidence, ood_evidence) <= 0 THEN 'None' WHEN trigger_evidence >= greatest(label_evidence, duplicate_evidence, ood_evidence) THEN 'Backdoor'
    WHEN label_evidence >= greatest(duplicate_evidence, ood_evidence) THEN 'Label' WHEN duplicate_evidence >= ood_evidence THEN 'Duplicate' ELSE 'OOD' END AS dominant_factor FROM re)
"""


@query(f"WITH {RISK_SQL} SELECT * FROM ri")
def contributor_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risks(spark, sf_dir)


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the detectors on documents and embeddings, and of every contributor that isn't clean."""
    dup = duplicates.exact_summary(samples(spark, sf_dir))
    ood = outliers.ratio(outliers.min_max_scores(_centroid_distance(spark, sf_dir)))
    return (
        governance.contributor_findings(risks(spark, sf_dir))
        .unionByName(governance.detector_findings("duplicates", dup, F.col("flooding_risk"), F.when(F.col("flooding_risk") >= 0.2, "HIGH").when(F.col("flooding_risk") > 0, "MEDIUM")))
        .unionByName(governance.detector_findings("ood", ood, F.col("ood_ratio"), F.when(F.col("ood_ratio") >= 0.15, "HIGH").when(F.col("ood_ratio") > 0, "MEDIUM")))
    )


_FINDINGS = (
    f"WITH {RISK_SQL}, {_OOD.replace('v AS', 'v AS', 1)}, "
    + """
du AS (SELECT round(sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n), 4) AS r FROM (SELECT count(*) AS n FROM documents GROUP BY sha256(coalesce(text, '')))),
oo AS (SELECT round(count_if(norm_score >= 0.7) / count(*), 4) AS r FROM nm),
fi AS (SELECT 'FND-CONTRIB-' || contributor AS finding_id, 'contributor_risk' AS kind, risk_level AS severity, round(risk_score, 4) AS evidence FROM ri WHERE risk_level <> 'CLEAN'
  UNION ALL SELECT 'FND-DUPLICATES', 'duplicates', CASE WHEN r >= 0.2 THEN 'HIGH' ELSE 'MEDIUM' END, r FROM du WHERE r > 0
  UNION ALL SELECT 'FND-OOD', 'ood', CASE WHEN r >= 0.15 THEN 'HIGH' ELSE 'MEDIUM' END, r FROM oo WHERE r > 0)
"""
)

HEALTH_SQL = """
hc AS (SELECT {key} severity, count(*) AS n, count_if(finding_id NOT LIKE 'FND-CONTRIB-%') AS own FROM fi GROUP BY ALL),
hp AS (SELECT *, CASE severity WHEN 'CRITICAL' THEN (CASE WHEN own >= 1 THEN 18 ELSE 0 END) + (CASE WHEN own >= 2 THEN 12 ELSE 0 END) + greatest(0, own - 2) * 6
  WHEN 'HIGH' THEN (CASE WHEN own >= 1 THEN 10 ELSE 0 END) + (CASE WHEN own >= 2 THEN 6 ELSE 0 END) + greatest(0, own - 2) * 3
  WHEN 'MEDIUM' THEN (CASE WHEN own >= 1 THEN 5 ELSE 0 END) + greatest(0, own - 1) * 3 WHEN 'LOW' THEN own * 2 ELSE 0 END AS pts FROM hc),
hr AS (SELECT {key} CAST(coalesce(sum(CASE WHEN severity = 'CRITICAL' THEN n END), 0) AS BIGINT) AS critical_count, CAST(coalesce(sum(CASE WHEN severity = 'HIGH' THEN n END), 0) AS BIGINT) AS high_count,
  CAST(coalesce(sum(CASE WHEN severity = 'MEDIUM' THEN n END), 0) AS BIGINT) AS medium_count, CAST(coalesce(sum(CASE WHEN severity = 'LOW' THEN n END), 0) AS BIGINT) AS low_count, round(greatest(0.0, 100.0 - coalesce(sum(pts), 0)), 1)::DOUBLE AS health_score FROM hp {group})
SELECT *, CASE WHEN critical_count > 0 OR health_score < 50 THEN 'QUARANTINE' WHEN high_count > 0 OR medium_count >= 2 OR health_score < 80 THEN 'REVIEW' ELSE 'ACCEPT' END AS disposition FROM hr
"""


@query(_FINDINGS + "SELECT * FROM fi")
def assurance_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir)


@query(_FINDINGS + ", " + HEALTH_SQL.format(key="", group=""))
def disposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: evidence by contributor, findings, health score and disposition."""
    return governance.health(findings(spark, sf_dir))


@query(
    "WITH fi AS (SELECT CAST(o_orderkey AS VARCHAR) AS finding_id, o_custkey AS g, CASE o_orderpriority WHEN '1-URGENT' THEN 'CRITICAL' WHEN '2-HIGH' THEN 'HIGH' WHEN '3-MEDIUM' THEN 'MEDIUM' WHEN '5-LOW' THEN 'LOW' ELSE 'INFO' END AS severity FROM orders), "
    + HEALTH_SQL.format(key="g,", group="GROUP BY g")
)
def health_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_orderpriority")
    severity = F.when(p == "1-URGENT", "CRITICAL").when(p == "2-HIGH", "HIGH").when(p == "3-MEDIUM", "MEDIUM").when(p == "5-LOW", "LOW").otherwise("INFO")
    return governance.health(table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("finding_id"), F.col("o_custkey").alias("g"), severity.alias("severity")), "g")


_METRICS = """
u AS (SELECT 'toxic' AS family, toxic = 1 AS a, n_chars < 1000 AS p FROM documents JOIN labels USING (doc_id) UNION ALL SELECT 'quality', quality = 0, n_chars < 1000 FROM documents JOIN labels USING (doc_id)),
n AS (SELECT family, count_if(a AND p) AS tp, count_if(NOT a AND p) AS fp, count_if(a AND NOT p) AS fn, count_if(NOT a AND NOT p) AS tn FROM u GROUP BY 1),
r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS pr, coalesce(tp / nullif(tp + fn, 0), 0) AS rc FROM n),
m AS (SELECT family, tp, fp, fn, tn, round(pr, 4) AS precision, round(rc, 4) AS recall, round(coalesce(2 * pr * rc / nullif(pr + rc, 0), 0), 4) AS f1, round(coalesce(tn / nullif(tn + fp, 0), 1), 4) AS specificity,
  round(coalesce(fp / nullif(fp + tn, 0), 0), 4) AS fpr, round(fn / nullif(tp + fn, 0), 4) AS fnr, round(tp / nullif(tp + fn, 0), 4) AS detection_rate, round(coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0), 4) AS accuracy FROM r)
"""


def _universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    short = F.col("n_chars") < 1000
    both = F.explode(F.array(F.struct(F.lit("toxic").alias("family"), (F.col("toxic") == 1).alias("actual"), short.alias("predicted")), F.struct(F.lit("quality").alias("family"), (F.col("quality") == 0).alias("actual"), short.alias("predicted"))))
    return rows.select(both.alias("u")).select("u.*")


@query(f"WITH {_METRICS} SELECT * FROM m")
def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.binary_metrics(_universe(spark, sf_dir), "family")


@query(f"WITH {_METRICS} SELECT count(*) AS families, round(avg(precision), 4) AS macro_precision, round(avg(recall), 4) AS macro_recall, round(avg(f1), 4) AS macro_f1 FROM m")
def macro_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.macro_metrics(evaluation.binary_metrics(_universe(spark, sf_dir), "family"))


@query(
    f"""WITH {RISK_SQL}, lb AS (SELECT source || '/' || lang AS contributor, avg(quality) < 0.85 AS bad FROM documents JOIN labels USING (doc_id) GROUP BY 1),
j AS (SELECT bad, coalesce(risk_level <> 'CLEAN', false) AS hit FROM lb LEFT JOIN ri USING (contributor))
SELECT count_if(bad) AS compromised, count_if(bad AND hit) AS compromised_flagged, count_if(NOT bad AND NOT hit) AS clean_kept, round(coalesce(count_if(NOT bad AND hit) / nullif(count_if(NOT bad), 0), 0), 4) AS clean_fpr,
  round(count_if(bad AND hit) / nullif(count_if(bad), 0), 4) AS detection_rate FROM j"""
)
def contributor_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    truth = rows.groupBy(F.concat_ws("/", "source", "lang").alias("contributor")).agg((F.avg("quality") < 0.85).alias("is_compromised"))
    return evaluation.contributor_evaluation(risks(spark, sf_dir), truth)


@query("SELECT count(value) AS n, round(quantile_cont(value, 0.99), 4) AS quantile, round(greatest(5.5, quantile_cont(value, 0.99) + 0.5), 4) AS threshold FROM events")
def calibration_p99(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.quantile_threshold(table(spark, sf_dir, "events"), "value")


@query("WITH " + _BITS + ", q AS (SELECT min(list_sum(list_transform(list_zip(a.p, b.p), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END))) AS d FROM h a JOIN h b ON a.id < b.id) SELECT CAST(d AS INT) AS least_distance, CAST(greatest(4, least(8, floor(d * 0.45))) AS INT) AS threshold FROM q")
def calibration_least_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.least_hash_distance(vectors(spark, sf_dir))


_SHIFT = """
x AS (SELECT 'value' AS dimension, event_type = 'purchase' AS t, value AS v FROM events WHERE event_type IN ('view', 'purchase')
  UNION ALL SELECT 'total', o_orderkey % 2 = 1, o_totalprice FROM orders UNION ALL SELECT 'price', l_linenumber > 3, l_extendedprice FROM lineitem UNION ALL SELECT 'balance', c_custkey % 2 = 1, c_acctbal FROM customer),
c AS (SELECT dimension, v, count_if(NOT t) AS r, count_if(t) AS s FROM x WHERE v IS NOT NULL GROUP BY 1, 2),
k AS (SELECT dimension, v, sum(r) OVER w / sum(r) OVER a AS f, sum(s) OVER w / sum(s) OVER a AS g, lead(v) OVER w2 - v AS gap, sum(r) OVER a AS nr, sum(s) OVER a AS ns FROM c
  WINDOW w AS (PARTITION BY dimension ORDER BY v ROWS UNBOUNDED PRECEDING), w2 AS (PARTITION BY dimension ORDER BY v), a AS (PARTITION BY dimension)),
s AS (SELECT dimension, CAST(max(nr) AS BIGINT) AS nr, CAST(max(ns) AS BIGINT) AS ns, max(abs(f - g)) AS ks, coalesce(sum(abs(f - g) * gap), 0) AS w FROM k GROUP BY 1),
p AS (SELECT *, (sqrt(nr * ns / (nr + ns)) + 0.12 + 0.11 / sqrt(nr * ns / (nr + ns))) * ks AS z FROM s),
st AS (SELECT dimension, nr AS n_reference, ns AS n_target, round(ks, 6) AS ks_statistic, round(CASE WHEN z < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0, list_sum(list_transform(range(1, 21), lambda j: 2.0 * (-1) ** (j - 1) * exp(-2.0 * j * j * z * z))))) END, 6) AS p_value, round(w, 6) AS wasserstein FROM p)
"""


def _dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, orders, lines, customers = (table(spark, sf_dir, t) for t in ("events", "orders", "lineitem", "customer"))
    part = lambda df, name, target, value: df.select(F.lit(name).alias("dimension"), target.alias("is_target"), F.col(value).alias("value"))
    return (
        part(events.filter(F.col("event_type").isin("view", "purchase")), "value", F.col("event_type") == "purchase", "value")
        .unionByName(part(orders, "total", F.col("o_orderkey") % 2 == 1, "o_totalprice"))
        .unionByName(part(lines, "price", F.col("l_linenumber") > 3, "l_extendedprice"))
        .unionByName(part(customers, "balance", F.col("c_custkey") % 2 == 1, "c_acctbal"))
    )


@query(f"WITH {_SHIFT} SELECT * FROM st")
def ks_wasserstein(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shift.two_sample(_dimensions(spark, sf_dir))


@query(
    f"""WITH {_SHIFT}, b AS (SELECT *, p_value < 0.1 OR ks_statistic >= 0.25 OR wasserstein >= 1.5 AS sh, ks_statistic >= 0.35 OR wasserstein >= 3 AS sv FROM st),
r AS (SELECT count(*) AS d, count_if(sh) AS k, bool_or(sh AND dimension = 'value') AS sensor, bool_or(sv AND dimension = 'value') AS severe, bool_or(sh AND dimension = 'total') AS season, bool_or(sh AND dimension = 'balance') AS light, min(least(n_reference, n_target)) AS n FROM b)
SELECT d AS dimensions, k AS shifted_dimensions, CASE WHEN n < 5 OR k = 0 THEN 'NO_SHIFT' WHEN severe AND NOT season AND NOT light THEN 'SUSPICIOUS_MANIPULATION' WHEN sensor AND k = 1 THEN 'SUSPICIOUS_MANIPULATION' ELSE 'OPERATIONAL_DRIFT' END AS verdict,
  round(CASE WHEN n < 5 THEN 0.0 ELSE k / d END, 4) AS drift_score, round(least(1.0, n / 30.0), 4)::DOUBLE AS confidence, n < 5 AS insufficient FROM r"""
)
def shift_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shift.classify(shift.two_sample(_dimensions(spark, sf_dir)), "value", "total", "balance")


@query("""
WITH b AS (SELECT event_type, value, floor(greatest(0.0, least(9.0, (value - 5) / 95 * 10))) AS k FROM events WHERE value IS NOT NULL),
e AS (SELECT event_type, sum(n * n) / (sum(n) * sum(n)) AS q FROM (SELECT event_type, k, count(*) AS n FROM b GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS sd, avg(CASE WHEN value < 5 THEN 1.0 ELSE 0.0 END) AS l, avg(CASE WHEN value > 100 THEN 1.0 ELSE 0.0 END) AS h FROM b GROUP BY 1)
SELECT event_type, round(m, 2) AS mean_value, round(sd, 2) AS value_std, round(l, 4) AS low_share, round(h, 4) AS high_share, round(q, 4) AS histogram_energy, round(20 * log10(255 / (sd + 1e-5)), 2) AS psnr FROM s JOIN e USING (event_type)
""")
def environment_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shift.environment_features(table(spark, sf_dir, "events"), "event_type", "value", 5.0, 100.0)
