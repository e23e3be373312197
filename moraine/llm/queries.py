"""Registered queries of this subpackage, with their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.llm import clusters, leakage, mixing, neighbours, repetition, sketch, topn
from moraine.plans.engine_sql import chain
from moraine.session import materialize


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best current children of every parent."""
    return topn.top_children(_t(spark, sf_dir, "condensed_tree"), 5).select("parent", "child")


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = materialize(clusters.labelled_records(_t(spark, sf_dir, "prediction_data"), _t(spark, sf_dir, "cluster_map")), "records")
    return clusters.similarity_sets(points, dim=24, radius=1.0)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of the sets of three or more records within 1.0 of one another and of no others."""
    return _sets(spark, sf_dir).where("mutual").select("first_id", "id")


def p3_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every similarity set with its size and its three most typical records."""
    sets = _sets(spark, sf_dir).where("typical <= 3")
    one = sets.groupBy("first_id").agg(F.first("label").alias("label"), F.first("set_size").alias("set_size"), F.first("mutual").alias("mutual"), F.sort_array(F.collect_list(F.struct("typical", "id"))).alias("t"))
    return one.select("first_id", "label", "set_size", "mutual", F.col("t.id").alias("typical"))


def p3_typical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and typical records of the sets whose members are all within 1.0 of one another."""
    rows = p3_sets(spark, sf_dir).where("mutual")
    return rows.select("first_id", "label", "set_size", F.explode("typical").alias("id"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups whose 90th percentile is at least three times their median."""
    return sketch.long_tailed(_t(spark, sf_dir, "run_timings"), 3.0)


def p4_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median, 90th and 99th percentile of every group, within one per cent."""
    found = sketch.timing_percentiles(_t(spark, sf_dir, "run_timings"))
    return found.select("c0", "c1", "n", *[F.round(c, 9).alias(c) for c in ("p50", "p90", "p99")])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records of which one is among the other's five nearest."""
    return neighbours.neighbour_pairs(_t(spark, sf_dir, "prediction_data"))


def p5_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every record among those that the index visits first: at least nine tenths of the true ones."""
    found = neighbours.knn(materialize(neighbours.records(_t(spark, sf_dir, "prediction_data")), "records"), 24, 5, complete=False, recall=0.9)
    return found.select("id", "nbr", "dist", "rank")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with twelve consecutive words of an item."""
    found = leakage.leaks(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "eval_items"))
    return found.select("doc_id", "item_id").distinct()


def p6_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All exact passages, the best near one per document and item, short items as a whole, and where they stand."""
    return leakage.leaks(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "eval_items"), near=True)


#: Vocabulary file of a public byte-level tokenizer.
TOKENIZER = os.environ.get("MORAINE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents chosen for each mix and their copies."""
    return mixing.mix(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "mix_targets"), TOKENIZER)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares of each mix."""
    return mixing.mix(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "mix_targets"), TOKENIZER)[1]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of which at least three tenths of the words are repeated."""
    return repetition.repetition(_t(spark, sf_dir, "documents")).where("fails").select("doc_id")


def p8_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's share, and the verdict on its host."""
    rows = repetition.repetition(_t(spark, sf_dir, "documents"))
    return rows.withColumns({"share": F.round("share", 9), "host_rate": F.round("host_rate", 9)})


QUERIES = {f.__name__: f for f in (p2_found, p3_found, p3_sets, p3_typical, p4_found, p4_percentiles, p5_found, p5_approximate, p6_found, p6_leaks, p7_mix, p7_shares, p8_found, p8_hosts)}

_CURRENT = """
WITH cur AS (
  SELECT parent, child, lambda_val FROM condensed_tree WHERE parent IS NOT NULL AND child IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY parent, child ORDER BY loaded_at DESC NULLS LAST) = 1)
"""
_RUNS = """
WITH r AS (SELECT run_id, c0, c1, c2 FROM run_timings WHERE run_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY loaded_at DESC) = 1),
ok AS (SELECT * FROM r WHERE c2 > 0 AND NOT isnan(c2) AND NOT isinf(c2)),
k AS (SELECT c0, c1, c2, row_number() OVER w AS i, count(*) OVER (PARTITION BY c0, c1) AS n FROM ok WINDOW w AS (PARTITION BY c0, c1 ORDER BY c2)),
s AS (SELECT c0, c1, any_value(n) AS n, min(c2) FILTER (i >= greatest(ceil(n * 0.5), 1)) AS v50, min(c2) FILTER (i >= greatest(ceil(n * 0.9), 1)) AS v90, min(c2) FILTER (i >= greatest(ceil(n * 0.99), 1)) AS v99 FROM k GROUP BY c0, c1),
q AS (SELECT c0, c1, any_value(n) AS n, min(c2) FILTER (i >= greatest(ceil(n * 0.5), 1)) AS p50, min(c2) FILTER (i >= greatest(ceil(n * 0.9), 1)) AS p90 FROM k GROUP BY c0, c1)
"""
_VALID = """
WITH v AS (SELECT id, raw_data, cluster_node FROM (SELECT * FROM prediction_data WHERE id IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC NULLS LAST) = 1)
  WHERE len(raw_data) = 24 AND len(list_filter(raw_data, lambda x: x IS NOT NULL AND NOT isnan(x) AND NOT isinf(x))) = 24),
"""
_WORDS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(nfc_normalize(text)), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
"""
ORACLES = {
    "p2_found": _CURRENT
    + """SELECT parent, child FROM cur WHERE lambda_val IS NOT NULL AND NOT isnan(lambda_val)
QUALIFY row_number() OVER (PARTITION BY parent ORDER BY lambda_val DESC, child) <= 5""",
    "p3_found": _VALID
    + """m AS (SELECT cluster_node, min(label) AS label FROM cluster_map WHERE label IS NOT NULL GROUP BY cluster_node),
r AS (SELECT v.id, v.raw_data, m.label FROM v JOIN m USING (cluster_node)),
n AS (SELECT a.id, list_sort(list(b.id)) AS near FROM r a JOIN r b ON a.label = b.label AND list_distance(a.raw_data, b.raw_data) <= 1.0 GROUP BY a.id),
s AS (SELECT near FROM n GROUP BY near HAVING count(*) = len(near) AND len(near) >= 3)
SELECT near[1] AS first_id, unnest(near) AS id FROM s""",
    # Within each mutual set, equal vectors as one node: spanning tree of the reachability by the second nearest, condensed, the longest-lived first.
    "p3_typical": "WITH RECURSIVE"
    + _VALID.replace("WITH", "", 1)
    + """m AS (SELECT cluster_node, min(label) AS label FROM cluster_map WHERE label IS NOT NULL GROUP BY cluster_node),
r AS MATERIALIZED (SELECT v.id, v.raw_data, m.label FROM v JOIN m USING (cluster_node)),
e AS MATERIALIZED (SELECT a.id AS a, b.id AS b, list_distance(a.raw_data, b.raw_data) AS d FROM r a JOIN r b ON a.label = b.label AND list_distance(a.raw_data, b.raw_data) <= 1.0),
s AS (SELECT near FROM (SELECT a, list_sort(list(b)) AS near FROM e GROUP BY a) GROUP BY near HAVING count(*) = len(near) AND len(near) >= 3),
member AS MATERIALIZED (SELECT near[1] AS g, len(near) AS set_size, unnest(near) AS id FROM s),
rep AS MATERIALIZED (SELECT m.g, m.id, min(o.id) AS rep FROM member m JOIN e ON e.a = m.id AND e.d = 0 JOIN member o ON o.id = e.b GROUP BY ALL),
near2 AS MATERIALIZED (SELECT a, d AS core FROM e WHERE a <> b QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) = 2),
tpts AS MATERIALIZED (SELECT g, id, row_number() OVER (PARTITION BY g ORDER BY id) AS k FROM rep WHERE id = rep),
tpair AS (SELECT p.g, p.k AS i, q.k AS j, greatest(e.d, x.core, y.core) AS w FROM e JOIN tpts p ON p.id = e.a JOIN tpts q ON q.id = e.b JOIN near2 x ON x.a = e.a JOIN near2 y ON y.a = e.b WHERE p.g = q.g AND p.k < q.k),
"""
    + chain(mcs=3, p="t", upto="condensed")
    + """, level AS (SELECT p.g, p.id, coalesce(t.lam, 'inf'::DOUBLE) AS lam FROM tpts p LEFT JOIN tdrop t ON t.g = p.g AND t.x = p.k - 1)
SELECT r.g AS first_id, z.label, m.set_size, r.id FROM rep r JOIN member m ON m.id = r.id JOIN level l ON l.g = r.g AND l.id = r.rep JOIN r z ON z.id = r.id QUALIFY row_number() OVER (PARTITION BY r.g ORDER BY l.lam DESC, r.id) <= 3""",
    "p5_found": _VALID
    + """n AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.id <> b.id
  QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.raw_data, b.raw_data), b.id) <= 5)
SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM n""",
    "p4_found": _RUNS + "SELECT c0, c1 FROM q WHERE p90 >= 3 * p50",
    # The value of the bucket, of width (1 + 0.01) / (1 - 0.01), that holds the true percentile.
    "p4_percentiles": _RUNS + "SELECT c0, c1, n, " + ", ".join(f"round(pow(1.01 / 0.99, ceil(ln(v{p}) / ln(1.01 / 0.99))) * 2 / (1 + 1.01 / 0.99), 9) AS p{p}" for p in (50, 90, 99)) + " FROM s",
    "p6_found": _WORDS
    + r"""i AS (SELECT item_id, regexp_extract_all(lower(nfc_normalize(item_text)), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE item_text IS NOT NULL),
ds AS (SELECT doc_id, array_to_string(w[s : s + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS s FROM d)),
ist AS (SELECT item_id, array_to_string(w[s : s + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS s FROM i))
SELECT DISTINCT doc_id, item_id FROM ds JOIN ist USING (g)""",
    "p8_hosts": _WORDS
    + r"""g AS (SELECT doc_id, s, array_to_string(w[s : s + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS s FROM d)),
r AS (SELECT doc_id, s FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, count(DISTINCT s + k) AS n FROM r, range(8) t(k) GROUP BY doc_id),
m AS (SELECT o.doc_id, nullif(regexp_replace(lower(trim(o.source)), '[\s-]+', '_', 'g'), '') AS host, coalesce(len(d.w), 0) AS words, coalesce(c.n, 0) AS repeated, CASE WHEN len(d.w) > 0 THEN coalesce(c.n, 0) / len(d.w) ELSE 0.0 END AS share FROM documents o LEFT JOIN d USING (doc_id) LEFT JOIN c USING (doc_id)),
h AS (SELECT host, count(*) AS docs, count(*) FILTER (share >= 0.3) AS failures FROM m GROUP BY host),
a AS (SELECT sum(failures) / sum(docs) AS mean, sum(docs) AS docs, count(*) AS k, sum(docs * pow(failures / docs, 2)) / sum(docs) AS sq FROM h),
b AS (SELECT mean, sq - mean * mean - mean * (1 - mean) * k / docs AS between_ FROM a),
p AS (SELECT mean, CASE WHEN between_ > 0 THEN greatest(mean * (1 - mean) / between_ - 1, 0) END AS weight FROM b),
v AS (SELECT host, mean, CASE WHEN weight IS NULL THEN mean ELSE (failures + mean * weight) / (docs + weight) END AS rate FROM h, p)
SELECT doc_id, m.host, words, repeated, round(share, 9) AS share, share >= 0.3 AS fails, round(rate, 9) AS host_rate, rate >= 1.5 * mean AND rate > 0 AS host_fails FROM m JOIN v ON v.host IS NOT DISTINCT FROM m.host""",
    "p8_found": _WORDS
    + """g AS (SELECT doc_id, s, array_to_string(w[s : s + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS s FROM d)),
r AS (SELECT doc_id, s FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, count(DISTINCT s + k) AS n FROM r, range(8) t(k) GROUP BY doc_id)
SELECT doc_id FROM c JOIN d USING (doc_id) WHERE n >= 0.3 * len(w)""",
}
