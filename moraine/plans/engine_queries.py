"""Registered queries of the clustering engine, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.functions import scalar
from moraine.functions.metrics import Metric, distance_metric
from moraine.operators import neighbors as N
from moraine.operators import spanning as S
from moraine.operators import stored_tree as ST
from moraine.operators.forest import boruvka, connected_components
from moraine.operators.within_labels import label_gaps, reduce_pairs
from moraine.plans import engine_sql as E
from moraine.plans import exports, flat, inputs, validity
from moraine.plans.branches import BranchDetector
from moraine.plans.density import DensityClusterer, DensityModel
from moraine.plans.predict import Predictor, wide
from moraine.plans.robust import RobustLinkage
from moraine.session import materialize, scratch_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c: str | F.Column) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits, so that another engine's rounding shows no difference."""
    return df.select(*[r6(f.name).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in df.schema])


# -- SQL of the derived inputs -------------------------------------------------------------

_EMB = "emb64 AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings)"


def _blobs(name: str, amplitude: float) -> str:
    return f"{name} AS (SELECT vec_id AS id, label, [embedding[1]::DOUBLE + {amplitude} * cos(2 * pi() * label / 10.0), embedding[2]::DOUBLE + {amplitude} * sin(2 * pi() * label / 10.0)] AS x FROM embeddings)"


_B4, _B1 = _blobs("blobs", 4.0), _blobs("noisy", 1.0)
_CORE5 = """d AS (SELECT a.id AS i, b.id AS j, list_distance(a.x, b.x) AS d FROM {t} a JOIN {t} b ON a.id <> b.id),
core AS (SELECT i AS id, d AS core FROM d QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) = 5)"""

# -- metrics ---------------------------------------------------------------------------------

#: Query, metric, input, distance of a.x and b.x in SQL.
_V = [round(0.5 + (k % 7) / 10, 2) for k in range(64)]
_SUM = "list_sum(list_transform(range(1, len(a.x) + 1), lambda k: {}))"
_NEQ = "list_sum(list_transform(range(1, len(a.x) + 1), lambda k: ((a.x[k] <> 0) <> (b.x[k] <> 0))::INT))"
_NTT = "list_sum(list_transform(range(1, len(a.x) + 1), lambda k: ((a.x[k] <> 0) AND (b.x[k] <> 0))::INT))"
_DOT, _NN = "list_dot_product(a.x, b.x)", "(list_dot_product(a.x, a.x) * list_dot_product(b.x, b.x))"
_VSQL = "[" + ", ".join(f"{v}::DOUBLE" for v in _V) + "]"
_METRICS = {
    "euclidean": ({}, "emb64", "list_distance(a.x, b.x)"),
    "seuclidean": ({"V": _V}, "emb64", f"sqrt({_SUM.format(f'(a.x[k] - b.x[k]) ** 2 / {_VSQL}[k]')})"),
    "manhattan": ({}, "emb64", _SUM.format("abs(a.x[k] - b.x[k])")),
    "chebyshev": ({}, "emb64", "list_max(list_transform(range(1, len(a.x) + 1), lambda k: abs(a.x[k] - b.x[k])))"),
    "minkowski": ({"p": 3}, "emb64", f"pow({_SUM.format('pow(abs(a.x[k] - b.x[k]), 3)')}, 1.0 / 3)"),
    "wminkowski": ({"p": 3, "w": _V}, "emb64", f"pow({_SUM.format(f'pow({_VSQL}[k] * abs(a.x[k] - b.x[k]), 3)')}, 1.0 / 3)"),
    "mahalanobis": ({"VI": [[2.0, 0.5], [0.5, 1.0]]}, "blobs", "sqrt(2 * (a.x[1] - b.x[1]) ** 2 + (a.x[1] - b.x[1]) * (a.x[2] - b.x[2]) + (a.x[2] - b.x[2]) ** 2)"),
    "hamming": ({}, "bools", f"{_NEQ} / len(a.x)"),
    "canberra": ({}, "emb64", _SUM.format("CASE WHEN abs(a.x[k]) + abs(b.x[k]) > 0 THEN abs(a.x[k] - b.x[k]) / (abs(a.x[k]) + abs(b.x[k])) ELSE 0 END")),
    "braycurtis": ({}, "emb64", f"{_SUM.format('abs(a.x[k] - b.x[k])')} / {_SUM.format('abs(a.x[k]) + abs(b.x[k])')}"),
    "jaccard": ({}, "bools", f"{_NEQ} / ({_NEQ} + {_NTT})"),
    "matching": ({}, "bools", f"{_NEQ} / len(a.x)"),
    "dice": ({}, "bools", f"{_NEQ} / (2 * {_NTT} + {_NEQ})"),
    "kulsinski": ({}, "bools", f"({_NEQ} - {_NTT} + len(a.x)) / ({_NEQ} + len(a.x))"),
    "rogerstanimoto": ({}, "bools", f"2 * {_NEQ} / (len(a.x) + {_NEQ})"),
    "russellrao": ({}, "bools", f"(len(a.x) - {_NTT}) / len(a.x)"),
    "sokalmichener": ({}, "bools", f"2 * {_NEQ} / (len(a.x) + {_NEQ})"),
    "sokalsneath": ({}, "bools", f"{_NEQ} / (0.5 * {_NTT} + {_NEQ})"),
    "haversine": ({}, "geo", "2 * asin(sqrt(sin((a.x[1] - b.x[1]) / 2) ** 2 + cos(a.x[1]) * cos(b.x[1]) * sin((a.x[2] - b.x[2]) / 2) ** 2))"),
    "cosine": ({}, "emb64", f"1 - {_DOT} / sqrt({_NN})"),
    "sqeuclidean": ({}, "emb64", _SUM.format("(a.x[k] - b.x[k]) ** 2")),
    "correlation": ({}, "emb64", "1 - (list_dot_product(a.x, b.x) - list_sum(a.x) * list_sum(b.x) / 64) / sqrt((list_dot_product(a.x, a.x) - list_sum(a.x) ** 2 / 64) * (list_dot_product(b.x, b.x) - list_sum(b.x) ** 2 / 64))"),
    "yule": ({}, "bools", f"2 * (list_sum(a.x) - {_NTT}) * (list_sum(b.x) - {_NTT}) / ({_NTT} * (64 - {_NTT} - {_NEQ}) + (list_sum(a.x) - {_NTT}) * (list_sum(b.x) - {_NTT}))"),
    "arccos": ({}, "emb64", f"acos(least(1, greatest(-1, {_DOT} / sqrt({_NN})))) / pi()"),
}
_INPUTS = {
    "emb64": (inputs.emb64, 64, "p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings)"),
    "bools": (inputs.emb_bool, 64, "p AS (SELECT vec_id AS id, list_transform(embedding, lambda v: CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END) AS x FROM embeddings)"),
    "geo": (inputs.emb_geo, 2, "p AS (SELECT vec_id AS id, [asin(embedding[1]::DOUBLE), pi() * embedding[2]::DOUBLE] AS x FROM embeddings)"),
    "blobs": (inputs.blobs2d, 2, _blobs("p", 4.0)),
}


def _metric_query(name: str):
    kwargs, source, sql = _METRICS[name]
    make, dim, cte = _INPUTS[source]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Per point the sum and the largest of its distances to all others."""
        p = make(spark, sf_dir)
        a, b = p.select("id", F.col("features").alias("u")), p.select(F.col("id").alias("other"), F.col("features").alias("v"))
        d = Metric(name, **kwargs).column(F.col("u"), F.col("v"), dim)
        return a.join(b, F.col("id") != F.col("other")).select("id", d.alias("d")).groupBy("id").agg(F.round(F.sum("d"), 5).alias("total"), r6(F.max("d")).alias("largest"))

    run.__name__ = f"metric_{name}"
    query(f"WITH {cte} SELECT a.id, round(sum({sql}), 5) AS total, round(max({sql}), 6) AS largest FROM p a JOIN p b ON a.id <> b.id GROUP BY a.id")(run)


for _name in _METRICS:
    _metric_query(_name)


@query("WITH p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings) SELECT a.id, round(sum(abs(a.x[1] - b.x[1])), 5) AS total FROM p a JOIN p b ON a.id <> b.id GROUP BY a.id")
def metric_callable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric given as a Python function, summed per point over all others."""
    rows = inputs.placed(inputs.emb64(spark, sf_dir))
    metric = Metric(lambda u, v: abs(u[0] - v[0]))
    sums = reduce_pairs(rows.select("pos", "x", F.lit(0).alias("label"), F.lit(1.0).alias("weight")), metric, lambda d, w: __import__("numpy").nansum(d, axis=1))
    return sums.join(rows, "pos").select("id", F.round("total", 5).alias("total"))


# -- neighbours --------------------------------------------------------------------------------


@query(f"WITH {_B4} SELECT a.id AS i, b.id AS j, round(list_distance(a.x, b.x), 6) AS d FROM blobs a JOIN blobs b ON a.id < b.id")
def pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.blobs2d(spark, sf_dir).select(F.col("id").alias("pos"), F.col("features").alias("x"))
    return N.pairwise(rows, Metric(), 2).select("i", "j", r6("d").alias("d"))


@query(f"WITH {_EMB} SELECT a.id, b.id AS nbr, round(list_distance(a.x, b.x), 6) AS dist, (row_number() OVER w)::INT AS rank FROM emb64 a JOIN emb64 b ON a.id <> b.id WINDOW w AS (PARTITION BY a.id ORDER BY list_distance(a.x, b.x), b.id) QUALIFY row_number() OVER w <= 10")
def knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = inputs.emb64(spark, sf_dir).select(F.col("id").alias("pos"), F.col("features").alias("x"))
    return N.knn(p, 10, Metric()).select(F.col("pos").alias("id"), "nbr", r6("dist").alias("dist"), F.col("rank").cast("int").alias("rank"))


@query(f"WITH {_B4}, {_B1} SELECT a.id, b.id AS nbr, round(list_distance(a.x, b.x), 6) AS dist, (row_number() OVER w)::INT AS rank FROM noisy a JOIN blobs b ON true WINDOW w AS (PARTITION BY a.id ORDER BY list_distance(a.x, b.x), b.id) QUALIFY row_number() OVER w <= 10")
def knn_new_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest model points of other points."""
    p = inputs.blobs2d(spark, sf_dir).select(F.col("id").alias("pos"), F.col("features").alias("x"))
    q = inputs.blobs2d(spark, sf_dir, 1.0).select(F.col("id").alias("pos"), F.col("features").alias("x"))
    return N.knn(p, 10, Metric(), itself=None, queries=q).select(F.col("pos").alias("id"), "nbr", r6("dist").alias("dist"), F.col("rank").cast("int").alias("rank"))


@query(f"WITH {_B4} SELECT a.id, b.id AS nbr, round(list_distance(a.x, b.x), 6) AS dist FROM blobs a JOIN blobs b ON a.id <> b.id AND list_distance(a.x, b.x) <= 0.05")
def radius_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = inputs.blobs2d(spark, sf_dir).select(F.col("id").alias("pos"), F.col("features").alias("x"))
    return N.within(p, 0.05, Metric()).select(F.col("pos").alias("id"), "nbr", r6("dist").alias("dist"))


@query(f"WITH {_EMB}, {_CORE5.format(t='emb64')} SELECT id, round(core, 6) AS core FROM core")
def core_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = inputs.emb64(spark, sf_dir).select(F.col("id").alias("pos"), F.col("features").alias("x"))
    return N.core_distances(N.knn(p, 5, Metric()), 5).select(F.col("pos").alias("id"), r6("core").alias("core"))


@query("SELECT p_partkey AS id FROM part WHERE p_size IS NOT NULL AND p_retailprice IS NOT NULL AND NOT isnan(p_retailprice) AND NOT isinf(p_retailprice)")
def finite_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.parts(spark, sf_dir).where(scalar.is_finite("features", 2)).select("id")


# -- graphs --------------------------------------------------------------------------------------


@query(f"WITH {E.blobs('blobs', 4.0)}, {E.reach('blobs', 5, '1.5')}, u AS (SELECT i, w FROM pair UNION ALL SELECT j, w FROM pair) SELECT p.id, round(sum(w), 5) AS total, round(min(w), 6) AS least, round(max(w), 6) AS largest FROM u JOIN pts p ON p.k = u.i GROUP BY p.id")
def mutual_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutual reachability over all pairs, summed per point."""
    p = inputs.blobs2d(spark, sf_dir).select(F.col("id").alias("pos"), F.col("features").alias("x"))
    core = materialize(N.core_distances(N.knn(p, 5, Metric()), 5), "core")
    return _per_point(S.reachability(p, core, Metric(), 2, 1.5))


def _per_point(pairs: DataFrame) -> DataFrame:
    ends = pairs.select(F.explode(F.array("i", "j")).alias("id"), "w")
    return ends.groupBy("id").agg(F.round(F.sum("w"), 5).alias("total"), r6(F.min("w")).alias("least"), r6(F.max("w")).alias("largest"))


_STORED = f"""WITH RECURSIVE {E.blobs('blobs', 4.0)}, pts AS MATERIALIZED (SELECT 0 AS g, id, row_number() OVER (ORDER BY id) AS k FROM blobs),
dist AS MATERIALIZED (SELECT p.k AS i, q.k AS j, list_distance(a.x, b.x) AS d FROM blobs a JOIN pts p ON p.id = a.id JOIN blobs b ON b.id <> a.id JOIN pts q ON q.id = b.id WHERE list_distance(a.x, b.x) <= 0.2),
core AS MATERIALIZED (SELECT i, d AS core FROM dist QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) = 5),
pair AS (SELECT 0 AS g, dist.i, dist.j, greatest(a.core, b.core, d) AS w FROM dist JOIN core a ON a.i = dist.i JOIN core b ON b.i = dist.j WHERE dist.i < dist.j)"""


@query(_STORED + ", u AS (SELECT i, w FROM pair UNION ALL SELECT j, w FROM pair) SELECT p.id, round(sum(w), 5) AS total, round(min(w), 6) AS least, round(max(w), 6) AS largest FROM u JOIN pts p ON p.k = u.i GROUP BY p.id")
def sparse_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutual reachability over stored distances only, summed per point; points with under five are unreachable."""
    p = inputs.blobs2d(spark, sf_dir).select(F.col("id").alias("pos"), F.col("features").alias("x"))
    e = materialize(N.within(p, 0.2, Metric()).select(F.col("pos").alias("i"), F.col("nbr").alias("j"), F.col("dist").alias("d")), "edges")
    return _per_point(S.edge_reachability(e, N.core_of_edges(e, 5)))


_REACH = """WITH RECURSIVE {cte}, {core}, g AS (SELECT i, j FROM d JOIN core a ON a.id = i JOIN core b ON b.id = j WHERE greatest(a.core, b.core, d / {alpha}) < {cut}),
c(id, part) AS (SELECT id, id FROM {t} UNION SELECT g.j, c.part FROM c JOIN g ON g.i = c.id WHERE c.part <= g.j),
least AS (SELECT id, min(part) AS part FROM c GROUP BY id), size AS (SELECT part, count(*) AS n FROM least GROUP BY part)
SELECT id, CASE WHEN n >= 5 THEN part END AS first_id FROM least JOIN size USING (part)"""


def _first_ids(labels: DataFrame) -> DataFrame:
    """Labels by the least id of their cluster; noise is null."""
    first = labels.where("label >= 0").groupBy("label").agg(F.min("id").alias("first_id"))
    return labels.join(first, "label", "left").select("id", "first_id")


@query(_REACH.format(cte=_B1, core=_CORE5.format(t="noisy"), alpha="1.0", cut="0.06", t="noisy"))
def dbscan_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components at a distance of 0.06 with at least five points."""
    model = DensityClusterer(min_samples=5, min_cluster_size=10).fit(inputs.blobs2d(spark, sf_dir, 1.0)).model
    return _first_ids(model.dbscan(0.06, 5))


@query(_REACH.format(cte=_B1, core=_CORE5.format(t="noisy"), alpha="sqrt(2)", cut="0.05", t="noisy"))
def robust_single_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _first_ids(RobustLinkage(cut=0.05, k=5, gamma=5).fit(inputs.blobs2d(spark, sf_dir, 1.0)).labels)


@query(_REACH.format(cte=_B1, core=_CORE5.format(t="noisy"), alpha="sqrt(2)", cut="0.05", t="noisy"))
def robust_precomputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a table of all distances."""
    p = inputs.blobs2d(spark, sf_dir, 1.0).select(F.col("id").alias("pos"), F.col("features").alias("x"))
    return _first_ids(RobustLinkage(cut=0.05, k=5, gamma=5, metric="precomputed").fit(N.pairwise(p, Metric(), 2)).labels)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT least(parent, child) AS a, greatest(parent, child) AS b FROM condensed_tree WHERE child_size > 1 AND parent IS NOT NULL AND child IS NOT NULL AND parent <> child),
n AS (SELECT a AS x, b AS y FROM e UNION ALL SELECT b, a FROM e),
c(node, part) AS (SELECT DISTINCT x, x FROM n UNION SELECT n.y, c.part FROM c JOIN n ON n.x = c.node WHERE c.part <= n.y)
SELECT node, min(part) AS part FROM c GROUP BY node""")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which tree of the forest each cluster belongs to."""
    t = inputs.table(spark, sf_dir, "condensed_tree").where("child_size > 1")
    return connected_components(t.select(F.col("parent").alias("a"), F.col("child").alias("b")))


_WEIGHTS = " SELECT round(w, 6) AS w, count(*) AS edges FROM {} GROUP BY 1"
_EDGES = ' SELECT p.id AS "from", q.id AS "to", round(w, 6) AS distance, (step - 1)::INT AS step FROM mst JOIN pts p ON p.k = f JOIN pts q ON q.k = t'


@query(E.model("blobs", 4.0, upto="tree") + _WEIGHTS.format("mst"))
def mst_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weights of the spanning tree and how often each occurs."""
    model = DensityClusterer(min_samples=5, min_cluster_size=10).fit(inputs.blobs2d(spark, sf_dir)).model
    return model.minimum_spanning_tree.groupBy(r6("distance").alias("w")).agg(F.count(F.lit(1)).alias("edges"))


@query(E.model("blobs", 4.0, upto="tree") + _EDGES)
def mst_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(DensityClusterer(min_samples=5, min_cluster_size=10).fit(inputs.blobs2d(spark, sf_dir)).model.minimum_spanning_tree)


@query(E.model("noisy", 1.0, upto="tree") + _EDGES)
def mst_edges_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by blocks of about 64 points: trees of blocks and the crossings between them."""
    return rounded(DensityClusterer(min_samples=5, min_cluster_size=10, block=64).fit(inputs.blobs2d(spark, sf_dir, 1.0)).model.minimum_spanning_tree)


_EMB_PAIRS = f"WITH RECURSIVE {_EMB}, {E.reach('emb64')}, {E.chain(upto='tree')}"


@query(_EMB_PAIRS + _EDGES)
def mst_edges_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By blocks, in 64 dimensions without structure: boxes prune little."""
    return rounded(DensityClusterer(min_samples=5, min_cluster_size=10, block=64).fit(inputs.emb64(spark, sf_dir)).model.minimum_spanning_tree)


@query(f"WITH {_B1} SELECT a.id, b.id AS nbr, round(list_distance(a.x, b.x), 6) AS dist, (row_number() OVER w)::INT AS rank FROM noisy a JOIN noisy b ON a.id <> b.id WINDOW w AS (PARTITION BY a.id ORDER BY list_distance(a.x, b.x), b.id) QUALIFY row_number() OVER w <= 10")
def knn_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours by blocks of about 64 points."""
    p = inputs.blobs2d(spark, sf_dir, 1.0).select(F.col("id").alias("pos"), F.col("features").alias("x"))
    return N.knn(p, 10, Metric(), block=64).select(F.col("pos").alias("id"), "nbr", r6("dist").alias("dist"), F.col("rank").cast("int").alias("rank"))


@query(_STORED + f", {E.chain(upto='tree')} SELECT least(p.id, q.id) AS a, greatest(p.id, q.id) AS b, round(w, 6) AS w FROM mst JOIN pts p ON p.k = f JOIN pts q ON q.k = t")
def sparse_spanning_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spanning forest of stored distances, by distributed rounds."""
    p = inputs.blobs2d(spark, sf_dir).select(F.col("id").alias("pos"), F.col("features").alias("x"))
    e = materialize(N.within(p, 0.2, Metric()).select(F.col("pos").alias("i"), F.col("nbr").alias("j"), F.col("dist").alias("d")), "edges")
    return rounded(boruvka(S.edge_reachability(e, N.core_of_edges(e, 5)).select(F.col("i").alias("a"), F.col("j").alias("b"), "w"))[0])


# -- clustering ------------------------------------------------------------------------------------


def _fit(spark: SparkSession, sf_dir: str, amplitude: float = 4.0, **params) -> DensityModel:
    return DensityClusterer(**({"min_cluster_size": 10, "min_samples": 5} | params)).fit(inputs.blobs2d(spark, sf_dir, amplitude)).model


_RESULT = " SELECT id, label, round(probability, 6) AS probability FROM lab"


@query(E.model("blobs", 4.0) + _RESULT)
def cluster_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: labels and probabilities of the 2-D blobs."""
    return rounded(_fit(spark, sf_dir).result)


@query(E.model("blobs", 4.0) + " " + E.first_ids())
def cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each point's cluster by its least id."""
    return _first_ids(_fit(spark, sf_dir).result)


def _recut_sql(n: int, table: str, amplitude: float) -> str:
    """A fit by stability, re-cut to ``n`` clusters."""
    return f"WITH RECURSIVE {E.blobs(table, amplitude)}, {E.reach(table)}, {E.chain(epsilon='(SELECT eps FROM wanted)', between=E.recut(n))}"


@query(_recut_sql(5, "noisy", 1.0) + " " + E.first_ids())
def cluster_members_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping blobs as exactly five clusters, by a flat cut."""
    return _first_ids(flat.recut(_fit(spark, sf_dir, 1.0), 5).result)


@query(E.model("noisy", 1.0, method="leaf", upto="labels") + " " + E.first_ids())
def cluster_members_leaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping blobs by the leaf selection."""
    return _first_ids(_fit(spark, sf_dir, 1.0, cluster_selection_method="leaf").result)


@query(E.model("noisy", 1.0) + " " + E.first_ids())
def cluster_precomputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping blobs clustered from a table of all their distances."""
    p = inputs.blobs2d(spark, sf_dir, 1.0).select(F.col("id").alias("pos"), F.col("features").alias("x"))
    model = DensityClusterer(min_cluster_size=10, min_samples=5, metric="precomputed").fit(N.pairwise(p, Metric(), 2)).model
    return _first_ids(model.result)


@query(E.model("noisy", 1.0) + _RESULT)
def cluster_noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_fit(spark, sf_dir, 1.0).result)


@query(E.model("noisy", 1.0, single=True) + _RESULT)
def cluster_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the root among the clusters that may be selected."""
    return rounded(_fit(spark, sf_dir, 1.0, allow_single_cluster=True).result)


_PARTS = "parts AS MATERIALIZED (SELECT p_partkey AS id, [p_size::DOUBLE, p_retailprice::DOUBLE] AS x FROM part)"


@query(f"WITH RECURSIVE {_PARTS}, {E.reach('parts', 15)}, {E.chain(mcs=15)}" + _RESULT)
def cluster_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with many duplicates, so with infinite lambdas."""
    return rounded(DensityClusterer(min_cluster_size=15).fit(inputs.parts(spark, sf_dir)).model.result)


_USERS = "users AS MATERIALIZED (SELECT user_id AS id, [count(*)::DOUBLE, avg(value)] AS x FROM events WHERE user_id IS NOT NULL GROUP BY user_id)"


@query(f"WITH RECURSIVE {_USERS}, {E.reach('users')}, {E.chain(mcs=5)}" + _RESULT)
def cluster_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(DensityClusterer(min_cluster_size=5).fit(inputs.users(spark, sf_dir)).model.result)


@query()
def fit_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fit over all orders with default parameters: block by block."""
    return DensityClusterer().fit(inputs.orders(spark, sf_dir)).model.result


@query(E.model("noisy", 1.0, method="leaf", epsilon=0.05) + _RESULT)
def cluster_leaf_epsilon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_fit(spark, sf_dir, 1.0, cluster_selection_method="leaf", cluster_selection_epsilon=0.05).result)


@query(E.model("noisy", 1.0, epsilon=0.12) + _RESULT)
def cluster_epsilon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By stability, clusters born below a distance merged upwards."""
    return rounded(_fit(spark, sf_dir, 1.0, cluster_selection_epsilon=0.12).result)


@query(E.model("noisy", 1.0) + " SELECT label, round(persistence, 6) AS persistence FROM persist")
def label_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_fit(spark, sf_dir, 1.0).persistence)


@query()
def cluster_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of little persistence collapsed before the selection."""
    return _fit(spark, sf_dir, 1.0, cluster_selection_persistence=1.0).persistence


@query(E.model("noisy", 1.0, cap=60, far=0.3) + _RESULT)
def cluster_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_fit(spark, sf_dir, 1.0, max_cluster_size=60, cluster_selection_epsilon_max=0.3).result)


@query(E.model("blobs", 4.0, upto="link") + _WEIGHTS.format("link"))
def linkage_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distances at which the single-linkage tree merges: those of the spanning tree."""
    return _fit(spark, sf_dir).single_linkage_tree.groupBy(r6("distance").alias("w")).agg(F.count(F.lit(1)).alias("edges"))


@query(E.model("blobs", 4.0, upto="link") + " SELECT node AS parent, lft AS left_child, rgt AS right_child, round(w, 6) AS distance, size FROM link")
def single_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_fit(spark, sf_dir).single_linkage_tree)


@query(E.model("noisy", 1.0, upto="condensed") + " SELECT parent, child, round(lam, 6) AS lambda_val, size AS child_size FROM cond")
def condensed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_fit(spark, sf_dir, 1.0).condensed_tree)


@query(E.model("noisy", 1.0) + " SELECT cl.c AS cluster, coalesce(sel.label, -1) AS label, coalesce(cl.up, -1) AS parent, cl.size, round(cl.birth, 6) AS birth, round(t.death, 6) AS death, round(t.own, 6) AS stability, round(b.death, 6) AS subtree_death FROM cl JOIN stab t ON t.c = cl.c JOIN sub b ON b.c = cl.c LEFT JOIN sel ON sel.c = cl.c")
def cluster_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cluster of the hierarchy: size, birth, death, stability, its label if it is selected."""
    return rounded(_fit(spark, sf_dir, 1.0).clusters)


@query(E.model("noisy", 1.0) + " SELECT id, round(score, 6) AS score FROM score")
def outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_fit(spark, sf_dir, 1.0).outlier_scores)


@query(E.model("noisy", 1.0) + " SELECT id, round(score, 6) AS score FROM score WHERE score > (SELECT quantile_cont(score, 0.9) FROM score)")
def outliers_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tenth of the points with the highest outlier scores."""
    return rounded(_fit(spark, sf_dir, 1.0).outliers_above(0.9))


@query(E.model("noisy", 1.0) + " SELECT e.label, e.id, round(x[1], 6) AS x, round(x[2], 6) AS y FROM exem e JOIN noisy USING (id)")
def exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _fit(spark, sf_dir, 1.0).exemplars
    return rows.select("label", "id", r6(F.col("features")[0]).alias("x"), r6(F.col("features")[1]).alias("y"))


@query(E.model("noisy", 1.0) + f", {E.RELATIVE_VALIDITY}")
def relative_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(round(_fit(spark, sf_dir, 1.0).relative_validity(), 9),)], "validity double")


@query(E.model("noisy", 1.0) + ", c AS (SELECT l.label, l.id, sum(list_distance(x.x, y.x) * m.probability) AS cost FROM lab l JOIN lab m ON m.label = l.label AND m.id <> l.id JOIN noisy x ON x.id = l.id JOIN noisy y ON y.id = m.id WHERE l.label >= 0 GROUP BY ALL) SELECT label, id FROM c QUALIFY row_number() OVER (PARTITION BY label ORDER BY cost, id) = 1")
def cluster_medoids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members of least weighted distance to their cluster."""
    return _fit(spark, sf_dir, 1.0).weighted_medoids().select("label", "id")


@query(E.model("noisy", 1.0) + " SELECT l.label, round(sum(b.x[1] * probability) / sum(probability), 6) AS c1, round(sum(b.x[2] * probability) / sum(probability), 6) AS c2 FROM lab l JOIN noisy b USING (id) WHERE l.label >= 0 GROUP BY l.label")
def cluster_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _fit(spark, sf_dir, 1.0).weighted_centroids()
    return c.select("label", r6(F.col("centroid")[0]).alias("c1"), r6(F.col("centroid")[1]).alias("c2"))


# -- aggregates over labelled points ------------------------------------------------------------------


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = inputs.table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("int").alias("label"))
    return materialize(inputs.placed(inputs.blobs2d(spark, sf_dir)).join(lab, "id"), "labelled")


@query(f"WITH {_B4} SELECT label::INT AS label, round(sum(x[1] * (1 + id % 3)) / sum(1 + id % 3), 6) AS c1, round(sum(x[2] * (1 + id % 3)) / sum(1 + id % 3), 6) AS c2 FROM blobs GROUP BY label")
def weighted_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir).withColumn("w", 1.0 + F.col("id") % 3)
    c = scalar.weighted_average(rows, "label", "x", "w")
    return c.select("label", r6(F.col("x")[0]).alias("c1"), r6(F.col("x")[1]).alias("c2"))


@query(f"WITH {_B4}, c AS (SELECT a.label, a.id, sum(list_distance(a.x, b.x) * (1 + b.id % 3)) AS cost FROM blobs a JOIN blobs b ON a.label = b.label AND a.id <> b.id GROUP BY ALL) SELECT label::INT AS label, id FROM c QUALIFY row_number() OVER (PARTITION BY label ORDER BY cost, id) = 1")
def weighted_medoids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import numpy as np

    rows = _labelled(spark, sf_dir).withColumn("weight", 1.0 + F.col("id") % 3)
    cost = reduce_pairs(rows, Metric(), lambda d, w: np.nansum(d * w[None], axis=1)).join(rows.select("pos", "id"), "pos")
    return cost.groupBy("label").agg(F.min(F.struct("total", "id")).alias("m")).select("label", F.col("m.id").alias("id"))


_V1 = f"{_B4}, v AS (SELECT a.id, a.label, pow(sum(pow(1 / list_distance(a.x, b.x), 2)) / count(*), -0.5) AS core FROM blobs a JOIN blobs b ON a.label = b.label AND a.id <> b.id GROUP BY a.id, a.label)"


@query(f"WITH {_V1} SELECT id, round(core, 6) AS core FROM v")
def all_points_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir)
    core = validity.all_points_core_distances(rows.select("pos", "x", "label"), Metric(), 2)
    return core.join(rows.select("pos", "id"), "pos").select("id", r6("core").alias("core"))


@query(E.validity("blobs", 4.0) + "SELECT la::INT AS a, lb::INT AS b, round(gap, 6) AS gap FROM gap WHERE la < lb")
def density_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least mutual reachability between the inner nodes of every two labels' trees."""
    rows = _labelled(spark, sf_dir)
    core = validity.all_points_core_distances(rows.select("pos", "x", "label"), Metric(), 2).select("pos", "core")
    cored = materialize(rows.select("pos", "x", "label").join(core, "pos"), "cored")
    inner = validity.internal_trees(cored, Metric())[1]
    return label_gaps(cored.join(inner.select("pos"), "pos", "left_semi"), Metric()).select("a", "b", r6("gap").alias("gap"))


@query(E.validity("blobs", 4.0) + "SELECT label::INT AS label, size, round(sparseness, 6) AS sparseness, round(separation, 6) AS separation, round((separation - sparseness) / greatest(separation, sparseness), 6) AS validity FROM per")
def validity_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(validity.validity(_labelled(spark, sf_dir).select("pos", "x", "label"))[1])


@query(E.validity("blobs", 4.0) + "SELECT label::INT AS label, size, round(sparseness, 6) AS sparseness, round(separation, 6) AS separation, round((separation - sparseness) / greatest(separation, sparseness), 6) AS validity FROM per")
def validity_precomputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a table of all distances."""
    rows = _labelled(spark, sf_dir)
    edges = N.pairwise(rows.select(F.col("id").alias("pos"), "x"), Metric(), 2)
    return rounded(validity.validity_of_distances(edges, rows.select("id", "label"), 2)[1])


@query(f"WITH {_B4}, {_EMB} SELECT a.id, b.id AS nbr, round(acos(least(1, greatest(-1, list_dot_product(a.x, b.x) / sqrt(list_dot_product(a.x, a.x) * list_dot_product(b.x, b.x))))) / pi(), 6) AS d FROM emb64 a JOIN emb64 b ON b.id > a.id AND b.id - a.id <= 20")
def angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As a distance by itself "cosine" is the angle over pi; only a fit takes it for 1 - cos."""
    p = inputs.emb64(spark, sf_dir)
    a, b = p.select("id", F.col("features").alias("u")), p.select(F.col("id").alias("nbr"), F.col("features").alias("v"))
    near = a.join(b, (F.col("nbr") > F.col("id")) & (F.col("nbr") - F.col("id") <= 20))
    return near.select("id", "nbr", r6(distance_metric("cosine").column(F.col("u"), F.col("v"), 64)).alias("d"))


@query(E.validity("blobs", 4.0) + "SELECT g::INT AS label, id FROM inner_")
def inner_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points with more than one edge in the tree of their label."""
    rows = _labelled(spark, sf_dir)
    core = validity.all_points_core_distances(rows.select("pos", "x", "label"), Metric(), 2).select("pos", "core")
    inner = validity.internal_trees(materialize(rows.select("pos", "x", "label").join(core, "pos"), "cored"), Metric())[1]
    return inner.join(rows.select("pos", "id"), "pos").select("label", "id")


@query("SELECT label, count(*) AS n FROM (SELECT DISTINCT id, label, probability FROM cluster_result) GROUP BY label")
def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.table(spark, sf_dir, "cluster_result").distinct().groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT cluster_node, (dense_rank() OVER (ORDER BY cluster_node) - 1)::INT AS label FROM (SELECT DISTINCT cluster_node FROM cluster_map WHERE cluster_node IS NOT NULL)")
def relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster nodes numbered 0.. in ascending order, without a single-task sort."""
    from moraine.sources.points import positions

    nodes = inputs.table(spark, sf_dir, "cluster_map").select("cluster_node").where("cluster_node IS NOT NULL").distinct()
    return positions(nodes, "cluster_node").select("cluster_node", F.col("raw").cast("int").alias("label"))


@query("WITH d AS (SELECT DISTINCT id, label, probability FROM cluster_result WHERE probability IS NOT NULL AND label >= 0), s AS (SELECT id, label, probability, exp(probability - max(probability) OVER w) AS e, sum(probability) OVER w AS t FROM d WINDOW w AS (PARTITION BY label)) SELECT id, label, round(e / sum(e) OVER (PARTITION BY label), 9) AS soft, round(probability / t, 9) AS share FROM s")
def softmax_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = inputs.table(spark, sf_dir, "cluster_result").where("probability IS NOT NULL AND label >= 0").distinct()
    return d.select("id", "label", F.round(scalar.softmax(F.col("probability"), ["label"]), 9).alias("soft"), F.round(scalar.normalise(F.col("probability"), ["label"]), 9).alias("share"))


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount > 0 THEN 1.0 / l_discount ELSE 'inf'::DOUBLE END, 6) AS lam, round(l_quantity / CASE WHEN l_discount <= 0 THEN 1e-8 ELSE l_discount END, 4) AS ratio FROM lineitem")
def scalar_lambda(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, q = F.col("l_discount").cast("double"), F.col("l_quantity").cast("double")
    return inputs.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r6(scalar.inverse(d)).alias("lam"), F.round(scalar.safe_divide(q, d), 4).alias("ratio"))


# -- stored condensed trees ------------------------------------------------------------------------------

_CUR = """cur AS (SELECT parent, child, lambda_val, child_size FROM (SELECT * FROM condensed_tree WHERE parent IS NOT NULL AND child IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY parent, child ORDER BY loaded_at DESC NULLS LAST) = 1) WHERE lambda_val IS NOT NULL AND NOT isnan(lambda_val))"""


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(ST.current(inputs.table(spark, sf_dir, "condensed_tree")), "tree")


@query(f"""WITH {_CUR}, birth AS (SELECT child AS cluster, min(lambda_val) AS b FROM cur WHERE child_size > 1 GROUP BY child),
s AS (SELECT parent AS cluster, coalesce(sum(lambda_val * child_size) FILTER (NOT isinf(lambda_val)), 0) AS w, coalesce(sum(child_size) FILTER (NOT isinf(lambda_val)), 0) AS n, coalesce(bool_or(isinf(lambda_val) AND child_size > 0), false) AS e FROM cur GROUP BY parent)
SELECT cluster, CASE WHEN e AND NOT isinf(coalesce(b, 0)) THEN 'inf'::DOUBLE WHEN isinf(coalesce(b, 0)) THEN 0 ELSE round(w - coalesce(b, 0) * n, 8) END AS stability FROM s LEFT JOIN birth USING (cluster)""")
def stored_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ST.stability(_stored(spark, sf_dir)).select("cluster", F.round("stability", 8).alias("stability"))


@query(f"WITH {_CUR} SELECT parent AS cluster, max(lambda_val) AS death FROM cur GROUP BY parent")
def stored_deaths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ST.deaths(_stored(spark, sf_dir))


@query(f"WITH {_CUR} SELECT DISTINCT child AS cluster FROM cur WHERE child_size > 1 AND child NOT IN (SELECT parent FROM cur WHERE child_size > 1)")
def stored_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ST.leaves(_stored(spark, sf_dir))


_UP = f"""WITH RECURSIVE {_CUR}, up AS (SELECT DISTINCT child AS c, parent AS p FROM cur WHERE child_size > 1 AND child <> parent),
path(c, a) AS (SELECT c, c FROM up UNION SELECT p, p FROM up UNION SELECT path.c, up.p FROM path JOIN up ON up.c = path.a)"""


@query(_UP + " SELECT c AS cluster, a AS ancestor FROM path")
def stored_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ST.ancestors(_stored(spark, sf_dir)).select("cluster", "ancestor")


@query(_UP + ", own AS (SELECT parent AS c, max(lambda_val) AS d FROM cur GROUP BY parent), s AS (SELECT path.a AS p, max(d) AS d FROM path JOIN own USING (c) GROUP BY 1), t AS (SELECT c AS p, greatest(own.d, s.d) AS d FROM own LEFT JOIN s ON s.p = own.c) SELECT parent, child, round(CASE WHEN d = 0 OR isinf(lambda_val) THEN 0 WHEN isinf(d) THEN 1 ELSE (d - lambda_val) / d END, 6) AS score FROM cur JOIN t ON t.p = cur.parent WHERE child_size = 1")
def stored_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ST.outlier_scores(_stored(spark, sf_dir)).select("parent", "child", r6("score").alias("score"))


# -- new points, branches, exports ------------------------------------------------------------------------


def _new(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.blobs2d(spark, sf_dir, 3.9)


_PLACED = E.model("noisy", 1.0) + ", " + E.PLACED.format(new=E.blobs("fresh", 0.9), table="noisy")
_PUT = _PLACED + " SELECT id, label, round(probability, 6) AS probability, neighbor FROM put"


def _overlap(spark: SparkSession, sf_dir: str) -> tuple[DensityModel, DataFrame]:
    """The model of the overlapping blobs, and new points near them."""
    return _fit(spark, sf_dir, 1.0), inputs.blobs2d(spark, sf_dir, 0.9)


@query(_PUT)
def predict_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, new = _overlap(spark, sf_dir)
    return rounded(Predictor(model).labels(new))


@query(_PLACED + " " + E.NEW_SCORES)
def predict_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, new = _overlap(spark, sf_dir)
    return rounded(Predictor(model).scores(new))


_SOFT = " SELECT id, label, round(membership, 6) AS membership FROM soft"


@query(_PLACED + ", " + E.NEW_MEMBERSHIPS.format(asked="fresh", table="noisy") + _SOFT)
def predict_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, new = _overlap(spark, sf_dir)
    return rounded(Predictor(model).membership(new))


@query(E.model("noisy", 1.0) + ", " + E.ALL_MEMBERSHIPS.format(asked="noisy", table="noisy") + _SOFT)
def all_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Predictor(_fit(spark, sf_dir, 1.0)).all_memberships())


@query(E.model("noisy", 1.0) + ", " + E.ALL_MEMBERSHIPS.format(asked="noisy", table="noisy") + " SELECT id, list(round(membership, 6) ORDER BY label) AS memberships FROM soft GROUP BY id")
def membership_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One array per point."""
    rows = wide(Predictor(_fit(spark, sf_dir, 1.0)).all_memberships())
    return rows.select("id", F.transform("memberships", lambda v: F.round(v, 6)).alias("memberships"))


_FLAT = _recut_sql(5, "noisy", 1.0)


@query(_FLAT + ", " + E.PLACED.format(new=E.blobs("fresh", 0.9), table="noisy") + " SELECT id, label, round(probability, 6) AS probability, neighbor FROM put")
def predict_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, new = _overlap(spark, sf_dir)
    return rounded(flat.approximate_predict_flat(model, new, 5))


@query(_FLAT + ", " + E.ALL_MEMBERSHIPS.format(asked="noisy", table="noisy") + _SOFT)
def memberships_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(flat.all_points_membership_vectors_flat(_fit(spark, sf_dir, 1.0), 5))


@query(_FLAT + ", " + E.PLACED.format(new=E.blobs("fresh", 0.9), table="noisy") + ", " + E.NEW_MEMBERSHIPS.format(asked="fresh", table="noisy") + _SOFT)
def new_memberships_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, new = _overlap(spark, sf_dir)
    return rounded(flat.membership_vector_flat(model, new, 5))


def _branch_sql(method: str) -> str:
    return E.model("blobs", 4.0) + ", " + E.branches(method)


@query(_branch_sql("full") + " " + E.BRANCH_ROWS)
def branch_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(BranchDetector("full", min_cluster_size=5).fit(_fit(spark, sf_dir)).result)


@query(_branch_sql("core") + " " + E.BRANCH_ROWS)
def branch_labels_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(BranchDetector("core", min_cluster_size=5).fit(_fit(spark, sf_dir)).result)


@query(_branch_sql("full") + " SELECT g::INT AS cluster, parent, child, round(lam, 6) AS lambda_val, size AS child_size FROM bcond")
def branch_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The condensed tree of each cluster's branches."""
    return rounded(BranchDetector("full", min_cluster_size=5).fit(_fit(spark, sf_dir)).condensed_trees)


@query(
    _branch_sql("full")
    + ", "
    + E.PLACED.format(new=E.blobs("fresh", 3.9), table="blobs").replace("core4 AS MATERIALIZED (SELECT i, d AS core FROM dist QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) = 4),\n", "")
    + """ SELECT p.id, CASE WHEN p.label < 0 THEN -1 WHEN o.n <= 2 THEN p.label ELSE b.label END::INT AS label, round(CASE WHEN p.label < 0 THEN 0 WHEN o.n <= 2 THEN p.probability ELSE (p.probability + b.branch_probability) / 2 END, 6) AS probability, p.label AS cluster_label, round(p.probability, 6) AS cluster_probability,
CASE WHEN p.label < 0 OR o.n <= 2 THEN 0 ELSE b.branch_label END AS branch_label, round(CASE WHEN p.label < 0 OR o.n <= 2 THEN 1 ELSE b.branch_probability END, 6) AS branch_probability FROM put p LEFT JOIN boff o ON o.g = p.label LEFT JOIN bres b ON b.id = p.neighbor"""
)
def predict_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(BranchDetector("full", min_cluster_size=5).fit(_fit(spark, sf_dir)).predict(_new(spark, sf_dir)))


@query(_branch_sql("core") + " SELECT p.id AS parent, q.id AS child, round(e.lens, 6) AS centrality, round(e.mr, 6) AS mutual_reachability, e.g::INT AS component, round(1 / (1 + e.mr), 6) AS weight FROM bgraph e JOIN pts p ON p.k = e.i JOIN pts q ON q.k = e.j")
def branch_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(exports.approximation_graph(BranchDetector("core", min_cluster_size=5).fit(_fit(spark, sf_dir)))[1])


@query(E.model("noisy", 1.0) + ", " + E.PLOT + " " + E.BARS)
def plot_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(exports.plot_data(_fit(spark, sf_dir, 1.0))[0])


@query(E.model("noisy", 1.0) + ", " + E.PLOT + " " + E.LINES)
def plot_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(exports.plot_data(_fit(spark, sf_dir, 1.0))[1])


@query(E.model("noisy", 1.0) + ", " + E.PLOT + " " + E.BOUNDS)
def plot_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(exports.plot_data(_fit(spark, sf_dir, 1.0))[2])


@query(E.model("blobs", 4.0, upto="link") + " SELECT node AS parent, unnest([lft, rgt]) AS child, round(w, 6) AS weight FROM link")
def linkage_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(exports.linkage_graph(_fit(spark, sf_dir))[1])


@query(E.model("noisy", 1.0, upto="condensed") + " SELECT parent, child, round(lam, 6) AS weight FROM cond")
def condensed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(exports.condensed_graph(_fit(spark, sf_dir, 1.0))[1])


@query(_PUT)
def stream_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New points read as a stream and placed in the frozen model."""
    import uuid

    from moraine.streaming.scoring import score_stream

    model, new = _overlap(spark, sf_dir)
    where = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    new.write.parquet(f"{where}/in")
    stream = spark.readStream.schema("id long, features array<double>").parquet(f"{where}/in")
    score_stream(stream, Predictor(model), f"{where}/out", f"{where}/log").awaitTermination()
    return rounded(spark.read.parquet(f"{where}/out").select("id", "label", "probability", "neighbor"))


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: hourly counts, as a table; the same plan runs on a stream."""
    from moraine.streaming.scoring import windowed_counts

    out = windowed_counts(inputs.table(spark, sf_dir, "events"), "ts", "event_type")
    return out.select("start", "event_type", "n", r6("mean").alias("mean"))


@query(E.model("noisy", 1.0, mcs=15) + _RESULT)
def stored_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model written, read again and selected from anew."""
    import uuid

    from moraine.sources.store import load_model, save_model

    where = f"{scratch_dir(spark)}/model-{uuid.uuid4().hex}"
    save_model(_fit(spark, sf_dir, 1.0), where)
    return rounded(load_model(spark, where).refit(min_cluster_size=15).result)
