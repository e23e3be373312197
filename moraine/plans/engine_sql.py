"""SQL of the hierarchy and of what is read off it, for the registered queries.

An independent statement of the operators over whole tables: recursive CTEs in place of kernels.
All steps work per group ``g``, so that one chain serves a whole model (one group) and
the branches of each of its clusters (a group per cluster).

A chain starts from ``pts(g, id, k)``, the points numbered 1.. per group, and ``pair(g, i, j, w)``,
the weighted edges i < j between such numbers.
"""

from __future__ import annotations

#: Minimum spanning tree (Prim from the first point; the order (w, i, j) makes it unique) and merges in the order (w, step).
_TREE = """
{p}num AS MATERIALIZED (SELECT g, count(*) AS n FROM {p}pts GROUP BY g),
{p}rk AS MATERIALIZED (SELECT g, i, j, w, row_number() OVER (PARTITION BY g ORDER BY w, i, j) AS r FROM {p}pair),
{p}sym AS (SELECT g, i, j, r FROM {p}rk UNION ALL SELECT g, j, i, r FROM {p}rk),
{p}m AS MATERIALIZED (SELECT a.g, a.k AS i, list(coalesce(s.r, 3000000000000) ORDER BY b.k) AS rs FROM {p}pts a JOIN {p}pts b ON a.g = b.g LEFT JOIN {p}sym s ON s.g = a.g AND s.i = a.k AND s.j = b.k GROUP BY a.g, a.k),
{p}prim(g, step, nxt, r, best) AS (
  SELECT g, 0::BIGINT, 1::BIGINT, 0::BIGINT, list_transform(rs, lambda v, k: CASE WHEN k = 1 THEN 4000000000000 ELSE v END) FROM {p}m WHERE i = 1
  UNION ALL
  SELECT o.g, o.step + 1, o.nx, o.nr, list_transform(o.best, lambda v, k: CASE WHEN v = 4000000000000 OR k = o.nx THEN 4000000000000 ELSE least(v, m.rs[k]) END)
  FROM (SELECT p.g, p.step, p.best, list_min(p.best) AS nr, list_position(p.best, list_min(p.best))::BIGINT AS nx FROM {p}prim p JOIN {p}num USING (g) WHERE p.step < n - 1) o
  JOIN {p}m m ON m.g = o.g AND m.i = o.nx),
{p}mst AS MATERIALIZED (SELECT p.g, p.step, CASE WHEN rk.i = p.nxt THEN rk.j ELSE rk.i END AS f, p.nxt AS t, rk.w FROM {p}prim p JOIN {p}rk rk ON rk.g = p.g AND rk.r = p.r WHERE p.step > 0),
"""

#: Single linkage: points are nodes 0..n-1, merge s makes node n + s - 1.
_LINK = """
{p}ord AS MATERIALIZED (SELECT g, row_number() OVER (PARTITION BY g ORDER BY w, step) AS s, f, t, w FROM {p}mst),
{p}agg(g, s, comp, lft, rgt) AS (
  SELECT g, 0::BIGINT, list_transform(range(n), lambda v: v::BIGINT), -1::BIGINT, -1::BIGINT FROM {p}num
  UNION ALL
  SELECT a.g, o.s, list_transform(a.comp, lambda c: CASE WHEN c = a.comp[o.f] OR c = a.comp[o.t] THEN n + o.s - 1 ELSE c END), a.comp[o.f], a.comp[o.t]
  FROM {p}agg a JOIN {p}ord o ON o.g = a.g AND o.s = a.s + 1 JOIN {p}num u ON u.g = a.g),
{p}link AS MATERIALIZED (SELECT a.g, n + a.s - 1 AS node, a.lft, a.rgt, o.w, len(list_filter(a.comp, lambda c: c = n + a.s - 1)) AS size FROM {p}agg a JOIN {p}ord o ON o.g = a.g AND o.s = a.s JOIN {p}num ON {p}num.g = a.g),
"""

#: The condensed tree, root first; clusters are numbered level by level of the linkage tree.
_CONDENSE = """
{p}sz AS (SELECT g, node, size FROM {p}link UNION ALL SELECT g, k - 1, 1 FROM {p}pts),
{p}kid AS MATERIALIZED (
  SELECT l.g, l.node AS up, unnest([l.lft, l.rgt]) AS node, unnest(['0', '1']) AS side, unnest([a.size, b.size]) AS size, CASE WHEN l.w > 0 THEN 1 / l.w ELSE 'inf'::DOUBLE END AS lam, a.size >= {mcs} AND b.size >= {mcs} AS both
  FROM {p}link l JOIN {p}sz a ON a.g = l.g AND a.node = l.lft JOIN {p}sz b ON b.g = l.g AND b.node = l.rgt),
{p}down(g, node, c, above, birth, fell, size, path) AS (
  SELECT g, max(node), max(node), -1::BIGINT, 0.0::DOUBLE, NULL::DOUBLE, max(size), '' FROM {p}link GROUP BY g
  UNION ALL
  SELECT d.g, h.node,
    CASE WHEN d.fell IS NULL AND h.size >= {mcs} AND h.both THEN h.node ELSE d.c END,
    CASE WHEN d.fell IS NULL AND h.size >= {mcs} AND h.both THEN d.c ELSE d.above END,
    CASE WHEN d.fell IS NULL AND h.size >= {mcs} AND h.both THEN h.lam ELSE d.birth END,
    CASE WHEN d.fell IS NOT NULL THEN d.fell WHEN h.size < {mcs} THEN h.lam END,
    h.size, CASE WHEN d.fell IS NULL THEN d.path || h.side ELSE '' END
  FROM {p}down d JOIN {p}kid h ON h.g = d.g AND h.up = d.node),
{p}born AS MATERIALIZED (SELECT d.g, node AS c, n + row_number() OVER (PARTITION BY d.g ORDER BY length(path), path) - 1 AS no, above, birth, size FROM {p}down d JOIN {p}num USING (g) WHERE fell IS NULL AND node = c),
{p}cl AS MATERIALIZED (SELECT b.g, b.no AS c, u.no AS up, b.birth, b.size FROM {p}born b LEFT JOIN {p}born u ON u.g = b.g AND u.c = b.above),
{p}drop AS MATERIALIZED (SELECT d.g, b.no AS c, d.node AS x, d.fell AS lam FROM {p}down d JOIN {p}born b ON b.g = d.g AND b.c = d.c JOIN {p}num ON {p}num.g = d.g WHERE d.node < n),
{p}cond AS MATERIALIZED (SELECT g, c AS parent, x AS child, lam, 1::BIGINT AS size FROM {p}drop UNION ALL SELECT g, up, c, birth, size FROM {p}cl WHERE up IS NOT NULL),
{p}stab AS MATERIALIZED (SELECT cl.g, cl.c, cl.up, cl.birth, cl.size, max(d.lam) AS death, sum((d.lam - cl.birth) * d.size) AS own FROM {p}cl cl JOIN {p}cond d ON d.g = cl.g AND d.parent = cl.c GROUP BY ALL),
{p}anc(g, c, a) AS (SELECT g, c, c FROM {p}cl UNION ALL SELECT n.g, n.c, cl.up FROM {p}anc n JOIN {p}cl cl ON cl.g = n.g AND cl.c = n.a WHERE cl.up IS NOT NULL),
{p}sub AS MATERIALIZED (SELECT n.g, n.a AS c, max(s.death) AS death FROM {p}anc n JOIN {p}stab s ON s.g = n.g AND s.c = n.c GROUP BY ALL),
"""

#: Excess of mass: from the last cluster to the first, sums of single precision move up.
_EOM = """
{p}ix AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY c) AS k FROM {p}stab),
{p}kl AS MATERIALIZED (SELECT a.g, a.k, a.up IS NULL AS top, CASE WHEN a.birth > 0 THEN 1 / a.birth ELSE 'inf'::DOUBLE END AS far, a.size, list(b.k) FILTER (b.k IS NOT NULL) AS ks FROM {p}ix a LEFT JOIN {p}ix b ON b.g = a.g AND b.up = a.c GROUP BY ALL),
{p}eom(g, step, w, keep) AS (
  SELECT g, max(k), list(own ORDER BY k), list(true ORDER BY k) FROM {p}ix GROUP BY g
  UNION ALL
  SELECT g, step - 1, list_transform(w, lambda v, i: CASE WHEN i = step AND bad THEN below ELSE v END), list_transform(keep, lambda v, i: CASE WHEN i = step THEN NOT bad ELSE v END)
  FROM (SELECT e.g, e.step, e.w, e.keep, x.below, (x.below > e.w[e.step] AND NOT isnan(x.below) AND NOT isnan(e.w[e.step])) OR (x.size > {cap} AND NOT top) OR (x.far > {far} AND NOT top) AS bad
    FROM {p}eom e JOIN (SELECT e2.g, e2.step, coalesce(list_sum(list_transform(kl.ks, lambda v: e2.w[v])), 0)::FLOAT::DOUBLE AS below, kl.size, kl.far, kl.top FROM {p}eom e2 JOIN {p}kl kl ON kl.g = e2.g AND kl.k = e2.step) x ON x.g = e.g AND x.step = e.step WHERE e.step >= 1)),
{p}kept AS MATERIALIZED (SELECT ix.g, ix.c FROM {p}eom e JOIN {p}ix ix ON ix.g = e.g WHERE e.step = 0 AND e.keep[ix.k] AND ({single} OR ix.up IS NOT NULL)),
{p}first AS MATERIALIZED (SELECT g, c FROM {p}kept k WHERE NOT EXISTS (SELECT 1 FROM {p}anc n JOIN {p}kept o ON o.g = n.g AND o.c = n.a WHERE n.g = k.g AND n.c = k.c AND n.a <> k.c)),
"""
_LEAF = """
{p}first AS MATERIALIZED (SELECT g, c FROM {p}cl WHERE up IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {p}cl o WHERE o.g = cl.g AND o.up = cl.c)),
"""

#: Clusters born below a distance give way to the first ancestor born above it.
_EPSILON = """
{p}top AS MATERIALIZED (
  SELECT f.g, f.c, 1 / cl.birth >= {eps} AS high, CASE WHEN 1 / cl.birth >= {eps} THEN f.c ELSE coalesce(
    (SELECT max(n.a) FROM {p}anc n JOIN {p}cl u ON u.g = n.g AND u.c = n.a WHERE n.g = f.g AND n.c = f.c AND u.up IS NOT NULL AND n.a <> f.c AND 1 / u.birth > {eps}),
    (SELECT min(n.a) FROM {p}anc n JOIN {p}cl u ON u.g = n.g AND u.c = n.a WHERE n.g = f.g AND n.c = f.c AND ({single} OR u.up IS NOT NULL))) END AS t
  FROM {p}first f JOIN {p}cl cl ON cl.g = f.g AND cl.c = f.c),
{p}pick AS MATERIALIZED (SELECT DISTINCT g, t AS c FROM {p}top o WHERE high OR NOT EXISTS (SELECT 1 FROM {p}top e JOIN {p}anc n ON n.g = e.g AND n.c = o.c AND n.a = e.t WHERE e.g = o.g AND e.c < o.c AND NOT e.high)),
"""
_NO_EPSILON = "{p}pick AS (SELECT g, c FROM {p}first),"

#: Labels, probabilities, outlier scores, persistence of the labels, exemplars.
_LABELS = """
{p}sel AS MATERIALIZED (SELECT g, c, (row_number() OVER (PARTITION BY g ORDER BY c) - 1)::INT AS label FROM {p}pick),
{p}own AS MATERIALIZED (SELECT n.g, n.c, max(n.a) AS a FROM {p}anc n JOIN {p}sel s ON s.g = n.g AND s.c = n.a GROUP BY ALL),
{p}lab AS MATERIALIZED (SELECT p.g, p.id, d.x, d.c, d.lam, CASE WHEN s.label IS NULL OR {lone} THEN -1 ELSE s.label END AS label, CASE WHEN s.label IS NULL OR {lone} THEN 0.0 WHEN t.death = 0 OR isinf(d.lam) THEN 1.0 ELSE least(d.lam, t.death) / t.death END AS probability
  FROM {p}pts p JOIN {p}drop d ON d.g = p.g AND d.x = p.k - 1 LEFT JOIN {p}own o ON o.g = d.g AND o.c = d.c LEFT JOIN {p}sel s ON s.g = o.g AND s.c = o.a LEFT JOIN {p}stab t ON t.g = o.g AND t.c = o.a),
{p}score AS (SELECT l.g, l.id, CASE WHEN b.death = 0 OR isinf(l.lam) THEN 0.0 ELSE (b.death - l.lam) / b.death END AS score FROM {p}lab l JOIN {p}sub b ON b.g = l.g AND b.c = l.c),
{p}persist AS (SELECT s.g, s.label, t.own / (count(l.id) * (SELECT max(lam) FROM {p}cond)) AS persistence FROM {p}sel s JOIN {p}stab t ON t.g = s.g AND t.c = s.c JOIN {p}lab l ON l.g = s.g AND l.label = s.label GROUP BY s.g, s.label, t.own),
{p}exem AS MATERIALIZED (SELECT l.g, s.label, l.id FROM {p}lab l JOIN {p}stab t ON t.g = l.g AND t.c = l.c AND t.death = l.lam JOIN {p}own o ON o.g = l.g AND o.c = l.c JOIN {p}sel s ON s.g = o.g AND s.c = o.a WHERE NOT EXISTS (SELECT 1 FROM {p}cl k WHERE k.g = l.g AND k.up = l.c)),
"""


def chain(mcs: int = 10, method: str = "eom", epsilon: float | str = 0.0, cap: int | None = None, far: float | None = None, single: bool = False, p: str = "", upto: str = "labels", between: str = "") -> str:
    """The CTEs from ``pts`` and ``pair`` on; ``p`` is put before all of their names, ``between`` before the distance of the selection."""
    parts = {"tree": [_TREE], "link": [_TREE, _LINK], "condensed": [_TREE, _LINK, _CONDENSE]}
    sql = parts.get(upto) or [*parts["condensed"], _EOM if method == "eom" else _LEAF, between, _EPSILON if epsilon else _NO_EPSILON, _LABELS]
    limit = "1e18" if cap is None else str(cap)
    # A lone root keeps the points at 1 / epsilon, or those as deep as its deepest row.
    lone = f"(s.c = (SELECT min(c) FROM {p}cl z WHERE z.g = s.g) AND (SELECT count(*) FROM {p}sel z WHERE z.g = s.g) = 1 AND d.lam < {1 / epsilon if epsilon else 't.death'})" if single else "false"
    return "".join(sql).format(lone=lone, p=p, mcs=mcs, eps=epsilon, cap=limit, far="'inf'::DOUBLE" if far is None else far, single=str(single).lower()).strip().rstrip(",")


def blobs(name: str, amplitude: float) -> str:
    return f"{name} AS MATERIALIZED (SELECT vec_id AS id, label, [embedding[1]::DOUBLE + {amplitude} * cos(2 * pi() * label / 10.0), embedding[2]::DOUBLE + {amplitude} * sin(2 * pi() * label / 10.0)] AS x FROM embeddings)"


def reach(table: str, k: int = 5, alpha: str = "1.0") -> str:
    """``pts`` and ``pair`` of one model: mutual reachability over all pairs of ``table(id, x)``."""
    return f"""pts AS MATERIALIZED (SELECT 0 AS g, id, row_number() OVER (ORDER BY id) AS k FROM {table}),
dist AS MATERIALIZED (SELECT p.k AS i, q.k AS j, list_distance(a.x, b.x) AS d FROM {table} a JOIN pts p ON p.id = a.id JOIN {table} b ON b.id <> a.id JOIN pts q ON q.id = b.id),
core AS MATERIALIZED (SELECT i, d AS core FROM dist QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) = {k}),
pair AS (SELECT 0 AS g, dist.i, dist.j, greatest(a.core, b.core, d / {alpha}) AS w FROM dist JOIN core a ON a.i = dist.i JOIN core b ON b.i = dist.j WHERE dist.i < dist.j)"""


def model(table: str, amplitude: float, **params) -> str:
    """All CTEs of a fit over the 2-D blobs."""
    return f"WITH RECURSIVE {blobs(table, amplitude)}, {reach(table)}, {chain(**params)}"


# -- what is read off a model ----------------------------------------------------------------------


def first_ids(source: str = "lab", extra: str = "") -> str:
    """Labels by the least id of their cluster; noise is null."""
    return f"SELECT id, CASE WHEN label >= 0 THEN min(id) OVER (PARTITION BY label) END AS first_id FROM {source} {extra}"


#: The re-cut to a number of clusters by stability: the largest distance that leaves so many.
def recut(n: int) -> str:
    return f"""
lev AS MATERIALIZED (SELECT DISTINCT 1 / birth - 1e-12 AS eps FROM cl WHERE up IS NOT NULL),
alt AS MATERIALIZED (SELECT lev.eps, f.c, 1 / cl.birth >= lev.eps AS high, CASE WHEN 1 / cl.birth >= lev.eps THEN f.c ELSE coalesce(
    (SELECT max(n.a) FROM anc n JOIN cl u ON u.c = n.a WHERE n.c = f.c AND u.up IS NOT NULL AND n.a <> f.c AND 1 / u.birth > lev.eps),
    (SELECT min(n.a) FROM anc n JOIN cl u ON u.c = n.a WHERE n.c = f.c AND u.up IS NOT NULL)) END AS t
  FROM lev CROSS JOIN first f JOIN cl ON cl.c = f.c),
left_ AS MATERIALIZED (SELECT eps, count(DISTINCT t) AS n FROM alt o WHERE high OR NOT EXISTS (SELECT 1 FROM alt e JOIN anc n ON n.c = o.c AND n.a = e.t WHERE e.eps = o.eps AND e.c < o.c AND NOT e.high) GROUP BY eps),
wanted AS MATERIALIZED (SELECT max(eps) AS eps FROM left_ WHERE n = {n}),
"""


#: New points: their nearest points of the model by mutual reachability, and the cluster they fall to.
PLACED = """{new},
near AS MATERIALIZED (SELECT q.id AS q, p.k, list_distance(q.x, b.x) AS d, row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.x, b.x), p.k) AS rank FROM fresh q CROSS JOIN {table} b JOIN pts p ON p.id = b.id QUALIFY rank <= 10),
core4 AS MATERIALIZED (SELECT i, d AS core FROM dist QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) = 4),
join_ AS MATERIALIZED (SELECT n.q, n.k, greatest(n.d, o.d, c.core) AS mr, min(n.d) OVER (PARTITION BY n.q) = 0 AS exact FROM near n JOIN near o ON o.q = n.q AND o.rank = 6 JOIN core4 c ON c.i = n.k QUALIFY row_number() OVER (PARTITION BY n.q ORDER BY greatest(n.d, o.d, c.core), n.rank) = 1),
met AS MATERIALIZED (SELECT j.q, l.id AS neighbor, l.c, l.lam AS nlam, CASE WHEN mr > 0 THEN 1 / mr ELSE 1.7976931348623157e308 END AS lam, exact FROM join_ j JOIN lab l ON l.x = j.k - 1),
fall AS MATERIALIZED (SELECT m.*, CASE WHEN nlam > lam THEN (SELECT max(n.a) FROM anc n JOIN cl ON cl.c = n.a WHERE n.c = m.c AND cl.birth < m.lam) ELSE m.c END AS at FROM met m),
put AS MATERIALIZED (SELECT f.q AS id, coalesce(s.label, -1) AS label, CASE WHEN s.label IS NULL THEN 0.0 WHEN t.death > 0 THEN least(t.death, f.lam) / t.death ELSE 1.0 END AS probability, f.neighbor FROM fall f LEFT JOIN own o ON o.c = f.at LEFT JOIN sel s ON s.c = o.a LEFT JOIN stab t ON t.c = o.a)"""

NEW_SCORES = "SELECT m.q AS id, round(CASE WHEN b.death = 0 THEN 0 ELSE (b.death - CASE WHEN exact THEN nlam ELSE lam END) / b.death END, 6) AS score FROM met m JOIN sub b ON b.c = m.c"

#: Soft memberships: nearness to exemplars times how late a point joins each cluster, times the chance to be in any.
_SOFT = """
hgt AS MATERIALIZED (SELECT y.c, s.label, s.c AS t, CASE WHEN EXISTS (SELECT 1 FROM anc n WHERE n.c = y.c AND n.a = s.c) THEN NULL ELSE
  (SELECT min(struct_pack(a := n.a, b := u.birth)).b FROM anc n JOIN cl u ON u.c = n.a WHERE n.c = y.c AND NOT EXISTS (SELECT 1 FROM anc o WHERE o.c = s.c AND o.a = n.a)) END AS h FROM cl y CROSS JOIN sel s),
exd AS MATERIALIZED (SELECT q.id, e.label, min(list_distance(q.x, b.x)) AS d FROM {asked} q CROSS JOIN exem e JOIN {table} b ON b.id = e.id GROUP BY ALL),
base AS MATERIALIZED (SELECT r.id, h.label, coalesce(h.h, r.lam) AS h, r.lam, t.death AS deep, z.death AS zdeath, x.d,
    CASE WHEN x.d > 0 THEN 1 / x.d ELSE 1.7976931348623157e308 / (SELECT count(*) FROM sel) END AS v
  FROM soft_rows r JOIN hgt h ON h.c = r.c JOIN stab t ON t.c = r.c JOIN stab z ON z.c = h.t JOIN exd x ON x.id = r.id AND x.label = h.label),
most AS MATERIALIZED (SELECT id, max(h) AS h, arg_max(zdeath, struct_pack(h := h, l := -label)) AS ahead FROM base GROUP BY id),
"""
#: Of training points: exp of exp(-(deepest + 1e-8) / height), both parts to the power 1.
ALL_MEMBERSHIPS = (
    """soft_rows AS (SELECT id, c, lam FROM lab),"""
    + _SOFT
    + """raw AS (SELECT *, exp(-(deep + 1e-8) / greatest(h, 1e-300)) AS u FROM base),
outl AS (SELECT *, exp(u - (SELECT max(u) FROM raw)) AS e FROM raw),
part AS (SELECT *, v / sum(v) OVER w * e / sum(e) OVER w AS y FROM outl WINDOW w AS (PARTITION BY id)),
soft AS (SELECT p.id, p.label, y / sum(y) OVER (PARTITION BY p.id) * m.h / greatest(p.lam, m.ahead) AS membership FROM part p JOIN most m USING (id))"""
)
#: Of new points: softmax of deepest / (deepest - height), squared, and the root of nearness.
NEW_MEMBERSHIPS = (
    """soft_rows AS (SELECT q AS id, c, least(lam, nlam) AS lam FROM met),"""
    + _SOFT
    + """raw AS (SELECT *, deep / CASE WHEN deep - h <= 0 THEN 1e-8 ELSE deep - h END AS u FROM base),
outl AS (SELECT *, exp(u - max(u) OVER (PARTITION BY id)) AS e FROM raw),
part AS (SELECT *, sqrt(v / sum(v) OVER w) * pow(e / sum(e) OVER w, 2) AS y FROM outl WINDOW w AS (PARTITION BY id)),
soft AS (SELECT p.id, p.label, y / sum(y) OVER (PARTITION BY p.id) * m.h / (greatest(p.lam, m.ahead) + 1e-8) AS membership FROM part p JOIN most m USING (id))"""
)

RELATIVE_VALIDITY = """ends AS (SELECT a.label AS la, b.label AS lb, m.w FROM mst m JOIN lab a ON a.x = m.f - 1 JOIN lab b ON b.x = m.t - 1),
sides AS (SELECT la, lb, w FROM ends UNION ALL SELECT lb, la, w FROM ends),
per AS (SELECT l.label, count(*) AS n, coalesce((SELECT max(w) FROM ends WHERE la = lb AND la = l.label), 0) AS sparse, (SELECT min(w) FROM sides WHERE la = l.label AND lb <> la AND lb >= 0) AS other, (SELECT min(w) FROM sides WHERE la = l.label AND lb < 0) AS noise FROM lab l WHERE label >= 0 GROUP BY l.label),
far AS (SELECT label, n, sparse, coalesce(other, CASE WHEN (SELECT count(*) FROM per) > 1 THEN noise END, 2 * (SELECT max(w) FROM mst)) AS sep FROM per)
SELECT round(sum(n / (SELECT count(*) FROM lab) * (sep - sparse) / greatest(sep, sparse)), 9) AS validity FROM far"""


def validity(table: str, amplitude: float) -> str:
    """The validity index per label of a table with labels: its own trees, their inner nodes and heaviest edges."""
    return f"""WITH RECURSIVE {blobs(table, amplitude)},
vd AS MATERIALIZED (SELECT a.id AS i, b.id AS j, a.label AS la, b.label AS lb, list_distance(a.x, b.x) AS d FROM {table} a JOIN {table} b ON a.id <> b.id),
vc AS MATERIALIZED (SELECT i AS id, pow(sum(pow(1 / d, 2)) FILTER (d > 0) / count(*), -0.5) AS core FROM vd WHERE la = lb GROUP BY i),
vpts AS MATERIALIZED (SELECT label AS g, id, row_number() OVER (PARTITION BY label ORDER BY id) AS k FROM {table}),
vpair AS (SELECT p.g, p.k AS i, q.k AS j, greatest(vd.d, a.core, b.core) AS w FROM vd JOIN vpts p ON p.id = vd.i JOIN vpts q ON q.id = vd.j JOIN vc a ON a.id = vd.i JOIN vc b ON b.id = vd.j WHERE la = lb AND p.k < q.k),
{chain(p="v", upto="tree")},
deg AS MATERIALIZED (SELECT g, k FROM (SELECT g, f AS k FROM vmst UNION ALL SELECT g, t FROM vmst) GROUP BY g, k HAVING count(*) > 1),
inner_ AS MATERIALIZED (SELECT p.g, p.id FROM deg JOIN vpts p ON p.g = deg.g AND p.k = deg.k),
kept_ AS MATERIALIZED (SELECT m.g, m.w FROM vmst m SEMI JOIN deg a ON a.g = m.g AND a.k = m.f SEMI JOIN deg b ON b.g = m.g AND b.k = m.t),
gap AS MATERIALIZED (SELECT la, lb, min(greatest(vd.d, a.core, b.core)) AS gap FROM vd JOIN vc a ON a.id = i JOIN vc b ON b.id = j WHERE la <> lb AND i IN (SELECT id FROM inner_) AND j IN (SELECT id FROM inner_) GROUP BY ALL),
per AS (SELECT t.label, count(*) AS size, coalesce((SELECT max(w) FROM kept_ WHERE g = t.label), (SELECT max(w) FROM vmst WHERE g = t.label)) AS sparseness, (SELECT min(gap) FROM gap WHERE la = t.label) AS separation FROM {table} t GROUP BY t.label)
"""


#: Branches: eccentricity within each cluster over its graph, then the same hierarchy per cluster.
def branches(method: str, mcs: int = 5, table: str = "blobs") -> str:
    graph = {
        "full": "bgraph AS MATERIALIZED (SELECT u.label AS g, dist.i, dist.j, greatest(u.lens, v.lens) AS lens, greatest(u.core, v.core, d) AS mr FROM dist JOIN mem u ON u.k = dist.i JOIN mem v ON v.k = dist.j JOIN radius r ON r.label = u.label WHERE u.label = v.label AND i < j AND d <= r.w)",
        "core": """bnear AS (SELECT least(i, j) AS i, greatest(i, j) AS j FROM (SELECT i, j FROM dist QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) <= 4) GROUP BY 1, 2),
bgraph AS MATERIALIZED (SELECT g, i, j, max(lens) AS lens, min(mr) AS mr FROM (
  SELECT u.label AS g, i, j, greatest(u.lens, v.lens) AS lens, greatest(u.core, v.core) AS mr FROM bnear JOIN mem u ON u.k = i JOIN mem v ON v.k = j WHERE u.label = v.label
  UNION ALL SELECT u.label, least(f, t), greatest(f, t), greatest(u.lens, v.lens), w FROM mst JOIN mem u ON u.k = f JOIN mem v ON v.k = t WHERE u.label = v.label) GROUP BY ALL)""",
    }[method]
    return f"""core4 AS MATERIALIZED (SELECT i, d AS core FROM dist QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) = 4),
centre AS (SELECT l.label, [sum(b.x[1] * probability) / sum(probability), sum(b.x[2] * probability) / sum(probability)] AS x FROM lab l JOIN {table} b USING (id) WHERE l.label >= 0 GROUP BY l.label),
mem AS MATERIALIZED (SELECT l.id, l.x + 1 AS k, l.label, l.probability, core4.core, CASE WHEN list_distance(c.x, b.x) > 0 THEN 1 / list_distance(c.x, b.x) ELSE 'inf'::DOUBLE END AS lens FROM lab l JOIN {table} b ON b.id = l.id JOIN centre c ON c.label = l.label JOIN core4 ON core4.i = l.x + 1),
radius AS (SELECT u.label, max(w) AS w FROM mst JOIN mem u ON u.k = f JOIN mem v ON v.k = t WHERE u.label = v.label GROUP BY u.label),
{graph},
bpts AS MATERIALIZED (SELECT label AS g, id, row_number() OVER (PARTITION BY label ORDER BY id) AS k, k AS at FROM mem),
bpair AS (SELECT p.g, p.k AS i, q.k AS j, e.lens AS w FROM bgraph e JOIN bpts p ON p.at = e.i JOIN bpts q ON q.at = e.j),
{chain(mcs=mcs, p="b")},
bcount AS MATERIALIZED (SELECT l.g, (SELECT count(*) FROM bsel s WHERE s.g = l.g) AS n, max((l.label < 0)::INT) AS noise FROM blab l GROUP BY l.g),
boff AS MATERIALIZED (SELECT g, n, noise, n <= 2 AS plain, coalesce(sum(CASE WHEN n <= 2 THEN 1 ELSE n + noise END) OVER (ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM bcount),
bres AS MATERIALIZED (SELECT l.id, CASE WHEN m.id IS NULL THEN -1 WHEN o.plain THEN o.before ELSE b.label + o.before + o.noise END::INT AS label,
    CASE WHEN m.id IS NULL OR o.plain THEN l.probability ELSE (l.probability + b.probability) / 2 END AS probability, l.label AS cluster_label, l.probability AS cluster_probability,
    CASE WHEN m.id IS NULL OR o.plain THEN 0 ELSE b.label END AS branch_label, CASE WHEN m.id IS NULL OR o.plain THEN 1.0 ELSE b.probability END AS branch_probability, coalesce(m.lens, 0.0) AS centrality
  FROM lab l LEFT JOIN mem m USING (id) LEFT JOIN blab b ON b.id = l.id LEFT JOIN boff o ON o.g = l.label)"""


BRANCH_ROWS = "SELECT id, label, round(probability, 6) AS probability, cluster_label, round(cluster_probability, 6) AS cluster_probability, branch_label, round(branch_probability, 6) AS branch_probability, round(centrality, 6) AS centrality FROM bres"

#: Plot data of a condensed tree: leaves in a row depth first, clusters at the mean of their two children, bars by steps.
PLOT = """walk(c, path, depth) AS (SELECT c, '', 0 FROM cl WHERE up IS NULL UNION ALL SELECT k.c, w.path || lpad(k.c::VARCHAR, 12, '0'), w.depth + 1 FROM walk w JOIN cl k ON k.up = w.c),
leaf_ AS MATERIALIZED (SELECT c, depth, row_number() OVER (ORDER BY path) - 1 AS place FROM walk w WHERE NOT EXISTS (SELECT 1 FROM cl k WHERE k.up = w.c)),
spot AS MATERIALIZED (SELECT n.a AS c, sum(l.place * pow(0.5, l.depth - w.depth)) AS place FROM anc n JOIN leaf_ l ON l.c = n.c JOIN walk w ON w.c = n.a GROUP BY n.a),
wide AS (SELECT sum(size) AS width FROM cond WHERE parent = (SELECT min(c) FROM cl)),
lev AS MATERIALIZED (SELECT parent AS c, lam, sum(size) AS lost, row_number() OVER (PARTITION BY parent ORDER BY lam) AS k FROM cond GROUP BY parent, lam),
lev2 AS MATERIALIZED (SELECT *, sum(lost) OVER w - coalesce(sum(lost) OVER (w ORDER BY lam ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS here, count(*) OVER w AS last_k, sum(lost) OVER w AS total FROM lev WINDOW w AS (PARTITION BY c)),
tot AS MATERIALIZED (SELECT l.c, l.last_k, l.total, (l.total - l.lost) / 20.0 AS step, l.lam AS top, s.place * (SELECT width FROM wide) AS x, cl.birth FROM lev2 l JOIN spot s ON s.c = l.c JOIN cl ON cl.c = l.c WHERE l.k = l.last_k),
bar(c, k, bottom, shown, last, fb, fh, fw) AS (
  SELECT t.c, 0::BIGINT, t.birth, t.total::DOUBLE, t.birth, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE FROM tot t
  UNION ALL
  SELECT c, nk, CASE WHEN out_ THEN last ELSE bottom END, CASE WHEN out_ THEN here ELSE shown END, lam, CASE WHEN out_ THEN bottom END, CASE WHEN out_ THEN lam - bottom END, CASE WHEN out_ THEN shown END
  FROM (SELECT b.*, l.k AS nk, l.lam, l.here::DOUBLE AS here, l.lam <> b.last AND (b.shown - l.here > t.step OR l.k = l.last_k) AS out_ FROM bar b JOIN lev2 l ON l.c = b.c AND l.k = b.k + 1 JOIN tot t ON t.c = b.c))"""
BARS = "SELECT b.c AS cluster, round(t.x, 6) AS center, round(fb, 6) AS bottom, round(fh, 6) AS height, round(fw, 6) AS width FROM bar b JOIN tot t ON t.c = b.c WHERE fb IS NOT NULL"
LINES = "SELECT cl.c AS cluster, round(u.x, 6) AS x0, round(t.x + sign(t.x - u.x) * cl.size / 2, 6) AS x1, round(cl.birth, 6) AS y FROM cl JOIN tot t ON t.c = cl.c JOIN tot u ON u.c = cl.up"
BOUNDS = 'SELECT c AS cluster, round(x - total / 2, 6) AS "left", round(x + total / 2, 6) AS "right", round(birth, 6) AS bottom, round(top, 6) AS top FROM tot'
