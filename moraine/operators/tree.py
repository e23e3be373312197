"""Hierarchy kernels: from the edges of a spanning tree to labels.

Sequential work over n - 1 rows, on plain Python lists, run in one task per tree
(or per component, or per cluster). Everything here is pure: no Spark. Points are
0..n-1; in a condensed tree the root is n and further clusters follow.
"""

from __future__ import annotations

import math
from collections import defaultdict, deque
from dataclasses import dataclass, field

import numpy as np

INF = math.inf


@dataclass
class Condensed:
    """Rows of a condensed tree over ``n`` points."""

    n: int
    parent: list = field(default_factory=list)
    child: list = field(default_factory=list)
    lam: list = field(default_factory=list)
    size: list = field(default_factory=list)
    least: float | None = None  # least lambda, where only the clusters' rows are held

    def add(self, parent: int, child: int, lam: float, size: int) -> None:
        self.parent.append(parent)
        self.child.append(child)
        self.lam.append(lam)
        self.size.append(size)

    def rows(self):
        return zip(self.parent, self.child, self.lam, self.size)

    def clusters(self) -> list:
        """Rows whose child is a cluster."""
        return [r for r in self.rows() if r[3] > 1]

    def children(self) -> dict:
        """Cluster to its child clusters."""
        kids = defaultdict(list)
        for p, c, _, _ in self.clusters():
            kids[p].append(c)
        return kids


def inverse(distance: float) -> float:
    """Density level of a distance; +inf at distance zero."""
    return 1.0 / distance if distance > 0 else INF


def prim_order(n: int, edges: list) -> list:
    """The edges of a spanning tree in the order Prim's method meets them from point 0.

    ``edges``: (a, b, w) over 0..n-1. Ties go to the smaller (w, low, high) edge. The
    position in this order is the canonical tie key of the hierarchy.
    """
    import heapq

    near = defaultdict(list)
    for a, b, w in edges:
        near[a].append((w, min(a, b), max(a, b), b))
        near[b].append((w, min(a, b), max(a, b), a))
    seen, order = bytearray(n), []
    for first in range(n):  # a forest has one start per tree
        if seen[first]:
            continue
        seen[first] = 1
        heap = list(near[first])
        heapq.heapify(heap)
        while heap:
            w, lo, hi, to = heapq.heappop(heap)
            if not seen[to]:
                seen[to] = 1
                order.append((hi if to == lo else lo, to, w))
                for e in near[to]:
                    if not seen[e[3]]:
                        heapq.heappush(heap, e)
    return order


def find(up: list, x: int) -> int:
    while up[x] != x:
        up[x] = up[up[x]]
        x = up[x]
    return x


def agglomerate(n: int, edges: list) -> list:
    """Single linkage: (left, right, distance, size) per merge; row r makes node n + r.

    ``edges``: (a, b, w) in merge order.
    """
    up, size, merges = list(range(2 * n - 1)), [1] * n, []
    for a, b, w in edges:
        left, right, node = find(up, a), find(up, b), n + len(merges)
        up[left] = up[right] = node
        size.append(size[left] + size[right])
        merges.append((left, right, w, size[node]))
    return merges


def _leaves(node: int, n: int, merges: list) -> list:
    out, stack = [], [node]
    while stack:
        x = stack.pop()
        if x < n:
            out.append(x)
        else:
            stack += [merges[x - n][1], merges[x - n][0]]
    return out


def condense(n: int, merges: list, min_size: int) -> Condensed:
    """Keep the splits whose two sides have ``min_size`` points; smaller sides fall out as points."""
    tree = Condensed(n)
    if not merges:
        return tree
    count = lambda x: 1 if x < n else merges[x - n][3]
    todo, fresh = deque([(n + len(merges) - 1, n)]), n + 1
    while todo:
        node, label = todo.popleft()
        if node < n:
            continue
        left, right, distance, _ = merges[node - n]
        lam = inverse(distance)
        big = [count(x) >= min_size for x in (left, right)]
        for x, stays in zip((left, right), big):
            if not stays:
                for leaf in _leaves(x, n, merges):
                    tree.add(label, leaf, lam, 1)
            elif all(big):
                tree.add(label, fresh, lam, count(x))
                if x < n:  # only with min_size 1: a point can be a side of its own
                    tree.size[-1] = 1
                    tree.child[-1] = x
                else:
                    todo.append((x, fresh))
                    fresh += 1
            else:
                todo.append((x, label))
    return tree


def simplify(tree: Condensed, threshold: float) -> Condensed:
    """Collapse sibling clusters of too little persistence into their parent, bottom up.

    A pair goes when the smaller of its two deaths (largest lambda below) less the lambda
    of the split is under ``threshold``. Is the more persistent sibling without clusters
    of its own, so is the parent then; else its clusters are the parent's and the points of
    the other fall out at the split. Lambdas are compared in single precision.
    """
    f32 = np.float32
    rows = defaultdict(list)
    death: dict = defaultdict(lambda: f32(0))
    kids: dict = defaultdict(list)
    for p, c, lam, size in tree.rows():
        rows[p].append((c, lam, size))
        death[p] = max(death[p], f32(lam))
        if size > 1:
            kids[p].append((c, lam))
    for p in sorted(kids, reverse=True):
        pair = kids[p]
        if len(pair) != 2:
            continue
        split = f32(pair[0][1])
        if min(death[pair[0][0]], death[pair[1][0]]) - split < f32(threshold):
            keep, drop = sorted((c for c, _ in pair), key=lambda c: (-death[c], c))
            below = [(c, lam, s) for c, lam, s in rows[p] if s == 1]
            if keep in kids:
                gone, stack = [], [drop]
                while stack:
                    x = stack.pop()
                    gone += [c for c, _, s in rows[x] if s == 1]
                    stack += [c for c, _, s in rows[x] if s > 1]
                rows[p] = below + [(c, pair[0][1], 1) for c in gone] + rows[keep]
                kids[p] = kids[keep]
            else:
                rows[p] = below + rows[keep] + [r for r in rows[drop] if r[2] == 1]
                stack = [c for c, _, s in rows[drop] if s > 1]
                while stack:
                    x = stack.pop()
                    rows[p] += [r for r in rows[x] if r[2] == 1]
                    stack += [c for c, _, s in rows[x] if s > 1]
                del kids[p]
        if p in kids or rows[p]:
            death[p] = max([death[p], *(death[c] for c, _ in kids.get(p, []))])
    out, number, todo = Condensed(tree.n), {tree.n: tree.n}, deque([tree.n])
    live, order = [], [tree.n]
    while todo:
        p = todo.popleft()
        live.append(p)
        for c, _, s in rows[p]:
            if s > 1:
                order.append(c)
                todo.append(c)
    for i, c in enumerate(sorted(order)):
        number[c] = tree.n + i
    for p in sorted(live):
        for c, lam, s in rows[p]:
            out.add(number[p], number[c] if s > 1 else c, lam, s)
    return out


def stability(tree: Condensed) -> dict:
    """Per cluster the sum over its rows of (lambda - birth) * size."""
    birth: dict = {tree.n: 0.0}
    for _, c, lam, s in tree.rows():
        if s > 1:
            birth[c] = min(lam, birth.get(c, INF))
    out: dict = {tree.n: 0.0} if tree.parent else {}
    for p, _, lam, s in tree.rows():
        out[p] = out.get(p, 0.0) + (lam - birth[p]) * s
    return out


def deaths(tree: Condensed) -> dict:
    """Largest lambda among the direct rows of each cluster."""
    out: dict = {}
    for p, _, lam, _ in tree.rows():
        out[p] = max(out.get(p, 0.0), lam)
    return out


def subtree_deaths(tree: Condensed) -> dict:
    """Largest lambda anywhere below each cluster."""
    out = deaths(tree)
    for p, c, _, s in sorted(tree.clusters(), key=lambda r: -r[1]):
        out[p] = max(out[p], out.get(c, 0.0))
    return out


def descendants(kids: dict, node: int) -> list:
    out, stack = [], list(kids.get(node, []))
    while stack:
        x = stack.pop()
        out.append(x)
        stack += kids.get(x, [])
    return out


def leaf_clusters(tree: Condensed, node: int | None = None) -> list:
    """Clusters without clusters below ``node`` (the root by default), ``node`` included if it is one."""
    kids = tree.children()
    node = tree.n if node is None else node
    return sorted(c for c in [node, *descendants(kids, node)] if not kids.get(c))


def _climb(up: dict, birth: dict, c: int, epsilon: float, root: int, single: bool) -> int:
    """The first ancestor of ``c`` born at a distance above ``epsilon``."""
    while True:
        above = up[c]
        if above == root:
            return root if single else c
        if (1 / birth[above] if birth[above] < INF else 0.0) > epsilon:
            return above
        c = above


def merge_by_epsilon(tree: Condensed, chosen: list, epsilon: float, single: bool) -> set:
    """Replace clusters born below distance ``epsilon`` by the ancestor that reaches it."""
    clusters = tree.clusters()
    up, birth, kids = {c: p for p, c, _, _ in clusters}, {c: lam for _, c, lam, _ in clusters}, tree.children()
    out, done = set(), set()
    for c in sorted(chosen):
        if c not in up:  # the root
            out.add(c)
        elif (1 / birth[c] if birth[c] > 0 else INF) >= epsilon:
            out.add(c)
        elif c not in done:
            top = _climb(up, birth, c, epsilon, tree.n, single)
            out.add(top)
            done.update(descendants(kids, top), [top])
    return out


def select(tree: Condensed, weight: dict, method: str = "eom", single: bool = False, epsilon: float = 0.0, max_size: int = 0, epsilon_max: float = INF) -> list:
    """The selected clusters, ascending. ``weight`` (stabilities) is updated as sums move up.

    "eom": from the deepest cluster up, a cluster stays unless the clusters below have
    more stability together (in single precision), or it is over ``max_size`` points or
    born above distance ``epsilon_max``. "leaf": the clusters without clusters below.
    """
    if method not in ("eom", "leaf"):
        raise ValueError('cluster selection method must be "eom" or "leaf"')
    clusters, kids, root = tree.clusters(), tree.children(), tree.n
    if method == "leaf":
        chosen = [c for c in leaf_clusters(tree) if c != root]
        return sorted(merge_by_epsilon(tree, chosen, epsilon, single)) if chosen and epsilon else chosen
    size, born = {c: s for _, c, _, s in clusters}, {c: (1 / lam if 0 < lam < INF else (0.0 if lam else INF)) for _, c, lam, _ in clusters}
    nodes = sorted(weight, reverse=True)
    if not single:
        nodes = [c for c in nodes if c != root]
    else:
        size[root] = sum(s for p, _, _, s in clusters if p == root)
        low = min(tree.lam, default=0.0) if tree.least is None else tree.least
        born[root] = 1 / low if 0 < low < INF else (0.0 if low else INF)
    limit, kept = max_size or tree.n + 1, dict.fromkeys(nodes, True)
    for c in nodes:
        below = float(np.float32(sum(weight[k] for k in kids.get(c, []))))
        if below > weight[c] or size.get(c, 0) > limit or born.get(c, 0.0) > epsilon_max:
            kept[c] = False
            weight[c] = below
    chosen, under = [], set()
    for c in reversed(nodes):  # ancestors have smaller ids
        if kept[c] and c not in under:
            chosen.append(c)
        if kept[c] or c in under:
            under.update(kids.get(c, []))
    if epsilon and clusters:
        if chosen == [root]:
            return chosen if single else []
        return sorted(merge_by_epsilon(tree, chosen, epsilon, single))
    return chosen


def owners(tree: Condensed, chosen: list) -> dict:
    """Every cluster's nearest selected ancestor or itself; clusters without one are absent."""
    kids, out = tree.children(), {}
    for c in sorted(chosen):  # ancestors have smaller ids, so the nearest wins
        for k in [c, *descendants(kids, c)]:
            out[k] = c
    return out


@dataclass
class Labels:
    label: list
    probability: list
    clusters: list  # cluster of each label
    persistence: list


def labels(tree: Condensed, chosen: list, weight: dict, single: bool = False, epsilon: float = 0.0, strict: bool = False) -> Labels:
    """Labels 0.. in ascending cluster id, probabilities and persistence of the labels.

    A lone root keeps the points at lambda >= 1/``epsilon``, or without it those as
    deep as its deepest direct row. ``strict`` keeps only points deeper than the birth of
    their cluster.
    """
    number, own, death = {c: i for i, c in enumerate(chosen)}, owners(tree, chosen), deaths(tree)
    birth = {c: lam for _, c, lam, _ in tree.clusters()}
    label, prob, top = [-1] * tree.n, [0.0] * tree.n, max(tree.lam, default=0.0)
    for p, x, lam, s in tree.rows():
        if s > 1 or p not in own:
            continue
        c = own[p]
        if c == tree.n and len(chosen) == 1 and single:
            if lam < (1 / epsilon if epsilon else death[c]):
                continue
        elif c == tree.n and not (len(chosen) == 1 and single):
            continue
        elif strict and not lam > birth[c]:
            continue
        label[x] = number[c]
        d = death[c]
        prob[x] = 1.0 if d == 0 or lam == INF else min(lam, d) / d
    size = [0] * len(chosen)
    for x in label:
        if x >= 0:
            size[x] += 1
    score = [1.0 if top in (0, INF) or not size[i] else weight[c] / (size[i] * top) for i, c in enumerate(chosen)]
    return Labels(label, prob, list(chosen), score)


def outlier_scores(tree: Condensed) -> list:
    """(death - lambda) / death of each point, with the death of the subtree it left."""
    death, out = subtree_deaths(tree), [0.0] * tree.n
    for p, x, lam, s in tree.rows():
        if s == 1:
            d = death[p]
            out[x] = 0.0 if d == 0 or lam == INF else (d - lam) / d
    return out


def exemplars(tree: Condensed, chosen: list) -> list:
    """Per selected cluster, the points that stay longest in each leaf cluster below it."""
    kids, death, points = tree.children(), deaths(tree), defaultdict(list)
    for p, x, lam, s in tree.rows():
        if s == 1 and lam == death[p]:
            points[p].append(x)
    return [[x for leaf in sorted(k for k in [c, *descendants(kids, c)] if not kids.get(k)) for x in points[leaf]] for c in chosen]


def cut(n: int, edges: list, distance: float, min_size: int) -> list:
    """Labels of the components of all edges shorter than ``distance``; small ones are -1."""
    up = list(range(n))
    for a, b, w in edges:
        if w < distance:
            up[find(up, a)] = find(up, b)
    roots = [find(up, x) for x in range(n)]
    size = defaultdict(int)
    for r in roots:
        size[r] += 1
    number = {}
    for r in roots:
        if size[r] >= min_size:
            number.setdefault(r, len(number))
    return [number.get(r, -1) for r in roots]


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each point's component, by label spreading on arrays."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def spanning_forest(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
    """Borůvka on arrays: the indices of the minimum spanning forest's edges.

    Ties go to the edge given first, so give the edges in their tie order; without ``w`` that is their order altogether.
    """
    if w is not None:
        order = np.argsort(w, kind="stable")
        return np.sort(order[spanning_forest(n, np.asarray(a)[order], np.asarray(b)[order])])
    m = len(a)
    comp, live, picked = np.arange(n, dtype=a.dtype), np.arange(m), []
    while len(live):
        ca, cb = comp[a[live]], comp[b[live]]
        apart = ca != cb
        live, ca, cb = live[apart], ca[apart], cb[apart]
        if not len(live):
            break
        best = np.full(n, m, np.int64)
        np.minimum.at(best, ca, live)
        np.minimum.at(best, cb, live)
        new = np.unique(best[best < m])
        picked.append(new)
        del best, ca, cb, apart
        comp = components(n, comp[a[new]], comp[b[new]]).astype(a.dtype)[comp]
    return np.sort(np.concatenate(picked)) if picked else np.empty(0, np.int64)
