"""The hierarchy of one large tree on arrays: from the edges of a spanning tree to all artefacts.

The same results as the kernels of :mod:`moraine.operators.tree`, which suit many small trees; here
only the merges and the walks over them go node by node, on arrays of plain numbers; all rows are array operations.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np

from moraine.operators import tree as T

#: Numbers turned into Python's at a time.
_PIECE = 65_536


def _code(most: int) -> str:
    return "i" if most < 1 << 31 else "q"


def _ints(values: np.ndarray, most: int) -> array:
    """Whole numbers below ``most``, quick to read and write one by one, at 4 bytes each where that is enough."""
    out = array(_code(most))
    out.frombytes(np.ascontiguousarray(values, out.typecode).view(np.uint8).data)
    return out


def _view(numbers: array) -> np.ndarray:
    return np.frombuffer(numbers, numbers.typecode) if len(numbers) else np.empty(0, numbers.typecode)


def linkage(n: int, f: np.ndarray, t: np.ndarray) -> tuple[array, array, array]:
    """(left, right, size) of each merge, for edges in merge order; merge r makes node n + r; sizes are of all nodes."""
    m = len(f)
    up, size = _ints(np.arange(n + m), n + m), _ints(np.r_[np.ones(n), np.zeros(m)], n + m)
    left, right = _ints(np.zeros(m), n + m), _ints(np.zeros(m), n + m)
    for s in range(0, m, _PIECE):
        for r, x, y in zip(range(s, m), f[s : s + _PIECE].tolist(), t[s : s + _PIECE].tolist()):
            p = up[x]
            while p != x:
                up[x] = x = up[p]
                p = up[x]
            p = up[y]
            while p != y:
                up[y] = y = up[p]
                p = up[y]
            node = n + r
            up[x] = up[y] = node
            left[r] = x
            right[r] = y
            size[node] = size[x] + size[y]
    return left, right, size


def _layout(n: int, left: array, right: array, size: array) -> tuple[array, np.ndarray]:
    """(first place of every node, the nodes that are in no other): the points below a node are one stretch of places, its left side first."""
    m = len(left)
    inside = np.zeros(n + m, bool)
    inside[_view(left)] = inside[_view(right)] = True
    roots = np.flatnonzero(~inside)
    many = _view(size)[roots]
    start = np.zeros(n + m, np.int64)
    start[roots] = np.cumsum(many) - many
    start = _ints(start, n + m)
    for e in range(m, 0, -_PIECE):
        s = max(0, e - _PIECE)
        for node, x, y in zip(range(n + e - 1, n + s - 1, -1), left[s:e][::-1], right[s:e][::-1]):
            start[x] = k = start[node]
            start[y] = k + size[x]
    return start, roots


def prim_order(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(from, to, w) of a spanning tree's edges in the order in which Prim's method meets them from point 0.

    Prim's method, once within the part that an edge joins to another, sees all of it before it takes that edge, and then
    all of the other. So the order follows from the merges of the edges by rank, from the last one down: of the two sides of
    a merge, first the one with the point where the method came in, then the edge, then the other side from the edge's end.
    """
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((high, low, w))
    low, high, w = low[order], high[order], w[order]
    del order
    m = len(w)
    left, right, size = linkage(n, low, high)  # the left side has the edge's low end
    start, roots = _layout(n, left, right, size)
    place = _view(start)[:n]
    point = np.empty(n, place.dtype)
    point[place] = np.arange(n, dtype=place.dtype)
    least = np.minimum.reduceat(point, _view(start)[roots]) if n else point  # a forest has one start per tree
    del point
    roots, least = roots[np.argsort(least)], np.sort(least)
    came, first = np.zeros(n + m, place.dtype), np.zeros(n + m, place.dtype)  # per node the place where the method comes in, and the number of its first edge
    came[roots] = place[least]
    edges = _view(size)[roots] - 1
    first[roots] = np.cumsum(edges) - edges
    came, first, number, down = _ints(came, n + m), _ints(first, n + m), _ints(np.zeros(m), n + m), bytearray(m)
    for e in range(m, 0, -_PIECE):
        s = max(0, e - _PIECE)
        rows = left[s:e][::-1], right[s:e][::-1], place[low[s:e]][::-1].tolist(), place[high[s:e]][::-1].tolist()
        for r, x, y, of_x, of_y in zip(range(e - 1, s - 1, -1), *rows):
            v, k = came[n + r], first[n + r]
            if v >= start[y]:
                x, y, of_y = y, x, of_x
                down[r] = 1
            came[x], first[x] = v, k
            k += size[x]
            came[y], first[y] = of_y, k
            number[r] = k - 1
    del came, first, start, place, left, right, size
    picked = np.empty(m, np.int64)
    picked[_view(number)] = np.arange(m)
    up = np.frombuffer(down, np.uint8)[picked] == 0 if m else np.empty(0, bool)
    low, high = low[picked], high[picked]
    return np.where(up, low, high), np.where(up, high, low), w[picked]


def condense(n: int, left: array, right: array, size: array, w: np.ndarray, min_size: int) -> tuple[np.ndarray, ...]:
    """(parent, child, lambda, size) of the condensed tree's rows.

    Points are laid out so that the leaves below a node are one stretch; what falls out of a cluster is then a
    stretch, and the walk from the top only sees nodes of at least ``min_size`` points.
    """
    m = len(left)
    if not m:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
    start, _ = _layout(n, left, right, size)
    code = _code(n + m)
    # parent, first place of the stretch (or the child cluster), merge, number of points, whether it is a cluster
    parent, first, merge, many, cluster = array(code), array(code), array(code), array(code), bytearray()
    nodes, labels, fresh = array(code, [n + m - 1]), array(code, [n]), n + 1

    def out(label: int, x: int, r: int, points: int) -> None:
        parent.append(label)
        first.append(start[x])
        merge.append(r)
        many.append(points)
        cluster.append(0)

    for node, label in zip(nodes, labels):  # both grow meanwhile
        r = node - n
        x, y = left[r], right[r]
        of_x, of_y = size[x], size[y]
        if of_x < min_size:
            out(label, x, r, of_x)
            if of_y < min_size:
                out(label, y, r, of_y)
            else:
                nodes.append(y)
                labels.append(label)
        elif of_y < min_size:
            out(label, y, r, of_y)
            nodes.append(x)
            labels.append(label)
        else:
            for c, points in ((x, of_x), (y, of_y)):
                parent.append(label)
                first.append(fresh)
                merge.append(r)
                many.append(points)
                cluster.append(1)
                nodes.append(c)
                labels.append(fresh)
                fresh += 1
    del nodes, labels
    place = _view(start)[:n]
    leaf = np.empty(n, place.dtype)
    leaf[place] = np.arange(n, dtype=place.dtype)
    del place, start
    parent, first, merge, many, cluster = _view(parent), _view(first), _view(merge), _view(many), np.frombuffer(cluster, bool)
    times = np.where(cluster, 1, many)
    row = np.repeat(np.arange(len(parent), dtype=parent.dtype), times)
    child = first[row] + (np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)).astype(parent.dtype)
    is_cluster = cluster[row]
    child = np.where(is_cluster, child, leaf[np.where(is_cluster, 0, child)])
    with np.errstate(divide="ignore"):
        lam = np.where(w > 0, 1 / np.where(w > 0, w, 1), np.inf)[merge][row]
    return parent[row], child, lam, np.where(is_cluster, many[row], many.dtype.type(1))


def artefacts(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, p: dict) -> dict[str, dict[str, np.ndarray]]:
    """All tables of one tree, each as columns: ``mst``, ``linkage`` and, with selection parameters, ``condensed``, ``points``, ``clusters``."""
    return dict(tables(n, a, b, w, p))


def tables(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, p: dict) -> Iterator[tuple[str, dict[str, np.ndarray]]]:
    """The names and columns of :func:`artefacts`, one table at a time, so that they needn't all be held.

    Merge order is by weight, then by the place in Prim's order, which makes the result independent
    of how the tree was found.
    """
    whole = np.dtype(_code(2 * n))
    f, t, w = prim_order(n, np.asarray(a, whole), np.asarray(b, whole), np.asarray(w, float))
    del a, b
    yield "mst", {"a": f, "b": t, "n": np.arange(len(f), dtype=whole), "x": w}
    order = np.argsort(w, kind="stable")
    f, t, height = f[order], t[order], w[order]
    del order, w
    left, right, size = linkage(n, f, t)
    del f, t
    yield "linkage", {"a": np.arange(n, n + len(left), dtype=whole), "b": _view(left), "c": _view(right), "n": _view(size)[n:], "x": height}
    if "min_cluster_size" not in p:
        return
    if p["min_cluster_size"] < 2:
        rows = T.condense(n, list(zip(left, right, height.tolist(), size[n:])), p["min_cluster_size"])
        parent, child, lam, many = (np.array(c) for c in (rows.parent, rows.child, rows.lam, rows.size))
    else:
        parent, child, lam, many = condense(n, left, right, size, height, p["min_cluster_size"])
    del left, right, size, height
    if p.get("cluster_selection_persistence", 0.0) > 0:
        rows = T.simplify(T.Condensed(n, parent.tolist(), child.tolist(), lam.tolist(), many.tolist()), p["cluster_selection_persistence"])
        parent, child, lam, many = (np.array(c) for c in (rows.parent, rows.child, rows.lam, rows.size))
    parent, child, many, lam = parent.astype(whole, copy=False), child.astype(whole, copy=False), many.astype(whole, copy=False), lam.astype(float, copy=False)
    yield "condensed", {"a": parent, "b": child, "n": many, "x": lam}
    yield from _selected(n, parent, child, lam, many, p).items()


def _selected(n: int, parent: np.ndarray, child: np.ndarray, lam: np.ndarray, many: np.ndarray, p: dict) -> dict:
    single, epsilon, strict = p["allow_single_cluster"], p["cluster_selection_epsilon"], p["match_reference_implementation"]
    inner, point = np.flatnonzero(many > 1), np.flatnonzero(many == 1)
    k = int(parent.max()) - n + 1 if len(parent) else 1
    k = max(k, int(child[inner].max()) - n + 1 if len(inner) else 1)
    birth, up, total = np.zeros(k), np.full(k, -1, np.int64), np.full(k, n, np.int64)
    birth[child[inner] - n], up[child[inner] - n], total[child[inner] - n] = lam[inner], parent[inner], many[inner]
    death, weight = np.zeros(k), np.zeros(k)
    if len(parent):
        np.maximum.at(death, parent - n, lam)
        with np.errstate(invalid="ignore"):
            weight = np.bincount(parent - n, (lam - birth[parent - n]) * many, k)
    below = death.copy()
    for c in range(k - 1, 0, -1):  # parents have smaller numbers
        below[up[c] - n] = max(below[up[c] - n], below[c])
    skeleton = T.Condensed(n, parent[inner].tolist(), child[inner].tolist(), lam[inner].tolist(), many[inner].tolist(), float(lam.min()) if len(lam) else None)
    sums = {n + c: float(v) for c, v in enumerate(weight.tolist())} if len(parent) else {}
    chosen = T.select(skeleton, sums, p["cluster_selection_method"], single, epsilon, p["max_cluster_size"], p["cluster_selection_epsilon_max"])
    number, own = np.full(k, -1, np.int64), np.full(k, -1, np.int64)
    number[np.array(chosen, np.int64) - n] = np.arange(len(chosen))
    for c, top in T.owners(skeleton, chosen).items():
        own[c - n] = top - n
    of = own[parent[point] - n] if len(point) else np.empty(0, np.int64)
    at, who = lam[point], child[point]
    keep = of >= 0
    lone = len(chosen) == 1 and single
    root = of == 0
    keep &= ~root | (lone & (at >= (1 / epsilon if epsilon else death[0])))
    if strict:
        keep &= root | (at > birth[of])
    label, prob, score = np.full(n, -1, np.int64), np.zeros(n), np.zeros(n)
    label[who[keep]] = number[of[keep]]
    d = death[of[keep]]
    with np.errstate(invalid="ignore", divide="ignore"):
        prob[who[keep]] = np.where((d == 0) | np.isinf(at[keep]), 1.0, np.minimum(at[keep], d) / d)
        d = below[parent[point] - n] if len(point) else np.empty(0)
        score[who] = np.where((d == 0) | np.isinf(at), 0.0, (d - at) / d)
    left, when = np.full(n, n, np.int64), np.zeros(n)
    left[who], when[who] = parent[point], at
    cluster = np.arange(k) if len(parent) else np.empty(0, np.int64)
    return {
        "points": {"a": np.arange(n), "b": label, "c": left, "x": prob, "y": score, "z": when},
        "clusters": {"a": n + cluster, "b": number[cluster], "c": up[cluster], "n": total[cluster], "x": birth[cluster], "y": death[cluster], "z": weight[cluster], "u": below[cluster]},
    }
