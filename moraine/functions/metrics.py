"""Distance metrics: as Spark expressions over two array columns, and as array kernels.

Both forms add up the dimensions in the same order, so that they agree to the last bit
wherever the JVM and numpy round alike.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Every name a metric can be asked for by, and the metric it means.
NAMES = {
    "euclidean": "euclidean",
    "l2": "euclidean",
    "minkowski": "minkowski",
    "p": "minkowski",
    "manhattan": "manhattan",
    "cityblock": "manhattan",
    "l1": "manhattan",
    "chebyshev": "chebyshev",
    "infinity": "chebyshev",
    "seuclidean": "seuclidean",
    "mahalanobis": "mahalanobis",
    "wminkowski": "wminkowski",
    "hamming": "hamming",
    "canberra": "canberra",
    "braycurtis": "braycurtis",
    "matching": "matching",
    "jaccard": "jaccard",
    "dice": "dice",
    "kulsinski": "kulsinski",
    "rogerstanimoto": "rogerstanimoto",
    "russellrao": "russellrao",
    "sokalmichener": "sokalmichener",
    "sokalsneath": "sokalsneath",
    "haversine": "haversine",
    "cosine": "cosine",
    "arccos": "arccos",
    "sqeuclidean": "sqeuclidean",
    "correlation": "correlation",
    "yule": "yule",
    "pyfunc": "pyfunc",
}
#: Metrics on truth values: any element that isn't zero is true.
BOOLEAN = {"matching", "jaccard", "dice", "kulsinski", "rogerstanimoto", "russellrao", "sokalmichener", "sokalsneath", "yule"}
#: Metrics for which a box around points bounds the distances to them.
BOXED = {"euclidean", "manhattan", "chebyshev", "minkowski", "seuclidean"}
#: Up to so many terms expressions are unrolled, so that they compile; beyond, they are lambdas:
#: generated code over 64 KB isn't compiled at all, and much below that compiling costs more than it saves.
UNROLL = 32


def valid_metric_ids(names: list) -> list[str]:
    """The names in ``names`` that are metrics' names (a class of metric stands for its names)."""
    return [n for n in NAMES if n in names or NAMES[n] in names]


def distance_metric(name: str | Callable, **kwargs) -> Metric:
    """The metric that computes distances by themselves: there "cosine" is the angle over pi, as "arccos" is."""
    return Metric("arccos" if name == "cosine" else name, **kwargs)


def fit_metric(name: str | Callable, **kwargs) -> Metric:
    """The metric of a fit: there "arccos" is 1 - cos, as "cosine" is."""
    return Metric("cosine" if name == "arccos" else name, **kwargs)


class Metric:
    """A distance metric. ``dim`` is needed for the unrolled expressions only.

    ``reduced`` is a cheaper number of the same order (the square, the p-th power), for
    ranking; ``to_distance`` and ``to_reduced`` convert.
    """

    def __init__(self, name: str | Callable = "euclidean", p: float | None = None, V=None, VI=None, w=None, func: Callable | None = None, **kwargs):
        if callable(name):
            name, func = "pyfunc", name
        if name not in NAMES:
            raise ValueError(f"unknown metric: {name!r}")
        self.asked, self.name, self.kwargs = name, NAMES[name], kwargs
        self.func, self.p, self.w, self.v, self.vi = func, p, w, V, VI
        if self.name == "pyfunc" and not callable(func):
            raise ValueError("the metric pyfunc needs a function")
        if self.name in ("minkowski", "wminkowski"):
            self.p = 2.0 if p is None else float(p)
            if self.p < 1:
                raise ValueError("p must be at least 1")
            if self.name == "minkowski":
                self.name = {1.0: "manhattan", 2.0: "euclidean", math.inf: "chebyshev"}.get(self.p, "minkowski")
            elif math.isinf(self.p) or w is None:
                raise ValueError("wminkowski needs a finite p and weights w")
        if self.name == "seuclidean":
            if V is None:
                raise ValueError("seuclidean needs the variances V")
            self.v = np.asarray(V, float).ravel()
        if self.name == "wminkowski":
            self.w = np.asarray(w, float).ravel()
            if (self.w < 0).any():
                raise ValueError("weights must not be negative")
        if self.name == "mahalanobis":
            if V is None and VI is None:
                raise ValueError("mahalanobis needs V or VI")
            self.vi = np.linalg.inv(np.asarray(V, float)) if VI is None else np.asarray(VI, float)
            if self.vi.ndim != 2 or self.vi.shape[0] != self.vi.shape[1]:
                raise ValueError("V or VI must be a square matrix")

    # -- Spark ---------------------------------------------------------------------------

    def _terms(self, a: Column, b: Column, dim: int | None, f: Callable[..., Column], consts: list[np.ndarray] = ()) -> Column:
        """Sum over the dimensions of ``f(x, y, *constants)``."""
        if dim is not None and dim <= (UNROLL // 4 if self.name in BOOLEAN or self.name in ("canberra", "braycurtis", "cosine", "arccos", "correlation") else UNROLL):
            parts = [f(a[i], b[i], *[F.lit(float(c[i])) for c in consts]) for i in range(dim)]
            return reduce(lambda s, t: s + t, parts, F.lit(0.0))
        if not consts:
            each = F.zip_with(a, b, f)
        else:
            pairs = F.arrays_zip(a.alias("x"), b.alias("y"), *[F.array(*[F.lit(float(v)) for v in c]).alias(f"c{k}") for k, c in enumerate(consts)])
            each = F.transform(pairs, lambda s: f(s["x"], s["y"], *[s[f"c{k}"] for k in range(len(consts))]))
        return F.aggregate(each, F.lit(0.0), lambda s, t: s + t)

    def _count(self, a: Column, b: Column, dim: int | None, f: Callable[[Column, Column], Column]) -> Column:
        return self._terms(a, b, dim, lambda x, y: F.when(f(x, y), 1.0).otherwise(0.0))

    def reduced(self, a: Column, b: Column, dim: int | None = None) -> Column:
        if self.name == "euclidean":
            return self._terms(a, b, dim, lambda x, y: (x - y) * (x - y))
        if self.name == "seuclidean":
            return self._terms(a, b, dim, lambda x, y, v: (x - y) * (x - y) / v, [self.v])
        if self.name == "minkowski":
            return self._terms(a, b, dim, lambda x, y: F.pow(F.abs(x - y), F.lit(self.p)))
        if self.name == "wminkowski":
            return self._terms(a, b, dim, lambda x, y, w: F.pow(w * F.abs(x - y), F.lit(self.p)), [self.w])
        if self.name == "mahalanobis":
            n = len(self.vi)
            diff = [a[i] - b[i] for i in range(n)]
            rows = [reduce(lambda s, t: s + t, [F.lit(float(self.vi[i, j])) * diff[j] for j in range(n)]) * diff[i] for i in range(n)]
            return reduce(lambda s, t: s + t, rows)
        return self.column(a, b, dim)

    def to_distance(self, r):
        """Distances (a column, number or array) from reduced ones."""
        root = F.sqrt if isinstance(r, Column) else np.sqrt
        power = F.pow if isinstance(r, Column) else np.power
        if self.name in ("euclidean", "seuclidean", "mahalanobis"):
            return root(r)
        if self.name in ("minkowski", "wminkowski"):
            return power(r, F.lit(1 / self.p) if isinstance(r, Column) else 1 / self.p)
        return r

    def to_reduced(self, d):
        if self.name in ("euclidean", "seuclidean", "mahalanobis"):
            return d * d
        if self.name in ("minkowski", "wminkowski"):
            return F.pow(d, F.lit(self.p)) if isinstance(d, Column) else np.power(d, self.p)
        return d

    def column(self, a: Column, b: Column, dim: int | None = None) -> Column:
        """The distance of two array columns of ``dim`` finite doubles each."""
        n = self.name
        size = F.lit(float(dim)) if dim else F.size(a).cast("double")
        zero = F.lit(0.0)
        if n in ("euclidean", "seuclidean", "minkowski", "wminkowski", "mahalanobis"):
            return self.to_distance(self.reduced(a, b, dim))
        if n == "sqeuclidean":
            return self._terms(a, b, dim, lambda x, y: (x - y) * (x - y))
        if n == "correlation":
            one = lambda f: self._terms(a, b, dim, f)
            sa, sb = one(lambda x, y: x), one(lambda x, y: y)
            p, q, pq = one(lambda x, y: x * x) - sa * sa / size, one(lambda x, y: y * y) - sb * sb / size, one(lambda x, y: x * y) - sa * sb / size
            return F.when(p * q > 0, 1 - pq / F.sqrt(p * q)).otherwise(zero)
        if n == "manhattan":
            return self._terms(a, b, dim, lambda x, y: F.abs(x - y))
        if n == "chebyshev":
            if dim is not None and dim <= UNROLL:
                parts = [F.abs(a[i] - b[i]) for i in range(dim)]
                return F.greatest(*parts) if dim > 1 else parts[0]
            return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
        if n == "hamming":
            return self._count(a, b, dim, lambda x, y: x != y) / size
        if n == "canberra":
            return self._terms(a, b, dim, lambda x, y: F.when(F.abs(x) + F.abs(y) > 0, F.abs(x - y) / (F.abs(x) + F.abs(y))).otherwise(zero))
        if n == "braycurtis":
            num, den = self._terms(a, b, dim, lambda x, y: F.abs(x - y)), self._terms(a, b, dim, lambda x, y: F.abs(x) + F.abs(y))
            return F.when(den > 0, num / den).otherwise(zero)
        if n == "haversine":
            s1, s2 = F.sin((a[0] - b[0]) * 0.5), F.sin((a[1] - b[1]) * 0.5)
            return 2 * F.asin(F.sqrt(s1 * s1 + F.cos(a[0]) * F.cos(b[0]) * s2 * s2))
        if n in ("cosine", "arccos"):
            dot, na, nb = (self._terms(u, v, dim, lambda x, y: x * y) for u, v in ((a, b), (a, a), (b, b)))
            cos = F.when(na * nb > 0, dot / F.sqrt(na * nb)).otherwise(zero)
            return 1 - cos if n == "cosine" else F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cos))) / F.lit(math.pi)
        if n in BOOLEAN:
            neq = self._count(a, b, dim, lambda x, y: (x != 0) != (y != 0))
            if n == "matching":
                return neq / size
            if n in ("rogerstanimoto", "sokalmichener"):
                return 2 * neq / (size + neq)
            if n == "jaccard":
                nnz = self._count(a, b, dim, lambda x, y: (x != 0) | (y != 0))
                return F.when(nnz > 0, neq / nnz).otherwise(zero)
            ntt = self._count(a, b, dim, lambda x, y: (x != 0) & (y != 0))
            if n == "yule":
                odd = self._count(a, b, dim, lambda x, y: (x != 0) & (y == 0))
                cross = odd * (neq - odd)
                return F.when(cross > 0, 2 * cross / (ntt * (size - ntt - neq) + cross)).otherwise(zero)
            if n == "russellrao":
                return (size - ntt) / size
            if n == "kulsinski":
                return (neq - ntt + size) / (neq + size)
            num, den = (neq, 2 * ntt + neq) if n == "dice" else (neq, 0.5 * ntt + neq)
            return F.when(den > 0, num / den).otherwise(zero)
        return self._udf()(a, b)

    def _udf(self):
        metric = self

        @F.arrow_udf("double")
        def distance(a, b):
            import pyarrow as pa

            return pa.array([metric.dist(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())

        return distance

    # -- arrays ----------------------------------------------------------------------------

    def dist(self, x, y) -> float:
        """The distance of two vectors."""
        return float(self.pairwise(np.asarray(x, float)[None], np.asarray(y, float)[None])[0, 0])

    def pairwise(self, x: np.ndarray, y: np.ndarray | None = None) -> np.ndarray:
        """Distances of all rows of ``x`` to all of ``y`` (``x`` itself by default)."""
        y = x if y is None else y
        if x.shape[1] != y.shape[1]:
            raise ValueError("the two sides differ in dimension")
        n, shape = self.name, (len(x), len(y))
        if n == "haversine" and x.shape[1] != 2:
            raise ValueError("haversine needs two dimensions, latitude and longitude in radians")

        def add(f) -> np.ndarray:
            total = np.zeros(shape)
            for j in range(x.shape[1]):
                total += f(x[:, j, None], y[None, :, j], j)
            return total

        if n == "pyfunc":
            out = np.empty(shape)
            for i, u in enumerate(x):
                for j, v in enumerate(y):
                    d = self.func(u, v, **self.kwargs)
                    if not isinstance(d, (float, int, np.floating, np.integer)):
                        raise TypeError("a metric must return a number")
                    out[i, j] = d
            return out
        if n == "euclidean":
            total, buf = np.zeros(shape), np.empty(shape)
            for j in range(x.shape[1]):
                np.subtract(x[:, j, None], y[None, :, j], out=buf)
                np.multiply(buf, buf, out=buf)
                total += buf
            return np.sqrt(total, out=total)
        if n == "sqeuclidean":
            return add(lambda a, b, j: (a - b) * (a - b))
        if n == "correlation":
            x, y = x - x.mean(1, keepdims=True), y - y.mean(1, keepdims=True)
            dot, norm = add(lambda a, b, j: a * b), (x * x).sum(1)[:, None] * (y * y).sum(1)[None]
            return np.where(norm > 0, 1 - dot / np.sqrt(np.where(norm > 0, norm, 1)), 0.0)
        if n == "seuclidean":
            return np.sqrt(add(lambda a, b, j: (a - b) * (a - b) / self.v[j]))
        if n == "manhattan":
            return add(lambda a, b, j: np.abs(a - b))
        if n == "chebyshev":
            return reduce(np.maximum, (np.abs(x[:, j, None] - y[None, :, j]) for j in range(x.shape[1])), np.zeros(shape))
        if n == "minkowski":
            return add(lambda a, b, j: np.abs(a - b) ** self.p) ** (1 / self.p)
        if n == "wminkowski":
            return add(lambda a, b, j: (self.w[j] * np.abs(a - b)) ** self.p) ** (1 / self.p)
        if n == "mahalanobis":
            d = x[:, None, :] - y[None, :, :]
            return np.sqrt(np.maximum(np.einsum("ijk,kl,ijl->ij", d, self.vi, d), 0))
        if n == "hamming":
            return add(lambda a, b, j: a != b) / x.shape[1]
        if n == "canberra":
            return add(lambda a, b, j: np.abs(a - b) / np.where((s := np.abs(a) + np.abs(b)) > 0, s, 1))
        if n == "braycurtis":
            num, den = add(lambda a, b, j: np.abs(a - b)), add(lambda a, b, j: np.abs(a) + np.abs(b))
            return np.where(den > 0, num / np.where(den > 0, den, 1), 0.0)
        if n == "haversine":
            s1, s2 = np.sin((x[:, 0, None] - y[None, :, 0]) * 0.5), np.sin((x[:, 1, None] - y[None, :, 1]) * 0.5)
            return 2 * np.arcsin(np.sqrt(s1 * s1 + np.cos(x[:, 0, None]) * np.cos(y[None, :, 0]) * s2 * s2))
        if n in ("cosine", "arccos"):
            dot, norm = add(lambda a, b, j: a * b), (x * x).sum(1)[:, None] * (y * y).sum(1)[None]
            cos = np.where(norm > 0, dot / np.sqrt(np.where(norm > 0, norm, 1)), 0.0)
            return 1 - cos if n == "cosine" else np.arccos(np.clip(cos, -1, 1)) / math.pi
        p, q, d = x != 0, y != 0, x.shape[1]
        ntt = p.astype(float) @ q.T.astype(float)
        neq = p.sum(1)[:, None] + q.sum(1)[None] - 2 * ntt
        if n == "yule":
            odd = p.sum(1)[:, None] - ntt
            cross = odd * (neq - odd)
            return np.where(cross > 0, 2 * cross / np.where(cross > 0, ntt * (d - ntt - neq) + cross, 1), 0.0)
        if n == "matching":
            return neq / d
        if n in ("rogerstanimoto", "sokalmichener"):
            return 2 * neq / (d + neq)
        if n == "russellrao":
            return (d - ntt) / d
        if n == "kulsinski":
            return (neq - ntt + d) / (neq + d)
        den = {"jaccard": neq + ntt, "dice": 2 * ntt + neq, "sokalsneath": 0.5 * ntt + neq}[n]
        return np.where(den > 0, neq / np.where(den > 0, den, 1), 0.0)

    # Euclidean distances of more than a few dimensions are first screened by one matrix
    # product; what may count is then computed as everywhere else, to the same last bit.

    def _screened(self, x: np.ndarray) -> bool:
        return self.name == "euclidean" and x.shape[1] > 4

    def rough(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
        """Distances of all rows of ``x`` to all of ``y``, each within the error given second (0: exact)."""
        if not self._screened(x) or not len(x) or not len(y):
            return self.pairwise(x, y), 0.0
        mean = y.mean(0)
        a, b = x - mean, y - mean
        a2, b2 = (a * a).sum(1), (b * b).sum(1)
        d = a @ b.T
        d *= -2
        d += a2[:, None]
        d += b2
        np.sqrt(np.maximum(d, 0, out=d), out=d)
        # |d'^2 - d^2| <= e implies |d' - d| <= sqrt(e).
        return d, float(np.sqrt(1e-14 * x.shape[1] * max(a2.max() + b2.max(), 1e-300)))

    def paired(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Distances of the rows of ``x`` to the same rows of ``y``; as :meth:`pairwise` makes them."""
        if self.name != "euclidean":
            return np.array([self.dist(u, v) for u, v in zip(x, y)])
        total = np.zeros(len(x))
        for j in range(x.shape[1]):
            d = x[:, j] - y[:, j]
            total += d * d
        return np.sqrt(total)

    def near_pairs(self, x: np.ndarray, y: np.ndarray, limit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of rows at most ``limit`` apart (a number, or one for each pair), and their distances."""
        d, error = self.rough(x, y)
        i, j = np.nonzero(d <= limit + error)
        if not error:
            return i, j, d[i, j]
        real = self.paired(x[i], y[j])
        ok = real <= (limit if np.isscalar(limit) else np.broadcast_to(limit, d.shape)[i, j])
        return i[ok], j[ok], real[ok]

    def from_one(self, point: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Distances of one point to points given as columns."""
        if self.name != "euclidean":
            return self.pairwise(point[None], columns.T)[0]
        d = columns - point[:, None]
        d *= d
        return np.sqrt(d.sum(0))  # rows are added in their order, as in pairwise

    def box_gap(self, low_a: np.ndarray, high_a: np.ndarray, low_b: np.ndarray, high_b: np.ndarray) -> np.ndarray:
        """A lower bound of the distances between two boxes (last axis: dimensions); 0 where none is known."""
        if self.name not in BOXED:
            return np.zeros(np.broadcast_shapes(low_a.shape, low_b.shape)[:-1])
        d = np.maximum(np.maximum(low_b - high_a, low_a - high_b), 0)
        if self.name == "manhattan":
            return d.sum(-1)
        if self.name == "chebyshev":
            return d.max(-1)
        if self.name == "minkowski":
            return (d**self.p).sum(-1) ** (1 / self.p)
        return np.sqrt((d * d / (self.v if self.name == "seuclidean" else 1)).sum(-1))
