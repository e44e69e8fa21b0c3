"""Whitening of vectors by spectrum slicing.

Entries are quantised to integers, so the moments of the fit list (each distinct
vector once) are exact sums of longs, whatever the order of the tasks.  The
covariance has the size of the dimensions squared, and its leading spectrum is
found without a full decomposition:

- *slices*: the LDLᵀ factors of ``V - s I`` have as many positive pivots as
  ``V`` has eigenvalues above ``s`` (Sylvester's law of inertia).  Bisection on
  such counts closes in on the j-th largest eigenvalue until a slice holds it
  alone.
- *Rayleigh quotient iteration* in that slice converges cubically; a quotient
  that leaves the slice makes it be halved again.
- *certificate*: the counts on both sides of the found value must number it j.
  Eigenvalues that no slice can part (ties) get an orthonormal basis.

The projection of all rows and the covariance of the whitened fit list are Spark
jobs again.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from judgefuse.llm.common import checkpoint

SCALE, SHIFT = 64, 1_000_000


# ---- the spectrum, on a matrix of dimensions squared -------------------------------------------------
def above(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric ``a`` exceed ``shift``: the positive
    pivots of an LDLᵀ factorisation of ``a - shift I`` with Bunch-Kaufman pivoting."""
    m = a - shift * np.eye(len(a))
    alpha, positive, k, n = (1 + 17 ** 0.5) / 8, 0, 0, len(a)
    while k < n:
        col = np.abs(m[k + 1:, k])
        most = col.max() if len(col) else 0.0
        size, step = 1, None
        if max(abs(m[k, k]), most) == 0:
            k += 1
            continue          # a zero pivot: an eigenvalue at the shift itself
        if abs(m[k, k]) < alpha * most:
            r = k + 1 + int(col.argmax())
            row = np.abs(m[k:, r])
            row[r - k] = 0
            other = row.max()
            if abs(m[k, k]) * other >= alpha * most * most:
                step = None
            elif abs(m[r, r]) >= alpha * other:
                step = (k, r)
            else:
                size, step = 2, (k + 1, r)
        if step and step[0] != step[1]:
            i, j = step
            m[[i, j]] = m[[j, i]]
            m[:, [i, j]] = m[:, [j, i]]
        if size == 1:
            d = m[k, k]
            positive += d > 0
            c = m[k + 1:, k].copy()
            m[k + 1:, k + 1:] -= np.outer(c, c / d)
        else:
            d = m[k:k + 2, k:k + 2].copy()
            positive += 1     # such a block has a negative determinant: one eigenvalue of each sign
            c = m[k + 2:, k:k + 2].copy()
            m[k + 2:, k + 2:] -= c @ np.linalg.solve(d, c.T)
        k += size
    return int(positive)


class Spectrum:
    """Leading eigenpairs of a symmetric matrix, numbered by inertia counts."""

    def __init__(self, a: np.ndarray):
        self.a, self.n = a, len(a)
        self.norm = float(np.abs(a).sum(1).max()) if len(a) else 0.0     # no eigenvalue is larger
        self.tiny = 4 * np.finfo(float).eps * self.norm * max(1, self.n)
        self.counts: dict[float, int] = {self.norm + self.tiny: 0, -self.norm - self.tiny: self.n}

    def count(self, s: float) -> int:
        if s not in self.counts:
            self.counts[s] = above(self.a, s)
        return self.counts[s]

    def slice_of(self, j: int) -> tuple[float, float]:
        """The narrowest counted slice (low, high] that holds the j-th largest eigenvalue."""
        low = max(s for s, c in self.counts.items() if c >= j)
        high = min(s for s, c in self.counts.items() if c < j and s > low)
        return low, high

    def eigenpairs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(values, vectors as rows) of the ``k`` largest eigenvalues that are above zero
        by more than rounding; fewer if the matrix has fewer."""
        values, vectors = [], []
        k = min(k, self.count(self.tiny) if self.norm else 0)
        while len(values) < k:
            j = len(values) + 1
            low, high = self.slice_of(j)
            while self.counts[low] - self.counts[high] > 1 and high - low > self.tiny:
                self.count((low + high) / 2)
                low, high = self.slice_of(j)
            tied = self.counts[low] - self.counts[high]
            if tied == 1:
                value, vector = self.alone(j)
                values.append(value)
                vectors.append(vector)
                continue
            for value, vector in self.together(low, high, tied):   # ties
                values.append(value)
                vectors.append(vector)
        return np.array(values[:k]), np.array(vectors[:k]).reshape(-1, self.n)

    def solve(self, shift: float, x: np.ndarray) -> np.ndarray:
        m = self.a - shift * np.eye(self.n)
        try:
            y = np.linalg.solve(m, x)
        except np.linalg.LinAlgError:     # the shift is the eigenvalue to the last bit
            y = np.linalg.solve(m + self.tiny / self.n * np.eye(self.n), x)
        return y / np.linalg.norm(y)

    def alone(self, j: int) -> tuple[float, np.ndarray]:
        """The pair of the j-th eigenvalue, which is alone in its slice."""
        while True:
            low, high = self.slice_of(j)
            x = self.solve((low + high) / 2, np.random.default_rng(j).standard_normal(self.n))
            x = self.solve((low + high) / 2, x)      # nearer to this slice's vector than to any other
            best, left = None, np.inf
            for _ in range(50):
                value = float(x @ self.a @ x)
                if not low - self.tiny <= value <= high + self.tiny:
                    best = None
                    break
                rest = float(np.linalg.norm(self.a @ x - value * x))
                if rest >= left:                      # no gain any more: rounding is reached
                    break
                best, left = (value, x), rest
                x = self.solve(value, x)
            if best and left <= 64 * self.tiny and self.numbered(j, best[0]):
                return best
            if high - low <= self.tiny:
                return best or (float(x @ self.a @ x), x)
            self.count((low + high) / 2)              # halve the slice and start again

    def numbered(self, j: int, value: float) -> bool:
        """The counts around a value say that it is the j-th."""
        wide = 64 * self.tiny
        return self.count(value + wide) < j <= self.count(value - wide)

    def together(self, low: float, high: float, n: int) -> list[tuple[float, np.ndarray]]:
        """``n`` eigenvalues that no slice parts: subspace iteration at their place."""
        q = np.linalg.qr(np.random.default_rng(n).standard_normal((self.n, n)))[0]
        shift = (low + high) / 2
        for _ in range(4):
            q = np.linalg.qr(np.column_stack([self.solve(shift, c) for c in q.T]))[0]
        small, turn = np.linalg.eigh(q.T @ self.a @ q)
        return [(float(v), q @ t) for v, t in zip(small[::-1], turn.T[::-1])]


# ---- the jobs --------------------------------------------------------------------------------------
def quantised(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, x): rows whose vector is neither null nor empty and has finite entries only."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = df.filter(F.col(vector).isNotNull() & (F.size(vector) > 0) & fine)
    return rows.select(F.col(key), F.transform(v, lambda c: F.floor(c * SCALE).cast("long") + SHIFT).alias("__x"))


def moments(fit: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, S, n² V) of the distinct vectors: exact Python integers in object arrays.

    Vectors are centred at the rounded mean before they are multiplied; sums of
    longs are exact, and the rest of a unit that rounding leaves is taken off in
    whole numbers.
    """
    import pyarrow as pa

    first = fit.select(F.posexplode("__x").alias("i", "c")).groupBy("i").agg(F.sum("c").alias("s"), F.count("c").alias("n")).collect()
    if not first:
        return 0, np.zeros(0, object), np.zeros((0, 0), object)
    total = np.array([r.s for r in sorted(first, key=lambda r: r.i)], object)
    n, d = first[0].n, len(first)
    centre = np.array([int((2 * s + n) // (2 * n)) for s in total], np.int64)

    def products(batches):
        gram, used = np.zeros((d, d), np.int64), 0
        upper = np.triu_indices(d)

        def out():
            return pa.RecordBatch.from_arrays([pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()),
                                               pa.array(gram[upper], pa.int64())], names=["i", "j", "p"])
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(-1, d) - centre
            for rows in np.array_split(x, -(-len(x) // 4096)) if len(x) else []:
                top = int(np.abs(rows).max())
                if top * top * (used + len(rows)) >= 1 << 62:
                    raise OverflowError("entries are too large for exact sums of longs")
                gram += rows.T @ rows
            used += len(x)
        if used:
            yield out()

    sums = fit.select("__x").mapInArrow(products, "i int, j int, p long").groupBy("i", "j").agg(F.sum("p").alias("p")).collect()
    gram = np.zeros((d, d), object)
    for r in sums:
        gram[r.i, r.j] = gram[r.j, r.i] = r.p
    rest = total - n * centre.astype(object)          # sum of the centred vectors: below n / 2 in every dimension
    return n, total, n * gram - np.outer(rest, rest)


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 16) -> DataFrame:
    """One row per usable row of ``df`` and component: key, component (from 1), n,
    deviation, whitened, explained, identity_error.

    Rows with a null or empty vector, or one with a null or non-finite entry,
    have no result; nor have vectors of another length than most have (of equally
    frequent lengths the longest counts).  Repeated rows and rows without a key
    are rows like others; a repeated vector counts once in the fit.  There are
    fewer components where the covariance has fewer eigenvalues above zero
    (none for a single distinct vector), and no rows for an empty table.  Equal
    eigenvalues get any orthonormal basis.  Other columns are ignored.  Entries
    whose sums exceed a long end the job with an error.
    """
    import pyarrow as pa

    kind = df.select(key).schema[0].dataType.simpleString()
    out = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = quantised(df, key, vector)
    sizes = rows.groupBy(F.size("__x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not sizes:
        return df.sparkSession.createDataFrame([], out)
    d = sizes[0].d
    rows = rows.filter(F.size("__x") == d)
    fit = checkpoint(rows.select("__x").distinct())
    n, total, scaled = moments(fit)
    square = n * n
    cov = np.array([[float(v) / square if abs(v) < 1 << 1000 else v / square for v in line] for line in scaled])
    values, vectors = Spectrum(cov).eigenpairs(components)
    if not len(values):
        return df.sparkSession.createDataFrame([], out)
    trace = float(np.trace(cov))
    project = vectors.T / np.sqrt(values)              # dimensions x components
    whole = np.array([int(s // n) for s in total], np.int64)
    part = np.array([float((s % n)) / n for s in total])

    def coordinates(x: np.ndarray) -> np.ndarray:
        return ((x - whole) - part) @ project

    k = len(values)

    def spread(batches):
        sums, outer, any_ = np.zeros(k), np.zeros((k, k)), False
        for batch in batches:
            w = coordinates(batch.column(0).flatten().to_numpy().reshape(-1, d))
            sums, outer, any_ = sums + w.sum(0), outer + w.T @ w, True
        if any_:
            yield pa.RecordBatch.from_arrays([pa.array(range(k * k), pa.int32()), pa.array(outer.ravel()),
                                              pa.array(np.repeat(sums, k))], names=["at", "p", "s"])

    got = fit.mapInArrow(spread, "at int, p double, s double").groupBy("at").agg(F.sum("p").alias("p"), F.sum("s").alias("s")).collect()
    outer, mean = np.zeros(k * k), np.zeros(k * k)
    for r in got:
        outer[r.at], mean[r.at] = r.p / n, r.s / n
    mean = mean.reshape(k, k)[:, 0]
    error = float(np.abs(outer.reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())
    wide = [int(s) for s in total]
    explained = values / trace

    def apply(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, d)
            m = len(x)
            w = coordinates(x)
            away = float(np.abs((x - whole) * float(n)).max() + n) if m else 0.0
            if away * away * d < 1 << 62:
                off = n * (x - whole) - np.array([s - n * int(c) for s, c in zip(wide, whole)], np.int64)
                deviation = (off * off).sum(1)
            else:                                      # exact, and an error beyond a long
                deviation = [sum((n * int(c) - s) ** 2 for c, s in zip(row, wide)) for row in x.tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                 pa.array(np.full(m * k, n), pa.int64()), pa.array(np.repeat(np.array(deviation, object), k).tolist(), pa.int64()),
                 pa.array(w.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(apply, out)
