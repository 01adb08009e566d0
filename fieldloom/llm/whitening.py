"""Embedding whitening by spectral divide and conquer over QDWH polar decompositions.

1.  One pass over the table sums the vectors, a second one the products of their centred entries, in tasks, by block products. Only sums of the vectors' dimension
    meet: by dimension, then by pair of dimensions, so the driver gets a square of the dimension, whatever the number of rows.
2.  The covariance is split: the polar factor of the covariance less a shift, by QDWH's dynamically weighted Halley steps (each a QR decomposition), is the matrix sign; half of
    it and the identity is the projector on the eigenvectors above the shift. An orthonormal basis of each side turns the covariance into two blocks, which are split in
    turn until blocks are single numbers. Only sides that can hold one of the leading components are followed.
3.  Mean and scaled components (dimension times `components` numbers) are sent to all tasks, which project their rows. A third pass measures the whitened covariance.

Entries count as whole numbers x = floor(1024 c) + 100000. Edge cases: vectors that are null, empty or hold a null or an entry that isn't finite (or is beyond 2^42 in size, where x isn't exact) are dropped, and so are
vectors whose length isn't the commonest (of equally common ones the largest); components without variance, as all are for equal vectors, whiten to null; where the deviation is over what a long holds it is
null; repeated and null ids are rows of their own; a table without vectors gives an empty table; other columns pass through `whiten`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT, LARGEST = 1024, 100_000, float(1 << 42)
COMPONENTS, ROWS = 8, 4096
EPS = np.finfo(float).eps


# spectral divide and conquer of a symmetric matrix


def polar(a: np.ndarray, rounds: int = 40) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix: its sign. `low` is a bound of the smallest singular value that the weights go by; it may be too small."""
    x, low, n = a / max(np.linalg.norm(a), np.finfo(float).tiny), 1e-15, len(a)
    eye = np.eye(n)
    for _ in range(rounds):
        d = np.cbrt(4 * (1 - low * low) / low**4)
        wa = np.sqrt(1 + d) + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - low * low) / (low * low * np.sqrt(1 + d)))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))[0]
        new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * q[:n] @ q[n:].T
        new = (new + new.T) / 2
        low = min(1.0, low * (wa + wb * low * low) / (1 + wc * low * low))
        moved, x = np.linalg.norm(new - x), new
        if moved < 10 * EPS * np.sqrt(n) and low > 1 - 1e-8:
            break
    return x


def split(a: np.ndarray) -> tuple[np.ndarray, int] | None:
    """An orthonormal basis whose first columns span the eigenvectors above a shift, and their number; None if no shift parts the spectrum."""
    n = len(a)
    diagonal = np.sort(np.diag(a))
    for shift in (diagonal[(n - 1) // 2 : (n - 1) // 2 + 2].mean(), diagonal.mean(), *(diagonal[0] + (diagonal[-1] - diagonal[0]) * np.array([0.31, 0.67, 0.47, 0.83, 0.13]))):
        projector = (polar(a - shift * np.eye(n)) + np.eye(n)) / 2
        above = int(round(np.trace(projector)))
        if 0 < above < n and np.linalg.norm(projector @ projector - projector) < 1e-8 * n:
            noise = np.random.default_rng(n).normal(size=(n, n))
            upper = np.linalg.qr(projector @ noise[:, :above])[0]
            upper = np.linalg.qr(projector @ upper)[0]
            rest = noise[:, above:] - projector @ noise[:, above:]
            rest -= upper @ (upper.T @ rest)
            lower = np.linalg.qr(rest)[0]
            lower = np.linalg.qr(lower - upper @ (upper.T @ lower))[0]
            return np.hstack([upper, lower]), above
    return None


def leading(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and their unit eigenvectors as columns."""
    norm = np.linalg.norm(a)

    def parts(a: np.ndarray, basis: np.ndarray, k: int) -> list[tuple[float, np.ndarray]]:
        n = len(a)
        if n == 1:
            return [(float(a[0, 0]), basis[:, 0])]
        found = None
        if np.linalg.norm(a - np.trace(a) / n * np.eye(n)) > 4 * EPS * n * norm:
            found = split(a)
        if found is None:  # equal to rounding: any basis will do
            return [(float(a[j, j]), basis[:, j]) for j in np.argsort(-np.diag(a), kind="stable")]
        turn, above = found
        sides = []
        for columns, wanted in ((turn[:, :above], k), (turn[:, above:], k - above)):
            if wanted > 0:
                block = columns.T @ a @ columns
                sides += parts((block + block.T) / 2, basis @ columns, wanted)
        return sides

    if not len(a) or not norm:
        return np.zeros(min(k, len(a))), np.eye(len(a))[:, :k]
    vectors = np.array([v for _, v in parts(a, np.eye(len(a)), k)[:k]]).T
    vectors = np.linalg.qr(vectors)[0]  # columns stay what they are but for rounding
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


# over a table


@dataclass(frozen=True)
class Whitening:
    """n vectors with sums by dimension; `centre` is the whole number nearest to the mean; components are rows."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def centre(self) -> np.ndarray:
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], "i8")

    @property
    def offset(self) -> np.ndarray:
        """The mean less the centre, which is exact but for one rounding."""
        return np.array([(s - self.n * int(m)) / self.n for s, m in zip(self.sums, self.centre, strict=True)])

    @property
    def scaled(self) -> np.ndarray:
        """Components over their deviations; NaN without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            deviation = np.where(self.values > 8 * EPS * len(self.sums) * self.trace, np.sqrt(np.abs(self.values)), np.nan)
        return self.components / deviation[:, None]


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector has no null and only finite entries that make exact whole numbers."""
    fine = lambda x: x.isNotNull() & (F.abs(x.cast("double")) <= LARGEST)  # noqa: E731  NaN is over all numbers
    return df.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: F.coalesce(fine(x), F.lit(False))))


def whole(column: pa.Array, dim: int) -> np.ndarray:
    """x of a batch of vectors, as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("f8")
    return np.floor(SCALE * flat).astype("i8").reshape(-1, dim) + SHIFT


def chunks(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    return (b.slice(k, rows) for b in batches for k in range(0, b.num_rows, rows))


def dimension(df: DataFrame, vector: str) -> int:
    """The commonest length, the largest of those that are; 0 for an empty table."""
    top = df.groupBy(F.size(vector).alias("_d")).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), F.desc("_d")).first()
    return top["_d"] if top else 0


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """The whitening of a table whose rows are usable() and of one length."""
    dim = dimension(df, vector)
    if not dim:
        return Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros(dim, "O"), 0
        for batch in chunks(batches):
            sums, n = sums + whole(batch.column(0), dim).sum(0).astype("O"), n + batch.num_rows
        yield pa.RecordBatch.from_pydict({"i": list(range(dim)), "s": [str(x) for x in sums], "n": [n] * dim}, pa.schema([("i", pa.int32()), ("s", pa.string()), ("n", pa.int64())]))

    own = df.select(vector)
    added = own.mapInArrow(add, "i int, s string, n long").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).orderBy("i").collect()  # a row for each dimension
    n, sums = added[0]["n"], [int(r["s"]) for r in added]
    blank = Whitening(n, sums, np.zeros(0), np.zeros((0, dim)), 0.0)
    centre, offset = blank.centre, blank.offset

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products = np.zeros((dim, dim))
        for batch in chunks(batches):
            y = (whole(batch.column(0), dim) - centre).astype("f8")
            products += y.T @ y
        upper = np.triu_indices(dim)
        yield pa.RecordBatch.from_arrays([pa.array(upper[0].astype("i4")), pa.array(upper[1].astype("i4")), pa.array(products[upper])], names=["i", "j", "v"])

    pairs = own.mapInArrow(multiply, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()  # half a square of the dimension
    v = np.zeros((dim, dim))
    i, j = pairs["i"].to_numpy(), pairs["j"].to_numpy()
    v[i, j] = v[j, i] = pairs["v"].to_numpy()
    v = v / n - np.outer(offset, offset)
    values, vectors = leading(v, components)
    return Whitening(n, sums, values, vectors.T, float(np.trace(v)))


def whiten(df: DataFrame, model: Whitening, vector: str = "embedding", out: str = "whitened", deviation: str | None = None) -> DataFrame:
    """df (usable rows of one length) with a column of the whitened vector, an array of doubles with nulls for components without variance, and if asked the exact sum of squares of n x - S."""
    dim, centre, offset, scaled, n = len(model.sums), model.centre if model.n else None, model.offset if model.n else None, model.scaled, model.n
    sums = np.array(model.sums, "O")

    @F.arrow_udf("array<double>")
    def project(column: pa.Array) -> pa.Array:
        w = (whole(column, dim) - centre - offset) @ scaled.T
        flat = pa.array(w.ravel(), mask=np.isnan(w.ravel()))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(column) + 1, dtype="i4") * w.shape[1], pa.int32()), flat)

    @F.arrow_udf("long")
    def spread(column: pa.Array) -> pa.Array:
        x = whole(column, dim)
        bound = int(np.abs(x - centre).max(initial=0)) + 1
        if n * bound * n * bound * dim < 2**63:  # n x - S fits, and so do its squares
            y = n * (x - centre) - np.array([int(s) - n * int(m) for s, m in zip(sums, centre, strict=True)], "i8")
            return pa.array((y * y).sum(1))
        exact = [int(s) for s in ((n * x.astype("O") - sums) ** 2).sum(1)]
        return pa.array([s if s < 2**63 else None for s in exact], pa.int64())

    columns = {out: project(vector)} | ({deviation: spread(vector)} if deviation else {})
    return df.withColumns(columns) if model.n else df.withColumns({c: F.lit(None).cast("array<double>" if c == out else "long") for c in columns})


def identity_error(whitened: DataFrame, k: int, column: str = "whitened") -> float | None:
    """The largest absolute entry of the whitened covariance less the identity, over components with variance."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for batch in chunks(batches):
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(-1, k)
            w = np.hstack([np.nan_to_num(flat), np.ones((len(flat), 1))])
            total += w.T @ w
        at = np.indices(total.shape).reshape(2, -1).astype("i4")
        yield pa.RecordBatch.from_arrays([pa.array(at[0]), pa.array(at[1]), pa.array(total.ravel())], names=["i", "j", "v"])

    if not k:
        return None
    got = whitened.select(column).mapInArrow(multiply, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    total = np.zeros((k + 1, k + 1))
    total[got["i"].to_numpy(), got["j"].to_numpy()] = got["v"].to_numpy()
    n = total[k, k]
    mean = total[:k, k] / n  # zero but for rounding, as rows are centred before they are projected
    covariance = total[:k, :k] / n - np.outer(mean, mean)
    used = np.diag(covariance) > 0
    return float(np.abs(covariance - np.eye(k))[np.ix_(used, used)].max()) if used.any() else None


def report(df: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component: vec_id, component (from 1), n, deviation, whitened, explained and identity_error."""
    rows = usable(df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("_v")), "_v")
    rows = rows.where(F.size("_v") == dimension(rows, "_v"))
    model = fit(rows, "_v", components)
    done = whiten(rows, model, "_v", "_w", "deviation")
    k = len(model.values)
    error = identity_error(done, k, "_w")
    parts = F.array(*[F.struct(F.lit(c + 1).alias("component"), F.col("_w")[c].alias("whitened"), F.lit(float(e / model.trace) if model.trace > 0 else None).cast("double").alias("explained")) for c, e in enumerate(model.values)])
    out = done.select("vec_id", "deviation", F.inline(parts)) if k else done.select("vec_id", "deviation", F.lit(0).alias("component"), F.lit(0.0).alias("whitened"), F.lit(0.0).alias("explained")).limit(0)
    return out.select("vec_id", "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(error).cast("double").alias("identity_error"))
