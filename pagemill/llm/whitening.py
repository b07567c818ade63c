"""Whitening components of vectors by shifted CholeskyQR.

With A the centred rows, a pass sums the Gram matrix of the rows' present images over all
tasks, takes its Cholesky factor R and replaces the rows by their solutions of q R = a, a
triangular solve for each batch of rows.  The first Gram matrix gets a small shift on its
diagonal, so that the factor exists for any condition number; what the shift spoils, later
passes mend, until the rows' images are orthonormal to rounding.  The composed factor
R = Rk ... R1 then has the singular values and right vectors of A to double precision,
where an eigendecomposition of the covariance would lose the small ones to squaring.  The
SVD of R, dimensions x dimensions, is the driver's only work of size.

Rows are whole numbers x = floor(scale * c) + offset.  Their sums are exact, and a centred
entry is (n x - S) / n with an exact numerator, so a large common offset costs no digits.
Tasks hand on one row for each pair of dimensions, added up by Spark; images are made anew
from the rows in each pass instead of being stored.

Defined results: rows are left out whose vector is null, empty, of another length than most
(equally many: the greater length), or holds null or non-finite entries or such that do not
fit a long after scaling; they take no part in the sums.  Rows with equal or null ids are
rows of their own.  Components end at the numerical rank (singular values of 1e-10 of the
largest): equal vectors, or a single one, have none and give no rows; so does an empty
table.  The sign of a component makes its largest entry positive.  A deviation beyond a
long is null.  Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.scratch import Scratch

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Orthonormal to this, least singular value against the largest, and passes at most.
ORTHONORMAL, RANK, PASSES = 1e-13, 1e-10, 8
#: Entries reach at most so far from zero.
_MOST = 2.0**52
_ROWS = 4096


@dataclass
class Whitening:
    """Fitted components: ``vectors`` has a row each, ``eigenvalues`` those of the covariance."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    passes: int

    def centred(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors.T / np.sqrt(self.eigenvalues))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums over dimensions of (n x - S) ** 2, exact."""
        apart = _apart(x, self.n, self.sums)
        if apart.dtype != object and np.abs(apart.astype(float)).max(initial=0) < np.sqrt(2.0**62 / max(1, x.shape[1])):
            return (apart * apart).sum(axis=1).tolist()
        exact = [sum(v * v for v in row) for row in apart.tolist()]
        return [v if v < 2**63 else None for v in exact]


def _apart(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S in whole numbers, of any size."""
    if n * max(1.0, float(np.abs(x).max(initial=0))) < 2.0**61:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return _apart(x, n, sums).astype(np.float64) / n


def solve(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """q of q r = a, r upper triangular, column by column for all rows at once."""
    q = np.empty_like(a)
    for j in range(a.shape[1]):
        q[:, j] = (a[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def cholesky(gram: np.ndarray, shift: float) -> np.ndarray:
    """Upper factor of the Gram matrix, with the least shift of at least the given size that lets it exist."""
    own = shift
    while True:
        try:
            return np.linalg.cholesky(gram + own * np.eye(len(gram))).T
        except np.linalg.LinAlgError:
            own = max(10 * own, np.finfo(float).eps * np.trace(gram))


def whole_numbers(vectors: DataFrame, id_column: str, vector_column: str, scale: int, offset: int, scratch: Scratch) -> DataFrame:
    """(id, x) of the rows that take part."""
    sound = lambda x: x.isNotNull() & (F.abs(x.cast("double") * scale) < _MOST)  # noqa: E731  NaN is the greatest
    rows = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).alias("v")).where(F.size("v") > 0).where(F.forall("v", sound))
    rows = scratch.table(rows.select("id", F.transform("v", lambda x: F.floor(x.cast("double") * scale) + offset).alias("x")))
    most = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("x") == (most.d if most else 0))


def _matrix(batch, column: str = "x") -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _parts(batches, column: str = "x"):
    for batch in batches:
        for a in range(0, batch.num_rows, _ROWS):
            part = batch.slice(a, min(_ROWS, batch.num_rows - a))
            if part.num_rows:
                yield part, _matrix(part, column)


def column_sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of rows and exact sums by dimension."""
    def task(batches):
        import pyarrow as pa

        n, total = 0, None
        for _, x in _parts(batches):
            own = x.sum(axis=0)  # below 2 ** 53 an entry, few rows at a time
            total = own.astype(object) if total is None else total + own
            n += len(x)
        if n:
            yield pa.RecordBatch.from_pydict({"place": pa.array(range(-1, len(total)), pa.int32()), "amount": [str(v) for v in [n, *total]]})

    parts = rows.select("x").mapInArrow(task, "place int, amount string")
    sums = {r.place: int(r.total) for r in parts.groupBy("place").agg(F.sum(F.col("amount").cast("decimal(38,0)")).alias("total")).collect()}
    return sums.get(-1, 0), [sums[d] for d in range(len(sums) - 1)]


def gram(rows: DataFrame, image, column: str = "x") -> np.ndarray:
    """Sum over all rows of q^T q, q = ``image`` of a batch of rows."""
    def task(batches):
        import pyarrow as pa

        total = None
        for _, x in _parts(batches, column):
            q = image(x)
            total = q.T @ q if total is None else total + q.T @ q
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "value": pa.array(total[i, j])})

    parts = rows.select(column).mapInArrow(task, "i int, j int, value double")
    cells = parts.groupBy("i", "j").agg(F.sum("value").alias("value")).collect()
    d = max((r.j for r in cells), default=-1) + 1
    out = np.zeros((d, d))
    for r in cells:
        out[r.i, r.j] = out[r.j, r.i] = r.value
    return out


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening:
    """Components of ``rows`` (column ``x`` of whole numbers, equally long)."""
    n, sums = column_sums(rows)
    factors: list[np.ndarray] = []

    def image(x: np.ndarray) -> np.ndarray:
        q = centred(x, n, sums)
        for r in factors:
            q = solve(q, r)
        return q

    d = len(sums)
    composed, passes = np.zeros((d, d)), 0
    while passes < PASSES and d:
        g = gram(rows, image)
        size = np.trace(g)
        if not size > 0:
            break
        off = np.abs(g - np.eye(d)).max()
        if factors and off <= ORTHONORMAL * d:
            break
        # the first shift covers the rounding of the sum; later images are near orthonormal but for directions without spread
        factors.append(cholesky(g, 11 * (d + 1) * np.finfo(float).eps * size if not factors else 0.0))
        composed = factors[-1] @ composed if passes else factors[-1]
        passes += 1
    if not passes:
        return Whitening(n, sums, np.zeros((0, d)), np.zeros(0), np.zeros(0), 0)
    _, singular, right = np.linalg.svd(composed)
    held = int((singular > RANK * singular[0]).sum())
    largest = right[np.arange(d), np.abs(right).argmax(axis=1)]
    right = right * np.sign(largest)[:, None]
    share = singular**2 / (singular**2).sum()
    most = min(held, components)
    return Whitening(n, sums, right[:most], singular[:most] ** 2 / n, share[:most], passes)


def whiten(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> tuple[DataFrame, Whitening]:
    """(id, deviation, whitened: an entry for each component) of every row that takes part, and what was fitted."""
    scratch = Scratch(vectors.sparkSession, "whitening")
    rows = whole_numbers(vectors, id_column, vector_column, scale, offset, scratch)
    fitted = fit(rows, components)

    def images(batches):
        import pyarrow as pa

        for part, x in _parts(batches):
            w = fitted.whiten(x)
            ends = pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1])
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(fitted.deviations(x), pa.int64()), pa.ListArray.from_arrays(ends, pa.array(w.reshape(-1)))], names=["id", "deviation", "whitened"])

    schema = T.StructType([rows.schema["id"], T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    return scratch.table(rows.mapInArrow(images, schema)), fitted


def identity_error(whitened: DataFrame) -> float:
    """Largest absolute entry of the covariance of ``whitened`` (an array column) minus the identity."""
    def task(batches):
        import pyarrow as pa

        n, total = 0, None
        for _, w in _parts(batches, "whitened"):
            total = w.sum(axis=0) if total is None else total + w.sum(axis=0)
            n += len(w)
        if n:
            yield pa.RecordBatch.from_pydict({"place": pa.array(range(-1, len(total)), pa.int32()), "amount": [float(n), *total]})

    parts = whitened.select("whitened").where(F.size("whitened") > 0).mapInArrow(task, "place int, amount double")
    sums = {r.place: r.total for r in parts.groupBy("place").agg(F.sum("amount").alias("total")).collect()}
    if not sums:
        return 0.0
    n = sums[-1]
    mean = np.array([sums[d] for d in range(len(sums) - 1)]) / n
    return float(np.abs(gram(whitened, lambda w: w - mean, "whitened") / n - np.eye(len(mean))).max())


def op13_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    """Contract query over all ``embeddings``."""
    rows, fitted = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    error = identity_error(rows)
    explained = F.array(*(F.lit(float(v)) for v in fitted.explained)).cast("array<double>")
    each = rows.select("id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return each.select(
        F.col("id").alias("vec_id"), (F.col("k") + 1).cast("int").alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("k")).alias("explained"), F.lit(error).alias("identity_error"))
