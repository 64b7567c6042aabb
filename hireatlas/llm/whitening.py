"""Whitening components of an embedding table by shifted Cholesky QR.

Entries are put on a grid of 1/64 (`x = floor(64 c) + 1000000`), so counts and sums are exact integers. Each pass centres the rows
(`x - S/n`, rounded once), takes them through the triangular factors found so far by forward substitution, and sums the Gram matrix of
what comes out: tasks send their d x d sums, Spark adds them, the driver takes the Cholesky factor. The first Gram matrix is shifted so
that its factor exists for any table; two more passes make the rows orthonormal. The factors multiply to the R of a QR decomposition, and
the singular value decomposition of R (d x d) gives the components: right vectors, eigenvalues `sigma^2 / n`. One more pass sums the
covariance of the whitened rows. What tasks and driver hold is a few d x d matrices; the number of rows never matters to them.

Left out are vectors that are null or empty, hold a null or a value that is not finite, hold an entry of 2^46 or more (no double tells its
neighbours on the grid apart), or have another length than most of them (the shorter one in a tie). Repeated ids are rows of their own.
Without any row left the result is empty. A component without variance (eigenvalue below 1e-24 of the largest) has a null `whitened`; it
explains 0 and is left out of the identity error, which is 0 if no component varies. A deviation that does not fit a long is null. Columns
other than the id and the vector are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store, table

SCALE, ORIGIN = 64, 1_000_000
COMPONENTS = 32
LARGEST = 2.0**46
#: Eigenvalues below this share of the largest count as zero.
NO_VARIANCE = 1e-24
#: Rows a task works on at once.
ROWS = 1024


def on_grid(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + ORIGIN)


def fit_list(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """`vec_id, x array<long>` of the vectors that count, stored."""
    sound = F.forall(F.col(vector), lambda c: F.coalesce(F.abs(c.cast("double")) < LARGEST, F.lit(False)))
    rows = vectors.where((F.size(vector) > 0) & sound).select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v"))
    rows = store(rows.select("vec_id", on_grid(F.col("v")).alias("x")), "whitening-fit")
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(2).collect()
    return rows if len(lengths) < 2 else rows.where(F.size("x") == lengths[0].d)


@dataclass
class Centre:
    """Number of rows and exact sums of every dimension. `wide`: products with n may not fit 64 bits."""

    n: int
    sums: np.ndarray
    wide: bool

    def numerators(self, x: np.ndarray) -> np.ndarray:
        """`n x - S`, exact."""
        if self.wide:
            return x.astype(object) * self.n - self.sums
        return x * np.int64(self.n) - self.sums.astype(np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.numerators(x) / self.n).astype(np.float64)


def _matrices(batches, width: int):
    """Ids and integer rows, some at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, part.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def centre(rows: DataFrame) -> Centre | None:
    """One pass over the fit list. None if it has no rows."""
    head = rows.select(F.size("x").alias("d")).first()
    if head is None:
        return None
    width = head.d

    def add(batches):
        n, largest, sums = 0, 0, np.zeros(width, object)
        for _, x in _matrices(batches, width):
            n += len(x)
            largest = max(largest, int(np.abs(x).max(initial=0)))
            sums += x.sum(0).astype(object)  # at most 1,024 entries below 2^53 each
        if n:
            yield pa.record_batch({"n": pa.array([n]), "largest": pa.array([largest]), "sums": pa.array([[str(s) for s in sums]], pa.list_(pa.string()))})

    parts = store(rows.select("x").mapInArrow(add, "n long, largest long, sums array<string>"), "whitening-sums")
    n, largest = parts.agg(F.sum("n"), F.max("largest")).first()
    by_place = parts.select(F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    sums = np.zeros(width, object)
    for row in by_place.collect():  # one row a dimension
        sums[row.i] = int(row.s)
    return Centre(n, sums, n * largest >= 1 << 61)


def forward(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """Q of `Q factor = rows` for an upper triangular factor, column by column."""
    out = np.empty_like(rows)
    for j in range(rows.shape[1]):
        out[:, j] = (rows[:, j] - out[:, :j] @ factor[:j, j]) / factor[j, j]
    return out


def gram(rows: DataFrame, width: int, work) -> np.ndarray:
    """Sum over all rows of z'z, where `work` turns integer rows into float rows z of the given width."""
    length = rows.select(F.size("x").alias("d")).first().d

    def add(batches):
        total = np.zeros((width, width))
        for _, x in _matrices(batches, length):
            z = work(x)
            total += z.T @ z
        yield pa.record_batch({"i": pa.array(range(width), pa.int32()), "sums": pa.array([total[i, i:] for i in range(width)], pa.list_(pa.float64()))})

    parts = rows.select("x").mapInArrow(add, "i int, sums array<double>")
    summed = parts.select("i", F.posexplode("sums").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()  # d x d / 2 rows
    out = np.zeros((width, width))
    i, j = summed["i"].to_numpy(), summed["j"].to_numpy()
    out[i, i + j] = summed["v"].to_numpy()
    return np.triu(out) + np.triu(out, 1).T


def _cholesky(matrix: np.ndarray, n: int, shifted: bool) -> np.ndarray:
    """Upper factor. The shift bounds the rounding of the sums, so that the shifted matrix is positive definite."""
    d = len(matrix)
    largest = float(np.linalg.eigvalsh(matrix)[-1]) if d else 0.0
    shift = min(11 * (n * d + d * (d + 1)) * 2.0**-53, 2.0**-10) * (largest if largest > 0 else 1.0)
    if not shifted:
        try:
            return np.linalg.cholesky(matrix).T
        except np.linalg.LinAlgError:
            pass  # a direction without variance
    while True:
        try:
            return np.linalg.cholesky(matrix + shift * np.eye(d)).T
        except np.linalg.LinAlgError:
            shift *= 16


@dataclass
class Whitening:
    """Components (rows of unit length), eigenvalues in falling order, and the sum of all eigenvalues."""

    at: Centre
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    def weights(self) -> np.ndarray:
        """Matrix from centred rows to whitened values; a column of zeros where nothing varies."""
        varies = self.varies()
        scale = np.where(varies, 1 / np.sqrt(np.where(varies, self.eigenvalues, 1)), 0)
        return self.components.T * scale

    def varies(self) -> np.ndarray:
        largest = self.eigenvalues.max(initial=0)
        return self.eigenvalues > NO_VARIANCE * largest


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Three Gram passes over a stored fit list. None if it has no rows."""
    at = centre(rows)
    if at is None:
        return None
    width = len(at.sums)
    context = rows.sparkSession.sparkContext
    product = np.eye(width)
    factors: list[np.ndarray] = []
    n, sums, wide = at.n, at.sums, at.wide
    for turn in range(3):
        sent = context.broadcast(factors)

        def work(x):
            z = Centre(n, sums, wide).centred(x)
            for factor in sent.value:
                z = forward(z, factor)
            return z

        summed = gram(rows, width, work)
        sent.destroy()
        if not turn and not np.trace(summed):  # exact: all rows are equal
            return Whitening(at, np.eye(width)[:components], np.zeros(min(components, width)), 0.0)
        factor = _cholesky(summed, n, shifted=turn == 0)
        factors.append(factor)
        product = factor @ product
    _, sigma, right = np.linalg.svd(product)
    # Either sign is right; the largest entry is made positive.
    right *= np.where(np.take_along_axis(right, np.abs(right).argmax(1)[:, None], 1) < 0, -1.0, 1.0)
    eigenvalues = sigma**2 / n
    keep = min(components, width)
    return Whitening(at, right[:keep], eigenvalues[:keep], float(eigenvalues.sum()))


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest entry by which the covariance of the whitened rows differs from the identity."""
    varies = model.varies()
    if not varies.any():
        return 0.0
    at, weights = model.at, model.weights()[:, varies]
    covariance = gram(rows, weights.shape[1], lambda x: at.centred(x) @ weights) / at.n
    return float(np.abs(covariance - np.eye(len(covariance))).max())


def whiten(rows: DataFrame, model: Whitening) -> DataFrame:
    """`vec_id, deviation, whitened array<double>` of every row of the fit list; a component without variance is null."""
    at, weights, varies = model.at, model.weights(), model.varies()

    def run(batches):
        for part, x in _matrices(batches, len(at.sums)):
            above = at.numerators(x)
            z = (above / at.n).astype(np.float64) @ weights
            lengths = np.square(above.astype(np.float64)).sum(1)
            if lengths.max(initial=0) < 2.0**62:
                deviation = pa.array(np.square(above).sum(1).astype(np.int64))
            else:
                exact = (above.astype(object) ** 2).sum(1)
                deviation = pa.array([int(v) if v < 1 << 63 else None for v in exact], pa.int64())
            flat = pa.array(z.ravel(), mask=np.broadcast_to(~varies, z.shape).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, z.shape[1], dtype=np.int32)), flat)
            yield pa.record_batch([part.column("vec_id"), deviation, lists], ["vec_id", "deviation", "whitened"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id {kind}, deviation long, whitened array<double>")


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    rows = fit_list(table(spark, sf_dir, "embeddings"))
    model = fit(rows)
    kind = rows.schema["vec_id"].dataType.simpleString()
    if model is None or not len(model.eigenvalues):
        columns = "component int, n long, deviation long, whitened double, explained double, identity_error double"
        return spark.createDataFrame([], f"vec_id {kind}, {columns}")
    share = model.eigenvalues / model.trace if model.trace > 0 else np.zeros(len(model.eigenvalues))
    explained = F.array(*(F.lit(float(s)) for s in share))
    error = identity_error(rows, model)
    return whiten(rows, model).select(
        "vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened")
    ).select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        F.lit(model.at.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        explained[F.col("place")].alias("explained"),
        F.lit(error).alias("identity_error"),
    )


QUERIES = {"op12_whitening": op12_whitening}
