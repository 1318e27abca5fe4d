"""Embedding whitening by block Jacobi-Davidson (operator 12).

The leading eigenvectors of the covariance are found without forming it: the driver keeps a few vectors
of the embedding's dimension, and every product of the covariance with them is a Spark pass that centres
the rows, multiplies them twice and sums one small matrix per task. A round of Jacobi-Davidson

1. takes Ritz pairs from the search space (Rayleigh-Ritz) and their residuals,
2. locks the leading pairs whose residual is down to double precision,
3. solves the projected correction equations of the other wanted pairs by a few MINRES steps, all
   pairs sharing the passes, and widens the search space by the corrections;

a space that has grown too wide starts again from its best Ritz vectors. Locked and wanted directions
are projected out of the corrections. When no direction is left, the space is everything and exact.

Entries become integers, x = floor(1024 c) + 100000, so sums and squared deviations are exact.

Defined cases: rows whose vector is NULL, empty, of another length than most (ties: the longer), or
holds NULL, non-finite or absolute entries of 2^42 or more are dropped; zero vectors and repeated rows
stay and count each. With fewer than eight dimensions there are as many components. A component without
variance has ``explained`` 0 and ``whitened`` NULL; ``identity_error`` covers the others, NULL if there
are none. A deviation beyond 64 bits is NULL. Empty tables give no rows. Columns other than vec_id and
embedding are never read.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable, Iterator, Optional

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorframe.llm import common

COMPONENTS = 8
SCALE, OFFSET = 1024, 100_000
LARGEST = float(1 << 42)
# The search space starts with twice the components and is cut back to that beyond this many.
MOST_DIRECTIONS, MINRES_STEPS, MOST_ROUNDS = 48, 4, 100
# A residual counts as double precision below this share of the largest eigenvalue.
PRECISION = 2e-14
# Eigenvalues below this share of the largest are rounding.
NO_VARIANCE = 1e-13
ROWS_PER_BLOCK = 4096

Product = Callable[[np.ndarray], np.ndarray]


# -- the eigenproblem, on the driver: a few vectors of the embedding's dimension --------------------


def _orthonormal(vectors: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``vectors`` add to the orthonormal ``against``."""
    kept = against
    for v in vectors.T:
        size = np.linalg.norm(v)
        if not size > 0:
            continue
        v = v / size
        for _ in range(3):
            v = v - kept @ (kept.T @ v)
        rest = np.linalg.norm(v)
        if rest > 1e-10:
            v = v / rest
            v = v - kept @ (kept.T @ v)
            kept = np.column_stack((kept, v / np.linalg.norm(v)))
    return kept[:, against.shape[1] :]


def corrections(multiply: Product, shifts: np.ndarray, out: np.ndarray, residuals: np.ndarray, steps: int) -> np.ndarray:
    """MINRES on (I - QQ')(A - shift I)(I - QQ') t = -residual, Q = ``out``, all columns at once.

    Each column has its own recurrence; one pass multiplies all of them.
    """
    shape = residuals.shape
    project = lambda x: x - out @ (out.T @ x)
    v = project(-residuals)
    beta = np.linalg.norm(v, axis=0)
    alive = beta > 0
    v = np.where(alive, v / np.where(alive, beta, 1), 0)
    t, before = np.zeros(shape), np.zeros(shape)
    d1, d2 = np.zeros(shape), np.zeros(shape)
    c1, s1 = np.ones(shape[1]), np.zeros(shape[1])
    c2, s2 = np.ones(shape[1]), np.zeros(shape[1])
    eta, beta_in = beta.copy(), np.zeros(shape[1])
    floor = beta * 1e-3
    for _ in range(steps):
        if not alive.any():
            break
        w = project(multiply(v) - v * shifts) - before * beta_in
        alpha = (v * w).sum(axis=0)
        w = w - v * alpha
        beta_out = np.linalg.norm(w, axis=0)
        # Givens rotations of the last two steps, and this one's
        r3, r2 = s2 * beta_in, c2 * beta_in
        r2, r1 = c1 * r2 + s1 * alpha, -s1 * r2 + c1 * alpha
        length = np.hypot(r1, beta_out)
        alive &= length > 0
        safe = np.where(alive, length, 1)
        c, s = r1 / safe, beta_out / safe
        d = np.where(alive, (v - d1 * r2 - d2 * r3) / safe, 0)
        t = t + d * np.where(alive, c * eta, 0)
        eta = np.where(alive, -s * eta, 0)
        alive &= (np.abs(eta) > floor) & (beta_out > 0)
        before, v = v, np.where(beta_out > 0, w / np.where(beta_out > 0, beta_out, 1), 0)
        d1, d2, beta_in = d, d1, beta_out
        c2, s2, c1, s1 = c1, s1, c, s
    return project(t)


@dataclass
class Eigen:
    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    rounds: int
    products: int


def jacobi_davidson(
    multiply: Product,
    dimension: int,
    wanted: int = COMPONENTS,
    most: int = MOST_DIRECTIONS,
    steps: int = MINRES_STEPS,
    precision: float = PRECISION,
) -> Eigen:
    """The ``wanted`` largest eigenpairs of a symmetric positive operator that only multiplies."""
    wanted = min(wanted, dimension)
    products = 0

    def counted(x: np.ndarray) -> np.ndarray:
        nonlocal products
        products += 1
        return multiply(x)

    start = min(2 * wanted, dimension)
    locked, values, sizes = np.zeros((dimension, 0)), [], []
    space = _orthonormal(np.random.default_rng(7).standard_normal((dimension, start)), locked)
    image = counted(space)
    top = 0.0
    for rounds in range(1, MOST_ROUNDS + 1):
        small = space.T @ image
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        open_pairs = min(wanted - len(values), len(theta))
        ritz, ritz_image = space @ turn, image @ turn
        residual = ritz_image[:, :open_pairs] - ritz[:, :open_pairs] * theta[:open_pairs]
        residual -= locked @ (locked.T @ residual)
        norms = np.linalg.norm(residual, axis=0)
        top = max(top, float(theta[0]) if len(theta) else 0.0, *values) if values else max(top, float(theta[0]))
        # with every direction in the space the pairs are as exact as the products are
        full = locked.shape[1] + space.shape[1] >= dimension
        ready = 0
        while ready < open_pairs and (full or norms[ready] <= precision * top):
            ready += 1
        if ready:
            locked = np.column_stack((locked, ritz[:, :ready]))
            values += theta[:ready].tolist()
            sizes += norms[:ready].tolist()
            space, image = ritz[:, ready:], ritz_image[:, ready:]
            ritz, ritz_image, theta = space, image, theta[ready:]
            residual = residual[:, ready:]
            open_pairs -= ready
        if len(values) >= wanted:
            break
        if space.shape[1] + open_pairs > most:
            space, image = ritz[:, :start], ritz_image[:, :start]
        out = np.column_stack((locked, ritz[:, :open_pairs]))
        moves = corrections(counted, theta[:open_pairs], out, residual, steps)
        fresh = _orthonormal(moves, np.column_stack((locked, space)))
        if not fresh.shape[1]:
            # corrections within the space: any new direction leads on
            fresh = np.random.default_rng(rounds).standard_normal((dimension, open_pairs))
            fresh = _orthonormal(fresh, np.column_stack((locked, space)))
        image = np.column_stack((image, counted(fresh)))
        space = np.column_stack((space, fresh))
    else:
        raise RuntimeError(f"{len(values)} of {wanted} eigenpairs after {MOST_ROUNDS} rounds, residuals {norms}")
    order = np.argsort(-np.array(values), kind="stable")
    return Eigen(np.array(values)[order], locked[:, order], np.array(sizes)[order], rounds, products)


# -- passes over the rows ---------------------------------------------------------------------------


def usable(rows: DataFrame) -> tuple[DataFrame, Optional[int]]:
    """(rows whose vector remains, dimension); None for the dimension without any."""
    x = F.col("embedding")
    # NaN compares as larger than any number
    sound = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < F.lit(LARGEST)))
    rows = rows.filter(F.coalesce(sound, F.lit(False)))
    sizes = rows.groupBy(F.size(x).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    top = sizes.agg(F.max(F.struct("n", "d"))["d"]).first()[0]
    return rows.filter(F.size(x) == F.lit(top if top is not None else -1)), top


def blocks(rows: DataFrame, dimension: int) -> DataFrame:
    """ids, present, x: some thousand rows each, x their integer vectors as bytes."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), ROWS_PER_BLOCK):
                part = pdf.iloc[at : at + ROWS_PER_BLOCK]
                c = np.stack([np.asarray(v, dtype=np.float64) for v in part["embedding"]])
                x = np.floor(SCALE * c).astype("<i8") + OFFSET
                known = part["vec_id"].notna().to_numpy()
                ids = part["vec_id"].where(known, 0).to_numpy(dtype="<i8")
                yield pd.DataFrame({"ids": [ids.tobytes()], "known": [known.tobytes()], "x": [x.tobytes()]})

    return rows.select("vec_id", "embedding").mapInPandas(pack, "ids binary, known binary, x binary")


def _matrix(raw, dimension: int) -> np.ndarray:
    return np.frombuffer(bytes(raw), dtype="<i8").reshape(-1, dimension)


def _summed(table: DataFrame, per_block: Callable[[np.ndarray], np.ndarray], dimension: int, height: int, width: int, kind: str) -> np.ndarray:
    """Sum over all blocks of a ``height`` x ``width`` matrix each, one per task before the shuffle."""
    columns = [f"c{k}" for k in range(width)]
    number = np.int64 if kind == "long" else np.float64

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, some = np.zeros((height, width), dtype=number), False
        for pdf in batches:
            for raw in pdf["x"]:
                total += per_block(_matrix(raw, dimension))
                some = True
        if some:
            yield pd.DataFrame(total, columns=columns).assign(at=np.arange(height))

    schema = ", ".join(f"{c} {kind}" for c in columns) + ", at long"
    sums = table.select("x").mapInPandas(partial, schema).groupBy("at").agg(*[F.sum(c).alias(c) for c in columns])
    out = np.zeros((height, width), dtype=number)
    for row in sums.collect():  # ``height`` rows
        out[row["at"]] = [row[c] for c in columns]
    return out


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[Optional[int]]:
    """Sum over dimensions of (n x - S)^2, exact; None beyond 64 bits."""
    rough = ((float(n) * x - sums.astype(np.float64)) ** 2).sum(axis=1)
    if len(rough) and rough.max() < 9e18 and float(n) * np.abs(x).max() < 9e18:
        apart = n * x - sums
        return (apart * apart).sum(axis=1).tolist()
    out = []
    for row, size in zip(x.tolist(), rough):
        exact = sum((n * v - s) ** 2 for v, s in zip(row, sums.tolist())) if size < 9.3e18 else 1 << 63
        out.append(exact if exact < 1 << 63 else None)
    return out


@dataclass
class Whitener:
    """What a pass needs to whiten rows: all of it grows with the dimension alone."""

    n: int
    sums: np.ndarray
    trace: float
    eigen: Eigen
    identity_error: Optional[float] = None

    @property
    def mean(self) -> np.ndarray:
        return self.sums / self.n

    @property
    def varies(self) -> np.ndarray:
        values = self.eigen.values
        return values > NO_VARIANCE * max(float(values[0]), 0.0) if len(values) else np.zeros(0, bool)

    @property
    def axes(self) -> np.ndarray:
        """Eigenvectors over the roots of their eigenvalues; zero without variance."""
        roots = np.sqrt(np.where(self.varies, self.eigen.values, 1.0))
        return np.where(self.varies, self.eigen.vectors / roots, 0.0)


def fit(table: DataFrame, dimension: int, wanted: int = COMPONENTS) -> Optional[Whitener]:
    """Whitening of the blocks in ``table``; None without rows."""
    first = _summed(table, lambda x: np.column_stack((x.sum(axis=0), np.full(dimension, len(x)))), dimension, dimension, 2, "long")
    sums, n = first[:, 0], int(first[0, 1])
    if not n:
        return None
    mean = sums / n
    spread = _summed(table, lambda x: ((x - mean) ** 2).sum(axis=0)[:, None], dimension, dimension, 1, "double")
    trace = float(spread.sum()) / n

    def multiply(vectors: np.ndarray) -> np.ndarray:
        def block(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return centred.T @ (centred @ vectors)

        return _summed(table, block, dimension, dimension, vectors.shape[1], "double") / n

    model = Whitener(n, sums, trace, jacobi_davidson(multiply, dimension, wanted))
    axes, varies = model.axes, model.varies
    if varies.any():
        k = axes.shape[1]

        def gram(x: np.ndarray) -> np.ndarray:
            white = (x - mean) @ axes
            return np.column_stack((white.T @ white, white.sum(axis=0)))

        # whitened rows are centred already; what rounding leaves of their mean is taken out
        held = _summed(table, gram, dimension, k, k + 1, "double") / n
        covariance = held[:, :k] - np.outer(held[:, k], held[:, k])
        error = np.abs(covariance - np.eye(k))[np.ix_(varies, varies)]
        model.identity_error = float(error.max())
    return model


_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, wanted: int = COMPONENTS) -> DataFrame:
    """One row per remaining row of ``rows`` (vec_id, embedding) and component."""
    taking, dimension = usable(rows.select("vec_id", "embedding"))
    if dimension is None:
        return rows.sparkSession.createDataFrame([], _OUT)
    table = common.staged(blocks(taking, dimension), "vector-blocks")
    model = fit(table, dimension, wanted)
    n, sums, mean, axes, varies = model.n, model.sums, model.mean, model.axes, model.varies
    k = axes.shape[1]
    explained = np.where(varies, model.eigen.values / model.trace if model.trace > 0 else 0.0, 0.0)
    error = np.nan if model.identity_error is None else model.identity_error

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for raw_ids, raw_known, raw in zip(pdf["ids"], pdf["known"], pdf["x"]):
                x = _matrix(raw, dimension)
                ids = np.frombuffer(bytes(raw_ids), dtype="<i8")
                known = np.frombuffer(bytes(raw_known), dtype=bool)
                white = np.where(varies, (x - mean) @ axes, np.nan)
                deviation = pd.array(_deviations(x, n, sums), dtype="Int64")
                out = pd.DataFrame(
                    {
                        "vec_id": pd.array(ids, dtype="Int64").repeat(k),
                        "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)),
                        "n": n,
                        "deviation": deviation.repeat(k),
                        "whitened": white.ravel(),
                        "explained": np.tile(explained, len(x)),
                        "identity_error": error,
                    }
                )
                out.loc[~np.repeat(known, k), "vec_id"] = pd.NA
                yield out

    found = table.mapInPandas(apply, _OUT)
    missing = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return found.select("vec_id", "component", "n", "deviation", missing("whitened"), "explained", missing("identity_error"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(common.read(spark, sf_dir, "embeddings", "vec_id", "embedding"))


QUERIES = {"op12_whitening": op12_whitening}
