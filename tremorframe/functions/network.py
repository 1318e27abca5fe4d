"""Learned multiplicative travel-time correction, evaluated in Arrow batches with numpy.

The correction of an event, a receiver and a phase is the same in every observation of them, so each
task runs the network once per distinct triple: repeats within a batch are found by hash and those of
earlier batches in a table of fixed size. ``costly`` asks for observations that are clustered by
receiver and phase, so that all repeats of a triple meet in one task; ``forward.by_receiver`` does it.

The network takes (horizontal distance, source depth, receiver depth, phase), the first three over
``scale``. An input layer is followed by residual blocks of two layers each and a linear output
whose absolute value multiplies the straight-ray time. Hidden layers use ELU. Weights come as a
table of ``schemas.NETWORK_WEIGHTS``: one row per layer, in order, ``w`` row-major.
"""

from __future__ import annotations

from typing import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorframe.functions.travel_time import RECEIVER, StraightRay
from tremorframe.schemas import require_columns

# Bytes of weights that may be sent to every executor; the architecture's 12 layers have 1.3 MB.
MAX_WEIGHT_BYTES = 256 << 20
# Rows that pass the layers together, so that they stay in a processor's cache.
_CHUNK = 256
# Triples that a task remembers (some 90 bytes each).
_REMEMBERED = 1 << 19


def load_weights(table: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """Layer matrices of a weights table, checked for size and shape before they are collected."""
    require_columns(table, ["layer", "n_out", "n_in", "w", "b"], "network weights")
    size = table.agg(F.coalesce(F.sum(F.size("w") + F.size("b")), F.lit(0))).first()[0] * 8
    if size > MAX_WEIGHT_BYTES:
        raise ValueError(f"{size} bytes of network weights, more than {MAX_WEIGHT_BYTES}")
    rows = table.collect()
    if len(rows) < 2 or len(rows) % 2:
        raise ValueError(f"expected an even number of layers, got {len(rows)}")
    layers = []
    for row in sorted(rows, key=lambda r: r["layer"]):
        w = np.asarray(row["w"], dtype=np.float64).reshape(row["n_out"], row["n_in"])
        b = np.asarray(row["b"], dtype=np.float64)
        if b.shape != (row["n_out"],):
            raise ValueError(f"layer {row['layer']} has {b.size} biases for {row['n_out']} outputs")
        layers.append((w, b))
    return layers


def evaluate(
    layers: list[tuple[np.ndarray, np.ndarray]], features: np.ndarray, gradients: bool = False
) -> tuple[np.ndarray, np.ndarray | None]:
    """Correction for each feature row and, on request, its gradient by the four features."""
    slopes: list[np.ndarray] = []

    features = features.astype(layers[0][0].dtype, copy=False)

    def hidden(k: int, a: np.ndarray) -> np.ndarray:
        z = a @ layers[k][0].T
        z += layers[k][1]
        below = np.minimum(z, 0.0)
        np.exp(below, out=below)
        if gradients:
            # the derivative of ELU is exp(z) below 0 and 1 above
            slopes.append(below.copy())
        # exp(z) - 1 is 0 above 0 and no less than z below
        below -= 1.0
        return np.maximum(z, below, out=z)

    a = hidden(0, features)
    last = len(layers) - 1
    for k in range(1, last, 2):
        a = hidden(k + 1, hidden(k, a)) + a
    raw = (a @ layers[last][0].T + layers[last][1])[:, 0]
    if not gradients:
        return np.abs(raw), None

    g = np.sign(raw)[:, None] * layers[last][0]
    for k in range(last - 2, 0, -2):
        through = (g * slopes[k + 1]) @ layers[k + 1][0]
        g = g + (through * slopes[k]) @ layers[k][0]
    return np.abs(raw), (g * slopes[0]) @ layers[0][0]


class Remembered:
    """Values of rows of keys, found once for equal rows; older entries give way to newer ones."""

    def __init__(self, n_keys: int, n_values: int, entries: int = _REMEMBERED):
        self.entries = entries
        self.keys = np.zeros((entries, n_keys), dtype=np.uint64)
        self.values = np.zeros((entries, n_values))
        self.filled = np.zeros(entries, dtype=bool)
        self.odd = np.array([pow(0x9E3779B97F4A7C15, 2 * i + 1, 1 << 64) for i in range(n_keys)], dtype=np.uint64)

    def get(self, rows: np.ndarray, find: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """``find(rows)``, called for distinct rows that are not remembered only."""
        bits = np.ascontiguousarray(rows).view(np.uint64)
        mixed = (bits ^ (bits >> np.uint64(29))) * self.odd
        mixed = (mixed ^ (mixed >> np.uint64(32))).sum(axis=1, dtype=np.uint64) * self.odd[-1]
        mixed ^= mixed >> np.uint64(31)
        _, first, back = np.unique(mixed, return_index=True, return_inverse=True)
        if not (bits[first][back] == bits).all():
            return find(rows)  # two rows of one hash
        bits, at = bits[first], (mixed[first] % np.uint64(self.entries)).astype(np.int64)
        known = self.filled[at] & (self.keys[at] == bits).all(axis=1)
        out = self.values[at]
        missing = np.flatnonzero(~known)
        if len(missing):
            out[missing] = find(rows[first[missing]])
            # of rows that share an entry one is remembered
            slot, one = np.unique(at[missing], return_index=True)
            self.keys[slot], self.values[slot] = bits[missing[one]], out[missing[one]]
            self.filled[slot] = True
        return out[back]


class NetworkTravelTime:
    """Straight-ray time multiplied by the learned correction.

    The network runs in single precision by default, as its weights are trained; ``dtype`` changes
    that. Positions, ray times and their products stay in double precision.
    """

    costly = True

    def __init__(
        self,
        layers: list[tuple[np.ndarray, np.ndarray]],
        scale: float,
        vp: float = 6.0,
        vs: float = 3.3,
        dtype: type = np.float32,
    ):
        self.layers = [(w.astype(dtype), b.astype(dtype)) for w, b in layers]
        self.scale = float(scale)
        self.base = StraightRay(vp, vs)
        self._shared = None

    def _correction(self, spark, n_sources: int, gradients: str | None):
        """Arrow UDF giving ``c1 .. cn`` and, per source, its position or receiver gradient.

        All sources of a row go through one forward pass, so Arrow batches stay full.
        """
        if self._shared is None:
            # one fixed-size weights table (about 1.3 MB for 12 layers of width 128)
            self._shared = spark.sparkContext.broadcast(self.layers)
        shared, scale = self._shared, self.scale
        names = [f"c{i + 1}" for i in range(n_sources)]
        if gradients:
            names += [f"k{i + 1}{axis}" for i in range(n_sources) for axis in "xyz"]
        schema = ", ".join(f"{n} double" for n in names)
        n_values = 4 if gradients else 1

        def correct(layers: list, rows: np.ndarray) -> np.ndarray:
            """Correction and gradient of rows of receiver, phase and source."""
            out = np.empty((len(rows), n_values))
            for start in range(0, len(rows), _CHUNK):
                part = rows[start : start + _CHUNK]
                off = part[:, 4:6] - part[:, 0:2]
                r = np.sqrt((off * off).sum(axis=1))
                feats = np.column_stack([r / scale, part[:, 6] / scale, part[:, 2] / scale, part[:, 3]])
                value, g = evaluate(layers, feats, gradients is not None)
                dest = out[start : start + _CHUNK]
                dest[:, 0] = value
                if gradients is None:
                    continue
                flat = np.divide(off, r[:, None], out=np.zeros_like(off), where=r[:, None] > 0)
                sign, depth_feature = (1.0, 1) if gradients == "source" else (-1.0, 2)
                dest[:, 1:3] = sign * flat * g[:, :1] / scale
                dest[:, 3] = g[:, depth_feature] / scale
            return out

        def run(
            batches: Iterator[tuple[pd.Series, ...]],
        ) -> Iterator[pd.DataFrame]:
            layers, seen = shared.value, Remembered(7, n_values)
            for batch in batches:
                values = np.column_stack([s.to_numpy(dtype=np.float64) for s in batch])
                ends = [values[:, [0, 1, 2, 3, *range(4 + 3 * i, 7 + 3 * i)]] for i in range(n_sources)]
                found = seen.get(np.concatenate(ends), lambda rows: correct(layers, rows))
                ends = np.split(found, n_sources)
                out = np.concatenate([e[:, :1] for e in ends] + [e[:, 1:] for e in ends], axis=1)
                yield pd.DataFrame(out, columns=names)

        return F.pandas_udf(run, schema)

    def attach(self, df: DataFrame, gradients: bool = False) -> DataFrame:
        plain = self.base.attach(df, gradients)
        udf = self._correction(df.sparkSession, 2, "source" if gradients else None)
        inputs = [*RECEIVER, "phase", "x1", "y1", "z1", "x2", "y2", "z2"]
        out = plain.withColumn("_c", udf(*[F.col(c).cast("double") for c in inputs]))
        corrected = [f"t{e} * _c.c{e} AS t{e}" for e in "12"]
        if gradients:
            # product rule: correction times the ray's slope plus ray time times the correction's
            corrected += [
                f"_c.c{e} * g{e}{a} + t{e} * _c.k{e}{a} AS g{e}{a}" for e in "12" for a in "xyz"
            ]
        return out.selectExpr(*df.columns, *corrected)

    def time(self, df: DataFrame, src: tuple, rec: tuple, name: str = "travel_time") -> DataFrame:
        udf = self._correction(df.sparkSession, 1, None)
        inputs = [*rec, "phase", *src]
        out = self.base.time(df, src, rec, "_t0")
        out = out.withColumn("_c", udf(*[F.col(c).cast("double") for c in inputs]))
        return out.withColumn(name, F.col("_t0") * F.col("_c.c1")).drop("_t0", "_c")

    def receiver_slowness(
        self,
        df: DataFrame,
        name: str = "slowness",
        src: tuple = ("x_src", "y_src", "z_src"),
        rec: tuple = ("x_rec", "y_rec", "z_rec"),
    ) -> DataFrame:
        """Gradient norm of the travel time by the receiver position."""
        udf = self._correction(df.sparkSession, 1, "receiver")
        inputs = [*rec, "phase", *src]
        out = self.base.time(df, src, rec, "_t0")
        out = out.withColumn("_c", udf(*[F.col(c).cast("double") for c in inputs]))
        out = self.base.receiver_slowness(out, "_s")
        # unit vector of the straight ray at the receiver, times 1 / v, is the base gradient
        terms = []
        reach = F.sqrt(sum((F.col(r) - F.col(s)) ** 2 for s, r in zip(src, rec)))
        for axis, s, r in zip("xyz", src, rec):
            direction = F.when(reach == 0, F.lit(0.0)).otherwise(
                (F.col(r) - F.col(s)) / F.nullif(reach, F.lit(0.0))
            )
            full = F.col("_c.c1") * direction * F.col("_s") + F.col("_t0") * F.col(f"_c.k1{axis}")
            terms.append(full * full)
        return out.withColumn(name, F.sqrt(terms[0] + terms[1] + terms[2])).drop("_t0", "_c", "_s")
