"""Layered velocity profiles: linear interpolation in depth by a binary search in array literals."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def profile_nodes(velocity_model: DataFrame) -> list[tuple[float, float, float]]:
    """(depth, vp, vs) nodes of a profile table in depth order; depths must differ."""
    # one row per depth of a model, whose number does not depend on the data
    rows = velocity_model.select("depth", "vp", "vs").collect()
    nodes = sorted((r["depth"], r["vp"], r["vs"]) for r in rows)
    _check([z for z, _, _ in nodes])
    return nodes


def _check(depths: Sequence[float]) -> None:
    if len(depths) < 2:
        raise ValueError("velocity model needs at least two depth nodes")
    if any(a >= b for a, b in zip(depths, depths[1:])):
        raise ValueError("depths of a velocity model must increase")


def _doubles(values: Sequence[float]) -> Column:
    """Array of doubles that the optimizer folds into one literal."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def _layer(depths: Sequence[float], depth: Column) -> Column:
    """0-based index of the layer that holds ``depth``, by halving steps; the outer layers reach on."""
    nodes = _doubles(depths)
    last = len(depths) - 2
    steps = [1 << k for k in range(last.bit_length() - 1, -1, -1)]

    def step(low: Column, width: Column) -> Column:
        ahead = low + width
        deeper = F.get(nodes, F.least(ahead, F.lit(last))) <= depth
        return F.when((ahead <= last) & deeper, ahead).otherwise(low)

    return F.aggregate(F.array(*[F.lit(n) for n in steps]), F.lit(0), step) if steps else F.lit(0)


def _interpolated(depths: Sequence[float], values: Column, depth: Column, outside: str) -> Column:
    if outside not in {"error", "null"}:
        raise ValueError("outside must be 'error' or 'null'")
    _check(depths)
    nodes = _doubles(depths)

    def at(i: Column) -> Column:
        z0, z1 = F.get(nodes, i), F.get(nodes, i + 1)
        v0, v1 = F.get(values, i), F.get(values, i + 1)
        return v0 + (depth - z0) * ((v1 - v0) / (z1 - z0))

    # the array of one index binds it, so that the search runs once per row
    value = F.get(F.transform(F.array(_layer(depths, depth)), at), F.lit(0))
    found = F.when((depth >= float(depths[0])) & (depth <= float(depths[-1])), value)
    if outside == "error":
        message = F.lit("depth outside the velocity model: ")
        # a NULL depth is missing data, not an out-of-range one
        found = found.when(depth.isNotNull(), F.raise_error(F.concat(message, depth.cast("string"))))
    return found


def interpolate(
    nodes: Sequence[tuple[float, float]], depth: Column, outside: str = "error"
) -> Column:
    """Piecewise linear value at ``depth``; ``outside`` the nodes it fails or gives NULL."""
    return _interpolated([z for z, _ in nodes], _doubles([v for _, v in nodes]), depth, outside)


def slowness_at(
    nodes: Sequence[tuple[float, float, float]],
    depth: Column,
    phase: Column,
    outside: str = "error",
) -> Column:
    """1 / v for the row's phase (0 = P, 1 = S) at ``depth``."""
    vp, vs = (_doubles([n[k] for n in nodes]) for k in (1, 2))
    speeds = F.when(phase >= 0.5, vs).otherwise(vp)
    return 1 / _interpolated([n[0] for n in nodes], speeds, depth, outside)
