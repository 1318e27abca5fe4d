"""Synthetic source-receiver pairs with target slowness, for training a travel-time network."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorframe.functions.portable_random import gaussian, uniform
from tremorframe.functions.velocity import slowness_at


@dataclass(frozen=True)
class Box:
    """Horizontal extent 0 .. ``scale`` km and depth range."""

    scale: float
    z_min: float
    z_max: float


def training_pairs(
    ids: DataFrame,
    box: Box,
    nodes: Sequence[tuple[float, float, float]],
    seed: int = 0,
    id_column: str = "id",
) -> DataFrame:
    """One pair per id: uniform source in the box, receiver at a random direction and distance.

    The distance is uniform in [0.1, scale]; the receiver is clamped to the box. ``s_true`` is the
    profile's slowness at the receiver for the random phase. Values are keyed by id and ``seed``.
    """
    key = F.col(id_column)
    u = lambda tag: uniform(F.lit(seed), key, F.lit(tag))
    scale, z_min, z_max = float(box.scale), float(box.z_min), float(box.z_max)
    drawn = ids.select(
        key,
        (u("x") * scale).alias("x_src"),
        (u("y") * scale).alias("y_src"),
        (z_min + u("z") * (z_max - z_min)).alias("z_src"),
        *[gaussian(F.lit(seed), key, F.lit(f"n{a}")).alias(f"_n{a}") for a in "xyz"],
        (0.1 + u("r") * (scale - 0.1)).alias("_radius"),
        F.floor(u("p") * 2).cast("int").alias("phase"),
    )
    norm = F.sqrt(sum(F.col(f"_n{a}") * F.col(f"_n{a}") for a in "xyz")) + 1e-8
    clamp = lambda c, lo, hi: F.least(F.greatest(c, F.lit(lo)), F.lit(hi))
    limits = {"x": (0.0, scale), "y": (0.0, scale), "z": (z_min, z_max)}
    placed = drawn.withColumn("_reach", F.col("_radius") / norm).select(
        id_column,
        "x_src",
        "y_src",
        "z_src",
        *[
            clamp(F.col(f"{a}_src") + F.col(f"_n{a}") * F.col("_reach"), *limits[a]).alias(f"{a}_rec")
            for a in "xyz"
        ],
        "phase",
    )
    return placed.withColumn("s_true", slowness_at(nodes, F.col("z_rec"), F.col("phase")))


def sinusoidal_velocity(z: Column) -> Column:
    """Test profile: sin(2 pi 10 z) + 3."""
    return F.sin(2 * 3.141592653589793 * 10.0 * z) + 3.0
