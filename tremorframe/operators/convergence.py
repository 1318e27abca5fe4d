"""Convergence measures over epochs and steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorframe.schemas import COMPONENTS


def relative_change(
    snapshots: DataFrame, lag: int, components: list[str] = COMPONENTS, name: str = "relative_change"
) -> DataFrame:
    """Per epoch: norm of (state - state ``lag`` epochs before) over the norm of the earlier state.

    ``snapshots`` holds one row per (evid, epoch); the pairing is an equi-join on that key, so all
    epochs of an event need not meet in one task. Epochs without an earlier snapshot get NULL.
    """
    if lag < 1:
        raise ValueError(f"lag must be >= 1, got {lag}")
    earlier = snapshots.select(
        "evid", (F.col("epoch") + lag).alias("epoch"), *[F.col(c).alias(f"_p_{c}") for c in components]
    )
    paired = snapshots.select("evid", "epoch", *components).join(earlier, ["evid", "epoch"], "left")
    moved = sum((F.col(c) - F.col(f"_p_{c}")) * (F.col(c) - F.col(f"_p_{c}")) for c in components)
    before = sum(F.col(f"_p_{c}") * F.col(f"_p_{c}") for c in components)
    change = F.sqrt(F.sum(moved)) / (F.sqrt(F.sum(before)) + 1e-12)
    return paired.groupBy("epoch").agg(change.alias(name))


def loss_plateau(metrics: DataFrame, win: int = 2000, rel_slope: float = 0.01) -> DataFrame:
    """Per run: does the loss trend over the last ``win`` steps count as flat?

    Flat means |slope per 1000 steps| <= ``rel_slope`` * (population std + 1e-12); fewer than
    ``win`` values count as flat. ``metrics`` has (run_id, step, loss) with consecutive steps.
    """
    ends = metrics.groupBy("run_id").agg(F.max("step").alias("_end"))
    recent = metrics.join(ends, "run_id").filter(F.col("step") > F.col("_end") - win)
    # steps relative to the end keep the regression well conditioned
    x = (F.col("step") - F.col("_end")).cast("double")
    fitted = recent.groupBy("run_id").agg(
        F.count("loss").alias("n"),
        F.regr_slope("loss", x).alias("_slope"),
        F.stddev_pop("loss").alias("loss_std"),
    )
    slope = 1000 * F.coalesce(F.col("_slope"), F.lit(0.0))
    flat = F.abs(slope) <= rel_slope * (F.col("loss_std") + 1e-12)
    return fitted.select(
        "run_id",
        "n",
        slope.alias("slope_per_1000"),
        "loss_std",
        F.when(F.col("n") < win, F.lit(True)).otherwise(flat).alias("plateau"),
    )
