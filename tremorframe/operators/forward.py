"""Event state, differential-time prediction, residuals and their robust spread."""

from __future__ import annotations

from typing import Optional, Union

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorframe import lineage
from tremorframe.functions.geodesy import EqualArea
from tremorframe.operators.blocks import ObservationBlocks
from tremorframe.operators.scaling import GATHER_ROWS, exact_quantiles, first_per_key, group_sizes, small_side
from tremorframe.schemas import COMPONENTS

Observations = Union[DataFrame, ObservationBlocks]


def initial_state(origins: DataFrame, lat_min: float, lon_min: float) -> DataFrame:
    """Event state at the catalog positions, with zero shifts and zero optimizer memory.

    Of rows that share an event id one counts: the latest in time, then in longitude, latitude and
    depth.
    """
    order = [F.col(n).desc_nulls_last() for n in ("time", "longitude", "latitude", "depth") if n in origins.columns]
    origins = first_per_key(origins, ["evid"], order)
    x, y = EqualArea(lat_min, lon_min).forward(F.col("longitude"), F.col("latitude"))
    zeros = [
        F.lit(0.0).alias(f"{prefix}{c}") for prefix in ("", "m_", "v_") for c in COMPONENTS
    ]
    return origins.select(
        "evid",
        x.alias("x0"),
        y.alias("y0"),
        F.col("depth").cast("double").alias("z0"),
        *zeros,
        F.lit(0.0).alias("huber_sum"),
    )


def by_receiver(obs: DataFrame, parts: int, spread: int = 1) -> DataFrame:
    """Rows of a receiver and phase in one task, or ``spread`` of them, of ``parts`` tasks.

    For models that cost more than moving the rows: a task then meets every observation of an event at
    its receivers and finds their travel time once. ``spread`` splits the receivers by first event.
    """
    key = F.pmod(F.xxhash64("evid1"), F.lit(spread))
    return obs.repartition(parts, "X", "Y", "Z", "phase", key)


def attach_sources(obs: Observations, state: DataFrame, n_events: Optional[int] = None) -> DataFrame:
    """Join both ends of each observation to the current event positions and time shifts.

    ``n_events`` is the known size of ``state``; a small state is broadcast, a large one joined. The
    second end comes first: rows that were matched with the catalog lie by second event already.
    Observations in blocks stay where they are and get their parts of the state.
    """
    if isinstance(obs, ObservationBlocks):
        return obs.attach(state)
    out = obs
    for end in ("2", "1"):
        side = state.selectExpr(
            f"evid AS evid{end}",
            *[f"{a}0 + d{a} AS {a}{end}" for a in "xyz"],
            f"dt AS s{end}",
        )
        out = out.join(small_side(side, n_events), f"evid{end}")
    return out


def predict_dt(
    obs: Observations,
    state: DataFrame,
    model,
    gradients: bool = False,
    n_events: Optional[int] = None,
) -> DataFrame:
    """Add ``dt_pred`` = (T2 + shift2) - (T1 + shift1)."""
    joined = model.attach(attach_sources(obs, state, n_events), gradients)
    return joined.selectExpr("*", "(t2 + s2) - (t1 + s1) AS dt_pred")


def residuals(
    obs: Observations, state: DataFrame, model, n_events: Optional[int] = None
) -> DataFrame:
    """Observation columns with ``dt_pred`` and ``residual`` = observed minus predicted."""
    out = predict_dt(obs, state, model, n_events=n_events)
    return out.select(*obs.columns, "dt_pred", (F.col("dt") - F.col("dt_pred")).alias("residual"))


def phase_mad(
    resid: DataFrame, averaging: bool = False, rows: Optional[int] = None, **narrow
) -> DataFrame:
    """Median absolute deviation of ``residual`` per phase, as (phase, n_obs, mad).

    Medians are the lower middle element, or the mean of the middle two when ``averaging``.
    ``rows``, when known, bounds the group sizes. The result is computed at once.
    """
    spark = resid.sparkSession
    path = lineage.scratch_path(spark, "residuals")
    try:
        # both medians and the counts read the residuals, which are computed once
        stored = lineage.as_table(resid.select("phase", "residual"), "residuals", path=path)
        return lineage.cut(_phase_mad(stored, averaging, rows, narrow))
    finally:
        lineage.remove(spark, path)


def _phase_mad(resid: DataFrame, averaging: bool, rows: Optional[int], narrow: dict) -> DataFrame:
    # phase codes are 0, 1 or NULL, so this collects at most three counts
    counted = resid.groupBy("phase").agg(F.count("residual").alias("n")).collect()
    counts = {int(r["phase"]): r["n"] for r in counted if r["phase"] is not None}
    largest = max(counts.values(), default=0) if rows is None else rows
    options = {"lower": not averaging, "sizes": (len(counts), largest), **narrow}
    known = resid.filter(F.col("phase").isNotNull())
    centre = exact_quantiles(known, ["phase"], "residual", {"_m": 0.5}, **options)
    spread = known.join(F.broadcast(centre), "phase").select(
        "phase", F.abs(F.col("residual") - F.col("_m")).alias("_a")
    )
    mad = exact_quantiles(spread, ["phase"], "_a", {"mad": 0.5}, **options)
    n_obs = F.coalesce(
        *[F.when(F.col("phase") == k, F.lit(n)) for k, n in counts.items()],
        F.lit(0),
    )
    return mad.select("phase", n_obs.cast("long").alias("n_obs"), "mad")


def shift_stats(state: DataFrame, n_events: Optional[int] = None, **narrow) -> DataFrame:
    """One row of means, lower medians of magnitudes, and radius statistics of the event shifts.

    Up to ``gather_rows`` events all of it comes from one pass; beyond, the three medians are narrowed
    together and the radius beside them.
    """
    sizes = (1, n_events) if n_events is not None else group_sizes(state, [])
    radius = F.sqrt(
        F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz")
    )
    moves = state.select("dx", "dy", "dz", radius.alias("_r"))
    axes = {"X": "dx", "Y": "dy", "Z": "dz"}
    means = [F.avg(column).alias(f"mean_d{axis}") for axis, column in axes.items()]
    medians = [f"median_abs_d{axis}" for axis in axes]
    names = [*(f"mean_d{axis}" for axis in axes), *medians, "max_radius", "quantile_90_radius"]
    if sizes[1] <= narrow.get("gather_rows", GATHER_ROWS):
        # NaN takes no part in quantiles, as on the other path
        lower = "percentile_disc(0.5) WITHIN GROUP (ORDER BY nanvl({}, NULL))"
        middle = [F.expr(lower.format(f"abs({column})")).alias(m) for m, column in zip(medians, axes.values())]
        spread = F.percentile(F.nanvl("_r", F.lit(None).cast("double")), 0.9).alias("quantile_90_radius")
        return moves.agg(*means, *middle, F.max("_r").alias("max_radius"), spread).select(*names)
    base = moves.agg(*means, F.max("_r").alias("max_radius"))
    sides = F.array(*[F.struct(F.lit(m).alias("axis"), F.abs(c).alias("_a")) for m, c in zip(medians, axes.values())])
    long = moves.select(F.inline(sides))
    middle = exact_quantiles(long, ["axis"], "_a", {"m": 0.5}, lower=True, sizes=(3, sizes[1]), **narrow)
    wide = middle.agg(*[F.max(F.when(F.col("axis") == m, F.col("m"))).alias(m) for m in medians])
    spread = exact_quantiles(moves, [], "_r", {"quantile_90_radius": 0.9}, sizes=sizes, **narrow)
    beside = wide.select(F.struct(*medians)).scalar()
    return base.select(
        *[f"mean_d{axis}" for axis in axes],
        *[beside[m].alias(m) for m in medians],
        "max_radius",
        spread.scalar().alias("quantile_90_radius"),
    )


def relocated_catalog(
    origins: DataFrame,
    state: DataFrame,
    lat_min: float,
    lon_min: float,
    uncertainty: Optional[DataFrame] = None,
    shift_time: bool = False,
) -> DataFrame:
    """Catalog at the current event positions.

    ``time`` stays as it was; ``shift_time`` adds ``time_shifted`` = time + T_src. The uncertainty
    columns come from ``uncertainty`` (evid, sigma_x, sigma_y, sigma_z) and are NULL without it.
    """
    moved = state.select(
        "evid",
        F.col("dt").alias("T_src"),
        (F.col("x0") + F.col("dx")).alias("X"),
        (F.col("y0") + F.col("dy")).alias("Y"),
        (F.col("z0") + F.col("dz")).alias("depth"),
    )
    lon, lat = EqualArea(lat_min, lon_min).inverse(F.col("X"), F.col("Y"))
    moved = moved.withColumns({"longitude": lon, "latitude": lat})
    replaced = [c for c in origins.columns if c not in ("longitude", "latitude", "depth")]
    out = origins.select(*replaced).join(moved, "evid")
    sigmas = ["sigma_x", "sigma_y", "sigma_z"]
    if uncertainty is not None:
        out = out.join(uncertainty.select("evid", *sigmas), "evid", "left")
    for axis, sigma in zip("xyz", sigmas):
        value = F.col(sigma) if uncertainty is not None else F.lit(None).cast("double")
        out = out.withColumn(f"unc_{axis}", value)
    if uncertainty is not None:
        out = out.drop(*sigmas)
    if shift_time:
        micros = F.round(F.col("T_src") * 1e6).cast("long")
        out = out.withColumn(
            "time_shifted", F.timestamp_micros(F.unix_micros(F.col("time").cast("timestamp")) + micros)
        )
    return out
