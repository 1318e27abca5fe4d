"""Filters, de-duplication and joins that turn three input tables into observations.

Joins against catalogs and station lists take the list's row count when the caller knows it and
broadcast lists below the checked limit. Larger or uncounted ones are left to Spark, which compares
sizes itself and splits skewed keys of shuffled joins.
"""

from __future__ import annotations

import math
from typing import Optional

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorframe import lineage
from tremorframe.functions.geodesy import EqualArea, distance3
from tremorframe.functions.portable_random import uniform
from tremorframe.operators.scaling import first_per_key, keep_frequent, number_rows, small_side
from tremorframe.schemas import require_columns

DTIME_COLUMNS = ["network", "station", "dt", "evid1", "evid2", "phase", "cc"]


def parse_origin_time(origins: DataFrame, strict: bool = True) -> DataFrame:
    """Origin time from text to timestamp; unparsable text fails, or is NULL when not strict."""
    if dict(origins.dtypes)["time"].startswith("timestamp"):
        return origins
    parse = F.to_timestamp if strict else F.try_to_timestamp
    return origins.withColumn("time", parse(F.col("time")))


def spatial_subset(
    origins: DataFrame,
    lat_bounds: Optional[tuple[float, float]] = None,
    lon_bounds: Optional[tuple[float, float]] = None,
) -> DataFrame:
    """Events inside the closed bounds that are given."""
    if lat_bounds is not None:
        origins = origins.filter(F.col("latitude").between(*map(float, lat_bounds)))
    if lon_bounds is not None:
        origins = origins.filter(F.col("longitude").between(*map(float, lon_bounds)))
    return origins


def time_range(origins: DataFrame, start: str, end: str) -> DataFrame:
    """Events in the half-open range [start, end)."""
    t = F.col("time")
    return origins.filter(
        (t >= F.to_timestamp(F.lit(start))) & (t < F.to_timestamp(F.lit(end)))
    )


def encode_phase(dtimes: DataFrame) -> DataFrame:
    """Phase letter to 1 for S in any case, 0 for anything else; NULL stays NULL."""
    return dtimes.withColumn("phase", (F.upper("phase") == "S").cast("tinyint"))


def prune_columns(dtimes: DataFrame) -> DataFrame:
    return require_columns(dtimes, DTIME_COLUMNS, "differential times").select(*DTIME_COLUMNS)


def limit_abs_dt(dtimes: DataFrame, max_abs: float) -> DataFrame:
    """Keep |dt| strictly below ``max_abs`` when that is positive."""
    return dtimes.filter(F.abs("dt") < float(max_abs)) if max_abs > 0 else dtimes


def limit_cc(dtimes: DataFrame, cc_min: float) -> DataFrame:
    """Keep cc of at least ``cc_min`` when that is positive."""
    return dtimes.filter(F.col("cc") >= float(cc_min)) if cc_min > 0 else dtimes


def flip_sign(dtimes: DataFrame) -> DataFrame:
    return dtimes.withColumn("dt", -F.col("dt"))


def thin_observations(
    dtimes: DataFrame, fraction: float, seed: int = 42, key: Optional[list[str]] = None
) -> DataFrame:
    """Keep about ``fraction`` of the rows, chosen by a hash of ``key`` and ``seed``.

    The choice does not depend on partitioning or retries. Rows with equal keys share their fate:
    remove duplicates first, or name a row id as ``key``.
    """
    if fraction >= 1.0:
        return dtimes
    if fraction < 0.0:
        raise ValueError(f"fraction must be >= 0, got {fraction}")
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (key or dtimes.columns)]
    return dtimes.filter(uniform(F.lit(seed), *parts) < float(fraction))


# Hashes of 52 bits are narrowed by so many at a time.
_HASH_BITS, _CELL_BITS = 52, 13


def thin_exactly(
    dtimes: DataFrame, fraction: float, seed: int = 42, key: Optional[list[str]] = None
) -> DataFrame:
    """Keep exactly floor(``fraction`` times rows) rows: those with the smallest hash of ``key`` and ``seed``.

    The largest hash to keep is an order statistic. It is found by counting rows in cells of hashes and
    counting again within the cell that holds it, so a pass gives the driver some thousand counts and no
    row moves. Rows of that very hash are taken in order of all columns. They are repeats of one key, so
    they may be many: they are numbered in range partitions.
    """
    if not 0.0 <= fraction:
        raise ValueError(f"fraction must be >= 0, got {fraction}")
    if fraction >= 1.0:
        return dtimes
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (key or dtimes.columns)]
    span = float(1 << _HASH_BITS)
    hashed = lineage.as_table(dtimes.withColumn("_hash", (uniform(F.lit(seed), *parts) * span).cast("long")), "hashed")
    wanted = math.floor(fraction * hashed.count())
    if wanted == 0:
        return hashed.filter(F.lit(False)).drop("_hash")
    low, left = 0, wanted
    for shift in range(_HASH_BITS - _CELL_BITS, -1, -_CELL_BITS):
        inside = hashed.filter(F.col("_hash").between(low, low + (1 << (shift + _CELL_BITS)) - 1))
        cell = F.shiftright(F.col("_hash") - low, shift)
        # at most 2 ** _CELL_BITS counts
        counts = sorted(inside.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect())
        for at, n in counts:
            if left <= n:
                low += at << shift
                break
            left -= n
    below = hashed.filter(F.col("_hash") < low).drop("_hash")
    last = hashed.filter(F.col("_hash") == low).drop("_hash")
    # ``left`` of these are still wanted
    return below.unionByName(number_rows(last, "_place", dtimes.columns).filter(F.col("_place") < left).drop("_place"))


def unordered_pair() -> dict[str, Column]:
    return {
        "evid_min": F.least("evid1", "evid2"),
        "evid_max": F.greatest("evid1", "evid2"),
    }


def distinct_stations(stations: DataFrame) -> DataFrame:
    """One row per (network, station): the first by longitude, latitude, depth."""
    order = [F.col(c).asc_nulls_last() for c in ("longitude", "latitude", "depth")]
    return first_per_key(stations, ["network", "station"], order)


def distinct_observations(dtimes: DataFrame) -> DataFrame:
    """One row per unordered pair, station and phase: the best correlated.

    Ties go to the smaller evid1, evid2, dt. A kept row with reversed ends keeps its sign.
    """
    keyed = dtimes.withColumns(unordered_pair())
    keys = ["evid_min", "evid_max", "network", "station", "phase"]
    order = [
        F.col("cc").desc_nulls_last(),
        F.col("evid1"),
        F.col("evid2"),
        F.col("dt").asc_nulls_last(),
    ]
    return first_per_key(keyed, keys, order).drop("evid_min", "evid_max")


def with_known_events(
    dtimes: DataFrame, origins: DataFrame, n_events: Optional[int] = None
) -> DataFrame:
    """Differential times whose two events are both in the catalog."""
    ids = origins.select("evid")
    out = dtimes
    for end in ("evid1", "evid2"):
        side = small_side(ids.withColumnRenamed("evid", end), n_events)
        out = out.join(side, end, "left_semi")
    return out.select(*dtimes.columns)


def used_event_ids(dtimes: DataFrame) -> DataFrame:
    """Distinct event ids over both ends."""
    return dtimes.select(F.explode(F.array("evid1", "evid2")).alias("evid")).distinct()


def used_origins(origins: DataFrame, dtimes: DataFrame) -> DataFrame:
    """Catalog events that occur in at least one differential time."""
    return origins.join(used_event_ids(dtimes), "evid", "left_semi").select(*origins.columns)


def min_rows_per_ordered_pair(dtimes: DataFrame, min_rows: int) -> DataFrame:
    """Rows of (evid1, evid2) pairs with at least ``min_rows`` rows."""
    keys = {"_e1": F.col("evid1"), "_e2": F.col("evid2")}
    return keep_frequent(dtimes, keys, min_rows)


def min_dtimes_per_pair(
    origins: DataFrame, dtimes: DataFrame, min_rows: int
) -> tuple[DataFrame, DataFrame]:
    """(origins, dtimes) restricted to ordered pairs with at least ``min_rows`` rows."""
    kept = min_rows_per_ordered_pair(dtimes, min_rows)
    return used_origins(origins, kept), kept


def min_rows_per_unordered_pair(dtimes: DataFrame, min_rows: int) -> DataFrame:
    """Rows of unordered event pairs with at least ``min_rows`` rows.

    One pass suffices: dropping whole pairs leaves the counts of all other pairs unchanged.
    """
    return keep_frequent(dtimes, unordered_pair(), min_rows)


def project_stations(stations: DataFrame, lat_min: float, lon_min: float) -> DataFrame:
    x, y = EqualArea(lat_min, lon_min).forward(F.col("longitude"), F.col("latitude"))
    return stations.select("*", x.alias("X"), y.alias("Y"), F.col("depth").alias("Z"))


def join_stations(
    dtimes: DataFrame,
    stations: DataFrame,
    lat_min: float,
    lon_min: float,
    n_stations: Optional[int] = None,
) -> DataFrame:
    """Observations with station coordinates; rows of unknown stations drop out."""
    projected = project_stations(stations, lat_min, lon_min)
    return dtimes.join(small_side(projected, n_stations), ["network", "station"])


def project_origins(origins: DataFrame, lat_min: float, lon_min: float) -> DataFrame:
    x, y = EqualArea(lat_min, lon_min).forward(F.col("longitude"), F.col("latitude"))
    return origins.select("*", x.alias("X"), y.alias("Y"))


def cut_long_edges(
    dtimes: DataFrame,
    origins: DataFrame,
    r_max: float,
    lat_min: float,
    lon_min: float,
    n_events: Optional[int] = None,
) -> DataFrame:
    """Differential times whose events lie less than ``r_max`` km apart.

    The distance is a function of the pair, so rows are filtered where they are instead of listing
    the long pairs and anti-joining.
    """
    places = project_origins(origins, lat_min, lon_min).select("evid", "X", "Y", "depth")
    joined = dtimes
    for end in ("1", "2"):
        side = places.select(
            F.col("evid").alias(f"evid{end}"),
            F.col("X").alias(f"_x{end}"),
            F.col("Y").alias(f"_y{end}"),
            F.col("depth").alias(f"_z{end}"),
        )
        joined = joined.join(small_side(side, n_events), f"evid{end}")
    at = lambda end: [F.col(f"_{axis}{end}") for axis in "xyz"]
    return joined.filter(distance3(*at("1"), *at("2")) < float(r_max)).select(*dtimes.columns)


def number_observations(
    obs: DataFrame, order: Optional[list[str]] = None, name: str = "arid"
) -> DataFrame:
    """Add the dense observation ordinal ``arid``."""
    return number_rows(obs, name, order)


def station_bounds(
    stations: DataFrame,
    lat_bounds: tuple[float, float],
    lon_bounds: tuple[float, float],
) -> DataFrame:
    """One row: station extremes and whether all stations lie inside the box."""
    ext = stations.agg(
        F.min("latitude").alias("lat_lo"),
        F.max("latitude").alias("lat_hi"),
        F.min("longitude").alias("lon_lo"),
        F.max("longitude").alias("lon_hi"),
    )
    ok = (
        (F.col("lat_lo") >= float(lat_bounds[0]))
        & (F.col("lat_hi") <= float(lat_bounds[1]))
        & (F.col("lon_lo") >= float(lon_bounds[0]))
        & (F.col("lon_hi") <= float(lon_bounds[1]))
    )
    return ext.withColumn("inside", ok)


def check_station_bounds(
    stations: DataFrame,
    lat_bounds: tuple[float, float],
    lon_bounds: tuple[float, float],
) -> None:
    """Fail when a station lies outside the box."""
    row = station_bounds(stations, lat_bounds, lon_bounds).first()
    if row["inside"] is False:
        raise ValueError("one or more stations lie outside the latitude or longitude bounds")


def stage_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """Rows after each named stage, as (stage, n_rows)."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("stage"), "n_rows")
        for name, df in stages.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
