"""The fixed chain from three input tables to observations."""

from __future__ import annotations

import uuid
from typing import Optional

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tremorframe import lineage
from tremorframe.operators import observations as ops
from tremorframe.params import RunParams
from tremorframe.sources import tables


class _Marks:
    """Counts rows of stages while the write that they lead to runs."""

    def __init__(self, counts: Optional[dict[str, int]]):
        self.counts = counts
        self._open: dict[str, Observation] = {}

    def on(self, df: DataFrame, stage: str) -> DataFrame:
        if self.counts is None:
            return df
        self._open[stage] = Observation(f"{stage}-{uuid.uuid4().hex}")
        return df.observe(self._open[stage], F.count(F.lit(1)).alias("rows"))

    def written(self, df: DataFrame, name: str) -> DataFrame:
        table = lineage.as_table(df, name)
        for stage, seen in self._open.items():
            # a stage that the planner knows to be empty is not observed
            self.counts[stage] = seen.get.get("rows", 0)
        self._open = {}
        return table


def prepare_observations(
    stations: DataFrame,
    origins: DataFrame,
    dtimes: DataFrame,
    params: RunParams,
    stage: bool = False,
    counts: Optional[dict[str, int]] = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(stations, observations, origins) ready for relocation.

    The order is part of the result: duplicates go before the quality filters, ordered pairs are
    counted before unknown stations drop out and unordered pairs after. Restricting the catalog to
    used events happens once, at the end: the earlier restriction after the ordered-pair count
    keeps a superset of it.

    Events and stations are counted first, so that joins with them broadcast within a checked limit.
    A pair filter reads its input twice, to count and to select. ``stage`` writes that input to
    shared storage once instead of repeating the steps before it; worth it when those are costly,
    as parsing text or removing duplicates is.

    ``counts`` is filled with the rows that each stage leaves. They are counted as the rows pass: the
    input of every pair filter and the result are written once then, and no stage runs twice for it.
    """
    marks = _Marks(counts)
    stations = ops.distinct_stations(stations)
    origins = ops.parse_origin_time(origins)
    origins = ops.spatial_subset(origins, params.event_lat_bounds, params.event_lon_bounds)
    n_events, n_stations = origins.count(), stations.count()

    if counts is not None:
        counts["events"], counts["stations"] = n_events, n_stations
    obs = marks.on(ops.prune_columns(ops.encode_phase(dtimes)), "dtimes")
    obs = marks.on(ops.with_known_events(obs, origins, n_events), "known_events")
    if params.remove_duplicates:
        obs = marks.on(ops.distinct_observations(obs), "distinct")
    obs = marks.on(ops.limit_abs_dt(obs, params.max_abs_input_dt), "abs_dt")
    if params.dtime_thin_exact and params.dtime_thin_frac < 1.0 and counts is not None:
        obs = marks.written(obs, "unthinned-dtimes")
    thin = ops.thin_exactly if params.dtime_thin_exact else ops.thin_observations
    obs = marks.on(thin(obs, params.dtime_thin_frac, params.thin_seed), "thinned")
    if params.flip_dt_sign:
        obs = ops.flip_sign(obs)
    obs = marks.on(ops.limit_cc(obs, params.cc_min), "cc")
    paired = params.min_dtimes_per_pair > 0 or params.min_dtimes > 0
    if counts is not None:
        obs = marks.written(obs, "filtered-dtimes")
    elif stage and paired:
        obs = lineage.as_table(obs, "filtered-dtimes")
    if params.min_dtimes_per_pair > 0:
        obs = marks.on(ops.min_rows_per_ordered_pair(obs, params.min_dtimes_per_pair), "ordered_pairs")
    obs = ops.join_stations(obs, stations, params.lat_min, params.lon_min, n_stations)
    obs = marks.on(obs, "known_stations")
    if params.min_dtimes > 0:
        if counts is not None:
            obs = marks.written(obs, "stationed-dtimes")
        obs = marks.on(ops.min_rows_per_unordered_pair(obs, params.min_dtimes), "unordered_pairs")
    if counts is not None:
        obs = marks.written(obs, "prepared-dtimes")
    used = ops.used_origins(origins, obs)
    if counts is not None:
        used = lineage.as_table(used, "used-events")
        counts["used_events"] = used.count()
    return stations, obs, used


def prepare_inputs(
    spark: SparkSession, params: RunParams, counts: Optional[dict[str, int]] = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Read the three files that ``params`` names and prepare them; ``counts`` as above.

    Event ids are integers when all ids of the catalog are, else text, unless ``params`` says which.
    """
    for name in ("station_file", "catalog_infile", "dtime_file"):
        if getattr(params, name) is None:
            raise KeyError(f"parameters lack {name}")
    ids = params.evid_type
    if ids == "auto":
        ids = tables.catalog_id_type(spark, params.catalog_infile)
    return prepare_observations(
        tables.read_stations(spark, params.station_file),
        tables.read_catalog(spark, params.catalog_infile, parse_time=False, id_type=ids),
        tables.read_dtimes(spark, params.dtime_file, id_type=ids),
        params,
        stage=tables.is_text(params.dtime_file) or params.remove_duplicates,
        counts=counts,
    )
