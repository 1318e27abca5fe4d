"""Repair of damaged catalogs and differential-time tables before preparation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorframe.operators.scaling import number_rows

# Defaults of missing columns and the accepted phase letters.
CATALOG_NUMBERS = ["longitude", "latitude", "depth"]
DEFAULT_TIME = "2023-01-01T00:00:00"
DTIME_TEXT_DEFAULTS = {
    "event1_id": "unknown",
    "event2_id": "unknown",
    "station": "unknown",
    "phase": "P",
}
DTIME_NUMBERS = ["dt_obs", "dt_err"]
VALID_PHASES = ["P", "S", "p", "s"]


def _numbers(df: DataFrame, names: list[str]) -> DataFrame:
    # NaN counts as missing, as unreadable text does
    parsed = {n: F.col(n).cast("string").try_cast("double") for n in names}
    df = df.withColumns({n: F.when(~F.isnan(c), c) for n, c in parsed.items()})
    return df.dropna(subset=names)


def repair_catalog(catalog: DataFrame) -> DataFrame:
    """Add missing columns, coerce numbers and times, drop rows where either cannot be read."""
    out = catalog
    if "event_id" not in out.columns:
        out = number_rows(out, "_i")
        digits = F.col("_i").cast("string")
        padded = F.when(F.col("_i") < 1000, F.lpad(digits, 3, "0")).otherwise(digits)
        out = out.withColumn("event_id", F.concat(F.lit("evt_"), padded)).drop("_i")
    for name in CATALOG_NUMBERS:
        if name not in out.columns:
            out = out.withColumn(name, F.lit(0.0))
    if "origin_time" not in out.columns:
        out = out.withColumn("origin_time", F.lit(DEFAULT_TIME))
    out = _numbers(out, CATALOG_NUMBERS)
    out = out.withColumn("origin_time", F.try_to_timestamp(F.col("origin_time").cast("string")))
    return out.dropna(subset=["origin_time"])


def repair_dtimes(dtimes: DataFrame) -> DataFrame:
    """Add missing columns, coerce numbers, make errors positive, keep valid phases."""
    out = dtimes
    for name, default in DTIME_TEXT_DEFAULTS.items():
        if name not in out.columns:
            out = out.withColumn(name, F.lit(default))
    for name in DTIME_NUMBERS:
        if name not in out.columns:
            out = out.withColumn(name, F.lit(0.0))
    out = _numbers(out, DTIME_NUMBERS)
    out = out.withColumn("dt_err", F.abs("dt_err"))
    return out.filter(F.col("phase").isin(VALID_PHASES))
