"""Append-only Parquet store of posterior draws, partitioned by batch.

A row is one draw of one event: ``(batch_id, evid, draw, longitude, latitude, depth, delta_t, X, Y,
Z)``. ``draw`` counts from 0 inside its batch; X, Y, Z and delta_t are shifts, depth is absolute.
"""

from __future__ import annotations

from typing import Optional, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorframe.functions.geodesy import EqualArea
from tremorframe.schemas import SAMPLE_FIELDS, SAMPLES


def _stored(spark: SparkSession, path: str) -> DataFrame:
    # the schema comes from the files, because event ids may be integers or text
    try:
        found = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return spark.createDataFrame([], SAMPLES)
        raise
    return found.withColumn("batch_id", F.col("batch_id").cast("long"))


def build_rows(
    draws: DataFrame, lat_min: float, lon_min: float, store_lonlat: bool = True
) -> DataFrame:
    """Store rows from draws ``(evid, draw, x0, y0, z0, dx, dy, dz, dt)``.

    Without ``store_lonlat`` longitude and latitude are NULL.
    """
    if store_lonlat:
        lon, lat = EqualArea(lat_min, lon_min).inverse(
            F.col("x0") + F.col("dx"), F.col("y0") + F.col("dy")
        )
    else:
        lon = lat = F.lit(None)
    values = {
        "longitude": lon,
        "latitude": lat,
        "depth": F.col("z0") + F.col("dz"),
        "delta_t": F.col("dt"),
        "X": F.col("dx"),
        "Y": F.col("dy"),
        "Z": F.col("dz"),
    }
    return draws.select(
        "evid", "draw", *[values[n].cast("float").alias(n) for n in SAMPLE_FIELDS]
    )


def append_batch(rows: DataFrame, path: str, batch_id: Optional[int] = None) -> int:
    """Write ``rows`` as one batch and return its number; the next free one by default.

    Only the batch's own partition is replaced, so repeating a write leaves one copy. Files are
    ordered by event, so that reads of some events skip most row groups.
    """
    number = next_batch_id(rows.sparkSession, path) if batch_id is None else batch_id
    (
        rows.repartitionByRange("evid", "draw")
        .sortWithinPartitions("evid", "draw")
        .withColumn("batch_id", F.lit(number).cast("long"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch_id")
        .parquet(path)
    )
    return number


def save_samples(
    draws: Optional[DataFrame],
    path: str,
    lat_min: float,
    lon_min: float,
    batch_id: Optional[int] = None,
    store_lonlat: bool = True,
) -> Optional[int]:
    """Convert draws to store rows and append them; without draws nothing is written."""
    if draws is None or draws.isEmpty():
        return None
    return append_batch(build_rows(draws, lat_min, lon_min, store_lonlat), path, batch_id)


def next_batch_id(spark: SparkSession, path: str) -> int:
    """Highest batch number plus one, 0 for an absent or empty store."""
    top = next_batch(_stored(spark, path)).first()
    return top["next_batch_id"]


def next_batch(samples: DataFrame) -> DataFrame:
    return samples.agg(F.coalesce(F.max("batch_id") + 1, F.lit(0)).alias("next_batch_id"))


def read_samples(
    spark: SparkSession,
    path: str,
    thin: int = 1,
    event_ids: Optional[DataFrame | Sequence[int]] = None,
) -> DataFrame:
    """All draws, every ``thin``-th of each batch; empty when the store is absent.

    ``event_ids`` restricts the events: a list becomes a scan filter, a frame a semi join.
    """
    return select_events(thin_batches(_stored(spark, path), thin), event_ids)


def thin_batches(samples: DataFrame, thin: int) -> DataFrame:
    """Draws 0, n, 2n, ... of each batch, numbered anew from 0; the count restarts in every batch."""
    if thin < 1:
        raise ValueError(f"thin must be >= 1, got {thin}")
    if thin == 1:
        return samples
    kept = samples.filter(F.col("draw") % thin == 0)
    return kept.withColumn("draw", F.expr(f"draw div {int(thin)}"))


def select_events(
    samples: DataFrame, event_ids: Optional[DataFrame | Sequence[int]] = None
) -> DataFrame:
    if event_ids is None:
        return samples
    if isinstance(event_ids, DataFrame):
        return samples.join(event_ids.select("evid"), "evid", "left_semi").select(*samples.columns)
    return samples.filter(F.col("evid").isin(list(event_ids)))


def batch_metadata(samples: DataFrame) -> DataFrame:
    """Per batch: number of events, draws per event and rows."""
    return samples.groupBy("batch_id").agg(
        F.countDistinct("evid").alias("n_events"),
        (F.max("draw") + 1).alias("sample_count"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def store_metadata(samples: DataFrame) -> DataFrame:
    """One row: events, batches and draws per chain of the whole store."""
    batches = samples.groupBy("batch_id").agg((F.max("draw") + 1).alias("w"))
    totals = batches.agg(
        F.struct(F.count(F.lit(1)).alias("n_batches"), F.sum("w").alias("n_draws"))
    ).scalar()
    return samples.agg(F.countDistinct("evid").alias("n_events")).select(
        "n_events",
        totals["n_batches"].alias("n_batches"),
        F.coalesce(totals["n_draws"], F.lit(0)).alias("n_draws"),
    )


def event_ids(samples: DataFrame) -> DataFrame:
    return samples.select("evid").distinct()


def clear_samples(spark: SparkSession, path: str) -> bool:
    """Empty the store; True also when there was none."""
    if not _stored(spark, path).isEmpty():
        empty = spark.createDataFrame([], SAMPLES)
        empty.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(
            "batch_id"
        ).parquet(path)
    return True
