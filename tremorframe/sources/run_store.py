"""Resumable run state and run logs as Parquet tables, one folder per run."""

from __future__ import annotations

from typing import Any, Optional

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremorframe import schemas
from tremorframe.params import RunParams

_SEQ = T.StructField("seq", T.LongType())
_RUN_STATE = T.StructType([*schemas.RUN_STATE.fields, _SEQ])
_EVENT_STATE = T.StructType([*schemas.EVENT_STATE.fields, _SEQ])


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def _event_states(spark: SparkSession, path: str) -> DataFrame:
    # the schema comes from the files, because event ids may be integers or text
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return spark.createDataFrame([], _EVENT_STATE)
        raise


def _write_partition(df: DataFrame, path: str, by: str) -> None:
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(by)
        .parquet(path)
    )


def latest(run_states: DataFrame) -> DataFrame:
    """One row: the run state with the highest ``seq``."""
    row = F.struct(*run_states.columns)
    return run_states.agg(F.max_by(row, "seq").alias("s")).filter("s is not null").select("s.*")


class RunStore:
    """Checkpoints of one run below ``folder/run_id``.

    A monotone ``seq`` names each checkpoint, so phases never overwrite one another. The run-state
    row is written after the event state it belongs to and marks the checkpoint complete.
    """

    def __init__(self, spark: SparkSession, folder: str, run_id: str = "run"):
        self.spark, self.run_id = spark, run_id
        base = f"{folder.rstrip('/')}/{run_id}"
        self.state_path, self.event_path = f"{base}/run_state", f"{base}/event_state"

    def save(
        self,
        state: DataFrame,
        phase: str,
        epoch: int,
        n_obs: int,
        optimizer_type: str,
        optimizer_step: int,
        global_step_count: int,
        stats: Optional[dict[str, float]] = None,
    ) -> int:
        last = self.load_row()
        seq = 0 if last is None else last["seq"] + 1
        columns = schemas.EVENT_STATE.fieldNames()
        events = state.select(*columns).withColumn("seq", F.lit(seq).cast("long"))
        _write_partition(events, self.event_path, "seq")
        row = (
            self.run_id,
            phase,
            epoch,
            n_obs,
            optimizer_type,
            optimizer_step,
            global_step_count,
            stats or {},
            seq,
        )
        marker = self.spark.createDataFrame([row], _RUN_STATE).coalesce(1)
        _write_partition(marker, self.state_path, "seq")
        return seq

    def load_row(self) -> Optional[dict[str, Any]]:
        """The newest run-state row, or None."""
        row = latest(_read(self.spark, self.state_path, _RUN_STATE)).first()
        if row is None:
            return None
        out = row.asDict(recursive=True)
        out["phase"] = out["phase"] or "phase4"
        return out

    def load(self) -> Optional[tuple[dict[str, Any], DataFrame]]:
        """(run-state row, event state) of the newest checkpoint, or None."""
        row = self.load_row()
        if row is None:
            return None
        events = _event_states(self.spark, self.event_path)
        return row, events.filter(F.col("seq") == row["seq"]).drop("seq")

    def clear(self) -> bool:
        """Empty this run's checkpoints; True also when there were none."""
        stored = (
            (self.state_path, _read(self.spark, self.state_path, _RUN_STATE)),
            (self.event_path, _event_states(self.spark, self.event_path)),
        )
        for path, rows in stored:
            if not rows.isEmpty():
                empty = self.spark.createDataFrame([], rows.schema)
                empty.write.mode("overwrite").option(
                    "partitionOverwriteMode", "static"
                ).partitionBy("seq").parquet(path)
        return True


class RunLog:
    """Per-epoch metric rows, buffered on the driver and appended in batches."""

    def __init__(self, spark: SparkSession, path: Optional[str], run_id: str = "run"):
        self.spark, self.path, self.run_id = spark, path, run_id
        self.rows: list[dict[str, Any]] = []

    def log(self, phase: str, epoch: Optional[int], **metrics: Any) -> None:
        known = set(schemas.RUN_METRICS.fieldNames())
        unknown = set(metrics) - known
        if unknown:
            raise KeyError(f"unknown metrics {sorted(unknown)}")
        self.rows.append({"run_id": self.run_id, "phase": phase, "epoch": epoch, **metrics})

    def flush(self) -> None:
        if self.path and self.rows:
            names = schemas.RUN_METRICS.fieldNames()
            data = [tuple(r.get(n) for n in names) for r in self.rows]
            frame = self.spark.createDataFrame(data, schemas.RUN_METRICS).coalesce(1)
            frame.write.mode("append").parquet(self.path)
        self.rows = []


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, schemas.RUN_METRICS)


# Parameters that a run's configuration row records.
CONFIG_KEYS = [
    "phase1_epochs",
    "phase2_epochs",
    "phase3_epochs",
    "phase4_epochs",
    "lr_warmup",
    "lr_sgld",
    "batch_size_warmup",
    "batch_size_sgld",
    "save_every_n",
    "checkpoint_interval",
    "phase_unc",
    "prior_event_std",
    "prior_centroid_std",
]


def run_config(
    spark: SparkSession,
    params: dict[str, Any],
    total_events: Optional[int] = None,
    total_dtimes: Optional[int] = None,
) -> DataFrame:
    """One row with a string map of the recorded parameters and data counts."""
    config = {k: params[k] for k in CONFIG_KEYS if params.get(k) is not None}
    if total_events is not None:
        config["total_events"] = total_events
    if total_dtimes is not None:
        config["total_dtimes"] = total_dtimes
    text = {k: str(list(v) if isinstance(v, tuple) else v) for k, v in config.items()}
    return spark.createDataFrame([(text,)], "config map<string,string>")


def write_config(
    spark: SparkSession, params: RunParams, total_events: int, total_dtimes: int, run_id: str = "run"
) -> None:
    """Store the configuration of a run; a later start of the same run replaces it."""
    row = run_config(spark, params.as_dict(), total_events, total_dtimes).withColumn("run_id", F.lit(run_id))
    _write_partition(row.coalesce(1), params.config_outfile, "run_id")


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """run_id, config of every run that has stored its configuration below ``path``."""
    return _read(spark, path, schemas.RUN_CONFIG)
