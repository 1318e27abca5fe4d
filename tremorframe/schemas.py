"""Explicit schemas of every table the library reads or writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _struct(spec: dict[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in spec.items()])


_D, _L, _S = T.DoubleType(), T.LongType(), T.StringType()

STATIONS = _struct({"network": _S, "station": _S, "longitude": _D, "latitude": _D, "depth": _D})

# ``time`` is text on disk and becomes a timestamp in ``parse_origin_time``.
CATALOG = _struct({"evid": _L, "longitude": _D, "latitude": _D, "depth": _D, "time": _S})

DTIMES = _struct(
    {"network": _S, "station": _S, "dt": _D, "evid1": _L, "evid2": _L, "phase": _S, "cc": _D}
)

VELOCITY_MODEL = _struct({"depth": _D, "vs": _D, "vp": _D})

TRUTH = _struct({"lon": _D, "lat": _D, "depth": _D})

# The seven fields of one stored draw, in storage order.
SAMPLE_FIELDS = ["longitude", "latitude", "depth", "delta_t", "X", "Y", "Z"]

SAMPLES = T.StructType(
    [T.StructField("evid", _L), T.StructField("draw", _L)]
    + [T.StructField(name, T.FloatType()) for name in SAMPLE_FIELDS]
    + [T.StructField("batch_id", _L)]
)

COMPONENTS = ["dx", "dy", "dz", "dt"]

EVENT_STATE = _struct(
    {
        "evid": _L,
        **{name: _D for name in ("x0", "y0", "z0")},
        **{name: _D for name in COMPONENTS},
        **{f"m_{name}": _D for name in COMPONENTS},
        **{f"v_{name}": _D for name in COMPONENTS},
        "huber_sum": _D,
    }
)

RUN_STATE = _struct(
    {
        "run_id": _S,
        "phase": _S,
        "epoch": _L,
        "n_obs": _L,
        "optimizer_type": _S,
        "optimizer_step": _L,
        "global_step_count": _L,
        "stats": T.MapType(_S, _D),
    }
)

SHIFT_STATS = [
    "mean_dX",
    "mean_dY",
    "mean_dZ",
    "median_abs_dX",
    "median_abs_dY",
    "median_abs_dZ",
    "max_radius",
    "quantile_90_radius",
]

RUN_METRICS = T.StructType(
    [
        T.StructField("run_id", _S),
        T.StructField("phase", _S),
        T.StructField("epoch", _L),
        T.StructField("loss", _D),
        *[T.StructField(name, _D) for name in SHIFT_STATS],
        T.StructField("mad_p", _D),
        T.StructField("mad_s", _D),
        T.StructField("epoch_time", _D),
        T.StructField("learning_rate", _D),
        T.StructField("noise_enabled", T.BooleanType()),
        T.StructField("ramp_progress", _D),
        T.StructField("relative_change_N", _D),
        T.StructField("relative_change_N2", _D),
        T.StructField("samples_collected", _L),
        T.StructField("sample_count", _L),
    ]
)

RUN_CONFIG = _struct({"config": T.MapType(_S, _S), "run_id": _S})

NETWORK_WEIGHTS = T.StructType(
    [
        T.StructField("layer", T.IntegerType()),
        T.StructField("n_out", T.IntegerType()),
        T.StructField("n_in", T.IntegerType()),
        T.StructField("w", T.ArrayType(_D)),
        T.StructField("b", T.ArrayType(_D)),
    ]
)


def require_columns(df: DataFrame, names: list[str], what: str) -> DataFrame:
    """Fail before any job starts when ``df`` lacks a column that ``what`` needs."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"{what} lacks required columns {missing}")
    return df
