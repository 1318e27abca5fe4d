"""Seismic views over the general test tables, each over its whole table.

Parts become events, suppliers stations, order lines differential times between neighbouring events,
embedding vectors chains of 64 draws in 4 batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorframe.functions.travel_time import StraightRay
from tremorframe.operators import forward, observations
from tremorframe.operators.objective import Priors
from tremorframe.params import RunParams

PARAMS = RunParams(
    lat_min=32.5,
    lon_min=-118.5,
    event_lat_bounds=(33.4, 33.6),
    event_lon_bounds=(-116.9, -116.66),
    cc_min=0.6,
    max_abs_input_dt=0.5,
    min_dtimes=3,
)
CENTRE = (PARAMS.lat_min, PARAMS.lon_min)
MODEL = StraightRay(vp=6.0, vs=3.3)
# wide enough that both branches of the Huber loss occur
PHASE_UNC = (1.5, 2.0)
PRIORS = Priors()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(
        "concat('N', s_nationkey % 5) AS network",
        "concat('S', s_suppkey) AS station",
        "-117.5D + (s_suppkey * 37 % 100) * 1e-2D AS longitude",
        "33.0D + (s_suppkey * 61 % 100) * 1e-2D AS latitude",
        "-1e-3D * (s_suppkey % 20) AS depth",
    )


def stations_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every station listed twice, in part at slightly different places."""
    once = stations(spark, sf_dir)
    again = once.withColumn("longitude", F.col("longitude") + (F.col("depth") < -5e-3).cast("int") * 1e-3)
    return once.unionByName(again)


def origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    orders = table(spark, sf_dir, "orders")
    return part.join(orders, part.p_partkey == orders.o_orderkey).selectExpr(
        "p_partkey AS evid",
        "-116.9D + (p_partkey * 7919 % 10007) * 3e-5D AS longitude",
        "33.4D + (p_partkey * 104729 % 9973) * 3e-5D AS latitude",
        "2.0D + p_size * 0.25D AS depth",
        "cast(o_orderdate AS timestamp) AS time",
    )


def dtimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    supplier = table(spark, sf_dir, "supplier")
    neighbour = "l_partkey + 1 + l_orderkey % 3"
    return line.join(supplier, line.l_suppkey == supplier.s_suppkey).selectExpr(
        "concat('N', s_nationkey % 5) AS network",
        "concat('S', l_suppkey) AS station",
        "(l_discount - 5e-2D) * 12D AS dt",
        f"CASE WHEN l_linenumber % 2 = 0 THEN l_partkey ELSE {neighbour} END AS evid1",
        f"CASE WHEN l_linenumber % 2 = 0 THEN {neighbour} ELSE l_partkey END AS evid2",
        "CASE l_returnflag WHEN 'R' THEN 's' WHEN 'A' THEN 'P' ELSE 'S' END AS phase",
        "1D - l_tax * 6D AS cc",
    )


def velocity_model(spark: SparkSession) -> DataFrame:
    nodes = [
        (-5.0, 3.3, 6.0),
        (0.0, 3.3, 6.0),
        (5.0, 3.4, 6.1),
        (10.0, 3.5, 6.2),
        (15.0, 3.6, 6.3),
        (20.0, 3.7, 6.4),
    ]
    return spark.createDataFrame(nodes, "depth double, vs double, vp double")


def observations_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phase-encoded differential times of known events with station coordinates."""
    known = observations.with_known_events(
        observations.encode_phase(dtimes(spark, sf_dir)), origins(spark, sf_dir)
    )
    return observations.join_stations(known, stations(spark, sf_dir), *CENTRE)


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event state with shifts that vary by event."""
    base = forward.initial_state(origins(spark, sf_dir), *CENTRE)
    return base.withColumns(
        {
            "dx": F.expr("(evid * 31 % 101 - 50) * 2e-3D"),
            "dy": F.expr("(evid * 17 % 103 - 51) * 2e-3D"),
            "dz": F.expr("(evid * 13 % 107 - 53) * 2e-3D"),
            "dt": F.expr("(evid * 7 % 109 - 54) * 1e-3D"),
        }
    )


def warm_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state with optimizer memory."""
    memory = {}
    for i, c in enumerate(("dx", "dy", "dz", "dt")):
        memory[f"m_{c}"] = F.expr(f"(evid * {3 + i} % 11 - 5) * 1e-6D")
        memory[f"v_{c}"] = F.expr(f"(evid * {5 + i} % 13 + 1) * 1e-11D")
    return state(spark, sf_dir).withColumns(memory)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 draws per vector: coordinate series are rotations of the vector."""
    vectors = table(spark, sf_dir, "embeddings")
    items = vectors.selectExpr("vec_id AS evid", "embedding", "posexplode(embedding) AS (i, x)")
    shifts = items.selectExpr(
        "evid",
        "cast(i div 16 AS bigint) AS batch_id",
        "cast(i % 16 AS bigint) AS draw",
        "cast(x AS double) AS X",
        "cast(embedding[(i + 21) % 64] AS double) AS Y",
        "cast(embedding[(i + 42) % 64] AS double) AS Z",
    )
    return shifts.selectExpr(
        "evid",
        "draw",
        "-116.8D + X * 1e-2D AS longitude",
        "33.5D + Y * 1e-2D AS latitude",
        "6D + Z AS depth",
        "Y * 5e-2D AS delta_t",
        "X",
        "Y",
        "Z",
        "batch_id",
    )
