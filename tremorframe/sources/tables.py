"""Input tables (CSV or Parquet, by extension) and catalog output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremorframe import schemas
from tremorframe.operators.observations import parse_origin_time
from tremorframe.schemas import require_columns


def is_text(path: str) -> bool:
    """Whether the path names a CSV or text file rather than Parquet."""
    name = path.rstrip("/").lower()
    return name.endswith((".csv", ".csv.gz", ".txt"))


def _read(spark: SparkSession, path: str, schema: T.StructType, what: str) -> DataFrame:
    if not is_text(path):
        df = require_columns(spark.read.parquet(path), schema.fieldNames(), what)
        return df.withColumns(
            {f.name: F.col(f.name).cast(f.dataType) for f in schema if f.name != "time"}
        )
    # columns are matched by header name, so their order in the file is free
    header = spark.read.option("header", True).csv(path)
    require_columns(header, schema.fieldNames(), what)
    known = {f.name: f.dataType for f in schema}
    full = T.StructType(
        [T.StructField(name, known.get(name, T.StringType())) for name in header.columns]
    )
    # a file of the folder whose columns are in another order fails instead of being misread
    reader = spark.read.schema(full).option("header", True).option("enforceSchema", False)
    return reader.option("mode", "FAILFAST").csv(path)


def _with_ids(schema: T.StructType, names: tuple[str, ...], id_type: str) -> T.StructType:
    """The schema with its event-id columns as ``long`` or ``string``."""
    kinds = {"long": T.LongType(), "string": T.StringType()}
    if id_type not in kinds:
        raise ValueError(f"id_type must be 'long' or 'string', got {id_type!r}")
    return T.StructType(
        [T.StructField(f.name, kinds[id_type] if f.name in names else f.dataType) for f in schema]
    )


def catalog_id_type(spark: SparkSession, path: str) -> str:
    """``long`` when every event id of the catalog is an integer, else ``string``."""
    ids = read_catalog(spark, path, parse_time=False, id_type="string").select("evid")
    unreadable = F.col("evid").isNotNull() & F.col("evid").try_cast("bigint").isNull()
    return "long" if ids.filter(unreadable).isEmpty() else "string"


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, schemas.STATIONS, "station table").select(
        *schemas.STATIONS.fieldNames()
    )


def read_catalog(
    spark: SparkSession, path: str, parse_time: bool = True, id_type: str = "long"
) -> DataFrame:
    """Event catalog; extra columns are kept."""
    schema = _with_ids(schemas.CATALOG, ("evid",), id_type)
    df = _read(spark, path, schema, "event catalog")
    return parse_origin_time(df) if parse_time else df


def read_dtimes(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    schema = _with_ids(schemas.DTIMES, ("evid1", "evid2"), id_type)
    return _read(spark, path, schema, "differential times").select(*schema.fieldNames())


def read_velocity_model(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, schemas.VELOCITY_MODEL, "velocity model").select(
        *schemas.VELOCITY_MODEL.fieldNames()
    )


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Whitespace-separated lon, lat, depth; further columns are ignored, rows keep no order."""
    fields = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).filter((F.trim("value") != "") & ~F.col("value").startswith("#"))
    return lines.select(
        *[fields[i].cast("double").alias(n) for i, n in enumerate(schemas.TRUTH.fieldNames())]
    )


def write_catalog(catalog: DataFrame, path: str) -> None:
    """Catalog as CSV with a header, or Parquet when the path does not look like CSV."""
    writer = catalog.write.mode("overwrite")
    if is_text(path):
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)


def map_catalog_path(catalog_outfile: str) -> str:
    """Where the catalog of the first phase goes."""
    return f"{catalog_outfile}_MAP.csv"


# Column names of the documented summary catalog file.
SUMMARY_COLUMNS = {
    "evid": "event_id",
    "longitude": "longitude",
    "latitude": "latitude",
    "depth": "depth",
    "time": "origin_time",
    "longitude_std": "longitude_std",
    "latitude_std": "latitude_std",
    "depth_std": "depth_std",
    "time_std": "time_std",
}


def summary_catalog(means: DataFrame, spreads: DataFrame, origins: DataFrame) -> DataFrame:
    """Posterior means, standard deviations and origin times in the documented file layout."""
    spread_columns = ["longitude_std", "latitude_std", "depth_std", "time_std"]
    joined = (
        means.select("evid", "longitude", "latitude", "depth")
        .join(spreads.select("evid", *spread_columns), "evid")
        .join(origins.select("evid", "time"), "evid", "left")
    )
    return joined.select(*[F.col(a).alias(b) for a, b in SUMMARY_COLUMNS.items()])
