"""Queries of preparation: scans, filters, joins, counts, repair."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks import sql as q
from checks.registry import query, rounded
from tremorframe import lineage
from tremorframe.operators import observations as ops
from tremorframe.operators import repair
from tremorframe.plans.prepare import prepare_inputs, prepare_observations
from tremorframe.sources import run_store, tables

TIME = "strftime(time, '%Y-%m-%d %H:%M:%S') AS time"
DT = "network, station, dt, evid1, evid2, phase, cc"


def shown_time(df):
    return df.withColumn("time", F.date_format("time", "yyyy-MM-dd HH:mm:ss"))


def as_csv(df, name):
    """Write as CSV in shared scratch storage and give the path."""
    path = lineage.scratch_path(df.sparkSession, name) + ".csv"
    df.write.option("header", True).csv(path)
    return path


def text_time(df):
    return df.withColumn("time", F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss"))


# --- scans -------------------------------------------------------------------------------------


@query(q.with_(q.STATIONS) + "SELECT * FROM stations")
def station_scan(spark, sf_dir):
    return tables.read_stations(spark, as_csv(fx.stations(spark, sf_dir), "stations"))


@query(q.with_(q.ORIGINS) + f"SELECT evid, longitude, latitude, depth, {TIME} FROM origins")
def catalog_scan(spark, sf_dir):
    path = as_csv(text_time(fx.origins(spark, sf_dir)), "catalog")
    return shown_time(tables.read_catalog(spark, path))


@query(q.with_(q.DTIMES) + f"SELECT {DT} FROM dtimes")
def dtime_scan(spark, sf_dir):
    return tables.read_dtimes(spark, as_csv(fx.dtimes(spark, sf_dir), "dtimes"))


@query(q.with_(q.ORIGINS) + "SELECT longitude AS lon, latitude AS lat, depth FROM origins")
def truth_scan(spark, sf_dir):
    lines = fx.origins(spark, sf_dir).select(
        F.concat_ws("  ", "longitude", "latitude", "depth", F.lit("0.0")).alias("value")
    )
    path = lineage.scratch_path(spark, "truth")
    lines.write.text(path)
    return tables.read_truth(spark, path)


@query(q.with_(q.ORIGINS) + f"SELECT evid, longitude, latitude, depth, {TIME} FROM origins")
def parse_origin_time(spark, sf_dir):
    return shown_time(ops.parse_origin_time(text_time(fx.origins(spark, sf_dir))))


# --- filters and projections ---------------------------------------------------------------------


@query(
    q.with_(q.ORIGINS)
    + f"""SELECT evid, longitude, latitude, depth, {TIME} FROM origins
WHERE latitude BETWEEN 33.4e0 AND 33.6e0 AND longitude BETWEEN -116.9e0 AND -116.66e0"""
)
def spatial_subset(spark, sf_dir):
    p = fx.PARAMS
    kept = ops.spatial_subset(fx.origins(spark, sf_dir), p.event_lat_bounds, p.event_lon_bounds)
    return shown_time(kept)


@query(
    q.with_(q.ORIGINS)
    + f"""SELECT evid, longitude, latitude, depth, {TIME} FROM origins
WHERE time >= TIMESTAMP '1996-07-01' AND time < TIMESTAMP '1999-08-01'"""
)
def time_range(spark, sf_dir):
    return shown_time(ops.time_range(fx.origins(spark, sf_dir), "1996-07-01", "1999-08-01"))


@query(q.with_(q.DTIMES, q.ENCODED) + f"SELECT {DT} FROM encoded")
def phase_encode(spark, sf_dir):
    coded = ops.prune_columns(ops.encode_phase(fx.dtimes(spark, sf_dir)))
    return coded.withColumn("phase", F.col("phase").cast("int"))


@query(q.with_(q.DTIMES) + f"SELECT {DT} FROM dtimes WHERE abs(dt) < 0.5e0 AND cc >= 0.6e0")
def dt_cc_filter(spark, sf_dir):
    return ops.limit_cc(ops.limit_abs_dt(fx.dtimes(spark, sf_dir), 0.5), 0.6)


@query(
    q.with_(q.DTIMES)
    + """SELECT network, station, CASE WHEN dt = 0 THEN 0e0 ELSE dt * -1 END AS dt, evid1, evid2,
phase, cc FROM dtimes"""
)
def flip_sign(spark, sf_dir):
    flipped = ops.flip_sign(fx.dtimes(spark, sf_dir))
    return flipped.withColumn("dt", F.when(F.col("dt") == 0, F.lit(0.0)).otherwise(F.col("dt")))


@query(
    q.with_(q.DTIMES)
    + f"""SELECT {DT} FROM dtimes WHERE {q.unit("concat_ws(':', '42', network, station, "
    "CAST(evid1 AS VARCHAR), CAST(evid2 AS VARCHAR), phase)")} < 0.25e0"""
)
def thin_sample(spark, sf_dir):
    key = ["network", "station", "evid1", "evid2", "phase"]
    return ops.thin_observations(fx.dtimes(spark, sf_dir), 0.25, key=key)


@query(
    q.with_(q.DTIMES)
    + """SELECT least(evid1, evid2) AS evid_min, greatest(evid1, evid2) AS evid_max, count(*) AS n
FROM dtimes GROUP BY ALL"""
)
def unordered_pairs(spark, sf_dir):
    keyed = fx.dtimes(spark, sf_dir).withColumns(ops.unordered_pair())
    return keyed.groupBy("evid_min", "evid_max").agg(F.count(F.lit(1)).alias("n"))


@query(
    q.with_(q.STATIONS)
    + """SELECT min(latitude) AS lat_lo, max(latitude) AS lat_hi, min(longitude) AS lon_lo,
max(longitude) AS lon_hi, min(latitude) >= 33e0 AND max(latitude) <= 34e0 AND min(longitude) >= -118e0
AND max(longitude) <= -116e0 AS inside FROM stations"""
)
def station_bounds(spark, sf_dir):
    return ops.station_bounds(fx.stations(spark, sf_dir), (33.0, 34.0), (-118.0, -116.0))


# --- distinct, joins, counts ---------------------------------------------------------------------


@query(
    q.with_(q.STATIONS, q.STATIONS_TWICE)
    + """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY network, station
ORDER BY longitude, latitude, depth) AS rn FROM stations_twice) WHERE rn = 1"""
)
def station_dedupe(spark, sf_dir):
    return ops.distinct_stations(fx.stations_twice(spark, sf_dir))


@query(
    q.with_(q.DTIMES, q.ENCODED)
    + f"""SELECT {DT} FROM (SELECT *, row_number() OVER (PARTITION BY least(evid1, evid2),
greatest(evid1, evid2), network, station, phase ORDER BY cc DESC, evid1, evid2, dt) AS rn
FROM encoded) WHERE rn = 1"""
)
def observation_dedupe(spark, sf_dir):
    kept = ops.distinct_observations(ops.encode_phase(fx.dtimes(spark, sf_dir)))
    return kept.withColumn("phase", F.col("phase").cast("int"))


@query(q.with_(q.ORIGINS, q.DTIMES, q.ENCODED, q.KNOWN) + f"SELECT {DT} FROM known")
def event_membership(spark, sf_dir):
    coded = ops.encode_phase(fx.dtimes(spark, sf_dir))
    kept = ops.with_known_events(coded, fx.origins(spark, sf_dir))
    return kept.withColumn("phase", F.col("phase").cast("int"))


@query(
    q.with_(q.DTIMES)
    + "SELECT evid1 AS evid FROM dtimes UNION SELECT evid2 FROM dtimes"
)
def used_event_ids(spark, sf_dir):
    return ops.used_event_ids(fx.dtimes(spark, sf_dir))


@query(
    q.with_(q.ORIGINS, q.DTIMES)
    + f"""SELECT evid, longitude, latitude, depth, {TIME} FROM origins WHERE evid IN (
SELECT evid1 FROM dtimes WHERE abs(dt) < 0.1e0 UNION SELECT evid2 FROM dtimes WHERE abs(dt) < 0.1e0)"""
)
def used_origins(spark, sf_dir):
    near = ops.limit_abs_dt(fx.dtimes(spark, sf_dir), 0.1)
    return shown_time(ops.used_origins(fx.origins(spark, sf_dir), near))


@query(
    q.with_(q.DTIMES)
    + f"""SELECT {DT} FROM dtimes WHERE (evid1, evid2) IN (
SELECT (evid1, evid2) FROM dtimes GROUP BY evid1, evid2 HAVING count(*) >= 6)"""
)
def pair_min_ordered(spark, sf_dir):
    return ops.min_rows_per_ordered_pair(fx.dtimes(spark, sf_dir), 6)


@query(
    q.with_(q.ORIGINS, q.DTIMES)
    + f"""SELECT evid, longitude, latitude, depth, {TIME} FROM origins WHERE evid IN (
SELECT unnest([evid1, evid2]) FROM dtimes GROUP BY evid1, evid2 HAVING count(*) >= 9)"""
)
def pair_min_origins(spark, sf_dir):
    kept, _ = ops.min_dtimes_per_pair(fx.origins(spark, sf_dir), fx.dtimes(spark, sf_dir), 9)
    return shown_time(kept)


@query(
    q.with_(q.DTIMES)
    + f"""SELECT {DT} FROM (SELECT *, count(*) OVER (PARTITION BY least(evid1, evid2),
greatest(evid1, evid2)) AS n FROM dtimes) WHERE n >= 11"""
)
def pair_min_unordered(spark, sf_dir):
    return ops.min_rows_per_unordered_pair(fx.dtimes(spark, sf_dir), 11)


@query(
    q.with_(q.STATIONS, q.STATIONS_XY, q.DTIMES)
    + f"""SELECT network, station, dt, evid1, evid2, phase, cc, longitude, latitude, depth,
{q.r('"X"', 7, '"X"')}, {q.r('"Y"', 7, '"Y"')}, "Z" FROM dtimes JOIN stations_xy USING (network, station)"""
)
def station_join(spark, sf_dir):
    joined = ops.join_stations(fx.dtimes(spark, sf_dir), fx.stations(spark, sf_dir), *fx.CENTRE)
    return rounded(joined, 7, "X", "Y")


@query(
    q.with_(q.ORIGINS, q.ORIGINS_XY, q.DTIMES)
    + f"""SELECT d.* FROM dtimes d JOIN origins_xy a ON d.evid1 = a.evid JOIN origins_xy b
ON d.evid2 = b.evid WHERE sqrt((a.x0 - b.x0) * (a.x0 - b.x0) + (a.y0 - b.y0) * (a.y0 - b.y0)
+ (a.z0 - b.z0) * (a.z0 - b.z0)) < 12.3456e0"""
)
def long_edge_cut(spark, sf_dir):
    return ops.cut_long_edges(
        fx.dtimes(spark, sf_dir), fx.origins(spark, sf_dir), 12.3456, *fx.CENTRE
    )


@query(
    q.with_(q.DTIMES)
    + f"""SELECT {DT}, row_number() OVER (ORDER BY evid1, evid2, network, station, phase, dt, cc) - 1
AS arid FROM dtimes"""
)
def observation_ordinal(spark, sf_dir):
    order = ["evid1", "evid2", "network", "station", "phase", "dt", "cc"]
    return ops.number_observations(fx.dtimes(spark, sf_dir), order)


PREPARED = q.with_(
    q.STATIONS,
    q.STATIONS_XY,
    q.ORIGINS,
    "box AS (SELECT * FROM origins WHERE latitude BETWEEN 33.4e0 AND 33.6e0"
    " AND longitude BETWEEN -116.9e0 AND -116.66e0)",
    q.DTIMES,
    q.ENCODED,
    """good AS (SELECT * FROM encoded WHERE evid1 IN (SELECT evid FROM box)
AND evid2 IN (SELECT evid FROM box) AND abs(dt) < 0.5e0 AND cc >= 0.6e0)""",
    """joined AS (SELECT g.*, s.longitude, s.latitude, s.depth, s."X", s."Y", s."Z" FROM good g
JOIN stations_xy s USING (network, station))""",
    """prepared AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY least(evid1, evid2),
greatest(evid1, evid2)) AS n FROM joined) WHERE n >= 3)""",
)


@query(
    PREPARED
    + f"""SELECT network, station, dt, evid1, evid2, phase, cc, longitude, latitude, depth,
{q.r('"X"', 7, '"X"')}, {q.r('"Y"', 7, '"Y"')}, "Z" FROM prepared"""
)
def prepared_observations(spark, sf_dir):
    _, obs, _ = prepare_observations(
        fx.stations(spark, sf_dir), fx.origins(spark, sf_dir), fx.dtimes(spark, sf_dir), fx.PARAMS
    )
    return rounded(obs, 7, "X", "Y").withColumn("phase", F.col("phase").cast("int"))


@query(
    PREPARED
    + f"""SELECT evid, longitude, latitude, depth, {TIME} FROM box WHERE evid IN (
SELECT evid1 FROM prepared UNION SELECT evid2 FROM prepared)"""
)
def prepared_origins(spark, sf_dir):
    _, _, kept = prepare_observations(
        fx.stations(spark, sf_dir), fx.origins(spark, sf_dir), fx.dtimes(spark, sf_dir), fx.PARAMS
    )
    return shown_time(kept)


@query(
    q.with_(
        q.STATIONS,
        q.STATIONS_TWICE,
        """one AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
PARTITION BY network, station ORDER BY longitude, latitude, depth) AS rn FROM stations_twice) WHERE rn = 1)""",
        q.ORIGINS,
        q.DTIMES,
        q.ENCODED,
        q.KNOWN,
        """uniq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY least(evid1, evid2),
greatest(evid1, evid2), network, station, phase ORDER BY cc DESC, evid1, evid2, dt) AS rn
FROM known) WHERE rn = 1)""",
        "small AS (SELECT * FROM uniq WHERE abs(dt) < 0.5e0)",
        """flipped AS (SELECT network, station, -dt AS dt, evid1, evid2, phase, cc FROM small
WHERE cc >= 0.6e0)""",
        """often AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY evid1, evid2) AS n
FROM flipped) WHERE n >= 2)""",
        """full_rows AS (SELECT o.* FROM often o JOIN one USING (network, station))""",
    )
    + f"""SELECT network, station, CASE WHEN dt = 0 THEN 0e0 ELSE dt END AS dt, evid1, evid2, phase, cc
FROM (SELECT *, count(*) OVER (PARTITION BY least(evid1, evid2), greatest(evid1, evid2)) AS m
FROM full_rows) WHERE m >= 5"""
)
def prepared_all_filters(spark, sf_dir):
    """All filters and counts on, inputs read from CSV files."""
    params = replace(
        fx.PARAMS,
        event_lat_bounds=None,
        event_lon_bounds=None,
        remove_duplicates=True,
        flip_dt_sign=True,
        min_dtimes_per_pair=2,
        min_dtimes=5,
        station_file=as_csv(fx.stations_twice(spark, sf_dir), "stations"),
        catalog_infile=as_csv(text_time(fx.origins(spark, sf_dir)), "catalog"),
        dtime_file=as_csv(fx.dtimes(spark, sf_dir), "dtimes"),
    )
    _, obs, _ = prepare_inputs(spark, params)
    out = obs.select(*ops.DTIME_COLUMNS)
    dt = F.when(F.col("dt") == 0, F.lit(0.0)).otherwise(F.col("dt"))
    return out.withColumns({"dt": dt, "phase": F.col("phase").cast("int")})


@query(
    q.with_(q.STATIONS, q.ORIGINS, q.DTIMES, q.ENCODED, q.KNOWN)
    + """SELECT 'origins' AS stage, count(*) AS n_rows FROM origins UNION ALL
SELECT 'dtimes', count(*) FROM dtimes UNION ALL SELECT 'known_events', count(*) FROM known UNION ALL
SELECT 'max_abs_dt', count(*) FROM known WHERE abs(dt) < 0.5e0"""
)
def stage_counts(spark, sf_dir):
    events, raw = fx.origins(spark, sf_dir), fx.dtimes(spark, sf_dir)
    known = ops.with_known_events(raw, events)
    return ops.stage_counts(
        {
            "origins": events,
            "dtimes": raw,
            "known_events": known,
            "max_abs_dt": ops.limit_abs_dt(known, 0.5),
        }
    )


# --- repair --------------------------------------------------------------------------------------

_BROKEN_CATALOG = """CASE p_partkey % 7 WHEN 0 THEN 'n/a' ELSE CAST({x} AS {text}) END AS longitude,
CASE p_partkey % 5 WHEN 1 THEN NULL ELSE CAST({y} AS {text}) END AS latitude,
CAST(p_size AS {text}) AS depth,
CASE p_partkey % 11 WHEN 3 THEN 'yesterday' ELSE concat('2023-0', CAST(1 + p_partkey % 9 AS {text}), '-11T06:07:08') END AS origin_time"""


def _broken(text, suffix):
    x = f"-117{suffix} + (p_partkey % 64) * 0.015625{suffix}"
    y = f"33{suffix} + (p_partkey % 32) * 0.03125{suffix}"
    return _BROKEN_CATALOG.format(x=x, y=y, text=text)


@query(
    f"""WITH broken AS (SELECT p_partkey, {_broken('VARCHAR', 'e0')} FROM part)
SELECT CASE WHEN p_partkey < 1000 THEN concat('evt_', lpad(CAST(p_partkey AS VARCHAR), 3, '0'))
    ELSE concat('evt_', CAST(p_partkey AS VARCHAR)) END AS event_id,
  TRY_CAST(longitude AS DOUBLE) AS longitude, TRY_CAST(latitude AS DOUBLE) AS latitude,
  TRY_CAST(depth AS DOUBLE) AS depth,
  strftime(TRY_CAST(origin_time AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS origin_time
FROM broken WHERE TRY_CAST(longitude AS DOUBLE) IS NOT NULL AND TRY_CAST(latitude AS DOUBLE) IS NOT NULL
  AND TRY_CAST(depth AS DOUBLE) IS NOT NULL AND TRY_CAST(origin_time AS TIMESTAMP) IS NOT NULL"""
)
def catalog_repair(spark, sf_dir):
    broken = (
        fx.table(spark, sf_dir, "part")
        .selectExpr("p_partkey", *_split(_broken("STRING", "D")))
        .repartitionByRange("p_partkey")
        .sortWithinPartitions("p_partkey")
        .drop("p_partkey")
    )
    fixed = repair.repair_catalog(broken)
    return fixed.withColumn("origin_time", F.date_format("origin_time", "yyyy-MM-dd HH:mm:ss"))


def _split(text):
    """One expression per line of the shared projection text."""
    return [line.rstrip(",") for line in text.splitlines()]


@query(
    """WITH broken AS (SELECT concat('e', CAST(l_partkey AS VARCHAR)) AS event1_id,
  concat('e', CAST(l_orderkey AS VARCHAR)) AS event2_id,
  CASE l_returnflag WHEN 'R' THEN 's' WHEN 'A' THEN 'P' ELSE 'Pg' END AS phase,
  CASE l_linenumber WHEN 2 THEN 'bad' ELSE CAST(l_discount AS VARCHAR) END AS dt_obs,
  l_tax - 0.0625e0 AS dt_err FROM lineitem)
SELECT event1_id, event2_id, 'unknown' AS station, phase, TRY_CAST(dt_obs AS DOUBLE) AS dt_obs,
  abs(dt_err) AS dt_err FROM broken
WHERE TRY_CAST(dt_obs AS DOUBLE) IS NOT NULL AND phase IN ('P', 'S', 'p', 's')"""
)
def dtime_repair(spark, sf_dir):
    broken = fx.table(spark, sf_dir, "lineitem").selectExpr(
        "concat('e', l_partkey) AS event1_id",
        "concat('e', l_orderkey) AS event2_id",
        "CASE l_returnflag WHEN 'R' THEN 's' WHEN 'A' THEN 'P' ELSE 'Pg' END AS phase",
        "CASE l_linenumber WHEN 2 THEN 'bad' ELSE cast(l_discount AS string) END AS dt_obs",
        "l_tax - 0.0625D AS dt_err",
    )
    return repair.repair_dtimes(broken).select(
        "event1_id", "event2_id", "station", "phase", "dt_obs", "dt_err"
    )


# --- run configuration ---------------------------------------------------------------------------


@query(
    q.with_(q.ORIGINS, q.DTIMES)
    + """SELECT * FROM (VALUES ('phase3_epochs', '500'), ('phase1_epochs', '0'),
('phase2_epochs', '0'), ('phase4_epochs', '0'), ('lr_warmup', '0.002'), ('lr_sgld', '0.001'),
('save_every_n', '10'), ('checkpoint_interval', '50'), ('phase_unc', '[0.01, 0.01]'),
('prior_event_std', '[0.25, 0.25, 0.25, 0.1]'), ('prior_centroid_std', '[0.01, 0.01, 0.01, 0.01]'))
AS t(key, value) UNION ALL SELECT 'total_events', CAST(count(*) AS VARCHAR) FROM origins
UNION ALL SELECT 'total_dtimes', CAST(count(*) AS VARCHAR) FROM dtimes"""
)
def run_config(spark, sf_dir):
    config = run_store.run_config(
        spark,
        fx.PARAMS.as_dict(),
        fx.origins(spark, sf_dir).count(),
        fx.dtimes(spark, sf_dir).count(),
    )
    return config.select(F.explode("config").alias("key", "value"))


# --- exact thinning --------------------------------------------------------------------------------

_KEYED = "concat_ws(':', '42', network, station, CAST(evid1 AS VARCHAR), CAST(evid2 AS VARCHAR), phase)"


@query(
    q.with_(q.DTIMES)
    + f"""SELECT {DT} FROM (SELECT *, row_number() OVER (ORDER BY {q.unit(_KEYED)}, network, station, dt, evid1,
evid2, phase, cc) AS place FROM dtimes) WHERE place <= (SELECT floor(count(*) * 0.3e0) FROM dtimes)"""
)
def thin_exact(spark, sf_dir):
    """Exactly three tenths of the rows, whole tables; rows of equal keys may be cut apart."""
    key = ["network", "station", "evid1", "evid2", "phase"]
    return ops.thin_exactly(fx.dtimes(spark, sf_dir), 0.3, key=key)


# --- counts of a whole preparation -----------------------------------------------------------------

_DT_LIMIT = """known_box AS (SELECT * FROM encoded WHERE evid1 IN (SELECT evid FROM box) AND evid2 IN (SELECT evid FROM box)),
ordered AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY evid1, evid2) AS m FROM good) WHERE m >= 2),
placed AS (SELECT o.* FROM ordered o JOIN stations s ON s.network = o.network AND s.station = o.station),
kept AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY least(evid1, evid2), greatest(evid1, evid2)) AS u
FROM placed) WHERE u >= 3),
used AS (SELECT evid FROM box WHERE evid IN (SELECT evid1 FROM kept UNION SELECT evid2 FROM kept))"""
_COUNTED = {
    "events": "box",
    "stations": "stations",
    "dtimes": "dtimes",
    "known_events": "known_box",
    "abs_dt": "known_box WHERE abs(dt) < 0.5e0",
    "thinned": "known_box WHERE abs(dt) < 0.5e0",
    "cc": "good",
    "ordered_pairs": "ordered",
    "known_stations": "placed",
    "unordered_pairs": "kept",
    "used_events": "used",
}


@query(
    PREPARED.rstrip()
    + f",\n{_DT_LIMIT}\n"
    + " UNION ALL ".join(f"SELECT '{stage}' AS stage, count(*) AS n_rows FROM {rows}" for stage, rows in _COUNTED.items())
)
def prepared_counts(spark, sf_dir):
    """Rows that each stage of one preparation leaves, counted on the way."""
    counts = {}
    params = replace(fx.PARAMS, min_dtimes_per_pair=2)
    prepare_observations(
        fx.stations(spark, sf_dir), fx.origins(spark, sf_dir), fx.dtimes(spark, sf_dir), params, counts=counts
    )
    return spark.createDataFrame(list(counts.items()), "stage string, n_rows long")
