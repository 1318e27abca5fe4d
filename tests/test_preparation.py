"""Edge cases of scans, filters, de-duplication, repair and preparation."""

import pytest
from pyspark.sql import functions as F

from tremorframe.operators import observations as ops
from tremorframe.operators import repair
from tremorframe.params import RunParams
from tremorframe.plans.prepare import prepare_inputs, prepare_observations
from tremorframe.plans.relocate import relocate
from tremorframe.sources import tables
from tremorframe.sources.run_store import RunStore
from tremorframe.sources.sample_store import read_samples

DT = "network string, station string, dt double, evid1 long, evid2 long, phase string, cc double"
PARAMS = RunParams(lat_min=32.5, lon_min=-118.5)


def dtimes(spark, rows):
    return spark.createDataFrame(rows, DT)


def test_phase_codes(spark):
    rows = [("N", "S", 0.0, 1, 2, p, 1.0) for p in ("S", "s", "P", "p", "Sg", None)]
    coded = ops.encode_phase(dtimes(spark, rows))
    assert coded.schema["phase"].dataType.simpleString() == "tinyint"
    assert [r["phase"] for r in coded.collect()] == [1, 1, 0, 0, 0, None]


def test_thresholds_are_strict_and_inclusive(spark):
    df = dtimes(
        spark,
        [("N", "S", v, 1, 2, "P", c) for v, c in ((0.5, 0.6), (-0.49, 0.59), (None, 0.7), (0.1, None))],
    )
    assert [r["dt"] for r in ops.limit_abs_dt(df, 0.5).collect()] == [-0.49, 0.1]
    assert [r["cc"] for r in ops.limit_cc(df, 0.6).collect()] == [0.6, 0.7]
    assert ops.limit_abs_dt(df, 0).count() == ops.limit_cc(df, 0).count() == 4


def test_reversed_duplicate_keeps_best_correlated(spark):
    df = dtimes(
        spark,
        [
            ("N", "S", 0.3, 1, 2, "P", 0.7),
            ("N", "S", -0.31, 2, 1, "P", 0.9),
            ("N", "S", 0.2, 1, 2, "P", None),
            ("N", "S", 0.3, 1, 2, "S", 0.7),
        ],
    )
    kept = {(r["evid1"], r["phase"]): r["dt"] for r in ops.distinct_observations(df).collect()}
    assert kept == {(2, "P"): -0.31, (1, "S"): 0.3}


def test_thinning_fraction_and_stability(spark):
    df = spark.range(20000).select(F.col("id"))
    kept = ops.thin_observations(df, 0.3)
    assert kept.count() == pytest.approx(6000, abs=250)
    again = ops.thin_observations(df.repartition(5), 0.3)
    assert kept.exceptAll(again).isEmpty() and again.exceptAll(kept).isEmpty()
    assert ops.thin_observations(df, 1.0) is df
    with pytest.raises(ValueError):
        ops.thin_observations(df, -0.1)


def test_pair_counts_at_the_threshold(spark):
    rows = [("N", "S", 0.1, 1, 2, "P", 1.0)] * 2 + [("N", "S", 0.1, 2, 1, "P", 1.0)]
    rows += [("N", "S", 0.1, 3, 4, "P", 1.0)] * 2
    df = dtimes(spark, rows)
    assert ops.min_rows_per_ordered_pair(df, 2).count() == 4
    assert ops.min_rows_per_unordered_pair(df, 3).count() == 3


def test_station_check(spark):
    st = spark.createDataFrame(
        [("N", "A", -117.0, 33.0, 0.0)],
        "network string, station string, longitude double, latitude double, depth double",
    )
    ops.check_station_bounds(st, (32.0, 34.0), (-118.0, -116.0))
    with pytest.raises(ValueError):
        ops.check_station_bounds(st, (33.5, 34.0), (-118.0, -116.0))


def write(path, text):
    path.write_text(text)
    return str(path)


@pytest.fixture
def files(tmp_path):
    stations = "station,network,depth,latitude,longitude\nA,N,-0.5,33.0,-117.0\nA,N,-0.4,33.0,-117.0\nB,N,0.0,33.2,-117.1\n"
    catalog = (
        "evid,longitude,latitude,depth,time,magnitude\n"
        "1,-116.8,33.5,5.0,2023-01-01T12:00:00.250,1.1\n"
        "2,-116.7,33.5,6.0,2023-01-02T12:00:00,1.2\n"
        "3,-110.0,33.5,6.0,2023-01-03T12:00:00,1.3\n"
    )
    dtime = (
        "network,station,dt,evid1,evid2,phase,cc,extra\n"
        "N,A,0.1,1,2,P,0.9,x\nN,B,0.2,2,1,s,0.8,x\nN,Z,0.3,1,2,S,0.9,x\nN,A,0.1,1,3,P,0.9,x\nN,A,0.1,1,9,P,0.9,x\n"
    )
    return {
        "station_file": write(tmp_path / "stations.csv", stations),
        "catalog_infile": write(tmp_path / "catalog.csv", catalog),
        "dtime_file": write(tmp_path / "dtimes.csv", dtime),
    }


def test_preparation_from_files(spark, files):
    params = RunParams.from_dict(
        {**files, "lat_min": 32.5, "lon_min": -118.5, "event_lon_bounds": [-117, -116], "min_dtimes": 2, "devices": [0]}
    )
    stations, obs, origins = prepare_inputs(spark, params)
    assert sorted((r["station"], r["Z"]) for r in stations.withColumn("Z", F.col("depth")).collect()) == [
        ("A", -0.5),
        ("B", 0.0),
    ]
    got = sorted((r["station"], r["dt"], r["phase"], r["Z"]) for r in obs.collect())
    assert got == [("A", 0.1, 0, -0.5), ("B", 0.2, 1, 0.0)]
    kept = origins.orderBy("evid").collect()
    assert [r["evid"] for r in kept] == [1, 2]
    assert kept[0]["time"].microsecond == 250000 and kept[0]["magnitude"] == "1.1"


def test_missing_columns_and_files(spark, tmp_path, files):
    bad = write(tmp_path / "bad.csv", "network,station\nN,A\n")
    with pytest.raises(KeyError, match="longitude"):
        tables.read_stations(spark, bad)
    with pytest.raises(KeyError):
        prepare_inputs(spark, PARAMS)
    with pytest.raises(KeyError):
        RunParams.from_dict({"lat_min": 1.0})
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.read_dtimes(spark, str(tmp_path / "absent.csv"))


def test_malformed_number_fails_the_scan(spark, tmp_path):
    bad = write(tmp_path / "s.csv", "network,station,longitude,latitude,depth\nN,A,east,33.0,0.0\n")
    with pytest.raises(Exception):
        tables.read_stations(spark, bad).collect()


def test_parquet_inputs(spark, tmp_path, files):
    path = str(tmp_path / "dtimes.parquet")
    tables.read_dtimes(spark, files["dtime_file"]).write.parquet(path)
    assert tables.read_dtimes(spark, path).count() == 5


def test_empty_inputs(spark):
    st = spark.createDataFrame([], "network string, station string, longitude double, latitude double, depth double")
    ev = spark.createDataFrame([], "evid long, longitude double, latitude double, depth double, time timestamp")
    for changes in ({}, {"min_dtimes": 2, "min_dtimes_per_pair": 2, "remove_duplicates": True}):
        params = RunParams(lat_min=32.5, lon_min=-118.5, **changes)
        _, obs, origins = prepare_observations(st, ev, dtimes(spark, []), params)
        assert obs.count() == 0 and origins.count() == 0


def test_staging_changes_nothing(spark):
    rows = [("N", "A", 0.1 * i, i % 3, (i + 1) % 3, "P", 0.9) for i in range(30)]
    st = spark.createDataFrame(
        [("N", "A", -117.0, 33.0, 0.0)],
        "network string, station string, longitude double, latitude double, depth double",
    )
    ev = spark.createDataFrame(
        [(i, -116.8, 33.5, 5.0, "2023-01-01T00:00:00") for i in range(3)],
        "evid long, longitude double, latitude double, depth double, time string",
    )
    params = RunParams(lat_min=32.5, lon_min=-118.5, min_dtimes=3, min_dtimes_per_pair=2, max_abs_input_dt=2.0)
    _, a, _ = prepare_observations(st, ev, dtimes(spark, rows), params)
    _, b, _ = prepare_observations(st, ev, dtimes(spark, rows), params, stage=True)
    assert sorted(a.collect()) == sorted(b.collect()) and a.count() == 20


def test_repair_adds_missing_columns(spark):
    cat = spark.createDataFrame([("1.5", "2"), ("x", "3"), (None, "4")], "longitude string, latitude string")
    fixed = repair.repair_catalog(cat).collect()
    assert len(fixed) == 1
    row = fixed[0]
    assert row["event_id"].startswith("evt_00") and row["depth"] == 0.0
    assert str(row["origin_time"]) == "2023-01-01 00:00:00"
    dts = spark.createDataFrame([("0.5", "-0.1"), ("NaN", "0.1")], "dt_obs string, dt_err string")
    row = repair.repair_dtimes(dts).collect()
    assert len(row) == 1 and row[0]["dt_err"] == 0.1 and row[0]["phase"] == "P"


def test_truth_file(spark, tmp_path):
    path = write(tmp_path / "truth.txt", "# lon lat depth\n-117.0  33.0\t5.0 9\n\n -116.5 33.5 6.0\n")
    assert sorted(tuple(r) for r in tables.read_truth(spark, path).collect()) == [
        (-117.0, 33.0, 5.0),
        (-116.5, 33.5, 6.0),
    ]


def test_text_event_ids(spark, tmp_path, files):
    """Ids that are not all integers stay text through preparation, a step, checkpoints and draws."""
    names = {}
    for key in ("catalog_infile", "dtime_file"):
        with open(files[key]) as f:
            text = f.read().replace("\n1,", "\nev1,").replace(",1,2,", ",ev1,2,").replace(",2,1,", ",2,ev1,")
        names[key] = write(tmp_path / f"text-{key}.csv", text)
    params = RunParams.from_dict(
        {
            **files,
            **names,
            "lat_min": 32.5,
            "lon_min": -118.5,
            "min_dtimes": 2,
            "phase1_epochs": 1,
            "phase3_epochs": 0,
            "phase4_epochs": 1,
            "lr_sgld": 1e-9,
            "checkpoint_dir": str(tmp_path / "checkpoints"),
            "samples_outfile": str(tmp_path / "samples"),
            "save_every_n": 1,
        }
    )
    assert tables.catalog_id_type(spark, files["catalog_infile"]) == "long"
    assert tables.catalog_id_type(spark, params.catalog_infile) == "string"
    _, obs, origins = prepare_inputs(spark, params)
    assert sorted(r["evid"] for r in origins.collect()) == ["2", "ev1"]
    relocate(origins, obs, params)
    stored = read_samples(spark, params.samples_outfile)
    assert sorted((r["evid"], r["batch_id"], r["draw"]) for r in stored.collect()) == [
        ("2", 0, 0),
        ("ev1", 0, 0),
    ]
    _, state = RunStore(spark, params.checkpoint_dir).load()
    assert sorted(r["evid"] for r in state.collect()) == ["2", "ev1"]


def test_exact_share_of_rows(spark):
    rows = spark.range(1000).selectExpr("id", "id % 7 AS k", "cast(id % 3 AS string) AS s")
    for fraction in (0.0, 0.001, 0.3337, 0.5, 0.9999):
        got = [r["id"] for r in ops.thin_exactly(rows, fraction, seed=5).collect()]
        assert len(got) == len(set(got)) == int(fraction * 1000)
    # rows of equal keys may be cut apart, in order of all columns; the choice does not move with partitions
    some = sorted(r["id"] for r in ops.thin_exactly(rows, 0.4, key=["k"]).collect())
    assert len(some) == 400 and some == sorted(r["id"] for r in ops.thin_exactly(rows.repartition(9), 0.4, key=["k"]).collect())
    hot = spark.range(500).selectExpr("1 AS a", "'x' AS b")
    assert ops.thin_exactly(hot, 0.25).count() == 125
    assert ops.thin_exactly(rows, 1.0).count() == 1000 and ops.thin_exactly(rows.limit(0), 0.5).count() == 0
    with pytest.raises(ValueError):
        ops.thin_exactly(rows, -0.1)
