"""Projection, random numbers, velocity profile, travel-time network."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.queries_model import network_model
from tremorframe.functions.geodesy import EqualArea
from tremorframe.operators import forward
from tremorframe.functions.network import NetworkTravelTime, Remembered, evaluate, load_weights
from tremorframe.functions.portable_random import gaussian, uniform, uniform_pair
from tremorframe.functions.travel_time import StraightRay
from tremorframe.functions.velocity import interpolate, profile_nodes, slowness_at


def test_projection_golden_value(spark):
    x, y = EqualArea(32.5, -118.5).forward(F.lit(-116.78), F.lit(33.5))
    row = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert row["x"] == pytest.approx(159.82437352, abs=1e-7)
    assert row["y"] == pytest.approx(112.19378565, abs=1e-7)


def test_projection_round_trip_and_centre(spark):
    proj = EqualArea(32.5, -118.5)
    points = [(-118.5, 32.5), (-118.5, 33.0), (-117.0, 32.5), (-120.0, 30.0), (-115.0, 35.5)]
    df = spark.createDataFrame(points, "lon double, lat double")
    x, y = proj.forward(F.col("lon"), F.col("lat"))
    df = df.withColumns({"x": x, "y": y})
    lon, lat = proj.inverse(F.col("x"), F.col("y"))
    for row in df.withColumns({"lon2": lon, "lat2": lat}).collect():
        assert row["lon2"] == pytest.approx(row["lon"], abs=2e-8)
        assert row["lat2"] == pytest.approx(row["lat"], abs=2e-8)
    centre = df.filter("lon = -118.5 and lat = 32.5").first()
    assert (centre["x"], centre["y"]) == (pytest.approx(0, abs=1e-9), pytest.approx(0, abs=1e-6))


def test_random_columns_ignore_partitioning(spark):
    ids = spark.range(4000)
    u, w = uniform_pair(F.lit(1), F.col("id"))
    cols = [uniform(F.lit(3), F.col("id")).alias("a"), u.alias("u"), w.alias("w")]
    one = {r["id"]: r for r in ids.repartition(7).select("id", *cols).collect()}
    two = {r["id"]: r for r in ids.repartition(3, "id").select("id", *cols).collect()}
    assert one == two
    u, w = np.array([[r["u"], r["w"]] for r in one.values()]).T
    assert 0 <= u.min() and u.max() < 1
    assert u.mean() == pytest.approx(0.5, abs=0.02) and w.var() == pytest.approx(1 / 12, abs=0.006)
    assert abs(np.corrcoef(u, w)[0, 1]) < 0.06


def test_gaussian_moments(spark):
    z = np.array(
        [r[0] for r in spark.range(8000).select(gaussian(F.col("id"), F.lit("x"))).collect()]
    )
    assert z.mean() == pytest.approx(0, abs=0.05)
    assert z.std() == pytest.approx(1, abs=0.04)
    assert (z**3).mean() == pytest.approx(0, abs=0.15)


def test_velocity_profile(spark):
    model = spark.createDataFrame(
        [(10.0, 3.5, 6.2), (0.0, 3.3, 6.0), (20.0, 3.7, 6.4)], "depth double, vs double, vp double"
    )
    nodes = profile_nodes(model)
    assert [n[0] for n in nodes] == [0.0, 10.0, 20.0]
    z = spark.createDataFrame([(0.0,), (5.0,), (10.0,), (20.0,)], "z double")
    got = [r[0] for r in z.select(interpolate([(d, p) for d, p, _ in nodes], F.col("z"))).collect()]
    assert got == pytest.approx([6.0, 6.1, 6.2, 6.4])
    s = z.select(slowness_at(nodes, F.col("z"), F.lit(1))).collect()
    assert [r[0] for r in s] == pytest.approx([1 / 3.3, 1 / 3.4, 1 / 3.5, 1 / 3.7])


def test_velocity_profile_outside(spark):
    nodes = [(0.0, 6.0), (10.0, 6.2)]
    z = spark.createDataFrame([(-1.0,)], "z double")
    assert z.select(interpolate(nodes, F.col("z"), "null")).first()[0] is None
    with pytest.raises(Exception, match="outside the velocity model"):
        z.select(interpolate(nodes, F.col("z"))).collect()
    with pytest.raises(ValueError):
        interpolate(nodes, F.col("z"), "clamp")


def _brute(layers, x):
    elu = lambda z: np.where(z > 0, z, np.expm1(np.minimum(z, 0)))
    lin = lambda k, a: layers[k][0] @ a + layers[k][1]
    a = elu(lin(0, x))
    for k in range(1, len(layers) - 1, 2):
        a = elu(lin(k + 1, elu(lin(k, a)))) + a
    return abs(lin(len(layers) - 1, a)[0])


def test_network_matches_brute_force_and_differences():
    layers = network_model(16, 3, np.float64).layers
    x = np.random.default_rng(0).uniform(-1, 1, (20, 4))
    value, grad = evaluate(layers, x, True)
    assert value == pytest.approx([_brute(layers, row) for row in x], rel=1e-12)
    step = 1e-6
    for j in range(4):
        up, down = x.copy(), x.copy()
        up[:, j] += step
        down[:, j] -= step
        numeric = (evaluate(layers, up)[0] - evaluate(layers, down)[0]) / (2 * step)
        assert grad[:, j] == pytest.approx(numeric, abs=1e-6)


SCENE = [
    (1, 0, 3.0, 4.0, -0.5, 10.0, 20.0, 5.0, 11.0, 22.0, 7.0),
    (2, 1, 3.0, 4.0, -0.5, -10.0, 2.0, 9.0, 3.0, 4.0, 8.0),
    (3, 1, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0),
]
COLUMNS = "id long, phase int, X double, Y double, Z double, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double"


@pytest.mark.parametrize("kind", ["ray", "network"])
def test_source_gradients_against_differences(spark, kind):
    model = StraightRay(6.0, 3.3) if kind == "ray" else network_model(16, 2, np.float64)
    df = spark.createDataFrame(SCENE[:2], COLUMNS)
    exact = {r["id"]: r for r in model.attach(df, True).collect()}
    step = 1e-5
    for end in "12":
        for axis in "xyz":
            name = f"{axis}{end}"
            up = model.attach(df.withColumn(name, F.col(name) + step)).select("id", f"t{end}").collect()
            down = model.attach(df.withColumn(name, F.col(name) - step)).select("id", f"t{end}").collect()
            for hi, lo in zip(sorted(up), sorted(down)):
                numeric = (hi[1] - lo[1]) / (2 * step)
                got = exact[hi["id"]][f"g{end}{axis}"]
                # the second source of row 2 sits above its receiver
                assert got == pytest.approx(numeric, abs=2e-5), (hi["id"], name)


def test_source_at_receiver_has_zero_gradient(spark):
    row = StraightRay().attach(spark.createDataFrame(SCENE[2:], COLUMNS), True).first()
    assert (row["t1"], row["g1x"], row["g1y"], row["g1z"]) == (0.0, 0.0, 0.0, 0.0)


def test_equal_rows_are_found_once():
    rng = np.random.default_rng(4)
    seen, calls = Remembered(3, 2, entries=64), []

    def find(rows):
        calls.append(len(rows))
        return np.column_stack([rows.sum(axis=1), rows[:, 0] * 7])

    pool = rng.normal(size=(40, 3))
    pool[0], pool[1] = (0.0, 0.0, 0.0), (np.nan, 1.0, 2.0)
    for _ in range(20):
        rows = pool[rng.integers(0, 40, 300)]
        np.testing.assert_array_equal(seen.get(rows, find), np.column_stack([rows.sum(axis=1), rows[:, 0] * 7]))
    # entries that clash are found again, the others once
    assert calls[0] <= 40 and sum(calls[1:]) < 20 * 40
    # more distinct rows than entries
    rows = rng.normal(size=(500, 3))
    np.testing.assert_array_equal(seen.get(rows, find)[:, 0], rows.sum(axis=1))
    one = Remembered(3, 2, entries=1 << 12)
    one.get(pool, find)
    before = len(calls)
    one.get(pool[::-1], find)
    assert len(calls) - before <= 1


def test_observations_of_a_receiver_share_a_task(spark):
    rows = spark.range(2000).selectExpr(
        "id % 50 AS evid1", "id % 49 AS evid2", "double(id % 7) AS X", "1D AS Y", "2D AS Z", "int(id % 2) AS phase"
    )
    for spread, most in ((1, 1), (3, 3)):
        near = forward.by_receiver(rows, 16, spread).withColumn("task", F.spark_partition_id())
        tasks = near.groupBy("X", "phase").agg(F.countDistinct("task").alias("n")).agg(F.max("n")).first()[0]
        assert tasks <= most and near.rdd.getNumPartitions() == 16


def test_receiver_slowness_of_network(spark):
    model = network_model(16, 2, np.float64)
    src, rec = ("x_src", "y_src", "z_src"), ("x_rec", "y_rec", "z_rec")
    df = spark.createDataFrame(
        [(1, 0, 10.0, 20.0, 5.0, 40.0, 3.0, -1.0), (2, 1, 1.0, 2.0, 8.0, 30.0, 12.0, 2.0)],
        "id long, phase int, x_src double, y_src double, z_src double, x_rec double, y_rec double, z_rec double",
    )
    got = {r["id"]: r["slowness"] for r in model.receiver_slowness(df).collect()}
    step, squares = 1e-5, {1: 0.0, 2: 0.0}
    for name in rec:
        up = model.time(df.withColumn(name, F.col(name) + step), src, rec).collect()
        down = model.time(df.withColumn(name, F.col(name) - step), src, rec).collect()
        for hi, lo in zip(up, down):
            squares[hi["id"]] += ((hi["travel_time"] - lo["travel_time"]) / (2 * step)) ** 2
    for i, total in squares.items():
        assert got[i] == pytest.approx(math.sqrt(total), rel=1e-5)


def test_weights_table_round_trip(spark):
    layers = network_model(8, 1, np.float64).layers
    rows = [
        (k, *w.shape, w.ravel().tolist(), b.tolist()) for k, (w, b) in enumerate(layers)
    ]
    table = spark.createDataFrame(
        rows[::-1], "layer int, n_out int, n_in int, w array<double>, b array<double>"
    )
    back = load_weights(table)
    assert all(np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1]) for a, b in zip(back, layers))
    NetworkTravelTime(back, 400.0)
    with pytest.raises(ValueError):
        load_weights(table.limit(3))


def test_velocity_of_many_nodes(spark):
    rng = np.random.default_rng(8)
    depths = np.cumsum(rng.uniform(0.01, 1.0, 100_000))
    nodes = [(z, 4.0 + i % 7, 2.0 + i % 5) for i, z in enumerate(depths.tolist())]
    points = rng.uniform(depths[0], depths[-1], 2000).tolist() + [nodes[0][0], nodes[-1][0], nodes[777][0]]
    df = spark.createDataFrame([(z,) for z in points], "z double")
    got = [r[0] for r in df.select(slowness_at(nodes, F.col("z"), F.lit(1))).collect()]
    want = 1 / np.interp(points, depths, [s for _, _, s in nodes])
    np.testing.assert_allclose(got, want, rtol=1e-9)


def test_velocity_depths_must_differ(spark):
    model = spark.createDataFrame([(0.0, 5.0, 3.0), (0.0, 6.0, 3.5), (9.0, 7.0, 4.0)], "depth double, vp double, vs double")
    with pytest.raises(ValueError, match="increase"):
        profile_nodes(model)
