"""Whole runs: descent, sampling, resume rules, minibatches, logs."""

import os
import re
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremorframe.functions.geodesy import EqualArea
from tremorframe.functions.travel_time import StraightRay
from tremorframe import lineage
from tremorframe.operators import forward
from tremorframe.operators.blocks import ObservationBlocks, in_blocks
from tremorframe.operators.minibatches import permuted, store_minibatches
from tremorframe.params import RunParams
from tremorframe.plans import relocate as plan
from tremorframe.plans.training_pairs import Box, training_pairs
from tremorframe.schemas import COMPONENTS
from tremorframe.sources import sample_store, tables
from tremorframe.sources.run_store import RunStore, read_config, read_metrics

PARAMS = RunParams(
    lat_min=32.5,
    lon_min=-118.5,
    phase_unc=(0.05, 0.05),
    prior_event_std=(0.5, 0.5, 0.5, 0.2),
    prior_centroid_std=(0.05, 0.05, 0.05, 0.05),
    lr_warmup=0.04,
    lr_sgld=1e-9,
    phase3_epochs=0,
    metrics_every=5,
)


@pytest.fixture(scope="module")
def synthetic(spark):
    """Catalog with known errors and exact differential times of the true positions."""
    rng = np.random.default_rng(7)
    n = 10
    true = np.column_stack([rng.uniform(150, 156, n), rng.uniform(105, 111, n), rng.uniform(5, 12, n)])
    shift = rng.normal(0, 0.3, (n, 3))
    shift -= shift.mean(axis=0)
    start = true + shift
    rec = np.column_stack([rng.uniform(120, 190, 14), rng.uniform(80, 140, 14), np.zeros(14)])
    rows = []
    for a in range(n):
        for b in range(a + 1, n):
            for s in range(14):
                phase = (a + b + s) % 2
                v = 3.3 if phase else 6.0
                t = [np.linalg.norm(true[e] - rec[s]) / v for e in (a, b)]
                rows.append((a, b, float(t[1] - t[0]), *map(float, rec[s]), phase))
    obs = spark.createDataFrame(
        rows, "evid1 long, evid2 long, dt double, X double, Y double, Z double, phase int"
    )
    places = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(start)], "evid long, x double, y double, depth double")
    lon, lat = EqualArea(32.5, -118.5).inverse(F.col("x"), F.col("y"))
    origins = places.select(
        "evid", lon.alias("longitude"), lat.alias("latitude"), "depth",
        F.to_timestamp(F.lit("2023-01-01T00:00:00")).alias("time"),
    )
    return origins.cache(), obs.cache(), true


def folders(tmp_path, **changes):
    return replace(
        PARAMS,
        checkpoint_dir=str(tmp_path / "checkpoints"),
        samples_outfile=str(tmp_path / "samples"),
        metrics_outfile=str(tmp_path / "metrics"),
        catalog_outfile=str(tmp_path / "catalog"),
        **changes,
    )


def positions(run):
    rows = run.state.orderBy("evid").collect()
    return np.array([[r[f"{a}0"] + r[f"d{a}"] for a in "xyz"] for r in rows])


def test_descent_recovers_positions(spark, tmp_path, synthetic):
    origins, obs, true = synthetic
    params = folders(tmp_path, phase1_epochs=18, metrics_every=17)
    run = plan.start_run(origins, obs, params, StraightRay())
    before = np.abs(positions(run) - true).mean()
    plan.map_phase(run)
    assert np.abs(positions(run) - true).mean() < 0.5 * before
    logged = read_metrics(spark, params.metrics_outfile).orderBy("epoch").collect()
    assert [r["epoch"] for r in logged] == [0, 17]
    assert logged[-1]["loss"] < logged[0]["loss"] and logged[-1]["mad_p"] < logged[0]["mad_p"]
    catalog = tables.read_catalog(spark, tables.map_catalog_path(params.catalog_outfile))
    got = {r["evid"]: r for r in catalog.collect()}
    assert len(got) == 10 and {"T_src", "X", "Y", "unc_x"} <= set(catalog.columns)
    assert float(got[0]["X"]) == pytest.approx(positions(run)[0, 0])
    assert got[0]["unc_x"] in (None, "") and str(got[0]["time"]) == "2023-01-01 00:00:00"
    row, state = RunStore(spark, params.checkpoint_dir).load()
    assert (row["phase"], row["epoch"], row["optimizer_step"], row["optimizer_type"]) == ("phase1", 17, 18, "Adam")
    assert set(row["stats"]) >= {"max_radius", "mean_dX"} and state.count() == 10


def test_minibatches_cover_every_row_once(spark, synthetic):
    origins, obs, _ = synthetic
    run = plan.start_run(origins, obs, replace(PARAMS, batch_size_warmup=150))
    seen, orders = [], []
    for epoch in range(2):
        ids, sizes = [], []
        for part, n in plan.minibatches(run, 150, epoch):
            got = [r["arid"] for r in part.select("arid").collect()]
            assert len(got) == n
            ids += got
            sizes.append(n)
        assert len(sizes) == 5  # 630 rows in steps of 150, none empty
        seen.append(sorted(ids))
        orders.append(ids)
    assert seen[0] == seen[1] and len(set(seen[0])) == run.n_obs == 630
    assert orders[0] != orders[1]
    plan.map_phase(replace_params(run, phase1_epochs=1, batch_size_warmup=150))
    assert run.optimizer_step == 5


def replace_params(run, **changes):
    run.params = replace(run.params, **changes)
    return run


def test_minibatches_are_cells_of_one_table(spark, tmp_path):
    rows = spark.range(5000).selectExpr("id AS arid", "id * 2 AS x")
    store = store_minibatches(rows, 5000, 100, str(tmp_path), most_buckets=30)
    assert (store.n_batches, store.n_buckets, store.n_slices) == (50, 30, 14)
    orders = []
    for epoch in range(2):
        cells = [c for b in range(50) for c in store.cells(b, epoch)]
        assert sorted(cells) == [(b, s) for b in range(30) for s in range(14)]
        orders.append(cells)
    assert orders[0] != orders[1]
    part, n = store.batch(7, 0)
    got = [r["arid"] for r in part.collect()]
    assert part.columns == ["arid", "x"] and len(got) == len(set(got)) == n
    # only the folders of its cells are read
    part.write.format("noop").mode("overwrite").save()
    scan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: []" not in scan and "EqualTo(_slice" in scan.split("PushedFilters")[1]
    seen = sorted(r["arid"] for rows, _ in store.epoch(3) for r in rows.collect())
    assert seen == list(range(5000))


@pytest.mark.parametrize("n", [1, 2, 3, 10, 257, 4096])
def test_cells_are_permuted(n):
    assert sorted(permuted(i, n, "k") for i in range(n)) == list(range(n))


def ancestors(plan_text, mark):
    """Lines of the operators above the first line that holds ``mark``."""
    lines = plan_text.split("\n")
    at = next(i for i, line in enumerate(lines) if mark in line)
    depth = lambda line: len(re.match(r"[\s:|+\-*()0-9]*", line).group())
    out, level = [], depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < level:
            level = depth(line)
            out.append(line.strip())
    return out


def test_blocks_give_the_same_steps_without_moving_observations(spark, tmp_path, synthetic):
    origins, obs, _ = synthetic
    # a hot pair, whose block is split
    obs = obs.unionByName(obs.filter("evid1 = 0 AND evid2 = 1").crossJoin(spark.range(40)).drop("id"))
    near = plan.start_run(origins, obs, PARAMS, StraightRay())
    far = plan.start_run(origins, obs, PARAMS, StraightRay(), broadcast_events=0, block_events=3, block_rows=200)
    assert isinstance(far.obs, ObservationBlocks) and far.obs.side == 4 and far.obs.n_blocks > 16
    assert far.rows.count() == near.n_obs == far.n_obs
    graded = plan._graded(far, far.obs, far.n_obs)
    with far.planning():
        text = graded._jdf.queryExecution().executedPlan().toString()
    above = ancestors(text, "Bucketed: true")
    upto = next(i for i, line in enumerate(above) if "HashAggregate" in line)
    assert sum("ShuffledHashJoin" in line for line in above[:upto]) == 2
    assert not any("Exchange" in line for line in above[:upto])
    for run in (near, far):
        for _ in range(2):
            plan.adam_step(run, run.obs, run.n_obs)
        plan.langevin_step(run, run.obs, run.n_obs, 0.5)
    assert np.abs(positions(near) - positions(far)).max() < 1e-9
    assert plan._epoch_metrics(near, [1.0])["mad_p"] == pytest.approx(plan._epoch_metrics(far, [1.0])["mad_p"])
    parts = list(plan.minibatches(far, 300, 0))
    assert sum(n for _, n in parts) == far.n_obs
    path = far.obs.path
    plan.end_run(far)
    assert not os.path.exists(path) and len(positions(far)) == 10
    assert far.obs.name not in [t.name for t in spark.catalog.listTables()]
    plan.end_run(near)


def test_runs_leave_nothing_but_their_state(spark, tmp_path, synthetic):
    origins, obs, _ = synthetic
    shared = lineage.shared_dir(spark)
    scratch = lambda: {f for f in os.listdir(shared) if f.startswith(("relocat", "observations"))}
    before = scratch()
    params = folders(tmp_path, phase1_epochs=1, phase4_epochs=1, batch_size_warmup=300, save_every_n=1)
    run = plan.relocate(origins, obs, replace(params, config_outfile=str(tmp_path / "config")), StraightRay())
    assert scratch() - before == {os.path.basename(run.folder)}
    assert os.listdir(run.folder) == ["state"] and run.state.count() == 10
    config = read_config(spark, str(tmp_path / "config")).first()
    assert config["run_id"] == "run" and config["config"]["phase1_epochs"] == "1"
    assert config["config"]["total_events"] == "10" and config["config"]["total_dtimes"] == "630"
    with pytest.raises(ValueError):
        plan.relocate(origins, obs.withColumn("evid1", F.lit(99).cast("long")), params, StraightRay())
    with pytest.raises(Exception):
        plan.relocate(origins, obs, replace(params, lr_sgld=-1.0, reset_batch_numbers=True), StraightRay())
    assert scratch() - before == {os.path.basename(run.folder)}


def test_full_run_saves_each_draw_once(spark, tmp_path, synthetic):
    origins, obs, _ = synthetic
    params = folders(
        tmp_path,
        phase1_epochs=1,
        phase2_epochs=1,
        phase4_epochs=7,
        save_every_n=2,
        checkpoint_interval=3,
        rel_change_window=2,
        rel_change_window2=4,
        metrics_every=1,
    )
    params = replace(params, phase3_epochs=2)
    run = plan.relocate(origins, obs, params, StraightRay())
    assert run.global_step == 11 and run.n_draws == 0
    stored = sample_store.read_samples(spark, params.samples_outfile)
    per_batch = {r["batch_id"]: r["sample_count"] for r in sample_store.batch_metadata(stored).collect()}
    # sampler steps 4 .. 10 of which the even ones are kept; flushed at epochs 3, 6 and the end
    assert per_batch == {0: 2, 1: 2}
    assert stored.count() == 4 * 10
    rows = read_metrics(spark, params.metrics_outfile).filter("phase like 'phase%'").collect()
    by = {(r["phase"], r["epoch"]): r for r in rows}
    assert by["phase3", 0]["ramp_progress"] == 0.5 and by["phase3", 1]["noise_enabled"]
    assert by["phase2", 0]["noise_enabled"] is False
    assert by["phase4", 1]["relative_change_N"] is None
    assert by["phase4", 2]["relative_change_N"] > 0
    assert by["phase4", 3]["relative_change_N2"] is None and by["phase4", 4]["relative_change_N2"] > 0
    assert RunStore(spark, params.checkpoint_dir).load_row()["epoch"] == 6


def test_resume_continues_the_sampler(spark, tmp_path, synthetic):
    origins, obs, _ = synthetic
    params = folders(
        tmp_path, phase1_epochs=1, phase4_epochs=2, save_every_n=1, checkpoint_interval=1, metrics_every=100
    )
    plan.relocate(origins, obs, params, StraightRay())
    store = RunStore(spark, params.checkpoint_dir)
    first = store.load_row()
    assert (first["phase"], first["epoch"], first["global_step_count"]) == ("phase4", 1, 3)
    batches = sample_store.next_batch_id(spark, params.samples_outfile)
    again = plan.relocate(origins, obs, replace(params, phase4_epochs=4), StraightRay())
    # epochs 1, 2, 3 run again from the stored one
    assert again.global_step == 6
    assert store.load_row()["epoch"] == 3
    assert sample_store.next_batch_id(spark, params.samples_outfile) > batches


@pytest.mark.parametrize(
    "stored, changes, want",
    [
        (None, {}, ("phase1", 0, None)),
        ("phase1", {}, ("phase1", 5, "phase1")),
        ("map", {}, ("phase1", 5, "phase1")),
        ("phase3", {}, ("phase3", 5, "phase3")),
        ("phase4", {}, ("phase4", 5, "phase4")),
        ("warmup", {}, ("phase4", 5, "phase4")),
        ("phase4", {"clear_samples_on_reset": True}, ("phase2", 0, "phase4")),
        ("phase4", {"reset_batch_numbers": True}, ("phase1", 0, None)),
    ],
)
def test_resume_rules(spark, tmp_path, synthetic, stored, changes, want):
    origins, obs, _ = synthetic
    params = folders(tmp_path, **changes)
    run = plan.start_run(origins, obs, params)
    draws = run.state.select("evid", F.lit(0).cast("long").alias("draw"), "x0", "y0", "z0", *COMPONENTS)
    sample_store.save_samples(draws, params.samples_outfile, 32.5, -118.5)
    if stored:
        moved = run.state.withColumn("dx", F.lit(0.25))
        run.store.save(moved, stored, 5, run.n_obs, "pSGLD", 9, 77)
    entry = plan.resume_point(run)
    assert (entry.phase, entry.epoch, entry.resumed_from) == want
    adopted = stored is not None and not changes.get("reset_batch_numbers")
    assert run.state.first()["dx"] == (0.25 if adopted else 0.0)
    assert run.global_step == (77 if adopted else 0)
    left = sample_store.read_samples(spark, params.samples_outfile).count()
    assert left == (0 if changes.get("clear_samples_on_reset") else 10)
    assert (run.store.load_row() is None) == (stored is None or "reset_batch_numbers" in changes)


def test_checkpoints_of_runs_stay_apart(spark, tmp_path, synthetic):
    origins, _, _ = synthetic
    state = forward.initial_state(origins, 32.5, -118.5)
    one, two = (RunStore(spark, str(tmp_path), name) for name in ("one", "two"))
    assert one.load() is None and one.clear()
    assert [one.save(state, "phase2", 0, 1, "pSGLD", 1, 1) for _ in range(2)] == [0, 1]
    two.save(state, "phase1", 3, 1, "Adam", 1, 1)
    assert one.clear() and one.load() is None
    assert two.load_row()["epoch"] == 3
    assert one.save(state, "phase1", 0, 1, "Adam", 1, 1) == 0


def test_probe_halves_until_flat(spark, synthetic):
    origins, obs, _ = synthetic
    run = plan.start_run(origins, obs, replace(PARAMS, lr_sgld=1e-8, batch_size_sgld=300))
    # fewer losses than the window count as flat
    assert plan.probe_step_size(run, probe_steps=3, win=50) == 1e-8
    # a window of 2 that never looks flat uses up the halvings
    got = plan.probe_step_size(run, max_halves=1, win=2, rel_slope=0.0)
    assert got == pytest.approx(1e-8 / 4)


def test_uncertainty_columns_come_from_a_summary(spark, synthetic):
    origins, _, _ = synthetic
    state = forward.initial_state(origins, 32.5, -118.5).withColumn("dt", F.lit(0.25))
    sigma = origins.select("evid", *[F.lit(float(i)).alias(f"sigma_{a}") for i, a in enumerate("xyz", 1)])
    out = forward.relocated_catalog(origins, state, 32.5, -118.5, sigma, shift_time=True).first()
    assert (out["unc_x"], out["unc_y"], out["unc_z"]) == (1.0, 2.0, 3.0)
    assert str(out["time_shifted"]) == "2023-01-01 00:00:00.250000"


def test_no_observations_is_an_error(synthetic):
    origins, obs, _ = synthetic
    with pytest.raises(ValueError):
        plan.start_run(origins, obs.limit(0), PARAMS)


def test_training_pairs_stay_in_the_box(spark):
    nodes = [(-5.0, 6.0, 3.3), (20.0, 6.5, 3.6)]
    rows = training_pairs(spark.range(3000), Box(50.0, -5.0, 20.0), nodes).collect()
    for a, lo, hi in (("x", 0, 50), ("y", 0, 50), ("z", -5, 20)):
        src = np.array([r[f"{a}_src"] for r in rows])
        rec = np.array([r[f"{a}_rec"] for r in rows])
        assert lo <= src.min() and src.max() <= hi and lo <= rec.min() and rec.max() <= hi
        assert src.mean() == pytest.approx((lo + hi) / 2, abs=(hi - lo) * 0.03)
    phase = np.array([r["phase"] for r in rows])
    assert set(phase) == {0, 1} and phase.mean() == pytest.approx(0.5, abs=0.04)
    slow = np.array([r["s_true"] for r in rows])
    assert slow[phase == 0].max() <= 1 / 6.0 and slow[phase == 1].min() >= 1 / 3.6


def test_blocks_grow_with_events_and_not_with_their_square(spark):
    obs = spark.range(4000).selectExpr("id % 400 AS evid1", "id % 400 + 1 + id % 3 AS evid2", "id AS arid")
    path = lineage.scratch_path(spark, "blocks")
    blocks = in_blocks(obs, 400, path, block_events=10, block_rows=1000)
    assert blocks.side == 40 and blocks.n_blocks <= 160  # one per row and column would be near 1,000
    # an event goes to the blocks that hold it, and to no other
    sent = blocks.routes.selectExpr("sum(size(blocks1))", "sum(size(blocks2))").first()
    held = blocks.table.selectExpr("count(DISTINCT block, evid1)", "count(DISTINCT block, evid2)").first()
    assert tuple(sent) == tuple(held) and blocks.table.count() == 4000
    tall = blocks.table.groupBy("block").agg(F.countDistinct("evid2").alias("n")).agg(F.max("n")).first()[0]
    assert tall <= 20
    blocks.free()
    assert not os.path.exists(path) and not os.path.exists(f"{path}-routes")
