"""Sample store, chains, summaries, effective size, distributions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremorframe.operators import chains, distributions, forward, posterior, scaling
from tremorframe.operators import effective_size as ess_ops
from tremorframe.schemas import SAMPLE_FIELDS
from tremorframe.sources import sample_store as store

DRAWS = "evid long, draw long, x0 double, y0 double, z0 double, dx double, dy double, dz double, dt double"


def draws(spark, n_events=3, n_draws=4, offset=0.0):
    rows = [
        (e, d, 120.0, 90.0, 5.0, 0.01 * d + offset, 0.02 * e, -0.01 * d, 0.001 * d)
        for e in range(n_events)
        for d in range(n_draws)
    ]
    return spark.createDataFrame(rows, DRAWS)


def chain_frame(spark, arrays, width=None):
    """Samples of the given (evid -> array) chains, batches of ``width`` draws."""
    rows = []
    for e, xs in arrays.items():
        for i, x in enumerate(xs):
            batch, draw = (0, i) if width is None else divmod(i, width)
            rows.append((e, draw, float(x), float(x) * 2, float(x) - 1, 0.0, float(x), -float(x), float(x) ** 2, batch))
    fields = ", ".join(f"{n} double" for n in SAMPLE_FIELDS)
    return spark.createDataFrame(rows, f"evid long, draw long, {fields}, batch_id long")


def test_store_life_cycle(spark, tmp_path):
    path = str(tmp_path / "samples")
    assert store.read_samples(spark, path).count() == 0
    assert store.next_batch_id(spark, path) == 0
    assert store.clear_samples(spark, path)
    assert store.save_samples(None, path, 32.5, -118.5) is None
    assert store.save_samples(draws(spark).limit(0), path, 32.5, -118.5) is None
    assert store.save_samples(draws(spark), path, 32.5, -118.5) == 0
    assert store.save_samples(draws(spark, offset=1.0), path, 32.5, -118.5) == 1
    # a retried write of the same batch leaves one copy
    store.save_samples(draws(spark, offset=1.0), path, 32.5, -118.5, batch_id=1)
    assert store.read_samples(spark, path).count() == 24
    meta = store.store_metadata(store.read_samples(spark, path)).first()
    assert (meta["n_events"], meta["n_batches"], meta["n_draws"]) == (3, 2, 8)
    assert store.clear_samples(spark, path)
    assert store.read_samples(spark, path).count() == 0
    assert store.next_batch_id(spark, path) == 0


def test_event_subset_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "samples")
    store.save_samples(draws(spark), path, 32.5, -118.5)
    some = store.read_samples(spark, path, event_ids=[1, 99])
    assert {r["evid"] for r in some.collect()} == {1}
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(evid" in plan


def test_lonlat_can_stay_out(spark):
    row = store.build_rows(draws(spark), 32.5, -118.5, store_lonlat=False).first()
    assert row["longitude"] is None and row["latitude"] is None and row["depth"] == 5.0


def test_thinning_restarts_in_every_batch(spark):
    df = chain_frame(spark, {1: range(10)}, width=5)
    got = sorted((r["batch_id"], r["draw"]) for r in store.thin_batches(df, 3).collect())
    assert got == [(0, 0), (0, 1), (1, 0), (1, 1)]
    thinned = store.thin_batches(df, 3)
    assert chains.chain_layout(thinned).n_draws == 4
    with pytest.raises(ValueError):
        chains.thinned_chain(thinned, burn_in=4, thin=1)


def test_short_chains_and_zero_lag_keep_their_events(spark):
    df = chain_frame(spark, {1: [float(i % 7) for i in range(40)], 2: [float(i % 5) for i in range(40)]}, width=10)
    df = df.filter("evid = 1 OR (batch_id = 0 AND draw < 2)")
    for lag in (None, 0, 5):
        sizes = [
            sorted((r["evid"], r["n"], round(r["ess"], 9)) for r in ess_ops.effective_sample_size(df, max_lag=lag, block_draws=b).collect())
            for b in (1000, 8)
        ]
        assert sizes[0] == sizes[1] and [s[:2] for s in sizes[0]] == [(1, 40), (2, 2)]


def test_missing_draws_do_not_depend_on_the_path(spark):
    df = chain_frame(spark, {1: [1.0, 2.0, float("nan"), 4.0, 5.0, 6.0], 2: [float("nan")] * 6}, width=6)
    both = [
        [tuple(r) for r in posterior.posterior_catalog(df, gather_rows=g).orderBy("evid").collect()]
        for g in (1000, 0)
    ]
    assert len(both[0]) == 2
    assert np.allclose(*[np.array(rows, dtype=float) for rows in both], equal_nan=True)
    with pytest.raises(ValueError):
        store.thin_batches(df, 0)


def test_batches_order_by_number(spark):
    df = chain_frame(spark, {1: range(24)}, width=2)
    placed = chains.with_draw_ordinal(df).orderBy("pos").collect()
    assert [r["X"] for r in placed] == [float(i) for i in range(24)]


def test_burn_in_and_thin(spark):
    df = chain_frame(spark, {1: range(10), 2: range(10)}, width=4)
    kept = chains.thinned_chain(df, burn_in=3, thin=3).filter("evid = 1").orderBy("rank").collect()
    assert [(r["pos"], r["rank"], r["X"]) for r in kept] == [(3, 0, 3.0), (6, 1, 6.0), (9, 2, 9.0)]
    for burn_in, thin in ((10, 1), (-1, 1), (0, 0)):
        with pytest.raises(ValueError):
            chains.thinned_chain(df, burn_in, thin)


@pytest.mark.parametrize("gather_rows", [0, 10**6])
def test_posterior_catalog_against_numpy(spark, gather_rows):
    rng = np.random.default_rng(0)
    arrays = {e: rng.normal(e, 1 + e, 41) for e in range(4)}
    got = posterior.posterior_catalog(chain_frame(spark, arrays, 10), 5, 4, gather_rows=gather_rows)
    assert got.columns == "latitude longitude depth X sigma_x Y sigma_y Z sigma_z evid".split()
    for row in got.collect():
        xs = arrays[row["evid"]]
        after, kept = xs[5:], xs[5:][::4]
        half = lambda v: 0.5 * (np.quantile(v, 0.995) - np.quantile(v, 0.005))
        assert row["latitude"] == pytest.approx((2 * after).mean())
        assert row["X"] == pytest.approx(kept.mean())
        assert row["sigma_x"] == pytest.approx(half(kept))
        assert row["sigma_z"] == pytest.approx(half(kept**2))


def test_include_checks_names_and_prunes(spark, tmp_path):
    path = str(tmp_path / "samples")
    store.save_samples(draws(spark), path, 32.5, -118.5)
    df = store.read_samples(spark, path)
    with pytest.raises(KeyError):
        posterior.posterior_means(df, ["speed"])
    plan = posterior.posterior_means(df, ["X"])._jdf.queryExecution().executedPlan().toString()
    assert "latitude" not in plan


def brute_ess(x, max_lag):
    n, c = len(x), x - x.mean()
    v = c.var(ddof=1)
    if v == 0:
        return float(n)
    acf = [max((c[:-k] * c[k:]).sum() / ((n - k) * v), 0) for k in range(1, max_lag + 1)]
    return min(max(n / (1 + 2 * sum(acf)), 1), n)


@pytest.mark.parametrize("block", [7, 25, 100, 16384])
def test_effective_size_against_brute_force(spark, block):
    rng = np.random.default_rng(1)
    slow = np.convolve(rng.normal(size=130), np.ones(11), "valid")
    arrays = {1: slow, 2: rng.normal(size=120), 3: np.full(120, 2.5), 4: np.arange(120.0)}
    df = chain_frame(spark, arrays, 16)
    for max_lag, burn_in, thin in ((None, 0, 1), (5, 0, 1), (None, 11, 2)):
        n = len(slow[burn_in:][::thin])
        lag = max_lag or n // 4
        got = ess_ops.effective_sample_size(df, burn_in, thin, max_lag, block_draws=block)
        for row in got.collect():
            x = arrays[row["evid"]][burn_in:][::thin]
            want = [brute_ess(v, lag) for v in (x, -x, x**2)]
            assert [row["ess_x"], row["ess_y"], row["ess_z"]] == pytest.approx(want, rel=1e-9)
            assert row["ess"] == pytest.approx(min(want), rel=1e-9)
            assert 1 <= row["ess"] <= row["n"] == n


def test_effective_size_guards(spark):
    df = chain_frame(spark, {1: range(8)})
    with pytest.raises(ValueError):
        ess_ops.effective_sample_size(df, method="batch")
    with pytest.raises(ValueError):
        ess_ops.effective_sample_size(df.drop("Z"))
    with pytest.raises(ValueError):
        ess_ops.effective_sample_size(df, burn_in=8)
    # a lag beyond the chain is cut to it
    assert ess_ops.effective_sample_size(df, max_lag=99).count() == 1


def test_histogram_edges(spark):
    lo, width = -0.1, 0.003
    edges = lo + width * np.arange(distributions.edge_count(-0.1, 0.1, width))
    assert len(edges) == len(np.arange(-0.1, 0.1 + 0.5 * width, width))
    values = np.concatenate([edges, np.nextafter(edges, -1), np.nextafter(edges, 1), [-0.2, 0.2]])
    df = chain_frame(spark, {1: values})
    got = distributions.histogram(df, coords=["X"]).collect()
    want, _ = np.histogram(values, bins=edges)
    assert {r["bin"]: r["n"] for r in got} == {i: n for i, n in enumerate(want) if n}
    dens, _ = np.histogram(values, bins=edges, density=True)
    assert all(r["density"] == pytest.approx(dens[r["bin"]], rel=1e-9) for r in got)


def test_cumulative_histogram_defaults(spark):
    values = [0.2, 0.9, 1.0, 2.5, 3.0, 7.0]
    df = spark.createDataFrame([(v,) for v in values], "a double")
    got = distributions.cumulative_histogram(df, ["a"]).orderBy("bin").collect()
    counts, _ = np.histogram(values, bins=np.arange(6))
    upto = np.cumsum(counts) / counts.sum()
    assert [(r["bin"], r["n"]) for r in got] == [(i, n) for i, n in enumerate(counts) if n]
    assert [r["cumulative"] for r in got] == pytest.approx([upto[r["bin"]] for r in got])


def test_histogram2d_and_levels(spark):
    rng = np.random.default_rng(2)
    df = chain_frame(spark, {1: rng.normal(0, 0.05, 300)})
    cells = distributions.histogram2d(df, xlim=(-0.1, 0.1), bin_width=0.05, center=False)
    x = np.array([r["X"] for r in df.orderBy("draw").collect()])
    edges = -0.1 + 0.05 * np.arange(5)
    want, _, _ = np.histogram2d(x, -x, bins=[edges, edges])
    got = {(r["bin_a"], r["bin_b"]): r["n"] for r in cells.filter("pair = 'XY'").collect()}
    assert got == {(a, b): int(want[a, b]) for a in range(4) for b in range(4) if want[a, b]}
    levels = distributions.contour_levels(cells, (-0.1, 0.1), 0.05, 4).filter("pair = 'XY'")
    assert [r["level"] for r in levels.orderBy("level_no").collect()] == pytest.approx(
        np.linspace(want.min(), want.max(), 5)[1:]
    )
    with pytest.raises(ValueError):
        distributions.histogram2d(df, coords=["X", "Y"])


def test_levels_start_at_the_smallest_count_when_no_cell_is_empty(spark):
    cells = spark.createDataFrame(
        [(1, "XY", a, b, 3 + a + b) for a in range(2) for b in range(2)],
        "evid long, pair string, bin_a long, bin_b long, n long",
    )
    levels = distributions.contour_levels(cells, (0.0, 2.0), 1.0, 2).orderBy("level_no").collect()
    assert [r["level"] for r in levels] == [4.0, 5.0]


@pytest.mark.parametrize("gather_rows", [0, 10**6])
def test_density_curve(spark, gather_rows):
    rng = np.random.default_rng(3)
    xs = rng.normal(3, 0.05, 400)
    df = chain_frame(spark, {1: xs, 2: np.full(5, 1.0), 3: [float("nan"), float("inf")]})
    df = df.unionByName(df.filter("draw = 0").withColumns({"X": F.lit(float("nan")), "draw": F.lit(999)}))
    rows = distributions.density_curve(df, ["X"], gather_rows=gather_rows).collect()
    curve = sorted((r["i"], r["x"], r["density"]) for r in rows if r["evid"] == 1)
    assert len(curve) == 512
    grid = np.array([c[1] for c in curve])
    dens = np.array([c[2] for c in curve])
    assert dens.sum() * (grid[1] - grid[0]) == pytest.approx(1, abs=1e-3)
    m = (xs - xs.mean()) * 1000
    iqr = (np.quantile(m, 0.75) - np.quantile(m, 0.25)) / 1.34
    h = 0.9 * min(m.std(ddof=1), iqr) * len(m) ** -0.2
    direct = np.exp(-0.5 * ((grid[:, None] - m) / h) ** 2).sum(1) / (len(m) * h * np.sqrt(2 * np.pi))
    assert dens == pytest.approx(direct, abs=2e-3 * direct.max())
    flat = [r["density"] for r in rows if r["evid"] == 2]
    step = 600 / 511
    assert sum(flat) * step == pytest.approx(1, abs=1e-6)
    none = sorted((r["i"], r["x"], r["density"]) for r in rows if r["evid"] == 3)
    assert len(none) == 512 and none[0][1] == -1.0 and none[-1][1] == pytest.approx(1.0)
    assert all(d == 0.0 for _, _, d in none)


def test_smoothing_is_within_its_bound_of_the_exact_sum():
    rng = np.random.default_rng(12)
    for n in (2, 3, 64, 512, 700):
        grid = rng.random((40, n)) * (rng.random((40, n)) < 0.3)
        width = 10.0 ** rng.uniform(-2, 3.5, 40)
        width[:3] = (0.0, -1.0, np.nan)
        got = distributions.smoothed(grid, width)
        assert np.array_equal(got[:3], grid[:3])
        at = np.arange(n)
        for g, w, row in zip(grid[3:], width[3:], got[3:]):
            kernel = np.exp(-0.5 * ((at[:, None] - at[None, :]) / w) ** 2) / (w * np.sqrt(2 * np.pi))
            norm = np.sqrt((np.exp(-(np.arange(1 - n, n) / w) ** 2) / (2 * np.pi * w * w)).sum())
            bound = 16 * np.finfo(float).eps * np.log2(4 * n) * np.linalg.norm(g) * norm
            assert np.abs(row - kernel @ g).max() <= bound


def test_event_selection(spark):
    df = chain_frame(spark, {e: [0.0] for e in (5, 3, 9, 7)})
    assert [r[0] for r in chains.first_events(df, 2).collect()] == [3, 5]
    assert sorted(r[0] for r in chains.events_at(df, [0, 3, 8]).collect()) == [3, 9]
    assert sorted(r[0] for r in chains.known_events(df, [9, 5, 1000]).collect()) == [5, 9]
    with pytest.raises(ValueError):
        chains.known_events(df, [1000])
    some = chains.random_events(df, 3, seed=1).collect()
    assert len({r[0] for r in some}) == 3


def test_trace_scales_and_centres(spark):
    df = chain_frame(spark, {1: [1.0, 2.0, 3.0, 6.0]})
    got = chains.chain_trace(df, ["X"], burn_in=1, thin=2).orderBy("sample_index").collect()
    assert [(r["sample_index"], r["value"]) for r in got] == [(1, -2000.0), (3, 2000.0)]
    km = chains.chain_trace(df, ["X"], units="kilometers").orderBy("sample_index").collect()
    assert [r["value"] for r in km] == [-2.0, -1.0, 0.0, 3.0]


@pytest.mark.parametrize("gather_rows", [0, 10**6])
def test_catalog_and_chains_agree_with_their_parts(spark, gather_rows):
    rng = np.random.default_rng(9)
    df = chain_frame(spark, {1: rng.normal(3, 0.05, 40), 2: rng.normal(0, 1, 40)})
    catalog, chains_ = posterior.catalog_and_chains(df, 4, 3, gather_rows=gather_rows)
    want = posterior.posterior_catalog(df, 4, 3).orderBy("evid").collect()
    for got, expected in zip(catalog.orderBy("evid").collect(), want):
        assert got.asDict() == pytest.approx(expected.asDict())
    order = ["evid", "rank"]
    parts = zip(chains_.orderBy(*order).collect(), posterior.centred_chains(df, 4, 3).orderBy(*order).collect())
    for got, expected in parts:
        assert tuple(got) == pytest.approx(tuple(expected), abs=1e-9)
    assert chains_.count() == 2 * 12


@pytest.mark.parametrize("gather_rows", [0, 10**6])
def test_shift_statistics_on_both_paths(spark, gather_rows):
    rng = np.random.default_rng(10)
    moves = rng.normal(0, 1, (501, 3))
    state = spark.createDataFrame(moves.tolist(), "dx double, dy double, dz double")
    got = forward.shift_stats(state, gather_rows=gather_rows).first()
    radius = np.linalg.norm(moves, axis=1)
    assert got["quantile_90_radius"] == pytest.approx(np.quantile(radius, 0.9)) and got["max_radius"] == radius.max()
    for axis, column in zip("XYZ", moves.T):
        assert got[f"median_abs_d{axis}"] == np.sort(np.abs(column))[250]
        assert got[f"mean_d{axis}"] == pytest.approx(column.mean())


def test_curves_and_sizes_bound_the_rows_of_a_task(spark, monkeypatch):
    monkeypatch.setattr(scaling, "TASK_ROWS", 30)
    df = spark.range(200).selectExpr("id % 20 AS evid", "id div 20 AS draw", "0L AS batch_id", *[f"sin(id * {k}) AS {c}" for k, c in enumerate("XYZ", 1)])
    for out in (distributions.density_curve(df, n_eval=16), ess_ops.effective_sample_size(df)):
        used = out.withColumn("p", F.spark_partition_id()).agg(F.countDistinct("p")).first()[0]
        assert used > 4
