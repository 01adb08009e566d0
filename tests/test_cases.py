"""Hand-made cases: what the jobs must do at gaps, edges and ties."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.grid import GridSpec, assign_zones, decimate, snap_points, upscale
from fieldloom.operators import breakpoint, kendall, points, quality, spatial, temporal
from fieldloom.sources import granules


def cube(spark, series, start=0):
    rows = [(c, t, 2000 + t // 12, t % 12 + 1, float(v)) for c, vs in series.items() for t, v in enumerate(vs, start) if v is not None]
    return spark.createDataFrame(rows, "cell_id long, t int, year int, month int, v double")


def dense(spark, series, n):
    return temporal.densify(cube(spark, series), granules.month_spine(spark, (2000, 1), (2000 + (n - 1) // 12, (n - 1) % 12 + 1)))


def test_names_give_months(spark):
    names = ["a/X.061__1_km_monthly_NDVI_doy2000306000000_aid0001.tif", "X_NDVI_doy2001305.tif", "none.tif", "X_pixel_Reliability_doy2001001.tif", "run_200207_x.tif"]
    df = granules.parse_granule_name(granules.classify_layers(spark.createDataFrame([(n,) for n in names], "path string")), fallback_yyyymm=True)
    got = {r["path"]: (r["layer"], r["year"], r["month"]) for r in df.collect()}
    assert [got[n] for n in names] == [("value", 2000, 11), ("value", 2001, 11), (None, None, None), ("quality", 2001, 1), (None, 2002, 7)]
    parts = granules.granule_name_parts(spark.createDataFrame([(names[0],)], "path string")).first()
    assert (parts["version"], parts["doy"], parts["feature_id"], parts["extension"]) == (None, None, None, None) or parts["doy"] == "306"


def test_manifest_and_features_round_trip(spark, tmp_path):
    for n in ("P_NDVI_doy2000306.tif", "P_NDVI_doy2000336.tif", "P_VI_Quality_doy2000306.tif", "P_pixel_reliability_doy2000306.tif"):
        (tmp_path / n).write_bytes(b"x")
    m = granules.granule_manifest(spark, str(tmp_path))
    assert sorted((r["layer"], r["ym"] % 12 + 1) for r in m.collect()) == [("quality", 11), ("value", 11), ("value", 12)]
    f = spark.createDataFrame([(1, 0, 1, 0.5, None), (2, 0, 2, None, 3)], "cell_id long, row int, col int, f1_mean double, f10_points long")
    granules.write_features(f, str(tmp_path / "out"), {"period": "2000-2001"})
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["cell_id"], r["feature"], r["value"], r["period"]) for r in back.where("value IS NOT NULL").collect()) == [(1, "f1_mean", 0.5, "2000-2001"), (2, "f10_points", 3.0, "2000-2001")]


def test_strips_and_points(spark, tmp_path):
    g = GridSpec(0.5, 68.0, -0.5, 36.0, 2, 3)
    s = spark.createDataFrame([(0, 1, [1.0, float("nan"), None])], "t int, row int, values array<double>")
    assert [(r["cell_id"], r["raw"]) for r in granules.explode_strips(s, g).collect()] == [(3, 1.0)]
    (tmp_path / "p.csv").write_text("latitude,longitude,acq_date,year,month\n10.5,70.25,2001-02-03,2001,2\n")
    assert granules.read_points(spark, str(tmp_path / "p.csv")).first()["month"] == 2
    assert granules.missing_months(spark.createDataFrame([(2000, 12), (2001, 2)], "year int, month int"), (2000, 12), (2001, 3)).count() == 2


def test_masks(spark):
    raw = spark.createDataFrame([("i", 5000.0, 0), ("i", -3000.0, 0), ("i", 10001.0, 0), ("f", 0.4, 2), ("f", 1.5, 0), ("g", 0.3, 3)], "granule string, raw double, qa int")
    got = quality.mask_range(quality.rescale(raw, ["granule"])).orderBy("granule", "raw").collect()
    assert [r["v"] for r in got] == [0.4, None, 0.3, None, 0.5, None]
    values = spark.createDataFrame([(1, 0, 0.1), (1, 1, 0.2), (1, 2, 0.25), (2, 0, 0.3)], "t int, cell_id int, v double")
    codes = spark.createDataFrame([(1, 0, 1), (1, 1, 2)], "t int, cell_id int, qa int")
    out = {(r["t"], r["cell_id"]): r["v"] for r in quality.mask_quality(values, codes, ["t"], ["cell_id"]).collect()}
    assert out == {(1, 0): 0.1, (1, 1): None, (1, 2): None, (2, 0): 0.3}  # month 2 has no layer


def test_decomposition(spark):
    wave = [math.sin(math.pi * t / 6) for t in range(48)]
    got = temporal.decompose(dense(spark, {1: [0.5] * 48, 2: wave, 3: [1.0 if t == 20 else None for t in range(48)]}, 48), 47).collect()
    inner = [r for r in got if 6 <= r["t"] <= 41]
    assert all(abs(r["trend"] - (0.5 if r["cell_id"] == 1 else 0)) < 1e-9 and abs(r["resid"]) < 1e-9 for r in inner if r["cell_id"] != 3)
    assert all(r["trend"] is None for r in got if not 6 <= r["t"] <= 41)
    assert [r["t"] for r in sorted(got, key=lambda r: r["t"]) if r["cell_id"] == 3 and r["trend"] is not None] == list(range(14, 27))


def test_cvsi(spark):
    rows = [(1, t, d) for t, d in enumerate([-0.1, 0.2, None, -0.3, 0.0, 0.1])]
    got = {r["t"]: r for r in temporal.cvsi(spark.createDataFrame(rows, "cell_id long, t int, delta double")).collect()}
    assert got[0]["cvsi_1"] is None and got[1]["cvsi_1"] == pytest.approx(0.1) and got[2]["cvsi_1"] == 0 and got[3]["cvsi_1"] is None
    assert got[4]["cvsi_4"] == pytest.approx(0.4) and got[3]["cvsi_4"] is None


def test_kendall(spark):
    rng = np.random.default_rng(1)
    noise = rng.normal(size=30).round(1).tolist()
    series = {1: list(range(20)), 2: list(range(20, 0, -1)), 3: [1] * 20, 4: range(9), 5: noise, 6: [None if t % 3 == 0 else v for t, v in enumerate(noise)]}
    got = {r["cell_id"]: r for r in kendall.mann_kendall(cube(spark, series), "v").collect()}
    assert [got[k]["tau"] for k in (1, 2, 3, 4)] == [1, -1, 0, None]
    for k in (5, 6):
        v = [x for x in series[k] if x is not None]
        s = sum(np.sign(b - a) for i, a in enumerate(v) for b in v[i + 1 :])
        assert got[k]["s"] == s and got[k]["n"] == len(v) and 0 <= got[k]["p"] <= 1
    tied = {r["cell_id"]: r["tau"] for r in kendall.mann_kendall(cube(spark, series), "v", ties=True).collect()}
    assert tied[1] == 1 and tied[3] is None and abs(tied[5]) >= abs(got[5]["tau"])


def test_fill(spark):
    got = temporal.fill_linear(dense(spark, {1: [None, 1.0, None, None, 4.0, None]}, 6), 6, least=2).orderBy("t").collect()
    assert [r["filled"] for r in got] == [1, 1, 2, 3, 4, 4]


def test_snap_is_half_even_and_drops_outside(spark):
    g = GridSpec(1.0, 0.0, -1.0, 0.0, 4, 4)
    pts = spark.createDataFrame([(-x, 0.0, 2000, 1) for x in (0.5, 1.5, 2.5, 3.6, -0.6)], "latitude double, longitude double, year int, month int")
    got = snap_points(pts, g).collect()
    assert [(r["row"], r["in_bounds"]) for r in got] == [(0, True), (2, True), (2, True), (4, False), (-1, False)]
    assert [r["row"] for r in snap_points(pts, g, "floor").collect()] == [0, 1, 2, 3, -1]


def test_zones_overlap_and_edges_count(spark):
    cells = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.0, 0.5), (3, 9.0, 0.5)], "cell_id long, lon double, lat double")
    zones = spark.createDataFrame([("a", 0.0, 1.0, 0.0, 1.0), ("b", 1.0, 2.0, 0.0, 1.0)], "zone string, lon_min double, lon_max double, lat_min double, lat_max double")
    assert sorted((r["cell_id"], r["zone"]) for r in assign_zones(cells, zones).collect()) == [(1, "a"), (2, "a"), (2, "b")]


def test_many_boxes_and_every_edge(spark):
    """100,000 boxes of all sizes against a plain search, joined by equal squares."""
    rng = np.random.default_rng(12)
    n = 100_000
    x, y = rng.uniform(-180, 179, n).round(3), rng.uniform(-90, 89, n).round(3)
    w, h = (10 ** rng.uniform(-3, 0, (2, n))).round(3)
    boxes = np.stack([x, x + w, y, y + h], 1)
    boxes[:3] = [-180, 180, -90, 90], [10, 10, 20, 20], [0, 1000, 0, 1000]
    where = "zone int, lon_min double, lon_max double, lat_min double, lat_max double"
    zones = spark.createDataFrame([*((k, *map(float, b)) for k, b in enumerate(boxes)), (-1, 5.0, 4.0, 0.0, 1.0), (-2, None, 1.0, 0.0, 1.0)], where)
    corners = [(boxes[k][i], boxes[k][2 + j]) for k in range(200) for i in (0, 1) for j in (0, 1)]
    pts = [(float(a), float(b)) for a, b in [*corners, (10, 20), *rng.uniform(-90, 90, (300, 2))]]
    cells = spark.createDataFrame([(k, *p) for k, p in enumerate(pts)], "cell_id long, lon double, lat double")
    want = {(k, z) for k, (a, b) in enumerate(pts) for z in np.flatnonzero((boxes[:, 0] <= a) & (a <= boxes[:, 1]) & (boxes[:, 2] <= b) & (b <= boxes[:, 3])).tolist()}
    got = assign_zones(cells, zones)
    assert got.columns == ["cell_id", "lon", "lat", "zone"]
    rows = [(r["cell_id"], r["zone"]) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString().replace("BroadcastNestedLoopJoin BuildRight, Cross", "")


@pytest.mark.parametrize("side", [3, 64])
def test_lags_with_holes_and_tiles(spark, monkeypatch, side):
    monkeypatch.setattr(spatial.tiles, "__defaults__", (1, side))
    monkeypatch.setattr(spatial.inner, "__defaults__", (side,))
    rng = np.random.default_rng(side)
    cells = {(r, c): (None if rng.random() < 0.1 else float(rng.normal())) for r in range(-2, 11) for c in range(9) if rng.random() < 0.7}
    df = spark.createDataFrame([(r, c, v, "x") for (r, c), v in cells.items()], "row int, col int, v double, s string")
    got = {(r["row"], r["col"]): (r["v"], r["s"], r["n_neighbours"], r["lag"]) for r in spatial.neighbour_lag(df, "v").collect()}
    assert got.keys() == cells.keys()
    for (r, c), (v, s, n, lag) in got.items():
        near = [cells[p] for p in ((r + a, c + b) for a, b in spatial.OFFSETS) if cells.get(p) is not None]
        assert (v, s, n) == (cells[r, c], "x", len(near)) and lag == pytest.approx(sum(near) / len(near) if near else 0.0)
    z = rng.normal(size=(8, 7))
    whole = spark.createDataFrame([(r, c, float(z[r, c])) for r in range(8) for c in range(7)], "row int, col int, filled double")
    monkeypatch.setattr(spatial.tiles, "__defaults__", (1, max(side, 5)))
    monkeypatch.setattr(spatial.inner, "__defaults__", (max(side, 5),))
    small = spatial.morans_i(whole).first()
    monkeypatch.setattr(spatial.tiles, "__defaults__", (1, 64))
    monkeypatch.setattr(spatial.inner, "__defaults__", (64,))
    assert list(small.asDict().values()) == pytest.approx(list(spatial.morans_i(whole).first().asDict().values()))


def test_only_borders_move_twice(spark):
    df = spark.range(128 * 128).select(F.floor(F.col("id") / 128).cast("int").alias("row"), (F.col("id") % 128).cast("int").alias("col"), F.rand(1).alias("v"))
    assert spatial.tiles(df).count() <= 128 * 128 * 1.11
    text, n = exchanges(spatial.neighbour_lag(df, "v"))
    assert n == 1


def lattice(spark, f, n=6):
    return spark.createDataFrame([(r, c, float(f(r, c))) for r in range(n) for c in range(n)], "row int, col int, filled double")


def test_moran(spark):
    board, halves = lattice(spark, lambda r, c: (r + c) % 2), lattice(spark, lambda r, c: c < 3)
    assert spatial.morans_i(board).first()["i"] < 0 < spatial.morans_i(halves).first()["i"]
    flat = spatial.morans_i(lattice(spark, lambda r, c: 1)).first()
    assert flat["i"] is None
    n = {r["n_neighbours"] for r in spatial.neighbour_lag(halves, "filled").collect()}
    assert n == {3, 5, 8}


def test_moran_moments_match_matrices(spark):
    rng = np.random.default_rng(2)
    z = rng.normal(size=(5, 5))
    got = spatial.morans_i(lattice(spark, lambda r, c: z[r, c], 5)).first()
    cells = [(r, c) for r in range(5) for c in range(5)]
    w = np.array([[float(a != b and abs(a[0] - b[0]) <= 1 and abs(a[1] - b[1]) <= 1) for b in cells] for a in cells])
    w /= w.sum(1, keepdims=True)
    x, n = z.ravel() - z.mean(), 25
    s0, s1, s2 = w.sum(), ((w + w.T) ** 2).sum() / 2, ((w.sum(0) + w.sum(1)) ** 2).sum()
    assert got["i"] == pytest.approx(n / s0 * (x @ w @ x) / (x @ x))
    assert got["variance"] == pytest.approx((n * n * s1 - n * s2 + 3 * s0 * s0) / ((n - 1) * (n + 1) * s0 * s0) - 1 / (n - 1) ** 2)


def test_lisa_finds_halves_and_is_repeatable(spark):
    halves = lattice(spark, lambda r, c: 1 if c < 4 else 0, 8)
    a = spatial.lisa(halves).orderBy("row", "col").collect()
    assert a == spatial.lisa(halves.repartition(3)).orderBy("row", "col").collect()
    assert {r["cls"] for r in a if r["col"] in (0, 1)} <= {0, 1} and {r["cls"] for r in a if r["col"] in (6, 7)} <= {0, 3} and any(r["cls"] == 1 for r in a)
    assert all(0 < r["p_sim"] <= 0.5 for r in spatial.lisa(halves, p="analytic").collect())


def test_upscale_and_decimate(spark):
    g = GridSpec(1, 0, -1, 0, 4, 4)
    cells = spark.createDataFrame([(r, c, r * 4 + c) for r in range(4) for c in range(4)], "row int, col int, cell_id int")
    small = decimate(cells, 2)
    assert small.count() == 4
    block = upscale(small.withColumnRenamed("cell_id", "cls"), cells, g, 2, "block")
    assert all(r["cls"] == (r["row"] // 2) * 8 + (r["col"] // 2) * 2 for r in block.collect())


def test_samples_and_information(spark):
    df = spark.range(1000).select(F.col("id").alias("cell_id"), F.lit(1).alias("t"), (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 2).cast("double").alias("x"), F.lit(1).alias("k"))
    one = points.hash_sample(df, ["cell_id", "t"], 50)
    assert one.count() == 50 and {r["cell_id"] for r in one.collect()} == {r["cell_id"] for r in points.hash_sample(df.repartition(7), ["cell_id", "t"], 50).collect()}
    assert {r["n"] for r in points.case_control_sample(df, ["k"], ["cell_id"], 40).groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()} == {40}
    same = points.mutual_information(points.quantile_bins(df, ["k"]), ["k"]).first()
    assert same["mi"] == pytest.approx(math.log(2))
    free = points.mutual_information(points.quantile_bins(df.withColumn("x", F.floor(F.col("cell_id") / 2).cast("double")), ["k"]), ["k"]).first()
    assert abs(free["mi"]) < 1e-6
    assert points.lag_select(spark.createDataFrame([(1, None)], "k int, mi double")).count() == 0


def test_planted_break(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(size=20000).round(4)
    y = (rng.uniform(size=20000) < np.where(x <= 0.5, 0.8, 0.2)).astype(int)
    rows = spark.createDataFrame([("z", float(a), int(b)) for a, b in zip(x, y)] + [("few", 0.5, 1)], "zone string, x double, y int")
    fit = breakpoint.fit_breakpoint(rows).collect()
    assert [r["zone"] for r in fit] == ["z"] and abs(fit[0]["theta"] - 0.5) < 0.02
    below = breakpoint.below_threshold(spark.createDataFrame([(0.1,), (0.9,), (None,)], "f1_mean double"), 0.5).collect()
    assert [r["f9_below"] for r in below] == [1.0, 0.0, 0.0]


def plain_fit(x, y, mid, half, rounds=200):
    """Both parameters of one branch by plain Newton steps to the end, and the likelihood."""
    u, a = (x - mid) / half, np.zeros(2)
    d = np.stack([np.ones_like(u), u], 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-d @ a))
        a = a + np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + breakpoint.RIDGE * np.eye(2), d.T @ (y - p) - breakpoint.RIDGE * a)
    p = np.clip(1 / (1 + np.exp(-d @ a)), breakpoint.CLIP, 1 - breakpoint.CLIP)
    return a[0] - a[1] * mid / half, a[1] / half, -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum()


def test_breakpoint_is_the_best_of_plain_fits(spark):
    rng = np.random.default_rng(6)
    zones = {"rising": (rng.uniform(-0.2, 1, 400).round(3), lambda x: np.where(x < 0.3, 0.1, 0.3 + 0.5 * x)), "flat": (rng.uniform(0.2, 0.4, 300).round(4), lambda x: 0.4 + 0 * x), "parted": (rng.uniform(0, 1, 250).round(2), lambda x: (x > 0.6) * 1.0)}
    rows, data = [], {}
    for z, (x, f) in zones.items():
        y = (rng.uniform(size=len(x)) < f(x)).astype(float)
        data[z] = x, y
        rows += [(z, float(a), int(b)) for a, b in zip(x, y, strict=True)]
    df = spark.createDataFrame([*rows, ("rising", None, 1), ("few", 0.1, 1), *[("none", i / 300, 0) for i in range(300)]], "zone string, x double, y int")
    got = {r["zone"]: r for r in breakpoint.fit_breakpoint(df.repartition(3)).collect()}
    assert got.keys() == zones.keys()
    assert got == {r["zone"]: r for r in breakpoint.fit_breakpoint(df.repartition(7)).collect()}
    for z, r in got.items():
        x, y = data[z]
        low, high = np.quantile(x, [0.1, 0.9])
        mid, half = (low + high) / 2, (high - low) / 2

        def total(theta):
            return sum(plain_fit(x[m], y[m], mid, half)[2] for m in (x <= theta, x > theta) if m.any())

        one, two = plain_fit(x[x <= r["theta"]], y[x <= r["theta"]], mid, half), plain_fit(x[x > r["theta"]], y[x > r["theta"]], mid, half)
        assert (r["a1"], r["b1"], r["a2"], r["b2"]) == pytest.approx((*one[:2], *two[:2]), rel=1e-4, abs=1e-3)
        assert r["nll"] == pytest.approx(one[2] + two[2], abs=1e-5) and (r["n"], r["events"]) == (len(x), y.sum())
        assert r["nll"] <= min(total(t) for t in np.linspace(low, high, 25)) + 1e-5


def exchanges(df):
    """Exchanges of the plan by kind, as it is before it runs."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = df.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    return text, text.count("Exchange hashpartitioning")


def test_features_move_the_cube_once(spark):
    """On the real tables: the cube's blocks are read without an exchange, and all per-cell features, the trend test too, come from one scan of them."""
    from fieldloom.plans import features as plan
    from fieldloom.plans import tables
    from fieldloom.sources import layout

    small = "/root/testdata/sf0.001"
    laid = layout.by_cell(tables.cube(spark, small), 6)
    text, n = exchanges(plan.temporal_features(plan.dense_frame(laid, tables.spine(spark), tables.BASE, tables.MONTHS - 1), 6))
    assert n == 0 and text.count("FileScan") == 1 and "Bucketed: true" in text and text.count("ArrowEvalPython") == 1
    assert sorted(map(tuple, laid.collect())) == sorted(map(tuple, tables.cube(spark, small).collect()))
    plain = plan.dense_frame(tables.cube(spark, small), tables.spine(spark), tables.BASE, tables.MONTHS - 1)
    tau = {r["cell_id"]: r["tau"] for r in kendall.mann_kendall(plain.select("cell_id", "t", "trend")).collect()}
    assert {r["cell_id"]: r["f6_mk_tau"] for r in plan.temporal_features(plan.dense_frame(laid, tables.spine(spark), tables.BASE, tables.MONTHS - 1), 6).collect()} == tau


def test_ingested_cells_are_scanned_once(spark, tmp_path):
    from fieldloom.plans import tables

    cells, stats = tables.ingested(spark, "/root/testdata/sf0.001")
    text, _ = exchanges(quality.rescale(cells, ["t", "granule"], stats=stats))
    assert text.count("FileScan") == 2 and text.count("/stats") == 1  # the cells, and a row for each granule
    assert sorted(map(tuple, tables.cube_of(cells, stats).selectExpr("cell_id", "t", "round(v, 9)").collect())) == sorted(map(tuple, tables.cube(spark, "/root/testdata/sf0.001").selectExpr("cell_id", "t", "round(v, 9)").collect()))


def files_read(df):
    """Files that the scans of a frame read when it ran."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.collectToPython()
    leaves = plan.collectLeaves()
    return [leaves.apply(k).metrics().get("numFiles").get().value() for k in range(leaves.size()) if leaves.apply(k).metrics().contains("numFiles")]


def test_slices_read_their_month_only(spark, tmp_path):
    rows = [(c, 2000 + t // 12, t % 12 + 1, t, float(c + t)) for t in range(30) for c in range(5)]
    cells = granules.write_months(spark.createDataFrame(rows, "cell_id long, year int, month int, t int, v double"), str(tmp_path / "m"))
    spine = granules.month_spine(spark, (2000, 1), (2002, 6))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for asked, t in (((2001, 4), 15), ((1990, 1), 15), ((2002, 6), 29)):
            part = temporal.slice_month(cells, spine, *asked)
            assert sorted(r["v"] for r in part.collect()) == [float(c + t) for c in range(5)]
            assert files_read(temporal.slice_month(cells, spine, *asked))[0] == 1
        assert files_read(granules.filter_period(cells, (2000, 11), (2001, 2)))[0] == 4
        assert files_read(cells)[0] == 30
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    found = granules.table_manifest(spark, str(tmp_path / "m")).collect()
    assert len(found) == 30 and {(int(r["year"]), int(r["month"])) for r in found} == {(2000 + t // 12, t % 12 + 1) for t in range(30)} and all(r["length"] > 0 for r in found)


def test_granules_that_fail_are_listed(spark, tmp_path):
    for name, rows in {"a": [(0, [5000.0, -3000.0]), (1, [3000.0, 9000.0])], "b": [(0, [-3000.0, -3000.0])]}.items():
        spark.createDataFrame(rows, "row int, values array<double>").coalesce(1).write.parquet(str(tmp_path / name))
    (tmp_path / "c.parquet").write_bytes(b"this is no strip file")
    paths = [f"file:{f}" for n in "ab" for f in (tmp_path / n).glob("*.parquet")] + [f"file:{tmp_path}/c.parquet"]
    manifest = spark.createDataFrame([(p,) for p in paths], "path string")
    strips = granules.read_strips(spark, manifest)
    cells = granules.explode_strips(strips, GridSpec(1, 0, -1, 0, 2, 2))
    by_path = {r["path"]: (r["n"], r["n_present"], r["largest"], r["readable"]) for r in granules.granule_stats(cells, ["path"], manifest).collect()}
    want = [(4, 3, 9000.0, True), (2, 0, None, True), (0, 0, None, False)]
    assert [by_path[p] for p in paths] == want
    stats = granules.granule_stats(cells, ["path"], manifest)
    shape = quality.profile(spark.createDataFrame([(1, 0, 0.5)], "cell_id long, t int, v double"), 4, 1, stats).first()
    assert (shape["n_granules"], shape["n_failed"], shape["n_blank"], shape["n_valid"]) == (3, 1, 1, 1)
    assert granules.read_strips(spark, manifest.where("false")).count() == 0
    scaled = quality.rescale(cells.where("raw > 0"), ["path"], stats=stats).agg(F.max("v")).first()[0]
    assert scaled == pytest.approx(0.9)


def test_blocks_follow_the_values(spark):
    from fieldloom.sources import layout

    assert layout.blocks(spark, 10, 10) == spark.sparkContext.defaultParallelism
    assert layout.blocks(spark, 12_758_064, 266) == -(-12_758_064 * 266 // layout.BLOCK_ROWS)


@pytest.mark.parametrize("months", [1, 2, 9, 16, 17, 40, 65])
def test_pairs_by_merging(months):
    rng = np.random.default_rng(months)
    x = np.concatenate([rng.integers(0, 5, (60, months)).astype(float), rng.normal(size=(60, months))])
    x[:9, 0] = np.inf
    n = rng.integers(0, months + 1, 120)
    s, same, spread = kendall.pair_counts(x, n)
    for k, own in enumerate(x[j, : n[j]] for j in range(120)):
        t = np.unique(own, return_counts=True)[1]
        pairs = [(a, b) for i, a in enumerate(own) for b in own[i + 1 :]]
        assert (s[k], same[k], spread[k]) == (sum(int(b > a) - int(b < a) for a, b in pairs), sum(bool(a == b) for a, b in pairs), (t * (t - 1) * (2 * t + 5)).sum())


def test_kendall_statistics(spark):
    """Gaps, ties, NaN and short series against the definitions."""
    rng = np.random.default_rng(4)
    series = {k: [None if rng.random() < 0.2 else float(rng.integers(0, 6)) for _ in range(30)] for k in range(20)} | {50: [1.0] * 12, 51: [float(t) for t in range(9)], 52: [float("nan"), *range(10)]}
    for ties in (False, True):
        got = {r["cell_id"]: r for r in kendall.mann_kendall(cube(spark, series), "v", ties=ties).collect()}
        assert got.keys() == series.keys()
        for k, r in got.items():
            v = [x for x in series[k] if x is not None and x == x]
            n, s = len(v), sum(int(b > a) - int(b < a) for i, a in enumerate(v) for b in v[i + 1 :])
            t = np.unique(v, return_counts=True)[1].astype(float)
            pairs, var, same = n * (n - 1) / 2, n * (n - 1) * (2 * n + 5) / 18, (t * (t - 1) / 2).sum()
            assert (r["n"], r["s"]) == (n, s)
            if n < 10 or (ties and pairs <= same):
                assert r["tau"] is None and r["z"] is None and r["p"] is None
                continue
            tau, z = (s / math.sqrt(pairs * (pairs - same)), s / math.sqrt(var - (t * (t - 1) * (2 * t + 5)).sum() / 18)) if ties else (s / pairs, (s - np.sign(s)) / math.sqrt(var))
            assert r["tau"] == pytest.approx(tau) and r["z"] == pytest.approx(z) and r["p"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), rel=1e-12)


def test_normal_tails_keep_the_stated_error(spark):
    from fieldloom.functions.normal import two_sided_p, two_sided_sql

    zs = [*np.linspace(0, 12, 4001).tolist(), 7.0710678118, 7.0710678119, 36.0, 40.0, -1.96]
    got = [r["p"] for r in spark.createDataFrame([(z,) for z in [*zs, None]], "z double").coalesce(1).select(two_sided_p(F.col("z")).alias("p")).collect()]
    assert got[-1] is None
    for z, p in zip(zs, got[:-1], strict=True):
        want = math.erfc(abs(z) / math.sqrt(2))
        assert abs(p - want) < 1e-15 and p == pytest.approx(want, rel=1e-8, abs=1e-300)
    import duckdb

    for z, p in zip(zs[::100], got[:-1:100], strict=True):
        assert duckdb.connect().execute(f"SELECT {two_sided_sql('z')} FROM (SELECT {z!r}::DOUBLE AS z)").fetchone()[0] == pytest.approx(p, rel=1e-12)


def test_one_exchange_by_cell(spark):
    """All windows of the dense frame, and its aggregation, use the one repartition by cell."""
    from fieldloom.plans.features import temporal_features

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        d = dense(spark, {1: [0.1] * 30, 2: [0.2] * 30}, 30).repartition("cell_id")
        frame = temporal.decompose(temporal.anomaly(d, (2000, 2001)), 29)
        text = temporal_features(frame, 6)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert text.split("REPARTITION_BY_COL")[0].count("Exchange hashpartitioning") == 1


def test_dense_frame_moves_the_cube_once(spark):
    from fieldloom.plans.features import dense_frame, temporal_features
    from fieldloom.sources.granules import month_spine

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        cube = dense(spark, {1: [0.1] * 30, 2: [0.2] * 30}, 30).where("v IS NOT NULL")
        text = temporal_features(dense_frame(cube, month_spine(spark, (2000, 1), (2002, 6)), (2000, 2001), 29), 6)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert text.count("Exchange hashpartitioning") == 1
