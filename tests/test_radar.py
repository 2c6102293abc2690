import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import components, dataset, detect, evaluate, raster
from tidemark.plans.scenes import masked_scenes, slick_figures
from tidemark.sources.rasters import list_raster_files, read_rasters, write_report


def frame(spark, arrays):
    rows = [(s, r, c, float(v)) for s, a in arrays.items() for (r, c), v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, "scene_id bigint, row bigint, col bigint, value double")


def grid(df, name, shape, scene=0):
    out = np.full(shape, np.nan)
    for r in df.filter(F.col("scene_id") == scene).collect():
        assert np.isnan(out[r.row, r.col])
        out[r.row, r.col] = r[name]
    return out


def box(a, k):
    p = np.pad(a, k, mode="reflect") if min(a.shape) > 1 else np.pad(a, k, mode="edge")
    return np.array([[p[i:i + 2 * k + 1, j:j + 2 * k + 1].mean() for j in range(a.shape[1])] for i in range(a.shape[0])])


RNG = np.random.default_rng(5)


@pytest.mark.parametrize("shape,size", [((12, 17), 5), ((9, 4), 3), ((3, 5), 9), ((2, 40), 31)])
def test_box_mean_with_mirrored_border(spark, shape, size):
    a = RNG.random(shape)
    for axes in (("col", "row"), ("row", "col")):
        assert grid(raster.box_mean(frame(spark, {0: a}), size, axes=axes), "mean", shape) == pytest.approx(box(a, size // 2))


def test_lee_and_gradient(spark):
    a = RNG.random((14, 11))
    m, s = box(a, 2), box(a * a, 2)
    var = np.maximum(s - m * m, 1e-6)
    want = m + np.clip(var / (var + a.var() + 1e-6), 0, 1) * (a - m)
    assert grid(raster.lee(frame(spark, {0: a}), 5), "despeckled", a.shape) == pytest.approx(want)
    gy, gx = np.gradient(a)
    assert grid(raster.gradient(frame(spark, {0: a})), "gradient", a.shape) == pytest.approx(np.hypot(gx, gy))


def test_probability_equals_two_plain_filters(spark):
    a = RNG.random((40, 36))
    w = np.array(raster.gauss_weights())
    p = np.pad(1 - a, 3, mode="reflect")
    smooth = np.array([[(p[i:i + 7, j:j + 7] * np.outer(w, w)).sum() for j in range(a.shape[1])] for i in range(a.shape[0])])
    want = 1 / (1 + np.exp(-15 * (smooth - box(smooth, 15) - 0.05)))
    assert grid(detect.probability(frame(spark, {0: a}), "value"), "prob", a.shape) == pytest.approx(want)


def test_blending_returns_the_raster(spark):
    a = RNG.random((50, 37))
    t = raster.tile_pixels(frame(spark, {0: a}), 16, 12)
    assert grid(raster.blend_tiles(t, 16), "value", a.shape) == pytest.approx(a)
    arr = {(r.r0, r.c0): np.array(r["values"]).reshape(16, 16) for r in raster.tile_arrays(t, 16).collect()}
    last = arr[(48, 36)]
    assert last[:2, 0] == pytest.approx(a[48:50, 36]) and last[2:].sum() == 0 and last[:, 1:].sum() == 0
    assert len(arr) == 5 * 4


def flood(mask):
    seen, n = {}, 0
    for start in zip(*np.nonzero(mask)):
        if start in seen:
            continue
        n, stack = n + 1, [start]
        seen[start] = n
        while stack:
            r, c = stack.pop()
            for q in ((r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                if 0 <= q[0] < mask.shape[0] and 0 <= q[1] < mask.shape[1] and mask[q] and q not in seen:
                    seen[q] = n
                    stack.append(q)
    return seen


@pytest.mark.parametrize("block", [256, 7, 1])
def test_components_against_flood_fill(spark, block):
    masks = {0: RNG.random((40, 40)) < 0.42, 1: np.eye(30, dtype=bool), 2: np.zeros((5, 5), bool)}
    spiral = np.zeros((21, 21), bool)
    for k in range(0, 10, 2):
        spiral[k, k:21 - k] = spiral[20 - k, k:21 - k] = spiral[k:21 - k, k] = spiral[k:21 - k, 20 - k] = True
        spiral[k + 1, k] = False
    masks[3] = spiral
    df = frame(spark, masks).withColumn("mask", F.col("value").cast("int"))
    got = components.components(df, block=block).collect()
    for s, m in masks.items():
        want = flood(m)
        mine = {(r.row, r.col): r.component for r in got if r.scene_id == s}
        assert set(mine) == set(want)
        pairs = {(want[p], mine[p]) for p in mine}
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_circle_and_square_shapes(spark):
    yy, xx = np.mgrid[0:100, 0:100]
    disc, bar = (yy - 50) ** 2 + (xx - 50) ** 2 <= 900, (abs(yy - 50) < 4) & (abs(xx - 50) < 40)
    df = frame(spark, {0: disc, 1: bar}).withColumns({"mask": F.col("value").cast("int"), "prob": F.lit(0.95)})
    bounds = spark.createDataFrame([(s, 100, 100, 72.0, 18.0, 73.0, 19.0) for s in (0, 1)], "scene_id bigint, h bigint, w bigint, min_lon double, min_lat double, max_lon double, max_lat double")
    a, b = slick_figures(df, bounds).orderBy("scene_id").collect()
    px = 111.320 * np.cos(np.radians(18.5)) * 110.574 / 1e4
    assert a.area_km2 == pytest.approx(disc.sum() * px, abs=1e-3) and a.confidence == 0.95
    assert a.elongation_ratio == pytest.approx(1, abs=0.02) and a.compactness == "COMPACT_FORMATION"
    # A disc's outline is a few per cent too long in steps between pixels, not a quarter.
    assert 0.85 < a.circularity <= 1
    assert b.compactness == "ELONGATED_SLICK" and b.elongation_ratio == pytest.approx(79 / 7, rel=0.02) and b.orientation_deg == 0
    assert (a.lon, a.lat) == pytest.approx((72.5, 18.5)) and a.age_status == "ESTIMATED_RANGE"


def test_dark_square_chain(spark):
    """Preview scene with a dark square: the whole chain against plain array code.

    The 31-pixel mean sees only the square in its very middle, so the rim carries the mask.
    """
    a = np.clip(RNG.normal(180, 20, (128, 128)), 1, 255)
    a[44:84, 44:84] = np.clip(RNG.normal(35, 8, (40, 40)), 1, 255)
    scenes = spark.createDataFrame([(0, ".png")], "scene_id bigint, ext string")
    wind = spark.createDataFrame([(0, 6.5)], "scene_id bigint, wind_mps double")
    got = masked_scenes(frame(spark, {0: a}), scenes, wind).withColumn("mask", F.col("mask").cast("double"))
    x = a / 255
    m, s = box(x, 1), box(x * x, 1)
    var = np.maximum(s - m * m, 1e-6)
    norm = np.clip(m + np.clip(var / (var + x.var() + 1e-6), 0, 1) * (x - m), 0, 1)
    w = np.array(raster.gauss_weights())
    p = np.pad(1 - norm, 3, mode="reflect")
    smooth = np.array([[(p[i:i + 7, j:j + 7] * np.outer(w, w)).sum() for j in range(128)] for i in range(128)])
    prob = 1 / (1 + np.exp(-15 * (smooth - box(smooth, 15) - 0.05)))
    assert grid(got, "prob", a.shape) == pytest.approx(prob)
    mask = grid(got, "mask", a.shape)
    assert mask[46:50, 46:82].all() and mask[:28].mean() < 0.05


@pytest.mark.parametrize("wind,p,flags", [(1.2, 0.75, 2), (6.5, 0.2, 1), (14.0, 0.45, 2), (None, 0.2, 1)])
def test_lookalike_on_a_flat_patch(spark, wind, p, flags):
    df = frame(spark, {0: np.full((10, 10), 0.8)}).withColumnRenamed("value", "prob")
    w = spark.createDataFrame([(0, wind)], "scene_id bigint, wind_mps double")
    v = detect.lookalike(df, w).first()
    assert v.lookalike_probability == p and len(v.flags) == flags and v.is_probable_spill == (p < 0.5)


def test_metrics(spark):
    t = np.zeros((10, 10))
    t[:5] = 1
    half = np.zeros((10, 10))
    half[:, :5] = 1
    for pred, iou in ((t, 1.0), (1 - t, 0.0), (half, 0.3333)):
        df = evaluate.join_truth(frame(spark, {0: pred}), frame(spark, {0: t}).withColumnRenamed("value", "truth"))
        r = evaluate.scene_metrics(df).first()
        assert r.iou == pytest.approx(iou, abs=1e-4) and r.tp + r.fp + r.tn + r.fn == 100
    empty = frame(spark, {0: np.zeros((3, 3))}).withColumn("truth", F.lit(0))
    assert evaluate.scene_metrics(empty).first().iou == 1.0


def test_value_kind(spark):
    arrays = {0: np.array([[-9.0, 1.0], [-1.0, 3.0]]), 1: np.array([[-1.0, 5.0], [-2.0, 0.5]]), 2: np.array([[0.0, 1.0]]), 3: np.array([[4.0, 90.0]])}
    kinds = {r.scene_id: r.value_kind for r in raster.value_kind(frame(spark, arrays)).collect()}
    want = {s: "DB" if np.median(a) < 0 or (a.min() < -5 and a.max() <= 10) else "NORMALISED" if a.min() >= 0 and a.max() <= 1 else "DN" for s, a in arrays.items()}
    assert kinds == want


def test_scan_flags(spark):
    a = np.array([[0.0, np.nan], [np.inf, 1.0]])
    r = raster.scan(frame(spark, {0: a})).first()
    assert (r.h, r.w, r.has_nan, r.has_inf, r.is_binary) == (2, 2, True, True, False)


def test_raster_files(spark, tmp_path):
    two = np.stack([np.zeros((120, 130)), np.ones((120, 130))])
    np.save(tmp_path / "first.npy", two)
    np.save(tmp_path / "last.npy", np.moveaxis(two, 0, -1))
    np.save(tmp_path / "flat.npy", RNG.random((70, 9)))
    (tmp_path / "first.png").write_bytes(b"x")
    (tmp_path / "only.png").write_bytes(b"x")
    for pol, want in (("VV", 0.0), ("VH", 1.0)):
        got = read_rasters(spark, str(tmp_path), pol).groupBy("scene").agg(F.count("*").alias("n"), F.avg("value").alias("m")).collect()
        assert {r.scene: (r.n, r.m) for r in got if r.scene != "flat"} == {"first": (15600, want), "last": (15600, want)}
    (tmp_path / "sub").mkdir()
    np.save(tmp_path / "sub" / "flat.npy", RNG.random((3, 4)))
    (tmp_path / "sub" / "first.png").write_bytes(b"x")
    sizes = {r["scene"]: r["count"] for r in read_rasters(spark, str(tmp_path)).groupBy("scene").count().collect()}
    assert (sizes["flat"], sizes["sub/flat"]) == (630, 12)
    assert sorted(r.basename + r.ext for r in list_raster_files(spark, str(tmp_path)).collect()) == ["first.npy", "first.png", "flat.npy", "flat.npy", "last.npy", "only.png"]
    write_report(spark.range(1), str(tmp_path / "report"))
    assert len(list((tmp_path / "report").glob("*.json"))) == 1


@pytest.mark.parametrize("n,want", [(1, {"train": 1}), (2, {"train": 1, "val": 1}), (3, {"train": 2, "val": 1}), (10, {"train": 7, "val": 2, "test": 1}), (100, {"train": 70, "val": 20, "test": 10})])
def test_scene_split(spark, n, want):
    got = dataset.scene_split(spark.range(n), "id").collect()
    assert {s: sum(r.split == s for r in got) for s in {r.split for r in got}} == want and len({r.id for r in got}) == n


def test_flat_split(spark):
    assert sorted(r.split for r in dataset.flat_split(spark.range(1), "id").collect()) == ["train", "val"]
    got = [r.split for r in dataset.flat_split(spark.range(25), "id").collect()]
    assert (got.count("train"), got.count("val")) == (20, 5)


def test_negative_sampling(spark):
    rows = [(s, f"t{s}_{i}", i < p) for s, p in ((0, 3), (1, 0)) for i in range(20)]
    tiles = spark.createDataFrame(rows, "scene_id bigint, tile_name string, has_spill boolean")
    got = dataset.sample_negatives(tiles, 2.0, clean_keep=4).groupBy("scene_id", "has_spill").count().collect()
    assert {(r.scene_id, r.has_spill): r["count"] for r in got} == {(0, True): 3, (0, False): 6, (1, False): 4}


def test_intake(spark):
    files = spark.createDataFrame([("a/x.TIF", 5), ("a/x.exe", 5), ("a/b.png", 0), ("a/c.npy", 50 * 1024 * 1024 + 1), ("a/d.nc", 9)], "path string, length bigint")
    got = {r.path: r.reject_reason for r in dataset.intake_check(files).collect()}
    assert list(got.values()) == [None, "UNSUPPORTED_FORMAT", "EMPTY", "TOO_LARGE", "UNSUPPORTED_FORMAT"]
    scenes = {r.path: r.reject_reason for r in dataset.intake_check(files, dataset.SCENE_EXT, None).collect()}
    assert scenes["a/d.nc"] is None and scenes["a/c.npy"] is None


def test_opening(spark):
    m = RNG.random((25, 31)) < 0.85
    p = np.pad(m, 1, constant_values=True)
    core = p[1:-1, 1:-1] & p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:]
    q = np.pad(core, 1)
    want = q[1:-1, 1:-1] | q[:-2, 1:-1] | q[2:, 1:-1] | q[1:-1, :-2] | q[1:-1, 2:]
    df = frame(spark, {0: m}).withColumn("mask", F.col("value").cast("int"))
    dims = raster.scene_stats(df)
    got = {(r.row, r.col) for r in components.opened(df, dims).collect()}
    assert got == set(zip(*map(lambda a: a.tolist(), np.nonzero(want)))) and 0 < len(got) < m.sum()


def test_block_labels_of_a_spiral():
    """One long winding run of pixels is one component; its corners touch diagonally."""
    size, cells, r, c, d = 41, {(0, 0)}, 0, 0, 0
    steps = ((0, 1), (1, 0), (0, -1), (-1, 0))
    for length in (40, *(k for n in range(40, 1, -2) for k in (n, n))):
        for _ in range(length):
            r, c = r + steps[d][0], c + steps[d][1]
            cells.add((r, c))
        d = (d + 1) % 4
    rows = np.array(sorted(cells))
    assert rows.max() < size
    nodes = components.block_nodes(rows[:, 0], rows[:, 1])
    assert set(nodes.tolist()) == {0}
    assert components.block_nodes(rows[:0, 0], rows[:0, 1]).tolist() == []
