"""Operators on small literal matrices, against numpy or known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import cluster, elementwise, estimation, features, geometry, histogram, linalg, matching, neighbourhood, random, reduce, structural
from rasterloom.plans import taps as T
from rasterloom.sources import pixels
from rasterloom.types import Border, Criteria, MatrixError, Shape


def matrix(spark, m, img=0):
    m = np.asarray(m, float)
    m = m[:, :, None] if m.ndim == 2 else m
    rows = [(img, y, x, c, float(m[y, x, c])) for y in range(m.shape[0]) for x in range(m.shape[1]) for c in range(m.shape[2])]
    return spark.createDataFrame(rows, "img long, y int, x int, c int, v double")


def array(px, shape):
    out = np.full(shape, np.nan)
    for r in px.collect():
        out[(r["y"], r["x"]) if len(shape) == 2 else (r["y"], r["x"], r["c"])] = r["v"]
    return out


def test_saturation_and_truncation(spark):
    a, b = matrix(spark, [[0, 1, 100, 127, 128, 200, 250, 255]]), matrix(spark, [[0, 1, 3, 100, 128, 255, 7, 2]])
    assert array(elementwise.add(a, b), (1, 8)).tolist() == [[0, 2, 103, 227, 255, 255, 255, 255]]
    assert array(elementwise.subtract(a, b), (1, 8)).tolist() == [[0, 0, 97, 27, 0, 0, 243, 253]]
    assert array(elementwise.divide(a, b), (1, 8)).tolist() == [[0, 1, 33, 1, 1, 0, 35, 127]]
    assert array(elementwise.multiply_scalar(a, 1.5), (1, 8)).tolist() == [[0, 1, 150, 190, 192, 0, 0, 0]]
    half = matrix(spark, [[0.5, 1.5, -3, 300, float("nan")]])
    assert array(elementwise.saturating(half, "u8"), (1, 5)).tolist() == [[0, 2, 0, 255, 0]]


def test_convert_to_raises(spark):
    with pytest.raises(Exception, match="out of range"):
        elementwise.convert_to(matrix(spark, [[300]]), "u8").collect()


def test_comparisons_with_nan(spark):
    a = matrix(spark, [[float("nan"), 1.0]])
    assert array(elementwise.compare_scalar(a, 0.0, "gt"), (1, 2)).tolist() == [[0, 255]]
    assert array(elementwise.compare_scalar(a, 0.0, "ne"), (1, 2)).tolist() == [[255, 255]]


@pytest.mark.parametrize("border", [Border.REPLICATE, Border.REFLECT, Border.REFLECT_101, Border.WRAP])
def test_box_filter_against_numpy(spark, border):
    m = np.random.default_rng(1).integers(0, 256, (5, 6)).astype(float)
    mode = {Border.REPLICATE: "edge", Border.REFLECT: "symmetric", Border.REFLECT_101: "reflect", Border.WRAP: "wrap"}[border]
    p = np.pad(m, 1, mode=mode)
    want = sum(p[i : i + 5, j : j + 6] for i in range(3) for j in range(3)) / 9
    assert np.allclose(array(neighbourhood.blur(matrix(spark, m), Shape(5, 6), (3, 3), border=border), (5, 6)), want)


def test_border_of_single_row():
    assert T.border_index(-1, 1, Border.REFLECT_101) == 0 and T.border_index(3, 1, Border.REFLECT) == 0
    assert T.border_index(-1, 4, Border.CONSTANT) == -1


def test_composed_taps(spark):
    m = np.random.default_rng(2).random((4, 9))
    k = T.kernel_taps(9, [0.25, 0.5, 0.25])
    twice = neighbourhood.along(neighbourhood.along(matrix(spark, m), k, "x"), k, "x")
    once = neighbourhood.along(matrix(spark, m), T.compose(k, k), "x")
    assert np.allclose(array(twice, (4, 9)), array(once, (4, 9)))


def test_fourier_against_numpy(spark):
    m = np.random.default_rng(3).random((4, 6))
    out = array(neighbourhood.dft(matrix(spark, m), Shape(4, 6)), (4, 6, 2))
    assert np.allclose(out[:, :, 0] + 1j * out[:, :, 1], np.fft.fft2(m))


def test_median_and_morphology(spark):
    m = np.zeros((5, 5))
    m[2, 2] = 9
    px = matrix(spark, m)
    assert array(neighbourhood.median_blur(px, Shape(5, 5), 3), (5, 5)).max() == 0
    assert array(neighbourhood.dilate(px, Shape(5, 5), T.structuring_element("cross", 3, 3)), (5, 5)).sum() == 45
    assert array(neighbourhood.morphology_ex(px, Shape(5, 5), "open", T.structuring_element("rect", 3, 3)), (5, 5)).sum() == 0


def test_canny_closes_a_square(spark):
    m = np.zeros((16, 16))
    m[4:12, 4:12] = 200
    edges = array(features.canny(matrix(spark, m), Shape(16, 16), 100, 300), (16, 16))
    assert edges[8, 3:5].max() == 255 and edges[8, 8] == 0 and edges[0].max() == 0


@pytest.mark.parametrize("tile", [512, 8])
def test_hysteresis_is_a_flood_from_strong_pixels(spark, monkeypatch, tile):
    from rasterloom.operators import dense

    monkeypatch.setattr(dense, "TILE", tile)
    shape = Shape(33, 40)
    yy, xx = np.mgrid[0:33, 0:40]
    noise = np.random.default_rng(7).normal(size=(33, 40)) * 12
    rings = 128 + 60 * np.sin(np.hypot(yy - 10, xx - 17) * 1.1) * (xx / 40) + noise  # long edges that weaken along their way
    px = matrix(spark, np.round(rings)).unionByName(matrix(spark, np.round(rings.max() - rings), 3))
    found = features.canny_candidates(px, shape, 60, 330).collect()
    places = {(r["img"], r["y"], r["x"]) for r in found}
    reached = {(r["img"], r["y"], r["x"]) for r in found if r["strong"]}
    front = list(reached)
    while front:
        img, y, x = front.pop()
        for near in ((img, y + j, x + i) for j in (-1, 0, 1) for i in (-1, 0, 1)):
            if near in places and near not in reached:
                reached.add(near)
                front.append(near)
    rows = features.canny(px, shape, 60, 330).collect()
    assert len(rows) == 2 * 33 * 40
    assert {(r["img"], r["y"], r["x"]) for r in rows if r["v"] == 255} == reached
    assert 0 < sum(r["strong"] for r in found) < len(reached) < len(places)


def test_fast_finds_a_corner(spark):
    m = np.full((15, 15), 20.0)
    m[7:, 7:] = 220
    found = {(r["y"], r["x"]) for r in features.fast(matrix(spark, m), Shape(15, 15), 30, nonmax=False).collect()}
    assert found and all(5 <= y <= 9 and 5 <= x <= 9 for y, x in found)


def test_hough_finds_a_line(spark):
    m = np.zeros((20, 20))
    m[7, :] = 1
    best = features.hough_lines(matrix(spark, m), Shape(20, 20), 1.0, math.pi / 18, 15).orderBy(F.desc("votes")).first()
    assert (best["rho"], round(best["theta"], 6), best["votes"]) == (7.0, round(math.pi / 2, 6), 20)


def test_homography_and_outliers(spark):
    h = np.array([[1.1, 0.2, 3], [-0.1, 0.9, 5], [0.001, 0.002, 1]])
    rng = np.random.default_rng(4)
    a = rng.random((60, 2)) * 100
    q = np.column_stack([a, np.ones(60)]) @ h.T
    b = q[:, :2] / q[:, 2:]
    b[:15] += rng.random((15, 2)) * 80 + 20
    rows = [(1, *map(float, p), *map(float, r)) for p, r in zip(a, b)]
    points = spark.createDataFrame(rows, "group long, ax double, ay double, bx double, by double")
    m = estimation.find_homography(points, "ransac", 1.0, 500).first()
    assert np.allclose(m["model"], h.ravel(), atol=1e-6) and m["n_inliers"] == 45
    clean = estimation.find_homography(points.join(points.limit(0), "group", "left_anti").where("true"), "dlt").first()
    assert len(clean["model"]) == 9
    few = estimation.find_homography(points.limit(3)).first()
    assert few["model"] is None


def test_pnp_recovers_the_pose(spark):
    rng = np.random.default_rng(5)
    x = rng.random((12, 3)) * 2 - 1
    p = np.array([0.1, -0.2, 0.3, 0.1, -0.1, 6.0])
    k = [[800.0, 0, 320], [0, 800.0, 240], [0, 0, 1]]
    uv = estimation.project(x, p, np.array(k))
    rows = [(1, *map(float, a), *map(float, b)) for a, b in zip(x, uv)]
    got = estimation.solve_pnp(spark.createDataFrame(rows, "group long, x double, y double, z double, u double, v double"), k).first()
    assert np.allclose(got["model"], p, atol=1e-5)


def test_rotation_vector_round_trip():
    for v in ([0.1, 0.2, -0.3], [0, 0, 0], [math.pi, 0, 0], [0, math.pi - 1e-6, 0]):
        assert np.allclose(np.abs(estimation.rotation_vector(estimation.rotation(np.array(v, float)))), np.abs(v), atol=1e-5)


def test_linear_systems(spark):
    m, r = np.array([[4.0, 1, 0], [1, 3, 1], [0, 1, 2]]), np.array([[1.0], [2], [3]])
    got = array(linalg.solve(matrix(spark, m), matrix(spark, r)).drop("solved"), (3, 1))
    assert np.allclose(got, np.linalg.solve(m, r))
    assert np.isclose(linalg.determinant(matrix(spark, m), 3).first()["det"], np.linalg.det(m))
    singular = linalg.invert(matrix(spark, np.ones((2, 2)))).first()
    assert singular["det"] == 0 and singular["v"] == 0


def test_roots(spark):
    one = spark.range(1)
    lit = [F.lit(float(v)) for v in (1, -6, 11, -6)]
    assert np.allclose(one.select(linalg.cubic_roots(*lit).alias("r")).first()["r"], [1, 2, 3])
    poly = linalg.solve_poly(spark.createDataFrame([(1, [-6.0, 11.0, -6.0, 1.0])], "k long, c array<double>"), "k", "c").orderBy("root").collect()
    assert np.allclose([r["re"] for r in poly], [1, 2, 3], atol=1e-8)


def test_kmeans_separates(spark):
    rng = np.random.default_rng(6)
    pts = np.concatenate([rng.normal(c, 0.1, (20, 2)) for c in ((0, 0), (5, 5), (0, 5))])
    rows = [(i, [float(a), float(b)]) for i, (a, b) in enumerate(pts)]
    labelled, centres, compactness = cluster.kmeans(spark.createDataFrame(rows, "id long, p array<double>"), 3, Criteria(10, 1e-6))
    labels = [r["label"] for r in labelled.orderBy("id").collect()]
    assert len({tuple(labels[k : k + 20]) for k in (0, 20, 40)}) == 3 and all(len(set(labels[k : k + 20])) == 1 for k in (0, 20, 40))
    assert compactness < 3


def test_empty_tables(spark):
    none = matrix(spark, [[1.0]]).limit(0)
    assert elementwise.add(none, none).count() == 0
    assert neighbourhood.blur(none, Shape(1, 1), (3, 3)).count() == 0
    assert reduce.mean(none).count() == 0 and histogram.equalize_hist(none).count() == 0


def test_structure(spark):
    m = np.arange(12.0).reshape(3, 4)
    px = matrix(spark, m)
    assert np.array_equal(array(structural.rotate(px, Shape(3, 4), 0), (4, 3)), np.rot90(m, -1))
    assert np.array_equal(array(structural.reshape(px, Shape(3, 4), 0, 2), (2, 6)), m.reshape(2, 6))
    with pytest.raises(MatrixError):
        structural.reshape(px, Shape(3, 4), 0, 5)
    dense = pixels.to_dense(px, Shape(3, 4))
    assert dense.first()["data"] == m.ravel().tolist() and np.array_equal(array(pixels.to_pixels(dense), (3, 4)), m)


LARGE = {
    "gaussian": lambda p, s: neighbourhood.gaussian_blur(p, s, (5, 3), 1.1),
    "laplacian": lambda p, s: neighbourhood.laplacian(p, s, 1, border=Border.CONSTANT),
    "laplacian_3": lambda p, s: neighbourhood.laplacian(p, s, 3),
    "median": lambda p, s: neighbourhood.median_blur(p, s, 3),
    "erode": lambda p, s: neighbourhood.erode(p, s, T.structuring_element("ellipse", 5, 3)),
    "dilate": lambda p, s: neighbourhood.dilate(p, s, T.structuring_element("rect", 3, 3), 2, Border.REFLECT),
    "bilateral": lambda p, s: neighbourhood.bilateral_filter(p, s, 3, 20.0, 1.5),
    "bilateral_constant": lambda p, s: neighbourhood.bilateral_filter(p, s, 3, 20.0, 1.5, Border.CONSTANT),
    "resize": lambda p, s: neighbourhood.resize(p, s, 7, 13),
    "dft": lambda p, s: neighbourhood.dft(p, s),
    "idft": lambda p, s: neighbourhood.idft(neighbourhood.dft(p, s), Shape(s.rows, s.cols, 2)),
    "harris": lambda p, s: features.corner_harris(p, s, 3),
    "eigen": lambda p, s: features.corner_min_eigen_val(p, s, 3),
    "pre_corner": lambda p, s: features.pre_corner_detect(p, s),
    "canny": lambda p, s: features.canny(p, s, 60, 200),
    "fast": lambda p, s: features.fast(p, s, 15, kind="5_8").withColumnRenamed("response", "v").withColumn("c", F.lit(0)),
    "fast_scores": lambda p, s: features.fast_scores(p, s, 1, "5_8"),
    "canny_low": lambda p, s: features.canny_candidates(p, s, 0, 200).selectExpr("img", "y", "x", "0 as c", "cast(strong as double) as v"),
    "sobel_wrap": lambda p, s: neighbourhood.sobel(p, s, 1, 1, 5, border=Border.WRAP),
    "harris_wrap": lambda p, s: features.corner_harris(p, s, 2, border=Border.WRAP),
    "eigen_constant": lambda p, s: features.corner_min_eigen_val(p, s, 4, 5, border=Border.CONSTANT),
    "peaks": lambda p, s: features.local_maxima(p, s, False, 2),
    "pyr_up": lambda p, s: neighbourhood.pyr_up(p, s)[0],
    "pyr_down": lambda p, s: neighbourhood.pyr_down(p, s, Border.REPLICATE)[0],
    "dct": lambda p, s: neighbourhood.dct(p, s),
    "open": lambda p, s: neighbourhood.morphology_ex(p, s, "open", T.structuring_element("cross", 3, 5)),
    "dft_rows": lambda p, s: neighbourhood.dft(p, s, rows_only=True),
}


@pytest.mark.parametrize("sparse", [False, True])
@pytest.mark.parametrize("name", sorted(LARGE))
def test_tiles_give_the_same(spark, monkeypatch, name, sparse):
    from rasterloom.operators import dense

    shape = Shape(9, 11)
    images = [np.random.default_rng(k).integers(0, 256, (9, 11)) for k in (1, 2)]
    px = matrix(spark, images[0]).unionByName(matrix(spark, images[1], 5))
    if sparse:  # a corner, a stretch over a tile's edge, single places
        px = px.where("not (y < 3 and x < 4) and not (y between 4 and 6 and x between 4 and 7) and not (y = 8 and x = 8)")
    px = px.unionByName(spark.createDataFrame([(0, -1, 2, 0, 9.0), (0, 3, 11, 0, 9.0), (0, 9, -5, 0, 9.0)], px.schema))  # beyond the shape
    rows = lambda: {(r["img"], r["y"], r["x"], r["c"]): r["v"] for r in LARGE[name](px, shape).collect()}
    small = rows()
    for tile in (6, 4):
        monkeypatch.setattr(dense, "TILE", tile)
        large = rows()
        assert small and small.keys() == large.keys() and np.allclose([small[k] for k in small], [large[k] for k in small])


def test_missing_pixels_are_left_out(spark):
    m = np.random.default_rng(4).integers(0, 256, (6, 7)).astype(float)
    gone = [(0, 0), (2, 3), (2, 4), (5, 6)]
    px, shape = matrix(spark, m).where(" and ".join(f"not (y = {y} and x = {x})" for y, x in gone)), Shape(6, 7)
    there = {(y, x): m[y, x] for y in range(6) for x in range(7) if (y, x) not in gone}
    near = lambda y, x: [there[p] for p in ((y + j, x + i) for j in (-1, 0, 1) for i in (-1, 0, 1)) if p in there]
    got = {(r["y"], r["x"]): r["v"] for r in neighbourhood.erode(px, shape, T.structuring_element("rect", 3, 3)).collect()}
    assert got == {(y, x): min(near(y, x)) for y in range(6) for x in range(7)}
    got = {(r["y"], r["x"]): r["v"] for r in neighbourhood.median_blur(px, shape, 3).collect()}
    assert all(np.isclose(got[y, x], np.median(near(y, x))) for y in range(1, 5) for x in range(1, 6))
    got = {(r["y"], r["x"]): r["v"] for r in neighbourhood.filter_2d(px, shape, [[1.0] * 3] * 3, Border.CONSTANT).collect()}
    assert all(np.isclose(got[y, x], sum(near(y, x))) for y in range(6) for x in range(7))
    lone = spark.createDataFrame([(0, 0, 0, 0, 5.0), (0, 0, 0, 10**6, 7.0)], px.schema)  # a stray channel number is one plane more
    got = {(r["y"], r["x"], r["c"]): r["v"] for r in neighbourhood.dilate(lone, Shape(4, 4), T.structuring_element("rect", 3, 3)).collect()}
    assert got == {(y, x, c): v for y in (0, 1) for x in (0, 1) for c, v in ((0, 5.0), (10**6, 7.0))}


def test_large_transform(spark):
    rng = np.random.default_rng(11)
    m = rng.random((700, 530))
    px = spark.range(700 * 530).selectExpr("0L as img", "cast(id div 530 as int) y", "cast(id % 530 as int) x", "0 as c", "cast(sin(id * id % 1009) as double) v")
    m = np.sin(np.arange(700 * 530, dtype=np.int64) ** 2 % 1009).reshape(700, 530)
    out = neighbourhood.dft(px, Shape(700, 530)).toPandas()
    got = np.zeros((700, 530, 2))
    got[out["y"], out["x"], out["c"]] = out["v"]
    assert np.allclose(got[..., 0] + 1j * got[..., 1], np.fft.fft2(m))
    blurred = neighbourhood.gaussian_blur(px, Shape(700, 530), (5, 5), 1.0).toPandas()
    one = np.zeros((700, 530))
    one[blurred["y"], blurred["x"]] = blurred["v"]
    k = np.array(T.gaussian_kernel(5, 1.0))
    pad = np.pad(m, 2, mode="reflect")
    want = sum(k[j] * k[i] * pad[j : j + 700, i : i + 530] for j in range(5) for i in range(5))
    assert np.allclose(one, want)


def test_tracking_large_frames_gives_the_same(spark, monkeypatch):
    from rasterloom.operators import dense, flow

    m = np.random.default_rng(5).random((24, 24)) * 200
    shape, points = Shape(24, 24), spark.createDataFrame([(0, k, float(x), float(y)) for k, (x, y) in enumerate(((9, 9), (14, 10), (2, 21)))], "img long, id long, x double, y double")
    a = neighbourhood.gaussian_blur(matrix(spark, m), shape, (7, 7), 2.0)
    b = neighbourhood.gaussian_blur(matrix(spark, np.roll(m, 1, 1)), shape, (7, 7), 2.0)
    rows = lambda: {r["id"]: (r["x"], r["y"], r["status"], r["error"]) for r in flow.calc_optical_flow_pyramid_lk(a, b, shape, points, (7, 7), 0, Criteria(4, 0.05)).collect()}
    small = rows()
    monkeypatch.setattr(dense, "TILE", 8)
    large = rows()
    assert all(s[2] == large[k][2] and np.allclose(s[:2], large[k][:2]) and (s[2] == 0 or np.isclose(s[3], large[k][3])) for k, s in small.items())


def test_descriptors_of_both_ways(spark, monkeypatch):
    m = np.random.default_rng(6).integers(0, 256, (60, 60))
    px, shape = matrix(spark, m), Shape(60, 60)
    found = {r["id"]: r for r in features.orb(px, shape, features=8, levels=1, edge=20).collect()}
    keys = spark.createDataFrame([(0, i, int(r["y"]), int(r["x"])) for i, r in found.items()], "img long, id int, y int, x int")
    joined = {r["id"]: r for r in features.describe(px, shape, features.orientation(px, keys)).collect()}
    assert len(found) == 8 and found.keys() == joined.keys()
    assert all(np.isclose(found[i]["angle"], r["angle"]) and list(found[i]["descriptor"]) == list(r["descriptor"]) for i, r in joined.items())
    from rasterloom.operators import dense

    monkeypatch.setattr(dense, "TILE", 16)
    again = {r["id"]: r for r in features.orb(px, shape, features=8, levels=1, edge=20).collect()}
    assert {i: (r["x"], r["y"], round(r["angle"], 6), r["descriptor"]) for i, r in found.items()} == {i: (r["x"], r["y"], round(r["angle"], 6), r["descriptor"]) for i, r in again.items()}


def test_stacks_are_cut_between_images(spark, monkeypatch):
    from rasterloom.operators import dense

    px = spark.range(40).selectExpr("id as img", "explode(sequence(0, 24)) as p").selectExpr("img", "cast(p / 5 as int) y", "cast(p % 5 as int) x", "0 as c", "cast(img * 25 + p as double) v")
    monkeypatch.setattr(dense, "STACK", 30)
    axis = dense.reaching(5, 0, Border.CONSTANT)
    out = dense.by_tile(px, axis, axis, lambda a, *_: {"v": a + 1})
    assert sorted((r["img"], r["y"], r["x"], r["v"]) for r in out.collect()) == [(i, p // 5, p % 5, i * 25 + p + 1) for i in range(40) for p in range(25)]



def test_stacks_of_sparse_images_are_bounded_by_places(spark, monkeypatch):
    from rasterloom.operators import dense

    monkeypatch.setattr(dense, "STACK", 60)
    axis = dense.reaching(5, 0, Border.CONSTANT)
    px = spark.range(50).selectExpr("id as img", "cast(id % 5 as int) y", "2 as x", "0 as c", "1.0D as v")
    out = dense.by_tile(px, axis, axis, lambda a, there, *_: {"v": a + len(a), "_keep": there})
    assert sorted((r["img"], r["y"]) for r in out.collect()) == [(i, i % 5) for i in range(50)]
    assert {r["v"] for r in out.collect()} <= {2.0, 3.0}  # one or two images of 25 places


def test_warp_by_identity(spark):
    m = np.random.default_rng(7).random((5, 5))
    out = geometry.warp_perspective(matrix(spark, m), Shape(5, 5), [[1.0, 0, 0], [0, 1.0, 0], [0, 0, 1.0]], 5, 5)
    assert np.allclose(array(out, (5, 5)), m)


# Published streams of the generator for seeds (fixed values).
STREAMS = {
    42: ([164, 63, 102, 186, 144, 232, 246, 91], [0, 8, 9, 1, 4, 0, 3, 2], [5, 3, 7, 1, 4, 2, 8, 9, 6, 0], [2.4166553e-08, -0.6258468, 0.58832407, -0.7319965, -0.19489458, -1.2311678, 0.10487158, 0.1139631]),
    12345: ([58, 237, 174, 40, 7, 225, 216, 205], [4, 3, 3, 1, 9, 4, 2, 5], [4, 2, 8, 3, 5, 7, 1, 9, 6, 0], [8.2702945e-06, 0.46152943, -0.23233406, 0.9038273, 0.39947677, 0.59975564, 1.2827576, -0.19060737]),
}


@pytest.mark.parametrize("seed", sorted(STREAMS))
def test_random_streams(spark, seed):
    bytes_, digits, order, normal = STREAMS[seed]
    one, row = spark.range(1).withColumnRenamed("id", "img"), lambda df: [r["v"] for r in df.orderBy("x").collect()]
    assert row(random.randu(one, Shape(1, 8), [0], [256], seed, "u8")) == bytes_
    assert row(random.randu(one, Shape(1, 8), [0], [10], seed, "u8")) == digits
    assert np.allclose(row(random.randn(one, Shape(1, 8), [0.0], [1.0], seed, "f32")), normal, rtol=1e-6, atol=1e-14)
    assert row(random.rand_shuffle(matrix(spark, [list(range(10))]), seed)) == order


def test_streams_can_be_entered_anywhere(monkeypatch, spark):
    for depth, low, high in (("u8", [0, 0, 0], [256, 16, 2]), ("i32", [0, -7, 5], [10, 7, 2000]), ("f64", [0.0, 1.0, -1.0], [1.0, 3.0, 1.0])):
        whole = random._uniform(random.Rng(9), 0, 4001, low, high, depth, 3, 4001)
        parts = [random._uniform(random.Rng(9), k, min(600, 4001 - k), low, high, depth, 3, 4001) for k in range(0, 4001, 600)]
        assert np.array_equal(whole, np.concatenate(parts))
    a, b = random.Rng(5).jump(1000), random.Rng(5)
    for _ in range(1000):
        b.step()
    assert a.state == b.state
    z = random.normals(random.Rng(3), 20000)
    assert abs(z.mean()) < 0.03 and abs(z.std() - 1) < 0.03


def test_normals_in_slices_equal_the_stream(spark, monkeypatch):
    images = spark.range(3).withColumnRenamed("id", "img")
    order = lambda df: [tuple(r) for r in df.orderBy("img", "y", "x", "c").collect()]
    whole = order(random.randn(images, Shape(30, 40, 2), [0.0, 1.0], [1.0, 3.0], 11, "f32"))
    serial, one = random.Rng(11), []
    for n in (1, 7, 2000, 392):  # in parts of any size
        one.append(random.normals(serial, n))
    assert np.array_equal(np.concatenate(one)[::2].astype(float), [r[4] for r in whole if r[0] == 0 and r[3] == 0])
    for size in (64, 97, 1000):
        monkeypatch.setattr(random, "SLICE", size)
        assert order(random.randn(images, Shape(30, 40, 2), [0.0, 1.0], [1.0, 3.0], 11, "f32")) == whole
    monkeypatch.setattr(random, "ENTRIES", 1)  # every slice is looked at again
    assert order(random.randn(images, Shape(30, 40, 2), [0.0, 1.0], [1.0, 3.0], 11, "f32")) == whole


def test_passages_are_paths():
    for seed in range(5):
        part = random.Slice(random.Rng(seed + 1).state, 3000)
        for entry, (beyond, count) in zip(range(64), part.passage(range(64))):
            begins, out = part.path(entry)
            assert (out, int((begins & part.hit).sum())) == (beyond, count)


@pytest.mark.parametrize("generator", ["mwc", "xoshiro"])
def test_shuffles_by_pointers(spark, monkeypatch, generator):
    m = np.arange(23 * 31.0).reshape(23, 31)
    px = matrix(spark, m).unionByName(matrix(spark, m + 1000, 4)).where("not (y = 3 and x > 20)")
    order = lambda: [tuple(r) for r in random.rand_shuffle(px, 5, generator).orderBy("img", "y", "x", "c").collect()]
    whole = order()
    assert sorted(r[4] for r in whole) == sorted(r["v"] for r in px.collect()) and len({r[:4] for r in whole}) == len(whole)
    monkeypatch.setattr(random, "SLICE", 100)
    assert order() == whole


def test_xoshiro(spark):
    g = random.Xoshiro()
    g.words = (1, 2, 3, 4)  # published draws of this state (fixed values)
    assert [g.next_u64() for _ in range(6)] == [11520, 0, 1509978240, 1215971899390074240, 1216172134540287360, 607988272756665600]
    assert random.Xoshiro(1234567).words[:2] == (6457827717110365317, 3203168211198807973)  # published draws of SplitMix64
    for n in (1, 2, 1000):
        a, b = random.Xoshiro(7).jump(n), random.Xoshiro(7)
        for _ in range(n):
            b.next_u64()
        assert a.words == b.words
    images = spark.range(2).withColumnRenamed("id", "img")
    for f in (random.randu, random.randn):
        rows = [r["v"] for r in f(images, Shape(20, 30), [2.0], [9.0], 3, generator="xoshiro").where("img = 0").orderBy("y", "x").collect()]
        stream = random.Xoshiro(3)
        want = stream.floats(600) * 7 + 2 if f is random.randu else random.Xoshiro(3).normals(0, 600) * 9 + 2
        assert np.allclose(rows, want)
    assert np.array_equal(random.Xoshiro(3).normals(0, 50)[13:40], random.Xoshiro(3).normals(13, 27))
    values = list(range(10))
    random.Xoshiro(42).shuffle(values)
    assert sorted(values) == list(range(10)) != values


def test_other_generator(spark):
    images = spark.range(2).withColumnRenamed("id", "img")
    a = random.randu(images, Shape(2, 3), [1.0], [2.0], 9, generator="pcg").orderBy("img", "y", "x").collect()
    assert a == random.randu(images, Shape(2, 3), [1.0], [2.0], 9, generator="pcg").orderBy("img", "y", "x").collect() and all(1 <= r["v"] < 2 for r in a)
    with pytest.raises(MatrixError):
        random.randn(images, Shape(2, 3), [0.0], [1.0], generator="none")


def test_round_patch_is_mirrored_by_its_diagonal():
    for half in (3, 7, 15, 31):
        reach = features.umax(half)
        disc = {(y, x) for y, w in enumerate(reach) for x in range(w + 1)}
        assert disc == {(x, y) for y, x in disc} and reach[0] == half
    assert features.umax(15) == [15, 15, 15, 15, 14, 14, 14, 13, 13, 12, 11, 10, 9, 8, 6, 3]


def test_circle_is_found(spark):
    yy, xx = np.mgrid[0:40, 0:40]
    m = np.where(np.hypot(yy - 18, xx - 21) <= 9, 200.0, 0.0)
    best = features.hough_circles(matrix(spark, m), Shape(40, 40), 1.0, 10.0, 100.0, 20.0, 5, 13).orderBy(F.desc("votes")).first()
    assert abs(best["x"] - 21) <= 1 and abs(best["y"] - 18) <= 1 and abs(best["radius"] - 9) <= 1


def test_segment_is_found(spark):
    m = np.zeros((30, 30))
    m[5, 4:25] = 255
    found = features.hough_lines_p(matrix(spark, m), Shape(30, 30), 1.0, math.pi / 180, 10, 10, 2).collect()
    assert [sorted([(r["x1"], r["y1"]), (r["x2"], r["y2"])]) for r in found] == [[(4, 5), (24, 5)]]


def test_nearest_rows_with_ties_and_copies(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(0, 3, 4)]) for i in range(300)]
    df = spark.createDataFrame(rows, "idx long, descriptor array<double>")
    queries = df.where("idx % 20 = 0")
    for norm in ("l2", "hamming"):
        for apart in (False, True):
            got = {(r["query_idx"], r["rank"]): (r["train_idx"], round(r["distance"], 9)) for r in matching.knn_match(queries, df.repartition(5), 3, norm, apart=apart).collect()}
            for i, q in rows[::20]:
                dist = (lambda t: math.dist(q, t)) if norm == "l2" else (lambda t: sum((int(a) ^ int(b)).bit_count() for a, b in zip(q, t)))  # noqa: B023
                want = sorted((round(float(dist(t)), 9), j) for j, t in rows if not (apart and i == j))[:3]
                assert [got[i, k + 1] for k in range(3)] == [(j, d) for d, j in want]


@pytest.mark.parametrize("reach", [0.0, 1.0, 4.5, 11.0])
def test_spacing_by_tiles_is_the_serial_order(spark, monkeypatch, reach):
    monkeypatch.setattr(features, "SPACED_TILE", 24)
    rng = np.random.default_rng(9)
    rows = [(img, float(x), float(y), float(v)) for img in (1, 2) for x, y, v in zip(rng.integers(0, 120, 700), rng.integers(0, 90, 700), rng.integers(0, 40, 700))]
    # A ridge whose merit falls along it: one chain of decisions over all tiles.
    rows += [(3, float(x), 7.0, 200.0 - x) for x in range(120)] + [(4, 5.0, 5.0, 1.0)] * 3
    df = spark.createDataFrame(rows, "img long, x double, y double, v double").repartition(5)
    want = []
    for img in (1, 2, 3, 4):
        taken = []
        for _, x, y, v in sorted((r for r in rows if r[0] == img), key=lambda r: (-r[3], r[2], r[1])):
            if reach <= 0 or all((x - a) ** 2 + (y - b) ** 2 >= reach**2 for a, b, _ in taken):
                taken.append((x, y, v))
        want += [(img, *t, n) for n, t in enumerate(taken)]
    assert sorted(tuple(r) for r in features.spaced(df, reach).collect()) == sorted(want)
    assert sorted(tuple(r) for r in features.spaced(df, reach, 6).collect()) == sorted(w for w in want if w[4] < 6)
    assert sorted(tuple(r) for r in features.spaced(df, reach, extent=Shape(24, 24)).collect()) == sorted(want)
    assert features.spaced(df.where("false"), reach).collect() == []


def test_seeding_passes_do_not_grow_with_k(spark, monkeypatch):
    rng = np.random.default_rng(10)
    centres = rng.normal(size=(30, 5)) * 50
    rows = [(i, [float(v) for v in centres[i % 30] + rng.normal(size=5)]) for i in range(1500)]
    points = spark.createDataFrame(rows, "id long, p array<double>")
    passes = []
    whole = cluster.nearest
    monkeypatch.setattr(cluster, "nearest", lambda p, c: passes.append(len(c)) or whole(p, c))
    for k in (3, 30):
        passes.clear()
        chosen = np.array(cluster.start_centres(points, k, 1))
        assert chosen.shape == (k, 5) and len(passes) <= cluster.ROUNDS + 1
    # One centre in (nearly) every one of the groups far from one another.
    assert len({int(((centres - c) ** 2).sum(1).argmin()) for c in chosen}) >= 28
    same = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(50)], "id long, p array<double>")
    assert sorted(cluster.start_centres(same, 5, 0)) == [[1.0, 0.0], [1.0, 1.0]]
    assert cluster.start_centres(same.where("false"), 5, 0) == []
    assert len(cluster.start_centres(same, 5, 0, spread=False)) == 5


def test_outliers_of_every_model(spark):
    rng = np.random.default_rng(8)
    x = rng.random((80, 3)) * 2 - 1
    k, p = np.array([[800.0, 0, 320], [0, 800.0, 240], [0, 0, 1]]), np.array([0.1, -0.2, 0.3, 0.1, -0.1, 6.0])
    uv, front = estimation.project(x, p, k), estimation.project(x, np.array([0, 0, 0, 0, 0, 6.0]), k)
    uv[:20] += 90 + rng.random((20, 2)) * 50
    scene = spark.createDataFrame([(1, n, *map(float, (*a, *b))) for n, (a, b) in enumerate(zip(x, uv))], "group long, point int, x double, y double, z double, u double, v double")
    pose = estimation.solve_pnp(scene, k.tolist(), "ransac", 300)
    assert np.allclose(pose.first()["model"], p, atol=1e-6) and pose.first()["n_inliers"] == 60
    assert {r["point"] for r in estimation.inlier_mask(scene, pose, "pose", 8.0, k.tolist()).where("not inlier").collect()} == set(range(20))
    views = spark.createDataFrame([(1, n, *map(float, (*a, *b))) for n, (a, b) in enumerate(zip(front, uv))], "group long, point int, ax double, ay double, bx double, by double")
    f = estimation.find_fundamental_mat(views, "ransac", 0.5, 0.9999, 2000)
    kept = {r["point"] for r in estimation.inlier_mask(views, f, "fundamental", 0.5).where("inlier").collect()}
    assert set(range(20, 80)) <= kept and len(kept) < 64


LENS5 = (-0.28, 0.07, 0.001, -0.0015, 0.02)


def seen(rng, groups, camera):
    rows = []
    for g, (x, pose, noise) in enumerate(groups):
        uv = estimation.project(x, np.array(pose), camera) + rng.normal(0, 1, (len(x), 2)) * noise
        rows += [(g, *map(float, (*a, *b))) for a, b in zip(x, uv)]
    return rows


@pytest.mark.parametrize("lens", [(), LENS5[:4], LENS5, (*LENS5, 0.01, -0.002, 0.001)])
def test_poses_of_planes_and_lenses(spark, lens):
    rng = np.random.default_rng(3)
    camera = estimation.Camera(np.array([[800.0, 0, 320], [0, 780.0, 240], [0, 0, 1]]), lens)
    flat = lambda n: np.column_stack([rng.random((n, 2)) * 2 - 1, np.zeros(n)])
    tilted = flat(16) @ estimation.rotation(np.array([0.4, -0.7, 0.2])).T + [0.3, 0.1, -0.4]
    square = np.array([[-1.0, -1, 0], [1, -1, 0], [1, 1, 0], [-1, 1, 0]])
    poses = [[0.1, -0.2, 0.3, 0.1, -0.1, 6.0], [0.5, 0.3, -0.4, 0.2, 0.1, 7.0], [-0.6, 0.5, 0.2, -0.3, 0.2, 5.0], [0.9, -0.4, 0.1, 0.1, 0.1, 6.0]]
    groups = [(rng.random((24, 3)) * 2 - 1, poses[0], 0), (flat(16), poses[1], 0), (tilted, poses[2], 0), (square, poses[3], 0)]
    groups += [(square[:3], poses[0], 0), (np.outer(np.arange(8.0), [0.1, 0.2, 0.05]), poses[0], 0), (rng.random((5, 3)), poses[0], 0)]
    points = spark.createDataFrame(seen(rng, groups, camera), "group long, x double, y double, z double, u double, v double")
    got = {r["group"]: r for r in estimation.solve_pnp(points, camera.k.tolist(), lens=lens).collect()}
    for g, pose in enumerate(poses):
        assert np.allclose(got[g]["model"], pose, atol=1e-5), (g, got[g])
    assert all(got[g]["model"] is None and got[g]["n_inliers"] == 0 for g in (4, 5, 6))


def test_planes_with_noise_and_outliers(spark):
    rng = np.random.default_rng(4)
    camera = estimation.Camera(np.array([[800.0, 0, 320], [0, 800.0, 240], [0, 0, 1]]), LENS5)
    pose = [0.5, 0.4, -0.2, 0.1, 0.1, 6.0]
    x = np.column_stack([rng.random((60, 2)) * 2 - 1, np.full(60, 0.5)])
    rows = seen(rng, [(x, pose, 0.3), (x, [-0.4, 0.3, 0.1, 0.0, 0.2, 5.0], 0.0)], camera)
    rows = [(*r[:4], r[4] + 70, r[5] - 50) if k % 5 == 0 else r for k, r in enumerate(rows)]
    points = spark.createDataFrame(rows, "group long, x double, y double, z double, u double, v double")
    got = {r["group"]: r for r in estimation.solve_pnp(points, camera.k.tolist(), "ransac", 200, lens=LENS5).collect()}
    assert np.allclose(got[0]["model"], pose, atol=0.02) and got[0]["n_inliers"] == 48
    assert np.allclose(got[1]["model"], [-0.4, 0.3, 0.1, 0.0, 0.2, 5.0], atol=1e-5) and got[1]["n_inliers"] == 48


def test_rays_take_the_lens_off(spark):
    rng = np.random.default_rng(5)
    camera = estimation.Camera(np.array([[800.0, 0, 320], [0, 780.0, 240], [0, 0, 1]]), LENS5)
    x, y = rng.random((2, 50)) - 0.5
    u, v = camera.pixels(x, y)
    assert np.allclose(camera.rays(u, v), (x, y), atol=1e-9)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(u, v)], "u double, v double")
    a, b = camera.ray_columns(F.col("u"), F.col("v"))
    assert np.allclose(df.select(a.alias("a"), b.alias("b")).toPandas().to_numpy(), np.column_stack([x, y]), atol=1e-9)
    with pytest.raises(MatrixError):
        estimation.Camera(camera.k, (0.1, 0.2, 0.3))


def test_least_squares_of_a_curve(spark):
    t = np.linspace(0, 4, 60)
    rows = [(g, float(x), float(a * np.exp(-b * x))) for g, (a, b) in enumerate(((2.0, 0.7), (5.0, 1.3))) for x in t]
    off = lambda p, df: p[0] * np.exp(-p[1] * df["x"].to_numpy()) - df["y"].to_numpy()
    got = {r["group"]: r["model"] for r in estimation.lm_fit(spark.createDataFrame(rows, "group long, x double, y double"), [1.0, 1.0], off).collect()}
    assert np.allclose(got[0], [2.0, 0.7]) and np.allclose(got[1], [5.0, 1.3])


def test_tracking_finds_the_shift(spark):
    from rasterloom.plans import queries

    spots = [(x, y) for x in (20.0, 40.0, 60.0) for y in (20.0, 40.0, 60.0)]
    got = queries.tracked(spark, "/root/testdata/sf0.001").where("img = 0 and status = 1").collect()
    assert len(got) >= 6 and all(abs(r["x"] - spots[r["id"]][0] + 1) < 0.1 and abs(r["y"] - spots[r["id"]][1]) < 0.1 for r in got)


def test_equal_products_are_a_tie(spark):
    m = [[140, 181, 139, 131, 135, 98, 115, 134], [115, 124, 166, 131, 185, 182, 93, 111], [158, 177, 119, 89, 78, 120, 93, 133], [149, 160, 116, 135, 104, 99, 123, 177]]
    m += [[84, 104, 177, 148, 167, 178, 191, 129], [153, 115, 98, 91, 124, 109, 94, 148], [118, 103, 108, 173, 169, 155, 130, 71], [101, 128, 124, 97, 100, 122, 131, 123]]
    r = features.corner_eigen_vals_and_vecs(matrix(spark, m), Shape(8, 8), 3).where("y = 7 and x = 0").first()  # ixx = iyy = 1352, ixy = 0
    assert [r[n] for n in ("l1", "l2", "x1", "y1", "x2", "y2")] == [1352.0, 1352.0, 1.0, 0.0, 0.0, 1.0]


@pytest.mark.parametrize(("clip", "bits", "shift"), [(3.0, 16, 0), (0.0, 12, 2), (40.0, 8, 0)])
def test_clahe_in_tasks_and_spread(spark, monkeypatch, clip, bits, shift):
    rng, shape = np.random.default_rng(8), Shape(9, 14, 2)
    m = rng.integers(0, 1 << bits, (9, 14, 2)).astype(float)
    m[2:5, 3:9] = m[0, 0]  # bins to be cut
    m[8, 13, 0] = -1.0  # counts nowhere, and has no result
    px = matrix(spark, m).where("not (y = 1 and x in (2, 3))").cache()
    run = lambda p: {(r["y"], r["x"], r["c"]): r["v"] for r in histogram.clahe(p, shape, clip, (3, 2), bits, shift).collect()}
    whole = run(px)
    one = {(y, x, 1): v for (y, x, _), v in run(px.where("c = 1").withColumn("c", F.lit(0))).items()}
    assert len(whole) == 9 * 14 * 2 - 5 and {k: v for k, v in whole.items() if k[2] == 1} == one  # a channel is an image of its own
    plan = histogram.clahe(px, shape, clip, (3, 2), bits, shift)._jdf.queryExecution().toString()
    assert "explode" not in plan.lower() and "Window" not in plan  # no table of all bins
    monkeypatch.setattr("rasterloom.operators.dense.TILE", 8)
    assert run(px) == whole


def test_tracking_with_kept_pyramids_in_tasks(spark, monkeypatch):
    from rasterloom.operators import dense, flow

    m = np.random.default_rng(9).random((40, 44)) * 200
    shape, points = Shape(40, 44), spark.createDataFrame([(g, k, float(x), float(y)) for g in (0, 7) for k, (x, y) in enumerate(((15, 15), (24, 20), (2, 37)))], "img long, id long, x double, y double")
    a = neighbourhood.gaussian_blur(matrix(spark, m), shape, (7, 7), 2.0).where("not (y = 30 and x < 9)")
    b = neighbourhood.gaussian_blur(matrix(spark, np.roll(m, 1, 1)), shape, (7, 7), 2.0)

    def rows():
        before, after = (flow.build_optical_flow_pyramid(p, shape, (9, 9), 1) for p in (a, b))
        df = flow.track_with_pyramids(before, after, points, (9, 9), Criteria(4, 0.05))
        return {(r["img"], r["id"]): (r["x"], r["y"], r["status"], r["error"]) for r in df.collect()}

    monkeypatch.setattr(flow, "durable", lambda df: 1 / 0)  # no rounds of jobs
    small = rows()
    monkeypatch.undo()
    monkeypatch.setattr(dense, "TILE", 32)
    large = rows()
    assert len(small) == 6 and {s[2] for s in small.values()} == {0, 1} and small.keys() == large.keys()
    assert all(s[2] == large[k][2] and np.allclose(s[:2], large[k][:2]) and (s[2] == 0 or np.isclose(s[3], large[k][3])) for k, s in small.items())
