"""Kernels that SQL cannot state, against exhaustive versions on small inputs."""

import itertools

import numpy as np
import pytest

from tessera.operators import dense as D
from tessera.operators import geometry as G
from tessera.operators import palette as P
from tessera.operators import regions as R
from tessera.operators import statistics as S
from tessera.plans import raster
from tessera.sources.derived import polylines

SF = "/root/testdata/sf0.001"


def flood(grid):
    """Components by flooding, in raster order of first pixels."""
    out = np.full(grid.shape, -1)
    n = 0
    for y, x in np.ndindex(grid.shape):
        if out[y, x] < 0:
            todo = [(y, x)]
            out[y, x] = n
            while todo:
                a, b = todo.pop()
                for c, d in ((a - 1, b), (a + 1, b), (a, b - 1), (a, b + 1)):
                    if 0 <= c < grid.shape[0] and 0 <= d < grid.shape[1] and out[c, d] < 0 and grid[c, d] == grid[a, b]:
                        out[c, d] = n
                        todo.append((c, d))
            n += 1
    return out


@pytest.mark.parametrize("seed", range(12))
def test_components(seed):
    rng = np.random.default_rng(seed)
    grid = rng.integers(0, 2 + seed % 3, (rng.integers(1, 9), rng.integers(1, 9)))
    assert (R.label_components(grid) == flood(grid)).all()


def test_small_maps():
    board = np.indices((4, 4)).sum(axis=0) % 2
    assert R.label_components(board).max() == 15
    ring = np.array([[1, 1, 1], [1, 0, 1], [1, 1, 1]])
    assert R.label_components(ring).max() == 1
    assert (R.despeckle(ring, 2) == 1).all() and (R.despeckle(ring, 1) == ring).all()
    assert (R.despeckle(np.zeros((1, 1), int), 5) == 0).all()
    # The first speck takes the lower of equally common labels, and the second sees that edit.
    assert R.despeckle(np.array([[0, 1, 2, 2, 2]]), 2).tolist() == [[1, 1, 2, 2, 2]]


def test_components_by_rounds_agree(spark):
    labels = raster._components(spark, SF)
    want = {(r["image_id"], r["x"], r["y"]): r["component"] for r in labels.collect()}
    got = {(r["image_id"], r["x"], r["y"]): r["component"] for r in R.components_by_rounds(labels.select("image_id", "x", "y", "label")).collect()}
    assert got == want


def test_components_by_rounds_of_tall_and_winding_images(spark):
    spiral = np.zeros((15, 15), int)
    y, x, dy, dx = 0, 0, 0, 1
    spiral[0, 0] = 1
    while True:
        for _ in range(2):
            ahead, beyond = (y + dy, x + dx), (y + 2 * dy, x + 2 * dx)
            if 0 <= ahead[0] < 15 and 0 <= ahead[1] < 15 and not (0 <= beyond[0] < 15 and 0 <= beyond[1] < 15 and spiral[beyond]):
                break
            dy, dx = dx, -dy
        else:
            break
        if spiral[ahead]:
            break
        y, x = ahead
        spiral[y, x] = 1
    grids = {1: np.ones((100, 2), int), 2: spiral}
    rows = [(k, x, y, int(v)) for k, g in grids.items() for (y, x), v in np.ndenumerate(g)]
    df = spark.createDataFrame(rows, "image_id long, x int, y int, label int")
    got = {(r["image_id"], r["x"], r["y"]): r["component"] for r in R.components_by_rounds(df).collect()}
    want = {(k, x, y): int(c) for k, g in grids.items() for (y, x), c in np.ndenumerate(R.label_components(g))}
    assert got == want and spiral.sum() > 100


def residual(x, y, s):
    w = 1 / s**2
    mx, my = (w * x).sum() / w.sum(), (w * y).sum() / w.sum()
    xx, yy, xy = (w * (x - mx) ** 2).sum(), (w * (y - my) ** 2).sum(), (w * (x - mx) * (y - my)).sum()
    return max(0.5 * (xx + yy - np.sqrt((xx - yy) ** 2 + 4 * xy**2)), 0)


@pytest.mark.parametrize("seed", range(8))
def test_best_polygon(seed):
    rng = np.random.default_rng(seed)
    n, lam = int(rng.integers(2, 10)), float(rng.uniform(0.2, 4))
    x, y, s = np.sort(rng.uniform(0, 10, n)), rng.normal(0, 3, n), rng.uniform(0.3, 2, n)
    best = np.inf
    for k in range(n - 1):
        for inner in itertools.combinations(range(1, n - 1), k):
            chain = [0, *inner, n - 1]
            best = min(best, sum(0.5 * residual(x[a : b + 1], y[a : b + 1], s[a : b + 1]) + 2 * lam for a, b in itertools.pairwise(chain)))
    chain, cost = G.best_polygon(x, y, s, lam)
    assert cost == pytest.approx(best, rel=1e-9) and chain[0] == 0 and chain[-1] == n - 1


def test_polygon_edges():
    one = np.zeros(1)
    assert G.best_polygon(one, one, one + 1, 1.0) == ([0], 0.0)
    line = np.arange(6.0)
    assert G.best_polygon(line, 2 * line, line * 0 + 1, 1.0)[0] == [0, 5]


@pytest.mark.parametrize("seed", range(6))
def test_ties_clusters(seed):
    rng = np.random.default_rng(seed)
    v = np.sort(rng.normal(0, 1, rng.integers(1, 9)))
    penalty = float(rng.uniform(0.05, 1))

    def cost(cuts):
        return sum(((p := v[a:b]) - p.mean()).__pow__(2).sum() + penalty for a, b in zip(cuts, [*cuts[1:], len(v)], strict=True))

    every = [[0, *c] for k in range(len(v)) for c in itertools.combinations(range(1, len(v)), k)]
    assert cost(G.ties_clusters(iter(v), penalty)) == pytest.approx(min(map(cost, every)))


def test_kernels_over_tables(spark):
    lines = G.optimal_polygons(polylines(spark, SF), 3.0)
    assert lines.count() > 0 and lines.filter("n_vertices < 1 OR n_vertices > n_points").count() == 0
    images = raster.label_arrays(spark, SF)
    got = R.despeckled(images, 8, 8, 3).groupBy("image_id").count()
    assert got.count() == images.count() and got.filter("count <> 64").count() == 0


def test_haar_distance():
    """The sums written out, pixel by pixel, on mirrored coordinates."""
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 256, (2, 12, 10)).astype(float)

    def half(y):
        return [[(y[2 * i][2 * j] + y[2 * i][2 * j + 1] + y[2 * i + 1][2 * j] + y[2 * i + 1][2 * j + 1]) / 4 for j in range(5)] for i in range(6)]

    def at(y, i, j):
        h, w = len(y), len(y[0])
        i, j = (i if i >= 0 else -1 - i), (j if j >= 0 else -1 - j)
        return y[i if i < h else 2 * h - 1 - i][j if j < w else 2 * w - 1 - j]

    def response(y, n, i, j, upright):
        total = 0
        for p in range(n):
            for q in range(n):
                step = p if upright else q
                total += at(y, i + p - n // 2, j + q - n // 2) * (2 / n if step < n // 2 else -2 / n) / n
        return abs(total)

    x, y = half(a), half(b)
    top = bottom = 0
    for upright in (False, True):
        for i in range(6):
            for j in range(5):
                pairs = [(response(x, n, i, j, upright), response(y, n, i, j, upright)) for n in (2, 4, 8)]
                alike = sum((2 * p * q + 30) / (p * p + q * q + 30) for p, q in pairs[:2]) / 2
                top += max(pairs[2]) / (1 + np.exp(-4.2 * alike))
                bottom += max(pairs[2])
    mean = top / bottom
    assert D.haar_distance(a, b) == pytest.approx(1 - (np.log(mean / (1 - mean)) / 4.2) ** 2)
    assert D.haar_distance(a, a) < 1e-9


def test_capped_components():
    rng = np.random.default_rng(1)
    for _ in range(8):
        grid = rng.integers(0, 3, (9, 8))
        out = D.capped(grid, 5, R.label_components)
        assert R.label_components(out).max() + 1 <= 5 and (D.capped(out, 5, R.label_components) == out).all()
        large = R.label_components(grid)
        assert (D.capped(grid, large.max() + 1, R.label_components) == grid).all()
    # One speck takes the label that it touches most.
    grid = np.array([[0, 0, 1, 1], [0, 2, 1, 1], [0, 1, 1, 1]])
    assert D.capped(grid, 2, R.label_components)[1, 1] == 0


def test_cover_of_polygons():
    square = np.array([[0.5, 0.25], [2.5, 0.25], [2.5, 1.25], [0.5, 1.25]])
    assert np.allclose(D.clipped_cover(square, 4, 2), [[0.375, 0.75, 0.375, 0], [0.125, 0.25, 0.125, 0]])
    rng = np.random.default_rng(2)
    for _ in range(20):
        triangle = rng.random((3, 2)) * 6
        assert D.clipped_cover(triangle, 6, 6).sum() == pytest.approx(abs(D.ring_area(triangle)))


def test_contours_close_and_hold_what_is_inside():
    rng = np.random.default_rng(5)
    for _ in range(10):
        field = rng.random((7, 6))
        lines = D.contours(field)
        assert all(np.abs(np.diff(np.vstack([x, x[:1]]), axis=0)).max() <= 1 + 1e-9 for x in lines)
    ring = np.zeros((5, 5))
    ring[1:4, 1:4] = 1
    ring[2, 2] = 0
    areas = sorted(D.ring_area(x) for x in D.contours(ring))
    assert len(areas) == 2 and areas[0] < 0 < areas[1]


def test_rings_of_faces():
    grid = np.array([[0, 0, 0, 0], [0, 1, 0, 2], [0, 0, 0, 2]])
    rings = D.face_rings(R.label_components(grid))
    assert sorted((f, D.ring_area(r)) for f, r in rings) == [(0, -1.0), (0, 10.0), (1, 1.0), (2, 2.0)]
    # Parts that meet at a corner only are rings of their own, each corner named once.
    assert all(len(r) == 4 for _, r in D.face_rings(np.array([[0, 1], [2, 3]])))


def test_bootstrap_like_plain_resampling(spark):
    rng = np.random.default_rng(9)
    base = rng.random(900) + 0.5
    current = base * (1 + rng.normal(0, 0.2, 900))
    rows = [(f"f{i % 3}", i, float(base[i]), float(current[i])) for i in range(900)]
    df = spark.createDataFrame(rows, "family string, part long, base double, current double")
    got = np.sort([r["rel"] for r in S.bootstrap(df, "family", "part", 4000, block=64).collect()])
    plain = []
    for _ in range(4000):
        means = [[x[i].mean() for x in (base[k::3], current[k::3])] for k in range(3) for i in [rng.integers(0, 300, 300)]]
        plain.append(np.mean([m[1] for m in means]) / np.mean([m[0] for m in means]) - 1)
    assert len(got) == 4000 and abs(got.std() / np.std(plain) - 1) < 0.08
    assert np.allclose(np.percentile(got, [5, 50, 95]), np.percentile(plain, [5, 50, 95]), atol=0.1 * np.std(plain))
    # One block is drawn from directly, and blocks' draws add up to the family's.
    sizes = np.array([5, 1, 9, 30])
    assert (sum(S.draws_of_block(1, "x", sizes, k, 50) for k in range(4)) == 45).all()
    values = rng.random((7, 2))
    sums = S.drawn_sums(np.random.default_rng(4), values, np.array([3, 0, 2]), most=4)
    picked = np.random.default_rng(4)
    for n, s in zip((3, 0, 2), sums, strict=True):
        assert np.allclose(s, values[picked.integers(0, 7, n)].sum(axis=0))


def test_relative_change_of_nothing(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(0.0, 0.0), (0.0, 2.0), (4.0, 5.0)], "a double, b double")
    assert [r[0] for r in rows.select(S.relative(F.col("a"), F.col("b"))).collect()] == [0.0, float("inf"), 0.25]


def test_palettes(spark):
    from pyspark.sql import functions as F

    from tessera.functions import colour as C

    rng = np.random.default_rng(8)
    rgb = rng.random((40, 3))
    lab = P.cielab(rgb)
    rows = spark.createDataFrame([(i, *map(float, c)) for i, c in enumerate(rgb)], "i int, r double, g double, b double").orderBy("i")
    assert np.allclose([list(r) for r in rows.select(*C.srgb_to_cielab(F.col("r"), F.col("g"), F.col("b"))).collect()], lab)
    pairs = spark.createDataFrame([(i, *map(float, p), *map(float, q)) for i, (p, q) in enumerate(zip(lab, lab[::-1], strict=True))], "i int, l double, a double, b double, m double, c double, d double")
    want = [r[0] for r in pairs.orderBy("i").select(C.ciede2000([F.col(c) for c in "lab"], [F.col(c) for c in "mcd"])).collect()]
    assert np.allclose([P.colour_difference(lab[i], lab[39 - i][None])[0] for i in range(40)], want)
    # Greys and near copies: counted once each.
    colours = np.array([[0, 0, 0], [0.003, 0.003, 0.003], [1, 1, 1], [0.5, 0.2, 0.2], [0.502, 0.2, 0.2], [0.2, 0.5, 0.2]])
    assert P.palette_size(colours, 2.0) == 4 and P.palette_size(colours, 0.0) == 5 and P.palette_size(colours, 2.0, most=3) == 5

    points = np.concatenate([rng.normal(c, 0.004, (50, 3)) for c in ([0.2, 0, 0], [0.24, 0, 0], [0.9, 0, 0])])
    modes = np.array([[0.2, 0, 0], [0.24, 0, 0], [0.9, 0, 0], [0.205, 0, 0]])
    always = lambda claimed: True
    assert P.mdl_walk(points, modes, 0.1, 0.0, 4.0, 0.012, 16, always) == [0, 2]  # no noise, no escape
    assert P.mdl_walk(points, modes, 0.1, 0.01, 4.0, 0.012, 16, always) == [0, 1, 2]
    assert P.mdl_walk(points, modes, 0.1, 0.01, 4.0, 0.012, 16, lambda c: False) == [0, 2]
    assert P.mdl_walk(points, modes, 0.1, 0.01, 4.0, 0.001, 16, always) == [0, 1, 2, 3] or P.mdl_walk(points, modes, 0.1, 0.01, 4.0, 0.001, 2, always) == [0, 1]
    assert P.interior_share(np.ones((3, 3), bool)) == 1 and P.interior_share(np.eye(3, dtype=bool)) == 0 and P.lower_median(np.array([3.0, 1.0, 2.0, 9.0])) == 3.0


def test_simplified_lines():
    def plain(points, tolerance):
        if len(points) < 3:
            return points
        (ax, ay), (bx, by) = points[0], points[-1]

        def far(p):
            length = (bx - ax) ** 2 + (by - ay) ** 2
            t = min(max(((p[0] - ax) * (bx - ax) + (p[1] - ay) * (by - ay)) / length, 0), 1) if length else 0
            return ((p[0] - ax - t * (bx - ax)) ** 2 + (p[1] - ay - t * (by - ay)) ** 2) ** 0.5

        k = max(range(1, len(points) - 1), key=lambda i: far(points[i]))
        if far(points[k]) <= tolerance:
            return [points[0], points[-1]]
        return plain(points[: k + 1], tolerance)[:-1] + plain(points[k:], tolerance)

    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 40):
        x, y = rng.random(n) * 10, rng.random(n) * 10
        for tolerance in (0.0, 1.0, 4.0):
            assert [(x[i], y[i]) for i in G.kept_points(x, y, tolerance)] == plain(list(zip(x, y, strict=True)), tolerance)


def test_redundant_statistics(spark):
    rho = {("b", "a"): 0.9, ("c", "a"): 0.2, ("c", "b"): -0.95, ("d", "c"): -0.8, ("d", "a"): 0.75}
    assert S.pruned(list("abcd"), rho, 0.7) == [("a", None, None), ("b", "a", 0.9), ("c", None, None), ("d", "c", -0.8)]
    rng = np.random.default_rng(6)
    a = rng.integers(0, 30, 200)
    rows = spark.createDataFrame([(int(v), int(v) * 2 + 1, float(rng.random())) for v in a], "a int, b int, c double")
    found = {r["statistic"]: r["duplicate_of"] for r in S.redundancy(rows, ["a", "b", "c"], 0.7).collect()}
    assert found == {"a": None, "b": "a", "c": None}
    total = {r["a"]: r["upto"] for r in S.running_total(rows.groupBy("a").count(), "a", "count", 5).collect()}
    assert total == {v: int((a <= v).sum()) for v in set(a.tolist())}


def test_budget_rules(spark):
    from tessera.operators import evalkit as E

    rows = [("a", "max", 1.0, 0.5), ("b", "max", 1.0, 2.0), ("c", "min", 1.0, 2.0), ("d", "floor", 0.0, 0.01), ("e", "max", None, 3.0), ("f", "min", 1.0, None)]
    got = {r["key"]: (r["passed"], r["tightened"]) for r in E.ratchet_rules(spark.createDataFrame(rows, "key string, rule string, base double, now double"), 0.05).collect()}
    assert got == {"a": (True, True), "b": (False, False), "c": (True, True), "d": (False, False), "e": (True, False), "f": (False, False)}
