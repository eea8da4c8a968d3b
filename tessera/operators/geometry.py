"""Geometry over polylines, spans and boxes: moments, fits, crossings, interval algebra, nearest pieces.

A polyline is rows of line_id, seq, x, y. Spans are half-open [lo, hi) on a line. Joins are
equi-joins on an id or a cell, with the exact predicate after them.
"""

from __future__ import annotations


from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import checkpointed


def _along():
    return Window.partitionBy("line_id").orderBy("seq")


def ring_area(points: DataFrame) -> DataFrame:
    """Signed area and centroid moments of each closed line by the shoelace rule: line_id, area, cx, cy."""
    whole = Window.partitionBy("line_id")
    nx, ny = F.coalesce(F.lead("x").over(_along()), F.min_by("x", "seq").over(whole)), F.coalesce(F.lead("y").over(_along()), F.min_by("y", "seq").over(whole))
    steps = points.withColumns({"nx": nx, "ny": ny}).withColumn("c", F.col("x") * F.col("ny") - F.col("nx") * F.col("y"))
    sums = steps.groupBy("line_id").agg((F.sum("c") / 2).alias("area"), (F.sum((F.col("x") + F.col("nx")) * F.col("c")) / 6).alias("sx"), (F.sum((F.col("y") + F.col("ny")) * F.col("c")) / 6).alias("sy"))
    safe = F.when(F.abs("area") > 1e-9, F.col("area"))
    return sums.select("line_id", F.round("area", 4).alias("area"), F.round(F.col("sx") / safe, 4).alias("cx"), F.round(F.col("sy") / safe, 4).alias("cy"))


def segments(points: DataFrame) -> DataFrame:
    """line_id, seq, x, y, nx, ny of each step."""
    return points.withColumns({"nx": F.lead("x").over(_along()), "ny": F.lead("y").over(_along())}).filter("nx IS NOT NULL").select("line_id", "seq", "x", "y", "nx", "ny")


def path_length(points: DataFrame) -> DataFrame:
    steps = segments(points).withColumn("d", F.sqrt((F.col("nx") - F.col("x")) ** 2 + (F.col("ny") - F.col("y")) ** 2))
    return steps.groupBy("line_id").agg(F.round(F.sum("d"), 6).alias("length"), F.count(F.lit(1)).alias("steps"))


def turning(points: DataFrame) -> DataFrame:
    """Total absolute turning of each open line, and per length; repeated points are dropped first."""
    moved = points.withColumns({"px": F.lag("x").over(_along()), "py": F.lag("y").over(_along())}).filter("px IS NULL OR px <> x OR py <> y")
    steps = segments(moved.select("line_id", "seq", "x", "y")).withColumns({"dx": F.col("nx") - F.col("x"), "dy": F.col("ny") - F.col("y")})
    turned = steps.withColumns({"ex": F.lead("dx").over(_along()), "ey": F.lead("dy").over(_along())})
    angle = F.abs(F.atan2(F.col("dx") * F.col("ey") - F.col("dy") * F.col("ex"), F.col("dx") * F.col("ex") + F.col("dy") * F.col("ey")))
    out = turned.select("line_id", angle.alias("angle"), F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2).alias("d"))
    sums = out.groupBy("line_id").agg(F.coalesce(F.sum("angle"), F.lit(0.0)).alias("turning"), F.sum("d").alias("length"))
    return sums.select("line_id", F.round("turning", 5).alias("turning"), F.round(F.col("turning") / F.col("length"), 6).alias("per_length"))


def prefix_moments(points: DataFrame) -> DataFrame:
    """Running weighted sums along each line, weights 1 / sigma^2: w, wx, wy, wxx, wyy, wxy up to each point."""
    w = 1 / (F.col("sigma") * F.col("sigma"))
    upto = _along().rowsBetween(Window.unboundedPreceding, 0)
    terms = {"w": w, "wx": w * F.col("x"), "wy": w * F.col("y"), "wxx": w * F.col("x") ** 2, "wyy": w * F.col("y") ** 2, "wxy": w * F.col("x") * F.col("y")}
    return points.select("line_id", "seq", *[F.sum(t).over(upto).alias(n) for n, t in terms.items()])


def line_residual(w: Column, wx: Column, wy: Column, wxx: Column, wyy: Column, wxy: Column) -> Column:
    """Weighted squared distance of points to their best line, from their sums."""
    xx, yy, xy = wxx - wx * wx / w, wyy - wy * wy / w, wxy - wx * wy / w
    return F.greatest(0.5 * (xx + yy - F.sqrt((xx - yy) * (xx - yy) + 4 * xy * xy)), F.lit(0.0))


def window_residuals(points: DataFrame, width: int) -> DataFrame:
    """Residual to the best line of every `width` points in a row, from differences of prefix sums."""
    sums = prefix_moments(points)
    names = ("w", "wx", "wy", "wxx", "wyy", "wxy")
    parts = [F.col(n) - F.coalesce(F.lag(n, width).over(_along()), F.lit(0.0)) for n in names]
    n = F.row_number().over(_along())
    return sums.select("line_id", "seq", n.alias("n"), F.round(line_residual(*parts), 4).alias("chi2")).filter(F.col("n") >= width).drop("n")


def kasa_circle(points: DataFrame) -> DataFrame:
    """Algebraic least-squares circle of each line's points from their moments: cx, cy, radius; null for points on a line."""
    x, y = F.col("x"), F.col("y")
    z = x * x + y * y
    m = points.groupBy("line_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg(z).alias("mz"), F.covar_pop("x", "x").alias("xx"), F.covar_pop("y", "y").alias("yy"),
        F.covar_pop("x", "y").alias("xy"), F.covar_pop("x", z).alias("xz"), F.covar_pop("y", z).alias("yz"),
    )
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    safe = F.when(det > 1e-9, det)
    m = m.withColumns({"cx": (F.col("xz") * F.col("yy") - F.col("yz") * F.col("xy")) / (2 * safe), "cy": (F.col("yz") * F.col("xx") - F.col("xz") * F.col("xy")) / (2 * safe)})
    radius = F.sqrt(F.greatest(F.col("mz") - 2 * F.col("cx") * F.col("mx") - 2 * F.col("cy") * F.col("my") + F.col("cx") ** 2 + F.col("cy") ** 2, F.lit(0.0)))
    return m.select("line_id", "n", F.round("cx", 3).alias("cx"), F.round("cy", 3).alias("cy"), F.round(F.when(F.col("cx").isNotNull(), radius), 3).alias("radius"))


def max_deviation(points: DataFrame) -> DataFrame:
    """Largest distance of a line's points to its chord."""
    whole = Window.partitionBy("line_id")
    ends = {n: f(c, "seq").over(whole) for n, f, c in (("ax", F.min_by, "x"), ("ay", F.min_by, "y"), ("bx", F.max_by, "x"), ("by", F.max_by, "y"))}
    p = points.withColumns(ends)
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    chord = F.sqrt(dx * dx + dy * dy)
    off = F.when(chord > 0, F.abs(dx * (F.col("y") - F.col("ay")) - dy * (F.col("x") - F.col("ax"))) / F.nullif(chord, F.lit(0.0))).otherwise(F.sqrt((F.col("x") - F.col("ax")) ** 2 + (F.col("y") - F.col("ay")) ** 2))
    return p.groupBy("line_id").agg(F.round(F.max(off), 6).alias("deviation"))


def orientation(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def crossings(points: DataFrame) -> DataFrame:
    """Proper crossings between steps of one line that are not neighbours: line_id, a, b (their seq)."""
    s = segments(points)
    p, q = s.alias("p"), s.alias("q")
    c = F.col
    near = (F.least("p.x", "p.nx") < F.greatest("q.x", "q.nx")) & (F.least("q.x", "q.nx") < F.greatest("p.x", "p.nx")) & (F.least("p.y", "p.ny") < F.greatest("q.y", "q.ny")) & (F.least("q.y", "q.ny") < F.greatest("p.y", "p.ny"))
    d = [orientation(*[c(n) for n in t]) for t in (("p.x", "p.y", "p.nx", "p.ny", "q.x", "q.y"), ("p.x", "p.y", "p.nx", "p.ny", "q.nx", "q.ny"), ("q.x", "q.y", "q.nx", "q.ny", "p.x", "p.y"), ("q.x", "q.y", "q.nx", "q.ny", "p.nx", "p.ny"))]
    both = p.join(q, (c("p.line_id") == c("q.line_id")) & (c("p.seq") + 1 < c("q.seq")) & near)
    return both.filter((d[0] * d[1] < 0) & (d[2] * d[3] < 0)).select("p.line_id", c("p.seq").alias("a"), c("q.seq").alias("b"))


def points_in_rings(probes: DataFrame, rings: DataFrame) -> DataFrame:
    """Whether each probe (line_id, px, py) lies in its closed ring, by counting crossings of a ray."""
    whole = Window.partitionBy("line_id")
    edges = rings.withColumns({"nx": F.coalesce(F.lead("x").over(_along()), F.min_by("x", "seq").over(whole)), "ny": F.coalesce(F.lead("y").over(_along()), F.min_by("y", "seq").over(whole))})
    hit = ((F.col("y") > F.col("py")) != (F.col("ny") > F.col("py"))) & (F.col("px") < F.col("x") + (F.col("py") - F.col("y")) * (F.col("nx") - F.col("x")) / F.nullif(F.col("ny") - F.col("y"), F.lit(0.0)))
    counted = probes.join(edges, "line_id").groupBy("line_id", "px", "py").agg(F.sum(F.coalesce(hit, F.lit(False)).cast("long")).alias("n"))
    return counted.select("line_id", "px", "py", (F.col("n") % 2 == 1).alias("inside"))


def span_algebra(spans: DataFrame, kind: str) -> DataFrame:
    """Union, intersection or difference of the two sides' spans of each region by a sweep: region_id, lo, hi.

    Ends are events of +1 and -1; running sums say which sides cover the stretch to the next event.
    """
    inside = {"union": "(a > 0 OR b > 0)", "intersect": "(a > 0 AND b > 0)", "minus": "(a > 0 AND b = 0)"}[kind]
    ends = spans.select("region_id", "side", F.explode(F.array(F.struct(F.col("lo").alias("at"), F.lit(1).alias("d")), F.struct(F.col("hi").alias("at"), F.lit(-1).alias("d")))).alias("e")).select("region_id", "side", "e.*")
    steps = ends.groupBy("region_id", "at").agg(F.sum(F.when(F.col("side") == 0, F.col("d")).otherwise(0)).alias("da"), F.sum(F.when(F.col("side") == 1, F.col("d")).otherwise(0)).alias("db"))
    order = Window.partitionBy("region_id").orderBy("at")
    running = steps.withColumns({"a": F.sum("da").over(order), "b": F.sum("db").over(order), "next": F.lead("at").over(order)})
    pieces = running.filter(f"next IS NOT NULL AND {inside}").select("region_id", F.col("at").alias("lo"), F.col("next").alias("hi"))
    new = (F.lag("hi").over(Window.partitionBy("region_id").orderBy("lo")) != F.col("lo")).cast("int")
    numbered = pieces.withColumn("new", F.coalesce(new, F.lit(1))).withColumn("k", F.sum("new").over(Window.partitionBy("region_id").orderBy("lo")))
    return numbered.groupBy("region_id", "k").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("k")


def containment_parent(boxes: DataFrame) -> DataFrame:
    """The smallest other box that holds each box of its image: image_id, label, parent (the lower label of equals)."""
    outer = boxes.select("image_id", *[F.col(c).alias(f"o_{c}") for c in ("label", "x0", "y0", "x1", "y1")])
    holds = (F.col("o_label") != F.col("label")) & (F.col("o_x0") <= F.col("x0")) & (F.col("o_y0") <= F.col("y0")) & (F.col("o_x1") >= F.col("x1")) & (F.col("o_y1") >= F.col("y1"))
    size = (F.col("o_x1") - F.col("o_x0") + 1) * (F.col("o_y1") - F.col("o_y0") + 1)
    best = F.min(F.when(holds, F.struct(size.alias("size"), F.col("o_label").alias("parent"))))["parent"]
    return boxes.join(outer, "image_id").groupBy("image_id", "label").agg(best.alias("parent"))


def nearest_segment(probes: DataFrame, steps: DataFrame, cell: float) -> DataFrame:
    """The step nearest each probe: probe_id, line_id, seq, distance.

    Probes look within `cell` first; those that find nothing look again in cells of twice the
    size, until all have found one.
    """
    found = checkpointed(nearest_within(probes, steps, cell))
    left = checkpointed(probes.join(found, "probe_id", "left_anti"))
    while left.limit(1).count() and steps.limit(1).count():
        cell *= 2
        more = checkpointed(nearest_within(left, steps, cell))
        found, left = found.unionByName(more), checkpointed(left.join(more, "probe_id", "left_anti"))
    return found


def nearest_within(probes: DataFrame, steps: DataFrame, cell: float) -> DataFrame:
    """The step nearest each probe within `cell`, found in the nine cells about it.

    Steps are put into every cell that their bounding box meets, so no nearer one is missed.
    """
    x0, x1 = F.floor(F.least("x", "nx") / cell), F.floor(F.greatest("x", "nx") / cell)
    y0, y1 = F.floor(F.least("y", "ny") / cell), F.floor(F.greatest("y", "ny") / cell)
    placed = steps.withColumn("cx", F.explode(F.sequence(x0, x1))).withColumn("cy", F.explode(F.sequence(y0, y1)))
    px, py = F.floor(F.col("px") / cell), F.floor(F.col("py") / cell)
    asked = probes.withColumn("cx", F.explode(F.sequence(px - 1, px + 1))).withColumn("cy", F.explode(F.sequence(py - 1, py + 1)))
    dx, dy = F.col("nx") - F.col("x"), F.col("ny") - F.col("y")
    long = dx * dx + dy * dy
    t = F.when(long > 0, F.least(F.greatest(((F.col("px") - F.col("x")) * dx + (F.col("py") - F.col("y")) * dy) / F.nullif(long, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    met = asked.join(placed, ["cx", "cy"]).withColumn("t", t)
    d = F.round(F.sqrt((F.col("px") - F.col("x") - F.col("t") * dx) ** 2 + (F.col("py") - F.col("y") - F.col("t") * dy) ** 2), 6)
    best = met.withColumn("d", d).filter(F.col("d") <= cell).groupBy("probe_id").agg(F.min(F.struct("d", "line_id", "seq")).alias("m"))
    return best.select("probe_id", "m.line_id", "m.seq", F.col("m.d").alias("distance"))


def best_polygon(x: np.ndarray, y: np.ndarray, sigma: np.ndarray, lam: float) -> tuple[list[int], float]:
    """Vertices of the cheapest chain of best-fit lines through the points, and its cost.

    A segment costs half its weighted residual and two parameters at `lam`. Among equal costs the
    earliest start holds. A start is given up once its residual alone is dearer than four times
    the parameters that splitting could add.
    """
    n = len(x)
    if n < 2:
        return list(range(n)), 0.0
    w = 1 / sigma**2
    sums = np.zeros((6, n + 1))
    np.cumsum([w, w * x, w * y, w * x * x, w * y * y, w * x * y], axis=1, out=sums[:, 1:])
    best, back = np.full(n, np.inf), np.zeros(n, int)
    best[0] = 0
    open_ = np.zeros(0, int)
    for j in range(1, n):
        open_ = np.append(open_, j - 1)
        s = sums[:, j + 1, None] - sums[:, open_]
        xx, yy, xy = s[3] - s[1] ** 2 / s[0], s[4] - s[2] ** 2 / s[0], s[5] - s[1] * s[2] / s[0]
        half = 0.5 * np.maximum(0.5 * (xx + yy - np.sqrt((xx - yy) ** 2 + 4 * xy**2)), 0)
        cost = best[open_] + half + 2 * lam
        k = int(np.argmin(cost))
        best[j], back[j] = cost[k], open_[k]
        open_ = open_[half <= 8 * lam * (j - open_)]
    chain = [n - 1]
    while chain[-1]:
        chain.append(int(back[chain[-1]]))
    return chain[::-1], float(best[-1])


POLYGON = "line_id bigint, n_points bigint, n_vertices bigint, cost double, vertices string"


def optimal_polygons(points: DataFrame, lam: float) -> DataFrame:
    """`best_polygon` of each line: its vertices' seq, joined by commas. A line meets in one task, as its optimum needs."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        chain, cost = best_polygon(rows["x"].to_numpy(float), rows["y"].to_numpy(float), rows["sigma"].to_numpy(float), lam)
        names = rows["seq"].to_numpy()[chain]
        return pd.DataFrame([[rows["line_id"].iloc[0], len(rows), len(chain), round(cost, 6), ",".join(map(str, names))]], columns=[c.split()[0] for c in POLYGON.split(", ")])

    return points.select("line_id", "seq", "x", "y", "sigma").groupBy("line_id").applyInPandas(run, POLYGON)


def ties_clusters(values: Iterator[float], penalty: float) -> list[int]:
    """Cuts of sorted values into clusters of least squared spread plus a penalty each: the index each cluster starts at."""
    v = np.sort(np.fromiter(values, float))
    n = len(v)
    one, two = np.concatenate([[0], np.cumsum(v)]), np.concatenate([[0], np.cumsum(v * v)])
    best, back = np.zeros(n + 1), np.zeros(n + 1, int)
    for j in range(1, n + 1):
        i = np.arange(j)
        spread = np.maximum(two[j] - two[:j] - (one[j] - one[:j]) ** 2 / (j - i), 0)
        cost = best[:j] + spread + penalty
        back[j] = int(np.argmin(cost))
        best[j] = cost[back[j]]
    cuts, j = [], n
    while j:
        j = int(back[j])
        cuts.append(j)
    return cuts[::-1]


def clustered(rows: DataFrame, by: str, value: str, penalty: float) -> DataFrame:
    """How many tied clusters each group's values have, and where they start."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        cuts = ties_clusters(iter(group[value].to_numpy(float)), penalty)
        v = np.sort(group[value].to_numpy(float))
        return pd.DataFrame([[group[by].iloc[0], len(v), len(cuts), ",".join(f"{v[c]:g}" for c in cuts)]], columns=[by, "n", "clusters", "starts"])

    kind = dict(rows.dtypes)[by]
    return rows.select(by, value).groupBy(by).applyInPandas(run, f"{by} {kind}, n bigint, clusters bigint, starts string")




def axis_share(points: DataFrame, tolerance: float) -> DataFrame:
    """Share of each line's length in steps within a tolerance (a sine) of an axis: line_id, share."""
    dx, dy = F.col("nx") - F.col("x"), F.col("ny") - F.col("y")
    steps = segments(points).select("line_id", dx.alias("dx"), dy.alias("dy"), F.sqrt(dx * dx + dy * dy).alias("n")).filter("n >= 1e-9")
    aligned = (F.abs("dx") < tolerance * F.col("n")) | (F.abs("dy") < tolerance * F.col("n"))
    return steps.groupBy("line_id").agg(F.round(F.sum(F.when(aligned, F.col("n")).otherwise(0.0)) / F.sum("n"), 6).alias("share"))


def spikes(points: DataFrame, sharp: float, arm: float) -> DataFrame:
    """Points where a line turns back by more than `sharp` degrees on an arm longer than `arm`: line_id, seq, turn, before, after."""
    steps = points.select("line_id", "seq", *[(F.col(c) - F.lag(c).over(_along())).alias(f"u{c}") for c in "xy"], *[(F.lead(c).over(_along()) - F.col(c)).alias(f"v{c}") for c in "xy"])
    steps = steps.filter("ux IS NOT NULL AND vx IS NOT NULL").withColumns({"lu": F.sqrt(F.col("ux") ** 2 + F.col("uy") ** 2), "lv": F.sqrt(F.col("vx") ** 2 + F.col("vy") ** 2)}).filter("lu >= 1e-6 AND lv >= 1e-6")
    cosine = (F.col("ux") * F.col("vx") + F.col("uy") * F.col("vy")) / (F.col("lu") * F.col("lv"))
    turn = F.round(F.degrees(F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0)))), 6)
    found = steps.select("line_id", "seq", turn.alias("turn"), F.round("lu", 6).alias("before"), F.round("lv", 6).alias("after"))
    return found.filter((F.col("turn") > sharp) & (F.greatest("before", "after") > arm))


def exact_predicates(points: DataFrame) -> DataFrame:
    """Of whole-number points: the sign of the turn at the next two, and whether the fourth lies in the circle of the three.

    Products are decimals of 38 digits, so no sign is lost; differences may have nine digits.
    """
    ahead = points.select("line_id", "seq", *[(F.lead(c, k).over(_along()) if k else F.col(c)).cast("decimal(10,0)").alias(f"{c}{k}") for k in range(4) for c in "xy"]).filter("x3 IS NOT NULL")

    def minus(a: str, b: str) -> Column:
        return (F.col(a) - F.col(b)).cast("decimal(10,0)")

    def cross(p: tuple[Column, Column], q: tuple[Column, Column]) -> Column:
        return (p[0] * q[1] - p[1] * q[0]).cast("decimal(19,0)")

    o = cross((minus("x1", "x0"), minus("y1", "y0")), (minus("x2", "x0"), minus("y2", "y0")))
    a, b, c = ((minus(f"x{k}", "x3"), minus(f"y{k}", "y3")) for k in range(3))

    def square(p: tuple[Column, Column]) -> Column:
        return (p[0] * p[0] + p[1] * p[1]).cast("decimal(18,0)")

    circle = square(a) * cross(b, c) - square(b) * cross(a, c) + square(c) * cross(a, b)
    return ahead.select("line_id", "seq", F.signum(o).cast("int").alias("orientation"), F.signum(circle).cast("int").alias("in_circle"))


def second_moments(points: DataFrame) -> DataFrame:
    """Moments of area of each closed line about the origin: line_id, xx, yy, xy."""
    whole = Window.partitionBy("line_id")
    ring = points.withColumns({f"n{c}": F.coalesce(F.lead(c).over(_along()), F.min_by(c, "seq").over(whole)) for c in "xy"})
    x, y, nx, ny = (F.col(c) for c in ("x", "y", "nx", "ny"))
    c = x * ny - nx * y
    sums = ring.groupBy("line_id").agg((F.sum(c * (x * x + x * nx + nx * nx)) / 12).alias("xx"), (F.sum(c * (y * y + y * ny + ny * ny)) / 12).alias("yy"), (F.sum(c * (x * ny + 2 * x * y + 2 * nx * ny + nx * y)) / 24).alias("xy"))
    return sums.select("line_id", *[F.round(k, 2).alias(k) for k in ("xx", "yy", "xy")])


def triangle_cover(points: DataFrame, width: int, height: int) -> DataFrame:
    """The pixel coverage of each triangle of three points in a row, added up: line_id, seq, covered."""
    from tessera.operators.dense import clipped_cover

    corners = points.select("line_id", "seq", "x", "y", *[F.lead(c, k).over(_along()).alias(f"{c}{k}") for k in (1, 2) for c in "xy"]).filter("x2 IS NOT NULL")

    @F.pandas_udf("double")
    def covered(x: pd.Series, y: pd.Series, x1: pd.Series, y1: pd.Series, x2: pd.Series, y2: pd.Series) -> pd.Series:
        rows = np.stack([x, y, x1, y1, x2, y2], axis=1).reshape(-1, 3, 2)
        return pd.Series([round(float(clipped_cover(t, width, height).sum()), 6) for t in rows])

    return corners.select("line_id", "seq", covered("x", "y", "x1", "y1", "x2", "y2").alias("covered"))


def _joined_spans(spans: DataFrame) -> DataFrame:
    return span_algebra(spans.withColumn("side", F.lit(0)), "union")


def span_dilate(spans: DataFrame, reach: int) -> DataFrame:
    """Spans wider by `reach` at either end, joined where they meet: region_id, lo, hi."""
    return _joined_spans(spans.withColumns({"lo": F.col("lo") - reach, "hi": F.col("hi") + reach}))


def span_erode(spans: DataFrame, reach: int) -> DataFrame:
    """Joined spans narrower by `reach` at either end; those that vanish go."""
    return _joined_spans(spans).select("region_id", (F.col("lo") + reach).alias("lo"), (F.col("hi") - reach).alias("hi")).filter("hi > lo")


def span_overdraw(spans: DataFrame) -> DataFrame:
    """Of each region the covered length, its bounds, and the drawn length over the covered one."""
    net = span_algebra(spans, "union").groupBy("region_id").agg(F.sum(F.col("hi") - F.col("lo")).alias("area"))
    drawn = spans.groupBy("region_id").agg(F.sum(F.col("hi") - F.col("lo")).alias("drawn"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return net.join(drawn, "region_id").select("region_id", "area", "lo", "hi", F.round(F.col("drawn") / F.col("area"), 6).alias("overdraw"))


def machine_moves(points: DataFrame) -> DataFrame:
    """Each line as moves of a tool: line_id, moves."""
    at = [F.floor(F.col(c) * 1000 + 0.5) / 1000 for c in "xy"]
    move = F.format_string("%s X%.3f Y%.3f", F.when(F.col("seq") == 1, "G0").otherwise("G1"), *at)
    rows = points.groupBy("line_id").agg(F.sort_array(F.collect_list(F.struct("seq", move.alias("m")))).alias("ms"))
    return rows.select("line_id", F.array_join(F.transform("ms", lambda m: m["m"]), "\n").alias("moves"))


def kept_points(x: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    """Indices that the farthest-point rule keeps: a stretch is split at the point farthest from its chord while that is over the tolerance."""
    n = len(x)
    keep = np.zeros(n, bool)
    keep[[0, -1]] = True
    todo = [(0, n - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        px, py, dx, dy = x[a + 1 : b] - x[a], y[a + 1 : b] - y[a], x[b] - x[a], y[b] - y[a]
        length = dx * dx + dy * dy
        t = np.clip((px * dx + py * dy) / length, 0, 1) if length > 0 else np.zeros(b - a - 1)
        d = np.hypot(px - t * dx, py - t * dy)
        far = int(d.argmax())
        if d[far] > tolerance:
            keep[a + 1 + far] = True
            todo += [(a, a + 1 + far), (a + 1 + far, b)]
    return np.flatnonzero(keep)


def simplified(points: DataFrame, tolerance: float) -> DataFrame:
    """Each line's points that `kept_points` keeps: line_id, seq, x, y. A line meets in one task."""

    def run(line: pd.DataFrame) -> pd.DataFrame:
        line = line.sort_values("seq")
        return line.iloc[kept_points(line["x"].to_numpy(), line["y"].to_numpy(), tolerance)]

    return points.select("line_id", "seq", "x", "y").groupBy("line_id").applyInPandas(run, "line_id bigint, seq int, x double, y double")
