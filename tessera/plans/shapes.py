"""Queries of geometry, intervals and kernels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import geometry as G
from tessera.operators import regions as R
from tessera.plans.registry import register
from tessera.sources.derived import LB_SQL, PL_SQL, SP_SQL, order_spans, polylines, tile_labels, tile_pixels

RING_SQL = PL_SQL + """,
rg AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM pl WINDOW w AS (PARTITION BY line_id ORDER BY seq))"""
SG_SQL = PL_SQL + """,
sg AS (SELECT * FROM (SELECT line_id, seq, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM pl WINDOW w AS (PARTITION BY line_id ORDER BY seq)) WHERE nx IS NOT NULL)"""


@register("shoelace_area", f"WITH {RING_SQL}, s AS (SELECT line_id, sum(x * ny - nx * y) / 2 AS a, sum((x + nx) * (x * ny - nx * y)) / 6 AS sx, sum((y + ny) * (x * ny - nx * y)) / 6 AS sy FROM rg GROUP BY 1) SELECT line_id, round(a, 4) AS area, round(CASE WHEN abs(a) > 1e-9 THEN sx / a END, 4) AS cx, round(CASE WHEN abs(a) > 1e-9 THEN sy / a END, 4) AS cy FROM s")
def shoelace_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.ring_area(polylines(spark, sf_dir))


@register("path_length", f"WITH {SG_SQL} SELECT line_id, round(sum(sqrt(pow(nx - x, 2) + pow(ny - y, 2))), 6) AS length, count(*) AS steps FROM sg GROUP BY 1")
def path_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.path_length(polylines(spark, sf_dir))


@register("turning", f"WITH {PL_SQL}, mv AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM pl WINDOW w AS (PARTITION BY line_id ORDER BY seq)), st AS (SELECT line_id, seq, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy FROM mv WHERE px IS NULL OR px <> x OR py <> y WINDOW w AS (PARTITION BY line_id ORDER BY seq)), tn AS (SELECT line_id, dx, dy, lead(dx) OVER w AS ex, lead(dy) OVER w AS ey FROM st WHERE dx IS NOT NULL WINDOW w AS (PARTITION BY line_id ORDER BY seq)), s AS (SELECT line_id, coalesce(sum(abs(atan2(dx * ey - dy * ex, dx * ex + dy * ey))), 0) AS t, sum(sqrt(dx * dx + dy * dy)) AS l FROM tn GROUP BY 1) SELECT line_id, round(t, 5) AS turning, round(t / l, 6) AS per_length FROM s")
def turning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.turning(polylines(spark, sf_dir))


PM_SQL = PL_SQL + """,
pm AS (SELECT line_id, seq, """ + ", ".join(f"sum({t} / (sigma * sigma)) OVER (PARTITION BY line_id ORDER BY seq) AS {n}" for n, t in (("w", "1"), ("wx", "x"), ("wy", "y"), ("wxx", "x * x"), ("wyy", "y * y"), ("wxy", "x * y"))) + " FROM pl)"


@register("prefix_moments", f"WITH {PM_SQL} SELECT line_id, seq, round(w, 4) AS w, round(wx, 4) AS wx, round(wy, 4) AS wy, round(wxx, 4) AS wxx, round(wyy, 4) AS wyy, round(wxy, 4) AS wxy FROM pm")
def prefix_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.prefix_moments(polylines(spark, sf_dir)).select("line_id", "seq", *[F.round(c, 4).alias(c) for c in ("w", "wx", "wy", "wxx", "wyy", "wxy")])


def _ahead(n: str) -> str:
    return f"{n} - coalesce(lag({n}, 8) OVER o, 0) AS {n}"


@register("window_residuals", f"WITH {PM_SQL}, df AS (SELECT line_id, seq, row_number() OVER o AS n, {', '.join(map(_ahead, ('w', 'wx', 'wy', 'wxx', 'wyy', 'wxy')))} FROM pm WINDOW o AS (PARTITION BY line_id ORDER BY seq)), cv AS (SELECT line_id, seq, n, wxx - wx * wx / w AS xx, wyy - wy * wy / w AS yy, wxy - wx * wy / w AS xy FROM df) SELECT line_id, seq, round(greatest(0.5 * (xx + yy - sqrt((xx - yy) * (xx - yy) + 4 * xy * xy)), 0), 4) AS chi2 FROM cv WHERE n >= 8")
def window_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.window_residuals(polylines(spark, sf_dir), 8)


@register("kasa_circle", f"WITH {PL_SQL}, m AS (SELECT line_id, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(x * x + y * y) AS mz, covar_pop(x, x) AS xx, covar_pop(y, y) AS yy, covar_pop(x, y) AS xy, covar_pop(x, x * x + y * y) AS xz, covar_pop(y, x * x + y * y) AS yz FROM pl GROUP BY 1), c AS (SELECT *, CASE WHEN xx * yy - xy * xy > 1e-9 THEN (xz * yy - yz * xy) / (2 * (xx * yy - xy * xy)) END AS cx, CASE WHEN xx * yy - xy * xy > 1e-9 THEN (yz * xx - xz * xy) / (2 * (xx * yy - xy * xy)) END AS cy FROM m) SELECT line_id, n, round(cx, 3) AS cx, round(cy, 3) AS cy, round(sqrt(CASE WHEN cx IS NOT NULL THEN greatest(mz - 2 * cx * mx - 2 * cy * my + cx * cx + cy * cy, 0) END), 3) AS radius FROM c")
def kasa_circle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.kasa_circle(polylines(spark, sf_dir))


@register("max_deviation", f"WITH {PL_SQL}, e AS (SELECT *, first_value(x) OVER w AS ax, first_value(y) OVER w AS ay, last_value(x) OVER w AS bx, last_value(y) OVER w AS by_ FROM pl WINDOW w AS (PARTITION BY line_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) SELECT line_id, round(max(CASE WHEN sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2)) > 0 THEN abs((bx - ax) * (y - ay) - (by_ - ay) * (x - ax)) / sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2)) ELSE sqrt(pow(x - ax, 2) + pow(y - ay, 2)) END), 6) AS deviation FROM e GROUP BY 1")
def max_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.max_deviation(polylines(spark, sf_dir))


FOLD_SQL = PL_SQL.replace("pl AS", "p0 AS") + ", pl AS (SELECT line_id, seq, round(x - 9 * floor(x / 9), 6) AS x, y, sigma FROM p0)"


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line with its time folded to nine days, so that it crosses itself."""
    return polylines(spark, sf_dir).withColumn("x", F.round(F.col("x") - 9 * F.floor(F.col("x") / 9), 6))


FSG_SQL = FOLD_SQL + SG_SQL.removeprefix(PL_SQL)


@register("folded_crossings", f"WITH {FSG_SQL} SELECT p.line_id, p.seq AS a, q.seq AS b FROM sg p JOIN sg q ON p.line_id = q.line_id AND p.seq + 1 < q.seq WHERE ((p.nx - p.x) * (q.y - p.y) - (p.ny - p.y) * (q.x - p.x)) * ((p.nx - p.x) * (q.ny - p.y) - (p.ny - p.y) * (q.nx - p.x)) < 0 AND ((q.nx - q.x) * (p.y - q.y) - (q.ny - q.y) * (p.x - q.x)) * ((q.nx - q.x) * (p.ny - q.y) - (q.ny - q.y) * (p.nx - q.x)) < 0")
def folded_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.crossings(folded(spark, sf_dir))


@register("point_in_polygon", f"WITH {FOLD_SQL}, rg AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM pl WINDOW w AS (PARTITION BY line_id ORDER BY seq)), pb AS (SELECT DISTINCT line_id, px + 0.5::DOUBLE AS px, py * 20 + 7.5::DOUBLE AS py FROM pl, range(0, 9, 2) AS u(px), range(0, 5) AS t(py)) SELECT line_id, px, py, count(*) FILTER (WHERE (y > py) <> (ny > py) AND px < x + (py - y) * (nx - x) / nullif(ny - y, 0)) % 2 = 1 AS inside FROM pb JOIN rg USING (line_id) GROUP BY 1, 2, 3")
def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    rings = folded(spark, sf_dir)
    grid = rings.select("line_id").distinct().withColumn("u", F.explode(F.sequence(F.lit(0), F.lit(8), F.lit(2)))).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return G.points_in_rings(grid.select("line_id", (F.col("u") + 0.5).alias("px"), (F.col("t") * 20 + 7.5).alias("py")), rings)


@register("nearest_segment_bucketed", f"WITH {FSG_SQL}, pb AS (SELECT (u * 5 + t) AS probe_id, u + 0.5::DOUBLE AS px, t * 20 + 7.5::DOUBLE AS py FROM range(0, 9) AS a(u), range(0, 5) AS b(t)), d AS (SELECT probe_id, line_id, seq, px, py, x, y, nx, ny, coalesce(least(greatest(((px - x) * (nx - x) + (py - y) * (ny - y)) / nullif(pow(nx - x, 2) + pow(ny - y, 2), 0), 0), 1), 0) AS t FROM pb, sg), e AS (SELECT probe_id, line_id, seq, round(sqrt(pow(px - x - t * (nx - x), 2) + pow(py - y - t * (ny - y), 2)), 6) AS distance FROM d) SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY probe_id ORDER BY distance, line_id, seq) = 1")
def nearest_segment_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = spark.range(45).select(F.col("id").alias("probe_id"), (F.floor(F.col("id") / 5) + 0.5).alias("px"), (F.col("id") % 5 * 20 + 7.5).alias("py"))
    return G.nearest_segment(probes, G.segments(folded(spark, sf_dir)), 0.5)


def _span_sql(inside: str) -> str:
    return f"""WITH {SP_SQL}, dy AS (SELECT DISTINCT region_id, side, unnest(range(lo, hi)) AS d FROM sp), cv AS (SELECT region_id, d, max((side = 0)::INT) AS a, max((side = 1)::INT) AS b FROM dy GROUP BY 1, 2),
ok AS (SELECT region_id, d, d - row_number() OVER (PARTITION BY region_id ORDER BY d) AS k FROM cv WHERE {inside}) SELECT region_id, CAST(min(d) AS INT) AS lo, CAST(max(d) + 1 AS INT) AS hi FROM ok GROUP BY region_id, k"""


@register("span_union", _span_sql("a = 1 OR b = 1"))
def span_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.span_algebra(order_spans(spark, sf_dir), "union")


@register("span_intersect", _span_sql("a = 1 AND b = 1"))
def span_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.span_algebra(order_spans(spark, sf_dir), "intersect")


@register("span_minus", _span_sql("a = 1 AND b = 0"))
def span_minus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.span_algebra(order_spans(spark, sf_dir), "minus")


@register("containment_parent", f"WITH {LB_SQL}, bx AS (SELECT image_id, label, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM lb GROUP BY 1, 2), c AS (SELECT a.image_id, a.label, b.label AS parent, row_number() OVER (PARTITION BY a.image_id, a.label ORDER BY (b.x1 - b.x0 + 1) * (b.y1 - b.y0 + 1), b.label) AS k FROM bx a JOIN bx b ON a.image_id = b.image_id AND a.label <> b.label AND b.x0 <= a.x0 AND b.y0 <= a.y0 AND b.x1 >= a.x1 AND b.y1 >= a.y1) SELECT bx.image_id, bx.label, c.parent FROM bx LEFT JOIN c ON bx.image_id = c.image_id AND bx.label = c.label AND c.k = 1")
def containment_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.containment_parent(R.bounding_boxes(tile_labels(spark, sf_dir)))


@register("optimal_polygon")
def optimal_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dynamic program over each line; tests compare it with an exhaustive one."""
    return G.optimal_polygons(polylines(spark, sf_dir), 3.0)


@register("ties_clusters")
def ties_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact clusters of each tile's values; tests compare them with all partitions."""
    return G.clustered(tile_pixels(spark, sf_dir), "image_id", "v", 0.05)


def _is_axis(dx: str, dy: str) -> str:
    return f"abs({dx}) < 0.0175 * sqrt({dx} * {dx} + {dy} * {dy}) OR abs({dy}) < 0.0175 * sqrt({dx} * {dx} + {dy} * {dy})"


@register("axis_share", f"WITH {SG_SQL}, d AS (SELECT line_id, nx - x AS dx, ny - y AS dy FROM sg), n AS (SELECT *, sqrt(dx * dx + dy * dy) AS n FROM d) SELECT line_id, round(coalesce(sum(n) FILTER (WHERE {_is_axis('dx', 'dy')}), 0) / sum(n), 6) AS share FROM n WHERE n >= 1e-9 GROUP BY 1")
def axis_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.axis_share(polylines(spark, sf_dir), 0.0175)


@register("spikes", f"WITH {PL_SQL}, t AS (SELECT line_id, seq, x - lag(x) OVER w AS ux, y - lag(y) OVER w AS uy, lead(x) OVER w - x AS vx, lead(y) OVER w - y AS vy FROM pl WINDOW w AS (PARTITION BY line_id ORDER BY seq)), l AS (SELECT *, sqrt(ux * ux + uy * uy) AS lu, sqrt(vx * vx + vy * vy) AS lv FROM t WHERE ux IS NOT NULL AND vx IS NOT NULL), a AS (SELECT line_id, seq, round(degrees(acos(least(greatest((ux * vx + uy * vy) / (lu * lv), -1), 1))), 6) AS turn, round(lu, 6) AS before, round(lv, 6) AS after FROM l WHERE lu >= 1e-6 AND lv >= 1e-6) SELECT * FROM a WHERE turn > 179 AND greatest(before, after) > 5")
def spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.spikes(polylines(spark, sf_dir), 179.0, 5.0)


GRID_SQL = PL_SQL + ", gp AS (SELECT line_id, seq, CAST(floor(x * 1000000) AS HUGEINT) AS x, CAST(floor(y * 1000) AS HUGEINT) AS y FROM pl)"


def _lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = polylines(spark, sf_dir)
    return p.select("line_id", "seq", F.floor(F.col("x") * 1_000_000).alias("x"), F.floor(F.col("y") * 1000).alias("y"))


@register(
    "exact_predicates",
    f"""WITH {GRID_SQL}, w AS (SELECT line_id, seq, x, y, lead(x, 1) OVER w AS bx, lead(y, 1) OVER w AS by_, lead(x, 2) OVER w AS cx, lead(y, 2) OVER w AS cy, lead(x, 3) OVER w AS dx, lead(y, 3) OVER w AS dy FROM gp WINDOW w AS (PARTITION BY line_id ORDER BY seq)),
r AS (SELECT line_id, seq, x - dx AS ax, y - dy AS ay, bx - dx AS bx, by_ - dy AS by_, cx - dx AS cx, cy - dy AS cy, (bx - x) * (cy - y) - (by_ - y) * (cx - x) AS o FROM w WHERE dx IS NOT NULL)
SELECT line_id, seq, CAST(sign(o) AS INT) AS orientation, CAST(sign((ax * ax + ay * ay) * (bx * cy - cx * by_) - (bx * bx + by_ * by_) * (ax * cy - cx * ay) + (cx * cx + cy * cy) * (ax * by_ - bx * ay)) AS INT) AS in_circle FROM r""",
)
def exact_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signs without rounding: which way three points turn, and whether the fourth lies in their circle."""
    return G.exact_predicates(_lattice(spark, sf_dir))


@register(
    "second_moments",
    f"""WITH {RING_SQL}, s AS (SELECT line_id, sum((x * ny - nx * y) * (x * x + x * nx + nx * nx)) / 12 AS xx, sum((x * ny - nx * y) * (y * y + y * ny + ny * ny)) / 12 AS yy, sum((x * ny - nx * y) * (x * ny + 2 * x * y + 2 * nx * ny + nx * y)) / 24 AS xy FROM rg GROUP BY 1)
SELECT line_id, round(xx, 2) AS xx, round(yy, 2) AS yy, round(xy, 2) AS xy FROM s""",
)
def second_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.second_moments(polylines(spark, sf_dir))


@register("triangle_cover", f"WITH {PL_SQL}, m AS (SELECT line_id, seq, x - 4 * floor(x / 4) AS x, y - 4 * floor(y / 4) AS y FROM pl), t AS (SELECT line_id, seq, x, y, lead(x, 1) OVER w AS bx, lead(y, 1) OVER w AS by_, lead(x, 2) OVER w AS cx, lead(y, 2) OVER w AS cy FROM m WINDOW w AS (PARTITION BY line_id ORDER BY seq)) SELECT line_id, seq, round(abs((bx - x) * (cy - y) - (by_ - y) * (cx - x)) / 2, 6) AS covered FROM t WHERE cx IS NOT NULL")
def triangle_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixel coverage of every three points in a row, folded to four by four pixels; it adds up to the triangle's area."""
    m = polylines(spark, sf_dir).select("line_id", "seq", *[(F.col(c) - 4 * F.floor(F.col(c) / 4)).alias(c) for c in "xy"])
    return G.triangle_cover(m, 4, 4)


@register("span_dilate", _span_sql("a = 1").replace("unnest(range(lo, hi))", "unnest(range(lo - 5, hi + 5))"))
def span_dilate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first side's spans, each wider by five days at either end, joined."""
    return G.span_dilate(order_spans(spark, sf_dir).filter("side = 0"), 5)


@register("span_erode", f"WITH u AS ({_span_sql('a = 1')}) SELECT region_id, CAST(lo + 5 AS INT) AS lo, CAST(hi - 5 AS INT) AS hi FROM u WHERE hi - 5 > lo + 5")
def span_erode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.span_erode(order_spans(spark, sf_dir).filter("side = 0"), 5)


@register("span_overdraw", f"WITH u AS ({_span_sql('a = 1 OR b = 1')}), {SP_SQL.strip()}, t AS (SELECT region_id, sum(hi - lo) AS drawn, min(lo) AS lo, max(hi) AS hi FROM sp GROUP BY 1), n AS (SELECT region_id, sum(hi - lo) AS net FROM u GROUP BY 1) SELECT region_id, CAST(net AS BIGINT) AS area, lo, hi, round(drawn / net, 6) AS overdraw FROM t JOIN n USING (region_id)")
def span_overdraw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area, bounds, and how often each covered day is drawn over."""
    return G.span_overdraw(order_spans(spark, sf_dir))


@register("machine_moves", f"WITH {PL_SQL}, g AS (SELECT line_id, string_agg(CASE WHEN seq = 1 THEN 'G0' ELSE 'G1' END || printf(' X%.3f Y%.3f', floor(x * 1000 + 0.5) / 1000, floor(y * 1000 + 0.5) / 1000), chr(10) ORDER BY seq) AS moves FROM pl GROUP BY 1) SELECT line_id, moves FROM g")
def machine_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line as a tool's moves: one rapid, then feeds."""
    return G.machine_moves(polylines(spark, sf_dir))


@register("simplified_lines")
def simplified_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points that a tolerance keeps; tests compare with the recursion."""
    return G.simplified(polylines(spark, sf_dir), 20.0)
