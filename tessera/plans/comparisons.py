"""Queries that compare rasters and choose between models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import metrics as M
from tessera.operators import palette as P
from tessera.operators import regions as R
from tessera.plans.raster import CRACKS_SQL
from tessera.plans.registry import register
from tessera.sources.derived import LB_SQL, PX_SQL, label_of, tile_labels, tile_pixels

PAIR_SQL = PX_SQL + ", pr AS (SELECT image_id, x, y, v + 0.5 AS v, round(v, 1) + 0.5 AS w FROM px)"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tile and the same in steps of a tenth."""
    return tile_pixels(spark, sf_dir).select("image_id", "x", "y", (F.col("v") + 0.5).alias("v"), (F.round("v", 1) + 0.5).alias("w"))


def _grad(c: str) -> str:
    right, left = (f"sum(b.{c}) FILTER (WHERE b.x = a.x {s} 1)" for s in "+-")
    below, above = (f"sum(b.{c}) FILTER (WHERE b.y = a.y {s} 1)" for s in "+-")
    return f"sqrt(pow(({right} - {left}) / 3, 2) + pow(({below} - {above}) / 3, 2))"


@register("gmsd", f"WITH {PAIR_SQL}, g AS (SELECT a.image_id, a.x, a.y, {_grad('v')} AS m, {_grad('w')} AS n FROM pr a JOIN pr b ON a.image_id = b.image_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 WHERE a.x BETWEEN 1 AND 6 AND a.y BETWEEN 1 AND 6 GROUP BY 1, 2, 3) SELECT image_id, round(stddev_pop((2 * m * n + 0.0026) / (m * m + n * n + 0.0026)), 6) AS gmsd FROM g GROUP BY 1")
def gmsd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.gmsd(pairs(spark, sf_dir))


@register("ssim", f"WITH {PAIR_SQL}, m AS (SELECT image_id, avg(v) AS a, avg(w) AS b, var_pop(v) AS va, var_pop(w) AS vb, covar_pop(v, w) AS c FROM pr GROUP BY 1) SELECT image_id, round((2 * a * b + 1e-4) * (2 * c + 9e-4) / ((a * a + b * b + 1e-4) * (va + vb + 9e-4)), 6) AS ssim FROM m")
def ssim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.ssim(pairs(spark, sf_dir))


@register("seam_fraction", f"WITH {PAIR_SQL} SELECT image_id, round(avg((v >= 0.6 AND w <= 0.61)::INT), 6) AS seam FROM pr GROUP BY 1")
def seam_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.seam_fraction(pairs(spark, sf_dir), 0.6, 0.61)


@register(
    "fill_select",
    f"""WITH {LB_SQL}, m AS (SELECT image_id, label, avg(x) AS mx, avg(y) AS my, avg(v) AS mv, covar_pop(x, x) AS xx, covar_pop(y, y) AS yy, covar_pop(x, y) AS xy, covar_pop(x, v) AS xv, covar_pop(y, v) AS yv FROM px JOIN lb USING (image_id, x, y) GROUP BY 1, 2),
g AS (SELECT *, round(CASE WHEN xx * yy - xy * xy > 1e-9 THEN (xv * yy - yv * xy) / (xx * yy - xy * xy) END, 6) AS gx, round(CASE WHEN xx * yy - xy * xy > 1e-9 THEN (yv * xx - xv * xy) / (xx * yy - xy * xy) END, 6) AS gy,
  CASE WHEN xx * yy - xy * xy > 1e-9 THEN round(mv - (xv * yy - yv * xy) / (xx * yy - xy * xy) * mx - (yv * xx - xv * xy) / (xx * yy - xy * xy) * my, 6) END AS c FROM m),
s AS (SELECT image_id, label, sum(pow(greatest(abs(v - mv) - 0.5 / 255, 0) / 0.02, 2)) AS f, sum(pow(greatest(abs(v - (c + gx * x + gy * y)) - 0.5 / 255, 0) / 0.02, 2)) AS l FROM px JOIN lb USING (image_id, x, y) JOIN g USING (image_id, label) GROUP BY 1, 2),
k AS (SELECT image_id, label, round(0.5 * f + 2.0::DOUBLE * 3, 4) AS a, CASE WHEN l IS NOT NULL THEN round(0.5 * l + 2.0::DOUBLE * 10, 4) END AS b FROM s)
SELECT image_id, label, CASE WHEN b < a THEN 'linear' ELSE 'flat' END AS model, CASE WHEN b < a THEN b ELSE a END AS cost FROM k""",
)
def fill_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tile_pixels(spark, sf_dir).withColumn("label", label_of())
    return M.fill_select(rows, P.linear_fill(rows).withColumn("c", F.when(F.col("gx").isNotNull(), F.col("c"))), 0.02, 2.0)


@register(
    "junction_votes",
    f"""WITH {CRACKS_SQL}, ar AS (SELECT image_id, x0 AS x, y0 AS y, before, after, x0 = x1 AS up FROM ck UNION ALL SELECT image_id, x1, y1, before, after, x0 = x1 FROM ck),
t3 AS (SELECT image_id, x, y, count(*) FILTER (WHERE up) = 2 AS vertical FROM ar GROUP BY 1, 2, 3 HAVING count(*) = 3),
sd AS (SELECT image_id, x, y, unnest([before, after]) AS label, up = vertical AS straight FROM ar JOIN t3 USING (image_id, x, y)),
ov AS (SELECT image_id, x, y, label AS top FROM sd WHERE straight GROUP BY ALL HAVING count(*) = 2),
o1 AS (SELECT image_id, x, y, min(top) AS top FROM ov GROUP BY 1, 2, 3 HAVING count(*) = 1),
vt AS (SELECT DISTINCT o1.image_id, o1.x, o1.y, top, sd.label AS bottom FROM o1 JOIN sd ON o1.image_id = sd.image_id AND o1.x = sd.x AND o1.y = sd.y AND NOT straight AND sd.label <> top),
ks AS (SELECT image_id, least(top, bottom) AS low, greatest(top, bottom) AS high, count(*) FILTER (WHERE top < bottom) AS low_over, count(*) FILTER (WHERE top > bottom) AS high_over FROM vt GROUP BY 1, 2, 3)
SELECT *, CASE WHEN high_over = 0 THEN low WHEN low_over = 0 THEN high END AS occluder FROM ks""",
)
def junction_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = R.cracks(tile_labels(spark, sf_dir))
    return M.junction_votes(segments, R.node_degrees(segments))
