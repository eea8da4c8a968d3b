"""Queries of colour functions, palettes and estimators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import colour as C
from tessera.operators import palette as P
from tessera.plans.registry import register
from tessera.sources.derived import LB_SQL, PX_SQL, RGB_SQL, label_of, rgb_tiles, tile_labels, tile_pixels


def _rgb() -> list:
    return [F.col(x) for x in "rgb"]


def _lin(c: str) -> str:
    return f"(CASE WHEN {c} <= 0.04045 THEN {c} / 12.92 ELSE pow(({c} + 0.055) / 1.055, 2.4) END)"


def _cbrt(x: str) -> str:
    return f"(sign({x}) * pow(abs({x}), 1.0 / 3))"


def _dot(row: tuple[float, ...], names: list[str]) -> str:
    return " + ".join(f"({v!r})::DOUBLE * {n}" for v, n in zip(row, names, strict=True))


LAB_SQL = (
    RGB_SQL
    + f""",
ln1 AS (SELECT *, {_lin("r")} AS lr, {_lin("g")} AS lg, {_lin("b")} AS lb_ FROM rgb),
lm AS (SELECT *, {", ".join(f"{_dot(row, ['lr', 'lg', 'lb_'])} AS m{i}" for i, row in enumerate(C.TO_LMS))} FROM ln1),
lc AS (SELECT *, {", ".join(f"{_cbrt(f'm{i}')} AS c{i}" for i in range(3))} FROM lm),
ok AS (SELECT image_id, x, y, r, g, b, {", ".join(f"{_dot(row, ['c0', 'c1', 'c2'])} AS {n}" for n, row in zip(("ol", "oa", "ob"), C.TO_LAB, strict=True))} FROM lc)"""
)


def oklab_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, x, y, l, a, b."""
    lab = C.srgb_to_oklab(*_rgb())
    return rgb_tiles(spark, sf_dir).select("image_id", "x", "y", *[v.alias(n) for v, n in zip(lab, "lab", strict=True)])


@register("srgb_linear", f"WITH {RGB_SQL} SELECT image_id, x, y, round({_lin('r')}, 9) AS lr, round({_lin('g')}, 9) AS lg, round({_lin('b')}, 9) AS lb FROM rgb")
def srgb_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rgb_tiles(spark, sf_dir).select("image_id", "x", "y", *[F.round(C.srgb_to_linear(F.col(c)), 9).alias(f"l{c}") for c in "rgb"])


@register("oklab", f"WITH {LAB_SQL} SELECT image_id, x, y, round(ol, 6) AS l, round(oa, 6) AS a, round(ob, 6) AS b FROM ok")
def oklab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oklab_tiles(spark, sf_dir).select("image_id", "x", "y", *[F.round(n, 6).alias(n) for n in "lab"])


BACK_SQL = (
    LAB_SQL
    + f""",
bl AS (SELECT image_id, x, y, {", ".join(f"pow({_dot(row, ['ol', 'oa', 'ob'])}, 3) AS m{i}" for i, row in enumerate(C.FROM_LAB))} FROM ok),
bm AS (SELECT image_id, x, y, {", ".join(f"{_dot(row, ['m0', 'm1', 'm2'])} AS v{i}" for i, row in enumerate(C.FROM_LMS))} FROM bl)"""
)


def _encoded(c: str) -> str:
    return f"least(greatest(CASE WHEN {c} <= 0.0031308 THEN {c} * 12.92 ELSE 1.055 * pow(greatest({c}, 0), 1 / 2.4::DOUBLE) - 0.055 END, 0), 1)"


@register("oklab_round_trip", f"WITH {BACK_SQL} SELECT image_id, x, y, {', '.join(f'round({_encoded(f"v{i}")}, 6) AS {c}' for i, c in enumerate('rgb'))} FROM bm")
def oklab_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours after OKLab and back."""
    back = C.oklab_to_srgb(*C.srgb_to_oklab(*_rgb()))
    return rgb_tiles(spark, sf_dir).select("image_id", "x", "y", *[F.round(v, 6).alias(c) for c, v in zip("rgb", back, strict=True)])


def _f(t: str) -> str:
    return f"(CASE WHEN {t} > pow(6.0 / 29, 3) THEN {_cbrt(t)} ELSE {t} / (3 * pow(6.0 / 29, 2)) + 4.0 / 29 END)"


CIE_SQL = (
    RGB_SQL
    + f""",
ln1 AS (SELECT *, {_lin("r")} AS lr, {_lin("g")} AS lg, {_lin("b")} AS lb_ FROM rgb),
xyz AS (SELECT *, {", ".join(f"({_dot(row, ['lr', 'lg', 'lb_'])}) / {w}::DOUBLE AS t{i}" for i, (row, w) in enumerate(zip(C.TO_XYZ, C.WHITE, strict=True)))} FROM ln1),
fx AS (SELECT *, {", ".join(f"{_f(f't{i}')} AS f{i}" for i in range(3))} FROM xyz),
ci AS (SELECT image_id, x, y, 116 * f1 - 16 AS cl, 500 * (f0 - f1) AS ca, 200 * (f1 - f2) AS cb FROM fx)"""
)


@register("cielab", f"WITH {CIE_SQL} SELECT image_id, x, y, round(cl, 6) AS l, round(ca, 6) AS a, round(cb, 6) AS b FROM ci")
def cielab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rgb_tiles(spark, sf_dir).select("image_id", "x", "y", *[F.round(v, 6).alias(n) for v, n in zip(C.srgb_to_cielab(*_rgb()), "lab", strict=True)])


DE_SQL = (
    CIE_SQL
    + """,
d0 AS (SELECT p.image_id, p.x, p.y, p.cl AS l1, p.ca AS a1, p.cb AS b1, q.cl AS l2, q.ca AS a2, q.cb AS b2 FROM ci p JOIN ci q ON p.image_id = q.image_id AND p.y = q.y AND p.x + 1 = q.x),
d1 AS (SELECT *, (sqrt(a1 * a1 + b1 * b1) + sqrt(a2 * a2 + b2 * b2)) / 2 AS cm FROM d0),
d2 AS (SELECT image_id, x, y, l1, b1, l2, b2, a1 * (1 + 0.5 * (1 - sqrt(pow(cm, 7) / (pow(cm, 7) + pow(25.0, 7))))) AS a1, a2 * (1 + 0.5 * (1 - sqrt(pow(cm, 7) / (pow(cm, 7) + pow(25.0, 7))))) AS a2 FROM d1),
d3 AS (SELECT *, sqrt(a1 * a1 + b1 * b1) AS c1, sqrt(a2 * a2 + b2 * b2) AS c2,
  CASE WHEN a1 = 0 AND b1 = 0 THEN 0 WHEN degrees(atan2(b1, a1)) < 0 THEN degrees(atan2(b1, a1)) + 360 ELSE degrees(atan2(b1, a1)) END AS h1,
  CASE WHEN a2 = 0 AND b2 = 0 THEN 0 WHEN degrees(atan2(b2, a2)) < 0 THEN degrees(atan2(b2, a2)) + 360 ELSE degrees(atan2(b2, a2)) END AS h2 FROM d2),
d4 AS (SELECT *, CASE WHEN c1 * c2 = 0 THEN 0 WHEN h2 - h1 > 180 THEN h2 - h1 - 360 WHEN h2 - h1 < -180 THEN h2 - h1 + 360 ELSE h2 - h1 END AS turn,
  CASE WHEN c1 * c2 = 0 THEN h1 + h2 WHEN abs(h1 - h2) > 180 AND h1 + h2 < 360 THEN (h1 + h2 + 360) / 2 WHEN abs(h1 - h2) > 180 THEN (h1 + h2 - 360) / 2 ELSE (h1 + h2) / 2 END AS hm,
  (l1 + l2) / 2 AS lm, (c1 + c2) / 2 AS cm FROM d3),
d5 AS (SELECT *, 1 - 0.17 * cos(radians(hm - 30)) + 0.24 * cos(radians(2 * hm)) + 0.32 * cos(radians(3 * hm + 6)) - 0.20 * cos(radians(4 * hm - 63)) AS t,
  -2 * sqrt(pow(cm, 7) / (pow(cm, 7) + pow(25.0, 7))) * sin(radians(60 * exp(-pow((hm - 275) / 25, 2)))) AS rt FROM d4),
d6 AS (SELECT *, (l2 - l1) / (1 + 0.015 * pow(lm - 50, 2) / sqrt(20 + pow(lm - 50, 2))) AS u, (c2 - c1) / (1 + 0.045 * cm) AS v, 2 * sqrt(c1 * c2) * sin(radians(turn / 2)) / (1 + 0.015 * cm * t) AS w FROM d5)"""
)


@register("ciede2000", f"WITH {DE_SQL} SELECT image_id, x, y, round(sqrt(greatest(u * u + v * v + w * w + rt * v * w, 0)), 5) AS de FROM d6")
def ciede2000(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference of each pixel and the next in its row."""
    from pyspark.sql import Window

    order = Window.partitionBy("image_id", "y").orderBy("x")
    lab = rgb_tiles(spark, sf_dir).select("image_id", "x", "y", *[v.alias(n) for v, n in zip(C.srgb_to_cielab(*_rgb()), "lab", strict=True)])
    pairs = lab.withColumns({f"n{c}": F.lead(c).over(order) for c in "lab"}).filter("nl IS NOT NULL")
    de = C.ciede2000([F.col(c) for c in "lab"], [F.col(f"n{c}") for c in "lab"])
    return pairs.select("image_id", "x", "y", F.round(de, 5).alias("de"))


@register("luma_ycbcr", f"WITH {RGB_SQL}, k AS (SELECT *, 0.299 * r * 255 + 0.587 * g * 255 + 0.114 * b * 255 AS yy FROM rgb) SELECT image_id, x, y, round(yy, 6) AS luma, round(128 + (b * 255 - yy) * (0.5 / 0.886), 6) AS cb, round(128 + (r * 255 - yy) * (0.5 / 0.701), 6) AS cr FROM k")
def luma_ycbcr(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.ycbcr(*[F.col(c) * 255 for c in "rgb"])
    return rgb_tiles(spark, sf_dir).select("image_id", "x", "y", *[F.round(v, 6).alias(n) for v, n in zip(out, ("luma", "cb", "cr"), strict=True)])


@register("hex_colours", f"WITH {RGB_SQL} SELECT image_id, x, y, format('#{{:02x}}{{:02x}}{{:02x}}', CAST(floor(r * 255 + 0.5) AS INT), CAST(floor(g * 255 + 0.5) AS INT), CAST(floor(b * 255 + 0.5) AS INT)) AS hex FROM rgb")
def hex_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rgb_tiles(spark, sf_dir).select("image_id", "x", "y", C.hex_colour(*_rgb()).alias("hex"))


def _enc(c: str) -> str:
    return f"(CASE WHEN {c} <= 0.0031308 THEN {c} * 12.92 ELSE 1.055 * pow({c}, 1 / 2.4::DOUBLE) - 0.055 END)"


@register("composite_over", f"WITH {RGB_SQL}, m AS (SELECT image_id, x, y, {_lin('r')} * g + 1.0 * (1 - g) AS u, {_lin('r')} * g + {_lin('0.5::DOUBLE')} * (1 - g) AS w FROM rgb) SELECT image_id, x, y, round({_enc('u')}, 6) AS over_white, round({_enc('w')}, 6) AS over_grey FROM m")
def composite_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, g = F.col("r"), F.col("g")
    return rgb_tiles(spark, sf_dir).select("image_id", "x", "y", F.round(C.composite_over(r, g, F.lit(1.0)), 6).alias("over_white"), F.round(C.composite_over(r, g, F.lit(0.5)), 6).alias("over_grey"))


@register("distinct_colour_ids", f"WITH {RGB_SQL}, d AS (SELECT image_id, r, g, b, min(y * 8 + x) AS k, count(*) AS n FROM rgb GROUP BY 1, 2, 3, 4) SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY k) - 1 AS INT) AS colour_id, r, g, b, n, CAST(k % 8 AS INT) AS first_x, CAST(k // 8 AS INT) AS first_y FROM d")
def distinct_colour_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.distinct_colours(rgb_tiles(spark, sf_dir))


# Colours are rounded first, so that both engines put them in the same cells.
MD_SQL = LAB_SQL + """,
orr AS (SELECT image_id, x, y, round(ol, 4) + 0.0 AS l, round(oa, 4) + 0.0 AS a, round(ob, 4) + 0.0 AS b FROM ok),
mc AS (SELECT *, CAST(floor(least(greatest(l, 0), 1) * 23 + 0.5) * 576 + floor(least(greatest((a + 0.4) / 0.8, 0), 1) * 23 + 0.5) * 24 + floor(least(greatest((b + 0.4) / 0.8, 0), 1) * 23 + 0.5) AS INT) AS cell FROM orr),
md AS (SELECT image_id, cell, count(*) AS n, floor(sum(CAST(round(l * 10000) AS BIGINT))::BIGINT * 100 / count(*) + 0.5) / 1e6::DOUBLE AS l, floor(sum(CAST(round(a * 10000) AS BIGINT))::BIGINT * 100 / count(*) + 0.5) / 1e6::DOUBLE AS a, floor(sum(CAST(round(b * 10000) AS BIGINT))::BIGINT * 100 / count(*) + 0.5) / 1e6::DOUBLE AS b FROM mc GROUP BY 1, 2),
mr AS (SELECT *, CAST(row_number() OVER (PARTITION BY image_id ORDER BY n DESC, cell) AS INT) AS rank FROM md),
ik AS (SELECT image_id, rank - 1 AS ink_id, l, a, b FROM mr WHERE rank <= 4)"""


def rounded_lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oklab_tiles(spark, sf_dir).select("image_id", "x", "y", *[(F.round(n, 4) + 0.0).alias(n) for n in "lab"])


def inks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four commonest modes of each tile."""
    return P.frequency_modes(rounded_lab(spark, sf_dir)).filter("rank <= 4").select("image_id", (F.col("rank") - 1).alias("ink_id"), *"lab")


@register("frequency_modes", f"WITH {MD_SQL} SELECT * FROM mr")
def frequency_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.frequency_modes(rounded_lab(spark, sf_dir))


NI_SQL = MD_SQL + """,
nd AS (SELECT p.*, i.ink_id, round((p.l - i.l) * (p.l - i.l) + (p.a - i.a) * (p.a - i.a) + (p.b - i.b) * (p.b - i.b), 12) AS d2 FROM orr p JOIN ik i USING (image_id)),
ni AS (SELECT * FROM nd QUALIFY row_number() OVER (PARTITION BY image_id, x, y ORDER BY d2, ink_id) = 1)"""


@register("nearest_ink", f"WITH {NI_SQL} SELECT * FROM ni")
def nearest_ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.nearest_ink(rounded_lab(spark, sf_dir), inks(spark, sf_dir))


@register("refine_members", f"WITH {NI_SQL}, t AS (SELECT image_id, count(*) AS total FROM ni GROUP BY 1) SELECT image_id, ink_id, round(avg(l), 9) AS l, round(avg(a), 9) AS a, round(avg(b), 9) AS b, round(count(*) / any_value(total), 9) AS weight FROM ni JOIN t USING (image_id) WHERE d2 <= 0.12::DOUBLE * 0.12::DOUBLE GROUP BY 1, 2")
def refine_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.refine_members(P.nearest_ink(rounded_lab(spark, sf_dir), inks(spark, sf_dir)), 0.12)


_T = "least(greatest(((p.l - i.l) * (j.l - i.l) + (p.a - i.a) * (j.a - i.a) + (p.b - i.b) * (j.b - i.b)) / nullif(pow(j.l - i.l, 2) + pow(j.a - i.a, 2) + pow(j.b - i.b, 2), 0), 0), 1)"


@register("mixture_pairs", f"WITH {MD_SQL}, mt AS (SELECT p.*, i.ink_id AS a_id, j.ink_id AS b_id, i.l AS il, i.a AS ia, i.b AS ib, j.l AS jl, j.a AS ja, j.b AS jb, coalesce({_T}, 0) AS t FROM orr p JOIN ik i USING (image_id) JOIN ik j ON j.image_id = p.image_id AND i.ink_id < j.ink_id), ms AS (SELECT image_id, x, y, a_id, b_id, round(sqrt(pow(l - il - t * (jl - il), 2) + pow(a - ia - t * (ja - ia), 2) + pow(b - ib - t * (jb - ib), 2)), 6) AS residual, CASE WHEN t < 0.5 THEN a_id ELSE b_id END AS dominant FROM mt) SELECT * FROM ms QUALIFY row_number() OVER (PARTITION BY image_id, x, y ORDER BY residual, a_id, b_id) = 1")
def mixture_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.mixture_pairs(rounded_lab(spark, sf_dir), inks(spark, sf_dir))


@register("straddle_fraction", f"WITH {LB_SQL}, s AS (SELECT a.image_id, a.x, a.y, a.label, max((b.label <> a.label)::INT) AS m FROM lb a JOIN lb b ON a.image_id = b.image_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY 1, 2, 3, 4) SELECT image_id, label, round(avg(m), 6) AS straddle, count(*) AS n FROM s GROUP BY 1, 2")
def straddle_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.straddle_fraction(tile_labels(spark, sf_dir))


@register("noise_sigma", f"WITH {PX_SQL}, h AS (SELECT image_id, round(abs(4 * v - lag(v) OVER r - lag(v) OVER c - lead(v) OVER r - lead(v) OVER c), 12) AS h FROM px WINDOW r AS (PARTITION BY image_id, y ORDER BY x), c AS (PARTITION BY image_id, x ORDER BY y)), k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY h) - 1 AS i, count(*) OVER (PARTITION BY image_id) AS n FROM h WHERE h IS NOT NULL) SELECT image_id, round(greatest(h / 0.12566 / sqrt(20), 0.5 / 255::DOUBLE), 9) AS sigma FROM k WHERE i = floor(n * 0.10::DOUBLE)")
def noise_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.noise_sigma(tile_pixels(spark, sf_dir))


@register("weighted_lower_median", f"WITH {PX_SQL}, w AS (SELECT image_id, round(v, 2) AS v, CAST(sum(x + 1) AS BIGINT) AS w FROM px GROUP BY 1, 2), u AS (SELECT *, sum(w) OVER (PARTITION BY image_id ORDER BY v) AS upto, floor(sum(w) OVER (PARTITION BY image_id) / 2) AS half FROM w) SELECT image_id, min(v) AS median FROM u WHERE upto > half GROUP BY 1")
def weighted_lower_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tile_pixels(spark, sf_dir).select("image_id", F.round("v", 2).alias("v"), (F.col("x") + 1).alias("w"))
    return P.weighted_lower_median(rows, ["image_id"], "v", "w")


GR_SQL = PX_SQL + """,
gd AS (SELECT image_id, x, y, (coalesce(lead(v) OVER r, v) - coalesce(lag(v) OVER r, v)) / greatest((x > 0)::INT + (x < 7)::INT, 1) AS gx, (coalesce(lead(v) OVER c, v) - coalesce(lag(v) OVER c, v)) / greatest((y > 0)::INT + (y < 7)::INT, 1) AS gy
       FROM px WINDOW r AS (PARTITION BY image_id, y ORDER BY x), c AS (PARTITION BY image_id, x ORDER BY y)),
gr AS (SELECT image_id, x, y, round(gx, 6) AS gx, round(gy, 6) AS gy, round(sqrt(gx * gx + gy * gy), 6) AS magnitude FROM gd)"""


@register("gradient_magnitude", f"WITH {GR_SQL} SELECT * FROM gr")
def gradient_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.gradient(tile_pixels(spark, sf_dir))


@register("positional_sigma", f"WITH {GR_SQL} SELECT image_id, x, y, round(least(greatest(sqrt(pow(0.02 / greatest(magnitude, 1e-9), 2) + 0.1 * 0.1), 0.001), 4.0), 6) AS sigma FROM gr")
def positional_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.gradient(tile_pixels(spark, sf_dir)).select("image_id", "x", "y", F.round(P.positional_sigma(F.col("magnitude"), F.lit(0.02), 0.1), 6).alias("sigma"))


@register("grid_contrast", f"WITH {PX_SQL}, s AS (SELECT image_id, x % 2 AS phase, abs(lag(v) OVER r - 2 * v + lead(v) OVER r) AS d FROM px WINDOW r AS (PARTITION BY image_id, y ORDER BY x)) SELECT image_id, phase, round(avg(d), 6) AS mean, count(*) AS n FROM s WHERE d IS NOT NULL GROUP BY 1, 2")
def grid_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.grid_contrast(tile_pixels(spark, sf_dir), 2)


@register("shading_share", f"WITH {GR_SQL} SELECT image_id, round(avg((magnitude > 0.05 AND magnitude < 0.2)::INT), 6) AS shading FROM gr GROUP BY 1")
def shading_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.shading_share(P.gradient(tile_pixels(spark, sf_dir)), 0.05, 0.2)


@register("description_lambdas", f"WITH {PX_SQL} SELECT image_id, round(ln(greatest((max(v) - min(v)) / 0.1, exp(1))), 6) AS precision_lambda, round(0.5 * ln(greatest(count(*), 2)), 6) AS bic_lambda FROM px GROUP BY 1")
def description_lambdas(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = tile_pixels(spark, sf_dir).groupBy("image_id").agg((F.max("v") - F.min("v")).alias("extent"), F.count(F.lit(1)).alias("n"))
    return one.select("image_id", F.round(P.precision_lambda(F.col("extent"), 0.1), 6).alias("precision_lambda"), F.round(P.bic_lambda(F.col("n")), 6).alias("bic_lambda"))


@register("psnr", f"WITH {PX_SQL}, m AS (SELECT image_id, avg(pow(v - round(v, 1), 2)) AS mse FROM px GROUP BY 1) SELECT image_id, round(mse, 9) AS mse, CASE WHEN mse > 0 THEN round(10 * log10(1 / nullif(mse, 0)), 6) END AS psnr FROM m")
def psnr(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tile_pixels(spark, sf_dir)
    return P.psnr(p, p.withColumn("v", F.round("v", 1)))


@register("linear_fill_fit", f"WITH {LB_SQL}, m AS (SELECT image_id, label, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(v) AS mv, covar_pop(x, x) AS xx, covar_pop(y, y) AS yy, covar_pop(x, y) AS xy, covar_pop(x, v) AS xv, covar_pop(y, v) AS yv, covar_pop(v, v) AS vv FROM px JOIN lb USING (image_id, x, y) GROUP BY 1, 2), g AS (SELECT *, CASE WHEN xx * yy - xy * xy > 1e-9 THEN (xv * yy - yv * xy) / (xx * yy - xy * xy) END AS gx, CASE WHEN xx * yy - xy * xy > 1e-9 THEN (yv * xx - xv * xy) / (xx * yy - xy * xy) END AS gy FROM m) SELECT image_id, label, n, round(gx, 6) AS gx, round(gy, 6) AS gy, round(mv - gx * mx - gy * my, 6) AS c, CASE WHEN gx IS NULL THEN 0.0 ELSE round(greatest(vv - gx * xv - gy * yv, 0) * n, 6) END AS sse FROM g")
def linear_fill_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.linear_fill(tile_pixels(spark, sf_dir).withColumn("label", label_of()))
