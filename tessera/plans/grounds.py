"""Queries of colours over two grounds, of names, and of palettes walked in order."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import colour as C
from tessera.operators import dense as D
from tessera.operators import palette as P
from tessera.plans.colours import LAB_SQL, MD_SQL, _cbrt, _dot, _lin, rounded_lab
from tessera.plans.dense import tile_images
from tessera.plans.registry import register
from tessera.sources.derived import RGB_SQL, rgb_tiles

_HUES = " ".join(f"WHEN h < {most} THEN '{name}'" for most, name in C.HUE_NAMES)
_GREYS = " ".join(f"WHEN l > {least} THEN '{name}'" for least, name in C.GREY_NAMES)


@register("colour_names", f"""WITH {LAB_SQL}, o AS (SELECT image_id, x, y, round(ol, 4) + 0.0 AS l, round(oa, 4) + 0.0 AS a, round(ob, 4) + 0.0 AS b FROM ok),
h AS (SELECT *, CASE WHEN degrees(atan2(b, a)) < 0 THEN degrees(atan2(b, a)) + 360 ELSE degrees(atan2(b, a)) END AS h FROM o),
n AS (SELECT *, CASE {_HUES} ELSE 'red' END AS word FROM h)
SELECT image_id, x, y, CASE WHEN sqrt(a * a + b * b) < 0.03 THEN CASE {_GREYS} ELSE 'black' END WHEN word IN ('red', 'orange') AND l < 0.5 THEN 'brown' ELSE word END AS name FROM n""")
def colour_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_lab(spark, sf_dir).select("image_id", "x", "y", C.colour_name(*[F.col(c) for c in "lab"]).alias("name"))


def translucent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, x, y, alpha and each channel over white (w) and grey (k): tiles whose green is their opacity too."""
    t = rgb_tiles(spark, sf_dir).withColumn("alpha", F.col("g"))
    t = t.withColumns({f"w{c}": C.on_white(F.col(c), F.col("alpha")) for c in "rgb"})
    return t.withColumns({f"k{c}": C.on_grey(F.col(f"w{c}"), F.col("alpha")) for c in "rgb"})


WK_SQL = RGB_SQL + """,
wt AS (SELECT image_id, x, y, g AS alpha, r * g + (1 - g) AS wr, g * g + (1 - g) AS wg, b * g + (1 - g) AS wb FROM rgb),
wk AS (SELECT *, greatest(wr - (1 - alpha) * 0.5, 0) AS kr, greatest(wg - (1 - alpha) * 0.5, 0) AS kg, greatest(wb - (1 - alpha) * 0.5, 0) AS kb FROM wt)"""


@register("on_white", f"WITH {WK_SQL} SELECT image_id, x, y, round(wr, 6) AS r, round(wg, 6) AS g, round(wb, 6) AS b, round(1 - alpha, 6) AS show_through, round(0.299 * wr + 0.587 * wg + 0.114 * wb, 10) AS luma FROM wk")
def on_white(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels over white, how much of the ground shows, and the luma that a lossy file keeps whole."""
    t = translucent(spark, sf_dir)
    return t.select("image_id", "x", "y", *[F.round(f"w{c}", 6).alias(c) for c in "rgb"], F.round(1 - F.col("alpha"), 6).alias("show_through"), F.round(C.luma(*[F.col(f"w{c}") for c in "rgb"]), 10).alias("luma"))


@register("two_ground_alpha", f"WITH {WK_SQL}, a AS (SELECT image_id, x, y, least(greatest(1 - ((wr - kr) + (wg - kg) + (wb - kb)) / 3 / 0.5, 0), 1) AS a FROM wk) SELECT image_id, x, y, round(CASE WHEN a > 0.995 THEN 1 WHEN a < 0.005 THEN 0 ELSE a END, 6) AS alpha FROM a")
def two_ground_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    alpha = C.two_ground_alpha([F.col(f"w{c}") for c in "rgb"], [F.col(f"k{c}") for c in "rgb"])
    return translucent(spark, sf_dir).select("image_id", "x", "y", F.round(alpha, 6).alias("alpha"))


def _lab_sql(source: str, out: str, p: str) -> str:
    return f"""{out}1 AS (SELECT *, {_lin(p + "r")} AS q0, {_lin(p + "g")} AS q1, {_lin(p + "b")} AS q2 FROM {source}),
{out}2 AS (SELECT * EXCLUDE (q0, q1, q2), {", ".join(f"{_cbrt('(' + _dot(row, ['q0', 'q1', 'q2']) + ')')} AS m{i}" for i, row in enumerate(C.TO_LMS))} FROM {out}1),
{out} AS (SELECT * EXCLUDE (m0, m1, m2), {", ".join(f"{_dot(row, ['m0', 'm1', 'm2'])} AS {p}{n}" for n, row in zip(("l", "a", "o"), C.TO_LAB, strict=True))} FROM {out}2)"""


@register(
    "two_ground_distance",
    f"""WITH {WK_SQL}, {_lab_sql("wk", "lw", "w")}, {_lab_sql("lw", "lk", "k")}
SELECT p.image_id, p.x, p.y, round(greatest(sqrt(pow(p.wl - q.wl, 2) + pow(p.wa - q.wa, 2) + pow(p.wo - q.wo, 2)), sqrt(pow(p.kl - q.kl, 2) + pow(p.ka - q.ka, 2) + pow(p.ko - q.ko, 2))), 6) AS distance
FROM lk p JOIN lk q ON p.image_id = q.image_id AND p.y = q.y AND p.x + 1 = q.x""",
)
def two_ground_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each pixel is from the next in its row, over the ground that tells them apart better."""
    t = translucent(spark, sf_dir)
    points = [*C.srgb_to_oklab(*[F.col(f"w{c}") for c in "rgb"]), *C.srgb_to_oklab(*[F.col(f"k{c}") for c in "rgb"])]
    t = t.select("image_id", "x", "y", *[v.alias(f"p{i}") for i, v in enumerate(points)])
    order = Window.partitionBy("image_id", "y").orderBy("x")
    pairs = t.withColumns({f"q{i}": F.lead(f"p{i}").over(order) for i in range(6)}).filter("q0 IS NOT NULL")
    d = C.two_ground_distance([F.col(f"p{i}") for i in range(6)], [F.col(f"q{i}") for i in range(6)])
    return pairs.select("image_id", "x", "y", F.round(d, 6).alias("distance"))


WALK_SQL = MD_SQL + """,
wl AS (SELECT image_id, rank, l, a, b, n FROM mr),
rw AS (SELECT image_id, rank, [{'l': l, 'a': a, 'b': b, 'rank': rank}] AS inks FROM wl WHERE rank = 1
       UNION ALL SELECT wl.image_id, wl.rank, CASE WHEN len(rw.inks) < 16 AND len(list_filter(rw.inks, lambda i: round(sqrt(pow(i.l - wl.l, 2) + pow(i.a - wl.a, 2) + pow(i.b - wl.b, 2)), 9) <= 0.12)) = 0
         THEN list_append(rw.inks, {'l': wl.l, 'a': wl.a, 'b': wl.b, 'rank': wl.rank}) ELSE rw.inks END
       FROM rw JOIN wl ON wl.image_id = rw.image_id AND wl.rank = rw.rank + 1),
wi AS (SELECT image_id, unnest(arg_max(inks, rank)) AS i, generate_subscripts(arg_max(inks, rank), 1) - 1 AS ink_id FROM rw GROUP BY 1),
pk AS (SELECT image_id, CAST(ink_id AS INT) AS ink_id, i.rank AS rank, i.l AS l, i.a AS a, i.b AS b FROM wi)"""


def walked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.walked_palette(P.frequency_modes(rounded_lab(spark, sf_dir)), 0.12, 16)


@register("palette_walk", f"WITH RECURSIVE {WALK_SQL} SELECT * FROM pk")
def palette_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modes by count, each an ink unless it lies within a distance of one before it."""
    return walked(spark, sf_dir)


@register(
    "claim_spread",
    f"""WITH RECURSIVE {WALK_SQL},
cd AS (SELECT image_id, rank, l, a, b FROM mr WHERE rank BETWEEN 2 AND 6),
dq AS (SELECT p.image_id, p.x, p.y, c.rank, round(sqrt(pow(p.l - c.l, 2) + pow(p.a - c.a, 2) + pow(p.b - c.b, 2)), 9) AS d,
         (SELECT min(round(sqrt(pow(p.l - e.l, 2) + pow(p.a - e.a, 2) + pow(p.b - e.b, 2)), 9)) FROM mr e WHERE e.image_id = p.image_id AND e.rank < c.rank) AS best FROM orr p JOIN cd c USING (image_id)),
cl AS (SELECT * FROM dq WHERE d < best),
md2 AS (SELECT *, row_number() OVER (PARTITION BY image_id, rank ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY image_id, rank) AS m FROM cl WHERE d < 0.12),
sp AS (SELECT image_id, rank, min(d) AS spread FROM md2 WHERE i = m // 2 GROUP BY 1, 2),
it AS (SELECT c.image_id, c.rank, c.x, c.y, 4 - (c.x = 0)::INT - (c.x = 7)::INT - (c.y = 0)::INT - (c.y = 7)::INT AS need, count(n.x) AS have FROM cl c LEFT JOIN cl n ON n.image_id = c.image_id AND n.rank = c.rank AND abs(n.x - c.x) + abs(n.y - c.y) = 1 GROUP BY ALL),
ag AS (SELECT image_id, rank, count(*) AS claim, round(avg((have = need)::INT), 6) AS interior FROM it GROUP BY 1, 2)
SELECT cd.image_id, cd.rank, coalesce(claim, 0) AS claim, coalesce(spread, 0) AS spread, coalesce(interior, 0) AS interior FROM cd LEFT JOIN ag USING (image_id, rank) LEFT JOIN sp USING (image_id, rank)""",
)
def claim_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the second to sixth mode would take from those before: pixels, their median distance, the share inside."""
    lab = rounded_lab(spark, sf_dir)
    return P.claims(lab, P.frequency_modes(lab).filter("rank <= 6"), 0.12, 8, 8).select("image_id", "rank", "claim", "spread", "interior")


@register("palette_mdl")
def palette_mdl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The walk with the description-length escape; tests compare it with the walk written out."""
    lab = rounded_lab(spark, sf_dir)
    return P.mdl_palette(lab, P.frequency_modes(lab), merge=0.2, sigma=0.05, weight=4.0, floor=0.012, most=16)


@register("palette_size")
def palette_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many colours a viewer would count; tests compare it with plain loops."""
    return D.per_image(tile_images(spark, sf_dir), ["r", "g", "b"], lambda *c: ([P.palette_size(np.stack([x.ravel() for x in c], axis=1), 2.0)],), "colours int")
