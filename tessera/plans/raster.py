"""Queries over label maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import regions as R
from tessera.plans.registry import register
from tessera.sources.derived import LB2_SQL, LB_SQL, PX_SQL, SIDE, label_of, read, tile_labels, tile_pixels

CUTS2 = (-0.05, 0.1)


def label_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("image_id"), F.transform("embedding", lambda v: F.when(v.cast("double") < -0.08, 0).when(v.cast("double") < 0.08, 1).otherwise(2)).alias("labels"))


# Components by recursion: least pixel numbers spread to equal neighbours.
CC_SQL = LB_SQL + """,
st AS (SELECT image_id, x, y, label, y * 8 + x AS k FROM lb),
ed AS (SELECT a.image_id, a.k AS u, b.k AS w FROM st a JOIN st b ON a.image_id = b.image_id AND a.label = b.label AND abs(a.x - b.x) + abs(a.y - b.y) = 1),
rc AS (SELECT image_id, k AS u, k AS root FROM st UNION SELECT rc.image_id, ed.w AS u, rc.root FROM rc JOIN ed ON rc.image_id = ed.image_id AND rc.u = ed.u WHERE rc.root < ed.w),
lw AS (SELECT image_id, u, min(root) AS root FROM rc GROUP BY 1, 2),
cc AS (SELECT s.image_id, s.x, s.y, s.label, CAST(dense_rank() OVER (PARTITION BY s.image_id ORDER BY l.root) - 1 AS INT) AS component
       FROM st s JOIN lw l ON s.image_id = l.image_id AND s.k = l.u)"""


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.components(label_arrays(spark, sf_dir), SIDE, SIDE)


@register(
    "region_census",
    f"WITH RECURSIVE {CC_SQL}, "
    """sz AS (SELECT image_id, component, label, count(*) AS size FROM cc GROUP BY ALL),
ag AS (SELECT image_id, count(*) AS regions, max(size) AS largest, count(*) FILTER (WHERE label = 0) AS dark, count(*) FILTER (WHERE label = 2) AS light FROM sz GROUP BY image_id),
pr AS (SELECT a.image_id, sum(CASE WHEN abs(a.x - b.x) + abs(a.y - b.y) = 1 THEN 1 ELSE 1 / sqrt(2) END) AS n
       FROM lb a JOIN lb b ON a.image_id = b.image_id AND a.label <> b.label AND (b.y = a.y AND b.x = a.x + 1 OR b.y = a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1) GROUP BY 1)
SELECT ag.*, round(coalesce(n, 0) * pi() / 8, 6) AS length FROM ag LEFT JOIN pr USING (image_id)""",
)
def region_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many regions each tile has, how large, and how long their boundaries are."""
    sizes = R.component_sizes(_components(spark, sf_dir))
    counts = sizes.groupBy("image_id").agg(F.count(F.lit(1)).alias("regions"), F.max("size").alias("largest"), F.sum((F.col("label") == 0).cast("long")).alias("dark"), F.sum((F.col("label") == 2).cast("long")).alias("light"))
    return counts.join(R.boundary_length(tile_labels(spark, sf_dir)), "image_id")


@register("tile_pixels", f"WITH {PX_SQL} SELECT * FROM px")
def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tile_pixels(spark, sf_dir)


@register("tile_components", f"WITH RECURSIVE {CC_SQL} SELECT * FROM cc")
def tile_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _components(spark, sf_dir)


@register("component_sizes", f"WITH RECURSIVE {CC_SQL} SELECT image_id, component, min(label) AS label, count(*) AS size, CAST(min(y * 8 + x) % 8 AS INT) AS first_x, CAST(min(y * 8 + x) // 8 AS INT) AS first_y FROM cc GROUP BY 1, 2")
def component_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.component_sizes(_components(spark, sf_dir))


RUNS_SQL = LB_SQL + """,
ch AS (SELECT *, CASE WHEN lag(label) OVER w IS DISTINCT FROM label THEN 1 ELSE 0 END AS c FROM lb WINDOW w AS (PARTITION BY image_id, y ORDER BY x)),
nr AS (SELECT *, CAST(sum(c) OVER (PARTITION BY image_id, y ORDER BY x) AS INT) AS run FROM ch),
rn AS (SELECT image_id, y, run, min(x) AS x0, max(x) + 1 AS x1, min(label) AS label FROM nr GROUP BY 1, 2, 3)"""


@register("tile_runs", f"WITH {RUNS_SQL} SELECT * FROM rn")
def tile_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.row_runs(tile_labels(spark, sf_dir))


@register("run_overlaps", f"WITH {RUNS_SQL} SELECT a.image_id, a.y, a.run AS upper, b.run AS lower, greatest(a.x0, b.x0) AS x0, least(a.x1, b.x1) AS x1 FROM rn a JOIN rn b ON a.image_id = b.image_id AND a.y + 1 = b.y AND a.x0 < b.x1 AND b.x0 < a.x1")
def run_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.run_overlaps(R.row_runs(tile_labels(spark, sf_dir)))


SIDES_SQL = """SELECT a.image_id, a.label AS p, b.label AS q FROM lb a JOIN lb b ON a.image_id = b.image_id AND (a.y = b.y AND a.x + 1 = b.x OR a.x = b.x AND a.y + 1 = b.y)"""


@register("tile_contacts", f"WITH {LB_SQL}, sd AS ({SIDES_SQL}) SELECT image_id, least(p, q) AS low, greatest(p, q) AS high, count(*) AS sides FROM sd WHERE p <> q GROUP BY 1, 2, 3")
def tile_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.contacts(tile_labels(spark, sf_dir))


TALLY_SQL = CC_SQL + """,
ta AS (SELECT a.image_id, a.component, a.label, b.label AS neighbour, count(*) AS sides
       FROM cc a JOIN cc b ON a.image_id = b.image_id AND abs(a.x - b.x) + abs(a.y - b.y) = 1 AND a.component <> b.component GROUP BY 1, 2, 3, 4),
cn AS (SELECT image_id, component, neighbour, sides FROM ta QUALIFY row_number() OVER (PARTITION BY image_id, component ORDER BY sides DESC, neighbour) = 1)"""


@register("contact_tally", f"WITH RECURSIVE {TALLY_SQL} SELECT * FROM ta")
def contact_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.contact_tally(_components(spark, sf_dir))


@register("commonest_neighbour", f"WITH RECURSIVE {TALLY_SQL} SELECT * FROM cn")
def commonest_neighbour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.commonest_neighbour(_components(spark, sf_dir))


@register("region_adjacency", f"WITH RECURSIVE {CC_SQL} SELECT a.image_id, least(a.component, b.component) AS low, greatest(a.component, b.component) AS high, count(*) AS sides FROM cc a JOIN cc b ON a.image_id = b.image_id AND (a.y = b.y AND a.x + 1 = b.x OR a.x = b.x AND a.y + 1 = b.y) AND a.component <> b.component GROUP BY 1, 2, 3")
def region_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.contacts(_components(spark, sf_dir), "component")


@register("despeckle_isolated", f"WITH RECURSIVE {TALLY_SQL}, sz AS (SELECT image_id, component FROM cc GROUP BY 1, 2 HAVING count(*) < 3) SELECT cc.image_id, cc.x, cc.y, coalesce(m.neighbour, cc.label) AS label FROM cc LEFT JOIN (SELECT cn.* FROM cn JOIN sz USING (image_id, component)) m USING (image_id, component)")
def despeckle_isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.despeckle_isolated(_components(spark, sf_dir), 3)


@register("despeckle")
def despeckle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In-order despeckling; tests compare it with brute force."""
    return R.despeckled(label_arrays(spark, sf_dir), SIDE, SIDE, 3)


CRACKS_SQL = LB_SQL + """,
fr AS (SELECT i.image_id, gx AS x, gy AS y, coalesce(l.label, 65535) AS label FROM (SELECT DISTINCT image_id FROM lb) i, range(-1, 9) AS tx(gx), range(-1, 9) AS ty(gy)
       LEFT JOIN lb l ON l.image_id = i.image_id AND l.x = gx AND l.y = gy),
ck AS (SELECT a.image_id, CAST(a.x + 1 AS INT) AS x0, CAST(a.y AS INT) AS y0, CAST(a.x + 1 AS INT) AS x1, CAST(a.y + 1 AS INT) AS y1, a.label AS before, b.label AS after FROM fr a JOIN fr b ON a.image_id = b.image_id AND a.y = b.y AND a.x + 1 = b.x AND a.label <> b.label
       UNION ALL SELECT a.image_id, CAST(a.x AS INT), CAST(a.y + 1 AS INT), CAST(a.x + 1 AS INT), CAST(a.y + 1 AS INT), a.label, b.label FROM fr a JOIN fr b ON a.image_id = b.image_id AND a.x = b.x AND a.y + 1 = b.y AND a.label <> b.label)"""


@register("tile_cracks", f"WITH {CRACKS_SQL} SELECT * FROM ck")
def tile_cracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.cracks(tile_labels(spark, sf_dir))


@register("node_degrees", f"WITH {CRACKS_SQL}, nd AS (SELECT image_id, x0 AS x, y0 AS y FROM ck UNION ALL SELECT image_id, x1, y1 FROM ck) SELECT image_id, x, y, count(*) AS degree FROM nd GROUP BY 1, 2, 3")
def node_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.node_degrees(R.cracks(tile_labels(spark, sf_dir)))


@register("tile_boundary_length", f"WITH {LB_SQL} SELECT i.image_id, round(coalesce(n, 0) * pi() / 8, 6) AS length FROM (SELECT DISTINCT image_id FROM lb) i LEFT JOIN (SELECT a.image_id, sum(CASE WHEN abs(a.x - b.x) + abs(a.y - b.y) = 1 THEN 1 ELSE 1 / sqrt(2) END) AS n FROM lb a JOIN lb b ON a.image_id = b.image_id AND a.label <> b.label AND (b.y = a.y AND b.x = a.x + 1 OR b.y = a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1) GROUP BY 1) USING (image_id)")
def tile_boundary_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.boundary_length(tile_labels(spark, sf_dir))


@register("bbox_by_label", f"WITH {LB_SQL} SELECT image_id, label, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, count(*) AS area FROM lb GROUP BY 1, 2")
def bbox_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.bounding_boxes(tile_labels(spark, sf_dir))


@register("interior_counts", f"WITH {LB_SQL}, ns AS (SELECT a.image_id, a.label, a.x, a.y, count(*) FILTER (WHERE b.label = a.label) AS n FROM lb a JOIN lb b ON a.image_id = b.image_id AND abs(a.x - b.x) + abs(a.y - b.y) = 1 GROUP BY ALL) SELECT image_id, label, count(*) FILTER (WHERE n = 4) AS interior, count(*) FILTER (WHERE n < 4) AS border FROM ns GROUP BY 1, 2")
def interior_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.interior_counts(tile_labels(spark, sf_dir))


@register("saddle_corners", f"WITH {LB_SQL} SELECT a.image_id, a.x + 1 AS x, a.y + 1 AS y, a.label = d.label AS main, b.label = c.label AS cross FROM lb a JOIN lb b ON b.image_id = a.image_id AND b.x = a.x + 1 AND b.y = a.y JOIN lb c ON c.image_id = a.image_id AND c.x = a.x AND c.y = a.y + 1 JOIN lb d ON d.image_id = a.image_id AND d.x = a.x + 1 AND d.y = a.y + 1 WHERE a.label = d.label AND b.label <> a.label AND c.label <> a.label OR b.label = c.label AND a.label <> b.label AND d.label <> b.label")
def saddle_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.saddle_corners(tile_labels(spark, sf_dir))


CT_SQL = LB2_SQL + ", ct AS (SELECT a.image_id, a.label AS g, b.label AS o, count(*) AS n FROM lb a JOIN lb2 b ON a.image_id = b.image_id AND a.x = b.x AND a.y = b.y GROUP BY 1, 2, 3)"


@register("contingency", f"WITH {CT_SQL} SELECT * FROM ct")
def contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.contingency(tile_labels(spark, sf_dir), tile_labels(spark, sf_dir, CUTS2))


@register(
    "contingency_class",
    f"""WITH {CT_SQL}, os AS (SELECT image_id, o, CAST(sum(n) AS BIGINT) AS own FROM ct GROUP BY 1, 2),
bk AS (SELECT image_id, o AS backdrop FROM os QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY own DESC, o) = 1),
rk AS (SELECT ct.*, own, backdrop, CAST(sum(n) OVER g AS BIGINT) AS area, row_number() OVER (PARTITION BY image_id, g ORDER BY n DESC, o) AS k FROM ct JOIN os USING (image_id, o) JOIN bk USING (image_id) WINDOW g AS (PARTITION BY image_id, g)),
pc AS (SELECT *, count(*) FILTER (WHERE n >= 0.1::DOUBLE * area) OVER (PARTITION BY image_id, g) AS pieces FROM rk)
SELECT image_id, g, o AS best, area, round(n / area, 6) AS cover, round(n / own, 6) AS share, pieces,
  CASE WHEN o = backdrop OR n / area < 0.3 THEN CASE WHEN pieces >= 2 THEN 'shattered' ELSE 'missing' END
       WHEN n / area >= 0.6 AND n / own >= 0.5 THEN 'matched' WHEN n / area >= 0.6 THEN 'absorbed' WHEN pieces >= 2 THEN 'shattered' ELSE 'absorbed' END AS class
FROM pc WHERE k = 1 AND area >= 4""",
)
def contingency_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.region_classes(R.contingency(tile_labels(spark, sf_dir), tile_labels(spark, sf_dir, CUTS2)))


@register("mirror_detect", f"WITH {LB_SQL}, mm AS (SELECT a.image_id, count(*) FILTER (WHERE b.y = a.y AND b.x = 7 - a.x AND a.label <> b.label) AS off_x, count(*) FILTER (WHERE b.x = a.x AND b.y = 7 - a.y AND a.label <> b.label) AS off_y, count(*) FILTER (WHERE b.x = 7 - a.x AND b.y = 7 - a.y AND a.label <> b.label) AS off_turn FROM lb a JOIN lb b ON a.image_id = b.image_id GROUP BY 1) SELECT *, off_x > 0 AND off_y > 0 AND off_turn = 0 AS half_turn FROM mm")
def mirror_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.mirrors(tile_labels(spark, sf_dir), SIDE, SIDE)


def _thin_sql(source: str, one: str, two: str) -> str:
    cells = {"n": (0, -1), "ne": (1, -1), "e": (1, 0), "se": (1, 1), "s": (0, 1), "sw": (-1, 1), "w": (-1, 0), "nw": (-1, -1)}
    names = list(cells)
    at = ", ".join(f'max(b."on") FILTER (WHERE b.x = a.x + {dx} AND b.y = a.y + {dy}) AS {k}' for k, (dx, dy) in cells.items())
    turns = " + ".join(f"CASE WHEN {a} = 0 AND {b} = 1 THEN 1 ELSE 0 END" for a, b in zip(names, names[1:] + names[:1], strict=True))
    return f"""SELECT image_id, x, y, CASE WHEN "on" = 1 AND {" + ".join(names)} BETWEEN 2 AND 6 AND {turns} = 1 AND {one} = 0 AND {two} = 0 THEN 0 ELSE "on" END AS "on"
    FROM (SELECT a.image_id, a.x, a.y, a."on", {at} FROM {source} a JOIN {source} b ON a.image_id = b.image_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY ALL)"""


@register("thinning_round", f"""WITH {PX_SQL}, ik AS (SELECT image_id, x, y, CASE WHEN v > -0.05 THEN 1 ELSE 0 END AS "on" FROM px), t1 AS ({_thin_sql("ik", "n * e * s", "e * s * w")}) {_thin_sql("t1", "n * e * w", "n * s * w")}""")
def thinning_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    ink = tile_pixels(spark, sf_dir).select("image_id", "x", "y", F.when(F.col("v") > -0.05, 1).otherwise(0).alias("on"))
    return R.thinning_pass(R.thinning_pass(ink, False), True)


@register("potts_energy", f"WITH {LB_SQL}, pv AS (SELECT px.*, label FROM px JOIN lb USING (image_id, x, y)), dv AS (SELECT image_id, v - avg(v) OVER (PARTITION BY image_id, label) AS d FROM pv), da AS (SELECT image_id, sum(d * d) AS data FROM dv GROUP BY 1), sd AS ({SIDES_SQL}), ss AS (SELECT image_id, count(*) FILTER (WHERE p <> q) AS sides FROM sd GROUP BY 1) SELECT image_id, round(data, 6) AS data, sides, round(data + 0.01::DOUBLE * sides, 6) AS energy FROM da JOIN ss USING (image_id)")
def potts_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.potts_energy(tile_pixels(spark, sf_dir).withColumn("label", label_of()), 0.01)


@register(
    "area_between_maps",
    f"""WITH {LB2_SQL}, ms AS (SELECT a.image_id, a.x, a.y, (a.label <> b.label)::INT AS miss FROM lb a JOIN lb2 b USING (image_id, x, y)),
nr AS (SELECT DISTINCT a.image_id, a.x, a.y FROM lb a JOIN lb b ON a.image_id = b.image_id AND abs(a.x - b.x) + abs(a.y - b.y) = 1 AND a.label <> b.label),
nn AS (SELECT image_id, x, y FROM nr UNION SELECT p.image_id, p.x, p.y FROM lb p JOIN nr ON nr.image_id = p.image_id AND abs(nr.x - p.x) + abs(nr.y - p.y) = 1),
ln_ AS (SELECT a.image_id, round(sum(CASE WHEN abs(a.x - b.x) + abs(a.y - b.y) = 1 THEN 1 ELSE 1 / sqrt(2) END) * pi() / 8, 6) AS length FROM lb a JOIN lb b ON a.image_id = b.image_id AND a.label <> b.label AND (b.y = a.y AND b.x = a.x + 1 OR b.y = a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1) GROUP BY 1)
SELECT image_id, round(sum(miss) / any_value(length), 6) AS geom, round(sum(CASE WHEN nn.x IS NULL THEN miss ELSE 0 END) / any_value(length), 6) AS geom_far FROM ms JOIN ln_ USING (image_id) LEFT JOIN nn USING (image_id, x, y) GROUP BY 1""",
)
def area_between_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area where two label maps differ over the first one's boundary length, and the part of it beyond a pixel of an edge."""
    return R.area_between(tile_labels(spark, sf_dir), tile_labels(spark, sf_dir, CUTS2))
