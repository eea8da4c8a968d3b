"""Queries of vector documents as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import paths
from tessera.operators import regions as R
from tessera.operators import svgtext as S
from tessera.plans.registry import register
from tessera.sources.derived import LB_SQL, PL_SQL, polylines, read, tile_labels


def _num(v: str) -> str:
    fixed = f"printf('%.2f', round({v}, 2))"
    short = f"regexp_replace({fixed}, '\\.?0+$', '')"
    lead = f"regexp_replace({short}, '^(-?)0\\.', '\\1.')"
    return f"CASE WHEN {lead} IN ('', '-0', '-') THEN '0' ELSE {lead} END"


D_SQL = PL_SQL + f""",
dd AS (SELECT line_id, 'M' || string_agg({_num("x")} || ' ' || {_num("y")}, 'L' ORDER BY seq) AS d FROM pl GROUP BY 1)"""
TK_SQL = D_SQL + """,
tk AS (SELECT line_id, CAST(i - 1 AS INT) AS pos, token FROM (SELECT line_id, unnest(regexp_extract_all(d, '[A-Za-z]|-?[0-9]*\\.?[0-9]+')) AS token, generate_subscripts(regexp_extract_all(d, '[A-Za-z]|-?[0-9]*\\.?[0-9]+'), 1) AS i FROM dd)),
tc AS (SELECT *, last_value(CASE WHEN regexp_matches(token, '^[A-Za-z]$') THEN token END IGNORE NULLS) OVER (PARTITION BY line_id ORDER BY pos) AS command FROM tk)"""


@register("emit_paths", f"WITH {D_SQL} SELECT * FROM dd")
def emit_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.polyline_paths(polylines(spark, sf_dir))


@register("path_tokens", f"WITH {TK_SQL} SELECT * FROM tc")
def path_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.path_tokens(emit_paths(spark, sf_dir))


@register("structure_counts", f"WITH {TK_SQL} SELECT line_id, count(*) FILTER (WHERE token = 'M') AS subpaths, count(*) FILTER (WHERE token = 'L') AS segments, count(*) FILTER (WHERE token NOT IN ('M', 'L')) AS numbers, CAST(sum(length(token)) AS BIGINT) AS token_bytes FROM tc GROUP BY 1")
def structure_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.structure_counts(path_tokens(spark, sf_dir))


@register("path_absolute", f"WITH {TK_SQL}, n AS (SELECT line_id, row_number() OVER (PARTITION BY line_id ORDER BY pos) - 1 AS i, CAST(token AS DOUBLE) AS v FROM tc WHERE token NOT IN ('M', 'L')), p AS (SELECT line_id, i // 2 AS seq, max(v) FILTER (WHERE i % 2 = 0) AS dx, max(v) FILTER (WHERE i % 2 = 1) AS dy FROM n GROUP BY 1, 2) SELECT line_id, CAST(seq AS INT) AS seq, round(sum(dx) OVER w, 2) AS x, round(sum(dy) OVER w, 2) AS y FROM p WINDOW w AS (PARTITION BY line_id ORDER BY seq)")
def path_absolute(spark: SparkSession, sf_dir: str) -> DataFrame:
    relative = emit_paths(spark, sf_dir).withColumn("d", F.lower("d"))
    return S.absolute_positions(relative)


@register("emit_svg", f"""WITH {LB_SQL}, bx AS (SELECT image_id, label, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM lb GROUP BY 1, 2) SELECT image_id, '<svg>' || string_agg(printf('<rect x="%d" y="%d" width="%d" height="%d" class="c%d"/>', x0, y0, x1 - x0 + 1, y1 - y0 + 1, label), '' ORDER BY (x1 - x0 + 1) * (y1 - y0 + 1) DESC, label) || '</svg>' AS svg FROM bx GROUP BY 1""")
def emit_svg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.rectangles(R.bounding_boxes(tile_labels(spark, sf_dir)))


@register("minify_numbers", f"SELECT o_orderkey, {_num('o_totalprice / 7 - 15000')} AS text FROM orders")
def minify_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", S.number_text(F.col("o_totalprice") / 7 - 15000, 2).alias("text"))


@register("element_counts", "SELECT lower(tag) AS tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag FROM pages) GROUP BY 1")
def element_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.tag_counts(read(spark, sf_dir, "pages").select("html"))


@register(
    "options_validate",
    """WITH o AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '{"precision": 0.2}' WHEN 1 THEN '{"colors": ' || event_id || '}' WHEN 2 THEN '{"mode": "' || event_type || '"}' WHEN 3 THEN '{"nonsense": 1}' WHEN 4 THEN '{"precision": -1, "mode": "fast"}' ELSE '[1]' END AS options FROM events)
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 0.2 WHEN 4 THEN -1.0 ELSE 0.1 END::DOUBLE AS precision, CASE event_id % 6 WHEN 1 THEN event_id ELSE 64 END::INT AS colors,
  CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN CASE WHEN event_id > 4096 OR event_id < 1 THEN 'colors' END WHEN 2 THEN 'mode' WHEN 3 THEN 'unknown option' WHEN 4 THEN 'precision' ELSE 'not an object' END AS problem FROM o""",
)
def options_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, kind = F.col("event_id"), F.col("event_id") % 6
    text = (
        F.when(kind == 0, '{"precision": 0.2}').when(kind == 1, F.concat(F.lit('{"colors": '), i, F.lit("}"))).when(kind == 2, F.concat(F.lit('{"mode": "'), "event_type", F.lit('"}')))
        .when(kind == 3, '{"nonsense": 1}').when(kind == 4, '{"precision": -1, "mode": "fast"}').otherwise("[1]")
    )
    rows = read(spark, sf_dir, "events").select("event_id", text.alias("options"))
    return S.options_validated(rows).select("event_id", "values.precision", "values.colors", "problem")


MIX_SQL = PL_SQL + """,
ip AS (SELECT line_id, seq, 3.0::DOUBLE * seq AS x, round(y) AS y FROM pl),
iv AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM ip WINDOW w AS (PARTITION BY line_id ORDER BY seq)),
is_ AS (SELECT line_id, seq, 0 AS part, 'line' AS kind, px AS x0, py AS y0, NULL::DOUBLE AS x1, NULL::DOUBLE AS y1, NULL::DOUBLE AS x2, NULL::DOUBLE AS y2, x, CASE WHEN seq % 4 = 3 THEN py ELSE y END AS y FROM iv WHERE seq > 1 AND seq % 4 <> 0
  UNION ALL SELECT line_id, seq, 1, 'line', x, py, NULL, NULL, NULL, NULL, x, y FROM iv WHERE seq > 1 AND seq % 4 = 3 AND py <> y
  UNION ALL SELECT line_id, seq, 0, 'cubic', px, py, px, round(py + 2 / 3.0::DOUBLE * (y - py), 6), round(x + 2 / 3.0::DOUBLE * (px - x), 6), y, x, y FROM iv WHERE seq > 1 AND seq % 4 = 0)"""
SEGMENTS_SQL = f"WITH {MIX_SQL} SELECT line_id, CAST(0 AS INT) AS subpath, CAST(row_number() OVER (PARTITION BY line_id ORDER BY seq, part) - 1 AS INT) AS seq, kind, x0, y0, x1, y1, x2, y2, x, y, FALSE AS closed FROM is_"


def mixed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line_id, d: lines in whole numbers whose steps take turns as L, l, H and V, and Q."""
    from pyspark.sql import Window

    p = polylines(spark, sf_dir).select("line_id", "seq", (3.0 * F.col("seq")).alias("x"), F.round("y").alias("y"))
    order = Window.partitionBy("line_id").orderBy("seq")
    p = p.withColumns({"px": F.lag("x").over(order), "py": F.lag("y").over(order)})
    whole = [F.col(c).cast("long").cast("string") for c in ("x", "y", "px")]
    step = (
        F.when(F.col("seq") == 1, F.concat(F.lit("M"), whole[0], F.lit(" "), whole[1]))
        .when(F.col("seq") % 4 == 1, F.concat(F.lit("L"), whole[0], F.lit(","), whole[1]))
        .when(F.col("seq") % 4 == 2, F.concat(F.lit(" l"), (F.col("x") - F.col("px")).cast("long"), F.lit(" "), (F.col("y") - F.col("py")).cast("long")))
        .when(F.col("seq") % 4 == 3, F.concat(F.lit("H"), whole[0], F.lit("V"), whole[1]))
        .otherwise(F.concat(F.lit("Q"), whole[2], F.lit(" "), whole[1], F.lit(" "), whole[0], F.lit(" "), whole[1]))
    )
    steps = p.groupBy("line_id").agg(F.sort_array(F.collect_list(F.struct("seq", step.alias("s")))).alias("ss"))
    return steps.select("line_id", F.array_join(F.transform("ss", lambda s: s["s"]), "").alias("d"))


@register("path_segments", SEGMENTS_SQL)
def path_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.segment_rows(mixed_paths(spark, sf_dir))


@register("path_rewritten", SEGMENTS_SQL.replace("round(py + 2 / 3.0::DOUBLE * (y - py), 6)", "round(round(py + 2 / 3.0::DOUBLE * (y - py), 6), 2)").replace("round(x + 2 / 3.0::DOUBLE * (px - x), 6)", "round(round(x + 2 / 3.0::DOUBLE * (px - x), 6), 2)"))
def path_rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same segments, read from what the writer of few bytes makes of them."""
    return paths.segment_rows(mixed_paths(spark, sf_dir), rewritten=True)


@register("paths_minified")
def paths_minified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path data in few bytes; tests read it back."""
    return paths.minified(mixed_paths(spark, sf_dir))
