"""Rasters, polylines, spans and score tables derived from the star-schema and vector tables.

A vector of 64 numbers is an 8 x 8 tile; a user's events are a polyline; orders are spans; line
items are scores of runners. Each function reads only the columns that it needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 8
CUTS = (-0.08, 0.08)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tile_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, x, y, v."""
    cells = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("i", "e"))
    return cells.select("image_id", (F.col("i") % SIDE).cast("int").alias("x"), F.floor(F.col("i") / SIDE).cast("int").alias("y"), F.col("e").cast("double").alias("v"))


def label_of(v: str = "v", cuts: tuple[float, float] = CUTS):
    return F.when(F.col(v) < cuts[0], 0).when(F.col(v) < cuts[1], 1).otherwise(2)


def tile_labels(spark: SparkSession, sf_dir: str, cuts: tuple[float, float] = CUTS) -> DataFrame:
    """image_id, x, y, label."""
    return tile_pixels(spark, sf_dir).select("image_id", "x", "y", label_of(cuts=cuts).alias("label"))


def rgb_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, x, y, r, g, b: channels from the pixel's number and the two after it, around the tile, in [0, 1]."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), "embedding", F.posexplode("embedding").alias("i", "e"))

    def channel(k: int):
        value = F.get("embedding", ((F.col("i") + k) % (SIDE * SIDE)).cast("int")).cast("double")
        return F.least(F.greatest(F.round(value * 1.5 + 0.5, 3), F.lit(0.0)), F.lit(1.0))

    return e.select("image_id", (F.col("i") % SIDE).cast("int").alias("x"), F.floor(F.col("i") / SIDE).cast("int").alias("y"), channel(0).alias("r"), channel(1).alias("g"), channel(2).alias("b"))


def polylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line_id, seq, x (days since the user's first event), y, sigma."""
    from pyspark.sql import Window

    e = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value", "event_type")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    first = F.min("ts").over(Window.partitionBy("user_id"))
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(first.cast("timestamp"))
    sigma = F.when(F.col("event_type").isin("click", "view"), 0.5).otherwise(1.0)
    return e.select(F.col("user_id").alias("line_id"), F.row_number().over(order).alias("seq"), (seconds / 86_400_000_000).alias("x"), F.col("value").alias("y"), sigma.alias("sigma"))


def order_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region_id (customer), side (0 or 1), lo, hi: half-open day spans of an order."""
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date"))
    return o.select(
        F.col("o_custkey").alias("region_id"), (F.col("o_orderkey") % 2).cast("int").alias("side"), day.alias("lo"), (day + 30 + (F.col("o_orderkey") % 90)).cast("int").alias("hi")
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """runner, setting, family, uid, perturbation, cost, quality, seconds: one row a line item, deduplicated by its key."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus")
    su = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    na = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    keyed = li.join(su, F.col("l_suppkey") == F.col("s_suppkey")).join(F.broadcast(na), F.col("s_nationkey") == F.col("n_nationkey"))
    return keyed.select(
        F.col("l_returnflag").alias("runner"), F.col("l_linestatus").alias("setting"), F.col("n_name").alias("family"), F.col("l_orderkey").alias("uid"),
        F.col("l_linenumber").alias("perturbation"), F.col("l_partkey").alias("part"), F.col("l_extendedprice").alias("cost"), F.col("l_quantity").alias("quality"), F.col("l_discount").alias("seconds"),
    )


# The same relations as SQL, for the oracle. Each is a list of common table expressions.
PX_SQL = """
px AS (SELECT vec_id AS image_id, CAST((i - 1) % 8 AS INT) AS x, CAST((i - 1) // 8 AS INT) AS y, CAST(embedding[i] AS DOUBLE) AS v
       FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings))"""
LB_SQL = PX_SQL + """,
lb AS (SELECT image_id, x, y, CASE WHEN v < -0.08 THEN 0 WHEN v < 0.08 THEN 1 ELSE 2 END AS label FROM px)"""
LB2_SQL = LB_SQL + """,
lb2 AS (SELECT image_id, x, y, CASE WHEN v < -0.05 THEN 0 WHEN v < 0.1 THEN 1 ELSE 2 END AS label FROM px)"""
RGB_SQL = """
rgb AS (SELECT vec_id AS image_id, CAST((i - 1) % 8 AS INT) AS x, CAST((i - 1) // 8 AS INT) AS y,
               least(greatest(round(CAST(embedding[i] AS DOUBLE) * 1.5 + 0.5, 3), 0.0), 1.0) AS r,
               least(greatest(round(CAST(embedding[i % 64 + 1] AS DOUBLE) * 1.5 + 0.5, 3), 0.0), 1.0) AS g,
               least(greatest(round(CAST(embedding[(i + 1) % 64 + 1] AS DOUBLE) * 1.5 + 0.5, 3), 0.0), 1.0) AS b
        FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings))"""
PL_SQL = """
pl AS (SELECT user_id AS line_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS seq,
              (epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY user_id))) / 86400000000.0::DOUBLE AS x, value AS y,
              CASE WHEN event_type IN ('click', 'view') THEN 0.5 ELSE 1.0 END::DOUBLE AS sigma FROM events)"""
SP_SQL = """
sp AS (SELECT o_custkey AS region_id, CAST(o_orderkey % 2 AS INT) AS side, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS INT) AS lo,
              CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) + 30 + o_orderkey % 90 AS INT) AS hi FROM orders)"""
SC_SQL = """
sc AS (SELECT l_returnflag AS runner, l_linestatus AS setting, n_name AS family, l_orderkey AS uid, l_linenumber AS perturbation, l_partkey AS part,
              l_extendedprice AS cost, l_quantity AS quality, l_discount AS seconds
       FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""
