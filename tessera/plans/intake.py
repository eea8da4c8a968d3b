"""Queries from file bytes: headers, packing, and pictures traced to paths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import dense as D
from tessera.operators import intake as I
from tessera.operators import trace as T
from tessera.plans.dense import PV_SQL, tile_images
from tessera.plans.raster import CC_SQL
from tessera.plans.registry import register
from tessera.sources.derived import RGB_SQL, read


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p_partkey, content: the first bytes of files of eight kinds, sized by the part."""
    k, w, h = F.col("p_partkey") % 9, F.col("p_size"), (F.col("p_partkey") % 1000).cast("int")

    def big(v) -> str:
        return F.lpad(F.hex(v.cast("long")), 8, "0")

    def little(v, size: int):
        text = F.lpad(F.hex(v.cast("long")), 2 * size, "0")
        return F.concat(*[F.substring(text, 2 * i + 1, 2) for i in reversed(range(size))])

    lit = F.lit
    body = (
        F.when(k == 0, F.concat(lit("89504E470D0A1A0A0000000D49484452"), big(w), big(h))).when(k == 1, lit("FFD8FFE000104A46494600"))
        .when(k == 2, F.concat(lit("474946383961"), little(w, 2), little(h, 2))).when(k == 3, F.concat(lit("424D"), F.repeat(lit("00"), 16), little(w, 4), little(h, 4)))
        .when(k == 4, F.concat(lit("49492A00"), F.repeat(lit("00"), 12))).when(k == 5, lit("52494646000000005745425056503820")).when(k == 6, lit("5249464600000000574542505650384C"))
        .when(k == 7, lit("52494646000000005745425056503858")).otherwise(lit("0001020304"))
    )
    return read(spark, sf_dir, "part").select("p_partkey", "p_size", F.unhex(body).alias("content"))


@register(
    "file_headers",
    """SELECT p_partkey, ['png', 'jpeg', 'gif', 'bmp', 'tiff', 'webp', 'webp', 'webp', NULL][p_partkey % 9 + 1] AS kind, CASE p_partkey % 9 WHEN 1 THEN TRUE WHEN 5 THEN TRUE WHEN 7 THEN NULL WHEN 8 THEN NULL ELSE FALSE END AS lossy,
CASE WHEN p_partkey % 9 IN (0, 2, 3) THEN CAST(p_size AS BIGINT) END AS width, CASE WHEN p_partkey % 9 IN (0, 2, 3) THEN p_partkey % 1000 END AS height FROM part""",
)
def file_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.col("content")
    width, height = I.header_size(content)
    return headers(spark, sf_dir).select("p_partkey", I.file_kind(content).alias("kind"), I.lossy_container(content).alias("lossy"), width.alias("width"), height.alias("height"))


@register("factor_for_width", "SELECT p_partkey, CAST(least(greatest(floor(1.4 * (p_size / 8.0::DOUBLE) - 0.756 + 0.5), 1), 8) AS INT) AS factor FROM part")
def factor_for_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", I.factor_for_width(F.col("p_size") / 8.0).alias("factor"))


@register("planar_pack", f"WITH {RGB_SQL}, c AS (SELECT image_id, x, y, unnest([r, g, b]) AS v, unnest([0, 1, 2]) AS c FROM rgb) SELECT image_id, CAST(c AS INT) AS c, CAST(px AS INT) AS x, CAST(py AS INT) AS y, v FROM c JOIN (SELECT px, py, least(px, 7) AS x, least(py, 7) AS y FROM range(9) a(px), range(9) b(py)) USING (x, y)")
def planar_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    def pack(*channels: np.ndarray) -> tuple:
        out = I.planar(list(channels), 3)
        c, y, x = np.indices(out.shape)
        return c.ravel(), x.ravel(), y.ravel(), out.ravel()

    return D.per_image(tile_images(spark, sf_dir), ["r", "g", "b"], pack, "c int, x int, y int, v double")


@register("selective_scan", f"WITH RECURSIVE {RGB_SQL}, s AS (SELECT image_id, y * 8 + x AS i, r AS a, b FROM rgb), q AS (SELECT image_id, i, b AS v FROM s WHERE i = 0 UNION ALL SELECT s.image_id, s.i, s.a * q.v + s.b FROM q JOIN s ON s.image_id = q.image_id AND s.i = q.i + 1) SELECT image_id, CAST(i % 8 AS INT) AS x, CAST(i // 8 AS INT) AS y, v FROM q")
def selective_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first-order recurrence over each tile's pixels in order."""
    return D.per_image(tile_images(spark, sf_dir), ["r", "b"], lambda r, b: D.cells(I.scanned(r.ravel(), b.ravel()).reshape(r.shape), None), "x int, y int, v double")


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: every tile as a PNG file of three greys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, values = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist()).reshape(-1, 8, 8)
            level = np.array([20, 128, 240], np.uint8)[np.where(values < -0.08, 0, np.where(values < 0.08, 1, 2))]
            files = [I.encode_png(np.dstack([g, g, g, np.full_like(g, 255)])) for g in level]
            yield pa.RecordBatch.from_arrays([pa.array([f"{i}.png" for i in ids]), pa.array(files, pa.binary())], names=["path", "content"])

    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return rows.mapInArrow(run, "path string, content binary")


@register(
    "traced_pictures",
    f"""WITH RECURSIVE {CC_SQL}, f AS (SELECT image_id, component, min(label) AS label, count(*) AS n FROM cc GROUP BY 1, 2),
s AS (SELECT image_id, count(DISTINCT label) AS inks, count(*) AS faces, string_agg(CASE label WHEN 0 THEN '#141414' WHEN 1 THEN '#808080' ELSE '#f0f0f0' END, ',' ORDER BY n DESC, component) AS fills FROM f GROUP BY 1)
SELECT image_id || '.png' AS path, CAST(8 AS INT) AS width, CAST(8 AS INT) AS height, CAST(inks AS INT) AS inks, CAST(faces AS INT) AS faces, fills FROM s""",
)
def traced_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From PNG bytes to a document: its size, inks, faces and their fills back to front. Tests draw the paths again."""
    done = T.traced(pictures(spark, sf_dir))
    fills = F.array_join(F.regexp_extract_all("svg", F.lit('fill="(#[0-9a-f]{6})"'), F.lit(1)), ",")
    return done.select("path", "width", "height", "inks", "faces", fills.alias("fills"))


@register("tile_values_enlarged", f"WITH {PV_SQL} SELECT image_id, CAST(tx AS INT) AS x, CAST(ty AS INT) AS y, round(v, 6) AS v FROM pv JOIN (SELECT tx, ty, greatest(least(tx - 2, 7), 0) AS x, greatest(least(ty - 2, 7), 0) AS y FROM range(12) a(tx), range(12) b(ty)) USING (x, y)")
def tile_values_enlarged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles with a border of two pixels, their edges going on."""
    return D.per_image(tile_images(spark, sf_dir), ["v"], lambda g: D.cells(I.framed(g[..., None], 2)[..., 0], 6), "x int, y int, v double")
