import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.sources import rasters
from tessera.streaming import images


def png(width, height, depth, colour, rows, extra=b""):
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return rasters._SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, 0)) + extra + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def filtered(image, kinds):
    """Rows of 8-bit samples under the given filters, the slow way."""
    height, width, channels = image.shape
    flat = image.reshape(height, -1).astype(int)
    out = b""
    for y in range(height):
        out += bytes([kinds[y]])
        for i in range(width * channels):
            left = flat[y, i - channels] if i >= channels else 0
            up = flat[y - 1, i] if y else 0
            corner = flat[y - 1, i - channels] if y and i >= channels else 0
            p = left + up - corner
            near = sorted([(abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner)])[0][2]
            out += bytes([(flat[y, i] - [0, left, up, (left + up) // 2, near][kinds[y]]) % 256])
    return out


def test_png_filters_and_types():
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (5, 7, 4)).astype(np.uint8)
    assert (rasters.decode_png(rasters.encode_png(image)) == image).all()
    assert (rasters.decode_png(png(7, 5, 8, 6, filtered(image, [0, 1, 2, 3, 4]))) == image).all()
    rgb = rasters.decode_png(png(7, 5, 8, 2, filtered(image[..., :3], [4, 3, 2, 1, 0])))
    assert (rgb[..., :3] == image[..., :3]).all() and (rgb[..., 3] == 255).all()
    grey = rasters.decode_png(png(3, 1, 1, 0, b"\0\xa0"))
    assert grey[0, :, 0].tolist() == [255, 0, 255]
    bad = png(2, 1, 8, 3, b"\0\0\1")
    with pytest.raises(rasters.RasterError):
        rasters.decode_png(bad)
    plte = b"\0\0\0\6PLTE" + bytes([1, 2, 3, 4, 5, 6]) + b"\0\0\0\0"
    assert rasters.decode_png(png(2, 1, 8, 3, b"\0\0\1", plte))[0, :, :3].tolist() == [[1, 2, 3], [4, 5, 6]]


def test_images_as_pixels(spark, tmp_path):
    image = np.arange(48, dtype=np.uint8).reshape(3, 4, 4)
    (tmp_path / "a.png").write_bytes(rasters.encode_png(image))
    (tmp_path / "b.png").write_bytes(b"nothing")
    read = rasters.read_images(spark, str(tmp_path))
    assert read.filter("error IS NOT NULL").count() == 1
    got = {(r["x"], r["y"]): [round(r[c] * 255) for c in "rgba"] for r in rasters.image_pixels(read).collect()}
    assert got == {(x, y): image[y, x].tolist() for y in range(3) for x in range(4)}


def test_stream_of_tiles(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").limit(20).withColumn("arrived", F.lit("2024-01-01").cast("timestamp"))
    rows.unionByName(rows).write.parquet(f"{tmp_path}/in")
    stream = images.label_counts(images.new_tiles(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")))
    query = stream.writeStream.format("memory").queryName("tiles").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = spark.table("tiles")
    assert got.count() == rows.count() and got.filter("dark + middle + light <> 64").count() == 0
