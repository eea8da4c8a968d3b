"""Image files as tables: PNG decoding, and pixels of decoded images.

Files are read by Spark's `binaryFile` source, so any store that Spark reaches will do; each is
decoded where it was read. A file that can't be decoded keeps its row, with nulls and a reason.
PNG: all colour types, 1 to 16 bits, without interlacing. Samples are straight RGBA in 0..255.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


class RasterError(ValueError):
    """The file is no image that can be decoded here."""


def encode_png(rgba: np.ndarray) -> bytes:
    """height x width x 4 bytes as PNG, without filters."""
    height, width, _ = rgba.shape
    rows = np.concatenate([np.zeros((height, 1), np.uint8), rgba.reshape(height, -1)], axis=1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return _SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def _unfiltered(raw: bytes, height: int, stride: int, step: int) -> np.ndarray:
    """Undo the rows' filters; step is the bytes of a whole pixel."""
    if len(raw) < height * (stride + 1):
        raise RasterError("cut short")
    rows = np.frombuffer(raw, np.uint8, count=height * (stride + 1)).reshape(height, stride + 1)
    out = np.zeros((height + 1, stride + step), np.uint8)
    for y in range(height):
        kind, line, above = rows[y, 0], rows[y, 1:], out[y]
        here = out[y + 1]
        if kind == 0:
            here[step:] = line
        elif kind == 2:
            here[step:] = line + above[step:]
        elif kind == 1:
            pad = -stride % step
            cells = np.append(line, np.zeros(pad, np.uint8)).reshape(-1, step)
            here[step:] = np.cumsum(cells, axis=0, dtype=np.uint8).ravel()[:stride]
        elif kind in (3, 4):
            for i in range(stride):
                left, up, corner = int(here[i]), int(above[i + step]), int(above[i])
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    guess = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
                here[i + step] = (int(line[i]) + guess) & 255
        else:
            raise RasterError("unknown filter")
    return out[1:, step:]


def decode_png(data: bytes) -> np.ndarray:
    """height x width x 4 bytes of straight RGBA."""
    if data[:8] != _SIGNATURE:
        raise RasterError("not PNG")
    at, body, palette, clear, head = 8, [], None, None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = part
        elif kind == b"IDAT":
            body.append(part)
        elif kind == b"IEND":
            break
        at += size + 12
    if head is None or head[3] not in _CHANNELS or head[6]:
        raise RasterError("header missing, unknown or interlaced")
    width, height, depth, colour = head[:4]
    channels = _CHANNELS[colour]
    try:
        raw = zlib.decompress(b"".join(body))
    except zlib.error as why:
        raise RasterError(str(why)) from why
    stride = (width * channels * depth + 7) // 8
    rows = _unfiltered(raw, height, stride, max(1, channels * depth // 8))
    if depth == 16:
        samples, most = rows.reshape(height, width, channels, 2)[..., 0], 255
    elif depth == 8:
        samples, most = rows.reshape(height, width, channels), 255
    else:
        bits = np.unpackbits(rows, axis=1)[:, : width * depth].reshape(height, width, depth)
        samples, most = (bits * (1 << np.arange(depth)[::-1])).sum(axis=2, dtype=np.uint8)[..., None], (1 << depth) - 1
    out = np.full((height, width, 4), 255, np.uint8)
    if colour == 3:
        if palette is None:
            raise RasterError("no palette")
        out[..., :3] = palette[samples[..., 0]]
        if clear is not None:
            alpha = np.full(256, 255, np.uint8)
            alpha[: len(clear)] = np.frombuffer(clear, np.uint8)
            out[..., 3] = alpha[samples[..., 0]]
        return out
    scaled = samples if most == 255 else (samples.astype(np.uint16) * 255 // most).astype(np.uint8)
    if channels <= 2:
        out[..., :3] = scaled[..., :1]
    else:
        out[..., :3] = scaled[..., :3]
    if channels in (2, 4):
        out[..., 3] = scaled[..., -1]
    elif clear is not None and depth <= 8:
        key = np.frombuffer(clear, ">u2").astype(np.int64)
        out[..., 3] = np.where((samples == key).all(axis=2), 0, 255)
    return out


IMAGE = "path string, width int, height int, rgba binary, error string"


def read_images(spark: SparkSession, path: str, glob: str = "*.png") -> DataFrame:
    """path, width, height, rgba (row-major bytes) and error of every file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")
    return decode_images(files)


def decode_images(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                try:
                    image = decode_png(row["content"] or b"")
                    made = (row["path"], image.shape[1], image.shape[0], image.tobytes(), None)
                except (RasterError, struct.error, ValueError, IndexError) as why:
                    made = (row["path"], None, None, None, str(why))
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(made, kinds, strict=True)], names=[x.split()[0] for x in IMAGE.split(", ")])

    return files.select("path", "content").mapInArrow(run, IMAGE)


def image_pixels(images: DataFrame) -> DataFrame:
    """path, x, y, r, g, b, a in [0, 1] of decoded images, by expressions over the bytes."""
    at = F.posexplode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1))
    rows = images.filter("rgba IS NOT NULL").select("path", "width", F.hex("rgba").alias("hex"), at.alias("pos", "i"))

    def channel(k: int):
        return F.conv(F.substring("hex", F.col("i") * 8 + 1 + 2 * k, F.lit(2)), 16, 10).cast("double") / 255

    return rows.select("path", (F.col("i") % F.col("width")).alias("x"), F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), *[channel(k).alias(c) for k, c in enumerate("rgba")])
