"""What a file says before it is decoded: its kind, whether it is lossy, its size; and rasters made or read from bytes."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# The first bytes of each kind of file, in hex.
SIGNATURES = {"png": "89504E470D0A1A0A", "jpeg": "FFD8FF", "gif": "47494638", "bmp": "424D", "tiff": ("49492A00", "4D4D002A")}


def file_kind(content: Column) -> Column:
    """png, jpeg, gif, bmp, tiff or webp by its first bytes; null for others."""
    head = F.hex(F.substring(content, 1, 16))
    kind = F
    for name, marks in SIGNATURES.items():
        for mark in (marks,) if isinstance(marks, str) else marks:
            kind = kind.when(head.startswith(mark), name)
    return kind.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp")


def lossy_container(content: Column) -> Column:
    """Whether a lossy codec wrote the file; null where the container does not say."""
    kind, chunk = file_kind(content), F.hex(F.substring(content, 13, 4))
    return F.when(kind == "jpeg", True).when((kind == "webp") & (chunk == "56503820"), True).when((kind == "webp") & (chunk == "5650384C"), False).when(kind.isin("png", "gif", "bmp", "tiff"), False)


def _number(content: Column, start: int, size: int, little: bool) -> Column:
    text = F.hex(F.substring(content, start, size))
    if little:
        text = F.concat(*[F.substring(text, 2 * k + 1, 2) for k in reversed(range(size))])
    return F.conv(text, 16, 10).cast("long")


def header_size(content: Column) -> tuple[Column, Column]:
    """Width and height from the header of a PNG, GIF or BMP; null for other kinds and for cut headers."""
    kind, size = file_kind(content), F.octet_length(content)
    width = F.when((kind == "png") & (size >= 24), _number(content, 17, 4, False)).when((kind == "gif") & (size >= 10), _number(content, 7, 2, True)).when((kind == "bmp") & (size >= 26), _number(content, 19, 4, True))
    height = F.when((kind == "png") & (size >= 24), _number(content, 21, 4, False)).when((kind == "gif") & (size >= 10), _number(content, 9, 2, True)).when((kind == "bmp") & (size >= 26), _number(content, 23, 4, True))
    # A BMP whose rows run down has a negative height.
    return width, F.when((kind == "bmp") & (height >= 1 << 31), (1 << 32) - height).otherwise(height)


def factor_for_width(width: Column) -> Column:
    """The whole reduction that an edge's width in pixels implies, 1 to 8."""
    return F.least(F.greatest(F.floor(F.lit(1.4) * width - 0.756 + 0.5), F.lit(1)), F.lit(8)).cast("int")


def encode_png(rgba: np.ndarray) -> bytes:
    """Eight-bit RGBA, one filter-free row after another."""
    height, width = rgba.shape[:2]
    rows = np.concatenate([np.zeros((height, 1), np.uint8), rgba.reshape(height, width * 4)], axis=1).tobytes()

    def part(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return bytes.fromhex(SIGNATURES["png"]) + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def raw_rgba(data: bytes, width: int, height: int) -> np.ndarray:
    """Packed bytes as height x width x 4; what a short buffer lacks is transparent black."""
    return np.frombuffer(data[: width * height * 4].ljust(width * height * 4, b"\0"), np.uint8).reshape(height, width, 4)


def framed(rgba: np.ndarray, by: int) -> np.ndarray:
    """The image with a border: its edge pixels go on where they touch the frame."""
    return np.pad(rgba, ((by, by), (by, by), (0, 0)), mode="edge")


def planar(channels: list[np.ndarray], multiple: int) -> np.ndarray:
    """Channels one after another, the last row and column repeated up to a multiple."""
    h, w = channels[0].shape
    return np.stack([np.pad(c, ((0, -h % multiple), (0, -w % multiple)), mode="edge") for c in channels])


def scanned(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x[i] = a[i] x[i - 1] + b[i] along the last axis, from zero."""
    out, x = np.empty_like(b), np.zeros(b.shape[:-1])
    for i in range(b.shape[-1]):
        x = a[..., i] * x + b[..., i]
        out[..., i] = x
    return out
