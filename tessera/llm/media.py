"""Media columns: Netpbm and BMP to numpy arrays, area resizing, NPY tiles and difference hashes.

Decoders read P1 to P6 and uncompressed 8-, 24- and 32-bit BMP. Resizing averages each
target cell over its exact area of the source, from an integral image. Tiles are NPY
files in memory; the 64-bit difference hash compares neighbours of a 9 x 8 tile.

Rows: a null text or image is empty; an empty payload is one row of 64 zero bytes, so every
row has an image. Equal inputs give equal outputs; repeated rows stay. Columns other than
those named are ignored, so clashing names do no harm; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import buffers, chunks, column, long_ids, table, tidied

ROW_BYTES = 64
#: Rows of an image that are summed at once.
SEGMENT_ROWS = 1 << 14
TILE = (8, 9)
_HEADER = re.compile(rb"(P[1-6])" + rb"(?:\s+|\s*#[^\n]*\n)+(\d+)" * 2)
_SPACE_AND_NUMBER = re.compile(rb"(?:\s+|\s*#[^\n]*\n)+(\d+)")


class MediaError(ValueError):
    """The bytes are no image that the decoders know."""


def encode_pgm(samples: np.ndarray) -> bytes:
    """A height x width array of bytes as binary PGM."""
    height, width = samples.shape
    return b"P5\n%d %d\n255\n" % (width, height) + samples.tobytes()


def decode_netpbm(data: bytes) -> np.ndarray:
    """height x width, or height x width x 3, as uint8, or uint16 if the maximum is over 255."""
    head = _HEADER.match(data)
    if not head:
        raise MediaError("not Netpbm")
    kind, width, height, at = head[1], int(head[2]), int(head[3]), head.end()
    most = 1
    if kind not in (b"P1", b"P4"):
        found = _SPACE_AND_NUMBER.match(data, at)
        if not found:
            raise MediaError("Netpbm without a maximum")
        most, at = int(found[1]), found.end()
        if not 0 < most < 65536:
            raise MediaError("Netpbm maximum out of range")
    planes = 3 if kind in (b"P3", b"P6") else 1
    shape = (height, width, 3) if planes == 3 else (height, width)
    count = width * height * planes
    if kind in (b"P1", b"P2", b"P3"):
        body = re.sub(rb"#[^\n]*", b"", data[at:])
        numbers = [int(x) for x in (re.findall(rb"[01]", body) if kind == b"P1" else body.split())[:count]]
        if len(numbers) < count:
            raise MediaError("Netpbm is cut short")
        flat = np.array(numbers, np.uint16 if most > 255 else np.uint8)
    else:
        at += 1
        if kind == b"P4":
            stride = (width + 7) // 8
            rows = np.frombuffer(data, np.uint8, count=_available(data, at, stride * height), offset=at)
            return np.unpackbits(rows.reshape(height, stride), axis=1)[:, :width]
        kind_of = np.dtype(">u2") if most > 255 else np.dtype(np.uint8)
        _available(data, at, count * kind_of.itemsize)
        flat = np.frombuffer(data, kind_of, count=count, offset=at)
    return flat.reshape(shape)


def _available(data: bytes, at: int, wanted: int) -> int:
    if len(data) - at < wanted:
        raise MediaError("image is cut short")
    return wanted


def encode_bmp(samples: np.ndarray) -> bytes:
    """A height x width array of bytes as an 8-bit grey BMP, rows from the bottom, padded to 4 bytes."""
    height, width = samples.shape
    stride = (width + 3) // 4 * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, :width] = samples[::-1]
    palette = b"".join(bytes((i, i, i, 0)) for i in range(256))
    offset = 14 + 40 + len(palette)
    head = struct.pack("<2sIHHI", b"BM", offset + rows.size, 0, 0, offset)
    info = struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, 0, rows.size, 2835, 2835, 256, 0)
    return head + info + palette + rows.tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP: height x width of 8-bit greys, or height x width x 3 (red, green, blue)."""
    if data[:2] != b"BM" or len(data) < 54:
        raise MediaError("not BMP")
    offset, size, width, height, _, bits, packing = struct.unpack_from("<IIiiHHI", data, 10)
    if packing or bits not in (8, 24, 32) or width <= 0:
        raise MediaError(f"BMP of {bits} bits and packing {packing}")
    rows, stride = abs(height), (width * bits // 8 + 3) // 4 * 4
    flat = np.frombuffer(data, np.uint8, count=_available(data, offset, rows * stride), offset=offset).reshape(rows, stride)
    if height > 0:
        flat = flat[::-1]
    if bits == 8:
        used = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.frombuffer(data, np.uint8, count=used * 4, offset=14 + size).reshape(used, 4)[:, 2::-1]
        colours = palette[flat[:, :width]]
        grey = (palette[:, :1] == palette).all()
        return np.ascontiguousarray(colours[:, :, 0] if grey else colours)
    return np.ascontiguousarray(flat[:, : width * bits // 8].reshape(rows, width, bits // 8)[:, :, 2::-1])


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def luma(image: np.ndarray) -> np.ndarray:
    """Grey levels: of grey images the samples themselves."""
    return image if image.ndim == 2 else image.astype(np.float64) @ np.array([0.299, 0.587, 0.114])


def area_resize(grey: np.ndarray, height: int, width: int) -> np.ndarray:
    """Each target cell is the mean of the source over the cell's exact area.

    The integral image is made `SEGMENT_ROWS` rows at a time, and only what lies at the target's bounds is kept.
    """
    rows, columns = grey.shape
    at = np.arange(height + 1) * (rows / height)
    low = np.minimum(at.astype(np.int64), rows - 1)
    bounds, carry = np.zeros((height + 1, columns + 1)), np.zeros(columns + 1)
    for i in range(0, rows, SEGMENT_ROWS):
        piece = grey[i : i + SEGMENT_ROWS].astype(np.float64)
        total = np.zeros((len(piece) + 1, columns + 1))
        np.cumsum(np.cumsum(piece, axis=0), axis=1, out=total[1:, 1:])
        total += carry
        here = np.flatnonzero((low >= i) & (low < i + len(piece)))
        part = (at - low)[here, None]
        bounds[here] = total[low[here] - i] * (1 - part) + total[low[here] - i + 1] * part
        carry = total[-1].copy()
    across = np.arange(width + 1) * (columns / width)
    left = np.minimum(across.astype(np.int64), columns - 1)
    sums = bounds[:, left] * (1 - (across - left)) + bounds[:, left + 1] * (across - left)
    return np.diff(np.diff(sums, axis=0), axis=1) / ((rows / height) * (columns / width))


def tile_npy(grey: np.ndarray, height: int = TILE[0], width: int = TILE[1]) -> bytes:
    """The resized image, rounded to bytes, as an NPY file."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(grey, height, width)), 0, 255).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def difference_hash(tile: bytes) -> str:
    """64 bits in hex: whether each cell of an 8 x 9 tile is darker than the next in its row."""
    cells = np.load(io.BytesIO(tile), allow_pickle=False)
    return np.packbits(cells[:, 1:] > cells[:, :-1]).tobytes().hex()


def payload_image(payload: bytes) -> np.ndarray:
    """Bytes as rows of 64 samples, zero bytes to a positive multiple of 64 appended."""
    size = max(ROW_BYTES, -(-len(payload) // ROW_BYTES) * ROW_BYTES)
    return np.frombuffer(payload.ljust(size, b"\0"), np.uint8).reshape(-1, ROW_BYTES)


DECODED = "height int, width int, planes int, tile binary, dhash string, error string"


def decode_media(images: DataFrame, data: str = "image", keep: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Decode a binary column of Netpbm or BMP files: their size, an NPY tile and its difference hash.

    An image that can't be decoded, or null, has nulls there and says why in `error`.
    """
    kept = images.select(*keep, F.col(data).alias("__data"))

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(len(keep)):
                try:
                    if not value.is_valid:
                        raise MediaError("null")
                    image = decode(value.as_py())
                    if not image.size:
                        raise MediaError("no pixels")
                    tile = tile_npy(luma(image))
                    rows.append((image.shape[0], image.shape[1], image.shape[2] if image.ndim == 3 else 1, tile, difference_hash(tile), None))
                except (MediaError, struct.error, ValueError) as why:
                    rows.append((None, None, None, None, None, str(why)))
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string())
            made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], names=[*keep, "height", "width", "planes", "tile", "dhash", "error"])

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[: len(keep)])
    return kept.mapInArrow(run, f"{head}, {DECODED}")


STORED = (
    "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, "
    "media_bytes bigint, media_sha256 string, feature string, tile binary"
)


def store_texts(docs: DataFrame, form: str = "pgm") -> DataFrame:
    """Each text's bytes as an image (`pgm` or `bmp`), read back from the stored bytes.

    The feature is the difference hash of the image's 8 x 9 tile, then the tile's mean and
    deviation; all of it comes from the decoded image.
    """
    encode = {"pgm": encode_pgm, "bmp": encode_bmp}[form]

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            raw, starts, ends = buffers(column(batch, "text"))
            rows = []
            for a, b in zip(starts, ends, strict=True):
                stored = encode(payload_image(raw[a:b].tobytes()))
                image = decode(stored)
                payload = image.tobytes()
                tile = tile_npy(luma(image))
                cells = np.load(io.BytesIO(tile))
                feature = f"{difference_hash(tile)}:{cells.mean():.3f}:{cells.std():.3f}"
                rows.append((b - a, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, tile))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
            names = [x.split()[0] for x in STORED.split(", ")]
            yield pa.RecordBatch.from_arrays([long_ids(batch), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds))], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, STORED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_texts(table(spark, sf_dir, "documents"))
