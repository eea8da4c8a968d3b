"""From the bytes of a picture to paths: decode, palette, labels, faces, rings, path data.

One picture is one row and one task: it is decoded, its distinct colours are merged in order
of frequency, pixels take the nearest ink, faces are 4-connected, and each face is drawn by its
rings in whole pixels, larger faces first. Drawing the result gives the label map back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.operators import dense as D
from tessera.operators import regions as R
from tessera.operators.palette import _distances
from tessera.operators.paths import Subpath, write_path
from tessera.sources.rasters import RasterError, decode_png

TRACED = "path string, width int, height int, inks int, faces int, svg string, error string"


def picture_inks(rgb: np.ndarray, merge: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Inks (the commonest colours, none within `merge` of one before) and each pixel's ink."""
    colours, place, count = np.unique(rgb.reshape(-1, 3), axis=0, return_inverse=True, return_counts=True)
    kept: list[int] = []
    for k in sorted(range(len(colours)), key=lambda k: (-count[k], k)):
        if len(kept) < most and (not kept or _distances(colours[k][None] / 255, colours[kept] / 255).min() > merge):
            kept.append(k)
    nearest = np.concatenate([_distances(colours[i : i + 4096] / 255, colours[kept] / 255).argmin(axis=1) for i in range(0, len(colours), 4096)])
    return colours[kept], nearest[place].reshape(rgb.shape[:2])


def trace(rgba: np.ndarray, merge: float = 0.1, most: int = 64) -> tuple[str, int, int]:
    """The document, how many inks it has and how many faces."""
    height, width = rgba.shape[:2]
    alpha = rgba[..., 3:].astype(np.uint16)
    flat = ((rgba[..., :3] * alpha + 255 * (255 - alpha) + 127) // 255).astype(np.uint8)
    inks, label = picture_inks(flat, merge, most)
    face = R.label_components(label)
    rings: dict[int, list[np.ndarray]] = {}
    for f, ring in D.face_rings(face):
        rings.setdefault(f, []).append(ring)
    ink_of = np.zeros(int(face.max()) + 1, np.int64)
    ink_of[face.ravel()] = label.ravel()
    size = np.bincount(face.ravel())
    parts = []
    for f in sorted(rings, key=lambda f: (-size[f], f)):
        own = [Subpath(tuple(map(float, r[0])), [tuple(map(float, p)) for p in r[1:]], True) for r in rings[f]]
        parts.append(f'<path fill="#{bytes(inks[ink_of[f]].tolist()).hex()}" d="{write_path(own)}"/>')
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {height}">{"".join(parts)}</svg>', len(inks), len(rings)


def traced(files: DataFrame, merge: float = 0.1, most: int = 64) -> DataFrame:
    """The document of every file (path, content); what can't be decoded says why."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rgba = decode_png(content or b"")
                    svg, inks, faces = trace(rgba, merge, most)
                    row = (path, rgba.shape[1], rgba.shape[0], inks, faces, svg, None)
                except (RasterError, ValueError, IndexError) as why:
                    row = (path, None, None, None, None, None, str(why))
                kinds = (pa.string(), *[pa.int32()] * 4, pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in TRACED.split(", ")])

    return files.select("path", "content").mapInArrow(run, TRACED)
