"""Pictures from bytes to paths, drawn again; headers and packing."""

import re

import numpy as np
import pytest

from tessera.operators import intake as I
from tessera.operators import trace as T
from tessera.operators.paths import parse_path
from tessera.sources.rasters import RasterError, decode_png


def drawn(svg, width, height):
    """Each pixel's fill: even-odd of a ray to the right from its middle, in document order."""
    out = np.full((height, width), "", object)
    for fill, d in re.findall(r'fill="(#\w+)" d="([^"]*)"', svg):
        odd = np.zeros((height, width), int)
        for sub in parse_path(d):
            pens = [sub.start, *sub.segments]
            for (x0, y0), (x1, y1) in zip(pens, [*pens[1:], sub.start], strict=True):
                if x0 == x1:
                    for y in range(int(min(y0, y1)), int(max(y0, y1))):
                        odd[y, : int(x0)] += 1
        out[odd % 2 == 1] = fill
    return out


@pytest.mark.parametrize("seed", range(6))
def test_drawing_the_trace_gives_the_labels_back(seed):
    rng = np.random.default_rng(seed)
    grey = rng.choice([0, 90, 255], (rng.integers(1, 12), rng.integers(1, 12))).astype(np.uint8)
    rgba = np.dstack([grey, grey, grey, np.full_like(grey, 255)])
    again = decode_png(I.encode_png(rgba))
    assert (again == rgba).all()
    svg, inks, _ = T.trace(again)
    want = np.vectorize(lambda v: f"#{v:02x}{v:02x}{v:02x}")(grey)
    assert (drawn(svg, grey.shape[1], grey.shape[0]) == want).all() and inks == len(np.unique(grey))


def test_near_colours_are_one_ink_and_faults_are_told(spark):
    rgba = np.full((2, 2, 4), 255, np.uint8)
    rgba[0, 0, :3] = 250
    assert T.trace(rgba)[1:] == (1, 1)
    assert T.trace(np.zeros((1, 1, 4), np.uint8))[0].count("#ffffff") == 1
    files = spark.createDataFrame([("a", bytes(I.encode_png(rgba))), ("b", b"nothing"), ("c", None)], "path string, content binary")
    rows = {r["path"]: r for r in T.traced(files).collect()}
    assert rows["a"]["faces"] == 1 and rows["b"]["error"] and rows["c"]["error"] and rows["b"]["svg"] is None
    with pytest.raises(RasterError):
        decode_png(b"")


def test_raw_bytes_and_scans():
    assert I.raw_rgba(b"\1\2\3", 2, 1).tolist() == [[[1, 2, 3, 0], [0, 0, 0, 0]]]
    a, b = np.array([0.5, 0.5, 2.0]), np.array([1.0, 1.0, 1.0])
    assert I.scanned(a, b).tolist() == [1.0, 1.5, 4.0]
    assert I.planar([np.arange(4.0).reshape(2, 2)], 3)[0].tolist() == [[0, 1, 1], [2, 3, 3], [2, 3, 3]]
