"""Kernels over whole images: resampling, masks, block transforms, contours, rings, distances.

An image is one row: image_id, width, height and one array a channel, row by row. A kernel
gets its channels as arrays of height x width and returns columns of equal length, so
nothing is shuffled and a task holds one image at a time. An image with a null or short
channel gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Kernel = Callable[..., tuple]


def per_image(images: DataFrame, channels: list[str], kernel: Kernel, schema: str) -> DataFrame:
    """image_id and the kernel's columns, for every image."""
    full = f"image_id bigint, {schema}"
    arrow = to_arrow_schema(StructType.fromDDL(full))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, w, h, *planes in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns)), strict=True):
                if any(p is None or len(p) != w * h for p in planes):
                    continue
                out = kernel(*(np.array(p, np.float64).reshape(h, w) for p in planes))
                n = len(out[0])
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array([i] * n, pa.int64()), *(pa.array(v, f.type) for v, f in zip(out, list(arrow)[1:], strict=True))], schema=arrow)

    return images.select("image_id", "width", "height", *channels).mapInArrow(run, full)


def _coordinates(grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    y, x = np.indices(grid.shape[:2])
    return x.ravel(), y.ravel()


def cells(grid: np.ndarray, digits: int | None = 9) -> tuple:
    """x, y and the value of every pixel, rounded if digits are given."""
    return (*_coordinates(grid), grid.ravel() if digits is None else np.round(grid.ravel(), digits))


# Resampling


def area_weights(size: int, target: int) -> np.ndarray:
    """target x size: how much of each source cell a target cell covers, as shares of the target cell."""
    edges = np.arange(target + 1) * (size / target)
    low, high = np.arange(size), np.arange(size) + 1
    cover = np.minimum(edges[1:, None], high) - np.maximum(edges[:-1, None], low)
    return np.maximum(cover, 0) / (size / target)


def area_average(grid: np.ndarray, width: int, height: int) -> np.ndarray:
    """Each target pixel is the mean of the source over its exact area."""
    return area_weights(grid.shape[0], height) @ grid @ area_weights(grid.shape[1], width).T


def box_average(grid: np.ndarray, factor: int) -> np.ndarray:
    """Means of whole factor x factor blocks; rows and columns that fill no block are left out."""
    h, w = grid.shape[0] // factor, grid.shape[1] // factor
    return grid[: h * factor, : w * factor].reshape(h, factor, w, factor).mean(axis=(1, 3))


def cubic_weights(size: int, target: int) -> np.ndarray:
    """target x size: Keys' cubic convolution with a = -0.5, samples outside clamped to the edge."""
    out = np.zeros((target, size))
    for t in range(target):
        at = (t + 0.5) * size / target - 0.5
        first = int(np.floor(at)) - 1
        for i in range(first, first + 4):
            d = abs(at - i)
            near, far = 1.5 * d**3 - 2.5 * d**2 + 1, -0.5 * (d**3 - 5 * d**2 + 8 * d - 4)
            out[t, min(max(i, 0), size - 1)] += near if d <= 1 else far if d < 2 else 0.0
    return out / out.sum(axis=1, keepdims=True)


def bicubic(grid: np.ndarray, width: int, height: int) -> np.ndarray:
    return np.clip(cubic_weights(grid.shape[0], height) @ grid @ cubic_weights(grid.shape[1], width).T, 0, 1)


def block_factor(grid: np.ndarray) -> int:
    """The largest factor of which the image is a whole enlargement, pixel for pixel."""
    h, w = grid.shape[:2]
    for k in range(min(h, w), 1, -1):
        if h % k == 0 and w % k == 0 and (grid == grid[::k, ::k].repeat(k, axis=0).repeat(k, axis=1)).all():
            return k
    return 1


# Flat areas


def flat_mask(luma: np.ndarray, tolerance: float) -> np.ndarray:
    """Where the 3 x 3 neighbourhood spans less than the tolerance; the frame is never flat."""
    out = np.zeros(luma.shape, bool)
    if min(luma.shape) >= 3:
        around = np.lib.stride_tricks.sliding_window_view(luma, (3, 3))
        out[1:-1, 1:-1] = np.round(around.max(axis=(2, 3)) - around.min(axis=(2, 3)), 9) < tolerance
    return out


def match_flats(high: np.ndarray, low: np.ndarray, mask: np.ndarray, least: int = 16) -> np.ndarray:
    """high under the affine map that takes it to low over the flat pixels, clamped; unchanged where there are too few or no slope."""
    if mask.sum() < 0.01 * mask.size:
        mask = np.ones_like(mask)
    x, y = high[mask], low[mask]
    n = len(x)
    det = n * (x * x).sum() - x.sum() ** 2
    if n < least or abs(det) < 1e-9:
        return high
    a = (n * (x * y).sum() - x.sum() * y.sum()) / det
    return np.clip(a * high + (y.sum() - a * x.sum()) / n, 0, 1)


def interior_residual(image: list[np.ndarray], model: list[np.ndarray], tolerance: float, least: int) -> float | None:
    """Disagreement on an 8-bit scale where the model is flat: the root of the squared sum over 9 n; none under `least` flat pixels."""
    mask = flat_mask(sum(model) / 3, tolerance)
    n = int(mask.sum())
    if n < least:
        return None
    return float(np.sqrt(sum((((m - i)[mask] * 255) ** 2).sum() for i, m in zip(image, model, strict=True)) / (9 * n)))


# Block transform of a lossy codec

# The luma quantisation table of baseline JPEG.
QUANTA = np.array(
    [
        [16, 11, 10, 16, 24, 40, 51, 61], [12, 12, 14, 19, 26, 58, 60, 55], [14, 13, 16, 24, 40, 57, 69, 56], [14, 17, 22, 29, 51, 87, 80, 62],
        [18, 22, 37, 56, 68, 109, 103, 77], [24, 35, 55, 64, 81, 104, 113, 92], [49, 64, 78, 87, 103, 121, 120, 101], [72, 92, 95, 98, 112, 100, 103, 99],
    ]
)


def quantisation(quality: int) -> np.ndarray:
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((QUANTA * scale + 50) // 100, 1, 255)


def cosines() -> np.ndarray:
    """8 x 8: row u is the u-th cosine of the orthonormal transform."""
    u, x = np.indices((8, 8))
    return np.where(u == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * x + 1) * u * np.pi / 16)


def codec_round_trip(grid: np.ndarray, quality: int) -> np.ndarray:
    """Levels of 0 to 255 after the transform, quantising and back, in blocks of 8 x 8 (edges repeated to fill)."""
    h, w = grid.shape
    padded = np.pad(grid, ((0, -h % 8), (0, -w % 8)), mode="edge") - 128
    blocks = padded.reshape(padded.shape[0] // 8, 8, padded.shape[1] // 8, 8).swapaxes(1, 2)
    basis, quanta = cosines(), quantisation(quality)
    levels = np.floor(np.round(basis @ blocks @ basis.T / quanta, 9) + 0.5) * quanta
    back = (basis.T @ levels @ basis).swapaxes(1, 2).reshape(padded.shape)[:h, :w] + 128
    return np.clip(np.floor(np.round(back, 6) + 0.5), 0, 255)


# Similarity


def windowed_ssim(a: np.ndarray, b: np.ndarray, window: int = 7, span: float = 1.0) -> float:
    """Mean structural similarity over all whole windows, with sample covariances."""
    va, vb = (np.lib.stride_tricks.sliding_window_view(x, (window, window)).reshape(-1, window * window) for x in (a, b))
    ma, mb, n = va.mean(axis=1), vb.mean(axis=1), window * window
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    saa, sbb = va.var(axis=1) * n / (n - 1), vb.var(axis=1) * n / (n - 1)
    sab = ((va - ma[:, None]) * (vb - mb[:, None])).sum(axis=1) / (n - 1)
    return float(np.mean((2 * ma * mb + c1) * (2 * sab + c2) / ((ma**2 + mb**2 + c1) * (saa + sbb + c2))))


def _halved(y: np.ndarray) -> np.ndarray:
    return box_average(y, 2)


def _same(y: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Correlation of the image, mirrored at its edges, with a kernel whose cell (rows // 2, columns // 2) is the pixel."""
    a, b = kernel.shape
    padded = np.pad(y, ((a // 2, a - a // 2), (b // 2, b - b // 2)), mode="symmetric")
    return np.einsum("yxij,ij->yx", np.lib.stride_tricks.sliding_window_view(padded, kernel.shape)[: y.shape[0], : y.shape[1]], kernel)


def haar_distance(a: np.ndarray, b: np.ndarray, c: float = 30.0, alpha: float = 4.2) -> float:
    """One less the Haar perceptual similarity of two luma images of 0 to 255: 0 for equals."""
    a, b = _halved(a), _halved(b)
    top = bottom = 0.0
    for upright in (False, True):
        found = []
        for n in (2, 4, 8):
            kernel = np.outer(np.full(n, 1 / n), np.repeat([2 / n, -2 / n], n // 2))
            found.append([np.abs(_same(x, kernel.T if upright else kernel)) for x in (a, b)])
        alike = sum((2 * p * q + c) / (p * p + q * q + c) for p, q in found[:2]) / 2
        weight = np.maximum(*found[2])
        top += (weight / (1 + np.exp(-alpha * alike))).sum()
        bottom += weight.sum()
    if bottom <= 0:
        return 0.0
    mean = min(max(top / bottom, 1e-12), 1 - 1e-12)
    return float(1 - min(max((np.log(mean / (1 - mean)) / alpha) ** 2, 0.0), 1.0))


# Distances, contours, rings


def distance_transform(mask: np.ndarray) -> np.ndarray:
    """Squared distance of every pixel to the nearest one of the mask (infinite without one), exact: columns first, then rows."""
    h, w = mask.shape
    rows = np.arange(h)
    down = np.full((h, w), np.inf)
    for x in range(w):
        on = rows[mask[:, x]]
        if len(on):
            place = np.searchsorted(on, rows)
            left, right = on[np.maximum(place - 1, 0)], on[np.minimum(place, len(on) - 1)]
            down[:, x] = np.minimum(np.abs(rows - left), np.abs(rows - right)) ** 2
    apart = (np.arange(w)[:, None] - np.arange(w)[None, :]) ** 2
    return np.stack([(row[None, :] + apart).min(axis=1) for row in down])


def contours(field: np.ndarray, level: float = 0.5) -> list[np.ndarray]:
    """Closed lines at a level by marching squares; the outside of the image is zero, and pixel centres are at whole numbers."""
    g = np.pad(field, 1)
    inside = g >= level
    after: dict[tuple, tuple] = {}

    for j, i in np.ndindex(g.shape[0] - 1, g.shape[1] - 1):
        # Clockwise from the top left; side k lies between corners k and k + 1.
        corner = [inside[j, i], inside[j, i + 1], inside[j + 1, i + 1], inside[j + 1, i]]
        edges = [("h", j, i), ("v", j, i + 1), ("h", j + 1, i), ("v", j, i)]
        leaves = [k for k in range(4) if corner[k] and not corner[(k + 1) % 4]]
        # At a saddle the cell's mean says whether the inside corners are joined.
        joined = len(leaves) == 2 and g[j : j + 2, i : i + 2].mean() >= level
        for k in range(4):
            if corner[(k + 1) % 4] and not corner[k]:
                after[edges[k]] = edges[leaves[0] if len(leaves) == 1 else (k + (3 if joined else 1)) % 4]

    def place(edge: tuple[str, int, int]) -> tuple[float, float]:
        kind, j, i = edge
        a, b = g[j, i], g[j, i + 1] if kind == "h" else g[j + 1, i]
        t = 0.5 if abs(b - a) < 1e-12 else min(max((level - a) / (b - a), 0.0), 1.0)
        return (i - 1 + t, j - 1.0) if kind == "h" else (i - 1.0, j - 1 + t)

    lines, seen = [], set()
    for start in sorted(after, key=lambda e: (e[1], e[2], e[0])):
        line, edge = [], start
        while edge not in seen:
            seen.add(edge)
            line.append(place(edge))
            edge = after[edge]
        if len(line) >= 3:
            lines.append(np.array(line))
    return lines


def face_rings(label: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """The closed boundary rings of each 4-connected face: its number and the corners, the face on the left in image coordinates (y down).

    Outer rings have a positive area, holes a negative one. At a corner where a face meets itself
    the ring turns so that its parts stay apart.
    """
    h, w = label.shape
    framed = np.pad(label, 1, constant_values=-1)
    steps: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
    for y, x in np.ndindex(h, w):
        f = int(label[y, x])
        for (ny, nx), a, b in (((y - 1, x), (x, y), (x + 1, y)), ((y, x + 1), (x + 1, y), (x + 1, y + 1)), ((y + 1, x), (x + 1, y + 1), (x, y + 1)), ((y, x - 1), (x, y + 1), (x, y))):
            if framed[ny + 1, nx + 1] != f:
                steps.setdefault((f, *a), []).append(b)
    rings = []
    for start in sorted(steps):
        while steps.get(start):
            f, at, ring, heading = start[0], start[1:], [], None
            while True:
                options = steps[f, *at]
                # Clockwise on the screen: the sharpest turn to the right keeps to the same pixel's side.
                to = options[0] if heading is None or len(options) == 1 else min(options, key=lambda b: 0 if (heading[0] * (b[1] - at[1]) - heading[1] * (b[0] - at[0])) > 0 else 1)
                options.remove(to)
                if heading is None or (to[0] - at[0], to[1] - at[1]) != heading:
                    ring.append(at)
                heading, at = (to[0] - at[0], to[1] - at[1]), to
                if at == start[1:]:
                    break
            first = (ring[1][0] - ring[0][0], ring[1][1] - ring[0][1])
            if np.sign(first[0]) == heading[0] and np.sign(first[1]) == heading[1]:
                ring = ring[1:]
            rings.append((f, np.array(ring)))
    return rings


def ring_area(ring: np.ndarray) -> float:
    x, y = ring[:, 0], ring[:, 1]
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def clipped_cover(polygon: np.ndarray, width: int, height: int) -> np.ndarray:
    """Exact share of each pixel that a simple polygon covers: it is clipped to the pixel's row, then to the pixel."""

    def cut(points: list[tuple[float, float]], axis: int, bound: float, keep_above: bool) -> list[tuple[float, float]]:
        out = []
        for p, q in zip(points, points[1:] + points[:1], strict=True):
            inside_p, inside_q = ((v[axis] >= bound) if keep_above else (v[axis] <= bound) for v in (p, q))
            if inside_p:
                out.append(p)
            if inside_p != inside_q:
                t = (bound - p[axis]) / (q[axis] - p[axis])
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        return out

    cover = np.zeros((height, width))
    whole = [tuple(p) for p in polygon.tolist()]
    low, high = np.floor(polygon.min(axis=0)).astype(int), np.ceil(polygon.max(axis=0)).astype(int)
    for y in range(max(low[1], 0), min(high[1], height)):
        row = cut(cut(whole, 1, y, True), 1, y + 1, False)
        for x in range(max(low[0], 0), min(high[0], width)):
            cell = cut(cut(row, 0, x, True), 0, x + 1, False)
            if len(cell) >= 3:
                cover[y, x] = abs(ring_area(np.array(cell)))
    return cover


# Thinning


def thinned(ink: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """A one-pixel skeleton: rounds of two passes of simultaneous deletions until neither deletes; the frame is kept.

    With `rounds`, what so many rounds leave, settled or not; no query asks for that.
    """
    ink = ink.astype(bool).copy()
    if min(ink.shape) < 3:
        return ink
    moved, done = True, 0
    while moved and (rounds is None or done < rounds):
        moved, done = False, done + 1
        for second in (False, True):
            n, ne, e, se, s, sw, w, nw = (
                ink[1 + dy : ink.shape[0] - 1 + dy, 1 + dx : ink.shape[1] - 1 + dx] for dx, dy in ((0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1))
            )
            ring = [n, ne, e, se, s, sw, w, nw]
            count = sum(p.astype(int) for p in ring)
            turns = sum((~p & q).astype(int) for p, q in zip(ring, ring[1:] + ring[:1], strict=True))
            free = ~(n & e & w) & ~(n & s & w) if second else ~(n & e & s) & ~(e & s & w)
            gone = ink[1:-1, 1:-1] & (count >= 2) & (count <= 6) & (turns == 1) & free
            if gone.any():
                moved = True
                ink[1:-1, 1:-1] &= ~gone
    return ink


def capped(label: np.ndarray, cap: int, components: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Labels in which at most `cap` components are left: rounds that give the smallest to their commonest neighbours.

    A component is passed over in a round if a neighbour has moved in it, or if another has moved to it.
    """
    label = label.copy()
    while True:
        part = components(label)
        n = int(part.max()) + 1
        if n <= max(cap, 1):
            return label
        size = np.bincount(part.ravel(), minlength=n)
        state = np.zeros(n, int)
        for c in sorted(range(n), key=lambda c: (size[c], c))[: n - max(cap, 1)]:
            if state[c]:
                continue
            at = np.argwhere(part == c)
            near = [(y + dy, x + dx) for y, x in at.tolist() for dy, dx in ((0, -1), (0, 1), (-1, 0), (1, 0)) if 0 <= y + dy < label.shape[0] and 0 <= x + dx < label.shape[1]]
            near = [p for p in near if part[p] != c]
            if not near or any(state[part[p]] == 1 for p in near):
                continue
            votes = np.bincount([label[p] for p in near])
            best = int(votes.argmax())
            label[part == c] = best
            state[c] = 1
            for p in near:
                if label[p] == best and state[part[p]] == 0:
                    state[part[p]] = 2
