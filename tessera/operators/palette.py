"""Palettes and per-image estimators: distinct colours, modes, nearest inks, noise, gradients.

An image's pixels meet in windows or groups by image; palettes are joined by image, so a pixel
sees its own image's inks only. Floor-index and lower quantiles are row numbers, without
interpolation.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import colour as C

MODE_CELLS = 24
NOISE_SHARE, NOISE_POINT, NOISE_FLOOR = 0.10, 0.12566, 0.5 / 255


def _row():
    return Window.partitionBy("image_id", "y").orderBy("x")


def _column():
    return Window.partitionBy("image_id", "x").orderBy("y")


def distinct_colours(pixels: DataFrame) -> DataFrame:
    """Dictionary of colours: image_id, colour_id by first appearance, r, g, b, n, first (x and y)."""
    seen = pixels.groupBy("image_id", "r", "g", "b").agg(F.min(F.struct("y", "x")).alias("first"), F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("image_id").orderBy("first")
    return seen.select("image_id", (F.row_number().over(order) - 1).alias("colour_id"), "r", "g", "b", "n", F.col("first.x").alias("first_x"), F.col("first.y").alias("first_y"))


def frequency_modes(lab: DataFrame) -> DataFrame:
    """Occupied cells of a 24-cube over OKLab: image_id, rank (by count, then cell), cell, n and the mean colour.

    Colours count to four digits, means have six.
    """
    top = MODE_CELLS - 1

    def cell(v: Column) -> Column:
        return F.floor(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) * top + 0.5).cast("int")

    key = cell(F.col("l")) * MODE_CELLS * MODE_CELLS + cell((F.col("a") + 0.4) / 0.8) * MODE_CELLS + cell((F.col("b") + 0.4) / 0.8)
    n = F.count(F.lit(1))
    # Whole ten-thousandths add up exactly in any order; halves of the last digit go up.
    means = [(F.floor(F.sum(F.round(F.col(x) * 10_000).cast("long")) * 100 / n + 0.5) / 1e6).alias(x) for x in "lab"]
    cells = lab.withColumn("cell", key).groupBy("image_id", "cell").agg(n.alias("n"), *means)
    return cells.withColumn("rank", F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("n"), "cell")))


def _palettes(inks: DataFrame, axes: tuple[str, ...]) -> DataFrame:
    """One row an image with the array of its inks, by number; a palette is some tens of inks at most."""
    return inks.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("ink_id", *axes))).alias("inks"))


def nearest_ink(pixels: DataFrame, inks: DataFrame, axes: tuple[str, ...] = ("l", "a", "b")) -> DataFrame:
    """Each pixel's nearest ink of its image and the squared distance, the lower index of equals.

    A pixel stays one row: it looks through its image's palette, and nothing is shuffled but palettes.
    """

    def far(ink: Column) -> Column:
        return F.round(sum(((F.col(x) - ink[x]) * (F.col(x) - ink[x]) for x in axes), F.lit(0.0)), 12)

    best = pixels.join(_palettes(inks, axes), "image_id").withColumn("m", F.array_min(F.transform("inks", lambda i: F.struct(far(i).alias("d"), i["ink_id"].alias("ink_id")))))
    return best.select("image_id", "x", "y", *axes, F.col("m.ink_id").alias("ink_id"), F.col("m.d").alias("d2"))


def refine_members(assigned: DataFrame, reach: float, axes: tuple[str, ...] = ("l", "a", "b")) -> DataFrame:
    """Each ink at the mean of the pixels that chose it within `reach`; weight is their share of all pixels."""
    total = assigned.groupBy("image_id").agg(F.count(F.lit(1)).alias("total"))
    members = assigned.filter(F.col("d2") <= reach * reach).groupBy("image_id", "ink_id").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(x), 9).alias(x) for x in axes])
    return members.join(total, "image_id").select("image_id", "ink_id", *axes, F.round(F.col("n") / F.col("total"), 9).alias("weight"))


def mixture_pairs(pixels: DataFrame, inks: DataFrame, axes: tuple[str, ...] = ("l", "a", "b")) -> DataFrame:
    """The pair of inks whose segment comes nearest a pixel (first of equals): a_id, b_id, residual, dominant."""
    first = inks.select("image_id", F.col("ink_id").alias("a_id"), *[F.col(x).alias(f"p_{x}") for x in axes])
    other = inks.select("image_id", F.col("ink_id").alias("b_id"), *[F.col(x).alias(f"q_{x}") for x in axes])
    pairs = first.join(other, "image_id").filter("a_id < b_id")
    sides = [f"{s}_{x}" for s in "pq" for x in axes]
    held = pairs.groupBy("image_id").agg(F.collect_list(F.struct("a_id", "b_id", *sides)).alias("pairs"))

    def choice(k: Column) -> Column:
        t = C.blend_position([F.col(x) for x in axes], [k[f"p_{x}"] for x in axes], [k[f"q_{x}"] for x in axes])
        d = sum(((F.col(x) - k[f"p_{x}"] - t * (k[f"q_{x}"] - k[f"p_{x}"])) ** 2 for x in axes), F.lit(0.0))
        return F.struct(F.round(F.sqrt(d), 6).alias("residual"), k["a_id"].alias("a_id"), k["b_id"].alias("b_id"), F.when(t < 0.5, k["a_id"]).otherwise(k["b_id"]).alias("dominant"))

    best = pixels.join(held, "image_id").withColumn("m", F.array_min(F.transform("pairs", choice)))
    return best.select("image_id", "x", "y", "m.a_id", "m.b_id", "m.residual", "m.dominant")


def straddle_fraction(labels: DataFrame) -> DataFrame:
    """Per label, the share of its pixels next to (of eight) another label."""
    near = labels.withColumns({"lo": F.least(*[F.coalesce(f("label").over(_row()), "label") for f in (F.lag, F.lead)], "label"), "hi": F.greatest(*[F.coalesce(f("label").over(_row()), "label") for f in (F.lag, F.lead)], "label")})
    window = _column().rowsBetween(-1, 1)
    mixed = (F.min("lo").over(window) != F.col("label")) | (F.max("hi").over(window) != F.col("label"))
    return near.select("image_id", "label", mixed.cast("double").alias("m")).groupBy("image_id", "label").agg(F.round(F.avg("m"), 6).alias("straddle"), F.count(F.lit(1)).alias("n"))


def kth_of_group(rows: DataFrame, by: list[str], value: str, index: Column) -> DataFrame:
    """The element at a 0-based index of each group's sorted values; index may use the group's count `n`."""
    group = Window.partitionBy(*by)
    ranked = rows.select(*by, value, (F.row_number().over(group.orderBy(value)) - 1).alias("i"), F.count(F.lit(1)).over(group).alias("n"))
    return ranked.filter(F.col("i") == index).select(*by, value, "n")


def noise_sigma(pixels: DataFrame) -> DataFrame:
    """Noise of each image: the element at floor(n / 10) of the four-neighbour Laplacian's magnitudes, scaled, with a floor."""
    around = [f("v").over(w) for f in (F.lag, F.lead) for w in (_row(), _column())]
    inner = pixels.select("image_id", F.round(F.abs(4 * F.col("v") - around[0] - around[1] - around[2] - around[3]), 12).alias("h")).filter("h IS NOT NULL")
    found = kth_of_group(inner, ["image_id"], "h", F.floor(F.col("n") * F.lit(NOISE_SHARE)))
    return found.select("image_id", F.round(F.greatest(F.col("h") / NOISE_POINT / math.sqrt(20), F.lit(NOISE_FLOOR)), 9).alias("sigma"))


def weighted_lower_median(rows: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """The element at total / 2 (whole part) of the multiset of each group."""
    counts = rows.groupBy(*by, value).agg(F.sum(weight).alias("w"))
    group = Window.partitionBy(*by)
    upto, total = F.sum("w").over(group.orderBy(value)), F.sum("w").over(group)
    return counts.select(*by, value, upto.alias("upto"), F.floor(total / 2).alias("half")).filter("upto > half").groupBy(*by).agg(F.min(value).alias("median"))


def gradient(pixels: DataFrame) -> DataFrame:
    """Central differences, one-sided at the frame: image_id, x, y, gx, gy, magnitude."""

    def slope(order) -> Column:
        before, after = F.lag("v").over(order), F.lead("v").over(order)
        steps = before.isNotNull().cast("int") + after.isNotNull().cast("int")
        return (F.coalesce(after, "v") - F.coalesce(before, "v")) / F.greatest(steps, F.lit(1))

    out = pixels.select("image_id", "x", "y", slope(_row()).alias("gx"), slope(_column()).alias("gy"))
    return out.select("image_id", "x", "y", F.round("gx", 6).alias("gx"), F.round("gy", 6).alias("gy"), F.round(F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2), 6).alias("magnitude"))


def positional_sigma(magnitude: Column, sigma_a: Column, sigma_model: float) -> Column:
    spread = F.sqrt(F.pow(sigma_a / F.greatest(magnitude, F.lit(1e-9)), F.lit(2.0)) + sigma_model**2)
    return F.least(F.greatest(spread, F.lit(0.001)), F.lit(4.0))


def grid_contrast(pixels: DataFrame, period: int) -> DataFrame:
    """How much second differences along rows depend on x modulo a period: image_id, phase, mean magnitude."""
    second = F.lag("v").over(_row()) - 2 * F.col("v") + F.lead("v").over(_row())
    rows = pixels.select("image_id", (F.col("x") % period).alias("phase"), F.abs(second).alias("d")).filter("d IS NOT NULL")
    return rows.groupBy("image_id", "phase").agg(F.round(F.avg("d"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


def shading_share(steps: DataFrame, flat: float, strong: float) -> DataFrame:
    """Share of pixels whose gradient lies between flat and strong."""
    between = ((F.col("magnitude") > flat) & (F.col("magnitude") < strong)).cast("double")
    return steps.groupBy("image_id").agg(F.round(F.avg(between), 6).alias("shading"))


def precision_lambda(extent: Column, precision: float) -> Column:
    return F.ln(F.greatest(extent / precision, F.lit(math.e)))


def bic_lambda(n: Column) -> Column:
    return 0.5 * F.ln(F.greatest(n, F.lit(2)))


def psnr(a: DataFrame, b: DataFrame, peak: float = 1.0) -> DataFrame:
    """Peak signal-to-noise of each image's pair, null when they are equal."""
    joined = a.join(b.withColumnRenamed("v", "w"), ["image_id", "x", "y"]).groupBy("image_id").agg(F.avg((F.col("v") - F.col("w")) ** 2).alias("mse"))
    return joined.select("image_id", F.round("mse", 9).alias("mse"), F.when(F.col("mse") > 0, F.round(10 * F.log10(peak**2 / F.nullif("mse", F.lit(0.0))), 6)).alias("psnr"))


def linear_fill(pixels: DataFrame) -> DataFrame:
    """Least squares v = c + gx x + gy y of each group (image_id, label) from its moments; null where the positions lie on a line."""
    x, y, v = F.col("x").cast("double"), F.col("y").cast("double"), F.col("v")
    m = pixels.groupBy("image_id", "label").agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.avg(v).alias("mv"), F.covar_pop(x, x).alias("xx"), F.covar_pop(y, y).alias("yy"), F.covar_pop(x, y).alias("xy"),
        F.covar_pop(x, v).alias("xv"), F.covar_pop(y, v).alias("yv"), F.covar_pop(v, v).alias("vv"),
    )
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    ok = det > 1e-9
    safe = F.when(ok, det)
    m = m.withColumns({"gx": (F.col("xv") * F.col("yy") - F.col("yv") * F.col("xy")) / safe, "gy": (F.col("yv") * F.col("xx") - F.col("xv") * F.col("xy")) / safe})
    left = F.greatest(F.col("vv") - F.col("gx") * F.col("xv") - F.col("gy") * F.col("yv"), F.lit(0.0)) * F.col("n")
    return m.select("image_id", "label", "n", F.round("gx", 6).alias("gx"), F.round("gy", 6).alias("gy"), F.round(F.col("mv") - F.col("gx") * F.col("mx") - F.col("gy") * F.col("my"), 6).alias("c"), F.round(left, 6).alias("sse"))


def walked_palette(modes: DataFrame, merge: float, most: int) -> DataFrame:
    """Inks of the fixed threshold: modes in order, each kept unless one before lies within `merge`: image_id, ink_id, rank, l, a, b.

    A fold over the image's array of modes, which are cells of the colour cube, so bounded.
    """
    listed = modes.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("rank", "l", "a", "b"))).alias("modes"))

    def near(i: Column, m: Column) -> Column:
        return F.round(F.sqrt(sum(((i[x] - m[x]) * (i[x] - m[x]) for x in "lab"), F.lit(0.0))), 9) <= merge

    kept = F.aggregate(
        F.slice("modes", 2, F.greatest(F.size("modes"), F.lit(1))),
        F.slice("modes", 1, F.least(F.lit(1), F.lit(most))),
        lambda acc, m: F.when((F.size(acc) < most) & ~F.exists(acc, lambda i: near(i, m)), F.concat(acc, F.array(m))).otherwise(acc),
    )
    return listed.select("image_id", F.posexplode(kept).alias("ink_id", "i")).select("image_id", "ink_id", "i.rank", "i.l", "i.a", "i.b")


def _distances(points: np.ndarray, inks: np.ndarray) -> np.ndarray:
    return np.round(np.sqrt(((points[:, None, :] - inks[None, :, :]) ** 2).sum(axis=2)), 9)


def claim_of(points: np.ndarray, candidate: np.ndarray, accepted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which points are strictly nearer the candidate than any accepted ink, and their distances to it."""
    own = _distances(points, candidate[None, :])[:, 0]
    return own < (_distances(points, accepted).min(axis=1) if len(accepted) else np.full(len(points), np.inf)), own


def lower_median(values: np.ndarray) -> float:
    return float(np.sort(values)[len(values) // 2]) if len(values) else 0.0


def interior_share(claimed: np.ndarray) -> float:
    """Share of the claimed pixels whose four neighbours are claimed; the outside counts as claimed."""
    framed = np.pad(claimed, 1, constant_values=True)
    inside = claimed & framed[:-2, 1:-1] & framed[2:, 1:-1] & framed[1:-1, :-2] & framed[1:-1, 2:]
    return float(inside.sum() / claimed.sum()) if claimed.any() else 0.0


def _by_image(lab: DataFrame, modes: DataFrame, kernel, schema: str) -> DataFrame:
    """Rows of a kernel over each image's pixels (ordered by y, x) and modes (by rank)."""
    info = modes.select(F.col("image_id").alias("i"), "rank", "n", *[F.col(c).alias(f"m{c}") for c in "lab"])

    def run(pixels: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        pixels, own = pixels.sort_values(["y", "x"]), own.sort_values("rank")
        return kernel(pixels, own) if len(pixels) and len(own) else pd.DataFrame({x.split()[0]: [] for x in schema.split(", ")})

    return lab.groupBy("image_id").cogroup(info.groupBy("i")).applyInPandas(run, schema)


def claims(lab: DataFrame, modes: DataFrame, reach: float, width: int, height: int) -> DataFrame:
    """What each mode but the first would claim against those before it: image_id, rank, claim, spread (of members within `reach`), interior."""

    def kernel(pixels: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        points, inks = pixels[["l", "a", "b"]].to_numpy(), own[["ml", "ma", "mb"]].to_numpy()
        rows = []
        for k in range(1, len(inks)):
            claimed, d = claim_of(points, inks[k], inks[:k])
            share = interior_share(claimed.reshape(height, width))
            rows.append((pixels["image_id"].iloc[0], int(own["rank"].iloc[k]), int(claimed.sum()), lower_median(d[claimed & (d < reach)]), round(share, 6)))
        return pd.DataFrame(rows, columns=["image_id", "rank", "claim", "spread", "interior"])

    return _by_image(lab, modes, kernel, "image_id bigint, rank int, claim bigint, spread double, interior double")


def mdl_walk(points: np.ndarray, modes: np.ndarray, merge: float, sigma: float, weight: float, floor: float, most: int, interior) -> list[int]:
    """Which modes become inks: separated by `merge`, or else worth three parameters to keep apart, above the floor and with an inside."""
    accepted: list[int] = []
    for k in range(len(modes)):
        if len(accepted) >= most:
            break
        inks = modes[accepted]
        d = float(_distances(modes[k][None, :], inks).min()) if accepted else np.inf
        if d <= merge:
            claimed, _ = claim_of(points, modes[k], inks)
            escape = sigma > 0 and d > floor and 0.5 * claimed.sum() * (d / sigma) ** 2 > weight * 3
            if not escape or not interior(claimed):
                continue
        accepted.append(k)
    return accepted


def mdl_palette(lab: DataFrame, modes: DataFrame, merge: float, sigma: float, weight: float, floor: float, most: int, inside: float = 0.0) -> DataFrame:
    """The walk with the escape, then each ink moved to the mean of the pixels that choose it: image_id, ink_id, rank, l, a, b, share."""

    def kernel(pixels: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        points, inks = pixels[["l", "a", "b"]].to_numpy(), own[["ml", "ma", "mb"]].to_numpy()
        width = int(pixels["x"].max()) + 1
        kept = mdl_walk(points, inks, merge, sigma, weight, floor, most, lambda c: interior_share(c.reshape(-1, width)) > inside)
        far = _distances(points, inks[kept])
        chosen, near = far.argmin(axis=1), far.min(axis=1) <= merge
        rows = []
        for i, k in enumerate(kept):
            mine = points[(chosen == i) & near]
            centre = mine.mean(axis=0) if len(mine) else inks[k]
            rows.append((pixels["image_id"].iloc[0], i, int(own["rank"].iloc[k]), *np.round(centre, 9), len(mine) / len(points)))
        return pd.DataFrame(rows, columns=["image_id", "ink_id", "rank", "l", "a", "b", "share"])

    return _by_image(lab, modes, kernel, "image_id bigint, ink_id int, rank int, l double, a double, b double, share double")


def cielab(rgb: np.ndarray) -> np.ndarray:
    linear = np.where(rgb <= 0.04045, rgb / 12.92, ((rgb + 0.055) / 1.055) ** 2.4)
    t = linear @ np.array(C.TO_XYZ).T / np.array(C.WHITE)
    f = np.where(t > (6 / 29) ** 3, np.cbrt(t), t / (3 * (6 / 29) ** 2) + 4 / 29)
    return np.stack([116 * f[:, 1] - 16, 500 * (f[:, 0] - f[:, 1]), 200 * (f[:, 1] - f[:, 2])], axis=1)


def colour_difference(lab: np.ndarray, other: np.ndarray) -> np.ndarray:
    """CIEDE2000 of one CIELAB colour and each of others, over arrays."""
    mean = (np.hypot(lab[1], lab[2]) + np.hypot(other[:, 1], other[:, 2])) / 2

    def bend(c: np.ndarray) -> np.ndarray:
        return np.sqrt(c**7 / (c**7 + 25.0**7))

    grow = 1.5 - 0.5 * bend(mean)
    a1, a2, b1, b2 = lab[1] * grow, other[:, 1] * grow, lab[2], other[:, 2]
    c1, c2 = np.hypot(a1, b1), np.hypot(a2, b2)
    h1, h2 = np.degrees(np.arctan2(b1, a1)) % 360, np.degrees(np.arctan2(b2, a2)) % 360
    grey = c1 * c2 == 0
    turn = np.where(grey, 0, (h2 - h1 + 180) % 360 - 180)
    turn = np.where(~grey & (h2 - h1 == 180), 180, turn)
    total = h1 + h2
    hue = np.where(grey, total, np.where(np.abs(h1 - h2) <= 180, total / 2, np.where(total < 360, total / 2 + 180, total / 2 - 180)))
    light, chroma = (lab[0] + other[:, 0]) / 2, (c1 + c2) / 2
    wave = 1 - 0.17 * np.cos(np.radians(hue - 30)) + 0.24 * np.cos(np.radians(2 * hue)) + 0.32 * np.cos(np.radians(3 * hue + 6)) - 0.2 * np.cos(np.radians(4 * hue - 63))
    x = (other[:, 0] - lab[0]) / (1 + 0.015 * (light - 50) ** 2 / np.sqrt(20 + (light - 50) ** 2))
    y = (c2 - c1) / (1 + 0.045 * chroma)
    z = 2 * np.sqrt(c1 * c2) * np.sin(np.radians(turn / 2)) / (1 + 0.015 * chroma * wave)
    twist = -2 * bend(chroma) * np.sin(np.radians(60 * np.exp(-(((hue - 275) / 25) ** 2))))
    return np.sqrt(np.maximum(x * x + y * y + z * z + twist * y * z, 0))


def palette_size(rgb: np.ndarray, tolerance: float, most: int = 4000) -> int:
    """Colours told apart by more than a tolerance: the distinct 8-bit colours in order, each counted unless near one before.

    Over `most` distinct colours are far past any palette, and are the count themselves.
    """
    distinct = np.unique(np.floor(np.round(rgb * 255, 9)).astype(np.uint8), axis=0)
    if len(distinct) > most:
        return len(distinct)
    lab, kept = cielab(distinct / 255), []
    for c in lab:
        if not kept or colour_difference(c, np.array(kept)).min() > tolerance:
            kept.append(c)
    return len(kept)
