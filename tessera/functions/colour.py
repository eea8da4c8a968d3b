"""Colour as column expressions: transfer curves, OKLab, CIELAB, CIEDE2000, luma, alpha."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published OKLab matrices (gamma-free sRGB to cone-like responses, then to L, a, b) and their inverses.
TO_LMS = ((0.41222147, 0.53633255, 0.051445995), (0.2119035, 0.6806995, 0.10739696), (0.08830246, 0.28171885, 0.6299787))
TO_LAB = ((0.21045426, 0.7936178, -0.004072047), (1.9779985, -2.4285922, 0.4505937), (0.025904037, 0.78277177, -0.80867577))
FROM_LAB = ((1.0, 0.39633778, 0.21580376), (1.0, -0.105561346, -0.06385417), (1.0, -0.08948418, -1.2914855))
FROM_LMS = ((4.0767417, -3.3077116, 0.23096994), (-1.268438, 2.6097574, -0.34131938), (-0.0041960863, -0.7034186, 1.7076147))
# Linear sRGB to XYZ and the D65 white.
TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)


def _times(matrix: tuple[tuple[float, ...], ...], values: list[Column]) -> list[Column]:
    return [values[0] * row[0] + values[1] * row[1] + values[2] * row[2] for row in matrix]


def srgb_to_linear(c: Column) -> Column:
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(c: Column) -> Column:
    """Not clamped."""
    return F.when(c <= 0.0031308, c * 12.92).otherwise(1.055 * F.pow(F.greatest(c, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055)


def cube_root(c: Column) -> Column:
    return F.signum(c) * F.pow(F.abs(c), F.lit(1 / 3))


def srgb_to_oklab(r: Column, g: Column, b: Column) -> list[Column]:
    """L, a, b."""
    return _times(TO_LAB, [cube_root(x) for x in _times(TO_LMS, [srgb_to_linear(x) for x in (r, g, b)])])


def oklab_to_srgb(lightness: Column, a: Column, b: Column) -> list[Column]:
    """Clamped to [0, 1]."""
    linear = _times(FROM_LMS, [x * x * x for x in _times(FROM_LAB, [lightness, a, b])])
    return [F.least(F.greatest(linear_to_srgb(x), F.lit(0.0)), F.lit(1.0)) for x in linear]


def oklab_distance(p: list[Column], q: list[Column]) -> Column:
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(p, q, strict=True)), F.lit(0.0)))


def srgb_to_cielab(r: Column, g: Column, b: Column) -> list[Column]:
    """L in 0..100, against D65."""

    def f(t: Column) -> Column:
        return F.when(t > (6 / 29) ** 3, cube_root(t)).otherwise(t / (3 * (6 / 29) ** 2) + 4 / 29)

    x, y, z = (f(v / w) for v, w in zip(_times(TO_XYZ, [srgb_to_linear(v) for v in (r, g, b)]), WHITE, strict=True))
    return [116 * y - 16, 500 * (x - y), 200 * (y - z)]


def _hue(a: Column, b: Column) -> Column:
    """Degrees in [0, 360); 0 for greys."""
    degrees = F.atan2(b, a) * (180 / math.pi)
    return F.when((a == 0) & (b == 0), 0.0).when(degrees < 0, degrees + 360).otherwise(degrees)


def ciede2000(p: list[Column], q: list[Column]) -> Column:
    """Colour difference of two CIELAB colours, all weights one."""

    def cos(degrees: Column) -> Column:
        return F.cos(degrees * (math.pi / 180))

    def power7(c: Column) -> Column:
        return F.sqrt(F.pow(c, F.lit(7.0)) / (F.pow(c, F.lit(7.0)) + 25.0**7))

    (l1, a1, b1), (l2, a2, b2) = p, q
    chroma = (F.sqrt(a1 * a1 + b1 * b1) + F.sqrt(a2 * a2 + b2 * b2)) / 2
    stretch = 1 + 0.5 * (1 - power7(chroma))
    a1, a2 = a1 * stretch, a2 * stretch
    c1, c2 = F.sqrt(a1 * a1 + b1 * b1), F.sqrt(a2 * a2 + b2 * b2)
    h1, h2 = _hue(a1, b1), _hue(a2, b2)
    grey = c1 * c2 == 0
    turn = F.when(grey, 0.0).when(h2 - h1 > 180, h2 - h1 - 360).when(h2 - h1 < -180, h2 - h1 + 360).otherwise(h2 - h1)
    d_l, d_c, d_h = l2 - l1, c2 - c1, 2 * F.sqrt(c1 * c2) * F.sin(turn * (math.pi / 360))
    mid_l, mid_c = (l1 + l2) / 2, (c1 + c2) / 2
    far = F.abs(h1 - h2) > 180
    mid_h = F.when(grey, h1 + h2).when(far & (h1 + h2 < 360), (h1 + h2 + 360) / 2).when(far, (h1 + h2 - 360) / 2).otherwise((h1 + h2) / 2)
    t = 1 - 0.17 * cos(mid_h - 30) + 0.24 * cos(2 * mid_h) + 0.32 * cos(3 * mid_h + 6) - 0.20 * cos(4 * mid_h - 63)
    around = F.exp(-((mid_h - 275) / 25) * ((mid_h - 275) / 25))
    turned = F.sin(60 * around * (math.pi / 180)) * -2 * power7(mid_c)
    low = (mid_l - 50) * (mid_l - 50)
    s_l, s_c, s_h = 1 + 0.015 * low / F.sqrt(20 + low), 1 + 0.045 * mid_c, 1 + 0.015 * mid_c * t
    x, y, z = d_l / s_l, d_c / s_c, d_h / s_h
    return F.sqrt(F.greatest(x * x + y * y + z * z + turned * y * z, F.lit(0.0)))


def luma(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def ycbcr(r: Column, g: Column, b: Column) -> list[Column]:
    """Full range, channels in 0..255."""
    y = luma(r, g, b)
    return [y, 128 + (b - y) * (0.5 / 0.886), 128 + (r - y) * (0.5 / 0.701)]


def byte(c: Column) -> Column:
    return F.floor(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)) * 255 + 0.5).cast("int")


def hex_colour(r: Column, g: Column, b: Column) -> Column:
    return F.lower(F.concat(F.lit("#"), *(F.lpad(F.hex(byte(x).cast("long")), 2, "0") for x in (r, g, b))))


def composite_over(colour: Column, alpha: Column, ground: Column) -> Column:
    """An sRGB channel over a ground, mixed in linear light."""
    return linear_to_srgb(srgb_to_linear(colour) * alpha + srgb_to_linear(ground) * (1 - alpha))


def blend_position(c: list[Column], a: list[Column], b: list[Column]) -> Column:
    """Where c projects on the segment from a to b, in [0, 1]; 0 if a is b."""
    along = sum(((z - x) * (y - x) for x, y, z in zip(a, b, c, strict=True)), F.lit(0.0))
    length = sum(((y - x) * (y - x) for x, y in zip(a, b, strict=True)), F.lit(0.0))
    return F.when(length == 0, 0.0).otherwise(F.least(F.greatest(along / F.when(length == 0, 1.0).otherwise(length), F.lit(0.0)), F.lit(1.0)))


def huber(z: Column, kappa: float) -> Column:
    return F.when(F.abs(z) <= kappa, z * z).otherwise(kappa * (2 * F.abs(z) - kappa))


# Two grounds: a translucent colour is known by how it shows over white and over grey.

GREY = 0.5
# Names of greys by the lightness they exceed, and of hues by the degrees they stay under.
GREY_NAMES = ((0.93, "white"), (0.72, "light-grey"), (0.42, "grey"), (0.18, "dark-grey"))
HUE_NAMES = ((20, "red"), (45, "orange"), (70, "yellow"), (100, "olive"), (165, "green"), (200, "teal"), (240, "cyan"), (285, "blue"), (320, "purple"), (345, "magenta"))


def colour_name(lightness: Column, a: Column, b: Column) -> Column:
    """A basic word for an OKLab colour: greys by lightness, others by hue; dark reds and oranges are brown."""
    grey = F
    for least, name in GREY_NAMES:
        grey = grey.when(lightness > least, name)
    degrees = F.atan2(b, a) * (180 / math.pi)
    hue = F.when(degrees < 0, degrees + 360).otherwise(degrees)
    word = F
    for most, name in HUE_NAMES:
        word = word.when(hue < most, name)
    word = word.otherwise("red")
    word = F.when(word.isin("red", "orange") & (lightness < 0.5), "brown").otherwise(word)
    return F.when(F.sqrt(a * a + b * b) < 0.03, grey.otherwise("black")).otherwise(word)


def on_white(colour: Column, alpha: Column) -> Column:
    """An encoded channel over white, mixed as it is stored."""
    return colour * alpha + (1 - alpha)


def on_grey(white: Column, alpha: Column) -> Column:
    """The same channel over the second ground, from what it is over white."""
    return F.greatest(white - (1 - F.least(F.greatest(alpha, F.lit(0.0)), F.lit(1.0))) * (1 - GREY), F.lit(0.0))


def snap_alpha(alpha: Column) -> Column:
    """Opacity in [0, 1], exactly 0 or 1 within measurement of either."""
    held = F.least(F.greatest(alpha, F.lit(0.0)), F.lit(1.0))
    return F.when(held > 0.995, 1.0).when(held < 0.005, 0.0).otherwise(held)


def two_ground_alpha(white: list[Column], grey: list[Column]) -> Column:
    """The opacity that the encoded channels over both grounds imply."""
    apart = sum((w - k for w, k in zip(white, grey, strict=True)), F.lit(0.0)) / 3
    return snap_alpha(1 - apart / (1 - GREY))


def two_ground_distance(p: list[Column], q: list[Column]) -> Column:
    """The larger of the distances over either ground; six OKLab coordinates each."""
    return F.greatest(oklab_distance(p[:3], q[:3]), oklab_distance(p[3:], q[3:]))
