"""Differences between two rasters or label maps of an image, and choices between fills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUANTUM = 0.5 / 255
# Parameters of each fill model.
FILL_PARAMETERS = {"flat": 3, "linear": 10}


def _row():
    return Window.partitionBy("image_id", "y").orderBy("x")


def _column():
    return Window.partitionBy("image_id", "x").orderBy("y")


def prewitt(pixels: DataFrame, value: str, out: str) -> DataFrame:
    """Adds the gradient magnitude of 3 x 3 differences; null on the frame."""
    rows = pixels.withColumns({"__l": F.lag(value).over(_row()), "__r": F.lead(value).over(_row())})
    rows = rows.withColumns({"__d": F.col("__r") - F.col("__l"), "__s": F.col("__l") + F.col(value) + F.col("__r")})
    whole = _column().rowsBetween(-1, 1)
    full = F.count("__d").over(whole) == 3
    gx = F.when(full, F.sum("__d").over(whole) / 3)
    gy = (F.lead("__s").over(_column()) - F.lag("__s").over(_column())) / 3
    return rows.withColumns({"__gx": gx, "__gy": gy}).withColumn(out, F.sqrt(F.col("__gx") ** 2 + F.col("__gy") ** 2)).drop("__l", "__r", "__d", "__s", "__gx", "__gy")


def gmsd(pairs: DataFrame, constant: float = 0.0026) -> DataFrame:
    """Population deviation of gradient-magnitude similarity of v and w: image_id, gmsd."""
    both = prewitt(prewitt(pairs, "v", "m"), "w", "n").filter("m IS NOT NULL AND n IS NOT NULL")
    alike = (2 * F.col("m") * F.col("n") + constant) / (F.col("m") ** 2 + F.col("n") ** 2 + constant)
    return both.select("image_id", alike.alias("s")).groupBy("image_id").agg(F.round(F.stddev_pop("s"), 6).alias("gmsd"))


def ssim(pairs: DataFrame, c1: float = 1e-4, c2: float = 9e-4) -> DataFrame:
    """Structural similarity of v and w over one window, the whole image."""
    m = pairs.groupBy("image_id").agg(F.avg("v").alias("a"), F.avg("w").alias("b"), F.var_pop("v").alias("va"), F.var_pop("w").alias("vb"), F.covar_pop("v", "w").alias("c"))
    top = (2 * F.col("a") * F.col("b") + c1) * (2 * F.col("c") + c2)
    return m.select("image_id", F.round(top / ((F.col("a") ** 2 + F.col("b") ** 2 + c1) * (F.col("va") + F.col("vb") + c2)), 6).alias("ssim"))


def seam_fraction(pairs: DataFrame, opaque: float = 0.9, clear: float = 0.5) -> DataFrame:
    """Share of pixels where the reference (v) is opaque and the candidate (w) is not."""
    seam = ((F.col("v") >= opaque) & (F.col("w") <= clear)).cast("double")
    return pairs.groupBy("image_id").agg(F.round(F.avg(seam), 6).alias("seam"))


def fill_chi2(residual: Column, sigma: float) -> Column:
    """A residual beyond half an 8-bit step, in sigmas, squared."""
    beyond = F.greatest(F.abs(residual) - QUANTUM, F.lit(0.0)) / sigma
    return beyond * beyond


def fill_select(pixels: DataFrame, fits: DataFrame, sigma: float, weight: float) -> DataFrame:
    """The cheaper of a flat and a linear fill of each region, the simpler of equals: cost 0.5 chi2 + weight * parameters.

    fits: image_id, label and the linear model's c, gx, gy (null where it has none).
    """
    mean = F.avg("v").over(Window.partitionBy("image_id", "label"))
    rows = pixels.withColumn("mean", mean).join(fits.select("image_id", "label", "c", "gx", "gy"), ["image_id", "label"])
    line = F.col("c") + F.col("gx") * F.col("x") + F.col("gy") * F.col("y")
    sums = rows.groupBy("image_id", "label").agg(F.sum(fill_chi2(F.col("v") - F.col("mean"), sigma)).alias("f"), F.sum(fill_chi2(F.col("v") - line, sigma)).alias("l"))
    flat = F.round(0.5 * F.col("f") + weight * FILL_PARAMETERS["flat"], 4)
    linear = F.round(0.5 * F.col("l") + weight * FILL_PARAMETERS["linear"], 4)
    better = F.coalesce(linear < flat, F.lit(False))
    return sums.select("image_id", "label", F.when(better, "linear").otherwise("flat").alias("model"), F.when(better, linear).otherwise(flat).alias("cost"))


def junction_votes(segments: DataFrame, degrees: DataFrame) -> DataFrame:
    """T-junctions: at nodes of degree three the label on both sides of the straight arm occludes the other two.

    segments: cracks. Votes for each pair of labels: image_id, low, high, low_over, high_over, occluder (null if both have votes).
    """
    ends = F.explode(F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"))))
    arms = segments.withColumn("e", ends).select("image_id", "e.x", "e.y", "before", "after", (F.col("x0") == F.col("x1")).alias("upright"))
    three = arms.join(degrees.filter("degree = 3").select("image_id", "x", "y"), ["image_id", "x", "y"])
    at = three.groupBy("image_id", "x", "y").agg(
        F.sum(F.col("upright").cast("int")).alias("n_up"),
        F.collect_set(F.when(F.col("upright"), F.array("before", "after"))).alias("up"),
        F.collect_set(F.when(~F.col("upright"), F.array("before", "after"))).alias("flat"),
    )
    straight, stem = F.when(F.col("n_up") == 2, F.col("up")).otherwise(F.col("flat")), F.when(F.col("n_up") == 2, F.col("flat")).otherwise(F.col("up"))
    over = F.array_intersect(F.element_at(straight, 1), F.element_at(straight, -1))
    votes = at.select("image_id", over.alias("over"), F.flatten(stem).alias("under")).filter(F.size("over") == 1).select("image_id", F.element_at("over", 1).alias("top"), F.explode(F.array_distinct("under")).alias("bottom")).filter("top <> bottom")
    keyed = votes.groupBy("image_id", F.least("top", "bottom").alias("low"), F.greatest("top", "bottom").alias("high")).agg(F.sum((F.col("top") < F.col("bottom")).cast("long")).alias("low_over"), F.sum((F.col("top") > F.col("bottom")).cast("long")).alias("high_over"))
    return keyed.withColumn("occluder", F.when(F.col("high_over") == 0, F.col("low")).when(F.col("low_over") == 0, F.col("high")))
