"""Regions of label maps: runs, components, contacts, cracks, rewriting and comparison.

A label map is rows of image_id, x, y, label. Neighbours are found by windows along rows and
columns where one direction is enough, so an image's pixels meet in one partition, and by
equi-joins on shifted coordinates otherwise. Images are independent; none is collected whole
but by the dense kernels, which take one image at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import checkpointed

OUTSIDE = 65_535


def _row():
    return Window.partitionBy("image_id", "y").orderBy("x")


def _column():
    return Window.partitionBy("image_id", "x").orderBy("y")


def row_runs(labels: DataFrame) -> DataFrame:
    """Maximal runs [x0, x1) of one label in a row: image_id, y, run, x0, x1, label."""
    change = (F.lag("label").over(_row()).isNull() | (F.lag("label").over(_row()) != F.col("label"))).cast("int")
    numbered = labels.withColumn("change", change).withColumn("run", F.sum("change").over(_row()).cast("int"))
    return numbered.groupBy("image_id", "y", "run").agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"), F.min("label").alias("label"))


def run_overlaps(runs: DataFrame, same_label: bool = False) -> DataFrame:
    """Intervals in which runs of adjacent rows overlap: image_id, y, upper, lower, x0, x1."""
    a, b = runs.alias("a"), runs.alias("b")
    on = (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a.y") + 1 == F.col("b.y")) & (F.col("a.x0") < F.col("b.x1")) & (F.col("b.x0") < F.col("a.x1"))
    if same_label:
        on &= F.col("a.label") == F.col("b.label")
    return a.join(b, on).select(
        "a.image_id", "a.y", F.col("a.run").alias("upper"), F.col("b.run").alias("lower"), F.greatest("a.x0", "b.x0").alias("x0"), F.least("a.x1", "b.x1").alias("x1")
    )


def label_components(grid: np.ndarray) -> np.ndarray:
    """Of one height x width label map, each pixel's component, numbered from 0 in raster order of first pixels.

    Runs of a row are joined to overlapping equal runs of the row above by union-find.
    """
    height, width = grid.shape
    starts = np.ones((height, width), bool)
    starts[:, 1:] = grid[:, 1:] != grid[:, :-1]
    run = np.cumsum(starts.ravel()).reshape(height, width) - 1
    parent = np.arange(run[-1, -1] + 1 if run.size else 0)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    touching = grid[1:] == grid[:-1]
    for a, b in np.unique(np.stack([run[:-1][touching], run[1:][touching]], axis=1), axis=0):
        x, y = root(int(a)), root(int(b))
        parent[max(x, y)] = min(x, y)
    roots = np.array([root(i) for i in range(len(parent))], np.int64)
    return np.searchsorted(np.unique(roots), roots)[run]


def components(images: DataFrame, width: int, height: int) -> DataFrame:
    """image_id, x, y, label, component of images given as image_id, labels (array<int>, row-major).

    An image is one row, so nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y = np.tile(np.arange(width), height), np.repeat(np.arange(height), width)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            grids = np.array(batch.column(1).to_pylist(), np.int32).reshape(n, height, width)
            found = np.concatenate([label_components(g).ravel() for g in grids])
            ids = np.repeat(batch.column(0).to_numpy(), width * height)
            out = (pa.array(ids, pa.int64()), *(pa.array(v, pa.int32()) for v in (np.tile(x, n), np.tile(y, n), grids.ravel(), found)))
            yield pa.RecordBatch.from_arrays(list(out), names=["image_id", "x", "y", "label", "component"])

    return images.mapInArrow(run, "image_id bigint, x int, y int, label int, component int")


def components_by_rounds(labels: DataFrame) -> DataFrame:
    """The same for images of any size, over the graph of runs: least run numbers spread until none changes.

    A run takes the least number among its neighbours', then that run's own, which halves the paths
    that are left. Rounds are checkpointed in the folder that the session names; use it where an image doesn't fit a task.
    """
    runs = row_runs(labels).withColumn("node", F.col("y").cast("long") * (1 << 32) + F.col("x0"))
    runs = checkpointed(runs)
    a, b = runs.alias("a"), runs.alias("b")
    meet = (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a.y") + 1 == F.col("b.y")) & (F.col("a.label") == F.col("b.label")) & (F.col("a.x0") < F.col("b.x1")) & (F.col("b.x0") < F.col("a.x1"))
    down = a.join(b, meet).select("a.image_id", F.col("a.node").alias("u"), F.col("b.node").alias("w"))
    edges = checkpointed(down.unionByName(down.select("image_id", F.col("w").alias("u"), F.col("u").alias("w"))))
    state = runs.select("image_id", F.col("node").alias("u"), F.col("node").alias("least"))
    moved = 1
    while moved:
        offers = edges.join(state, ["image_id", "u"]).select("image_id", F.col("w").alias("u"), "least").unionByName(state)
        nearer = offers.groupBy("image_id", "u").agg(F.min("least").alias("least"))
        further = state.select("image_id", F.col("u").alias("least"), F.col("least").alias("further"))
        new = checkpointed(nearer.join(further, ["image_id", "least"]).select("image_id", "u", F.least("least", "further").alias("least")))
        moved = new.alias("n").join(state.alias("o"), ["image_id", "u"]).filter(F.col("n.least") != F.col("o.least")).limit(1).count()
        state = new
    rank = F.dense_rank().over(Window.partitionBy("image_id").orderBy("least")) - 1
    named = state.withColumn("component", rank.cast("int")).join(runs.withColumnRenamed("node", "u"), ["image_id", "u"])
    return named.select("image_id", F.explode(F.sequence("x0", F.col("x1") - 1)).alias("x"), "y", "label", "component")


def component_sizes(pixels: DataFrame) -> DataFrame:
    """image_id, component, label, size, first_pixel (x and y of it)."""
    first = F.min(F.struct("y", "x"))
    return pixels.groupBy("image_id", "component").agg(F.min("label").alias("label"), F.count(F.lit(1)).alias("size"), first.alias("p")).select("image_id", "component", "label", "size", F.col("p.x").alias("first_x"), F.col("p.y").alias("first_y"))


def _sides(labels: DataFrame, value: str = "label") -> DataFrame:
    """A row for each pixel side between two pixels: image_id, p, q (values left/above, then right/below)."""
    right = labels.select("image_id", F.col(value).alias("p"), F.lead(value).over(_row()).alias("q"))
    below = labels.select("image_id", F.col(value).alias("p"), F.lead(value).over(_column()).alias("q"))
    return right.unionByName(below).filter("q IS NOT NULL")


def contacts(labels: DataFrame, value: str = "label") -> DataFrame:
    """How many pixel sides two values share: image_id, low, high, sides."""
    pairs = _sides(labels, value).filter("p <> q")
    return pairs.groupBy("image_id", F.least("p", "q").alias("low"), F.greatest("p", "q").alias("high")).agg(F.count(F.lit(1)).alias("sides"))


def contact_tally(pixels: DataFrame) -> DataFrame:
    """Per component and neighbouring label, the sides to other components: image_id, component, label, neighbour, sides."""
    keyed = pixels.withColumn("pair", F.struct("component", "label"))
    both = _sides(keyed, "pair")
    both = both.unionByName(both.select("image_id", F.col("q").alias("p"), F.col("p").alias("q"))).filter("p.component <> q.component")
    return both.groupBy("image_id", F.col("p.component").alias("component"), F.col("p.label").alias("label"), F.col("q.label").alias("neighbour")).agg(F.count(F.lit(1)).alias("sides"))


def commonest_neighbour(pixels: DataFrame) -> DataFrame:
    """The label with which a component shares most sides, the lower of equals: image_id, component, neighbour, sides."""
    order = Window.partitionBy("image_id", "component").orderBy(F.desc("sides"), "neighbour")
    return contact_tally(pixels).withColumn("n", F.row_number().over(order)).filter("n = 1").select("image_id", "component", "neighbour", "sides")


def despeckle_isolated(pixels: DataFrame, min_size: int) -> DataFrame:
    """One simultaneous pass: components under min_size take their commonest neighbour's label."""
    small = component_sizes(pixels).filter(F.col("size") < min_size).select("image_id", "component")
    moves = commonest_neighbour(pixels).join(small, ["image_id", "component"]).select("image_id", "component", "neighbour")
    return pixels.join(moves, ["image_id", "component"], "left").select("image_id", "x", "y", F.coalesce("neighbour", "label").alias("label"))


def despeckle(grid: np.ndarray, min_size: int) -> np.ndarray:
    """Components under min_size, in order, take the commonest label around them as edited so far."""
    if min_size <= 1:
        return grid.copy()
    found, out = label_components(grid), grid.copy()
    height, width = grid.shape
    for c in np.flatnonzero(np.bincount(found.ravel()) < min_size):
        votes: dict[int, int] = {}
        for y, x in np.argwhere(found == c):
            for v, u in ((y - 1, x), (y, x - 1), (y, x + 1), (y + 1, x)):
                if 0 <= v < height and 0 <= u < width and found[v, u] != c:
                    votes[int(out[v, u])] = votes.get(int(out[v, u]), 0) + 1
        if votes:
            out[found == c] = min(votes, key=lambda k: (-votes[k], k))
    return out


def despeckled(images: DataFrame, width: int, height: int, min_size: int) -> DataFrame:
    """image_id, x, y, label after `despeckle` of images given as image_id, labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y = np.tile(np.arange(width), height), np.repeat(np.arange(height), width)
        for batch in batches:
            n = batch.num_rows
            if n:
                grids = np.array(batch.column(1).to_pylist(), np.int32).reshape(n, height, width)
                flat = np.concatenate([despeckle(g, min_size).ravel() for g in grids])
                ids = np.repeat(batch.column(0).to_numpy(), width * height)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(v, pa.int32()) for v in (np.tile(x, n), np.tile(y, n), flat))], names=["image_id", "x", "y", "label"])

    return images.mapInArrow(run, "image_id bigint, x int, y int, label int")


def cracks(labels: DataFrame) -> DataFrame:
    """A unit segment for each pixel side between two labels, the frame's against OUTSIDE.

    image_id, x0, y0, x1, y1 (grid nodes), before, after (the labels above or left, and below or right).
    """
    x, y, own = F.col("x"), F.col("y"), F.col("label")

    def segments(order, dx: int, dy: int) -> DataFrame:
        after = F.lead("label").over(order)
        inner = labels.select("image_id", "x", "y", own.alias("before"), F.coalesce(after, F.lit(OUTSIDE)).alias("after"))
        first = labels.withColumn("last", F.lag("label").over(order)).filter("last IS NULL").select("image_id", (x - dx).alias("x"), (y - dy).alias("y"), F.lit(OUTSIDE).alias("before"), own.alias("after"))
        both = inner.unionByName(first).filter("before <> after")
        return both.select("image_id", (x + dx).alias("x0"), (y + dy).alias("y0"), (x + 1).alias("x1"), (y + 1).alias("y1"), "before", "after")

    return segments(_row(), 1, 0).unionByName(segments(_column(), 0, 1))


def node_degrees(segments: DataFrame) -> DataFrame:
    """image_id, x, y, degree of every grid node on a boundary; a degree other than 2 is a junction."""
    ends = segments.select("image_id", F.col("x0").alias("x"), F.col("y0").alias("y")).unionByName(segments.select("image_id", F.col("x1").alias("x"), F.col("y1").alias("y")))
    return ends.groupBy("image_id", "x", "y").agg(F.count(F.lit(1)).alias("degree"))


def boundary_length(labels: DataFrame) -> DataFrame:
    """Cauchy-Crofton length of an image's boundaries from unequal pairs in four directions: image_id, length."""
    own = F.col("label")
    below_right, below_left = F.lead("right").over(_column()), F.lead("left").over(_column())
    seen = labels.withColumns({"right": F.lead("label").over(_row()), "left": F.lag("label").over(_row()), "below": F.lead("label").over(_column())})
    seen = seen.withColumns({"diagonal": below_right, "anti": below_left})

    def differs(name: str) -> Column:
        return F.sum(F.coalesce((F.col(name) != own).cast("long"), F.lit(0)))

    straight, slanted = differs("right") + differs("below"), differs("diagonal") + differs("anti")
    return seen.groupBy("image_id").agg(F.round(math.pi / 8 * (straight + slanted / math.sqrt(2)), 6).alias("length"))


def bounding_boxes(labels: DataFrame) -> DataFrame:
    """Inclusive box and area of each label."""
    return labels.groupBy("image_id", "label").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count(F.lit(1)).alias("area"))


def interior_counts(labels: DataFrame) -> DataFrame:
    """Per label, pixels all of whose four neighbours have it (those on the frame have not), and the rest."""
    own = F.col("label")
    inside = F.lit(True)
    for order in (_row(), _column()):
        inside &= F.coalesce(F.lag("label").over(order) == own, F.lit(False)) & F.coalesce(F.lead("label").over(order) == own, F.lit(False))
    return labels.withColumn("inside", inside.cast("long")).groupBy("image_id", "label").agg(F.sum("inside").alias("interior"), F.sum(1 - F.col("inside")).alias("border"))


def saddle_corners(labels: DataFrame) -> DataFrame:
    """Nodes where two pixels of one label touch at a corner only: image_id, x, y, main (label of the falling diagonal), cross."""
    seen = labels.withColumns({"b": F.lead("label").over(_row())})
    seen = seen.withColumns({"c": F.lead("label").over(_column()), "d": F.lead("b").over(_column())})
    found = seen.filter("label = d AND b <> label AND c <> label OR b = c AND label <> b AND d <> b")
    return found.select("image_id", (F.col("x") + 1).alias("x"), (F.col("y") + 1).alias("y"), (F.col("label") == F.col("d")).alias("main"), (F.col("b") == F.col("c")).alias("cross"))


def contingency(truth: DataFrame, ours: DataFrame) -> DataFrame:
    """Pixels that each pair of labels shares: image_id, g, o, n."""
    return truth.withColumnRenamed("label", "g").join(ours.withColumnRenamed("label", "o"), ["image_id", "x", "y"]).groupBy("image_id", "g", "o").agg(F.count(F.lit(1)).alias("n"))


def region_classes(table: DataFrame, least: int = 4, cover: float = 0.6, share: float = 0.5, piece: float = 0.1, floor: float = 0.3) -> DataFrame:
    """Class of each true region of `least` pixels at least: matched, absorbed, shattered or missing.

    The backdrop is the image's largest label of ours, the lower of equals.
    """
    by_o = table.groupBy("image_id", "o").agg(F.sum("n").alias("own"))
    back = by_o.groupBy("image_id").agg(F.max_by("o", F.struct("own", -F.col("o"))).alias("backdrop"))
    total = Window.partitionBy("image_id", "g")
    order = total.orderBy(F.desc("n"), "o")
    rows = table.join(by_o, ["image_id", "o"]).join(back, "image_id").withColumn("area", F.sum("n").over(total)).withColumn("rank", F.row_number().over(order))
    rows = rows.withColumn("pieces", F.sum((F.col("n") >= piece * F.col("area")).cast("long")).over(total)).filter((F.col("rank") == 1) & (F.col("area") >= least))
    covered, kept = F.col("n") / F.col("area"), F.col("n") / F.col("own")
    broken = F.when(F.col("pieces") >= 2, "shattered")
    kind = (
        F.when((F.col("o") == F.col("backdrop")) | (covered < floor), F.coalesce(broken, F.lit("missing")))
        .when((covered >= cover) & (kept >= share), "matched")
        .when(covered >= cover, "absorbed")
        .otherwise(F.coalesce(broken, F.lit("absorbed")))
    )
    return rows.select("image_id", "g", F.col("o").alias("best"), "area", F.round(covered, 6).alias("cover"), F.round(kept, 6).alias("share"), "pieces", kind.alias("class"))


def mirrors(labels: DataFrame, width: int, height: int) -> DataFrame:
    """Per image, how many pixels differ from their reflection in x and y and in the half turn, and what holds."""
    other = labels.select("image_id", F.col("x").alias("u"), F.col("y").alias("v"), F.col("label").alias("other"))
    flips = F.array(*(F.struct(F.lit(k).alias("kind"), u.alias("u"), v.alias("v")) for k, u, v in (("x", width - 1 - F.col("x"), F.col("y")), ("y", F.col("x"), height - 1 - F.col("y")), ("turn", width - 1 - F.col("x"), height - 1 - F.col("y")))))
    pairs = labels.withColumn("f", F.explode(flips)).select("image_id", "label", "f.*").join(other, ["image_id", "u", "v"])

    def off(kind: str) -> Column:
        return F.sum(((F.col("kind") == kind) & (F.col("label") != F.col("other"))).cast("long"))

    counted = pairs.groupBy("image_id").agg(off("x").alias("off_x"), off("y").alias("off_y"), off("turn").alias("off_turn"))
    return counted.withColumn("half_turn", (F.col("off_x") > 0) & (F.col("off_y") > 0) & (F.col("off_turn") == 0))


def thinning_pass(ink: DataFrame, second: bool) -> DataFrame:
    """One sub-iteration of two-pass thinning: image_id, x, y, on. Frame pixels are never deleted; all deletions at once."""
    rows = ink.withColumns({"e": F.lead("on").over(_row()), "w": F.lag("on").over(_row())})
    around = rows.withColumns({f"{b}{a}": f(a).over(_column()) for a in ("on", "e", "w") for b, f in (("n", F.lag), ("s", F.lead))})
    ring = [F.col(x) for x in ("non", "ne", "e", "se", "son", "sw", "w", "nw")]
    alive = sum(ring, F.lit(0))
    turns = sum((((a == 0) & (b == 1)).cast("int") for a, b in zip(ring, [*ring[1:], ring[0]], strict=True)), F.lit(0))
    p2, p4, p6, p8 = ring[0], ring[2], ring[4], ring[6]
    one, two = (p2 * p4 * p8, p2 * p6 * p8) if second else (p2 * p4 * p6, p4 * p6 * p8)
    goes = (F.col("on") == 1) & alive.between(2, 6) & (turns == 1) & (one == 0) & (two == 0)
    return around.select("image_id", "x", "y", F.when(F.coalesce(goes, F.lit(False)), 0).otherwise(F.col("on")).alias("on"))


def potts_energy(pixels: DataFrame, beta: float) -> DataFrame:
    """Squared distance to each label's mean value plus beta for each unequal side: image_id, data, sides, energy."""
    mean = F.avg("v").over(Window.partitionBy("image_id", "label"))
    data = pixels.withColumn("d", F.col("v") - mean).groupBy("image_id").agg(F.sum(F.col("d") * F.col("d")).alias("data"))
    sides = _sides(pixels).groupBy("image_id").agg(F.sum((F.col("p") != F.col("q")).cast("long")).alias("sides"))
    return data.join(sides, "image_id").select("image_id", F.round("data", 6).alias("data"), "sides", F.round(F.col("data") + beta * F.col("sides"), 6).alias("energy"))


def area_between(labels: DataFrame, other: DataFrame) -> DataFrame:
    """image_id, geom, geom_far: differing pixels over the boundary length of `labels`, all and those over a pixel (by sides) from its edges."""

    def near(flag: Column) -> Column:
        return F.greatest(flag, *[F.coalesce(f(flag).over(w), F.lit(0)) for f in (F.lag, F.lead) for w in (_row(), _column())])

    sides = [F.coalesce((f("label").over(w) != F.col("label")).cast("int"), F.lit(0)) for f in (F.lag, F.lead) for w in (_row(), _column())]
    edged = labels.withColumn("edge", F.greatest(*sides))
    edged = edged.withColumn("near", near(F.col("edge")))
    joined = edged.join(other.withColumnRenamed("label", "other"), ["image_id", "x", "y"]).withColumn("miss", (F.col("label") != F.col("other")).cast("int"))
    sums = joined.groupBy("image_id").agg(F.sum("miss").alias("miss"), F.sum(F.col("miss") * (1 - F.col("near"))).alias("far"))
    both = sums.join(boundary_length(labels), "image_id").filter("length > 0")
    return both.select("image_id", F.round(F.col("miss") / F.col("length"), 6).alias("geom"), F.round(F.col("far") / F.col("length"), 6).alias("geom_far"))
