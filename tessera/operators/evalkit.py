"""Evaluation tables: sweeps, leaderboards, frontiers, family means, selections, comparisons.

Every operator takes and returns DataFrames and states its order keys. Keys that rows may
repeat are broken by further columns, so results do not depend on partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TILE_LIMIT = 4096 * 4096


def round_half_even(x: Column) -> Column:
    return F.bround(x, 0)


def manifest(items: DataFrame, tiers: list[int], corpora: list[str], limit: int) -> DataFrame:
    """Items of the tiers and corpora, the first `limit` in manifest order (a top-k, no global sort)."""
    return items.filter(F.col("tier").isin(tiers) & F.col("corpus").isin(corpora)).orderBy("position").limit(limit)


def sweep(items: DataFrame, grid: DataFrame) -> DataFrame:
    """Every item with every runner's own settings. The grid is configuration: a few rows, joined by broadcast."""
    return items.join(F.broadcast(grid), how="cross")


def eval_scales(tier: Column, scales: list[int]) -> Column:
    """The scales at which a tier's raster stays within 4096 x 4096; [1] if none does."""
    kept = F.filter(F.array(*[F.lit(s) for s in scales]), lambda s: (tier * s) * (tier * s) <= TILE_LIMIT)
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit(1)))


def leaderboard(scores: DataFrame, by: str, metrics: list[str]) -> DataFrame:
    """Exact medians per runner."""
    return scores.groupBy(by).agg(*[F.round(F.percentile(m, 0.5), 6).alias(f"median_{m}") for m in metrics], F.count(F.lit(1)).alias("n"))


COST_RANGES = 64


def pareto_mask(scores: DataFrame, cost: str, quality: str, ties: list[str], within: list[str] | None = None) -> DataFrame:
    """Rows whose quality strictly beats the best so far in order of cost; at equal cost an earlier, worse row stays.

    Rows that are not finite go. Within groups the running maximum is a window; over the whole
    table rows are dealt into ranges of cost, whose best qualities (one number a range) are run
    through first, so no task holds them all.
    """
    finite = scores.filter(F.col(cost).isNotNull() & F.col(quality).isNotNull() & ~F.isnan(cost) & ~F.isnan(quality))
    if within:
        order = Window.partitionBy(*within).orderBy(cost, *ties)
        best = F.max(quality).over(order.rowsBetween(Window.unboundedPreceding, -1))
        return finite.withColumn("best", best).filter(F.col("best").isNull() | (F.col(quality) > F.col("best"))).drop("best")
    cuts = finite.agg(F.percentile_approx(cost, [i / COST_RANGES for i in range(1, COST_RANGES)]).alias("c")).first()["c"] or []
    dealt = finite.withColumn("__range", sum((F.when(F.col(cost) > c, 1).otherwise(0) for c in sorted(set(cuts))), F.lit(0)))
    tops = dealt.groupBy("__range").agg(F.max(quality).alias("__top"))
    before = tops.select("__range", F.max("__top").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    own = F.max(quality).over(Window.partitionBy("__range").orderBy(cost, *ties).rowsBetween(Window.unboundedPreceding, -1))
    ran = dealt.withColumn("__own", own).join(F.broadcast(before), "__range").withColumn("__best", F.greatest("__own", "__before"))
    return ran.filter(F.col("__best").isNull() | (F.col(quality) > F.col("__best"))).select(*scores.columns)


def strict_pareto(points: DataFrame, axes: list[str]) -> DataFrame:
    """Points that no other is at most as high on all axes of and lower on one; duplicates survive.

    Only distinct points can dominate. An anti-join over them; points are few after rounding or pre-aggregation.
    """
    valid = points.filter(" AND ".join(f"{a} >= 0 AND NOT isnan({a})" for a in axes))
    rivals = valid.select(*[F.col(a).alias(f"_{a}") for a in axes]).distinct()
    below = F.lit(True)
    strictly = F.lit(False)
    for a in axes:
        below &= F.col(f"_{a}") <= F.col(a)
        strictly |= F.col(f"_{a}") < F.col(a)
    return valid.join(rivals, below & strictly, "left_anti")


def robustness(clean: DataFrame, perturbed: DataFrame, keys: list[str], params: str, by: list[str]) -> DataFrame:
    """Growth of a count against the clean run, in percent: median, mean and n for each runner and perturbation."""
    joined = perturbed.join(clean.select(*keys, F.col(params).alias("clean")), keys).filter("clean <> 0")
    growth = (F.col(params) / F.col("clean") - 1) * 100
    return joined.groupBy(*by).agg(F.round(F.percentile(growth, 0.5), 6).alias("median_growth"), F.round(F.avg(growth), 6).alias("mean_growth"), F.count(F.lit(1)).alias("n"))


def best_setting(scores: DataFrame, engine: str, quality: str, ties: list[str], higher: bool) -> DataFrame:
    """The best row of each engine; the direction is stated."""
    order = Window.partitionBy(engine).orderBy(F.desc(quality) if higher else F.asc(quality), *ties)
    return scores.withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")


def every_kth(items: DataFrame, family: str, key: str, k: int) -> DataFrame:
    """Every k-th item of each family, the first included."""
    n = F.row_number().over(Window.partitionBy(family).orderBy(key))
    return items.withColumn("n", n).filter((F.col("n") - 1) % k == 0).drop("n")


def stratified_sample(items: DataFrame, family: str, key: str, fraction: float) -> DataFrame:
    """max(1, n * fraction rounded half to even) of each family, by hash order."""
    whole = Window.partitionBy(family)
    ranked = items.withColumn("n", F.row_number().over(whole.orderBy(F.md5(F.col(key).cast("string").cast("binary")), key))).withColumn("m", F.count(F.lit(1)).over(whole))
    return ranked.filter(F.col("n") <= F.greatest(F.lit(1.0), round_half_even(F.col("m") * F.lit(fraction)))).drop("n", "m")


def round_robin(items: DataFrame, family: str, key: str, n: int) -> DataFrame:
    """n items, one of each family in turn."""
    turn = F.row_number().over(Window.partitionBy(family).orderBy(key))
    return items.withColumn("turn", turn).orderBy("turn", family).limit(n)


def hash_select(items: DataFrame, family: str, key: str, seed: str, n: int) -> DataFrame:
    """The first n of each family by SHA-256 of seed, family and key."""
    digest = F.sha2(F.concat(F.lit(seed), F.col(family), F.col(key).cast("string")).cast("binary"), 256)
    return items.withColumn("n", F.row_number().over(Window.partitionBy(family).orderBy(digest))).filter(F.col("n") <= n).drop("n")


def family_means(scores: DataFrame, family: str, metrics: list[str]) -> DataFrame:
    return scores.groupBy(family).agg(*[F.avg(m).alias(m) for m in metrics], F.count(F.lit(1)).alias("n"))


def macro_means(scores: DataFrame, family: str, metrics: list[str]) -> DataFrame:
    """Means of family means, beside plain means: metric, macro, micro."""
    per = scores.groupBy(family).agg(*[F.avg(m).alias(m) for m in metrics], *[F.sum(m).alias(f"sum_{m}") for m in metrics], F.count(F.lit(1)).alias("n"))
    one = per.agg(*[F.avg(m).alias(m) for m in metrics], *[(F.sum(f"sum_{m}") / F.sum("n")).alias(f"sum_{m}") for m in metrics])
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.round(m, 8).alias("macro"), F.round(f"sum_{m}", 8).alias("micro")) for m in metrics]))
    return one.select(rows.alias("r")).select("r.*")


def family_table(scores: DataFrame, family: str, macro: list[str], micro: list[str]) -> DataFrame:
    """Families and a row ALL, in which `macro` columns are means of family means and `micro` plain means."""
    per = scores.groupBy(family).agg(*[F.avg(m).alias(m) for m in macro + micro], *[F.sum(m).alias(f"sum_{m}") for m in micro], F.count(F.lit(1)).alias("n"))
    rows = per.select(family, *[F.round(m, 6).alias(m) for m in macro + micro], "n")
    total = per.agg(*[F.round(F.avg(m), 6).alias(m) for m in macro], *[F.round(F.sum(f"sum_{m}") / F.sum("n"), 6).alias(m) for m in micro], F.sum("n").alias("n"))
    return rows.unionByName(total.select(F.lit("ALL").alias(family), *macro, *micro, "n"))


def deltas(base: DataFrame, current: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """Paired differences."""
    return base.select(*keys, F.col(metric).alias("base")).join(current.select(*keys, F.col(metric).alias("current")), keys).withColumn("delta", F.round(F.col("current") - F.col("base"), 6))


def worst(rows: DataFrame, metric: str, ties: list[str], n: int) -> DataFrame:
    return rows.orderBy(F.desc(metric), *ties).limit(n)


def constraint_report(rows: DataFrame, caps: dict[str, float], seconds: str, metric: str) -> DataFrame:
    """Whether time percentiles and the worst regression keep their caps: rule, value, cap, passed."""
    one = rows.agg(F.percentile(seconds, 0.95).alias("p95_seconds"), F.max(seconds).alias("max_seconds"), F.max(metric).alias("worst_regression"))
    names = ["p95_seconds", "max_seconds", "worst_regression"]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.round(n, 6).alias("value"), F.lit(float(caps[n])).alias("cap")) for n in names]))
    return one.select(each.alias("r")).select("r.*").withColumn("passed", F.col("value") <= F.col("cap"))


def ratchet(base: DataFrame, current: DataFrame, key: str, value: str) -> DataFrame:
    """What is new, gone, tightened or loosened between two tables of budgets: key, base, current, change."""
    a, b = base.select(key, F.col(value).alias("base")), current.select(key, F.col(value).alias("current"))
    change = (
        F.when(F.col("base").isNull(), "new").when(F.col("current").isNull(), "gone").when(F.col("current") < F.col("base"), "tightened").when(F.col("current") > F.col("base"), "loosened").otherwise("same")
    )
    return a.join(b, key, "full").withColumn("change", change)


def suite_aggregate(rows: DataFrame, by: str, quality: str, seconds: str, valid: Column) -> DataFrame:
    """Means of quality over valid rows; percentiles of time and slow counts over all."""
    return rows.groupBy(by).agg(
        F.round(F.avg(F.when(valid, F.col(quality))), 6).alias("mean_quality"),
        F.sum(valid.cast("long")).alias("n_valid"),
        F.round(F.percentile(seconds, 0.5), 6).alias("p50_seconds"),
        F.round(F.percentile(seconds, 0.95), 6).alias("p95_seconds"),
        F.max(seconds).alias("max_seconds"),
        F.sum((F.col(seconds) > 0.05).cast("long")).alias("slow"),
    )


def cross_summary(rows: DataFrame, size: str, family: str, engine: str, metric: str) -> DataFrame:
    """Means and counts by size, family and engine, and over all families, by grouping sets."""
    sets = rows.groupingSets([[F.col(size), F.col(family), F.col(engine)], [F.col(size), F.col(engine)]], size, family, engine)
    out = sets.agg(F.round(F.avg(metric), 6).alias("mean"), F.count(F.lit(1)).alias("n"), F.grouping(family).alias("all"))
    return out.select(size, F.when(F.col("all") == 1, F.lit("All families")).otherwise(F.col(family)).alias(family), engine, "mean", "n")


def with_cache(jobs: DataFrame, cache: DataFrame, keys: list[str], fresh: Column) -> DataFrame:
    """Cached scores where a key has one, `fresh` for the rest; hit says which."""
    held = cache.dropDuplicates(keys)
    hits = jobs.join(held, keys).withColumn("hit", F.lit(True))
    return hits.unionByName(jobs.join(held, keys, "left_anti").withColumn("score", fresh).withColumn("hit", F.lit(False)))


def error_attribution(pixels: DataFrame, by: str) -> DataFrame:
    """Shares of summed error by kind of pixel."""
    total = F.sum("error")

    def share(kind: str) -> Column:
        return F.round(F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("error"))), F.lit(0.0)) / total, 6)

    return pixels.groupBy(by).agg(share("boundary").alias("boundary"), share("structure").alias("structure"), share("flat").alias("flat"), F.round(total, 6).alias("total"))


def pivot_metrics(rows: DataFrame, key: str, name: str, value: str, names: list[str]) -> DataFrame:
    """Long metrics as columns; the names are given, so the plan is static."""
    return rows.groupBy(key).pivot(name, names).agg(F.round(F.avg(value), 6))


def sweep_constant(rows: DataFrame, constant: str, metric: str) -> DataFrame:
    return rows.groupBy(constant).agg(F.round(F.percentile(metric, 0.5), 6).alias("median"), F.count(F.lit(1)).alias("n"))


def without_errors(cells: DataFrame, error: str = "error") -> DataFrame:
    """Cells whose error is null or empty."""
    return cells.filter(F.col(error).isNull() | (F.col(error) == ""))


def ratchet_rules(budget: DataFrame, floor: float) -> DataFrame:
    """Whether each key's figure keeps its rule (max, min or floor), and whether the budget can be tightened to it.

    key, rule, base, now. A key without a base is new and passes; one without a figure is gone and fails.
    """
    base, now, rule = F.col("base"), F.col("now"), F.col("rule")
    kept = F.when(rule == "max", now <= base).when(rule == "min", now >= base).otherwise(now >= floor)
    tighter = F.when(rule == "max", now < base).when(rule == "min", now > base).otherwise(False)
    passed = F.when(now.isNull(), False).when(base.isNull() & (rule != "floor"), True).otherwise(kept)
    return budget.withColumns({"passed": passed, "tightened": F.coalesce(tighter, F.lit(False))})


def csv_line(values: list[Column]) -> Column:
    """Text values as one line of CSV."""
    quoted = [F.when(v.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v) for v in values]
    return F.concat_ws(",", *[F.coalesce(q, F.lit("")) for q in quoted])
