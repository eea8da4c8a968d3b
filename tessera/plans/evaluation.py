"""Queries of the evaluation toolkit over score tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import evalkit as E
from tessera.plans.registry import register
from tessera.sources.derived import LB2_SQL, SC_SQL, read, scores, tile_labels, tile_pixels

SC = f"WITH {SC_SQL}"
# One row a (family, part) and build: the two line statuses are the builds.
PAIR_SQL = SC_SQL + ", pr AS (SELECT family, part, setting, round(avg(seconds), 6) AS score, round(avg(cost), 6) AS cost FROM sc GROUP BY 1, 2, 3)"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).groupBy("family", "part", "setting").agg(F.round(F.avg("seconds"), 6).alias("score"), F.round(F.avg("cost"), 6).alias("cost"))


def builds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = pairs(spark, sf_dir)
    return p.filter("setting = 'F'"), p.filter("setting = 'O'")


@register("leaderboard_median", f"{SC} SELECT runner, round(median(cost), 6) AS median_cost, round(median(quality), 6) AS median_quality, count(*) AS n FROM sc GROUP BY 1")
def leaderboard_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.leaderboard(scores(spark, sf_dir), "runner", ["cost", "quality"])


PT = "part, uid, perturbation"


@register("pareto_mask", f"{SC}, b AS (SELECT *, max(quality) OVER (ORDER BY cost, {PT}, quality DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM sc) SELECT uid, part, perturbation, cost, quality FROM b WHERE best IS NULL OR quality > best")
def pareto_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Only rows that lead their own runner, setting and family can lead overall: the last window sees those.
    ties = ["part", "uid", "perturbation", F.desc("quality")]
    inner = E.pareto_mask(scores(spark, sf_dir), "cost", "quality", ties, ["runner", "setting", "family"])
    return E.pareto_mask(inner, "cost", "quality", ties).select("uid", "part", "perturbation", "cost", "quality")


@register("frontier_per_engine", f"{SC}, b AS (SELECT *, max(quality) OVER (PARTITION BY runner ORDER BY cost, {PT}, quality DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM sc) SELECT runner, uid, part, cost, quality FROM b WHERE best IS NULL OR quality > best")
def frontier_per_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    ties = ["part", "uid", "perturbation", F.desc("quality")]
    inner = E.pareto_mask(scores(spark, sf_dir), "cost", "quality", ties, ["runner", "setting", "family"])
    return E.pareto_mask(inner, "cost", "quality", ties, ["runner"]).select("runner", "uid", "part", "cost", "quality")



@register("pareto_strict3", f"{SC}, p AS (SELECT part, round(min(cost), 0) AS cost, round(min(50 - quality), 0) AS loss, round(min(seconds) * 100, 0) AS wobble FROM sc GROUP BY part) SELECT * FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.cost <= a.cost AND b.loss <= a.loss AND b.wobble <= a.wobble AND (b.cost < a.cost OR b.loss < a.loss OR b.wobble < a.wobble))")
def pareto_strict3(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scores(spark, sf_dir)
    points = s.groupBy("part").agg(F.round(F.min("cost"), 0).alias("cost"), F.round(F.min(50 - F.col("quality")), 0).alias("loss"), F.round(F.min("seconds") * 100, 0).alias("wobble"))
    return E.strict_pareto(points, ["cost", "loss", "wobble"])


@register("robustness_growth", f"{SC}, c AS (SELECT runner, setting, uid, avg(quality) AS clean FROM sc WHERE perturbation = 1 GROUP BY 1, 2, 3), p AS (SELECT runner, perturbation, (quality / clean - 1) * 100 AS growth FROM sc JOIN c USING (runner, setting, uid) WHERE perturbation > 1 AND clean <> 0) SELECT runner, perturbation, round(median(growth), 6) AS median_growth, round(avg(growth), 6) AS mean_growth, count(*) AS n FROM p GROUP BY 1, 2")
def robustness_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scores(spark, sf_dir)
    keys = ["runner", "setting", "uid"]
    clean = s.filter("perturbation = 1").groupBy(*keys).agg(F.avg("quality").alias("quality"))
    return E.robustness(clean, s.filter("perturbation > 1"), keys, "quality", ["runner", "perturbation"])


@register("best_setting", f"{SC} SELECT family, runner, setting, uid, part, quality, cost FROM sc QUALIFY row_number() OVER (PARTITION BY family ORDER BY quality DESC, cost, part, uid, perturbation, seconds) = 1")
def best_setting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.best_setting(scores(spark, sf_dir), "family", "quality", ["cost", "part", "uid", "perturbation", "seconds"], True).select("family", "runner", "setting", "uid", "part", "quality", "cost")


@register("stratified_every4", "SELECT c_custkey, c_mktsegment FROM customer QUALIFY (row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1) % 4 = 0")
def stratified_every4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.every_kth(read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", 4)


@register("stratified_sample", "SELECT c_custkey, c_mktsegment FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(CAST(c_custkey AS VARCHAR)), c_custkey) <= greatest(1, round_even(count(*) OVER (PARTITION BY c_mktsegment) * 0.15::DOUBLE, 0))")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.stratified_sample(read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", 0.15)


@register("canary_round_robin", "SELECT c_custkey, c_mktsegment, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS INT) AS turn FROM customer ORDER BY turn, c_mktsegment LIMIT 24")
def canary_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.round_robin(read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", 24)


@register("hash_select2", "SELECT item_id, lang FROM (SELECT doc_id AS item_id, lang FROM documents) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY sha256('seed' || lang || CAST(item_id AS VARCHAR))) <= 2")
def hash_select2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.hash_select(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "lang"), "lang", "item_id", "seed", 2)


@register("family_macro_mean", f"{SC}, f AS (SELECT family, avg(cost) AS cost, avg(seconds) AS seconds FROM sc GROUP BY 1) SELECT 'cost' AS metric, round(avg(cost), 8) AS macro, (SELECT round(avg(cost), 8) FROM sc) AS micro FROM f UNION ALL SELECT 'seconds', round(avg(seconds), 8), (SELECT round(avg(seconds), 8) FROM sc) FROM f")
def family_macro_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.macro_means(scores(spark, sf_dir), "family", ["cost", "seconds"])


@register("family_table_all", f"{SC}, f AS (SELECT family, avg(seconds) AS seconds, avg(cost) AS cost, count(*) AS n FROM sc GROUP BY 1) SELECT family, round(seconds, 6) AS seconds, round(cost, 6) AS cost, n FROM f UNION ALL SELECT 'ALL', round(avg(seconds), 6), (SELECT round(avg(cost), 6) FROM sc), CAST(sum(n) AS BIGINT) FROM f")
def family_table_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.family_table(scores(spark, sf_dir), "family", ["seconds"], ["cost"])


@register("per_image_delta", f"WITH {PAIR_SQL} SELECT a.family, a.part, a.score AS base, b.score AS \"current\", round(b.score - a.score, 6) AS delta FROM pr a JOIN pr b ON a.family = b.family AND a.part = b.part AND a.setting = 'F' AND b.setting = 'O'")
def per_image_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.deltas(*builds(spark, sf_dir), ["family", "part"], "score")


@register("worst_n", f"WITH {PAIR_SQL} SELECT a.family, a.part, a.score AS base, b.score AS \"current\", round(b.score - a.score, 6) AS delta FROM pr a JOIN pr b ON a.family = b.family AND a.part = b.part AND a.setting = 'F' AND b.setting = 'O' ORDER BY delta DESC, family, part LIMIT 10")
def worst_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.worst(E.deltas(*builds(spark, sf_dir), ["family", "part"], "score"), "delta", ["family", "part"], 10)


@register("constraint_report", f"{SC}, o AS (SELECT quantile_cont(seconds, 0.95) AS a, max(seconds) AS b, max(cost) AS c FROM sc) SELECT 'p95_seconds' AS rule, round(a, 6) AS value, 0.09::DOUBLE AS cap, round(a, 6) <= 0.09 AS passed FROM o UNION ALL SELECT 'max_seconds', round(b, 6), 0.2::DOUBLE, round(b, 6) <= 0.2 FROM o UNION ALL SELECT 'worst_regression', round(c, 6), 1000.0::DOUBLE, round(c, 6) <= 1000 FROM o")
def constraint_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.constraint_report(scores(spark, sf_dir), {"p95_seconds": 0.09, "max_seconds": 0.2, "worst_regression": 1000.0}, "seconds", "cost")


@register("ratchet_diff", "WITH a AS (SELECT o_custkey AS k, count(*) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) SELECT coalesce(a.k, b.k) AS o_custkey, a.v AS base, b.v AS \"current\", CASE WHEN a.v IS NULL THEN 'new' WHEN b.v IS NULL THEN 'gone' WHEN b.v < a.v THEN 'tightened' WHEN b.v > a.v THEN 'loosened' ELSE 'same' END AS change FROM a FULL JOIN b ON a.k = b.k")
def ratchet_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    a, b = (o.filter(F.col("o_orderstatus") == s).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("v")) for s in "FO")
    return E.ratchet(a, b, "o_custkey", "v")


@register("suite_aggregate", f"{SC} SELECT runner, round(avg(quality) FILTER (WHERE perturbation < 4), 6) AS mean_quality, count(*) FILTER (WHERE perturbation < 4) AS n_valid, round(median(seconds), 6) AS p50_seconds, round(quantile_cont(seconds, 0.95), 6) AS p95_seconds, max(seconds) AS max_seconds, count(*) FILTER (WHERE seconds > 0.05) AS slow FROM sc GROUP BY 1")
def suite_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.suite_aggregate(scores(spark, sf_dir), "runner", "quality", "seconds", F.col("perturbation") < 4)


@register("crosscompare_grouping_sets", f"{SC} SELECT perturbation AS size, CASE WHEN grouping(family) = 1 THEN 'All families' ELSE family END AS family, runner, round(avg(cost), 6) AS mean, count(*) AS n FROM sc GROUP BY GROUPING SETS ((perturbation, family, runner), (perturbation, runner))")
def crosscompare_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.cross_summary(scores(spark, sf_dir).withColumnRenamed("perturbation", "size"), "size", "family", "runner", "cost")


@register("score_cache_antijoin", "WITH c AS (SELECT DISTINCT n_chars, lang, 1.0::DOUBLE AS score FROM documents WHERE source = 'src0') SELECT d.doc_id, d.n_chars, d.lang, coalesce(c.score, 0.0) AS score, c.score IS NOT NULL AS hit FROM documents d LEFT JOIN c ON d.n_chars = c.n_chars AND d.lang = c.lang")
def score_cache_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    cache = d.filter("source = 'src0'").select("n_chars", "lang", F.lit(1.0).alias("score"))
    return E.with_cache(d.drop("source"), cache, ["n_chars", "lang"], F.lit(0.0)).select("doc_id", "n_chars", "lang", "score", "hit")


@register("sweep_cells", "SELECT p_partkey, r.* FROM part, (VALUES ('a', 1), ('a', 2), ('b', 5)) AS r(runner, setting)")
def sweep_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5)], "runner string, setting int")
    return E.sweep(read(spark, sf_dir, "part").select("p_partkey"), grid)


@register("eval_scales", "SELECT p_partkey, p_size * 64 AS tier, CAST(array_to_string(CASE WHEN len(list_filter([1, 2, 4], lambda s: (p_size * 64 * s) * (p_size * 64 * s) <= 16777216)) > 0 THEN list_filter([1, 2, 4], lambda s: (p_size * 64 * s) * (p_size * 64 * s) <= 16777216) ELSE [1] END, ',') AS VARCHAR) AS scales FROM part")
def eval_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 64).alias("tier"))
    return p.withColumn("scales", F.array_join(E.eval_scales(F.col("tier"), [1, 2, 4]), ","))


@register("manifest_filter", "SELECT p_partkey AS position, p_size AS tier, p_brand AS corpus FROM part WHERE p_size IN (5, 10, 15, 20) AND p_brand IN (SELECT DISTINCT p_brand FROM part ORDER BY 1 LIMIT 8) ORDER BY p_partkey LIMIT 50")
def manifest_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("position"), F.col("p_size").alias("tier"), F.col("p_brand").alias("corpus"))
    corpora = [r["corpus"] for r in p.select("corpus").distinct().orderBy("corpus").limit(8).collect()]
    return E.manifest(p, [5, 10, 15, 20], corpora, 50)


@register("error_attribution", f"WITH {LB2_SQL}, e AS (SELECT px.image_id, abs(v) AS error, CASE WHEN lb.label <> lb2.label THEN 'boundary' WHEN lb.label = 1 THEN 'structure' ELSE 'flat' END AS kind FROM px JOIN lb USING (image_id, x, y) JOIN lb2 USING (image_id, x, y)) SELECT image_id, round(coalesce(sum(error) FILTER (WHERE kind = 'boundary'), 0) / sum(error), 6) AS boundary, round(coalesce(sum(error) FILTER (WHERE kind = 'structure'), 0) / sum(error), 6) AS structure, round(coalesce(sum(error) FILTER (WHERE kind = 'flat'), 0) / sum(error), 6) AS flat, round(sum(error), 6) AS total FROM e GROUP BY 1")
def error_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["image_id", "x", "y"]
    a = tile_labels(spark, sf_dir).withColumnRenamed("label", "a")
    b = tile_labels(spark, sf_dir, (-0.05, 0.1)).withColumnRenamed("label", "b")
    joined = tile_pixels(spark, sf_dir).join(a, keys).join(b, keys)
    kind = F.when(F.col("a") != F.col("b"), "boundary").when(F.col("a") == 1, "structure").otherwise("flat")
    return E.error_attribution(joined.select("image_id", F.abs("v").alias("error"), kind.alias("kind")), "image_id")


@register("metrics_pivot", f"{SC} SELECT family, round(avg(cost) FILTER (WHERE runner = 'A'), 6) AS \"A\", round(avg(cost) FILTER (WHERE runner = 'N'), 6) AS \"N\", round(avg(cost) FILTER (WHERE runner = 'R'), 6) AS \"R\" FROM sc GROUP BY 1")
def metrics_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.pivot_metrics(scores(spark, sf_dir), "family", "runner", "cost", ["A", "N", "R"])


@register("sweep_constant", f"{SC} SELECT seconds, round(median(cost), 6) AS median, count(*) AS n FROM sc GROUP BY 1")
def sweep_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.sweep_constant(scores(spark, sf_dir), "seconds", "cost")


# A cell fails where its line number is six or more, with the reason in words.
FAIL_SQL = SC_SQL + ", fc AS (SELECT *, CASE WHEN perturbation >= 6 THEN 'timed out after ' || perturbation WHEN perturbation = 5 THEN '' END AS error FROM sc)"


def cells_with_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = F.concat(F.lit("timed out after "), F.col("perturbation").cast("string"))
    return scores(spark, sf_dir).withColumn("error", F.when(F.col("perturbation") >= 6, late).when(F.col("perturbation") == 5, ""))


@register("error_filter", f"WITH {FAIL_SQL} SELECT runner, setting, count(*) AS cells, count(*) FILTER (WHERE error IS NULL OR error = '') AS good, round(avg(quality) FILTER (WHERE error IS NULL OR error = ''), 6) AS quality FROM fc GROUP BY 1, 2")
def error_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = cells_with_errors(spark, sf_dir)
    good = E.without_errors(cells).groupBy("runner", "setting").agg(F.count(F.lit(1)).alias("good"), F.round(F.avg("quality"), 6).alias("quality"))
    return cells.groupBy("runner", "setting").agg(F.count(F.lit(1)).alias("cells")).join(good, ["runner", "setting"])


@register("means_by_class", f"WITH {FAIL_SQL} SELECT family, CASE WHEN quality < 15 THEN 'low' WHEN quality < 35 THEN 'middle' ELSE 'high' END AS class, count(*) AS n, round(avg(cost) FILTER (WHERE error IS NULL OR error = ''), 9) AS cost FROM fc GROUP BY 1, 2")
def means_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each family and class, and means over what did not fail."""
    group = F.when(F.col("quality") < 15, "low").when(F.col("quality") < 35, "middle").otherwise("high")
    good = F.col("error").isNull() | (F.col("error") == "")
    return cells_with_errors(spark, sf_dir).groupBy("family", group.alias("class")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(good, F.col("cost"))), 9).alias("cost"))


RULES_SQL = SC_SQL + """,
bl AS (SELECT family AS key, CASE length(family) % 3 WHEN 0 THEN 'max' WHEN 1 THEN 'min' ELSE 'floor' END AS rule, round(avg(seconds) FILTER (WHERE setting = 'F'), 6) AS base, round(avg(seconds) FILTER (WHERE setting = 'O'), 6) AS now FROM sc GROUP BY 1, 2)"""


@register(
    "ratchet_rules",
    f"""WITH {RULES_SQL} SELECT key, rule, base, now, CASE rule WHEN 'max' THEN now <= base WHEN 'min' THEN now >= base ELSE now >= 0.05 END AS passed,
  CASE rule WHEN 'max' THEN now < base WHEN 'min' THEN now > base ELSE FALSE END AS tightened FROM bl""",
)
def ratchet_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each family's figure against its budget under a rule: at most, at least, or over a floor."""
    rule = F.element_at(F.array(F.lit("max"), F.lit("min"), F.lit("floor")), F.length("family") % 3 + 1)
    sides = [F.round(F.avg(F.when(F.col("setting") == s, F.col("seconds"))), 6).alias(n) for s, n in (("F", "base"), ("O", "now"))]
    return E.ratchet_rules(scores(spark, sf_dir).groupBy(F.col("family").alias("key"), rule.alias("rule")).agg(*sides), 0.05)


@register("batch_csv", "SELECT o_orderkey, o_orderkey || ',\"' || replace(o_orderstatus || '\"' || o_orderpriority, '\"', '\"\"') || '\",' || CASE WHEN o_custkey % 5 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS line FROM orders")
def batch_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue rows as lines of CSV: quoted where they hold a quote, comma or line end, empty for null."""
    o = read(spark, sf_dir, "orders")
    columns = [F.col("o_orderkey").cast("string"), F.concat("o_orderstatus", F.lit('"'), "o_orderpriority"), F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey").cast("string"))]
    return o.select("o_orderkey", E.csv_line(columns).alias("line"))
