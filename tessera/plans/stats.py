"""Queries of the statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import statistics as S
from tessera.plans.evaluation import PAIR_SQL, builds
from tessera.plans.registry import register
from tessera.sources.derived import PX_SQL, RGB_SQL, read, rgb_tiles, tile_pixels

LI = "SELECT l_suppkey AS g, CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END AS side, l_quantity AS v, l_extendedprice AS w, l_returnflag AS kind, l_orderkey, l_partkey, l_linenumber FROM lineitem"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("g"), F.when(F.col("l_linestatus") == "F", 0).otherwise(1).alias("side"), F.col("l_quantity").alias("v"), F.col("l_extendedprice").alias("w"), F.col("l_returnflag").alias("kind"), "l_orderkey", "l_partkey", "l_linenumber")


AVG_RANK = "rank() OVER (PARTITION BY g ORDER BY {0}) + (count(*) OVER (PARTITION BY g, {0}) - 1) / 2.0::DOUBLE"


@register("spearman_matrix", f"WITH li AS ({LI}), r AS (SELECT g, {AVG_RANK.format('v')} AS a, {AVG_RANK.format('w')} AS b FROM li) SELECT g, CASE WHEN count(*) >= 10 AND stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN round(corr(a, b), 6) END AS rho, count(*) AS n FROM r GROUP BY g")
def spearman_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.spearman(lines(spark, sf_dir), "g", "v", "w")


@register("within_ranks", "SELECT c_custkey AS k, c_nationkey AS g, c_acctbal AS v, CASE WHEN count(*) OVER (PARTITION BY c_nationkey) > 1 THEN round((rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_nationkey, c_acctbal) - 1) / 2.0::DOUBLE - 1) / (count(*) OVER (PARTITION BY c_nationkey) - 1), 6) END AS rank FROM customer")
def within_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("g"), F.col("c_acctbal").alias("v"))
    return S.within_ranks(c, "g", "v")


@register("wasserstein1", f"WITH li AS ({LI}), c AS (SELECT g, v, count(*) FILTER (WHERE side = 0) AS a, count(*) FILTER (WHERE side = 1) AS b FROM li GROUP BY 1, 2), s AS (SELECT g, abs(sum(a) OVER w / nullif(sum(a) OVER p, 0) - sum(b) OVER w / nullif(sum(b) OVER p, 0)) AS d, lead(v) OVER w - v AS gap FROM c WINDOW w AS (PARTITION BY g ORDER BY v), p AS (PARTITION BY g)) SELECT g, round(sum(d * coalesce(gap, 0)), 6) AS w1 FROM s GROUP BY g")
def wasserstein1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.wasserstein(lines(spark, sf_dir), "g", "side", "v")


@register("total_variation", f"WITH li AS ({LI}), c AS (SELECT g, kind, count(*) FILTER (WHERE side = 0) AS a, count(*) FILTER (WHERE side = 1) AS b FROM li GROUP BY 1, 2), s AS (SELECT g, abs(a / nullif(sum(a) OVER (PARTITION BY g), 0) - b / nullif(sum(b) OVER (PARTITION BY g), 0)) AS d FROM c) SELECT g, round(sum(d) / 2, 6) AS tv FROM s GROUP BY g")
def total_variation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.total_variation(lines(spark, sf_dir), "g", "side", "kind")


@register("count_divergence", f"WITH li AS ({LI}), c AS (SELECT g, count(*) FILTER (WHERE side = 0 AND v > 45) AS a, count(*) FILTER (WHERE side = 1 AND v > 45) AS b FROM li GROUP BY 1) SELECT g, a, b, round(CASE WHEN a <= 0 OR b <= 0 THEN abs(ln((b + 0.5) / (a + 0.5))) ELSE abs(ln(b / a)) END, 6) AS divergence FROM c")
def count_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    many = F.col("v") > 45
    c = lines(spark, sf_dir).groupBy("g").agg(F.sum(((F.col("side") == 0) & many).cast("long")).alias("a"), F.sum(((F.col("side") == 1) & many).cast("long")).alias("b"))
    return c.withColumn("divergence", F.round(S.count_divergence(F.col("a"), F.col("b")), 6))


@register("gini", f"WITH li AS ({LI}), r AS (SELECT g, v, (2 * row_number() OVER (PARTITION BY g ORDER BY v) - count(*) OVER (PARTITION BY g) - 1) * v AS x FROM li) SELECT g, CASE WHEN sum(v) > 0 THEN round(sum(x) / (count(*) * sum(v)), 6) END AS gini FROM r GROUP BY g")
def gini(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.gini(lines(spark, sf_dir), "g", "v")


@register("ties_share", f"WITH li AS ({LI}), r AS (SELECT g, coalesce(abs(lag(w) OVER o - w) <= 1e-6, false) OR coalesce(abs(lead(w) OVER o - w) <= 1e-6, false) AS t FROM li WINDOW o AS (PARTITION BY g ORDER BY w)) SELECT g, CASE WHEN count(*) >= 2 THEN round(avg(t::INT), 6) END AS ties FROM r GROUP BY g")
def ties_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.ties_share(lines(spark, sf_dir), "g", "w")


@register("wilson_bounds", f"WITH li AS ({LI}), c AS (SELECT g, count(*) FILTER (WHERE kind = 'R')::DOUBLE AS h, count(*)::DOUBLE AS n FROM li GROUP BY 1), p AS (SELECT *, h / n AS p, 3.8416::DOUBLE AS zz FROM c) SELECT g, round(greatest(100 * ((p + zz / (2 * n)) / (1 + zz / n) - 1.96 / (1 + zz / n) * sqrt(p * (1 - p) / n + zz / (4 * n * n))), 0), 6) AS low, round(least(100 * ((p + zz / (2 * n)) / (1 + zz / n) + 1.96 / (1 + zz / n) * sqrt(p * (1 - p) / n + zz / (4 * n * n))), 100), 6) AS high FROM p")
def wilson_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lines(spark, sf_dir).groupBy("g").agg(F.sum((F.col("kind") == "R").cast("double")).alias("h"), F.count(F.lit(1)).cast("double").alias("n"))
    low, high = S.wilson(F.col("h"), F.col("n"))
    return c.select("g", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@register("geo_mean_ratio", f"WITH {PAIR_SQL} SELECT a.family, round(exp(avg(ln(b.cost / a.cost))), 6) AS ratio, count(*) AS n FROM pr a JOIN pr b ON a.family = b.family AND a.part = b.part AND a.setting = 'F' AND b.setting = 'O' WHERE a.cost > 0 GROUP BY 1")
def geo_mean_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = builds(spark, sf_dir)
    paired = a.select("family", "part", F.col("cost").alias("x")).join(b.select("family", "part", F.col("cost").alias("y")), ["family", "part"]).filter("x > 0")
    return paired.groupBy("family").agg(F.round(S.geometric_mean(F.col("y") / F.col("x")), 6).alias("ratio"), F.count(F.lit(1)).alias("n"))


@register("quartiles", f"WITH li AS ({LI}) SELECT g, round(quantile_cont(w, 0.25), 6) AS q25, round(quantile_cont(w, 0.5), 6) AS q50, round(quantile_cont(w, 0.75), 6) AS q75 FROM li GROUP BY g")
def quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.quartiles(lines(spark, sf_dir), "g", "w")


PAIRED_SQL = PAIR_SQL + """,
pd AS (SELECT a.family, a.part, a.score AS base, b.score AS cur FROM pr a JOIN pr b ON a.family = b.family AND a.part = b.part AND a.setting = 'F' AND b.setting = 'O')"""


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = builds(spark, sf_dir)
    return a.select("family", "part", F.col("score").alias("base")).join(b.select("family", "part", F.col("score").alias("current")), ["family", "part"])


GATE_SQL = PAIRED_SQL + """,
gf AS (SELECT family, avg(base) AS b, avg(cur) AS c FROM pd GROUP BY 1),
gt AS (SELECT (SELECT avg(b) FROM gf) AS bm, (SELECT avg(c) FROM gf) AS cm, avg(base) AS bi, avg(cur) AS ci, count(*) AS n, count(*) FILTER (WHERE cur <> base) AS changed,
              count(*) FILTER (WHERE cur - base < -1e-4) AS better, count(*) FILTER (WHERE cur - base > 1e-4) AS worse FROM pd)"""


@register("gate_compare_point", f"WITH {GATE_SQL} SELECT round(bm, 8) AS base_macro, round(cm, 8) AS current_macro, round(bi, 8) AS base_micro, round(ci, 8) AS current_micro, round(cm / bm - 1, 8) AS rel, n, changed, better, worse FROM gt")
def gate_compare_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.gate_compare(paired(spark, sf_dir), "family")


@register("bootstrap_replicates")
def bootstrap_replicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten thousand replicates; tests compare them with plain resampling."""
    return S.bootstrap(paired(spark, sf_dir), "family", "part")


@register("gate_decide")
def gate_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = paired(spark, sf_dir)
    changed = pairs.agg(F.sum((F.col("base") != F.col("current")).cast("long")).alias("changed"))
    one = S.interval(S.bootstrap(pairs, "family", "part")).crossJoin(changed)
    return one.select("p2_5", "p5", "p95", "p97_5", "se", F.round(S.mde(F.col("se")), 6).alias("mde"), S.decide(F.col("changed"), F.col("p95"), F.col("se"), 0.01).alias("verdict"))


# The intervals' arithmetic and the verdict where SQL can follow: a thousand changes a family stand for replicates.
RULE_SQL = PAIRED_SQL + """,
rp AS (SELECT family, round(cur / base - 1, 8) AS rel FROM pd WHERE base > 0),
iv AS (SELECT family, round(quantile_cont(rel, 0.95), 8) AS p95, round(stddev_samp(rel), 8) AS se, count(*) FILTER (WHERE rel <> 0) AS changed FROM rp GROUP BY 1)"""


@register("gate_rule", f"WITH {RULE_SQL} SELECT family, p95, se, round(2.48647::DOUBLE * se, 6) AS mde, CASE WHEN changed = 0 THEN 'identical' WHEN p95 < -0.001 THEN 'better' WHEN p95 < 0.01 THEN 'non-inferior' WHEN p95 < greatest(0.01, 2.48647 * se) THEN 'within-noise' ELSE 'worse' END AS verdict FROM iv")
def gate_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = paired(spark, sf_dir).filter("base > 0").select("family", F.round(S.relative(F.col("base"), F.col("current")), 8).alias("rel"))
    one = rel.groupBy("family").agg(F.round(F.percentile("rel", 0.95), 8).alias("p95"), F.round(F.stddev_samp("rel"), 8).alias("se"), F.sum((F.col("rel") != 0).cast("long")).alias("changed"))
    return one.select("family", "p95", "se", F.round(S.mde(F.col("se")), 6).alias("mde"), S.decide(F.col("changed"), F.col("p95"), F.col("se"), 0.01).alias("verdict"))


@register("palette_distance", f"WITH {RGB_SQL}, a AS (SELECT image_id, r, g, b FROM rgb WHERE x < 4), b AS (SELECT image_id, r, g, b FROM rgb WHERE x >= 4), d AS (SELECT a.image_id, a.r, a.g, a.b AS bb, min(sqrt((a.r - b.r) * (a.r - b.r) + (a.g - b.g) * (a.g - b.g) + (a.b - b.b) * (a.b - b.b))) AS d FROM a JOIN b USING (image_id) GROUP BY 1, 2, 3, 4), e AS (SELECT b.image_id, b.r, b.g, b.b AS bb, min(sqrt((a.r - b.r) * (a.r - b.r) + (a.g - b.g) * (a.g - b.g) + (a.b - b.b) * (a.b - b.b))) AS d FROM a JOIN b USING (image_id) GROUP BY 1, 2, 3, 4) SELECT image_id, round((x + y) / 2, 6) AS distance FROM (SELECT image_id, avg(d) AS x FROM d GROUP BY 1) JOIN (SELECT image_id, avg(d) AS y FROM e GROUP BY 1) USING (image_id)")
def palette_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The palettes of each tile's left and right half."""
    t = rgb_tiles(spark, sf_dir)
    return S.palette_distance(t.filter("x < 4").select("image_id", "r", "g", "b"), t.filter("x >= 4").select("image_id", "r", "g", "b"), "image_id", ["r", "g", "b"])


@register("huber_mean", f"WITH {PX_SQL} SELECT image_id, round(avg(CASE WHEN abs(v * 10) <= 1.345 THEN v * 10 * (v * 10) ELSE 1.345 * (2 * abs(v * 10) - 1.345) END), 6) AS huber FROM px GROUP BY 1")
def huber_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.huber_mean(tile_pixels(spark, sf_dir), "image_id", F.col("v") * 10, 1.345)


@register("crp_code_length", f"WITH li AS ({LI}), c AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY l_orderkey, l_partkey, l_linenumber, v) - 1 AS before, row_number() OVER (PARTITION BY g, v ORDER BY l_orderkey, l_partkey, l_linenumber) - 1 AS seen FROM li) SELECT g, round(sum(-ln(CASE WHEN seen > 0 THEN seen ELSE 2.0 END / (before + 2.0::DOUBLE))), 6) AS nats, count(*) AS n FROM c GROUP BY g")
def crp_code_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sequential_code_length(lines(spark, sf_dir), "g", "v", ["l_orderkey", "l_partkey", "l_linenumber", "v"], 2.0)


@register(
    "crp_concentration",
    f"""WITH RECURSIVE li AS ({LI}), p AS (SELECT kind, g, count(*) AS n, count(DISTINCT v) AS k FROM li GROUP BY 1, 2),
gs AS (SELECT DISTINCT kind, 0 AS step, -6.0::DOUBLE AS lo, 10.0::DOUBLE AS hi FROM p
  UNION ALL SELECT kind, step + 1, CASE WHEN up THEN a ELSE lo END, CASE WHEN up THEN hi ELSE b END FROM (
    SELECT m.kind, m.step, m.lo, m.hi, m.a, m.b, sum(k * a + lgamma(exp(a)) - lgamma(exp(a) + n)) < sum(k * b + lgamma(exp(b)) - lgamma(exp(b) + n)) AS up
    FROM (SELECT *, hi - (sqrt(5.0::DOUBLE) - 1) / 2 * (hi - lo) AS a, lo + (sqrt(5.0::DOUBLE) - 1) / 2 * (hi - lo) AS b FROM gs WHERE step < 40) m JOIN p ON p.kind = m.kind GROUP BY ALL))
SELECT kind, round(exp((lo + hi) / 2), 3) AS alpha FROM gs WHERE step = 40""",
)
def crp_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How readily each kind's suppliers name new quantities: the likeliest concentration of a restaurant process."""
    pairs = lines(spark, sf_dir).groupBy("kind", "g").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("v").alias("k"))
    return S.crp_concentration(pairs, "kind", 40).select("kind", F.round("alpha", 3).alias("alpha"))


@register("oddities", "WITH s AS (SELECT p_partkey, unnest(['size', 'price']) AS statistic, unnest([p_size::DOUBLE, p_retailprice]) AS v FROM part), z AS (SELECT *, round(abs(v - avg(v) OVER w) / nullif(stddev_pop(v) OVER w, 0), 6) AS z FROM s WINDOW w AS (PARTITION BY statistic)) SELECT statistic, p_partkey, v, z FROM z WHERE z IS NOT NULL QUALIFY row_number() OVER (PARTITION BY statistic ORDER BY z DESC, p_partkey) <= 5")
def oddities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five parts farthest from the rest in each statistic."""
    part = read(spark, sf_dir, "part")
    both = F.explode(F.array(F.struct(F.lit("size").alias("statistic"), F.col("p_size").cast("double").alias("v")), F.struct(F.lit("price").alias("statistic"), F.col("p_retailprice").alias("v"))))
    return S.oddities(part.select("p_partkey", both.alias("s")).select("p_partkey", "s.*"), "statistic", "p_partkey", "v", 5)


@register("redundancy_prune")
def redundancy_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of line items that one kept before makes redundant; tests compare the walk."""
    li = read(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))
    return S.redundancy(li, ["l_quantity", "l_extendedprice", "net", "l_discount", "l_tax"], 0.7)


@register("ratio_against_truth", f"WITH {PAIRED_SQL} SELECT family, part, CASE WHEN base > 0 THEN round(cur / base, 9) ELSE 'NaN'::DOUBLE END AS ratio, CASE WHEN base > 0 AND cur > 0 THEN round(abs(ln(cur / base)), 6) END AS gap FROM pd")
def ratio_against_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios, undefined over nothing, and how far they are from one."""
    base, current = F.col("base"), F.col("current")
    ratio = current / F.when(base > 0, base)
    gap = F.when((base > 0) & (current > 0), F.round(F.abs(F.ln(ratio)), 6))
    return paired(spark, sf_dir).select("family", "part", F.coalesce(F.round(ratio, 9), F.lit(float("nan"))).alias("ratio"), gap.alias("gap"))


@register("paired_summary", f"WITH {PAIRED_SQL}, r AS (SELECT family, part, round(cur / base, 9) AS ratio FROM pd WHERE base > 0) SELECT family, count(*) AS n, round(median(ratio), 6) AS median, round(quantile_cont(ratio, 0.9), 6) AS tail, string_agg(CAST(part AS VARCHAR), ',' ORDER BY ratio DESC, part) FILTER (WHERE k <= 5) AS worst FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY ratio DESC, part) AS k FROM r) GROUP BY 1")
def paired_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each family's ratios the median, the last decile and the five worst."""
    r = paired(spark, sf_dir).filter("base > 0").select("family", "part", F.round(F.col("current") / F.col("base"), 9).alias("ratio"))
    return S.paired_summary(r, "family", "part", "ratio", 5)
