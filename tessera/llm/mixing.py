"""Mixing sources to target weights by hash-threshold histograms.

A document has a 52-bit hash. Sizes are summed by source and leading hash bits; the bucket
in which a source's budget runs out is the only one that is refined, by the next bits, until
it holds a single hash value. What lies below the threshold is taken, so a filter picks the
rows and nothing is sorted. Budgets over a source's size take every document once and a
second time those below the threshold of the rest: thresholds of growing budgets are nested.

Rows: null texts have size 0; null sources are a source of their own, last in order. Rows
that repeat a doc_id share its hash and so its fate. An empty table gives an empty result;
extra columns are ignored by `mix` and kept by `mixed_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import table, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
HASH_BITS = 52
LEVEL_BITS = 13


def word_count(text: str | Column) -> Column:
    """Number of runs of bytes other than ASCII white space."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def unit_hash(doc_id: str) -> Column:
    """52 bits of the id's MD5, the same in any engine."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Per source: its size, and its target after capping at `most` times the size.

    Resharing what the caps free, by weight, until no target is above its cap ends at
    min(cap, level * weight) for one level: sources are capped in order of cap / weight.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("n"))
    whole = Window.partitionBy()
    ranked = by_source.select("source", "source_size", F.row_number().over(order).alias("n"))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("n") - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("budget", F.sum("source_size").over(whole) * F.lit(float(share)))
    ranked = ranked.withColumn("before", F.sum("cap").over(fill) - F.col("cap")).withColumn("heavy", F.sum("weight").over(whole) - F.sum("weight").over(fill) + F.col("weight"))
    ranked = ranked.withColumn("level", (F.col("budget") - F.col("before")) / F.col("heavy")).withColumn("open", F.col("cap") > F.col("level") * F.col("weight"))
    level = F.min(F.when(F.col("open"), F.struct("n_fill", "level"))).over(whole)["level"]
    ranked = ranked.withColumn("n_fill", F.row_number().over(fill)).withColumn("stop", level)
    return ranked.select("source", "source_size", F.when(F.col("stop").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("stop") * F.col("weight"))).alias("target"))


def thresholds(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per source: the hash below which sizes add up to its budget, whole hash values only.

    sizes: source, size, h. budgets: source, budget. Each level reads the histogram of one
    bucket per source; equal hashes stay together, and a hash whose first half fits is in.
    """
    state = budgets.select("source", F.col("budget").alias("left"), F.lit(0).cast("long").alias("low"))
    for level in range(HASH_BITS // LEVEL_BITS):
        shift = HASH_BITS - LEVEL_BITS * (level + 1)
        here = state.withColumn("prefix", F.shiftright("low", shift + LEVEL_BITS))
        inside = sizes.withColumn("prefix", F.shiftright("h", shift + LEVEL_BITS)) if level else sizes.withColumn("prefix", F.lit(0).cast("long"))
        inside = inside.withColumn("bucket", F.shiftright("h", shift)).groupBy("source", "prefix", "bucket").agg(F.sum("size").alias("held"))
        joined = here.alias("s").join(inside.alias("i"), F.col("s.source").eqNullSafe(F.col("i.source")) & (F.col("s.prefix") == F.col("i.prefix")), "left")
        order = Window.partitionBy("s.source").orderBy("i.bucket").rowsBetween(Window.unboundedPreceding, 0)
        joined = joined.select(F.col("s.source").alias("source"), "left", "low", "bucket", "held", F.sum("held").over(order).alias("upto"))
        last = shift == 0
        fits = (F.col("upto") - F.col("held") / 2 <= F.col("left")) if last else (F.col("upto") <= F.col("left"))
        passed = F.when(fits & F.col("bucket").isNotNull(), F.struct("bucket", "upto"))
        top = joined.groupBy("source").agg(F.first("left").alias("left"), F.first("low").alias("low"), F.max(passed).alias("top"))
        at = F.when(F.col("top").isNull(), F.col("low")).otherwise(F.shiftleft(F.col("top.bucket") + 1, shift))
        state = top.select("source", (F.col("left") - F.coalesce("top.upto", F.lit(0))).alias("left"), at.alias("low"))
        # The boundary is the next bucket that holds anything, not merely the next number.
        if not last:
            after = joined.filter(~fits).groupBy("source").agg(F.min("bucket").alias("next"))
            state = (
                state.alias("a")
                .join(after.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")), "left")
                .select(F.col("a.source").alias("source"), "left", F.coalesce(F.shiftleft("next", shift), F.lit(1 << HASH_BITS).cast("long")).alias("low"))
            )
    return state.select("source", F.col("low").alias("threshold"))


def mixing_plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Per source: its size and target, how often each document is taken, and the hash below which once more."""
    targets = written(source_targets(sized, weights, share, most), "mixing-targets")
    full = F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(int(most)))
    budgets = targets.withColumn("full", F.coalesce(F.when(F.col("source_size") > 0, full), F.lit(0)).cast("long"))
    budgets = budgets.withColumn("budget", F.col("target") - F.col("full") * F.col("source_size"))
    marks = thresholds(sized.select("source", "size", "h"), budgets)
    joined = budgets.alias("a").join(marks.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")), "left")
    once_more = F.when(F.col("full") < int(most), F.col("threshold")).otherwise(F.lit(0))
    return written(joined.select(F.col("a.source").alias("source"), "source_size", "target", "full", once_more.alias("threshold")), "mixing-plan")


def _sized(docs: DataFrame) -> DataFrame:
    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source"), word_count("text").alias("size"), unit_hash("doc_id").alias("h")), "mixing-sizes")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (words the mix takes, repeats counted)."""
    sized = _sized(docs)
    plan = mixing_plan(sized, weights, share, most)
    joined = sized.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
    copies = F.col("full") + (F.col("h") < F.col("threshold")).cast("long")
    return joined.select("d.doc_id", "d.source", "d.size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The rows of the mix: each document as often as it is taken. Texts are filtered where they are read, not moved."""
    own = {name: _free(docs, name) for name in ("source", "full", "threshold", "copies", "copy")}
    plan = mixing_plan(_sized(docs), weights, share, most).select(*[F.col(n).alias(own[n]) for n in ("source", "full", "threshold")])
    joined = docs.join(plan, docs["source"].eqNullSafe(F.col(own["source"])))
    copies = F.col(own["full"]) + (unit_hash("doc_id") < F.col(own["threshold"])).cast("long")
    repeated = joined.withColumn(own["copies"], copies).filter(F.col(own["copies"]) > 0)
    return repeated.withColumn(own["copy"], F.explode(F.sequence(F.lit(1), F.col(own["copies"]).cast("int")))).select(*docs.columns)


def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    while name in docs.columns or name.lower() in [c.lower() for c in docs.columns]:
        name = f"_{name}"
    return name


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source", "copies")


#: The same thresholds by a running sum over the hash: a hash is in if half of it fits.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM s),
w AS (SELECT *, CASE (n - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight,
             source_size * 2.0::DOUBLE AS cap, (SELECT sum(source_size) FROM s) * 1.5::DOUBLE AS budget FROM r),
f AS (SELECT *, sum(cap) OVER o - cap AS before, sum(weight) OVER () - sum(weight) OVER o + weight AS heavy, row_number() OVER o AS k
      FROM w WINDOW o AS (ORDER BY cap / weight, n)),
l AS (SELECT *, (budget - before) / heavy AS level FROM f),
lv AS (SELECT min(k) AS k FROM l WHERE cap > level * weight),
t AS (SELECT l.source, l.source_size, CASE WHEN (SELECT k FROM lv) IS NULL THEN cap
             ELSE least(cap, (SELECT level FROM l WHERE k = (SELECT k FROM lv)) * weight) END AS target FROM l),
b AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(least(floor(target / source_size), 2) AS BIGINT) ELSE 0 END AS copies FROM t),
hs AS (SELECT source, h, sum(size) AS held FROM d GROUP BY source, h),
c AS (SELECT *, sum(held) OVER (PARTITION BY source ORDER BY h) AS upto FROM hs)
SELECT d.doc_id, d.size, CAST(b.source_size AS BIGINT) AS source_size, b.target,
       CAST(d.size * (b.copies + CASE WHEN b.copies < 2 AND c.upto - c.held / 2.0 <= b.target - b.copies * b.source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.h = c.h
"""
