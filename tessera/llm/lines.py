"""Line deduplication: repeated runs of lines by prefix doubling over line-ID sequences.

Each document is a sequence of line ids: 128 bits of SHA-256 of the trimmed line, so equal ids
are equal lines. A suffix stands at every line. Level k of the suffix array groups the
suffixes that share their first 2**k lines: an interval whose longest common prefix is that
at least. A group's rank is its first suffix (lowest doc_id, then position), so a suffix of
another rank than itself begins a later copy. Level k + 1 groups level k's suffixes by two
ranks, their own and that of the suffix 2**k lines on; it is exact and compares no lines.
Suffixes alone in their group leave the levels, so each is smaller than the one before,
and the levels end where no run of that length repeats.

A repeated run counts if it has `min_lines` lines; its later copies are deleted, wherever
they overlap. The runs of just `min_lines` lines cover all longer ones, and two overlapping
groups of a level rank them; so with one line, the default, deleting needs the first level
only. `depth` asks for all levels: the longest power of two of lines that a document shares
with an earlier suffix.

Rows: null and empty texts have no lines to remove. Lines without words (of white space)
belong to no run, don't part one, and stay. Rows that repeat both doc_id and text share their
places, so they don't remove each other; those that repeat a doc_id only come in the order of
their text's hash; a null doc_id comes first. A line may be of any length. Extra columns
are kept; columns of the operator's own begin with two underscores, which no input column may.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table, written

WORD = r"[^\x20\x09-\x0D]"
DOC = ["__key", "__hash"]


def _place(docs: DataFrame) -> tuple[Column, Column]:
    """Which document a row is: its id, a null one before all others, and its text's hash."""
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(-(1 << 63))), F.xxhash64(docs["text"])


def suffixes(docs: DataFrame) -> DataFrame:
    """A row for each line with words: document, s (number among such lines), i (among all lines) and id."""
    key, hashed = _place(docs)
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("line"))), lambda x: x["line"].rlike(WORD))
    ids = F.transform(lines, lambda x: F.struct(x["i"].alias("i"), F.unhex(F.substring(F.sha2(F.trim(x["line"]).cast("binary"), 256), 1, 32)).alias("id")))
    return docs.select(key.alias("__key"), hashed.alias("__hash"), F.posexplode(ids).alias("s", "x")).select(*DOC, "s", "x.i", "x.id")


def _ranked(suffixed: DataFrame, by: list[str]) -> DataFrame:
    """Suffixes that are not alone in their group, with its rank: the group's first suffix."""
    place = F.struct(*DOC, "s")
    groups = suffixed.groupBy(*by).agg(F.min(place).alias("rank"), F.max(place).alias("last")).filter("rank <> last").drop("last")
    # As a table, so that the join with it can split the suffixes of a very common line.
    groups = written(groups, "line-ranks")
    return suffixed.join(groups, by).select(*DOC, "s", "rank")


def _joined(level: DataFrame, apart: int) -> DataFrame:
    """Suffixes of a level with the rank of the one `apart` lines on, if that is in the level too."""
    then = level.select(*DOC, (F.col("s") - apart).alias("s"), F.col("rank").alias("then"))
    return level.withColumnRenamed("rank", "now").join(then, [*DOC, "s"])


def first_level(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The suffixes, and the first level of groups, as tables."""
    every = written(suffixes(docs), "line-suffixes")
    return every, written(_ranked(every, ["id"]).distinct(), "line-level")


def next_level(level: DataFrame, reach: int) -> DataFrame:
    """Of the level of runs of `reach` lines the one of twice as many, as a table."""
    return written(_ranked(_joined(level, reach), ["now", "then"]), "line-level")


def _later(level: DataFrame) -> DataFrame:
    return level.filter(F.col("rank") != F.struct(*DOC, "s"))


def later_copies(every: DataFrame, level: DataFrame, min_lines: int = 1) -> DataFrame:
    """document, __gone: s and i of each line that a later copy of a run of `min_lines` lines covers."""
    reach = 1
    while 2 * reach <= min_lines:
        level, reach = next_level(level, reach), 2 * reach
    if reach < min_lines:
        level = _ranked(_joined(level, min_lines - reach), ["now", "then"])
    starts = _later(level).select(*DOC, "s")
    covered = starts if min_lines == 1 else starts.select(*DOC, F.explode(F.sequence(F.col("s"), F.col("s") + min_lines - 1)).alias("s")).distinct()
    return every.join(covered, [*DOC, "s"], "left_semi").groupBy(*DOC).agg(F.sort_array(F.collect_set(F.struct("s", "i"))).alias("__gone"))


def depths(level: DataFrame) -> DataFrame:
    """document, __depth: the longest power of two of lines of which the document has a later copy."""
    reach, found = 1, None
    while level.limit(1).count():
        own = _later(level).select(*DOC, F.lit(reach).cast("long").alias("__depth"))
        found = own if found is None else found.unionByName(own)
        level, reach = next_level(level, reach), 2 * reach
    if found is None:
        return level.select(*DOC, F.lit(0).cast("long").alias("__depth"))
    return found.groupBy(*DOC).agg(F.max("__depth").alias("__depth"))


def _bits(gone: Column) -> Column:
    """The deleted lines as bytes, 1 for a deleted one, so that a look at a line takes no search."""
    at = F.transform(gone, lambda x: x["i"])
    return F.array_join(F.transform(at, lambda i, j: F.concat(F.repeat(F.lit("0"), i - F.coalesce(F.get(at, j - 1), F.lit(-1)) - 1), F.lit("1"))), "").cast("binary")


def _deleted(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the lines gone, with __n_lines, __n_removed and __n_runs (of lines that follow one another)."""
    key, hashed = _place(docs)
    joined = docs.join(gone.withColumnsRenamed({"__key": "__own", "__hash": "__own_hash"}), (key == F.col("__own")) & (hashed == F.col("__own_hash")), "left")
    lines = F.split("text", "\n")
    # The transform over one element makes the bits once for all lines.
    kept = F.transform(F.array(_bits(F.col("__gone"))), lambda bits: F.filter(lines, lambda x, i: F.substring(bits, i + 1, F.lit(1)) != F.lit(b"1")))[0]
    runs = F.size(F.filter(F.transform("__gone", lambda x, j: x["s"] - F.coalesce(F.get("__gone", j - 1)["s"], F.lit(-2))), lambda d: d > 1))
    out = joined.select(
        *[docs[c] for c in docs.columns if c != "text"],
        F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("__n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("__n_removed"),
        F.when(F.col("__gone").isNull(), 0).otherwise(runs).cast("long").alias("__n_runs"),
        *([F.coalesce("__depth", F.lit(0).cast("long")).alias("__depth")] if "__depth" in gone.columns else []),
    )
    return out.select(*docs.columns, *out.columns[len(docs.columns) :])


def dedup_lines(docs: DataFrame, min_lines: int = 1, depth: bool = False) -> DataFrame:
    """docs with later copies of repeated runs of lines deleted from text, plus __n_lines, __n_removed, __n_runs, and __depth if asked for."""
    every, level = first_level(docs)
    gone = later_copies(every, level, min_lines)
    if depth:
        # A document has a depth if its first level has a later copy; fewer deletions come with longer runs.
        gone = gone.join(depths(level), DOC, "full")
    return _deleted(docs, gone)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"), depth=True)
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256")
    return done.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), F.col("__n_runs").alias("n_runs"), F.col("__depth").alias("depth"), digest)


SQL = r"""
WITH a AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, i, trim(line, ' ') AS line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM a WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
r AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, k) AS n FROM s),
g AS (SELECT doc_id, i, k, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS island FROM r WHERE n > 1),
p AS (SELECT x.doc_id, y.doc_id AS other, x.k, x.k - y.k AS diagonal FROM r x JOIN r y ON x.line = y.line AND (y.doc_id < x.doc_id OR y.doc_id = x.doc_id AND y.k < x.k)),
q AS (SELECT doc_id, k - row_number() OVER (PARTITION BY doc_id, other, diagonal ORDER BY k) AS island, other, diagonal FROM p),
l AS (SELECT doc_id, count(*) AS n FROM q GROUP BY doc_id, other, diagonal, island),
d AS (SELECT doc_id, CAST(pow(2, floor(log2(max(n)))) AS BIGINT) AS depth FROM l GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS n, count(DISTINCT island) AS runs FROM g GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n FROM a GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM (SELECT a.* FROM a ANTI JOIN g ON a.doc_id = g.doc_id AND a.i = g.i) GROUP BY doc_id)
SELECT o.doc_id, CAST(coalesce(t.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_removed, CAST(coalesce(c.runs, 0) AS BIGINT) AS n_runs,
       coalesce(d.depth, 0) AS depth, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents o LEFT JOIN t USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN d USING (doc_id) LEFT JOIN k USING (doc_id)
"""
