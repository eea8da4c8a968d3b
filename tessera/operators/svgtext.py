"""Vector documents as text: path data, numbers, element counts, emission, options.

Path data is scanned with one pattern into commands and numbers; absolute positions are running
sums over them. Everything is column expressions; documents are independent rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = r"[A-Za-z]|-?[0-9]*\.?[0-9]+"

# The options, their kinds, defaults and least and greatest values.
OPTIONS = {
    "precision": ("double", 0.1, 0.0, None), "min_area": ("double", 2.0, 0.0, None), "colors": ("int", 64, 1, 4096), "merge": ("double", 0.035, 0.0, None), "max_dim": ("int", 2048, 1, None),
    "time_budget": ("double", 0.0, 0.0, None), "margin": ("double", 0.0, 0.0, None), "harmonize_threshold": ("double", 0.92, 0.0, 1.0), "mode": ("string", "quality", None, None),
}
MODES = ("quality", "fast", "balanced")


def number_text(value: Column, digits: int) -> Column:
    """Shortest decimal of a number rounded to `digits`: no trailing zeros, no leading zero, no minus zero."""
    text = F.format_string(f"%.{digits}f", F.round(value, digits))
    text = F.regexp_replace(text, r"\.?0+$", "") if digits else text
    text = F.regexp_replace(text, r"^(-?)0\.", "$1.")
    return F.when(text.isin("", "-0", "-"), "0").otherwise(text)


def polyline_paths(points: DataFrame, digits: int = 2) -> DataFrame:
    """Each line's path data, absolute: line_id, d."""
    pair = F.concat_ws(" ", number_text(F.col("x"), digits), number_text(F.col("y"), digits))
    joined = points.groupBy("line_id").agg(F.sort_array(F.collect_list(F.struct("seq", pair.alias("p")))).alias("ps"))
    return joined.select("line_id", F.concat(F.lit("M"), F.array_join(F.transform("ps", lambda p: p["p"]), "L")).alias("d"))


def path_tokens(paths: DataFrame) -> DataFrame:
    """line_id, pos, token, command: every token of path data and the command that it belongs to."""
    tokens = paths.select("line_id", F.posexplode(F.regexp_extract_all("d", F.lit(TOKEN), F.lit(0))).alias("pos", "token"))
    letter = F.when(F.col("token").rlike("^[A-Za-z]$"), F.col("token"))
    return tokens.withColumn("command", F.last(letter, ignorenulls=True).over(Window.partitionBy("line_id").orderBy("pos")))


def structure_counts(tokens: DataFrame) -> DataFrame:
    """Per path: subpaths, segments, numbers and bytes of its tokens."""
    is_letter = F.col("token").rlike("^[A-Za-z]$")
    return tokens.groupBy("line_id").agg(
        F.sum((is_letter & F.upper("token").isin("M")).cast("long")).alias("subpaths"),
        F.sum((is_letter & ~F.upper("token").isin("M", "Z")).cast("long")).alias("segments"),
        F.sum((~is_letter).cast("long")).alias("numbers"),
        F.sum(F.length("token").cast("long")).alias("token_bytes"),
    )


def absolute_positions(paths: DataFrame) -> DataFrame:
    """Points of relative path data of `m` and `l`: line_id, seq, x, y by running sums."""
    numbers = path_tokens(paths).filter(~F.col("token").rlike("^[A-Za-z]$"))
    n = F.row_number().over(Window.partitionBy("line_id").orderBy("pos")) - 1
    placed = numbers.select("line_id", F.floor(n / 2).alias("seq"), (n % 2).alias("axis"), F.col("token").cast("double").alias("v"))
    pairs = placed.groupBy("line_id", "seq").agg(F.max(F.when(F.col("axis") == 0, F.col("v"))).alias("dx"), F.max(F.when(F.col("axis") == 1, F.col("v"))).alias("dy"))
    upto = Window.partitionBy("line_id").orderBy("seq")
    return pairs.select("line_id", F.col("seq").cast("int").alias("seq"), F.round(F.sum("dx").over(upto), 2).alias("x"), F.round(F.sum("dy").over(upto), 2).alias("y"))


def rectangles(boxes: DataFrame) -> DataFrame:
    """One document an image: a rectangle for each label's box, larger ones first."""
    area = (F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1)
    shape = F.format_string('<rect x="%d" y="%d" width="%d" height="%d" class="c%d"/>', "x0", "y0", F.col("x1") - F.col("x0") + 1, F.col("y1") - F.col("y0") + 1, "label")
    rows = boxes.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct((-area).alias("k"), "label", shape.alias("s")))).alias("ss"))
    return rows.select("image_id", F.concat(F.lit("<svg>"), F.array_join(F.transform("ss", lambda s: s["s"]), ""), F.lit("</svg>")).alias("svg"))


def tag_counts(pages: DataFrame, html: str = "html") -> DataFrame:
    """How often each element opens over all documents."""
    names = F.explode(F.regexp_extract_all(F.col(html), F.lit(r"<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1)))
    return pages.select(names.alias("tag")).groupBy(F.lower("tag").alias("tag")).agg(F.count(F.lit(1)).alias("n"))


def options_validated(rows: DataFrame, text: str = "options") -> DataFrame:
    """Adds the options as a struct with defaults, and `problem`: invalid JSON, an unknown option or a value out of range."""
    kinds = {"double": T.DoubleType(), "int": T.IntegerType(), "string": T.StringType()}
    schema = T.StructType([T.StructField(n, kinds[k]) for n, (k, *_) in OPTIONS.items()])
    parsed = rows.withColumns({"__o": F.from_json(text, schema), "__k": F.json_object_keys(text)})
    problem = F.when(F.col("__k").isNull(), "not an object")
    problem = problem.when(F.size(F.array_except("__k", F.array(*[F.lit(n) for n in OPTIONS]))) > 0, "unknown option")
    for name, (kind, _, low, high) in OPTIONS.items():
        value = F.col("__o")[name]
        if kind == "string":
            problem = problem.when(value.isNotNull() & ~value.isin(*MODES), name)
        else:
            if low is not None:
                problem = problem.when(value < low, name)
            if high is not None:
                problem = problem.when(value > high, name)
    filled = F.struct(*[F.coalesce(F.col("__o")[n], F.lit(d)).alias(n) for n, (_, d, *_) in OPTIONS.items()])
    return parsed.withColumn("values", filled).withColumn("problem", problem).drop("__o", "__k")
