"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney models of the letters of words, one of toxic and one of ordinary
texts, give each word a log-likelihood ratio. Their lower orders are shared continuation
counts of both classes, so rare expressions are smoothed alike and only what the classes'
own longer contexts have seen tells them apart. A text's features are its length-normalised
difference of log-likelihoods and how far its likeliest expressions stand out; a logistic
curve, fitted on labelled rows that the models have not counted, maps them to a score.

The models are fitted on a bounded sample of labelled rows, chosen by hash: at most
`MAX_ROWS` rows and `MAX_BYTES` of text a class (a text over that is left to later rows).
So the model has a size bound and is broadcast; every text is scored whole.

Rows: null and empty texts have no words and get the score of a text without evidence. Labels
that are null are ignored; of labels that disagree on a doc_id the toxic one holds. Without
labels of both classes every score is 0; with one labelled text of a class the curve is a
fixed one over the length-normalised difference. A null doc_id is not held out and has no
label. Repeated rows stay; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Polynomial, chunks, column, long_ids, table, tidied

ORDER = 6
SHARED_ORDER = 3
DISCOUNT = 0.75
MAX_ROWS = 20_000
MAX_BYTES = 24 << 20
THRESHOLD = 0.3
HELD_OUT = 2
#: Words a task remembers, the most letters of such a word, and how many new ones it looks up at once; no result depends on them.
REMEMBERED, LONGEST_REMEMBERED, LOOKED_UP = 100_000, 64, 10_000
START, END = 2, 3

_WORD = re.compile(r"[^\W\d_]+")
_polynomial = Polynomial()


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _symbols(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, each between a start and an end mark, and each word's start."""
    joined = chr(END) + chr(START)
    points = np.frombuffer((chr(START) + joined.join(words) + chr(END)).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.flatnonzero(points == START)


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Prefix hashes; each predicted position; its word's number; how many symbols of its word stand before it."""
    points, starts = _symbols(words)
    at = np.flatnonzero(points != START).astype(np.int32)
    word = (np.cumsum(points == START, dtype=np.int32) - 1)[at]
    return _polynomial.prefixes(points), at, word, at - starts.astype(np.int32)[word]


def _key(prefixes: np.ndarray, at: np.ndarray, n: int, last: int = 1) -> np.ndarray:
    """Hashes of the n symbols up to each position, without the last if `last` is 0."""
    return _polynomial.spans(prefixes, at - n + 1, at + last)


@dataclass
class Order:
    """Terms of one order: by gram its discounted share, by context what is left to the order below. A column a class."""

    grams: np.ndarray
    shares: np.ndarray
    contexts: np.ndarray
    left: np.ndarray


@dataclass
class Model:
    orders: list[Order] = field(default_factory=list)
    floor: float = 1e-4
    weights: np.ndarray | None = None

    def ratios(self, words: list[str]) -> np.ndarray:
        """log p(word | toxic) - log p(word | ordinary)."""
        if not words or not self.orders:
            return np.zeros(len(words))
        prefixes, at, word, before = _grams(words)
        p = np.full((len(at), 2), self.floor)
        for n, order in enumerate(self.orders, 1):
            there = np.flatnonzero(before >= n - 1)
            if not len(there):
                break
            share, left = _looked_up(order.grams, order.shares, _key(prefixes, at[there], n), 0.0), _looked_up(order.contexts, order.left, _key(prefixes, at[there], n, 0), 1.0)
            p[there] = share + left * p[there]
        logs = np.log(p)
        return np.bincount(word, logs[:, 1] - logs[:, 0], minlength=len(words))


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> np.ndarray:
    if not len(keys):
        return np.full((len(wanted), 2), default)
    i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    out = values[i].astype(np.float64)
    out[keys[i] != wanted] = default
    return out


TRAIN_WORDS = 40_000


def _distinct_grams(words: list[str], counts: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """Grams of one order: key, context's key, key without the first symbol, count in each class, whether at a word's start.

    Words are read in parts, so what is held grows with the distinct grams, not with the text.
    """
    parts = []
    for i in range(0, len(words), TRAIN_WORDS):
        prefixes, at, word, before = _grams(words[i : i + TRAIN_WORDS])
        ok = before >= n - 1
        here, owner = at[ok], word[ok]
        grams, first, place = np.unique(_key(prefixes, here, n), return_index=True, return_inverse=True)
        lead = here[first]
        held = np.column_stack([np.bincount(place, counts[i + owner, c], minlength=len(grams)) for c in (0, 1)])
        parts.append((grams, _key(prefixes, lead, n, 0), _key(prefixes, lead, n - 1), held, before[ok][first] == n - 1))
    keys = np.concatenate([x[0] for x in parts])
    grams, first, place = np.unique(keys, return_index=True, return_inverse=True)
    del keys
    contexts, suffixes, starts = (np.concatenate([x[k] for x in parts])[first] for k in (1, 2, 4))
    held = np.concatenate([x[3] for x in parts])
    del parts
    return grams, contexts, suffixes, np.column_stack([np.bincount(place, held[:, c], minlength=len(grams)) for c in (0, 1)]), starts


def train(words: list[str], counts: np.ndarray) -> Model:
    """Kneser-Ney models of the words. counts: words x 2 (ordinary, toxic)."""
    model = Model()
    longer: tuple[np.ndarray, np.ndarray] | None = None
    for n in range(ORDER, 0, -1):
        grams, contexts_of, suffixes, raw, starts = _distinct_grams(words, counts, n)
        held = raw
        if longer is not None:
            # Continuations: in how many longer grams it ends; grams at a word's start count as often as they occur.
            held = np.where(starts[:, None], raw, 0)
            place = np.searchsorted(grams, longer[0])
            held += np.column_stack([np.bincount(place, longer[1][:, c], minlength=len(grams)) for c in (0, 1)])
        longer = (suffixes, raw > 0)
        if n <= SHARED_ORDER:
            held = np.repeat(held.sum(axis=1, keepdims=True), 2, axis=1)
        contexts, under = np.unique(contexts_of, return_inverse=True)
        total = np.column_stack([np.bincount(under, held[:, c], minlength=len(contexts)) for c in (0, 1)])
        kinds = np.column_stack([np.bincount(under, held[:, c] > 0, minlength=len(contexts)) for c in (0, 1)])
        with np.errstate(invalid="ignore", divide="ignore"):
            shares = np.where(held > 0, np.maximum(held - DISCOUNT, 0) / total[under], 0)
            left = np.where(total > 0, DISCOUNT * kinds / total, 1)
        model.orders.append(Order(grams, shares.astype(np.float32), contexts, left.astype(np.float32)))
    model.orders.reverse()
    model.floor = 1.0 / max(2, len(model.orders[0].grams))
    return model


FEATURES = 5
#: The curve where no row is left to fit it: the length-normalised difference alone.
UNFITTED = [4.0, 0.0, 0.0, 0.0, 0.0, -1.0]


def features(ratios: np.ndarray) -> np.ndarray:
    """Length-normalised difference, the highest and third highest ratio, the share over 4, and the length."""
    n = len(ratios)
    if not n:
        return np.zeros(FEATURES)
    top = np.sort(np.partition(ratios, -min(3, n))[-3:])
    return np.array([np.clip(ratios.mean(), -2, 2), min(top[-1], 20), min(top[0] if n >= 3 else 0, 20), min(1, np.maximum(ratios - 4, 0).sum() / (n + 20)), np.log1p(n)])


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted logistic regression by Newton steps; the last weight is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[-1] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (weight * (y - p)) - keep * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


class Scorer:
    """Remembers the ratios of words it has met."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def features(self, texts: list[str | None]) -> np.ndarray:
        split = [words_of(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list(set().union(*split).difference(self.known)) if split else []
        for i in range(0, len(new), LOOKED_UP):
            some = new[i : i + LOOKED_UP]
            self.known.update(zip(some, self.model.ratios(some).tolist(), strict=True))
        out = np.array([features(np.array([self.known[w] for w in words])) for words in split]).reshape(-1, FEATURES)
        for w in new:
            if len(w) > LONGEST_REMEMBERED:
                del self.known[w]
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.model.weights is None:
            return np.zeros(len(texts))
        x = self.features(texts)
        return 1 / (1 + np.exp(-np.clip(x @ self.model.weights[:-1] + self.model.weights[-1], -30, 30)))


def held_out(doc_id: str | Column) -> Column:
    """Whether a row's labels are kept from all fitting: crc32 of its id as text leaves 2 on division by 4."""
    ids = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(ids.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def training_labels(labels: DataFrame) -> DataFrame:
    """doc_id, toxic of the rows that may be learnt from."""
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(~held_out("doc_id"))


def _sampled(docs: DataFrame, labels: DataFrame) -> tuple[dict[int, int], dict[int, int]]:
    """The sample's ids and classes, and how many rows each class has in all."""
    known = training_labels(labels).withColumn("toxic", (F.col("toxic") > 0).cast("int")).withColumn("h", F.xxhash64("doc_id"))
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    spark = docs.sparkSession
    picked = [known.filter(F.col("toxic") == c).orderBy("h").limit(MAX_ROWS) for c in (0, 1)]
    rows = picked[0].unionByName(picked[1]).collect()
    if not rows:
        return {}, totals
    few = spark.createDataFrame([(r["doc_id"], r["toxic"], r["h"]) for r in rows], "doc_id long, toxic int, h long")
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).join(F.broadcast(few), "doc_id")
    sizes = sizes.groupBy("doc_id", "toxic", "h").agg(F.max("size").alias("size")).collect()
    found: dict[int, int] = {}
    room = {0: MAX_BYTES, 1: MAX_BYTES}
    for r in sorted(sizes, key=lambda r: (r["h"], r["doc_id"])):
        if r["size"] <= room[r["toxic"]]:
            room[r["toxic"]] -= r["size"]
            found[r["doc_id"]] = r["toxic"]
    return found, totals


def calibrating(sample: dict[int, int]) -> set[int]:
    """The rows left to the curve: of each class a quarter, chosen by hash, one at least and never all."""
    found: set[int] = set()
    for c in set(sample.values()):
        own = sorted((i for i in sample if sample[i] == c), key=lambda i: (zlib.crc32(b"curve:%d" % i), i))
        found.update(own[: min(max(1, len(own) // 4), len(own) - 1)])
    return found


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The models and the curve, from the sample of labelled rows."""
    spark = docs.sparkSession
    sample, totals = _sampled(docs, labels)
    if len(set(sample.values())) < 2:
        return Model()
    curve = calibrating(sample)
    few = spark.createDataFrame([(i, c, i in curve) for i, c in sample.items()], "doc_id long, toxic int, curve boolean")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(few), "doc_id").select("toxic", "curve", "text")

    @tidied
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for c, text in zip(*(column(batch, x).to_pylist() for x in ("toxic", "text")), strict=True):
                seen[c].update(words_of(text))
        words = list(set(seen[0]) | set(seen[1]))
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([seen[c][w] for w in words], pa.int64()) for c in (0, 1))], names=["word", "ordinary", "toxic"])

    counted = texts.filter("NOT curve").mapInArrow(count, "word string, ordinary long, toxic long").groupBy("word").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic")).toArrow()
    if not counted.num_rows:
        return Model()
    counted = counted.sort_by("word")
    counts = np.column_stack([counted.column("ordinary").to_numpy(), counted.column("toxic").to_numpy()]).astype(np.float32)
    words = counted.column("word").to_pylist()
    del counted
    model = train(words, counts)
    del words, counts
    shared = spark.sparkContext.broadcast(model)

    @tidied
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in chunks(batches, "text"):
            x = scorer.features(column(batch, "text").to_pylist())
            yield pa.RecordBatch.from_arrays([column(batch, "toxic"), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["toxic", "x"])

    rows = texts.filter("curve").mapInArrow(measure, "toxic int, x array<double>").toArrow()
    shared.destroy()
    y = rows.column("toxic").to_numpy().astype(np.float64)
    if len(set(y.tolist())) < 2:
        # A class has one labelled row only, and the models have it.
        model.weights = np.array(UNFITTED)
        return model
    x = np.array(rows.column("x").to_pylist())
    x = x[np.lexsort((*x.T, y))]
    y = np.sort(y)
    # Classes weigh as they occur among all rows that may be learnt from.
    weight = np.where(y == 1, totals[1] / max(1, (y == 1).sum()), totals[0] / max(1, (y == 0).sum()))
    model.weights = fit_curve(x, y, weight * len(y) / weight.sum())
    return model


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, and mean_ratio (the length-normalised difference) of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in chunks(batches, "text"):
            texts = column(batch, "text").to_pylist()
            yield pa.RecordBatch.from_arrays([long_ids(batch), pa.array(scorer.scores(texts), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double")


def keep_ordinary(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score under the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in chunks(batches, "text"):
            yield batch.filter(pa.array(scorer.scores(column(batch, "text").to_pylist()) < threshold))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = score_texts(docs, fit(docs, labels))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
