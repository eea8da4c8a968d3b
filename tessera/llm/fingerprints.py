"""Document fingerprints from closed syncmers.

A k-mer of code points is an anchor if the least of its inner s-mers stands at either end.
Whether it is depends on the k-mer alone, so equal passages have equal anchors wherever they
stand; `match_positions` aligns two texts by them, and `n_aligned` counts the pairs. A
fingerprint is the lowest hashes of a text's anchors: one of `SHARE`, but `SIZE` at least. So it
grows with the text and is all anchors of a short one. Likeness estimates the Jaccard index
of two texts' anchors from the hashes below the lower of the two fingerprints' bounds, where
both are complete. Those are `SIZE` distinct hashes or more, so its standard error is 0.045 at
most; it is exact for texts of up to `SIZE` anchors.

Rows: a null text is empty; empty texts have an empty fingerprint, alike to one another (1)
and to nothing else (0). A text without an anchor (under k code points always, under 2k - s
perhaps) is its own anchor. Equal texts have equal fingerprints. A text is read in segments
of `SEGMENT` code points, so a long one takes a small multiple of its size. Rows that repeat a
doc_id are ordered by a hash of their text; a null doc_id comes last. Extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Polynomial, chunks, column, mix, sliding_min, table, tidied

K, S = 20, 8
SIZE, SHARE = 128, 8
HASH_BYTES = 5
SEGMENT = 1 << 20
#: Bytes of text a run of ids holds, about.
PART_BYTES = 64 << 20

_polynomial = Polynomial()


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts end to end, and the bounds of the texts in them."""
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), bounds


def anchors(texts: list[str], k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Closed syncmers: the text's number, the position in it and the hash of each."""
    points, bounds = code_points(texts)
    parts = [_closed(points[i : i + SEGMENT + k - 1], i, k, s) for i in range(0, max(1, len(points)), SEGMENT)]
    at, hashes = (np.concatenate([x[i] for x in parts]) for i in (0, 1))
    owner = np.searchsorted(bounds, at, side="right") - 1
    whole = at + k <= bounds[owner + 1]
    at, owner, hashes = at[whole], owner[whole], hashes[whole]
    # Texts without an anchor are their own; from 2k - s code points on there is one.
    bare = np.flatnonzero((np.bincount(owner, minlength=len(texts)) == 0) & (np.diff(bounds) > 0))
    own = [_hashed(points[bounds[i] : bounds[i + 1]], np.zeros(1, np.int64), np.diff(bounds)[i : i + 1]) for i in bare]
    owner, at, hashes = np.concatenate([owner, bare]), np.concatenate([at, bounds[bare]]), np.concatenate([hashes, *own])
    order = np.argsort(owner, kind="stable")
    return owner[order], (at - bounds[owner])[order], hashes[order]


def _hashed(points: np.ndarray, starts: np.ndarray, sizes: np.ndarray | int) -> np.ndarray:
    return mix(_polynomial.spans(_polynomial.prefixes(points), starts, starts + sizes) ^ np.uint64(0x5851F42D4C957F2D))


def _closed(points: np.ndarray, offset: int, k: int, s: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the closed syncmers of a run of code points."""
    inner = mix(_polynomial.windows(_polynomial.prefixes(points), s))
    least = sliding_min(inner, k - s + 1)
    at = np.flatnonzero((inner[: len(least)] == least) | (inner[k - s :] == least)) if len(least) else np.zeros(0, np.int64)
    return at + offset, _hashed(points, at, k)


class Fingerprint(NamedTuple):
    """The lowest hashes, ascending, and the bound up to which they are all that the text has."""

    hashes: np.ndarray
    bound: int


EVERY = 1 << 64


def fingerprints(texts: list[str], size: int = SIZE, share: int = SHARE) -> list[Fingerprint]:
    """Of each text, the lowest of its distinct anchor hashes: one of `share`, `size` at least."""
    owner, _, hashes = anchors(texts)
    hashes = hashes >> np.uint64(64 - 8 * HASH_BYTES)
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    owner, hashes = owner[new], hashes[new]
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    found = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        kept = hashes[a : min(b, a + max(size, -(-(b - a) // share)))]
        found.append(Fingerprint(kept, EVERY if len(kept) == b - a else int(kept[-1])))
    return found


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """The share of the hashes of either that both have, up to where both are complete."""
    if not len(a.hashes) or not len(b.hashes):
        return float(len(a.hashes) == len(b.hashes))
    bound = min(a.bound, b.bound)
    sides = [x if bound == EVERY else x[: np.searchsorted(x, bound, side="right")] for x in (a.hashes, b.hashes)]
    both = len(np.intersect1d(*sides, assume_unique=True))
    return both / (len(sides[0]) + len(sides[1]) - both)


def hexed(hashes: np.ndarray) -> str:
    return hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - HASH_BYTES :].tobytes().hex()


def match_positions(a: str, b: str) -> list[tuple[int, int]]:
    """Positions in a and b of the anchors that either has once, in the order of a."""
    owner, at, hashes = anchors([a, b])
    x, y = (_once(at[owner == side], hashes[owner == side]) for side in (0, 1))
    _, i, j = np.intersect1d(x[1], y[1], assume_unique=True, return_indices=True)
    return sorted(zip(x[0][i].tolist(), y[0][j].tolist(), strict=True))


def _once(at: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors that occur once."""
    values, first, counts = np.unique(hashes, return_index=True, return_counts=True)
    return at[first[counts == 1]], values[counts == 1]


RESULT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_aligned bigint"


def edited(text: str, after: str) -> str:
    """The text with its second half replaced by the beginning of another."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _in_order(docs: DataFrame, parts: int | None) -> DataFrame:
    """Rows dealt into `parts` runs of descending ids; each run ends with the next run's first row.

    Without a number, there are enough runs for each to hold `PART_BYTES` of text. Columns: part, tail (that first row), doc_id, text. Only the runs' bounds and first ids,
    a few numbers each, pass through the driver; the texts are moved once.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    if parts is None:
        size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    steps = [i / parts for i in range(1, parts)] or [0.5]
    found = keyed.select(key.alias("key")).agg(F.percentile_approx("key", steps, F.lit(max(10_000, 20 * parts))).alias("cuts")).first()
    cuts = np.array(sorted(set(found["cuts"] or [])), np.int64)

    @F.pandas_udf("int")
    def part_of(ids: pd.Series) -> pd.Series:
        return pd.Series(len(cuts) - np.searchsorted(cuts, ids.to_numpy(), side="left"))

    heads = {r["part"]: r["head"] for r in keyed.select(key.alias("key")).withColumn("part", part_of("key")).groupBy("part").agg(F.max("key").alias("head")).collect()}
    filled = sorted(heads)
    tail_of = {heads[p]: filled[i - 1] for i, p in enumerate(filled)}

    @F.pandas_udf("array<struct<part:int,tail:boolean>>")
    def places(ids: pd.Series) -> pd.Series:
        own = len(cuts) - np.searchsorted(cuts, ids.to_numpy(), side="left")
        return pd.Series([[{"part": int(p), "tail": False}, *([{"part": tail_of[i], "tail": True}] if i in tail_of else [])] for i, p in zip(ids.tolist(), own.tolist(), strict=True)])

    spread = keyed.withColumn("place", F.explode(places(key))).select("place.part", "place.tail", "doc_id", "text")
    return spread.repartitionByRange(parts, "part").sortWithinPartitions("part", "tail", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))


def fingerprint_with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Each document's fingerprint, its edited text's, and likeness to that and the next document.

    The next document is the one with the next lower doc_id; after the last comes the first.
    """

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in chunks(batches, "text"):
            part, tail, ids, texts = (column(batch, x).to_pylist() for x in ("part", "tail", "doc_id", "text"))
            rows = [*held, *zip(part, tail, ids, texts, fingerprints(texts), strict=True)]
            held = rows[-1:]
            pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if not a[1]]
            if pairs:
                yield _compared(pairs)

    return _in_order(docs, parts).mapInArrow(run, RESULT)


def _compared(pairs: list[tuple]) -> pa.RecordBatch:
    changed = [edited(a[3], b[3]) for a, b in pairs]
    new = fingerprints(changed)
    out = [
        pa.array([a[2] for a, _ in pairs], pa.int64()),
        pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed]),
        pa.array([hexed(a[4].hashes) for a, _ in pairs]),
        pa.array([hexed(x.hashes) for x in new]),
        pa.array([likeness(a[4], x) for (a, _), x in zip(pairs, new, strict=True)], pa.float64()),
        pa.array([likeness(a[4], b[4]) for a, b in pairs], pa.float64()),
        pa.array([len(match_positions(a[3], x)) for (a, _), x in zip(pairs, changed, strict=True)], pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(out, names=[x.split()[0] for x in RESULT.split(", ")])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_with_next(table(spark, sf_dir, "documents"))
