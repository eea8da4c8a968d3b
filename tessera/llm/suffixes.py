"""Removal of repeated passages of bytes by a hash-compared suffix sort.

A byte goes if a string of `width` bytes that covers it also starts earlier: in a document
of smaller doc_id, or before it in its own. Texts are UTF-8; strings never cross documents.

Suffixes are dealt into buckets that no pair of equal strings can straddle: a string's anchor
is the k-gram of lowest hash in it, leftmost of equals, so equal strings have equal anchors
at equal offsets. Neighbouring strings with one anchor are a stretch. Stretches equal as a
whole are settled by two 64-bit hashes; of the others, one of each kind is cut out of its text,
and the suffixes of a bucket are sorted: comparisons find the common extension of two suffixes
by binary search over prefix polynomial hashes, in a mergesort; neighbours with `width` bytes
in common are verified byte by byte. Buckets of over `MOST` stretches (a passage that many
texts share, with other surroundings in each) are dealt over the cluster by their strings'
hashes instead, exactly.

Rows: null texts are empty; texts under `width` bytes stay. Rows that repeat both doc_id and text
share their places and so don't remove each other; others of one doc_id come in the order of
their texts' hashes. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import BASE_2, Polynomial, chunks, column, mix, packed, ranges, sliding_min, table, tidied, written

WIDTH = 100
GRAM = 24
#: A stretch's number of strings has ten bits.
MOST_WIDTH = 1000
MOST = 20_000
_POSITION_BITS = 24
_SEGMENT = 1 << 23
_MASK = np.uint64((1 << _POSITION_BITS) - 1)

_polynomial = Polynomial()
_second = Polynomial(BASE_2)

PLACE = ["doc_id", "text_hash"]


def stretches(raw: np.ndarray, bounds: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of each stretch: owner, first start, number of strings, the anchor's offset, its hash and the stretch's hash."""
    parts = []
    begins, rooms, owners = bounds[:-1], np.maximum(np.diff(bounds) - width + 1, 0), np.arange(len(bounds) - 1)
    whole = len(raw) <= _SEGMENT
    for a, room, owner in [(None, None, None)] if whole else [(b + i, min(_SEGMENT, r - i), o) for b, r, o in zip(begins, rooms, owners, strict=True) for i in range(0, r, _SEGMENT)]:
        piece = raw if whole else raw[a : a + room + width - 1]
        prefixes = _polynomial.prefixes(piece)
        grams = mix(_polynomial.windows(prefixes, gram))
        keyed = (grams & ~_MASK) | np.arange(len(grams), dtype=np.uint64)
        least = sliding_min(keyed, width - gram + 1)
        at = ranges(begins, rooms) if whole else np.arange(room)
        if not len(at):
            continue
        own = np.repeat(owners, rooms) if whole else np.full(room, owner)
        anchor = (least[at] & _MASK).astype(np.int64)
        new = np.ones(len(at), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (own[1:] != own[:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(at)))
        start, anchor = at[first], anchor[first]
        hashes = mix(_second.spans(_second.prefixes(piece), start, start + count + width - 1) + (anchor - start).astype(np.uint64))
        base = bounds[own[first]] if whole else begins[owner] - a
        parts.append((own[first], start - base, count, anchor - start, grams[anchor], hashes))
    if not parts:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


class SuffixSort:
    """Sorts suffixes of a byte array within buckets, by their first `width` bytes."""

    def __init__(self, raw: np.ndarray, width: int = WIDTH):
        self.raw, self.width, self.prefixes = raw, width, _polynomial.prefixes(raw)

    def extensions(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes a and b, `width` at most, by binary search over hashes."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), self.width)
        for _ in range(self.width.bit_length()):
            mid = (low + high + 1) // 2
            same = _polynomial.spans(self.prefixes, a, a + mid) == _polynomial.spans(self.prefixes, b, b + mid)
            low = np.where(same, mid, low)
            high = np.where(same, high, np.maximum(mid - 1, low))
        return low

    def below(self, a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether suffix a sorts before b, or with it where asked."""
        common = self.extensions(a, b)
        inside = common < self.width
        step = np.where(inside, common, 0)
        return np.where(inside, self.raw[a + step] < self.raw[b + step], or_equal)

    def sort(self, starts: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """starts in the order of their buckets (ascending already), and in each by suffix: a bottom-up mergesort.

        All runs of a level are merged at once: an element's place is its place in its run
        plus how many of the sibling run come before it, which a binary search counts.
        """
        starts = starts.copy()
        first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(first, len(bucket)))
        base, size = np.repeat(first, sizes), np.repeat(sizes, sizes)
        width = 1
        while len(sizes) and width < sizes.max():
            live = np.flatnonzero(size > width)
            own = live - base[live]
            run = own // width
            left = run % 2 == 0
            low = np.minimum(np.where(left, run + 1, run - 1) * width, size[live])
            high = np.minimum(low + width, size[live])
            floor = low.copy()
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                mid = (low[open_] + high[open_]) // 2
                other = starts[base[live[open_]] + mid]
                # Equals of the left run stay before those of the right.
                before = self.below(other, starts[live[open_]], ~left[open_])
                low[open_] = np.where(before, mid + 1, low[open_])
                high[open_] = np.where(before, high[open_], mid)
            place = base[live] + (run // 2) * 2 * width + own % width + (low - floor)
            starts[place] = starts[live]
            width *= 2
        return starts

    def equal_runs(self, starts: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Of sorted suffixes, a number for each run that has `width` bytes in common; every equality is verified."""
        if len(starts) < 2:
            return np.zeros(len(starts), np.int64)
        a, b = starts[:-1], starts[1:]
        same = np.zeros(len(a), bool)
        near = np.flatnonzero(bucket[1:] == bucket[:-1])
        near = near[self.extensions(a[near], b[near]) == self.width]
        span = np.arange(self.width)
        for i in range(0, len(near), 50_000):
            some = near[i : i + 50_000]
            same[some] = (self.raw[a[some][:, None] + span] == self.raw[b[some][:, None] + span]).all(axis=1)
        if not same[near].all():
            raise HashCollision
        return np.concatenate([[0], np.cumsum(~same)])


class HashCollision(ValueError):
    """Two different strings have one hash; sort without hashes."""


def sorted_runs(raw: np.ndarray, starts: np.ndarray, bucket: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Sorted suffixes and the number of each one's run of equals."""
    work = SuffixSort(raw, width)
    order = work.sort(starts, bucket)
    try:
        return order, work.equal_runs(order, bucket)
    except HashCollision:
        texts = {int(s): raw[s : s + width].tobytes() for s in starts}
        order = np.array(sorted(range(len(starts)), key=lambda i: (bucket[i], texts[int(starts[i])], starts[i])))
        out = starts[order]
        new = [True] + [bucket[i] != bucket[i - 1] or texts[int(out[i])] != texts[int(out[i - 1])] for i in range(1, len(out))]
        return out, np.cumsum(new)


STRETCH = "doc_id bigint, text_hash bigint, anchor bigint, whole bigint, packed bigint"


def _stretch_rows(docs: DataFrame, width: int) -> DataFrame:
    """A row for each stretch; packed holds its start, number of strings and anchor's offset."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            raw, bounds = packed(column(batch, "text"))
            owner, start, count, offset, anchor, whole = stretches(raw, bounds, width)
            place = [pa.array(column(batch, k).to_numpy(zero_copy_only=False)[owner], pa.int64()) for k in PLACE]
            rest = (anchor.view(np.int64), whole.view(np.int64), start << 20 | count << 10 | offset)
            yield pa.RecordBatch.from_arrays([*place, *(pa.array(x, pa.int64()) for x in rest)], names=[*PLACE, "anchor", "whole", "packed"])

    return docs.mapInArrow(run, STRETCH)


SPAN = "doc_id bigint, text_hash bigint, start bigint, stop bigint"


def _cut_out(chosen: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """Each stretch with its bytes. Texts travel compressed."""
    wanted = chosen.groupBy(*PLACE).agg(F.collect_list(F.struct("anchor", "packed", "hot")).alias("parts"))

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            for row in batch.slice(0).to_pylist():
                text = expand.decompress(row["body"])
                rows = [(p["anchor"], p["packed"], p["hot"], p["packed"] >> 20, (p["packed"] >> 10) & 1023) for p in row["parts"]]
                n = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["doc_id"]] * n, pa.int64()),
                        pa.array([row["text_hash"]] * n, pa.int64()),
                        *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.bool_()))),
                        pa.array([text[r[3] : r[3] + r[4] + width - 1] for r in rows], pa.binary()),
                    ],
                    names=[*PLACE, "anchor", "packed", "hot", "bytes"],
                )

    joined = _compressed(docs).join(wanted, PLACE)
    return joined.mapInArrow(_merged_batches(run), "doc_id bigint, text_hash bigint, anchor bigint, packed bigint, hot boolean, bytes binary")


def _merged_batches(run, rows: int = 20_000):
    """Joins the small batches that `run` yields."""

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in run(batches):
            held.append(batch)
            n += batch.num_rows
            if n >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return merged


def _compressed(docs: DataFrame) -> DataFrame:
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            bodies = [squeeze.compress((t or "").encode()) for t in column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(column(batch, k) for k in PLACE), pa.array(bodies, pa.binary())], names=[*PLACE, "body"])

    return docs.mapInArrow(run, "doc_id bigint, text_hash bigint, body binary")


def _sorted_buckets(pieces: DataFrame, width: int) -> DataFrame:
    """Spans that the suffix sort of each bucket finds."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            anchors = held.column("anchor").to_numpy()
            last = int(np.flatnonzero(anchors != anchors[-1])[-1]) + 1 if len(anchors) and (anchors != anchors[-1]).any() else 0
            if last:
                yield _bucket_spans(held.slice(0, last).combine_chunks(), width)
                held = held.slice(last)
        if held is not None and held.num_rows:
            yield _bucket_spans(held.combine_chunks(), width)

    return pieces.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, SPAN)


def _bucket_spans(rows: pa.Table, width: int) -> pa.RecordBatch:
    pieces = rows.column("bytes").combine_chunks()
    raw, bounds = packed(pieces)
    coded = rows.column("packed").to_numpy()
    start, count, offset = coded >> 20, (coded >> 10) & 1023, coded & 1023
    owner = np.repeat(np.arange(len(coded)), count)
    at = ranges(bounds[:-1], count)
    # Equal strings have the same anchor at the same distance.
    shift = at - bounds[owner] - offset[owner]
    anchors = rows.column("anchor").to_numpy()
    number = np.cumsum(np.append(0, anchors[1:] != anchors[:-1]))
    bucket = number[owner] * 2048 + (shift + 1024)
    hashes = _second.spans(_second.prefixes(raw), at, at + width)
    order = np.lexsort((hashes, bucket))
    b, h = bucket[order], hashes[order]
    twin = np.zeros(len(order), bool)
    pair = (b[1:] == b[:-1]) & (h[1:] == h[:-1])
    twin[1:] |= pair
    twin[:-1] |= pair
    order = np.sort(order[twin])
    order = order[np.argsort(bucket[order], kind="stable")]
    starts = at[order]
    suffixes, runs = sorted_runs(raw, starts, bucket[order], width)
    index = np.searchsorted(bounds, suffixes, side="right") - 1
    where = start[index] + suffixes - bounds[index]
    ids, hashed = (rows.column(k).to_numpy()[index] for k in PLACE)
    by = np.lexsort((where, hashed, ids, runs))
    later = np.append(False, runs[by][1:] == runs[by][:-1])
    # The first of each run stays, as do rows at the very same place.
    lead = np.maximum.accumulate(np.where(later, 0, np.arange(len(by))))
    same = (ids[by] == ids[by][lead]) & (hashed[by] == hashed[by][lead]) & (where[by] == where[by][lead])
    gone = by[later & ~same]
    return _spans(ids[gone], hashed[gone], where[gone], width)


def _spans(ids: np.ndarray, hashed: np.ndarray, where: np.ndarray, width: int) -> pa.RecordBatch:
    """Strings that follow one another as one span."""
    order = np.lexsort((where, hashed, ids))
    ids, hashed, where = ids[order], hashed[order], where[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (hashed[1:] != hashed[:-1]) | (where[1:] > where[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(ids)) - 1 if len(first) else first
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids[first], hashed[first], where[first], where[last] + width)], names=[*PLACE, "start", "stop"])


def _hot_buckets(pieces: DataFrame, width: int) -> DataFrame:
    """Spans in buckets too large for one task: their strings' two hashes are grouped over the cluster."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, bounds = packed(column(batch, "bytes"))
            coded = column(batch, "packed").to_numpy()
            count = (coded >> 10) & 1023
            owner, at = np.repeat(np.arange(len(coded)), count), ranges(bounds[:-1], count)
            where = (coded >> 20)[owner] + at - bounds[owner]
            hashes = [mix(p.spans(p.prefixes(raw), at, at + width)).view(np.int64) for p in (_polynomial, _second)]
            place = [column(batch, k).to_numpy()[owner] for k in PLACE]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (*hashes, *place, where)], names=["h", "g", *PLACE, "start"])

    strings = pieces.mapInArrow(run, "h bigint, g bigint, doc_id bigint, text_hash bigint, start bigint")
    place = F.struct(*PLACE, "start")
    firsts = strings.groupBy("h", "g").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return strings.join(firsts, ["h", "g"]).filter(place > F.col("first")).select(*PLACE, "start", (F.col("start") + width).alias("stop"))


def repeated_spans(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, text_hash, start, stop of byte spans that later copies cover; they may overlap. docs: those and text."""
    if not GRAM <= width <= MOST_WIDTH:
        raise ValueError(f"width has to be {GRAM} to {MOST_WIDTH} bytes")
    rows = _stretch_rows(docs, width)
    again = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor")
    again = written(again, "suffix-anchors")
    shared = written(rows.join(again, "anchor", "left_semi"), "suffix-stretches")
    place = F.struct(*PLACE, "packed")
    kinds = written(shared.groupBy("anchor", "whole").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")), "suffix-kinds")
    copies = shared.join(kinds.filter("n > 1").select("anchor", "whole", "first"), ["anchor", "whole"]).filter(place > F.col("first"))
    start, count = F.shiftright("packed", 20), F.shiftright("packed", 10).bitwiseAND(1023)
    settled = copies.select(*PLACE, start.alias("start"), (start + count + width - 1).alias("stop"))

    sizes = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    chosen = kinds.join(sizes, "anchor").select("anchor", "first.*", (F.col("m") > MOST).alias("hot"))
    pieces = written(_cut_out(chosen, docs, width), "suffix-pieces")
    found = _sorted_buckets(pieces.filter("NOT hot"), width)
    hot = _hot_buckets(pieces.filter("hot"), width)
    return written(settled.unionByName(found).unionByName(hot), "suffix-spans")


RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.coalesce("text", F.lit("")).alias("text")).withColumn("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))))


def dedup_passages(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept: what is left of every text, as bytes."""
    own = keyed(docs)
    spans = repeated_spans(own, width)
    by_place = spans.groupBy(*PLACE).agg(F.collect_list(F.struct("start", "stop")).alias("spans"))

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            ids, bodies, spans = column(batch, "doc_id").to_pylist(), column(batch, "body").to_pylist(), column(batch, "spans")
            rows = []
            for i, body, cut in zip(ids, bodies, spans, strict=True):
                text = expand.decompress(body)
                merged: list[list[int]] = []
                if cut.is_valid:
                    flat = cut.values.flatten()
                    for a, b in sorted(zip(flat[0].to_pylist(), flat[1].to_pylist(), strict=True)):
                        if merged and a <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], b)
                        else:
                            merged.append([a, b])
                edges = [0, *(x for m in merged for x in m), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                rows.append((None if i == -(1 << 63) else i, len(text), len(text) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=[x.split()[0] for x in RESULT.split(", ")])

    return _compressed(own).join(by_place, PLACE, "left").select("doc_id", "body", "spans").mapInArrow(run, RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_passages(table(spark, sf_dir, "documents")).drop("kept")
