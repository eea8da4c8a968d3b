"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard, components.

Signatures: a first permutation scatters a text's distinct word shingles over D places; one
second permutation, shifted circularly by 0, 1, 2 ..., gives all coordinates. Coordinates are
banded; documents that agree on a band are compared by their whole signatures, and those
estimated at `similarity` less a wide margin form families. Within families every pair of
different shingle sets is confirmed exactly on the full sets, in blocks, so no link between
different texts is lost but by banding (odds below 1e-6 a pair at the threshold), and only
spanning links leave a block. Components of the links give each document its class.

Documents with equal shingle sets are one representative from the start, so copies cost
nothing more. Large buckets and families are split into blocks of bounded size, whose pairs
are dealt over the cluster; no cap drops any.

Rows: null texts and texts without words have no shingles and link with nothing. Texts with fewer
words than a shingle are one shingle. Rows that repeat a doc_id with another text link as
that doc_id. A text without a doc_id stands for itself (component_id null, kept) unless a
document with one has the same shingles. Extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Polynomial, chunks, column, few, long_ids, mix, packed, table, tidied, written
from tessera.llm.components import connected_components

WORDS, SIMILARITY = 5, 80
PLACES = 1 << 19
COORDINATES = 128
MISSED = 1e-6
MARGIN = 0.2
#: Rows of a block: of signatures (128 bytes each), and of full sets. The larger a block, the fewer spanning links leave.
SIGNATURE_BLOCK, SET_BLOCK = 1024, 192
#: Bytes of a long text that are read at once.
SEGMENT = 1 << 22

_polynomial = Polynomial()
_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[ord("A") : ord("Z") + 1] += 32


def shingles(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles, sorted within the text, and the n + 1 bounds of the texts.

    A text over `SEGMENT` bytes (chunks give it alone) is read in parts that share words - 1 words.
    """
    raw, bounds = packed(texts)
    if len(bounds) != 2 or len(raw) <= SEGMENT:
        return _shingles(raw, bounds, words)
    parts, begin, stop = [], 0, 0
    while stop < len(raw):
        stop = min(stop + SEGMENT, len(raw))
        while stop < len(raw) and not _space[raw[stop]]:
            stop += 1
        piece = raw[begin:stop]
        gap = _space[piece]
        starts = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
        if len(starts) >= words or (stop == len(raw) and not parts):
            parts.append(_shingles(piece, np.array([0, len(piece)]), words)[0])
        if words == 1:
            begin = stop
        elif len(starts) >= words:
            begin += int(starts[-(words - 1)])
    values = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
    return values, np.array([0, len(values)])


def _shingles(raw: np.ndarray, bounds: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    raw = _lower[raw]
    inside = ~_space[raw] if len(raw) else np.zeros(0, bool)
    edge = np.zeros(len(raw) + 1, bool)
    edge[bounds] = True
    first = inside & (np.concatenate([[True], ~inside[:-1]]) | edge[:-1]) if len(raw) else inside
    last = inside & (np.concatenate([~inside[1:], [True]]) | edge[1:]) if len(raw) else inside
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = mix(_polynomial.spans(_polynomial.prefixes(raw), starts, ends))
    word_bounds = np.searchsorted(starts, bounds)
    counts = np.diff(word_bounds)
    # One position for each shingle: all but the last words - 1 of a text, or its first word alone.
    room = np.where(counts > 0, np.maximum(counts - words + 1, 1), 0)
    owner = np.repeat(np.arange(len(counts)), room)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(room) - room, room) + np.repeat(word_bounds[:-1], room)
    stop = word_bounds[1:][owner]
    value = np.zeros(len(at), np.uint64)
    for i in range(words):
        there = at + i < stop
        value[there] = mix(value[there] * np.uint64(0x9E3779B97F4A7C15) + hashes[at[there] + i] + np.uint64(i + 1))
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return value[new], np.searchsorted(owner[new], np.arange(len(counts) + 1))


def circulant_signatures(values: np.ndarray, bounds: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """A row of coordinates for each nonempty set; values hold the sets end to end."""
    second = _second_permutation(coordinates)
    places = (mix(values ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(PLACES)).astype(np.int64)
    starts = bounds[:-1][np.diff(bounds) > 0]
    out = np.empty((len(starts), coordinates), np.uint32)
    for k in range(coordinates):
        out[:, k] = np.minimum.reduceat(second[places + (coordinates - k)], starts) if len(starts) else 0
    return out


_permutations: dict[int, np.ndarray] = {}


def _second_permutation(coordinates: int) -> np.ndarray:
    """The permutation, preceded by its end, so that a shift needs no modulo."""
    if coordinates not in _permutations:
        once = np.random.default_rng(20_231).permutation(PLACES).astype(np.uint32)
        _permutations[coordinates] = np.concatenate([once[-coordinates:], once])
    return _permutations[coordinates]


def rows_of_band(similarity: int) -> int:
    """The most coordinates a band may have for a pair at the threshold to share none with odds under MISSED."""
    return next((r for r in range(8, 1, -1) if (1 - (similarity / 100) ** r) ** (COORDINATES // r) < MISSED), 1)


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    bands = COORDINATES // rows
    out = np.zeros((len(signatures), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(signatures), band + 1, np.uint64)
        for k in range(band * rows, (band + 1) * rows):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + signatures[:, k])
        out[:, band] = key
    return out


SIGNED = "doc_id bigint, n_shingles bigint, digest string, bands array<bigint>, signature binary"


def signed(docs: DataFrame, words: int, rows: int) -> DataFrame:
    """n_shingles, a digest of the shingle set, band keys and a byte of each coordinate for every document."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            values, bounds = shingles(column(batch, "text"), words)
            sizes = np.diff(bounds)
            signatures = circulant_signatures(values, bounds)
            keys, marks = band_keys(signatures, rows).view(np.int64), mix(signatures.astype(np.uint64)).astype(np.uint8)
            digests, bands, bytes_of, row = [], [], [], 0
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                digests.append(hashlib.blake2b(values[a:b].tobytes(), digest_size=16).hexdigest() if b > a else None)
                bands.append(keys[row].tolist() if b > a else None)
                bytes_of.append(marks[row].tobytes() if b > a else None)
                row += b > a
            yield pa.RecordBatch.from_arrays(
                [long_ids(batch), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(bands, pa.list_(pa.int64())), pa.array(bytes_of, pa.binary())],
                names=["doc_id", "n_shingles", "digest", "bands", "signature"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SIGNED)


def _in_blocks(members: DataFrame, group: str, payload: list[str], block: int) -> DataFrame:
    """Members of each group, once for each pair of blocks that theirs is in: group, i, j, side, id, payload.

    A group of m has ceil(m / block) blocks; a member's block comes from its id's hash.
    """
    sizes = members.groupBy(group).agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    placed = members.join(sizes, group).withColumn("blocks", F.ceil(F.col("m") / block).cast("int"))
    placed = placed.withColumn("own", F.pmod(F.xxhash64(F.lit(7), "id"), "blocks").cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = placed.select(group, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "id", *payload)
    return pairs.repartition(group, "i", "j").sortWithinPartitions(group, "i", "j", "id")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[list[pa.Table]]:
    """Lists of whole groups of rows that follow one another with equal keys."""
    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows])
        if not held.num_rows:
            continue
        marks = np.column_stack([held.column(k).to_numpy() for k in keys])
        starts = np.concatenate([[0], np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1])
        if len(starts) > 1:
            held = held.combine_chunks()
            yield [held.slice(a, b - a) for a, b in zip(starts[:-1], starts[1:], strict=True)]
            held = held.slice(starts[-1])
    if held is not None and held.num_rows:
        yield [held.combine_chunks()]


def _spanning(ids: np.ndarray, alike: np.ndarray) -> list[tuple[int, int]]:
    """Links from each row to the least row of its component under a symmetric matrix."""
    n = len(ids)
    label = np.arange(n)
    a, b = np.nonzero(np.triu(alike, 1))
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if (low == label).all():
            break
        label = low
    return [(int(ids[i]), int(ids[label[i]])) for i in range(n) if label[i] != i]


def _links(group: pa.Table, alike) -> list[tuple[int, int]]:
    """Spanning links of a block pair, by a function that compares all its rows."""
    ids, side = group.column("id").to_numpy(), group.column("side").to_numpy()
    if len(ids) < 2:
        return []
    found = alike(group)
    if group.column("i")[0].as_py() != group.column("j")[0].as_py():
        found &= side[:, None] != side[None, :]
    return _spanning(ids, found)


def _blocks_linked(blocks: DataFrame, group: str, alike) -> DataFrame:
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[tuple[int, int]] = set()
        for groups in _groups(batches, [group, "i", "j"]):
            # Buckets repeat one another's links; what a task remembers is bounded, and repeats do no harm.
            links = list({x for g in groups for x in _links(g, alike)} - told)
            told = (told if len(told) < 500_000 else set()) | set(links)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return blocks.mapInArrow(run, "a bigint, b bigint").distinct()


def _estimated(least: float):
    """Pairs whose signatures agree on a share of at least `least`."""

    def alike(group: pa.Table) -> np.ndarray:
        marks = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint8).reshape(group.num_rows, -1)
        need = least * marks.shape[1]
        return np.array([(marks == row).sum(axis=1) >= need for row in marks])

    return alike


def _confirmed(similarity: int):
    """Pairs of full sets with 100 * intersection >= similarity * union."""

    def alike(group: pa.Table) -> np.ndarray:
        sets = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
        sizes = np.array([len(s) for s in sets], np.int64)
        if len(sets) == 2:
            shared = np.full((2, 2), len(np.intersect1d(*sets, assume_unique=True)))
        else:
            shared = _intersections(sets)
        return 100 * shared >= similarity * (sizes[:, None] + sizes[None, :] - shared)

    return alike


def _intersections(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all pairs, by products of membership matrices, `width` shingles at a time."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = count > 1
    number = np.cumsum(often) - 1
    keep = often[place]
    owner, place = owner[keep], number[place[keep]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    out = np.zeros((len(sets), len(sets)), np.int64)
    total = int(often.sum())
    for low in range(0, total, width):
        a, b = np.searchsorted(place, [low, low + width])
        member = np.zeros((len(sets), min(width, total - low)), np.float32)
        member[owner[a:b], place[a:b] - low] = 1
        out += np.rint(member @ member.T).astype(np.int64)
    return out


def shingle_sets(docs: DataFrame, words: int, keep: tuple[str, ...]) -> DataFrame:
    """The full sorted shingle sets as binary, with the columns to keep (bigint)."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            values, bounds = shingles(column(batch, "text"), words)
            sets = [values[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(long_ids(batch, k) for k in keep), pa.array(sets, pa.binary())], names=[*keep, "shingles"])

    return docs.select(*keep, "text").mapInArrow(run, ", ".join(f"{k} bigint" for k in keep) + ", shingles binary")


def near_duplicates(docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    rows = written(signed(docs, words, rows_of_band(similarity)), "neardup-signatures")
    classes = rows.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("id"))
    ids = written(classes, "neardup-classes")
    represented = rows.join(ids.withColumnRenamed("digest", "own"), (F.col("doc_id") == F.col("id")) & (F.col("digest") == F.col("own"))).select("id", "bands", "signature").dropDuplicates(["id", "signature"])
    represented = written(represented, "neardup-represented")

    keys = represented.select("id", F.explode("bands").alias("bucket"))
    # Buckets with the same members are looked at once.
    buckets = keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("low"), F.max("id").alias("high"), F.bit_xor(F.xxhash64("id")).alias("all")).filter("m > 1")
    once = buckets.groupBy("m", "low", "high", "all").agg(F.min("bucket").alias("bucket")).select("bucket")
    members = keys.join(once, "bucket").join(represented.select("id", "signature"), "id").select("bucket", "id", "signature")
    estimate = _estimated(similarity / 100 - MARGIN)
    close = written(_blocks_linked(_in_blocks(members, "bucket", ["signature"], SIGNATURE_BLOCK), "bucket", estimate), "neardup-close")
    families = connected_components(close)

    wanted = families.select(F.col("node").alias("id"), F.col("component").alias("family"))
    # Texts are not moved while the families' members are few enough to be sent to them.
    chosen = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(few(wanted), "id")
    full = shingle_sets(chosen, words, ("id", "family")).dropDuplicates(["id", "shingles"])
    links = written(_blocks_linked(_in_blocks(full, "family", ["shingles"], SET_BLOCK), "family", _confirmed(similarity)), "neardup-links")
    components = connected_components(links)

    class_of = ids.join(components, F.col("id") == F.col("node"), "left").select("digest", F.coalesce("component", "id").alias("component_id"))
    out = rows.join(class_of, "digest", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def one_of_each(docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """docs without the documents that another of their class stands for: the smallest doc_id of each class stays."""
    found = written(near_duplicates(docs, words, similarity).filter("NOT kept").select("doc_id").distinct(), "neardup-dropped")
    left = docs.join(few(found).withColumnRenamed("doc_id", "__dropped"), docs["doc_id"].cast("long") == F.col("__dropped"), "left_anti")
    if docs.groupBy("doc_id").count().filter("count > 1").limit(1).count():
        left = left.dropDuplicates(["doc_id", "text"])
    return left


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, similarity=85)
