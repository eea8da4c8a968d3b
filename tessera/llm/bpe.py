"""Byte-level BPE: ranked merges over the bytes of distinct words; decoding by concatenation.

`encode_texts`, which the query uses, splits whole documents in Arrow batches and merges the
words that are new in a batch at once, in arrays of words of one length; the README says why,
with figures. `encode_words` is the fold as a Spark expression: higher-order functions over
byte arrays and a literal rank map, for a table of distinct words. Decoding joins the bytes of
the ids.

Rows: a null or empty text has no ids (0 tokens, hashes of nothing); a null doc_id stays null.
Words of any length merge in n log n steps. Repeated rows stay; extra columns are ignored;
empty tables give empty results.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import chunks, column, long_ids, table, tidied

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Words a task remembers, and the most letters of such a word: some 20 MB; beyond that only the words met first stay, which are mostly the frequent ones. This changes no result.
REMEMBERED, FIRST_REMEMBERED, LONGEST_REMEMBERED = 100_000, 30_000, 64
#: Words of texts that are looked up at once.
SEGMENT = 1 << 18
#: Words of one length that are merged at once, and the bytes of the longest of them.
TOGETHER, LONGEST_TOGETHER = 1 << 14, 48
#: The rank of a pair that does not merge; ranks in arrays lie below, with six bits left for a place.
NEVER = 1 << 24


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 piece and its rank in each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, filter(bytes.strip, file))}


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: always merge the adjacent pair of lowest rank, the leftmost of equals."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > LONGEST_TOGETHER:
        return _merged_long(word, ranks)
    pieces = [word[i : i + 1] for i in range(len(word))]
    scores = [ranks.get(word[i : i + 2]) for i in range(len(word) - 1)]
    while True:
        best = min((x for x in scores if x is not None), default=None)
        if best is None:
            return [ranks[p] for p in pieces]
        at = scores.index(best)
        pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]
        del scores[at]
        if at < len(scores):
            scores[at] = ranks.get(pieces[at] + pieces[at + 1])
        if at:
            scores[at - 1] = ranks.get(pieces[at - 1] + pieces[at])


def _merged_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap over linked pieces."""
    n = len(word)
    ends, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    live = bytearray(b"\1") * n

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (rank := ranks.get(word[i : ends[j]])) is not None:
            heapq.heappush(heap, (rank, i, ends[j]))

    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i] if live[i] else n
        if j >= n or ends[j] != end:
            continue
        live[j], ends[i], after[i] = 0, end, after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [ranks[word[i : ends[i]]] for i in range(n) if live[i]]


class Merger:
    """The merges of `merged` for many words at once; the ranks hold every single byte, and all are below `NEVER`."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.size = ranks, max(ranks.values()) + 1
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.byte_pairs = np.array([ranks.get(bytes([i, j]), NEVER) for i in range(256) for j in range(256)], np.int32)
        pairs = {}
        for piece, rank in ranks.items():
            for i in range(1, len(piece)):
                left, right = ranks.get(piece[:i]), ranks.get(piece[i:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = rank
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        # The last key is above all that are looked up.
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.joined = np.append(np.fromiter(pairs.values(), np.int32, len(pairs))[order], np.int32(NEVER))

    @staticmethod
    def fits(ranks: dict[bytes, int]) -> bool:
        return all(bytes([i]) in ranks for i in range(256)) and max(ranks.values()) < NEVER

    def joins(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, NEVER if it does not merge."""
        wanted = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.keys, wanted)
        return np.where(self.keys[at] == wanted, self.joined[at], np.int32(NEVER))

    def merge(self, words: Iterable[bytes]) -> dict[bytes, bytes]:
        """Ids of each distinct word as little-endian unsigned 32-bit integers."""
        done: dict[bytes, bytes] = {}
        by_length: dict[int, list[bytes]] = {}
        for word in words:
            n = len(word)
            if n > LONGEST_TOGETHER or n < 2 or word in self.ranks:
                done[word] = np.array(merged(word, self.ranks), "<u4").tobytes()
            else:
                by_length.setdefault(n, []).append(word)
        for n, same in by_length.items():
            for start in range(0, len(same), TOGETHER):
                self._merge_same(same[start : start + TOGETHER], n, done)
        return done

    def _merge_same(self, words: list[bytes], n: int, done: dict[bytes, bytes]) -> None:
        """Words of n bytes. A column is a word, a row a place; each step merges one pair of every word that is not done."""
        raw = np.frombuffer(b"".join(words), np.uint8).reshape(-1, n).T.astype(np.int32)
        ids, ranks, which = self.bytes[raw], self.byte_pairs[raw[:-1] * 256 + raw[1:]], np.arange(len(words))
        places = np.arange(n, dtype=np.int32)[:, None]
        for width in range(n, 0, -1):
            # A rank before a place: the least is the lowest rank, the leftmost of equals.
            best = (ranks * 64 + places[: width - 1]).min(axis=0) if width > 1 else np.full(len(which), NEVER * 64, np.int32)
            over = best >= NEVER * 64
            if over.any():
                out, step = ids[:, over].T.astype("<u4").tobytes(), 4 * width
                for i, w in enumerate(which[over].tolist()):
                    done[words[w]] = out[i * step : (i + 1) * step]
                more = ~over
                ids, ranks, which, best = ids[:, more], ranks[:, more], which[more], best[more]
                if not len(which):
                    return
            at, new, every = best & 63, best >> 6, np.arange(len(which))
            ids = np.where(places[: width - 1] <= at, ids[:-1], ids[1:])
            ids[at, every] = new
            ranks = np.where(places[: width - 2] < at, ranks[:-1], ranks[1:])
            some = np.flatnonzero(at)
            ranks[at[some] - 1, some] = self.joins(ids[at[some] - 1, some], new[some])
            some = np.flatnonzero(at < width - 2)
            ranks[at[some], some] = self.joins(new[some], ids[at[some] + 1, some])


class Encoder:
    """Splits texts by a pattern and merges each distinct word once."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.find, self.known = ranks, regex.compile(pattern).findall, {}
        self.merger = Merger(ranks) if Merger.fits(ranks) else None
        self.pieces = [b""] * (max(ranks.values(), default=-1) + 1)
        for piece, rank in ranks.items():
            self.pieces[rank] = piece

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The same for each text; words that none has had before are merged together, those of very long texts by segments."""
        found = list(map(self.find, texts))
        if sum(map(len, found)) <= SEGMENT:
            return self._ids(found)
        return [b"".join(self._ids([words[i : i + SEGMENT]])[0] for i in range(0, len(words), SEGMENT)) for words in found]

    def _ids(self, found: list[list[str]]) -> list[bytes]:
        words, known = set(chain.from_iterable(found)), self.known
        new = words.difference(known)
        if new:
            if len(known) > REMEMBERED:
                first = list(islice(known.items(), FIRST_REMEMBERED))
                known.clear()
                known.update(first)
                new = words.difference(known)
            known.update(self._merge(new))
        ids = [b"".join([known[w] for w in own]) for own in found]
        for w in new:
            if len(w) > LONGEST_REMEMBERED:
                del known[w]
        return ids

    def _merge(self, words: set[str]) -> Iterator[tuple[str, bytes]]:
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        if self.merger is None:
            ids = {w: np.array(merged(w, self.ranks), "<u4").tobytes() for w in raw}
        else:
            ids = self.merger.merge(raw)
        return zip(words, map(ids.__getitem__, raw), strict=True)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One per worker process; the vocabulary is installed on every machine."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(read_ranks(path), pattern)
    return _encoders[path, pattern]


def _defaults(path: str | None, pattern: str | None) -> tuple[str, str]:
    if path is None or pattern is None:
        import public_tokenizers

        path, pattern = path or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN
    return path, pattern


def encode_texts(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit) and decoded (binary, from the ids)."""
    path, pattern = _defaults(path, pattern)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        own.known.clear()
        for batch in chunks(batches, "text"):
            ids = own.encode_all([t or "" for t in column(batch, "text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [long_ids(batch), pa.array(ids, pa.binary()), pa.array([own.decode(x) for x in ids], pa.binary())], names=["doc_id", "ids", "decoded"]
            )
        own.known.clear()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, ids binary, decoded binary")


def digests(encoded: DataFrame, keep_ids: bool = False) -> DataFrame:
    return encoded.select("doc_id", *(["ids"] if keep_ids else []), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def rank_map(ranks: dict[bytes, int], buckets: int = 1 << 16) -> Column:
    """The ranks as one literal: an array of small maps by the CRC of the piece in hex, so that a lookup reads one map."""
    held: list[dict[str, int]] = [{} for _ in range(buckets)]
    for piece, rank in ranks.items():
        held[zlib.crc32(piece.hex().upper().encode()) % buckets][piece.hex().upper()] = rank
    return F.from_json(F.lit(json.dumps(held)), "array<map<string,int>>")


def encode_words(words: DataFrame, ranks: dict[bytes, int], column: str = "word", buckets: int = 1 << 16) -> DataFrame:
    """Adds `ids` to a table of distinct words: a fold of ranked merges in higher-order functions.

    The state is the array of pieces, in hex; each step merges the pair of lowest rank,
    and the fold has a step for each byte but the first.
    """
    table = rank_map(ranks, buckets)

    def rank(piece: Column) -> Column:
        return F.get(table, (F.crc32(piece.cast("binary")) % buckets).cast("int"))[piece]

    def step(pieces: Column, _: Column) -> Column:
        pairs = F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p, i: rank(F.concat(p, F.get(pieces, i + 1))))
        # get() of a struct keeps the pairs' ranks evaluated once per step.
        found = F.array(F.struct(pairs.alias("pairs"), pieces.alias("pieces")))
        joined = F.transform(
            found,
            lambda x: F.when(F.array_min(x["pairs"]).isNull(), x["pieces"]).otherwise(
                F.transform(
                    F.array(F.array_position(x["pairs"], F.array_min(x["pairs"])).cast("int")),
                    lambda at: F.concat(
                        F.slice(x["pieces"], 1, at - 1),
                        F.array(F.concat(F.get(x["pieces"], at - 1), F.get(x["pieces"], at))),
                        F.slice(x["pieces"], at + 2, F.greatest(F.size(x["pieces"]), F.lit(1))),
                    ),
                )[0]
            ),
        )
        return joined[0]

    text = F.hex(F.col(column).cast("binary"))
    size = F.octet_length(column)
    first = F.transform(F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(text, 2 * i - 1, F.lit(2)))
    steps = F.when(size > 1, F.sequence(F.lit(2), size)).otherwise(F.array().cast("array<int>"))
    folded = F.aggregate(steps, first, step)
    return words.withColumn("ids", F.transform(folded, rank))


def decode_ids(encoded: DataFrame, ranks: dict[bytes, int], column: str = "ids") -> DataFrame:
    """Adds `decoded`, the bytes of an array of ids, by concatenating binary pieces of a literal array."""
    pieces = [""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.hex()
    table = F.from_json(F.lit(json.dumps(pieces)), "array<string>")
    return encoded.withColumn("decoded", F.unhex(F.array_join(F.transform(F.col(column), lambda i: F.get(table, i)), "")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_texts(table(spark, sf_dir, "documents")))
