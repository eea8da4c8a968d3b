"""What the operators share: reading columns in chunks, rolling hashes, written stages."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Base of the prefix polynomials; odd, so it has an inverse modulo 2**64.
BASE = 0x9E6C63D0676A9A99
BASE_2 = 0xD1342543DE82EF95


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir, or a temporary one on a single machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tessera-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there and outlives any executor.

    Its shuffle files go when it is written, since nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}.parquet"
    schema = df.schema
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(schema).parquet(path)


#: Rows of two or three numbers that may be broadcast: some 100 MB.
BROADCAST_ROWS = 4_000_000


def few(numbers: DataFrame) -> DataFrame:
    """A written table of numbers, to be broadcast if it has at most `BROADCAST_ROWS` rows; beyond that joins shuffle."""
    return F.broadcast(numbers) if numbers.count() <= BROADCAST_ROWS else numbers


Batches = Iterator[pa.RecordBatch]


def tidied(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """A map over batches after which the worker, which waits for other tasks, gives free memory back."""

    @functools.wraps(run)
    def wrapped(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of each batch that hold about `limit` bytes of a string column, one row at least."""
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        sizes = byte_lengths(batch.column(batch.schema.get_field_index(column)))
        ends = np.cumsum(sizes)
        start = 0
        while start < n:
            floor = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, floor + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def byte_lengths(values: pa.Array) -> np.ndarray:
    """UTF-8 bytes of each string, 0 for null."""
    _, starts, ends = buffers(values)
    return ends - starts


def buffers(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The UTF-8 bytes behind a string array and where each row starts and ends in them; null is empty."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    wide = pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type)
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    starts, ends = at[:-1], at[1:].copy()
    if values.null_count:
        gone = ~np.asarray(values.is_valid())
        ends[gone] = starts[gone]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, starts, ends


def packed(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows end to end, and the n + 1 bounds of the rows in them."""
    raw, starts, ends = buffers(values)
    bounds = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=bounds[1:])
    if len(starts) and bounds[-1] == ends[-1] - starts[0]:
        return raw[starts[0] : ends[-1]], bounds
    pieces = [raw[a:b] for a, b in zip(starts, ends, strict=True)]
    return (np.concatenate(pieces) if pieces else np.zeros(0, np.uint8)), bounds


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Polynomial:
    """Prefix polynomials modulo 2**64: any substring's hash in constant time."""

    def __init__(self, base: int = BASE):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, 2 * len(self.powers))
            for name, factor in (("powers", self.base), ("inverses", self.inverse)):
                steps = np.full(n, factor, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))

    def prefixes(self, symbols: np.ndarray) -> np.ndarray:
        n = len(symbols)
        self._grow(n + 1)
        out = np.zeros(n + 1, np.uint64)
        np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * self.powers[:n], out=out[1:])
        return out

    def spans(self, prefixes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of symbols[starts:ends], the same wherever the substring stands."""
        return (prefixes[ends] - prefixes[starts]) * self.inverses[starts]

    def windows(self, prefixes: np.ndarray, k: int) -> np.ndarray:
        """Hashes of every k symbols in a row."""
        n = len(prefixes) - k
        if n <= 0:
            return np.zeros(0, np.uint64)
        return (prefixes[k:] - prefixes[:-k]) * self.inverses[:n]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of every w neighbours, by doubling."""
    if len(x) < w:
        return x[:0]
    out, reach = x, 1
    while reach < w:
        step = min(reach, w - reach)
        out = np.minimum(out[:-step], out[step:])
        reach += step
    return out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... for each i, lengths[i] numbers, end to end."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    firsts = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - firsts, lengths)


def long_ids(batch: pa.RecordBatch, column: str = "doc_id") -> pa.Array:
    return batch.column(batch.schema.get_field_index(column)).cast(pa.int64())


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
