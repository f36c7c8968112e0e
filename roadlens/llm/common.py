"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlens.sources import shared

#: The bytes that separate words in every contract of this subpackage: [\x20\x09-\x0D].
SPACES = b" \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Chunks of documents for each shuffle partition, at every size: a chunk's arrays stay small in a Python worker.
CHUNKS = 4
#: Rows of an Arrow batch, at most: texts of several KB each must not fill a Python worker.
BATCH_ROWS = 1000

#: Odd 64-bit multiplier of the polynomial fingerprints, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}

materialise, discard = shared.saved, shared.discard


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def chunk_count(spark: SparkSession) -> int:
    return CHUNKS * partitions(spark)


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches of this session hold at most BATCH_ROWS rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def whole_row(docs: DataFrame) -> Column:
    """All columns as one struct, so that no name of theirs can clash with an operator's own."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns])


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
M64 = (1 << 64) - 1


def names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit names of each span of bytes, which together tell spans apart.

    Up to 8 bytes: the bytes themselves, mixed one to one, and 0 (but for spans that end with a NUL). Up to 16 bytes: two mixes of
    all bytes. Beyond that: the halves of the span's XXH3-128.
    """
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    padded = np.zeros(len(data) + 24, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 16, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    size = ends - starts
    lo = eight[starts] & _LOW[np.minimum(size, 8)]
    name, check = mix(lo), np.zeros(len(starts), np.uint64)
    more = np.flatnonzero((size > 8) | (data[ends - 1] == 0))
    n, lo = size[more].astype(np.uint64), lo[more]
    hi = eight[starts[more] + 8] & _LOW[np.clip(size[more] - 8, 0, 8)]
    name[more] = mix(lo ^ mix(hi + n * np.uint64(BASE)))
    check[more] = mix(hi ^ mix(lo + n * np.uint64(BASE_INVERSE))) | np.uint64(1)
    for i in np.flatnonzero(size > 16).tolist():
        both = xxhash.xxh3_128_intdigest(data[starts[i] : ends[i]].tobytes())
        name[i], check[i] = both & M64, both >> 64 | 1
    return name, check


def sorted_groups(name: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal (name, check) next to each other, by name, and where each group of it begins."""
    order = np.argsort(name, kind="stable")
    a, b = name[order], check[order]
    if (b[1:] != b[:-1])[a[1:] == a[:-1]].any():  # different spans with one name
        order = np.lexsort((check, name))
        a, b = name[order], check[order]
    return order, starts_of_runs(a, b)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 21)
        for name, base in (("up", BASE), ("down", BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Prefix sums of (byte + 1) * BASE**position; span_hash() takes any span's fingerprint from them."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts])


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def text_arrays(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an Arrow binary column and each value's start (one more for the end); null counts as empty."""
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null(b"").cast(pa.large_binary())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(starts: np.ndarray, most: int):
    """Ranges of rows with about `most` bytes of text together, at least one row each."""
    first = 0
    while first < len(starts) - 1:
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + most, "right")) - 1)
        yield first, last
        first = last


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ in data; no word crosses an offset."""
    inner = ~((data == 32) | ((data >= 9) & (data <= 13)))
    return runs_of(inner, offsets)


def runs_of(inner: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches where inner holds; none crosses an offset."""
    start, last = inner.copy(), inner.copy()
    start[1:] &= ~inner[:-1]
    last[:-1] &= ~inner[1:]
    begin, end = offsets[:-1][offsets[:-1] < len(inner)], offsets[1:][offsets[1:] > 0] - 1
    start[begin], last[end] = inner[begin], inner[end]
    return np.flatnonzero(start), np.flatnonzero(last) + 1


def lowered(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def starts_of_runs(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the row before it, in sorted columns."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def narrow(x: np.ndarray, n_bytes: int) -> bytes:
    """The low n_bytes of each uint64."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n_bytes]).tobytes()


def widen(blob: bytes, n_bytes: int) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8).reshape(-1, n_bytes)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :n_bytes] = raw
    return out.view("<u8").reshape(-1)
