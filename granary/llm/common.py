"""What the operators of this package share: the shared scratch folder, cut points, and whole texts as NumPy bytes.

Texts are never turned into Python strings where an operator only needs words: an Arrow string column already is one
buffer of UTF-8 bytes and one of offsets, so word borders and word hashes come out of a few vectorised passes.
"""

from __future__ import annotations

import ctypes
import math
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.sources.scratch import forget, materialize, shared_dir  # noqa: F401  (the operators take them from here)

#: Bytes of text that one vectorised pass takes at once; a longer text is a block of its own.
BLOCK_BYTES = 1 << 18
#: Bytes of an Arrow batch at most, unless one row is larger.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of few rows and bytes, as single texts may be long; what the session has set lower stays."""
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}", None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def tidy(run):
    """The function of a mapInArrow, after which the worker's free memory goes back to the system: workers live on and would keep it."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def give_back() -> None:
    """Memory that isn't used goes back to the system."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def regrouped(batches, rows: int, most_bytes: int = 64 << 20):
    """Tables of that many rows (fewer if they have most_bytes bytes, and in the last), whatever batches Spark hands over."""
    held, n, size = [], 0, 0
    for b in batches:
        while b.num_rows:
            own = max(1, b.nbytes // b.num_rows)
            take = min(b.num_rows, rows - n, max(1, (most_bytes - size) // own))
            held.append(b.slice(0, take))
            n, size, b = n + take, size + take * own, b.slice(take)
            if n == rows or size >= most_bytes - own:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n, size = [], 0, 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def join_groups(rows: DataFrame, groups: DataFrame, on: str | list[str], size: str, most: int = 50_000) -> DataFrame:
    """Inner join of many rows with one row for each key, where size is the number of rows of the key.

    Keys with more than 1 / most of all rows, of which there are fewer than most, are broadcast, so no key's rows meet in one
    task; the rest is a shuffled join, and all of it is where there are no such keys.
    """
    total, largest = groups.agg(F.sum(size), F.max(size)).first()
    least = max(1000, (total or 0) // most)
    if (largest or 0) <= least:
        return rows.join(groups, on)
    large = F.col(size) > least
    hot = F.broadcast(groups.where(large))
    return rows.join(hot, on).unionByName(rows.join(hot.select(on), on, "left_anti").join(groups.where(~large), on))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the column as text (null: empty), modulo n."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % n


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES):
    """(first row, data, offsets) of runs of rows with about limit bytes of text; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return
    at = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def byte_set(*spans: tuple[int, int]) -> np.ndarray:
    """True for the bytes within the spans, ends included."""
    out = np.zeros(256, bool)
    for a, b in spans:
        out[a : b + 1] = True
    return out


#: Bytes of words: all but ASCII white space; or ASCII letters and digits and all beyond ASCII.
NOT_SPACE = ~byte_set((0x20, 0x20), (0x09, 0x0D))
ALNUM = byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def borders(data: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of each text; no word crosses from one text to the next."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    own = inside[data]
    first, last = own.copy(), own.copy()
    first[1:] &= ~own[:-1]
    last[:-1] &= ~own[1:]
    full = at[1:] > at[:-1]
    a, b = at[:-1][full], at[1:][full] - 1
    first[a] = own[a]
    last[b] = own[b]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
#: Bytes that one object of Hashes takes; longer data is hashed in slices of words.
SLICE = 2 * BLOCK_BYTES
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
_BYTE_LOWER = _BYTE[LOWER]
_powers: list[np.ndarray] = []


def powers() -> tuple[np.ndarray, np.ndarray]:
    """The base to the powers 0 to SLICE modulo 2 ** 64, and their inverses."""
    if not _powers:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(SLICE + 1, base, np.uint64)
            x[0] = 1
            _powers.append(np.cumprod(x, dtype=np.uint64))
    return _powers[0], _powers[1]


class Hashes:
    """64-bit hashes of any byte ranges of up to SLICE bytes, equal for equal bytes wherever they stand."""

    def __init__(self, data: np.ndarray, lower: bool):
        self.up, self.down = powers()
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * self.up[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])


def slices(starts: np.ndarray, ends: np.ndarray):
    """(first, last) of runs of words, each of SLICE bytes at most; a word longer than that is alone, and last is first + 1."""
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + SLICE, "right")))
        yield lo, hi
        lo = hi


def long_hash(data: np.ndarray, lower: bool) -> int:
    """What Hashes would give for the whole of data, of any length."""
    up, total = powers()[0], 0
    for lo in range(0, len(data), SLICE):
        part = data[lo : lo + SLICE]
        own = int(((_BYTE_LOWER if lower else _BYTE)[part] * up[: len(part)]).sum(dtype=np.uint64))
        total += own * pow(_BASE, lo, 1 << 64)
    return int(mix(np.array([total & (1 << 64) - 1], np.uint64))[0])


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """Hashes of the words of data, of any length, with scratch of a bounded size."""
    out = np.empty(len(starts), np.uint64)
    for lo, hi in slices(starts, ends):
        a, b = int(starts[lo]), int(ends[hi - 1])
        if b - a > SLICE:
            out[lo] = long_hash(data[a:b], lower)
        else:
            out[lo:hi] = Hashes(data[a:b], lower).of(starts[lo:hi] - a, ends[lo:hi] - a)
    return out


def hash_word(word: str | bytes, lower: bool = True) -> int:
    """The hash that Hashes gives to this word."""
    data = np.frombuffer(word.encode() if isinstance(word, str) else word, np.uint8)
    return long_hash(data, lower)


def sums_by(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of values, counts long each; 0 for an empty run."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    end = np.cumsum(counts)
    return total[end] - total[end - counts]


def bounded_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, id_col: str, text_col: str, max_rows: int, max_bytes: int, per_class: bool) -> DataFrame:
    """(id, y, text) of labelled documents, in the order of a hash of the id, within max_rows rows (of each class if per_class) and max_bytes bytes of text (likewise).

    All rows of an id count. An id that doesn't fit into what is left of the bytes is left out and costs nothing; if none fits, the shortest is taken.
    Rows without a label or id take no part; several labels of one id count as the largest, repeated ids as they are.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    known = known.where(learn).select("id", (F.col("y") > 0).cast("int").alias("y"), F.xxhash64(F.col("id").cast("string")).alias("h"))
    groups = [known.where(F.col("y") == y) for y in (0, 1)] if per_class else [known]
    parts = [g.orderBy("h", "id").limit(max_rows) for g in groups]
    picked = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    bytes_of = F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("n")
    sized = sorted((r.h, r.id, r.y, r.n, r.rows) for r in texts.join(F.broadcast(picked), "id").groupBy("h", "id", "y").agg(bytes_of, F.count(F.lit(1)).alias("rows")).collect())
    left, rows_left, keep, least = {0: max_bytes, 1: max_bytes}, {0: max_rows, 1: max_rows}, {}, {}
    for _, key, y, n, rows in sized:
        group = y if per_class else 0
        if n <= left[group] and rows <= rows_left[group]:
            left[group] -= n
            rows_left[group] -= rows
            keep[key] = y
        if n < least.get(group, (math.inf,))[0]:
            least[group] = n, key, y
    for n, key, y in least.values():
        if n > max_bytes:
            keep[key] = y
    rows = spark.createDataFrame([(k, y) for k, y in keep.items()], f"id {docs.schema[id_col].dataType.simpleString()}, y int")
    return texts.join(F.broadcast(rows), "id").select("id", "y", "text")
