"""Shared helpers: shared-folder staging, Arrow batch slicing and vectorised text hashing."""

from __future__ import annotations

import contextlib
import ctypes
import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

#: White space of the word definition ``[^\x20\x09-\x0D]+``.
WHITE = bytes([0x20, 9, 10, 11, 12, 13])
U64 = np.uint64
#: Fixed odd base of the polynomial hash modulo 2**64, and its inverse.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Text bytes handled at once in a Python worker; a longer single text is handled alone.
SLICE_BYTES = 1 << 20


def ship(module: str) -> None:
    """Pickle a module's functions by value, so executors need no installed copy of it."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


# ---------------------------------------------------------------------------------- staging


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset and there is one machine, as in tests, an own one."""
    jsc = spark.sparkContext._jsc
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and jsc.sc().getCheckpointDir().isDefined():
        found = jsc.sc().getCheckpointDir().get()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='staged')}"
        spark.sparkContext.setCheckpointDir(found)
        found = jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


def staged(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here.

    The files survive lost executors; the file system drops them when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def unstaged(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        target = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
        target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that clash with no column of df (compared without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


# ------------------------------------------------------------------- fixed-size bitmap filter

#: log2 of the bits of a row filter: 2**26 bits are 8 MB, whatever the input's size.
FILTER_BITS = 26


def bitmap_of(keys: DataFrame, column: str) -> DataFrame:
    """A Bloom filter with one hash over a bigint column, in rows of 32768 bits.

    At most 2**(FILTER_BITS - 15) rows of 4 KB: a proven bound, so it may be broadcast.
    It has no false negatives; callers follow it with an exact test.
    """
    bit = F.pmod(F.xxhash64(F.col(column)), F.lit(1 << FILTER_BITS)) + 1
    return keys.select(bit.alias("_bit")).groupBy(F.bitmap_bucket_number("_bit").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_bit")).alias("_map"))


def with_hit(df: DataFrame, bitmap: DataFrame, column: str, flag: str) -> DataFrame:
    """df with a boolean column: the key may be in the bitmap."""
    b, m, bit = fresh(df, "_fb", "_fm", "_fbit")
    probe = df.withColumn(bit, F.pmod(F.xxhash64(F.col(column)), F.lit(1 << FILTER_BITS)) + 1)
    probe = probe.withColumn(b, F.bitmap_bucket_number(bit))
    joined = probe.join(F.broadcast(bitmap.select(F.col("_bucket").alias(b), F.col("_map").alias(m))), b, "left")
    place = F.bitmap_bit_position(F.col(bit))
    byte = F.conv(F.hex(F.substring(F.col(m), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce((F.floor(byte / F.pow(F.lit(2), place % 8)) % 2) == 1, F.lit(False))
    return joined.withColumn(flag, hit).drop(b, m, bit)


def bitmap_bytes(bits: DataFrame) -> bytes:
    """The bitmap of a bigint column `bit` (1 to 2**FILTER_BITS) on the driver: 8 MB, whatever the input."""
    rows = bits.groupBy(F.bitmap_bucket_number("bit").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("m")).collect()
    out = bytearray(1 << FILTER_BITS - 3)
    for r in rows:
        out[(r["b"] - 1) * 4096 : r["b"] * 4096] = r["m"]
    return bytes(out)


def in_bitmap(bitmap: bytes, bits: np.ndarray) -> np.ndarray:
    """Whether each bit (from 0) of bitmap_bytes() is set."""
    bits = bits.astype(np.int64)
    return (np.frombuffer(bitmap, np.uint8)[bits >> 3] >> (bits & 7).astype(np.uint8) & 1).astype(bool)


# ------------------------------------------------------------------------- Arrow text batches


def text_column(array) -> pa.Array:
    """A column as one LargeString array without nulls (null: empty)."""
    array = array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array
    if not pa.types.is_large_string(array.type):
        array = array.cast(pa.large_string())
    return array.fill_null("") if array.null_count else array


def buffers(array: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a text array without nulls, without copying the bytes."""
    n = len(array)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(array.buffers()[1], np.int64, n + 1, array.offset * 8)
    data = array.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Cut a batch into runs of rows with about `most` bytes of text."""
    column = text_column(batch.column(batch.schema.get_field_index(text)))
    _, offsets = buffers(column)
    start = 0
    while start < len(column):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield batch.slice(start, end - start), column.slice(start, end - start)
        start = end


def release() -> None:
    """Give freed memory back to the system: a worker is kept between tasks, and what it once held would count on."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(work):
    """A function for mapInArrow or applyInArrow that releases its memory at the end."""

    def run(data):
        out = work(data)
        if isinstance(out, pa.Table):
            release()
            return out
        return _drained(out)

    return run


def _drained(batches):
    yield from batches
    release()


# ------------------------------------------------------------------------------ text hashing

def worker_cache() -> dict:
    """What a process keeps between tasks; in sys, as a shipped module's globals travel with its functions."""
    return sys.__dict__.setdefault("_llm_cache", {})


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    tables = worker_cache().get("powers")
    if tables is None or len(tables[0]) < n:
        size = max(n, SLICE_BYTES + (1 << 18))
        up, down = np.full(size, BASE, U64), np.full(size, INVERSE, U64)
        up[0] = down[0] = 1
        tables = worker_cache()["powers"] = np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)
    return tables[0][:n], tables[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: spreads every bit."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def running(data: np.ndarray) -> np.ndarray:
    """Prefix sums of (byte + 1) * BASE**position modulo 2**64, with a leading 0."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[:-1], out=out[1:])
    return out


def spans_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes [start, end) wherever they stand."""
    _, down = powers(len(sums))
    return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def eights(data: np.ndarray, n: int) -> np.ndarray:
    """The 8 bytes from each of the first n positions as a number that sorts like them; data must go on for 7 bytes."""
    out = np.empty(n, U64)
    for o in range(min(8, n)):
        out[o::8] = np.frombuffer(data, ">u8", (n - o + 7) // 8, o)
    return out


def words_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes [start, end) of each word: the sum of its mixed blocks of 8 bytes with their places."""
    size = end - start
    blocks = (size + 7) >> 3
    owner = np.repeat(np.arange(len(start)), blocks)
    begin = np.cumsum(blocks) - blocks
    nth = np.arange(len(owner)) - begin[owner]
    value = eights(np.concatenate([data, np.zeros(8, np.uint8)]), len(data))[start[owner] + 8 * nth] if len(owner) else np.zeros(0, U64)
    spare = np.maximum(8 - (size[owner] - 8 * nth), 0).astype(U64) << U64(3)
    value = (value >> spare) << spare  # bytes behind the word
    value = mixed(mixed(value) + (nth + 1).astype(U64) * U64(0xD6E8FEB86659FD93))
    return mixed(np.add.reduceat(value, begin) + size.astype(U64)) if len(owner) else value


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and the index of each word's text."""
    white = np.zeros(256, bool)
    white[list(WHITE)] = True
    solid = ~white[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True  # the first byte of each text, and the end
    before = np.zeros(len(data), bool)
    before[1:] = solid[:-1]
    start = np.flatnonzero(solid & (~before | first[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = solid[1:]
    end = np.flatnonzero(solid & (~after | first[1:])) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z lowered, all other bytes kept."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


ship(__name__)
