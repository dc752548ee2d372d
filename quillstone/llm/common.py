"""What the operators of this subpackage share: scratch tables, Arrow limits, word hashing."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.scratch import discard, if_small, scratch_path, written
from quillstone.session import ship

__all__ = [
    "arrow_limits", "discard", "fresh_names", "if_small", "joined_texts", "lowered", "mix64", "outside_of", "own_names", "ranked", "scratch_path", "shingle_hashes", "shuffle_partitions", "tidy", "utf8", "word_hashes", "word_spans", "written",
]

#: Rows and bytes of one Arrow batch sent to Python; bounds a worker's memory whatever the text lengths are.
ARROW_ROWS, ARROW_BYTES = 2048, 8 << 20


def arrow_limits(spark: SparkSession) -> None:
    """Send the package to the workers; bound the Arrow batches of functions planned from now on by rows and by bytes."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def tidy(made: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a task; after the last one its worker, which stays for later tasks, gives its free memory back."""
    yield from made
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps what it has
        pass


def own_names(operator):
    """For operators whose helper columns begin with two underscores: columns of the table that do so, too, have other names inside
    and their own again in the result."""

    @functools.wraps(operator)
    def apart(df: DataFrame, *args, **kwargs) -> DataFrame:
        inside = {c: f"kept {i} {c}" for i, c in enumerate(df.columns) if c.startswith("__")}
        out = operator(df.withColumnsRenamed(inside), *args, **kwargs) if inside else operator(df, *args, **kwargs)
        return out.withColumnsRenamed({v: k for k, v in inside.items()}) if inside else out

    return apart


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of the table has."""
    held, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in held:
            name += "_"
        out.append(name)
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of one range of a sort that numbers rows, about.
RANGE_ROWS = 1 << 20


def ranked(rows: DataFrame, order: list, at: str) -> DataFrame:
    """Adds ``at``: each row's place from 1 in the order of all rows, which is to be a total one. Rows are range-sorted; a range's
    rows are numbered in it, and a row a range tells how many are before. ``rows`` is read twice."""
    parts = max(shuffle_partitions(rows.sparkSession), rows.count() // RANGE_ROWS)
    dealt = written(rows.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("__part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))  # one row a range
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return dealt.withColumn(at, place).join(F.broadcast(base), "__part").withColumn(at, (F.col(at) + F.col("__before")).cast("long")).drop("__part", "__before")


_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers (two xor-shift-multiply rounds)."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


#: A random-looking 64-bit value for each byte at each of the first NEAR places of a word; values of later places are computed.
NEAR = 64


def _place_value(place: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return mix64((place.astype(np.uint64) << np.uint64(8)) + byte + np.uint64(0x9E3779B97F4A7C15))


_VALUES = _place_value(np.arange(NEAR * 256) >> 8, (np.arange(NEAR * 256) & 255).astype(np.uint64))


def word_spans(data: np.ndarray, outside: np.ndarray = _WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, or of the runs of bytes that are not ``outside``."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~outside[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(data: np.ndarray, lower: bool = False, outside: np.ndarray = _WHITE) -> np.ndarray:
    """A 64-bit hash of each word of UTF-8 bytes, in order; equal words have equal hashes. ``outside`` as in ``word_spans``.

    The sum of an unrelated value for each pair of place and byte, and the length: no pattern of bytes makes words collide more
    often than chance, as it would with powers of one base modulo 2**64.
    """
    starts, ends = word_spans(data, outside) if len(data) else (data, data)
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    data = (_LOWER[data] if lower else data)[~outside[data]]
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(data)) - np.repeat(first, lengths)
    values = _VALUES[np.minimum(place, NEAR - 1) << 8 | data]
    if int(lengths.max()) > NEAR:
        far = np.flatnonzero(place >= NEAR)
        values[far] = _place_value(place[far], data[far].astype(np.uint64))
    return mix64(np.add.reduceat(values, first) + lengths.astype(np.uint64) * _M1)


_MULTIPLIERS = (2 * np.arange(1, 17, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) | np.uint64(1)


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of n words, in order (repeats included); with fewer words, of the whole sequence as one."""
    if not len(words):
        return words
    n = min(n, len(words))
    out = np.full(len(words) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        out = mix64(out + words[i : len(words) - n + 1 + i] * _MULTIPLIERS[i % 16])
    return out


def outside_of(*ranges: tuple[int, int]) -> np.ndarray:
    """The bytes in none of the ranges (ends included), as a mask over all 256."""
    mask = np.ones(256, dtype=bool)
    for a, b in ranges:
        mask[a : b + 1] = False
    return mask


def lowered(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A-Z in lower case."""
    return _LOWER[data]


def joined_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, ends) of a batch's texts in one array, a line feed behind each; ends are where the next text begins. Null is empty."""
    raw = [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]
    ends = np.cumsum(np.array([len(t) + 1 for t in raw], dtype=np.int64))
    return np.frombuffer(b"".join(t + b"\n" for t in raw), dtype=np.uint8), ends


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")
