"""Importance resampling towards a target distribution: hashed n-gram features whose CRCs are composed, never spelled out."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import arrow_limits, joined_texts, lowered, outside_of, ranked, tidy, word_spans, written

#: Words: digits, small letters and all that is not ASCII.
OUTSIDE = outside_of((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: Bytes of a word up to which words are read side by side.
NEAR = 64
#: CRC-32's polynomial, bits reversed (a fixed value).
POLYNOMIAL = 0xEDB88320


def _byte_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(POLYNOMIAL), c >> 1).astype(np.uint32)
    return c


_STEP = _byte_table()


def _applied(matrix: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A GF(2) matrix, given as 32 columns, times vectors of 32 bits."""
    out = np.zeros(len(values), dtype=np.uint32)
    for bit in range(32):
        out ^= np.where(values >> np.uint32(bit) & np.uint32(1), matrix[bit], np.uint32(0))
    return out


def _shift_tables(powers: int = 40) -> np.ndarray:
    """For each k, what the register does over 1 << k zero bytes: a matrix, as four tables over the bytes of a CRC."""
    unit = np.uint32(1) << np.arange(32, dtype=np.uint32)
    matrix = (_STEP[unit & 255] ^ (unit >> np.uint32(8))).astype(np.uint32)  # one zero byte
    tables = np.empty((powers, 4, 256), dtype=np.uint32)
    for k in range(powers):
        for i in range(4):
            tables[k, i] = _applied(matrix, np.arange(256, dtype=np.uint32) << np.uint32(8 * i))
        matrix = _applied(matrix, matrix)
    return tables


_SHIFTS = _shift_tables()


def shifted(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRCs moved over as many bytes as ``lengths`` says: crc(a + b) == shifted(crc(a), len(b)) ^ crc(b)."""
    crc = crc.copy()
    for k in range(int(lengths.max(initial=0)).bit_length()):
        at = np.flatnonzero(lengths >> k & 1)
        c, t = crc[at], _SHIFTS[k]
        crc[at] = t[0][c & 255] ^ t[1][c >> np.uint32(8) & 255] ^ t[2][c >> np.uint32(16) & 255] ^ t[3][c >> np.uint32(24)]
    return crc


def word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-32 of each word of a byte array, all words a byte at a time; words beyond NEAR bytes one by one."""
    lengths = ends - starts
    order = np.argsort(-np.minimum(lengths, NEAR + 1), kind="stable")
    sizes = lengths[order]
    far = int(np.searchsorted(-sizes, -NEAR, side="left"))
    crc = np.full(len(starts), 0xFFFFFFFF, dtype=np.uint32)
    at = starts[order]
    for i in range(int(min(sizes[0], NEAR)) if len(sizes) else 0):
        n = int(np.searchsorted(-np.minimum(sizes, NEAR + 1), -i, side="left"))
        c = crc[far:n]
        crc[far:n] = _STEP[(c ^ data[at[far:n] + i]) & 255] ^ (c >> np.uint32(8))
    crc ^= np.uint32(0xFFFFFFFF)
    for i in range(far):
        crc[i] = zlib.crc32(data[at[i] : at[i] + sizes[i]])
    out = np.empty_like(crc)
    out[order] = crc
    return out


def gram_crcs(crc: np.ndarray, lengths: np.ndarray, doc: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each k from 1 to n: the CRCs of all runs of k words of a text joined by one space, and the texts they are of.

    A word's CRC is computed once. A run's follows from that of the run without its last word, moved over that word and the
    space before it, so that no run is ever spelled."""
    yield crc, doc
    spaced = shifted(np.full(len(crc), zlib.crc32(b" "), dtype=np.uint32), lengths) ^ crc
    run = crc
    for k in range(2, n + 1):
        if len(run) < 2:
            return
        run = shifted(run[:-1], lengths[k - 1 :] + 1) ^ spaced[k - 1 :]
        inside = doc[: len(run)] == doc[k - 1 :]
        yield run[inside], doc[: len(run)][inside]


def _features(column: pa.Array, n: int, buckets: int) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """The words of each text of a batch, and the buckets and texts of its features."""
    data, stops = joined_texts(column)
    data = lowered(data)
    starts, ends = word_spans(data, OUTSIDE) if len(data) else (np.empty(0, np.int64), np.empty(0, np.int64))
    doc = np.searchsorted(stops, starts, side="right")
    crc = word_crcs(data, starts, ends)
    return np.bincount(doc, minlength=len(column)), ((c % np.uint32(buckets), d) for c, d in gram_crcs(crc, ends - starts, doc, n))


def _histogram(batches: Iterator[pa.RecordBatch], n: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """(bucket, n) of a task's features, once a task."""
    total = np.zeros(buckets, dtype=np.int64)
    for batch in batches:
        for bucket, _ in _features(batch.column(0), n, buckets)[1]:
            total += np.bincount(bucket, minlength=buckets)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "n"])


def _weigh(batches: Iterator[pa.RecordBatch], gains: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
    """Adds __words, n_features and weight."""
    for batch in batches:
        words, grams = _features(batch.column("text"), n, len(gains))
        count, weight = np.zeros(len(batch), dtype=np.int64), np.zeros(len(batch), dtype=np.int64)
        for bucket, doc in grams:
            if len(doc):
                first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
                weight[doc[first]] += np.add.reduceat(gains[bucket], first)
                count += np.bincount(doc, minlength=len(batch))
        columns = [batch.column(c) for c in batch.schema.names if c != "text"]
        names = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, pa.int64()) for x in (words, count, weight))], [*names, "__words", "n_features", "weight"])


def bucket_counts(texts: DataFrame, *, n: int, buckets: int) -> DataFrame:
    """(bucket, n): how many features of a table's texts fall into each bucket, none left out."""
    arrow_limits(texts.sparkSession)
    rows = texts.select("text").mapInArrow(lambda b: tidy(_histogram(b, n, buckets)), "bucket long, n long")
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(documents: DataFrame, target: DataFrame, *, n: int, buckets: int) -> DataFrame:
    """(bucket, gain) of every bucket: 1000 times the logarithm of its smoothed share in the target over that in the documents,
    rounded down. ``buckets`` rows, whatever the tables' sizes."""
    both = documents.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    for name, table in (("s", documents), ("t", target)):
        both = both.join(bucket_counts(table, n=n, buckets=buckets).withColumnRenamed("n", name), "bucket", "left").fillna(0, [name])
    both = written(both, "buckets")
    sums = both.agg(F.sum("s").cast("double").alias("ss"), F.sum("t").cast("double").alias("tt"))
    ratio = (F.col("t") + F.lit(1.0)) * (F.col("ss") + buckets) / ((F.col("s") + F.lit(1.0)) * (F.col("tt") + buckets))
    return both.crossJoin(F.broadcast(sums)).select("bucket", F.floor(1000.0 * F.log(ratio)).alias("gain"))


def resample(documents: DataFrame, target: DataFrame, *, n: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score and rank for each row of a table with doc_id and text.

    Features are all runs of 1 to ``n`` words of the lower-cased text, hashed to buckets by CRC-32. weight is the sum of the
    buckets' gains, score adds Gumbel noise drawn from a hash of seed and doc_id, so that the highest scores are a draw
    without replacement in proportion to the weights' exponentials. Of the rows with at least ``least_words`` words the
    ``percent`` per cent (rounded down) with the highest scores are drawn; rank numbers them, ties by doc_id.

    Scale: counts are combined in each task to ``buckets`` rows before the shuffle; the gains, ``buckets`` numbers, are all that
    reaches the driver and the tasks. Texts are read twice and never shuffled; narrow rows are written once and range-sorted.

    Edge cases: null and empty texts have no features, weight 0, and are never drawn (unless least_words is 0); a null doc_id
    draws its noise as an empty one and comes after others of its score; repeated rows have equal scores and ranks next to
    each other; a text of any length is read whole; no documents, no rows; an empty target makes all gains follow the
    documents' counts alone; other columns are ignored.
    """
    spark = documents.sparkSession
    arrow_limits(spark)
    found = bucket_gains(documents, target, n=n, buckets=buckets).toArrow()  # as many rows as buckets
    gains = np.zeros(buckets, dtype=np.int64)
    gains[found["bucket"].to_numpy()] = found["gain"].to_numpy()
    kind = dict(documents.dtypes)["doc_id"]
    rows = documents.select("doc_id", "text").mapInArrow(lambda b: tidy(_weigh(b, gains, n)), f"doc_id {kind}, __words long, n_features long, weight long")
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000.0 * F.log(-F.log((drawn + 0.5) / F.lit(4294967296.0))))
    # equal rows are told apart by a number that is written, so that ranges can part them and reruns of a task agree
    scored = written(rows.withColumns({"score": (F.col("weight") + noise).cast("long"), "__row": F.monotonically_increasing_id()}), "scored")
    enough = F.col("__words") >= least_words
    quota = scored.agg(F.coalesce(F.floor(F.count(F.when(enough, 1)) * percent / 100), F.lit(0)).alias("quota")).first()["quota"]
    bar = _bar(scored.where(enough).select("score"), int(quota))
    best = ranked(scored.where(enough & (F.col("score") >= bar)), [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("__row")], "rank")
    rest = scored.where(~(enough & (F.col("score") >= bar))).withColumn("rank", F.lit(None).cast("long"))
    out = best.unionByName(rest)
    return out.select("doc_id", "n_features", "weight", "score", F.when(F.col("rank") <= F.lit(quota), F.col("rank")).alias("rank"))


#: Scores are counted in as many bins at once when the one at the quota is searched for.
BINS = 4096


def _bar(scores: DataFrame, quota: int) -> int:
    """The score at place ``quota`` from above: found by histograms of at most BINS rows, each of a bin of the one before. Above
    all scores for a quota of 0."""
    low, high = scores.agg(F.min("score"), F.max("score")).first()
    if quota <= 0 or low is None:
        return (1 << 63) - 1
    before = 0  # scores above ``high``
    while low < high:
        width = -(-(high - low + 1) // BINS)
        bins = scores.where(F.col("score").between(low, high)).groupBy(F.floor((F.col("score") - F.lit(low)) / width).alias("b")).agg(F.count("*").alias("n"))
        for r in sorted(bins.collect(), key=lambda r: -r["b"]):  # BINS rows at most
            if before + r["n"] >= quota:
                low, high = low + r["b"] * width, min(high, low + (r["b"] + 1) * width - 1)
                break
            before += r["n"]
    return low
