"""Files as chunks in a store by hash: put together again and verified as streams."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.scratch import written
from quillstone.session import ship

#: Bytes of one part of a file that is put together.
PART_BYTES = 8 << 20


def _fold(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """(key, n_chunks, n_missing, n_damaged, n_gaps, size, sha256) of files whose chunks come one after another: a running digest, so
    that no file is ever held."""
    now, state = None, None

    def done() -> tuple:
        key, digest, *counts = state
        return (key, *counts[:-1], digest.hexdigest())

    for batch in batches:
        rows = []
        for key, ordinal, chunk, intact in zip(*(batch.column(c).to_pylist() for c in ("key", "ordinal", "chunk", "intact")), strict=True):
            if state is None or key != now:
                if state is not None:
                    rows.append(done())
                now, state = key, [key, hashlib.sha256(), 0, 0, 0, 0, 0, 0]  # chunks, missing, damaged, gaps, bytes, the next ordinal
            state[2] += 1
            state[3] += chunk is None
            state[4] += chunk is not None and not intact
            state[5] += ordinal != state[7]
            state[7] = ordinal + 1
            if chunk is not None:
                state[1].update(chunk)
                state[6] += len(chunk)
        if rows:
            yield _batch(rows, kind)
    if state is not None:
        yield _batch([done()], kind)


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    names = ["key", "n_chunks", "n_missing", "n_damaged", "n_gaps", "size", "sha256"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (kind, *[pa.int64()] * 5, pa.string()), strict=True)], names)


def verify(refs: DataFrame, store: DataFrame, files: DataFrame, *, key: str = "path") -> DataFrame:
    """(key, status, n_chunks, n_missing, n_damaged) of files (key, size, sha256) whose chunks (key, ordinal, hash) are in a store (hash,
    chunk).

    status: ``missing`` (a chunk that the store does not have), ``damaged`` (one that is not what its hash says), ``gap`` (ordinals that
    do not count from 0), ``size`` or ``digest`` (the whole is another one), ``unlisted`` (chunks of no file), else ``ok``; the first that
    holds. A chunk's own hash is checked where it lies; a file's digest is one running sum over its chunks in order, from a
    sorted stream, whatever its size: it has to be taken one after another, but nothing of a file is held."""
    from pyspark.sql.pandas.types import to_arrow_type

    ship(refs.sparkSession)
    kept = store.select("hash", "chunk", (F.sha2("chunk", 256) == F.col("hash")).alias("intact"))
    rows = refs.select(F.col(key).alias("key"), "ordinal", "hash").join(kept, "hash", "left").select("key", "ordinal", "chunk", "intact")
    kind = rows.schema["key"].dataType
    schema, arrow = f"key {kind.simpleString()}, n_chunks long, n_missing long, n_damaged long, n_gaps long, size long, sha256 string", to_arrow_type(kind)
    found = rows.repartition("key").sortWithinPartitions("key", "ordinal").mapInArrow(lambda b: _fold(b, arrow), schema)
    told = files.select(F.col(key).alias("key"), F.col("size").cast("long").alias("want_size"), F.col("sha256").alias("want"))
    both = told.withColumn("listed", F.lit(True)).join(found, "key", "full")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_chunks", "n_missing", "n_damaged", "n_gaps", "size")}
    both = both.withColumns(zero).withColumn("sha256", F.coalesce("sha256", empty))
    status = (
        F.when(F.col("listed").isNull(), "unlisted").when(F.col("n_missing") > 0, "missing").when(F.col("n_damaged") > 0, "damaged").when(F.col("n_gaps") > 0, "gap")
        .when(F.col("size") != F.col("want_size"), "size").when(F.col("sha256") != F.col("want"), "digest").otherwise("ok")
    )
    return both.select(F.col("key").alias(key), status.alias("status"), "n_chunks", "n_missing", "n_damaged")


def parts(chunks: DataFrame, *, key: str = "path", part_bytes: int = PART_BYTES) -> DataFrame:
    """(key, part, start, data) of files put together from (key, ordinal, chunk): runs of whole chunks of ``part_bytes`` or so. Where each chunk
    begins is summed on sizes alone, so a file of any size is dealt to many tasks, and none holds more than a part."""
    sized = written(chunks.select(key, "ordinal", F.octet_length("chunk").cast("long").alias("n")), "sizes")
    order = Window.partitionBy(key).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("start", F.coalesce(F.sum("n").over(order), F.lit(0)))
    placed = placed.select(key, "ordinal", "start", F.floor(F.col("start") / part_bytes).alias("part"))
    rows = chunks.select(key, "ordinal", "chunk").join(placed, [key, "ordinal"])
    listed = rows.groupBy(key, "part").agg(F.min("start").alias("start"), F.array_sort(F.collect_list(F.struct("ordinal", "chunk"))).alias("c"))
    data = F.aggregate("c", F.lit(b""), lambda a, c: F.concat(a, c["chunk"]))
    return listed.select(key, "part", "start", data.alias("data"))
