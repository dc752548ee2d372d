"""The undominated points of three measures or more: a grid of which dominated cells go whole, then chunks against chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.scratch import written
from quillstone.session import ship

#: Cells of a group's grid at most, and points of a chunk, about: what one comparison holds is the square of it.
CELLS, CHUNK = 1000, 512


def _related(cells: pd.DataFrame, bins: int, m: int) -> pd.DataFrame:
    """(gid, cell, other): of a group's cells, at most CELLS, those that no cell lies wholly below, each with itself and the others of
    them whose points may dominate some of its own."""
    numbers = cells["cell"].to_numpy()
    at = np.stack([numbers // bins**i % bins for i in range(m)], axis=1)
    held = np.zeros((bins,) * m, dtype=bool)
    held[tuple(at.T)] = True
    for axis in range(m):
        held = np.logical_or.accumulate(held, axis=axis)
    inner = (at > 0).all(axis=1)
    gone = np.zeros(len(at), dtype=bool)
    gone[inner] = held[tuple((at[inner] - 1).T)]
    at, numbers = at[~gone], numbers[~gone]
    pairs = [(a, b) for i, a in enumerate(numbers) for b in numbers[(at <= at[i]).all(axis=1)]]
    return pd.DataFrame(pairs, columns=["cell", "other"]).assign(gid=cells["gid"].iloc[0])[["gid", "cell", "other"]]


def beaten(points: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Which rows of ``points`` a row of ``by`` dominates: no worse in every column, better in one; less is better."""
    no_worse = np.ones((len(points), len(by)), dtype=bool)
    better = np.zeros((len(points), len(by)), dtype=bool)
    for i in range(points.shape[1]):
        no_worse &= by[None, :, i] <= points[:, None, i]
        better |= by[None, :, i] < points[:, None, i]
    return (no_worse & better).any(axis=1)


def _points(value: pa.ListScalar, m: int) -> np.ndarray:
    return value.values.flatten().to_numpy(zero_copy_only=False).reshape(-1, m)


def _local(batches: Iterator[pa.RecordBatch], m: int) -> Iterator[pa.RecordBatch]:
    """Chunks without what they dominate themselves, and the corners of the boxes they lie in."""
    for batch in batches:
        kept = [p[~beaten(p, p)] for p in (_points(x, m) for x in batch.column("points"))]
        columns = [batch.column(c) for c in ("gid", "cell", "chunk")]
        columns += [pa.array([p.tolist() for p in kept], pa.list_(pa.list_(pa.float64())))]
        columns += [pa.array([f(axis=0).tolist() for f in fs], pa.list_(pa.float64())) for fs in ([p.min for p in kept], [p.max for p in kept])]
        yield pa.RecordBatch.from_arrays(columns, ["gid", "cell", "chunk", "points", "low", "high"])


def _against(batches: Iterator[pa.RecordBatch], m: int) -> Iterator[pa.RecordBatch]:
    """(gid, cell, chunk, at): the places of a chunk's points that points of another one dominate."""
    for batch in batches:
        at = [np.flatnonzero(beaten(_points(a, m), _points(b, m))).tolist() for a, b in zip(batch.column("points"), batch.column("by"), strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("gid", "cell", "chunk")), pa.array(at, pa.list_(pa.int32()))], ["gid", "cell", "chunk", "at"])


def frontier(points: DataFrame, values: list[str]) -> DataFrame:
    """The rows of a table (gid, values), distinct and without nulls, that no other row of their gid dominates: less is better.

    Each group's measures are cut at quantiles into a grid of at most CELLS cells; cells that lie wholly above another one
    go, and of the others only those that may dominate a cell's points are known by it. A cell's points are dealt to
    chunks, which lose what they dominate themselves, and then meet the chunks of related cells whose boxes begin below
    their own end, one pair a row. No task holds a group, whatever its size and even if nothing in it is dominated; the
    work on that is the square of its chunks, less what grid and boxes rule out."""
    ship(points.sparkSession)
    m = len(values)
    bins = max(2, int(round(CELLS ** (1 / m) - 0.5)))
    quantiles = [i / bins for i in range(1, bins)]
    cuts = points.groupBy("gid").agg(*[F.percentile_approx(v, quantiles, 200).alias(f"q{i}") for i, v in enumerate(values)])
    below = lambda v: lambda q: q < F.col(v)
    places = [F.size(F.filter(f"q{i}", below(v))) * bins**i for i, v in enumerate(values)]
    dealt = written(points.join(cuts, "gid").select("gid", *values, sum(places[1:], places[0]).cast("int").alias("cell")), "points")
    counts = dealt.groupBy("gid", "cell").agg(F.count("*").alias("n"))
    related = counts.select("gid", "cell").groupBy("gid").applyInPandas(lambda cells: _related(cells, bins, m), "gid long, cell int, other int")
    related = written(related, "cells")
    alive = counts.join(related.where("cell = other").select("gid", "cell"), ["gid", "cell"])
    chunk = F.pmod(F.xxhash64(*values), F.ceil(F.col("n") / CHUNK)).cast("int")
    packed = dealt.join(alive, ["gid", "cell"]).groupBy("gid", "cell", chunk.alias("chunk")).agg(F.collect_list(F.array(*values)).alias("points"))
    schema = "gid long, cell int, chunk int, points array<array<double>>"
    local = written(packed.mapInArrow(lambda b: _local(b, m), f"{schema}, low array<double>, high array<double>"), "chunks")
    others = local.select("gid", F.col("cell").alias("other"), F.col("chunk").alias("chunk2"), "low")
    meet = local.select("gid", "cell", "chunk", "high").join(related, ["gid", "cell"]).join(others, ["gid", "other"])
    reaches = F.forall(F.zip_with("low", "high", lambda a, b: a <= b), lambda x: x)
    meet = meet.where(reaches & ~((F.col("cell") == F.col("other")) & (F.col("chunk") == F.col("chunk2")))).select("gid", "cell", "chunk", "other", "chunk2")
    by = local.select("gid", F.col("cell").alias("other"), F.col("chunk").alias("chunk2"), F.col("points").alias("by"))
    pairs = meet.join(local.select("gid", "cell", "chunk", "points"), ["gid", "cell", "chunk"]).join(by, ["gid", "other", "chunk2"])
    lost = pairs.select("gid", "cell", "chunk", "points", "by").mapInArrow(lambda b: _against(b, m), "gid long, cell int, chunk int, at array<int>")
    lost = lost.groupBy("gid", "cell", "chunk").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"))
    left = local.join(lost, ["gid", "cell", "chunk"], "left").select("gid", F.posexplode("points").alias("i", "p"), "at")
    left = left.where(F.col("at").isNull() | ~F.array_contains("at", F.col("i")))
    return left.select("gid", *[F.col("p")[i].alias(v) for i, v in enumerate(values)])
