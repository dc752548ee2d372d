"""Encoders of texts and the vectors they make: who made a table of vectors is written with it and checked when it is used."""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.operators.vectors import nearest
from quillstone.session import ship


@dataclass(frozen=True)
class Identity:
    """What tells one space of vectors from another."""

    model: str
    revision: str
    dimension: int
    pooling: str
    normalised: bool
    char_limit: int


class Encoder:
    """The slot: an identity, and ``encode``, which gives a row of ``identity.dimension`` numbers for each text. An encoder goes to the tasks by
    value; a model that it needs is to be loaded there, once a worker."""

    identity: Identity

    def encode(self, texts: list[str]) -> np.ndarray:
        raise NotImplementedError


class HashedGrams(Encoder):
    """Words and runs of three characters, hashed to a fixed number of coordinates, at unit length: a baseline without a model. A
    coordinate is the first 32 bits of an MD5 by the dimension, the same in every process; a word counts 1, a run 1/2."""

    def __init__(self, dimension: int = 1024, char_limit: int = 1 << 20):
        self.identity = Identity("hashed-grams", "1", dimension, "sum", True, char_limit)
        self._places: dict[str, int] = {}

    def _place(self, gram: str) -> int:
        if len(self._places) > 1 << 18:
            self._places.clear()
        if gram not in self._places:
            self._places[gram] = int(hashlib.md5(gram.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16) % self.identity.dimension
        return self._places[gram]

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.identity.dimension))
        for row, text in zip(out, texts, strict=True):
            for word, n in Counter(re.findall(r"\w+", text.lower())).items():
                row[self._place(word)] += n
            for gram, n in Counter(text[i : i + 3].lower() for i in range(len(text) - 2)).items():
                row[self._place(gram)] += n / 2
        length = np.sqrt((out**2).sum(axis=1))[:, None]
        return out / np.where(length > 0, length, 1)


def checked(vectors: np.ndarray, n: int, identity: Identity) -> np.ndarray:
    """Vectors as an encoder is to make them; an error for another number or dimension of them, or elements that are not finite."""
    if vectors.shape != (n, identity.dimension):
        raise ValueError(f"{identity.model} gave vectors of shape {vectors.shape}, not {(n, identity.dimension)}")
    if not np.isfinite(vectors).all():
        raise ValueError(f"{identity.model} gave elements that are not finite")
    return vectors


def encoded(rows: DataFrame, encoder: Encoder, *, text: str = "text", out: str = "vector") -> DataFrame:
    """``rows`` with ``out``: the vector of each text's first ``char_limit`` characters, as the encoder's identity says; null is empty."""
    ship(rows.sparkSession)
    limit, dimension = encoder.identity.char_limit, encoder.identity.dimension

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "")[:limit] for t in batch.column(text).to_pylist()]
            vectors = checked(encoder.encode(texts), len(texts), encoder.identity) if texts else np.empty((0, dimension))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * dimension, pa.int32()), pa.array(vectors.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, out])

    rows = rows.drop(out)
    return rows.mapInArrow(add, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), f"`{out}` array<double>"]))


def score_blocks(queries: DataFrame, blocks: DataFrame, encoder: Encoder, k: int, *, keys: list[str], floor: float | None = None) -> DataFrame:
    """(query_id, keys, score, rank) of the ``k`` blocks (keys, text) nearest to each query (query_id, text)."""
    asked = encoded(queries.select("query_id", "text"), encoder, out="query").drop("text")
    rows = encoded(blocks.select(*keys, "text"), encoder, out="embedding").select(F.struct(*keys).alias("block"), "embedding")
    return nearest(asked, rows, k, floor=floor, id_col="block").select("query_id", "block.*", "score", "rank")


def _folder(store, identity: Identity | None = None) -> str:
    """Where a store's present state has its vectors, of one encoder where it is given."""
    mark = hashlib.sha256(json.dumps(asdict(identity), sort_keys=True).encode()).hexdigest()[:16] if identity else ""
    return f"{store.root}/vectors-{store.manifest()['root_sha256'][:32]}-{mark}"


def write_vectors(store, encoder: Encoder) -> DataFrame:
    """Encode the blocks of a store's present state; the table carries the encoder's identity. Written once: a second call reads."""
    path = _folder(store, encoder.identity)
    at, fs = store._fs(f"{path}/_SUCCESS")
    if not fs.exists(at):
        rows = encoded(store.table("blocks").select("path", "ordinal", "text"), encoder, out="embedding").drop("text")
        rows.withColumn("identity", F.lit(json.dumps(asdict(encoder.identity), sort_keys=True))).write.mode("overwrite").parquet(path)
    return read_vectors(store, encoder)


def read_vectors(store, encoder: Encoder) -> DataFrame:
    """(path, ordinal, embedding) of a store's present state; an error if it has none, or another encoder's only."""
    spark, path = store.spark, _folder(store, encoder.identity)
    root, fs = store._fs(store.root)
    prefix = _folder(store).rpartition("/")[2]
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    if path.rpartition("/")[2] not in names:
        others = [n for n in names if n.startswith(prefix)]
        raise ValueError(f"the store's vectors are another encoder's than {encoder.identity}" if others else "the store's present state has no vectors")
    rows = spark.read.parquet(path)
    wanted = F.lit(json.dumps(asdict(encoder.identity), sort_keys=True))
    same = F.when(F.col("identity") == wanted, F.col("embedding")).otherwise(F.raise_error(F.lit("vectors of another encoder")).cast("array<double>"))
    return rows.select("path", "ordinal", same.alias("embedding"))
