"""The encoder slot, and chunks verified as streams."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.operators import chunks, derive, encoders
from quillstone.operators.encoders import HashedGrams, Identity
from quillstone.sources.store import Store


def broken(row):
    """An encoder of its own; of a local class, so that it goes to the tasks by value."""

    class Broken(encoders.Encoder):
        identity = Identity("broken", "0", 4, "mean", False, 10)

        def encode(self, texts):
            return np.array([row] * len(texts))

    return Broken()


@pytest.mark.parametrize("made,error", [([1.0, 2.0], "shape"), ([1.0, 2.0, float("nan"), 0.0], "finite"), ([1.0, float("inf"), 0.0, 0.0], "finite")])
def test_what_an_encoder_gives_is_checked(spark, made, error):
    with pytest.raises(Exception, match=error):
        encoders.encoded(spark.createDataFrame([("x",)], "text string"), broken(made)).collect()


def test_encoding(spark):
    rows = spark.createDataFrame([(1, "Word word other"), (2, None), (3, "ab"), (4, "x" * 50)], "id long, text string").withColumn("vector", F.lit("clash"))
    got = {r.id: np.array(r.vector) for r in encoders.encoded(rows, HashedGrams(64)).collect()}
    assert abs(np.linalg.norm(got[1]) - 1) < 1e-12 and not got[2].any() and np.count_nonzero(got[3]) == 1
    place = lambda g: int(hashlib.md5(g.encode()).hexdigest()[:8], 16) % 64
    want = np.zeros(64)
    for g, n in [("word", 2), ("other", 1)] + [("Word word other"[i : i + 3].lower(), 0.5) for i in range(13)]:
        want[place(g)] += n
    assert np.allclose(got[1], want / np.linalg.norm(want))
    assert encoders.encoded(rows.where("false"), HashedGrams(64)).count() == 0
    short = encoders.encoded(rows.where("id = 4"), HashedGrams(64, char_limit=5)).first().vector
    assert np.allclose(short, HashedGrams(64).encode(["xxxxx"])[0])


def test_scores_of_texts(spark):
    blocks = spark.createDataFrame([("a", 0, "retry policy limit"), ("b", 1, "colour of the sky"), ("c", 0, None)], "path string, ordinal int, text string")
    asked = spark.createDataFrame([(1, "the limit of a retry"), (2, "sky colour")], "query_id long, text string")
    top = {r.query_id: r.path for r in encoders.score_blocks(asked, blocks, HashedGrams(), 2, keys=["path", "ordinal"]).where("rank = 0").collect()}
    assert top == {1: "a", 2: "b"}


def test_vectors_of_a_store_are_used_by_their_encoder_only(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    files = spark.createDataFrame([(1, "a.py", "python", "TOKEN = 7\n"), (2, "b.md", "markdown", "# T\nbody\n")], "doc_id long, path string, language string, text string")
    store.write(files)
    with pytest.raises(ValueError, match="no vectors"):
        encoders.read_vectors(store, HashedGrams(64))
    assert encoders.write_vectors(store, HashedGrams(64)).count() == store.table("blocks").count()
    assert encoders.write_vectors(store, HashedGrams(64)).count() == store.table("blocks").count()
    for other in (HashedGrams(32), HashedGrams(64, char_limit=9)):
        with pytest.raises(ValueError, match="another encoder"):
            encoders.read_vectors(store, other)
    assert store.vacuum() == 0 and encoders.read_vectors(store, HashedGrams(64)).count() > 0
    store.update(files.where("doc_id = 1"))
    with pytest.raises(ValueError, match="no vectors"):
        encoders.read_vectors(store, HashedGrams(64))


def test_files_are_verified_and_put_together(spark):
    big = "".join(chr(97 + i % 26) for i in range(300_000))
    docs = spark.createDataFrame([("big", big), ("gone", "g" * 700), ("hurt", "h" * 700 + "x"), ("gap", "p" * 600 + "q" * 600), ("long", "l" * 10), ("odd", "o" * 10), ("empty", "")], "path string, text string")
    refs = derive.fixed_chunks(docs, 512, key="path")
    wanted = docs.select("path", F.octet_length("text").alias("size"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    wanted = wanted.withColumn("size", F.col("size") + (F.col("path") == "long").cast("int")).withColumn("sha256", F.when(F.col("path") == "odd", "0").otherwise(F.col("sha256")))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    store = derive.chunk_store(refs).where(F.col("hash") != sha(b"g" * 512)).withColumn("chunk", F.when(F.col("hash") == sha(b"h" * 512), F.lit(b"other")).otherwise(F.col("chunk")))
    refs = refs.where("NOT (path = 'gap' AND ordinal = 1)").unionByName(refs.where("path = 'odd'").withColumn("path", F.lit("stray")))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    got = {r.path: (r.status, r.n_chunks, r.n_missing, r.n_damaged) for r in chunks.verify(refs, store, wanted).collect()}
    assert got == {"big": ("ok", 586, 0, 0), "gone": ("missing", 2, 1, 0), "hurt": ("damaged", 2, 0, 1), "gap": ("gap", 2, 0, 0), "long": ("size", 1, 0, 0), "odd": ("digest", 1, 0, 0), "empty": ("ok", 0, 0, 0), "stray": ("unlisted", 1, 0, 0)}
    rows = sorted((r.path, r.part, r.start, bytes(r.data)) for r in chunks.parts(derive.fixed_chunks(docs, 512, key="path"), part_bytes=10_000).collect())
    assert b"".join(d for p, _, _, d in rows if p == "big").decode() == big and max(len(d) for *_, d in rows) <= 10_512
    assert len([1 for p, *_ in rows if p == "big"]) == 30 and all(big[s:].startswith(d.decode()) for p, _, s, d in rows if p == "big")
