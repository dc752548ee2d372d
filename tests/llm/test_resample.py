"""Composed CRCs, and resampling against a plain model."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstone.llm import common, resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text, n):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def plain(docs, target, n, buckets, percent, least, seed=2024):
    of = [(d, *plain_features(t, n)) for d, t in docs]
    s, t = Counter(c % buckets for _, _, f in of for c in f), Counter(c % buckets for x in target for c in plain_features(x, n)[1])
    ss, tt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ss + buckets) / ((s[b] + 1) * (tt + buckets)))) for b in range(buckets)]
    rows = []
    for d, words, f in of:
        weight = sum(gain[c % buckets] for c in f)
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = {id(r): i + 1 for i, r in enumerate(able[: len(able) * percent // 100])}
    return sorted(((r[0], r[2], r[3], r[4], ranks.get(id(r))) for r in rows), key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in df.collect()), key=repr)


def test_shift_is_combination():
    rng = random.Random(1)
    for _ in range(200):
        a, b = (bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 3, 50, 1000]))) for _ in "ab")
        moved = resample.shifted(np.array([zlib.crc32(a)], dtype=np.uint32), np.array([len(b)]))[0]
        assert moved ^ zlib.crc32(b) == zlib.crc32(a + b)


@pytest.mark.parametrize("n", [1, 2, 5])
def test_runs_of_words(n):
    rng = random.Random(n)
    texts = [" ".join(rng.choice(["a", "Bé", "x9", "ÄÖ漢字", "w" * 70, "-", "_"]) for _ in range(rng.randrange(0, 40))) for _ in range(50)] + ["", None, "z" * 5000, "A", "...", "ÀB C"]
    words, grams = resample._features(pa.array(texts), n, 1 << 31)
    want = [plain_features(t, n) for t in texts]
    assert words.tolist() == [w for w, _ in want]
    held = [Counter() for _ in texts]
    for bucket, doc in grams:
        for b, d in zip(bucket.tolist(), doc.tolist(), strict=True):
            held[d][b] += 1
    assert held == [Counter(c % (1 << 31) for c in f) for _, f in want]


@pytest.mark.parametrize("n,buckets,percent,least", [(1, 10_000, 10, 20), (2, 97, 50, 1), (3, 1000, 100, 0), (1, 50, 0, 0)])
def test_against_a_plain_model(spark, n, buckets, percent, least):
    rng = random.Random(n)
    vocabulary = [f"wörd{i}" if i % 3 else f"Wa{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choice(vocabulary[: 10 + i % 50]) for _ in range(rng.randrange(0, 60)))) for i in range(150)]
    docs += [(500, None), (501, ""), (None, docs[5][1]), (None, docs[5][1]), (3, docs[3][1]), (700, "x" * 300_000), (-7, docs[9][1])]
    target = [" ".join(rng.choice(vocabulary[:20]) for _ in range(30)) for _ in range(10)] + [None, ""]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"rank": F.lit("clash"), "__row": F.lit(1), "weight": F.lit(2)}).repartition(3)
    out = resample.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), n=n, buckets=buckets, percent=percent, least_words=least)
    assert got(out) == plain(docs, target, n, buckets, percent, least)


def test_empty_tables(spark):
    docs, texts = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([], "text string")
    assert resample.resample(docs.where("false"), texts).count() == 0
    assert got(resample.resample(docs, texts, least_words=1, percent=100)) == plain([(1, "a b c")], [], 1, 10_000, 100, 1)


def test_ranks_of_equal_rows_and_many_ranges(spark, monkeypatch):
    """A third of the rows are one row, over many ranges of the sort."""
    monkeypatch.setattr(common, "RANGE_ROWS", 50)
    docs = [(i, "some words of text here " * (i % 7)) for i in range(400)] + [(7, "one row many times " * 5)] * 200
    target = ["text here"]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = got(resample.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), percent=50, least_words=1))
    assert out == plain(docs, target, 1, 10_000, 50, 1)


def test_query_against_brute_force(spark, sf_dir):
    from quillstone.llm import queries

    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    docs = [(r.doc_id, r.text) for r in read("documents").select("doc_id", "text").collect()]
    target = [r.text for r in read("benchmark").select("text").collect()]
    assert got(queries.op13_resample(spark, sf_dir)) == plain(docs, target, 1, 10_000, 10, 20)


def test_query_equals_sql(spark, sf_dir):
    from oracle import connect, rows_of_query, rows_of_sql

    from quillstone.llm import queries

    assert rows_of_query(queries.op13_resample(spark, sf_dir)) == rows_of_sql(connect(sf_dir), queries.OP13_SQL)
