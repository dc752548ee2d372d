"""The Jaccard join against all pairs, and the pipeline's stages."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillstone.llm import components, jaccard


def brute(rows, words, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[j : j + words]) for j in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = [i for i in sets if sets[i]]
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def families(seed, n=40):
    rng = random.Random(seed)
    rows = []
    for fam in range(n):
        size = rng.choice([1, 2, 3, 5, 8, 12, 20, 33, 64, 120, 300])
        base = [f"w{rng.randint(0, 50 if fam % 3 else 5000)}" for _ in range(size)]
        for _ in range(rng.choice([1, 2, 6, 30])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, size // 40, size // 20, size // 10])):
                p = rng.randrange(len(w) + 1)
                if rng.random() < 0.5 or len(w) < 2:
                    w.insert(p, f"x{rng.randint(0, 9)}")
                else:
                    w.pop(min(p, len(w) - 1))
            rows.append((len(rows), " ".join(w)))
    k = len(rows)
    rows += [(k, None), (k + 1, ""), (k + 2, "  \n"), (k + 3, "A b"), (k + 4, "a B")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("words,percent,seed", [(3, 90, 1), (5, 80, 2)])
@pytest.mark.parametrize("limits", [{}, {"CHUNK_DOCS": 16, "SMALL": 2, "HOT": 3}, {"CHUNK_DOCS": 16, "DIRECT": 1, "SMALL": 2, "HOT": 3}])
def test_all_links_count(spark, monkeypatch, words, percent, seed, limits):
    for k, v in limits.items():
        monkeypatch.setattr(jaccard, k, v)
    rows = families(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("label", F.lit("clash")).repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df, words=words, percent=percent).collect()}
    assert got == brute(rows, words, percent)


def test_signatures_meet():
    """Sets at the least similarity that links share a signature, at many sizes."""
    import numpy as np

    rng = np.random.default_rng(1)
    for percent in (80, 90):
        for n in (1, 2, 5, 9, 10, 16, 17, 40, 129, 256, 1000, 4097):
            for _ in range(20):
                common = rng.integers(0, 2**63, n, dtype=np.uint64)
                extra = n * (100 - percent) // percent
                k = int(rng.integers(0, extra + 1))
                new = rng.integers(0, 2**63, extra, dtype=np.uint64)
                a, b = np.unique(np.concatenate([common, new[:k]])), np.unique(np.concatenate([common, new[k:]]))
                assert np.intersect1d(jaccard.signatures(a, percent), jaccard.signatures(b, percent)).size, (percent, n)
                ca, cb = (jaccard._nibbles(jaccard.sketch(x)[None]) for x in (a, b))
                assert jaccard.possible(ca, np.array([len(a)]), cb, np.array([len(b)]), percent).all()


def test_repeats_nulls_and_nothing(spark):
    rows = [(2, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, "other words stand here now"), (1, "A B C D E F"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(2, 2, 1), (2, 2, 1), (None, 2, 1), (None, 1, None), (1, 2, 1), (3, 0, 3)], key=repr)
    assert sorted(str(r.doc_id) for r in jaccard.keep_first(df.withColumn("x", F.lit(1))).collect()) == ["1", "3", "None", "None"]
    assert jaccard.near_duplicates(df.where("false")).count() == 0


def test_very_long_texts(spark):
    """Texts of 40,000 words: near copies link, and those at the limit follow the exact share."""
    rng = random.Random(6)
    base = [f"w{rng.randint(0, 10**9)}" for _ in range(40_000)]

    def changed(n):
        words = list(base)
        for at in rng.sample(range(0, 40_000, 10), n):
            words[at] = f"x{at}"
        return " ".join(words)

    rows = [(1, " ".join(base)), (2, changed(400)), (3, changed(3000)), (4, "a " * 60_000), (5, "a " * 60_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df, words=3, percent=90).collect()}
    assert got == brute(rows, 3, 90) and [got[i][1] for i in range(1, 6)] == [1, 1, 3, 4, 4]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 101), (None, 3)], "a long, b long")
    labels = {r.node: r.label for r in components.connected_components(edges).collect()}
    assert labels == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as pipeline
    from quillstone.llm.common import written

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for n, (name, stage) in enumerate(pipeline.STAGES):
        before, docs = docs, written(stage(spark, docs, sf_dir), "stage")
        if n < 4:
            assert docs.columns == pipeline.COLUMNS
        if n < 3:
            assert docs.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
        if n == 1:
            assert docs.count() == before.count()
        if n == 2:
            rows = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()]
            want = {i for i, (_, c) in brute(rows, 5, 80).items() if i == c}
            assert {r.doc_id for r in docs.collect()} == want
    assert docs.where("offset = 0").count() == docs.select("sequence_id").distinct().count()
    empty = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        empty = stage(spark, empty, sf_dir)
    assert empty.count() == 0


def test_queries_with_sql(spark, sf_dir):
    from oracle import connect, rows_of_query, rows_of_sql

    from quillstone.llm import queries

    con = connect(sf_dir)
    for name, sql in queries.SQL.items():
        assert rows_of_query(queries.QUERIES[name](spark, sf_dir)) == rows_of_sql(con, sql), name
