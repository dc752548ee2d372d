"""Postings in blocks: the same ranking as a full scan, with fewer postings read."""

import random

import pytest
from pyspark.sql import functions as F

from quillstone.operators import blockmax, retrieval as R

KEYS = ["path", "ordinal"]


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    docs, rows = [], []
    for i in range(1500):
        path, topic = f"t{i % 10}/f{i:05}", i % 10
        terms = {f"topic{topic}_{min(60, int(rng.expovariate(0.15)))}": rng.randrange(1, 5) for _ in range(12)} | {f"common{rng.randrange(4)}": rng.randrange(1, 3) for _ in range(3)}
        docs.append((path, i % 3, sum(terms.values()) + rng.randrange(5)))
        rows += [(path, i % 3, t, n) for t, n in terms.items()]
    queries = [(q, t) for q in range(12) for t in {f"topic{q % 10}_{rng.randrange(30)}" for _ in range(4)} | {"common0", "nowhere"}] + [(90, "nowhere"), (91, "common1")]
    make = lambda rows, s: spark.createDataFrame(rows, s).repartition(3)
    return make(rows, "path string, ordinal int, term string, tf long"), make(docs, "path string, ordinal int, dl long"), make(queries, "query_id long, term string")


def rows_of(df, digits=6):
    return sorted((r.query_id, r.path, r.ordinal, round(r.score, digits), r["rank"]) for r in df.collect())


@pytest.mark.parametrize("span,first,k", [(64, 8, 10), (7, 1, 3), (5, 0, 60), (4000, 8, 5)])
def test_top_equals_that_of_a_full_scan(tables, monkeypatch, span, first, k):
    monkeypatch.setattr(blockmax, "SPAN", span)
    monkeypatch.setattr(blockmax, "FIRST", first)
    postings, lengths, queries = tables
    made = blockmax.BlockPostings.of(postings, lengths, keys=KEYS)
    full = R.bm25_scores(queries, postings, lengths, keys=KEYS)
    assert rows_of(made.top(queries, k)) == rows_of(R.top_k(full, k, by=R.score_order()))


def test_ties_at_the_boundary_stay(tables):
    postings, lengths, queries = tables
    made = blockmax.BlockPostings.of(postings, lengths, keys=KEYS)
    full = R.bm25_scores(queries, postings, lengths, keys=KEYS).withColumn("score", F.round("score", 1))
    assert rows_of(made.top(queries, 10, digits=1, ties=True), 1) == rows_of(R.top_k(full, 10, by=[F.col("score").desc()], ties=True), 1)


def test_blocks_that_cannot_win_are_not_read(tables):
    postings, lengths, queries = tables
    made = blockmax.BlockPostings.of(postings, lengths, keys=KEYS)
    read, whole = made.read(queries, 5)
    print(f"{read} of {whole} postings")
    assert 0 < read < whole / 2
    assert made.top(queries.where("query_id = 90"), 5).count() == 0


def test_nothing(tables):
    postings, lengths, queries = tables
    assert blockmax.BlockPostings.of(postings.where("false"), lengths.where("false"), keys=KEYS).top(queries, 5).count() == 0
    assert blockmax.BlockPostings.of(postings, lengths, keys=KEYS).top(queries.where("false"), 5).count() == 0
