"""Substring dedup against a plain model."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import phrases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, window=13):
    """(doc_id, n_words, n_removed, text) of each row."""
    words = [WORD.findall(t or "") for _, t in rows]
    first = {}
    for (d, _), ws in zip(rows, words, strict=True):
        if d is not None:
            for i in range(len(ws) - window + 1):
                key = tuple(ws[i : i + window])
                first[key] = min(first.get(key, d), d)
    out = []
    for (d, _), ws in zip(rows, words, strict=True):
        gone = np.zeros(len(ws), dtype=bool)
        for i in range(len(ws) - window + 1):
            if d is not None and first[tuple(ws[i : i + window])] < d:
                gone[i : i + window] = True
        out.append((d, len(ws), int(gone.sum()), " ".join(w for w, g in zip(ws, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in df.collect()), key=repr)


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["Ä", "x" * 30, "日本", " ", "\u0085y"]
    some = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passages = [some(rng.choice([12, 13, 14, 30, 200, 600])) for _ in range(8)]
    rows = []
    for i in range(n):
        ws = some(rng.randrange(0, 60))
        for _ in range(rng.randrange(0, 4)):
            p = passages[rng.randrange(8)]
            a = rng.randrange(len(p))
            ws += p[a : a + rng.randrange(1, 400)] + some(rng.randrange(0, 3))
        gaps = [rng.choice([" ", "  ", "\n", "\t \r"]) for _ in ws]
        rows.append((rng.randrange(10**6), rng.choice(["", " "]) + "".join(w + g for w, g in zip(ws, gaps, strict=True))))
    return rows


@pytest.mark.parametrize("seed,limits", [(1, {}), (2, {"CHUNK": 50, "READ": 2000}), (3, {"READ": 300})])
def test_against_a_plain_model(spark, monkeypatch, seed, limits):
    for k, v in limits.items():
        monkeypatch.setattr(phrases, k, v)
    rows = corpus(seed)
    rows += [(5, rows[0][1])] * 2 + [(9_000_000, rows[1][1]), (None, rows[2][1]), (None, None), (-3, None), (-2, ""), (-1, " \n"), (7, " ".join("ab" * 40)), (6, " ".join(map(str, range(13))))]
    rows += [(rows[3][0], rows[4][1] + " more"), (rows[3][0], rows[3][1]), (8, " ".join(map(str, range(-4, 20))))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"no": F.lit("clash"), "th": F.lit(1), "spans": F.lit(2), "copy": F.lit(3)}).repartition(4)
    assert got(phrases.cut_repeats(df)) == plain(rows)


@pytest.mark.parametrize("window", [3, 6])
def test_other_windows(spark, window):
    rows = corpus(window, 30)
    assert got(phrases.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=window)) == plain(rows, window)


def test_large_groups_and_a_long_text(spark, monkeypatch):
    """Two thirds are copies or near copies; one text repeats a passage thousands of times; chunks are small."""
    monkeypatch.setattr(phrases, "CHUNK", 500)
    rng = random.Random(4)
    base = [f"b{rng.randrange(500)}" for _ in range(300)]
    rows = [(i, " ".join(base)) for i in range(100, 200)]
    for i in range(200, 300):
        ws = list(base)
        ws[rng.randrange(300)] = f"x{i}"
        rows.append((i, " ".join(ws)))
    rows += [(i, " ".join(f"own{i}_{k}" for k in range(100)) + " " + " ".join(base[:20])) for i in range(50)]
    rows.append((1000, " ".join(base[:40] * 1000 + [str(i) for i in range(20_000)])))
    assert got(phrases.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))) == plain(rows)


def test_nothing(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert phrases.cut_repeats(df.where("false")).count() == 0
    assert got(phrases.cut_repeats(df)) == [(1, 2, 0, "a b")]


def test_parts_hold_all_windows(monkeypatch):
    monkeypatch.setattr(phrases, "READ", 100)
    texts = [b"", None, b"one two", " ".join(f"é{i}" for i in range(200)).encode(), b"x" * 1000, b"x" * 1000 + b" y" * 30]
    for overlap in (1, 5):
        held = {}
        for data, of, before, stops in phrases._parts(texts, overlap):
            start = 0
            for i, b, stop in zip(of, before, stops.tolist(), strict=True):
                words = data[start:stop].tobytes().split()
                for k in range(len(words) - overlap):
                    assert (i, b + k) not in held
                    held[i, b + k] = words[k : k + overlap + 1]
                start = stop
        want = {(i, k): ws[k : k + overlap + 1] for i, t in enumerate(texts) for ws in [(t or b"").split()] for k in range(len(ws) - overlap)}
        assert held == want


def test_query_against_brute_force(spark, sf_dir):
    from quillstone.llm import queries

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted(((d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in plain(rows)), key=repr)
    out = queries.op11_repeated_phrases(spark, sf_dir)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out.collect()), key=repr) == want
    assert sum(k for _, _, k, _ in want) > 1000


def test_query_equals_sql(spark, sf_dir):
    from oracle import connect, rows_of_query, rows_of_sql

    from quillstone.llm import queries

    assert rows_of_query(queries.op11_repeated_phrases(spark, sf_dir)) == rows_of_sql(connect(sf_dir), queries.OP11_SQL)
