"""Signatures that many documents share, over several tasks."""

import random

import pytest
from test_jaccard import brute

from quillstone.llm import jaccard


@pytest.mark.parametrize("words,percent", [(3, 90), (5, 80)])
def test_template_groups_of_a_size_class_are_not_cut(spark, monkeypatch, words, percent):
    """Groups of near copies whose shingles are frequent sign the same empty parts; each task's smallest document is of
    another group, and stands for those of all groups in its task."""
    monkeypatch.setattr(jaccard, "HOT", 3)
    rng = random.Random(7)
    bases = [[f"g{g}w{i}" for i in range(120)] for g in range(5)]
    rows = []
    for task in range(4):
        for k in range(60):
            w = list(bases[(task + k) % 5])
            w[rng.choice([20, 90])] = f"x{task}y{k}"
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 4), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df, words=words, percent=percent).collect()}
    want = brute(rows, words, percent)
    assert len({c for _, c in want.values()}) == 5
    assert got == want


def test_a_hot_row_stands_for_others(monkeypatch):
    """1 and 2 share a hot signature in one task, 2 links with 3 of another task, and 1 cannot."""
    import pyarrow as pa

    monkeypatch.setattr(jaccard, "HOT", 1)
    texts = {1: [f"a{i}" for i in range(120)], 2: [f"b{i}" for i in range(120)], 3: [f"b{i}" for i in range(119)]}
    frequent = jaccard.np.unique(jaccard.np.concatenate([jaccard.shingle_set(" ".join(w), 3) for w in texts.values()])).tobytes()
    signed = []
    for task in ((1, 2), (3,)):
        batch = pa.RecordBatch.from_arrays([pa.array(task, pa.int64()), pa.array([" ".join(texts[i]) for i in task])], ["doc_id", "text"])
        signed += jaccard._sign(iter([batch]), 3, 90, frequent)
    table = pa.Table.from_batches(signed).sort_by("key")
    pairs = [(a, b) for out in jaccard._meet(iter(table.combine_chunks().to_batches()), 90) for a, b in zip(*(c.to_pylist() for c in out.columns), strict=True)]
    assert sorted(pairs) == [(1, 2), (1, 3)]


@pytest.mark.parametrize("limits", [{}, {"ALL_GLUED": 4, "MEET": 8}])
def test_copies_meet_once(monkeypatch, limits):
    """Edges of a group of near copies follow its size, not how many partitions its signatures are dealt over."""
    import pyarrow as pa

    for k, v in limits.items():
        monkeypatch.setattr(jaccard, k, v)
    rng, base = random.Random(3), [f"w{i}" for i in range(200)]
    texts = []
    for i in range(300):
        words = list(base)
        words[rng.randrange(200)] = f"x{i}"
        texts.append(" ".join(words))
    batch = pa.RecordBatch.from_arrays([pa.array(range(300), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    table = pa.Table.from_batches(list(jaccard._sign(iter([batch]), 3, 90, b""))).sort_by("key")
    of = jaccard.np.array([hash((7, k)) % 64 for k in table["key"].to_pylist()])
    pairs = []
    for part in range(64):
        some = table.filter(pa.array(of == part)).combine_chunks().to_batches()
        pairs += [(a, b) for out in jaccard._meet(iter(some), 90) for a, b in zip(*(c.to_pylist() for c in out.columns), strict=True)]
    joined = jaccard._joined_up(jaccard.np.array(pairs))
    assert len(joined) == 299
    assert limits or len(pairs) < 300 * 6


def test_large_blocks_move_by_what_is_not_joined(spark, monkeypatch):
    """A block of one large group of near copies, smaller ones and lone texts, in many chunks: all links count, and texts do not
    move with the square of the block."""
    monkeypatch.setattr(jaccard, "CHUNK_DOCS", 16)
    monkeypatch.setattr(jaccard, "DIRECT", 2)
    monkeypatch.setattr(jaccard, "HOT", 2)  # whatever shares a signature is one block
    rng, rows = random.Random(5), []
    base = [f"w{i}" for i in range(150)]
    for group, size in ((0, 220), (1, 30), (2, 20)):
        own = [w if i % 4 else f"g{group}{w}" for i, w in enumerate(base)]
        for _ in range(size):
            words = list(own)
            words[rng.randrange(150)] = f"x{len(rows)}"
            rows.append((len(rows), " ".join(words)))
    rows += [(len(rows) + i, " ".join(w if rng.random() < 0.8 else f"y{i}" for w in base)) for i in range(20)]
    rng.shuffle(rows)
    moved = []
    whole = jaccard._links
    monkeypatch.setattr(jaccard, "_links", lambda sets, words, percent: (moved.append(sets.agg({"high": "sum", "low": "sum", "*": "count"}).first()), whole(sets, words, percent))[1])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df, words=3, percent=90).collect()}
    assert got == brute(rows, 3, 90)
    copies = sum(r["sum(high)"] - r["sum(low)"] + r["count(1)"] for r in moved if r["count(1)"])
    assert len(moved) == 4 and copies < len(rows) * (len(rows) / 16) / 2


def test_large_sets_that_share_by_chance_do_not_move(spark, monkeypatch):
    """Large sets that share a passage, and a signature or two of hundreds, but are far from linking: no block holds them, and
    their signatures move as a key and a document, without what is the same for all signatures of a document."""
    rng, rows, moved = random.Random(5), [], []
    words = [[f"w{i}_{rng.random()}" for _ in range(1500)] for i in range(40)]
    for i in range(39):
        words[i + 1][:300] = words[i][-300:]
    rows = [(i, " ".join(w)) for i, w in enumerate(words)] + [(100, " ".join(words[0][:-20]))]
    sets = [jaccard.shingle_set(text, 5) for _, text in rows]
    signed = [jaccard.signatures(s, 80) for s in sets]
    assert sum(len(jaccard.np.intersect1d(a, b)) > 0 for a, b in zip(signed[:39], signed[1:40], strict=True)) > 20
    whole = jaccard._links
    monkeypatch.setattr(jaccard, "_links", lambda sets, words, percent: (moved.append(sets.count()), whole(sets, words, percent))[1])
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {i: 0 if i == 100 else i for i, _ in rows}
    assert moved == [2]
    batch = jaccard.pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows]})
    narrow = list(jaccard._narrow(jaccard._sign(iter([batch]), 5, 80, b""), 80))
    assert {tuple(b.schema.names) for b in narrow} == {("key", "doc", "kind")}
    table = jaccard.pa.Table.from_batches(narrow).sort_by([("key", "ascending"), ("doc", "ascending"), ("kind", "descending")])
    key, doc, kind = (table[c].to_pylist() for c in table.column_names)
    held = {}
    for k, d, at in zip(key, doc, kind, strict=True):
        if at <= jaccard.STANDS:
            held.setdefault(k, set()).add(d)
    for size in (1, 7, 1 << 20):  # where batches end makes no difference
        out = jaccard.pa.Table.from_batches(list(jaccard._shared(iter(table.combine_chunks().to_batches(max_chunksize=size)))))
        some = sorted((k, d) for k, d, at in zip(*(out[c].to_pylist() for c in out.column_names), strict=True) if at <= jaccard.STANDS)
        assert some == sorted((k, d) for k, ds in held.items() if len(ds) > 1 for d in ds)
