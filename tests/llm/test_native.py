"""Line dedup, mixing and sharding on edge cases, and mixing against a plain model."""

import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillstone.llm import lines, mixing, sharding

DOCS = "doc_id long, text string, lang string, source string, extra string"


def test_line_dedup_by_hand(spark):
    rows = [(i, "h", f"own line {i}\nshared\n\nrare {i % 4}") for i in range(10)] + [(90, None, "shared"), (91, "small", "shared"), (92, "h", None), (93, "h", "")]
    rows += [(0, "h", "own line 0\nshared\n\nrare 0")]  # a repeated row
    df = spark.createDataFrame(rows, "page_id long, host string, text string").withColumn("__line", F.lit("clash")).withColumn("n_lines", F.lit(5))
    out = lines.drop_site_lines(df, F.col("host"), F.col("text"), max_ratio=0.5, min_pages=5)
    got = {(r.page_id, r.host): r for r in out.collect()}
    assert len(out.collect()) == len(rows)
    assert got[(3, "h")].text == "own line 3\n\nrare 3" and got[(3, "h")].n_dropped == 1 and got[(3, "h")].n_lines == 4
    assert got[(90, None)].text == "shared" and got[(91, "small")].text == "shared"
    assert got[(92, "h")].text is None and got[(92, "h")].n_lines == 0 and got[(93, "h")].text == ""
    assert got[(3, "h")]["__line"] == "clash"


def test_line_dedup_counts_equal_pages_once(spark):
    rows = [(i, "h", "copied text") for i in range(50)] + [(100 + i, "h", f"page {i}") for i in range(9)]
    df = spark.createDataFrame(rows, "page_id long, host string, text string")
    out = lines.drop_site_lines(df, F.col("host"), F.col("text"), max_ratio=0.2, min_pages=5, distinct_texts=True)
    assert out.where("n_dropped > 0").count() == 0
    by_page = lines.drop_site_lines(df, F.col("host"), F.col("text"), max_ratio=0.2, min_pages=5)
    assert by_page.where("n_dropped > 0").count() == 50


@pytest.mark.parametrize("broadcast", [1 << 19, 0])
def test_line_dedup_of_a_hot_site_and_of_nothing(spark, monkeypatch, broadcast):
    """A host with two thirds of all pages, one page of 50,000 lines, by either way of joining."""
    from quillstone import scratch

    monkeypatch.setattr(scratch, "BROADCAST_ROWS", broadcast)
    rows = [(i, "hot" if i % 3 else f"h{i % 30}", "\n".join(["menu", f"line {i}", f"tenth {i % 10}", f"shared by few {i % 90}"])) for i in range(900)]
    rows.append((900, "hot", "menu\n" + "\n".join(f"long {i}" for i in range(50_000))))
    df = spark.createDataFrame(rows, "page_id long, host string, text string")
    out = {r.page_id: r for r in lines.drop_site_lines(df, F.col("host"), F.col("text"), max_ratio=0.2, min_pages=5).collect()}
    assert all(out[i].text == (f"line {i}\ntenth {i % 10}\nshared by few {i % 90}" if i % 3 else f"line {i}") for i in range(900))
    assert out[900].n_lines == 50_001 and out[900].n_dropped == 1
    assert lines.drop_site_lines(df.where("false"), F.col("host"), F.col("text"), max_ratio=0.2, min_pages=5).count() == 0


def test_page_text(spark):
    html = "<html><head><title>x</title></head><script>var a='</p>';</script><p>One <b>two</b></p><!-- c --><div>three</div></html>"
    got = spark.createDataFrame([(html,)], "h string").select(lines.page_text(F.col("h")).alias("t"), lines.host_of(F.lit("HTTPS://u:p@Ex.com:80/a")).alias("h")).first()
    assert [x for x in got.t.split("\n") if x.strip()] == ["One two", "three"] and got.h == "ex.com"


def targets(sizes, weights=(5, 2, 1), cap=3):
    """Shares by weight; what a cap cuts off is shared again among the others until none is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, fixed = {}, {}
    while True:
        left = sum(sizes.values()) - sum(fixed.values())
        open_ = [s for s in names if s not in fixed]
        total = sum(w[s] for s in open_)
        out = dict(fixed) | {s: left * w[s] / total for s in open_}
        above = [s for s in open_ if out[s] > cap * sizes[s] + 1e-9]
        if not above:
            return out
        fixed |= {s: float(cap * sizes[s]) for s in above}


def corpus(n=400):
    return [(i, " ".join(["w"] * (1 + i * 7 % 90)), "en", ["a", "b", "é", None, "zz"][min(4, i % 23)], "x") for i in range(n)]


@pytest.mark.parametrize("n", [1, 7, 400])
def test_mixing(spark, n):
    rows = [*corpus(n), (None, None, None, "a", None), (-1, " \t ", "en", "b", None), (5, "same id", "en", "a", None), (5, "same id", "en", "a", None)]
    df = spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("clash"))
    out = mixing.mix_sources(df).collect()
    assert len(out) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in out:
        words = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        assert r["size"] == words and 0 <= r.copies <= 3
        sizes[r.source] += words
        taken[r.source] += words * r.copies
    want, most = targets(sizes), max(r["size"] for r in out)
    for r in out:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
    for s in want:
        assert abs(taken[s] - want[s]) <= most / 2 + 1, s
        if sum(x["source"] == s for x in out) > 100:
            assert abs(taken[s] - want[s]) <= 3, s
    again = mixing.mix_sources(df.repartition(7)).collect()
    key = lambda r: (str(r.doc_id), str(r.text), str(r.source), r.copies)
    assert sorted(map(key, out)) == sorted(map(key, again))


def test_mixing_of_rows_without_ids_and_of_small_sources(spark):
    """Rows without doc_id are documents each; a source of one long text among short ones comes near its target."""
    rows = [(None, " ".join(["w"] * 100) + f" {i}", "en", "a", None) for i in range(40)] + [(i, " ".join(["w"] * (1700 if i == 0 else 20 + i % 11)), "en", "b", None) for i in range(200)]
    out = mixing.mix_sources(spark.createDataFrame(rows, DOCS)).collect()
    for s, near in (("a", 51), ("b", 16)):
        assert abs(sum(r["size"] * r.copies for r in out if r.source == s) - next(r.target for r in out if r.source == s)) <= near, s
    assert len({r.copies for r in out if r.source == "a"}) == 2


def test_the_fold_settles_units_and_keeps_their_words(spark):
    """A block's fold against a plain one with the same draws: all but one unit have none or all, and no word is lost."""
    rows = [("s", i, 5 + i * 13 % 60, (5 + i * 13 % 60) * (1 << 20) * 3 // 10) for i in range(50)]
    units = spark.createDataFrame(rows, "source string, unit long, size long, mass long")
    got = {r.unit: (r["size"], r.extra) for r in mixing.pivotal_copies(units, 7).collect()}
    assert len(got) == 50 and {e for _, e in got.values()} == {0, 1}
    want = sum(m for *_, m in rows) / (1 << 20)
    assert abs(sum(n * e for n, e in got.values()) - want) <= max(n for n, _ in got.values()) / 2 + 1
    draws = {r.k: r.u for r in spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(f"{a},{b}").alias("k"), mixing._uniform(F.lit(a), F.lit(b), F.lit(7)).alias("u")) for a, b in ((3, 4), (-1, 9))])).alias("x")).select("x.*").collect()}
    assert all(0 <= u < 1 for u in draws.values()) and len(set(draws.values())) == 2


def test_mixing_of_nothing(spark):
    assert mixing.mix_sources(spark.createDataFrame([], DOCS)).count() == 0
    assert mixing.mix_sources(spark.createDataFrame([(1, None, "x", "a", None)], DOCS)).first().target == 0


def test_sharding(spark):
    rows = [*corpus(300), *[(1000 + i, "hot text", "en", "a", None) for i in range(40)], (None, None, None, None, None), (9007, "", "en", "a", None), (9007, "", "en", "a", None)]
    df = spark.createDataFrame(rows, DOCS)
    out = sharding.shard_documents(df, n_shards=8).collect()
    assert len(out) == len(rows)
    by_text, slots, load = defaultdict(set), defaultdict(list), defaultdict(int)
    texts = defaultdict(list)
    for i, t, *_ in rows:
        texts[i].append(t)
    for r in out:
        slots[r.shard].append(r.slot)
        load[r.shard] += r["size"]
        t = texts[r.doc_id][0]
        assert r["size"] == len((t or "").encode()) + 1 and r.text_crc32 == zlib.crc32((t or "").encode()) and r.law == "bytes" and r.grown_shard is None
        by_text[t].add(r.shard)
    assert all(len(s) == 1 for s in by_text.values()) and set(load) == set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) < 1.25 * min(load.values())
    assert sharding.shard_documents(spark.createDataFrame([], DOCS), n_shards=8).count() == 0
    assert sharding.shard_documents(df, target_bytes=5000).select("shard").distinct().count() > 1


def plain_shards(units, n_dims, n_shards):
    """digest -> shard by sorting each node's units (digest, weight, places) along its widest dimension."""
    out, todo = {}, [(units, n_shards, 0)]
    while todo:
        found, k, first = todo.pop()
        if k == 1 or not found:
            out |= {u[0]: first for u in found}
            continue
        d = max(range(n_dims), key=lambda i: ((max(u[2][i] for u in found) - min(u[2][i] for u in found)) >> sharding.HASH_BITS, -i))
        goal, below, cut = sum(u[1] for u in found) * (k // 2) / k, 0, None
        by = defaultdict(int)
        for u in found:
            by[u[2][d]] += u[1]
        for n, (at, w) in enumerate(sorted(by.items())):
            if below + w > goal or n == len(by) - 1:
                cut = at + (below + w - goal < goal - below)
                break
            below += w
        todo += [([u for u in found if u[2][d] < cut], k // 2, first), ([u for u in found if u[2][d] >= cut], k - k // 2, first + k // 2)]
    return out


@pytest.mark.parametrize("n_shards,broadcast", [(1, 1 << 19), (2, 1 << 19), (7, 1 << 19), (23, 0)])
def test_cuts_are_weighted_medians(spark, monkeypatch, n_shards, broadcast):
    from quillstone import scratch

    monkeypatch.setattr(scratch, "BROADCAST_ROWS", broadcast)
    rng = random.Random(n_shards)
    rows = [(f"{i:03d}".encode(), rng.choice([1, 5, 40, 900 if i % 50 == 0 else 7]), float(rng.choice([0, 1, 1, 2, rng.random() * 9])), float(i % 3)) for i in range(200)]
    df = spark.createDataFrame(rows, "digest binary, weight long, a double, b double")
    dims = {"a": F.col("a"), "b": F.col("b")}
    places = [(bytes(r.digest), r.weight, (r.k0, r.k1)) for r in sharding._places(df, dims).collect()]
    got = {bytes(r.digest): r.shard for r in sharding.kd_shards(df, dims, n_shards).collect()}
    assert got == plain_shards(places, 2, n_shards)


def test_shards_by_target_and_clashing_columns(spark):
    rows = corpus(200)
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in ("node", "weight", "size", "shard", "digest", "k0")})
    out = sharding.shard_documents(df, target_bytes=1000).collect()
    total = sum(r["size"] for r in out)
    assert len({r.shard for r in out}) > 1 and max(r.shard for r in out) == -(-total // 1000) - 1
