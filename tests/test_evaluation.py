"""Evaluation reports and query views on cases of their own."""

import pytest
from pyspark.sql import functions as F

from quillstone.operators import decide, evaluate, integrity, retrieval, telemetry, views

ROWS = "corpus string, method string, task string, transport boolean, success boolean, request string"


def test_operations_are_what_code_calls():
    text = "Why?\n```python\nimport os\nwith pool.lease as x, open('f') as g:\n    run.job(a, key=b, **rest)\n    table[0](1)\n    getattr(x, 'y')\n```\ntext call() here\n```\nsecond(2)\n```\n"
    names, notes = views.operation_names(text)
    assert names == ["lease", "open", "job", "key=b", "getattr", "second"]
    assert notes == ["a computed call target", "unpacked keywords", "what getattr reaches"]
    assert views.operation_names("Explain this, please.\ndef f():\n    g(h(1))\n") == (["g", "h"], [])
    assert views.operation_names("no code at all, really") == ([], [])
    assert views.operation_names("x" * 70_000) == ([], ["code too long to parse"])
    many = "".join(f"```py\nf{i}(a=[ 1 ])\n```\n" for i in range(20)) + "```\nbroken(\n```\n```js\nno()\n```\n```\nopen_ended()\n"
    assert views.operation_names(many) == ([x for i in range(20) for x in ((f"f{i}", "a=[1]") if i == 0 else (f"f{i}",))], [])
    assert views.operation_names("") == ([], [])


def test_views_of_queries(spark):
    rows = spark.createDataFrame([("Set it up. Does it run? It does! And then?",), ("no question",), ("HTTPServer maxRetry_count 42 the",)], "q string")
    got = rows.select(views.questions(F.col("q")).alias("a"), views.expanded_terms(F.col("q")).alias("e")).collect()
    assert [r.a for r in got] == ["Does it run?\nAnd then?", "no question", "HTTPServer maxRetry_count 42 the"]
    assert got[2].e == ["httpserver", "maxretry_count", "http", "server", "max", "retry", "count"]
    parts = spark.createDataFrame([("XMLFile2",), ("plain",), ("ABC1",)], "w string").select(views.spelled_parts(F.col("w")).alias("p")).collect()
    assert [r.p for r in parts] == [["xml", "file"], [], ["abc"]]


def test_intent_is_read_from_whole_words(spark):
    names = F.array(F.lit("valueerror"))
    ask = lambda q, mode: spark.createDataFrame([(q,)], "q string").select(views.intent_relations(F.col("q"), names, mode).alias("n")).first().n
    assert ask("errors.raise ValueError", "action") == [] and ask("who raises it", "action") == ["valueerror"] and ask("who raises it", "conservative") == []
    assert ask("who raises pkg.ValueError", "conservative") == ["valueerror"] and ask("who doesn't raise ValueError", "conservative") == []
    assert ask("anything", "original") == ["valueerror"] and ask("anything", "disabled") == []
    with pytest.raises(ValueError):
        ask("x", "other")


def test_corpora_of_other_tasks_are_not_compared(spark):
    rows = [("base", "m", "a", True, True, "1"), ("base", "m", "b", True, False, "2"), ("new", "m", "a", True, False, "1"), ("new", "m", "b", False, False, "3")]
    df = spark.createDataFrame(rows, ROWS)
    row = evaluate.corpus_comparison(df, baseline="base", keys=["method"]).first()
    assert (row.wins, row.losses, row.ties, row.missing, row.identical) == (0, 1, 0, 1, 1)
    for bad in (rows[:3], [*rows, ("new", "m", "c", True, True, "4")], [*rows, rows[3]], [*rows, ("new", "other", "a", True, True, "1")]):
        with pytest.raises(Exception, match="matching groups"):
            evaluate.corpus_comparison(spark.createDataFrame(bad, ROWS), baseline="base", keys=["method"]).collect()


def test_malformed_traces_fail(spark):
    df = spark.createDataFrame([("r1", 5, 3), ("r2", 7, 7)], "request_id string, original_tokens long, optimized_tokens long")
    assert telemetry.valid_traces(df).count() == 2 and telemetry.trace_of(df, "r2").first().original_tokens == 7 and telemetry.trace_of(df, "r3").count() == 0
    for bad in ((None, 1, 1), ("r3", -1, 0), ("r3", None, 0)):
        with pytest.raises(Exception, match="malformed"):
            telemetry.valid_traces(df.union(spark.createDataFrame([bad], df.schema))).collect()


def test_values_at_places(spark):
    import random
    import statistics

    rng = random.Random(1)
    rows = [(g, float(rng.choice([1, 2, 2, 3, rng.random() * 10**rng.randint(0, 9)]))) for g in "abc" for _ in range(rng.choice([1, 8, 501]))] + [("z", None), ("y", 4.0), ("y", 4.0)]
    found = {r.g: r.median for r in telemetry.medians(spark.createDataFrame(rows, "g string, v double"), group="g", value="v").collect()}
    assert found == {g: statistics.median([v for h, v in rows if h == g]) for g in {h for h, v in rows if v is not None}}


def test_contracts(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b")], "n int, s string")
    rules = {"positive": F.col("n") > 0}
    assert {r.check: r.n for r in integrity.contracts(df, {"n": "int", "s": "string"}, rules).collect()} == {"schema": 0, "positive": 1}
    assert integrity.contracts(df, {"n": "bigint", "t": "string"}, rules).where("check = 'schema'").first().n == 3


def test_tails_are_trimmed(spark):
    rows = spark.createDataFrame([(1, 0, 40), (1, 1, 40), (1, 2, 1), (2, 0, 4000)], "query_id long, place long, chars long")
    assert sorted((r.query_id, r.place) for r in retrieval.trim_tail(rows, budget=20).collect()) == [(1, 0), (1, 1)]


def test_the_row_before_in_order(spark):
    rows = [(i % 3 or None, i * 7 % 50, f"t{i}") for i in range(150)] + [(1, 3, "x"), (1, 3, "x")]
    df = spark.createDataFrame(rows, "g int, k int, v string").repartition(3)
    got = decide.with_previous(df, group=["g"], order=["k", "v"], value="v", name="before").collect()
    by = {}
    for g, k, v in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        by.setdefault(g, []).append((k, v))
    want = sorted(((g, k, v, vs[i - 1][1] if i else None) for g, vs in by.items() for i, (k, v) in enumerate(vs)), key=repr)
    assert sorted(((r.g, r.k, r.v, r.before) for r in got), key=repr) == want


def test_many_queries_are_not_sent(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)
    vectors = spark.createDataFrame([(i, [float(i % 7), float(i % 5)]) for i in range(40)], "vec_id long, embedding array<double>")
    queries = vectors.where("vec_id % 3 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    rows = lambda: sorted(map(tuple, retrieval.vector_channel(queries, vectors, 3).select("query_id", "vec_id", "rank").collect()))
    sent = rows()
    monkeypatch.setattr(retrieval, "SENT_QUERIES", 0)
    assert rows() == sent and len(sent) == 42


def test_the_bootstrap_is_that_of_the_draws(spark):
    rows = [(g, i, float(d)) for g, n in (("a", 5), ("b", 400)) for i in range(n) for d in [(i * 7 % 5) - 2]] + [("a", 99, None)]
    df = spark.createDataFrame(rows, "g string, k long, d double")
    ask = lambda x: {r.g: (r.n, r["mean"], r.low, r.high) for r in evaluate.bootstrap_interval(x, by=["g"], key="k", value="d", resamples=200).collect()}
    got = ask(df)
    assert got == ask(df.repartition(5)) and got["a"][0] == 5 and got["b"][0] == 400
    mean = sum(d for g, _, d in rows if g == "b") / 400
    spread = (sum((d - mean) ** 2 for g, _, d in rows if g == "b") / 400 / 400) ** 0.5
    assert abs(got["b"][1] - mean) < 1e-9 and abs(got["b"][2] - (mean - 1.96 * spread)) < 0.5 * spread and abs(got["b"][3] - (mean + 1.96 * spread)) < 0.5 * spread
    assert evaluate.bootstrap_interval(df.where("false"), by=["g"], key="k", value="d", resamples=5).count() == 0


def test_frontiers_of_three_measures(spark):
    import random

    rng = random.Random(4)
    rows = [(rng.choice(["a", "b"]), float(rng.randint(0, 9)), float(rng.randint(0, 9)), float(rng.randint(0, 9)), i) for i in range(300)] + [("a", None, 1.0, 1.0, 999)]
    got = {r.i for r in decide.pareto(spark.createDataFrame(rows, "g string, x double, y double, z double, i int"), minimize=["x", "y"], maximize=["z"], group="g").collect()}
    worse = lambda p, q: q[0] == p[0] and q[1] <= p[1] and q[2] <= p[2] and q[3] >= p[3] and q[1:4] != p[1:4]
    whole = rows[:-1]
    assert got == {p[4] for p in whole if not any(worse(p, q) for q in whole)}


def test_choice_without_a_key(spark):
    rows = [("b", 5.0, 1.0, 9, True, True, "e", 3.0), ("a", 5.0, 1.0, 9, True, True, "e", 3.0), ("c", 0.0, 0.0, 9, False, True, "e", 3.0), ("d", 0.0, 0.0, 99, True, True, " ", None)]
    df = spark.createDataFrame(rows, "name string, setup_ms double, request_ms double, storage_bytes long, compatible boolean, quality_passed boolean, evidence string, p95_ms double")
    got = {r.name: (r.chosen, list(r.reasons)) for r in decide.choose(df, requests=10, storage=50, slo_ms=5.0).collect()}
    assert got == {"a": (True, []), "b": (False, []), "c": (False, ["incompatible"]), "d": (False, ["no evidence", "storage", "latency"])}
    assert not any(r.chosen for r in decide.choose(df.where("name = 'c'"), requests=1, storage=50).collect())


def test_nested_secrets_do_not_reach_the_log(spark, tmp_path):
    rows = [("r1", {"Api_Key": 'a"b', "note": "Bearer abc.def"}, [("sk-" + "a" * 24, "kept")])]
    df = spark.createDataFrame(rows, "request_id string, headers map<string,string>, calls array<struct<body:string,client_secret:string>>")
    telemetry.write_traces(df, str(tmp_path / "log"))
    row = spark.read.json(str(tmp_path / "log")).first()
    assert row.headers.Api_Key == "[REDACTED]" and row.headers.note == "Bearer [REDACTED_TOKEN]"
    assert row.calls[0].body == "[REDACTED_API_KEY]" and row.calls[0].client_secret == "[REDACTED]" and row.request_id == "r1"


def test_draws_of_a_bootstrap_are_dealt(spark, monkeypatch):
    """One draw a key and resample, whatever groups the key has, over as many tasks as the draws ask for."""
    import hashlib

    rows = [(g, i, float((i * 7 + len(g)) % 4 - 1)) for g in ("a", "bb") for i in range(40 + len(g))] + [("a", 3, 2.0)]
    df = spark.createDataFrame(rows, "g string, k long, d double")
    monkeypatch.setattr(evaluate, "DRAWS", 50)
    out = evaluate.bootstrap_interval(df, by=["g"], key="k", value="d", resamples=20)
    got = {r.g: (r.n, r["mean"], r.low, r.high) for r in out.collect()}
    weight = lambda k, r: sum(int(hashlib.md5(f"{k}|{r}|0".encode()).hexdigest()[:8], 16) / 2**32 >= t for t in evaluate._AT_MOST)

    def at(values, share):
        values, place = sorted(values), share * (len(values) - 1)
        low = int(place)
        return values[low] + (place - low) * (values[min(low + 1, len(values) - 1)] - values[low])

    for g in ("a", "bb"):
        mine = [(k, d) for h, k, d in rows if h == g]
        means = [sum(weight(k, r) * d for k, d in mine) / sum(weight(k, r) for k, _ in mine) for r in range(20)]
        want = (len(mine), sum(d for _, d in mine) / len(mine), at(means, 0.025), at(means, 0.975))
        assert all(abs(x - y) < 1e-9 for x, y in zip(got[g], want, strict=True))
