from quillstone.operators import conflicts, decide, retrieval as R, sequential as S


def test_ties_go_by_path_then_ordinal(spark):
    scored = spark.createDataFrame([(1, "z.py", 0, 1.0), (1, "a.py", 1, 1.0), (1, "a.py", 0, 1.0)], "query_id long, path string, ordinal int, score double")
    assert [(r.path, r.ordinal) for r in R.top_k(scored, 2, by=R.score_order()).orderBy("rank").collect()] == [("a.py", 0), ("a.py", 1)]


def test_idf_of_frequent_terms_is_clamped(spark):
    queries = spark.createDataFrame([(1, "x")], "query_id long, term string")
    postings = spark.createDataFrame([("a", 0, "x", 1), ("b", 0, "x", 2)], "path string, ordinal int, term string, tf long")
    lengths = spark.createDataFrame([("a", 0, 1), ("b", 0, 2), ("c", 0, 3)], "path string, ordinal int, dl long")
    assert all(0 < r.score < 1e-5 for r in R.bm25_scores(queries, postings, lengths, keys=["path", "ordinal"]).collect())


def test_greedy_skips_what_does_not_fit_and_empty_queries_have_a_row(spark):
    queries = spark.createDataFrame([(1,), (2,)], "query_id long")
    fused = spark.createDataFrame([(1, "a", 0, 0), (1, "b", 0, 1), (1, "c", 0, 2)], "query_id long, path string, ordinal int, place long")
    sizes = spark.createDataFrame([("a", 0, 40), ("b", 0, 400), ("c", 0, 30)], "path string, ordinal int, chars long")
    rows = {r.query_id: r for r in R.greedy_pack(queries, fused, sizes, budget=20).collect()}
    assert rows[1].selected == ["a#0", "c#0"] and rows[1].total_tokens == (40 + 30 + 2) // 4
    assert rows[2].seed_failed and rows[2].total_tokens == 0 and rows[2].reduction_pct is None


def test_fusion_ties_keep_channel_order(spark):
    rows = [(1, "lexical", "a", 0, 0), (1, "symbol", "b", 0, 0)]
    channels = spark.createDataFrame(rows, "query_id long, channel string, path string, ordinal int, rank long")
    assert [r.path for r in R.fuse(channels).orderBy("place").collect()] == ["b", "a"]


def test_relation_channel_is_selective_and_scoped(spark):
    relations = spark.createDataFrame([("x/a.py", 0, "rare"), ("y/b.py", 0, "rare")] + [(f"f{i}.py", 0, "often") for i in range(9)], "path string, ordinal int, name string")
    wanted = spark.createDataFrame([(1, "rare", ["rare", "y"]), (1, "often", ["rare", "y"])], "query_id long, name string, expanded array<string>")
    assert [r.path for r in R.relation_channel(wanted, relations, 100).orderBy("rank").collect()] == ["y/b.py", "x/a.py"]


def test_prefer_whole(spark):
    row = lambda q, p: (q, p, 0, 1.0)
    schema = "query_id long, path string, ordinal int, score double"
    expanded = spark.createDataFrame([row(1, "a"), row(1, "b"), row(2, "c")], schema)
    whole, single = spark.createDataFrame([row(1, "a")], schema), spark.createDataFrame([(1,), (2,)], "query_id long")
    assert sorted((r.query_id, r.path) for r in R.prefer_whole(expanded, whole, single).collect()) == [(1, "a"), (2, "c")]


def test_expand_stops_at_depth(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("b", "a")], "src string, dst string")
    seeds = spark.createDataFrame([(1, "a")], "query_id long, node string")
    assert sorted((r.node, r.hop) for r in R.expand(seeds, edges).collect()) == [("b", 1), ("c", 2)]


TIMEOUTS = [("billing/limits.py", "TIMEOUT = 30"), ("search/limits.py", "TIMEOUT = 90"), ("legacy/limits.py", "TIMEOUT = 5")]
SELECTED = "query_id long, query string, rank long, id long, path string, text string, assigned array<struct<symbol:string,value_hash:string>>"


def selected(spark, *queries):
    """Rows of queries (query, blocks (path, text, assigned pairs))."""
    return spark.createDataFrame([(q, query, i, i, path, text, given) for q, (query, blocks) in enumerate(queries) for i, (path, text, given) in enumerate(blocks)], SELECTED)


def test_conflicts_follow_the_query_scope(spark):
    own = [(p, t, [("TIMEOUT", t.split()[-1])]) for p, t in TIMEOUTS]
    same = [(p, t, [("TIMEOUT", "1")]) for p, t in TIMEOUTS[:2]]
    rows = selected(spark, ("search TIMEOUT value", own), ("compare TIMEOUT in search", own), ("TIMEOUT", own[:2]), ("search", same), ("previous search TIMEOUT", own), ("TIMEOUT", [own[0], own[2]]))
    found = {(r.query_id, r.symbol): (r.kept, sorted(r.dropped)) for r in conflicts.decisions(rows).collect()}
    assert found == {(0, "TIMEOUT"): (1, [0, 2]), (5, "TIMEOUT"): (0, [1])}
    left = [(r.query_id, r.id) for r in conflicts.drop_conflicts(rows).collect()]
    assert sorted(left) == [(0, 1), *((1, i) for i in range(3)), (2, 0), (2, 1), (3, 0), (3, 1), *((4, i) for i in range(3)), (5, 0)]


def test_a_loser_with_another_named_fact_stays(spark):
    blocks = [("billing/s.py", "TIMEOUT = 30", [("TIMEOUT", "a")]), ("search/s.py", "TIMEOUT = 90\nMAX_JOBS = 7", [("TIMEOUT", "b"), ("MAX_JOBS", "c")])]
    assert conflicts.decisions(selected(spark, ("billing TIMEOUT and MAX_JOBS", blocks), ("billing TIMEOUT", [])).limit(9)).count() == 0


def test_what_gave_way_has_no_say_later(spark):
    """B gives way to A for the first symbol; for the second only A and C are left, and C is marked as superseded."""
    blocks = [("api/a.py", "x", [("ALPHA", "1"), ("BETA", "1")]), ("b.py", "x", [("ALPHA", "2"), ("BETA", "2")]), ("old/api/c.py", "x", [("BETA", "3")])]
    found = [(r.symbol, r.kept, list(r.dropped)) for r in conflicts.decisions(selected(spark, ("api ALPHA BETA", blocks))).orderBy("symbol").collect()]
    assert found == [("ALPHA", 0, [1]), ("BETA", 0, [2])]


def test_information_gain_rules():
    assert S.information_gain([4.0, 0.1, 3.9], [100, 100, 100], {}, 250) == [0, 2]
    assert S.information_gain([4.0, 0.1, 3.9], [100, 100, 100], {}, 300, rule="budget_fill") == [0, 1, 2]
    assert S.information_gain([4.0, 0.0], [100, 100], {1: {0}}, 300, unit=4.0) == [0, 1]
    assert S.information_gain([0.0], [1], {}, 10) == []


def test_grouped_order_is_least_served_first():
    assert S.grouped_order([(0, "a"), (1, "a"), (2, "b"), (3, "a")]) == [0, 2, 1, 3]


def test_views_and_clauses():
    assert len(S.clauses("Do this. Then that and more")) > 1 and S.clauses("one") == ["one"]


def test_views_rescue_what_does_not_fit(spark):
    rows = spark.createDataFrame([(1, 0, 400, 40), (1, 1, 20, 10), (1, 2, 900, 900), (2, 0, 900, 900)], "query_id long, place long, full long, compact long")
    got = {m: {r.query_id: ([(k.place, k.view) for k in r.kept], r.used) for r in R.pack_views(rows, budget=20, mode=m).collect()} for m in ("raw", "compact", "rescue")}
    assert got["raw"] == {1: ([(1, "full")], 20), 2: ([], 0)} and got["compact"] == {1: ([(0, "compact"), (1, "compact")], 52), 2: ([], 0)}
    assert got["rescue"] == {1: ([(0, "compact"), (1, "full")], 62), 2: ([], 0)}



def test_pareto_keeps_ties_and_drops_nulls(spark):
    rows = spark.createDataFrame([("g", 1.0, 5.0), ("g", 1.0, 5.0), ("g", 2.0, 4.0), ("g", None, 9.0), ("g", 2.0, 6.0)], "grp string, cost double, gain double")
    assert sorted((r.cost, r.gain) for r in decide.pareto(rows, minimize=["cost"], maximize=["gain"], group="grp").collect()) == [(1.0, 5.0), (1.0, 5.0), (2.0, 6.0)]
    three = rows.withColumnRenamed("grp", "g2").selectExpr("g2 AS grp", "cost", "gain", "cost AS other")
    assert decide.pareto(three, minimize=["cost", "other"], maximize=["gain"], group="grp").count() == 3


def test_answers_compare_by_type(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("1", "1.0"), ("true", "1"), ('"a"', '"a"'), ('{"x":1}', '{"x":1}')], "a string, b string")
    v = [F.parse_json("a"), F.parse_json("b")]
    rows = df.select(decide.same_answer(*v).alias("s"), decide.same_number(*v).alias("n")).collect()
    assert [(r.s, r.n) for r in rows] == [(False, True), (False, False), (True, True), (True, True)]


def test_queries_of_equal_neighbours_are_expanded_once(spark):
    import random

    rng = random.Random(3)
    edges = [(f"s{i}", f"n{rng.randint(0, 3)}") for i in range(200)] + [(f"n{i}", f"t{j}") for i in range(4) for j in range(i + 3)]
    edges += [("t0", "s5"), ("t1", "n0"), ("n2", "n3")] + [(f"s{i}", "n1") for i in range(0, 200, 7)]
    seeds = [(i, f"s{i}") for i in range(200)] + [(300, "s1"), (300, "s2"), (301, "n1"), (302, "lost")]
    seeds, edges = spark.createDataFrame(seeds, "query_id long, node string"), spark.createDataFrame(edges, "src string, dst string")
    want = {}
    for r in R.expand(seeds, edges, depth=3).collect():
        want.setdefault((r.query_id, r.hop), []).append(r.node)
    got = {(r.query_id, r.hop): (r.n, r.first_node) for r in R.reach(seeds, edges, depth=3).collect()}
    assert got == {k: (len(v), min(v)) for k, v in want.items()}


def test_lists_of_names_stay_where_they_are(spark):
    relations = spark.createDataFrame([(f"{'x' if i % 3 else 'Y'}/f{i}.py", 0, f"n{i % 5}") for i in range(40)] * 2, "path string, ordinal int, name string")
    wanted = spark.createDataFrame([(q, f"n{q % 5}", ["y", f"n{q % 5}"]) for q in range(9)] + [(9, "none", ["none"])], "query_id long, name string, expanded array<string>")
    out = R.relation_channel(wanted, relations, 500, 4)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "expanded" not in plan
    want = set()
    for q in range(9):
        paths = sorted({f"{'x' if i % 3 else 'Y'}/f{i}.py" for i in range(40) if i % 5 == q % 5}, key=lambda p: (p[0] != "Y", p))
        want |= {(q, p, r) for r, p in enumerate(paths[:4])}
    assert {(r.query_id, r.path, r["rank"]) for r in out.collect()} == want


def test_reused_blocks_are_compared_without_their_texts(spark):
    from quillstone.operators import integrity

    shape = "path string, ordinal int, kind string, name string, text string"
    rows = lambda tag, n: [(f"{tag}{i:02}", i % 2, "k", None if i % 3 else "m", "copy" if i % 2 else f"t{i % 7}") for i in range(n)]
    old, new = rows("a", 30), rows("b", 41)
    out = integrity.reuse_blocks(spark.createDataFrame(old, shape), spark.createDataFrame(new, shape))
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    by = {}
    for r in sorted(old):
        by.setdefault(r[2:], []).append(r[:2])
    want = {r[:2]: by[r[2:]].pop(0) if by.get(r[2:]) else (None, None) for r in sorted(new)}
    assert {(r.path, r.ordinal): (r.old_path, r.old_ordinal) for r in out.collect()} == want
