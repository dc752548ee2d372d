from pyspark.sql import functions as F

from quillstone.__main__ import main
from quillstone.operators import derive, integrity, prompts, selector, split
from quillstone.sources import documents
from quillstone.sources.store import Store

SCHEMA = "doc_id long, path string, language string, text string"
PROJECT = [(0, "handlers/retry_policy.py", "python", "class RetryPolicy:\n    def check(self, value):\n        raise RetryLimitError(value)\n")]
PROJECT += [(i, f"filler_{i}.py", "python", f"FILLER_{i} = {i}\n") for i in range(1, 81)]


def index_of(spark, rows, vectors=None):
    files = spark.createDataFrame(rows, SCHEMA)
    return selector.Index(split.split_blocks(files).persist(), files, vectors)


def test_relation_channel_needs_positive_intent(spark):
    index = index_of(spark, PROJECT)
    questions = ["Under what conditions is RetryLimitError raised?", "When is RetryLimitError caught?", "When is RetryLimitError not raised?", "Mention the literal string RetryLimitError raised"]
    queries = spark.createDataFrame(list(enumerate(questions)), "query_id long, query string")
    found = {r.query_id for r in selector.Selector(index).channels(queries, 60).where("channel = 'relation'").collect()}
    assert found == {0}
    for intent, wanted in (("disabled", set()), ("action", {0, 2, 3}), ("original", {0, 1, 2, 3})):
        options = selector.Options(intent=intent)
        assert {r.query_id for r in selector.Selector(index, options).channels(queries, 60).where("channel = 'relation'").collect()} == wanted, intent


def test_spelling_alias_and_path_queries_hit(spark):
    index = index_of(spark, PROJECT)
    for question in ("retryLimitError", "handlers retry policy"):
        assert selector.ask(spark, index, question)["spans"][0].startswith("handlers/retry_policy.py"), question


def test_an_exact_spelling_is_not_widened(spark):
    index = index_of(spark, [(i, f"f{i}.py", "python", f"item{i} = 1\n") for i in range(12)])
    assert selector.ask(spark, index, "item1")["spans"] == ["f1.py:1-1"]


def test_no_match_falls_back(spark):
    got = selector.ask(spark, index_of(spark, PROJECT[:3]), "zzqqmmwwqqzz")
    assert got["status"] == "fallback_required" and got["risk"] == "uncalibrated:maximum" and got["reduction_pct"] is None and got["escalation"] == "raw_fallback"


def test_expansion_conflicts_and_order(spark):
    rows = [(1, "b/use.py", "python", "def entry():\n    return alpha_step()\n"), (2, "a/alpha.py", "python", "def alpha_step():\n    return BETA_CONSTANT\n"), (3, "a/beta.py", "python", "BETA_CONSTANT = 60317\n")]
    got = selector.ask(spark, index_of(spark, rows), "entry", expand=True, canonical=True)
    assert [s.split(":")[0] for s in got["spans"]] == ["a/alpha.py", "a/beta.py", "b/use.py"]
    limits = [(i, f"{d}/limits.py", "python", f"REQUEST_TIMEOUT = {v}\n") for i, (d, v) in enumerate({"billing": 30, "search": 90, "auth": 77, "legacy": 5}.items())]
    index = index_of(spark, limits)
    assert selector.ask(spark, index, "search REQUEST_TIMEOUT", drop_conflicts=True)["spans"] == ["search/limits.py:1-1"]
    assert len(selector.ask(spark, index, "compare REQUEST_TIMEOUT", drop_conflicts=True)["spans"]) == 4


def test_vectors_bridge_what_words_do_not(spark):
    rows = [(1, "billing/worker_limits.py", "python", "MAX_PARALLEL_WORKERS = 3742\n"), (2, "n.py", "python", "X1 = 1\n")]
    vectors = spark.createDataFrame([("billing/worker_limits.py", 0, [1.0, 0.0]), ("n.py", 0, [0.0, 1.0])], "path string, ordinal int, embedding array<float>")
    index = index_of(spark, rows, vectors)
    queries = spark.createDataFrame([(0, "how many threads")], "query_id long, query string")
    near, far = ([(0, [x, 0.1])] for x in (0.99, 0.05))
    schema = "query_id long, query array<float>"
    s = selector.Selector(index)
    assert s.select(queries, spark.createDataFrame(near, schema)).first().spans[0].startswith("billing/")
    assert s.select(queries, spark.createDataFrame(far, schema)).first().status == "fallback_required"


def test_prompt_sections(spark):
    rows = [(0, 0, "entry.py", "def entry():\n    return alpha()\n", 3.0), (0, 1, "alpha.py", "def alpha():\n    return BETA_CONSTANT\n", 0.0), (0, 2, "beta.py", "BETA_CONSTANT = 60317\n", 0.0)]
    rows += [(0, i, f"noise_{i}.py", f"noise_{i} = {i}\n", 0.0) for i in range(3, 20)]
    df = spark.createDataFrame(rows, "query_id long, idx long, name string, content string, score double")
    assert {(r.src, r.dst) for r in prompts.section_graph(df).collect()} >= {(0, 1), (1, 2)}
    assert sorted(r.idx for r in prompts.retrieve(df).collect()) == [0, 1, 2]
    zero = df.withColumn("score", F.lit(0.0))
    assert prompts.retrieve(zero).count() == 20
    named = prompts.boosted(df.withColumn("query", F.lit("what is in beta.py")))
    assert named.where("idx = 2").first().score == 6.0
    assert prompts.literal_fallback(zero.withColumnRenamed("content", "text"), terms=F.array(F.lit("beta_constant"), F.lit("zzz"))).where("idx = 2").first().score == 0.5
    assert prompts.margin(df.withColumn("kept", F.col("idx") == 0)).first().margin == 3.0
    fused = prompts.rescaled_fusion(df.withColumn("lexical", F.col("score")).withColumn("dense", -F.col("idx").cast("double")))
    assert fused.orderBy(F.desc("score")).first().idx == 0
    assert df.select(prompts.truncated(F.lit("a b c d"), 4)).first()[0] == "a b c"


def test_hashed_vectors_have_unit_length(spark):
    rows = spark.createDataFrame([("one two two",), ("",)], "text string")
    got = [sum(x * x for x in r.vector) for r in derive.hashed_vectors(rows, 16).collect()]
    assert abs(got[0] - 1) < 1e-5 and got[1] == 0


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("LIMIT = 3\n")
    (tmp_path / "src" / "b.py").write_text("def check(v):\n    raise RetryLimitError(v)\n")
    store = str(tmp_path / "store")
    assert main(["compile", str(tmp_path / "src"), store]) == 0
    assert main(["update", str(tmp_path / "src"), store]) == 0 and '"unchanged": 2' in capsys.readouterr().out
    assert main(["query", store, "LIMIT"]) == 0 and "a.py:1-1" in capsys.readouterr().out
    assert main(["verify", store]) == 0 and main(["stats", store]) == 0
    asked = spark.createDataFrame([(0, "When is RetryLimitError raised?")], "query_id long, query string")
    stored = selector.Index.of_store(Store(spark, store))
    channels = selector.Selector(stored).channels(asked, 60)
    assert ("relation", "b.py") in {(r.channel, r.path) for r in channels.collect()}
    plan = channels._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all(text" not in plan  # nothing is tokenised again
    derived = selector.Index(stored.blocks, documents.scan_tree(spark, str(tmp_path / "src")).withColumn("doc_id", F.lit(0)))
    same = lambda a, b: integrity.same_rows(a, b.select(*a.columns)).count() == 0
    assert same(stored.postings, derived.postings) and same(stored.relations, derived.relations)
