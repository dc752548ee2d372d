import pytest
from pyspark.sql import functions as F

from quillstone.operators import derive, integrity, messages, telemetry
from quillstone.sources import documents
from quillstone.sources.store import TABLES, Store, compile_tables

SCHEMA = "doc_id long, path string, language string, text string"
FILES = [(1, "a/x.py", "python", "TOKEN = 7\ndef f():\n    return TOKEN\n"), (2, "b/y.md", "markdown", "# T\nbody\n"), (3, "c.txt", "text", "plain words")]


def test_update_equals_rebuild(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.write(spark.createDataFrame(FILES, SCHEMA))
    before = store.manifest()
    assert store.update(spark.createDataFrame(FILES, SCHEMA))["unchanged"] == 3 and store.manifest() == before
    new = [FILES[0], (2, "b/y.md", "markdown", "# T\nother body\n"), (4, "d.txt", "text", "added")]
    assert store.update(spark.createDataFrame(new, SCHEMA)) == {"added": 1, "deleted": 1, "modified": 1, "unchanged": 1}
    fresh = compile_tables(spark.createDataFrame(new, SCHEMA))
    for name in TABLES:
        columns = fresh[name].columns
        assert integrity.same_rows(store.table(name).select(*columns), fresh[name]).count() == 0, name
    assert all(r.n == 0 for r in store.verify().collect())
    other = Store(spark, str(tmp_path / "t"))
    assert other.write(spark.createDataFrame(new, SCHEMA))["root_sha256"] == store.manifest()["root_sha256"] and other.manifest()["rows"] == store.manifest()["rows"]
    assert len(store.manifest()["segments"]) == 2 and store.vacuum() == 0 and store.load_blocks().count() > 0
    store.write(spark.createDataFrame(new, SCHEMA))
    assert store.vacuum() == 2 and store.load_blocks().count() > 0 and len(list((tmp_path / "s").glob("manifest-*.json"))) == 1
    assert store.cached(("q",), lambda: store.load_blocks()) == store.cached(("q",), lambda: 1 / 0)


def test_an_update_writes_and_reads_what_changed_only(spark, tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    for i in range(12):
        (root / f"f{i}.py").write_text(f"LIMIT_{i} = {i}\n")
    store = Store(spark, str(tmp_path / "s"))
    store.write(documents.scan_tree(spark, str(root)).select(F.xxhash64("path").alias("doc_id"), "path", "language", "text", "mtime_ns"))
    assert store.update_tree(str(root)) == {"added": 0, "deleted": 0, "modified": 0, "unchanged": 12} and len(store.manifest()["segments"]) == 1
    (root / "f3.py").write_text("LIMIT_3 = 333\n")
    (root / "f4.py").unlink()
    (root / "new.py").write_text("def g():\n    raise KeyError\n")
    (root / "f5.py").chmod(0)  # an unchanged file that could not be read
    known = store.table("files").select("path", "size", "mtime_ns")
    assert sorted(r.path for r in documents.scan_tree(spark, str(root), known=known).collect()) == ["f3.py", "new.py"]
    assert store.update_tree(str(root)) == {"added": 1, "deleted": 1, "modified": 1, "unchanged": 10}
    last = store.manifest()["segments"][-1]
    for name in TABLES:
        assert {r.path for r in spark.read.parquet(f"{store.root}/{last}/{name}").select("path").collect()} <= {"f3.py", "new.py"}, name
    assert sorted(r.path for r in spark.read.parquet(f"{store.root}/{last}/stale").collect()) == ["f3.py", "f4.py"]
    assert store.manifest()["rows"]["files"] == 12 and [r.name for r in store.table("relations").collect()] == ["keyerror"]
    assert not {r.check: r.n for r in store.verify().collect() if r.n}
    for i in range(8):  # segments are merged in time, and rows stay
        (root / "new.py").write_text("X = " + "1" * (i + 2) + "\n")
        store.update_tree(str(root))
    assert len(store.manifest()["segments"]) < 8 and store.manifest()["rows"]["files"] == 12
    assert not {r.check: r.n for r in store.verify().collect() if r.n}


def test_readers_see_whole_states_and_of_two_writers_one_fails(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    store.write(spark.createDataFrame(FILES, SCHEMA))
    before = store.manifest()
    monkeypatch.setattr(Store, "_publish", lambda self, segments: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        store.update(spark.createDataFrame(FILES[:2], SCHEMA))
    monkeypatch.undo()
    assert store.manifest() == before and store.table("files").count() == 3
    late = Store(spark, store.root)
    monkeypatch.setattr(late, "_numbers", lambda: [0])
    with pytest.raises(ValueError, match="first"):
        late._publish(before["segments"])
    assert store.manifest() == before


def test_changed_rows_are_found_in_any_table(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.write(spark.createDataFrame(FILES, SCHEMA))
    segment = store.manifest()["segments"][0]
    path = f"{store.root}/{segment}/assignments"
    rows = [r.asDict() for r in spark.read.parquet(path).collect()]
    rows[0]["value_hash"] = "0" * 16
    spark.createDataFrame(rows, spark.read.parquet(path).schema).write.mode("overwrite").parquet(path)
    assert {r.check: r.n for r in store.verify().collect() if r.n} == {"file digest": 1}


def test_the_tree_of_digests(spark, monkeypatch):
    digests = spark.range(3000).select(F.col("id").cast("string").alias("path"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    monkeypatch.setattr(integrity, "BRANCH_FILES", 4)
    root = integrity.root_digest(digests).first().root
    assert root == integrity.root_digest(digests.repartition(7)).first().root
    assert root != integrity.root_digest(digests.withColumn("digest", F.when(F.col("path") == "7", "x").otherwise(F.col("digest")))).first().root
    assert root != integrity.root_digest(digests.where("path <> '7'")).first().root


def test_corruption_is_found(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.write(spark.createDataFrame(FILES, SCHEMA))
    blocks = store.table("blocks")
    broken = blocks.withColumn("text", F.concat("text", F.lit(" more")))
    found = {r.check: r.n for r in integrity.violations(broken, store.table("files"), store.table("postings"), derive.field_postings(broken)).collect()}
    assert found["posting missing"] > 0
    assert integrity.root_digest(integrity.file_digests(broken, ["text"])).first() != integrity.root_digest(integrity.file_digests(blocks, ["text"])).first()


def test_scan(spark, tmp_path):
    root = tmp_path / "tree"
    for path, data in {"a.py": b"x = 1", ".git/b.py": b"no", "n/c.md": b"# h", "d.bin": b"\0", "e.txt": b"", "secret_x.txt": b"no"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(data)
    found = documents.scan_tree(spark, str(root))
    assert sorted((r.path, r.language) for r in found.collect()) == [("a.py", "python"), ("n/c.md", "markdown")]
    known = spark.createDataFrame(found.collect(), found.schema)
    (root / "a.py").write_bytes(b"x = 22")
    assert [r.path for r in documents.scan_tree(spark, str(root), known=known).collect()] == ["a.py"]
    (root / "k.txt").write_bytes(b"AKIA" + b"A" * 16)
    with pytest.raises(Exception, match="potential credential"):
        documents.scan_tree(spark, str(root)).collect()
    assert "k.txt" not in [r.path for r in documents.scan_tree(spark, str(root), strict=False).collect()]


@pytest.mark.parametrize("path,ok", [("a/b.txt", True), ("../x", False), ("a//b", False), ("con.txt", False), ("a\\b", False), ("/x", False), ("x.", False)])
def test_portable(spark, path, ok):
    assert spark.createDataFrame([(path,)], "p string").select(documents.portable(F.col("p")).alias("x")).first().x is ok


def test_strict_json(spark):
    rows = spark.createDataFrame([('{"a": 1}',), ("",)], "value string")
    assert documents.strict_json(rows).count() == 1
    for bad in ('{"a": 1, "a": 2}', "[1]", '{"a": NaN}', "{"):
        with pytest.raises(Exception, match="malformed"):
            documents.strict_json(spark.createDataFrame([(bad,)], "value string")).collect()


def test_prompt_blocks(spark):
    df = spark.createDataFrame([("[File: a.py]\nx = 1\n[File: b.py]\ny\n",), ("just text",)], "text string")
    assert sorted((r.idx, r.name, r.content) for r in documents.prompt_blocks(df).collect()) == [(0, "a.py", "x = 1"), (0, "main", "just text"), (1, "b.py", "y")]


def test_redaction(spark):
    df = spark.createDataFrame([({"password": "x", "note": "Bearer abc.def", "k": "sk-" + "a" * 24},)], "m map<string,string>")
    assert df.select(telemetry.redact_map(F.col("m")).alias("m")).first().m == {"password": "[REDACTED]", "note": "Bearer [REDACTED_TOKEN]", "k": "[REDACTED_API_KEY]"}


def test_audit_rejects_unmatched_ids(spark):
    inputs = spark.createDataFrame([(1, "yes", None), (2, "a", "b")], "id long, expected_fact string, forbidden_fact string")
    outputs = spark.createDataFrame([(1, "m", "YES"), (2, "m", "a b")], "id long, mode string, content string")
    usage = spark.createDataFrame([(1, "m", 10, 1), (2, "m", 5, 1)], "id long, mode string, prompt_tokens long, completion_tokens long")
    row = telemetry.audit(inputs, outputs, usage).first()
    assert (row.n, row.passed, row.prompt_tokens) == (2, 1, 15)
    with pytest.raises(Exception, match="unmatched"):
        telemetry.audit(inputs, outputs.where("id = 1"), usage).collect()


def test_trace_compaction_keeps_errors_and_two_lines(spark):
    text = "start\nsecond\nthird\nError: x\n0 matches found error\nabout widgets"
    row = spark.createDataFrame([(text,)], "t string").select(messages.compact_trace(F.col("t"), F.lit("widgets")).alias("c")).first().c
    assert row.text.split("\n")[1:] == ["start", "second", "Error: x", "about widgets"] and row.omitted == 2


def test_compression_stops_at_first_overflow(spark):
    parts = ["alpha " * 200, "beta alpha " * 300, "gamma " * 10]
    df = spark.createDataFrame([("\n\n".join(parts), "alpha beta")], "text string, query string").withColumn("doc_id", F.lit(1))
    assert messages.compress(df, ratio=0.1).first().kept_parts == [1]


def test_stream(spark, sf_dir, tmp_path):
    from quillstone.streaming.traces import event_windows, stream_rollup

    source = tmp_path / "in"
    spark.read.parquet(f"{sf_dir}/events.parquet").write.parquet(str(source))
    out = stream_rollup(spark, str(source), str(tmp_path / "out"), str(tmp_path / "cp"))
    batch = event_windows(spark.read.parquet(str(source)))
    assert 0 < out.count() <= batch.count() and out.select("window_start", "event_type", "n").exceptAll(batch.select("window_start", "event_type", "n")).count() == 0
    telemetry.write_traces(spark.createDataFrame([("sk-" + "b" * 30, 1)], "note string, n int"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).first().note == "[REDACTED_API_KEY]"


def test_the_root_is_that_of_two_digits_at_any_size(spark, monkeypatch):
    import hashlib

    paths = [f"p{i}" for i in range(3000)]
    digests = spark.createDataFrame([(p, hashlib.sha256(p.encode()).hexdigest()) for p in paths], "path string, digest string").repartition(5)
    sha, by = lambda x: hashlib.sha256(x.encode()).hexdigest(), {}
    for p in paths:
        by.setdefault(sha(p)[:2], []).append(f"{len(p)}:{p}={sha(p)}")
    want = sha("\n".join(sorted(f"{b}=" + sha("\n".join(sorted(rows))) for b, rows in by.items())))
    assert integrity.root_digest(digests).first().root == want
    monkeypatch.setattr(integrity, "BRANCH_FILES", 4)  # more files than gathered branches may have
    assert integrity.root_digest(digests).first().root == want
