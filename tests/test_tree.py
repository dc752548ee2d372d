"""A mounted tree is read so that it fails closed."""

import os

import pytest
from pyspark.sql import functions as F

from quillstone.sources import documents, tree
from quillstone.sources.tree import Limits, Listed, SourceError


@pytest.fixture
def root(tmp_path):
    top = tmp_path / "src"
    (top / "a" / "deep").mkdir(parents=True)
    (top / "node_modules").mkdir()
    (top / ".hidden").mkdir()
    for name, text in {"x.py": "A = 1\n", "a/y.md": "# é\n", "a/deep/z.txt": "z", "node_modules/n.js": "no", ".hidden/h.txt": "no", "empty.txt": "", "image.png": "no", ".env": "no", "a/secret.txt": "no"}.items():
        (top / name).write_text(text, encoding="utf-8")
    return top


def test_rows_equal_those_of_the_other_scan(spark, root):
    got, want = tree.checked_tree(spark, str(root)), documents.scan_tree(spark, str(root))
    rows = lambda df: sorted((r.path, r.text, r.sha256, r["size"], r.language) for r in df.collect())
    assert rows(got) == rows(want) and len(rows(got)) == 3
    assert {r.path: r.mtime_ns for r in got.collect()}["x.py"] == os.stat(root / "x.py").st_mtime_ns
    assert rows(tree.checked_tree(spark, "file://" + str(root))) == rows(want)


def test_partitions_follow_sizes(spark, root, monkeypatch):
    reader = tree._Reader(str(root), Limits())
    monkeypatch.setattr(tree, "PARTITION_BYTES", 1)
    parts = reader.partitions()
    assert sorted(f.path for p in parts for f in p.files) == ["a/deep/z.txt", "a/y.md", "x.py"] and len([p for p in parts if p.files]) == 3
    assert [r[0] for p in parts for r in reader.read(p)]


@pytest.mark.parametrize("limits,error", [({"max_files": 2}, "limits"), ({"max_source_bytes": 8}, "limits"), ({"max_file_bytes": 5}, "beyond")])
def test_limits(spark, root, limits, error):
    with pytest.raises(SourceError, match=error):
        list(tree.walk(str(root), Limits(**limits)))
    with pytest.raises(Exception, match=error):
        tree.checked_tree(spark, str(root), **limits).collect()


def test_links(spark, root, tmp_path):
    (tmp_path / "out.txt").write_text("outside")
    (root / "in.txt").symlink_to(root / "x.py")
    with pytest.raises(SourceError, match="a link in"):
        list(tree.walk(str(root)))
    inside = Limits(links="contained")
    assert "in.txt" in [f.path for f in tree.walk(str(root), inside)]
    (root / "out.txt").symlink_to(tmp_path / "out.txt")
    with pytest.raises(SourceError, match="a link out"):
        list(tree.walk(str(root), inside))
    (root / "out.txt").unlink()
    (root / "dir").symlink_to(tmp_path)
    assert not any(f.path.startswith("dir") for f in tree.walk(str(root), inside))  # not gone into
    with pytest.raises(SourceError, match="a link in"):
        list(tree.walk(str(root)))
    (tmp_path / "link").symlink_to(root)
    with pytest.raises(SourceError, match="no link"):
        list(tree.walk(str(tmp_path / "link")))
    at = os.stat(tmp_path / "out.txt")
    with pytest.raises(SourceError, match="out of the source"):
        tree.read_checked(str(root), Listed("../out.txt", at.st_size, at.st_mtime_ns))


def test_a_file_that_becomes_a_link_is_not_read(root, tmp_path):
    listed = next(f for f in tree.walk(str(root)) if f.path == "x.py")
    (root / "x.py").rename(root / "moved.py")
    (root / "x.py").symlink_to(root / "moved.py")
    with pytest.raises(SourceError, match="not readable"):
        tree.read_checked(str(root), listed)


def test_changes_between_listing_and_reading_and_while_reading(root, monkeypatch):
    listed = next(f for f in tree.walk(str(root)) if f.path == "x.py")
    assert tree.read_checked(str(root), listed)[1] == "A = 1\n"
    (root / "x.py").write_text("A = 2\n")
    os.utime(root / "x.py", ns=(listed.mtime_ns + 1, listed.mtime_ns + 1))
    with pytest.raises(SourceError, match="changed"):
        tree.read_checked(str(root), listed)
    listed, seen, real = next(f for f in tree.walk(str(root)) if f.path == "x.py"), [], os.fstat

    def stat_and_write(handle):
        out = real(handle)
        if not seen:
            seen.append(1)
            (root / "x.py").write_text("A = 3\nB = 4\n")
        return out

    monkeypatch.setattr(tree.os, "fstat", stat_and_write)
    with pytest.raises(SourceError, match="changed"):
        tree.read_checked(str(root), listed)


@pytest.mark.parametrize("raw,error", [(b"a\0b", "NUL"), (b"\xff\xfe", "UTF-8"), (b"key AKIA" + b"A" * 16, "credential")])
def test_contents(root, raw, error):
    (root / "bad.txt").write_bytes(raw)
    listed = next(f for f in tree.walk(str(root)) if f.path == "bad.txt")
    with pytest.raises(SourceError, match=error):
        tree.read_checked(str(root), listed)


@pytest.mark.parametrize("name", ["CON.txt", "a?b.txt", "X.PY"])
def test_names(root, name):
    (root / name).write_text("x")
    with pytest.raises(SourceError):
        list(tree.walk(str(root)))


def test_a_table_of_paths_is_read_where_it_lies(spark, root):
    known = documents.tree_metadata(spark, str(root)).where("path = 'x.py'").select("path", "size", "mtime_ns")
    assert sorted(r.path for r in documents.scan_tree(spark, str(root), known=known).collect()) == ["a/deep/z.txt", "a/y.md"]
    stale = spark.createDataFrame([("x.py", 6, 5)], "path string, size long, mtime_ns long")
    with pytest.raises(Exception, match="changed"):
        tree.read_listed(str(root), stale).select(F.max("text")).collect()
