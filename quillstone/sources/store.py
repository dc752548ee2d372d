"""The compiled store: segments of Parquet tables, and numbered manifests of which the last one counts."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import derive, integrity, split

FORMAT_VERSION, COMPILER_VERSION = "2", "2.0"
TABLES = ("files", "blocks", "postings", "lengths", "symbols", "relations", "assignments")
#: Segments from which on an update merges them.
MAX_SEGMENTS = 8
_MANIFEST = re.compile(r"manifest-(\d{8})\.json$")


def compile_tables(files: DataFrame) -> dict[str, DataFrame]:
    """The tables derived from files (doc_id, path, language, text; size and mtime_ns where a scan gave them): one lineage from
    blocks on. A file's digest covers its rows in all of them."""
    stamped = {"sha256": F.sha2(F.col("text").cast("binary"), 256), "size": F.octet_length("text").cast("long")}
    if "mtime_ns" not in files.columns:
        stamped["mtime_ns"] = F.lit(None).cast("long")
    files = files.withColumns(stamped)
    blocks = split.split_blocks(files)
    made = {
        "blocks": blocks, "postings": derive.field_postings(blocks), "lengths": derive.field_lengths(blocks), "symbols": derive.symbols(blocks),
        "relations": derive.raises(files, blocks), "assignments": derive.assignments(blocks),
    }
    return {"files": files.select("doc_id", "path", "language", "sha256", "size", "mtime_ns"), **made}


def tables_digests(tables: dict[str, DataFrame]) -> DataFrame:
    """(path, digest) of files over all tables; when a file was changed is no part of it."""
    return integrity.table_digests({n: df.drop("mtime_ns", "digest") for n, df in tables.items()})


class Store:
    """Compiled tables below one root. A segment holds the rows of the files that one write compiled, and the paths (``stale``)
    whose rows in earlier segments no longer count. A manifest lists the segments; it gets the next number and is renamed
    into place whole, so a reader sees one state or the other, and of two writers one fails. Old states stay until ``vacuum``.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._cache: dict[tuple, list] = {}

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        at, fs = self._fs(self.root)
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(m[1]) for n in names if (m := _MANIFEST.match(n)))

    def manifest(self) -> dict:
        """The current state's description; refused if written by another format."""
        numbers = self._numbers()
        if not numbers:
            raise ValueError(f"no store at {self.root}")
        row = self.spark.read.schema("value string").text(f"{self.root}/manifest-{numbers[-1]:08d}.json", wholetext=True).first()
        found = json.loads(row["value"])
        if found.get("format_version") != FORMAT_VERSION:
            raise ValueError(f"unsupported format {found.get('format_version')}")
        return found

    def _read(self, segment: str, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{segment}/{name}")

    def table(self, name: str, segments: list[str] | None = None) -> DataFrame:
        """A table's rows: of each segment those whose file no later segment replaces or drops."""
        segments = self.manifest()["segments"] if segments is None else segments
        out = None
        for i, segment in enumerate(segments):
            rows = self._read(segment, name)
            for later in segments[i + 1 :]:
                rows = rows.join(self._read(later, "stale"), "path", "left_anti")
            out = rows if out is None else out.unionByName(rows)
        return out

    def _segment(self, tables: dict[str, DataFrame], stale: DataFrame) -> str:
        """Write a segment; its files carry their digests."""
        name = f"segment-{uuid.uuid4().hex}"
        stale.select("path").write.parquet(f"{self.root}/{name}/stale")
        for t in TABLES[1:]:
            tables[t].write.parquet(f"{self.root}/{name}/{t}")
        whole = {t: self._read(name, t) for t in TABLES[1:]} | {"files": tables["files"].drop("digest")}
        whole["files"].join(tables_digests(whole), "path").write.parquet(f"{self.root}/{name}/files")
        return name

    def _publish(self, segments: list[str]) -> dict:
        numbers = self._numbers()
        number = numbers[-1] + 1 if numbers else 1
        tables = {t: self.table(t, segments) for t in TABLES}
        counted = [df.agg(F.count("*").alias("n"), (F.sum("n_tokens") if t == "blocks" else F.lit(0)).alias("tokens")).select(F.lit(t).alias("t"), "n", "tokens") for t, df in tables.items()]
        every = counted[0]
        for c in counted[1:]:
            every = every.unionByName(c)
        found = {r["t"]: r for r in every.collect()}
        manifest = {
            "format_version": FORMAT_VERSION, "compiler_version": COMPILER_VERSION, "segments": segments, "root_sha256": integrity.root_digest(tables["files"].select("path", "digest")).first()["root"],
            "rows": {t: found[t]["n"] for t in TABLES}, "tokens": found["blocks"]["tokens"] or 0,
        }
        staged, fs = self._fs(f"{self.root}/.manifest-{uuid.uuid4().hex}")
        out = fs.create(staged, True)
        out.write(bytearray(json.dumps(manifest, sort_keys=True), "utf-8"))
        out.close()
        final, _ = self._fs(f"{self.root}/manifest-{number:08d}.json")
        if fs.exists(final) or not fs.rename(staged, final):
            fs.delete(staged, False)
            raise ValueError("another writer published first")
        return manifest

    def _no_paths(self) -> DataFrame:
        return self.spark.createDataFrame([], "path string")

    def write(self, files: DataFrame) -> dict:
        """A new state of these files alone."""
        return self._publish([self._segment(compile_tables(files), self._no_paths())])

    def _checked(self) -> dict:
        manifest = self.manifest()
        if manifest["compiler_version"] != COMPILER_VERSION:
            raise ValueError("the store is of another compiler version")
        return manifest

    def _apply(self, fresh: DataFrame, stale: DataFrame) -> None:
        """Compile ``fresh`` files and let go of ``stale`` paths: what is written follows what changed."""
        segments = [*self._checked()["segments"], self._segment(compile_tables(fresh), stale)]
        if len(segments) >= MAX_SEGMENTS:
            segments = [self._segment({t: self.table(t, segments) for t in TABLES}, self._no_paths())]
        self._publish(segments)

    def update(self, files: DataFrame) -> dict[str, int]:
        """Bring the store to ``files``: only added and modified files are compiled and written; equal input writes nothing."""
        self._checked()
        marked = files.withColumn("sha256", F.sha2(F.col("text").cast("binary"), 256))
        changes = integrity.diff(self.table("files"), marked).persist()
        counts = {s: 0 for s in ("added", "deleted", "modified", "unchanged")}
        counts |= {r["status"]: r["count"] for r in changes.groupBy("status").count().collect()}
        if counts["added"] or counts["deleted"] or counts["modified"]:
            fresh = files.join(changes.where("status IN ('added', 'modified')").select("path"), "path", "left_semi")
            self._apply(fresh, changes.where("status IN ('deleted', 'modified')").select("path"))
        changes.unpersist()
        return counts

    def update_tree(self, root: str, *, strict: bool = True) -> dict[str, int]:
        """Bring the store to the files below ``root`` by their sizes and times: contents of unchanged files are not read, nor
        anything of them written. A file whose stamp changed but not its content counts as modified."""
        from quillstone.sources.documents import scan_tree, tree_metadata

        self._checked()
        known = self.table("files").select("path", "size", "mtime_ns")
        listed = tree_metadata(self.spark, root).select("path", "size", "mtime_ns").persist()
        stamp = lambda df: df.select("path", F.struct("size", "mtime_ns").cast("string").alias("sha256"))
        changes = integrity.diff(stamp(known), stamp(listed)).persist()
        counts = {s: 0 for s in ("added", "deleted", "modified", "unchanged")}
        counts |= {r["status"]: r["count"] for r in changes.groupBy("status").count().collect()}
        if counts["added"] or counts["deleted"] or counts["modified"]:
            fresh = scan_tree(self.spark, root, known=known, strict=strict).select(F.xxhash64("path").alias("doc_id"), "path", "language", "text", "mtime_ns")
            self._apply(fresh, changes.where("status IN ('deleted', 'modified')").select("path"))
        changes.unpersist(), listed.unpersist()
        return counts

    def verify(self) -> DataFrame:
        """(check, n) of broken rules; ``file digest`` counts files whose rows are not those they were compiled to, ``root
        digest`` is 1 if the files are not those of the manifest, ``row counts`` counts tables of another size."""
        manifest = self.manifest()
        tables = {t: self.table(t, manifest["segments"]) for t in TABLES}
        out = integrity.violations(tables["blocks"], tables["files"], tables["postings"], derive.field_postings(tables["blocks"]))
        again = tables_digests(tables).withColumnRenamed("digest", "now")
        wrong = tables["files"].select("path", "digest").join(again, "path", "full").where(~F.col("digest").eqNullSafe(F.col("now")))
        out = out.unionByName(wrong.agg(F.count("*").alias("n")).select(F.lit("file digest").alias("check"), "n"))
        root = integrity.root_digest(tables["files"].select("path", "digest"))
        out = out.unionByName(root.select(F.lit("root digest").alias("check"), (F.col("root") != manifest["root_sha256"]).cast("long").alias("n")))
        sizes = None
        for t, df in tables.items():
            off = df.agg((F.count("*") != manifest["rows"][t]).cast("long").alias("n"))
            sizes = off if sizes is None else sizes.unionByName(off)
        return out.unionByName(sizes.agg(F.sum("n").alias("n")).select(F.lit("row counts").alias("check"), "n"))

    def load_blocks(self, ids: DataFrame | None = None) -> DataFrame:
        """Blocks, of (path, ordinal) ``ids`` only where given, by path and ordinal."""
        blocks = self.table("blocks")
        return (blocks if ids is None else blocks.join(ids, ["path", "ordinal"], "left_semi")).orderBy("path", "ordinal")

    def cached(self, key: tuple, make) -> list:
        """Collected rows of ``make()`` for a key of the current state, the 128 latest kept."""
        key = (self.manifest()["root_sha256"], *key)
        if key in self._cache:
            self._cache[key] = self._cache.pop(key)
        else:
            self._cache[key] = make().collect()
            if len(self._cache) > 128:
                self._cache.pop(next(iter(self._cache)))
        return list(self._cache[key])

    def vacuum(self) -> int:
        """Remove what the current manifest does not name, and vectors of other states; how many segments went."""
        current, last, mine = set(self.manifest()["segments"]), self._numbers()[-1], f"vectors-{self.manifest()['root_sha256'][:32]}-"
        root, fs = self._fs(self.root)
        gone = 0
        for s in fs.listStatus(root):
            name = s.getPath().getName()
            old = (m := _MANIFEST.match(name)) and int(m[1]) < last
            if old or (s.isDirectory() and name not in current and not name.startswith(mine)):
                fs.delete(s.getPath(), True)
                gone += s.isDirectory() and not name.startswith("vectors-")
        return gone
