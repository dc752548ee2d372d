"""Sources of text files: tables of documents or pages, and file trees."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Languages by file suffix, directories and files that a scan leaves out, credential shapes.
SUFFIXES = {
    "py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript",
    "go": "go", "rs": "rust", "java": "java", "rb": "ruby", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "cs": "csharp",
    "php": "php", "sh": "shell", "md": "markdown", "rst": "rst", "txt": "text", "json": "json", "yaml": "yaml",
    "yml": "yaml", "toml": "toml", "ini": "ini", "cfg": "ini", "sql": "sql", "html": "html", "css": "css",
}
EXCLUDED_DIRS = (
    ".git", ".hg", ".svn", ".venv", "venv", "env", "node_modules", "__pycache__", ".pytest_cache", ".ruff_cache",
    ".mypy_cache", "dist", ".tox", ".idea", ".vscode", "secrets", ".aws", ".ssh", ".azure", ".gcloud",
)
EXCLUDED_FILE = (
    r"(?i)(^\.env($|\.)|(^|[._-])secret|credential|(^|[._-])token(s)?\.json$|"
    r"\.(pem|key|p12|pfx|pyc|so|dll|dylib|bin)$|^id_(rsa|ed25519))"
)
CREDENTIALS = {
    "nvidia": r"nvapi-[A-Za-z0-9_-]{30,}",
    "openai": r"\bsk-(?:proj-|svcacct-)?[A-Za-z0-9_-]{20,}",
    "aws": r"(?:AKIA|ASIA)[0-9A-Z]{16}",
    "github": r"(?:gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{30,})",
    "private_key": r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----",
}
MAX_FILE_BYTES = 2 << 20


def document_files(docs: DataFrame) -> DataFrame:
    """(doc_id, path, language, text) of a documents table: one text file a row, at source/lang/doc_id."""
    path = F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".txt"))
    return docs.select("doc_id", path.alias("path"), F.lit("text").alias("language"), "text")


def language_of(path: Column) -> Column:
    """The language of a path's suffix; null for suffixes that no scan reads."""
    table = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))


def excluded(path: Column) -> Column:
    """Whether a scan leaves a relative path out: an excluded or hidden directory above it, or an excluded file name."""
    parts = F.split(path, "/")
    above = F.slice(parts, 1, F.size(parts) - 1)
    hidden = F.exists(above, lambda p: p.isin(*EXCLUDED_DIRS) | p.startswith("."))
    return hidden | F.element_at(parts, -1).rlike(EXCLUDED_FILE)


def has_credential(text: Column) -> Column:
    out = F.lit(False)
    for pattern in CREDENTIALS.values():
        out = out | text.rlike(pattern)
    return out


def masked(text: Column) -> Column:
    """Text with recognised credentials replaced by a label."""
    for pattern in CREDENTIALS.values():
        text = F.regexp_replace(text, pattern, "[credential]")
    return text


def _listed(spark: SparkSession, root: str, paths: list[str] | None = None, *, content: bool) -> DataFrame:
    reader = spark.read.format("binaryFile")
    found = reader.option("recursiveFileLookup", True).load(root) if paths is None else reader.load(paths)
    prefix = re.sub(r"/+$", "", root)
    relative = F.regexp_replace(F.col("path"), "^(?:[a-z]+:)?/*" + re.escape(prefix.split(":", 1)[-1].lstrip("/")) + "/", "")
    nanos = (F.unix_micros("modificationTime") * 1000).alias("mtime_ns")
    found = found.select(F.col("path").alias("uri"), relative.alias("path"), F.col("length").alias("size"), nanos, *([F.col("content")] if content else []))
    return found.withColumn("language", language_of(F.col("path"))).where(F.col("language").isNotNull() & ~excluded(F.col("path")) & (F.col("size") > 0))


def tree_metadata(spark: SparkSession, root: str) -> DataFrame:
    """(uri, path, size, mtime_ns, language) of the files below ``root`` that a scan takes; no content is read."""
    return _listed(spark, root, content=False)


def scan_tree(spark: SparkSession, root: str, *, known: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """The text files below ``root``: path (relative), text, sha256, size, language, mtime_ns.

    Files of other suffixes, excluded files and empty files are left out. A file over MAX_FILE_BYTES, with a NUL, not in
    UTF-8 or with a credential fails the scan where ``strict``; else it is left out. With ``known`` (path, size, mtime_ns)
    only files whose size or time differs are opened: metadata is compared first. Below a mounted folder the paths that
    differ stay in a table, and tasks read what they have (strictly, see ``tree.read_checked``); in a store that only Spark
    reads, or where not ``strict``, they are listed by the driver for its reader. ``tree.checked_tree`` scans a mounted tree with
    limits.
    """
    from quillstone.sources.tree import local_root, read_listed

    same = ["path", "size", "mtime_ns"]
    if known is not None and strict and (mounted := local_root(root)):
        return read_listed(mounted, tree_metadata(spark, root).join(known.select(*same), same, "left_anti"))
    if known is None:
        files = _listed(spark, root, content=True)
    else:
        changed = [r["uri"] for r in tree_metadata(spark, root).join(known.select(*same), same, "left_anti").select("uri").collect()]
        files = _listed(spark, root, changed, content=True) if changed else _listed(spark, root, content=True).where("false")
    text = F.try_validate_utf8(F.col("content").cast("string"))
    files = files.withColumn("text", text)
    reason = (
        F.when(F.col("size") > MAX_FILE_BYTES, "too large")
        .when(F.col("text").isNull(), "not UTF-8")
        .when(F.instr("text", "\0") > 0, "NUL byte")
        .when(has_credential(F.col("text")), "potential credential")
    )
    if strict:
        label = F.concat(reason, F.lit(": "), masked(F.col("path")))
        files = files.withColumn("text", F.when(reason.isNull(), F.col("text")).otherwise(F.raise_error(label).cast("string")))
    else:
        files = files.where(reason.isNull())
    return files.select("path", "text", F.sha2("content", 256).alias("sha256"), "size", "language", "mtime_ns")


def case_collisions(files: DataFrame) -> DataFrame:
    """Paths that differ in case only: (folded, n)."""
    return files.groupBy(F.lower("path").alias("folded")).agg(F.count("*").alias("n")).where("n > 1")


# Device names that are no portable file names.
RESERVED = ("con", "prn", "aux", "nul", *(f"com{i}" for i in range(1, 10)), *(f"lpt{i}" for i in range(1, 10)))


def portable(path: Column) -> Column:
    """Whether a relative path is safe on any system: no empty, dot or reserved part, no drive, backslash or control."""
    parts = F.split(path, "/")
    bad = F.exists(
        parts,
        lambda p: p.isin("", ".", "..") | F.lower(F.regexp_extract(p, r"^([^.]*)", 1)).isin(*RESERVED) | p.rlike(r"[. ]$"),
    )
    return (F.length(path) > 0) & ~bad & ~path.rlike(r'[\\:*?"<>|\x00-\x1f]') & ~path.startswith("/")


def strict_json(lines: DataFrame, column: str = "value") -> DataFrame:
    """Parsed JSON objects of a column of lines as VARIANT ``row``; blank lines go, any other malformed line fails.

    Duplicate keys, NaN and infinities and top levels other than objects are malformed.
    """
    parsed = F.try_parse_json(F.col(column))
    ok = parsed.isNotNull() & F.schema_of_variant(parsed).startswith("OBJECT")
    bad = F.raise_error(F.concat(F.lit("malformed JSON object: "), F.substring(column, 1, 80))).cast("string")
    rows = lines.where(F.trim(F.col(column)) != "")
    return rows.select(F.parse_json(F.when(ok, F.col(column)).otherwise(bad)).alias("row"))


def prompt_blocks(df: DataFrame, column: str = "text") -> DataFrame:
    """Sections of one prompt: ``[File: name]`` heads, else fenced ``File:`` blocks, else markdown heads, else one ``main``.

    Adds idx, name and content; a text's first form with a match is the one used.
    """
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    pair = lambda pattern: F.transform(
        F.arrays_zip(
            F.regexp_extract_all(column, F.lit(pattern), F.lit(1)).alias("name"),
            F.regexp_extract_all(column, F.lit(pattern), F.lit(2)).alias("content"),
        ),
        lambda p: F.struct(strip(p["name"]).alias("name"), strip(p["content"]).alias("content")),
    )
    heads = pair(r"(?s)\[File:\s*([^\]]+)\]\s*\n(.*?)(?=\n\[File:|\z)")
    fenced = pair(r"(?s)File:\s*([^\n]+)\n```[A-Za-z0-9_-]*\n(.*?)\n```")
    titles = pair(r"(?ms)^(#{1,3}\s+[^\n]+)\n(.*?)(?=^#{1,3}\s|\z)")
    main = F.array(F.struct(F.lit("main").alias("name"), F.col(column).alias("content")))
    chosen = F.when(F.size(heads) > 0, heads).when(F.size(fenced) > 0, fenced).when(F.size(titles) > 0, titles).otherwise(main)
    return df.select("*", F.posexplode(chosen).alias("idx", "b")).select(*df.columns, "idx", "b.name", "b.content")
