"""Reading a mounted file tree so that it fails closed: a data source whose partitions are planned from metadata, with limits, no
escape by links, and each file's stamp compared before and after it is read."""

from __future__ import annotations

import hashlib
import os
import re
import stat
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillstone.session import ship
from quillstone.sources.documents import CREDENTIALS, EXCLUDED_DIRS, EXCLUDED_FILE, MAX_FILE_BYTES, RESERVED, SUFFIXES

SCHEMA = "path string, text string, sha256 string, size long, language string, mtime_ns long"
#: Bytes of the files of one partition, about.
PARTITION_BYTES = 64 << 20
_EXCLUDED, _CREDENTIALS = re.compile(EXCLUDED_FILE), [re.compile(p) for p in CREDENTIALS.values()]
_UNSAFE = re.compile(r'[\\:*?"<>|\x00-\x1f]|[. ]$')


class SourceError(ValueError):
    """A tree that is not to be read as it is."""


@dataclass(frozen=True)
class Limits:
    """What a scan takes at most, and whether a link is an error (``refuse``) or, for a file within the tree, followed
    (``contained``)."""

    max_files: int = 1_000_000
    max_file_bytes: int = MAX_FILE_BYTES
    max_source_bytes: int = 1 << 40
    links: str = "refuse"


@dataclass(frozen=True)
class Listed:
    path: str
    size: int
    mtime_ns: int


def _safe(relative: str) -> None:
    for part in relative.split("/"):
        if part in ("", ".", "..") or _UNSAFE.search(part) or part.split(".")[0].lower() in RESERVED:
            raise SourceError(f"not a portable path: {_label(relative)}")


def _label(path: str) -> str:
    """A path to show: without what looks like a credential."""
    for pattern in _CREDENTIALS:
        path = pattern.sub("[credential]", path)
    return path


def local_root(path: str) -> str | None:
    """The folder of a path that every process reads by itself; None for a store that only Spark reads."""
    plain = path.removeprefix("file:")
    return None if re.match(r"[a-z][a-z0-9+.-]*:", plain) else "/" + plain.lstrip("/") if path.startswith("file:") else plain


def walk(root: str, limits: Limits = Limits()) -> Iterator[Listed]:
    """The text files below ``root`` in order of their paths, by metadata alone. Excluded and hidden folders, excluded files, other
    suffixes and empty files are left out; links, paths that are not portable or that differ in case only, and what goes
    beyond the limits are errors, and so is a folder that cannot be listed."""
    if os.path.islink(root) and limits.links == "refuse" or not os.path.isdir(root):
        raise SourceError("the source is to be a folder and no link")
    top, folded, files, total, open_ = os.path.realpath(root), set(), 0, 0, [""]
    while open_:
        base = open_.pop()
        found = sorted(os.scandir(os.path.join(root, base)), key=lambda e: e.name)  # an error ends the scan
        for entry in found:
            relative = f"{base}/{entry.name}" if base else entry.name
            link = entry.is_symlink()
            if link and limits.links == "refuse":
                raise SourceError(f"a link in the source: {_label(relative)}")
            if entry.is_dir(follow_symlinks=False):
                if entry.name not in EXCLUDED_DIRS and not entry.name.startswith("."):
                    _safe(relative)
                    open_.append(relative)
                continue
            suffix = entry.name.rpartition(".")[2].lower() if "." in entry.name else ""
            if suffix not in SUFFIXES or _EXCLUDED.search(entry.name) or (link and entry.is_dir()):
                continue
            _safe(relative)
            if link and os.path.commonpath([top, os.path.realpath(entry.path)]) != top:
                raise SourceError(f"a link out of the source: {_label(relative)}")
            at = entry.stat()
            if not stat.S_ISREG(at.st_mode):
                raise SourceError(f"not a regular file: {_label(relative)}")
            if relative.casefold() in folded:
                raise SourceError(f"paths that differ in case only: {_label(relative)}")
            if at.st_size == 0:
                continue
            folded.add(relative.casefold())
            files, total = files + 1, total + at.st_size
            if at.st_size > limits.max_file_bytes:
                raise SourceError(f"a file beyond {limits.max_file_bytes} bytes: {_label(relative)}")
            if files > limits.max_files or total > limits.max_source_bytes:
                raise SourceError("more files or bytes than the limits allow")
            yield Listed(relative, at.st_size, at.st_mtime_ns)


def _identity(at: os.stat_result) -> tuple:
    return at.st_dev, at.st_ino, at.st_size, at.st_mtime_ns


def read_checked(root: str, file: Listed, limits: Limits = Limits()) -> tuple:
    """A row of SCHEMA: a file's text, if the file is what was listed, stays so while it is read, and is UTF-8 without NUL bytes
    and credentials."""
    full, top = os.path.join(root, file.path), os.path.realpath(root)
    if os.path.commonpath([top, os.path.realpath(full)]) != top:
        raise SourceError(f"a path out of the source: {_label(file.path)}")
    try:
        handle = os.open(full, os.O_RDONLY | (os.O_NOFOLLOW if limits.links == "refuse" else 0))
    except OSError as e:
        raise SourceError(f"not readable: {_label(file.path)}: {e.strerror}") from None
    with os.fdopen(handle, "rb") as f:
        before = os.fstat(f.fileno())
        raw = f.read(limits.max_file_bytes + 1)
        after = os.fstat(f.fileno())
    whole = file.mtime_ns % 1_000_000 == 0  # a listing that knows milliseconds only
    time = before.st_mtime_ns // 1_000_000 * 1_000_000 if whole else before.st_mtime_ns
    if (before.st_size, time) != (file.size, file.mtime_ns) or _identity(before) != _identity(after) or len(raw) != after.st_size:
        raise SourceError(f"changed while it was read: {_label(file.path)}")
    if b"\0" in raw:
        raise SourceError(f"NUL bytes: {_label(file.path)}")
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        raise SourceError(f"not UTF-8: {_label(file.path)}") from None
    if any(p.search(text) for p in _CREDENTIALS):
        raise SourceError(f"potential credential: {_label(file.path)}")
    return file.path, text, hashlib.sha256(raw).hexdigest(), len(raw), SUFFIXES[file.path.rpartition(".")[2].lower()], file.mtime_ns


@dataclass
class _Part(InputPartition):
    files: list[Listed]

    def __init__(self, files: list[Listed]):
        super().__init__(len(files))
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, root: str, limits: Limits):
        self.root, self.limits = root, limits

    def partitions(self) -> list[_Part]:
        """Files by their sizes: a partition of about PARTITION_BYTES. Only names and stamps pass the driver, ``max_files`` at most."""
        parts, held, size = [], [], 0
        for file in walk(self.root, self.limits):
            held.append(file)
            size += file.size
            if size >= PARTITION_BYTES:
                parts.append(_Part(held))
                held, size = [], 0
        return [*parts, _Part(held)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for file in partition.files:
            yield read_checked(self.root, file, self.limits)


class CheckedTree(DataSource):
    """``spark.read.format("checked_tree").load(root)``, with the fields of Limits as options."""

    @classmethod
    def name(cls) -> str:
        return "checked_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        root = local_root(self.options.get("path", ""))
        if not root:
            raise SourceError("a tree is read from a folder that all machines mount")
        kinds = {name: type(value) for name, value in asdict(Limits()).items()}
        return _Reader(root, Limits(**{n: kind(self.options[n]) for n, kind in kinds.items() if n in self.options}))


def checked_tree(spark: SparkSession, root: str, **limits) -> DataFrame:
    """The text files below ``root`` as rows of SCHEMA; see ``walk`` and ``read_checked`` for what fails."""
    ship(spark)
    spark.dataSource.register(CheckedTree)
    return spark.read.format("checked_tree").options(**{k: str(v) for k, v in limits.items()}).load(root)


def read_listed(root: str, listed: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Rows of SCHEMA for a table of files (path, size, mtime_ns) below a mounted folder: the paths stay in the table, and each task
    reads those it has."""
    ship(listed.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = [c.split()[0] for c in SCHEMA.split(", ")], [pa.int64() if c.endswith("long") else pa.string() for c in SCHEMA.split(", ")]
        for batch in batches:
            for file in map(Listed, *(batch.column(c).to_pylist() for c in ("path", "size", "mtime_ns"))):
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(read_checked(root, file, limits), types, strict=True)], names)

    return listed.select("path", "size", "mtime_ns").mapInArrow(read, SCHEMA)
