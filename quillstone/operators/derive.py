"""Tables derived from blocks: terms, postings, symbols, assignments, references, raise relations, vectors, chunks."""

from __future__ import annotations

import keyword
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.text import STOPWORDS, analyzed_terms, fold, folded_words, short_hash
from quillstone.session import ship

BLOCK_ID = ["path", "ordinal"]
# Shapes of identifiers, definitions, constants, imports and assignments.
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]{2,}"
DEFINITION = r"(?m)^\s*(?:def|class|function|fn|func|type|struct|interface)\s+([A-Za-z_][A-Za-z0-9_]*)"
CONSTANT = r"(?m)^\s*([A-Z_][A-Z0-9_]{2,})\s*[:=]"
IMPORT = r"(?m)^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))"
ASSIGNMENT = r"(?m)^[ \t]*([A-Z_][A-Z0-9_]{2,})[ \t]*(?::[^=\n]+)?=[ \t]*(.+?)[ \t]*$"


def postings(blocks: DataFrame, terms: Column, *, keys: list[str] = BLOCK_ID) -> DataFrame:
    """(keys, term, tf): counts are combined before the shuffle."""
    return blocks.select(*keys, F.explode(terms).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def lengths(blocks: DataFrame, terms: Column, *, keys: list[str] = BLOCK_ID) -> DataFrame:
    """(keys, dl) by counting terms where they are: no shuffle."""
    return blocks.select(*keys, F.size(terms).cast("long").alias("dl"))


def counted_terms(blocks: DataFrame, terms: Column, columns: list[str]) -> DataFrame:
    """(columns, dl, terms, tfs): a row's terms in order, each once, with their counts, and how many there are in all. Counted in
    the row: no shuffle. Null terms have a null length. ``sort_array`` sorts without a function called for each comparison."""
    held = blocks.select(*columns, F.sort_array(terms).alias("__t")).withColumn("dl", F.size("__t").cast("long"))
    none = F.array().cast("array<int>")
    fresh = F.filter(F.sequence(F.lit(0), F.size("__t") - 1), lambda i: (i == 0) | (F.get("__t", i) != F.get("__t", i - 1)))
    held = held.withColumn("dl", F.when(F.col("__t").isNotNull(), F.col("dl"))).withColumn("__s", F.when(F.size("__t") > 0, fresh).otherwise(none))
    each = F.transform("__s", lambda i: F.get("__t", i))
    counts = F.transform("__s", lambda i, j: F.coalesce(F.get("__s", j + 1), F.size("__t")) - i)
    return held.select(*columns, "dl", F.coalesce(each, F.array().cast("array<string>")).alias("terms"), counts.alias("tfs"))


def text_terms(column: str = "text") -> Column:
    """The folded words of a text: the index terms of prose."""
    return folded_words(F.col(column))


def field_terms(blocks: DataFrame) -> DataFrame:
    """Analysed, folded terms of the three searched fields: f_text, f_name and f_path (the path without its suffix)."""
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    of = lambda c: F.transform(analyzed_terms(c), fold)
    return blocks.withColumns({"f_text": of(F.col("text")), "f_name": of(F.coalesce("name", F.lit(""))), "f_path": of(stem)})


#: How often a term of the text, the name and the path counts.
FIELD_WEIGHTS = (1, 1, 1)


def field_postings(blocks: DataFrame, weights: tuple[int, int, int] = FIELD_WEIGHTS) -> DataFrame:
    """(path, ordinal, term, tf) over the three fields, weighted: one pass over the blocks, one shuffle of combined counts."""
    fields = field_terms(blocks)
    each = F.flatten(F.array(*(F.transform(c, lambda t, w=w: F.struct(t.alias("term"), F.lit(w).alias("w"))) for c, w in zip(("f_text", "f_name", "f_path"), weights, strict=True))))
    return fields.select(*BLOCK_ID, F.explode(each).alias("t")).groupBy(*BLOCK_ID, F.col("t.term").alias("term")).agg(F.sum("t.w").alias("tf"))


def field_lengths(blocks: DataFrame, weights: tuple[int, int, int] = FIELD_WEIGHTS) -> DataFrame:
    """(path, ordinal, dl) over the three fields, weighted: no shuffle."""
    length = sum((F.size(c) * w for c, w in zip(("f_text", "f_name", "f_path"), weights, strict=True)), F.lit(0))
    return field_terms(blocks).select(*BLOCK_ID, length.cast("long").alias("dl"))


def symbols(blocks: DataFrame) -> DataFrame:
    """(keys, symbol, kind): definitions, then constants, then the block's own name, each name once a block."""
    tag = lambda names, kind: F.transform(names, lambda n: F.struct(n.alias("symbol"), F.lit(kind).alias("kind")))
    found = F.concat(
        tag(F.regexp_extract_all("text", F.lit(DEFINITION), F.lit(1)), "definition"),
        tag(F.regexp_extract_all("text", F.lit(CONSTANT), F.lit(1)), "constant"),
        tag(F.when(F.col("name").isNotNull(), F.array("name")).otherwise(F.array().cast("array<string>")), "definition"),
    )
    rows = blocks.select(*BLOCK_ID, F.posexplode(found).alias("at", "s")).select(*BLOCK_ID, "at", "s.*")
    return rows.groupBy(*BLOCK_ID, "symbol").agg(F.min_by("kind", "at").alias("kind"))


def imports(blocks: DataFrame) -> DataFrame:
    found = F.arrays_zip(F.regexp_extract_all("text", F.lit(IMPORT), F.lit(1)).alias("a"), F.regexp_extract_all("text", F.lit(IMPORT), F.lit(2)).alias("b"))
    rows = blocks.select(*BLOCK_ID, F.posexplode(found).alias("at", "m"))
    return rows.select(*BLOCK_ID, "at", F.when(F.col("m.a") != "", F.col("m.a")).otherwise(F.col("m.b")).alias("module"))


def assignments(blocks: DataFrame, pattern: str = ASSIGNMENT, *, keys: list[str] = BLOCK_ID) -> DataFrame:
    """(keys, symbol, value_hash) of constant assignments; a comment after the value is no part of it."""
    found = F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)).alias("symbol"), F.regexp_extract_all("text", F.lit(pattern), F.lit(2)).alias("value"))
    rows = blocks.select(*keys, F.explode(found).alias("m")).select(*keys, "m.symbol", F.trim("m.value").alias("value"))
    rows = rows.where(~F.col("value").startswith("#")).withColumn("value", F.trim(F.regexp_replace("value", r"(?s)\s+#.*$", "")))
    return rows.where("value <> ''").select(*keys, "symbol", short_hash(F.col("value")).alias("value_hash")).distinct()


def references(blocks: DataFrame, definitions: DataFrame, languages: DataFrame | None = None) -> DataFrame:
    """Edges (src, dst) from blocks that use a name to the block that defines it first (by path, then ordinal).

    definitions: (path, ordinal, symbol). Python's keywords and stop words are no names; a block does not refer to itself.
    With ``languages`` (path, language) only files in Python or of no known language refer to anything.
    """
    at = F.struct("path", "ordinal")
    nothing = F.col("symbol").isin(*sorted(keyword.kwlist)) | F.lower("symbol").isin(*sorted(STOPWORDS))
    first = definitions.where(~nothing).groupBy("symbol").agg(F.min(at).alias("dst"))
    if languages is not None:
        spoken = languages.where(F.coalesce(F.col("language"), F.lit("unknown")).isin("python", "unknown")).select("path")
        blocks = blocks.join(spoken, "path", "left_semi")
    used = blocks.select(at.alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(IDENTIFIER), F.lit(0)))).alias("symbol"))
    return used.join(first, "symbol").where("src <> dst").select("src", "dst").distinct()


def _sites(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from quillstone.operators.split import raise_sites

    for batch in batches:
        rows = [(p, *s) for p, t in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True) for s in raise_sites(t or "")]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        types = [pa.string(), pa.int32(), pa.int32(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["path", "lo", "hi", "name"])


def raises(files: DataFrame, blocks: DataFrame) -> DataFrame:
    """(path, ordinal, name): named raise sites and the blocks that contain them: an equi-join on the file with a range."""
    ship(files.sparkSession)
    sites = files.where("language = 'python'").select("path", "text").mapInArrow(_sites, "path string, lo int, hi int, name string")
    inside = (blocks.start_line <= sites.lo) & (sites.hi <= blocks.end_line)
    return blocks.join(sites, (blocks.path == sites.path) & inside).select(blocks.path, "ordinal", sites.name).distinct()


def reused_vectors(blocks: DataFrame, old: DataFrame) -> DataFrame:
    """Blocks (sha256, text, ...) with the vector of an old block of equal text, null where there is none."""
    known = old.groupBy("sha256", "text").agg(F.first("vector").alias("vector"))
    return blocks.join(known, ["sha256", "text"], "left")


def hashed_vectors(blocks: DataFrame, dim: int = 64) -> DataFrame:
    """A stand-in encoder without a model: term counts hashed to ``dim`` places, unit length. Adds ``vector``."""
    at = lambda t: F.pmod(F.xxhash64(t), F.lit(dim))
    sign = lambda t: F.when(F.shiftrightunsigned(F.xxhash64(t), 63) == 0, 1.0).otherwise(-1.0)
    sums = F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda i: F.aggregate(F.filter(F.col("__t"), lambda t: at(t) == i), F.lit(0.0), lambda a, t: a + sign(t)),
    )
    norm = F.sqrt(F.aggregate(F.col("__v"), F.lit(0.0), lambda a, x: a + x * x))
    out = blocks.withColumn("__t", F.slice(text_terms(), 1, 2000)).withColumn("__v", sums)
    return out.withColumn("vector", F.transform("__v", lambda x: F.when(norm > 0, x / norm).otherwise(0.0).cast("float"))).drop("__t", "__v")


def fixed_chunks(files: DataFrame, size: int = 4096, *, key: str = "doc_id") -> DataFrame:
    """(key, ordinal, chunk, hash) of fixed-size runs of a text's bytes."""
    data = F.col("text").cast("binary")
    starts = F.when(F.octet_length("text") > 0, F.sequence(F.lit(0), F.octet_length("text") - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    rows = files.select(key, F.posexplode(F.transform(starts, lambda i: F.substring(data, i + 1, F.lit(size)))).alias("ordinal", "chunk"))
    return rows.withColumn("hash", F.sha2("chunk", 256))


#: Multiplier and increment of the generator that the rolling hash's table comes from.
GEAR = (6364136223846793005, 1442695040888963407)


def gear_table() -> list[int]:
    out, x = [], 1
    for _ in range(256):
        x = (x * GEAR[0] + GEAR[1]) & (1 << 64) - 1
        out.append((x ^ x >> 29) & (1 << 64) - 1)
    return out


def content_chunks(data: bytes, target: int) -> list[bytes]:
    """Content-defined chunks: after target / 2 bytes a cut where the rolling hash's low bits are 0, at 2 * target at last."""
    table, out, start, h = gear_table(), [], 0, 0
    for i, byte in enumerate(data):
        h = (h << 1) + table[byte] & (1 << 64) - 1
        n = i + 1 - start
        if n >= 2 * target or (n >= target // 2 and h & target - 1 == 0):
            out.append(data[start : i + 1])
            start, h = i + 1, 0
    return [*out, data[start:]] if start < len(data) else out


def _content(batches: Iterator[pa.RecordBatch], target: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(k, i, c) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, c in enumerate(content_chunks((t or "").encode(), target))]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (batch.schema.field(0).type, pa.int32(), pa.binary()), strict=True)], ["key", "ordinal", "chunk"])


def defined_chunks(files: DataFrame, target: int = 4096, *, key: str = "doc_id") -> DataFrame:
    """(key, ordinal, chunk, hash) of content-defined chunks: an edit moves the cuts around it only."""
    if target < 64 or target > 1 << 20 or target & target - 1:
        raise ValueError("the target is to be a power of two from 64 to 1048576")
    ship(files.sparkSession)
    kind = dict(files.dtypes)[key]
    rows = files.select(key, "text").mapInArrow(lambda b: _content(b, target), f"key {kind}, ordinal int, chunk binary")
    return rows.withColumnRenamed("key", key).withColumn("hash", F.sha2("chunk", 256))


def chunk_store(chunks: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Chunks to store: one of each hash, less those already known."""
    fresh = chunks.select("hash", "chunk", F.octet_length("chunk").alias("size")).dropDuplicates(["hash"])
    return fresh if known is None else fresh.join(known.select("hash"), "hash", "left_anti")


def orphan_chunks(store: DataFrame, refs: DataFrame) -> DataFrame:
    return store.join(refs.select("hash"), "hash", "left_anti")


def rebuilt(chunks: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """(key, text) from chunks in order."""
    parts = F.array_sort(F.collect_list(F.struct("ordinal", F.hex("chunk").alias("h"))))
    return chunks.groupBy(key).agg(F.unhex(F.array_join(F.transform(parts, lambda p: p["h"]), "")).cast("string").alias("text"))


def anchored_lines(blocks: DataFrame, bits: int = 5) -> DataFrame:
    """Adds ``section`` to lines (path, line_no, line): it rises after each line whose CRC-32 ends in ``bits`` zeros."""
    cut = (F.crc32(F.col("line").cast("binary")).bitwiseAND(F.lit((1 << bits) - 1)) == 0).cast("int")
    order = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("section", F.coalesce(F.sum(cut).over(order), F.lit(0)))
