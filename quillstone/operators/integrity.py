"""Differences, digests and checks of compiled tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import product_tokens
from quillstone.scratch import numbered
from quillstone.session import ship


def diff(old: DataFrame, new: DataFrame, *, key: str = "path", content: str = "sha256") -> DataFrame:
    """(key, status) of every key of two tables: added, deleted, modified or unchanged."""
    a, b = old.select(key, F.col(content).alias("__a"), F.lit(1).alias("__in_a")), new.select(key, F.col(content).alias("__b"), F.lit(1).alias("__in_b"))
    status = (
        F.when(F.col("__in_a").isNull(), "added").when(F.col("__in_b").isNull(), "deleted")
        .when(F.col("__a").eqNullSafe(F.col("__b")), "unchanged").otherwise("modified")
    )
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows (side, n) that one table has and the other has not, as multisets; no rows if the tables are equal."""
    only = lambda x, y, side: x.exceptAll(y.select(*x.columns)).agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "n")
    return only(a, b, "first").unionByName(only(b, a, "second")).where("n > 0")


def framed(*columns: str) -> Column:
    """A row's canonical text: each value with its length before it, nulls told from empty texts."""
    return F.concat_ws("|", *[F.when(F.col(c).isNull(), "n").otherwise(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string"))) for c in columns])


def file_digests(rows: DataFrame, columns: list[str], *, key: str = "path") -> DataFrame:
    """(key, digest): SHA-256 over the sorted hashes of a file's rows."""
    leaves = rows.select(key, F.sha2(framed(*columns).cast("binary"), 256).alias("h"))
    return leaves.groupBy(key).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "").cast("binary"), 256).alias("digest"))


#: Files of one of the 256 branches of the tree of digests, about, up to which a branch is gathered; larger ones are streamed.
BRANCH_FILES = 1024


def root_digest(digests: DataFrame, *, key: str = "path") -> DataFrame:
    """One row (root): files' digests are combined by the first two hex digits of the hash of their key, the 256 results in all.

    A branch's digest is the SHA-256 of its files in order. With more than BRANCH_FILES files or so a branch is sorted and
    hashed as a stream, so that no task holds one whole; the root is the same. Tables of equal rows have equal roots."""
    branch = F.substring(F.sha2(F.col(key).cast("string").cast("binary"), 256), 1, 2)
    leaf = F.concat(F.length(F.col(key).cast("string")).cast("string"), F.lit(":"), F.col(key).cast("string"), F.lit("="), F.col("digest"))
    joined = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "\n").cast("binary"), 256)
    leaves = digests.select(branch.alias("branch"), leaf.alias("leaf"))
    if digests.count() > 256 * BRANCH_FILES:
        ship(digests.sparkSession)
        dealt = leaves.where("leaf IS NOT NULL").repartition(256, "branch").sortWithinPartitions("branch", "leaf")
        branches = dealt.mapInArrow(_streamed, "branch string, digest string")
    else:
        branches = leaves.groupBy("branch").agg(joined("leaf").alias("digest"))
    return branches.agg(joined(F.concat("branch", F.lit("="), F.col("digest"))).alias("root"))


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(branch, digest) of rows (branch, leaf) in order: SHA-256 of a branch's leaves, a line feed between them."""
    made = lambda b, h: pa.RecordBatch.from_pydict({"branch": [b], "digest": [h.hexdigest()]})
    now, running = None, None
    for batch in batches:
        for branch, leaf in zip(batch.column("branch").to_pylist(), batch.column("leaf").to_pylist(), strict=True):
            if branch != now:
                if running is not None:
                    yield made(now, running)
                now, running = branch, hashlib.sha256(leaf.encode())
            else:
                running.update(b"\n" + leaf.encode())
    if running is not None:
        yield made(now, running)


def table_digests(tables: dict[str, DataFrame], *, key: str = "path") -> DataFrame:
    """(key, digest): SHA-256 over the sorted hashes of a file's rows in all tables, each under its table's name, columns by
    name: whatever is stored of a file is in its digest."""
    leaves = None
    for name, df in sorted(tables.items()):
        rows = df.select(key, F.sha2(F.concat(F.lit(f"{name}|"), framed(*sorted(df.columns))).cast("binary"), 256).alias("h"))
        leaves = rows if leaves is None else leaves.unionByName(rows)
    return leaves.groupBy(key).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "").cast("binary"), 256).alias("digest"))


def violations(blocks: DataFrame, files: DataFrame, postings: DataFrame, fresh: DataFrame, *, key: str = "path") -> DataFrame:
    """(check, n): rows that break a rule of the store, for each rule; postings are compared with ``fresh`` ones in one pass.

    blocks: (key, ordinal, kind, start_line, end_line, text, n_tokens); files: (key, ...); postings: (key, ordinal, term, tf). ``key``
    tells files apart; a null is a key as any other. Files with a ``text`` need a block only where this is not blank."""
    block = [key, "ordinal"]

    def without(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
        b = b.select(*(F.col(c).alias(f"__{c}") for c in columns))
        return a.join(b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in columns], "left_anti")

    def count(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")

    lines = F.size(F.split("text", "\n"))
    sides = [df.select(*block, "term", F.col("tf").cast("long").alias("tf"), F.lit(s).alias("s")) for df, s in ((postings, 1), (fresh, -1))]
    unequal = sides[0].unionByName(sides[1]).groupBy(*block, "term", "tf").agg(F.sum("s").alias("s"))
    unequal = unequal.agg(F.count(F.when(F.col("s") < 0, 1)).alias("missing"), F.count(F.when(F.col("s") > 0, 1)).alias("unfounded"))
    unequal = unequal.select(F.explode(F.array(*(F.struct(F.lit(f"posting {c}").alias("check"), F.col(c).alias("n")) for c in ("missing", "unfounded")))).alias("x")).select("x.*")
    told = files.where(F.col("text").rlike(r"\S")) if "text" in files.columns else files
    out = [
        count(without(blocks, files, [key]), "block without file"),
        count(without(told, blocks, [key]), "file without block"),
        count(blocks.where((F.col("start_line") < 1) | (F.col("end_line") - F.col("start_line") + 1 != lines)), "span geometry"),
        count(blocks.where(F.col("n_tokens") != product_tokens(F.col("text"))), "token estimate"),
        count(blocks.groupBy(*block).agg(F.count("*").alias("c")).where("c > 1"), "ordinal twice"),
        without(postings.groupBy(*block).agg(F.count("*").alias("c")), blocks, block)
        .agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n")).select(F.lit("posting without block").alias("check"), "n"),
        unequal,
    ]
    all_rows = out[0]
    for x in out[1:]:
        all_rows = all_rows.unionByName(x)
    return all_rows


def contracts(rows: DataFrame, schema: dict[str, str], rules: dict[str, Column]) -> DataFrame:
    """(check, n): columns that are missing, of another type or not foreseen, and rows that break a rule or leave it open."""
    found = dict(rows.dtypes)
    off = sum(found.get(c) != t for c, t in schema.items()) + sum(c not in schema for c in found)
    broken = rows.agg(*(F.count(F.when(~F.coalesce(rule, F.lit(False)), 1)).alias(name) for name, rule in rules.items()))
    each = F.array(F.struct(F.lit("schema").alias("check"), F.lit(off).cast("long").alias("n")), *(F.struct(F.lit(n).alias("check"), F.col(n).alias("n")) for n in rules))
    return broken.select(F.explode(each).alias("x")).select("x.*")


def reuse_blocks(old: DataFrame, new: DataFrame) -> DataFrame:
    """New blocks (path, ordinal, kind, name, text) with the old block (old_path, old_ordinal) of equal kind, name and
    text that each takes over, one for one in order; null where there is none left.

    Blocks are compared by the SHA-256 of these, so that texts stay out of sorts; places among equal ones come of a range sort,
    so that no task sorts all copies of a block."""
    same = F.sha2(framed("kind", "name", "text").cast("binary"), 256).alias("__h")
    a, b = ((df.select(same, "path", "ordinal")) for df in (old, new))
    a, b = (_among_equals(df) for df in (a, b))
    met = b.join(a.select("__h", "__n", F.col("path").alias("old_path"), F.col("ordinal").alias("old_ordinal")), ["__h", "__n"], "left")
    return new.join(met.select("path", "ordinal", "old_path", "old_ordinal"), ["path", "ordinal"])


def _among_equals(rows: DataFrame) -> DataFrame:
    """Adds ``__n`` to (__h, path, ordinal): a row's place among those of its hash."""
    at = numbered(rows, [F.col(c) for c in rows.columns], "__at")
    several = at.groupBy("__h").agg(F.min("__at").alias("__first"), F.count("*").alias("__c")).where("__c > 1").drop("__c")
    return at.join(several, "__h", "left").withColumn("__n", F.col("__at") - F.coalesce("__first", F.col("__at")))
