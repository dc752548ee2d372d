"""Columns of a table that are named like the operators' helpers keep their values, and change no result."""

import pytest
from pyspark.sql import functions as F

from quillstone.llm import jaccard, lines, mixing, perplexity, phrases, pii, resample, sharding, wand, webp

HELPERS = (
    "__key", "__lang", "__half", "__low", "__high", "__units", "__unit", "__source", "__whole", "__due", "__unit_source", "__unit_of", "__extra", "__s", "__u",
    "__site", "__body", "__lines", "__flags", "__kept", "__line", "__n", "__total", "__page", "__row", "__words", "low", "high", "unit", "share", "rest", "chunk", "no", "th",
)
DOCS = [(i, f"word{i} some text of document number {i % 7} " * 12 + f"\nmenu\nline {i}", "en", f"s{i % 2}") for i in range(24)]
PASSING = {
    "judge": perplexity.judge,
    "mix_sources": mixing.mix_sources,
    "keep_first": jaccard.keep_first,
    "drop_site_lines": lambda df: lines.drop_site_lines(df, F.col("source"), F.col("text"), max_ratio=0.5, min_pages=2),
}
IGNORING = {
    "cut_repeats": phrases.cut_repeats,
    "find_private": pii.find_private,
    "shard_documents": lambda df: sharding.shard_documents(df, n_shards=2),
    "near_duplicates": jaccard.near_duplicates,
    "resample": lambda df: resample.resample(df, df.select("text").limit(3)),
    "search": lambda df: wand.search(wand.Index.of(df), df.limit(3).selectExpr("doc_id AS item_id", "text")),
    "measure_media": lambda df: webp.measure_media(webp.store_texts(df)),
}


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string").coalesce(2)
    return plain, plain.withColumns({h: F.concat(F.lit(h + " "), F.col("doc_id").cast("string")) for h in HELPERS})


def rows(df, columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("name", sorted(PASSING))
def test_columns_pass_through(docs, name):
    plain, named = docs
    want, got = PASSING[name](plain), PASSING[name](named)
    assert set(got.columns) == set(want.columns) | set(HELPERS)
    assert rows(got, want.columns) == rows(want, want.columns)
    assert all(r[h] == f"{h} {r.doc_id}" for r in got.collect() for h in HELPERS)


@pytest.mark.parametrize("name", sorted(IGNORING))
def test_columns_are_ignored(docs, name):
    plain, named = docs
    want, got = IGNORING[name](plain), IGNORING[name](named)
    assert got.columns == want.columns and rows(got, want.columns) == rows(want, want.columns)
