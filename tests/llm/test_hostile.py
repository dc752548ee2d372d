"""Inputs on which a careless pattern or cache would hang or lie."""

import time

import pytest
from pyspark.sql import functions as F

from quillstone.llm import lines, perplexity, pii

CASES = {
    "blanks after a cue": "password" + " " * 1_000_000,
    "tabs and a word": "account" + "\t" * 500_000 + "no." + " " * 500_000,
    "cues and blanks": ("secret" + " " * 50) * 20_000,
    "digits": "1" * 1_000_000,
    "dots": "1." * 500_000,
    "pluses": "+1" * 500_000,
    "phone without end": "+1" + "(" * 1_000_000,
    "at signs": "a@" * 500_000,
    "local part": "a" * 1_000_000 + "@",
    "domain": "a@" + "b" * 1_000_000,
    "schemes": "a://" * 250_000,
    "scheme": "a" * 1_000_000 + "://",
    "token starts": "-eyJ" * 250_000,
    "token starts with dots": "-eyJ.a" * 170_000,
    "two parts of a token": "-eyJ" * 120_000 + "." + "a" * 500_000,
    "account numbers": "AB12" * 250_000,
    "key starts": "-sk-" * 250_000,
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_a_megabyte_of_anything_is_read_in_seconds(name):
    pii.find_spans("warm up")
    began = time.process_time()
    pii.find_spans(CASES[name])
    assert time.process_time() - began < 5


def test_values_after_blanks_and_tokens_after_failed_ones_are_found():
    text = "password   :   \"hunter2abc\" and -eyJ" + "a" * 9 + " -eyJ" + "b" * 9 + "." + "c" * 9 + "." + "d" * 9
    assert [(k, text[a:b][:6]) for k, a, b in pii.find_spans(text)] == [("account", "hunter"), ("key", "eyJbbb")]
    assert [k for k, _, _ in pii.find_spans("token no. 12345678")] == ["account"]


@pytest.mark.parametrize("unit", ["<", "<p ", "<!--", "<script ", "</div ", "< p>"])
def test_a_megabyte_of_tags_is_read_in_seconds(spark, unit):
    df = spark.createDataFrame([("x",)], "h string").select(F.repeat(F.lit(unit), 1_000_000 // len(unit)).alias("h"))
    began = time.monotonic()
    df.select(F.length(lines.page_text(F.col("h")))).collect()
    assert time.monotonic() - began < 20


def test_elements_without_an_end_take_the_rest(spark):
    rows = [("a<script>b</script>c<script>d<p>e",), ("a<!-- b",), ("x < y and <p>z",), ("<p <p>q",)]
    got = [r.t for r in spark.createDataFrame(rows, "h string").select(lines.page_text(F.col("h")).alias("t")).collect()]
    assert got == ["ac", "a", "x < y and \nz", "<p \nq"]


def test_scores_do_not_depend_on_what_a_worker_judged_before(spark):
    """The same n-grams with other counts are another model."""
    texts = [" ".join(f"word{(i * j) % 17} and{j % 5}" for j in range(1, 70)) for i in range(1, 20)]
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    more = spark.createDataFrame(rows + rows[:5] * 3, "doc_id long, text string, lang string").coalesce(1)
    small = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    scores = lambda df: sorted((r.doc_id, r.log_ppl) for r in perplexity.judge(df).collect())
    perplexity._tables.clear()
    alone = scores(more)
    assert scores(small) != alone
    assert scores(more) == alone


def test_columns_named_like_bands_pass_through(spark):
    df = spark.createDataFrame([(1, "one two " * 40, "en", 5, "x")], "doc_id long, text string, lang string, low int, high string")
    r = perplexity.judge(df).first()
    assert r.low == 5 and r.high == "x"
