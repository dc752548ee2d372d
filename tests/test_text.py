import re

import pytest
from pyspark.sql import functions as F

from quillstone.functions import text as T

CASES = ["", "a", "abcdefgh", "a😀b", "été", "x" * 4801, "one\r\ntwo\rthree\n", "a\fb c\n\n", "HTTPServer2Error parse_URLValue snake_case", "`a.b` and `x` of the", "plain"]


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r["x"] for r in df.select("i", expr(F.col("t")).alias("x")).orderBy("i").collect()]


def test_token_estimates(spark):
    assert column(spark, CASES, T.product_tokens) == [max(1, len(t) // 4) for t in CASES]
    assert column(spark, CASES, T.legacy_tokens) == [max(1, int(len(t) / 3.8)) if t else 0 for t in CASES]


def test_lines_end_at_cr_and_lf_only(spark):
    def lines(t):
        out = re.split("\r\n|\r|\n", t)
        return out[:-1] if out[-1] == "" else out

    assert column(spark, CASES, T.physical_lines) == [lines(t) for t in CASES]


CAMEL = re.compile(T.CAMEL)


def expected_terms(text):
    out = []
    for word in re.findall(r"\w+", text):
        parts = [p for piece in word.split("_") for p in (CAMEL.findall(piece) if len(CAMEL.findall(piece)) > 1 else [piece])]
        out.append(word.lower())
        if len(parts) > 1:
            out += [p.lower() for p in parts if p and p.lower() != word.lower()]
    return out


def test_analysed_terms(spark):
    cases = [*CASES, "éaB xÉy ABCdef __init__ A1b2"]
    assert column(spark, cases, T.analyzed_terms) == [expected_terms(t) for t in cases]


def test_literals_survive_word_filters(spark):
    assert column(spark, ["use `of.x` now"], T.lexical_terms) == [["use", "of", "x", "now", "of.x"]]
    assert column(spark, ["use `of.x` now"], T.whole_terms) == [["use", "of", "x", "now", "of.x"]]


def test_fold_drops_marks(spark):
    assert column(spark, ["ÉTÉ ñ ß Ø"], T.fold) == ["ete n ß ø"]


@pytest.mark.parametrize("text,expected", [("Foo.bar x ab a_b", ["Foo.bar", "Foo", "bar", "a_b"]), ("no", [])])
def test_identifier_candidates(spark, text, expected):
    assert column(spark, [text], T.identifier_candidates) == [expected]


def test_content_terms_ignore_case_changes(spark):
    assert column(spark, ["the fooBar snake_case v12beta"], T.content_terms) == [["foobar", "snake_case", "v12beta", "snake", "case", "beta"]]
