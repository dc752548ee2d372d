"""Queries of prompt sections, symbols, answers and equal tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import decide, derive, integrity, prompts
from quillstone.plans.common import table
from quillstone.plans.structure import modules

Q: dict = {}
SQL: dict = {}


def section_scores(spark: SparkSession, d: str) -> DataFrame:
    """The turns of a conversation as sections of its first turn's question: scores with names boosted, with literal terms where none
    scores, and fused with another one."""
    turns = table(spark, d, "conversations")
    asked = turns.groupBy("conv_id").agg(F.min_by("text", "turn").alias("query"))
    rows = turns.join(asked, "conv_id").select(
        F.col("conv_id").alias("query_id"), F.col("turn").alias("idx"), F.col("role").alias("name"), "text", "query",
        F.when(F.col("conv_id") % 3 == 0, 0.0).otherwise((F.length("text") % 7).cast("double")).alias("score"), (F.length("text") % 5).cast("double").alias("dense"),
    )
    terms = F.filter(F.split(F.lower("query"), "[^a-z]+"), lambda t: F.length(t) > 3)
    out = prompts.boosted(rows).select("query_id", "idx", F.round("score", 6).alias("boosted"))
    literal = prompts.literal_fallback(rows, terms=terms).select("query_id", "idx", F.round("score", 6).alias("literal"))
    fused = prompts.rescaled_fusion(rows.withColumnRenamed("score", "lexical")).select("query_id", "idx", F.round("score", 6).alias("fused"))
    return out.join(literal, ["query_id", "idx"]).join(fused, ["query_id", "idx"])


SQL["section_scores"] = """WITH a AS (SELECT conv_id, arg_min(text, turn) AS query FROM conversations GROUP BY conv_id),
r AS (SELECT c.conv_id, turn, role, text, query, CASE WHEN c.conv_id % 3 = 0 THEN 0.0 ELSE length(text) % 7 END::DOUBLE AS s, (length(text) % 5)::DOUBLE AS dense,
  list_filter(string_split_regex(lower(query), '[^a-z]+'), lambda t: length(t) > 3) AS ts FROM conversations c JOIN a ON a.conv_id = c.conv_id),
k AS (SELECT *, max(s) OVER w AS top, min(s) OVER w AS least, row_number() OVER (PARTITION BY conv_id ORDER BY s DESC, turn) - 1 AS rl, row_number() OVER (PARTITION BY conv_id ORDER BY dense DESC, turn) - 1 AS rd FROM r WINDOW w AS (PARTITION BY conv_id)),
f AS (SELECT *, 1.0::DOUBLE / (60 + rl) + 1.0::DOUBLE / (60 + rd) AS rr FROM k), g AS (SELECT *, min(rr) OVER (PARTITION BY conv_id) AS lo, max(rr) OVER (PARTITION BY conv_id) AS hi FROM f)
SELECT conv_id AS query_id, turn AS idx, round(s + CASE WHEN contains(lower(query), lower(role)) THEN 2.0 * top ELSE 0 END, 6) AS boosted,
round(CASE WHEN top <= 0 THEN len(list_filter(ts, lambda t: contains(lower(text), t)))::DOUBLE / greatest(len(ts), 1) ELSE s END, 6) AS literal,
round(CASE WHEN hi > lo THEN least + (rr - lo) / (hi - lo) * (top - least) ELSE top END, 6) AS fused FROM g"""


def symbol_table(spark: SparkSession, d: str) -> DataFrame:
    """The symbols of a module made for each document, by what defines them, and the modules that they import."""
    files = modules(spark, d).select("path", F.lit(0).alias("ordinal"), "text", F.col("path").alias("name"))
    plain = lambda c: F.regexp_replace(c, r"\d+", "")
    found = derive.symbols(files).select(plain("symbol").alias("symbol"), "kind")
    taken = derive.imports(files).select(plain("module").alias("symbol"), F.lit("import").alias("kind"))
    return found.unionByName(taken).groupBy("symbol", "kind").agg(F.count("*").alias("n"))


SQL["symbol_table"] = """SELECT symbol, kind, count(*) AS n FROM documents, (VALUES ('f', 'definition'), ('g', 'definition'), ('C', 'definition'), ('__init__', 'definition'), ('run', 'definition'), ('step', 'definition'),
('LIMIT', 'constant'), ('pkg/m.py', 'definition'), ('pkg.m', 'import')) v(symbol, kind) GROUP BY ALL"""


def answer_checks(spark: SparkSession, d: str) -> DataFrame:
    """Answers as JSON against wanted ones, by type and by value: a number, the same with a fraction, a text, a boolean, an object."""
    n = F.col("event_id").cast("string")
    forms = F.array(n, F.concat(n, F.lit(".0")), F.concat(F.lit('"'), n, F.lit('"')), F.lit("true"), F.col("props"))
    got = F.when(F.col("event_id") % 5 == 4, F.col("props")).otherwise(n)
    rows = table(spark, d, "events").select("event_id", F.parse_json(got).alias("got"), F.parse_json(F.get(forms, (F.col("event_id") % 5).cast("int"))).alias("wanted"))
    return rows.select("event_id", decide.same_answer(F.col("got"), F.col("wanted")).alias("same_answer"), decide.same_number(F.col("got"), F.col("wanted")).alias("same_number"))


SQL["answer_checks"] = "SELECT event_id, event_id % 5 IN (0, 4) AS same_answer, event_id % 5 IN (0, 1, 4) AS same_number FROM events"


def table_differences(spark: SparkSession, d: str) -> DataFrame:
    """Rows of documents' sources and languages that one of two overlapping halves has and the other has not, as multisets."""
    rows = table(spark, d, "documents").select("doc_id", "source", "lang")
    half = lambda part: rows.where(part).select("source", "lang")
    return integrity.same_rows(half(F.col("doc_id") % 3 < 2), half(F.col("doc_id") % 3 > 0))


SQL["table_differences"] = """WITH a AS (SELECT source, lang FROM documents WHERE doc_id % 3 < 2), b AS (SELECT source, lang FROM documents WHERE doc_id % 3 > 0)
SELECT * FROM (SELECT 'first' AS side, count(*) AS n FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'second', count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) WHERE n > 0"""

for _f in (section_scores, symbol_table, answer_checks, table_differences):
    Q[_f.__name__] = _f
