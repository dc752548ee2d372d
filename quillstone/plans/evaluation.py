"""Queries of evaluation reports and of query views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions.text import STOPWORDS
from quillstone.operators import decide as D, derive, evaluate as E, integrity, messages as M, retrieval as R, telemetry as T, views as V
from quillstone.plans.common import BLOCKS, benchmark_queries, benchmark_terms, block_shelf, block_table, blocks, document_shelf, files, table
from quillstone.scratch import if_small, written

Q: dict = {}
SQL: dict = {}


def _observations(spark: SparkSession, d: str) -> DataFrame:
    """Customers as tasks of four methods at two budgets, with outcomes by arithmetic on their keys."""
    arms = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("m")
    rows = table(spark, d, "customer").select("c_custkey", "c_nationkey", arms).select("*", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("b"))
    k, m, b = (F.col(c).cast("long") for c in ("c_custkey", "m", "b"))
    selected = b * 400 + (k * 31 + m) % 100
    transport = (k + 3 * m + b) % 11 != 0
    return rows.select(
        k.alias("task"), F.concat(F.lit("m"), F.col("m").cast("string")).alias("method"), (b * 512).alias("budget"), (F.col("c_nationkey").cast("long") % 3).alias("category"),
        transport.alias("transport"), (transport & ((k * 7 + m * 5 + b * 3) % 10 < 4 + m)).alias("success"), ((k + m) % 13 == 0).alias("parse_error"), ((k * b) % 17 == 0).alias("length_hit"),
        selected.alias("selected_tokens"), F.when(k % 19 != 0, selected + 50).alias("input_tokens"), ((k * 17 + m * 7) % 1000 / 8.0).alias("latency"),
        F.concat_ws("-", (k % 100).cast("string"), F.col("b").cast("string")).alias("request"), F.when(~((m == 3) & (k % 50 == 0)), selected * 2).alias("quote"), (k % 4 > m).alias("evidence"),
    )


_OBS = """obs AS (SELECT c_custkey AS task, concat('m', m) AS method, (b * 512)::BIGINT AS budget, c_nationkey % 3 AS category, (c_custkey + 3 * m + b) % 11 <> 0 AS transport,
 (c_custkey + 3 * m + b) % 11 <> 0 AND (c_custkey * 7 + m * 5 + b * 3) % 10 < 4 + m AS success, (c_custkey + m) % 13 = 0 AS parse_error, (c_custkey * b) % 17 = 0 AS length_hit,
 b * 400 + (c_custkey * 31 + m) % 100 AS selected_tokens, CASE WHEN c_custkey % 19 <> 0 THEN b * 400 + (c_custkey * 31 + m) % 100 + 50 END AS input_tokens,
 ((c_custkey * 17 + m * 7) % 1000) / 8.0::DOUBLE AS latency, concat(c_custkey % 100, '-', b) AS request, CASE WHEN NOT (m = 3 AND c_custkey % 50 = 0) THEN 2 * (b * 400 + (c_custkey * 31 + m) % 100) END AS quote,
 c_custkey % 4 > m AS evidence
 FROM customer, (VALUES (0), (1), (2), (3)) a(m), (VALUES (1), (2)) e(b))"""


def arm_summary(spark: SparkSession, d: str) -> DataFrame:
    out = E.arm_summary(_observations(spark, d), keys=["method", "budget"])
    return out.withColumns({c: F.round(c, 6) for c in ("success_rate", "mean_selected", "mean_input", "median_input", "median_latency")})


SQL["arm_summary"] = f"""WITH {_OBS} SELECT method, budget, count(*) AS planned, count(*) FILTER (WHERE transport) AS completed, count(*) FILTER (WHERE transport AND success) AS successes,
round(count(*) FILTER (WHERE transport AND success) / count(*) FILTER (WHERE transport), 6) AS success_rate, count(*) FILTER (WHERE NOT transport) AS transport_errors,
count(*) FILTER (WHERE transport AND parse_error) AS parse_errors, count(*) FILTER (WHERE length_hit) AS length_hits, round(avg(selected_tokens), 6) AS mean_selected,
round(avg(input_tokens) FILTER (WHERE transport), 6) AS mean_input, round(quantile_cont(input_tokens, 0.5) FILTER (WHERE transport), 6) AS median_input,
round(quantile_cont(latency, 0.5) FILTER (WHERE transport), 6) AS median_latency, count(DISTINCT request) AS distinct_requests FROM obs GROUP BY ALL"""


def arm_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return E.outcomes(_observations(spark, d), arm="method", baseline="m0", on=["task", "budget"], by=["budget"])


SQL["arm_outcomes"] = f"""WITH {_OBS}, p AS (SELECT a.method, a.budget, a.transport AND b.transport AS ok, a.success AS x, b.success AS y FROM obs a JOIN obs b ON a.task = b.task AND a.budget = b.budget AND b.method = 'm0' WHERE a.method <> 'm0')
SELECT method, budget, count(*) FILTER (WHERE ok AND x AND NOT y) AS wins, count(*) FILTER (WHERE ok AND y AND NOT x) AS losses, count(*) FILTER (WHERE ok AND x = y) AS ties, count(*) FILTER (WHERE NOT ok) AS missing FROM p GROUP BY ALL"""


def corpus_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Budgets stand for corpora: the larger one against the smaller."""
    rows = _observations(spark, d).withColumn("corpus", F.when(F.col("budget") == 512, "base").otherwise("grown"))
    return E.corpus_comparison(rows, baseline="base", keys=["method", "category"])


SQL["corpus_comparison"] = f"""WITH {_OBS}, p AS (SELECT 'grown' AS corpus, a.method, a.category, a.transport AND b.transport AS ok, a.success AS x, b.success AS y, a.request = b.request AS same
 FROM obs a JOIN obs b ON a.task = b.task AND a.method = b.method AND b.budget = 512 WHERE a.budget = 1024)
SELECT corpus, method, category, count(*) FILTER (WHERE ok AND x AND NOT y) AS wins, count(*) FILTER (WHERE ok AND y AND NOT x) AS losses, count(*) FILTER (WHERE ok AND x = y) AS ties, count(*) FILTER (WHERE NOT ok) AS missing,
 count(*) FILTER (WHERE same) AS identical FROM p GROUP BY ALL"""


def failure_split(spark: SparkSession, d: str) -> DataFrame:
    return E.failure_split(_observations(spark, d), keys=["method", "budget"], evidence=F.col("evidence"))


SQL["failure_split"] = f"""WITH {_OBS} SELECT method, budget, task, 'wrong_with_evidence' AS kind FROM obs WHERE evidence AND NOT success
UNION ALL SELECT method, budget, task, 'right_without_evidence' FROM obs WHERE success AND NOT evidence"""


def arm_economics(spark: SparkSession, d: str) -> DataFrame:
    return E.economics(_observations(spark, d), keys=["method", "budget"]).withColumn("mean_input", F.round("mean_input", 6))


SQL["arm_economics"] = f"""WITH {_OBS} SELECT method, budget, count(*) AS planned, count(*) FILTER (WHERE transport) AS completed, count(*) FILTER (WHERE transport AND success) AS passed,
count(DISTINCT request) AS unique_requests, round(avg(input_tokens) FILTER (WHERE transport), 6) AS mean_input,
CASE WHEN bool_and(NOT transport OR quote IS NOT NULL) THEN sum(quote) FILTER (WHERE transport) END::BIGINT AS quoted FROM obs GROUP BY ALL"""


def category_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return E.accuracy(_observations(spark, d), category="category", passed="success").withColumn("accuracy", F.round("accuracy", 6))


SQL["category_accuracy"] = f"WITH {_OBS} SELECT category, count(*) AS total, count(*) FILTER (WHERE success) AS passed, round(avg(success::INT), 6) AS accuracy FROM obs GROUP BY ALL"


def pareto_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = _observations(spark, d).withColumns({
        "full_recall": F.col("evidence"), "recall": (F.col("task") % 5) / 4.0, "leaked": F.col("parse_error"), "seed_failed": F.col("length_hit")
    })
    return E.pareto_summary(rows, keys=["method", "budget"])


SQL["pareto_summary"] = f"""WITH {_OBS} SELECT method, budget, round(avg(selected_tokens), 1) AS mean_selected, round(100.0::DOUBLE * avg(evidence::INT), 1) AS full_recall_pct,
round(100.0::DOUBLE * avg((task % 5) / 4.0::DOUBLE), 1) AS recall_pct, round(100.0::DOUBLE * avg(parse_error::INT), 1) AS leak_pct, round(100.0::DOUBLE * avg(length_hit::INT), 1) AS seed_failure_pct,
round(quantile_cont(latency, 0.5), 2) AS median_latency FROM obs GROUP BY ALL"""


def paired_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """What each method adds to the first one's successes, with the interval that 100 resamples give."""
    rows = _observations(spark, d).where("budget = 512")
    base = rows.where("method = 'm0'").select("task", F.col("success").cast("int").alias("b"))
    pairs = rows.where("method <> 'm0'").join(base, "task").withColumn("d", F.col("success").cast("int") - F.col("b"))
    out = E.bootstrap_interval(pairs, by=["method"], key="task", value="d", resamples=100)
    return out.select("method", "n", *(F.round(c, 6).alias(c) for c in ("mean", "low", "high")))


SQL["paired_bootstrap"] = f"""WITH {_OBS}, p AS (SELECT a.method, a.task, a.success::INT - b.success::INT AS d FROM obs a JOIN obs b ON a.task = b.task AND b.method = 'm0' AND b.budget = 512 WHERE a.budget = 512 AND a.method <> 'm0'),
u AS (SELECT method, r, d, concat('0x', md5(concat(task, '|', r, '|0'))[1:8])::BIGINT / 4294967296.0::DOUBLE AS u FROM p, range(100) t(r)),
w AS (SELECT method, r, d, {" + ".join(f"(u >= {t!r}::DOUBLE)::INT" for t in E._AT_MOST)} AS w FROM u),
m AS (SELECT method, r, sum(w * d) / sum(w)::DOUBLE AS m FROM w GROUP BY ALL HAVING sum(w) > 0),
e AS (SELECT method, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m GROUP BY method)
SELECT method, n, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high FROM (SELECT method, count(*) AS n, avg(d) AS mean FROM p GROUP BY method) JOIN e USING (method)"""


def msc_efficiency(spark: SparkSession, d: str) -> DataFrame:
    """Order keys as token counts, measured in blocks or lines."""
    unit = lambda c: F.when(F.col(c) % 3 == 0, "line").when(F.col(c) % 3 == 1, "block")
    value = E.msc_efficiency(F.col("o_orderkey") % 700, F.col("o_custkey") % 900, unit("o_orderkey"), unit("o_custkey"))
    return table(spark, d, "orders").select("o_orderkey", value.alias("efficiency"))


SQL["msc_efficiency"] = """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = o_custkey % 3 AND o_custkey % 900 > 0 THEN round(100.0::DOUBLE * (o_orderkey % 700) / (o_custkey % 900), 2) END AS efficiency FROM orders"""


def prepended(spark: SparkSession, d: str) -> DataFrame:
    """A customer's three dearest orders before the five oldest ones."""
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    top = lambda order, k: rows.withColumn("rank", F.row_number().over(Window.partitionBy("o_custkey").orderBy(*order)).cast("long")).where(F.col("rank") <= k)
    primary, fallback = top((F.col("o_totalprice").desc(), "o_orderkey"), 3), top(("o_orderdate", "o_orderkey"), 5)
    return E.prepend(primary, fallback, keys=["o_custkey"], item="o_orderkey", rank="rank")


SQL["prepended"] = """WITH a AS (SELECT o_custkey, o_orderkey, 0 AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders QUALIFY r <= 3),
b AS (SELECT o_custkey, o_orderkey, 1 AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders QUALIFY r <= 5),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b WHERE (o_custkey, o_orderkey) NOT IN (SELECT o_custkey, o_orderkey FROM a))
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY c, r) - 1 AS rank FROM u"""


def attributed_retention(spark: SparkSession, d: str) -> DataFrame:
    """Each document's first lines as a task; shown are its blocks, and those of the next document, which do not count."""
    line = F.element_at(F.split(F.col("text"), "\n"), 1)
    tasks = files(spark, d).select(F.col("doc_id").alias("task"), "path", F.lit(1).alias("start_line"), F.lit(3).alias("end_line"), F.array(F.element_at(F.split(line, " "), 1), F.lit("of the")).alias("wanted"))
    own = blocks(spark, d).select("doc_id", "path", "start_line", "end_line", "text")
    shown = own.withColumnRenamed("doc_id", "task").unionByName(own.withColumn("task", F.col("doc_id") - 1).drop("doc_id"))
    return E.attributed_retention(shown, tasks).withColumn("recall", F.round("recall", 6))


SQL["attributed_retention"] = rf"""WITH {BLOCKS}, t AS (SELECT doc_id AS task, split_part(split_part(text, chr(10), 1), ' ', 1) AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id AS task, regexp_replace(string_agg(text, chr(10) || chr(10) ORDER BY start_line), '\s+', ' ', 'g') AS x FROM blocks WHERE start_line <= 3 AND end_line >= 1 GROUP BY doc_id)
SELECT task, contains(coalesce(x, ''), w) AND contains(coalesce(x, ''), 'of the') AS strict, round((contains(coalesce(x, ''), w)::INT + contains(coalesce(x, ''), 'of the')::INT) / 2.0::DOUBLE, 6) AS recall FROM t LEFT JOIN s USING (task)"""


def _identifiers(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("The "), F.regexp_replace("p_brand", "#", "x_"), F.lit(" maxRetryCount HTTPServer parse_XMLFile "), "p_type")
    return table(spark, d, "part").select("p_partkey", text.alias("query"))


_STOP = ", ".join(f"'{w}'" for w in sorted(STOPWORDS))
_IDENTIFIERS = "i AS (SELECT p_partkey, concat('The ', replace(p_brand, '#', 'x_'), ' maxRetryCount HTTPServer parse_XMLFile ', p_type) AS query FROM part)"
_PARTS = r"regexp_extract_all(regexp_replace({0}, '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+')"


def expanded_terms(spark: SparkSession, d: str) -> DataFrame:
    return _identifiers(spark, d).select("p_partkey", F.array_join(F.array_sort(V.expanded_terms(F.col("query"))), " ").alias("terms"))


SQL["expanded_terms"] = rf"""WITH {_IDENTIFIERS}, w AS (SELECT p_partkey, unnest(regexp_extract_all(query, '\w+')) AS w FROM i),
p AS (SELECT p_partkey, lower(w) AS t FROM w UNION SELECT p_partkey, lower(unnest({_PARTS.format("w")})) FROM w)
SELECT p_partkey, string_agg(t, ' ' ORDER BY t) AS terms FROM p WHERE length(t) > 2 AND t NOT IN ({_STOP}) GROUP BY p_partkey"""


def spelling_additions(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers whose parts join a query, unless documents hold them as they are."""
    words = _identifiers(spark, d).select(F.col("p_partkey").alias("query_id"), F.explode(F.regexp_extract_all("query", F.lit(r"\w+"), 0)).alias("word"))
    known = table(spark, d, "documents").select(F.explode(F.split(F.lower("text"), r"(?U)[^\w]+")).alias("term")).unionByName(table(spark, d, "part").select(F.lit("httpserver").alias("term")))
    return V.spelling_additions(words, known)


SQL["spelling_additions"] = rf"""WITH {_IDENTIFIERS}, w AS (SELECT DISTINCT p_partkey AS query_id, unnest(regexp_extract_all(query, '\w+')) AS word FROM i),
k AS (SELECT DISTINCT unnest(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}_]+')) AS term FROM documents UNION SELECT 'httpserver'),
m AS (SELECT *, {_PARTS.format("word")} AS parts FROM w WHERE lower(word) NOT IN (SELECT term FROM k WHERE term IS NOT NULL))
SELECT DISTINCT query_id, word, part FROM (SELECT query_id, word, lower(unnest(parts)) AS part FROM m WHERE len(parts) > 1) WHERE length(part) > 2 AND part NOT IN ({_STOP}) AND part <> lower(word)"""


def question_views(spark: SparkSession, d: str) -> DataFrame:
    """Turns with every third sentence end made a question."""
    text = F.regexp_replace("text", r"e\.", "e?")
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(V.questions(text)).alias("view"))


SQL["question_views"] = r"""WITH q AS (SELECT conv_id, turn, regexp_replace(text, 'e\.', 'e?', 'g') AS t FROM conversations),
s AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(t, '([.!?;])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x LIKE '%?') AS a FROM q)
SELECT conv_id, turn, md5(CASE WHEN len(a) > 0 THEN array_to_string(a, chr(10)) ELSE t END) AS view FROM s"""


def intent_modes(spark: SparkSession, d: str) -> DataFrame:
    """Which of two raises relations a query's wording supports, in each mode."""
    tail = F.element_at(F.array(F.lit(" raises ValueError?"), F.lit(" doesn't raise ValueError"), F.lit(" Raised by errors.KeyError"), F.lit(" errors.raise"), F.lit(" handled, thrown KeyError")), (F.col("query_id") % 5 + 1).cast("int"))
    names = F.array(F.lit("valueerror"), F.lit("keyerror"))
    rows = benchmark_queries(spark, d).withColumn("query", F.concat("query", tail))
    return rows.select("query_id", *(F.array_join(V.intent_relations(F.col("query"), names, m), ",").alias(m) for m in ("original", "disabled", "action", "conservative")))


_WORDS = lambda words: ", ".join(f"'{w}'" for w in sorted(words))
SQL["intent_modes"] = rf"""WITH q AS (SELECT item_id AS query_id, concat(text, ([' raises ValueError?', ' doesn''t raise ValueError', ' Raised by errors.KeyError', ' errors.raise', ' handled, thrown KeyError'])[item_id % 5 + 1]) AS t FROM benchmark),
h AS (SELECT *, list_filter(regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}_]+(?:\.[\p{{L}}_][\p{{L}}\p{{N}}_]*)*'), lambda x: NOT regexp_matches(x, '^\p{{N}}')) AS hits FROM q),
m AS (SELECT *, list_has_any(hits, [{_WORDS(V.ACTION_WORDS)}]) AS acts, list_has_any(hits, [{_WORDS(V.ABSTAIN_WORDS)}]) OR regexp_matches(t, '(?i)\w+n[''’]t\b') AS unclear,
 list_concat(hits, string_split(array_to_string(hits, '.'), '.')) AS said FROM h)
SELECT query_id, 'valueerror,keyerror' AS original, '' AS disabled, CASE WHEN acts THEN 'valueerror,keyerror' ELSE '' END AS action,
CASE WHEN acts AND NOT unclear THEN array_to_string(list_filter(['valueerror', 'keyerror'], lambda n: list_contains(said, n)), ',') ELSE '' END AS conservative FROM m"""


def operation_views(spark: SparkSession, d: str) -> DataFrame:
    """Each turn of a conversation with its words as calls, some of them passed on: what the code calls, each once."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))
    calls = F.transform(words, lambda w, i: F.when(i % 3 == 0, F.concat(F.lit("do_"), w, F.lit("(n="), i.cast("string"), F.lit(")"))).otherwise(F.concat(F.lit("x.do_"), w, F.lit("()"))))
    last = F.when(F.col("turn") % 2 == 0, F.lit("eval(x, **rest)\n")).otherwise("")
    code = F.concat(F.lit("Explain this.\n```python\n"), F.array_join(calls, "\n"), F.lit("\n"), last, F.lit("```\n"))
    rows = table(spark, d, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("query_id"), code.alias("query"))
    return V.operations(rows).select("query_id", F.array_join("operations", " ").alias("operations"), F.array_join("uncertainty", ", ").alias("uncertainty"))


SQL["operation_views"] = """WITH w AS (SELECT concat(conv_id, '/', turn) AS query_id, turn, regexp_extract_all(lower(text), '[a-z]{3,}') AS ws FROM conversations),
n AS (SELECT query_id, turn, list_concat(flatten(list_transform(ws, lambda x, i: CASE WHEN (i - 1) % 3 = 0 THEN [concat('do_', x), concat('n=', i - 1)] ELSE [concat('do_', x)] END)), CASE WHEN turn % 2 = 0 THEN ['eval'] ELSE [] END) AS ns FROM w)
SELECT query_id, array_to_string(list_filter(ns, lambda x, i: list_position(ns, x) = i), ' ') AS operations, CASE WHEN turn % 2 = 0 THEN 'unpacked keywords, what eval reaches' ELSE '' END AS uncertainty FROM n"""


def scoped_passages(spark: SparkSession, d: str) -> DataFrame:
    """Passages with their places, of the English documents of two sources only: a semi-join on paths."""
    docs = table(spark, d, "documents")
    sources = docs.select("source").distinct().orderBy("source").limit(2)
    scope = files(spark, d).join(docs.where("lang = 'en'").join(sources, "source", "left_semi").select("doc_id"), "doc_id", "left_semi").select("path")
    return blocks(spark, d).join(scope, "path", "left_semi").select("path", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), F.md5("text").alias("text_md5"))


SQL["scoped_passages"] = f"""WITH {BLOCKS} SELECT b.path, b.start_line::BIGINT AS start_line, b.end_line::BIGINT AS end_line, md5(b.text) AS text_md5 FROM blocks b JOIN documents d ON b.doc_id = d.doc_id
WHERE d.lang = 'en' AND d.source IN (SELECT DISTINCT source FROM documents ORDER BY source LIMIT 2)"""


def _routed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Each query's best documents, and the scores of all blocks of these and of the documents that its best blocks are in."""
    terms, shelf = benchmark_terms(spark, d), block_shelf(spark, d)
    weights = shelf.weights(terms)
    docs = document_shelf(spark, d).top(terms, 16).select("query_id", "doc_id", "score")
    flat = block_table(spark, d).select("doc_id", "path", "ordinal").join(if_small(shelf.top(terms, R.CANDIDATES, weights=weights)), ["path", "ordinal"])
    wanted = docs.select("query_id", "doc_id").unionByName(flat.select("query_id", "doc_id"))
    return written(shelf.scores_of(terms, wanted, ["doc_id"], weights), "routed"), docs


_MODES = ("flat", "gate1", "gate16", "balanced4", "escape4", "passage_parent4")


def doc_first_modes(spark: SparkSession, d: str) -> DataFrame:
    """The five best blocks of each way of going by documents first."""
    scored, docs, out = *_routed(spark, d), None
    for mode in _MODES:
        found = R.document_routes(scored, docs, mode=mode).where("rank < 5").select(F.lit(mode).alias("mode"), "query_id", "path", F.col("ordinal").cast("long").alias("ordinal"), F.col("rank").cast("long").alias("rank"))
        out = found if out is None else out.unionByName(found)
    return out


def _doc_first_sql() -> str:
    from quillstone.plans.retrieval import _DOCS, BASE

    order = "round(score, 6) DESC, path, ordinal"
    gate = lambda n: f"SELECT s.query_id, s.path, s.ordinal, row_number() OVER (PARTITION BY s.query_id ORDER BY round(s.score, 6) DESC, s.path, s.ordinal) - 1 AS rank FROM sd s JOIN dranks k ON k.query_id = s.query_id AND k.doc_id = s.doc_id WHERE drank < {n}"
    return f"""{BASE}, {_DOCS}, sd AS (SELECT s.*, b.doc_id FROM scores s JOIN blocks b USING (path, ordinal)),
fl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) - 1 AS rank FROM sd QUALIFY rank < 60),
g1 AS ({gate(1)}), g16 AS ({gate(16)}),
tu AS (SELECT s.*, drank, row_number() OVER (PARTITION BY s.query_id, s.doc_id ORDER BY {order.replace("score", "s.score").replace("path", "s.path").replace("ordinal", "s.ordinal")}) AS turn FROM sd s JOIN dranks k ON k.query_id = s.query_id AND k.doc_id = s.doc_id WHERE drank < 4),
ba AS (SELECT query_id, path, ordinal, row_number() OVER (PARTITION BY query_id ORDER BY turn, drank) - 1 AS rank FROM tu QUALIFY rank < 60),
es AS (SELECT query_id, path, ordinal, row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(1.0::DOUBLE / (60 + fl.rank), 0) + coalesce(1.0::DOUBLE / (60 + ba.rank), 0), 9) DESC, fl.rank NULLS LAST, ba.rank NULLS LAST) - 1 AS rank
       FROM fl FULL JOIN ba USING (query_id, path, ordinal)),
pa AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY min(rank)) AS n FROM fl GROUP BY query_id, doc_id),
pp AS (SELECT s.query_id, s.path, s.ordinal, row_number() OVER (PARTITION BY s.query_id ORDER BY round(s.score, 6) DESC, s.path, s.ordinal) - 1 AS rank FROM sd s JOIN pa USING (query_id, doc_id) WHERE n <= 4),
every AS (SELECT 'flat' AS mode, query_id, path, ordinal, rank FROM fl UNION ALL SELECT 'gate1', * FROM g1 UNION ALL SELECT 'gate16', * FROM g16 UNION ALL SELECT 'balanced4', * FROM ba UNION ALL SELECT 'escape4', * FROM es UNION ALL SELECT 'passage_parent4', * FROM pp)
SELECT mode, query_id, path, ordinal::BIGINT AS ordinal, rank FROM every WHERE rank < 5"""


SQL["doc_first_modes"] = _doc_first_sql()


def trimmed_packs(spark: SparkSession, d: str) -> DataFrame:
    """Each query's ten best blocks less those at the end that take it over 700 tokens."""
    top = if_small(block_shelf(spark, d).top(benchmark_terms(spark, d), 10))
    sized = top.join(block_table(spark, d).select("path", "ordinal", F.length("text").cast("long").alias("chars")), ["path", "ordinal"]).select("query_id", F.col("rank").alias("place"), "chars")
    return R.trim_tail(sized, budget=700).groupBy("query_id").agg(F.count("*").alias("n_kept"), F.sum("chars").alias("chars"))


def view_packs(spark: SparkSession, d: str) -> DataFrame:
    """Each query's twelve best blocks in 900 tokens: whole, by their first lines, or by these where the whole does not fit."""
    found, top = block_table(spark, d), if_small(block_shelf(spark, d).top(benchmark_terms(spark, d), 12))
    short = F.length(F.substring_index("text", "\n", 1)).cast("long")
    sized = top.join(found.select("path", "ordinal", F.length("text").cast("long").alias("full"), short.alias("compact")), ["path", "ordinal"]).select("query_id", F.col("rank").alias("place"), "full", "compact")
    out = None
    for mode in ("raw", "compact", "rescue"):
        kept = F.array_join(F.transform("kept", lambda k: F.concat(k["place"].cast("string"), F.substring(k["view"], 1, 1))), ",")
        made = R.pack_views(sized, budget=900, mode=mode).select(F.lit(mode).alias("mode"), "query_id", kept.alias("kept"), "used")
        out = made if out is None else out.unionByName(made)
    return out


def _views_sql() -> str:
    from quillstone.plans.common import RANKED
    from quillstone.plans.retrieval import BASE

    fits = lambda v: f"greatest(1, (a.used + x.{v} + CASE WHEN len(a.kept) > 0 THEN 2 ELSE 0 END) // 4) <= 900"
    take = lambda v: f"{{'used': a.used + x.{v} + CASE WHEN len(a.kept) > 0 THEN 2 ELSE 0 END, 'kept': list_append(a.kept, concat(x.place, '{v[0]}')), 'place': 0::BIGINT, 'f': 0::BIGINT, 'c': 0::BIGINT}}"
    fold = lambda *vs: f"list_reduce(c, lambda a, x: CASE {' '.join(f'WHEN {fits(v)} THEN {take(v)}' for v in vs)} ELSE a END, {{'used': 0::BIGINT, 'kept': []::VARCHAR[], 'place': 0::BIGINT, 'f': 0::BIGINT, 'c': 0::BIGINT}})"
    modes = {"raw": ("f",), "compact": ("c",), "rescue": ("f", "c")}
    return f"""{BASE}, t AS (SELECT query_id, path, ordinal, {RANKED} AS rank FROM scores),
s AS (SELECT query_id, list({{'used': 0::BIGINT, 'kept': []::VARCHAR[], 'place': rank::BIGINT, 'f': length(text)::BIGINT, 'c': length(split_part(text, chr(10), 1))::BIGINT}} ORDER BY rank) AS c
      FROM t JOIN blocks USING (path, ordinal) WHERE rank < 12 GROUP BY query_id),
""" + ", ".join(f"{m} AS (SELECT '{m}' AS mode, query_id, {fold(*vs)} AS r FROM s)" for m, vs in modes.items()) + "\n" + " UNION ALL ".join(f"SELECT mode, query_id, array_to_string(r.kept, ',') AS kept, r.used AS used FROM {m}" for m in modes)


SQL["view_packs"] = _views_sql()


def _trim_sql() -> str:
    from quillstone.plans.common import RANKED
    from quillstone.plans.retrieval import BASE

    return f"""{BASE}, t AS (SELECT query_id, path, ordinal, {RANKED} AS rank FROM scores), s AS (SELECT query_id, rank, length(text) AS chars FROM t JOIN blocks USING (path, ordinal) WHERE rank < 10),
u AS (SELECT *, sum(chars) OVER (PARTITION BY query_id ORDER BY rank) + 2 * rank AS used FROM s)
SELECT query_id, count(*) AS n_kept, sum(chars)::BIGINT AS chars FROM u WHERE greatest(1, used // 4) <= 700 GROUP BY query_id"""


SQL["trimmed_packs"] = _trim_sql()


def risk_scores(spark: SparkSession, d: str) -> DataFrame:
    """Ordinal risks and bands of orders, whose keys give coverage, margin and indirection."""
    k = F.col("o_orderkey")
    score = M.risk_score((k % 11) / 10.0, (k % 7) / 10.0, (k % 5) / 4.0, k % 3 == 0)
    return table(spark, d, "orders").select("o_orderkey", F.round(score, 6).alias("risk"), M.score_band(F.round(score, 6)).alias("band"))


SQL["risk_scores"] = """WITH k AS (SELECT o_orderkey, (o_orderkey % 11) / 10.0::DOUBLE AS c, (o_orderkey % 7) / 10.0::DOUBLE AS m, (o_orderkey % 5) / 4.0::DOUBLE AS t, o_orderkey % 3 = 0 AS dy FROM orders),
r AS (SELECT o_orderkey, round(greatest(0, least(1, 0.7::DOUBLE * (1 - greatest(0, least(1, c))) + 0.3::DOUBLE * (1 - CASE WHEN t > 0 THEN greatest(0, least(1, m / t)) ELSE 0 END) + CASE WHEN dy THEN 0.15::DOUBLE ELSE 0 END)), 6) AS risk FROM k)
SELECT o_orderkey, risk, concat('uncalibrated:', CASE WHEN risk < 0.20 THEN 'low' WHEN risk < 0.50 THEN 'moderate' ELSE 'high' END) AS band FROM r"""


def superseded_turns(spark: SparkSession, d: str) -> DataFrame:
    """What turns declare superseded, where every fourth one does."""
    text = F.when(F.col("turn") % 4 == 1, F.concat(F.lit("Please disregard the Old Region "), F.col("conv_id").cast("string"), F.lit(", we moved. "), F.col("text"))).otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", M.superseded(text).alias("phrase")).where("phrase IS NOT NULL")


SQL["superseded_turns"] = rf"""WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 1 THEN concat('Please disregard the Old Region ', conv_id, ', we moved. ', text) ELSE text END AS x FROM conversations),
p AS (SELECT conv_id, turn, lower(trim(regexp_extract(x, '{M.SUPERSEDED}', 1))) AS phrase FROM t) SELECT * FROM p WHERE length(phrase) > 2"""


def orphan_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Stored chunks that no document refers to any more, once every third one is gone."""
    chunks = derive.fixed_chunks(table(spark, d, "documents"), 4096)
    return derive.orphan_chunks(derive.chunk_store(chunks), chunks.where("doc_id % 3 <> 0")).agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("n_bytes"))


SQL["orphan_chunks"] = """WITH c AS (SELECT doc_id, hex(encode(text)) AS h, unnest(range(0, strlen(text), 4096)) AS i FROM documents), p AS (SELECT doc_id, h[2 * i + 1:2 * (i + 4096)] AS chunk FROM c),
o AS (SELECT chunk FROM p WHERE doc_id % 3 = 0 EXCEPT SELECT chunk FROM p WHERE doc_id % 3 <> 0) SELECT count(*) AS n, coalesce(sum(length(chunk) // 2), 0)::BIGINT AS n_bytes FROM o"""


def request_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", D.fingerprint("n_name", "n_nationkey", "n_regionkey").alias("fingerprint"))


SQL["request_fingerprints"] = """SELECT n_nationkey, sha256(concat('{"n_name":"', n_name, '","n_nationkey":', n_nationkey, ',"n_regionkey":', n_regionkey, '}')) AS fingerprint FROM nation"""


def retention_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Words of the sources' documents as per cent of a baseline source's."""
    rows = table(spark, d, "documents").groupBy("lang").agg(F.sum("n_chars").cast("long").alias("chars"))
    return T.retention_by(rows, mode="lang", value="chars", baseline="en")


SQL["retention_by_source"] = """WITH r AS (SELECT lang, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang)
SELECT lang, chars, round(100.0::DOUBLE * chars / nullif((SELECT max(chars) FROM r WHERE lang = 'en'), 0), 6) AS pct FROM r"""


def trace_lookup(spark: SparkSession, d: str) -> DataFrame:
    """One event by its id, of validated ones."""
    traces = table(spark, d, "events").select(F.col("event_id").alias("request_id"), "event_type", F.floor(F.abs("value")).cast("long").alias("original_tokens"), F.lit(0).alias("optimized_tokens"))
    return T.trace_of(T.valid_traces(traces), 77).select("request_id", "event_type", "original_tokens")


SQL["trace_lookup"] = "SELECT event_id AS request_id, event_type, floor(abs(value))::BIGINT AS original_tokens FROM events WHERE event_id = 77"


def store_contracts(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of which some break a rule, under a schema that is off by a type and a column."""
    rows = blocks(spark, d).select("path", "ordinal", F.when(F.col("doc_id") % 10 == 3, 0).otherwise(F.col("start_line")).alias("start_line"), "end_line", F.when(F.col("doc_id") % 10 == 4, F.lit(None)).otherwise(F.col("n_tokens")).alias("n_tokens"))
    schema = {"path": "string", "ordinal": "bigint", "start_line": "int", "end_line": "int", "n_tokens": "bigint", "text": "string"}
    return integrity.contracts(rows, schema, {"lines": (F.col("start_line") >= 1) & (F.col("end_line") >= F.col("start_line")), "tokens": F.col("n_tokens") > 0})


SQL["store_contracts"] = f"""WITH {BLOCKS} SELECT 'schema' AS check, 2::BIGINT AS n UNION ALL SELECT 'lines', count(*) FILTER (WHERE doc_id % 10 = 3) FROM blocks UNION ALL SELECT 'tokens', count(*) FILTER (WHERE doc_id % 10 = 4) FROM blocks"""


for _f in (
    view_packs, doc_first_modes, trimmed_packs, risk_scores, superseded_turns, orphan_chunks, request_fingerprints, retention_by_source, trace_lookup, store_contracts,
    paired_bootstrap, arm_summary, arm_outcomes, corpus_comparison, failure_split, arm_economics, category_accuracy, pareto_summary, msc_efficiency, prepended, attributed_retention,
    expanded_terms, spelling_additions, question_views, intent_modes, operation_views, scoped_passages,
):
    Q[_f.__name__] = _f
