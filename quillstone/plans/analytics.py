"""Queries of conversations, traces, decisions and evaluations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions.text import legacy_tokens
from quillstone.operators import decide as D, messages as M, retrieval as R, telemetry as T
from quillstone.plans.common import QUERY_TERMS, WORDS_SQL, asked_documents, benchmark_queries, benchmark_terms, table
from quillstone.scratch import if_small
from quillstone.streaming.traces import event_windows

Q: dict = {}
SQL: dict = {}


def _conv(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations")


def convo_classify(spark: SparkSession, d: str) -> DataFrame:
    return M.classify(_conv(spark, d))


SQL["convo_classify"] = r"""WITH m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, min(turn) OVER (PARTITION BY conv_id) AS f FROM conversations),
g AS (SELECT conv_id, count(*) AS n_messages, sum(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, floor(length(text) / 3.8::DOUBLE)) END)::BIGINT AS n_tokens, count(*) FILTER (WHERE role IN ('user', 'assistant')) AS t,
  string_agg(text, chr(10) ORDER BY turn, role, text) AS x, coalesce(max(CASE WHEN role = 'system' OR (turn = f AND length(text) > 2000) THEN turn - f + 1 END), 0)::BIGINT AS stable_prefix FROM m GROUP BY conv_id)
SELECT conv_id, n_messages, n_tokens, CASE WHEN contains(x, 'tool_calls') OR contains(lower(x), 'observation:') OR regexp_matches(x, '\btool_result\b') THEN 'agent_trace'
 WHEN regexp_matches(x, '(?s)```(?:[a-zA-Z0-9_-]+)?\s*\n.*?\n```') OR regexp_matches(x, '\b(?:def |class |import |function |const |public |private )\b') THEN 'code'
 WHEN t >= 4 THEN 'conversation' WHEN length(x) > 3000 AND contains(x, '# ') THEN 'document' ELSE 'general' END AS context_type, stable_prefix FROM g"""


def convo_compact(spark: SparkSession, d: str) -> DataFrame:
    return M.compact_conversation(_conv(spark, d)).groupBy("conv_id").agg(F.count("*").alias("n_kept"), F.sum(legacy_tokens(F.col("text"))).alias("n_tokens"), F.min("turn").alias("first_turn"))


_CONSTRAINT = " OR ".join(f"contains(lower(text), '{c}')" for c in M.CONSTRAINT)
SQL["convo_compact"] = f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS late FROM conversations)
SELECT conv_id, count(*) AS n_kept, sum(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, floor(length(text) / 3.8::DOUBLE)) END)::BIGINT AS n_tokens, min(turn) AS first_turn FROM r WHERE late <= 3 OR {_CONSTRAINT} GROUP BY conv_id"""


def last_user_query(spark: SparkSession, d: str) -> DataFrame:
    return M.last_query(_conv(spark, d))


SQL["last_user_query"] = r"""WITH u AS (SELECT conv_id, arg_max(text, turn) AS last, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY conv_id)
SELECT conv_id, CASE WHEN n = 1 AND regexp_matches(last, '(?s)(?:^|\n\n)(?:QUESTION|Question|Query):[ \t]?(.*)\z') THEN regexp_extract(last, '(?s)(?:^|\n\n)(?:QUESTION|Question|Query):[ \t]?(.*)\z', 1) ELSE last END AS query FROM u"""


def trace_compact(spark: SparkSession, d: str) -> DataFrame:
    """Conversations read as traces: turns are lines, the first three words of the first turn the query."""
    rows = _conv(spark, d).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.regexp_replace("text", "\n", " ").alias("t")))), lambda x: x["t"]).alias("lines"))
    query = F.array_join(F.slice(F.split(F.element_at("lines", 1), " "), 1, 3), " ")
    done = M.compact_trace(F.array_join("lines", "\n"), query)
    return rows.select("conv_id", done["omitted"].alias("omitted"), F.md5(done["text"]).alias("text_md5"))


_CRIT = " OR ".join(f"contains(lower(x), '{c}')" for c in M.CRITICAL)
_NOISE = " OR ".join(f"contains(lower(x), '{c}')" for c in M.NOISE)
SQL["trace_compact"] = rf"""WITH l AS (SELECT conv_id, list(replace(text, chr(10), ' ') ORDER BY turn) AS ls FROM conversations GROUP BY conv_id),
q AS (SELECT *, list_filter(list_distinct({WORDS_SQL.format("array_to_string(string_split(ls[1], ' ')[1:3], ' ')")}), lambda w: length(w) > 3) AS qw FROM l),
f AS (SELECT conv_id, list_transform(ls, lambda x: {{'kept': [x], 'omitted': 0::BIGINT, 'noise': {_NOISE}, 'want': {_CRIT} OR len(list_filter(qw, lambda w: contains(strip_accents(lower(x)), w))) > 0}}) AS c FROM q),
r AS (SELECT conv_id, list_reduce(c, lambda a, x: CASE WHEN NOT x.noise AND (x.want OR len(a.kept) < 2) THEN {{'kept': list_concat(a.kept, x.kept), 'omitted': a.omitted, 'noise': false, 'want': false}}
   ELSE {{'kept': a.kept, 'omitted': a.omitted + 1, 'noise': false, 'want': false}} END, {{'kept': []::VARCHAR[], 'omitted': 0::BIGINT, 'noise': false, 'want': false}}) AS s FROM f)
SELECT conv_id, s.omitted AS omitted, md5(concat('<!-- trace: ', s.omitted, ' lines omitted -->', chr(10), array_to_string(s.kept, chr(10)))) AS text_md5 FROM r"""


def extractive_compress(spark: SparkSession, d: str) -> DataFrame:
    """Documents compressed to half by their overlap with their first line; lines stand for paragraphs, which they lack."""
    rows = table(spark, d, "documents").select("doc_id", "text", F.substring_index("text", "\n", 1).alias("query"))
    return M.compress(rows, separator="\n").select("doc_id", F.size("kept_parts").cast("long").alias("n_kept"), F.array_join(F.transform("kept_parts", lambda x: x.cast("string")), ",").alias("kept"))


_TOK = "(CASE WHEN length({0}) = 0 THEN 0 ELSE greatest(1, floor(length({0}) / 3.8::DOUBLE)) END)::BIGINT"
SQL["extractive_compress"] = rf"""WITH p AS (SELECT doc_id, text, string_split(text, chr(10)) AS ps, {_TOK.format("text")} AS total, list_distinct({WORDS_SQL.format("split_part(text, chr(10), 1)")}) AS qw FROM documents),
e AS (SELECT doc_id, total, qw, unnest(ps) AS p, unnest(range(0, len(ps))) AS i FROM p),
s AS (SELECT doc_id, total, i, {_TOK.format("p")} AS tok, 2.0 * len(list_intersect(qw, list_distinct({WORDS_SQL.format("p")}))) + CASE WHEN regexp_matches(trim(p), '^(?:#|##|def |class |export |public )') THEN 1.5 ELSE 0 END AS score FROM e),
o AS (SELECT *, sum(tok) OVER w AS used, row_number() OVER w AS rn FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY score DESC, i ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, min(CASE WHEN rn > 1 AND used > greatest(500, floor(total * 0.5::DOUBLE)) THEN rn END) OVER (PARTITION BY doc_id) AS stop FROM o)
SELECT doc_id, count(*) AS n_kept, string_agg(i::VARCHAR, ',' ORDER BY i) AS kept FROM b WHERE total <= 500 OR stop IS NULL OR rn < stop GROUP BY doc_id"""


def invariant_check(spark: SparkSession, d: str) -> DataFrame:
    """Conversations against themselves with every seventh one's last user turn lost and every fifth one's others changed."""
    before = _conv(spark, d)
    last = F.max(F.when(F.col("role") == "user", F.col("turn"))).over(Window.partitionBy("conv_id"))
    changed = F.when((F.col("conv_id") % 7 == 0) & (F.col("turn") == F.col("l")), "").when((F.col("conv_id") % 5 == 0) & (F.col("role") != "user"), "changed").otherwise(F.col("text"))
    after = before.withColumn("l", last).withColumn("text", changed).drop("l")
    return M.invariants(before, after).select("conv_id", F.array_join("violations", ";").alias("violations"))


SQL["invariant_check"] = f"""WITH m AS (SELECT conv_id, turn, role, text, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS l FROM conversations),
c AS (SELECT *, CASE WHEN conv_id % 7 = 0 AND turn = l THEN '' WHEN conv_id % 5 = 0 AND role <> 'user' THEN 'changed' ELSE text END AS after FROM m),
q AS ({SQL["last_user_query"]}),
g AS (SELECT conv_id, bool_or(role <> 'user' AND text IS DISTINCT FROM after) AS other, coalesce(sum(length(text)) FILTER (WHERE role = 'user'), 0) AS o, coalesce(sum(length(after)) FILTER (WHERE role = 'user'), 0) AS n,
 max(after) FILTER (WHERE turn = l) AS last FROM c GROUP BY conv_id),
j AS (SELECT g.*, query, coalesce(length(query), 0) AS k FROM g LEFT JOIN q USING (conv_id))
SELECT conv_id, concat_ws(';', CASE WHEN other THEN 'non-user message changed' END, CASE WHEN floor(greatest(0, o - k) / 3.8::DOUBLE) > {M.EMPTY_CONTEXT} AND floor(greatest(0, n - k) / 3.8::DOUBLE) <= {M.EMPTY_CONTEXT} THEN 'context destroyed' END,
 CASE WHEN k > 0 AND NOT coalesce(contains(last, query), false) THEN 'query lost' END) AS violations FROM j"""


def plan_choice(spark: SparkSession, d: str) -> DataFrame:
    """Three plans a conversation: as it is, cut to a half, compressed to six tenths, at prices by message role."""
    tokens = _conv(spark, d).groupBy(F.col("conv_id").alias("request_id")).agg(F.sum(legacy_tokens(F.col("text"))).alias("t"))
    plan = lambda pos, name, share, risk: F.struct(F.lit(pos).alias("pos"), F.lit(name).alias("name"), F.floor(F.col("t") * F.lit(share)).alias("tokens"), F.lit(risk).alias("risk"))
    plans = F.array(plan(0, "raw", 1.0, 0.0), plan(1, "slice", 0.5, 0.04), plan(2, "compress", 0.6, 0.02))
    rows = tokens.select("request_id", F.explode(plans).alias("p")).select("request_id", "p.*")
    priced = F.when(F.col("request_id") % 3 > 0, F.col("tokens") * (1 + F.col("pos") * (F.col("request_id") % 3)))
    rows = rows.withColumn("cost", priced).withColumn("confidence", 1 - F.col("risk") - F.when(F.col("request_id") % 4 == 0, 0.03).otherwise(0.0))
    return M.choose_plan(rows.withColumn("confidence", F.round("confidence", 6)), threshold=0.95)


SQL["plan_choice"] = f"""WITH t AS (SELECT conv_id AS request_id, sum({_TOK.format("text")})::BIGINT AS t FROM conversations GROUP BY 1),
p AS (SELECT request_id, pos, name, floor(t * share::DOUBLE)::BIGINT AS tokens, risk, round(1 - risk - CASE WHEN request_id % 4 = 0 THEN 0.03 ELSE 0 END, 6) AS conf FROM t, (VALUES (0, 'raw', 1.0, 0.0), (1, 'slice', 0.5, 0.04), (2, 'compress', 0.6, 0.02)) v(pos, name, share, risk)),
c AS (SELECT *, CASE WHEN request_id % 3 > 0 THEN tokens * (1 + pos * (request_id % 3)) END AS cost FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY cost NULLS LAST, tokens, CASE WHEN cost IS NULL THEN risk ELSE 0 END, pos) AS rn FROM c WHERE conf >= 0.95)
SELECT request_id, name FROM r WHERE rn = 1"""


def _traces(spark: SparkSession, d: str) -> DataFrame:
    """Events as traces: types are modes, values token counts."""
    value = F.floor(F.abs("value") * 100).cast("long")
    return table(spark, d, "events").select(
        "event_id", "ts", "event_type", "value", (F.col("user_id") % 3).alias("token_basis"), value.alias("original_tokens"), F.floor(value * F.lit(0.75)).cast("long").alias("optimized_tokens"),
        F.array("event_type", F.concat(F.lit("basis_"), (F.col("user_id") % 3).cast("string"))).alias("plan_strategy"),
    )


_TRACES = """t AS (SELECT event_id, ts, event_type, value, user_id % 3 AS token_basis, floor(abs(value) * 100)::BIGINT AS original_tokens, floor(floor(abs(value) * 100) * 0.75::DOUBLE)::BIGINT AS optimized_tokens,
[event_type, concat('basis_', user_id % 3)] AS plan_strategy FROM events)"""


def trace_rollup(spark: SparkSession, d: str) -> DataFrame:
    return T.rollup(_traces(spark, d), ["token_basis", "event_type"])


SQL["trace_rollup"] = f"""WITH {_TRACES} SELECT token_basis, event_type, count(*) AS n, sum(original_tokens)::BIGINT AS original, sum(optimized_tokens)::BIGINT AS optimized,
(sum(original_tokens) - sum(optimized_tokens))::BIGINT AS avoided FROM t GROUP BY ALL"""


def strategy_histogram(spark: SparkSession, d: str) -> DataFrame:
    return T.histogram(_traces(spark, d), "plan_strategy")


SQL["strategy_histogram"] = f"WITH {_TRACES}, e AS (SELECT unnest(plan_strategy) AS plan_strategy FROM t) SELECT plan_strategy, count(*) AS n FROM e GROUP BY 1"


def comparable_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = _traces(spark, d)
    mixed = T.comparable_totals(rows, basis="token_basis", legacy=F.lit(False)).withColumn("kind", F.lit("all"))
    one = T.comparable_totals(rows.where("token_basis = 1"), basis="token_basis", legacy=F.lit(False)).withColumn("kind", F.lit("one basis"))
    return mixed.unionByName(one)


SQL["comparable_totals"] = f"""WITH {_TRACES} SELECT count(*) AS n, count(DISTINCT token_basis) AS bases, 0::BIGINT AS legacy, NULL::BIGINT AS original_total, NULL::BIGINT AS optimized_total, 'all' AS kind FROM t
UNION ALL SELECT count(*), count(DISTINCT token_basis), 0, sum(original_tokens)::BIGINT, sum(optimized_tokens)::BIGINT, 'one basis' FROM t WHERE token_basis = 1"""


def latency_distribution(spark: SparkSession, d: str) -> DataFrame:
    ms = F.round(F.abs("value") * 10, 3)
    rows = table(spark, d, "events").select("event_type", ms.alias("ms"))
    return rows.groupBy("event_type").agg(
        F.count("*").alias("n"), F.round(F.max("ms"), 6).alias("max_ms"), F.round(F.avg("ms"), 6).alias("mean_ms"), F.round(F.var_pop("ms"), 4).alias("var_ms")
    ).join(T.medians(rows, group="event_type", value="ms").select("event_type", F.round("median", 6).alias("median_ms")), "event_type")


SQL["latency_distribution"] = """WITH e AS (SELECT event_type, round(abs(value) * 10, 3) AS ms FROM events)
SELECT event_type, count(*) AS n, round(quantile_cont(ms, 0.5), 6) AS median_ms, round(max(ms), 6) AS max_ms, round(avg(ms), 6) AS mean_ms, round(var_pop(ms), 4) AS var_ms FROM e GROUP BY 1"""


def nearest_rank_p95(spark: SparkSession, d: str) -> DataFrame:
    """The exact value at place ceil(0.95 n) of each type, found by bins."""
    found = T.values_at(table(spark, d, "events"), group="event_type", value="value", places={"p95": lambda n: F.ceil(n * F.lit(0.95))})
    return found.select("event_type", "p95")


SQL["nearest_rank_p95"] = "SELECT event_type, list_sort(list(value))[ceil(0.95::DOUBLE * count(*))::BIGINT] AS p95 FROM events GROUP BY 1"


def event_stream_rollup(spark: SparkSession, d: str) -> DataFrame:
    out = event_windows(table(spark, d, "events"))
    return out.select(F.unix_timestamp("window_start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


SQL["event_stream_rollup"] = "SELECT epoch(date_trunc('hour', ts))::BIGINT AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"


def audit_join(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents as answers: the expected fact is a word most hold, the forbidden one a mark of junk."""
    labels, docs = table(spark, d, "labels"), table(spark, d, "documents")
    inputs = labels.select(F.col("doc_id").alias("id"), F.lit("the").alias("expected_fact"), F.lit("***").alias("forbidden_fact"))
    outputs = docs.join(labels, "doc_id", "left_semi").select(F.col("doc_id").alias("id"), F.col("lang").alias("mode"), F.col("text").alias("content"))
    usage = outputs.select("id", "mode", F.length("content").cast("long").alias("prompt_tokens"), F.lit(1).cast("long").alias("completion_tokens"))
    return T.audit(inputs, outputs, usage)


SQL["audit_join"] = """SELECT lang AS mode, count(*) AS n, count(*) FILTER (WHERE contains(lower(text), 'the') AND NOT contains(text, '***')) AS passed, sum(length(text))::BIGINT AS prompt_tokens, count(*) AS completion_tokens
FROM documents JOIN labels USING (doc_id) GROUP BY lang"""


def pareto_frontier(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice", "p_size")
    return D.pareto(rows, minimize=["p_retailprice"], maximize=["p_size"], group="p_brand").select("p_partkey", "p_brand", "p_retailprice", F.col("p_size").cast("long").alias("p_size"))


SQL["pareto_frontier"] = """SELECT p_partkey, p_brand, p_retailprice, p_size::BIGINT AS p_size FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE a.p_brand = b.p_brand
AND b.p_retailprice <= a.p_retailprice AND b.p_size >= a.p_size AND (b.p_retailprice < a.p_retailprice OR b.p_size > a.p_size))"""


def option_choice(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(
        F.col("p_brand"), F.col("p_name").alias("name"), F.col("p_partkey"), F.col("p_retailprice").alias("setup_ms"), F.col("p_size").cast("double").alias("request_ms"),
        (F.col("p_size") * 10).cast("long").alias("storage_bytes"), (F.col("p_partkey") % 3 > 0).alias("compatible"), (F.col("p_partkey") % 5 > 0).alias("quality_passed"),
        F.when(F.col("p_partkey") % 7 > 0, F.col("p_type")).alias("evidence"), F.col("p_size").cast("double").alias("p95_ms"),
    ).withColumn("name", F.concat("name", F.lit(" "), F.col("p_partkey").cast("string")))
    out = D.choose(rows, requests=100, storage=400, slo_ms=30.0, key="p_brand")
    return out.where("chosen").select("p_brand", "name", F.round("cost", 4).alias("cost"))


SQL["option_choice"] = """WITH o AS (SELECT p_brand, concat(p_name, ' ', p_partkey) AS name, p_retailprice + 100 * p_size AS cost, p_size * 10 AS storage FROM part
  WHERE p_partkey % 3 > 0 AND p_partkey % 5 > 0 AND p_partkey % 7 > 0 AND p_size * 10 <= 400 AND p_size <= 30),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY cost, storage, name) AS rn FROM o) SELECT p_brand, name, round(cost, 4) AS cost FROM r WHERE rn = 1"""


def break_even(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", D.break_even(F.col("p_retailprice"), F.col("p_size").cast("double"), F.lit(10.0)).alias("requests"))


SQL["break_even"] = "SELECT p_partkey, CASE WHEN p_size > 10 THEN floor(p_retailprice / (p_size - 10.0::DOUBLE)) + 1 END::BIGINT AS requests FROM part"


def _arms(spark: SparkSession, d: str) -> DataFrame:
    """Recall of each passage's document among the best 1, 2, 4, 8 by two arms: all terms, and long terms only."""
    terms, arm = benchmark_terms(spark, d), lambda n: (F.shiftleft(F.col("query_id").cast("long"), 1) + n).alias("query_id")
    both = terms.select(arm(0), "term").unionByName(terms.where(F.length("term") > 6).select(arm(1), "term"))  # documents are ranked in one pass
    best = if_small(asked_documents(spark, d).top(both, 8))
    name = F.when(F.col("query_id") % 2 == 0, "all").otherwise("long")
    rows = best.select(name.alias("arm"), F.shiftright("query_id", 1).alias("query_id"), "doc_id", "rank")
    out = table(spark, d, "documents").select("doc_id", "text").join(rows, "doc_id")
    held = out.join(benchmark_queries(spark, d), "query_id")
    hit = held.select("arm", "query_id", "rank", F.contains("text", F.col("query")).cast("int").alias("hit"))
    first = hit.groupBy("arm", "query_id").agg(F.coalesce(F.min(F.when(F.col("hit") == 1, F.col("rank"))), F.lit(99)).alias("first"))
    points = first.select("arm", "query_id", "first", F.explode(F.array(*map(F.lit, (1, 2, 4, 8)))).alias("budget"))
    return points.select("arm", "query_id", F.col("budget").cast("long").alias("budget"), (F.col("first") < F.col("budget")).cast("long").alias("hit"))


def _arm_sql(name: str, condition: str) -> str:
    return f"""{name}_df AS (SELECT term, count(*) AS df FROM dpost WHERE term IN (SELECT term FROM query_terms) GROUP BY term),
{name}_s AS (SELECT query_id, doc_id, sum(CASE WHEN n - df <= df THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))) AS score
  FROM dpost JOIN query_terms USING (term) JOIN {name}_df USING (term) JOIN dlen USING (doc_id), dn WHERE {condition} GROUP BY ALL),
{name}_r AS (SELECT '{name}' AS arm, query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) - 1 AS rank FROM {name}_s)"""


_ARMS = rf"""WITH {QUERY_TERMS}, dterms AS (SELECT doc_id, unnest({WORDS_SQL.format("text")}) AS term FROM documents), dpost AS (SELECT doc_id, term, count(*) AS tf FROM dterms GROUP BY ALL),
dlen AS (SELECT doc_id, len({WORDS_SQL.format("text")}) AS dl FROM documents), dn AS (SELECT count(*) AS n, avg(dl) AS a FROM dlen),
{_arm_sql("all", "true")}, {_arm_sql("long", "length(term) > 6")},
ranked AS (SELECT * FROM all_r WHERE rank < 8 UNION ALL SELECT * FROM long_r WHERE rank < 8),
firsts AS (SELECT arm, query_id, coalesce(min(rank) FILTER (WHERE contains(d.text, b.text)), 99) AS first FROM ranked JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = query_id GROUP BY ALL),
points AS (SELECT arm, query_id, budget::BIGINT AS budget, (first < budget)::BIGINT AS hit FROM firsts, (VALUES (1), (2), (4), (8)) v(budget))"""


def recall_by_budget(spark: SparkSession, d: str) -> DataFrame:
    return _arms(spark, d).groupBy("arm", "budget").agg(F.count("*").alias("n"), F.round(F.avg("hit"), 6).alias("recall"), F.round(F.percentile("hit", 0.5), 6).alias("median_hit"))


SQL["recall_by_budget"] = f"{_ARMS} SELECT arm, budget, count(*) AS n, round(avg(hit), 6) AS recall, round(quantile_cont(hit, 0.5), 6) AS median_hit FROM points GROUP BY ALL"


def recall_pivot(spark: SparkSession, d: str) -> DataFrame:
    return _arms(spark, d).groupBy("budget").pivot("arm", ["all", "long"]).agg(F.sum("hit")).select("budget", F.col("all").alias("hits_all"), F.col("long").alias("hits_long"))


SQL["recall_pivot"] = f"{_ARMS} SELECT budget, sum(hit) FILTER (WHERE arm = 'all')::BIGINT AS hits_all, sum(hit) FILTER (WHERE arm = 'long')::BIGINT AS hits_long FROM points GROUP BY budget"


def cost_frontier(spark: SparkSession, d: str) -> DataFrame:
    points = _arms(spark, d).groupBy("arm", "budget").agg(F.round(F.avg("hit"), 6).alias("recall"))
    return D.first_budget(points, ["arm"], target=0.02)


SQL["cost_frontier"] = f"""{_ARMS}, m AS (SELECT arm, budget, round(avg(hit), 6) AS recall FROM points GROUP BY ALL)
SELECT arm, min(budget) FILTER (WHERE recall >= 0.02) AS budget, arg_min(recall, budget) FILTER (WHERE recall >= 0.02) AS recall FROM m GROUP BY arm"""


def macro_retention(spark: SparkSession, d: str) -> DataFrame:
    out = D.macro(_arms(spark, d), keys=["arm"], query="query_id", value="hit")
    return out.select("arm", "n", *[F.round(c, 6).alias(c) for c in ("task_mean", "macro_mean", "any_share", "all_share")])


SQL["macro_retention"] = f"""{_ARMS}, i AS (SELECT arm, query_id, avg(hit) AS m, max(hit) AS a, min(hit) AS l, count(*) AS c, sum(hit) AS s FROM points GROUP BY ALL)
SELECT arm, sum(c)::BIGINT AS n, round(sum(s) / sum(c), 6) AS task_mean, round(avg(m), 6) AS macro_mean, round(avg(a), 6) AS any_share, round(avg(l), 6) AS all_share FROM i GROUP BY arm"""


def arm_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = _arms(spark, d).where("budget = 8")
    pairs = rows.groupBy("query_id").pivot("arm", ["all", "long"]).agg(F.max("hit"))
    return D.discordants(pairs, "all", "long")


SQL["arm_pairs"] = f"""{_ARMS}, p AS (SELECT query_id, max(hit) FILTER (WHERE arm = 'all') AS a, max(hit) FILTER (WHERE arm = 'long') AS b FROM points WHERE budget = 8 GROUP BY query_id)
SELECT count(*) FILTER (WHERE a = 1 AND b = 0) AS only_a, count(*) FILTER (WHERE a = 0 AND b = 1) AS only_b, count(*) FILTER (WHERE a = 1 AND b = 1) AS both, count(*) FILTER (WHERE a = 0 AND b = 0) AS neither FROM p"""


def common_cohort(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers that delivered in every ship year: a division."""
    rows = table(spark, d, "lineitem").select("l_suppkey", F.year("l_shipdate").alias("y"), F.when(F.col("l_quantity") > 45, F.col("l_quantity")).alias("score"))
    return D.common_cohort(rows, task="l_suppkey", arm="y", score="score").groupBy("l_suppkey").agg(F.count("score").alias("n_scores"))


SQL["common_cohort"] = """WITH r AS (SELECT l_suppkey, year(l_shipdate) AS y, CASE WHEN l_quantity > 45 THEN l_quantity END AS score FROM lineitem)
SELECT l_suppkey, count(score) AS n_scores FROM r GROUP BY l_suppkey HAVING count(DISTINCT CASE WHEN score IS NOT NULL THEN y END) = (SELECT count(DISTINCT y) FROM r)"""


def paired_discordants(spark: SparkSession, d: str) -> DataFrame:
    return D.discordants(table(spark, d, "labels"), "quality", "toxic")


SQL["paired_discordants"] = """SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS only_a, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS only_b,
count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS both, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS neither FROM labels"""


def family_accounting(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").withColumn("split", D.hash_split(F.col("o_orderkey")))
    both = rows.withColumn("family", F.concat_ws("/", "o_orderpriority", "split"))
    middle = T.medians(both, group="family", value="o_totalprice")
    out = both.groupBy("family", "o_orderpriority", "split").agg(F.count("*").alias("n"), F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("most"))
    return out.join(middle, "family").select("o_orderpriority", "split", "n", "least", "median", "most")


SQL["family_accounting"] = """SELECT o_orderpriority, CASE WHEN concat('0x', sha256(o_orderkey::VARCHAR)[1:8])::BIGINT / 4294967295.0::DOUBLE < 0.5 THEN 'dev' ELSE 'sealed' END AS split,
count(*) AS n, min(o_totalprice) AS least, quantile_cont(o_totalprice, 0.5) AS median, max(o_totalprice) AS most FROM orders GROUP BY ALL"""


def ambiguous_queries(spark: SparkSession, d: str) -> DataFrame:
    """Part names (queries) with more than one brand (answer)."""
    return table(spark, d, "part").groupBy("p_name").agg(F.countDistinct("p_brand").alias("n_gold")).where("n_gold > 1")


SQL["ambiguous_queries"] = "SELECT p_name, count(DISTINCT p_brand) AS n_gold FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1"


def best_attempt(spark: SparkSession, d: str) -> DataFrame:
    """Of each user's events of a type the one with the largest value: unique requests, most attempts first."""
    first = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy(F.col("value").desc_nulls_last(), "event_id"))
    return table(spark, d, "events").withColumn("rn", first).where("rn = 1").select("user_id", "event_type", "event_id")


SQL["best_attempt"] = """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC NULLS LAST, event_id) AS rn FROM events) SELECT user_id, event_type, event_id FROM r WHERE rn = 1"""


def two_level_average(spark: SparkSession, d: str) -> DataFrame:
    """Mean line price by order status and ship mode of orders' means, as per cent of the plain mean."""
    rows = table(spark, d, "lineitem").groupBy("l_returnflag", "l_orderkey").agg(F.avg("l_extendedprice").alias("m"), F.sum("l_extendedprice").alias("s"), F.count("*").alias("c"))
    out = rows.groupBy("l_returnflag").agg(F.avg("m").alias("macro"), (F.sum("s") / F.sum("c")).alias("plain"))
    return out.select("l_returnflag", F.round("macro", 4).alias("macro"), F.round(T.retention(F.col("macro"), F.col("plain")), 6).alias("pct"))


SQL["two_level_average"] = """WITH r AS (SELECT l_returnflag, l_orderkey, avg(l_extendedprice) AS m, sum(l_extendedprice) AS s, count(*) AS c FROM lineitem GROUP BY ALL),
o AS (SELECT l_returnflag, avg(m) AS macro, sum(s) / sum(c) AS plain FROM r GROUP BY 1) SELECT l_returnflag, round(macro, 4) AS macro, round(100.0::DOUBLE * macro / plain, 6) AS pct FROM o"""


def planned_observed(spark: SparkSession, d: str) -> DataFrame:
    """Orders without lines of 1994 and lines of orders that there are none of: set equality both ways."""
    planned = table(spark, d, "orders").select("o_orderkey")
    observed = table(spark, d, "lineitem").where(F.year("l_shipdate") != 1994).select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("side"), "n")
    return count(planned.exceptAll(observed), "missing").unionByName(count(observed.exceptAll(planned), "unplanned"))


SQL["planned_observed"] = """SELECT 'missing' AS side, count(*) AS n FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem WHERE year(l_shipdate) <> 1994)
UNION ALL SELECT 'unplanned', count(*) FROM (SELECT l_orderkey FROM lineitem WHERE year(l_shipdate) <> 1994 EXCEPT SELECT o_orderkey FROM orders)"""


def quotes(spark: SparkSession, d: str) -> DataFrame:
    """Exact decimal prices of requests by segment; segments without a price have no quote."""
    price = F.when(F.col("c_mktsegment") != "MACHINERY", F.lit("0.15").cast("decimal(10,4)"))
    rows = table(spark, d, "customer").select("c_mktsegment", M.quote(F.col("c_custkey"), F.col("c_nationkey"), price, price * 4).alias("q"))
    return rows.groupBy("c_mktsegment").agg(F.count("q").alias("n"), F.round(F.sum("q").cast("double"), 9).alias("total"))


SQL["quotes"] = """SELECT c_mktsegment, count(*) FILTER (WHERE c_mktsegment <> 'MACHINERY') AS n, round(CASE WHEN c_mktsegment <> 'MACHINERY' THEN sum((c_custkey * 0.15 + c_nationkey * 0.6) / 1000000) END::DOUBLE, 9) AS total FROM customer GROUP BY c_mktsegment"""


def needle_retention(spark: SparkSession, d: str) -> DataFrame:
    """Whether documents hold all of three needles, white space apart, and which share."""
    whole, share = D.needles(F.col("text"), F.array(F.lit("the"), F.lit("of  and"), F.lit(".")))
    return table(spark, d, "documents").select("doc_id", whole.alias("strict"), F.round(share, 6).alias("recall"))


SQL["needle_retention"] = r"""WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, contains(t, 'the') AND contains(t, 'of and') AND contains(t, '.') AS strict, round((contains(t, 'the')::INT + contains(t, 'of and')::INT + contains(t, '.')::INT) / 3.0::DOUBLE, 6) AS recall FROM f"""


def redacted_events(spark: SparkSession, d: str) -> DataFrame:
    """Event properties as maps with sensitive keys masked."""
    more = F.create_map(*map(F.lit, ("Api_Key", "abc", "password_hint", "none", "kept", "plain")), F.lit("note"), F.concat(F.lit("Bearer t"), F.col("event_id").cast("string"), F.lit(" end")))
    fields = F.map_concat(F.from_json("props", "map<string,string>"), more)
    out = table(spark, d, "events").select("event_type", F.explode(T.redact_map(fields)).alias("key", "value"))
    whole, part = F.col("value") == "[REDACTED]", F.col("value") == "Bearer [REDACTED_TOKEN] end"
    return out.groupBy("event_type", "key").agg(F.count("*").alias("n"), F.count(F.when(whole, 1)).alias("n_redacted"), F.count(F.when(part, 1)).alias("n_masked"))


SQL["redacted_events"] = rf"""WITH m AS (SELECT event_type, unnest(list_concat(list_transform(json_keys(props), lambda k: {{'key': k, 'value': json_extract_string(props, '$.' || k)}}),
 [{{'key': 'Api_Key', 'value': 'abc'}}, {{'key': 'password_hint', 'value': 'none'}}, {{'key': 'kept', 'value': 'plain'}}, {{'key': 'note', 'value': concat('Bearer t', event_id, ' end')}}]), recursive := true) FROM events),
r AS (SELECT event_type, key, CASE WHEN {" OR ".join(f"contains(lower(key), '{s}')" for s in T.SENSITIVE)} THEN '[REDACTED]' ELSE regexp_replace(value, '(?i)Bearer\s+[A-Za-z0-9_\-\.]+', 'Bearer [REDACTED_TOKEN]', 'g') END AS value FROM m)
SELECT event_type, key, count(*) AS n, count(*) FILTER (WHERE value = '[REDACTED]') AS n_redacted, count(*) FILTER (WHERE value = 'Bearer [REDACTED_TOKEN] end') AS n_masked FROM r GROUP BY ALL"""


def redacted_json(spark: SparkSession, d: str) -> DataFrame:
    """Traces as nested JSON: values of sensitive keys go whatever their type and depth, numbers and lists too."""
    n, props = F.col("event_id").cast("string"), F.col("props")
    q = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    made = q('{"props":', props, ',"auth":{"Api_Key":{"value":"', n, '","n":[', n, ',{"x":1}]},"user":"u', n, '","calls":[{"password":', n,
             '},{"note":"Bearer t', n, ' end","at":1.50}]},"secret_text":"', F.repeat(q("\\\"", n), 500), '","credentials":null,"last":"a\\nb"}')
    rows = table(spark, d, "events").select("event_id", "event_type", T.redact_json(made).alias("json"))
    return rows.select("event_id", F.get_json_object("json", "$.auth.user").alias("user"), F.md5(F.col("json").cast("binary")).alias("json_md5"))


SQL["redacted_json"] = """SELECT event_id, concat('u', event_id) AS "user", md5(concat('{"props":', props, ',"auth":{"Api_Key":"[REDACTED]","user":"u', event_id, '","calls":[{"password":"[REDACTED]"},{"note":"Bearer [REDACTED_TOKEN] end","at":1.50}]},"secret_text":"[REDACTED]","credentials":"[REDACTED]","last":"a\\nb"}')) AS json_md5 FROM events"""


for _f in (
    convo_classify, convo_compact, last_user_query, trace_compact, extractive_compress, invariant_check, plan_choice, trace_rollup, strategy_histogram, comparable_totals,
    latency_distribution, nearest_rank_p95, event_stream_rollup, audit_join, pareto_frontier, option_choice, break_even, recall_by_budget, recall_pivot, cost_frontier, macro_retention,
    arm_pairs, common_cohort, paired_discordants, family_accounting, ambiguous_queries, best_attempt, two_level_average, planned_observed, quotes, needle_retention, redacted_events,
    redacted_json,
):
    Q[_f.__name__] = _f
