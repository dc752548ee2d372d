"""Queries of the retrieval channels, fusion, packing and evidence geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.text import content_terms
from quillstone.operators import derive, retrieval as R, sequential
from quillstone.operators.shelves import Shelf
from quillstone.operators.vectors import VectorIndex
from quillstone.plans.common import (
    BLOCKS, INDEX, QUERY_TERMS, RANKED, WORDS_SQL, asked_blocks, asked_documents, benchmark_queries, benchmark_terms, block_rows, block_shelf, block_table, blocks_at, bm25_sql, files, longs,
    query_terms_of, table,
)
from quillstone.scratch import if_small, written

Q: dict = {}
SQL: dict = {}
KEYS = ["path", "ordinal"]
BASE = f"WITH {INDEX}, {QUERY_TERMS}, {bm25_sql()}"


def _top(spark: SparkSession, d: str, k: int = R.CANDIDATES) -> DataFrame:
    """(query_id, path, ordinal, score, rank): each query's best blocks, few enough to be sent to what they are joined with."""
    return if_small(asked_blocks(spark, d).top(benchmark_terms(spark, d), k).drop("b"))


def _shown(df: DataFrame) -> DataFrame:
    return longs(df.select("query_id", "path", "ordinal", F.round("score", 6).alias("score"), "rank"), "ordinal")


def lexical_topk(spark: SparkSession, d: str) -> DataFrame:
    """Each query's best blocks: a task ranks its own ones for all queries."""
    return _shown(_top(spark, d))


SQL["lexical_topk"] = f"""{BASE}, r AS (SELECT query_id, path, ordinal::BIGINT AS ordinal, round(score, 6) AS score, {RANKED} AS rank FROM scores) SELECT * FROM r WHERE rank < 60"""


def boundary_ties(spark: SparkSession, d: str) -> DataFrame:
    """All blocks as good as the tenth: ties at the boundary stay."""
    out = asked_blocks(spark, d).top(benchmark_terms(spark, d), 10, digits=2, ties=True)
    return longs(out.select("query_id", "path", "ordinal", F.round("score", 2).alias("score"), "rank"), "ordinal")


SQL["boundary_ties"] = f"""{BASE}, r AS (SELECT query_id, path, ordinal::BIGINT AS ordinal, round(score, 2) AS score, rank() OVER (PARTITION BY query_id ORDER BY round(score, 2) DESC) - 1 AS rank FROM scores)
SELECT * FROM r WHERE rank < 10"""


def lexical_topk_legacy(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    postings = derive.postings(docs, derive.text_terms(), keys=["doc_id"])
    lengths = docs.select("doc_id", F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).cast("long").alias("dl"))
    terms = benchmark_queries(spark, d).select("query_id", F.explode(F.regexp_extract_all(F.lower("query"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("term"))
    scored = R.legacy_bm25_scores(terms, postings, lengths, keys=["doc_id"])
    out = R.top_k(scored.where("score > 0"), 20, by=[F.round("score", 6).desc(), F.col("doc_id")])
    return out.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


SQL["lexical_topk_legacy"] = rf"""WITH p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({WORDS_SQL.format("text")}) AS term FROM documents) GROUP BY ALL),
l AS (SELECT doc_id, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS dl FROM documents),
q AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS term FROM benchmark) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM p WHERE term IN (SELECT term FROM q) GROUP BY term), n AS (SELECT count(*) AS n, avg(dl) AS a FROM l),
s AS (SELECT query_id, doc_id, sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / greatest(tf + 1.5 * (0.25 + 0.75 * dl / a), 1e-5)) AS score
      FROM p JOIN q USING (term) JOIN df USING (term) JOIN l USING (doc_id), n GROUP BY ALL),
r AS (SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) - 1 AS rank FROM s WHERE score > 0)
SELECT * FROM r WHERE rank < 20"""


def and_search(spark: SparkSession, d: str) -> DataFrame:
    """Blocks with all of a query's terms."""
    return _shown(asked_blocks(spark, d).top(benchmark_terms(spark, d), 10, whole=True))


SQL["and_search"] = rf"""WITH {INDEX},
qw AS (SELECT item_id AS query_id, list_filter({WORDS_SQL.format("text")}, lambda t: length(t) > 1 AND NOT list_contains([{QUERY_TERMS.split("NOT IN (")[1].rsplit("))", 1)[0]}], t)) AS ws FROM benchmark),
qd AS (SELECT query_id, list_filter(ws, lambda t, i: list_position(ws, t) = i) AS ws FROM qw),
query_terms AS (SELECT query_id, unnest(ws) AS term FROM qd), {bm25_sql()},
need AS (SELECT query_id, count(*) AS n FROM query_terms GROUP BY query_id), hits AS (SELECT query_id, path, ordinal, count(*) AS c FROM postings JOIN query_terms USING (term) GROUP BY ALL),
held AS (SELECT query_id, path, ordinal FROM hits JOIN need USING (query_id) WHERE c = n),
r AS (SELECT query_id, path, ordinal::BIGINT AS ordinal, round(score, 6) AS score, {RANKED} AS rank FROM scores JOIN held USING (query_id, path, ordinal)) SELECT * FROM r WHERE rank < 10"""


def bm25_b_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Each query's best block by five values of b, all in one pass over the blocks."""
    return block_shelf(spark, d).top(benchmark_terms(spark, d), 1, b=(0.0, 0.25, 0.5, 0.75, 1.0)).select("b", "query_id", "path")


SQL["bm25_b_sweep"] = f"WITH {INDEX}, {QUERY_TERMS}" + "".join(f", {bm25_sql(f's{i}', b=b)}, r{i} AS (SELECT {b}::DOUBLE AS b, query_id, path, {RANKED} AS rank FROM s{i})" for i, b in enumerate(("0.0", "0.25", "0.5", "0.75", "1.0"))) + "\n" + " UNION ALL ".join(f"SELECT b, query_id, path FROM r{i} WHERE rank = 0" for i in range(5))


def _field_shelf(spark: SparkSession, d: str, terms: DataFrame) -> Shelf:
    """Weighted fields: the text's terms once, those of the path twice; postings of the asked terms."""
    path_terms = F.regexp_extract_all(F.lower("path"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return Shelf.asked(block_rows(spark, d), F.concat(derive.text_terms(), path_terms, path_terms), terms, keys=KEYS)


def field_bm25(spark: SparkSession, d: str) -> DataFrame:
    terms = benchmark_terms(spark, d).unionByName(benchmark_queries(spark, d).select("query_id", F.lit("fr").alias("term"))).distinct()
    return _shown(_field_shelf(spark, d, terms).top(terms, 10))


SQL["field_bm25"] = rf"""WITH {INDEX}, {QUERY_TERMS}, qt AS (SELECT * FROM query_terms UNION SELECT item_id, 'fr' FROM benchmark),
pt AS (SELECT path, ordinal, unnest(regexp_extract_all(lower(path), '[\p{{L}}\p{{N}}]+')) AS term FROM blocks),
fp AS (SELECT path, ordinal, term, sum(tf)::BIGINT AS tf FROM (SELECT path, ordinal, term, tf FROM postings UNION ALL SELECT path, ordinal, term, 2 FROM pt) GROUP BY ALL),
fl AS (SELECT path, ordinal, dl + 2 * len(regexp_extract_all(lower(path), '[\p{{L}}\p{{N}}]+')) AS dl FROM lengths), {bm25_sql("scores", postings="fp", lengths="fl", terms="qt")},
r AS (SELECT query_id, path, ordinal::BIGINT AS ordinal, round(score, 6) AS score, {RANKED} AS rank FROM scores) SELECT * FROM r WHERE rank < 10"""


def _best_docs(spark: SparkSession, d: str, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank): each query's best documents, few enough to be sent to what they are joined with."""
    return if_small(asked_documents(spark, d).top(benchmark_terms(spark, d), k).drop("b"))


def doc_first_gate(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of each query's four best documents only: no others are scored."""
    scored = asked_blocks(spark, d).scores_of(benchmark_terms(spark, d), _best_docs(spark, d, 4), ["doc_id"])
    return _shown(R.top_k(scored, 10, by=R.score_order()))


_DOCS = rf"""dterms AS (SELECT doc_id, unnest({WORDS_SQL.format("text")}) AS term FROM documents), dpost AS (SELECT doc_id, term, count(*) AS tf FROM dterms GROUP BY ALL),
dlen AS (SELECT doc_id, len({WORDS_SQL.format("text")}) AS dl FROM documents),
ddf AS (SELECT term, count(*) AS df FROM dpost WHERE term IN (SELECT term FROM query_terms) GROUP BY term), dn AS (SELECT count(*) AS n, avg(dl) AS a FROM dlen),
dscores AS (SELECT query_id, doc_id, sum(CASE WHEN n - df <= df THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))) AS score
            FROM dpost JOIN query_terms USING (term) JOIN ddf USING (term) JOIN dlen USING (doc_id), dn GROUP BY ALL),
dranks AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) - 1 AS drank FROM dscores)"""
SQL["doc_first_gate"] = f"""{BASE}, {_DOCS},
g AS (SELECT s.* FROM scores s JOIN files f USING (path) JOIN dranks k ON k.query_id = s.query_id AND k.doc_id = f.doc_id WHERE drank < 4),
r AS (SELECT query_id, path, ordinal::BIGINT AS ordinal, round(score, 6) AS score, {RANKED} AS rank FROM g) SELECT * FROM r WHERE rank < 10"""


def doc_first_soft(spark: SparkSession, d: str) -> DataFrame:
    """Block ranks and their documents' ranks fused."""
    top = files(spark, d).select("doc_id", "path").join(_top(spark, d), "path")
    docs = _best_docs(spark, d, R.CANDIDATES).select("query_id", "doc_id", F.col("rank").alias("doc_rank"))
    fused = top.join(docs, ["query_id", "doc_id"], "left").withColumn("score", 1 / (60 + F.col("rank")) + F.coalesce(1 / (60 + F.col("doc_rank")), F.lit(0.0)))
    return _shown(R.top_k(fused.drop("rank"), 10, by=[F.round("score", 9).desc(), F.col("path"), F.col("ordinal")]))


SQL["doc_first_soft"] = f"""{BASE}, {_DOCS}, t AS (SELECT *, {RANKED} AS rk FROM scores),
f2 AS (SELECT t.query_id, t.path, t.ordinal, 1.0::DOUBLE / (60 + rk) + coalesce(1.0::DOUBLE / (60 + drank), 0) AS score FROM t JOIN files f USING (path) LEFT JOIN dranks k ON k.query_id = t.query_id AND k.doc_id = f.doc_id AND drank < 60 WHERE rk < 60),
r AS (SELECT query_id, path, ordinal::BIGINT AS ordinal, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, path, ordinal) - 1 AS rank FROM f2) SELECT * FROM r WHERE rank < 10"""


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    vectors = table(spark, d, "embeddings")
    return vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), vectors


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """The nearest of every twentieth vector among all, from an inverted file whose cells are skipped by an exact bound."""
    queries, every = _vectors(spark, d)
    return VectorIndex.of(every).search(queries, 10).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


def vector_scan(spark: SparkSession, d: str) -> DataFrame:
    """The same without an index, blocks of queries against blocks of vectors."""
    return R.vector_channel(*_vectors(spark, d), 10).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


_VECTORS = """WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id, list_sum(list_transform(list_zip(q.e, v.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) AS score FROM q, embeddings v),
r AS (SELECT query_id, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, vec_id) - 1 AS rank FROM s)"""
SQL["vector_topk"] = SQL["vector_scan"] = _VECTORS + " SELECT * FROM r WHERE rank < 10"


def vector_floor(spark: SparkSession, d: str) -> DataFrame:
    """As ``vector_topk`` for queries turned a little away: those whose best similarity is under the floor get nothing."""
    queries, vectors = _vectors(spark, d)
    scaled = queries.withColumn("query", F.transform("query", lambda x: x * F.when(F.col("query_id") % 40 == 0, 0.3).otherwise(1.0)))
    return R.vector_channel(scaled, vectors, 5, floor=R.DENSE_FLOOR).groupBy("query_id").agg(F.count("*").alias("n"))


SQL["vector_floor"] = f"""{_VECTORS.replace("embedding AS e", "list_transform(embedding, lambda x: x * CASE WHEN vec_id % 40 = 0 THEN 0.3 ELSE 1.0 END) AS e")},
b AS (SELECT query_id, max(score) AS best FROM r GROUP BY query_id) SELECT query_id, count(*) AS n FROM r JOIN b USING (query_id) WHERE best >= {R.DENSE_FLOOR} AND rank < 5 GROUP BY query_id"""


def _channels(spark: SparkSession, d: str) -> DataFrame:
    from quillstone.plans.ingest import _capitals, _names

    lexical = _top(spark, d).select("query_id", F.lit("lexical").alias("channel"), *KEYS, "rank")
    wanted = benchmark_queries(spark, d).select("query_id", F.explode(_names("query")).alias("symbol"))
    symbol = R.symbol_channel(wanted, _capitals(spark, d, block_rows(spark, d))).select("query_id", F.lit("symbol").alias("channel"), *KEYS, "rank")
    return lexical.unionByName(symbol)


def _channels_sql() -> str:
    from quillstone.plans import ingest

    return f"""{BASE}, symbols AS (SELECT path, ordinal, unnest({ingest._NAMES}) AS symbol FROM blocks),
qs AS (SELECT item_id AS query_id, unnest({ingest._NAMES}) AS symbol FROM benchmark),
sh AS (SELECT query_id, path, ordinal, count(*) AS hits FROM symbols JOIN qs USING (symbol) GROUP BY ALL),
sr AS (SELECT query_id, path, ordinal, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, path, ordinal) - 1 AS rank FROM sh),
lr AS (SELECT query_id, path, ordinal, {RANKED} AS rank FROM scores),
ch AS (SELECT query_id, 1 AS ord, 'symbol' AS channel, path, ordinal, rank FROM sr WHERE rank < 60 UNION ALL SELECT query_id, 2, 'lexical', path, ordinal, rank FROM lr WHERE rank < 60)"""


def _fuse_sql(weight: str) -> str:
    return f"""{_channels_sql()}, fused AS (
  SELECT query_id, path, ordinal, sum({weight}::DOUBLE / (60 + rank)) AS fused, list_sort(list({{'ord': ord, 'rank': rank}}))[1] AS first, list(channel ORDER BY ord) AS channels FROM ch GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fused, 9) DESC, first) - 1 AS place FROM fused)"""


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    out = R.fuse(_channels(spark, d))
    return longs(out.where("place < 20").select("query_id", *KEYS, F.round("fused", 9).alias("fused"), F.array_join("channels", "+").alias("channels"), "place"), "ordinal")


SQL["rrf_fusion"] = f"""{_fuse_sql("1.0")} SELECT query_id, path, ordinal::BIGINT AS ordinal, round(fused, 9) AS fused, array_to_string(channels, '+') AS channels, place FROM placed WHERE place < 20"""


def rrf_weighted(spark: SparkSession, d: str) -> DataFrame:
    out = R.fuse(_channels(spark, d), weights={"symbol": 2.0})
    return longs(out.where("place < 20").select("query_id", *KEYS, F.round("fused", 9).alias("fused"), "place"), "ordinal")


SQL["rrf_weighted"] = f"""{_fuse_sql("CASE WHEN ord = 1 THEN 2.0 ELSE 1.0 END")} SELECT query_id, path, ordinal::BIGINT AS ordinal, round(fused, 9) AS fused, place FROM placed WHERE place < 20"""


def interleave(spark: SparkSession, d: str) -> DataFrame:
    lists = _channels(spark, d).withColumn("list", F.when(F.col("channel") == "symbol", 0).otherwise(1))
    return longs(R.interleave(lists, keys=KEYS).where("place < 20"), "ordinal")


SQL["interleave"] = f"""{_channels_sql()}, t AS (SELECT query_id, path, ordinal, min({{'rank': rank, 'ord': ord}}) AS turn FROM ch GROUP BY ALL),
p AS (SELECT query_id, path, ordinal::BIGINT AS ordinal, row_number() OVER (PARTITION BY query_id ORDER BY turn) - 1 AS place FROM t) SELECT * FROM p WHERE place < 20"""


def _sizes(found: DataFrame) -> DataFrame:
    return found.select(*KEYS, F.length("text").cast("long").alias("chars"))


def greedy_pack(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: lexical and symbol channels fused, packed into the default budget, one row a query."""
    fused = R.fuse(_channels(spark, d)).select("query_id", *KEYS, "place")
    out = R.greedy_pack(benchmark_queries(spark, d), fused, _sizes(block_table(spark, d)))
    return out.select("query_id", F.array_join("selected", ",").alias("selected"), "n_selected", "total_tokens", "seed_failed", F.round("reduction_pct", 6).alias("reduction_pct"))


SQL["greedy_pack"] = f"""{_fuse_sql("1.0")},
c AS (SELECT query_id, list({{'used': length(text)::BIGINT, 'kept': [concat(path, '#', ordinal)], 'n': 0::BIGINT}} ORDER BY place) AS c FROM placed JOIN blocks USING (path, ordinal) GROUP BY query_id),
f AS (SELECT query_id, list_reduce(c, lambda a, x: CASE WHEN greatest(1, (a.used + x.used + CASE WHEN a.n > 0 THEN 2 ELSE 0 END) // 4) <= 2000
        THEN {{'used': a.used + x.used + CASE WHEN a.n > 0 THEN 2 ELSE 0 END, 'kept': list_concat(a.kept, x.kept), 'n': a.n + 1}} ELSE a END,
        {{'used': 0::BIGINT, 'kept': []::VARCHAR[], 'n': 0::BIGINT}}) AS s FROM c),
n AS (SELECT greatest(1, (sum(length(text)) + 2 * (count(*) - 1)) // 4) AS available FROM blocks)
SELECT item_id AS query_id, coalesce(array_to_string(s.kept, ','), '') AS selected, coalesce(s.n, 0) AS n_selected, CASE WHEN coalesce(s.n, 0) > 0 THEN greatest(1, s.used // 4) ELSE 0 END::BIGINT AS total_tokens,
coalesce(s.n, 0) = 0 AS seed_failed, CASE WHEN s.n > 0 THEN round(100.0::DOUBLE * (available - greatest(1, s.used // 4)) / available, 6) END AS reduction_pct
FROM benchmark LEFT JOIN f ON item_id = f.query_id, n"""


def fill_budget(spark: SparkSession, d: str) -> DataFrame:
    """Blocks by score while their own estimates fit 1,000 tokens: no separators."""
    cost = F.greatest(F.lit(1), F.floor(F.col("chars") / F.lit(3.8))).cast("long")
    top = _top(spark, d, 30).join(_sizes(block_table(spark, d)), KEYS)
    listed = top.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", cost.alias("cost")))).alias("c"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("n"))

    def step(s, c):
        fits = s["used"] + c["cost"] <= 1000
        return F.struct(F.when(fits, s["used"] + c["cost"]).otherwise(s["used"]).alias("used"), F.when(fits, s["n"] + 1).otherwise(s["n"]).alias("n"))

    return listed.select("query_id", F.aggregate("c", start, step).alias("s")).select("query_id", "s.used", F.col("s.n").alias("n_kept"))


SQL["fill_budget"] = f"""{BASE}, t AS (SELECT query_id, path, ordinal, {RANKED} AS rank FROM scores),
c AS (SELECT query_id, list({{'used': greatest(1, floor(length(text) / 3.8::DOUBLE))::BIGINT, 'n': 1::BIGINT}} ORDER BY rank) AS c FROM t JOIN blocks USING (path, ordinal) WHERE rank < 30 GROUP BY query_id),
s AS (SELECT query_id, list_reduce(c, lambda a, x: CASE WHEN a.used + x.used <= 1000 THEN {{'used': a.used + x.used, 'n': a.n + 1}} ELSE a END, {{'used': 0::BIGINT, 'n': 0::BIGINT}}) AS s FROM c)
SELECT query_id, s.used AS used, s.n AS n_kept FROM s"""


def risk_bands(spark: SparkSession, d: str) -> DataFrame:
    """Coverage of each query's content terms by its three best fused blocks, and the band that follows."""
    kept = R.fuse(_channels(spark, d)).where("place < 3").join(block_table(spark, d).select(*KEYS, "text"), KEYS)
    joined = kept.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "\n").alias("text"), F.bool_or(F.size("channels") > 1).alias("overlap"))
    out = benchmark_queries(spark, d).join(joined, "query_id", "left").withColumn("terms", content_terms(F.col("query")))
    covered = R.coverage(F.col("terms"), F.coalesce("text", F.lit("")))
    return out.select("query_id", F.round(covered, 6).alias("coverage"), R.risk_band(covered, F.coalesce("overlap", F.lit(False)), F.col("text").isNull()).alias("band"))


_FUNCTION_SQL = f"[{QUERY_TERMS.split('NOT IN (')[1].rsplit('))', 1)[0]}]"
SQL["risk_bands"] = rf"""{_fuse_sql("1.0")}, k AS (SELECT query_id, string_agg(text, chr(10) ORDER BY place) AS text, bool_or(len(channels) > 1) AS overlap FROM placed JOIN blocks USING (path, ordinal) WHERE place < 3 GROUP BY query_id),
q AS (SELECT item_id AS query_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS ws FROM benchmark),
p AS (SELECT query_id, list_concat(ws, list_filter(flatten(list_transform(ws, lambda w: CASE WHEN contains(w, '_') THEN string_split(w, '_') ELSE [] END)), lambda x: length(x) > 2),
 list_filter(flatten(list_transform(ws, lambda w: CASE WHEN len(regexp_extract_all(w, '[a-z]+|[0-9]+')) > 1 THEN regexp_extract_all(w, '[a-z]+|[0-9]+') ELSE [] END)), lambda x: length(x) > 2)) AS ts FROM q),
t AS (SELECT query_id, list_filter(list_distinct(ts), lambda x: length(x) > 2 AND NOT list_contains({_FUNCTION_SQL}, x)) AS ts FROM p),
c AS (SELECT t.query_id, k.text, coalesce(overlap, false) AS overlap, CASE WHEN len(ts) = 0 THEN 1.0::DOUBLE ELSE len(list_filter(ts, lambda x: contains(lower(coalesce(k.text, '')), x))) / len(ts)::DOUBLE END AS cov FROM t LEFT JOIN k USING (query_id))
SELECT query_id, round(cov, 6) AS coverage, concat('uncalibrated:', CASE WHEN text IS NULL THEN 'maximum' WHEN cov >= 0.8 AND overlap THEN 'low' WHEN cov >= 0.5 OR overlap THEN 'moderate' ELSE 'high' END) AS band FROM c"""


def candidates(spark: SparkSession, d: str) -> DataFrame:
    top = _top(spark, d, 30).join(_sizes(block_table(spark, d)), KEYS)
    near = F.array((F.col("rank") - 1).cast("int"), (F.col("rank") + 1).cast("int"))
    return top.select("query_id", F.col("rank").alias("idx"), "score", F.greatest(F.lit(1), F.floor(F.col("chars") / 4)).alias("cost"), near.alias("near"))


def info_gain_select(spark: SparkSession, d: str) -> DataFrame:
    return sequential.gain_select(candidates(spark, d), budget=2000)


def grouped_pack(spark: SparkSession, d: str) -> DataFrame:
    top = _top(spark, d, 30).join(_sizes(block_table(spark, d)), KEYS)
    return sequential.grouped_pack(top.select("query_id", F.col("rank").alias("place"), F.substring_index("path", "/", 1).alias("grp"), "chars"), budget=2000)


def neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The blocks beside each query's best one, in its file."""
    seeds = _top(spark, d, 1).select(*KEYS)
    return longs(R.neighbours(block_table(spark, d), seeds).select("path", "ordinal", "start_line", "end_line"), "ordinal", "start_line", "end_line")


SQL["neighbours"] = f"""{BASE}, t AS (SELECT path, ordinal, {RANKED} AS rank FROM scores), s AS (SELECT DISTINCT path, ordinal FROM t WHERE rank = 0)
SELECT DISTINCT b.path, b.ordinal::BIGINT AS ordinal, b.start_line::BIGINT AS start_line, b.end_line::BIGINT AS end_line FROM blocks b JOIN s ON b.path = s.path AND abs(b.ordinal - s.ordinal) <= 1"""


def _spans(spark: SparkSession, d: str) -> DataFrame:
    """Windows of ten lines around each line that mentions a frequent short word: they touch and overlap."""
    rows = files(spark, d).select("path", F.posexplode(F.split("text", "\n")).alias("at", "line")).where(F.col("line").rlike(r"(^|[^a-z])(under|license)([^a-z]|$)|^The "))
    return rows.select("path", F.greatest(F.lit(1), F.col("at") - 1).cast("long").alias("start_line"), (F.col("at") + 2).cast("long").alias("end_line"))


_SPANS = rf"""{BLOCKS.split("raw_lines")[0].rstrip().rstrip(",")}, sl AS (SELECT path, string_split(text, chr(10)) AS l FROM files), sp AS (SELECT path, unnest(l) AS line, unnest(range(0, len(l))) AS pos FROM sl),
spans AS (SELECT path, greatest(1, pos - 1) AS start_line, pos + 2 AS end_line FROM sp WHERE regexp_matches(line, '(^|[^a-z])(under|license)([^a-z]|$)|^The ')),
o AS (SELECT *, max(end_line) OVER (PARTITION BY path ORDER BY start_line, end_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM spans),
i AS (SELECT *, sum((m IS NULL OR start_line > m + 1)::BIGINT) OVER (PARTITION BY path ORDER BY start_line, end_line ROWS UNBOUNDED PRECEDING) AS island FROM o),
united AS (SELECT path, min(start_line) AS start_line, max(end_line) AS end_line, count(*) AS n FROM i GROUP BY path, island)"""


def coalesce_spans(spark: SparkSession, d: str) -> DataFrame:
    return R.coalesce_spans(_spans(spark, d))


SQL["coalesce_spans"] = f"WITH {_SPANS} SELECT * FROM united"


def span_coverage(spark: SparkSession, d: str) -> DataFrame:
    required = files(spark, d).select(F.col("doc_id").alias("req_id"), "path", F.lit(1).cast("long").alias("start_line"), F.lit(2).cast("long").alias("end_line"))
    return R.covers(_spans(spark, d), required).groupBy("covered").agg(F.count("*").alias("n"))


SQL["span_coverage"] = f"""WITH {_SPANS}, c AS (SELECT doc_id, bool_or(coalesce(u.start_line <= 1 AND u.end_line >= 2, false)) AS covered FROM files f LEFT JOIN united u ON f.path = u.path GROUP BY doc_id)
SELECT covered, count(*) AS n FROM c GROUP BY covered"""


def span_overlap(spark: SparkSession, d: str) -> DataFrame:
    spans = R.coalesce_spans(_spans(spark, d)).select("path", "start_line", "end_line")
    found = block_table(spark, d)
    a = spans.withColumn("a_id", F.concat_ws(":", "path", "start_line"))
    b = found.select("path", F.concat_ws("#", "path", "ordinal").alias("b_id"), F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"))
    return R.overlaps(a, b).groupBy("b_id").agg(F.count("*").alias("n"))


SQL["span_overlap"] = f"""WITH {BLOCKS}, {_SPANS.replace(BLOCKS.split("raw_lines")[0].rstrip().rstrip(",") + ", ", "")}
SELECT concat(b.path, '#', b.ordinal) AS b_id, count(*) AS n FROM blocks b JOIN united u ON b.path = u.path AND u.start_line <= b.end_line AND b.start_line <= u.end_line GROUP BY ALL"""


def snippets(spark: SparkSession, d: str) -> DataFrame:
    """A window of words around the first mention of a term in each query's best block."""
    best = _top(spark, d, 1)
    best = blocks_at(spark, d, best).select(*KEYS, "text").join(best, KEYS)
    first = benchmark_queries(spark, d).select("query_id", F.element_at(F.regexp_extract_all(F.lower("query"), F.lit(r"\S+"), F.lit(0)), 1).alias("term"))
    return best.join(first, "query_id").select("query_id", R.snippet(F.col("text"), F.col("term")).alias("snippet"))


SQL["snippets"] = rf"""{BASE}, t AS (SELECT *, {RANKED} AS rank FROM scores), b AS (SELECT query_id, string_split_regex(text, '\s+') AS ts FROM t JOIN blocks USING (path, ordinal) WHERE rank = 0),
a AS (SELECT query_id, ts, coalesce(list_position(list_transform(ts, lambda x: lower(x)), regexp_extract(lower(text), '\S+')), 0) AS pos FROM b JOIN benchmark ON item_id = query_id)
SELECT query_id, array_to_string(ts[greatest(1, pos - 12):greatest(1, pos - 12) + 23], ' ') AS snippet FROM a"""


def labelled_pack(spark: SparkSession, d: str) -> DataFrame:
    """Blocks under a label with their source, the label charged to the budget."""
    found = block_rows(spark, d)
    label = F.concat(F.lit("[Source: "), F.col("path"), F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit("]\n"))
    sizes = written(found.select(*KEYS, (F.length(label) + F.length("text")).cast("long").alias("chars")), "sizes")
    top = _top(spark, d, 30).select("query_id", *KEYS, F.col("rank").alias("place"))
    return R.greedy_pack(benchmark_queries(spark, d), top, sizes, budget=1000).select("query_id", "n_selected", "total_tokens")


SQL["labelled_pack"] = f"""{BASE}, t AS (SELECT query_id, path, ordinal, {RANKED} AS place FROM scores),
c AS (SELECT query_id, list({{'used': length(concat('[Source: ', path, ':', start_line, '-', end_line, ']' || chr(10), text))::BIGINT, 'n': 0::BIGINT}} ORDER BY place) AS c FROM t JOIN blocks USING (path, ordinal) WHERE place < 30 GROUP BY query_id),
f AS (SELECT query_id, list_reduce(c, lambda a, x: CASE WHEN greatest(1, (a.used + x.used + CASE WHEN a.n > 0 THEN 2 ELSE 0 END) // 4) <= 1000
        THEN {{'used': a.used + x.used + CASE WHEN a.n > 0 THEN 2 ELSE 0 END, 'n': a.n + 1}} ELSE a END, {{'used': 0::BIGINT, 'n': 0::BIGINT}}) AS s FROM c)
SELECT item_id AS query_id, coalesce(s.n, 0) AS n_selected, CASE WHEN coalesce(s.n, 0) > 0 THEN greatest(1, s.used // 4) ELSE 0 END::BIGINT AS total_tokens FROM benchmark LEFT JOIN f ON item_id = f.query_id"""


def widened(spark: SparkSession, d: str) -> DataFrame:
    """Queries that find nothing among the first few are asked again with four times the limit."""
    top = _top(spark, d, 5 * R.WIDEN).where("ordinal > 0")
    first = top.where("rank < 5").groupBy("query_id").agg(F.count("*").alias("n_first"))
    wide = top.groupBy("query_id").agg(F.count("*").alias("n_wide"))
    out = benchmark_queries(spark, d).select("query_id").join(first, "query_id", "left").join(wide, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select("query_id", F.when(zero("n_first") > 0, F.col("n_first")).otherwise(zero("n_wide")).cast("long").alias("n"), (zero("n_first") == 0).alias("widened"))


SQL["widened"] = f"""{BASE}, t AS (SELECT query_id, ordinal, {RANKED} AS rank FROM scores), c AS (SELECT query_id, count(*) FILTER (WHERE rank < 5) AS a, count(*) AS b FROM t WHERE rank < 20 AND ordinal > 0 GROUP BY query_id)
SELECT item_id AS query_id, CASE WHEN coalesce(a, 0) > 0 THEN a ELSE coalesce(b, 0) END AS n, coalesce(a, 0) = 0 AS widened FROM benchmark LEFT JOIN c ON item_id = query_id"""


def spelling_index(spark: SparkSession, d: str) -> DataFrame:
    """Normal forms that several spellings share."""
    words = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("form")).distinct()
    from quillstone.functions.text import fold

    return words.groupBy(fold(F.col("form")).alias("norm")).agg(F.count("*").alias("n_forms"), F.min("form").alias("first_form")).where("n_forms > 1")


SQL["spelling_index"] = r"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS form FROM documents)
SELECT strip_accents(lower(form)) AS norm, count(*) AS n_forms, min(form) AS first_form FROM w GROUP BY 1 HAVING count(*) > 1"""


def clause_rrf(spark: SparkSession, d: str) -> DataFrame:
    """Each sentence of a query ranks blocks by itself; the ranks are fused."""
    parts = benchmark_queries(spark, d).select("query_id", F.posexplode(F.split("query", r"[.;?!]\s+")).alias("clause", "text"))
    terms = parts.select((F.col("query_id") * 1000 + F.col("clause")).alias("query_id"), F.explode(query_terms_of(F.col("text"))).alias("term"))
    top = block_shelf(spark, d).top(terms, 20)
    fused = top.groupBy(F.floor(F.col("query_id") / 1000).alias("query_id"), *KEYS).agg(F.sum(1.0 / (60 + F.col("rank"))).alias("score"))
    return _shown(R.top_k(fused, 10, by=[F.round("score", 9).desc(), F.col("path"), F.col("ordinal")]))


SQL["clause_rrf"] = rf"""WITH {INDEX}, cl AS (SELECT item_id, string_split_regex(text, '[.;?!]\s+') AS c FROM benchmark), ce AS (SELECT item_id * 1000 + i AS qid, c[i + 1] AS text FROM (SELECT *, unnest(range(0, len(c))) AS i FROM cl)),
query_terms AS (SELECT DISTINCT qid AS query_id, term FROM (SELECT qid, unnest({WORDS_SQL.format("text")}) AS term FROM ce) WHERE length(term) > 1 AND term NOT IN ({QUERY_TERMS.split("NOT IN (")[1].rsplit("))", 1)[0]})),
{bm25_sql()}, t AS (SELECT *, {RANKED} AS rk FROM scores), u AS (SELECT query_id // 1000 AS query_id, path, ordinal, sum(1.0::DOUBLE / (60 + rk)) AS score FROM t WHERE rk < 20 GROUP BY ALL),
r AS (SELECT query_id, path, ordinal::BIGINT AS ordinal, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, path, ordinal) - 1 AS rank FROM u) SELECT * FROM r WHERE rank < 10"""


def evidence_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether the best documents of each passage hold it: recall by cut-off."""
    texts = table(spark, d, "documents").select("doc_id", "text")
    flat = lambda c: F.regexp_replace(c, r"\s+", " ")
    held = texts.join(_best_docs(spark, d, 20), "doc_id").join(benchmark_queries(spark, d), "query_id").select("query_id", "rank", F.contains(flat("text"), flat("query")).cast("int").alias("hit"))
    first = held.groupBy("query_id").agg(F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"))
    cut = first.select("query_id", "first", F.explode(F.array(*map(F.lit, (1, 5, 20)))).alias("k"))
    return cut.groupBy(F.col("k").cast("long").alias("k")).agg(F.count("*").alias("n"), F.count(F.when(F.col("first") < F.col("k"), 1)).alias("n_hit"))


SQL["evidence_recall"] = rf"""WITH {QUERY_TERMS}, {_DOCS}, h AS (SELECT k.query_id, drank, contains(regexp_replace(d.text, '\s+', ' ', 'g'), regexp_replace(b.text, '\s+', ' ', 'g')) AS hit
  FROM dranks k JOIN benchmark b ON b.item_id = k.query_id JOIN documents d ON d.doc_id = k.doc_id WHERE drank < 20),
f AS (SELECT query_id, min(drank) FILTER (WHERE hit) AS first FROM h GROUP BY query_id)
SELECT k::BIGINT AS k, count(*) AS n, count(*) FILTER (WHERE first < k) AS n_hit FROM f, (VALUES (1), (5), (20)) v(k) GROUP BY k"""

for _f in (
    lexical_topk, boundary_ties, lexical_topk_legacy, and_search, bm25_b_sweep, field_bm25, doc_first_gate, doc_first_soft, vector_topk, vector_scan, vector_floor, rrf_fusion, rrf_weighted,
    interleave, greedy_pack, fill_budget, risk_bands, info_gain_select, grouped_pack, neighbours, coalesce_spans, span_coverage, span_overlap, snippets, labelled_pack, widened,
    spelling_index, clause_rrf, evidence_recall,
):
    Q[_f.__name__] = _f
