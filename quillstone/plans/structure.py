"""Queries of definitions, passages and frontiers of several measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import chunks, decide, derive, encoders, passages
from quillstone.operators.modules import Definitions
from quillstone.plans.common import INDEX, QUERY_TERMS, RANKED, benchmark_queries, benchmark_terms, block_shelf, block_table, bm25_sql, files, table
from quillstone.scratch import if_small, written

Q: dict = {}
SQL: dict = {}

#: A module for each document K, which takes a function from that of document B; lines 1 to 17.
MODULE = """from pkg.m{B} import f{B}
LIMIT{K} = {K}
def f{K}(x=LIMIT{K}):
    return f{B}(x) + g{K}()

def g{K}():
    return LIMIT{K}

class C{K}:
    def __init__(self):
        self.a = f{K}()

    def run(self):
        return self.step() + self.a

    def step(self):
        return g{K}()
"""


def modules(spark: SparkSession, d: str) -> DataFrame:
    """(k, path, text): a Python file for each document, derived from its id."""
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("k"), (2 * F.col("doc_id") + 1).cast("string").alias("b"))
    return rows.select("k", F.concat(F.lit("pkg/m"), "k", F.lit(".py")).alias("path"), F.replace(F.replace(F.lit(MODULE), F.lit("{K}"), F.col("k")), F.lit("{B}"), F.col("b")).alias("text"))


def definition_links(spark: SparkSession, d: str) -> DataFrame:
    """How many links each unit has, by what it is, and what they lead to."""
    made = Definitions(modules(spark, d))
    name = lambda c: F.regexp_replace(c, r"^pkg/m\d+\.py:", "")
    return made.links.groupBy(name("src").alias("src"), name("dst").alias("dst")).agg(F.count("*").alias("n"))


#: Links within a module and, marked, to the module that it imports from: by the template above.
_WITHIN = [
    ("3-4:FunctionDef", "1-1:ImportFrom"), ("3-4:FunctionDef", "2-2:Assign"), ("3-4:FunctionDef", "6-7:FunctionDef"), ("6-7:FunctionDef", "2-2:Assign"),
    ("9-17:ClassDef", "3-4:FunctionDef"), ("9-17:ClassDef", "6-7:FunctionDef"), ("10-11:FunctionDef", "3-4:FunctionDef"),
    ("13-14:FunctionDef", "16-17:FunctionDef"), ("13-14:FunctionDef", "10-11:FunctionDef"), ("16-17:FunctionDef", "6-7:FunctionDef"),
]
_LINKS = f"""m AS (SELECT DISTINCT doc_id AS k, 2 * doc_id + 1 AS b FROM documents),
within AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in _WITHIN)}) v(src, dst)),
links AS (SELECT concat('pkg/m', k, '.py:', src) AS src, concat('pkg/m', k, '.py:', dst) AS dst FROM m, within
  UNION SELECT concat('pkg/m', k, '.py:1-1:ImportFrom'), concat('pkg/m', b, '.py:3-4:FunctionDef') FROM m WHERE b IN (SELECT k FROM m))"""
SQL["definition_links"] = rf"WITH {_LINKS} SELECT regexp_replace(src, '^pkg/m\d+\.py:', '') AS src, regexp_replace(dst, '^pkg/m\d+\.py:', '') AS dst, count(*) AS n FROM links WHERE src <> dst GROUP BY ALL"


def definition_closures(spark: SparkSession, d: str) -> DataFrame:
    """What a link closure of two and of four links brings for the method that each module's class runs."""
    found = modules(spark, d)
    made = Definitions(found)
    seeds = found.select(F.col("k").cast("long").alias("query_id"), F.concat("path", F.lit(":13-14:FunctionDef")).alias("node")).distinct()
    out = None
    for depth in (2, 4):
        nodes = made.closure(seeds, depth)
        spans = made.pieces(nodes, ["query_id"]).groupBy("query_id").agg(F.count("*").alias("n_pieces"), F.sum(F.col("end_line") - F.col("start_line") + 1).alias("n_lines"))
        rows = nodes.groupBy("query_id").agg(F.count("*").alias("n_units"), F.max("hop").cast("long").alias("far")).join(spans, "query_id").withColumn("depth", F.lit(depth).cast("long"))
        out = rows if out is None else out.unionByName(rows)
    return out


SQL["definition_closures"] = rf"""WITH RECURSIVE {_LINKS.replace("m AS (", "m AS MATERIALIZED (", 1)},
r AS (SELECT k AS query_id, concat('pkg/m', k, '.py:13-14:FunctionDef') AS node, 0 AS hop FROM m UNION SELECT query_id, dst, hop + 1 FROM r JOIN links ON node = src WHERE hop < 4 AND src <> dst),
n AS (SELECT query_id, node, min(hop) AS hop FROM r GROUP BY ALL), c AS (SELECT depth, query_id, node, hop FROM n, (VALUES (2), (4)) v(depth) WHERE hop <= depth),
l AS (SELECT DISTINCT depth, query_id, split_part(node, ':', 1) AS path, unnest(range(split_part(split_part(node, ':', 2), '-', 1)::INT, split_part(split_part(node, ':', 2), '-', 2)::INT + 1)) AS line FROM c),
i AS (SELECT *, line - row_number() OVER (PARTITION BY depth, query_id, path ORDER BY line) AS island FROM l),
p AS (SELECT depth, query_id, count(DISTINCT concat(path, '#', island)) AS n_pieces, count(*) AS n_lines FROM i GROUP BY ALL)
SELECT c.query_id, count(*) AS n_units, max(c.hop)::BIGINT AS far, any_value(p.n_pieces) AS n_pieces, any_value(p.n_lines)::BIGINT AS n_lines, c.depth::BIGINT AS depth
FROM c JOIN p ON c.depth = p.depth AND c.query_id = p.query_id GROUP BY c.query_id, c.depth"""


def passage_modes(spark: SparkSession, d: str) -> DataFrame:
    """Each query's best block as a passage in four modes, narrowed to the block where the passage does not fit."""
    best = block_shelf(spark, d).top(benchmark_terms(spark, d), 1).select("query_id", F.col("rank").cast("int").alias("rank"), "path", "ordinal")
    named = if_small(written(best.select("path").distinct(), "paths"))
    found = written(block_table(spark, d).drop("text").join(named, "path", "left_semi"), "near")  # of a file a query
    texts = written(files(spark, d).select("path", F.regexp_replace("text", "\r\n?", "\n").alias("text")).join(named, "path", "left_semi"), "texts")
    out = None
    for mode in passages.REACH:
        options = passages.passage_options(best, found, texts, mode)
        made = passages.assemble(options, texts, benchmark_queries(spark, d), budget=4000)
        shown = F.array_join(F.transform("pieces", lambda p: F.concat_ws(":", p["path"], p["start_line"], p["end_line"])), ",")
        rows = made.select("query_id", F.lit(mode).alias("mode"), F.coalesce(shown, F.lit("")).alias("pieces"), "tokens", "n_narrowed", "status")
        out = rows if out is None else out.unionByName(rows)
    return out


SQL["passage_modes"] = rf"""WITH {INDEX}, {QUERY_TERMS}, {bm25_sql()}, t AS (SELECT query_id, path, ordinal, {RANKED} AS rank FROM scores),
s AS (SELECT t.query_id, b.path, b.ordinal, b.start_line AS lo, b.end_line AS hi FROM t JOIN blocks b USING (path, ordinal) WHERE rank = 0),
modes AS (SELECT * FROM (VALUES ('seed', 0), ('neighbor1', 1), ('neighbor2', 2), ('paragraph', 4)) v(mode, reach)),
seen AS (SELECT DISTINCT mode, query_id, s.path, lo, hi, unnest(range(b.start_line, b.end_line + 1)) AS line FROM s JOIN modes ON true JOIN blocks b ON b.path = s.path AND abs(b.ordinal - s.ordinal) <= reach),
told AS (SELECT seen.*, NOT regexp_matches(coalesce(l[line], ''), '\S') AS blank FROM seen JOIN raw_lines r ON r.path = seen.path),
near AS (SELECT *, line - row_number() OVER (PARTITION BY mode, query_id ORDER BY line) AS island FROM told),
own AS (SELECT mode, query_id, any_value(island) AS island FROM near WHERE line = lo GROUP BY ALL),
para AS (SELECT mode, query_id, max(line) FILTER (WHERE blank AND line < lo) AS up, min(line) FILTER (WHERE blank AND line > hi) AS down FROM near JOIN own USING (mode, query_id, island) GROUP BY ALL),
grp AS (SELECT mode, query_id, path, lo, hi, min(line) AS a, max(line) AS z, island, any_value(own.island) AS mine FROM near JOIN own USING (mode, query_id, island) GROUP BY ALL),
wide AS (SELECT g.mode, g.query_id, g.path, g.lo, g.hi, CASE WHEN g.mode = 'paragraph' THEN coalesce(up + 1, a) ELSE a END AS a, CASE WHEN g.mode = 'paragraph' THEN coalesce(down - 1, z) ELSE z END AS z FROM grp g JOIN para USING (mode, query_id)),
cost AS (SELECT w.*, greatest(1, (length(concat('[Source: ', w.path, ':', w.a, '-', w.z, ']' || chr(10))) + length(array_to_string(l[w.a:w.z], chr(10)))) // 4) AS wide_tokens,
  greatest(1, (length(concat('[Source: ', w.path, ':', w.lo, '-', w.hi, ']' || chr(10))) + length(array_to_string(l[w.lo:w.hi], chr(10)))) // 4) AS own_tokens FROM wide w JOIN raw_lines r ON r.path = w.path),
o AS (SELECT query_id, mode, CASE WHEN wide_tokens <= 4000 THEN concat(path, ':', a, ':', z) WHEN own_tokens <= 4000 THEN concat(path, ':', lo, ':', hi) ELSE '' END AS pieces,
  CASE WHEN wide_tokens <= 4000 THEN wide_tokens WHEN own_tokens <= 4000 THEN own_tokens ELSE 0 END AS tokens, (wide_tokens > 4000 AND own_tokens <= 4000)::BIGINT AS n_narrowed,
  CASE WHEN wide_tokens > 4000 AND own_tokens > 4000 THEN 'fallback_required' WHEN wide_tokens > 4000 THEN 'incomplete' ELSE 'selected' END AS status FROM cost)
SELECT item_id AS query_id, modes.mode AS mode, coalesce(pieces, '') AS pieces, coalesce(tokens, 0)::BIGINT AS tokens, coalesce(n_narrowed, 0) AS n_narrowed, coalesce(status, 'fallback_required') AS status
FROM benchmark JOIN modes ON true LEFT JOIN o ON o.query_id = item_id AND o.mode = modes.mode"""


def pareto_three(spark: SparkSession, d: str) -> DataFrame:
    """Orders of a priority that no other one beats in price, date and customer number at once."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", F.unix_timestamp("o_orderdate").alias("at"), "o_custkey")
    return decide.pareto(rows, minimize=["o_totalprice", "at"], maximize=["o_custkey"], group="o_orderpriority").select("o_orderkey", "o_orderpriority")


SQL["pareto_three"] = """SELECT o_orderkey, o_orderpriority FROM orders a WHERE NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_orderpriority = a.o_orderpriority AND b.o_totalprice <= a.o_totalprice AND b.o_orderdate <= a.o_orderdate
  AND b.o_custkey >= a.o_custkey AND (b.o_totalprice < a.o_totalprice OR b.o_orderdate < a.o_orderdate OR b.o_custkey > a.o_custkey))"""

def chunk_verify(spark: SparkSession, d: str) -> DataFrame:
    """Documents as chunks in a store that has lost some and holds some others wrongly: what is found out about each document."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    refs = derive.fixed_chunks(docs, 512)
    hurt = F.when(F.col("hash").startswith("11"), F.concat("chunk", F.lit(b"!"))).otherwise(F.col("chunk"))
    store = derive.chunk_store(refs).where(~F.col("hash").startswith("00")).withColumn("chunk", hurt)
    wanted = docs.select("doc_id", F.octet_length("text").alias("size"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    return chunks.verify(refs, store, wanted, key="doc_id")


SQL["chunk_verify"] = """WITH c AS (SELECT doc_id, hex(encode(text)) AS h, unnest(range(0, strlen(text), 512)) AS i FROM documents),
p AS (SELECT doc_id, sha256(unhex(h[2 * i + 1:2 * (i + 512)])) AS hash FROM c),
n AS (SELECT doc_id, count(*) AS n_chunks, count(*) FILTER (WHERE hash LIKE '00%') AS n_missing, count(*) FILTER (WHERE hash LIKE '11%') AS n_damaged FROM p GROUP BY doc_id)
SELECT doc_id, CASE WHEN n_missing > 0 THEN 'missing' WHEN n_damaged > 0 THEN 'damaged' ELSE 'ok' END AS status, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_missing, 0) AS n_missing, coalesce(n_damaged, 0) AS n_damaged
FROM documents LEFT JOIN n USING (doc_id)"""


def ngram_dense(spark: SparkSession, d: str) -> DataFrame:
    """The documents nearest to each passage by hashed words and runs of characters: the encoder slot's baseline."""
    queries = benchmark_queries(spark, d).withColumnRenamed("query", "text")
    out = encoders.score_blocks(queries, table(spark, d, "documents"), encoders.HashedGrams(), 5, keys=["doc_id"])
    return out.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


_GRAMS = r"""SELECT id, w AS g, 1.0::DOUBLE AS v FROM (SELECT id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM {0})
  UNION ALL SELECT id, lower(substring(text, i, 3)), 0.5::DOUBLE FROM (SELECT id, text, unnest(range(1, length(text) - 1)) AS i FROM {0})"""
SQL["ngram_dense"] = f"""WITH ds AS (SELECT doc_id AS id, text FROM documents), qs AS (SELECT item_id AS id, text FROM benchmark),
dg AS ({_GRAMS.replace("{0}", "ds")}), qg AS ({_GRAMS.replace("{0}", "qs")}),
h AS (SELECT g, (concat('0x', substr(md5(g), 1, 8))::BIGINT) % 1024 AS c FROM (SELECT g FROM dg UNION SELECT g FROM qg)),
dv AS (SELECT id, c, sum(v * n) AS v FROM (SELECT id, g, any_value(v) AS v, count(*) AS n FROM dg GROUP BY id, g, v) JOIN h USING (g) GROUP BY id, c),
qv AS (SELECT id, c, sum(v * n) AS v FROM (SELECT id, g, any_value(v) AS v, count(*) AS n FROM qg GROUP BY id, g, v) JOIN h USING (g) GROUP BY id, c),
dn AS (SELECT id, sqrt(sum(v * v)) AS n FROM dv GROUP BY id), qn AS (SELECT id, sqrt(sum(v * v)) AS n FROM qv GROUP BY id),
s AS (SELECT q.id AS query_id, d.id AS doc_id, sum(q.v * d.v) / any_value(qn.n) / any_value(dn.n) AS score FROM qv q JOIN dv d ON q.c = d.c JOIN qn ON qn.id = q.id JOIN dn ON dn.id = d.id GROUP BY ALL),
a AS (SELECT q.id AS query_id, d.id AS doc_id, coalesce(score, 0) AS score FROM qs q CROSS JOIN ds d LEFT JOIN s ON s.query_id = q.id AND s.doc_id = d.id),
r AS (SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) - 1 AS rank FROM a) SELECT * FROM r WHERE rank < 5"""


for _f in (chunk_verify, ngram_dense, definition_links, definition_closures, passage_modes, pareto_three):
    Q[_f.__name__] = _f
