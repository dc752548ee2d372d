"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import common, jaccard, lines, mixing, packing, perplexity, phrases, pii, resample, sharding, tokens, wand, warc, webp


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Share of a site's pages beyond which a line is boilerplate, and the pages a site needs to be judged.
LINE_RATIO, LINE_PAGES = 0.1, 5


def op3_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", lines.host_of(F.col("url")).alias("host"), "html")
    pages = common.written(pages.withColumn("text", lines.page_text(F.col("html"))).drop("html"), "texts")  # read three times
    out = lines.drop_site_lines(pages, F.col("host"), F.col("text"), max_ratio=LINE_RATIO, min_pages=LINE_PAGES)
    return out.select("page_id", "host", "n_lines", "n_dropped", "text")


OP3_SQL = f"""
WITH p AS (
  SELECT page_id, nullif(lower(regexp_extract(url, '{lines.HOST}', 1)), '') AS host,
         regexp_replace(regexp_replace(regexp_replace(html, '{lines.HIDDEN}', '', 'g'), '{lines.BREAKS}', chr(10), 'g'), '{lines.TAGS}', '', 'g') AS body
  FROM pages),
once AS (SELECT host, unnest(list_distinct(list_transform(string_split(body, chr(10)), lambda x: trim(x)))) AS line
         FROM p WHERE host IS NOT NULL AND body IS NOT NULL),
totals AS (SELECT host, count(*) AS total FROM p WHERE host IS NOT NULL AND body IS NOT NULL GROUP BY host),
flagged AS (
  SELECT host, list(line) AS flags FROM (
    SELECT o.host, o.line, count(*) AS n, any_value(t.total) AS total FROM once o JOIN totals t ON o.host = t.host WHERE o.line <> '' GROUP BY o.host, o.line)
  WHERE total >= {LINE_PAGES} AND n > {LINE_RATIO}::DOUBLE * total GROUP BY host),
j AS (
  SELECT p.page_id, p.host, string_split(p.body, chr(10)) AS ls,
         list_filter(string_split(p.body, chr(10)), lambda x: f.flags IS NULL OR trim(x) = '' OR NOT list_contains(f.flags, trim(x))) AS kept
  FROM p LEFT JOIN flagged f ON p.host = f.host)
SELECT page_id, host, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(len(ls) - len(kept), 0)::BIGINT AS n_dropped,
       array_to_string(kept, chr(10)) AS text
FROM j
"""

def op2_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.measure_media(webp.store_texts(table(spark, sf_dir, "documents")))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op7_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), n_shards=8)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), model_path=public_tokenizers.path("piece_bpe_32k.model"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=90)


def op6_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_private(table(spark, sf_dir, "documents"))


def op8_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
f AS (SELECT html, max(page_id) AS first FROM p WHERE n >= {warc.REVISIT_BYTES} GROUP BY html)
SELECT p.page_id, n AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN f.first IS NULL OR f.first = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.first <> p.page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.html = f.html
"""


def op9_pack_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_curve(table(spark, sf_dir, "documents"), tokenizer_path=public_tokenizers.path("word_bpe_49k.json")).drop("ids")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.judge(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), drop=("text",)).drop("lang")


def op11_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = phrases.cut_repeats(table(spark, sf_dir, "documents"), window=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
w AS (SELECT r, doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d)),
f AS (SELECT k, min(doc_id) AS first FROM w GROUP BY k),
g AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS p FROM w JOIN f USING (k) WHERE first < doc_id),
l AS (SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d),
t AS (SELECT r, count(*) AS kept, string_agg(word, ' ' ORDER BY p) AS text FROM l ANTI JOIN g USING (r, p) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(kept, 0))::BIGINT AS n_removed, sha256(coalesce(t.text, '')) AS kept_sha256 FROM d LEFT JOIN t USING (r)
"""


def op12_block_max_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wand.search(wand.Index.of(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


_TERMS = f"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{wand.TERM}')"
OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents WHERE text IS NOT NULL),
n AS (SELECT r, doc_id, len(ts)::BIGINT AS n FROM d WHERE len(ts) > 0),
c AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM n),
m AS (SELECT r, doc_id, 75 + (25 * n * docs) // terms AS m FROM n, c),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, c GROUP BY term, docs),
s AS (SELECT item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
      FROM p JOIN q USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY ALL),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM k WHERE rank <= 20
"""


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=1, buckets=10_000, percent=10, least_words=20, seed=2024)


_WORDS13 = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP13_SQL = f"""
WITH tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, {resample.POLYNOMIAL}::BIGINT) ELSE c >> 1 END) AS c FROM range(256) v(i))),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS13}, []) AS ws FROM documents), b AS (SELECT coalesce({_WORDS13}, []) AS ws FROM benchmark),
dw AS (SELECT r, word, count(*) AS n FROM (SELECT r, unnest(ws) AS word FROM d) GROUP BY ALL), bw AS (SELECT word, count(*) AS n FROM (SELECT unnest(ws) AS word FROM b) GROUP BY ALL),
words AS (SELECT word, list_transform(range(0, strlen(word)), lambda i: concat('0x', substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT) AS bytes FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
crc AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295::BIGINT) % 10000 AS bucket FROM words, tab),
s AS (SELECT bucket, sum(n)::BIGINT AS s FROM dw JOIN crc USING (word) GROUP BY bucket), t AS (SELECT bucket, sum(n)::BIGINT AS t FROM bw JOIN crc USING (word) GROUP BY bucket),
z AS (SELECT coalesce((SELECT sum(s) FROM s), 0)::DOUBLE AS ss, coalesce((SELECT sum(t) FROM t), 0)::DOUBLE AS tt),
gains AS (SELECT c.bucket, floor(1000.0::DOUBLE * ln((coalesce(t, 0) + 1)::DOUBLE * (ss + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * (tt + 10000))))::BIGINT AS gain FROM (SELECT DISTINCT bucket FROM crc) c LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), z),
q AS (SELECT r, sum(n * gain)::BIGINT AS weight FROM dw JOIN crc USING (word) JOIN gains USING (bucket) GROUP BY r),
e AS (SELECT doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
      (coalesce(weight, 0) + floor(-1000.0::DOUBLE * ln(-ln((concat('0x', substr(sha256(concat('2024:', doc_id)), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE))))::BIGINT AS score FROM d LEFT JOIN q USING (r)),
k AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, sum((n_features >= 20)::INT) OVER () AS able FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= (10 * able) // 100 THEN place END::BIGINT AS rank FROM k
"""

QUERIES = {f.__name__: f for f in (op1_token_counts, op2_lossless_webp, op3_site_lines, op4_mix_sources, op5_jaccard_join, op6_private_data, op7_shard_documents, op8_warc_round_trip, op9_pack_curve, op10_quality_rules, op11_repeated_phrases, op12_block_max_wand, op13_resample)}
SQL = {"op3_site_lines": OP3_SQL, "op8_warc_round_trip": OP8_SQL, "op11_repeated_phrases": OP11_SQL, "op12_block_max_wand": OP12_SQL, "op13_resample": OP13_SQL}
