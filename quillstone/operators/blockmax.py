"""Lexical top-k over postings in blocks: a block's largest contribution decides whether its postings are read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.operators.retrieval import B, K1, bm25_idf, top_k
from quillstone.scratch import numbered, written

#: Documents that share a block of each term; spans that every query reads first; what a rounded score may exceed a bound by.
SPAN, FIRST, SLACK = 64, 8, 1e-5


class BlockPostings:
    """Postings by term and span of SPAN neighbouring documents, in order of their keys.

    ``blocks`` (term, span, n, top, postings array of (at, part)): part is a document's BM25 contribution without the term's
    weight, top the largest of a block. ``places`` (keys, at): documents and their numbers."""

    def __init__(self, blocks: DataFrame, places: DataFrame, keys: list[str]):
        self.blocks, self.places, self.keys = blocks, places, keys

    @classmethod
    def of(cls, postings: DataFrame, lengths: DataFrame, *, keys: list[str], k1: float = K1, b: float = B) -> BlockPostings:
        """From postings (keys, term, tf) and lengths (keys, dl) of all documents. Both tables are written."""
        totals = lengths.agg(F.avg("dl").alias("__avgdl"))
        norm = F.lit(k1) * (1 - b + b * F.col("dl") / F.col("__avgdl"))
        sized = lengths.crossJoin(F.broadcast(totals)).select(*keys, norm.alias("__norm"))  # one row of totals
        places = numbered(sized, [F.col(c) for c in keys], "at")
        part = F.col("tf") * (k1 + 1) / (F.col("tf") + F.col("__norm"))
        rows = postings.join(places, keys).select("term", F.floor(F.col("at") / SPAN).alias("span"), "at", part.alias("part"))
        held = rows.groupBy("term", "span").agg(F.count("*").alias("n"), F.max("part").alias("top"), F.collect_list(F.struct("at", "part")).alias("postings"))
        return cls(written(held.sortWithinPartitions("term"), "blocks"), places.drop("__norm"), keys)

    def _terms(self, queries: DataFrame) -> DataFrame:
        df = self.blocks.join(queries.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
        return written(queries.join(df, "term").select("query_id", "term", bm25_idf(F.lit(self.places.count()), F.col("df")).alias("idf")), "weights")

    def _score(self, spans: DataFrame, terms: DataFrame) -> DataFrame:
        """(query_id, at, score, read) of all documents in a query's spans that hold a term of it; read: the postings it took."""
        asked = spans.select("query_id", "span").join(terms, "query_id")
        rows = self.blocks.select("term", "span", "postings").join(asked, ["term", "span"]).select("query_id", "idf", F.explode("postings").alias("p"))
        return rows.groupBy("query_id", F.col("p.at").alias("at")).agg(F.sum(F.col("idf") * F.col("p.part")).alias("score"), F.count("*").alias("read"))

    def scores(self, queries: DataFrame, k: int, *, digits: int = 6) -> DataFrame:
        """(query_id, at, score, read): of each query at least all documents whose score, rounded, is not below its k-th best.

        queries: (query_id, term), distinct. Blocks are met by their largest contributions alone; the sum of these bounds what
        a document of a span can reach. The FIRST spans of the highest bounds are scored, their k-th best score is the
        threshold, and of the others only spans that can reach it are scored: other blocks' postings are not joined."""
        terms = self._terms(queries)
        bounds = self.blocks.select("term", "span", "top").join(terms, "term").groupBy("query_id", "span").agg(F.sum(F.col("idf") * F.col("top")).alias("bound"))
        bounds = written(bounds, "bounds")
        seeds = written(top_k(bounds, FIRST, by=[F.col("bound").desc(), F.col("span")]).select("query_id", "span"), "seeds")
        first = written(self._score(seeds, terms), "first")
        bar = top_k(first.withColumn("score", F.round("score", digits)), k, by=[F.col("score").desc()]).where(F.col("rank") == k - 1).select("query_id", F.col("score").alias("bar"))
        rest = bounds.join(seeds, ["query_id", "span"], "left_anti").join(written(bar, "bars"), "query_id", "left")
        slack = SLACK + 10.0**-digits
        rest = rest.where(F.col("bar").isNull() | (F.col("bound") >= F.col("bar") - slack))
        return first.unionByName(self._score(rest, terms))

    def top(self, queries: DataFrame, k: int, *, digits: int = 6, ties: bool = False) -> DataFrame:
        """(query_id, keys, score, rank) of each query's first ``k`` documents by rounded score, then keys; with ``ties`` all that
        equal the last one. Documents are named last."""
        found = self.scores(queries, k, digits=digits).select("query_id", "at", "score")
        order = [F.round("score", digits).desc(), *([] if ties else [F.col("at")])]
        return top_k(found, k, by=order, ties=ties).join(self.places, "at").drop("at")

    def read(self, queries: DataFrame, k: int) -> tuple[int, int]:
        """Postings that ``top`` reads, and those of the queries' terms, which a full scan reads, each by query."""
        whole = self.blocks.select("term", "n").join(queries, "term").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        return self.scores(queries, k).agg(F.coalesce(F.sum("read"), F.lit(0))).first()[0], whole
