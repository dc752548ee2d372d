"""Evidence within one prompt: its sections scored against its question, expanded along their references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.text import legacy_tokens
from quillstone.operators import sequential
from quillstone.session import ship

ANCHOR = 2.0


def boosted(rows: DataFrame, *, query: str = "query", name: str = "name") -> DataFrame:
    """Rows (query_id, ..., score) with twice the best score added where the question names the section."""
    top = F.max("score").over(Window.partitionBy("query_id"))
    named = F.contains(F.lower(query), F.lower(F.regexp_replace(name, "^#+ *", "")))
    return rows.withColumn("score", F.col("score") + F.when(named, ANCHOR * top).otherwise(0.0))


def literal_fallback(rows: DataFrame, *, terms: Column, text: str = "text") -> DataFrame:
    """Where no section of a question scores, the share of its terms that a section holds as substrings."""
    top = F.max("score").over(Window.partitionBy("query_id"))
    held = F.size(F.filter(terms, lambda t: F.contains(F.lower(text), t))) / F.greatest(F.size(terms), F.lit(1))
    return rows.withColumn("score", F.when(top <= 0, held).otherwise(F.col("score")))


def rescaled_fusion(rows: DataFrame, *, lexical: str = "lexical", dense: str = "dense", k: int = 60) -> DataFrame:
    """Adds ``score``: reciprocal ranks of two scores added, then scaled to the range of the lexical one."""
    per = Window.partitionBy("query_id")
    rank = lambda c: F.row_number().over(per.orderBy(F.col(c).desc(), "idx")) - 1
    both = rows.withColumn("r", 1.0 / (k + rank(lexical)) + 1.0 / (k + rank(dense)))
    lo, hi, least, most = F.min("r").over(per), F.max("r").over(per), F.min(lexical).over(per), F.max(lexical).over(per)
    return both.withColumn("score", F.when(hi > lo, least + (F.col("r") - lo) / (hi - lo) * (most - least)).otherwise(most)).drop("r")


def section_graph(sections: DataFrame) -> DataFrame:
    """(query_id, src, dst) edges between sections (query_id, idx, name, content): a section uses a name that another one
    defines (the last that does), or imports another one's module."""
    defined = F.concat(
        F.regexp_extract_all("content", F.lit(r"\b(?:def|class)\s+([A-Za-z_]\w*)"), F.lit(1)), F.regexp_extract_all("content", F.lit(r"(?m)^([A-Z_][A-Z0-9_]{2,})\s*="), F.lit(1)),
        F.array(F.regexp_extract("name", r"([^/\\.]+)(?:\.\w+)?$", 1)),
    )
    defs = sections.select("query_id", "idx", F.explode(F.array_distinct(defined)).alias("symbol")).where("symbol <> ''")
    last = defs.groupBy("query_id", "symbol").agg(F.max("idx").alias("dst"))
    used = sections.select("query_id", F.col("idx").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"[A-Za-z_]\w*"), F.lit(0)))).alias("symbol"))
    return used.join(last, ["query_id", "symbol"]).where("src <> dst").select("query_id", "src", "dst").distinct()


def margin(rows: DataFrame) -> DataFrame:
    """(query_id, margin, top) of scored rows with ``kept``: the least kept score less the best dropped one, and the best."""
    return rows.groupBy("query_id").agg(
        (F.coalesce(F.min(F.when(F.col("kept"), F.col("score"))), F.lit(0.0)) - F.coalesce(F.max(F.when(~F.col("kept"), F.col("score"))), F.lit(0.0))).alias("margin"), F.max("score").alias("top")
    )


def retrieve(sections: DataFrame, *, budget: int = 12_000, rule: str = "relative") -> DataFrame:
    """The sections (query_id, idx, name, content, score) kept: by information gain along references, then what those refer
    to while the budget lasts; all of a question none of whose sections scores."""
    graph = section_graph(sections)
    near = graph.unionByName(graph.select("query_id", F.col("dst").alias("src"), F.col("src").alias("dst"))).groupBy("query_id", "src").agg(F.collect_set(F.col("dst").cast("int")).alias("near"))
    costed = sections.withColumn("cost", legacy_tokens(F.col("content"))).join(near.withColumnRenamed("src", "idx"), ["query_id", "idx"], "left")
    costed = costed.withColumn("near", F.coalesce("near", F.array().cast("array<int>")))
    taken = sequential.gain_select(costed.select("query_id", "idx", "score", "cost", "near"), budget=budget, rule=rule).select("query_id", "idx").withColumn("seed", F.lit(True))
    ship(sections.sparkSession)
    flagged = costed.join(taken, ["query_id", "idx"], "left")

    def close(pdf):
        import pandas as pd

        nodes = {int(i): int(c) for i, c in zip(pdf["idx"], pdf["cost"], strict=True)}
        links = {int(i): {int(x) for x in n} for i, n in zip(pdf["idx"], pdf["near"], strict=True)}
        seeds = [int(i) for i, s in zip(pdf["idx"], pdf["seed"], strict=True) if s is True or s == 1]
        kept = sorted(set(seeds) | set(sequential.bounded_closure(seeds, links, nodes, budget))) if seeds else sorted(nodes)
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[0], "idx": kept})

    kept = flagged.groupBy("query_id").applyInPandas(close, "query_id long, idx long")
    return sections.join(kept, ["query_id", "idx"], "left_semi")


def truncated(text: Column, budget: int) -> Column:
    """The first words of a text, three quarters of a word a token."""
    return F.array_join(F.slice(F.split(text, r"\s+"), 1, max(1, int(budget * 0.75))), " ")
