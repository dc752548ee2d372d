"""Conflicting values of a symbol among a query's selected blocks, settled where the query's wording tells which is meant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Path parts that mark a variant as superseded; query words that ask for an earlier state; query words that ask
# for a comparison.
DEPRECATED = frozenset("legacy deprecated old backup bak v0 archive vendor".split())
HISTORICAL = frozenset("original previous old deprecated former initial".split())
COMPARISON = frozenset(
    """compare comparison contrast difference differences differ
    both versus between across before after changed changes""".split()
)


def _list(values: frozenset[str]) -> Column:
    return F.array(*map(F.lit, sorted(values)))


def _words(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 0))


def decisions(selected: DataFrame) -> DataFrame:
    """(query_id, symbol, kept, dropped) for blocks (query_id, query, rank, id, path, text, assigned array<struct<symbol,
    value_hash>>) that a query selected.

    A symbol is in conflict where blocks give it several values. It is settled where one block's path shares more parts with
    the query's words than the next, or as many and is less marked as superseded; other blocks give way unless they mention
    a name of the query that the kept one does not. Queries that ask for earlier states or comparisons settle nothing.
    Symbols are settled in their order, and what gave way for one has no say in the next: a fold over a query's symbols,
    which its budget bounds.
    """
    asked = selected.withColumn("scope", _words(F.lower("query"), "[a-z_][a-z0-9_]{2,}")).where(~F.arrays_overlap("scope", _list(HISTORICAL | COMPARISON)))
    parts = F.array_distinct(F.split(F.lower("path"), r"[/\\._-]+"))
    name = "[A-Za-z_][A-Za-z0-9_]*"
    claim = F.struct(
        F.size(F.array_intersect(parts, F.col("scope"))).alias("shared"), (-F.size(F.array_intersect(parts, _list(DEPRECATED)))).alias("fresh"),
        (-F.col("rank")).alias("early"), F.col("id"), F.array_intersect(_words(F.col("query"), name), _words(F.col("text"), name)).alias("mentions"),
    )
    given = asked.select("query_id", claim.alias("claim"), F.explode("assigned").alias("a"))
    by_symbol = given.groupBy("query_id", F.col("a.symbol").alias("symbol")).agg(F.countDistinct("a.value_hash").alias("values"), F.sort_array(F.collect_set("claim"), asc=False).alias("claims"))
    symbols = F.array_sort(F.collect_list(F.struct("symbol", "claims")))
    by_query = by_symbol.where((F.col("values") > 1) & (F.size("claims") > 1)).groupBy("query_id").agg(symbols.alias("symbols"))

    def step(state: Column, x: Column) -> Column:
        left = F.filter(x["claims"], lambda c: ~F.array_contains(state["gone"], c["id"]))
        best, second = F.get(left, 0), F.get(left, 1)
        clear = second.isNotNull() & ((best["shared"] != second["shared"]) | (best["fresh"] != second["fresh"]))
        less = lambda c: (c["id"] != best["id"]) & (F.size(F.array_except(c["mentions"], best["mentions"])) == 0)
        lost = F.when(clear, F.transform(F.filter(left, less), lambda c: c["id"])).otherwise(F.array().cast("array<bigint>"))
        made = F.struct(x["symbol"].alias("symbol"), best["id"].alias("kept"), lost.alias("dropped"))
        return F.struct(F.concat(state["gone"], lost).alias("gone"), F.when(F.size(lost) > 0, F.concat(state["made"], F.array(made))).otherwise(state["made"]).alias("made"))

    start = F.struct(F.array().cast("array<bigint>").alias("gone"), F.array().cast("array<struct<symbol:string,kept:bigint,dropped:array<bigint>>>").alias("made"))
    return by_query.select("query_id", F.explode(F.aggregate("symbols", start, step, lambda s: s["made"])).alias("d")).select("query_id", "d.*")


def drop_conflicts(selected: DataFrame) -> DataFrame:
    """The rows of ``selected`` that ``decisions`` leave."""
    gone = decisions(selected.withColumn("id", F.col("id").cast("long"))).select("query_id", F.explode("dropped").alias("id"))
    return selected.join(gone, ["query_id", "id"], "left_anti")
