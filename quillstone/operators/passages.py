"""Passages around candidates, and their assembly: united while they grow, within a budget."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.operators.retrieval import coalesce_spans
from quillstone.session import ship

#: How many blocks on either side of a candidate a mode looks at.
REACH = {"seed": 0, "neighbor1": 1, "neighbor2": 2, "paragraph": 4}


def passage_options(candidates: DataFrame, blocks: DataFrame, files: DataFrame, mode: str) -> DataFrame:
    """(query_id, rank, option, path, start_line, end_line): what may stand for each candidate (query_id, rank, path, ordinal), the best
    first, then the candidate's own lines.

    ``neighbor1`` and ``neighbor2``: with the blocks beside it, touching ones united; ``paragraph``: its lines on to the nearest blank
    lines on either side, as far as the four blocks on that side go; ``seed``: nothing else. files: (path, text)."""
    reach = REACH[mode]
    spans = blocks.select("path", "ordinal", "start_line", "end_line")
    own = candidates.select("query_id", "rank", "path", "ordinal").join(spans, ["path", "ordinal"])
    out = own.select("query_id", "rank", F.lit(1).alias("option"), "path", "start_line", "end_line")
    if not reach:
        return out
    near = own.select("query_id", "rank", "path", F.explode(F.sequence(F.col("ordinal") - reach, F.col("ordinal") + reach)).alias("ordinal")).join(spans, ["path", "ordinal"])
    if mode != "paragraph":
        wide = coalesce_spans(near, keys=["query_id", "rank", "path"])
        return out.unionByName(wide.select("query_id", "rank", F.lit(0).alias("option"), "path", "start_line", "end_line"))
    seen = near.groupBy("query_id", "rank", "path").agg(F.collect_list(F.struct("start_line", "end_line")).alias("seen"))
    lines = files.select("path", F.split("text", "\n").alias("lines"))
    known = lambda i: F.exists("seen", lambda b: (b["start_line"] <= i) & (i <= b["end_line"]))
    blank = lambda i: ~F.element_at("lines", i).rlike(r"\S")
    stops = lambda a, b: F.filter(F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>")), lambda i: ~known(i) | blank(i))
    low, high = F.array_min(F.transform("seen", lambda b: b["start_line"])), F.array_max(F.transform("seen", lambda b: b["end_line"]))
    rows = own.join(seen, ["query_id", "rank", "path"]).join(lines, "path")
    up, down = stops(low, F.col("start_line") - 1), stops(F.col("end_line") + 1, high)
    start = F.when(F.size(up) > 0, F.array_max(up) + 1).otherwise(low)
    stop = F.when(F.size(down) > 0, F.array_min(down) - 1).otherwise(high)
    wide = rows.select("query_id", "rank", F.lit(0).alias("option"), "path", start.cast("int").alias("s"), stop.cast("int").alias("e"))
    return out.unionByName(wide.select("query_id", "rank", "option", "path", F.col("s").alias("start_line"), F.col("e").alias("end_line")))


def united(spans: list[tuple]) -> list[tuple]:
    """Spans (path, start line, end line, start, end) of lines and characters, touching and overlapping ones united, in order."""
    out: list[tuple] = []
    for path, lo, hi, start, end in sorted(spans):
        if out and out[-1][0] == path and lo <= out[-1][2] + 1:
            if hi > out[-1][2]:
                out[-1] = path, out[-1][1], hi, out[-1][3], end
        else:
            out.append((path, lo, hi, start, end))
    return out


def tokens_of(pieces: list[tuple]) -> int:
    """The estimate for pieces under their source labels, a blank line between."""
    chars = sum(len(f"[Source: {p}:{lo}-{hi}]\n") + end - start for p, lo, hi, start, end in pieces) + 2 * max(0, len(pieces) - 1)
    return max(1, chars // 4)


def assembled(rows: pd.DataFrame, budget: int) -> tuple[list[tuple], list[tuple[int, int]], list[int]]:
    """(pieces, taken, unmet) of one query's options: in order of rank the first option whose lines, united with what is there, fit
    the budget; taken are pairs of rank and option, unmet the ranks whose best option is not wholly there in the end."""
    options: dict[int, dict[int, list]] = {}
    for r in rows.itertuples(index=False):
        options.setdefault(r.rank, {}).setdefault(r.option, []).append((r.path, r.start_line, r.end_line, r.start, r.end))
    pieces, taken = [], []
    for rank in sorted(options):
        for option in sorted(options[rank]):
            wider = united([*pieces, *options[rank][option]])
            if tokens_of(wider) <= budget:
                pieces = wider
                taken.append((rank, option))
                break
    there = lambda s: any(p[0] == s[0] and p[1] <= s[1] and s[2] <= p[2] for p in pieces)
    unmet = [rank for rank, _ in taken if not all(there(s) for s in options[rank][min(options[rank])])]
    return pieces, taken, unmet


def assemble(options: DataFrame, files: DataFrame, queries: DataFrame, *, budget: int) -> DataFrame:
    """(query_id, pieces, tokens, n_taken, n_narrowed, unmet, status) for each of ``queries`` (query_id): the lines to show.

    options: (query_id, rank, option, path, start_line, end_line), a bounded number of candidates a query; files: (path, text), joined
    to what options name and measured there, so that only numbers meet by query. n_narrowed counts candidates whose best
    option did not fit; unmet are those of whom some wanted lines are not there. status: ``fallback_required`` without
    pieces, ``incomplete`` with unmet wishes, else ``selected``."""
    ship(options.sparkSession)
    lines = files.select("path", F.split("text", "\n").alias("lines"))
    upto = lambda n: F.length(F.array_join(F.slice("lines", F.lit(1), n), "\n"))
    before = F.when(F.col("start_line") > 1, upto(F.greatest(F.lit(0), F.col("start_line") - 1)) + 1).otherwise(0)
    spans = options.select("path", "start_line", "end_line").distinct().join(lines, "path").select("path", "start_line", "end_line", before.alias("start"), upto(F.col("end_line")).alias("end"))
    sized = options.join(spans, ["path", "start_line", "end_line"])

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        pieces, taken, unmet = assembled(rows, budget)
        shown = [{"path": p, "start_line": lo, "end_line": hi} for p, lo, hi, _, _ in pieces]
        best = rows.groupby("rank")["option"].min()
        narrowed = sum(option > best[rank] for rank, option in taken)
        return pd.DataFrame({"query_id": [rows["query_id"].iloc[0]], "pieces": [shown], "tokens": [tokens_of(pieces) if pieces else 0], "n_taken": [len(taken)], "n_narrowed": [narrowed], "unmet": [unmet]})

    kind = options.schema["query_id"].dataType.simpleString()
    made = sized.groupBy("query_id").applyInPandas(of, f"query_id {kind}, pieces array<struct<path:string,start_line:int,end_line:int>>, tokens long, n_taken long, n_narrowed long, unmet array<long>")
    out = queries.select("query_id").distinct().join(made, "query_id", "left")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("tokens", "n_taken", "n_narrowed")}
    none = F.coalesce(F.size("pieces") == 0, F.lit(True))
    return out.withColumns(zero).withColumn("status", F.when(none, "fallback_required").when(F.size("unmet") > 0, "incomplete").otherwise("selected"))
