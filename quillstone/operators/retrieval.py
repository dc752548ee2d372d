"""Retrieval for tables of queries: lexical, symbol, relation and vector channels, fusion, budgeted packing.

Every operator takes all queries at once and works on narrow columns; texts are joined to what is kept, last.
A block is named by its id; ties are broken by path, then ordinal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.operators.vectors import nearest
from quillstone.scratch import if_small, written

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
LEGACY_K1, LEGACY_B = 1.5, 0.75
RRF_K, CANDIDATES, BUDGET, WIDEN = 60, 60, 2000, 4
DENSE_FLOOR, SELECTIVE_SHARE = 0.35, 0.02
CHANNELS = ("symbol", "lexical", "relation", "embedding")


def bm25_idf(n_docs: Column, df: Column) -> Column:
    """The clamped inverse document frequency: terms in half of the blocks or more weigh next to nothing."""
    idf = F.log((n_docs - df + 0.5) / (df + 0.5))
    return F.when(idf <= 0, F.lit(IDF_FLOOR)).otherwise(idf)


def bm25_scores(queries: DataFrame, postings: DataFrame, lengths: DataFrame, *, keys: list[str], k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, keys, score) of blocks that share a term with a query.

    queries: (query_id, term), distinct; postings: (keys, term, tf); lengths: (keys, dl) of all blocks, matching or not.
    Postings are cut to query terms before anything else; corpus totals are one row that is cross-applied as a literal row.
    """
    hits = postings.join(queries.select("term").distinct(), "term", "left_semi")  # goes below the postings' aggregation
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    totals = lengths.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    weights = df.crossJoin(F.broadcast(totals)).select("term", "avgdl", bm25_idf(F.col("n_docs"), F.col("df")).alias("idf"))
    rows = hits.join(weights, "term").join(lengths, keys).join(queries, "term")
    norm = F.lit(k1) * (1 - b + b * F.col("dl") / F.col("avgdl"))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + norm)
    return rows.groupBy("query_id", *keys).agg(F.sum(part).alias("score"))


def legacy_bm25_scores(queries: DataFrame, postings: DataFrame, lengths: DataFrame, *, keys: list[str]) -> DataFrame:
    """The older score: another idf, k1 and b, query terms with repeats; ``dl`` counts white-space words."""
    hits = postings.join(queries.select("term").distinct(), "term", "left_semi")  # goes below the postings' aggregation
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    totals = lengths.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weights = df.crossJoin(F.broadcast(totals)).select("term", "avgdl", idf.alias("idf"))
    repeats = queries.groupBy("query_id", "term").agg(F.count("*").alias("times"))
    rows = hits.join(weights, "term").join(lengths, keys).join(repeats, "term")
    norm = F.lit(LEGACY_K1) * (1 - LEGACY_B + LEGACY_B * F.col("dl") / F.col("avgdl"))
    part = F.col("times") * F.col("idf") * F.col("tf") * (LEGACY_K1 + 1) / F.greatest(F.col("tf") + norm, F.lit(1e-5))
    return rows.groupBy("query_id", *keys).agg(F.sum(part).alias("score"))


def top_k(scored: DataFrame, k: int, *, by: list[Column], partition: str = "query_id", ties: bool = False) -> DataFrame:
    """The first ``k`` rows a query with their 0-based ``rank``; with ``ties`` all rows that equal the last one, too."""
    window = Window.partitionBy(partition).orderBy(*by)
    place = (F.rank() if ties else F.row_number()).over(window)
    return scored.withColumn("rank", (place - 1).cast("long")).where(F.col("rank") < k)


def score_order(digits: int = 6) -> list[Column]:
    """Best score first, rounded so that engines agree, then path and ordinal."""
    return [F.round("score", digits).desc(), F.col("path"), F.col("ordinal")]


def prefer_whole(expanded: DataFrame, whole: DataFrame, single: DataFrame) -> DataFrame:
    """Hits of the whole spelling where a query of ``single`` has any, hits of its expansion elsewhere."""
    exact = whole.join(single.select("query_id"), "query_id", "left_semi")
    return expanded.join(exact.select("query_id").distinct(), "query_id", "left_anti").unionByName(exact)


def symbol_channel(idents: DataFrame, symbols: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """Blocks that define a name a query mentions, by definitions, then mentions; aggregated before any join on blocks.

    idents: (query_id, symbol); symbols: (path, ordinal, symbol, is_def)."""
    hits = symbols.join(idents.distinct(), "symbol").groupBy("query_id", "path", "ordinal")
    ranked = hits.agg(F.sum(F.col("is_def").cast("long")).alias("defs"), F.count("*").alias("hits"))
    return top_k(ranked, k, by=[F.col("defs").desc(), F.col("hits").desc(), F.col("path"), F.col("ordinal")])


def relation_channel(wanted: DataFrame, relations: DataFrame, n_blocks: int, k: int = CANDIDATES) -> DataFrame:
    """Blocks with a selective relation a query asks for; those whose first path part the query names come first.

    wanted: (query_id, name, expanded array of names); relations: (path, ordinal, name). Relations are cut to names that a
    query asks for, then counted; lists of names stay where they are."""
    names = if_small(written(wanted.select("name").distinct(), "names"))
    asked = written(relations.join(names, "name", "left_semi").select("path", "ordinal", "name").distinct(), "asked")
    cap = max(1, int(n_blocks * SELECTIVE_SHARE))
    rare = if_small(written(asked.groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") <= cap).select("name"), "rare"))
    queries = if_small(written(wanted.select("query_id", "name", "expanded").join(rare, "name", "left_semi"), "wanted"))
    head = F.lower(F.substring_index("path", "/", 1))
    hits = asked.join(queries, "name").select("query_id", "path", "ordinal", F.array_contains("expanded", head).alias("scoped"))
    hits = written(hits.distinct(), "hits")
    some = hits.where("scoped").select("query_id", F.lit(True).alias("some")).distinct()
    late = F.coalesce("some", F.lit(False)) & ~F.col("scoped")
    out = hits.join(if_small(written(some, "scoped")), "query_id", "left").withColumn("late", late)
    return top_k(out, k, by=[F.col("late"), F.col("path"), F.col("ordinal")]).select("query_id", "path", "ordinal", "rank")


def floored(ranked: DataFrame, floor: float | None) -> DataFrame:
    """Ranked rows without those of queries whose best score is below the floor."""
    if floor is None:
        return ranked
    best = F.max("score").over(Window.partitionBy("query_id"))
    return ranked.withColumn("best", best).where(F.col("best") >= floor).drop("best")


def vector_channel(queries: DataFrame, vectors: DataFrame, k: int = CANDIDATES, *, floor: float | None = None, id_col: str = "vec_id") -> DataFrame:
    """The nearest vectors of each query by dot product, every query against all vectors; see ``vectors.nearest``, and
    ``vectors.VectorIndex`` for an index that skips."""
    return nearest(queries, vectors, k, floor=floor, id_col=id_col)


def and_search(queries: DataFrame, scored: DataFrame, postings: DataFrame, *, keys: list[str], k: int = 10) -> DataFrame:
    """Blocks that hold all terms of a query, best score first. queries: (query_id, term), distinct."""
    needed = queries.groupBy("query_id").agg(F.count("*").alias("needed"))
    held = postings.join(queries, "term").groupBy("query_id", *keys).agg(F.count("*").alias("held"))
    full = held.join(needed, "query_id").where("held = needed").select("query_id", *keys)
    return top_k(scored.join(full, ["query_id", *keys], "left_semi"), k, by=score_order())


def snippet(text: Column, term: Column, width: int = 24) -> Column:
    """About ``width`` words of a text around the first of a term."""
    tokens = F.split(text, r"\s+")
    at = F.array_position(F.transform(tokens, F.lower), term)
    return F.array_join(F.slice(tokens, F.greatest(F.lit(1), at - width // 2).cast("int"), F.lit(width)), " ")


def fuse(channels: DataFrame, *, weights: dict[str, float] | None = None, keys: list[str] | None = None) -> DataFrame:
    """Reciprocal-rank fusion of rows (query_id, channel, keys, rank): (query_id, keys, fused, channels, place).

    Equal scores keep the order in which channels, as listed in CHANNELS, and ranks within them first give a block."""
    keys = keys or ["path", "ordinal"]
    order = F.array_position(F.array(*map(F.lit, CHANNELS)), F.col("channel"))
    weight = F.lit(1.0)
    for name, w in (weights or {}).items():
        weight = F.when(F.col("channel") == name, float(w)).otherwise(weight)
    rows = channels.withColumn("ord", order).withColumn("part", weight / (RRF_K + F.col("rank")))
    out = rows.groupBy("query_id", *keys).agg(
        F.sum("part").alias("fused"), F.min(F.struct("ord", "rank")).alias("first"),
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "channel"))), lambda c: c["channel"]).alias("channels"),
    )
    window = Window.partitionBy("query_id").orderBy(F.round("fused", 9).desc(), "first")
    return out.withColumn("place", (F.row_number().over(window) - 1).cast("long")).drop("first")


def interleave(lists: DataFrame, *, keys: list[str]) -> DataFrame:
    """Round robin of ranked lists (query_id, list, rank, keys): each block once, at its first turn; adds ``place``."""
    first = lists.groupBy("query_id", *keys).agg(F.min(F.struct("rank", "list")).alias("turn"))
    window = Window.partitionBy("query_id").orderBy("turn")
    return first.withColumn("place", (F.row_number().over(window) - 1).cast("long")).drop("turn")


def greedy_fold(candidates: Column, budget: Column, *, separator: int = 2) -> Column:
    """Indexes (0-based) of candidates, in order, that a budget takes: each is tried once and skipped if it does not fit.

    candidates: array of structs with ``chars``; a text costs its characters and ``separator`` more behind the first."""
    taken = F.array().cast("array<int>")
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("i"), taken.alias("taken"))

    def step(s: Column, c: Column) -> Column:
        with_it = s["used"] + c["chars"] + F.when(F.size(s["taken"]) > 0, separator).otherwise(0)
        fits = F.greatest(F.lit(1), F.floor(with_it / 4)) <= budget
        return F.struct(
            F.when(fits, with_it).otherwise(s["used"]).cast("long").alias("used"), (s["i"] + 1).alias("i"),
            F.when(fits, F.concat(s["taken"], F.array(s["i"]))).otherwise(s["taken"]).alias("taken"),
        )

    return F.aggregate(candidates, start, step, lambda s: s["taken"])


def greedy_pack(queries: DataFrame, fused: DataFrame, sizes: DataFrame, *, budget: int = BUDGET, keys: list[str] | None = None) -> DataFrame:
    """(query_id, selected, n_selected, total_tokens, seed_failed, reduction_pct): one row a query, also where nothing is found.

    fused: (query_id, keys, place), a bounded number of candidates a query; sizes: (keys, chars) of all blocks."""
    keys = keys or ["path", "ordinal"]
    listed = fused.join(sizes, keys).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", *keys, "chars"))).alias("c"))
    totals = sizes.agg(F.sum("chars").alias("all_chars"), F.count("*").alias("all_blocks"))
    out = queries.select("query_id").join(listed, "query_id", "left").crossJoin(F.broadcast(totals))
    out = out.withColumn("taken", F.coalesce(greedy_fold(F.col("c"), F.lit(budget)), F.array().cast("array<int>")))
    kept = F.transform("taken", lambda i: F.element_at("c", i + 1))
    used = F.aggregate(kept, F.lit(0).cast("long"), lambda a, c: a + c["chars"])
    n = F.size("taken")
    total = F.when(n > 0, F.greatest(F.lit(1), F.floor((used + 2 * (n - 1)) / 4))).otherwise(0)
    available = F.greatest(F.lit(1), F.floor((F.col("all_chars") + 2 * (F.col("all_blocks") - 1)) / 4))
    selected = F.transform(kept, lambda c: F.concat_ws("#", *[c[k].cast("string") for k in keys]))
    return out.select(
        "query_id", selected.alias("selected"), n.cast("long").alias("n_selected"), total.cast("long").alias("total_tokens"), (n == 0).alias("seed_failed"),
        F.when(n > 0, 100.0 * (available - total) / F.nullif(available, F.lit(0))).alias("reduction_pct"),
    )


def expand(seeds: DataFrame, edges: DataFrame, *, depth: int = 2) -> DataFrame:
    """(query_id, node, hop) reached from (query_id, node) along edges (src, dst) in up to ``depth`` hops, seeds left out."""
    reached = frontier = seeds.select("query_id", "node").distinct().withColumn("hop", F.lit(0))
    for hop in range(1, depth + 1):
        near = frontier.join(edges, F.col("node") == F.col("src")).select("query_id", F.col("dst").alias("node")).distinct()
        frontier = near.join(reached.select("query_id", "node"), ["query_id", "node"], "left_anti").withColumn("hop", F.lit(hop))
        reached = reached.unionByName(frontier)
    return reached.where("hop > 0")


def reach(seeds: DataFrame, edges: DataFrame, *, depth: int = 2) -> DataFrame:
    """(query_id, hop, n, first_node) of what ``expand`` reaches, counted, for seeds (query_id, node) of which many see the same.

    A node that no edge leads to is reached by nobody, so queries whose seeds are such nodes and have the same neighbours reach
    the same at each hop: one of them is expanded for all. Neighbours are compared by their number and 128 bits of hashes.
    Queries with another seed are expanded by themselves."""
    seeds = seeds.select("query_id", "node").distinct()
    entered = edges.select(F.col("dst").alias("node")).distinct()
    alone = written(seeds.join(entered, "node", "left_semi").select("query_id").distinct(), "alone")
    near = seeds.join(edges.select("src", "dst").distinct(), F.col("node") == F.col("src")).select("query_id", "dst").distinct()
    mark = lambda salt: F.bit_xor(F.xxhash64(F.lit(salt), "dst"))
    told = near.groupBy("query_id").agg(F.count("*").alias("c"), mark(1).alias("x"), mark(2).alias("y")).join(alone, "query_id", "left_anti")
    told = written(told, "classes")
    first = written(told.groupBy("c", "x", "y").agg(F.min("query_id").alias("first")), "firsts")
    chosen = first.select(F.col("first").alias("query_id")).unionByName(alone)
    found = expand(seeds.join(if_small(written(chosen, "chosen")), "query_id", "left_semi"), edges, depth=depth)
    counts = written(found.groupBy("query_id", "hop").agg(F.count("*").alias("n"), F.min("node").alias("first_node")), "counts")
    named = told.join(if_small(first), ["c", "x", "y"]).select("query_id", "first").unionByName(alone.select("query_id", F.col("query_id").alias("first")))
    return named.join(if_small(counts.withColumnRenamed("query_id", "first")), "first").select("query_id", "hop", "n", "first_node")


def risk_band(coverage: Column, overlap: Column, empty: Column) -> Column:
    """An uncalibrated band from term coverage and from blocks that several channels found."""
    band = F.when((coverage >= 0.8) & overlap, "low").when((coverage >= 0.5) | overlap, "moderate").otherwise("high")
    return F.concat(F.lit("uncalibrated:"), F.when(empty, "maximum").otherwise(band))


def coverage(terms: Column, text: Column) -> Column:
    """The share of terms that a text holds as substrings; 1 without terms."""
    present = F.size(F.filter(terms, lambda t: F.contains(F.lower(text), t)))
    return F.when(F.size(terms) == 0, 1.0).otherwise(present / F.size(terms))


def document_first(block_scores: DataFrame, doc_scores: DataFrame, n_docs: int) -> DataFrame:
    """Block scores within each query's best ``n_docs`` documents. Both have query_id, doc_id, score."""
    best = top_k(doc_scores, n_docs, by=[F.round("score", 6).desc(), F.col("doc_id")])
    return block_scores.join(best.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi")


def document_routes(block_scores: DataFrame, doc_scores: DataFrame, *, mode: str, k: int = CANDIDATES, keys: list[str] | None = None) -> DataFrame:
    """(query_id, keys, rank) of blocks (query_id, keys, doc_id, score) routed by their documents' scores.

    ``flat`` ranks blocks alone; ``gateN`` those of each query's best N documents; ``balanced4`` takes the best block of each
    of four documents, then the second ones; ``escape4`` fuses that with ``flat`` by reciprocal ranks; ``passage_parent4``
    gates by the documents of the best blocks."""
    keys = keys or ["path", "ordinal"]
    ranked = top_k(block_scores, k, by=score_order())
    if mode == "flat":
        return ranked.select("query_id", *keys, "rank")
    if mode == "passage_parent4":
        parents = ranked.groupBy("query_id", "doc_id").agg((-F.min("rank")).cast("double").alias("score"))
        return top_k(document_first(block_scores, parents, 4), k, by=score_order()).select("query_id", *keys, "rank")
    if mode.startswith("gate"):
        return top_k(document_first(block_scores, doc_scores, int(mode[4:])), k, by=score_order()).select("query_id", *keys, "rank")
    best = top_k(doc_scores, 4, by=[F.round("score", 6).desc(), F.col("doc_id")]).select("query_id", "doc_id", F.col("rank").alias("doc_rank"))
    turn = F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy(*score_order()))
    dealt = block_scores.join(best, ["query_id", "doc_id"]).withColumn("turn", turn)
    balanced = top_k(dealt.where(F.col("turn") <= k), k, by=[F.col("turn"), F.col("doc_rank")]).select("query_id", *keys, "rank")
    if mode == "balanced4":
        return balanced
    if mode != "escape4":
        raise ValueError(f"unknown mode {mode}")
    both = ranked.select("query_id", *keys, F.col("rank").alias("a")).join(balanced.withColumnRenamed("rank", "b"), ["query_id", *keys], "full")
    score = F.coalesce(1.0 / (60 + F.col("a")), F.lit(0.0)) + F.coalesce(1.0 / (60 + F.col("b")), F.lit(0.0))
    return top_k(both.withColumn("fused", F.round(score, 9)), k, by=[F.col("fused").desc(), F.col("a").asc_nulls_last(), F.col("b").asc_nulls_last()]).select("query_id", *keys, "rank")


def pack_views(rows: DataFrame, *, budget: int, mode: str) -> DataFrame:
    """(query_id, kept, used) of candidates (query_id, place, full, compact), the lengths of a text and of its shorter view: in
    order, those that still fit. ``raw`` takes full texts, ``compact`` the views, ``rescue`` the view where the full text does
    not fit. kept: structs of place and view, a query's candidates being bounded by its channels."""
    views = {"raw": ("full",), "compact": ("compact",), "rescue": ("full", "compact")}[mode]
    listed = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "full", "compact"))).alias("c"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<place:bigint,view:string>>").alias("kept"))

    def step(s: Column, c: Column) -> Column:
        out = s
        for view in reversed(views):
            total = s["used"] + c[view] + F.when(F.size(s["kept"]) > 0, 2).otherwise(0)
            taken = F.struct(c["place"].cast("long").alias("place"), F.lit(view).alias("view"))
            fits = F.greatest(F.lit(1), F.floor(total / 4)) <= budget
            out = F.when(fits, F.struct(total.cast("long").alias("used"), F.concat(s["kept"], F.array(taken)).alias("kept"))).otherwise(out)
        return out

    return listed.select("query_id", F.aggregate("c", start, step).alias("s")).select("query_id", "s.kept", "s.used")


def trim_tail(rows: DataFrame, *, budget: int) -> DataFrame:
    """Rows (query_id, place, chars) without those at the end that take a query's joined text over the budget."""
    order = Window.partitionBy("query_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum("chars").over(order) + 2 * (F.count("*").over(order) - 1)
    return rows.withColumn("__used", F.greatest(F.lit(1), F.floor(used / 4))).where(F.col("__used") <= budget).drop("__used")


def conflict_sets(assigned: DataFrame, *, keys: list[str] | None = None) -> DataFrame:
    """(symbol, n_blocks, n_values) of symbols that several blocks assign different values."""
    keys = keys or ["path", "ordinal"]
    sets = assigned.groupBy("symbol").agg(F.countDistinct(*keys).alias("n_blocks"), F.countDistinct("value_hash").alias("n_values"))
    return sets.where("n_blocks > 1 AND n_values > 1")


def neighbours(blocks: DataFrame, seeds: DataFrame, reach: int = 1) -> DataFrame:
    """Blocks within ``reach`` ordinals of a seed (path, ordinal) in its file."""
    near = seeds.select("path", F.explode(F.sequence(F.col("ordinal") - reach, F.col("ordinal") + reach)).alias("ordinal")).distinct()
    return blocks.join(near, ["path", "ordinal"], "left_semi")


def coalesce_spans(spans: DataFrame, *, keys: list[str] | None = None) -> DataFrame:
    """(keys, start_line, end_line, n): touching and overlapping line spans of a key united."""
    keys = keys or ["path"]
    order = Window.partitionBy(*keys).orderBy("start_line", "end_line")
    before = F.max("end_line").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(before.isNull() | (F.col("start_line") > before + 1), 1).otherwise(0)
    grouped = spans.withColumn("fresh", starts).withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*keys, "island").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.count("*").alias("n")).drop("island")


def covers(evidence: DataFrame, required: DataFrame) -> DataFrame:
    """(req_id, covered): whether evidence spans of its path, taken together, hold every line of a required span.

    required: (req_id, path, start_line, end_line). Evidence is united first, so one span is to hold it."""
    united = coalesce_spans(evidence).select("path", F.col("start_line").alias("lo"), F.col("end_line").alias("hi"))
    hit = required.join(united, "path").where("lo <= start_line AND end_line <= hi").select("req_id").distinct().withColumn("covered", F.lit(True))
    return required.select("req_id").distinct().join(hit, "req_id", "left").select("req_id", F.coalesce("covered", F.lit(False)).alias("covered"))


def overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of spans (a_id, b_id) of one path that share a line."""
    joined = a.join(b.select("path", "b_id", F.col("start_line").alias("lo"), F.col("end_line").alias("hi")), "path")
    return joined.where("start_line <= hi AND lo <= end_line").select("a_id", "b_id")
