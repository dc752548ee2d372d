"""Selecting evidence for questions from a compiled store: channels, fusion, packing, expansion, conflicts, risk."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import conflicts, derive, retrieval as R
from quillstone.operators.views import ABSTAIN_WORDS, ACTION_WORDS

KEYS = ["path", "ordinal"]
SURFACE = r"(?<![\p{L}\p{N}_])[\p{L}_][\p{L}\p{N}_]*(?:\.[\p{L}_][\p{L}\p{N}_]*)*"


@dataclass(frozen=True)
class Options:
    """budget and limit are the token budget and the candidates of a channel; weights those of the text, name and path
    fields; floor the least similarity at which the vector channel counts; intent when a question asks for raise sites."""

    budget: int = R.BUDGET
    limit: int = R.CANDIDATES
    weights: tuple[int, int, int] = (1, 1, 1)
    floor: float = R.DENSE_FLOOR
    expand: bool = False
    drop_conflicts: bool = False
    intent: str = "conservative"
    canonical: bool = False


def raise_names(queries: DataFrame, intent: str = "conservative") -> DataFrame:
    """(query_id, name, expanded): names that a question asks raise sites of. ``conservative``: none where it denies or catches
    them; ``action``: it is to name the action; ``original``: any name counts; ``disabled``: none does."""
    whole = F.transform(F.regexp_extract_all("query", F.lit(SURFACE), F.lit(0)), F.lower)
    rows = queries.withColumn("whole", F.array_distinct(whole))
    rows = rows.withColumn("expanded", F.array_distinct(F.concat("whole", F.flatten(F.transform("whole", lambda w: F.split(w, r"\."))))))
    lits = lambda ws: F.array(*map(F.lit, sorted(ws)))
    acts = F.arrays_overlap("whole", lits(ACTION_WORDS))
    clear = ~F.arrays_overlap("whole", lits(ABSTAIN_WORDS)) & ~F.col("query").rlike(r"(?i)\b\w+n['’]t\b")
    asked = {"conservative": acts & clear, "action": acts, "original": F.lit(True), "disabled": F.lit(False)}[intent]
    return rows.where(asked).select("query_id", "expanded", F.explode(F.array_except("expanded", lits(ACTION_WORDS))).alias("name"))


class Index:
    """The tables that channels read: of a store, as they were compiled, or derived from blocks (path, ordinal, kind, name,
    start_line, end_line, text, n_tokens)."""

    def __init__(self, blocks: DataFrame, files: DataFrame | None = None, vectors: DataFrame | None = None, weights: tuple[int, int, int] = derive.FIELD_WEIGHTS):
        self.blocks, self.vectors, self.files = blocks, vectors, files
        self.postings, self.lengths = derive.field_postings(blocks, weights), derive.field_lengths(blocks, weights)
        self.symbols = derive.symbols(blocks).withColumn("is_def", F.lit(True))
        self.relations = derive.raises(files, blocks) if files is not None else None
        self.assigned = derive.assignments(blocks)

    @classmethod
    def of_store(cls, store, vectors: DataFrame | None = None) -> Index:
        """The index of a store's current state: nothing is tokenised or parsed again. ``vectors`` (path, ordinal, embedding)
        are any encoder's."""
        made = cls.__new__(cls)
        segments = store.manifest()["segments"]
        made.files, made.blocks, made.vectors = store.table("files", segments), store.table("blocks", segments), vectors
        made.postings, made.lengths, made.relations = (store.table(t, segments) for t in ("postings", "lengths", "relations"))
        made.symbols, made.assigned = store.table("symbols", segments).withColumn("is_def", F.lit(True)), store.table("assignments", segments)
        return made

    @property
    def edges(self) -> DataFrame:
        """References between blocks: whose name is defined first depends on all files, so they are joined when asked for."""
        languages = self.files.select("path", "language") if self.files is not None else None
        return derive.references(self.blocks, self.symbols.select(*KEYS, "symbol"), languages)


class Selector:
    """Evidence for a table of questions at once; one question is a table of one row."""

    def __init__(self, index: Index, options: Options = Options()):
        self.index, self.options = index, options

    def _lexical(self, queries: DataFrame, limit: int) -> DataFrame:
        """Hits of all terms; of the whole spelling alone where a question is one spelling that the blocks have."""
        rows = queries.withColumn("terms", T.lexical_terms(F.col("query"))).withColumn("whole", T.whole_terms(F.col("query")))
        fold = lambda c: F.explode(F.array_distinct(F.transform(c, T.fold))).alias("term")
        ask = lambda df, c: R.top_k(R.bm25_scores(df.select("query_id", fold(c)), self.index.postings, self.index.lengths, keys=KEYS), limit, by=R.score_order())
        single = rows.where((F.size("whole") == 1) & (F.col("whole") != F.col("terms")))
        return R.prefer_whole(ask(rows, "terms"), ask(single, "whole"), single)

    def channels(self, queries: DataFrame, limit: int, query_vectors: DataFrame | None = None) -> DataFrame:
        """(query_id, channel, path, ordinal, rank) of all channels."""
        idents = queries.select("query_id", F.explode(T.identifier_candidates(F.col("query"))).alias("symbol"))
        found = {"symbol": R.symbol_channel(idents, self.index.symbols, limit), "lexical": self._lexical(queries, limit)}
        if self.index.relations is not None:
            found["relation"] = R.relation_channel(raise_names(queries, self.options.intent), self.index.relations, self.index.blocks.count(), limit)
        if self.index.vectors is not None and query_vectors is not None:
            ids = self.index.vectors.withColumn("block", F.struct(*KEYS))
            near = R.vector_channel(query_vectors, ids, limit, floor=self.options.floor, id_col="block")
            found["embedding"] = near.select("query_id", "block.*", "rank")
        out = None
        for name, df in found.items():
            rows = df.select("query_id", F.lit(name).alias("channel"), *KEYS, F.col("rank").cast("long").alias("rank"))
            out = rows if out is None else out.unionByName(rows)
        return out

    def evidence(self, queries: DataFrame, query_vectors: DataFrame | None = None) -> DataFrame:
        """(query_id, position, path, ordinal, start_line, end_line, kind, name, n_tokens, text, score, channels), within
        the budget. Texts are joined to the candidates that fusion leaves, no earlier."""
        o = self.options
        # the first ``limit`` of a channel are the first of WIDEN * limit, so a question without any does not ask again
        fused = R.fuse(self.channels(queries, o.limit, query_vectors))
        rows = fused.join(self.index.blocks, KEYS).withColumn("chars", F.length("text").cast("long"))
        packed = self._pack(rows.select("query_id", *KEYS, F.col("fused").alias("score"), "channels", "place", "chars"), o.budget)
        if o.expand:
            packed = self._expanded(packed)
        out = packed.join(self.index.blocks, KEYS)
        if o.drop_conflicts:
            out = self._without_conflicts(queries, out)
        order = ["path", "start_line", "end_line"] if o.canonical else ["place"]
        from pyspark.sql import Window

        position = F.row_number().over(Window.partitionBy("query_id").orderBy(*order)) - 1
        return out.select("query_id", position.cast("long").alias("position"), *KEYS, "start_line", "end_line", "kind", "name", "n_tokens", "text", "score", "channels", "place")

    @staticmethod
    def _pack(rows: DataFrame, budget: int) -> DataFrame:
        """The candidates (a bounded number a question) that the budget takes, in order of place."""
        listed = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", *KEYS, "score", "channels", "chars"))).alias("c"))
        kept = F.transform(R.greedy_fold(F.col("c"), F.lit(budget)), lambda i: F.element_at("c", i + 1))
        return listed.select("query_id", F.explode(kept).alias("e")).select("query_id", "e.*")

    def _expanded(self, packed: DataFrame) -> DataFrame:
        """Blocks that the selected ones refer to, two hops deep, behind them in order of path while the budget lasts."""
        node = F.struct(*KEYS)
        reached = R.expand(packed.select("query_id", node.alias("node")), self.index.edges).select("query_id", "node.*")
        sizes = self.index.blocks.select(*KEYS, F.length("text").cast("long").alias("chars"))
        extra = reached.join(sizes, KEYS).withColumns({"score": F.lit(0.0), "channels": F.array(F.lit("dependency_expansion"))})
        from pyspark.sql import Window

        order = F.row_number().over(Window.partitionBy("query_id").orderBy(*KEYS))
        extra = extra.withColumn("place", (order + (1 << 20)).cast("long"))
        both = packed.select("query_id", *KEYS, "score", "channels", "place", "chars").unionByName(extra.select("query_id", *KEYS, "score", "channels", "place", "chars"))
        return self._pack(both, self.options.budget)

    def _without_conflicts(self, queries: DataFrame, rows: DataFrame) -> DataFrame:
        given = self.index.assigned.groupBy(*KEYS).agg(F.collect_list(F.struct("symbol", "value_hash")).alias("assigned"))
        whole = rows.join(given, KEYS, "left").join(queries.select("query_id", "query"), "query_id")
        ids = whole.withColumn("id", F.xxhash64(*KEYS)).withColumn("rank", F.col("place"))
        left = conflicts.drop_conflicts(ids.select("query_id", "query", "rank", "id", "path", "text", "assigned", "ordinal"))
        return rows.join(left.select("query_id", *KEYS), ["query_id", *KEYS], "left_semi")

    def select(self, queries: DataFrame, query_vectors: DataFrame | None = None) -> DataFrame:
        """One row a question, also where nothing is found: (query_id, spans, context, n_tokens, risk, status, escalation,
        reduction_pct). reduction_pct is null where nothing is selected."""
        rows = self.evidence(queries, query_vectors)
        ordered = F.array_sort(F.collect_list(F.struct("position", F.concat(F.col("path"), F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string")).alias("span"), "text")))
        several = F.size(F.filter("channels", lambda c: c != "dependency_expansion")) > 1
        per = rows.groupBy("query_id").agg(ordered.alias("e"), F.bool_or(several).alias("overlap"), F.sum(F.length("text")).alias("chars"), F.count("*").alias("n"))
        out = queries.join(per, "query_id", "left")
        text, empty = F.array_join(F.transform("e", lambda x: x["text"]), "\n\n"), F.col("n").isNull()
        total = self.index.blocks.agg(F.count("*").alias("all_n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("all_chars"))
        out = out.crossJoin(F.broadcast(total))
        used, available = T.context_tokens(F.coalesce("chars", F.lit(0)), F.coalesce("n", F.lit(0))), T.context_tokens(F.col("all_chars"), F.col("all_n"))
        covered = R.coverage(T.content_terms(F.col("query")), F.coalesce(text, F.lit("")))
        return out.select(
            "query_id", F.coalesce(F.transform("e", lambda x: x["span"]), F.array().cast("array<string>")).alias("spans"), F.coalesce(text, F.lit("")).alias("context"), used.alias("n_tokens"),
            R.risk_band(covered, F.coalesce("overlap", F.lit(False)), empty).alias("risk"), F.when(empty, "fallback_required").otherwise("selected").alias("status"),
            F.when(empty, "raw_fallback").alias("escalation"), F.when(~empty, 100.0 * (available - used) / F.nullif(available, F.lit(0))).alias("reduction_pct"),
        )


def ask(spark: SparkSession, index: Index, question: str, **options) -> dict:
    """The selection for one question as a dictionary."""
    queries = spark.createDataFrame([(0, question)], "query_id long, query string")
    return Selector(index, Options(**options)).select(queries).first().asDict()
