"""Conversations and prompts: classification, compaction, compression, invariants, risk and plan choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.text import fold, folded_words, legacy_tokens

# Cue lists of the trace and conversation compactors, and the pattern of indirection that hides control flow.
CRITICAL = ("critical", "error", "fail", "exception", "finding", "blocked")
NOISE = (
    "0 matches found", "clean, 0 errors", "0% packet loss", "dummy keys", "general tips", "standard startup logs",
    "no critical entries",
)
CONSTRAINT = ("never", "must", "strictly", "constraint", "always", "only")
SUPERSEDED = r"(?i)(?:disregard|ignore|update on|instead of)\s+([a-zA-Z0-9_\s]+?)(?:,|\.|\bwe\b|\buse\b)"
DYNAMIC = r"importlib\.import_module|__import__\s*\(|getattr\s*\(|globals\s*\(\s*\)\s*\[|locals\s*\(\s*\)\s*\[|eval\s*\(|exec\s*\(|setattr\s*\("
CODE = r"\b(?:def |class |import |function |const |public |private )\b"
QUESTION = r"(?s)(?:^|\n\n)(?:QUESTION|Question|Query):[ \t]?(.*)\z"
EMPTY_CONTEXT = 8


def any_of(text: Column, cues: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for cue in cues:
        out = out | text.contains(cue)
    return out


def in_order(value: str, *, turn: str = "turn", role: str = "role") -> Column:
    """The values of a group by turn, as an aggregate of bounded groups (one conversation)."""
    return F.transform(F.array_sort(F.collect_list(F.struct(turn, role, value))), lambda m: m[value])


def classify(messages: DataFrame, *, key: str = "conv_id") -> DataFrame:
    """(key, n_messages, n_tokens, context_type, stable_prefix) of messages (key, turn, role, text).

    Types are tried in the order agent trace, code, conversation, document, general."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = messages.withColumn("text", text)
    turns = F.count(F.when(F.col("role").isin("user", "assistant"), 1))
    prefix = F.when((F.col("role") == "system") | ((F.col("turn") == F.col("first")) & (F.length("text") > 2000)), F.col("turn") - F.col("first") + 1)
    rows = rows.withColumn("first", F.min("turn").over(Window.partitionBy(key)))
    out = rows.groupBy(key).agg(
        F.count("*").alias("n_messages"), F.sum(legacy_tokens(F.col("text"))).alias("n_tokens"), turns.alias("turns"),
        F.array_join(in_order("text"), "\n").alias("full"), F.coalesce(F.max(prefix), F.lit(0)).cast("long").alias("stable_prefix"),
    )
    full = F.col("full")
    trace = full.contains("tool_calls") | F.lower(full).contains("observation:") | full.rlike(r"\btool_result\b")
    code = full.rlike(r"(?s)```(?:[a-zA-Z0-9_-]+)?\s*\n.*?\n```") | full.rlike(CODE)
    document = (F.length(full) > 3000) & full.contains("# ")
    kind = F.when(trace, "agent_trace").when(code, "code").when(F.col("turns") >= 4, "conversation").when(document, "document").otherwise("general")
    return out.select(key, "n_messages", "n_tokens", kind.alias("context_type"), "stable_prefix")


def headings(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?m)^(?:#|##|###)\s+(.+)$"), F.lit(1))


def repeats_lines(text: Column) -> Column:
    """Whether long lines (over 30 characters, four at least) repeat twice or more."""
    long = F.filter(F.transform(F.split(text, "\r\n|\r|\n"), F.trim), lambda x: F.length(x) > 30)
    return (F.size(long) >= 4) & (F.size(long) - F.size(F.array_distinct(long)) >= 2)


def compact_trace(text: Column, query: Column) -> Column:
    """struct(text, omitted): critical lines and those with a query word stay unless they are noise; others that are no
    noise stay while fewer than two lines have been kept."""
    query_words = F.filter(F.array_distinct(folded_words(query)), lambda w: F.length(w) > 3)

    def step(state: Column, line: Column) -> Column:
        low = F.lower(line)
        noise = any_of(low, NOISE)
        wanted = any_of(low, CRITICAL) | F.exists(query_words, lambda w: F.contains(fold(line), w))
        keep = ~noise & (wanted | (F.size(state["kept"]) < 2))
        return F.struct(
            F.when(keep, F.concat(state["kept"], F.array(line))).otherwise(state["kept"]).alias("kept"),
            (state["omitted"] + F.when(keep, 0).otherwise(1)).cast("long").alias("omitted"),
        )

    lines = F.split(text, "\n")
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).cast("long").alias("omitted"))
    done = F.aggregate(lines, start, step)
    head = F.concat(F.lit("<!-- trace: "), done["omitted"].cast("string"), F.lit(" lines omitted -->\n"))
    return F.struct(F.concat(head, F.array_join(done["kept"], "\n")).alias("text"), done["omitted"].alias("omitted"))


def compact_conversation(messages: DataFrame, *, key: str = "conv_id") -> DataFrame:
    """(key, turn, role, text) of the turns kept: the last three, and earlier ones that set a constraint; conversations of
    three turns or fewer stay whole."""
    late = F.row_number().over(Window.partitionBy(key).orderBy(F.col("turn").desc()))
    rows = messages.withColumn("late", late)
    return rows.where((F.col("late") <= 3) | any_of(F.lower("text"), CONSTRAINT)).drop("late")


def superseded(text: Column) -> Column:
    """The phrase that a turn declares superseded; null without one of three characters or more."""
    phrase = F.lower(F.trim(F.regexp_extract(text, SUPERSEDED, 1)))
    return F.when(F.length(phrase) > 2, phrase)


def compress(rows: DataFrame, *, text: str = "text", query: str = "query", key: str = "doc_id", ratio: float = 0.5, min_tokens: int = 500, separator: str = "\n\n") -> DataFrame:
    """Adds ``kept_parts`` (their indexes) to rows: parts by overlap with the query's words and by structure, best first,
    until the first that does not fit the target; the best one always. Short texts keep all parts."""
    parts = F.split(F.col(text), separator)
    words = F.array_distinct(folded_words(F.col(query)))

    def scored(p: Column, i: Column) -> Column:
        overlap = F.size(F.array_intersect(words, F.array_distinct(folded_words(p))))
        structural = F.trim(p).rlike(r"^(?:#|##|def |class |export |public )")
        score = overlap * 2.0 + F.when(structural, 1.5).otherwise(0.0)
        return F.struct((-score).alias("neg"), i.alias("i"), legacy_tokens(p).alias("tokens"))

    ranked = F.array_sort(F.transform(parts, scored))
    total = legacy_tokens(F.col(text))
    target = F.greatest(F.lit(min_tokens).cast("long"), F.floor(total * ratio))

    def step(s: Column, p: Column) -> Column:
        take = ~s["over"] & ((s["used"] + p["tokens"] <= target) | (F.size(s["kept"]) == 0))
        return F.struct(
            F.when(take, s["used"] + p["tokens"]).otherwise(s["used"]).cast("long").alias("used"), (~take).alias("over"),
            F.when(take, F.concat(s["kept"], F.array(p["i"]))).otherwise(s["kept"]).alias("kept"),
        )

    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(False).alias("over"), F.array().cast("array<int>").alias("kept"))
    chosen = F.array_sort(F.aggregate(ranked, start, step)["kept"])
    every = F.sequence(F.lit(0), F.size(parts) - 1)
    return rows.withColumn("kept_parts", F.when(total <= min_tokens, every).otherwise(chosen))


def last_query(messages: DataFrame, *, key: str = "conv_id") -> DataFrame:
    """(key, query): the last user message; of a single one, what follows its question mark-up outside fences."""
    users = messages.where("role = 'user'").groupBy(key).agg(F.max_by("text", "turn").alias("last"), F.count("*").alias("n"))
    marked = F.regexp_extract("last", QUESTION, 1)
    head = F.substring(F.col("last"), F.lit(1), F.length("last") - F.length(marked))
    even = F.pmod(F.regexp_count(head, F.lit("```")), F.lit(2)) == 0
    return users.select(key, F.when((F.col("n") == 1) & F.col("last").rlike(QUESTION) & even, marked).otherwise(F.col("last")).alias("query"))


def invariants(before: DataFrame, after: DataFrame, *, key: str = "conv_id") -> DataFrame:
    """(key, violations) of an optimisation: messages (key, turn, role, text) before and after it.

    Envelopes and messages of other roles than user's are to be equal, the last user text is to hold the query, and a
    context body that was there is not to vanish."""
    old = before.select(key, "turn", F.col("role").alias("old_role"), F.col("text").alias("old_text"))
    new = after.select(key, "turn", F.col("role").alias("new_role"), F.col("text").alias("new_text"))
    queries = last_query(before, key=key)
    rows = old.join(new, [key, "turn"], "full_outer").join(queries, key, "left")
    size = lambda c: F.coalesce(F.sum(F.when(F.col(c.replace("text", "role")) == "user", F.length(c))), F.lit(0))
    last = F.max(F.when(F.col("old_role") == "user", F.col("turn")))
    out = rows.groupBy(key).agg(
        F.bool_or(~F.col("old_role").eqNullSafe(F.col("new_role"))).alias("envelope"),
        F.bool_or((F.col("old_role") != "user") & ~F.col("old_text").eqNullSafe(F.col("new_text"))).alias("other"),
        size("old_text").alias("old_size"), size("new_text").alias("new_size"), F.max(F.length("query")).alias("q"), last.alias("last_turn"),
        F.max_by(F.col("new_text").contains(F.col("query")), F.when(F.col("old_role") == "user", F.col("turn"))).alias("survives"),
    )
    body = lambda c: F.floor(F.greatest(F.lit(0), F.col(c) - F.coalesce("q", F.lit(0))) / F.lit(3.8))
    gone = (body("old_size") > EMPTY_CONTEXT) & (body("new_size") <= EMPTY_CONTEXT)
    found = F.array(
        F.when(F.col("envelope"), "envelope changed"), F.when(F.col("other"), "non-user message changed"),
        F.when(gone, "context destroyed"), F.when((F.col("q") > 0) & ~F.coalesce("survives", F.lit(False)), "query lost"),
    )
    return out.select(key, F.array_compact(found).alias("violations"))


def risk_score(coverage: Column, margin: Column, top: Column, dynamic: Column) -> Column:
    """An ordinal risk in [0, 1] from term coverage, the margin between kept and dropped, and indirection."""
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    narrow = clip(F.when(top > 0, margin / top).otherwise(0.0))
    return clip(0.70 * (1 - clip(coverage)) + 0.30 * (1 - narrow) + F.when(dynamic, 0.15).otherwise(0.0))


def score_band(score: Column) -> Column:
    return F.concat(F.lit("uncalibrated:"), F.when(score < 0.20, "low").when(score < 0.50, "moderate").otherwise("high"))


def choose_plan(candidates: DataFrame, *, threshold: float, key: str = "request_id") -> DataFrame:
    """(key, name) of the plan chosen: among those confident enough the cheapest (cost, then tokens) where all are priced,
    else the shortest (tokens, then risk); without any, the most confident. Earlier plans win ties.

    candidates: (key, pos, name, tokens, cost, risk, confidence)."""
    rows = candidates.withColumn("fit", F.col("confidence") >= threshold)
    fit = lambda value: F.when(F.col("fit"), value)
    out = rows.groupBy(key).agg(
        F.bool_and(fit(F.col("cost").isNotNull())).alias("priced"), F.bool_or("fit").alias("some"),
        F.min_by("name", fit(F.struct("cost", "tokens", "pos"))).alias("cheapest"), F.min_by("name", fit(F.struct("tokens", "risk", "pos"))).alias("shortest"),
        F.max_by("name", F.struct("confidence", -F.col("pos"))).alias("surest"),
    )
    return out.select(key, F.when(~F.col("some"), F.col("surest")).when(F.col("priced"), F.col("cheapest")).otherwise(F.col("shortest")).alias("name"))


def quote(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """The price of a request in exact decimals; null where a price is."""
    d = lambda c: c.cast("decimal(20,8)")
    return ((d(tokens_in) * d(price_in) + d(tokens_out) * d(price_out)) / F.lit(1_000_000)).cast("decimal(38,12)")
