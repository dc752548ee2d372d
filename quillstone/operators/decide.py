"""Decisions and evaluation: frontiers, gated choices, retention, grading, pairing, splits, identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.operators.skyline import frontier
from quillstone.scratch import written


def choose(options: DataFrame, *, requests: int, storage: int, slo_ms: float | None = None, key: str | None = None) -> DataFrame:
    """Options with ``reasons`` against each and ``chosen``: the eligible one with the least setup + requests * request time,
    then storage, then name, of all or of each ``key``."""
    reasons = F.array_compact(
        F.array(
            F.when(~F.col("compatible"), "incompatible"), F.when(~F.col("quality_passed"), "quality"), F.when(F.coalesce(F.trim("evidence"), F.lit("")) == "", "no evidence"),
            F.when(F.col("storage_bytes") > storage, "storage"),
            F.when(F.coalesce(F.col("p95_ms") > slo_ms, F.lit(True)), "latency") if slo_ms is not None else F.lit(None).cast("string"),
        )
    )
    cost = F.col("setup_ms") + requests * F.col("request_ms")
    out = options.withColumn("reasons", reasons).withColumn("cost", cost)
    rank = F.struct("cost", "storage_bytes", "name")
    eligible = out.where(F.size("reasons") == 0).groupBy(*([key] if key else [])).agg(F.min(rank).alias("__best"))
    out = out.join(eligible, key, "left") if key else out.crossJoin(F.broadcast(eligible))  # without key one row
    return out.withColumn("chosen", F.coalesce((F.size("reasons") == 0) & (rank == F.col("__best")), F.lit(False))).drop("__best")


def break_even(setup: Column, cold: Column, warm: Column) -> Column:
    """Requests after which a setup pays; null if a warm request is no faster."""
    return F.when(cold > warm, F.floor(setup / (cold - warm)) + 1).cast("long")


def pareto(rows: DataFrame, *, minimize: list[str], maximize: list[str], group: str) -> DataFrame:
    """The rows of each group that no other row of it dominates; equal rows all stay, rows with nulls or NaN go.

    One or two measures are swept: by the first, with the best of the second so far. More are compared by a grid and chunks, see
    ``skyline.frontier``."""
    measures = [(c, 1) for c in minimize] + [(c, -1) for c in maximize]
    valid = F.lit(True)
    for c, _ in measures:
        valid = valid & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & ~F.abs(F.col(c).cast("double")).isin(float("inf"))
    rows = rows.where(valid)
    signed = [(F.col(c) * sign).cast("double") for c, sign in measures]
    marked = rows.withColumns({f"__m{i}": s for i, s in enumerate(signed)})
    if len(measures) == 2:
        steps = marked.groupBy(group, "__m0").agg(F.min("__m1").alias("__l"))
        before = Window.partitionBy(group).orderBy("__m0").rowsBetween(Window.unboundedPreceding, -1)
        steps = steps.withColumn("__b", F.min("__l").over(before)).where("__b IS NULL OR __l < __b")
        return marked.join(steps.drop("__b"), [group, "__m0"]).where("__m1 = __l").drop("__m0", "__m1", "__l")
    values = [f"__m{i}" for i in range(len(measures))]
    groups = marked.select(group).distinct().withColumn("gid", F.monotonically_increasing_id())
    groups = written(groups, "groups").withColumnRenamed(group, "__g")
    points = marked.join(groups, F.col(group).eqNullSafe(F.col("__g"))).select("gid", *values).distinct()
    kept = frontier(points, values).join(groups, "gid").select("__g", *[F.col(v).alias(f"__o{i}") for i, v in enumerate(values)])
    same = F.col(group).eqNullSafe(F.col("__g"))
    for i, v in enumerate(values):
        same = same & (F.col(v) == F.col(f"__o{i}"))
    return marked.join(kept, same, "left_semi").drop(*values)


def first_budget(points: DataFrame, keys: list[str], *, target: float) -> DataFrame:
    """(keys, budget, recall): the least budget whose recall reaches the target, null without one."""
    reached = F.when(F.col("recall") >= target, F.struct("budget", "recall"))
    best = points.groupBy(*keys).agg(F.min(reached).alias("b"))
    return best.select(*keys, "b.budget", "b.recall")


def hash_split(key: Column, share: float = 0.5) -> Column:
    """``dev`` or ``sealed`` by the first 32 bits of a key's SHA-256."""
    head = F.conv(F.substring(F.sha2(key.cast("string").cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.when(head / F.lit(4294967295.0) < share, "dev").otherwise("sealed")


def needles(text: Column, wanted: Column) -> tuple[Column, Column]:
    """(all held, share held) of needles, white space apart; the share is null without needles."""
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    held = F.filter(wanted, lambda n: F.contains(flat(text), flat(n)))
    return F.size(held) == F.size(wanted), F.size(held) / F.nullif(F.size(wanted), F.lit(0))


def macro(rows: DataFrame, *, keys: list[str], query: str, value: str) -> DataFrame:
    """Two-level means: (keys, n, task_mean, macro_mean, any_share, all_share) of 0/1 values, by task and by query."""
    inner = rows.groupBy(*keys, query).agg(F.avg(value).alias("m"), F.max(value).alias("any"), F.min(value).alias("all"), F.count("*").alias("c"), F.sum(value).alias("s"))
    return inner.groupBy(*keys).agg(
        F.sum("c").alias("n"), (F.sum("s") / F.sum("c")).alias("task_mean"), F.avg("m").alias("macro_mean"), F.avg("any").alias("any_share"), F.avg("all").alias("all_share")
    )


def common_cohort(rows: DataFrame, *, task: str, arm: str, score: str) -> DataFrame:
    """The rows of tasks that have a score in every arm: a division."""
    arms = rows.agg(F.countDistinct(arm).alias("arms"))
    full = rows.where(F.col(score).isNotNull()).groupBy(task).agg(F.countDistinct(arm).alias("n")).crossJoin(F.broadcast(arms)).where("n = arms")
    return rows.join(full.select(task), task, "left_semi")


def discordants(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: pairs in which exactly one side passed, and those where both or none did."""
    return pairs.agg(
        F.count(F.when((F.col(a) == 1) & (F.col(b) == 0), 1)).alias("only_a"), F.count(F.when((F.col(a) == 0) & (F.col(b) == 1), 1)).alias("only_b"),
        F.count(F.when((F.col(a) == 1) & (F.col(b) == 1), 1)).alias("both"), F.count(F.when((F.col(a) == 0) & (F.col(b) == 0), 1)).alias("neither"),
    )


def fingerprint(*columns: str) -> Column:
    """SHA-256 of a canonical JSON object of columns by name."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def with_previous(rows: DataFrame, *, group: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Adds ``name``: the value of the row before in its group's order, null for the first. The rows are sorted by ranges, not by
    group in one task each; a range's first row takes the last of the range before, of which there is one row a range."""
    place = [*group, *order]
    dealt = rows.repartitionByRange(*place).sortWithinPartitions(*place).withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()})
    dealt = written(dealt, "ordered")
    key = F.struct(*group)
    last = dealt.groupBy("__part").agg(F.max_by(F.struct(key.alias("g"), F.col(value).alias("v")), "__at").alias("end"))
    last = last.select("__part", F.lag("end").over(Window.orderBy("__part")).alias("__end"))
    inside = Window.partitionBy("__part").orderBy("__at")
    before = F.coalesce(F.lag(F.struct(key.alias("g"), F.col(value).alias("v"))).over(inside), F.col("__end"))
    out = dealt.join(F.broadcast(last), "__part", "left").withColumn("__before", before)
    return out.withColumn(name, F.when(F.col("__before.g").eqNullSafe(key), F.col("__before.v"))).drop("__part", "__at", "__end", "__before")


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading elements two arrays share."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    short = F.least(F.size(a), F.size(b))
    first = F.array_position(F.slice(same, F.lit(1), F.greatest(short, F.lit(1))), False)
    return F.when(short == 0, 0).when(first == 0, short).otherwise(first - 1).cast("long")


def common_prefix_bytes(a: Column, b: Column) -> Column:
    """How many leading UTF-8 bytes two texts share: a search by halves on their prefixes."""
    low = F.least(F.octet_length(a), F.octet_length(b))
    ba, bb = a.cast("binary"), b.cast("binary")

    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"] + 1) / 2).cast("int")
        same = F.substring(ba, F.lit(1), mid) == F.substring(bb, F.lit(1), mid)
        return F.struct(F.when(same, mid).otherwise(s["lo"]).alias("lo"), F.when(same, s["hi"]).otherwise(mid - 1).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), low.cast("int").alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(32)), start, step, lambda s: s["lo"]).cast("long")


def same_answer(got: Column, wanted: Column) -> Column:
    """Type-exact equality of two JSON answers (VARIANT): true is not 1, 1 is not 1.0."""
    return (F.schema_of_variant(got) == F.schema_of_variant(wanted)) & (F.to_json(got) == F.to_json(wanted))


def same_number(got: Column, wanted: Column) -> Column:
    """As ``same_answer``, but numbers compare by value; booleans are no numbers."""
    number = lambda v: F.when(~F.schema_of_variant(v).isin("BOOLEAN"), F.try_variant_get(v, "$", "double"))
    plain = lambda v: ~F.schema_of_variant(v).isin("STRING")
    by_value = F.coalesce((number(got) == number(wanted)) & plain(got) & plain(wanted), F.lit(False))
    return same_answer(got, wanted) | by_value
