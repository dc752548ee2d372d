"""Reports on evaluation runs: arms, outcomes against a baseline, corpora, failures, economics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.operators.decide import needles
from quillstone.scratch import written


def _count(condition: Column, name: str) -> Column:
    return F.count(F.when(condition, 1)).alias(name)


def arm_summary(rows: DataFrame, *, keys: list[str]) -> DataFrame:
    """One row an arm of observations (transport, success, parse_error, length_hit, selected_tokens, input_tokens, latency,
    request): planned and completed, successes and their rate among the completed, transport, parse and length failures,
    means and medians, distinct requests. Rates and means without an observation are null."""
    done = F.col("transport")
    return rows.groupBy(*keys).agg(
        F.count("*").alias("planned"), _count(done, "completed"), _count(done & F.col("success"), "successes"),
        (F.count(F.when(done & F.col("success"), 1)) / F.nullif(F.count(F.when(done, 1)), F.lit(0))).alias("success_rate"),
        _count(~done, "transport_errors"), _count(done & F.col("parse_error"), "parse_errors"), _count(F.col("length_hit"), "length_hits"),
        F.avg("selected_tokens").alias("mean_selected"), F.avg(F.when(done, F.col("input_tokens"))).alias("mean_input"),
        F.percentile(F.when(done, F.col("input_tokens")), 0.5).alias("median_input"), F.percentile(F.when(done, F.col("latency")), 0.5).alias("median_latency"),
        F.countDistinct("request").alias("distinct_requests"),
    )


def _outcome(a: str, b: str) -> Column:
    """``a`` against ``b`` (structs with transport and success): wins, losses, ties, or missing where one has no result."""
    ok = lambda c, f: F.coalesce(F.col(f"{c}.{f}"), F.lit(False))
    return (
        F.when(~(ok(a, "transport") & ok(b, "transport")), "missing").when(ok(a, "success") == ok(b, "success"), "ties").when(ok(a, "success"), "wins").otherwise("losses")
    )


def outcomes(rows: DataFrame, *, arm: str, baseline: str, on: list[str], by: list[str]) -> DataFrame:
    """(arm, by, wins, losses, ties, missing) of each other arm against the baseline arm's observation of the same ``on``."""
    seen = F.struct("transport", "success")
    base = rows.where(F.col(arm) == baseline).select(*on, seen.alias("b"))
    pairs = rows.where(F.col(arm) != baseline).select(arm, *on, seen.alias("a")).join(base, on).withColumn("kind", _outcome("a", "b"))
    return pairs.groupBy(arm, *by).agg(*(_count(F.col("kind") == k, k) for k in ("wins", "losses", "ties", "missing")))


def corpus_comparison(rows: DataFrame, *, baseline: str, keys: list[str]) -> DataFrame:
    """Each corpus against the baseline corpus, group by group of ``keys``: wins, losses, ties, missing and identical requests.

    Fails if a group's tasks are not exactly those of the baseline's group, or a task is there twice: comparing other sets
    would compare nothing.
    """
    one = rows.groupBy("corpus", *keys, "task").agg(F.count("*").alias("n"), F.first(F.struct("transport", "success", "request")).alias("r"))
    base = one.where(F.col("corpus") == baseline).select(*keys, "task", F.col("n").alias("nb"), F.col("r").alias("b"))
    groups = one.where(F.col("corpus") != baseline).select("corpus", *keys).distinct()
    wanted = groups.join(base, keys, "left")  # the baseline's tasks, once for each corpus that has the group
    found = one.where(F.col("corpus") != baseline).withColumnRenamed("r", "a")
    pairs = wanted.join(found, ["corpus", *keys, "task"], "full")
    bad = F.col("a").isNull() | F.col("b").isNull() | (F.col("n") > 1) | (F.col("nb") > 1)
    checked = F.when(bad, F.raise_error(F.lit("corpora lack matching groups of tasks"))).otherwise(_outcome("a", "b"))
    pairs = pairs.withColumn("kind", checked)
    return pairs.groupBy("corpus", *keys).agg(
        *(_count(F.col("kind") == k, k) for k in ("wins", "losses", "ties", "missing")), _count(F.col("a.request").eqNullSafe(F.col("b.request")), "identical")
    )


def failure_split(rows: DataFrame, *, keys: list[str], evidence: Column) -> DataFrame:
    """(keys, task, kind): wrong answers that had all evidence, right ones that lacked some; a row each, so no list grows."""
    kind = F.when(evidence & ~F.col("success"), "wrong_with_evidence").when(~evidence & F.col("success"), "right_without_evidence")
    return rows.select(*keys, "task", kind.alias("kind")).where("kind IS NOT NULL")


def economics(rows: DataFrame, *, keys: list[str]) -> DataFrame:
    """Planned, completed and passed observations of an arm, its unique requests, mean input tokens of the completed, and the sum
    of their quotes: null where one completed observation has none."""
    done = F.col("transport")
    complete = F.count(F.when(done, 1)) == F.count(F.when(done, F.col("quote")))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("planned"), _count(done, "completed"), _count(done & F.col("success"), "passed"), F.countDistinct("request").alias("unique_requests"),
        F.avg(F.when(done, F.col("input_tokens"))).alias("mean_input"), F.when(complete, F.sum(F.when(done, F.col("quote")))).alias("quoted"),
    )


def accuracy(rows: DataFrame, *, category: str, passed: str) -> DataFrame:
    """(category, total, passed, accuracy)."""
    out = rows.groupBy(category).agg(F.count("*").alias("total"), _count(F.col(passed), "passed"))
    return out.withColumn("accuracy", F.col("passed") / F.col("total"))


def pareto_summary(rows: DataFrame, *, keys: list[str]) -> DataFrame:
    """Points of systems at budgets: mean selected tokens, shares in per cent of full recall, leaks and seed failures, mean
    evidence recall and median latency, rounded as reports show them."""
    percent = lambda c: F.round(100.0 * F.avg(F.col(c).cast("double")), 1)
    return rows.groupBy(*keys).agg(
        F.round(F.avg("selected_tokens"), 1).alias("mean_selected"), percent("full_recall").alias("full_recall_pct"), percent("recall").alias("recall_pct"),
        percent("leaked").alias("leak_pct"), percent("seed_failed").alias("seed_failure_pct"), F.round(F.percentile("latency", 0.5), 2).alias("median_latency"),
    )


#: Draws of one task of a bootstrap, about.
DRAWS = 1 << 22
#: Shares of a Poisson draw of mean 1 that are at most 0, 1, 2 and so on.
_AT_MOST = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(9)]


def bootstrap_interval(rows: DataFrame, *, by: list[str], key: str, value: str, resamples: int = 2000, seed: int = 0) -> DataFrame:
    """(by, n, mean, low, high): the mean of paired differences and the central 95 % of its resampled values.

    A resample counts each pair as often as a Poisson draw of mean 1 says, which a hash of its key, the resample and ``seed``
    gives: pairs stay where they are, sums are combined before the shuffle, and reruns agree. A resample without pairs
    is left out; without pairs there is no row.
    """
    pairs = rows.where(F.col(value).isNotNull()).select(*by, F.col(key).cast("string").alias("__key"), F.col(value).cast("double").alias("__d"))
    # What one key has is drawn together: sums by key first, then a list of as many sums as the key has groups.
    sums = pairs.groupBy("__key", *by).agg(F.sum("__d").alias("__d"), F.count("*").alias("__n"))
    keyed = written(sums.groupBy("__key").agg(F.collect_list(F.struct(*by, "__d", "__n")).alias("__sums")), "keys")
    each = keyed.select(F.explode("__sums").alias("x")).select("x.*")
    observed = each.groupBy(*by).agg(F.sum("__n").alias("n"), (F.sum("__d") / F.sum("__n")).alias("mean"))
    drawn = F.md5(F.concat_ws("|", "__key", F.col("__r").cast("string"), F.lit(str(seed))).cast("binary"))
    share = F.conv(F.substring(drawn, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    times = sum(((F.col("__u") >= t).cast("int") for t in _AT_MOST[1:]), (F.col("__u") >= _AT_MOST[0]).cast("int"))
    # Small rows become many: they are dealt by what comes of them, as their bytes do not tell.
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), keyed.count() * resamples // DRAWS)
    draws = keyed.repartition(parts, "__key").withColumn("__r", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).withColumn("__u", share).withColumn("__w", times)
    draws = draws.select("__r", "__w", F.explode("__sums").alias("x")).select("__r", "__w", "x.*")  # a filter on __w would draw anew for it
    means = draws.groupBy(*by, "__r").agg(F.sum(F.col("__w") * F.col("__d")).alias("s"), F.sum(F.col("__w") * F.col("__n")).alias("w")).where("w > 0").withColumn("m", F.col("s") / F.col("w"))
    ends = means.groupBy(*by).agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
    return observed.join(ends, by) if by else observed.crossJoin(F.broadcast(ends)).where("n > 0")


def msc_efficiency(needed: Column, selected: Column, needed_unit: Column, selected_unit: Column) -> Column:
    """Needed over selected tokens in per cent; null where the units they were measured in differ, or nothing was selected."""
    return F.when(needed_unit.eqNullSafe(selected_unit) & (selected > 0), F.round(100.0 * needed / selected, 2))


def prepend(primary: DataFrame, fallback: DataFrame, *, keys: list[str], item: str, rank: str) -> DataFrame:
    """(keys, item, rank): the primary channel's items in their order, then those of the fallback that it lacks, renumbered."""
    from pyspark.sql import Window

    both = primary.select(*keys, item, F.lit(0).alias("channel"), rank).unionByName(fallback.select(*keys, item, F.lit(1).alias("channel"), rank))
    first = both.groupBy(*keys, item).agg(F.min(F.struct("channel", rank)).alias("at"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("at", item)) - 1
    return first.select(*keys, item, place.cast("long").alias(rank))


def attributed_retention(items: DataFrame, tasks: DataFrame) -> DataFrame:
    """(task, strict, recall) of tasks (task, path, start_line, end_line, wanted) by what items (task, path, start_line, end_line,
    text) show of them: only texts of the task's path whose lines meet the task's count. Tasks without any have none."""
    span = tasks.select("task", "path", F.col("start_line").alias("lo"), F.col("end_line").alias("hi"), "wanted")
    met = items.join(span, ["task", "path"]).where((F.col("start_line") <= F.col("hi")) & (F.col("end_line") >= F.col("lo")))
    shown = met.groupBy("task").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_line", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    rows = tasks.select("task", "wanted").join(shown, "task", "left").withColumn("text", F.coalesce("text", F.lit("")))
    whole, share = needles(F.col("text"), F.col("wanted"))
    return rows.select("task", (whole & (F.size("wanted") > 0)).alias("strict"), share.alias("recall"))
