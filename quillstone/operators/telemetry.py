"""Traces and runs: redaction, roll-ups, audits."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.session import ship

# Shapes of secrets and names of sensitive keys.
SECRETS = (
    (r"nvapi-[A-Za-z0-9_\-]{30,}", "[REDACTED_NVIDIA_KEY]"),
    (r"sk-[A-Za-z0-9_\-]{20,}", "[REDACTED_API_KEY]"),
    (r"(?i)Bearer\s+[A-Za-z0-9_\-\.]+", "Bearer [REDACTED_TOKEN]"),
)
ASSIGNED = (r"(?i)\b(token|password|secret|api_key)(\s*=\s*\"?)[A-Za-z0-9]{16,}", "$1$2[REDACTED]")
SENSITIVE = ("api_key", "secret", "access_token", "auth_token", "password", "credential")


def redact(text: Column, *, assigned: bool = False) -> Column:
    """Text with secrets masked; with ``assigned`` also long values given to a secret's name."""
    for pattern, label in (*SECRETS, *((ASSIGNED,) if assigned else ())):
        text = F.regexp_replace(text, pattern, label)
    return text


def redact_map(fields: Column) -> Column:
    """A MAP with sensitive keys' values masked whole and others' secrets masked."""

    def of(k: Column, v: Column) -> Column:
        sensitive = F.lit(False)
        for s in SENSITIVE:
            sensitive = sensitive | F.contains(F.lower(k), F.lit(s))
        return F.when(sensitive, "[REDACTED]").otherwise(redact(v))

    return F.transform_values(fields, of)


#: A string, a mark or any other run of a JSON text, each read once whatever its length.
TOKEN = re.compile(r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[{}\[\],:]|[^\s{}\[\],:"]++', re.S)
BLANKS = re.compile(r"\s*")
_PYTHON = [(re.compile(p), label) for p, label in SECRETS]


def redacted(text: str) -> str:
    """A JSON text with the value of every sensitive key masked, whatever its type and depth, and secrets in all other strings;
    the rest stays as it is written. What is no JSON is masked whole if it names a sensitive key, else where it has secrets."""
    try:
        json.loads(text)
    except (ValueError, RecursionError):
        named = any(s in text.lower() for s in SENSITIVE)
        return json.dumps("[REDACTED]") if named else _masked(text)
    out, at, name = [], 0, ""  # name: the last string, a key if a colon follows
    hide, depth = False, 0  # whether a value is being left out, and its open brackets
    for m in TOKEN.finditer(text):
        t = m[0]
        if hide:
            depth += (t in "{[") - (t in "}]")
            if depth == 0:
                out.append(json.dumps("[REDACTED]"))
                hide, at = False, m.end()
            continue
        out.append(text[at : m.start()])
        at = m.end()
        if t == ":" and any(s in name.lower() for s in SENSITIVE):
            hide = True
            at = BLANKS.match(text, at).end()
            out += t, text[m.end() : at]
        elif t[0] == '"':
            name = json.loads(t)
            clean = _masked(name)
            out.append(t if clean == name else json.dumps(clean, ensure_ascii=False))
        else:
            out.append(t)
    return "".join([*out, text[at:]])


def _masked(text: str) -> str:
    for pattern, label in _PYTHON:
        text = pattern.sub(label, text)
    return text


def _redacted_all(texts: pd.Series) -> pd.Series:
    return texts.map(redacted, na_action="ignore")


def redact_json(text: Column) -> Column:
    """JSON text with the values of sensitive keys masked whole, at any depth, and secrets in other strings; null stays null."""
    ship(SparkSession.active())
    return F.pandas_udf(_redacted_all, "string")(text)


def write_traces(traces: DataFrame, path: str) -> None:
    """Append traces, redacted, as JSON lines: any value of a sensitive key, secrets in any text, at any depth."""
    traces.select(redact_json(F.to_json(F.struct(*traces.columns)))).write.mode("append").text(path)


def rollup(traces: DataFrame, keys: list[str], *, original: str = "original_tokens", optimized: str = "optimized_tokens") -> DataFrame:
    """(keys, n, original, optimized, avoided) totals."""
    return traces.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(original).alias("original"), F.sum(optimized).alias("optimized"), (F.sum(original) - F.sum(optimized)).alias("avoided")
    )


def comparable_totals(traces: DataFrame, *, basis: str, legacy: Column) -> DataFrame:
    """One row of totals, null unless all traces count tokens on one basis and none is a legacy one."""
    out = traces.agg(
        F.count("*").alias("n"), F.countDistinct(basis).alias("bases"), F.count(F.when(legacy, 1)).alias("legacy"),
        F.sum("original_tokens").alias("o"), F.sum("optimized_tokens").alias("p"),
    )
    ok = (F.col("bases") == 1) & (F.col("legacy") == 0)
    return out.select("n", "bases", "legacy", F.when(ok, F.col("o")).alias("original_total"), F.when(ok, F.col("p")).alias("optimized_total"))


def histogram(traces: DataFrame, column: str) -> DataFrame:
    return traces.select(F.explode(column).alias(column)).groupBy(column).agg(F.count("*").alias("n"))


#: Bins a group is dealt into, and how often a bin is dealt again.
BINS, REFINED = 4096, 2


def values_at(rows: DataFrame, *, group: str, value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(group, one column for each place) of the exact values at places (from 1, by a group's number of values) in each group's
    order; nulls are left out.

    A group's values are counted in BINS bins over their range, the bin that holds the place is dealt again, and only what is
    left is ranked: counts are combined before the shuffle, and no task sorts a group. Many values in a hair's breadth
    still meet in one task, equal ones as one row.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("g").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    out = None
    for name, place in places.items():
        ends = counted.groupBy("g").agg(F.sum("c").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        ends = ends.select("g", "lo", "hi", place(F.col("n")).cast("long").alias("k"))
        left = counted
        for _ in range(REFINED):
            share = F.when(F.col("hi") > F.col("lo"), (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.lit(0.0))
            left = left.join(ends, "g").where("v BETWEEN lo AND hi").withColumn("bin", F.floor(share * (BINS - 1)))
            bins = left.groupBy("g", "bin", "k").agg(F.sum("c").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi")).withColumn("upto", upto)
            ends = bins.where((F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("c") < F.col("k"))).select("g", "lo", "hi", (F.col("k") - F.col("upto") + F.col("c")).alias("k"))
            left = left.select("g", "v", "c")
        last = F.sum("c").over(Window.partitionBy("g").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
        found = left.join(ends, "g").where("v BETWEEN lo AND hi").withColumn("upto", last).where("upto >= k").groupBy("g").agg(F.min("v").alias(name))
        out = found if out is None else out.join(found, "g")
    return out.withColumnRenamed("g", group)


def medians(rows: DataFrame, *, group: str, value: str) -> DataFrame:
    """(group, median): the exact middle value, or the mean of the two."""
    found = values_at(rows, group=group, value=value, places={"a": lambda n: F.floor((n + 1) / 2), "b": lambda n: F.floor(n / 2) + 1})
    return found.select(group, ((F.col("a") + F.col("b")) / 2).alias("median"))


def passes(content: Column, expected: Column, forbidden: Column) -> Column:
    """Whether an answer holds what is expected and not what is forbidden, whatever the case."""
    bad = F.coalesce(F.contains(F.lower(content), F.lower(forbidden)), F.lit(False))
    return F.contains(F.lower(content), F.lower(expected)) & ~bad


def audit(inputs: DataFrame, outputs: DataFrame, usage: DataFrame) -> DataFrame:
    """(mode, n, passed, prompt_tokens, completion_tokens) of runs; every input is to have an output and a usage a mode.

    inputs: (id, expected_fact, forbidden_fact); outputs: (id, mode, content); usage: (id, mode, prompt_tokens,
    completion_tokens). A key on one side only fails the job."""
    keyed = outputs.join(usage, ["id", "mode"], "full_outer").join(inputs, "id", "full_outer")
    whole = F.col("content").isNotNull() & F.col("prompt_tokens").isNotNull() & F.col("expected_fact").isNotNull()
    checked = keyed.withColumn("id", F.when(whole, F.col("id")).otherwise(F.raise_error(F.concat(F.lit("unmatched id "), F.col("id").cast("string"))).cast(dict(keyed.dtypes)["id"])))
    ok = passes(F.col("content"), F.col("expected_fact"), F.col("forbidden_fact"))
    return checked.groupBy("mode").agg(
        F.count("id").alias("n"), F.count(F.when(ok, 1)).alias("passed"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens")
    )


def valid_traces(traces: DataFrame, *, numbers: tuple[str, ...] = ("original_tokens", "optimized_tokens"), required: tuple[str, ...] = ("request_id",)) -> DataFrame:
    """Traces as they are, if all have what is required and counts that are numbers from 0 on; one that has not fails the job."""
    bad = F.lit(False)
    for c in required:
        bad = bad | F.col(c).isNull()
    for c in numbers:
        bad = bad | F.col(c).isNull() | (F.col(c) < 0)
    first = required[0]
    return traces.withColumn(first, F.when(bad, F.raise_error(F.lit("malformed trace")).cast(dict(traces.dtypes)[first])).otherwise(F.col(first)))


def trace_of(traces: DataFrame, request_id) -> DataFrame:
    """The first trace of a request; no row if there is none."""
    return traces.where(F.col("request_id") == F.lit(request_id)).limit(1)


def retention_by(rows: DataFrame, *, mode: str, value: str, baseline: str) -> DataFrame:
    """(mode, value, pct): each mode's value as per cent of the baseline mode's; null where that is 0 or missing."""
    base = rows.where(F.col(mode) == baseline).agg(F.max(value).alias("__base"))  # one row
    return rows.crossJoin(F.broadcast(base)).select(mode, value, F.round(retention(F.col(value), F.col("__base")), 6).alias("pct"))


def retention(part: Column, base: Column) -> Column:
    """A percentage of a base, null where the base is 0."""
    return 100.0 * part / F.nullif(base, F.lit(0))
