"""Command line: compile, update, query, verify and stats of a store; analyze of a trace log, and explain of one of its requests."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillstone", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, arguments in {"compile": ("source", "store"), "update": ("source", "store"), "query": ("store", "question"), "verify": ("store",), "stats": ("store",), "analyze": ("traces",), "explain": ("traces", "request")}.items():
        sub = commands.add_parser(name)
        for a in arguments:
            sub.add_argument(a)
        if name == "query":
            sub.add_argument("--budget", type=int, default=2000)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("quillstone").getOrCreate()
    from quillstone.operators import selector, telemetry
    from quillstone.sources.documents import scan_tree
    from quillstone.sources.store import Store

    if args.command == "analyze":
        traces = telemetry.valid_traces(spark.read.json(args.traces), required=("token_basis",))
        found = telemetry.rollup(traces, ["token_basis", "mode", "evidence_mode"])
        print(json.dumps([r.asDict() for r in found.collect()]))
        return 0
    if args.command == "explain":
        traces = spark.read.json(args.traces)
        hidden = {c: telemetry.redact(F.col(c)) for c, t in traces.dtypes if t == "string"}
        found = telemetry.trace_of(traces.withColumn("request_id", F.col("request_id").cast("string")).withColumns(hidden), args.request).toJSON().collect()
        print(found[0] if found else "null")
        return int(not found)
    store = Store(spark, args.store)
    if args.command in ("compile", "update"):
        if args.command == "compile":
            files = scan_tree(spark, args.source).select(F.xxhash64("path").alias("doc_id"), "path", "language", "text", "mtime_ns")
        print(json.dumps(store.write(files) if args.command == "compile" else store.update_tree(args.source), sort_keys=True))
    elif args.command == "query":
        index = selector.Index.of_store(store)
        print(json.dumps(selector.ask(spark, index, args.question, budget=args.budget)))
    elif args.command == "verify":
        broken = {r["check"]: r["n"] for r in store.verify().collect() if r["n"]}
        print(json.dumps(broken))
        return int(bool(broken))
    else:
        print(json.dumps(store.manifest(), sort_keys=True))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
