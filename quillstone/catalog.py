"""All queries by name, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstone.plans import analytics, evaluation, ingest, retrieval, sections, structure

QUERIES: dict = {**ingest.Q, **retrieval.Q, **analytics.Q, **evaluation.Q, **structure.Q, **sections.Q}
SQL: dict = {**ingest.SQL, **retrieval.SQL, **analytics.SQL, **evaluation.SQL, **structure.SQL, **sections.SQL}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["greedy_pack"](spark, sf_dir)
