"""The store's rules over odd documents: the planted faults are found, and nothing else."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from oracle import rows_of_query, rows_of_sql

from quillstone import catalog

PLAIN = [(3, "the cat\nsat on the mat"), (7, "the dog"), (8, "The bird\r\nthe end\r\n")]
ODD = {
    "ids over eight digits share paths": [(i, f"the {i}\nend") for i in range(1_000_000_000, 1_000_000_110)],
    "blank texts have no block": [(12, ""), (13, "  \n "), (14, None)],
    "no id, language or source": [(None, "the x"), (15, "the y", None, "web"), (16, "the z", "en", None)],
}


def compared(spark, folder, rows):
    rows = [(i, text, *(more or ("en", "web"))) for i, text, *more in rows]
    columns = dict(zip(("doc_id", "text", "lang", "source"), zip(*rows, strict=True), strict=True))
    types = {"doc_id": pa.int64()}
    pq.write_table(pa.table({c: pa.array(v, types.get(c, pa.string())) for c, v in columns.items()}), folder / "documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet')")
    name = "verify_violations"
    return rows_of_query(catalog.QUERIES[name](spark, str(folder))), rows_of_sql(con, catalog.SQL[name])


@pytest.mark.parametrize("name", ODD)
def test_odd_documents_are_no_violations(spark, tmp_path, name):
    got, want = compared(spark, tmp_path, PLAIN + ODD[name])
    assert got == want


def test_planted_rules_are_listed_where_nothing_is_hit(spark, tmp_path):
    got, want = compared(spark, tmp_path, [(8, "a cat"), (9, "a dog")])
    assert got == want
