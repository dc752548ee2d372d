"""Every catalogue query against its SQL on the smallest tables."""

import pytest
from oracle import connect, rows_of_query, rows_of_sql

from quillstone import catalog


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, sf_dir, con, name):
    assert rows_of_query(catalog.QUERIES[name](spark, sf_dir)) == rows_of_sql(con, catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    assert df.columns and df.count() >= 0


def test_entry(spark, sf_dir):
    assert catalog.flagship(spark, sf_dir).count() > 0


def test_plans_have_no_cartesian_product_of_two_tables(spark, sf_dir):
    for name in ("lexical_topk", "greedy_pack", "rrf_fusion", "span_overlap", "pareto_frontier"):
        plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name


def test_sections_follow_the_lines(spark, sf_dir, con):
    """Sections end after each line whose CRC-32 ends in three zeros."""
    import zlib

    want = {}
    for path, text in con.sql("SELECT concat(source, '/', lang, '/doc_', lpad(doc_id::VARCHAR, 8, '0'), '.txt'), text FROM documents WHERE text IS NOT NULL").fetchall():
        lines = text.split("\n")
        want[path] = (1 + sum(zlib.crc32(x.encode()) % 8 == 0 for x in lines[:-1]), len(lines))
    assert {r.path: (r.n_sections, r.n_lines) for r in catalog.QUERIES["line_sections"](spark, sf_dir).collect()} == want


def test_defined_chunks_hold_all_bytes(spark, sf_dir, con):
    import hashlib
    from collections import Counter

    from quillstone.operators import derive

    want = Counter(hashlib.sha256(c).hexdigest() for (t,) in con.sql("SELECT text FROM documents").fetchall() for c in derive.content_chunks((t or "").encode(), 1024))
    assert {r.hash: r.refs for r in catalog.QUERIES["cdc_chunks"](spark, sf_dir).collect()} == dict(want)


def test_selections_keep_to_their_budgets(spark, sf_dir):
    """What is taken is in order, fits, and is what a plain run over a query's candidates takes."""
    from quillstone.operators import sequential
    from quillstone.plans import retrieval

    by = {}
    for r in sorted(retrieval.candidates(spark, sf_dir).collect(), key=lambda r: (r.query_id, r.idx)):
        by.setdefault(r.query_id, []).append(r)
    got = {}
    for r in catalog.QUERIES["info_gain_select"](spark, sf_dir).collect():
        got.setdefault(r.query_id, []).append(r.idx)
    for q, rows in by.items():
        near = {i: {n for n in r.near if 0 <= n < len(rows)} for i, r in enumerate(rows)}
        kept = sequential.information_gain([r.score for r in rows], [r.cost for r in rows], near, 2000, unit=max(r.score for r in rows))
        assert sorted(got.get(q, [])) == [rows[i].idx for i in kept] and sum(rows[i].cost for i in kept) <= 2000
