"""The pipeline's line dedup on documents without a source."""

import corpus_pipeline as pipeline


def test_no_source_is_a_source(spark):
    rows = [(i, f"all rights reserved\nline {i}", "en", s, 0) for s in (None, "a") for i in range(30)]
    rows += [(100 + i, f"rare\nown {i}", "en", "", 7) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = pipeline.line_dedup(spark, df, "").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.text == (f"line {r.doc_id}" if r.doc_id < 100 else f"rare\nown {r.doc_id - 100}")
        assert r.n_chars == (len(r.text) if r.doc_id < 100 else 7)
