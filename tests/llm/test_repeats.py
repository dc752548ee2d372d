"""Rows that repeat a doc_id with other texts."""

from quillstone.llm import jaccard


def test_other_texts_of_a_doc_id_stay_and_link(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(5, a), (5, b), (5, b), (7, b + " more"), (3, a + " more"), (9, c), (9, c + " more"), (None, a)]
    for n in (1, 4):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(n)
        got = sorted((r.doc_id, r.component_id) for r in jaccard.near_duplicates(df).collect() if r.doc_id is not None)
        assert got == [(3, 3), (5, 3), (5, 5), (5, 5), (7, 5), (9, 9), (9, 9)]
        kept = sorted((r.doc_id, r.text[0]) for r in jaccard.keep_first(df).collect() if r.doc_id is not None)
        assert kept == [(3, "a"), (5, "b"), (9, "c")]
