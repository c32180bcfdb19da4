"""Rows without an id, and one id on two texts."""

from covarium.llm import decontam, exact_dedup

LEAK = " ".join(f"word{i}" for i in range(12))


def test_decontamination_by_row(spark):
    rows = [(None, f"before {LEAK} after"), (None, "clean text without an id"), (1, f"again {LEAK}"), (1, "clean text under a repeated id"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([("a", LEAK)], "item_id string, text string")
    for broadcast_rows in (1_000_000, 0):
        got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.contaminated) for r in decontam.contamination(docs, bench, broadcast_rows=broadcast_rows).collect())
        assert got == [("1", 6, 0, False), ("1", 13, 12, True), ("2", 0, 0, False), ("None", 5, 0, False), ("None", 14, 12, True)]
    left = decontam.drop_contaminated(docs, bench).collect()
    assert sorted(str(r.text) for r in left) == sorted(str(t) for _, t in (rows[1], rows[3], rows[4]))


def test_exact_dedup_by_row(spark):
    rows = [(1, "Same text"), (2, "same text"), (1, "another text"), (None, "same TEXT"), (None, "a third text")]
    left = exact_dedup.keep_one_copy(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.text for r in left) == ["a third text", "another text", "same text"]
