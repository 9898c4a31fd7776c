"""keep_first decides by row: unlinked rows that share a doc_id all stay."""

from pickwise.llm import jaccard


def text(seed, n=40, other=0):
    return " ".join(f"x{seed}{k}" if k < other else f"w{seed}{k}" for k in range(n))


def test_rows_that_share_a_doc_id(spark):
    a, near = text("a"), text("a", other=1)
    rows = [
        (1, a, "stays"), (5, near, "copy of 1"), (5, text("c"), "stays"),  # clean text beside a copy, one doc_id
        (7, text("d"), "stays"), (7, text("e"), "stays"),  # two unrelated texts
        (9, text("f"), "stays"), (9, text("f"), "stays"), (9, text("f").upper(), "stays"),  # one row of three equal sets
        (10, text("f", other=1), "copy of 9"), (11, text("g"), "stays"), (12, text("g", other=1), "copy of 11"),
        (13, None, "stays"), (13, " ", "stays"), (13, text("h"), "stays"), (14, "", "stays"), (None, a, "stays"), (None, a, "stays"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, note string").repartition(3)
    kept = jaccard.keep_first(df)
    assert kept.columns == df.columns
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect())
    want = sorted((i or 0, t or "") for i, t, note in rows if note == "stays" and i != 9) + [(9, text("f").upper())]
    assert got == sorted(want)
