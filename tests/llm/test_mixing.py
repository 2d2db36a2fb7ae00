"""Mix of sources: targets, totals, repeats, and the stage's documents."""

from collections import Counter

from inkwell.llm import mixing


def test_targets_and_totals(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.query(docs).collect()
    total = sum(r["size"] for r in rows)
    taken = sum(r.taken for r in rows)
    largest = max(r["size"] for r in rows)
    assert 1.5 * total - largest <= taken <= 1.5 * total
    assert all(r.taken in (0, r["size"], 2 * r["size"]) for r in rows)
    sources = {(r.source_size, r.target) for r in rows}
    assert abs(sum(t for _, t in sources) - 1.5 * total) < 1e-6 * total
    by = Counter()
    for r in rows:
        by[r.source_size, r.target] += r.taken
    assert all(t <= 2 * s + 1e-6 for s, t in sources)
    assert all(abs(by[k] - k[1]) <= 2 * largest for k in sources)


def test_water_filling(spark):
    """One small heavy source is capped; its excess goes to the others by weight."""
    rows = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 30)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    left = 1.5 * 2040 - 20 - 60
    assert got["a"] == 20 and got[None] == 60
    assert abs(got["b"] - left * 2 / 3) < 1e-9 and abs(got["c"] - left / 3) < 1e-9


def test_mixed_documents(spark):
    text = "one two three four five"
    docs = spark.createDataFrame(
        [(1, text, "a", "p"), (1, text, "a", "p"), (2, None, "a", "q"), (3, "", None, "r"), (4, "x", None, "s")],
        "doc_id long, text string, source string, copies string")
    taken = {}
    for r in mixing.query(docs).collect():
        if r["size"]:
            taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken // r["size"]
    got = Counter(r.doc_id for r in mixing.mixed_documents(docs).collect())
    assert got == {k: v for k, v in taken.items() if v}
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mixed_documents(docs.limit(0)).count() == 0
