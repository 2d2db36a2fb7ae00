"""Multiset fingerprints: order, insertion, deletion, likeness."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from inkwell.llm import multiset_hash as m
from inkwell.llm.oracles import fingerprint_sql


def lanes(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in df.select("i", m.lanes(F.col("t")).alias("v")).orderBy("i").collect()]


def test_order_and_homomorphism(spark):
    a, b, both, swapped = lanes(spark, "first line\nsecond", "third\nfirst line",
                                "first line\nsecond\nthird\nfirst line",
                                "third\nfirst line\nfirst line\nsecond")
    assert both == swapped != a
    df = spark.createDataFrame([(a, b, both)], "a array<smallint>, b array<smallint>, c array<smallint>")
    r = df.select(m.added(F.col("a"), F.col("b")).alias("s"), m.removed(F.col("c"), F.col("b")).alias("d")).first()
    assert r.s == both and r.d == a


def test_sums_wrap(spark):
    one, many = lanes(spark, "x", "x\n" * 70_000)
    assert many == [(70_000 * x + 32768) % 65536 - 32768 for x in one]


def test_edited_is_nearer_than_next(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r for r in m.query(docs).collect() if r.n_chars > 400]
    assert sum(r.near_edited > r.near_next for r in rows) >= 0.93 * len(rows)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    by_text = {}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in m.query(docs).collect():
        by_text.setdefault(texts[r.doc_id], set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in by_text.values())


def skewed():
    """A far-off id, a third of the rows on one id (half of these equal), many null ids."""
    rows = [(i, f"text {i}. Of its own, number {i * 7}.") for i in range(150)] + [(1 << 60, "far"), (-5, None)]
    rows += [(77, "the same text. Again.")] * 60 + [(77, f"another {i % 40}! And more.") for i in range(60)]
    return rows + [(None, f"null {i % 9}.") for i in range(40)]


@pytest.mark.parametrize("chunk, block", [(5, 2), (5, 256), (30, 4), (500, 256)])
def test_skewed_ids(spark, duck, same, monkeypatch, chunk, block):
    for name, value in {"CHUNK_ROWS": chunk, "BLOCK": block, "COPIES": 7}.items():
        monkeypatch.setattr(m, name, value)
    docs = spark.createDataFrame(skewed(), "doc_id long, text string").repartition(5)
    frame = pd.DataFrame(skewed(), columns=["doc_id", "text"]).astype({"doc_id": "Int64", "text": "string"})
    same(m.query(docs).toPandas().astype({"doc_id": "Int64"}), duck(fingerprint_sql(), documents=frame))


def test_chunks_stay_small(spark, monkeypatch):
    monkeypatch.setattr(m, "CHUNK_ROWS", 50)
    ids = [*range(5000), 1 << 60] + [123] * 2500
    docs = spark.createDataFrame([(i, f"t {n}") for n, i in enumerate(ids)], "doc_id long, text string")
    sizes = {r.chunk: r["count"] for r in m._chunked(docs).groupBy("chunk").count().collect()}
    assert sum(sizes.values()) == 7501 and len(sizes) > 150
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert max(sizes.values()) <= 2 * 2501 / parts and sorted(sizes.values())[-parts - 1] < 50
