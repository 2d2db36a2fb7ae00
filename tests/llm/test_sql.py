"""Every query with a DuckDB statement, over whole tables and over a table of
odd rows: nulls, empty and long texts, ties and repeated rows, no rows."""

import pandas as pd
import pytest

from inkwell.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 900} the of. {i}\n" for i in range(20_000))
CLEAN = "The cat sat on the mat and it was as good as that. " * 2
ODD = [
    (1, None, "en", None), (2, "", "en", "a"), (2, "", "en", "a"), (3, " \n\t\n", None, "b"),
    (4, LONG, "en", "a"), (5, LONG, "fr", None), (None, "null id", "en", "c"),
    (None, "null id", "en", "c"), (None, "another", None, None), (7, "one\ntwo\none\n\none", "de", "b"),
    (8, CLEAN, "en", "b"), (8, CLEAN, "en", "b"), (9, "SHOUT!! " * 90, "en", "é"),
    (10, "a%%% b&&& c### " * 40, "xx", "Z"), (11, "Istanbul É 😀 漢字 " * 30, "tr", "a"),
    (12, "Released under the MIT licence.\nCopyright (c) 2020 Somebody\n* Licensed under CC BY-NC 4.0", "en", "b"),
    *((20 + i, f"unit {i} of and the to in is that it for on " * 12, "en", "d") for i in range(12)),
]
ITEMS = [(1, "and the to in is that it for on unit 3 of and"), (1, "cat sat"), (2, None), (3, " .. "), (None, "漢字"),
         (4, CLEAN), (5, "É 😀"), (5, "É 😀"), (6, "word1 the of 1 word2 the of 2 word3 the of 3")]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_tables(spark, duck, same, name):
    same(QUERIES[name](spark, SF).toPandas(), duck(ORACLES[name], SF))


@pytest.mark.parametrize("name", sorted(ORACLES))
@pytest.mark.parametrize("rows", [ODD, ODD[:1], []], ids=["odd", "one", "none"])
def test_odd_rows(spark, duck, same, tmp_path, name, rows):
    # Names that the operators use inside clash with extra columns.
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", size int, row_number string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    items = spark.createDataFrame([(*r, 1) for r in ITEMS if rows], "item_id long, text string, item int")
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    got = QUERIES[name](spark, str(tmp_path)).toPandas()
    frame = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"])
    frame = frame.astype({"doc_id": "Int64", "text": "string", "lang": "string", "source": "string"})
    bench = items.toPandas().astype({"item_id": "Int64", "text": "string"})
    same(got, duck(ORACLES[name], documents=frame, benchmark=bench))
