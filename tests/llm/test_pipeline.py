"""The pipeline's stages against brute force on their own inputs."""

import corpus_pipeline
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from inkwell.llm import bpe, mixing, quality_mil
from tests.llm import test_simhash as simhash
from tests.llm import test_suffix_dedup as suffix

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, labels = docs.columns, spark.read.parquet(f"{SF}/labels.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, seen[-1], SF).write.parquet(str(tmp_path / name))
        seen.append(spark.read.parquet(str(tmp_path / name)))
    assert all(d.columns == columns for d in seen[:-1])
    rows = [[tuple(r) for r in d.select("doc_id", "text").collect()] for d in seen[:-1]]

    scores = quality_mil.scored(docs, quality_mil.fit(docs, labels))
    assert sorted(rows[1]) == sorted(map(tuple, scores.where("score >= 0.7").select("doc_id", "text").collect()))

    groups = simhash.brute_components([(d, simhash.brute_fp(t)) for d, t in rows[1]])
    assert sorted(d for d, _ in rows[2]) == sorted({c for _, _, c in groups})

    left = {r[0]: r[1] - r[2] for r in suffix.brute(rows[2])}
    for d, t in rows[3]:
        assert left[d] - 8 <= len((t or "").encode()) <= left[d]
    assert all(r.n_chars == len(r.text) for r in seen[3].collect())

    taken = mixing.query(seen[3]).where(F.col("size") > 0).select("doc_id", (F.col("taken") / F.col("size")).cast("int"))
    want = sorted(d for d, n in map(tuple, taken.collect()) for _ in range(n))
    assert sorted(d for d, _ in rows[4]) == want

    library = Tokenizer.from_file(bpe.default_vocabulary())
    ids = {(d, bytes(i)) for d, i in map(tuple, seen[5].select("doc_id", "ids").collect())}
    import numpy as np
    assert ids == {(d, np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes())
                   for d, t in rows[4]}
    assert corpus_pipeline.run(spark, SF).count() == len(want)


def test_odd_rows(spark, tmp_path):
    rows = [(1, None, "en", "a", 0), (1, None, "en", "a", 0), (None, "", None, None, 0),
            (2, "clean words here " * 20, "en", "a", 340), (2, "clean words here " * 20, "en", "a", 340)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _rid int, score string"
    for data in ([(*r, 5, "s") for r in rows], []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES:
            path = str(tmp_path / f"{name}{len(data)}")
            stage(spark, docs, SF).write.parquet(path)
            docs = spark.read.parquet(path)
            if name != "tokens":
                assert docs.columns == [c.split()[0] for c in schema.split(", ")]
