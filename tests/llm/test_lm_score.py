"""Cross-entropy difference against a plain count-based computation."""

from collections import Counter
from math import log2

import pytest

from inkwell.llm import lm_score as lm

SF = "/root/testdata/sf0.001"


def brute(rows, target, share):
    """rows (doc_id, text), target ids -> {position: (n, target, background)}."""
    words = [lm.tokens((t or "").encode()) for _, t in rows]
    good = [d is not None and d in target for d, _ in rows]
    every = Counter(w for x in words for w in x)
    known = {w for w, n in every.items() if n >= share * sum(every.values())}
    texts = [[None] + [w if w in known else "?" for w in x] + ["end"] for x in words]

    def model(chosen):
        pairs = Counter(p for x in chosen for p in zip(x, x[1:]))
        context = Counter(w for x in chosen for w in x[:-1])
        token = Counter(w for x in chosen for w in x[1:])
        total, v = sum(token.values()), len(known) + 2
        return lambda a, b: -log2((pairs[a, b] + lm.SMOOTHING * (token[b] + 1) / (total + v))
                                  / (context[a] + lm.SMOOTHING))
    models = model([x for x, g in zip(texts, good) if g]), model(texts)
    return [(d, len(x) - 1, *(sum(m(a, b) for a, b in zip(x, x[1:])) / (len(x) - 1) for m in models))
            for (d, _), x in zip(rows, texts)]


def check(spark, rows, target, share=lm.WORD_SHARE):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    ids = spark.createDataFrame([(t,) for t in target], "doc_id long")
    key = lambda r: (r[0] is None, r[0] or 0, r[1], round(r[3], 6))
    got = sorted((tuple(r) for r in lm.scored(docs, ids, share).collect()), key=key)
    want = sorted(brute(rows, set(target), share), key=key)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    for g, w in zip(got, want):
        assert g[2:4] == pytest.approx(w[2:], rel=1e-9)
        assert g[4] == pytest.approx(w[2] - w[3], rel=1e-9, abs=1e-9)


def test_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows, [d for d, _ in rows if d % 3 == 0], 1e-3)


def test_edge_cases(spark):
    long = "the of and " * 30_000
    check(spark, [(1, None), (2, ""), (2, " \n"), (None, "a b a b"), (3, "A b a"), (3, "A b a"),
                  (4, long), (5, "x" * 100 + " a"), (6, "a" * 65), (7, "b" * 65), (8, "c" * 100_000 + " b")], [2, 3, 3, 6, 99], 0.0)
    check(spark, [(1, "a b"), (2, "b")], [])
    check(spark, [], [1])


def test_good_documents_score_lower(spark):
    docs, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.01')}/{t}.parquet")
                    for t in ("documents", "labels"))
    out = lm.query(docs, labels).join(labels.where(lm.held_out(labels.doc_id)), "doc_id").toPandas()
    good, bad = (out[out.quality == q].score for q in (1, 0))
    assert (good.median() < bad.quantile(0.1)) and out.n_tokens.gt(0).all()


def test_rare_words_are_words(spark):
    """Words seen once among many others count for themselves."""
    rows = [(1, "common " * 200_000), (2, "rare common"), (3, "scarce common"), (4, "rare"), (5, "scarce")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ids = spark.createDataFrame([(2,)], "doc_id long")
    got = {r.doc_id: tuple(r)[2:4] for r in lm.scored(docs, ids).collect()}
    for d, _, *want in brute(rows, {2}, 0.0):
        assert got[d] == pytest.approx(want, rel=1e-9)
    assert got[4][0] < got[5][0]


def test_long_words_are_words(spark):
    rows = [(1, "a" * 65), (2, "b" * 65), (3, "common")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: tuple(r)[2:4] for r in lm.scored(docs, docs.where("doc_id = 1").select("doc_id")).collect()}
    assert got[1][0] < got[2][0] and got[1][1] == got[2][1]


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", 5, "x"), (2, "b", 6, "y")], "doc_id long, text string, _chunk int, code string")
    ids = spark.createDataFrame([(1,)], "doc_id long")
    got = {tuple(r)[:5] for r in lm.scored(docs, ids).collect()}
    assert got == {tuple(r)[:5] for r in lm.scored(docs.select("doc_id", "text"), ids).collect()}
