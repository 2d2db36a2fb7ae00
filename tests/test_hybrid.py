"""Hybrid retrieval against scores of every document."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest

from inkwell.operators import hybrid as H


def brute(queries, docs, k):
    tok = lambda t: [w for w in re.split(r"[^a-z0-9]+", (t or "").lower()) if w]
    tfs = {i: Counter(tok(t)) for i, t in docs}
    n, avg = len(docs), sum(sum(c.values()) for c in tfs.values()) / len(docs)
    df = Counter(w for c in tfs.values() for w in c)
    raw = {w: math.log(n - f + 0.5) - math.log(f + 0.5) for w, f in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: 0.25 * mean if v < 0 else v for w, v in raw.items()}

    def vector(c):
        v = [0.0] * H.DIMS
        for w, f in c.items():
            if w in df:
                h = hashlib.md5(w.encode()).hexdigest()
                v[int(h[:4], 16) % H.DIMS] += (1 if h[4] < "8" else -1) * f * math.log(1 + n / df[w])
        norm = math.sqrt(sum(x * x for x in v))
        return [x / norm for x in v] if norm else v
    vecs = {i: vector(c) for i, c in tfs.items()}
    out = {}
    for q, text in queries:
        c = Counter(w for w in tok(text) if w in df)
        if not c:
            continue
        v = vector(c)
        words = {i: sum(f * idf[w] * t[w] * 2.5 / (t[w] + 1.5 * (0.25 + 0.75 * sum(t.values()) / avg))
                        for w, f in c.items() if t[w]) for i, t in tfs.items()}
        matched = [s for i, s in words.items() if any(tfs[i][w] for w in c)]
        top = max(matched) if matched else 0
        score = {i: 0.6 * (s / top if top > 0 else 0) + 0.4 * sum(a * b for a, b in zip(v, vecs[i]))
                 for i, s in words.items()}
        out[q] = sorted(score, key=lambda i: (-round(score[i], 9), i))[:k]
    return out


def corpus(seed=1, n=150):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(80)]
    docs = [(i * 7 % 1009, " ".join(rng.choices(pool, k=rng.randrange(1, 30)))) for i in range(n)]
    docs += [(2000 + i, docs[3][1]) for i in range(40)]  # a group of copies deeper than the lists
    docs += [(3000, None), (3001, ""), (3002, "--")]
    queries = [(i, " ".join(rng.choices(pool + ["zzz"], k=6))) for i in range(12)] + [(50, docs[3][1]), (51, "zzz"), (52, None)]
    return queries, docs


@pytest.mark.parametrize("depth", [1, 5, 40])
def test_exact_top_lists(spark, depth):
    queries, docs = corpus()
    q = spark.createDataFrame(queries, "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {}
    for r in H.hybrid_topk(q, d, 5, depth=depth).orderBy("item_id", "rank").collect():
        got.setdefault(r.item_id, []).append(r.doc_id)
    assert got == brute(queries, docs, 5)


def test_no_queries(spark):
    _, docs = corpus(n=10)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame([(1, "zzz")], "item_id long, text string")
    assert H.hybrid_topk(q, d).collect() == []


def test_terms_are_counted_without_a_shuffle(spark):
    """Terms are counted in the row of their text; rows of one id are still added up. Only query terms are stored."""
    from inkwell.operators import retrieval as R
    d = spark.createDataFrame([(1, "b a, b B"), (2, None), (3, ""), (4, "c")], "doc_id long, text string")
    rows = R.term_frequencies(d, "doc_id", "text")
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, rows.select("id", "term", "dl", "tf").collect())) == [(1, "a", 4, 1), (1, "b", 4, 3), (4, "c", 1, 1)]
    twice = R.term_frequencies(d.unionByName(d.limit(1)), "doc_id", "text").select("id", "term", "dl", "tf")
    assert sorted(map(tuple, twice.collect())) == [(1, "a", 4, 2), (1, "b", 4, 6), (4, "c", 1, 1)]
    words = spark.createDataFrame([("a zz",)], "text string")
    postings, stats, _ = R.bm25_index(d, queries=R.query_vocabulary(words, "text"))
    assert [r.term for r in postings.collect()] == ["a"] and stats.count() == 3
