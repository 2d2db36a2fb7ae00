"""Quality classifier: features and scores in plain Python, and the training sample."""

import math
import random
import zlib

import numpy as np
import pytest

from inkwell.llm import quality_mil as Q


def plain_features(text):
    """Features of each passage, byte by byte."""
    data = text or b""
    spans, start = [], None
    for i, b in enumerate(data + b" "):
        if b in b" \t\n\v\f\r":
            if start is not None:
                spans.append((start, i))
            start = None
        elif start is None:
            start = i
    if not spans:
        return [[0.0] * (Q.FEATURES - Q.PAIRS - 1) + [1.0] + [0.0] * Q.PAIRS]
    low = [b + 32 if 65 <= b <= 90 else b for b in data]
    out = []
    for at in range(0, len(spans), Q.PASSAGE_WORDS):
        part = spans[at:at + Q.PASSAGE_WORDS]
        n, k = len(part), len(Q._CLASSES)
        kinds = [0.0] * k
        for a, b in part:
            for x in data[a:b]:
                kinds[Q._TABLE[x]] += 1
        chars = max(sum(kinds), 1)
        seen = [bytes(low[a:b]) for a, b in part]
        sums = [(sum(x * 2654435761 % 1000003 * (x + 7) for x in w) * 64 + len(w)) for w in seen]
        again = sum(sums[i] == sums[i - 1] for i in range(1, n))
        begin = 0 if at == 0 else part[0][0]
        end = spans[at + Q.PASSAGE_WORDS][0] if at + Q.PASSAGE_WORDS < len(spans) else len(data)
        last = [data[b - 1] for _, b in part]
        symbol, upper = Q._CLASSES.index("symbol"), Q._CLASSES.index("upper")
        shape = [sum(b - a for a, b in part) / n / 10, len(set(sums)) / n, again / n,
                 sum(x == ord(".") for x in last) / n, sum(Q._TABLE[x] == symbol for x in last) / n,
                 data[begin:end].count(b"\n") / n, sum(Q._TABLE[data[a]] == upper for a, _ in part) / n,
                 math.log1p(n) / 5, 0.0]
        pairs = [0.0] * Q.PAIRS
        for w in seen:
            for x, y in zip(w, w[1:]):
                pairs[(x * 31 + y * 7) % Q.PAIRS] += 1
        total = max(sum(pairs), 1)
        out.append([c / chars for c in kinds] + shape + [math.sqrt(x / total) for x in pairs])
    return out


def plain_score(m, rows):
    """Forward pass with loops."""
    sig = lambda z: 1 / (1 + math.exp(-z))
    hs, es = [], []
    for row in rows:
        words = math.expm1(5 * row[Q._LENGTH])
        x = [max(-8, min(8, (v - a) * s)) * words / (words + Q.HALF_WORDS) for v, a, s in zip(row, m.mean, m.scale)]
        x = [v * (Q.PAIR_WEIGHT if i >= len(x) - Q.PAIRS else 1) for i, v in enumerate(x)]
        h = [math.tanh(sum(v * w for v, w in zip(x, col))) for col in m.encode.T]
        t = [math.tanh(sum(v * w for v, w in zip(h, col))) for col in m.V.T]
        g = [sig(sum(v * w for v, w in zip(h, col))) for col in m.U.T]
        hs.append(h)
        es.append(sum(a * b * w for a, b, w in zip(t, g, m.w)))
    top = max(es)
    a = [math.exp(e - top) for e in es]
    z = [sum(w * h[k] for w, h in zip(a, hs)) / sum(a) for k in range(len(hs[0]))]
    return sig(sum(v * w for v, w in zip(z, m.out)) + m.bias)


def texts():
    rng = random.Random(4)
    words = ["the", "The", "cat,", "dog.", "x1", "é漢", "#tag|", "go", "go", "A", "it's", "!!"]
    made = ["".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "\t"]) for _ in range(n)) for n in (1, 5, 127, 128, 129, 400)]
    return [None, b"", b" \n ", b"word " * 300, *(t.encode() for t in made), ("\n" + made[3]).encode()]


@pytest.mark.parametrize("text", texts())
def test_features(text):
    assert Q.passage_features(text) == pytest.approx(np.array(plain_features(text)), abs=2e-6)


def labelled(n=80):
    rng = random.Random(1)
    good, bad = ["the cat sat on a mat and so on, said she. "], ["#### $$$ BUY now!!! click 99 99 99 "]
    rows = [(i, "".join(rng.choices(good if i % 2 else bad, k=rng.randrange(1, 40)))) for i in range(n)]
    return rows, [(i, i % 2) for i in range(n)]


def frames(spark, rows, labels):
    return (spark.createDataFrame(rows, "doc_id long, text string"),
            spark.createDataFrame(labels, "doc_id long, quality int"))


def test_scores(spark):
    rows, labels = labelled()
    docs, marks = frames(spark, rows, labels)
    model = Q.fit(docs, marks)
    for r in Q.scored(docs, model).collect()[:20]:
        assert r.score == pytest.approx(plain_score(model, plain_features(r.text.encode())), abs=1e-5)


def test_many_rows_of_one_labelled_document(spark, monkeypatch):
    """20,000 rows of one id are one bag, or a bounded sample of its texts."""
    rows, labels = labelled()
    seen = []
    train = Q.train
    monkeypatch.setattr(Q, "train", lambda bags, y: seen.append((len(bags), sum(map(len, bags)))) or train(bags, y))
    docs, marks = frames(spark, rows, labels)
    alone = Q.fit(docs, marks)
    again = spark.range(20_000).selectExpr("1L AS doc_id", f"'{rows[1][1].replace(chr(39), '')}' AS text")
    same = Q.fit(docs.where("doc_id <> 1").unionByName(again), marks)
    assert seen[0] == seen[1] and np.allclose(alone.out, same.out)
    other = spark.range(20_000).selectExpr("1L AS doc_id", "concat('text ', id) AS text")
    Q.fit(docs.unionByName(other), marks, max_labelled=10)
    assert seen[2][0] <= 10


def test_every_passage_of_a_long_document_is_learnt_from(spark, monkeypatch):
    seen = []
    train = Q.train
    monkeypatch.setattr(Q, "train", lambda bags, y: seen.append(sorted(map(len, bags))) or train(bags, y))
    rows = [(1, "w " * 10_000), (2, "a b"), (3, "c " * 200)]
    ids = [d for d in range(1, 40) if not zlib.crc32(str(d).encode()) % 4 == 2][:3]
    docs, marks = frames(spark, [(d, t) for d, (_, t) in zip(ids, rows)], [(d, k % 2) for k, d in enumerate(ids)])
    Q.fit(docs, marks)
    Q.fit(docs, marks, max_passages=78)  # the long one does not fit whole and is passed over
    assert seen == [[1, 2, 79], [1, 2]]
