"""Importance resampling against a plain computation, and CRC sums of windows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from inkwell.llm import resample as R

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [" ".join(w[i:i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10000


def brute(docs, items, percent=5):
    raw = Counter(bucket(f) for _, x in docs for f in features(x)[1])
    goal = Counter(bucket(f) for x in items for f in features(x)[1])
    s, t = raw.total() + 10000, goal.total() + 10000
    gain = lambda b: math.floor(1000 * math.log((goal[b] + 1) * s / ((raw[b] + 1) * t)))
    out = []
    for d, x in docs:
        n, f = features(x)
        weight = sum(gain(bucket(y)) for y in f)
        h = int(hashlib.sha256(f"42:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32))), None, n])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[5]))
    for i, r in enumerate(able[:percent * len(able) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def check(spark, docs, items, **options):
    frame = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, score int").repartition(3)
    goal = spark.createDataFrame([(x,) for x in items], "text string")
    got = R.resampled(frame.select("doc_id", "text"), goal, **options)
    got = got.select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=repr) == brute(docs, items, **options)


DOCS = [(None, None), (1, ""), (2, " .. "), (3, "One"), (4, "one two"), (4, "One TWO three"), (5, "é 漢字 ÉA " * 9),
        (6, "x" * 5000 + " " + "y" * 100 + " z " * 30), (None, "a b c " * 8), *((i, "same old text " * 9) for i in (9, 8, 8, 7)),
        *((20 + i, f"the {i} cat sat on mat number {i * i} " * 5) for i in range(60)), (99, "big text of words " * 40_000)]


def test_documents(spark):
    items = ["the cat sat on", None, "", "mat é"]
    check(spark, DOCS, items)
    check(spark, DOCS, items, percent=60)


def test_empty_sides(spark):
    check(spark, [], ["a b"])
    check(spark, DOCS, [])


def test_string_ids(spark):
    docs = spark.createDataFrame([("x", "a " * 30), ("y", "b " * 30)], "doc_id string, text string")
    out = R.resampled(docs, docs.select("text"), percent=50).collect()
    assert sorted(r.doc_id for r in out) == ["x", "y"] and sum(r["rank"] is not None for r in out) == 1


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab Z9-é漢\n\x00_"), max_size=200), max_size=4), st.sampled_from([1, 90]))
def test_window_sums(texts, times):
    texts = [x * times for x in texts]
    n, buckets, places = R.batch_windows([type("S", (), {"as_py": lambda self, x=x: x})() for x in texts])
    got = Counter((p, b) for bs, ps in zip(buckets, places) for b, p in zip(bs.tolist(), ps.tolist()))
    assert got == Counter((i, bucket(f)) for i, x in enumerate(texts) for f in features(x)[1])
    assert n.tolist() == [features(x)[0] for x in texts]


def test_moves():
    crc, rng = R.Crc(), np.random.default_rng(1)
    for size in (0, 1, 63, 64, 65, 1000, 70_000):
        a, b = rng.bytes(9), rng.bytes(size)
        moved = crc.move(np.array([zlib.crc32(a)], np.uint32), np.array([size]))
        assert int(moved[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)
