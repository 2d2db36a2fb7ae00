"""Removal of repeated passages against a brute-force scan."""

import hashlib
import random

import numpy as np

from inkwell.llm import chunks
from inkwell.llm import suffix_dedup as sd

SF = "/root/testdata/sf0.001/documents.parquet"


def brute(rows):
    """rows (doc_id, text) in input order -> query rows; nulls last."""
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            w = b[i:i + 100]
            if w in seen:
                gone[i:i + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((doc_id, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def check(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    if options:
        docs = docs.repartition(options.pop("partitions"), "doc_id")
    got = sorted((tuple(r) for r in sd.query(docs).collect()), key=repr)
    assert got == brute(rows)


def test_documents(spark):
    check(spark, [tuple(r) for r in spark.read.parquet(SF).select("doc_id", "text").collect()])


def test_planted_passages(spark, monkeypatch):
    """Passages of many lengths at many offsets, over several chunks."""
    monkeypatch.setattr(chunks, "CHUNK_BYTES", 1 << 13)
    rng = random.Random(4)
    letters = "abcdefghijklmnop é\n"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    base = word(900)
    rows = []
    for i in range(120):
        at, n = rng.randrange(700), rng.choice([50, 97, 99, 100, 101, 133, 170, 200])
        rows.append((rng.randrange(10_000) * 200 + i,
                     word(rng.randrange(150)) + base[at:at + n] + word(rng.randrange(150))))
    rows += [(5_000_000 + i, "Sh " * rng.randrange(30, 90) + word(5)) for i in range(8)]
    rows += [(6_000_000 + i, base[:400] + "x" * i + base[400:]) for i in range(6)]
    check(spark, rows, partitions=5)


def test_edge_cases(spark):
    long = "".join(f"line {i} of many " for i in range(40_000))
    check(spark, [(3, None), (2, ""), (1, "a" * 99), (0, "a" * 100), (4, "a" * 350), (None, "a" * 120),
                  (9, "\0" * 130), (8, "\0" * 220 + "b"), (5, "é" * 60), (6, "xé" + "é" * 60)])
    check(spark, [(1, long), (2, "other start " + long[200_000:300_000])])
    check(spark, [])
    docs = spark.createDataFrame([(1, "é" * 70, 70, "k"), (2, "x" + "é" * 70, 71, "l"), (3, None, 0, "m")],
                                 "doc_id long, text string, n_chars long, kept string")
    got = {r.doc_id: r for r in sd.without_repeats(docs).collect()}
    assert got[1].text == "é" and got[2].text == "x" and got[3].text is None
    assert got[1].n_chars == 1 and got[2].n_chars == 1 and got[1].kept == "k"


def test_merge_of_runs():
    """The loser tree gives the sorted order and true common prefixes."""
    rng = np.random.default_rng(3)
    runs, every = [], []
    for size in (0, 1, 40, 7, 25):
        s = rng.integers(97, 99, (size, sd.WIDTH)).astype(np.uint8)
        s[:, 12:] = 97
        s = s[np.lexsort(s.T[::-1])]
        keep = np.ones(size, bool)
        keep[1:] = (s[1:] != s[:-1]).any(axis=1)
        runs.append(sd.Run(*sd.front_coded(s[keep])))
        every += [bytes(x) for x in s[keep]]
    out = [(n, t) for _, _, n, t in sd.merged(runs)]
    assert [t for _, t in out] == sorted(every)
    for (_, a), (n, b) in zip(out, out[1:]):
        assert n == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), sd.WIDTH)


def test_no_table_stays_in_the_catalog(spark):
    docs = spark.createDataFrame([(1, "a" * 300), (2, "a" * 300)], "doc_id long, text string")
    before = {t.name for t in spark.catalog.listTables()}
    assert sd.query(docs).count() == 2
    assert {t.name for t in spark.catalog.listTables()} == before
