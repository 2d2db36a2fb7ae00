"""SimHash near-dedup against brute force."""

import numpy as np
import pytest
import xxhash

from inkwell.llm import simhash_dedup as sd

SF = "/root/testdata/sf0.001/documents.parquet"


def brute_fp(text):
    ws = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")).translate(
        {c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w]
    sh = [" ".join(ws[i:i + 3]) for i in range(max(1, len(ws) - 2))] if ws else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h) > 0)


def brute_components(rows, bits=2):
    ids = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    fps = sorted({fp for _, fp in ids})
    label = {fp: fp for fp in fps}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x
    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if bin(a ^ b).count("1") <= bits:
                label[root(a)] = root(b)
    least = {}
    for d, fp in ids:
        least.setdefault(root(fp), d)
    return sorted(((d, f"{fp:016x}", least[root(fp)]) for d, fp in ids), key=repr)


def check(spark, data, schema="doc_id long, text string"):
    docs = spark.createDataFrame(data, schema)
    got = sorted((tuple(r) for r in sd.query(docs).collect()), key=repr)
    assert got == brute_components([(r[0], brute_fp(r[1])) for r in data])


def test_shared_keys_within_two_bits():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    a, b = rng.integers(0, 64, (2, 2000)).astype(np.uint64)
    near = fps ^ (np.uint64(1) << a) ^ (np.uint64(1) << b)
    (k1, w1), (k2, w2) = sd.keys(fps), sd.keys(near)
    one, two = set(zip(w1, k1)), set(zip(w2, k2))
    assert {w for w, _ in one & two} == set(range(2000))


def test_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(SF).select("doc_id", "text").collect()]
    check(spark, rows)


def test_edges_of_buckets():
    """Small and large buckets give the components of all pairs."""
    rng = np.random.default_rng(2)
    centre = np.uint64(0x123456789ABCDEF0)
    for m in (5, 24, 25, 300):
        f = np.unique(centre ^ (np.uint64(1) << rng.integers(0, 64, m).astype(np.uint64))
                      ^ (np.uint64(1) << rng.integers(0, 64, m).astype(np.uint64)))
        u, v = sd.bucket_links(np.zeros(len(f), np.int64), f, 2)
        label = {int(x): int(x) for x in f}
        for a, b in zip(u, v):
            label[int(a)] = int(b)
        want = {}
        todo = set(map(int, f))
        while todo:
            comp, stack = set(), [min(todo)]
            while stack:
                x = stack.pop()
                if x in todo:
                    todo.discard(x)
                    comp.add(x)
                    stack += [y for y in todo if bin(x ^ y).count("1") <= 2]
            want.update({x: min(comp) for x in comp})
        assert label == want


def test_edge_cases(spark):
    long = " ".join(f"w{i % 977} x{i}" for i in range(60_000))
    check(spark, [(5, None), (3, ""), (4, " \n\t"), (9, "one"), (8, "one two"), (7, "ONE two"),
                  (1, long), (2, long + " end"), (6, "a b c d"), (6, "a b c d")])
    check(spark, [])
    docs = spark.createDataFrame([(None, "x y z", "k"), (None, "x y z", "k"), (2, "x y z", "l")],
                                 "doc_id long, text string, component_id string")
    assert {tuple(r) for r in sd.query(docs).collect()} == {
        (None, f"{brute_fp('x y z'):016x}", 2), (2, f"{brute_fp('x y z'):016x}", 2)}
    kept = sd.deduplicated(docs).collect()
    assert [tuple(r) for r in kept] == [(2, "x y z", "l")]
    with pytest.raises(ValueError):
        sd.links(docs, 3)


@pytest.mark.parametrize("bits", [1, 2])
def test_large_buckets_lose_no_link(bits):
    """Random buckets beyond the pairwise size, many near each other."""
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(sd.PAIRWISE + 1, 80))
        fps = np.unique(rng.integers(0, 1 << 7, n, dtype=np.uint64) << np.uint64(int(rng.integers(0, 57))))
        u, v = sd.bucket_links(np.zeros(len(fps), np.int64), fps, bits)
        got = {int(x): int(x) for x in fps}

        def root(x):
            while got[x] != x:
                x = got[x]
            return x
        for a, b in zip(u.tolist(), v.tolist()):
            got[root(a)] = root(b)
        want = {d: c for d, _, c in brute_components([(int(x), int(x)) for x in fps], bits)}
        assert {frozenset(x for x in want if want[x] == c) for c in want.values()} == {
            frozenset(x for x in got if root(x) == c) for c in map(root, got)}
