"""Source audit: shards of any size and a plain computation give the same rows."""

import random
import re
from collections import Counter, defaultdict

from inkwell.llm import source_audit as A

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, ranks):
    count, seen, groups = defaultdict(Counter), Counter(), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        count[lang, source].update(terms)
        seen.update((lang, t) for t in set(terms))
    out = []
    for lang, sources in groups.items():
        kept = sorted((t for (x, t), n in seen.items() if x == lang and n >= 3), key=str.encode)
        v = len(kept)

        def shares(own):
            total = sum(own[t] for t in kept)
            return {t: 1 + 10 ** 9 * (own[t] + 1) // (total + v) for t in kept}
        whole = shares(sum((count[lang, s] for s in sources), Counter()))
        p = {s: shares(count[lang, s]) for s in sources}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((-f(p[s][t], whole[t]), t.encode()) for t in kept
                           if count[lang, s][t] and p[s][t] > whole[t])[:ranks]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, i.decode(), -x, n + 1) for n, (x, i) in enumerate(found)]
    return sorted(out)


def check(spark, rows, ranks=200, **options):
    docs = spark.createDataFrame([(*r, 1) for r in rows], "text string, lang string, source string, term int").repartition(3)
    got = A.audit(docs, term_ranks=ranks, **options)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute(rows, ranks)


def rows(n=120):
    r = random.Random(3)
    pool = [f"w{chr(97 + i % 26)}{'xyz'[i % 3]}" for i in range(60)] + ["É", "é", "漢字", "Z", "z"]
    return [(" ".join(r.choices(pool, k=r.randrange(40))) + r.choice(["", ".", "1 2"]), r.choice(["en", "de", None]),
             r.choice(["a", "b", "c", None, "é"])) for _ in range(n)]


def test_shards_of_any_size(spark):
    for cells in (1 << 20, 7):
        check(spark, rows(), cells=cells)


def test_rank_limit_and_ties(spark):
    check(spark, rows(), ranks=3)


def test_odd_rows(spark):
    check(spark, [])
    check(spark, [(None, None, None), ("", "en", "a"), ("1 2", "en", "b"), ("x", "en", "c")])  # no kept terms
    check(spark, [("x y " * 50_000, "en", "a")] * 4 + [("x", "en", "b"), ("", "en", "c"), ("x y", "de", "a")])


def test_counts_do_not_depend_on_pieces(spark, monkeypatch):
    docs = spark.createDataFrame(rows(), "text string, lang string, source string").toArrow()
    docs = docs.set_column(0, "text", docs["text"].fill_null("")).to_batches()
    want = {}
    for limit, held in ((4 << 20, 400_000), (50, 10)):
        monkeypatch.setattr(A, "HELD_COUNTS", held)
        pieces = A.pieces
        monkeypatch.setattr(A, "pieces", lambda b, limit=limit: pieces(b, limit))
        total = Counter()
        for batch in A._count(iter(docs)):
            for r in batch.to_pylist():
                total[r["lang"], r["source"], r["term"], "n"] += r["n"]
                total[r["lang"], r["source"], r["term"], "d"] += r["docs"]
        monkeypatch.setattr(A, "pieces", pieces)
        want[held] = total
    assert want[400_000] == want[10] and want[10]


def test_shares_are_exact_beyond_64_bits(spark):
    n, total, v = 9_000_000_000_000_000_000, 9_100_000_000_000_000_000, 7
    row = spark.createDataFrame([(n, total, v)], "n long, total long, v long")
    got = row.select(A.share(row.n, row.total, row.v)).first()[0]
    assert got == 1 + 10 ** 9 * (n + 1) // (total + v)
