"""Wu-Manber search against a plain search of word windows."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkwell.llm import decontaminate as D

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, size):
    w, hit, found = words(text), set(), set()
    for item, x in items:
        x = words(x)
        k = min(size, len(x))
        for j in range(len(x) - k + 1 if k else 0):
            for i in range(len(w) - k + 1):
                if w[i:i + k] == x[j:j + k]:
                    hit.update(range(i, i + k))
                    found.add("" if item is None else str(item))
    return len(w), sorted(hit), sorted(found)


def check(spark, docs, items, size, **options):
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in D.searched(frame, table, size, **options).collect()}
    assert len(got) == len(docs)
    for i, text in enumerate(docs):
        hit = [] if got[i]._hit is None else [int.from_bytes(got[i]._hit[j:j + 4], "little")
                                               for j in range(0, len(got[i]._hit), 4)]
        assert (got[i]._words, hit, got[i]._items) == brute(text, items, size)


DOCS = [None, "", "--", "a", "A b a b a b", "a a a a a a a a a a a a a", "Now: the quick-brown fox, 12 times the quick brown fox",
        "x" * 500 + " the quick brown", "thequick brown fox", "É é 漢 😀 the Quick BROWN", "b a " * 5000,
        "one two three four five six seven eight nine ten eleven twelve", "ten nine eight"]
ITEMS = [(1, "the quick brown"), (2, "a"), (3, None), (4, "!!"), (None, "é 漢"), (5, "a b a b"), (5, "quick brown fox"),
         (6, "two three four five six seven eight nine ten eleven"), (7, "y" * 70 + " z"), (8, "x" * 500 + " the")]


@pytest.mark.parametrize("size", [1, 3, 10])
def test_documents(spark, size):
    check(spark, DOCS, ITEMS, size)


def test_tables_of_bounded_size(spark):
    check(spark, DOCS, ITEMS, 3, table_bytes=60)


def test_empty_sides(spark):
    check(spark, [], ITEMS, 10)
    check(spark, DOCS, [], 10)


def test_clean_documents_keep_their_columns(spark):
    docs = spark.createDataFrame([("a b c", "x", 1), ("c b", "y", 2), (None, "z", 3)], "text string, item string, _hit int")
    items = spark.createDataFrame([(1, "B c")], "item_id long, text string")
    out = D.decontaminated(docs, items)
    assert out.columns == docs.columns
    assert sorted(r[2] for r in out.collect()) == [2, 3]


TEXT = st.lists(st.sampled_from(["a", "b", "ab", "ba", "abababab", "word" * 9]), max_size=30).map(" ".join)


@settings(max_examples=200, deadline=None)
@given(TEXT, st.lists(st.tuples(st.integers(0, 3), TEXT), max_size=6), st.integers(1, 5))
def test_search(text, items, size):
    rows = {(" ".join(w[j:j + min(size, len(w))]), str(i)) for i, x in items for w in [words(x)] if w
            for j in range(len(w) - min(size, len(w)) + 1)}
    places, found = D.hits(D.canonical(text.encode()), D.tables(sorted(rows)))
    assert (places.tolist(), sorted(found)) == brute(text, items, size)[1:]
