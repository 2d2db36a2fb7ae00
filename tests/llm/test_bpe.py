"""BPE against the tokenizers library and exact round trips of its parts."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from inkwell.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001/documents.parquet"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def encoder():
    arrays = bpe.Vocabulary(PATH).arrays()
    words = sorted(w.encode() for w in ("the", "of", "thing", "things", "ring", "rings", "élan", "."))
    ids = bpe.Merger(arrays).merge(words)
    lexicon = bpe.compile_lexicon(
        [(w, tuple(np.frombuffer(x, "<u4").tolist())) for w, x in zip(words, ids)])
    return bpe.Encoder(arrays | lexicon)


def digests(library, doc_id, text):
    e = library.encode(text or "", add_special_tokens=False)
    decoded = library.decode(e.ids, skip_special_tokens=False)
    return (doc_id, len(e.ids), hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256(decoded.encode()).hexdigest())


def check(spark, library, data):
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = sorted((tuple(r) for r in bpe.query(docs).collect()), key=repr)
    assert got == sorted((digests(library, *r) for r in data), key=repr)


def test_documents(spark, library):
    check(spark, library, [tuple(r) for r in spark.read.parquet(SF).select("doc_id", "text").collect()])


def test_edge_cases(spark, library):
    long = "word" * 30_000
    check(spark, library, [
        (None, None), (1, ""), (1, ""), (2, " \n "), (3, "<|endoftext|>The<|startoftext|> the"),
        (4, long + " " + "ab " * 50_000), (5, "#" * 5000), (6, "ΟΔΟΣ İstanbul ǅ ﬁ 1½² 'S 'll"),
        (6, "same same same"), (6, "same same same")])
    check(spark, library, [])
    docs = spark.createDataFrame([(1, "a b", "x")], "doc_id long, text string, ids string")
    row = bpe.encoded(docs, bpe.build_encoder(docs, PATH)).first()
    assert row.asDict().keys() == {"doc_id", "ids", "decoded"} and row.decoded == "a</w> b</w>"


@settings(max_examples=300, deadline=None)
@given(st.text() | st.text(alphabet="aAbBeE'stre é́Σİ1½… <|>\n"))
def test_any_text(library, encoder, text):
    want = library.encode(text, add_special_tokens=False).ids
    got = encoder.encode([text])[0]
    assert np.frombuffer(got, "<u4").tolist() == want
    assert encoder.decode(got) == library.decode(want, skip_special_tokens=False)


def test_transducer_is_exact_and_minimal():
    entries = sorted({f"{a}{b}ing".encode(): (ord(a), 7, 9) for a in "abc" for b in "xyz"}.items())
    lexicon = bpe.compile_lexicon(entries)
    words = [w for w, _ in entries]
    got = bpe.transduce(lexicon, [*words, b"axin", b"axings", b"", b"q"])
    assert [np.frombuffer(x, "<u4").tolist() for x in got[:9]] == [list(i) for _, i in entries]
    assert got[9:] == [None] * 4
    assert len(lexicon["end_n"]) - 1 == 6  # root, one state after the first letter, x|y|z, i, n, g


def test_mapped_file(tmp_path):
    arrays = bpe.Vocabulary(PATH).arrays() | bpe.compile_lexicon([])
    bpe.save_arrays(arrays, str(tmp_path / "lexicon"))
    mapped = bpe.map_arrays(str(tmp_path / "lexicon"))
    assert all(np.array_equal(mapped[k], arrays[k]) for k in arrays)
    assert bpe.transduce(mapped, [b"the"]) == [None]
