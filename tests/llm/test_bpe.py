import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from mnemos.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_replay_equals_the_library(library):
    random.seed(1)
    signs = "aab  \n\t'stre re ll0１²é日本😀　\x1c\x85!?.-_#"
    texts = ["".join(random.choice(signs) for _ in range(random.randint(0, 30))) for _ in range(5000)]
    texts += ["", " ", "a" * 3000, "  a  ", " a\n ", "<|endoftext|>", "x " * 2000]
    coder = bpe.Replay(bpe.read_ranks(PATH), P.PATTERN)
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_many_words_empty_the_cache(monkeypatch, library):
    monkeypatch.setattr(bpe, "KEPT", 3)
    coder = bpe.Replay(bpe.read_ranks(PATH), P.PATTERN)
    for text in ["one two three four", "four five", "one six seven"]:
        assert np.frombuffer(coder.encode([text])[0], "<u4").tolist() == library.encode_ordinary(text)


def test_operator_on_odd_tables(spark, library):
    rows = [(1, "the cat", "x"), (1, "the cat", "x"), (2, None, "y"), (3, "", None), (None, "à  b ", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(df, PATH, P.PATTERN), PATH).collect()
    assert len(out) == 5
    for r in out:
        assert r.ids == library.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert bpe.encode(df.limit(0), PATH, P.PATTERN).count() == 0


def test_query_against_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    assert {r.doc_id: tuple(r)[1:] for r in bpe.op7_bpe_merge_replay(spark, sf).collect()} == want


def test_texts_with_odd_spaces_are_cut(library):
    code = "def f(x):\n    if x:\n\t\treturn  x \n\n\n" * 3000
    texts = [code, " " + code, "\x1c \x1c a\x1c b", "a\u2003\u2003 b \u00a0c", "\0 a\0 b", "x" * 5000 + " " + "y, " * 3, ""]
    coder = bpe.Replay(bpe.read_ranks(PATH), P.PATTERN)
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(texts)] == [library.encode_ordinary(t) for t in texts]
    assert len(coder.known) < 60 and max(map(len, coder.known.to_pylist())) <= 256


def test_both_columns_from_one_worker(spark, library):
    df = spark.createDataFrame([(1, "the cat", 7), (2, None, 8)], "doc_id long, text string, __coded int")
    got = bpe.encode(df, PATH, P.PATTERN, decoded="text")
    assert got.columns == ["doc_id", "text", "__coded", "ids"]
    assert [(r.doc_id, bytes(r.text), r["__coded"], r.ids) for r in got.orderBy("doc_id").collect()] == [(1, b"the cat", 7, library.encode_ordinary("the cat")), (2, b"", 8, [])]
