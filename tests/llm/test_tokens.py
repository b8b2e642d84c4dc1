import zlib

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from mnemos.llm import tokens
from mnemos.llm.common import scratch

PATH = P.path("byte_bpe_50k.json")


def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


def brute(rows, end=0):
    out, at, encode = [], 0, library()
    for key, text in rows:
        ids = [*encode(text or ""), end]
        out.append((key, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    return out


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert sorted(map(tuple, tokens.op2_token_files(spark, sf).collect())) == brute(rows)


def test_odd_tables(spark):
    rows = [(5, "b  c \n"), (1, None), (1, None), (2, ""), (2, "<|endoftext|> it's\n \nx"), (9, "word " * 3000)]
    df = spark.createDataFrame([(k, t, "z") for k, t in rows], "doc_id long, text string, tokens string")
    path = scratch(spark, "t")
    tokens.write(df, path, PATH, files=3)
    assert [tuple(r) for r in tokens.positions(spark, path).orderBy("start").collect()] == brute(sorted(rows, key=lambda r: (r[0], r[1] or "")))
    assert tokens.read_range(spark, path, 2, 6).count() == 3
    assert tokens.read_meta(spark, path).columns == ["doc_id", "n_tokens"]
    files = [f for f in (p.removeprefix("file:").replace("//", "") for p in spark.read.parquet(path).inputFiles())]
    found = [pq.ParquetFile(f).metadata.row_group(0) for f in files]
    columns = {g.column(i).path_in_schema: g.column(i) for g in found for i in range(g.num_columns)}
    assert "DELTA_BINARY_PACKED" in columns["tokens.list.element"].encodings and columns["doc_id"].has_column_index
    empty = scratch(spark, "t")
    tokens.write(df.limit(0), empty, PATH)
    assert tokens.positions(spark, empty).count() == 0


def test_rows_with_one_key_over_several_files(spark):
    rows = [(7, "b " * 40), (7, "a"), (7, "c c"), (7, "a"), (7, None), (1, "x")] * 5
    path = scratch(spark, "t")
    tokens.write(spark.createDataFrame(rows, "doc_id long, text string"), path, PATH, files=3)
    got = [tuple(r) for r in tokens.positions(spark, path).orderBy("start").collect()]
    assert got == brute(sorted(rows, key=lambda r: (r[0], r[1] or "")))


def test_a_literal_special_token_as_in_a_plain_call(spark):
    texts = ["a <|endoftext|> b", "a  <|endoftext|>b c", "<|endoftext|>", "plain text", "  <|endoftext|> "]
    t = Tokenizer.from_file(PATH)
    got = tokens.encode(spark.createDataFrame([(x,) for x in texts], "text string"), PATH, 0, special=True).collect()
    assert [r.tokens for r in got] == [[*t.encode(x, add_special_tokens=False).ids, 0] for x in texts]


def test_names_of_the_files_own_columns_are_refused(spark):
    df = spark.createDataFrame([(1, "x", 3)], "doc_id long, text string, n_tokens int")
    try:
        tokens.write(df, scratch(spark, "t"), PATH, meta=("n_tokens",))
    except ValueError:
        return
    raise AssertionError


def test_pages_and_columns_are_skipped(spark):
    df = spark.range(6000).selectExpr("id as doc_id", "concat('word', id % 7, ' and more text') as text", "concat('s', id % 3) as source")
    path = scratch(spark, "t")
    tokens.write(df, path, PATH, meta=("source",), files=1, page_rows=100)
    (name,) = [f.removeprefix("file:").replace("//", "/") for f in spark.read.parquet(path).inputFiles()]
    group = pq.ParquetFile(name).metadata.row_group(0)
    by = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
    assert by["doc_id"].has_column_index and by["doc_id"].has_offset_index and "RLE_DICTIONARY" in by["source"].encodings
    meta = tokens.read_meta(spark, path)
    assert ",tokens:" not in meta._jdf.queryExecution().executedPlan().toString()
    found = tokens.read_range(spark, path, 100, 200)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,100)" in plan and "LessThan(doc_id,200)" in plan and found.count() == 100
