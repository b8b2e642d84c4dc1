"""Token-ID output: Parquet files of token lists that can be read selectively.

Rows are ordered by document over all files. The token column is written without a dictionary as delta-packed
integers, the metadata columns with a dictionary; row groups and pages are bounded, so the footers, page
indexes and column chunks let a reader fetch a range of documents, or the counts without any token.

A special token that stands literally in a text (``<|endoftext|>``) is coded as the characters it is made of, so that its
id is an end only; with ``special`` it gets its one id, as in a plain call of the library. The query follows the call.
"""

from __future__ import annotations

import functools
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemos.llm.chunking import FIRST, Memo, plain
from mnemos.llm.common import scratch, small_batches, table, text_of

WHITE = re.compile(r"\s")
#: Chunks whose ids a task keeps; beyond that only those of the block at hand stay.
KEPT = 400_000
#: Bytes of text dealt to a file, about; more text makes more files.
FILE_BYTES = 64 << 20
#: Characters of a text that tell ranges of rows with the same key apart.
HEAD = 64


class Coder(Memo):
    """A tokenizers.Tokenizer of byte-level BPE; each distinct chunk of a block is given to the library once.

    ``special``: special tokens that stand literally in a text get their one id, as in a plain call of the library.
    """

    def __init__(self, path: str, special: bool = False):
        from tokenizers import Tokenizer

        super().__init__(KEPT)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        if special:
            self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        #: which tokens begin with a space (in the byte alphabet of such files, the letter G with a dot)
        self.spaced = np.array([(self.tokenizer.id_to_token(i) or "").startswith("\u0120") for i in range(self.tokenizer.get_vocab_size())])

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each has."""
        found = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), np.int32), np.array([len(x) for x in found], np.int64)

    def code(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks. Those without other white space are coded many in a text, and told apart by the tokens that begin with a space."""
        alone = np.array([c[:1] == FIRST or not c or WHITE.search(c) is not None for c in new], bool)
        joined = [c for c, own in zip(new, alone.tolist(), strict=True) if not own]
        sizes, parts = np.zeros(len(new), np.int64), []
        for at in range(0, len(joined), 50_000):
            part = joined[at : at + 50_000]
            flat, _ = self._ids([" " + " ".join(part[i : i + 500]) for i in range(0, len(part), 500)])
            begins = np.flatnonzero(self.spaced[flat])
            if len(begins) != len(part):
                raise ValueError("a chunk's first token must begin with its space")
            parts.append((flat, np.diff(begins, append=len(flat))))
        apart = [plain(c) for c, own in zip(new, alone.tolist(), strict=True) if own]
        others = [self._ids(apart[at : at + 10_000]) for at in range(0, len(apart), 10_000)]
        sizes[~alone] = np.concatenate([x for _, x in parts] or [sizes[:0]])
        sizes[alone] = np.concatenate([x for _, x in others] or [sizes[:0]])
        of_alone = np.repeat(alone, sizes)
        ids = np.empty(len(of_alone), np.int32)
        ids[~of_alone] = np.concatenate([x for x, _ in parts] or [ids[:0]])
        ids[of_alone] = np.concatenate([x for x, _ in others] or [ids[:0]])
        return ids, sizes


@functools.cache
def coder_of(path: str, special: bool) -> Coder:
    """One for each Python worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Coder(path, special)


def encode(df: DataFrame, path: str, end: int | None, text: str = "text", ids: str = "tokens", special: bool = False) -> DataFrame:
    """``df`` with the column ``ids`` (array of int): the whole text's ids and then ``end``; a null text counts as empty.

    Rows, ties and repeated rows pass unchanged; a column of that name is replaced; an empty table gives an empty one.
    """

    @F.arrow_udf("array<int>")
    def encoded(texts: pa.Array) -> pa.Array:
        return coder_of(path, special).lists(texts, end)

    small_batches(df.sparkSession)
    return df.withColumn(ids, encoded.asNondeterministic()(text_of(text)))


def write(
    df: DataFrame, path: str, tokenizer: str, end: int | None = 0, key: str = "doc_id", text: str = "text", meta: tuple[str, ...] = (), row_group: int = 8 << 20, page: int = 64 << 10, page_rows: int = 2000,
    files: int | None = None, special: bool = False,
) -> None:
    """Writes ``key``, ``n_tokens``, the columns ``meta`` and ``tokens`` of every row to Parquet at ``path``, rows in ascending ``key``.

    Null keys come first; rows with the same key stand together in the order of their text, over several files where
    they are many; null texts count as empty; an empty table writes no rows. ``meta`` may not name ``n_tokens`` or
    ``tokens``, which raises ValueError. Each file covers a range of keys, so a reader can prune by footers and page
    indexes. Files hold about FILE_BYTES bytes of text each unless ``files`` gives their number.
    """
    if {"n_tokens", "tokens", key} & set(meta) or key in ("n_tokens", "tokens"):
        raise ValueError("n_tokens and tokens are names of the files' own columns")
    rows = df.select(F.col(key).alias("k"), F.struct(*[F.col(c) for c in meta]).alias("m") if meta else F.lit(None).alias("m"), text_of(text).alias("t"))
    if not files:
        size = df.agg(F.sum(F.octet_length(text_of(text)))).first()[0] or 0
        files = max(1, df.sparkSession.sparkContext.defaultParallelism, -(-size // FILE_BYTES))
    rows = rows.repartitionByRange(files, "k", F.substring("t", 1, HEAD)).sortWithinPartitions("k", "t")
    rows = encode(rows, tokenizer, end, "t", "tokens", special)
    rows = rows.select(F.col("k").alias(key), F.size("tokens").alias("n_tokens"), *[F.col("m")[c].alias(c) for c in meta], "tokens")
    (
        rows.write.option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "true")
        .option("parquet.enable.dictionary#tokens.list.element", "false")
        .option("parquet.block.size", row_group)
        .option("parquet.page.size", page)
        .option("parquet.page.row.count.limit", page_rows)
        .option("compression", "zstd")
        .parquet(path)
    )


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """All but the tokens: the scan leaves the token chunks unread. Null keys and repeated rows are kept; no rows if none were written."""
    return (df := spark.read.parquet(path)).select(*[c for c in df.columns if c != "tokens"])


def read_range(spark: SparkSession, path: str, low: int, high: int, key: str = "doc_id") -> DataFrame:
    """The rows with ``low <= key < high``, so none with a null key; row groups and pages outside are skipped."""
    return spark.read.parquet(path).where((F.col(key) >= low) & (F.col(key) < high))


def positions(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """Each row of the files with ``start`` (the ids of all rows before it) and ``ids_crc32``.

    A running sum within each file in the order of its rows, then the files' totals in the order of their numbers,
    which is that of the keys: so rows with one key, and null keys, count in the order in which they lie. The one
    window without a partition has a row for each file. No rows if none were written.
    """

    @F.arrow_udf("long")
    def crc(tokens: pa.Array) -> pa.Array:
        flat, cuts = tokens.flatten().to_numpy(zero_copy_only=False).astype("<u4"), np.concatenate([[0], np.cumsum(tokens.value_lengths().to_numpy(zero_copy_only=False))])
        return pa.array([zlib.crc32(flat[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])], pa.int64())

    part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long").alias("__file")
    small_batches(spark)
    rows = spark.read.parquet(path).select(key, F.col("n_tokens").cast("long").alias("n_tokens"), part, F.col("_metadata.row_index").alias("__row"), crc.asNondeterministic()("tokens").alias("ids_crc32"))
    files = spark.read.parquet(path).select("n_tokens", part).groupBy("__file").agg(F.sum("n_tokens").alias("__sum"))
    before = W.orderBy("__file").rowsBetween(W.unboundedPreceding, -1)
    files = files.select("__file", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    inside = W.partitionBy("__file").orderBy("__row").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("__in", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return rows.join(files, "__file").select(key, (F.col("__before") + F.col("__in")).alias("start"), "n_tokens", "ids_crc32")


def op2_token_files(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    path = scratch(spark, "tokens")
    write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end=0, special=True)
    return positions(spark, path)
