"""Documents packed into blocks: rows of a few megabytes of text that move between stages compressed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemos.llm.common import forget, materialize, scratch, small_batches, text_of

#: Text bytes of a block; a longer document is a block of its own.
BLOCK = 4 << 20
#: Of compression: the texts lie on disk until the end.
LEVEL = 6
#: Bytes of input for each bucket of a bucketed table, and its buckets at most.
WIDTH, MOST = 16 << 20, 4096
SCHEMA = "block long, keys array<long>, tags array<string>, sizes array<long>, n_bytes long, data binary"


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", tag: str | None = None, size: int = BLOCK) -> DataFrame:
    """A materialized table of blocks: the rows' keys, tags and text sizes in bytes, and their UTF-8 texts, compressed.

    Null keys and tags stay null; null texts are empty.
    """
    return materialize(packed(df, key, text, tag, size), "blocks")


def packed(df: DataFrame, key: str, text: str, tag: str | None, size: int) -> DataFrame:
    """Not yet materialized: a second run could number the blocks in another way."""

    def run(batches):
        part, n = TaskContext.get().partitionId(), 0
        keys, tags, texts, held = [], [], [], 0

        def give():
            data = b"".join(texts)
            row = [[(part << 32) + n], [keys], [tags], [[*map(len, texts)]], [len(data)], [pa.Codec("zstd", compression_level=LEVEL).compress(data, asbytes=True)]]
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names=["block", "keys", "tags", "sizes", "n_bytes", "data"])

        for batch in batches:
            for k, t, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
                own = x.as_py()
                keys.append(k)
                tags.append(t)
                texts.append(own)
                held += len(own)
                if held >= size or len(texts) >= 65_536:
                    yield give()
                    keys, tags, texts, held, n = [], [], [], 0, n + 1
        if texts:
            yield give()

    small_batches(df.sparkSession)
    rows = df.select(F.col(key).cast("long").alias("key"), (F.col(tag).cast("string") if tag else F.lit(None).cast("string")).alias("tag"), text_of(text).alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def unpack(data: bytes, n_bytes: int) -> bytes:
    return pa.decompress(data, decompressed_size=n_bytes, codec="zstd", asbytes=True) if n_bytes else b""


def starts(sizes) -> np.ndarray:
    """Where each text begins in the block, and the block's end."""
    return np.concatenate([[0], np.cumsum(np.asarray(sizes, dtype=np.int64))]).astype(np.int64)


def kept_blocks(df: DataFrame, key: str = "doc_id", text: str = "text", tag: str | None = None, size: int = BLOCK) -> tuple[DataFrame, int]:
    """As pack(), but in a table bucketed by ``block``, and its number of buckets.

    What is joined by block and dealt out with repartition(number, "block") meets the texts where they lie.
    """
    spark = df.sparkSession
    path = scratch(spark, "blocks")
    name = "mnemos_" + path.rpartition("-")[2]
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = min(MOST, -(-estimate // WIDTH)) if estimate < 1 << 60 else int(spark.conf.get("spark.sql.shuffle.partitions"))  # that large: unknown
    n = max(spark.sparkContext.defaultParallelism, n)
    packed(df, key, text, tag, size).write.bucketBy(n, "block").option("path", path).saveAsTable(name)
    return spark.table(name), n


def forget_blocks(blocks: DataFrame) -> None:
    """Deletes a table of kept_blocks() that nothing will read again, and its entry in the catalog."""
    folders = {f.rpartition("/")[0].rpartition("-")[2] for f in blocks.inputFiles()}
    forget(blocks)
    for own in folders:
        blocks.sparkSession.sql(f"DROP TABLE IF EXISTS mnemos_{own}")
