"""The corpus pipeline: quality rules, exact dedup, near-dedup by SimHash and MinHash candidates, mixing, byte-level BPE.

Each stage takes what its predecessor kept, whole texts, and returns the columns of documents; the last one returns
the token ids. A caller may write each stage's result and read it again; run() does so in the shared folder. All stages
take null and empty texts, repeated rows and an empty table, which stays empty; a text of any length is taken whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemos.llm import bpe, exact_dedup, mixing, quality_rules, similar
from mnemos.llm.common import materialize, table

#: Near-duplicate stage: words of a shingle, and the Jaccard similarity from which on texts link, as a fraction.
SHINGLE, SIMILARITY = 5, (4, 5)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base or a rule learned from the labels rejects go."""
    return quality_rules.accepted(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal normalised texts the smallest doc_id stays."""
    return exact_dedup.deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the smallest doc_id stays: SimHash links and MinHash buckets give candidates, the whole sets decide."""
    return similar.representatives(docs, shingle=SHINGLE, num=SIMILARITY[0], den=SIMILARITY[1])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; documents that two epochs take come twice."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, and the digest of what they decode to."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe.encode(docs, path, public_tokenizers.PATTERN, decoded="decoded").drop("text")
    return coded.withColumns({"n_tokens": F.size("ids").cast("long"), "decoded_sha256": F.sha2("decoded", 256)}).drop("decoded")


STAGES = [("quality rules", quality), ("exact dedup", exact), ("simhash near-dedup", near), ("mixing", mix), ("bpe", encode)]

#: Learned rules, fingerprints and merges aren't SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
