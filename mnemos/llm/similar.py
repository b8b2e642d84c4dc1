"""Near-duplicates by the Jaccard similarity of word shingles, from two kinds of candidates.

Fingerprints within a few bits of each other (operator 4's grid of segment counts) and sets that share a MinHash bucket
(operator 13's stars) are candidates. Each candidate edge is verified on the whole sets, buckets that hold several
components are searched whole, and only verified links are closed to groups. SimHash alone can't give a similarity of
0.8: such pairs lie some ten bits apart, and a radius that covers them has too many unrelated neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemos.llm import minhash, simhash
from mnemos.llm.common import materialize

#: Bits in which the fingerprints of candidates differ at most.
DISTANCE = 4


def by_fingerprint(rows: DataFrame) -> DataFrame:
    """Candidate edges (u, v) of rows (row, f): each row with the first one of its fingerprint, and those of linked fingerprints."""
    first = materialize(rows.groupBy("f").agg(F.min("row").alias("first")), "prints")
    same = rows.select("f", "row").join(first, "f").where("row <> first").select(F.col("first").alias("u"), F.col("row").alias("v"))
    near = materialize(simhash.links(first.select("f"), DISTANCE), "near")
    one, other = (first.select(F.col("f").alias(f"f{c}"), F.col("first").alias(c)) for c in "uv")
    near = near.select(F.col("u").alias("fu"), F.col("v").alias("fv")).join(one, "fu").join(other, "fv").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return same.unionByName(near).distinct()


def near_groups(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """One row for each row of ``df``: ``key``, ``n_shingles`` and ``component_id``.

    Rows link when the Jaccard similarity of their sets is ``num / den`` or more; ``component_id`` is the smallest key
    reachable (null keys aside). Null, empty and blank texts have the empty set and link with each other only.
    """
    also = {"f": simhash.fingerprints(F.col("text"), shingle)}
    found = minhash.grouped(minhash.sketched(df, key, text, shingle, num, den, also), key, shingle, num, den, by_fingerprint)
    blank = found.where("n_shingles = 0").agg(F.min(key)).first()[0]
    return found.select(key, "n_shingles", F.when(F.col("n_shingles") == 0, F.lit(blank).cast(found.schema["component_id"].dataType)).otherwise(F.col("component_id")).alias("component_id"))


def representatives(df: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``df`` with the smallest key of their component; of components with null keys only, all rows.

    Null, empty and blank texts are near-duplicates of each other; rows with the key that stays all stay, however long their
    texts are. A column named ``__k`` raises ValueError. An empty table stays empty.
    """
    if "__k" in df.columns:
        raise ValueError("__k is the name of a helper column")
    found = near_groups(df, key, text, **how)
    gone = materialize(found.where(F.col("component_id").isNotNull() & ~F.col(key).eqNullSafe(F.col("component_id"))).select(F.col(key).alias("__k")).distinct(), "gone")
    return df.join(gone, df[key].eqNullSafe(gone["__k"]), "left_anti").select(df.columns)
