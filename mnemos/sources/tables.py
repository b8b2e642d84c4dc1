"""Reading and writing tables: fixed schemas, absent files as empty tables, writes that change nothing when nothing changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """An absent path is an empty table of the schema."""
    return spark.read.schema(schema).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def digest(df: DataFrame, *columns: str) -> str:
    """Of a table's rows, in any order."""
    marks = df.select(F.xxhash64(F.to_json(F.struct(*(columns or df.columns)), {"ignoreNullFields": "false"})).cast("decimal(38,0)").alias("h"))
    n, s = marks.agg(F.count("*"), F.sum("h")).first()
    return f"{n}:{s or 0}"


def write_changed(df: DataFrame, path: str) -> bool:
    """Writes Parquet, unless the rows there are the same; says whether it wrote.

    The new rows are written beside the old ones, which are then set aside and deleted last. Where a crash left no table
    but the one set aside, that one is put back first, so at no time are both versions gone.
    """
    spark = df.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs, aside = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration()), path.rstrip("/") + ".old"
    if exists(spark, aside):
        if exists(spark, path):
            fs.delete(fs_path(aside), True)
        else:
            fs.rename(fs_path(aside), fs_path(path))
    if exists(spark, path) and digest(spark.read.schema(df.schema).parquet(path)) == digest(df):
        return False
    fresh = path.rstrip("/") + ".new"
    df.write.mode("overwrite").parquet(fresh)
    if exists(spark, path):
        fs.rename(fs_path(path), fs_path(aside))
    fs.rename(fs_path(fresh), fs_path(path))
    fs.delete(fs_path(aside), True)
    return True


def to_do(work: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """The rows whose key and content hash aren't done."""
    return work.join(done.select(*keys), list(keys), "left_anti")


def page(log: DataFrame, cursor: int, limit: int) -> DataFrame:
    """The next rows of a log after a cursor, with ``more`` if others follow."""
    rows = log.where(F.col("cursor") > cursor).orderBy("cursor").limit(limit + 1)
    place = F.row_number().over(W.orderBy("cursor"))  # over a page and one row
    return rows.withColumns({"more": F.count("*").over(W.partitionBy()) > limit, "__at": place}).where(F.col("__at") <= limit).drop("__at")


def merge_import(current: DataFrame, incoming: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows to add, and the keys that exist with other content; the import applies if there are none."""
    rest = [c for c in current.columns if c != key]
    mark = F.sha2(F.to_json(F.struct(*rest)), 256)
    old = current.select(key, mark.alias("__old"))
    x = incoming.withColumn("__new", mark).join(old, key, "left")
    return x.where("__old is null").select(current.columns), x.where("__old is not null and __old <> __new").select(key)


def export(df: DataFrame, key: str, value: Column) -> DataFrame:
    """One row for each key with all of its values, sorted."""
    return df.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias("items"))


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, sha256, size) of the files in ZIP archives, read where they lie, a megabyte at a time.

    Absolute paths, parent folders, back-slashes, drive letters, links and names that differ in case only fail.
    """
    import hashlib
    import io
    import zipfile

    def unpack(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for at, content in zip(pdf["path"], pdf["content"], strict=True):
                seen = set()
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for info in z.infolist():
                        name = info.filename
                        link = info.external_attr >> 16 & 0o170000 == 0o120000
                        if link or name.startswith("/") or "\\" in info.orig_filename or ":" in name.split("/")[0] or ".." in name.split("/") or name.lower() in seen:
                            raise ValueError(f"unsafe member {name}")
                        seen.add(name.lower())
                        if not info.is_dir():
                            mark, size = hashlib.sha256(), 0
                            with z.open(info) as member:
                                while part := member.read(1 << 20):
                                    mark.update(part)
                                    size += len(part)
                            rows.append((at, name, mark.hexdigest(), size))
            yield pd.DataFrame(rows, columns=["archive", "member", "sha256", "size"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unpack, "archive string, member string, sha256 string, size long")
