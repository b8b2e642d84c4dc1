"""Folders of work, leases and commits on the shared file system."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _at(spark: SparkSession, path: str):
    """The path and its file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def work_folder(spark: SparkSession, tag: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``, which driver and executors share, deleted when the session's file systems close.

    Only where that is unset and Spark runs in one process, it lies in a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="mnemos-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/mnemos/{tag}-{uuid.uuid4().hex}"
    fs, at = _at(spark, path)
    fs.deleteOnExit(at)
    return path


# --- leases: one writer for each scope ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Lease:
    """The right to write a scope, as long as no later token exists."""

    folder: str
    scope: str
    owner: str
    token: int


def _tokens(spark: SparkSession, folder: str, scope: str) -> list[tuple[int, object]]:
    """The scope's tokens so far, with their files, in order."""
    fs, at = _at(spark, f"{folder}/{scope}")
    if not fs.exists(at):
        return []
    return sorted(((int(f.getPath().getName()), f) for f in fs.listStatus(at) if f.getPath().getName().isdigit()), key=lambda x: x[0])


def acquire(spark: SparkSession, folder: str, scope: str, owner: str, keep_ms: int, now_ms: int | None = None) -> Lease | None:
    """A lease on a scope, or None while another one holds.

    A lease is a file that its writer alone can create (exclusive create), named by a token one above the last. It ends when it
    is released or ``keep_ms`` after its creation; of several writers that take over at once one creates the next file.
    """
    now = int(time.time() * 1000) if now_ms is None else now_ms
    known = _tokens(spark, folder, scope)
    if known and not (ended := _at(spark, f"{folder}/{scope}/{known[-1][0]}.released"))[0].exists(ended[1]) and now < _taken(spark, folder, scope, known[-1][0]) + keep_ms:
        return None
    token = known[-1][0] + 1 if known else 1
    if not _create(spark, f"{folder}/{scope}/{token}", f"{owner}\n{now}"):
        return None
    return Lease(folder, scope, owner, token)


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a file that does not exist; false if it does. Whoever creates it is the only one."""
    fs, at = _at(spark, path)
    fs.mkdirs(at.getParent())
    try:
        out = fs.create(at, False)
    except Exception as e:  # the file system's own exception, wrapped by the gateway
        if "AlreadyExists" in str(e) or "already exists" in str(e):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def _content(spark: SparkSession, path: str) -> str:
    fs, at = _at(spark, path)
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _taken(spark: SparkSession, folder: str, scope: str, token: int) -> int:
    text = _content(spark, f"{folder}/{scope}/{token}").split("\n")
    # a file without its time was just created by a writer that has not written it yet
    return int(text[1]) if len(text) == 2 and text[1].isdigit() else int(time.time() * 1000)


def release(spark: SparkSession, lease: Lease) -> None:
    _create(spark, f"{lease.folder}/{lease.scope}/{lease.token}.released", lease.owner)


def holds(spark: SparkSession, lease: Lease) -> bool:
    """Whether no later token exists: a writer that was taken over must not commit, however long it slept."""
    return _tokens(spark, lease.folder, lease.scope)[-1][0] == lease.token


# --- commits by manifest -----------------------------------------------------------------------------------------


class Fenced(RuntimeError):
    """The lease's scope has been taken over."""


def latest(spark: SparkSession, path: str) -> int:
    """The last committed version, 0 for none."""
    fs, at = _at(spark, f"{path}/versions")
    return max((int(f.getPath().getName()) for f in fs.listStatus(at) if f.getPath().getName().isdigit()), default=0) if fs.exists(at) else 0


def manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(part, digest, folder) of a version: which folder holds the content of each part. No version, no rows."""
    at = latest(spark, path) if version is None else version
    if not at:
        return spark.createDataFrame([], "part string, digest string, folder string")
    return spark.read.schema("part string, digest string, folder string").parquet(_content(spark, f"{path}/versions/{at}"))


def part_digests(df: DataFrame, part: str) -> DataFrame:
    """(part, digest) of each part's rows in any order, repeats counted; sums are taken in each task before they move."""
    rest = sorted(df.columns)
    marks = df.select(F.col(part).cast("string").alias("part"), *[F.conv(F.substring(F.sha2(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}), 256), a, 8), 16, 10).cast("long").alias(f"m{a}") for a in (1, 9, 17, 25)])
    sums = marks.groupBy("part").agg(F.count("*").alias("n"), *[F.sum(f"m{a}").alias(f"m{a}") for a in (1, 9, 17, 25)])
    return sums.select("part", F.sha2(F.concat_ws("-", "n", "m1", "m9", "m17", "m25"), 256).alias("digest"))


def commit(df: DataFrame, path: str, part: str, lease: Lease | None = None, stop_before: str | None = None) -> DataFrame:
    """Makes ``df`` the table's next version and returns (part, change: written | kept | removed).

    Parts whose content is that of the version before are not written again; the others go to a new folder by digest. Then
    the manifest is written, and last one file, which only one writer can create, names it: until then readers see the old
    version, and a crash at any step leaves that. Of two commits on one version the later one fails, as does one whose lease
    was taken over. ``stop_before`` (``manifest``, ``version``) ends there, as a crash would. An empty ``df`` is a version
    without parts. Null parts are one part.
    """
    spark = df.sparkSession
    before = latest(spark, path)
    old = manifest(spark, path, before) if before else manifest(spark, path)
    own = uuid.uuid4().hex
    fresh = part_digests(df, part).select("part", "digest")
    same = [F.col("f.part").eqNullSafe(F.col("o.part")), F.col("f.digest") == F.col("o.digest")]
    folder = f"{path}/data/{own}"
    planned = fresh.alias("f").join(old.alias("o"), same, "left").select("f.part", "f.digest", F.coalesce("o.folder", F.lit(folder)).alias("folder"), F.col("o.part").isNull() & F.col("o.folder").isNull())
    planned = planned.toDF("part", "digest", "folder", "new")
    planned.write.parquet(f"{path}/plans/{own}")  # read again below: the digests are taken once
    planned = spark.read.schema("part string, digest string, folder string, new boolean").parquet(f"{path}/plans/{own}")
    new = planned.where("new").select(F.col("part").alias("__part"), F.col("digest").alias("__digest"))
    df.join(new, F.col(part).cast("string").eqNullSafe(F.col("__part"))).drop("__part").write.partitionBy("__digest").parquet(folder)
    if stop_before == "manifest":
        return planned
    planned.select("part", "digest", "folder").write.parquet(f"{path}/manifests/{own}")
    if stop_before == "version":
        return planned
    if lease is not None and not holds(spark, lease):
        raise Fenced(f"{lease.scope} has a later writer than {lease.owner}")
    if not _create(spark, f"{path}/versions/{before + 1}", f"{path}/manifests/{own}"):
        raise FileExistsError(f"version {before + 1} was committed by another writer")
    x = planned.alias("p").join(old.alias("o"), F.col("p.part").eqNullSafe(F.col("o.part")), "full_outer")
    change = F.when(F.col("p.digest").isNull(), "removed").when(F.col("p.new"), "written").otherwise("kept")
    return x.select(F.coalesce("p.part", "o.part").alias("part"), change.alias("change"))


def read_version(spark: SparkSession, path: str, schema: str, version: int | None = None) -> DataFrame:
    """The rows of a version; folders that no part of it lies in are not listed."""
    parts = manifest(spark, path, version)
    folders = [r.folder for r in parts.select("folder").distinct().collect()]  # one for each commit that still counts
    if not folders:
        return spark.createDataFrame([], schema)
    found = None
    for f in folders:
        own = spark.read.schema(f"{schema}, __digest string").parquet(f).join(F.broadcast(parts.where(F.col("folder") == f).select(F.col("digest").alias("__digest")).distinct()), "__digest", "left_semi").drop("__digest")
        found = own if found is None else found.unionByName(own)
    return found


# --- a keyed store with versions and indexes ---------------------------------------------------------------------


def migrated(rows: DataFrame, steps: list[Callable[[DataFrame], DataFrame]], version: str = "schema_version") -> DataFrame:
    """Rows of all schema versions as the newest: those of version i pass ``steps[i]`` and all later ones. Null versions are 0."""
    out = None
    old = F.coalesce(F.col(version), F.lit(0))
    for i, step in enumerate(steps):
        own = rows.where(old == i)
        out = step(own if out is None else out.unionByName(own, allowMissingColumns=True))
    newest = rows.where(old >= len(steps))
    out = newest if out is None else out.unionByName(newest, allowMissingColumns=True)
    return out.withColumn(version, F.lit(len(steps)))


def repeated_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that stand in more than one row."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def index(rows: DataFrame, by: str, keys: list[str], path: str, buckets: int = 16) -> DataFrame:
    """A table of (``by``, primary ``keys``) in files by a hash of ``by``, so that a look-up of one value reads one bucket of them."""
    spark = rows.sparkSession
    name = "mnemos_index_" + uuid.uuid4().hex
    rows.select(by, *keys).write.bucketBy(buckets, by).sortBy(by).option("path", path).saveAsTable(name)
    return spark.table(name)
