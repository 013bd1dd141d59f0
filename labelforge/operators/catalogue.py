"""Incremental catalogue of many small log files (S4, S5, S7, T2).

A search leaves a file a trial; scanning the tree again for every question is
mostly listing and opening files. The catalogue reads each file once:

* ``files``: one row a file that was read (path, size, modification time), by batch;
* ``rows``: their rows as Parquet, with the file's path, packed many files to a
  task and partitioned by batch.

A refresh lists the tree (metadata only, no file is opened), reads the files that
are new or have changed since, and adds one batch. The rows are written before the
files are listed as read, so a refresh that dies is repeated as a whole; queries
read the batches that are listed, and of a file that was read again the newest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Paths that one scan is given; bytes that a task packs, and what opening a file counts for.
SCAN_FILES, PACK_BYTES, OPEN_BYTES = 20_000, 64 << 20, 64 << 10
FILES = "path string, uri string, size long, modified long"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def list_files(spark: SparkSession, root: str, file_glob: str, skip_dir: str | None = None) -> DataFrame:
    """``path, uri, size, modified`` of every file under ``root``; no file is opened. ``uri``: the path as rows carry it, encoded."""
    found = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", file_glob).load(root)
             .select("path", F.col("_metadata.file_path").alias("uri"), F.col("length").alias("size"),
                     F.unix_millis("modificationTime").alias("modified")))
    return found.filter(~F.contains("path", F.lit(f"/{skip_dir}/"))) if skip_dir else found


def seen_files(spark: SparkSession, catalogue: str) -> DataFrame:
    """``path, uri, size, modified, batch`` of what was read, the newest reading of each path."""
    if not _exists(spark, f"{catalogue}/files"):
        return spark.createDataFrame([], f"{FILES}, batch long")
    every = spark.read.schema(f"{FILES}, batch long").parquet(f"{catalogue}/files")
    return every.groupBy("path").agg(F.max(F.struct("batch", "uri", "size", "modified")).alias("r")).select(
        "path", "r.uri", "r.size", "r.modified", "r.batch")


def refresh(spark: SparkSession, root: str, catalogue: str, read: Callable[[list[str]], DataFrame], file_glob: str = "*",
            skip_dir: str | None = None) -> int:
    """Read what is new under ``root`` and return the number of files read.

    ``read`` takes a list of paths and gives their rows, with the path of the file
    as ``_lf_path`` (see ``trials.read_trial_results``).
    """
    seen = seen_files(spark, catalogue).select("path", "size", "modified")
    fresh = list_files(spark, root, file_glob, skip_dir).join(seen, ["path", "size", "modified"], "left_anti").persist()
    try:
        total = fresh.agg(F.count(F.lit(1)), F.coalesce(F.max("modified"), F.lit(0))).first()[0]
        if not total:
            return 0
        batch = (seen_files(spark, catalogue).agg(F.max("batch")).first()[0] or 0) + 1
        # paths, a bounded number at a time: a scan is told which files to open
        parts = -(-total // SCAN_FILES)
        for part in range(parts):
            paths = [r.path for r in fresh.filter(F.pmod(F.xxhash64("path"), F.lit(parts)) == part).select("path").collect()]
            if paths:
                before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
                try:
                    spark.conf.set("spark.sql.files.maxPartitionBytes", str(PACK_BYTES))
                    spark.conf.set("spark.sql.files.openCostInBytes", str(OPEN_BYTES))
                    read(paths).write.mode("overwrite").parquet(f"{catalogue}/rows/batch={batch}/part={part}")
                finally:
                    for k, v in before.items():
                        spark.conf.set(k, v)
        fresh.select("path", "uri", "size", "modified").write.mode("overwrite").parquet(f"{catalogue}/files/batch={batch}")
        return total
    finally:
        fresh.unpersist()


def rows(spark: SparkSession, catalogue: str) -> DataFrame:
    """The rows of every file read, each file's newest reading, with ``_lf_path``."""
    every = spark.read.parquet(f"{catalogue}/rows").drop("part")
    files = seen_files(spark, catalogue)
    again = spark.read.schema(f"{FILES}, batch long").parquet(f"{catalogue}/files").groupBy("path").count().filter("count > 1")
    if again.isEmpty():
        # no file was read twice: the listed batches are all there is to check, and few
        listed = [r.batch for r in files.select("batch").distinct().collect()]
        return every.filter(F.col("batch").isin(listed)).drop("batch")
    newest = files.select(F.col("uri").alias("_lf_path"), "batch")
    return every.join(newest, ["_lf_path", "batch"], "left_semi").drop("batch")
