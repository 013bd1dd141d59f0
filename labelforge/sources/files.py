"""Table sources and sinks: CSV, per-split files, split-partitioned datasets,
prediction and metric files, label manifests.

CSV follows RFC 4180 both ways (a quote inside a value is doubled), values may
span lines, and blanks at the ends of a value are kept.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CSV_OPTIONS = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"',
               "mode": "FAILFAST"}
CSV_WRITE_OPTIONS = {"header": "true", "quote": '"', "escape": '"',
                     "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


# S1 / S10 -------------------------------------------------------------------
def read_csv_table(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = True) -> DataFrame:
    """CSV with a header row and an explicit schema (no inference pass).

    ``multi_line`` is for values that span lines; such a file is one task. Turn
    it off for tables without free text, which are then read in splits.
    """
    return spark.read.schema(schema).options(**CSV_OPTIONS | {"multiLine": str(multi_line).lower()}).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.write.mode(mode).options(**CSV_WRITE_OPTIONS).csv(path)
    return path


# S2 / S9 --------------------------------------------------------------------
def write_splits(df: DataFrame, path: str, split_col: str = "split_name",
                 mode: str = "overwrite") -> str:
    """One directory per split (``split_name=train`` …), Parquet inside."""
    df.write.mode(mode).partitionBy(split_col).parquet(path)
    return path


def read_dataset(spark: SparkSession, path: str, split: str | None = None,
                 split_col: str = "split_name") -> DataFrame:
    """A split-partitioned dataset; asking for one split prunes the others
    at listing time (partition filter)."""
    df = spark.read.parquet(path)
    return df if split is None else df.filter(F.col(split_col) == split)


# S3 -------------------------------------------------------------------------
FORMATS = {"csv": "csv", "json": "json", "jsonl": "json", "parquet": "parquet"}


def _extension(path: str) -> str:
    ext = os.path.splitext(path.rstrip("/"))[1].lstrip(".").lower()
    if ext not in FORMATS:
        raise ValueError(f"unsupported file type {ext!r} for {path}")
    return ext


def check_split_files(files: dict[str, str]) -> str:
    """Train and validation must share an extension; test must match train."""
    if "train" not in files:
        raise ValueError("a train file is required")
    ext = _extension(files["train"])
    for split in ("validation", "test"):
        if split in files and FORMATS[_extension(files[split])] != FORMATS[ext]:
            raise ValueError(f"the {split} file is no {ext} file, but the train file is")
    return FORMATS[ext]


def read_split_files(spark: SparkSession, files: dict[str, str],
                     schema: T.StructType, split_col: str = "split_name", multi_line: bool = True) -> DataFrame:
    """Each split's file read in its format and tagged; one DataFrame. CSV with
    ``multi_line`` off is read in splits (see ``read_csv_table``)."""
    fmt = check_split_files(files)
    out = None
    for split, path in files.items():
        reader = spark.read.schema(schema)
        if fmt == "csv":
            reader = reader.options(**CSV_OPTIONS | {"multiLine": str(multi_line).lower()})
        part = reader.format(fmt).load(path).withColumn(split_col, F.lit(split))
        out = part if out is None else out.unionByName(part)
    return out


# S11 ------------------------------------------------------------------------
PREDICTION_SCHEMA = T.StructType([T.StructField("index", T.LongType()),
                                  T.StructField("prediction", T.StringType())])


def write_predictions(df: DataFrame, path: str) -> str:
    """``index<TAB>prediction`` with a header line."""
    (df.select("index", "prediction").write.mode("overwrite")
       .option("sep", "\t").option("header", "true").option("quote", '"')
       .option("escape", '"').csv(path))
    return path


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.schema(PREDICTION_SCHEMA).option("sep", "\t")
                 .option("header", "true").option("escape", '"').csv(path))


# S12 ------------------------------------------------------------------------
def metric_matrix(per_label: DataFrame, label_names: list[str]) -> DataFrame:
    """Rows f1 / precision / recall, one column per label (vector order).

    ``per_label`` is the C-row output of the per-label metrics; the pivot
    values are given, so no distinct pass runs first.
    """
    names = F.element_at(F.array(*[F.lit(n) for n in label_names]),
                         F.col("label_idx").cast("int") + 1)
    long = per_label.select(names.alias("label_name"), F.inline(F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"))
          for m in ("f1", "precision", "recall")])))
    return long.groupBy("metric").pivot("label_name", label_names).agg(F.first("value"))


# S13 ------------------------------------------------------------------------
def write_label_manifest(dictionary: DataFrame, path: str) -> str:
    """Label names one per line in vector order, one file. ``dictionary`` is
    the C-row (label_idx, label_name) table, so one task writes C lines."""
    (dictionary.select("label_idx", "label_name").coalesce(1)
               .sortWithinPartitions("label_idx").select("label_name")
               .write.mode("overwrite").text(path))
    return path


def read_label_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(label_idx, label_name): line order inside the single file."""
    lines = spark.read.text(path, wholetext=True)
    return lines.select(F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n"))
                        .alias("label_idx", "label_name")).select(
        F.col("label_idx").cast("long"), "label_name")


# S14 ------------------------------------------------------------------------
def write_metrics_json(metrics: DataFrame, path: str) -> str:
    metrics.coalesce(1).write.mode("overwrite").json(path)
    return path
