"""Stand-in tables over the test data, in Spark and as SQL text.

documents(doc_id, text, source) plays the abstracts (PMID, Abstract, Title);
labels(quality, toxic) plays the label columns; the split comes from the id.
Every stand-in reads the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelforge.functions.labels import split_of_key
from labelforge.schemas import TEST_SPEC

SPEC = TEST_SPEC
LABELS = SPEC.labels


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def abstracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("PMID"), F.col("source").alias("Title"),
        F.col("text").alias("Abstract"))


def binary_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = table(spark, sf_dir, "labels")
    return lab.select(
        F.col("doc_id").alias("PMID"),
        split_of_key(F.col("doc_id")).alias("Split"),
        (F.lit(1) + F.col("doc_id") % 3).cast("long").alias("Number of Annotators"),
        F.col("quality").cast("double").alias("quality"),
        F.col("toxic").cast("double").alias("toxic"))


def soft_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean label per source, given to every labelled document of the source.

    Per-source means are a partial aggregation (hot sources are combined
    map-side) of the narrow labelled rows, which are written once. The means
    are broadcast after their rows have been counted; a table of more than
    ``MAX_SOURCES`` sources is joined with the rows salted instead.
    """
    lab = binary_labels(spark, sf_dir)
    src = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("PMID"), "source")
    path = landed(spark, sf_dir, "labelled-sources", lambda: _written(lab.join(src, "PMID"), "labelled-sources"))
    tagged = spark.read.parquet(path)
    means = tagged.groupBy("source").agg(*[F.avg(c).alias(c) for c in LABELS])
    rows = tagged.select("PMID", "Split", "Number of Annotators", "source")
    if means.count() <= MAX_SOURCES:
        return rows.join(F.broadcast(means), "source").drop("source")
    salted = means.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (rows.withColumn("salt", F.pmod(F.xxhash64("PMID"), F.lit(SALTS)).cast("int"))
            .join(salted, ["source", "salt"]).drop("source", "salt"))


MAX_SOURCES, SALTS = 100_000, 64


def _written(df: DataFrame, name: str) -> str:
    from labelforge.session import work_path
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return path


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows with deterministic model scores (logits) derived from the
    document length, so the SQL oracle can repeat them. Score 0.5 occurs."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    lab = table(spark, sf_dir, "labels")
    return docs.join(lab, "doc_id").select(
        F.col("doc_id").alias("row_id"),
        split_of_key(F.col("doc_id")).alias("Split"),
        F.array((F.col("n_chars") % 11) / 10.0, (F.col("n_chars") % 7) / 6.0).alias("logits"),
        F.array(F.col("quality").cast("double"), F.col("toxic").cast("double")).alias("label"))


# SQL text of the same stand-ins ------------------------------------------------
SPLIT_SQL = ("CASE WHEN doc_id % 10 < 8 THEN 'Train' WHEN doc_id % 10 = 8 "
             "THEN 'Validation' ELSE 'Test' END")

ABSTRACTS_SQL = "SELECT doc_id AS PMID, source AS Title, text AS Abstract FROM documents"

BINARY_SQL = (f"SELECT doc_id AS PMID, {SPLIT_SQL} AS Split, "
              "CAST(1 + doc_id % 3 AS BIGINT) AS \"Number of Annotators\", "
              "CAST(quality AS DOUBLE) AS quality, CAST(toxic AS DOUBLE) AS toxic FROM labels")

SOFT_SQL = (f"SELECT b.PMID, b.Split, b.\"Number of Annotators\", "
            "avg(b.quality) OVER (PARTITION BY d.source) AS quality, "
            "avg(b.toxic) OVER (PARTITION BY d.source) AS toxic "
            f"FROM ({BINARY_SQL}) b JOIN documents d ON d.doc_id = b.PMID")

SCORED_SQL = (f"SELECT d.doc_id AS row_id, {SPLIT_SQL.replace('doc_id', 'd.doc_id')} AS Split, "
              "[(d.n_chars % 11)::DOUBLE / 10, (d.n_chars % 7)::DOUBLE / 6] AS logits, "
              "[CAST(l.quality AS DOUBLE), CAST(l.toxic AS DOUBLE)] AS label "
              "FROM documents d JOIN labels l ON l.doc_id = d.doc_id")

MERGED_SQL = (f"SELECT a.PMID, a.Title, a.Abstract, b.Split, b.\"Number of Annotators\", "
              "b.quality, b.toxic, [b.quality, b.toxic] AS label "
              f"FROM ({ABSTRACTS_SQL}) a JOIN ({BINARY_SQL}) b ON a.PMID = b.PMID")

SOFT_MERGED_SQL = (f"SELECT a.PMID, a.Title, a.Abstract, s.Split, s.\"Number of Annotators\", "
                   "s.quality, s.toxic, [s.quality, s.toxic] AS label "
                   f"FROM ({ABSTRACTS_SQL}) a JOIN ({SOFT_SQL}) s ON a.PMID = s.PMID")

BINARY_DATASET_SQL = (f"SELECT *, lower(Split) AS split_name, "
                      "row_number() OVER (ORDER BY PMID) - 1 AS __index_level_0__ "
                      f"FROM ({MERGED_SQL}) m")


def hypotheses_sql() -> str:
    rows = []
    for h in SPEC.hypotheses:
        rows.append(f"({h.label_idx}, true, '{h.positive}')")
        rows.append(f"({h.label_idx}, false, '{h.negative}')")
    return "(VALUES " + ", ".join(rows) + ") AS h(Label_idx, Positive, Hypothesis)"


NLI_SQL = ("SELECT m.PMID, m.Title, m.Abstract, h.Hypothesis, "
           "CASE WHEN h.Positive THEN m.label[h.Label_idx + 1] "
           "WHEN m.label[h.Label_idx + 1] IS NULL OR isnan(m.label[h.Label_idx + 1]) THEN 0.0 "
           "WHEN m.label[h.Label_idx + 1] = 0 THEN 1.0 ELSE 0.0 END AS Entailment, "
           "h.Positive, CAST(h.Label_idx AS BIGINT) AS Label_idx, lower(m.Split) AS split_name "
           f"FROM ({MERGED_SQL}) m, {hypotheses_sql()} "
           "WHERE m.Split IN ('Train', 'Validation', 'Test')")


# Landed fixtures (log trees, response bodies) are deterministic: land each once per shared folder and input, then
# reuse it. The input counts as the same while its files have the same names, sizes and times.
_LANDED: dict[tuple, str] = {}


def _files_of(spark: SparkSession, folder: str) -> tuple:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    listed = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    out = []
    while listed.hasNext():
        f = listed.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def landed(spark: SparkSession, sf_dir: str, name: str, build) -> str:
    from labelforge.session import shared_dir
    key = (shared_dir(spark), sf_dir, name, _files_of(spark, sf_dir))
    if key not in _LANDED:
        _LANDED[key] = build()
    return _LANDED[key]
