"""Proof queries: sources and sinks (S1-S3, S9-S14) as write → read round trips
under the session's shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelforge.functions import labels as L
from labelforge.operators import metrics as M
from labelforge.operators import prepare as prep
from labelforge.operators.positions import with_row_index
from labelforge.plans import standins as S
from labelforge.plans.metrics_proofs import NAMES_SQL, PER_LABEL_SQL, PRED_SQL, C
from labelforge.plans.registry import proof
from labelforge.schemas import ABSTRACT_SCHEMA
from labelforge.session import work_path
from labelforge.sources import files as IO


@proof("src_csv_roundtrip", S.ABSTRACTS_SQL)
def src_csv_roundtrip(spark, d):
    path = work_path(spark, "abstracts-csv")
    IO.write_csv(S.abstracts(spark, d), path)
    return IO.read_csv_table(spark, path, ABSTRACT_SCHEMA)


@proof("sink_csv", "SELECT doc_id, lang, source, n_chars, text FROM documents")
def sink_csv(spark, d):
    docs = S.table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars", "text")
    path = work_path(spark, "documents-csv")
    IO.write_csv(docs, path)
    return IO.read_csv_table(spark, path, docs.schema)


def _binary(spark, d):
    return prep.build_binary(S.abstracts(spark, d), S.binary_labels(spark, d), S.SPEC,
                             with_index=False)


BINARY_ROWS_SQL = ("SELECT PMID, Split, quality, toxic, label, lower(Split) AS split_name "
                   f"FROM ({S.MERGED_SQL}) m WHERE Split IN ('Train', 'Validation', 'Test')")


@proof("sink_parquet_splits", BINARY_ROWS_SQL)
def sink_parquet_splits(spark, d):
    path = work_path(spark, "binary-dataset")
    IO.write_splits(_binary(spark, d).select("PMID", "Split", "quality", "toxic", "label",
                                             "split_name"), path)
    return IO.read_dataset(spark, path).select("PMID", "Split", "quality", "toxic", "label",
                                               "split_name")


@proof("src_parquet_splits",
       "SELECT PMID, label FROM (" + BINARY_ROWS_SQL + ") b WHERE split_name = 'validation'")
def src_parquet_splits(spark, d):
    path = work_path(spark, "binary-dataset")
    IO.write_splits(_binary(spark, d).select("PMID", "label", "split_name"), path)
    return IO.read_dataset(spark, path, "validation").select("PMID", "label")


@proof("src_split_files", BINARY_ROWS_SQL)
def src_split_files(spark, d):
    cols = ["PMID", "Split", "quality", "toxic", "label"]
    b = _binary(spark, d)
    root = work_path(spark, "split-files")
    files = {}
    for split in ("train", "validation", "test"):
        files[split] = f"{root}/{split}.json"
        b.filter(F.col("split_name") == split).select(*cols).write.mode("overwrite").json(files[split])
    schema = b.select(*cols).schema
    return IO.read_split_files(spark, files, schema)


@proof("sink_predictions_tsv",
       "SELECT row_number() OVER (ORDER BY row_id) - 1 AS \"index\", "
       "'[' || array_to_string(list_transform(names, lambda x: '''' || x || ''''), ', ') || ']' "
       f"AS prediction FROM (SELECT row_id, {NAMES_SQL} AS names FROM (SELECT row_id, {PRED_SQL} AS p "
       f"FROM ({S.SCORED_SQL}) s) q) r")
def sink_predictions_tsv(spark, d):
    sc = S.scored(spark, d)
    pred = L.threshold_scores(F.col("logits"))
    text = L.python_list_text(L.decode_multi_hot(pred, S.LABELS))
    out = with_row_index(sc.select("row_id", text.alias("prediction")), ["row_id"], "index")
    path = work_path(spark, "predictions-tsv")
    IO.write_predictions(out, path)
    return IO.read_predictions(spark, path)


@proof("sink_metric_matrix",
       "SELECT metric, max(CASE WHEN label_idx = 0 THEN round(value, 6) END) AS quality, "
       "max(CASE WHEN label_idx = 1 THEN round(value, 6) END) AS toxic FROM ("
       f"SELECT label_idx, 'f1' AS metric, f1 AS value FROM ({PER_LABEL_SQL}) a UNION ALL "
       f"SELECT label_idx, 'precision', precision FROM ({PER_LABEL_SQL}) b UNION ALL "
       f"SELECT label_idx, 'recall', recall FROM ({PER_LABEL_SQL}) c) u GROUP BY metric")
def sink_metric_matrix(spark, d):
    counts = M.confusion_counts(M.with_predictions(S.scored(spark, d)), C)
    matrix = IO.metric_matrix(M.per_label(counts), S.LABELS)
    matrix = matrix.select("metric", *[F.round(L.qcol(n), 6).alias(n) for n in S.LABELS])
    path = work_path(spark, "metric-matrix")
    IO.write_csv(matrix, path)
    schema = T.StructType([T.StructField("metric", T.StringType())]
                          + [T.StructField(n, T.DoubleType()) for n in S.LABELS])
    return IO.read_csv_table(spark, path, schema)


@proof("sink_label_manifest",
       "SELECT CAST(i - 1 AS BIGINT) AS label_idx, name AS label_name "
       "FROM (SELECT unnest(['quality', 'toxic']) AS name, "
       "generate_subscripts(['quality', 'toxic'], 1) AS i) t")
def sink_label_manifest(spark, d):
    merged = prep.join_labels(S.abstracts(spark, d), S.binary_labels(spark, d))
    names = prep.label_columns_by_position(merged.columns, 5)
    path = work_path(spark, "labels-manifest")
    IO.write_label_manifest(prep.label_dictionary_from(merged, names), path)
    return IO.read_label_manifest(spark, path)


@proof("sink_metrics_json",
       "SELECT count(*) FILTER (WHERE Split = 'Train') AS train_samples, "
       "count(*) FILTER (WHERE Split = 'Validation') AS eval_samples "
       f"FROM ({S.MERGED_SQL}) m")
def sink_metrics_json(spark, d):
    b = _binary(spark, d)
    counts = b.agg(F.sum((F.col("split_name") == "train").cast("long")).alias("train_samples"),
                   F.sum((F.col("split_name") == "validation").cast("long")).alias("eval_samples"))
    path = work_path(spark, "metrics-json")
    IO.write_metrics_json(counts, path)
    return spark.read.schema(counts.schema).json(path)
