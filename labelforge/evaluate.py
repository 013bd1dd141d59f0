"""Command line: score a table of model outputs against labels and write the
evaluation files.

    python -m labelforge.evaluate --scores scores.parquet --labels_file labels/ --save_dir out/ \
        [--key row_id] [--threshold 0.5]

``scores`` holds ``key``, ``logits`` (array<double>) and ``label``. A list
label means multi-label: metrics.json gets micro/macro F1, precision, recall
and the combined score, predict_metrics.csv the per-label f1/precision/recall
rows, predict_results.txt the ``index<TAB>prediction`` lines. A single label
means single-label: accuracy, and the argmax class name per row.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelforge.functions.labels import argmax, decode_class, decode_multi_hot, python_list_text
from labelforge.functions.labels import threshold_scores
from labelforge.operators import metrics as M
from labelforge.operators.positions import with_row_index
from labelforge.session import command_session
from labelforge.sources import files as IO


def evaluate(scores: DataFrame, label_names: list[str], save_dir: str, key: str = "row_id",
             threshold: float = 0.5) -> dict[str, str]:
    out = {"metrics": f"{save_dir}/metrics.json", "predictions": f"{save_dir}/predict_results.txt"}
    if M.is_multi_label(scores):
        counts = M.confusion_counts(M.with_predictions(scores, "logits", threshold), len(label_names))
        samples = scores.agg(F.count(F.lit(1)).alias("n")).scalar()
        IO.write_metrics_json(M.summary(counts).withColumn("eval_samples", samples), out["metrics"])
        out["per_label"] = f"{save_dir}/predict_metrics.csv"
        IO.write_csv(IO.metric_matrix(M.per_label(counts), label_names), out["per_label"])
        text = python_list_text(decode_multi_hot(threshold_scores(F.col("logits"), threshold), label_names))
    else:
        IO.write_metrics_json(M.accuracy(scores, argmax(F.col("logits")), F.col("label")), out["metrics"])
        text = decode_class(argmax(F.col("logits")), label_names)
    preds = with_row_index(scores.select(key, text.alias("prediction")), [key], "index")
    IO.write_predictions(preds, out["predictions"])
    return out


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    ap.add_argument("--scores", required=True)
    ap.add_argument("--labels_file", required=True, help="label manifest (one name per line, in order)")
    ap.add_argument("--save_dir", required=True)
    ap.add_argument("--work_dir", help="shared folder for intermediate tables (else spark.checkpoint.dir)")
    ap.add_argument("--key", default="row_id")
    ap.add_argument("--threshold", type=float, default=0.5)
    args = ap.parse_args(argv)
    spark = command_session("labelforge-evaluate", args.work_dir)
    names = [r.label_name for r in IO.read_label_manifest(spark, args.labels_file).orderBy("label_idx").collect()]
    for name, path in evaluate(spark.read.parquet(args.scores), names, args.save_dir, args.key,
                               args.threshold).items():
        print(f"{name}\t{path}")


if __name__ == "__main__":
    main()
