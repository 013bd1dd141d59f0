"""Command line: fit the multi-label text classifier on a dataset's train
split and evaluate it on validation (or test when there is none) and test.

    python -m labelforge.train --dataset out/labelled/dataset=binary --labels_file out/labels \
        --save_dir run/ [--text_columns Title,Abstract] [--max_iter 20]

Scores are written per split (``scores_<split>/``: PMID, logits = P(label),
label); each evaluated split gets the files of ``labelforge.evaluate``.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from labelforge.evaluate import evaluate
from labelforge.operators.models import fit_text_classifier
from labelforge.operators.prepare import SPLIT_NAME, concat_text_columns, eval_split_name
from labelforge.session import command_session
from labelforge.sources import files as IO


def train_and_evaluate(spark: SparkSession, dataset: str, label_names: list[str], save_dir: str,
                       text_columns: list[str], key: str = "PMID", max_iter: int = 20) -> dict[str, str]:
    data = concat_text_columns(IO.read_dataset(spark, dataset), text_columns, " ", "sentence")
    present = {r[0] for r in data.select(SPLIT_NAME).distinct().collect()}   # split names only
    model = fit_text_classifier(data.filter(F.col(SPLIT_NAME) == "train"), "sentence", "label",
                                len(label_names), max_iter=max_iter)
    out = {}
    for split in dict.fromkeys([eval_split_name(present), "test"]):
        if split not in present:
            continue
        scored = model.scores(data.filter(F.col(SPLIT_NAME) == split)).select(
            key, F.col("scores").alias("logits"), "label")
        path = f"{save_dir}/scores_{split}"
        scored.write.mode("overwrite").parquet(path)          # lineage cut: evaluate reads the table
        out[f"scores_{split}"] = path
        for name, p in evaluate(spark.read.parquet(path), label_names, f"{save_dir}/{split}", key).items():
            out[f"{split}_{name}"] = p
    return out


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    ap.add_argument("--dataset", required=True)
    ap.add_argument("--labels_file", required=True)
    ap.add_argument("--save_dir", required=True)
    ap.add_argument("--work_dir", help="shared folder for intermediate tables (else spark.checkpoint.dir)")
    ap.add_argument("--text_columns", default="Abstract")
    ap.add_argument("--max_iter", type=int, default=20)
    args = ap.parse_args(argv)
    spark = command_session("labelforge-train", args.work_dir)
    names = [r.label_name for r in IO.read_label_manifest(spark, args.labels_file).orderBy("label_idx").collect()]
    for name, path in train_and_evaluate(spark, args.dataset, names, args.save_dir,
                                         args.text_columns.split(","), max_iter=args.max_iter).items():
        print(f"{name}\t{path}")


if __name__ == "__main__":
    main()
