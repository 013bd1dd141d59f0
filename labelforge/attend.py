"""Command line: label attention from embeddings to evaluation files.

    python -m labelforge.attend --embeddings emb/ --labels_file labels/ --save_dir out/ \
        [--key vec_id] [--vector embedding] [--label label] [--kind cosine|linear|attended] \
        [--train train] [--split test] [--threshold 0.5]

``embeddings`` is a dataset partitioned by ``split_name`` with a key, a vector and
a label: a class number, or an array of 0/1 in manifest order. The label vectors
are the mean vectors of the training rows of each label; every row of ``split`` is
scored against all of them (one matrix product a batch). Writes the scores, the
label vectors and the files of ``labelforge.evaluate``.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from labelforge.evaluate import evaluate
from labelforge.operators import metrics as M
from labelforge.operators import vectors as V
from labelforge.session import command_session
from labelforge.sources import files as IO


def run(spark: SparkSession, embeddings: str, label_names: list[str], save_dir: str, key: str = "vec_id", vector: str = "embedding",
        label: str = "label", kind: str = "cosine", train: str = "train", split: str = "test", threshold: float = 0.5) -> dict[str, str]:
    if kind not in ("cosine", "linear", "attended"):
        raise ValueError(f"unknown kind {kind!r}; one of cosine, linear, attended")
    fit = IO.read_dataset(spark, embeddings, train).select(F.col(vector).alias("vec"), F.col(label).alias("label"))
    if M.is_multi_label(fit, "label"):
        long = fit.select("vec", F.posexplode("label").alias("label_idx", "has"))
        fit = long.filter(F.col("has") == 1).select("vec", F.col("label_idx").cast("long").alias("label_idx"))
    else:
        fit = fit.select("vec", F.col("label").cast("long").alias("label_idx"))
    paths = {"label_vectors": f"{save_dir}/label_vectors", "scores": f"{save_dir}/scores"}
    V.label_prototypes(fit, "vec", "label_idx", V.vector_dim(fit, "vec")).write.mode("overwrite").parquet(paths["label_vectors"])
    made = spark.read.parquet(paths["label_vectors"])
    known = sorted(r.label_idx for r in made.select("label_idx").collect())                    # a row a label
    if known != list(range(len(label_names))):
        raise ValueError(f"training rows give vectors for the labels {known}; the manifest has {len(label_names)}: every label needs one")
    held = IO.read_dataset(spark, embeddings, split)
    scored = held.select(key, V.LabelMatrix(made).scores(F.col(vector), kind).alias("logits"), F.col(label).alias("label"))
    scored.write.mode("overwrite").parquet(paths["scores"])
    return paths | evaluate(spark.read.parquet(paths["scores"]), label_names, save_dir, key, threshold)


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("embeddings", "labels_file", "save_dir"):
        ap.add_argument(f"--{name}", required=True)
    ap.add_argument("--work_dir", help="shared folder for intermediate tables (else spark.checkpoint.dir)")
    for name, value in (("key", "vec_id"), ("vector", "embedding"), ("label", "label"), ("kind", "cosine"), ("train", "train"), ("split", "test")):
        ap.add_argument(f"--{name}", default=value)
    ap.add_argument("--threshold", type=float, default=0.5)
    args = ap.parse_args(argv)
    spark = command_session("labelforge-attend", args.work_dir)
    names = [r.label_name for r in IO.read_label_manifest(spark, args.labels_file).orderBy("label_idx").collect()]
    for name, path in run(spark, args.embeddings, names, args.save_dir, args.key, args.vector, args.label, args.kind, args.train, args.split,
                          args.threshold).items():
        print(f"{name}\t{path}")


if __name__ == "__main__":
    main()
