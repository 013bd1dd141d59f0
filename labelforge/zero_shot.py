"""Command line: zero-shot entailment scoring of an NLI dataset.

    python -m labelforge.zero_shot --dataset out/nli_dataset --save_dir zs/ [--split test]

Every premise/hypothesis pair of the split is scored by the built-in overlap
scorer on its own texts, entailment = argmax of [1 - s, s]; writes the pair
scores, the binary F1 / precision / recall of entailment and the per-label
decisions (positive vs. negative hypothesis) of each abstract: several abstracts
of one id are told apart by ``premise``, a hash of the text.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelforge.operators import metrics as M
from labelforge.operators.models import nli_collapse, zero_shot_scores

from labelforge.session import command_session
from labelforge.sources import files as IO


def score_pairs(nli: DataFrame) -> DataFrame:
    """Pair scores, each of the pair's own texts, and the ``premise`` that it belongs to. No text is shuffled."""
    return zero_shot_scores(nli.withColumn("premise", F.xxhash64("Abstract")), keep=["premise"])


def run(spark: SparkSession, dataset: str, save_dir: str, split: str = "test") -> dict[str, str]:
    nli = IO.read_dataset(spark, dataset, split)
    scores_path = f"{save_dir}/pair_scores"
    score_pairs(nli).write.mode("overwrite").parquet(scores_path)
    scored = spark.read.parquet(scores_path)
    metrics = M.binary_metrics(scored, F.col("pred"), F.col("label"))
    IO.write_metrics_json(metrics, f"{save_dir}/metrics.json")
    nli_collapse(scored).write.mode("overwrite").parquet(f"{save_dir}/decisions")
    return {"pair_scores": scores_path, "metrics": f"{save_dir}/metrics.json",
            "decisions": f"{save_dir}/decisions"}


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    ap.add_argument("--dataset", required=True)
    ap.add_argument("--save_dir", required=True)
    ap.add_argument("--work_dir", help="shared folder for intermediate tables (else spark.checkpoint.dir)")
    ap.add_argument("--split", default="test")
    args = ap.parse_args(argv)
    spark = command_session("labelforge-zero-shot", args.work_dir)
    for name, path in run(spark, args.dataset, args.save_dir, args.split).items():
        print(f"{name}\t{path}")


if __name__ == "__main__":
    main()
