"""Command line: pick the best trial per model from a search's result logs
and write one JSON per model (the configuration to train with).

    python -m labelforge.select --results_dir tune_results/ --save_dir hyperparameters/ \
        [--metric objective] [--mode max] [--skip_dir checkpoint_tmp]

Every ``result.json`` under ``results_dir`` (any depth) is read in one scan;
the model is the first directory level below ``results_dir``. Ties go to the
newest timestamp, then the larger trial id; a missing metric never wins.
"""

from __future__ import annotations

import argparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelforge.operators.trials import best_trial, read_trial_results
from labelforge.schemas import TRIAL_RESULT_SCHEMA
from labelforge.session import command_session


def model_below(spark: SparkSession, root: str, path: Column) -> Column:
    """The first directory level below ``root`` in the (url-encoded) file path;
    a file that lies in no such directory is an error."""
    target = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    resolved = files.makeQualified(target).toUri().getPath().rstrip("/") + "/"
    # file:///x, file:/x and hdfs://host/x all end in the path proper
    proper = F.url_decode(F.replace(F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), F.lit("+"), F.lit("%2B")))
    below = F.substring_index(F.substring(proper, len(resolved) + 1, 1 << 20), "/", 1)
    inside = F.startswith(proper, F.lit(resolved)) & F.contains(F.substring(proper, len(resolved) + 1, 1 << 20), F.lit("/"))
    return F.when(inside & (below != ""), below).otherwise(
        F.raise_error(F.concat(F.lit("no model directory in the path of "), path)))


def select_best(spark: SparkSession, results_dir: str, metric: str = "objective", mode: str = "max",
                skip_dir: str | None = None, file_glob: str = "result.json") -> DataFrame:
    df = read_trial_results(spark, results_dir, TRIAL_RESULT_SCHEMA, file_glob, skip_dir)
    df = df.withColumn("model", model_below(spark, results_dir, F.col("_lf_path"))).drop("_lf_path")
    keep = [c for c in df.columns if c not in ("model", metric)]
    return best_trial(df, "model", metric, keep, mode)


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    ap.add_argument("--results_dir", required=True)
    ap.add_argument("--save_dir", required=True)
    ap.add_argument("--work_dir", help="shared folder for intermediate tables (else spark.checkpoint.dir)")
    ap.add_argument("--metric", default="objective")
    ap.add_argument("--mode", default="max", choices=["max", "min"])
    ap.add_argument("--skip_dir", default=None)
    args = ap.parse_args(argv)
    spark = command_session("labelforge-select", args.work_dir)
    best = select_best(spark, args.results_dir, args.metric, args.mode, args.skip_dir)
    # one row per model: one small JSON file per model directory
    best.repartition("model").write.mode("overwrite").partitionBy("model").json(args.save_dir)
    print(args.save_dir)


if __name__ == "__main__":
    main()
