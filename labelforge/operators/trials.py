"""Trial analytics and model selection over hyper-parameter search logs.

Trial logs are many small files (a JSON line per result, a CSV per trial, a
JSON array per policy decision, a text file per failure); each is read in one
scan of the whole tree, with model and trial taken from the file path.
Per-group choices (best trial per model, newest row per iteration, lowest
loss per run) are ``max``/``min`` of a struct: a partial aggregation, so a
model or trial holding a third of the rows is combined map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelforge.operators.positions import running_max_and_lag
from labelforge.schemas import TRIAL_CONFIG_SCHEMA, TRIAL_METRICS


def path_part(name: str) -> Column:
    """Value of a ``name=value`` directory in the file path."""
    return F.regexp_extract(F.col("_metadata.file_path"), f"{name}=([^/]+)", 1)


# S4 / S5 --------------------------------------------------------------------
def read_trial_results(spark: SparkSession, root: str, schema: T.StructType,
                       file_glob: str = "*.json", skip_dir: str | None = None) -> DataFrame:
    """Every result file under ``root`` (any depth), one row per JSON line,
    minus files under a directory called ``skip_dir``."""
    df = (spark.read.schema(schema).option("recursiveFileLookup", "true")
               .option("pathGlobFilter", file_glob).json(root)
               .withColumn("_lf_path", F.col("_metadata.file_path")))
    if skip_dir:
        df = df.filter(~F.col("_lf_path").contains(f"/{skip_dir}/"))
    return df


def read_trial_files(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    """The rows of the given result files, with ``_lf_path`` (for ``catalogue.refresh``)."""
    return spark.read.schema(schema).json(paths).withColumn("_lf_path", F.col("_metadata.file_path"))


def read_trial_progress(spark: SparkSession, root: str, schema: T.StructType,
                        file_glob: str = "*.csv") -> DataFrame:
    return (spark.read.schema(schema).option("recursiveFileLookup", "true")
                 .option("pathGlobFilter", file_glob).option("header", "true").csv(root)
                 .withColumn("_lf_path", F.col("_metadata.file_path")))


# S6 -------------------------------------------------------------------------
def read_training_log(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                      multi_line: bool = True) -> DataFrame:
    """Training-state documents; one row per entry of ``log_history``.

    Entries are heterogeneous (train / eval); fields an entry lacks are null.
    ``multi_line`` reads one pretty-printed document per file.
    """
    reader = spark.read.option("multiLine", str(multi_line).lower())
    if schema is not None:
        reader = reader.schema(schema)
    docs = reader.json(path)
    keep = [c for c in docs.columns if c != "log_history"]
    return docs.select(*keep, F.explode("log_history").alias("entry")).select(*keep, "entry.*")


# S7 / T5 --------------------------------------------------------------------
POLICY_FIELDS = [("target_tag", "string", "$[0]"), ("source_tag", "string", "$[1]"),
                 ("target_iter", "long", "$[2]"), ("source_iter", "long", "$[3]")]


def parse_policy_lines(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """A policy line is a JSON array of mixed types:
    [target, source, target_iter, source_iter, {old config}, {new config}]."""
    cols = [F.get_json_object(line_col, p).cast(t).alias(n) for n, t, p in POLICY_FIELDS]
    cols += [F.from_json(F.get_json_object(line_col, "$[4]"), TRIAL_CONFIG_SCHEMA).alias("old_config"),
             F.from_json(F.get_json_object(line_col, "$[5]"), TRIAL_CONFIG_SCHEMA).alias("new_config")]
    return lines.select(*cols)


def read_policy_log(spark: SparkSession, root: str, file_glob: str = "*.txt") -> DataFrame:
    lines = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", file_glob)
                  .text(root))
    return parse_policy_lines(lines.filter(F.length(F.trim("value")) > 0))


def policy_events(policy: DataFrame) -> DataFrame:
    """Distinct decisions (each policy file repeats its ancestors' lines)."""
    return policy.dropDuplicates()


# T6 -------------------------------------------------------------------------
def classify_change(old: Column, new: Column, factors=(0.8, 1.2), tol: float = 1e-6) -> Column:
    ratio = F.try_divide(new, old)
    down, up = factors
    return (F.when(old.isNull() | new.isNull(), F.lit(None))
             .when(old == 0, F.when(new == 0, F.lit("kept")).otherwise(F.lit("resample")))
             .when(F.abs(ratio - down) <= tol, F.lit("perturb_down"))
             .when(F.abs(ratio - up) <= tol, F.lit("perturb_up"))
             .when(F.abs(ratio - 1.0) <= tol, F.lit("kept"))
             .otherwise(F.lit("resample")))


def policy_mutations(events: DataFrame) -> DataFrame:
    o, n = F.col("old_config"), F.col("new_config")
    return events.select(
        "target_tag", "source_tag", "target_iter", "source_iter",
        classify_change(o["learning_rate"], n["learning_rate"]).alias("learning_rate_change"),
        classify_change(o["weight_decay"], n["weight_decay"]).alias("weight_decay_change"),
        (n["per_device_train_batch_size"] - o["per_device_train_batch_size"]).alias("batch_size_step"))


# T1 -------------------------------------------------------------------------
def objective(metrics: list[str] = TRIAL_METRICS) -> Column:
    """Sum of the quality metrics (loss and runtime are not part of it)."""
    return sum((F.col(m) for m in metrics[1:]), F.col(metrics[0]))


def missing_to_null(c: Column, kind: T.DataType) -> Column:
    """NaN is a missing score, like null."""
    return F.when(~F.isnan(c), c) if isinstance(kind, (T.DoubleType, T.FloatType)) else c


# O1 / T2 --------------------------------------------------------------------
def best_trial(results: DataFrame, group: str = "model", score: str = "objective",
               keep: list[str] | None = None, mode: str = "max") -> DataFrame:
    """Best row per group: highest (or lowest) score, ties to the newest
    timestamp, then the larger trial id; a missing score (null or NaN) never
    wins over a number and comes out as null."""
    if mode not in ("max", "min"):
        raise ValueError("mode must be 'max' or 'min'")
    keep = keep or [c for c in results.columns if c not in (group, score)]
    results = results.withColumn(score, missing_to_null(F.col(score), results.schema[score].dataType))
    s = F.col(score) if mode == "max" else -F.col(score)
    key = F.struct(s.isNotNull().alias("_k0"), s.alias("_k1"), F.col("timestamp").alias("_k2"),
                   F.col("trial_id").alias("_k3"))
    picked = results.groupBy(group).agg(F.max(F.struct(key.alias("_k"), F.col(score).alias(score),
                                                       *[F.col(c) for c in keep])).alias("_b"))
    return picked.select(group, F.col(f"_b.{score}").alias(score), *[F.col(f"_b.{c}").alias(c) for c in keep])


# W4 / W5 --------------------------------------------------------------------
def trial_progress(results: DataFrame, order: list[str] = ("timestamp", "event_id"),
                   score: str = "objective") -> DataFrame:
    """Best score so far and change since the previous evaluation, per trial:
    (trial_id, *order, score, best_so_far, delta). Only these columns go
    through the scan; join other columns back on (trial_id, *order)."""
    narrow = results.select("trial_id", *order, score)
    out = running_max_and_lag(narrow, "trial_id", list(order), score, "best_so_far", "_lf_prev",
                              method="arrow")
    return out.withColumn("delta", F.col(score) - F.col("_lf_prev")).drop("_lf_prev")


def trial_latest(results: DataFrame, order: list[str] = ("timestamp", "event_id")) -> DataFrame:
    """A restored trial writes an iteration again: keep the newest row per
    (trial, iteration)."""
    others = [c for c in results.columns if c not in ("trial_id", "training_iteration")]
    pick = results.groupBy("trial_id", "training_iteration").agg(
        F.max(F.struct(F.struct(*order).alias("_k"), *others)).alias("_b"))
    return pick.select("trial_id", "training_iteration", *[F.col(f"_b.{c}").alias(c) for c in others])


# T7 -------------------------------------------------------------------------
ERROR_LINE = r"(?m)^(\w+(?:Error|Exception)): (.*)$"


def trial_failures(spark: SparkSession, root: str, file_glob: str = "*.txt") -> DataFrame:
    """Error type by count over all error files, by line: a file may hold any number of errors and is read in splits."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", file_glob).text(root)
    lines = files.select(F.explode(F.regexp_extract_all("value", F.lit(ERROR_LINE), 1)).alias("error_type"))
    return lines.groupBy("error_type").agg(F.count(F.lit(1)).alias("n"))


# T8 -------------------------------------------------------------------------
def smoke_filter(results: DataFrame, max_iteration: int = 1) -> DataFrame:
    return results.filter(F.col("training_iteration") <= max_iteration)


# T9 -------------------------------------------------------------------------
def best_checkpoint(log_rows: DataFrame, run: str = "run_id") -> DataFrame:
    """Per run, the evaluation entry with the lowest loss (ties → earlier step)."""
    evals = log_rows.filter(F.col("eval_loss").isNotNull())
    b = evals.groupBy(run).agg(F.min(F.struct("eval_loss", "step")).alias("_b"))
    return b.select(run, F.col("_b.step").alias("best_step"), F.col("_b.eval_loss").alias("best_metric"))


# P13 ------------------------------------------------------------------------
REPORT_PARAMS = {"config.per_device_train_batch_size": "batch_size",
                 "config.learning_rate": "learning_rate",
                 "config.weight_decay": "weight_decay",
                 "config.num_train_epochs": "num_train_epochs"}
REPORT_METRICS = {
    "multi_label_classification": {
        "eval_loss": "loss", "eval_f1_micro": "f1_micro", "eval_f1_macro": "f1_macro",
        "eval_precision_micro": "precision_micro", "eval_precision_macro": "precision_macro",
        "eval_recall_micro": "recall_micro", "eval_recall_macro": "recall_macro"},
    "single_label_classification": {"eval_loss": "loss", "eval_accuracy": "accuracy"},
}


def trial_report(results: DataFrame, problem_type: str) -> DataFrame:
    """Parameter and metric columns renamed for a report. Every report of a
    problem type has the same columns; what the logs do not hold is null."""
    def has(path: str) -> bool:
        head, _, tail = path.partition(".")
        if head not in results.columns:
            return False
        if not tail:
            return True
        dt = results.schema[head].dataType
        return isinstance(dt, T.StructType) and tail in dt.fieldNames()

    wanted = {"trial_id": "trial_id", "training_iteration": "training_iteration",
              **REPORT_PARAMS, **REPORT_METRICS[problem_type]}
    return results.select(*[(F.col(src) if has(src) else F.lit(None).cast("double")).alias(dst)
                            for src, dst in wanted.items()])
