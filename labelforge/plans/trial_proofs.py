"""Proof queries: trial logs and model selection (S4-S7, O1, P13, W4, W5,
T1, T2, T5-T9, J6, M8 stand-in).

Fixture: every ``events`` row is one trial evaluation — model = event_type,
trial = event_type + user, iteration = hour + 1, timestamp = ts, metrics and
configuration derived from value and props.k. The logs are landed under the
session's shared folder, the lines of many trials to a file: the rows name their
trial, and the number of files does not grow with that of the trials.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from labelforge.operators import catalogue
from labelforge.operators import trials as TR
from labelforge.plans import standins as S
from labelforge.plans.registry import proof
from labelforge.schemas import TRIAL_METRICS
from labelforge.session import work_path

SIX = TRIAL_METRICS[:6]


def trial_rows(spark, d):
    ev = S.table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    ms = [((F.col("value") * (i + 3) + k * (i + 1)) % 97) / 97 for i in range(6)]
    combined = (ms[0] + ms[1] + ms[2] + ms[3] + ms[4] + ms[5]) / 6
    obj = ms[0] + ms[1] + ms[2] + ms[3] + ms[4] + ms[5] + combined
    config = F.struct(
        (F.lit(8) * (1 + F.col("user_id") % 4)).cast("long").alias("per_device_train_batch_size"),
        F.lit(8).cast("long").alias("per_device_eval_batch_size"),
        (1 + F.col("user_id") % 5).cast("double").alias("num_train_epochs"),
        F.lit(-1).cast("long").alias("max_steps"),
        (k / F.lit(333.0)).alias("weight_decay"),
        ((1 + F.col("event_id") % 9).cast("double") * F.lit(1e-5)).alias("learning_rate"))
    return ev.select(
        F.col("event_type").alias("model"),
        F.concat(F.col("event_type"), F.lit("_"), F.lpad(F.col("user_id").cast("string"), 5, "0")).alias("trial_id"),
        (F.hour("ts") + 1).cast("long").alias("training_iteration"),
        F.unix_timestamp("ts").alias("timestamp"),
        "event_id",
        F.date_format("ts", "yyyy-MM-dd_HH-mm-ss").alias("date"),
        obj.alias("objective"),
        (F.col("value") / 100).alias("eval_loss"),
        *[m.alias(n) for m, n in zip(ms, SIX)],
        combined.alias("eval_combined_score"),
        (F.col("value") / 10).alias("eval_runtime"),
        config.alias("config"))


K_SQL = "CAST(json_extract(props, '$.k') AS INTEGER)"
M_SQL = [f"((value * {i + 3} + {K_SQL} * {i + 1}) % 97) / 97" for i in range(6)]
COMB_SQL = "(" + " + ".join(f"({m})" for m in M_SQL) + ") / 6"
TRIALS_SQL = (
    "SELECT event_type AS model, event_type || '_' || lpad(CAST(user_id AS VARCHAR), 5, '0') AS trial_id, "
    "CAST(hour(ts) + 1 AS BIGINT) AS training_iteration, "
    "CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS timestamp, event_id, "
    "strftime(ts, '%Y-%m-%d_%H-%M-%S') AS date, "
    + " + ".join(f"({m})" for m in M_SQL) + f" + {COMB_SQL} AS objective, "
    "value / 100 AS eval_loss, "
    + ", ".join(f"{m} AS {n}" for m, n in zip(M_SQL, SIX))
    + f", {COMB_SQL} AS eval_combined_score, value / 10 AS eval_runtime, "
    "CAST(8 * (1 + user_id % 4) AS BIGINT) AS batch_size, "
    f"CAST({K_SQL} AS DOUBLE) / 333 AS weight_decay, "
    "CAST(1 + event_id % 9 AS DOUBLE) * 1e-5 AS learning_rate, "
    "CAST(1 + user_id % 5 AS DOUBLE) AS num_train_epochs "
    "FROM events")

FLAT = ["model", "trial_id", "training_iteration", "timestamp", "event_id", "objective"]


def _land_results(spark, d):
    return S.landed(spark, d, "_land_results", lambda: _land_results_now(spark, d))


def _land_results_now(spark, d):
    """Result lines in a directory per model, plus a decoy directory to skip."""
    rows = trial_rows(spark, d)
    root = work_path(spark, "tune-results")
    out = rows.withColumn("model_dir", F.col("model")).drop("model")
    # a task's rows of a model are one file, whatever the number of trials: files grow with the bytes
    out.write.mode("overwrite").partitionBy("model_dir").json(f"{root}/runs")
    # stale copies a search leaves in checkpoint folders: must not be counted
    out.write.mode("overwrite").json(f"{root}/runs/checkpoint_tmp")
    return root


def _results(spark, d):
    root = _land_results(spark, d)
    schema = trial_rows(spark, d).drop("model").schema
    df = TR.read_trial_results(spark, root, schema, "*.json", skip_dir="checkpoint_tmp")
    return df.withColumn("model", TR.path_part("model_dir")).drop("_lf_path")


def _catalogued(spark, d):
    """The same logs through the incremental catalogue: every file is read once, packed into Parquet."""
    def build():
        root, path = _land_results(spark, d), work_path(spark, "trial-catalogue")
        schema = trial_rows(spark, d).drop("model").schema
        catalogue.refresh(spark, root, path, lambda paths: TR.read_trial_files(spark, paths, schema), "*.json", skip_dir="checkpoint_tmp")
        return path
    rows = catalogue.rows(spark, S.landed(spark, d, "_trial_catalogue", build))
    return rows.withColumn("model", F.regexp_extract("_lf_path", "model_dir=([^/]+)", 1)).drop("_lf_path")


def _r6(c):
    return F.round(c, 6).alias(c)


@proof("src_trial_json",
       f"SELECT model, trial_id, training_iteration, timestamp, event_id, round(objective, 6) AS objective "
       f"FROM ({TRIALS_SQL}) t")
def src_trial_json(spark, d):
    return _results(spark, d).select(*FLAT[:-1], _r6("objective"))


@proof("src_trial_csv",
       "SELECT model, trial_id, training_iteration, round(eval_loss, 6) AS eval_loss, "
       f"round(eval_f1_micro, 6) AS eval_f1_micro FROM ({TRIALS_SQL}) t")
def src_trial_csv(spark, d):
    rows = trial_rows(spark, d).drop("config")
    root = work_path(spark, "tune-progress")
    (rows.withColumn("model_dir", F.col("model")).drop("model")
         .write.mode("overwrite").option("header", "true").partitionBy("model_dir").csv(root))
    schema = rows.drop("model").schema
    df = TR.read_trial_progress(spark, root, schema)
    return df.select(TR.path_part("model_dir").alias("model"), "trial_id", "training_iteration",
                     _r6("eval_loss"), _r6("eval_f1_micro"))


@proof("trial_objective",
       "SELECT trial_id, event_id, round(" + " + ".join(SIX) + " + eval_combined_score, 6) AS objective, "
       f"round(objective, 6) AS logged_objective FROM ({TRIALS_SQL}) t")
def trial_objective(spark, d):
    # recomputed from the seven quality metrics next to the logged value
    r = _results(spark, d)
    return r.select("trial_id", "event_id", F.round(TR.objective(), 6).alias("objective"),
                    F.round("objective", 6).alias("logged_objective"))


@proof("best_trial",
       "SELECT model, arg_max(trial_id, struct_pack(o := objective, ts := timestamp, t := trial_id)) AS trial_id, "
       "arg_max(training_iteration, struct_pack(o := objective, ts := timestamp, t := trial_id)) AS training_iteration, "
       "round(max(objective), 6) AS objective "
       f"FROM ({TRIALS_SQL}) t GROUP BY model")
def best_trial(spark, d):
    b = TR.best_trial(_catalogued(spark, d), keep=["trial_id", "training_iteration"])
    return b.select("model", "trial_id", "training_iteration", _r6("objective"))


BEST_SQL = ("SELECT model, arg_max(batch_size, struct_pack(o := objective, ts := timestamp, t := trial_id)) AS batch_size, "
            "arg_max(learning_rate, struct_pack(o := objective, ts := timestamp, t := trial_id)) AS learning_rate, "
            "arg_max(weight_decay, struct_pack(o := objective, ts := timestamp, t := trial_id)) AS weight_decay "
            f"FROM ({TRIALS_SQL}) t GROUP BY model")


@proof("best_trial_json",
       "SELECT model, batch_size, round(learning_rate, 9) AS learning_rate, round(weight_decay, 6) AS weight_decay "
       f"FROM ({BEST_SQL}) b")
def best_trial_json(spark, d):
    b = TR.best_trial(_catalogued(spark, d), keep=["trial_id", "config"])
    path = work_path(spark, "hyperparameters")
    b.write.mode("overwrite").partitionBy("model").json(path)   # one JSON per model
    back = spark.read.schema(b.drop("model").schema).json(path).withColumn("model", TR.path_part("model"))
    return back.select("model", F.col("config.per_device_train_batch_size").alias("batch_size"),
                       F.round("config.learning_rate", 9).alias("learning_rate"),
                       F.round("config.weight_decay", 6).alias("weight_decay"))


@proof("best_config_lookup",
       "SELECT m.model, b.batch_size, round(b.learning_rate, 9) AS learning_rate, "
       "round(b.weight_decay, 6) AS weight_decay "
       f"FROM (SELECT DISTINCT event_type AS model FROM events) m LEFT JOIN ({BEST_SQL}) b USING (model)")
def best_config_lookup(spark, d):
    best = TR.best_trial(_catalogued(spark, d), keep=["config"])
    models = S.table(spark, d, "events").select(F.col("event_type").alias("model")).distinct()
    j = models.join(best, "model", "left")
    return j.select("model", F.col("config.per_device_train_batch_size").alias("batch_size"),
                    F.round("config.learning_rate", 9).alias("learning_rate"),
                    F.round("config.weight_decay", 6).alias("weight_decay"))


@proof("trial_report",
       "SELECT trial_id, training_iteration, batch_size, round(learning_rate, 9) AS learning_rate, "
       "round(weight_decay, 6) AS weight_decay, num_train_epochs, round(eval_loss, 6) AS loss, "
       "round(eval_f1_micro, 6) AS f1_micro, round(eval_f1_macro, 6) AS f1_macro, "
       "round(eval_precision_micro, 6) AS precision_micro, round(eval_precision_macro, 6) AS precision_macro, "
       "round(eval_recall_micro, 6) AS recall_micro, round(eval_recall_macro, 6) AS recall_macro "
       f"FROM ({TRIALS_SQL}) t")
def trial_report(spark, d):
    r = TR.trial_report(_results(spark, d), "multi_label_classification")
    return r.select(*[F.round(c, 9).alias(c) if c == "learning_rate"
                      else (F.round(c, 6).alias(c) if t == "double" and c != "num_train_epochs" else F.col(c))
                      for c, t in r.dtypes])


@proof("trial_progress",
       "SELECT trial_id, event_id, round(objective, 6) AS objective, "
       "round(max(objective) OVER (PARTITION BY trial_id ORDER BY timestamp, event_id "
       "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS best_so_far, "
       "round(objective - lag(objective) OVER (PARTITION BY trial_id ORDER BY timestamp, event_id), 6) AS delta "
       f"FROM ({TRIALS_SQL}) t")
def trial_progress(spark, d):
    p = TR.trial_progress(trial_rows(spark, d).select("trial_id", "timestamp", "event_id", "objective"))
    return p.select("trial_id", "event_id", _r6("objective"), _r6("best_so_far"), _r6("delta"))


@proof("trial_latest",
       "SELECT trial_id, training_iteration, arg_max(event_id, struct_pack(ts := timestamp, e := event_id)) AS event_id, "
       "max(timestamp) AS timestamp FROM (" + TRIALS_SQL + ") t GROUP BY trial_id, training_iteration")
def trial_latest(spark, d):
    latest = TR.trial_latest(trial_rows(spark, d).select("trial_id", "training_iteration", "timestamp",
                                                          "event_id", "objective"))
    return latest.select("trial_id", "training_iteration", "event_id", "timestamp")


@proof("trial_smoke_filter",
       f"SELECT trial_id, event_id FROM ({TRIALS_SQL}) t WHERE training_iteration <= 1")
def trial_smoke_filter(spark, d):
    return TR.smoke_filter(trial_rows(spark, d)).select("trial_id", "event_id")


# S7 / T5 / T6: policy decisions -------------------------------------------------
def _json_text(c):
    """A string as a JSON string literal (quoted and escaped)."""
    return F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")


def _policy_lines(spark, d):
    rows = trial_rows(spark, d)
    ev = S.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    r = rows.join(ev, "event_id")
    factor = F.when(F.col("k") % 3 == 0, F.lit(0.8)).when(F.col("k") % 3 == 1, F.lit(1.2))
    old = F.col("config")
    new_lr = F.when(factor.isNotNull(), old["learning_rate"] * factor).otherwise(
        (1 + (F.col("event_id") * 7) % 9).cast("double") * F.lit(1e-5))
    new_wd = F.when(factor.isNotNull(), old["weight_decay"] * factor).otherwise(old["weight_decay"])
    new_bs = F.when(F.col("k") % 2 == 0, old["per_device_train_batch_size"] * 2).otherwise(
        old["per_device_train_batch_size"])
    new = old.withField("learning_rate", new_lr).withField("weight_decay", new_wd) \
             .withField("per_device_train_batch_size", new_bs)
    source = F.concat(F.col("model"), F.lit("_"), F.lpad(F.col("k").cast("string"), 5, "0"))
    line = F.concat(F.lit("["), _json_text(F.col("trial_id")),
                    F.lit(", "), _json_text(source),
                    F.lit(", "), F.col("training_iteration").cast("string"),
                    F.lit(", "), (F.col("training_iteration") - 1).cast("string"),
                    F.lit(", "), F.to_json(old), F.lit(", "), F.to_json(new), F.lit("]"))
    return r.select(line.alias("value"))


def _land_policy(spark, d):
    return S.landed(spark, d, "_land_policy", lambda: _land_policy_now(spark, d))


def _land_policy_now(spark, d):
    lines = _policy_lines(spark, d)
    root = work_path(spark, "pbt-policy")
    # the target's log and the source's log both hold the decision; a file holds the lines of many owners
    for sub in ("a", "b"):
        lines.select("value").write.mode("overwrite").text(f"{root}/{sub}")
    return root


POLICY_SQL = (
    "SELECT trial_id AS target_tag, model || '_' || lpad(CAST(k AS VARCHAR), 5, '0') AS source_tag, "
    "training_iteration AS target_iter, training_iteration - 1 AS source_iter, "
    "learning_rate AS old_lr, CASE WHEN k % 3 = 0 THEN learning_rate * 0.8 WHEN k % 3 = 1 THEN learning_rate * 1.2 "
    "ELSE CAST(1 + (event_id * 7) % 9 AS DOUBLE) * 1e-5 END AS new_lr, "
    "weight_decay AS old_wd, CASE WHEN k % 3 = 0 THEN weight_decay * 0.8 WHEN k % 3 = 1 THEN weight_decay * 1.2 "
    "ELSE weight_decay END AS new_wd, batch_size AS old_bs, "
    "CASE WHEN k % 2 = 0 THEN batch_size * 2 ELSE batch_size END AS new_bs "
    f"FROM ({TRIALS_SQL}) t JOIN (SELECT event_id, {K_SQL} AS k FROM events) e USING (event_id)")


@proof("src_policy_log",
       "SELECT target_tag, source_tag, target_iter, source_iter, round(new_lr, 9) AS new_learning_rate "
       f"FROM ({POLICY_SQL}) p, (VALUES (1), (2)) copies(c)")
def src_policy_log(spark, d):
    p = TR.read_policy_log(spark, _land_policy(spark, d))
    return p.select("target_tag", "source_tag", "target_iter", "source_iter",
                    F.round("new_config.learning_rate", 9).alias("new_learning_rate"))


@proof("policy_events",
       "SELECT DISTINCT target_tag, source_tag, target_iter, source_iter, round(old_lr, 9) AS old_learning_rate, "
       f"round(new_lr, 9) AS new_learning_rate, new_bs AS new_batch_size FROM (SELECT DISTINCT * FROM ({POLICY_SQL}) p0) p")
def policy_events(spark, d):
    e = TR.policy_events(TR.read_policy_log(spark, _land_policy(spark, d)))
    return e.select("target_tag", "source_tag", "target_iter", "source_iter",
                    F.round("old_config.learning_rate", 9).alias("old_learning_rate"),
                    F.round("new_config.learning_rate", 9).alias("new_learning_rate"),
                    F.col("new_config.per_device_train_batch_size").alias("new_batch_size"))


def _change_sql(old, new):
    r = f"({new}) / ({old})"
    return (f"CASE WHEN {old} = 0 THEN CASE WHEN {new} = 0 THEN 'kept' ELSE 'resample' END "
            f"WHEN abs({r} - 0.8) <= 1e-6 THEN 'perturb_down' WHEN abs({r} - 1.2) <= 1e-6 THEN 'perturb_up' "
            f"WHEN abs({r} - 1.0) <= 1e-6 THEN 'kept' ELSE 'resample' END")


@proof("policy_mutations",
       "SELECT target_tag, source_tag, target_iter, source_iter, "
       f"{_change_sql('old_lr', 'new_lr')} AS learning_rate_change, "
       f"{_change_sql('old_wd', 'new_wd')} AS weight_decay_change, new_bs - old_bs AS batch_size_step "
       f"FROM (SELECT DISTINCT * FROM ({POLICY_SQL}) p0) p")
def policy_mutations(spark, d):
    return TR.policy_mutations(TR.policy_events(TR.read_policy_log(spark, _land_policy(spark, d))))


# T7 ---------------------------------------------------------------------------
ERR_TYPE = "CASE WHEN value > 50 THEN 'RuntimeError' WHEN value > 20 THEN 'ValueError' ELSE 'KeyError' END"


@proof("trial_failures",
       f"SELECT {ERR_TYPE} AS error_type, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1")
def trial_failures(spark, d):
    ev = S.table(spark, d, "events").filter(F.col("event_type") == "error")
    etype = (F.when(F.col("value") > 50, "RuntimeError").when(F.col("value") > 20, "ValueError")
              .otherwise("KeyError"))
    text = F.concat(F.lit("Failure # 1 (occurred at "), F.date_format("ts", "yyyy-MM-dd_HH-mm-ss"),
                    F.lit(")\nTraceback (most recent call last):\n  File \"trainable.py\", line "),
                    F.col("event_id").cast("string"), F.lit(", in train\n"), etype, F.lit(": trial "),
                    F.col("user_id").cast("string"), F.lit(" stopped"))
    root = work_path(spark, "trial-errors")
    ev.select(text.alias("value")).write.mode("overwrite").text(root)   # a file holds the errors of many trials
    return TR.trial_failures(spark, root)


# S6 / T9: training-state documents -----------------------------------------------
def _land_training_log(spark, d):
    return S.landed(spark, d, "_land_training_log", lambda: _land_training_log_now(spark, d))


def _land_training_log_now(spark, d):
    rows = trial_rows(spark, d)
    ev = S.table(spark, d, "events").select("event_id", "ts")
    r = rows.join(ev, "event_id").withColumn("run_id", F.concat(F.col("trial_id"), F.lit("_"),
                                                                F.date_format("ts", "yyyyMMdd")))
    step = (F.unix_timestamp("ts") - F.unix_timestamp(F.date_trunc("day", "ts"))).cast("long")
    train_e = F.struct(F.col("training_iteration").cast("double").alias("epoch"), step.alias("step"),
                       F.col("eval_loss").alias("loss"), F.col("config.learning_rate").alias("learning_rate"),
                       F.lit(None).cast("double").alias("eval_loss"), F.lit(None).cast("double").alias("eval_f1_micro"))
    eval_e = F.struct(F.col("training_iteration").cast("double").alias("epoch"), step.alias("step"),
                      F.lit(None).cast("double").alias("loss"), F.lit(None).cast("double").alias("learning_rate"),
                      (F.col("eval_loss") + F.col("eval_runtime") / 1000).alias("eval_loss"),
                      F.col("eval_f1_micro").alias("eval_f1_micro"))
    # one document per run (trial and day); a run's log is bounded by its steps
    docs = r.groupBy("run_id").agg(
        F.max("training_iteration").cast("double").alias("epoch"),
        F.max(step).alias("global_step"),
        F.flatten(F.collect_list(F.array(train_e, eval_e))).alias("log_history"))
    path = work_path(spark, "trainer-state")
    docs.select(F.to_json(F.struct("run_id", "epoch", "global_step", "log_history")).alias("value")) \
        .write.mode("overwrite").text(path)
    return path


LOG_ROWS_SQL = (
    "SELECT t.trial_id || '_' || strftime(e.ts, '%Y%m%d') AS run_id, "
    "CAST(date_diff('second', date_trunc('day', e.ts), e.ts) AS BIGINT) AS step, "
    "t.eval_loss AS loss, NULL::DOUBLE AS eval_loss FROM (" + TRIALS_SQL + ") t JOIN events e USING (event_id) "
    "UNION ALL SELECT t.trial_id || '_' || strftime(e.ts, '%Y%m%d'), "
    "CAST(date_diff('second', date_trunc('day', e.ts), e.ts) AS BIGINT), NULL, t.eval_loss + t.eval_runtime / 1000 "
    "FROM (" + TRIALS_SQL + ") t JOIN events e USING (event_id)")


LOG_SCHEMA = ("run_id string, epoch double, global_step long, log_history array<struct<epoch double, step long, loss double, "
              "learning_rate double, eval_loss double, eval_f1_micro double>>")


@proof("src_training_log",
       f"SELECT run_id, step, round(loss, 6) AS loss, round(eval_loss, 6) AS eval_loss FROM ({LOG_ROWS_SQL}) l")
def src_training_log(spark, d):
    log = TR.read_training_log(spark, _land_training_log(spark, d), LOG_SCHEMA, multi_line=False)
    return log.select("run_id", "step", _r6("loss"), _r6("eval_loss"))


@proof("best_checkpoint",
       "SELECT run_id, arg_min(step, struct_pack(l := eval_loss, s := step)) AS best_step, "
       f"round(min(eval_loss), 6) AS best_metric FROM ({LOG_ROWS_SQL}) l WHERE eval_loss IS NOT NULL GROUP BY run_id")
def best_checkpoint(spark, d):
    log = TR.read_training_log(spark, _land_training_log(spark, d), LOG_SCHEMA, multi_line=False)
    b = TR.best_checkpoint(log)
    return b.select("run_id", "best_step", _r6("best_metric"))
