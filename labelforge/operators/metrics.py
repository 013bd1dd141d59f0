"""Classification metrics as one-pass aggregations.

Every metric comes from confusion counts that one global aggregation builds:
per label position ``c`` we sum ``tp_c, fp_c, fn_c`` straight off the score and
label arrays (3·C sums, partial-aggregated in every task, no explode, no
per-label shuffle). The C-row count table is all the rest needs.

Pinned rules: thresholding is strict ``> 0.5`` on raw scores; a ratio with a
zero denominator is 0; F1 = 2tp / (2tp + fp + fn); macro = mean of the
per-label values; the combined score is the mean of the reported values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelforge.functions.labels import argmax, threshold_scores

MULTI_LABEL_KEYS = ["f1_micro", "f1_macro", "precision_micro", "precision_macro",
                    "recall_micro", "recall_macro"]


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def _positive(y: Column) -> Column:
    return F.coalesce((y.cast("double") == 1.0), F.lit(False))


# M3 (counts) ----------------------------------------------------------------
def confusion_counts(df: DataFrame, n_labels: int, pred_col: str = "pred",
                     label_col: str = "label") -> DataFrame:
    """(label_idx, tp, fp, fn, support) from 0/1 prediction and label arrays."""
    sums = []
    for c in range(n_labels):
        p = F.coalesce(F.col(pred_col)[c] == 1, F.lit(False))
        y = _positive(F.col(label_col)[c])
        sums += [F.sum((p & y).cast("long")).alias(f"tp{c}"),
                 F.sum((p & ~y).cast("long")).alias(f"fp{c}"),
                 F.sum((~p & y).cast("long")).alias(f"fn{c}")]
    wide = df.agg(*sums)
    rows = F.array(*[F.struct(F.lit(c).cast("long").alias("label_idx"),
                              F.coalesce(F.col(f"tp{c}"), F.lit(0)).alias("tp"),
                              F.coalesce(F.col(f"fp{c}"), F.lit(0)).alias("fp"),
                              F.coalesce(F.col(f"fn{c}"), F.lit(0)).alias("fn"))
                     for c in range(n_labels)])
    return (wide.select(F.inline(rows))
                .withColumn("support", F.col("tp") + F.col("fn")))


def confusion_sums(n_labels: int, pred_col: str = "pred", label_col: str = "label") -> list[Column]:
    """Aggregates for any ``groupBy``: ``counts``, an array of (label_idx, tp, fp, fn) in label order."""
    rows = []
    for c in range(n_labels):
        p = F.coalesce(F.col(pred_col)[c] == 1, F.lit(False))
        y = _positive(F.col(label_col)[c])
        rows.append(F.struct(F.lit(c).cast("long").alias("label_idx"), *[
            F.sum(x.cast("long")).alias(n) for n, x in (("tp", p & y), ("fp", p & ~y), ("fn", ~p & y))]))
    return [F.array(*rows).alias("counts")]


def metrics_by(df: DataFrame, keys: list[str], n_labels: int, score_col: str = "logits", label_col: str = "label") -> DataFrame:
    """The values of ``multi_label_metrics`` for each group of ``keys``, from one aggregation: the confusion counts are
    combined in the tasks, and everything else is arithmetic on a group's row."""
    counts = with_predictions(df, score_col).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *confusion_sums(n_labels, "pred", label_col))

    def total(name: str) -> Column:
        return F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x[name])

    def mean(num, den) -> Column:
        return F.aggregate("counts", F.lit(0.0), lambda s, x: s + _ratio(num(x), den(x))) / n_labels

    tp, fp, fn = (total(n) for n in ("tp", "fp", "fn"))
    parts = {"f1": (lambda x: 2 * x["tp"], lambda x: 2 * x["tp"] + x["fp"] + x["fn"]), "precision": (lambda x: x["tp"], lambda x: x["tp"] + x["fp"]),
             "recall": (lambda x: x["tp"], lambda x: x["tp"] + x["fn"])}
    micro = {"f1": _ratio(2 * tp, 2 * tp + fp + fn), "precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn)}
    out = counts.select(*keys, "n", *[micro[m].alias(f"{m}_micro") for m in parts], *[mean(*parts[m]).alias(f"{m}_macro") for m in parts])
    combined = sum((F.col(k) for k in MULTI_LABEL_KEYS), F.lit(0.0)) / len(MULTI_LABEL_KEYS)
    return out.select(*keys, "n", *MULTI_LABEL_KEYS, combined.alias("combined_score"))


def with_predictions(df: DataFrame, score_col: str = "logits", cut: float = 0.5,
                     pred_col: str = "pred") -> DataFrame:
    return df.withColumn(pred_col, threshold_scores(F.col(score_col), cut))


# M3 -------------------------------------------------------------------------
def per_label(counts: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        "label_idx", "tp", "fp", "fn",
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


# M1 / M2 / M4 / U2 ----------------------------------------------------------
def summary(counts: DataFrame) -> DataFrame:
    """One row: micro and macro F1 / precision / recall and the combined score."""
    pl = per_label(counts)
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    row = pl.agg(
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1_micro"),
        F.avg("f1").alias("f1_macro"),
        _ratio(tp, tp + fp).alias("precision_micro"),
        F.avg("precision").alias("precision_macro"),
        _ratio(tp, tp + fn).alias("recall_micro"),
        F.avg("recall").alias("recall_macro"))
    combined = sum((F.col(k) for k in MULTI_LABEL_KEYS), F.lit(0.0)) / len(MULTI_LABEL_KEYS)
    return row.withColumn("combined_score", combined)


def multi_label_metrics(df: DataFrame, n_labels: int, score_col: str = "logits",
                        label_col: str = "label") -> DataFrame:
    scored = with_predictions(df, score_col)
    return summary(confusion_counts(scored, n_labels, "pred", label_col))


# M5 -------------------------------------------------------------------------
def accuracy(df: DataFrame, pred: Column, label: Column) -> DataFrame:
    return df.agg(F.avg((pred == label).cast("double")).alias("accuracy"))


# M6 -------------------------------------------------------------------------
def binary_metrics(df: DataFrame, pred: Column, label: Column) -> DataFrame:
    """F1 / precision / recall of class 1 and their mean (entailment)."""
    p = F.coalesce(pred == 1, F.lit(False))
    y = _positive(label)
    counts = df.agg(F.sum((p & y).cast("long")).alias("tp"),
                    F.sum((p & ~y).cast("long")).alias("fp"),
                    F.sum((~p & y).cast("long")).alias("fn"))
    tp, fp, fn = (F.coalesce(F.col(c), F.lit(0)) for c in ("tp", "fp", "fn"))
    out = counts.select(_ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
                        _ratio(tp, tp + fp).alias("precision"),
                        _ratio(tp, tp + fn).alias("recall"))
    return out.withColumn("combined_score",
                          (F.col("f1") + F.col("precision") + F.col("recall")) / 3)


def entailment_metrics(df: DataFrame, logits_col: str = "logits",
                       label_col: str = "label") -> DataFrame:
    return binary_metrics(df, argmax(F.col(logits_col)), F.col(label_col))


# M7 -------------------------------------------------------------------------
def common_width(df: DataFrame, column: str) -> int:
    """The width that all non-null arrays of a column have (0 without rows);
    arrays of different widths are an error, never cut to one of them."""
    w = F.when(F.col(column).isNotNull(), F.size(column))
    low, high = df.agg(F.min(w), F.max(w)).first()
    if low != high:
        raise ValueError(f"column {column!r} holds arrays of {low} to {high} elements")
    return int(low or 0)


def is_multi_label(df: DataFrame, label_col: str = "label") -> bool:
    return isinstance(df.schema[label_col].dataType, T.ArrayType)


def metric_by_name(df: DataFrame, name: str, score_col: str = "logits",
                   label_col: str = "label", average: str = "micro") -> DataFrame:
    """Metric by name; multi-label when the label column is a list.

    Multi-label: f1 / precision / recall with ``average`` micro or macro.
    Single-label: accuracy on the argmax, or the class-1 f1 / precision / recall.
    Returns one row (metric, problem_type, value).
    """
    if is_multi_label(df, label_col):
        n_labels = common_width(df, label_col)
        if name not in ("f1", "precision", "recall"):
            raise ValueError(f"metric {name!r} has no multi-label form")
        vals = multi_label_metrics(df, n_labels, score_col, label_col)
        value = F.col(f"{name}_{average}")
        ptype = "multi_label_classification"
    else:
        pred = argmax(F.col(score_col))
        if name == "accuracy":
            vals = accuracy(df, pred, F.col(label_col))
            value = F.col("accuracy")
        elif name in ("f1", "precision", "recall"):
            vals = binary_metrics(df, pred, F.col(label_col))
            value = F.col(name)
        else:
            raise ValueError(f"unknown metric {name!r}")
        ptype = "single_label_classification"
    return vals.select(F.lit(name).alias("metric"), F.lit(ptype).alias("problem_type"),
                       value.alias("value"))


# M8 -------------------------------------------------------------------------
def throughput(samples: Column, runtime_s: Column, batch_size: int) -> list[Column]:
    steps = F.ceil(samples / F.lit(batch_size))
    return [F.when(runtime_s > 0, samples / runtime_s).alias("samples_per_second"),
            F.when(runtime_s > 0, steps / runtime_s).alias("steps_per_second")]


# M9 -------------------------------------------------------------------------
def bce_with_logits(x: Column, y: Column) -> Column:
    """Per-row sum of the numerically stable binary cross-entropy terms."""
    terms = F.zip_with(x, y, lambda a, b: F.greatest(a, F.lit(0.0)) - a * b
                       + F.log1p(F.exp(-F.abs(a))))
    return F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)


def loss_bce(df: DataFrame, logits_col: str = "logits", label_col: str = "label") -> DataFrame:
    """Mean over all N×C entries (as the library loss averages)."""
    return df.agg((F.sum(bce_with_logits(F.col(logits_col), F.col(label_col)))
                   / F.sum(F.size(logits_col))).alias("loss"))


def cross_entropy(x: Column, y: Column) -> Column:
    m = F.array_max(x)
    lse = F.log(F.aggregate(x, F.lit(0.0), lambda acc, a: acc + F.exp(a - m))) + m
    return lse - F.element_at(x, y.cast("int") + 1)


def loss_ce(df: DataFrame, logits_col: str = "logits", label_col: str = "label") -> DataFrame:
    return df.agg(F.avg(cross_entropy(F.col(logits_col), F.col(label_col))).alias("loss"))


def loss_mse(df: DataFrame, pred_col: str = "logits", label_col: str = "label") -> DataFrame:
    sq = F.aggregate(F.zip_with(F.col(pred_col), F.col(label_col), lambda a, b: (a - b) * (a - b)),
                     F.lit(0.0), lambda acc, t: acc + t)
    return df.agg((F.sum(sq) / F.sum(F.size(pred_col))).alias("loss"))


def problem_type(df: DataFrame, logits_col: str = "logits", label_col: str = "label") -> str:
    """``regression`` for one score a row (a number or arrays of width 1), else
    single- or multi-label by the type of the label: whole numbers name a
    class, arrays of numbers are one target per label."""
    kind, label = df.schema[logits_col].dataType, df.schema[label_col].dataType
    if not isinstance(kind, T.ArrayType) or common_width(df, logits_col) == 1:
        return "regression"
    if isinstance(label, T.ArrayType):
        return "multi_label_classification"
    if isinstance(label, T.IntegralType):
        return "single_label_classification"
    raise ValueError(f"labels of type {label.simpleString()} fit no problem type of {kind.simpleString()} scores")


def loss(df: DataFrame, logits_col: str = "logits", label_col: str = "label", kind: str | None = None) -> DataFrame:
    """The loss of the problem type: squared error, cross-entropy or binary cross-entropy."""
    kind = kind or problem_type(df, logits_col, label_col)
    if kind == "regression":
        as_array = {c: F.array(F.col(c)) for c in (logits_col, label_col) if not isinstance(df.schema[c].dataType, T.ArrayType)}
        return loss_mse(df.withColumns(as_array), logits_col, label_col)
    if kind == "single_label_classification":
        return loss_ce(df, logits_col, label_col)
    if kind == "multi_label_classification":
        return loss_bce(df, logits_col, label_col)
    raise ValueError(f"unknown problem type {kind!r}")


# M10 ------------------------------------------------------------------------
def threshold_sweep(df: DataFrame, n_labels: int, score_col: str = "logits",
                    label_col: str = "label") -> DataFrame:
    """Best cut per label: predict positive when score > t. Every distinct score
    is tried, and the cut below the lowest (-Infinity: all positive); the
    highest F1 wins, then the lowest cut. Missing scores are never positive but
    their positives count as missed.

    Rows are first reduced to (label, score) → positives/negatives (partial
    aggregation); the counts above a cut are running sums over range
    partitions, so a label's scores are never gathered in one task.
    """
    from labelforge.operators.positions import running_sums

    pairs = df.select(F.inline(F.arrays_zip(
        F.sequence(F.lit(0), F.lit(n_labels - 1)).alias("label_idx"),
        F.col(score_col).alias("s"), F.col(label_col).alias("y"))))
    score = F.when(~F.isnan("s"), F.col("s").cast("double"))
    hist = (pairs.withColumn("t", score).groupBy("label_idx", "t")
                 .agg(F.sum(_positive(F.col("y")).cast("long")).alias("pos"),
                      F.sum((~_positive(F.col("y"))).cast("long")).alias("neg")))
    known = hist.filter(F.col("t").isNotNull())
    below = known.select("label_idx").distinct().select(
        "label_idx", F.lit(float("-inf")).alias("t"), F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("neg"))
    cum = running_sums(known.unionByName(below), "label_idx", -F.col("t"), ["pos", "neg"])
    all_pos = hist.groupBy("label_idx").agg(F.sum("pos").alias("p_all"))
    f1 = _ratio(2 * F.col("before_pos"), F.col("before_pos") + F.col("before_neg") + F.col("p_all"))
    best = cum.join(all_pos, "label_idx").withColumn("f1", f1).groupBy("label_idx").agg(
        F.max(F.struct("f1", (-F.col("t")).alias("neg_t"))).alias("b"))
    return best.select("label_idx", (-F.col("b.neg_t")).alias("best_threshold"),
                       F.col("b.f1").alias("best_f1"))
