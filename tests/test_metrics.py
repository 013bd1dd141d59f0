import math

import numpy as np
from pyspark.sql import functions as F

from labelforge.operators import metrics as M


def _scored(spark):
    # 3 labels; label 2 has no positives and no predictions (0/0 -> 0)
    rows = [
        ([0.9, 0.2, 0.1], [1.0, 0.0, 0.0]),
        ([0.6, 0.7, 0.0], [1.0, 1.0, 0.0]),
        ([0.1, 0.8, 0.2], [0.0, 0.0, 0.0]),
        ([0.5, 0.1, 0.3], [1.0, 1.0, 0.0]),   # 0.5 is not > 0.5
    ]
    return spark.createDataFrame(rows, "logits array<double>, label array<double>")


def test_per_label_counts_and_zero_denominators(spark):
    counts = M.confusion_counts(M.with_predictions(_scored(spark)), 3)
    pl = {r.label_idx: r for r in M.per_label(counts).collect()}
    assert (pl[0].tp, pl[0].fp, pl[0].fn) == (2, 0, 1)
    assert (pl[1].tp, pl[1].fp, pl[1].fn) == (1, 1, 1)
    assert (pl[2].tp, pl[2].fp, pl[2].fn) == (0, 0, 0)
    assert pl[2].precision == 0.0 and pl[2].recall == 0.0 and pl[2].f1 == 0.0
    assert math.isclose(pl[0].f1, 2 * 2 / (2 * 2 + 0 + 1))


def test_micro_macro_combined(spark):
    s = M.multi_label_metrics(_scored(spark), 3).first()
    tp, fp, fn = 3, 1, 2
    assert math.isclose(s.f1_micro, 2 * tp / (2 * tp + fp + fn))
    assert math.isclose(s.precision_micro, tp / (tp + fp))
    assert math.isclose(s.recall_micro, tp / (tp + fn))
    # macro is the mean of per-label F1, not the F1 of mean P and R
    assert math.isclose(s.f1_macro, (0.8 + 0.5 + 0.0) / 3)
    six = [s.f1_micro, s.f1_macro, s.precision_micro, s.precision_macro, s.recall_micro, s.recall_macro]
    assert math.isclose(s.combined_score, sum(six) / 6)
    # property: micro precision × (tp + fp) = tp
    assert math.isclose(s.precision_micro * (tp + fp), tp)


def test_binary_entailment_metrics(spark):
    df = spark.createDataFrame([([0.2, 0.8], 1.0), ([0.9, 0.1], 1.0), ([0.3, 0.7], 0.0), ([0.5, 0.5], 0.0)],
                               "logits array<double>, label double")
    r = M.entailment_metrics(df).first()
    assert (r.precision, r.recall) == (0.5, 0.5)
    assert math.isclose(r.combined_score, (r.f1 + r.precision + r.recall) / 3)


def test_losses_match_numpy(spark):
    df = _scored(spark)
    x = np.array([r.logits for r in df.collect()])
    y = np.array([r.label for r in df.collect()])
    bce = np.mean(np.maximum(x, 0) - x * y + np.log1p(np.exp(-np.abs(x))))
    assert math.isclose(M.loss_bce(df).first().loss, bce, rel_tol=1e-12)
    assert math.isclose(M.loss_mse(df).first().loss, np.mean((x - y) ** 2), rel_tol=1e-12)
    single = spark.createDataFrame([([1.0, 2.0, 0.5], 1), ([3.0, 0.0, 0.0], 2)], "logits array<double>, label int")
    lg = np.array([[1.0, 2.0, 0.5], [3.0, 0.0, 0.0]])
    lab = [1, 2]
    ce = np.mean([np.log(np.sum(np.exp(r - r.max()))) + r.max() - r[t] for r, t in zip(lg, lab)])
    assert math.isclose(M.loss_ce(single).first().loss, ce, rel_tol=1e-12)


def test_threshold_sweep_picks_best_cut(spark):
    df = spark.createDataFrame([([0.9], [1.0]), ([0.8], [1.0]), ([0.3], [0.0]), ([0.35], [1.0]), ([0.1], [0.0])],
                               "logits array<double>, label array<double>")
    r = M.threshold_sweep(df, 1).first()
    # cut at 0.3 (predict > 0.3): tp=3, fp=0, fn=0
    assert (r.best_threshold, r.best_f1) == (0.3, 1.0)


def test_threshold_sweep_tries_every_cut(spark):
    def best(rows):
        return M.threshold_sweep(spark.createDataFrame([([s], [y]) for s, y in rows], "logits array<double>, label array<double>"), 1).first()
    r = best([(0.2, 1.0), (0.5, 1.0), (0.9, 1.0)])               # all positive: the cut below the lowest score
    assert (r.best_threshold, r.best_f1) == (float("-inf"), 1.0)
    r = best([(0.5004, 1.0), (0.4996, 0.0), (0.1, 0.0)])         # scores closer than three digits
    assert (r.best_threshold, r.best_f1) == (0.4996, 1.0)
    r = best([(None, 1.0), (float("nan"), 1.0), (0.7, 1.0), (0.2, 0.0)])
    assert r.best_threshold == 0.2 and math.isclose(r.best_f1, 2 / 4)


def test_loss_by_problem_type(spark):
    multi = _scored(spark)
    assert M.problem_type(multi) == "multi_label_classification" and M.loss(multi).first() == M.loss_bce(multi).first()
    single = spark.createDataFrame([([1.0, 2.0, 0.5], 1)], "logits array<double>, label int")
    assert M.problem_type(single) == "single_label_classification" and M.loss(single).first() == M.loss_ce(single).first()
    number = spark.createDataFrame([(1.0, 2.0), (3.0, 3.5)], "logits double, label double")
    assert M.problem_type(number) == "regression" and math.isclose(M.loss(number).first().loss, (1 + 0.25) / 2)


def test_label_widths_are_checked(spark):
    import pytest
    with pytest.raises(ValueError):
        M.metric_by_name(spark.createDataFrame([([0.1], [1.0]), ([0.1, 0.9], [1.0, 0.0])], "logits array<double>, label array<double>"), "f1")


def test_metric_by_name_dispatches_on_label_type(spark):
    multi = M.metric_by_name(_scored(spark), "f1").first()
    assert multi.problem_type == "multi_label_classification"
    single = spark.createDataFrame([([0.1, 0.9], 1), ([0.8, 0.2], 1)], "logits array<double>, label int")
    acc = M.metric_by_name(single, "accuracy").first()
    assert acc.problem_type == "single_label_classification" and acc.value == 0.5


def test_golden_per_label_f1_from_precision_recall():
    # F1 = 2PR/(P+R) holds for a published per-label row (Has Comparator Group)
    p, r, f1 = 0.8301, 0.7283, 0.7759
    assert abs(2 * p * r / (p + r) - f1) < 1e-3
    assert F is not None
