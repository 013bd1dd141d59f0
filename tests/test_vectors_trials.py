import math

import numpy as np
from pyspark.sql import functions as F

from labelforge.operators import trials as TR
from labelforge.operators import vectors as V


def test_cosine_zero_vector_and_nearest_ties(spark):
    protos = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0])], "label_idx long, vec array<double>")
    rows = spark.createDataFrame([(1, [3.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0])], "id long, v array<double>")
    m = {(r.id, r.label_idx): r.cosine for r in V.cosine_label_matrix(rows, "id", "v", protos).collect()}
    assert math.isclose(m[(1, 0)], 1.0) and m[(2, 0)] == 0.0      # zero vector: norm floored, cosine 0
    assert math.isclose(m[(3, 2)], 1 / math.sqrt(2))
    near = V.attach_labels(rows, protos).select("id", V.nearest_label(F.col("v"), F.col("_lf_labels")).alias("p"))
    assert {r.id: r.p for r in near.collect()} == {1: 0, 2: 0, 3: 0}   # ties -> lower label id


def test_prototypes_both_paths_agree(spark):
    rnd = np.random.default_rng(3)
    rows = [(int(i % 3), [float(x) for x in rnd.normal(size=5)]) for i in range(60)]
    df = spark.createDataFrame(rows, "label int, v array<double>")
    a = {r.label_idx: r.vec for r in V.label_prototypes(df, "v", "label", 5).collect()}
    b = {r.label_idx: r.vec for r in V.label_prototypes(df, "v", "label").collect()}
    for k in a:
        exp = np.mean([v for lab, v in rows if lab == k], axis=0)
        assert np.allclose(a[k], exp) and np.allclose(b[k], exp)


def _trials(spark):
    rows = [
        ("m1", "t1", 1, 100, 1, 6.5), ("m1", "t2", 1, 200, 2, 6.6), ("m1", "t3", 2, 150, 3, 6.6),
        ("m1", "t4", 1, 300, 4, None), ("m2", "t5", 1, 100, 5, None), ("m2", "t6", 1, 90, 6, 1.0),
        ("m1", "t1", 1, 400, 7, 6.0),   # t1 iteration 1 written again later (restored trial)
    ]
    return spark.createDataFrame(rows, "model string, trial_id string, training_iteration long, "
                                       "timestamp long, event_id long, objective double")


def test_best_trial_ties_newest_and_null_never_wins(spark):
    best = {r.model: r for r in TR.best_trial(_trials(spark), keep=["trial_id"]).collect()}
    assert best["m1"].trial_id == "t2" and best["m1"].objective == 6.6   # tie 6.6: newer timestamp 200
    assert best["m2"].trial_id == "t6"


def test_trial_latest_keeps_newest_iteration_row(spark):
    got = {(r.trial_id, r.training_iteration): r.event_id for r in TR.trial_latest(_trials(spark)).collect()}
    assert got[("t1", 1)] == 7 and len(got) == 6


def test_trial_progress(spark):
    p = {r.event_id: r for r in TR.trial_progress(_trials(spark)).collect()}
    assert p[7].best_so_far == 6.5 and math.isclose(p[7].delta, -0.5)
    assert p[1].delta is None


def test_objective_golden_sum_of_seven():
    # a published best-trial row: objective is the sum of the seven metrics
    metrics = [0.9564, 0.9456, 0.9514, 0.9414, 0.9613, 0.9501, 0.9510]
    assert abs(sum(metrics) - 6.6572) < 1e-3


def test_policy_parse_and_mutation_classes(spark):
    lines = spark.createDataFrame([
        ('["a", "b", 3, 2, {"learning_rate": 1e-5, "weight_decay": 0.1, "per_device_train_batch_size": 8}, '
         '{"learning_rate": 1.2e-5, "weight_decay": 0.08, "per_device_train_batch_size": 16}]',),
        ('["a", "b", 3, 2, {"learning_rate": 1e-5, "weight_decay": 0.0, "per_device_train_batch_size": 8}, '
         '{"learning_rate": 3e-5, "weight_decay": 0.0, "per_device_train_batch_size": 8}]',)], "value string")
    ev = TR.policy_events(TR.parse_policy_lines(lines))
    got = sorted((r.learning_rate_change, r.weight_decay_change, r.batch_size_step)
                 for r in TR.policy_mutations(ev).collect())
    assert got == [("perturb_up", "perturb_down", 8), ("resample", "kept", 0)]


def test_trial_report_has_every_column(spark):
    df = spark.createDataFrame([("t", 1, 0.2, 0.9)], "trial_id string, training_iteration long, "
                                                      "eval_loss double, eval_f1_micro double")
    r = TR.trial_report(df, "multi_label_classification")
    assert r.columns == ["trial_id", "training_iteration", "batch_size", "learning_rate", "weight_decay", "num_train_epochs",
                         "loss", "f1_micro", "f1_macro", "precision_micro", "precision_macro", "recall_micro", "recall_macro"]
    row = r.first()
    assert (row.loss, row.f1_micro, row.precision_micro, row.batch_size) == (0.2, 0.9, None, None)


def test_missing_scores_never_win(spark):
    nan = float("nan")
    rows = [("m", "a", 1, 0.9), ("m", "b", 2, nan), ("m", "c", 3, None), ("m", "d", 4, 0.2), ("n", "e", 1, nan)]
    df = spark.createDataFrame(rows, "model string, trial_id string, timestamp long, objective double")
    for mode, best in (("max", "a"), ("min", "d")):
        got = {r.model: r for r in TR.best_trial(df, keep=["trial_id"], mode=mode).collect()}
        assert got["m"].trial_id == best and got["n"].objective is None


def test_running_best_on_any_partitioning(spark):
    from labelforge.operators.positions import running_max_and_lag
    nan = float("nan")
    values = [1.0, nan, 0.5, None, 2.0, nan, 1.5]
    df = spark.createDataFrame([("t", i, v) for i, v in enumerate(values)], "g string, i long, v double")
    want = [(1.0, None), (1.0, 1.0), (1.0, None), (1.0, 0.5), (2.0, None), (2.0, 2.0), (2.0, None)]
    for method in ("window", "arrow"):
        for parts in (1, 2, 4):
            out = running_max_and_lag(df, "g", ["i"], "v", num_partitions=parts, method=method).orderBy("i").collect()
            assert [(r.best_so_far, r.prev_value) for r in out] == want, (method, parts)


def test_widths_and_null_vectors(spark):
    import pytest
    ragged = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0, 3.0]), (2, None)], "label int, v array<double>")
    with pytest.raises(V.WidthError):
        V.vector_dim(ragged, "v")
    with pytest.raises(Exception, match="another width"):
        V.label_prototypes(ragged, "v", "label", 2).collect()
    protos = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "label_idx long, vec array<double>")
    rows = spark.createDataFrame([(1, [3.0, 0.0]), (2, None)], "id long, v array<double>")
    lm = V.LabelMatrix(protos)
    assert {r.id: r.p for r in rows.select("id", lm.nearest(F.col("v")).alias("p")).collect()} == {1: 0, 2: None}
    with pytest.raises(Exception, match="WidthError"):
        ragged.select(lm.scores(F.col("v"))).collect()


def test_arrow_and_sql_paths_agree_and_size_check(spark):
    import pytest
    protos = spark.createDataFrame([(0, [1.0, 0.0], 0.5), (1, [1.0, 0.0], 0.0), (2, [0.0, 2.0], -1.0)],
                                   "label_idx long, vec array<double>, b double")
    rows = spark.createDataFrame([(1, [3.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0])], "id long, v array<double>")
    lm = V.LabelMatrix(protos, bias_col="b")
    a = {(r.id, r.label_idx): round(r.score, 9) for r in lm.long_form(rows, "id", "v", "attended").collect()}
    w = F.col("_lf_labels")
    s = V.attach_labels(rows, protos, extra=["b"]).select(
        "id", F.arrays_zip(F.transform(w, lambda x: x["label_idx"]).alias("label_idx"),
                           V.label_attended_scores(F.col("v"), w).alias("score")).alias("z"))
    b = {(r.id, r.label_idx): round(r.score, 9) for r in s.select("id", F.inline("z")).collect()}
    assert a == b
    near = rows.select("id", lm.nearest(F.col("v")).alias("p")).collect()
    assert {r.id: r.p for r in near} == {1: 0, 2: 0, 3: 0}
    # blocks of one label vector each score as one matrix does
    blocks = V.LabelMatrix(protos, bias_col="b", block_bytes=16)
    assert len(blocks._blocks) == 3
    c = {(r.id, r.label_idx): round(r.score, 9) for r in blocks.long_form(rows, "id", "v", "attended").collect()}
    assert c == a
    with pytest.raises(ValueError):
        V.folded_labels(protos, block_bytes=16)
