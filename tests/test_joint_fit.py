"""All labels and trials in one scan: equal to fits one by one, and the population search."""
import numpy as np
import pytest
from conftest import SF001
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from labelforge.operators import joint_fit as J
from labelforge.operators import trials as TR
from labelforge.plans import model_proofs


def corpus(n=160, seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        words = rng.integers(0, 25, rng.integers(0, 15))
        y = [float(3 in words), float(np.clip(0.2 + 0.6 * (7 in words) + rng.normal(0, 0.05), 0, 1)), float(words.sum() % 2)]
        if i % 9 == 0:
            y[1] = None
        rows.append((" ".join(f"w{w}" for w in words), y))
    return [*rows, (None, [0.0, 1.0, 0.0]), ("w1 w2", None)]


def test_equal_to_fits_one_by_one(spark):
    df = spark.createDataFrame(corpus(), "t string, y array<double>").repartition(3)
    rows = J.prepare(df, "t", "y", 3, num_features=64)
    penalties = [0.01, 0.1]
    joint = J.optimise(J.start(rows, penalties), 200, 1e-9)
    model = J.model_of(joint)
    pdf = rows.table.toPandas()
    r, p, v = J._sparse(pdf.places, rows.weights)
    x = np.zeros((len(pdf), 64))
    x[r, p] = v
    y = J._targets(pdf.y, 3)
    for t, penalty in enumerate(penalties):
        for c in range(3):
            held = [(Vectors.dense(a), label, w) for a, b in zip(x, y[:, c]) if not np.isnan(b) for label, w in ((1.0, float(b)), (0.0, 1 - float(b))) if w > 0]
            # the spread of all rows, as the joint fit has it: features divided by it, no further standardisation
            frame = spark.createDataFrame([(Vectors.dense(a.toArray() / joint.std), label, w) for a, label, w in held], ["features", "label", "w"])
            one = LogisticRegression(weightCol="w", regParam=penalty, maxIter=300, tol=1e-12, standardization=False).fit(frame)
            k = t * 3 + c
            assert np.abs(one.coefficients.toArray() / joint.std - model.coefficients[:, k]).max() < 1e-4
            assert abs(one.intercept - model.intercepts[k]) < 1e-4


def test_passes_do_not_depend_on_labels_and_trials(spark):
    df = spark.createDataFrame(corpus(), "t string, y array<double>")
    rows = J.prepare(df, "t", "y", 3, num_features=64)
    few, many = (J.optimise(J.start(rows, p), 12, 0.0) for p in ([0.1], [0.3, 0.1, 0.03, 0.01]))
    assert few.passes == many.passes == 12
    assert np.allclose(few.w, many.w[:, 3:6], atol=1e-8)


def test_scores_and_bounds(spark, monkeypatch):
    df = spark.createDataFrame(corpus(), "t string, y array<double>")
    model = J.fit_joint(df, "t", "y", 3, [0.1, 0.001], passes=30, num_features=64)
    out = model.scores(df, "t", trial=1).collect()
    assert len(out) == 162 and all(len(r.scores) == 3 and all(0 < s < 1 for s in r.scores) for r in out)
    caught = [(r.scores[0] > 0.5) == (r.y[0] == 1.0) for r in out if r.y and r.t]
    assert np.mean(caught) > 0.95
    with pytest.raises(ValueError, match="outside 0 to 1"):
        J.prepare(spark.createDataFrame([("a", [1.5])], "t string, y array<double>"), "t", "y", 1, 16)
    monkeypatch.setattr(J, "MAX_CELLS", 100)
    with pytest.raises(ValueError, match="coefficients"):
        J.fit_joint(df, "t", "y", 3, [0.1], num_features=64)


def test_population_search_writes_a_policy_log(spark):
    b = model_proofs._binary(spark, SF001)
    train, valid = (b.where(f"split_name = '{s}'") for s in ("train", "validation"))
    results, policy, _ = J.population_search(train, valid, "Abstract", "label", 2, n_trials=4, generations=3, passes=4, num_features=1 << 10)
    assert results.count() == 12
    last, first = (results.where(f"generation = {g}").agg(F.min("eval_loss")).first()[0] for g in (2, 0))
    assert last <= first + 1e-9
    events = TR.policy_events(TR.parse_policy_lines(policy))
    kinds = {r.weight_decay_change for r in TR.policy_mutations(events).collect()}
    assert events.count() == 2 and kinds <= {"perturb_down", "perturb_up", "resample"}


def test_tasks_work_on_bounded_slices(spark, monkeypatch):
    import pandas as pd
    given, sparse = [], J._sparse
    rng = np.random.default_rng(0)
    places = pd.Series([rng.integers(0, 64, n, dtype=np.int32) for n in [3, 0, J.ENTRIES + 1, *[5000] * 60]])
    places[1] = None
    assert [i for s in J._slices(places) for i in range(s.start, s.stop)] == list(range(len(places)))
    model = J.JointModel(rng.normal(size=(64, 2)), np.zeros(2), np.full(64, 0.01), 2)
    udfs = []
    monkeypatch.setattr(J.F, "pandas_udf", lambda t: lambda f: udfs.append(f) or (lambda c: c))
    model.scores(spark.createDataFrame([("a",)], "t string"), "t")
    monkeypatch.undo()
    monkeypatch.setattr(J, "_sparse", lambda places, weights: given.append(sum(len(p) for p in places if p is not None)) or sparse(places, weights))
    got = np.stack(udfs[0](places))
    assert len(given) > 4 and sorted(given)[-2] <= J.ENTRIES and max(given) == J.ENTRIES + 1
    row, place, value = sparse(places, model.weights)
    z = np.zeros((len(places), 2))
    np.add.at(z, row, model.coefficients[place] * value[:, None])
    assert np.allclose(got, 1 / (1 + np.exp(-z)))


def test_partial_sums_go_by_groups_of_tasks(spark, monkeypatch):
    df = spark.createDataFrame(corpus(400), "t string, y array<double>")
    rows = J.prepare(df.repartition(7), "t", "y", 3, num_features=64)
    one = J.start(J.Rows(rows.table.coalesce(1), rows.weights, 3), [0.1])
    monkeypatch.setattr(J, "FAN_IN", 2)
    monkeypatch.setattr(J, "ENTRIES", 50)
    many = J.start(J.Rows(rows.table.repartition(7), rows.weights, 3), [0.1])
    w = np.random.default_rng(1).normal(size=one.w.shape)
    for a, b in zip(one.evaluate(w, one.b), many.evaluate(w, many.b)):
        assert np.allclose(a, b, rtol=1e-10, atol=1e-12)
    assert np.allclose(one.std, many.std)
