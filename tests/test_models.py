"""Value checks of the model operators that have no SQL oracle."""
import math

import numpy as np
import pytest
from conftest import SF001
from pyspark.sql import functions as F

import __spark_entry__ as E
from labelforge.functions.labels import python_list_text
from labelforge.operators import models as MD


def test_fractional_and_missing_labels(spark):
    rows = [("a", [0.7])] * 10 + [("b", [None])] * 5 + [("b", [0.1])] * 10 + [("b", [float("nan")])] * 3
    df = spark.createDataFrame(rows, "t string, y array<double>")
    model = MD.fit_text_classifier(df, "t", "y", 1, num_features=1024)
    got = {r.t: r.scores[0] for r in model.scores(df).select("t", "scores").distinct().collect()}
    assert math.isclose(got["a"], 0.7, abs_tol=1e-3) and math.isclose(got["b"], 0.1, abs_tol=1e-3)
    with pytest.raises(Exception, match="outside 0 to 1"):
        MD.fit_text_classifier(spark.createDataFrame([("a", [1.5]), ("b", [0.0])], "t string, y array<double>"), "t", "y", 1)


def test_predictions_are_the_thresholded_scores(spark):
    q = E.queries()
    scores = {r.PMID: r.scores for r in q["fit_text_classifier"](spark, SF001).where("split_name = 'test'").collect()}
    names = ["quality", "toxic"]
    want = [str([n for n, s in zip(names, scores[k]) if s > 0.5]) for k in sorted(scores)]
    got = [r.prediction for r in q["predict_labels"](spark, SF001).orderBy("index").collect()]
    assert got == want
    assert all(0 <= s <= 1 for v in scores.values() for s in v)


def test_projection_keeps_every_row_and_the_variance(spark):
    emb = spark.read.parquet(f"{SF001}/embeddings.parquet")
    out = E.queries()["project_2d"](spark, SF001)
    assert out.count() == 10 * emb.count()
    xy = np.array([(r.x, r.y) for r in out.where("panel = 0").collect()])
    x = np.array([r.embedding for r in emb.collect()], float)
    top = np.linalg.eigvalsh(np.cov(x.T))[::-1][:2]
    assert np.allclose(xy.var(axis=0, ddof=1), top, rtol=1e-6)
    assert out.where("is_positive").count() == emb.count()
    assert MD.project_2d(emb, "vec_id", "embedding", "label", 10, limits=((0, 9), (0, 9))).count() < out.count()


def test_search_marks_the_best_by_the_metric(spark):
    rows = E.queries()["param_search"](spark, SF001).collect()
    assert len(rows) == 10 and sum(r.is_best for r in rows) == 1
    assert max(r.objective for r in rows) == next(r.objective for r in rows if r.is_best)
    r = rows[0]
    seven = [r.f1_micro, r.f1_macro, r.precision_micro, r.precision_macro, r.recall_micro, r.recall_macro, r.combined_score]
    assert math.isclose(r.objective, sum(seven)) and math.isclose(r.combined_score, sum(seven[:6]) / 6)
    df = spark.createDataFrame([("a b", [1.0]), ("c d", [0.0])] * 6, "t string, y array<double>")
    trials = MD.draw_trials(MD.SearchSpace(), 3)
    low = MD.param_search(df, df, "t", "y", 1, trials, metric="eval_loss", num_features=64).collect()
    assert min(r.eval_loss for r in low) == next(r.eval_loss for r in low if r.is_best)
    with pytest.raises(ValueError):
        MD.param_search(df, df, "t", "y", 1, trials, metric="nope")


def test_pair_scorers(spark):
    pairs = spark.createDataFrame([(1, 0, True, "the cat sat", "cat sat", 1.0), (2, 0, True, "dog", "cat", 0.0), (3, 0, True, None, "x", 0.0)],
                                  "PMID long, Label_idx long, Positive boolean, Abstract string, Hypothesis string, Entailment double")
    got = {r.PMID: r.score for r in MD.zero_shot_scores(pairs, scorer=MD.tfidf_cosine).collect()}
    assert 0.5 < got[1] <= 1 and got[2] == 0 and got[3] == 0
    constant = MD.zero_shot_scores(pairs, scorer=lambda p: p.withColumn("score", F.lit(0.9)))
    assert {r.pred for r in constant.collect()} == {1}


def test_list_text_as_python_prints_it(spark):
    names = ["plain", "Crohn's", 'say "x"', "both ' and \"", "back\\slash"]
    got = spark.createDataFrame([(names,)], "n array<string>").select(python_list_text(F.col("n"))).first()[0]
    assert got == str(names)
