"""Proof queries (rows-only): the spark.ml text classifier, batch prediction,
2-D projection and the seeded parameter search (V7, V8, V10, T3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelforge.operators import joint_fit as JF
from labelforge.operators import models as MD
from labelforge.operators import prepare as prep
from labelforge.operators import trials as TR
from labelforge.plans import standins as S
from labelforge.plans.registry import proof
from labelforge.session import work_path
from labelforge.sources import files as IO


def _binary(spark, d):
    return prep.build_binary(S.abstracts(spark, d), S.binary_labels(spark, d), S.SPEC, with_index=False)


def _fit(spark, d):
    b = _binary(spark, d)
    train = b.filter(F.col("split_name") == "train")
    return b, MD.fit_text_classifier(train, "Abstract", "label", len(S.LABELS))


@proof("fit_text_classifier")
def fit_text_classifier(spark, d):
    """Fit on train, score validation and test: (PMID, split, scores)."""
    b, model = _fit(spark, d)
    held_out = b.filter(F.col("split_name").isin("validation", "test"))
    scored = model.scores(held_out)
    return scored.select("PMID", "split_name", F.transform("scores", lambda x: F.round(x, 6)).alias("scores"))


@proof("predict_labels")
def predict_labels(spark, d):
    """Model → scores → 0/1 → names → ``index<TAB>prediction`` file → read back."""
    from labelforge.operators.positions import with_row_index
    b, model = _fit(spark, d)
    test = b.filter(F.col("split_name") == "test")
    pred = MD.predict_labels(model, test, S.LABELS)
    out = with_row_index(pred.select("PMID", "prediction"), ["PMID"], "index")
    path = work_path(spark, "predict-results")
    IO.write_predictions(out, path)
    return IO.read_predictions(spark, path)


@proof("project_2d")
def project_2d(spark, d):
    emb = S.table(spark, d, "embeddings")
    return MD.project_2d(emb, "vec_id", "embedding", "label", 10)


@proof("param_search")
def param_search(spark, d):
    b = _binary(spark, d)
    train = b.filter(F.col("split_name") == "train")
    valid = b.filter(F.col("split_name") == "validation")
    return MD.param_search(train, valid, "Abstract", "label", len(S.LABELS), MD.draw_trials(MD.SearchSpace(), n_trials=10))


@proof("fit_joint")
def fit_joint(spark, d):
    """Every label and several penalties from the same scans: scores of validation and test by the first trial."""
    b = _binary(spark, d)
    train = b.filter(F.col("split_name") == "train")
    model = JF.fit_joint(train, "Abstract", "label", len(S.LABELS), [0.01, 0.1], passes=12)
    scored = model.scores(b.filter(F.col("split_name").isin("validation", "test")), "Abstract")
    return scored.select("PMID", "split_name", F.transform("scores", lambda x: F.round(x, 6)).alias("scores"))


def _population(spark, d):
    b = _binary(spark, d)
    train, valid = (b.filter(F.col("split_name") == s) for s in ("train", "validation"))
    return JF.population_search(train, valid, "Abstract", "label", len(S.LABELS), n_trials=4, generations=3, passes=4)


@proof("population_search")
def population_search(spark, d):
    """A row a generation and trial: penalty and validation loss."""
    results, _, _ = _population(spark, d)
    return results.select("generation", "trial", F.round("regParam", 9).alias("regParam"), F.round("eval_loss", 6).alias("eval_loss"))


@proof("population_mutations")
def population_mutations(spark, d):
    """T5 and T6 on the search's own policy log."""
    _, policy, _ = _population(spark, d)
    return TR.policy_mutations(TR.policy_events(TR.parse_policy_lines(policy))).select(
        "target_tag", "source_tag", "target_iter", "source_iter", "weight_decay_change")
