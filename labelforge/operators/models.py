"""Model-side operators: a distributed multi-label text classifier (spark.ml),
batch prediction, zero-shot pair scoring, the polarity collapse, a 2-D
projection of embeddings and a seeded hyper-parameter search."""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import IDF, PCA, HashingTF, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelforge.functions.labels import decode_multi_hot, python_list_text, threshold_scores
from labelforge.functions.text import overlap_score_sets, token_set
from labelforge.operators import metrics as M


# V7 -------------------------------------------------------------------------
@dataclass
class TextClassifier:
    """TF-IDF features + one logistic regression per label (binary relevance)."""
    features: PipelineModel
    per_label: list[LogisticRegressionModel]
    text_col: str

    def scores(self, df: DataFrame, name: str = "scores") -> DataFrame:
        """Adds ``scores``: array<double> of P(label) per label, label order."""
        out = self.features.transform(df)
        cols = []
        for c, m in enumerate(self.per_label):
            m = m.copy()
            m.setProbabilityCol(f"_lf_p{c}").setRawPredictionCol(f"_lf_r{c}").setPredictionCol(f"_lf_y{c}")
            out = m.transform(out)
            cols.append(vector_to_array(F.col(f"_lf_p{c}"))[1])
        drop = [f"_lf_{k}{c}" for c in range(len(self.per_label)) for k in "pry"]
        return out.withColumn(name, F.array(*cols)).drop("_lf_tok", "_lf_tf", "_lf_features", *drop)


def text_features(text_col: str, num_features: int = 1 << 18) -> Pipeline:
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text_col, outputCol="_lf_tok", pattern="\\s+", toLowercase=True),
        HashingTF(inputCol="_lf_tok", outputCol="_lf_tf", numFeatures=num_features),
        IDF(inputCol="_lf_tf", outputCol="_lf_features"),
    ])


def fit_text_classifier(train: DataFrame, text_col: str, label_col: str, n_labels: int,
                        num_features: int = 1 << 18, max_iter: int = 20,
                        reg_param: float = 0.0) -> TextClassifier:
    """Fit on the training rows. A target y between 0 and 1 counts as class 1
    with weight y and as class 0 with weight 1 - y, so fractional labels are
    fitted as they are; rows whose label is null or NaN are left out of that
    label's fit. The featurised training set is persisted (memory, spilling to
    disk) because each label's fit scans it; a lost block is recomputed from
    its lineage."""
    feats = text_features(text_col, num_features).fit(train)
    ftrain = feats.transform(train).select("_lf_features", label_col).persist(StorageLevel.MEMORY_AND_DISK)
    models = []
    try:
        for c in range(n_labels):
            lr = LogisticRegression(featuresCol="_lf_features", labelCol="_lf_target", weightCol="_lf_weight",
                                    maxIter=max_iter, regParam=reg_param)
            models.append(lr.fit(weighted_targets(ftrain, F.col(label_col)[c])))
    finally:
        ftrain.unpersist()
    return TextClassifier(feats, models, text_col)


def weighted_targets(df: DataFrame, target: Column) -> DataFrame:
    """(_lf_features, _lf_target, _lf_weight): one row of each class that the target has a share of."""
    y = target.cast("double")
    both = F.array(F.struct(F.lit(1.0).alias("_lf_target"), y.alias("_lf_weight")),
                   F.struct(F.lit(0.0).alias("_lf_target"), (1.0 - y).alias("_lf_weight")))
    out_of_range = F.raise_error(F.concat(F.lit("a label outside 0 to 1: "), y.cast("string"))).cast("double")
    checked = F.when(y.between(0, 1), y).otherwise(out_of_range)
    return (df.where(y.isNotNull() & ~F.isnan(y)).select("_lf_features", F.inline(F.transform(
        both, lambda r: F.struct(r["_lf_target"].alias("_lf_target"), F.when(checked >= 0, r["_lf_weight"]).alias("_lf_weight")))))
        .where("_lf_weight > 0"))


# V8 -------------------------------------------------------------------------
def predict_labels(model: TextClassifier, df: DataFrame, label_names: list[str],
                   cut: float = 0.5) -> DataFrame:
    """scores → 0/1 (strict > cut) → label names → printable list text."""
    scored = model.scores(df)
    pred = threshold_scores(F.col("scores"), cut)
    return (scored.withColumn("pred", pred)
                  .withColumn("pred_names", decode_multi_hot(F.col("pred"), label_names))
                  .withColumn("prediction", python_list_text(F.col("pred_names"))))


# V9 -------------------------------------------------------------------------
def tfidf_cosine(pairs: DataFrame, premise: str = "Abstract", hypothesis: str = "Hypothesis",
                 num_features: int = 1 << 18) -> DataFrame:
    """``pairs`` with ``score``: the cosine of the TF-IDF vectors of premise and
    hypothesis (white-space tokens, lower case; 0 where a side has none).

    Tokens are hashed into ``num_features`` places, so the document frequencies
    - counted over the distinct premises - are a table of bounded size that
    goes to the tasks; a batch of pairs is then scored in one Arrow pass.
    """
    place = lambda t: F.pmod(F.xxhash64(t), F.lit(num_features)).cast("int")

    def places(c: str) -> Column:
        words = F.filter(F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), "\\s+"), lambda w: w != "")
        return F.transform(words, place)
    texts = pairs.select(premise).distinct()
    n = texts.count()
    counts = (texts.select(F.explode(F.array_distinct(places(premise))).alias("k")).groupBy("k")
              .agg(F.count(F.lit(1)).alias("n")).collect())                # at most num_features rows
    idf = np.full(num_features, np.log(n + 1.0))
    for r in counts:
        idf[r.k] = np.log((n + 1.0) / (r.n + 1.0))

    @F.pandas_udf("double")
    def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            (kx, nx), (ky, ny) = (np.unique(np.asarray(v, dtype=np.int64), return_counts=True) for v in (x, y))
            wx, wy = nx * idf[kx], ny * idf[ky]
            _, i, j = np.intersect1d(kx, ky, assume_unique=True, return_indices=True)
            norm = np.sqrt((wx * wx).sum() * (wy * wy).sum())
            out.append(float((wx[i] * wy[j]).sum() / norm) if norm else 0.0)
        return pd.Series(out)

    return pairs.withColumn("score", cosine(places(premise), places(hypothesis)))


def zero_shot_scores(pairs: DataFrame, premise: str = "Abstract", hypothesis: str = "Hypothesis",
                     label: str = "Entailment", premise_set: str | None = None,
                     scorer: Callable[[DataFrame], DataFrame] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Pair scores s in 0..1; logits [1 - s, s]; entailment = argmax (ties → not
    entailed). ``scorer`` takes the pairs and adds a ``score`` column, e.g.
    ``tfidf_cosine`` or a wrapped model; the built-in one is the share of
    hypothesis tokens found in the premise. ``keep``: further columns to carry.

    Pass ``premise_set`` (a column of ``token_set(premise)`` computed before
    the hypothesis expansion) so a premise is tokenised once, not once per
    hypothesis.
    """
    if scorer is not None:
        staged, s = scorer(pairs), F.col("score")
    else:
        p = F.col(premise_set) if premise_set else token_set(F.col(premise))
        staged = pairs.withColumn("_lf_h", token_set(F.col(hypothesis)))
        s = overlap_score_sets(p, F.col("_lf_h"))
    out = staged.select("PMID", *keep, "Label_idx", "Positive", F.col(label).alias("label"), s.alias("score"))
    return out.withColumn("pred", F.when(F.col("score") > 1 - F.col("score"), 1).otherwise(0))


# V11 ------------------------------------------------------------------------
def nli_collapse(scored: DataFrame, score_col: str = "score") -> DataFrame:
    """Positive and negative hypothesis of one label → one decision:
    margin = score(positive) − score(negative); decided when margin > 0.

    A ``premise`` column tells several documents of one id apart: each gets its
    own decisions. Rows that repeat (the same document twice) count once."""
    keys = [c for c in ("PMID", "premise", "Label_idx") if c in scored.columns]
    side = [F.avg(F.when(p, F.col(score_col))) for p in (F.col("Positive"), ~F.col("Positive"))]
    any_score = F.count(F.when(F.col("Positive").isNotNull(), F.col(score_col))) > 0
    margin = F.when(any_score, F.coalesce(side[0], F.lit(0.0)) - F.coalesce(side[1], F.lit(0.0)))
    return scored.groupBy(*keys).agg(margin.alias("margin")).withColumn("decision", F.col("margin") > 0)


# V10 ------------------------------------------------------------------------
def project_2d(df: DataFrame, key: str, vec_col: str, label_col: str, n_labels: int,
               limits: tuple[tuple[float, float], tuple[float, float]] | None = None) -> DataFrame:
    """PCA to 2-D, then one panel per label: (key, panel, x, y, is_positive).
    Every row is projected; only a caller that gives axis limits ((x low, x
    high), (y low, y high)) gets the points inside them. Rows without a vector
    are left out. The covariance is d×d, so the driver-side part is bounded by
    the vector width."""
    df = df.where(F.col(vec_col).isNotNull())
    vecs = df.select(key, label_col, array_to_vector(F.col(vec_col).cast("array<double>")).alias("_lf_v"))
    pca = PCA(k=2, inputCol="_lf_v", outputCol="_lf_xy").fit(vecs)
    xy = pca.transform(vecs).select(key, label_col, vector_to_array("_lf_xy").alias("_lf_xy"))
    panels = xy.select(key, F.col("_lf_xy")[0].alias("x"), F.col("_lf_xy")[1].alias("y"),
                       F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(n_labels - 1)),
                                                lambda i: i == F.col(label_col))).alias("panel", "is_positive"))
    if limits is None:
        return panels
    (xlo, xhi), (ylo, yhi) = limits
    return panels.filter(F.col("x").between(xlo, xhi) & F.col("y").between(ylo, yhi))


# T3 -------------------------------------------------------------------------
@dataclass
class SearchSpace:
    reg_param: tuple[float, float] = (0.0, 0.3)       # uniform (weight decay)
    elastic_net: tuple[float, float] = (0.0, 0.5)     # uniform
    max_iter: tuple[int, ...] = (5, 10, 20)           # choice (epochs)


def draw_trials(space: SearchSpace, n_trials: int, seed: int = 42) -> list[dict]:
    rnd = random.Random(seed)
    return [{"trial": i,
             "regParam": rnd.uniform(*space.reg_param),
             "elasticNetParam": rnd.uniform(*space.elastic_net),
             "maxIter": rnd.choice(space.max_iter)} for i in range(n_trials)]


#: Columns of a search's result besides the parameters; ``objective`` is the sum of the seven quality values.
SEARCH_METRICS = ["eval_loss", *M.MULTI_LABEL_KEYS, "combined_score", "objective"]


def param_search(train: DataFrame, valid: DataFrame, text_col: str, label_col: str, n_labels: int,
                 trials: list[dict], metric: str = "objective", mode: str | None = None,
                 num_features: int = 1 << 18, parallelism: int = 2) -> DataFrame:
    """One distributed fit per trial and label on shared features, scored on
    the validation rows over all labels; a row per trial with its parameters
    and ``SEARCH_METRICS``, the best by ``metric`` and ``mode`` (``min`` for a
    loss, else ``max``) marked. A missing metric never is the best. Features of
    both sides are computed once and persisted."""
    if metric not in SEARCH_METRICS:
        raise ValueError(f"unknown metric {metric!r}; one of {SEARCH_METRICS}")
    mode = mode or ("min" if metric.endswith("loss") else "max")
    feats = text_features(text_col, num_features).fit(train)
    ftrain, fvalid = (feats.transform(d).select("_lf_features", F.col(label_col).cast("array<double>").alias("label"))
                      .persist(StorageLevel.MEMORY_AND_DISK) for d in (train, valid))

    def run(t: dict) -> tuple:
        models = []
        for c in range(n_labels):
            lr = LogisticRegression(featuresCol="_lf_features", labelCol="_lf_target", weightCol="_lf_weight",
                                    regParam=t["regParam"], elasticNetParam=t["elasticNetParam"], maxIter=t["maxIter"])
            models.append(lr.fit(weighted_targets(ftrain, F.col("label")[c])))
        scored = TextClassifier(PipelineModel([]), models, text_col).scores(fvalid, "logits")
        p = F.transform("logits", lambda x: F.least(F.greatest(x, F.lit(1e-12)), F.lit(1 - 1e-12)))
        entropy = F.zip_with(p, "label", lambda a, y: -(y * F.log(a) + (1 - y) * F.log(1 - a)))
        loss = scored.select(F.explode(entropy).alias("e")).agg(F.avg("e").alias("eval_loss")).first()[0]
        quality = M.multi_label_metrics(scored, n_labels).first()
        values = [quality[k] for k in [*M.MULTI_LABEL_KEYS, "combined_score"]]
        return (t["trial"], float(t["regParam"]), float(t["elasticNetParam"]), int(t["maxIter"]), loss, *values,
                float(sum(v for v in values if v is not None)))

    from multiprocessing.pool import ThreadPool
    try:
        # trials are independent distributed fits: up to `parallelism` of them are submitted at once
        with ThreadPool(max(1, min(parallelism, len(trials)))) as pool:
            rows = pool.map(run, trials)
    finally:
        ftrain.unpersist()
        fvalid.unpersist()
    names = ["eval_loss", *M.MULTI_LABEL_KEYS, "combined_score", "objective"]
    out = train.sparkSession.createDataFrame(rows, "trial long, regParam double, elasticNetParam double, maxIter int, "
                                             + ", ".join(f"{n} double" for n in names))
    known = [(r[4 + names.index(metric)], r[0]) for r in rows if r[4 + names.index(metric)] is not None]
    pick = (max if mode == "max" else min)(known, key=lambda v: (v[0], -v[1] if mode == "max" else v[1]))[1] if known else None
    return out.withColumn("is_best", F.coalesce(F.col("trial") == F.lit(pick).cast("long"), F.lit(False)))
