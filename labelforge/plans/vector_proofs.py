"""Proof queries: vectors and label attention over ``embeddings`` (V1-V6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelforge.operators import vectors as V
from labelforge.plans import standins as S
from labelforge.plans.registry import proof

VEC_SQL = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"
PROTOS_SQL = ("SELECT label AS label_idx, list(m ORDER BY i) AS vec FROM ("
              f"SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, "
              "range(1, (SELECT max(len(embedding)) FROM embeddings) + 1) r(i) GROUP BY label, i) t "
              "GROUP BY label")
NORM_SQL = "greatest(sqrt(list_dot_product({v}, {v})), 1e-8)"
COS_SQL = ("list_dot_product(e.v, p.vec) / (" + NORM_SQL.format(v="e.v") + " * "
           + NORM_SQL.format(v="p.vec") + ")")
PAIRS_SQL = (f"SELECT e.vec_id, e.label, CAST(p.label_idx AS BIGINT) AS label_idx, {COS_SQL} AS cosine, "
             "list_dot_product(e.v, p.vec) - 0.5 * list_dot_product(p.vec, p.vec) AS linear "
             f"FROM (SELECT vec_id, label, {VEC_SQL} AS v FROM embeddings) e, ({PROTOS_SQL}) p")


def _emb(spark, d):
    return S.table(spark, d, "embeddings")


def _protos(spark, d):
    emb = _emb(spark, d)
    return V.label_prototypes(emb, "embedding", "label", V.vector_dim(emb, "embedding"))


def _weights(spark, d):
    # nearest-centroid linear layer: w = prototype, b = -|prototype|² / 2
    p = _protos(spark, d)
    return p.withColumn("b", -0.5 * F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))


@proof("vector_norms",
       f"SELECT vec_id, round({NORM_SQL.format(v=VEC_SQL)}, 6) AS norm FROM embeddings")
def vector_norms(spark, d):
    emb = _emb(spark, d)
    return emb.select("vec_id", F.round(V.vector_norms(emb, "embedding"), 6).alias("norm"))


@proof("label_prototypes",
       "SELECT CAST(label_idx AS INTEGER) AS label_idx, list_transform(vec, lambda x: round(x, 6)) AS vec "
       f"FROM ({PROTOS_SQL}) p")
def label_prototypes(spark, d):
    return _protos(spark, d).select("label_idx", F.transform("vec", lambda x: F.round(x, 6)).alias("vec"))


@proof("label_prototypes_exploded",
       "SELECT CAST(label_idx AS INTEGER) AS label_idx, list_transform(vec, lambda x: round(x, 6)) AS vec "
       f"FROM ({PROTOS_SQL}) p")
def label_prototypes_exploded(spark, d):
    # the width-free path (positions exploded, then averaged)
    p = V.label_prototypes(_emb(spark, d), "embedding", "label")
    return p.select("label_idx", F.transform("vec", lambda x: F.round(x, 6)).alias("vec"))


@proof("cosine_label_matrix",
       f"SELECT vec_id, label_idx, round(cosine, 6) AS cosine FROM ({PAIRS_SQL}) x")
def cosine_label_matrix(spark, d):
    m = V.cosine_label_matrix(_emb(spark, d), "vec_id", "embedding", _protos(spark, d))
    return m.select("vec_id", "label_idx", F.round("cosine", 6).alias("cosine"))


@proof("cosine_label_matrix_sql",
       f"SELECT vec_id, label_idx, round(cosine, 6) AS cosine FROM ({PAIRS_SQL}) x")
def cosine_label_matrix_sql(spark, d):
    # built-in higher-order functions only (no Python), label fold by scalar subquery
    m = V.cosine_label_matrix(_emb(spark, d), "vec_id", "embedding", _protos(spark, d), method="sql")
    return m.select("vec_id", "label_idx", F.round("cosine", 6).alias("cosine"))


def class_logits(spark, d):
    """vec_id, label and the linear score of every class (whole vectors)."""
    lm = V.LabelMatrix(_weights(spark, d), bias_col="b")
    return _emb(spark, d).select("vec_id", "label", lm.scores(F.col("embedding"), "linear").alias("logits"))


LOGITS_SQL = f"SELECT vec_id, any_value(label) AS label, list(linear ORDER BY label_idx) AS logits FROM ({PAIRS_SQL}) x GROUP BY vec_id"


def _long(spark, d, kind):
    lm = V.LabelMatrix(_weights(spark, d), bias_col="b")
    out = lm.long_form(_emb(spark, d), "vec_id", "embedding", kind, "score")
    return out.select("vec_id", "label_idx", F.round("score", 6).alias("score"))


@proof("linear_scores",
       f"SELECT vec_id, label_idx, round(linear, 6) AS score FROM ({PAIRS_SQL}) x")
def linear_scores(spark, d):
    return _long(spark, d, "linear")


@proof("label_attended_scores",
       f"SELECT vec_id, label_idx, round(linear * cosine, 6) AS score FROM ({PAIRS_SQL}) x")
def label_attended_scores(spark, d):
    return _long(spark, d, "attended")


@proof("label_attended_scores_sql",
       f"SELECT vec_id, label_idx, round(linear * cosine, 6) AS score FROM ({PAIRS_SQL}) x")
def label_attended_scores_sql(spark, d):
    w = F.col("_lf_labels")
    emb = V.attach_labels(_emb(spark, d), _weights(spark, d), extra=["b"])
    out = emb.select("vec_id", F.arrays_zip(
        F.transform(w, lambda x: x["label_idx"]).alias("label_idx"),
        V.label_attended_scores(F.col("embedding"), w).alias("score")).alias("z"))
    return out.select("vec_id", F.inline_outer("z")).select(
        "vec_id", "label_idx", F.round("score", 6).alias("score"))


NEAREST_SQL = ("SELECT vec_id, label, CAST(arg_max(label_idx, cosine * 1e12 - label_idx) AS BIGINT) AS pred "
               f"FROM ({PAIRS_SQL}) x GROUP BY vec_id, label")


@proof("nearest_label", NEAREST_SQL)
def nearest_label(spark, d):
    lm = V.LabelMatrix(_protos(spark, d))
    return _emb(spark, d).select("vec_id", "label", lm.nearest(F.col("embedding")).alias("pred"))


@proof("nearest_label_sql", NEAREST_SQL)
def nearest_label_sql(spark, d):
    emb = V.attach_labels(_emb(spark, d), _protos(spark, d))
    return emb.select("vec_id", "label",
                      V.nearest_label(F.col("embedding"), F.col("_lf_labels")).alias("pred"))


@proof("nearest_label_accuracy",
       "SELECT round(avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM ("
       f"{NEAREST_SQL}) n")
def nearest_label_accuracy(spark, d):
    n = nearest_label(spark, d)
    return n.agg(F.round(F.avg((F.col("pred") == F.col("label")).cast("double")), 6).alias("accuracy"))
