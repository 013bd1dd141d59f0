"""Proof queries: metrics, aggregates, score functions and prediction sinks
(M1-M10, A1-A5, F8-F11, S11, S12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelforge.functions import labels as L
from labelforge.operators import metrics as M
from labelforge.plans import standins as S
from labelforge.plans.registry import proof
from labelforge.plans.vector_proofs import LOGITS_SQL, class_logits

C = len(S.LABELS)
R6 = 6

# SQL pieces over the scored stand-in ----------------------------------------
PRED_SQL = ("list_transform(logits, lambda x: CASE WHEN x > 0.5 AND NOT isnan(x) "
            "THEN 1 ELSE 0 END)::INTEGER[]")
COUNTS_SQL = (
    "SELECT CAST(i - 1 AS BIGINT) AS label_idx, "
    "CAST(sum(CASE WHEN p[i] = 1 AND y[i] = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp, "
    "CAST(sum(CASE WHEN p[i] = 1 AND coalesce(y[i] <> 1, true) THEN 1 ELSE 0 END) AS BIGINT) AS fp, "
    "CAST(sum(CASE WHEN p[i] <> 1 AND y[i] = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn "
    f"FROM (SELECT {PRED_SQL} AS p, label AS y FROM ({S.SCORED_SQL}) s) q, "
    f"range(1, {C + 1}) r(i) GROUP BY i")
PER_LABEL_SQL = (
    "SELECT label_idx, tp, fp, fn, "
    "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, "
    "CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall, "
    "CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1 "
    f"FROM ({COUNTS_SQL}) c")
SUMMARY_SQL = (
    "SELECT CASE WHEN 2 * sum(tp) + sum(fp) + sum(fn) > 0 THEN 2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) ELSE 0.0 END AS f1_micro, "
    "avg(f1) AS f1_macro, "
    "CASE WHEN sum(tp) + sum(fp) > 0 THEN sum(tp) / (sum(tp) + sum(fp)) ELSE 0.0 END AS precision_micro, "
    "avg(precision) AS precision_macro, "
    "CASE WHEN sum(tp) + sum(fn) > 0 THEN sum(tp) / (sum(tp) + sum(fn)) ELSE 0.0 END AS recall_micro, "
    "avg(recall) AS recall_macro "
    f"FROM ({PER_LABEL_SQL}) pl")
ALL_SQL = ("SELECT *, (f1_micro + f1_macro + precision_micro + precision_macro + recall_micro "
           f"+ recall_macro) / 6 AS combined_score FROM ({SUMMARY_SQL}) s")


def _rounded(df, digits=R6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c)
                       for c, t in df.dtypes])


def _counts(spark, d):
    return M.confusion_counts(M.with_predictions(S.scored(spark, d)), C)


@proof("metrics_per_label",
       "SELECT label_idx, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, "
       f"round(f1, 6) AS f1 FROM ({PER_LABEL_SQL}) p")
def metrics_per_label(spark, d):
    return _rounded(M.per_label(_counts(spark, d)))


@proof("metrics_micro",
       "SELECT round(f1_micro, 6) AS f1_micro, round(precision_micro, 6) AS precision_micro, "
       f"round(recall_micro, 6) AS recall_micro FROM ({SUMMARY_SQL}) s")
def metrics_micro(spark, d):
    return _rounded(M.summary(_counts(spark, d)).select(
        "f1_micro", "precision_micro", "recall_micro"))


@proof("metrics_macro",
       "SELECT round(f1_macro, 6) AS f1_macro, round(precision_macro, 6) AS precision_macro, "
       f"round(recall_macro, 6) AS recall_macro FROM ({SUMMARY_SQL}) s")
def metrics_macro(spark, d):
    return _rounded(M.summary(_counts(spark, d)).select(
        "f1_macro", "precision_macro", "recall_macro"))


@proof("metrics_combined", f"SELECT round(combined_score, 6) AS combined_score FROM ({ALL_SQL}) a")
def metrics_combined(spark, d):
    return _rounded(M.summary(_counts(spark, d)).select("combined_score"))


@proof("metrics_all",
       "SELECT " + ", ".join(f"round({k}, 6) AS {k}" for k in M.MULTI_LABEL_KEYS + ["combined_score"])
       + f" FROM ({ALL_SQL}) a")
def metrics_all(spark, d):
    return _rounded(M.multi_label_metrics(S.scored(spark, d), C))


# M5 / F9 / F11 over embeddings ------------------------------------------------
# (logits: the linear class scores over whole vectors)
PRED_CLASS_SQL = f"SELECT vec_id, label, list_position(logits, list_max(logits)) - 1 AS pred FROM ({LOGITS_SQL}) l"


@proof("metric_accuracy",
       f"SELECT round(avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM ({PRED_CLASS_SQL}) p")
def metric_accuracy(spark, d):
    return _rounded(M.accuracy(class_logits(spark, d), L.argmax(F.col("logits")), F.col("label")))


@proof("argmax_label",
       "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS pred "
       "FROM embeddings")
def argmax_label(spark, d):
    emb = S.table(spark, d, "embeddings")
    return emb.select("vec_id", L.argmax(F.col("embedding")).alias("pred"))


CLASS_NAMES = [f"class_{i}" for i in range(10)]


@proof("decode_class",
       f"SELECT vec_id, 'class_' || CAST(pred AS VARCHAR) AS class_name FROM ({PRED_CLASS_SQL}) p")
def decode_class(spark, d):
    return class_logits(spark, d).select("vec_id", L.decode_class(L.argmax(F.col("logits")), CLASS_NAMES).alias("class_name"))


# M6 over scored NLI pairs ---------------------------------------------------
def _entail_scored(spark, d):
    from labelforge.plans.prepare_proofs import build_nli
    n = build_nli(spark, d)
    second = ((F.col("PMID") * 7 + F.col("Label_idx") * 3
               + F.col("Positive").cast("int")) % 10) / 9.0
    return n.select("PMID", "Positive", "Label_idx",
                    F.array(F.lit(0.5), second).alias("logits"),
                    F.col("Entailment").alias("label"))


ENTAIL_SCORED_SQL = (
    "SELECT PMID, Positive, Label_idx, "
    "[0.5, ((PMID * 7 + Label_idx * 3 + CAST(Positive AS INTEGER)) % 10)::DOUBLE / 9] AS logits, "
    f"Entailment AS label FROM ({S.NLI_SQL}) n")
ENTAIL_COUNTS_SQL = (
    "SELECT sum(CASE WHEN p = 1 AND label = 1 THEN 1 ELSE 0 END) AS tp, "
    "sum(CASE WHEN p = 1 AND coalesce(label <> 1, true) THEN 1 ELSE 0 END) AS fp, "
    "sum(CASE WHEN p <> 1 AND label = 1 THEN 1 ELSE 0 END) AS fn "
    f"FROM (SELECT list_position(logits, list_max(logits)) - 1 AS p, label FROM ({ENTAIL_SCORED_SQL}) e) q")


@proof("metrics_entailment",
       "SELECT round(f1, 6) AS f1, round(precision, 6) AS precision, round(recall, 6) AS recall, "
       "round((f1 + precision + recall) / 3, 6) AS combined_score FROM ("
       "SELECT CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1, "
       "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, "
       "CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall "
       f"FROM ({ENTAIL_COUNTS_SQL}) c) m")
def metrics_entailment(spark, d):
    return _rounded(M.entailment_metrics(_entail_scored(spark, d)))


@proof("metric_by_name",
       "SELECT 'f1' AS metric, 'multi_label_classification' AS problem_type, "
       f"round(f1_micro, 6) AS value FROM ({SUMMARY_SQL}) s "
       "UNION ALL SELECT 'accuracy', 'single_label_classification', "
       f"round(avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END), 6) FROM ({PRED_CLASS_SQL}) p")
def metric_by_name(spark, d):
    multi = M.metric_by_name(S.scored(spark, d), "f1")
    single = M.metric_by_name(class_logits(spark, d), "accuracy")
    return _rounded(multi.unionByName(single))


# M8 -------------------------------------------------------------------------
@proof("throughput_stats",
       "SELECT event_type AS model, count(*) AS samples, round(sum(value), 6) AS runtime_s, "
       "round(count(*) / sum(value), 6) AS samples_per_second, "
       "round(ceil(count(*) / 8) / sum(value), 6) AS steps_per_second "
       "FROM events GROUP BY event_type")
def throughput_stats(spark, d):
    ev = S.table(spark, d, "events")
    per = ev.groupBy(F.col("event_type").alias("model")).agg(
        F.count(F.lit(1)).alias("samples"), F.sum("value").alias("runtime_s"))
    return _rounded(per.select("model", "samples", "runtime_s",
                               *M.throughput(F.col("samples"), F.col("runtime_s"), 8)))


# M9 -------------------------------------------------------------------------
@proof("loss_bce",
       "SELECT round(sum(list_sum(list_transform(range(1, len(logits) + 1), lambda i: "
       "greatest(logits[i], 0) - logits[i] * label[i] + ln(1 + exp(-abs(logits[i])))))) "
       f"/ sum(len(logits)), 6) AS loss FROM ({S.SCORED_SQL}) s")
def loss_bce(spark, d):
    return _rounded(M.loss_bce(S.scored(spark, d)))


@proof("loss_mse",
       "SELECT round(sum(list_sum(list_transform(range(1, len(logits) + 1), lambda i: "
       "(logits[i] - label[i]) * (logits[i] - label[i])))) "
       f"/ sum(len(logits)), 6) AS loss FROM ({S.SCORED_SQL}) s")
def loss_mse(spark, d):
    return _rounded(M.loss_mse(S.scored(spark, d)))


@proof("loss_ce",
       "SELECT round(avg(ln(list_sum(list_transform(x, lambda a: exp(a - list_max(x))))) "
       "+ list_max(x) - x[label + 1]), 6) AS loss "
       f"FROM (SELECT logits AS x, label FROM ({LOGITS_SQL}) l) e")
def loss_ce(spark, d):
    return _rounded(M.loss(class_logits(spark, d)))          # chosen by the problem type


# M10 ------------------------------------------------------------------------
# by brute force: every cut is counted over all rows on its own
@proof("threshold_sweep",
       "WITH pairs AS (SELECT CAST(i - 1 AS BIGINT) AS label_idx, logits[i] AS s, coalesce(label[i] = 1, false) AS y "
       f"FROM ({S.SCORED_SQL}) q, range(1, {C + 1}) r(i)), "
       "cuts AS (SELECT DISTINCT label_idx, s AS t FROM pairs UNION SELECT DISTINCT label_idx, '-infinity'::DOUBLE FROM pairs), "
       "f AS (SELECT c.label_idx, t, sum(CASE WHEN s > t AND y THEN 1 ELSE 0 END) AS tp, "
       "sum(CASE WHEN s > t AND NOT y THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN y THEN 1 ELSE 0 END) AS p "
       "FROM cuts c JOIN pairs p USING (label_idx) GROUP BY c.label_idx, t), "
       "g AS (SELECT label_idx, t, CASE WHEN tp + fp + p > 0 THEN 2 * tp / (tp + fp + p) ELSE 0.0 END AS f1 FROM f) "
       "SELECT label_idx, min(t) AS best_threshold, round(max(f1), 6) AS best_f1 FROM g "
       "JOIN (SELECT label_idx, max(f1) AS top FROM g GROUP BY label_idx) m USING (label_idx) WHERE f1 = top GROUP BY label_idx")
def threshold_sweep(spark, d):
    best = M.threshold_sweep(S.scored(spark, d), C)
    return best.select("label_idx", "best_threshold", F.round("best_f1", 6).alias("best_f1"))


# F8 / F10 / S11 -------------------------------------------------------------
@proof("threshold_scores", f"SELECT row_id, {PRED_SQL} AS pred FROM ({S.SCORED_SQL}) s")
def threshold_scores(spark, d):
    return S.scored(spark, d).select("row_id", L.threshold_scores(F.col("logits")).alias("pred"))


NAMES_SQL = ("list_filter([CASE WHEN p[1] = 1 THEN 'quality' END, "
             "CASE WHEN p[2] = 1 THEN 'toxic' END], lambda x: x IS NOT NULL)")


@proof("decode_labels",
       f"SELECT row_id, {NAMES_SQL} AS names FROM (SELECT row_id, {PRED_SQL} AS p "
       f"FROM ({S.SCORED_SQL}) s) q")
def decode_labels(spark, d):
    pred = L.threshold_scores(F.col("logits"))
    return S.scored(spark, d).select("row_id", L.decode_multi_hot(pred, S.LABELS).alias("names"))


# A1 - A5 --------------------------------------------------------------------
@proof("distinct_ids",
       "SELECT (SELECT count(DISTINCT doc_id) FROM documents) AS n_documents, "
       "(SELECT count(DISTINCT doc_id) FROM labels) AS n_labelled, "
       "(SELECT count(DISTINCT text) FROM documents) AS n_distinct_texts")
def distinct_ids(spark, d):
    # distinct texts are counted on their SHA-256 digest: 32 bytes per row
    # cross the shuffle instead of the whole text
    docs = S.table(spark, d, "documents").agg(
        F.countDistinct("doc_id").alias("n_documents"),
        F.countDistinct(F.sha2("text", 256)).alias("n_distinct_texts"))
    labs = S.table(spark, d, "labels").agg(F.countDistinct("doc_id").alias("n_labelled"))
    return docs.select("n_documents", labs.scalar().alias("n_labelled"), "n_distinct_texts")


@proof("value_counts", 'SELECT lang, count(*) AS "count" FROM documents GROUP BY lang')
def value_counts(spark, d):
    docs = S.table(spark, d, "documents")
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "lang")


@proof("label_support",
       "SELECT CAST(i - 1 AS BIGINT) AS label_idx, sum(label[i]) AS positives "
       f"FROM ({S.SCORED_SQL}) s, range(1, {C + 1}) r(i) GROUP BY i")
def label_support(spark, d):
    sc = S.scored(spark, d)
    wide = sc.agg(*[F.sum(F.col("label")[c]).alias(f"s{c}") for c in range(C)])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).cast("long").alias("label_idx"), F.col(f"s{c}").alias("positives"))
        for c in range(C)])))


@proof("collect_per_key",
       "SELECT conv_id, string_agg(role, ', ' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def collect_per_key(spark, d):
    # one conversation's turns per key: the group is one conversation, so the
    # list is bounded by its length
    conv = S.table(spark, d, "conversations")
    return conv.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))),
                                 lambda x: x["role"]), ", ").alias("roles"))


@proof("split_counts",
       f"SELECT lower(Split) AS split_name, count(*) AS n FROM ({S.MERGED_SQL}) m "
       "WHERE Split IN ('Train', 'Validation', 'Test') GROUP BY lower(Split)")
def split_counts(spark, d):
    from labelforge.operators import prepare as prep
    b = prep.build_binary(S.abstracts(spark, d), S.binary_labels(spark, d), S.SPEC,
                          with_index=False)
    return b.groupBy("split_name").agg(F.count(F.lit(1)).alias("n"))


LIST_LIMIT = 4


@proof("collect_per_key_parts",
       "SELECT conv_id, part, string_agg(role, ', ' ORDER BY pos) AS roles FROM (SELECT *, pos // 4 AS part FROM (SELECT conv_id, role, "
       "row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS pos FROM conversations) x) y GROUP BY conv_id, part")
def collect_per_key_parts(spark, d):
    """A4 with lists of bounded length, whatever the key holds."""
    from labelforge.operators.positions import bounded_lists
    conv = S.table(spark, d, "conversations")
    lists = bounded_lists(conv, "conv_id", F.struct("turn", "role", "text"), F.col("role"), LIST_LIMIT)
    return lists.select("conv_id", "part", F.array_join("values", ", ").alias("roles"))


BY_SPLIT_SQL = ALL_SQL.replace(S.SCORED_SQL, f"SELECT * FROM ({S.SCORED_SQL}) s0 WHERE Split = '{{split}}'")


@proof("metrics_by_split",
       " UNION ALL ".join(f"SELECT '{s}' AS Split, (SELECT count(*) FROM ({S.SCORED_SQL}) n WHERE Split = '{s}') AS n, "
                          + ", ".join(f"round({k}, 6) AS {k}" for k in M.MULTI_LABEL_KEYS + ["combined_score"])
                          + f" FROM ({BY_SPLIT_SQL.format(split=s)}) a" for s in ("Train", "Validation", "Test")))
def metrics_by_split(spark, d):
    out = M.metrics_by(S.scored(spark, d), ["Split"], C)
    return out.select("Split", "n", *[F.round(k, 6).alias(k) for k in [*M.MULTI_LABEL_KEYS, "combined_score"]])
