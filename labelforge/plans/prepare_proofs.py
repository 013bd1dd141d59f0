"""Proof queries: joins, label vectors, splits, dataset builders (P*, J1-J3, X1-X3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelforge.operators import prepare as prep
from labelforge.plans import standins as S
from labelforge.plans.registry import proof


def _merged(spark, d):
    return prep.join_labels(S.abstracts(spark, d), S.binary_labels(spark, d), "PMID")


def nli_summary(spark, d):
    binary = prep.build_binary(S.abstracts(spark, d), S.binary_labels(spark, d), S.SPEC,
                               with_index=False)
    return prep.nli_summary(prep.build_nli(binary, S.SPEC))


NLI_SUMMARY_SQL = (
    "SELECT split_name, Label_idx, Positive, count(*) AS n_pairs, "
    "round(avg(Entailment), 6) AS entail_rate "
    f"FROM ({S.NLI_SQL}) n GROUP BY split_name, Label_idx, Positive")

proof("nli_summary", NLI_SUMMARY_SQL)(nli_summary)


@proof("join_docs_labels",
       f"SELECT PMID, Title, Abstract, Split, \"Number of Annotators\", quality, toxic "
       f"FROM ({S.MERGED_SQL}) m")
def join_docs_labels(spark, d):
    return _merged(spark, d)


@proof("pack_label_vector", f"SELECT PMID, label FROM ({S.MERGED_SQL}) m")
def pack_label_vector(spark, d):
    # by position: the label columns start at the sixth column of the merged table
    return prep.with_label_vector(_merged(spark, d)).select("PMID", "label")


@proof("split_filter",
       f"SELECT PMID, Split, lower(Split) AS split_lc FROM ({S.MERGED_SQL}) m "
       "WHERE Split IN ('Train', 'Validation', 'Test')")
def split_filter(spark, d):
    return (prep.split_filter(_merged(spark, d))
                .select("PMID", "Split", F.col("split_name").alias("split_lc")))


@proof("rename_label",
       f"SELECT PMID, quality AS label, toxic FROM ({S.BINARY_SQL}) b")
def rename_label(spark, d):
    return prep.rename_label(S.binary_labels(spark, d), "quality").select("PMID", "label", "toxic")


@proof("drop_columns",
       f"SELECT PMID, Split, quality FROM ({S.BINARY_SQL}) b")
def drop_columns(spark, d):
    return prep.drop_columns(S.binary_labels(spark, d), "Number of Annotators,toxic")


@proof("split_alias",
       f"SELECT PMID, CASE lower(Split) WHEN 'validation' THEN 'dev' ELSE lower(Split) END AS split "
       f"FROM ({S.BINARY_SQL}) b")
def split_alias(spark, d):
    b = S.binary_labels(spark, d).select("PMID", F.lower("Split").alias("split"))
    return prep.split_alias(b, {"validation": "dev", "test": "test"})


@proof("eval_split_fallback",
       f"SELECT PMID, lower(Split) AS split FROM ({S.BINARY_SQL}) b "
       "WHERE lower(Split) = (SELECT CASE WHEN bool_or(lower(Split) = 'validation') "
       "THEN 'validation' WHEN bool_or(lower(Split) = 'test') THEN 'test' END "
       f"FROM ({S.BINARY_SQL}) b2)")
def eval_split_fallback(spark, d):
    b = S.binary_labels(spark, d).select("PMID", F.lower("Split").alias("split"))
    return prep.eval_split(b)


@proof("concat_text_columns",
       "SELECT p_partkey, p_name, concat_ws(' ', p_name, p_brand, p_type) AS sentence FROM part")
def concat_text_columns(spark, d):
    part = S.table(spark, d, "part")
    return prep.concat_text_columns(part, ["p_name", "p_brand", "p_type"]).select(
        "p_partkey", "p_name", "sentence")


@proof("row_position",
       "SELECT PMID, row_number() OVER (ORDER BY PMID) - 1 AS __index_level_0__ "
       f"FROM ({S.MERGED_SQL}) m")
def row_position(spark, d):
    return prep.with_position(_merged(spark, d).select("PMID"), ["PMID"])


DICT_SQL = ("SELECT 0::BIGINT AS label_idx, 'quality' AS label_name, count(quality) AS n_labelled "
            f"FROM ({S.MERGED_SQL}) m UNION ALL "
            "SELECT 1::BIGINT, 'toxic', count(toxic) "
            f"FROM ({S.MERGED_SQL}) m")


@proof("label_dictionary", DICT_SQL)
def label_dictionary(spark, d):
    # label names are the merged table's columns from the sixth on; the
    # dictionary is built from the table's rows (with a per-label count)
    merged = _merged(spark, d)
    cols = prep.label_columns_by_position(merged.columns, 5)
    return prep.label_dictionary_from(merged, cols)


CANDIDATE_TERMS = ["worthless", "excellent", "nicht", "tion"]


@proof("candidate_term_filter",
       "SELECT doc_id, lang FROM documents WHERE regexp_matches(text, "
       "'(?i)(^|[^a-z0-9])(worthless|excellent|nicht|tion)([^a-z0-9]|$)')")
def candidate_term_filter(spark, d):
    docs = S.table(spark, d, "documents")
    return prep.candidate_term_filter(docs, "text", CANDIDATE_TERMS).select("doc_id", "lang")


@proof("keyed_update",
       "SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN CAST(l.quality AS VARCHAR) END "
       "AS MeshID FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def keyed_update(spark, d):
    target = S.table(spark, d, "documents").select("doc_id", F.lit(None).cast("string").alias("MeshID"))
    updates = S.table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("MeshID"))
    return prep.keyed_update(target, updates, "doc_id", "MeshID")


@proof("build_binary",
       "SELECT PMID, Title, Abstract, Split, \"Number of Annotators\", quality, toxic, label, "
       "__index_level_0__, split_name "
       f"FROM ({S.BINARY_DATASET_SQL}) m WHERE Split IN ('Train', 'Validation', 'Test')")
def build_binary(spark, d):
    return prep.build_binary(S.abstracts(spark, d), S.binary_labels(spark, d), S.SPEC)


@proof("build_soft",
       "SELECT PMID, Title, Abstract, Split, \"Number of Annotators\", "
       "round(quality, 6) AS quality, round(toxic, 6) AS toxic, "
       "[round(quality, 6), round(toxic, 6)] AS label, __index_level_0__, lower(Split) AS split_name "
       f"FROM (SELECT *, row_number() OVER (ORDER BY PMID) - 1 AS __index_level_0__ FROM ({S.SOFT_MERGED_SQL}) x) m "
       "WHERE Split IN ('Train', 'Validation', 'Test')")
def build_soft(spark, d):
    out = prep.build_soft(S.abstracts(spark, d), S.soft_labels(spark, d), S.SPEC)
    return out.select("PMID", "Title", "Abstract", "Split", "Number of Annotators",
                      F.round("quality", 6).alias("quality"), F.round("toxic", 6).alias("toxic"),
                      F.transform("label", lambda x: F.round(x, 6)).alias("label"), "__index_level_0__", "split_name")


@proof("build_nli", S.NLI_SQL)
def build_nli(spark, d):
    binary = prep.build_binary(S.abstracts(spark, d), S.binary_labels(spark, d), S.SPEC,
                               with_index=False)
    return prep.build_nli(binary, S.SPEC)


@proof("nli_expand",
       "SELECT PMID, Label_idx, Positive, Entailment, split_name "
       f"FROM ({S.NLI_SQL}) n")
def nli_expand(spark, d):
    return build_nli(spark, d).select("PMID", "Label_idx", "Positive", "Entailment", "split_name")


@proof("nli_pair_text",
       "SELECT PMID, Positive, Abstract AS premise, Hypothesis AS hypothesis, "
       "Entailment AS label "
       f"FROM ({S.NLI_SQL}) n")
def nli_pair_text(spark, d):
    # premise and hypothesis travel together in one row; the label is the
    # entailment value, PMID and polarity are carried for the collapse (V11)
    n = build_nli(spark, d)
    return n.select("PMID", "Positive", F.col("Abstract").alias("premise"),
                    F.col("Hypothesis").alias("hypothesis"), F.col("Entailment").alias("label"))


@proof("labels_sorted",
       "SELECT label_name, sum(y) AS positives FROM ("
       f"SELECT 'quality' AS label_name, quality AS y FROM ({S.BINARY_SQL}) a UNION ALL "
       f"SELECT 'toxic', toxic FROM ({S.BINARY_SQL}) b) u GROUP BY label_name")
def labels_sorted(spark, d):
    return prep.labels_by_name(S.binary_labels(spark, d), S.LABELS)


@proof("build_all",
       "WITH b AS (SELECT *, row_number() OVER (ORDER BY PMID) - 1 AS i FROM (" + S.MERGED_SQL + ") x), "
       "s AS (SELECT *, row_number() OVER (ORDER BY PMID) - 1 AS i FROM (" + S.SOFT_MERGED_SQL + ") x) "
       "SELECT 'binary' AS dataset, lower(Split) AS split_name, PMID, i AS place, -1 AS label_idx, true AS positive, "
       "round(quality, 6) AS first, round(toxic, 6) AS second FROM b WHERE Split IN ('Train', 'Validation', 'Test') UNION ALL "
       "SELECT 'soft', lower(Split), PMID, i, -1, true, round(quality, 6), round(toxic, 6) FROM s "
       "WHERE Split IN ('Train', 'Validation', 'Test') UNION ALL "
       f"SELECT 'nli', split_name, PMID, -1, Label_idx, Positive, round(Entailment, 6), NULL FROM ({S.NLI_SQL}) n")
def build_all(spark, d):
    from labelforge.session import work_path
    paths = prep.build_all(S.abstracts(spark, d), S.binary_labels(spark, d), S.soft_labels(spark, d),
                           S.SPEC, work_path(spark, "hf-datasets"))
    out = None
    for name, path in paths.items():
        rows = spark.read.parquet(path)
        if name == "nli":
            part = rows.select(F.lit(name).alias("dataset"), "split_name", "PMID", F.lit(-1).cast("long").alias("place"),
                               F.col("Label_idx").alias("label_idx"), F.col("Positive").alias("positive"),
                               F.round("Entailment", 6).alias("first"), F.lit(None).cast("double").alias("second"))
        else:
            part = rows.select(F.lit(name).alias("dataset"), "split_name", "PMID", F.col(prep.INDEX_COL).alias("place"),
                               F.lit(-1).cast("long").alias("label_idx"), F.lit(True).alias("positive"),
                               F.round(F.col("label")[0], 6).alias("first"), F.round(F.col("label")[1], 6).alias("second"))
        out = part if out is None else out.unionByName(part)
    return out
