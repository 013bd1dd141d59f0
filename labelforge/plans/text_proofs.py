"""Proof queries: token sequences, truncation, padding widths, zero-shot pair
scoring and the polarity collapse, seeded order and sampling
(F15-F17, W3, V9, V11, O3, O4, U1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelforge.functions import text as X
from labelforge.operators import models as MD
from labelforge.operators import prepare as prep
from labelforge.operators.positions import with_batch_id, with_row_index
from labelforge.plans import standins as S
from labelforge.plans.registry import proof

N = X.effective_length(512)

TOK_SQL = ("(CASE WHEN trim(regexp_replace({x}, '\\s+', ' ', 'g')) = '' THEN []::VARCHAR[] "
           "ELSE string_split(trim(regexp_replace({x}, '\\s+', ' ', 'g')), ' ') END)")


def _seq_sql(x: str, n: int) -> str:
    t = TOK_SQL.format(x=x)
    kept = f"{t}[1:{n - 2}]"
    return (f"list_concat(['[CLS]'], {kept}, ['[SEP]'], "
            f"repeat(['[PAD]'], greatest({n - 2} - len({kept}), 0)))")


def _mask_sql(x: str, n: int) -> str:
    t = TOK_SQL.format(x=x)
    real = f"(len({t}[1:{n - 2}]) + 2)"
    return f"list_concat(repeat([1], {real}), repeat([0], greatest({n} - {real}, 0)))"


@proof("token_sequences",
       f"SELECT doc_id, {_seq_sql('text', N)} AS input_tokens, {_mask_sql('text', N)} AS attention_mask "
       "FROM documents")
def token_sequences(spark, d):
    docs = S.table(spark, d, "documents").select("doc_id", "text")
    return X.with_token_sequence(docs, "text", N).select("doc_id", "input_tokens", "attention_mask")


def _pair_sql(n: int) -> str:
    budget, half = n - 3, (n - 3) // 2
    la, lb = f"len({TOK_SQL.format(x='Abstract')})", f"len({TOK_SQL.format(x='Hypothesis')})"
    ka = (f"CASE WHEN {la} + {lb} <= {budget} THEN {la} WHEN least({la}, {lb}) <= {half} THEN "
          f"CASE WHEN {la} <= {lb} THEN {la} ELSE {budget} - {lb} END ELSE {budget - half} END")
    kb = (f"CASE WHEN {la} + {lb} <= {budget} THEN {lb} WHEN least({la}, {lb}) <= {half} THEN "
          f"CASE WHEN {la} <= {lb} THEN {budget} - {la} ELSE {lb} END ELSE {half} END")
    return ka, kb


KA_SQL, KB_SQL = _pair_sql(N)
PAIR_SQL = (
    "SELECT PMID, Label_idx, Positive, "
    f"list_concat(['[CLS]'], {TOK_SQL.format(x='Abstract')}[1:{KA_SQL}], ['[SEP]'], "
    f"{TOK_SQL.format(x='Hypothesis')}[1:{KB_SQL}], ['[SEP]'], "
    f"repeat(['[PAD]'], greatest({N - 3} - ({KA_SQL}) - ({KB_SQL}), 0))) AS input_tokens, "
    f"list_concat(repeat([0], ({KA_SQL}) + 2), repeat([1], ({KB_SQL}) + 1), "
    f"repeat([0], greatest({N - 3} - ({KA_SQL}) - ({KB_SQL}), 0))) AS token_type_ids, "
    f"list_concat(repeat([1], ({KA_SQL}) + ({KB_SQL}) + 3), "
    f"repeat([0], greatest({N - 3} - ({KA_SQL}) - ({KB_SQL}), 0))) AS attention_mask "
    f"FROM ({S.NLI_SQL}) n")


def _nli(spark, d, premise_col=None, premise_expr=None):
    """NLI pairs; with ``premise_expr`` the premise is tokenised on the
    labelled rows, before the hypothesis expansion, and carried instead of
    the text."""
    binary = prep.build_binary(S.abstracts(spark, d), S.binary_labels(spark, d), S.SPEC,
                               with_index=False)
    if premise_expr is None:
        return prep.build_nli(binary, S.SPEC)
    binary = binary.withColumn(premise_col, premise_expr)
    return prep.build_nli(binary, S.SPEC, keep=[premise_col, "split_name"])


@proof("token_pairs", PAIR_SQL)
def token_pairs(spark, d):
    n = _nli(spark, d, "_a", X.tokens(F.col("Abstract")))
    n = n.withColumn("_b", X.tokens(F.col("Hypothesis")))
    return X.with_token_pair(n, "_a", "_b", N).select(
        "PMID", "Label_idx", "Positive", "input_tokens", "token_type_ids", "attention_mask")


@proof("truncation_rate",
       f"SELECT lang, count(*) AS n_docs, round(avg(CASE WHEN len({TOK_SQL.format(x='text')}) + 2 > {N} "
       "THEN 1.0 ELSE 0.0 END), 6) AS truncation_rate FROM documents GROUP BY lang")
def truncation_rate(spark, d):
    docs = S.table(spark, d, "documents")
    return docs.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.round(F.avg(X.is_truncated(F.col("text"), N).cast("double")), 6).alias("truncation_rate"))


@proof("batch_pad_width",
       "SELECT batch_id, CAST(ceil(max(least(len(" + TOK_SQL.format(x="text") + f") + 2, {N})) / 8) * 8 AS INTEGER) "
       "AS pad_width FROM (SELECT text, (row_number() OVER (ORDER BY doc_id) - 1) // 8 AS batch_id "
       "FROM documents) b GROUP BY batch_id")
def batch_pad_width(spark, d):
    docs = S.table(spark, d, "documents")
    lens = docs.select("doc_id", F.least(X.token_count(F.col("text")) + 2, F.lit(N)).alias("len"))
    batched = with_batch_id(lens, ["doc_id"], 8)
    return batched.groupBy("batch_id").agg(X.padded_width(F.max("len"), 8).alias("pad_width"))


OVERLAP_SQL = (f"CASE WHEN len(list_distinct({TOK_SQL.format(x='lower(Hypothesis)')})) > 0 THEN "
               f"len(list_intersect({TOK_SQL.format(x='lower(Abstract)')}, list_distinct({TOK_SQL.format(x='lower(Hypothesis)')}))) "
               f"/ len(list_distinct({TOK_SQL.format(x='lower(Hypothesis)')})) ELSE 0.0 END")
ZS_SQL = (f"SELECT PMID, Label_idx, Positive, Entailment AS label, {OVERLAP_SQL} AS score FROM ({S.NLI_SQL}) n")


@proof("zero_shot_scores",
       "SELECT PMID, Label_idx, Positive, label, round(score, 6) AS score, "
       f"CASE WHEN score > 1 - score THEN 1 ELSE 0 END AS pred FROM ({ZS_SQL}) z")
def zero_shot_scores(spark, d):
    z = _zero_shot(spark, d)
    return z.select("PMID", "Label_idx", "Positive", "label", F.round("score", 6).alias("score"), "pred")


def _zero_shot(spark, d):
    pairs = _nli(spark, d, "_p", X.token_set(F.col("Abstract")))
    return MD.zero_shot_scores(pairs, premise_set="_p")


@proof("nli_collapse",
       "SELECT PMID, Label_idx, round(sum(CASE WHEN Positive THEN score ELSE -score END), 6) AS margin, "
       f"sum(CASE WHEN Positive THEN score ELSE -score END) > 0 AS decision FROM ({ZS_SQL}) z "
       "GROUP BY PMID, Label_idx")
def nli_collapse(spark, d):
    c = MD.nli_collapse(_zero_shot(spark, d))
    return c.select("PMID", "Label_idx", F.round("margin", 6).alias("margin"), "decision")


SEED = 42
SHUFFLE_SQL = ("SELECT PMID, row_number() OVER (ORDER BY md5('42' || CAST(PMID AS VARCHAR)), PMID) - 1 AS pos "
               f"FROM ({S.MERGED_SQL}) m WHERE Split = 'Train'")


def _train(spark, d):
    b = prep.build_binary(S.abstracts(spark, d), S.binary_labels(spark, d), S.SPEC, with_index=False)
    return b.filter(F.col("split_name") == "train")


def seeded_key(seed: int, key: str):
    return F.md5(F.concat(F.lit(str(seed)), F.col(key).cast("string")))


@proof("seeded_shuffle", SHUFFLE_SQL)
def seeded_shuffle(spark, d):
    # the order is a hash of seed ‖ key: the same on any partitioning
    t = _train(spark, d).select("PMID", seeded_key(SEED, "PMID").alias("_h"))
    return with_row_index(t, ["_h", "PMID"], "pos").select("PMID", "pos")


@proof("sample_k",
       "SELECT PMID FROM (" + SHUFFLE_SQL + ") s WHERE pos < 3")
def sample_k(spark, d):
    # top-k by the seeded hash: per-partition top 3, then merged
    t = _train(spark, d).select("PMID", seeded_key(SEED, "PMID").alias("_h"))
    return t.orderBy("_h", "PMID").limit(3).select("PMID")


NLI_PANDAS_SCHEMA = ("PMID long, Title string, Abstract string, Hypothesis string, Entailment double, "
                     "Positive boolean, Label_idx long, split_name string")


@proof("udf_nli_mapinpandas", S.NLI_SQL)
def udf_nli_mapinpandas(spark, d):
    """The NLI expansion as a batched map over Arrow batches (the reference's
    batch-map form); the built-in ``build_nli`` is the fast path."""
    hyps = [(h.label_name, h.label_idx, h.positive, h.negative) for h in S.SPEC.hypotheses]

    def expand(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        for b in batches:
            label, n = b.column("label"), b.num_rows
            for _name, idx, pos_text, neg_text in hyps:
                value = pc.list_element(label, idx).cast(pa.float64())
                missing = pc.or_kleene(pc.is_null(value), pc.fill_null(pc.is_nan(value), False))
                negated = pc.if_else(missing, 0.0, pc.fill_null(pc.equal(value, 0.0), False).cast(pa.float64()))
                for positive, text, entailment in ((True, pos_text, value), (False, neg_text, negated)):
                    yield pa.RecordBatch.from_arrays(
                        [b.column("PMID"), b.column("Title"), b.column("Abstract"), pa.repeat(pa.scalar(text, pa.string()), n), entailment,
                         pa.repeat(positive, n), pa.repeat(pa.scalar(idx, pa.int64()), n), b.column("split_name")],
                        names=["PMID", "Title", "Abstract", "Hypothesis", "Entailment", "Positive", "Label_idx", "split_name"])

    b = prep.build_binary(S.abstracts(spark, d), S.binary_labels(spark, d), S.SPEC, with_index=False)
    return b.select("PMID", "Title", "Abstract", "split_name", "label").mapInArrow(expand, NLI_PANDAS_SCHEMA)


# A public byte-level vocabulary; its path is a parameter of every function that uses it.
VOCABULARY, END = "/opt/tokenizers/byte_bpe_50k.json", 50256


@proof("subword_sequences")
def subword_sequences(spark, d):
    """F15 in model tokens: whole texts encoded, cut and padded (rows-only: the vocabulary is no SQL table)."""
    from labelforge.functions import subword as W
    docs = S.table(spark, d, "documents").select("doc_id", "text")
    out = W.with_subword_sequence(docs, "text", W.read_vocabulary(VOCABULARY), 512, END, END, END)
    return out.select("doc_id", "n_tokens", "truncated", "input_ids", "attention_mask")


@proof("subword_truncation_rate")
def subword_truncation_rate(spark, d):
    """F17 in model tokens, by language."""
    from labelforge.functions import subword as W
    out = W.truncation_rate(S.table(spark, d, "documents"), "text", W.read_vocabulary(VOCABULARY), 512, "lang")
    return out.select("lang", "n", "n_truncated", F.round("rate", 6).alias("rate"))


@proof("subword_round_trip", "SELECT doc_id, text FROM documents")
def subword_round_trip(spark, d):
    """Encoding and decoding gives back every whole text."""
    from labelforge.functions import subword as W
    vocabulary = W.read_vocabulary(VOCABULARY)
    docs = S.table(spark, d, "documents").select("doc_id", W.encoder(vocabulary)(F.col("text")).alias("ids"))
    return docs.select("doc_id", W.decoder(vocabulary)(F.col("ids")).alias("text"))
