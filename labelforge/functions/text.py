"""Token-sequence functions on whole texts (whitespace tokens, JVM-side).

A token is a maximal run of non-blank characters. Sequences follow the
encoder layout: ``[CLS] tokens [SEP]`` (single) or ``[CLS] a [SEP] b [SEP]``
(pair), cut to the budget and padded with ``[PAD]``; the attention mask marks
real positions with 1.

Tokenising a long text is the expensive step, so the DataFrame helpers below
tokenise once into a column and build everything else from that column (a
column referenced several times is not re-evaluated; a nested expression
would be). For premise/hypothesis pairs, tokenise the premise before the
hypothesis expansion multiplies the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelforge.schemas import MODEL_MAX_LENGTH

CLS, SEP, PAD = "[CLS]", "[SEP]", "[PAD]"
BLANKS = " \t\n\r\f\u000b"


def effective_length(max_seq_length: int, model_max_length: int = MODEL_MAX_LENGTH) -> int:
    """The asked length, capped at what the model takes."""
    return min(max_seq_length, model_max_length)


def tokens(text: Column) -> Column:
    """Whitespace tokens of the whole text (blank text → no tokens); one
    regex pass, no per-token lambda."""
    t = F.btrim(text, F.lit(BLANKS))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"\s+"))


def token_count(text: Column) -> Column:
    """Number of whitespace tokens, without building the token array."""
    return F.regexp_count(text, F.lit(r"\S+"))


def _pad(seq: Column, n: int) -> Column:
    return F.concat(seq, F.array_repeat(F.lit(PAD), F.greatest(F.lit(n) - F.size(seq), F.lit(0))))


def _mask(real: Column, n: int) -> Column:
    return F.concat(F.array_repeat(F.lit(1), real),
                    F.array_repeat(F.lit(0), F.greatest(F.lit(n) - real, F.lit(0))))


def with_token_sequence(df: DataFrame, text_col: str, n: int,
                        tokens_col: str | None = None) -> DataFrame:
    """Adds ``input_tokens`` and ``attention_mask`` (both exactly ``n`` long)."""
    t = F.col(tokens_col) if tokens_col else tokens(F.col(text_col))
    staged = df.withColumn("_lf_seq", F.concat(F.array(F.lit(CLS)), F.slice(t, 1, n - 2),
                                               F.array(F.lit(SEP))))
    return (staged.withColumn("input_tokens", _pad(F.col("_lf_seq"), n))
                  .withColumn("attention_mask", _mask(F.size("_lf_seq"), n))
                  .drop("_lf_seq"))


def pair_lengths(la: Column, lb: Column, budget: int) -> tuple[Column, Column]:
    """Lengths kept by longest-first truncation (one token at a time from the
    longer side; on a tie from the second), in closed form."""
    fits = (la + lb) <= budget
    half = budget // 2
    a_short = la <= lb
    short = F.least(la, lb)
    keep_a = (F.when(fits, la)
               .when(short <= half, F.when(a_short, la).otherwise(F.lit(budget) - lb))
               .otherwise(F.lit(budget - half)))
    keep_b = (F.when(fits, lb)
               .when(short <= half, F.when(a_short, F.lit(budget) - la).otherwise(lb))
               .otherwise(F.lit(half)))
    return keep_a, keep_b


def with_token_pair(df: DataFrame, a_tokens: str, b_tokens: str, n: int) -> DataFrame:
    """Adds ``input_tokens``, ``token_type_ids``, ``attention_mask`` for a pair
    whose token arrays are already columns."""
    ka, kb = pair_lengths(F.size(a_tokens), F.size(b_tokens), n - 3)
    staged = df.select(
        "*",
        F.concat(F.array(F.lit(CLS)), F.slice(a_tokens, 1, ka), F.array(F.lit(SEP))).alias("_lf_first"),
        F.concat(F.slice(b_tokens, 1, kb), F.array(F.lit(SEP))).alias("_lf_second"))
    lf, ls = F.size("_lf_first"), F.size("_lf_second")
    pad = F.greatest(F.lit(n) - lf - ls, F.lit(0))
    return (staged
            .withColumn("input_tokens", _pad(F.concat("_lf_first", "_lf_second"), n))
            .withColumn("token_type_ids", F.concat(F.array_repeat(F.lit(0), lf), F.array_repeat(F.lit(1), ls),
                                                   F.array_repeat(F.lit(0), pad)))
            .withColumn("attention_mask", _mask(lf + ls, n))
            .drop("_lf_first", "_lf_second"))


def is_truncated(text: Column, n: int) -> Column:
    """True when the text needs more than ``n`` positions with [CLS]/[SEP]."""
    return (token_count(text) + 2) > n


def padded_width(max_len: Column, multiple: int = 8) -> Column:
    """Batch width rounded up to a multiple (half-precision friendly)."""
    return (F.ceil(max_len / F.lit(multiple)) * multiple).cast("int")


def token_set(text: Column) -> Column:
    """Distinct lower-cased tokens (the overlap scorer's view of a text)."""
    return F.array_distinct(tokens(F.lower(text)))


def overlap_score_sets(premise_set: Column, hypothesis_set: Column) -> Column:
    """Share of the hypothesis' distinct tokens found in the premise."""
    return F.when(F.size(hypothesis_set) > 0,
                  F.size(F.array_intersect(premise_set, hypothesis_set)) / F.size(hypothesis_set)
                  ).otherwise(F.lit(0.0))
