"""Operator 5: quality rules with risk-controlled cutoffs (DataFrame functions only).

Every document gets its base counts; a fixed base rule fails plainly broken
texts; the method then rejects documents whose signals reach a cutoff. The
cutoffs are not hand-set: per stratum and signal, the lowest cutoff of a fixed
grid is taken for which labelled good documents show, by an exact binomial
test, a false-rejection rate below the allowed risk. The error level is split
over every (stratum, signal, cutoff) test (Bonferroni), the risk over the
signals (their rejections are joined by OR), so with probability ``1 - delta``
no stratum loses more than ``risk`` of its good documents to the method.

Edge cases: a null or blank text has no words, all counts 0 and fails the base
rule; a null stratum is its own stratum together with the empty name; a
stratum with too few labels for any valid cutoff is judged by the base rule
alone; repeated rows are judged alike; empty tables give empty results; other
columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelforge.llm.common import BLANKS, word_array, written

SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Rejecting signals, each a whole number per 1000 so that every engine cuts alike.
SIGNALS = {
    "symbols": "n_symbols * 1000 DIV greatest(word_chars, 1)",
    "dup_lines": "n_dup_lines * 1000 DIV greatest(n_words, 1)",
    "repeats": "n_repeat_words * 1000 DIV greatest(n_words, 1)",
    "long_words": "word_chars * 100 DIV greatest(n_words, 1)",
}
CUTOFFS = {
    "symbols": (5, 10, 20, 40, 80, 120, 160, 240, 320, 480),
    "dup_lines": (1, 2, 5, 10, 15, 20, 30, 50, 80, 120),
    "repeats": (10, 20, 30, 50, 75, 100, 125, 150, 175, 200),
    "long_words": (600, 650, 700, 750, 800, 900, 1000, 1200, 1500, 2000),
}


def _window_hash(x: Column, i: Column) -> Column:
    """Hash of the window that starts with word hash ``x`` at ``i``: shifted word hashes joined by XOR."""
    for k in range(1, WINDOW):
        x = x.bitwiseXOR(F.shiftleft(F.get(F.col("_w"), i + k), k))
    return x


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed``.

    Repeated windows are found by hashing each window of five words and
    sorting (hash, position) inside the row, in time n log n, and only in
    texts in which some window hash occurs twice.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    symbol = "[" + SYMBOLS + "]"
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    staged = (docs
              .withColumn("_v", word_array(F.col(text)))
              .withColumn("_l", lines)
              .withColumn("n_symbols", F.when(t.rlike(symbol), F.length(t) - F.length(F.translate(t, SYMBOLS, "")))
                          .otherwise(F.lit(0)).cast("long"))
              .withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"))
              .withColumn("n_words", F.size("_v").cast("long"))
              .withColumn("word_chars", F.length(F.concat_ws("", "_v")).cast("long"))
              .withColumn("_w", F.transform("_v", lambda x: F.xxhash64(x)))
              .withColumn("_h", F.when(F.col("n_words") >= WINDOW, F.transform(
                  F.slice("_w", F.lit(1), F.greatest(F.col("n_words").cast("int") - (WINDOW - 1), F.lit(0))),
                  _window_hash))))
    repeats = F.size(F.array_distinct("_h")) < F.size("_h")
    staged = (staged
              .withColumn("_s", F.when(repeats, F.sort_array(F.transform(
                  "_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
              .withColumn("_p", F.sort_array(F.transform(F.filter(
                  F.transform("_s", lambda x, j: F.struct(
                      x["i"].alias("i"),
                      ((x["h"] == F.get(F.col("_s"), j - 1)["h"]) | (x["h"] == F.get(F.col("_s"), j + 1)["h"]))
                      .alias("twice"))),
                  lambda x: x["twice"]), lambda x: x["i"])))
              .withColumn("n_repeat_words", F.coalesce(F.aggregate(
                  F.transform("_p", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(
                      F.get(F.col("_p"), j + 1) - p, F.lit(WINDOW)))),
                  F.lit(0), lambda acc, x: acc + x), F.lit(0)).cast("long")))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return staged.withColumn("base_failed", failed).drop("_v", "_w", "_l", "_h", "_s", "_p")


def _log_gamma(x: Column) -> Column:
    """log of the gamma function for x >= 1: Stirling's series at x + 8, stepped down."""
    y = x + 8
    s = ((y - 0.5) * F.log(y) - y + 0.9189385332046727
         + 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3))) + 1 / (1260 * F.pow(y, F.lit(5))))
    for k in range(8):
        s = s - F.log(x + k)
    return s


def most_rejections(n: Column, risk: float, level: Column) -> Column:
    """The largest k with P(Binomial(n, risk) <= k) <= level; -1 if there is none.

    The lower tail is summed term by term from 14 standard deviations below
    the mean (what lies below is under 1e-40), so the work grows with the
    square root of n.
    """
    nd = n.cast("double")
    mean = nd * risk
    start = F.greatest(F.lit(0), F.floor(mean - 14 * F.sqrt(mean * (1 - risk)))).cast("long")
    first = F.exp(_log_gamma(nd + 1) - _log_gamma(start + 1) - _log_gamma(nd - start + 1)
                  + start * F.log(F.lit(risk)) + (nd - start) * F.log(F.lit(1 - risk)))
    zero = F.struct(first.alias("term"), F.lit(0.0).alias("total"), F.lit(-1).cast("long").alias("k"))

    def step(acc: Column, i: Column) -> Column:
        total = acc["total"] + acc["term"]
        return F.struct((acc["term"] * (nd - i) / (i + 1) * (risk / (1 - risk))).alias("term"),
                        total.alias("total"),
                        F.when(total <= level, i).otherwise(acc["k"]).alias("k"))
    return F.when(n > 0, F.aggregate(F.sequence(start, F.ceil(mean).cast("long")), zero, step)["k"]).otherwise(F.lit(-1))


def controlled_cutoffs(labelled: DataFrame, stratum: str, risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """``_stratum, c_<signal>``: the lowest cutoff per signal whose false rejection is controlled (else null).

    ``labelled`` holds the signals of every labelled good document that passes
    the base rule. Counts are partial aggregates: one row per stratum and task
    is shuffled, whatever the number of labels.
    """
    tests = sum(len(c) for c in CUTOFFS.values())
    counted = labelled.groupBy(F.col(stratum).alias("_stratum")).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum((F.col(s) >= c).cast("long")).alias(f"{s}_{c}") for s in SIGNALS for c in CUTOFFS[s]])
    strata = counted.agg(F.count(F.lit(1)).alias("_strata"))
    level = F.lit(delta) / (F.col("_strata") * tests)
    allowed = (counted.crossJoin(strata)          # one row
               .withColumn("_most", most_rejections(F.col("n"), risk / len(SIGNALS), level)))
    return allowed.select("_stratum", *[
        F.least(*[F.when(F.col(f"{s}_{c}") <= F.col("_most"), F.lit(c)) for c in CUTOFFS[s]]).alias(f"c_{s}")
        for s in SIGNALS])


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang",
          label: str = "quality", risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """``key``, the base counts, ``base_failed``, ``kept`` and the rejecting ``reason``.

    A document is labelled good when its labels hold a 1 and no 0. The counts
    are computed once and written; the cutoffs and the verdicts read them.
    """
    counts = written(
        base_counts(docs.select(key, F.coalesce(stratum, F.lit("")).alias("_stratum"), F.col(text).alias("_text")), "_text")
        .drop("_text"), "quality-counts")
    signals = counts.withColumns({s: F.expr(e) for s, e in SIGNALS.items()})
    good = (labels.where(F.col(label).isin(0, 1)).groupBy(key).agg(F.min(label).alias("_good"))
            .where("_good = 1").select(key))
    cuts = controlled_cutoffs(signals.where("NOT base_failed").join(good, key, "left_semi"), "_stratum", risk, delta)
    hit = [F.when(F.col(s) >= F.col(f"c_{s}"), F.lit(s)) for s in SIGNALS]
    # one row per stratum: joined by size (Spark's own broadcast limit, else a skew-split shuffle join)
    return (signals.join(cuts, "_stratum", "left")
            .withColumn("reason", F.when(F.col("base_failed"), F.lit("base")).otherwise(F.coalesce(*hit)))
            .withColumn("kept", F.col("reason").isNull())
            .select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    "base_failed", "kept", "reason"))
