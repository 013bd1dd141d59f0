"""Operator 6: mixing sources to target weights.

Documents get hash-random keys; each source is ordered by them, token counts
are summed up along that order, and the source is cut at its exact budget.
Budgets above the source's size repeat it in whole epochs, the rest being cut
from the same order.

Distribution: the key space is split at fixed bounds into ``16 ** digits`` key
ranges a source (keys are uniform, so the ranges are even, also in a hot
source). A prefix sum over the few range totals plus one inside each range
gives the global prefix sum; no task holds more than one range's rows in
order. Re-runs agree: nothing depends on partitions or sampling.

Edge cases: a null text has size 0; a null source is a source of its own,
ordered last; sources of size 0 get target 0; a null id is keyed by its text;
repeated rows share a key and count each; an empty table gives an empty
result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelforge.llm.common import word_count, written


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float) -> DataFrame:
    """``_nul, _src, source_size, target`` from ``_nul, _src, source_size`` (a row a source).

    Sources in code point order, null last, take the weights in turn. Filling
    by weight until every target is at most ``max_epochs`` times its source:
    with sources ordered by limit / weight, the level is the largest
    (rest of the budget) / (rest of the weights).
    """
    order = Window.orderBy("_nul", "_src")
    by_limit = Window.orderBy("_ratio", "_nul", "_src").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    filled = (sizes.withColumn("_w", w)
              .withColumn("_limit", max_epochs * F.col("source_size").cast("double"))
              .withColumn("_ratio", F.col("_limit") / F.col("_w"))
              .withColumn("_total", share * F.sum("source_size").over(every).cast("double"))
              .withColumn("_sum_w", F.sum("_w").over(every))
              .withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_limit").over(by_limit), F.lit(0.0)))
                          / (F.col("_sum_w") - F.coalesce(F.sum("_w").over(by_limit), F.lit(0.0))))
              .withColumn("_level", F.max("_level").over(every)))
    return filled.select("_nul", "_src", "source_size",
                         F.least(F.col("_limit"), F.col("_w") * F.col("_level")).alias("target"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
        weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, max_epochs: int = 2,
        seed: str = "mix", digits: int = 3) -> DataFrame:
    """``docs`` keys with ``size, source_size, target, taken`` (tokens the mix takes of each document).

    The taken tokens of a source add up to its target, rounded down. The
    document at the cut is taken in part.
    """
    if not 1 <= digits <= 7:
        raise ValueError("digits must lie between 1 and 7")
    ident = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("null|"), F.md5(F.coalesce(F.col(text), F.lit("")))))
    sized = written(docs.select(
        F.col(key), F.col(source).isNull().alias("_nul"), F.coalesce(F.col(source), F.lit("")).alias("_src"),
        word_count(F.col(text)).alias("size"), F.md5(F.concat(F.lit(seed + "|"), ident)).alias("_key")), "mix-sizes")
    cell = F.conv(F.substring("_key", 1, digits), 16, 10).cast("int")
    sized = sized.withColumn("_cell", cell)
    cells = sized.groupBy("_nul", "_src", "_cell").agg(F.sum("size").alias("_n"))
    sources = cells.groupBy("_nul", "_src").agg(F.sum("_n").alias("source_size"))
    ahead = Window.partitionBy("_nul", "_src").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = (cells.withColumn("_ahead", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n")
             .join(targets(sources, weights, share, max_epochs), ["_nul", "_src"]))
    inside = (Window.partitionBy("_nul", "_src", "_cell").orderBy("_key", key, "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.floor("target") - F.col("_epochs") * F.col("source_size")
    return (sized.join(cells, ["_nul", "_src", "_cell"])
            .withColumn("_before", F.col("_ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
            .withColumn("_epochs", epochs)
            .withColumn("taken", F.col("_epochs") * F.col("size")
                        + F.least(F.greatest(rest - F.col("_before"), F.lit(0)), F.col("size")))
            .select(key, "size", "source_size", "target", F.col("taken").cast("long").alias("taken"),
                    F.when(~F.col("_nul"), F.col("_src")).alias(source)))
