"""Inverted index over a text column (P12): candidate retrieval without reading texts.

``build`` tokenises every text once and writes

* ``postings``: (bucket, term, docs, tfs, positions): a row a term and block of some
  ``BLOCK_WORDS`` words of text, with the documents of the block that hold the term, their
  counts and, one after the other, their positions. Blocks are made in the task that reads
  the texts, so that no word is moved by itself. Partitioned by a hash bucket of the term, so
  a query reads only the buckets of its terms, and there by term statistics;
* ``lengths``: (doc, n), the number of words of every document with any.

A document is named by a 64-bit key that the caller supplies. ``any_of``,
``all_of`` and ``phrase`` answer with documents, ``bm25`` with the k best of each
query. All are joins and aggregations over postings; the collection statistics are
sums over ``lengths``. A very common term has postings in proportion to the
documents that hold it: they are combined per task before anything moves.

Words are runs of ASCII letters and digits and of letters of any script, in lower
case. Null texts have no postings.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKETS = 64
#: Words that a task indexes at a time; a longer text goes alone.
BLOCK_WORDS = 1 << 20
#: Words of all queries together that are sent to the tasks; more are joined by shuffle.
ASKED_SENT = 1_000_000
K1, B = 1.2, 0.75
WORD = r"[\p{L}\p{N}]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def bucket_of(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _block(docs: list[tuple[int | None, pa.Array]]) -> pa.RecordBatch:
    """``term, docs, tfs, positions`` of the (key, words) given, a row a term."""
    terms = pa.concat_arrays([w for _, w in docs]).dictionary_encode()
    lengths = np.array([len(w) for _, w in docs], np.int64)
    row = np.repeat(np.arange(len(docs)), lengths)
    pos = (np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
    order = np.argsort(code := terms.indices.to_numpy(), kind="stable")         # by term, then row and position
    code, row = code[order], row[order]
    first = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (row[1:] != row[:-1])])
    tfs = np.diff(np.r_[first, len(code)]).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, np.diff(code[first]) != 0])             # of each term, among (term, row)
    per_term = pa.array(np.r_[starts, len(first)], pa.int32())
    keys = pa.array([k for k, _ in docs], pa.int64()).take(pa.array(row[first]))
    places = pa.ListArray.from_arrays(per_term, pa.ListArray.from_arrays(pa.array(np.r_[first, len(code)], pa.int32()), pa.array(pos[order])))
    return pa.RecordBatch.from_arrays(
        [terms.dictionary.take(pa.array(code[first[starts]])), pa.ListArray.from_arrays(per_term, keys),
         pa.ListArray.from_arrays(per_term, pa.array(tfs)), places], names=["term", "docs", "tfs", "positions"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, total = [], 0
    for batch in batches:
        keys, lists = batch.column(0).to_pylist(), batch.column(1)
        for i, key in enumerate(keys):
            found = lists[i].values
            if not len(found):
                continue
            if held and total + len(found) > BLOCK_WORDS:
                yield _block(held)
                held, total = [], 0
            held.append((key, found))
            total += len(found)
    if held:
        yield _block(held)


def build(docs: DataFrame, key: str, text: str, path: str, buckets: int = BUCKETS) -> None:
    """Write the index of ``docs`` under ``path``; ``key`` is a whole number, one row a key."""
    held = docs.select(F.col(key).cast("long").alias("doc"), words(F.col(text)).alias("w"))
    held.select("doc", F.size("w").cast("long").alias("n")).filter("n > 0").write.mode("overwrite").parquet(f"{path}/lengths")
    made = held.mapInArrow(_blocks, "term string, docs array<long>, tfs array<long>, positions array<array<int>>")
    # files of a bucket are as large as the session likes a partition, however many tasks there were
    (made.withColumn("bucket", bucket_of(F.col("term"), buckets)).hint("rebalance", "bucket")
     .sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings"))


def _unpacked(blocks: DataFrame, *columns: str) -> DataFrame:
    """``term, doc`` and the ``columns`` (of ``tfs`` and ``positions``) of blocks, a row a term and row of the indexed table."""
    return blocks.select("term", F.inline(F.arrays_zip("docs", *columns))).withColumnRenamed("docs", "doc")


def _of_terms(spark: SparkSession, path: str, terms: Sequence[str], buckets: int) -> DataFrame:
    wanted = sorted({t.lower() for t in terms})
    row = spark.range(1).select(F.array_distinct(F.transform(F.array(*[F.lit(t) for t in wanted]), lambda t: bucket_of(t, buckets))).alias("b")) if wanted else None
    parts = row.first().b if wanted else []
    return spark.read.parquet(f"{path}/postings").filter(F.col("bucket").isin(parts) & F.col("term").isin(wanted)).drop("bucket")


def postings(spark: SparkSession, path: str, terms: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """The postings (term, doc, tf, positions) of the given words: only their buckets are listed, and the term filter is
    pushed to the scan. Of a document that the indexed table has several times they are put together."""
    rows = _unpacked(_of_terms(spark, path, terms, buckets), "tfs", "positions")
    return rows.groupBy("term", "doc").agg(F.sum("tfs").alias("tf"), F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))


def any_of(spark: SparkSession, path: str, phrases: Sequence[str]) -> DataFrame:
    """``doc``: documents that hold at least one of the phrases (words side by side)."""
    out = None
    for p in phrases:
        found = phrase(spark, path, p)
        out = found if out is None else out.union(found)
    return out.distinct() if out is not None else spark.createDataFrame([], "doc long")


def all_of(spark: SparkSession, path: str, terms: Sequence[str]) -> DataFrame:
    """``doc``: documents that hold all of the words."""
    wanted = {t.lower() for t in terms}
    held = _of_terms(spark, path, sorted(wanted), BUCKETS).select("term", F.explode("docs").alias("doc"))
    found = held.groupBy("doc").agg(F.size(F.collect_set("term")).alias("n"))       # at most the asked words a document
    return found.filter(F.col("n") == len(wanted)).select("doc")


def phrase(spark: SparkSession, path: str, text: str) -> DataFrame:
    """``doc``: documents that hold the words of ``text`` side by side, in order."""
    import re
    wanted = re.findall(r"[^\W_]+", text.lower())
    if not wanted:
        return spark.createDataFrame([], "doc long")
    offsets: dict[str, list[int]] = {}
    for i, w in enumerate(wanted):
        offsets.setdefault(w, []).append(i)
    table = F.create_map(*[x for w, at in offsets.items() for x in (F.lit(w), F.array(*[F.lit(i) for i in at]))])
    starts = (_unpacked(_of_terms(spark, path, wanted, BUCKETS), "positions").select("doc", "term", F.explode("positions").alias("pos"))
              .select("doc", "pos", F.explode(table[F.col("term")]).alias("at")).select("doc", (F.col("pos") - F.col("at")).alias("start")))
    return starts.groupBy("doc", "start").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(wanted)).select("doc").distinct()


def bm25(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, query_key: str = "query_id", query_text: str = "text",
         k1: float = K1, b: float = B) -> DataFrame:
    """``query_key, doc, score, rank``: the ``k`` best documents of each query; equal scores by document.

    ``score`` sums ``ln(1 + (N - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * n / mean n))``
    over the query's words (repeats count), rounded to 9 digits.
    """
    lengths = spark.read.parquet(f"{path}/lengths")
    n_docs, mean = lengths.agg(F.count(F.lit(1)), F.avg("n")).first()
    asked = (queries.select(F.col(query_key).alias("q"), F.explode(words(F.col(query_text))).alias("term"))
             .groupBy("q", "term").agg(F.count(F.lit(1)).alias("times")))
    held = spark.read.parquet(f"{path}/postings").select("term", "docs", "tfs", "bucket")
    few = asked.select("term").distinct().withColumn("bucket", bucket_of(F.col("term")))
    held = _unpacked(held.join(few, ["bucket", "term"], "left_semi"), "tfs")
    # the postings move once, by document: they meet its length, and its scores are added up, where they are
    held = held.repartition("doc").groupBy("doc", "term").agg(F.sum("tfs").alias("tf"))
    df = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.log(F.lit(1.0) + (F.lit(float(n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = asked.join(df, "term").select("q", "term", (F.col("times") * weight).alias("w"))
    weights = F.broadcast(weights) if asked.count() <= ASKED_SENT else weights
    part = F.col("w") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.lit(mean)))
    scored = (held.join(lengths, "doc").join(weights, "term").groupBy("q", "doc").agg(F.round(F.sum(part), 9).alias("score")))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "doc"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select(F.col("q").alias(query_key), "doc", "score", "rank")
