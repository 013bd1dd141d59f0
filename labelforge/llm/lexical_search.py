"""Operator 11: ranked lexical search with bag deduplication.

Every item is a query against all documents. Terms are runs of letters, digits
and non-ASCII characters, A-Z folded. Of the documents with at least one term
(N, with L terms in all) a document of n terms has the length part
``m = 100 - 25 + (25 n N) DIV L``; a term in df documents weighs
``w = floor(1000 ln((2 N + 2) / (2 df + 1)))`` and a document's score sums
``w * ((10^9 tf) DIV (1000 tf + 12 m))`` over the item's terms.

1. *Vectors.* One Arrow pass over the whole texts keeps n and, of the item
   vocabulary, (term, tf) of each document: a narrow table. N, L and df are sums
   over it.
2. *Bags.* Documents with the same vector and m have the same scores for every
   item. They are grouped by a hash of both and by the vector itself, which
   verifies equality; a bag keeps its number of documents and its smallest id.
3. *Scores.* A bag is scored once: batches of bags meet the items' postings in one
   sparse product, and a task passes on the best ``top`` bags of an item.
4. *Expansion.* Ranked by (score, smallest id) the first ``top`` bags hold the first
   ``top`` documents. Only the ids of those bags are fetched, again by hash and
   vector, and only the smallest ``top`` of a bag move, however large it is.

Items are searched in blocks of at most about ``BLOCK_ENTRIES`` (item, term)
entries; a block's vocabulary and postings are what a task holds of the items, so
they are bounded whatever the number of items, at one pass over the texts a block.

Edge cases: null, empty and blank texts have no terms, count in no statistic and
are never found; items without terms, or whose terms are in no document, give
no rows; rows that repeat item id and text are one item; every document row is a
result of its own, also where ids repeat; equal scores go by id, null ids last;
an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelforge.llm.common import discard, map_batches, written

#: (item, term) entries of a block of items; scores that a task holds at once; sums below this are exact in doubles.
BLOCK_ENTRIES, CELLS, EXACT = 2_000_000, 4_000_000, 1 << 53
#: Bytes of a text to their folded form: A-Z lower-cased, other ASCII but letters and digits a blank, the rest as it is.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """``_item, item, term, times``: the terms of each item; ``_item`` tells texts of one id apart."""

    def rows(given: Iterator[list]) -> Iterator[list]:
        for batch in given:
            yield [(i, h, t, n) for i, h, data in batch for t, n in Counter(data.translate(FOLDED).split()).items()]

    one = items.select(F.col(key).alias("item"), F.coalesce(F.col(text), F.lit("")).alias("t")).distinct()
    read = one.select("item", F.xxhash64("item", "t").alias("_item"), F.col("t").cast("binary").alias("t"))
    schema = T.StructType([T.StructField("item", items.schema[key].dataType), *T.StructType.fromDDL("_item long, term binary, times long").fields])
    return written(map_batches(read, rows, schema), "search-items")


def vectors(docs: DataFrame, key: str, text: str, vocabulary: list[bytes]) -> DataFrame:
    """``_id, n, vec``: of every document with terms, their number and the (term, tf) pairs of the vocabulary, as 32-bit numbers."""

    def rows(given: Iterator[list]) -> Iterator[list]:
        place = {t: i for i, t in enumerate(vocabulary)}
        for batch in given:
            out = []
            for ident, data in batch:
                words = data.translate(FOLDED).split()
                if words:
                    held = Counter(map(place.get, words))
                    held.pop(None, None)
                    out.append((ident, len(words), np.array(sorted(held.items()), np.uint32).tobytes()))
            yield out

    read = docs.select(F.col(key).cast("long").alias("_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))
    return map_batches(read, rows, T.StructType.fromDDL("_id long, n long, vec binary"))


def document_counts(vecs: DataFrame, size: int) -> DataFrame:
    """``term`` (its place in the vocabulary), ``df``: a row a term and task is moved."""

    def rows(given: Iterator[list]) -> Iterator[list]:
        df = np.zeros(size, np.int64)
        for batch in given:
            if batch:
                df += np.bincount(np.frombuffer(b"".join(v for v, in batch), np.uint32)[::2], minlength=size)
        yield [(i, int(df[i])) for i in np.flatnonzero(df).tolist()]

    return map_batches(vecs.select("vec"), rows, T.StructType.fromDDL("term int, df long")).groupBy("term").agg(F.sum("df").alias("df"))


def best_bags(bags: DataFrame, weights: np.ndarray, start: np.ndarray, item: np.ndarray, times: np.ndarray, n_items: int, top: int) -> DataFrame:
    """``place`` (of the item), ``bag, least, members, score``: the ``top`` bags of each item in each task.

    ``start``: where the postings (``item, times``) of each term begin.
    """
    longest = int(np.bincount(item, weights=times, minlength=1).max()) if len(item) else 0
    small = int(weights.max(initial=0)) * 1_000_000 * max(longest, 1) < EXACT
    step = max(top, CELLS // n_items)

    def rows(given: Iterator[list]) -> Iterator[list]:
        held = [np.zeros(0, np.int64) for _ in range(6)]          # place, -score, whether the id is null, least, bag, members
        floor = np.zeros(n_items, np.int64)

        def add(some: list) -> None:
            nonlocal held
            bag, least, members, m, vec = zip(*some)
            pairs = np.frombuffer(b"".join(vec), np.uint32).astype(np.int64).reshape(-1, 2)
            row = np.repeat(np.arange(len(some)), [len(v) // 8 for v in vec])
            term, tf = pairs[:, 0], pairs[:, 1]
            part = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * np.array(m, np.int64)[row]))
            many = start[term + 1] - start[term]
            ends = np.cumsum(many)
            at = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - many, many) + np.repeat(start[term], many)
            cell, value = np.repeat(row, many) * n_items + item[at], np.repeat(part, many) * times[at]
            if small:
                scores = np.bincount(cell, weights=value, minlength=len(some) * n_items).astype(np.int64)
            else:
                scores = np.zeros(len(some) * n_items, np.int64)
                np.add.at(scores, cell, value)
            scores = scores.reshape(len(some), n_items)
            if len(some) >= top:
                np.maximum(floor, np.partition(scores, len(some) - top, axis=0)[len(some) - top], out=floor)
            r, p = np.nonzero((scores >= floor) & (scores > 0))
            ids, nul = np.array([x or 0 for x in least], np.int64), np.array([x is None for x in least], np.int64)
            new = (p, -scores[r, p], nul[r], ids[r], np.array(bag, np.int64)[r], np.array(members, np.int64)[r])
            held = [np.concatenate([a, b]) for a, b in zip(held, new)]
            order = np.lexsort((held[4], held[3], held[2], held[1], held[0]))
            place = held[0][order]
            order = order[np.arange(len(place)) - np.searchsorted(place, place) < top]
            held = [a[order] for a in held]

        for batch in given:
            for k in range(0, len(batch), step):
                add(batch[k:k + step])
        for k in range(0, len(held[0]), 50_000):
            yield [(p, b, None if no else x, c, -s) for p, s, no, x, b, c in zip(*(a[k:k + 50_000].tolist() for a in held))]

    read = bags.select("bag", "least", "members", "m", "vec")
    return map_batches(read, rows, T.StructType.fromDDL("place int, bag long, least long, members long, score long"))


def _ranked(df: DataFrame, top: int, *order) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("place").orderBy(F.desc("score"), *order))
    return df.withColumn("rank", rank).where(F.col("rank") <= top)


def search_block(docs: DataFrame, entries: list, key: str, text: str, top: int) -> DataFrame:
    """``_item, rank, _id, score`` for the items of ``entries`` (rows ``_item, term, times``)."""
    spark = docs.sparkSession
    vocabulary, names = sorted({r.term for r in entries}), sorted({r._item for r in entries})
    term, name = {t: i for i, t in enumerate(vocabulary)}, {x: i for i, x in enumerate(names)}
    postings = np.array(sorted((term[r.term], name[r._item], r.times) for r in entries), np.int64).reshape(-1, 3)
    start = np.searchsorted(postings[:, 0], np.arange(len(vocabulary) + 1))
    vecs = written(vectors(docs, key, text, [bytes(t) for t in vocabulary]), "search-vectors", compression="zstd")
    n_docs, n_terms = vecs.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1).cast("double")))
    weights = np.zeros(len(vocabulary), np.int64)
    for r in document_counts(vecs, len(vocabulary)).select("term", weight.alias("w")).collect():      # at most a row a term of the block
        weights[r.term] = r.w
    m = F.expr(f"75 + (25 * n * {n_docs}L) DIV {max(n_terms, 1)}L")
    hashed = vecs.where(F.octet_length("vec") > 0).select("_id", m.alias("m"), "vec").withColumn("bag", F.xxhash64("vec", "m"))
    # equal hashes of unequal bags stay apart, as the vector and m are part of the key
    bags = written(hashed.groupBy("bag", "vec", "m").agg(F.min("_id").alias("least"), F.count(F.lit(1)).alias("members")),
                   "search-bags", compression="zstd")
    found = best_bags(bags, weights, start, postings[:, 1], postings[:, 2], len(names), top)
    first = written(_ranked(found, top, F.asc_nulls_last("least"), "bag").drop("rank"), "search-best")
    # members of the bags found: at most `top` a bag leave a task
    wanted = first.where("members > 1").select("bag", "least").distinct()
    chosen = bags.join(wanted.withColumnRenamed("least", "l"), "bag").where("least <=> l").select("bag", "vec", "m", "least")
    some = hashed.join(chosen, ["bag", "vec", "m"]).select("bag", "least", "_id")
    nth = F.row_number().over(Window.partitionBy("bag", "least").orderBy(F.asc_nulls_last("_id")))
    some = some.withColumn("nth", nth).where(F.col("nth") <= top).select(F.col("bag").alias("_b"), F.col("least").alias("_l"), "_id")
    many = first.where("members > 1").join(some, (F.col("bag") == F.col("_b")) & F.col("least").eqNullSafe(F.col("_l"))).select("place", "_id", "score")
    every = first.where("members = 1").select("place", F.col("least").alias("_id"), "score").union(many)
    ranked = _ranked(every, top, F.asc_nulls_last("_id"))
    item = spark.createDataFrame([(i, x) for i, x in enumerate(names)], "place int, _item long")
    out = written(ranked.join(item, "place").select("_item", "rank", "_id", "score"), "search-found")
    for t in (vecs, bags, first):
        discard(t)
    return out


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
           top: int = 20) -> DataFrame:
    """``item_key, rank, key, score``: the ``top`` documents of each item with a score above 0; ``key`` is a whole number."""
    if not isinstance(docs.schema[key].dataType, T.IntegralType):
        raise ValueError(f"{key} must be a whole number")
    terms = item_terms(items, item_key, item_text)
    blocks = max(1, -(-terms.count() // BLOCK_ENTRIES))
    out = None
    for b in range(blocks):
        entries = terms.where(F.pmod(F.xxhash64("_item"), F.lit(blocks)) == b).select("_item", "term", "times").collect()   # bounded by BLOCK_ENTRIES
        if entries:
            found = search_block(docs, entries, key, text, top)
            out = found if out is None else out.union(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], "_item long, rank int, _id long, score long")
    named = terms.select("_item", "item").distinct()
    return out.join(named, "_item").select(F.col("item").alias(item_key), F.col("rank").cast("int").alias("rank"),
                                           F.col("_id").cast(docs.schema[key].dataType).alias(key), "score")
