"""Operator 10: benchmark decontamination by rare n-gram seeds and local alignment.

1. Seeds. The documents that hold each word n-gram of the test items are
   counted over the whole corpus. In every stretch of ``SPACING`` consecutive
   n-grams of an item the rarest becomes a seed (of items under ``SHORT`` words
   every n-gram, as few of them survive edits), so every part of an item has a
   seed, however common its words or however often it has leaked.
2. Join. Every document is searched for every seed; a hit names an item and
   the place where the item would start.
3. Alignment. Around each hit, if the stretch has enough of the item's words
   at all (an upper bound of the score), Smith-Waterman aligns item and
   document by words (match +1, mismatch and gap ``-PENALTY``). The score is
   divided by the item's length; ``min_score`` and more is a leak, so edited
   and paraphrased copies count as well as exact ones.

The test items are read in blocks of about ``BLOCK_WORDS`` words, each a
bounded table sent to the tasks; a larger benchmark takes more passes, one block
live at a time, never a larger broadcast. Documents are not shuffled; only counts of n-grams are
(combined per batch). A leak in a third of all documents costs one alignment
per document.

Edge cases: null and empty texts have no leaks; items without ``N`` words
cannot be told from chance and match nothing; null item ids are searched like
others and come out as null; rows that repeat id and text are one item, items with equal texts match alike; repeated rows give repeated results; empty
tables give empty results; documents keep all their columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelforge.llm.common import map_batches, spare_name, written

N, SPACING, PENALTY, MIN_SCORE, BLOCK_WORDS, SHORT = 3, 3, 0.5, 0.5, 500_000, 30
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


class Block:
    """A bounded block of items: words as numbers, n-grams as sorted codes."""

    def __init__(self, items: list[tuple[object, str]]):
        self.ids = [i for i, _ in items]
        texts = [words_of(t) for _, t in items]
        self.number = {w: k for k, w in enumerate(sorted({w for t in texts for w in t}))}
        self.items = [np.array([self.number[w] for w in t], np.int64) for t in texts]
        if len(self.number) >= 1 << 21:
            raise ValueError("a block of test items has too many distinct words; lower BLOCK_WORDS")
        self.codes = np.unique(np.concatenate([self.grams(t) for t in self.items] or [np.zeros(0, np.int64)]))

    def numbers(self, text: str | None) -> np.ndarray:
        get = self.number.get
        words = words_of(text)
        return np.fromiter((get(w, -1) for w in words), np.int64, len(words))

    def grams(self, t: np.ndarray) -> np.ndarray:
        """The code of the n-gram at each place; -1 where a word is not the benchmark's."""
        if len(t) < N:
            return np.zeros(0, np.int64)
        code, known = np.zeros(len(t) - N + 1, np.int64), np.ones(len(t) - N + 1, bool)
        for k in range(N):
            part = t[k:len(t) - N + 1 + k]
            code = (code << 21) | np.maximum(part, 0)
            known &= part >= 0
        return np.where(known, code, -1)

    def find(self, codes: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Index in the sorted ``table`` of each code, -1 where it is not there."""
        if not len(table):
            return np.full(len(codes), -1)
        at = np.minimum(np.searchsorted(table, codes), len(table) - 1)
        return np.where(table[at] == codes, at, -1)

    def choose_seeds(self, documents: np.ndarray) -> None:
        """``documents``: the number of documents of each code."""
        seeds: dict[int, list[tuple[int, int]]] = {}
        for k, t in enumerate(self.items):
            codes = self.grams(t)
            df = documents[self.find(codes, self.codes)] if len(codes) else codes
            spacing = 1 if len(t) < SHORT else SPACING
            chosen = {min(range(i, min(i + spacing, len(codes))), key=lambda j: (df[j], j))
                      for i in range(max(len(codes) - spacing + 1, min(len(codes), 1)))}
            for j in sorted(chosen):
                seeds.setdefault(int(codes[j]), []).append((k, j))
        self.seeds = np.array(sorted(seeds), np.int64)
        self.places = [seeds[c] for c in self.seeds.tolist()]


def align(item: np.ndarray, stretches: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Best Smith-Waterman score of ``item`` in each row of ``stretches`` (linear gaps)."""
    slope = penalty * np.arange(stretches.shape[1] + 1)
    row, best = np.zeros((len(stretches), stretches.shape[1] + 1)), np.zeros(len(stretches))
    for word in item:
        new = np.zeros_like(row)
        new[:, 1:] = np.maximum(row[:, :-1] + np.where(stretches == word, 1.0, -penalty), row[:, 1:] - penalty)
        # the best way to arrive along the row: a running maximum with the gap cost taken out
        row = np.maximum(np.maximum.accumulate(np.maximum(new, 0) + slope, axis=1) - slope, 0)
        best = np.maximum(best, row.max(axis=1))
    return best


def leaks_of(block: Block, texts: list[str | None], min_score: float = MIN_SCORE) -> list[list[tuple[object, float]]]:
    """(item id, score) of the items that leaked into each text, by item."""
    waiting: dict[int, list[tuple[int, np.ndarray]]] = {}
    for row, text in enumerate(texts):
        t = block.numbers(text)
        hit = block.find(block.grams(t), block.seeds)
        starts: dict[int, set[int]] = {}
        for place in np.flatnonzero(hit >= 0):
            for item, offset in block.places[hit[place]]:
                starts.setdefault(item, set()).add(int(place) - offset)
        for item, found in starts.items():
            m = len(block.items[item])
            pad, last = m // 2 + 4, None
            for start in sorted(found):
                if last is not None and start - last <= pad // 2:
                    continue                           # the stretch before holds this one's start and the padding
                last = start
                width = m + 2 * pad
                stretch = np.full(width, -1, np.int64)
                lo, hi = max(start - pad, 0), min(start + m + pad, len(t))
                stretch[:hi - lo] = t[lo:hi]
                waiting.setdefault(item, []).append((row, stretch))
    out: list[dict] = [{} for _ in texts]
    for item, held in waiting.items():
        word = block.items[item]
        values, need = np.unique(word, return_counts=True)
        for i in range(0, len(held), 512):
            rows = [r for r, _ in held[i:i + 512]]
            stretches = np.stack([s for _, s in held[i:i + 512]])
            at = np.minimum(np.searchsorted(values, stretches), len(values) - 1)
            known = values[at] == stretches
            have = np.zeros((len(rows), len(values)), np.int64)
            np.add.at(have, (np.nonzero(known)[0], at[known]), 1)
            possible = np.flatnonzero(np.minimum(have, need).sum(axis=1) >= min_score * len(word))
            if len(possible):
                for r, s in zip(possible, align(word, stretches[possible]) / len(word)):
                    if s >= min_score:
                        out[rows[r]][item] = max(out[rows[r]].get(item, 0.0), float(s))
    return [[(block.ids[k], round(s, 6)) for k, s in sorted(found.items())] for found in out]


def blocks_of(items: DataFrame, key: str, text: str, block_words: int = BLOCK_WORDS) -> Iterator[Block]:
    """The distinct test items, one bounded block after the other; null ids are searched like others."""
    named = items.select(F.col(key).alias("_k"), F.coalesce(text, F.lit("")).alias("_t")).distinct()
    total = named.agg(F.sum(F.length("_t"))).first()[0] or 0
    count = max(1, -(-total // (5 * block_words)))      # words are about five characters or more
    part = F.pmod(F.xxhash64("_k", "_t"), F.lit(count))  # the items of one id are spread, too
    for k in range(count):
        yield Block([(r[0], r[1]) for r in named.where(part == k).orderBy("_k", "_t").collect()])


def find_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text",
               column: str = "leaks", min_score: float = MIN_SCORE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with ``column``: an array of (item_id, score), empty for clean documents.

    Of a benchmark of several blocks one is in memory at a time: the hits of each
    block are written by the hash of their text and joined to the documents at the end.
    """
    schema = T.ArrayType(T.StructType([T.StructField("item_id", items.schema[item_key].dataType), T.StructField("score", T.DoubleType())]))
    hits, leaks = [], None
    for block in blocks_of(items, item_key, item_text, block_words):
        if leaks is not None:
            hits.append(_hits(docs, text, leaks))
        leaks = _search(docs, block, text, schema, min_score)
    if not hits:
        return docs.withColumn(column, leaks(F.col(text)))
    hits.append(_hits(docs, text, leaks))
    every = hits[0]
    for more in hits[1:]:
        every = every.union(more)
    mark = spare_name(docs, "_leak_hash")
    every = every.groupBy("h").agg(F.flatten(F.collect_list("l")).alias(column)).withColumnRenamed("h", mark)      # a text's items
    found = docs.withColumn(mark, F.md5(text)).join(every, mark, "left").drop(mark)
    return found.withColumn(column, F.coalesce(F.col(column), F.array().cast(schema)))


def _hits(docs: DataFrame, text: str, leaks) -> DataFrame:
    """``h, l``: the leaks of the texts that have any, a row a text."""
    found = docs.select(F.md5(text).alias("h"), leaks(F.col(text)).alias("l")).where(F.size("l") > 0)
    return written(found.groupBy("h").agg(F.first("l").alias("l")), "leak-hits")


def _search(docs: DataFrame, block: Block, text: str, schema: T.ArrayType, min_score: float):
    """The function that finds a block's items in texts; its seeds are chosen by the n-grams' counts over all documents."""

    def count(given: Iterator[list]) -> Iterator[list]:
        seen = np.zeros(len(block.codes), np.int64)
        for batch in given:
            for (t,) in batch:
                at = block.find(block.grams(block.numbers(t)), block.codes)
                seen[np.unique(at[at >= 0])] += 1
        yield [(int(k), int(seen[k])) for k in np.flatnonzero(seen)]

    counts = (map_batches(docs.select(text), count, T.StructType.fromDDL("k int, n long"))
              .groupBy("k").agg(F.sum("n").alias("n")).collect())           # one row an n-gram of the block
    documents = np.zeros(len(block.codes), np.int64)
    for r in counts:
        documents[r.k] = r.n
    block.choose_seeds(documents)

    @F.pandas_udf(schema)
    def leaks(texts: pd.Series) -> pd.Series:
        made = []
        for i in range(0, len(texts), 500):
            made += leaks_of(block, [None if t is None else t for t in texts.iloc[i:i + 500]], min_score)
        return pd.Series([[{"item_id": k, "score": s} for k, s in one] for one in made])

    return leaks


def leaked_pairs(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, item_id, score``: a row for each document and item that leaked into it."""
    found = find_leaks(docs.select(key, F.col(text).alias("_text")), items, "_text", column="_leaks")
    return found.select(key, F.inline("_leaks"))
