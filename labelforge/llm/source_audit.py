"""Operator 12: divergence audit of sources over run-length columns.

Of every language the terms that occur in enough of its documents are kept. A
group (language, source) is a column over these terms, and so is the language
itself. Two columns diverge by ``f = floor((p - q)^2 / (p + q))`` a term, with
``p = 1 + floor(10^9 (count + 2) / (N + 2 V))``.

1. *Counts.* Arrow batches count terms and the documents that hold them for each
   group, in a dictionary of bounded size a task; Spark adds them up.
2. *Order.* Terms of a language are range-sorted by their counts in its groups
   (the group with the most documents first), which puts equal counts side by side.
   Sorted partitions are cut into segments of at most ``SEGMENT`` terms, wherever
   a hot language's terms lie.
3. *Runs.* In a segment the column of each group is a list of runs of equal
   counts. A group without any of its terms is one run of zeros and is not stored.
4. *Audit.* A task has the runs of one segment. For two columns it intersects the
   run boundaries, computes f once a run and multiplies it by the run's length; f
   of a group against its language also gives the terms that set it apart. Sums
   over segments and ranks are Spark aggregations.

All arithmetic is on whole numbers, exact at any count: ``p`` is computed with
unbounded integers once a run and lies within 10^9 + 1, so f fits in a long.

Edge cases: null texts, languages and sources read as ''; a group without terms
has N = 0 and equal p for all terms; a language without kept terms gives its
pairs with value 0; the only source of a language has no pair; equal values are
ranked by term or source in UTF-8 order; repeated rows count each; an empty
table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelforge.llm.common import discard, map_batches, written

#: Entries of a task's dictionary before it is sent on; terms of a segment; the scale of p.
ENTRIES, SEGMENT, SCALE = 400_000, 8192, 10 ** 9
#: Bytes of a text to their folded form: A-Z lower-cased, other ASCII but letters a blank, everything else as it is.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def count_terms(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents of each term in each group, summed up."""

    def rows(given: Iterator[list]) -> Iterator[list]:
        seen: dict[tuple, tuple[Counter, Counter]] = {}

        def drained() -> list:
            out = [(a, b, t, c, held[t]) for (a, b), (total, held) in seen.items() for t, c in total.items()]
            seen.clear()
            return out

        for batch in given:
            for a, b, data in batch:
                words = data.translate(FOLDED).split()
                if words:
                    total, held = seen.setdefault((a, b), (Counter(), Counter()))
                    own = Counter(words)
                    total.update(own)
                    held.update(own.keys())
            if sum(len(total) for total, _ in seen.values()) > ENTRIES:
                yield drained()
        yield drained()

    read = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"),
                       F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))
    partial = map_batches(read, rows, T.StructType.fromDDL("lang string, source string, term binary, n long, docs long"))
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def columns_of(counts: DataFrame, docs: DataFrame, lang: str, source: str, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """``lang, term, cells`` (array of (g, count), ordered) of kept terms, and ``lang, g, source, total, terms`` of the
    groups (g = 0: the language itself, with null source; else by number of documents, largest first)."""
    found = docs.groupBy(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"),
                         F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("rows"))
    named = written(found.withColumn("g", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("rows"), "source"))).drop("rows"), "audit-groups")
    kept = written(counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
                   .where(F.col("docs") >= min_docs).drop("docs"), "audit-kept")
    own = written(counts.join(kept.drop("n"), ["lang", "term"]).join(named, ["lang", "source"]).select("lang", "g", "term", "n")
                  .union(kept.select("lang", F.lit(0).alias("g"), "term", "n")), "audit-cells")
    totals = own.groupBy("lang", "g").agg(F.sum("n").alias("total"))
    terms = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    every = named.select("lang", "g", "source").union(named.select("lang", F.lit(0), F.lit(None).cast("string")).distinct())
    groups = every.join(totals, ["lang", "g"], "left").join(terms, "lang", "left").fillna(0, ["total", "terms"])
    # at most one cell a group of the language
    cells = own.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("g", "n"))).alias("cells"))
    return cells, written(groups, "audit-totals")


def runs_of(cells: DataFrame) -> DataFrame:
    """``lang, segment, length, g, starts, counts`` (binary longs): the runs of each group that occurs in the segment,
    and with g = -1 the segment's terms, in order."""

    def rows(given: Iterator[list]) -> Iterator[list]:
        from pyspark import TaskContext
        base, made = TaskContext.get().partitionId() << 32, 0
        held: list[tuple] = []

        def close() -> list:
            nonlocal made
            made += 1
            place = np.repeat(np.arange(len(held)), [len(c) for _, _, c in held])
            group = np.array([x["g"] for _, _, c in held for x in c], np.int64)
            count = np.array([x["n"] for _, _, c in held for x in c], np.int64)
            out = [(held[0][0], base + made, len(held), -1, None, None, [t for _, t, _ in held])]
            order = np.argsort(group, kind="stable")
            edges = np.flatnonzero(np.diff(group[order], prepend=-1, append=-1))
            for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
                column = np.zeros(len(held), np.int64)
                column[place[order[s:e]]] = count[order[s:e]]
                starts = np.flatnonzero(np.concatenate(([True], column[1:] != column[:-1])))
                out.append((held[0][0], base + made, len(held), int(group[order[s]]), starts.tobytes(), column[starts].tobytes(), None))
            held.clear()
            return out

        for batch in given:
            for row in batch:
                if held and (held[0][0] != row[0] or len(held) == SEGMENT):
                    yield close()
                held.append(row)
        if held:
            yield close()

    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a language's rare terms come first, ordered by the groups that hold them; then by their counts there
    profile = F.transform(F.filter("cells", lambda x: x["g"] > 0), lambda x: F.struct(x["g"], -x["n"]))
    ordered = (cells.withColumn("profile", profile).repartitionByRange(parts, "lang", "profile", "term")
               .sortWithinPartitions("lang", "profile", "term").select("lang", "term", "cells"))
    return map_batches(ordered, rows, T.StructType.fromDDL(
        "lang string, segment long, length int, g long, starts binary, counts binary, terms array<binary>"))


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """p of each count, in whole numbers of any size."""
    whole = total + 2 * terms
    return np.array([1 + SCALE * (int(c) + 2) // whole for c in counts], np.int64)


def divergence(starts_a: np.ndarray, p: np.ndarray, starts_b: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The intersected runs of two columns: (starts, f, run of a, run of b)."""
    starts = np.union1d(starts_a, starts_b)
    i, j = np.searchsorted(starts_a, starts, "right") - 1, np.searchsorted(starts_b, starts, "right") - 1
    d = p[i] - q[j]
    return starts, d * d // (p[i] + q[j]), i, j


def audit_segment(top: int):
    def audit(runs: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if not len(runs):
            return pd.DataFrame(out, columns=["lang", "a", "b", "term", "value"])
        length, lang = int(runs["length"].iloc[0]), runs["lang"].iloc[0]
        terms = next(t for g, t in zip(runs["g"], runs["terms"]) if g == -1)
        stored = {g: (np.frombuffer(s, np.int64), np.frombuffer(c, np.int64)) for g, s, c in zip(runs["g"], runs["starts"], runs["counts"]) if g >= 0}
        empty = (np.zeros(1, np.int64), np.zeros(1, np.int64))
        columns = {}
        for g, total, v in zip(groups["g"], groups["total"], groups["terms"]):
            starts, counts = stored.get(g, empty)
            columns[g] = (starts, counts, shares(counts, int(total), int(v)))
        ids = sorted(columns)
        ends = np.array([length])
        for x, g in enumerate(ids[1:], 1):
            starts, counts, p = columns[g]
            for h in ids[x + 1:]:
                at, f, _, _ = divergence(starts, p, columns[h][0], columns[h][2])
                out.append((lang, g, h, None, int((f * np.diff(at, append=ends)).sum())))
            if g not in stored:
                continue
            at, f, i, j = divergence(starts, p, columns[0][0], columns[0][2])
            long = np.diff(at, append=ends)
            own = np.flatnonzero((counts[i] > 0) & (p[i] > columns[0][2][j]))
            # whole runs from the highest f on, until they hold `top` terms and all ties of the last
            own = own[np.argsort(-f[own], kind="stable")]
            if len(own):
                last = f[own[min(np.searchsorted(np.cumsum(long[own]), top), len(own) - 1)]]
                best = [(-int(f[r]), terms[k]) for r in own[f[own] >= last].tolist() for k in range(at[r], at[r] + long[r])]
                out.extend((lang, g, None, t.decode("utf-8", "replace"), -f) for f, t in sorted(best)[:top])
        made = pd.DataFrame(out, columns=["lang", "a", "b", "term", "value"])
        return made.astype({"a": "Int64", "b": "Int64", "value": "int64"})
    return audit


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = 10, top: int = 10) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far each source of a language lies from each other one (part
    ``pair``) and the terms that it has more of than its language (part ``term``, the ``top`` ones)."""
    counts = written(count_terms(docs, text, lang, source), "audit-counts")
    cells, groups = columns_of(counts, docs, lang, source, min_docs)
    runs = written(runs_of(cells), "audit-runs")
    discard(counts)
    held = runs.select(F.col("lang").alias("l"), F.col("segment").alias("own")).distinct().join(groups.select(F.col("lang").alias("l"), "g", "total", "terms"), "l")
    found = written(runs.groupBy("segment").cogroup(held.groupBy("own"))
                    .applyInPandas(audit_segment(top), "lang string, a long, b long, term string, value long"), "audit-found")
    discard(runs)
    pairs = found.where("term IS NULL").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    # languages without kept terms have no segment
    bare = groups.where("g > 0 AND terms = 0").select("lang", F.col("g").cast("long").alias("g"))
    pairs = pairs.union(bare.withColumnRenamed("g", "a").join(bare.withColumnRenamed("g", "b"), "lang").where("a < b")
                        .withColumn("value", F.lit(0).cast("long")))
    names = groups.where("g > 0").select("lang", F.col("g").cast("long").alias("g"), "source")
    one, other = names.withColumnsRenamed({"g": "a", "source": "x"}), names.withColumnsRenamed({"g": "b", "source": "y"})
    pairs = pairs.join(one, ["lang", "a"]).join(other, ["lang", "b"])
    pairs = (pairs.select("lang", F.col("x").alias("source"), F.col("y").alias("item"), "value")
             .union(pairs.select("lang", "y", "x", "value")).withColumn("part", F.lit("pair")))
    terms = (found.where("term IS NOT NULL").join(one, ["lang", "a"]).select("lang", F.col("x").alias("source"), F.col("term").alias("item"), "value")
             .withColumn("part", F.lit("term")))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).where(F.col("rank") <= top))
    return ranked.select("lang", "source", "part", "item", "value", "rank")
