"""Proof queries over the inverted index of ``documents`` (P12)."""

from __future__ import annotations

from labelforge.operators import text_index as TI
from labelforge.plans import standins as S
from labelforge.plans.registry import proof
from labelforge.session import work_path

WORDS_SQL = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"
ANY, ALL = ["worthless", "excellent", "nicht", "in the"], ["the", "and", "of"]


def _index(spark, d):
    def build():
        path = work_path(spark, "text-index")
        TI.build(S.table(spark, d, "documents"), "doc_id", "text", path)
        return path
    return S.landed(spark, d, "_text_index", build)


@proof("index_any_of",
       f"SELECT doc_id AS doc FROM (SELECT doc_id, ' ' || array_to_string({WORDS_SQL}, ' ') || ' ' AS t FROM documents) WHERE "
       + " OR ".join(f"contains(t, ' {p} ')" for p in ANY))
def index_any_of(spark, d):
    return TI.any_of(spark, _index(spark, d), ANY)


@proof("index_all_of",
       f"SELECT doc_id AS doc FROM (SELECT doc_id, {WORDS_SQL} AS w FROM documents) WHERE " + " AND ".join(f"list_contains(w, '{t}')" for t in ALL))
def index_all_of(spark, d):
    return TI.all_of(spark, _index(spark, d), ALL)


BM25_SQL = f"""
WITH d AS (SELECT doc_id AS doc, {WORDS_SQL} AS w FROM documents), l AS (SELECT doc, len(w) AS n FROM d WHERE len(w) > 0),
c AS (SELECT count(*)::DOUBLE AS docs, avg(n) AS mean FROM l),
t AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(w) AS term FROM d) GROUP BY ALL),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({WORDS_SQL}) AS term FROM benchmark) GROUP BY ALL),
f AS (SELECT term, ln(1 + (docs - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM t, c GROUP BY term, docs),
s AS (SELECT item_id, doc, round(sum(times * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 9) AS score
  FROM q JOIN t USING (term) JOIN f USING (term) JOIN l USING (doc), c GROUP BY ALL)
SELECT item_id, doc, round(score, 5) AS score FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc) <= 10"""


@proof("index_bm25", BM25_SQL)
def index_bm25(spark, d):
    from pyspark.sql import functions as F
    found = TI.bm25(spark, _index(spark, d), S.table(spark, d, "benchmark"), 10, "item_id")
    return found.select("item_id", "doc", F.round("score", 5).alias("score"))
