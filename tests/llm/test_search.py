"""Lexical search against scoring every document, and edge cases."""
import math
import random
import re
from collections import Counter

import pytest

from labelforge.llm import lexical_search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, bag string, vec string, m long, place string, n string, least string, term string, rank string, score string"


def terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain(docs, items, top=20):
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for i, c, n in held:
            m = 75 + 25 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def frame(spark, docs):
    return spark.createDataFrame([(i, t, *[None] * 9) for i, t in docs], SCHEMA)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def corpus():
    random.seed(3)
    words = ["the", "of", "Ärger", "naïve", "x1", "42", "deep", "blue", "Sea", "sky", "fish", "日本", "red", "green"]
    docs = [(i, " ".join(random.choices(words, k=random.randint(1, 30)))) for i in range(300)]
    docs += [(1000 - i, "deep blue sea, deep blue sky") for i in range(150)]              # one bag, ids descending
    docs += [(2000 + i, f"deep blue sea deep blue sky filler{i}") for i in range(40)]      # the same vector, another length
    docs += [(7, "deep Blue-sea"), (7, "deep Blue-sea"), (None, "deep blue sea"), (None, None), (5000, ""), (5001, " \n!?"), (5002, "zzz " * 30_000),
             ((1 << 63) - 1, "red fish"), (-(1 << 63), "red fish")]
    items = [(1, "deep blue sea"), (2, "THE the the of"), (3, "naïve Ärger 日本"), (4, "nowhere tofind"), (5, None), (6, ""), (1, "deep blue sea"),
             (None, "red fish"), (2, "x1-42"), (8, "zzz fish")]
    return docs, items


def test_equals_scoring_every_document(spark):
    docs, items = corpus()
    out = lexical_search.search(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows_of(out) == plain(docs, items)


def test_blocks_of_items_and_small_batches(spark, monkeypatch):
    docs, items = corpus()
    monkeypatch.setattr(lexical_search, "BLOCK_ENTRIES", 4)
    monkeypatch.setattr(lexical_search, "CELLS", 40)
    monkeypatch.setattr(lexical_search, "EXACT", 0)
    out = lexical_search.search(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), top=7)
    assert rows_of(out) == plain(docs, items, 7)


def test_empty_tables(spark):
    docs, items = corpus()
    none = frame(spark, [])
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert lexical_search.search(none, asked).count() == 0
    assert lexical_search.search(frame(spark, docs), asked.limit(0)).count() == 0
    assert lexical_search.search(frame(spark, [(1, None)]), asked).count() == 0
    with pytest.raises(ValueError):
        lexical_search.search(none, asked, key="text")
