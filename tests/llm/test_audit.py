"""The divergence audit against a plain table of all terms, and edge cases."""
import random
import re
from collections import Counter, defaultdict

import numpy as np

from labelforge.llm import source_audit

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, lang string, source string, g string, n string, docs string, term string, cells string, segment string, total string"


def plain(docs, min_docs=10, top=10):
    counts, held = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in docs:
        words = TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
        counts[(lang or "", source or "")].update(words)
        held[lang or ""].update(set(words))
    out = []
    for lang in held.keys() | {g[0] for g in counts}:
        kept = [t for t, n in held[lang].items() if n >= min_docs]
        groups = sorted(s for x, s in counts if x == lang)
        columns = {s: counts[(lang, s)] for s in groups}
        every = {t: sum(c[t] for c in columns.values()) for t in kept}

        def share(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10 ** 9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}
        q, p = share(every), {s: share(c) for s, c in columns.items()}

        def f(a, b):
            return (a - b) ** 2 // (a + b)
        for s in groups:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o) for o in groups if o != s)
            out += [(lang, s, "pair", o, -v, r) for r, (v, o) in enumerate(pairs, 1)]
            own = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if columns[s][t] > 0 and p[s][t] > q[t])[:top]
            out += [(lang, s, "term", t, -v, r) for r, (v, _, t) in enumerate(own, 1)]
    return sorted(out, key=str)


def frame(spark, docs):
    return spark.createDataFrame([(*d, *[None] * 7) for d in docs], SCHEMA)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def corpus():
    random.seed(5)
    words = [a + b for a in ("a", "Be", "çe", "日", "zo") for b in ("ta", "nu", "RI", "ß", "-x", "9q", "lo", "mi")]
    docs = [(i, " ".join(random.choices(words, k=random.randint(0, 12))), random.choice(["en", "de"]), random.choice(["s1", "s2", "s3", "Ä", ""]))
            for i in range(400)]
    docs += [(1, "the same words again", "en", "hot")] * 120                    # repeated rows, ties
    docs += [(None, None, None, None), (None, "rare words", None, "x"), (2, "", "fr", "only"), (3, "w " * 40_000, "en", "long"), (4, "zu selten", "it", "a"),
             (5, None, "it", "b")]
    return docs


def test_equals_a_plain_table(spark, monkeypatch):
    docs = corpus()
    out = source_audit.audit(frame(spark, docs))
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert rows_of(out) == plain(docs)
    monkeypatch.setattr(source_audit, "SEGMENT", 7)
    monkeypatch.setattr(source_audit, "ENTRIES", 50)
    assert rows_of(source_audit.audit(frame(spark, docs), top=4)) == plain(docs, top=4)


def test_empty_and_bare(spark):
    assert source_audit.audit(frame(spark, [])).count() == 0
    few = [(1, "one two", "en", "a"), (2, "two", "en", "b"), (3, None, "en", "c")]
    assert rows_of(source_audit.audit(frame(spark, few))) == plain(few)


def test_shares_and_runs_are_exact_beyond_longs():
    p = source_audit.shares(np.array([0, 5, 10 ** 13, 3 * 10 ** 17]), 9 * 10 ** 17, 10 ** 6)
    assert p.tolist() == [1 + 10 ** 9 * (c + 2) // (9 * 10 ** 17 + 2 * 10 ** 6) for c in (0, 5, 10 ** 13, 3 * 10 ** 17)]
    at, f, i, j = source_audit.divergence(np.array([0, 4, 6]), np.array([1, 10 ** 9, 7]), np.array([0, 5]), np.array([3, 10 ** 9 + 1]))
    assert at.tolist() == [0, 4, 5, 6] and i.tolist() == [0, 1, 1, 2] and j.tolist() == [0, 0, 1, 1]
    assert f.tolist() == [(a - b) ** 2 // (a + b) for a, b in ((1, 3), (10 ** 9, 3), (10 ** 9, 10 ** 9 + 1), (7, 10 ** 9 + 1))]
