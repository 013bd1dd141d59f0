"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, operator by operator."""
import pytest
from pyspark.sql import functions as F

from labelforge.llm import (
    decontaminate,
    jaccard_join,
    license_scan,
    line_dedup,
    quality_rules,
    secret_scan,
    source_mix,
    toxicity,
    url_filter,
    warc_store,
)

LONG = " ".join(f"w{i % 997}x{i % 13}" for i in range(40_000))
CLASH = "_n string, size string, `set` string, gid string, line string, digest string, host string, k string, removed string"
DOCS = [(1, "one two three four five six", "en", "a"), (2, None, None, None), (3, "", "en", "a"),
        (None, "one two three four five six", "en", "b"), (4, LONG, "de", "b"), (1, "one two three four five six", "en", "a"),
        (5, " \n\t\n ", "en", "a")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*d, *["x"] * 9) for d in DOCS]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, {CLASH}")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 1, 1), (3, None, None), (4, 0, 1)],
                                 "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(7, "one two three four five"), (8, None), (None, "one two three four"), (9, "two")],
                                 "item_id long, text string")


def by_id(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: tuple((x is not None, str(x)) for x in r))


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string, path string, _html string, _key string")


def test_quality(docs, labels):
    out = by_id(quality_rules.judge(docs, labels), "doc_id", "n_words", "word_chars", "base_failed", "kept")
    assert len(out) == len(DOCS)
    assert out.count((1, 6, 22, True, False)) == 2
    assert (2, 0, 0, True, False) in out and (5, 0, 0, True, False) in out
    assert quality_rules.judge(docs.limit(0), labels.limit(0)).count() == 0


def test_jaccard(docs):
    out = by_id(jaccard_join.classes(docs, words=4, percent=85), "doc_id", "n_shingles", "component_id")
    assert out.count((1, 3, 1)) == 2 and (None, 3, 1) in out
    assert (2, 0, 2) in out and (3, 0, 3) in out and (5, 0, 5) in out
    assert jaccard_join.classes(docs.limit(0)).count() == 0
    kept = jaccard_join.keep_one(docs, words=4, percent=85)
    assert kept.columns == docs.columns
    assert by_id(kept, "doc_id") == [(1,), (2,), (3,), (4,), (5,)]


def test_line_dedup(docs):
    out = by_id(line_dedup.report(docs), "doc_id", "n_lines", "n_removed")
    # the null id sorts first, so the others lose the line; repeated rows lose it together
    assert out.count((1, 1, 1)) == 2 and (None, 1, 0) in out and (2, 1, 0) in out and (5, 3, 0) in out
    text = line_dedup.deduplicate(docs.drop("removed"))
    assert sorted(x.text for x in text.where("doc_id = 1").collect()) == ["", ""]
    assert text.where("doc_id = 2").first().text is None
    assert line_dedup.report(docs.limit(0)).count() == 0


def test_toxicity(docs, labels):
    out = by_id(toxicity.judge_documents(docs, labels), "doc_id", "rejected")
    assert len(out) == len(DOCS)
    none = toxicity.judge_documents(docs, labels.limit(0))
    assert none.where("rejected").count() == 0 and none.count() == len(DOCS)
    assert toxicity.judge_documents(docs.limit(0), labels).count() == 0


def test_decontaminate(docs, items):
    out = by_id(decontaminate.leaked_pairs(docs, items), "doc_id", "item_id", "score")
    # the item without an id is searched like the others
    assert out == [(None, None, 1.0), (None, 7, 1.0), (1, None, 1.0), (1, None, 1.0), (1, 7, 1.0), (1, 7, 1.0)]
    kept = decontaminate.find_leaks(docs, items, column="leaks")
    assert kept.columns == [*docs.columns, "leaks"] and kept.where("size(leaks) = 0").count() == len(DOCS) - 3
    assert decontaminate.leaked_pairs(docs, items.limit(0)).count() == 0
    assert decontaminate.leaked_pairs(docs.limit(0), items).count() == 0


def test_secrets_and_licences(docs):
    out = by_id(secret_scan.scan(docs), "doc_id", "n_assign", "spans")
    assert out.count((1, 0, "")) == 2 and (None, 0, "") in out and len(out) == len(DOCS)
    assert secret_scan.scan(docs.limit(0)).count() == 0
    out = by_id(license_scan.scan(docs), "doc_id", "license", "n_notices", "notices")
    assert out.count((1, None, 0, "")) == 2 and len(out) == len(DOCS)
    assert license_scan.scan(docs.limit(0)).count() == 0


def test_mix(docs):
    out = source_mix.mix(docs)
    rows = by_id(out, "doc_id", "size", "source_size", "source")
    assert rows.count((1, 6, 12, "a")) == 2 and (2, 0, 0, None) in rows and (None, 6, 40_006, "b") in rows
    assert out.where("taken > 2 * size OR taken < 0").count() == 0
    per = {r.source: (r.t, r.g) for r in out.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()}
    assert all(t == int(g) for t, g in per.values())
    assert source_mix.mix(docs.limit(0)).count() == 0


def test_urls_and_archives(spark):
    rows = [(1, "https://A.example.org/es/1?x", "<p>", "h", "p", "q", "k"), (2, None, None, "h", "p", "q", "k"),
            (None, "no scheme", "<p>", "h", "p", "q", "k"), (3, "http://x.org?q", "", "h", "p", "q", "k"),
            (1, "https://A.example.org/es/1?x", "<p>", "h", "p", "q", "k")]
    table = pages(spark, rows)
    out = by_id(url_filter.judge(table), "page_id", "host", "path", "rule", "verdict")
    assert out.count((1, "a.example.org", "/es/1", "example.org/es/", "block")) == 2
    assert (2, "", "", None, "allow") in out and (None, "", "", None, "allow") in out and (3, "x.org", "", None, "allow") in out
    assert url_filter.judge(table.limit(0)).count() == 0
    manifest, folder = warc_store.write_archives(table)
    back = by_id(warc_store.read_archives(manifest, folder), "page_id", "payload_bytes", "record_type", "refers_to")
    # the two rows of page 1 are one original; the row without an id revisits it
    assert back == [(None, 3, "revisit", 1), (1, 3, "response", None), (1, 3, "response", None),
                    (2, 0, "response", None), (3, 0, "revisit", 2)]
    manifest, folder = warc_store.write_archives(table.limit(0))
    assert manifest.count() == 0 and warc_store.read_archives(manifest, folder).count() == 0
