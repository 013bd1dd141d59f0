"""The incremental log catalogue and the inverted index."""
import json
import math
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from labelforge.operators import catalogue, text_index
from labelforge.operators.trials import read_trial_files

SCHEMA = "trial_id string, objective double"


def put(root, trial, *values):
    folder = root / f"model=m 1%/{trial}"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "result.json").write_text("".join(json.dumps({"trial_id": trial, "objective": v}) + "\n" for v in values))


def test_only_new_and_changed_files_are_read(spark, tmp_path):
    root, cat = tmp_path / "logs", str(tmp_path / "catalogue")
    read, opened = (lambda paths: opened.append(len(paths)) or read_trial_files(spark, paths, SCHEMA)), []

    def refresh():
        return catalogue.refresh(spark, str(root), cat, read, "*.json", skip_dir="checkpoint_tmp")

    def held():
        return sorted((r.trial_id, r.objective) for r in catalogue.rows(spark, cat).collect())
    for i in range(30):
        put(root, f"t{i}", i * 1.0)
    put(root, "checkpoint_tmp", 99.0)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    assert refresh() == 30 and opened == [30] and len(held()) == 30
    assert spark.read.parquet(f"{cat}/rows").select(F.input_file_name()).distinct().count() <= 4
    assert refresh() == 0 and opened == [30]
    time.sleep(1.1)
    put(root, "t3", 3.0, 33.0)
    put(root, "new", 7.0)
    assert refresh() == 2 and opened == [30, 2]
    assert held() == sorted([(f"t{i}", i * 1.0) for i in range(30)] + [("t3", 33.0), ("new", 7.0)])
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before


def test_a_refresh_that_died_is_repeated(spark, tmp_path, monkeypatch):
    root, cat = tmp_path / "logs", str(tmp_path / "catalogue")
    put(root, "a", 1.0)
    catalogue.refresh(spark, str(root), cat, lambda p: read_trial_files(spark, p, SCHEMA), "*.json")
    put(root, "b", 2.0)
    monkeypatch.setattr(catalogue, "SCAN_FILES", 1)
    put(root, "c", 3.0)

    def dies(paths):
        if any("/c/" in p for p in paths):
            raise OSError("lost")
        return read_trial_files(spark, paths, SCHEMA)
    with pytest.raises(OSError):
        catalogue.refresh(spark, str(root), cat, dies, "*.json")
    assert [r.trial_id for r in catalogue.rows(spark, cat).collect()] == ["a"]
    catalogue.refresh(spark, str(root), cat, lambda p: read_trial_files(spark, p, SCHEMA), "*.json")
    assert sorted(r.trial_id for r in catalogue.rows(spark, cat).collect()) == ["a", "b", "c"]


DOCS = [(1, "The quick brown fox"), (2, "the lazy dog and the quick cat"), (3, None), (4, ""), (5, "Quick, quick: brown? FOX-trot"), (6, "brown the quick"),
        (7, "naïve Ärger 日本 42"), (8, "cat " * 5000)]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "i")
    text_index.build(spark.createDataFrame(DOCS, "k long, t string"), "k", "t", path)
    return path


def docs_of(df):
    return sorted(r.doc for r in df.collect())


def test_words_phrases_and_their_or(spark, index):
    assert docs_of(text_index.phrase(spark, index, "Quick brown")) == [1, 5]
    assert docs_of(text_index.phrase(spark, index, "quick quick brown")) == [5]
    assert docs_of(text_index.phrase(spark, index, "ärger")) == [7]
    assert docs_of(text_index.phrase(spark, index, "cat cat cat")) == [8]
    assert docs_of(text_index.all_of(spark, index, ["THE", "quick"])) == [1, 2, 6]
    assert docs_of(text_index.any_of(spark, index, ["lazy dog", "trot", "nothing here", ""])) == [2, 5]
    assert docs_of(text_index.any_of(spark, index, [])) == []


def test_only_the_buckets_of_the_terms_are_scanned(spark, index):
    plan = text_index.postings(spark, index, ["fox"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0]
    assert "EqualTo(term,fox)" in plan or "In(term, [fox])" in plan


def test_bm25_equals_its_formula(spark, index):
    queries = [(1, "quick fox"), (2, "the the cat"), (3, "absent"), (4, None)]
    got = [(r.q, r.doc, r.score) for r in text_index.bm25(spark, index, spark.createDataFrame(queries, "q long, text string"), 3, "q").collect()]
    held = {d: Counter(re.findall(r"[^\W_]+", t.lower())) for d, t in DOCS if t}
    mean, n = sum(sum(c.values()) for c in held.values()) / len(held), len(held)
    want = []
    for q, text in queries:
        scores = {}
        for t in re.findall(r"[^\W_]+", (text or "").lower()):
            df = sum(t in c for c in held.values())
            for d, c in held.items():
                if c[t]:
                    part = math.log(1 + (n - df + 0.5) / (df + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean))
                    scores[d] = scores.get(d, 0) + part
        want += [(q, d, pytest.approx(s, abs=1e-8)) for d, s in sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:3]]
    assert sorted(got, key=lambda r: r[:2]) == sorted(want, key=lambda r: r[:2])


def test_no_word_is_moved_by_itself(spark, tmp_path, monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(text_index, "BLOCK_WORDS", 4)
    given = pa.RecordBatch.from_arrays([pa.array([5, None, 7, 8]), pa.array([["a", "b", "a"], ["a"], [], ["c", "c", "b", "a", "c"]])], names=["doc", "w"])
    blocks = [b.to_pylist() for b in text_index._blocks(iter([given]))]
    assert blocks[0] == [{"term": "a", "docs": [5, None], "tfs": [2, 1], "positions": [[0, 2], [0]]}, {"term": "b", "docs": [5], "tfs": [1], "positions": [[1]]}]
    assert {r["term"]: (r["docs"], r["tfs"], r["positions"]) for r in blocks[1]} == {"c": ([8], [3], [[0, 1, 4]]), "b": ([8], [1], [[2]]), "a": ([8], [1], [[3]])}
    monkeypatch.undo()
    path = str(tmp_path / "i")
    text_index.build(spark.createDataFrame([(1, "x y x"), (2, "y")], "k long, t string").coalesce(1), "k", "t", path)
    assert spark.read.parquet(f"{path}/postings").count() == 2          # a row a term, not a row a term and document
    assert sorted((r.term, r.doc, r.tf, r.positions) for r in text_index.postings(spark, path, ["x", "y"]).collect()) == [
        ("x", 1, 2, [0, 2]), ("y", 1, 1, [1]), ("y", 2, 1, [0])]
