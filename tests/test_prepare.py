import pytest
from pyspark.sql import functions as F

from labelforge.operators import prepare as prep
from labelforge.schemas import CORPUS_LABELS, CORPUS_SPEC, label_file_schema


def _corpus(spark):
    abstracts = spark.createDataFrame(
        [(1, "t1", "a, \"quoted\"\nline"), (2, "t2", "b"), (3, "t3", "c"), (4, "t4", "d")],
        "PMID long, Title string, Abstract string")
    vals = [
        (1, "Train", 2, 1, 1.0, 0.0, 1.0, 0.0, 1.0, 0.0, None),
        (2, "Validation", 3, 0, 0.0, 1.0, float("nan"), 1.0, 0.0, 1.0, 0.0),
        (3, "Test", 1, 1, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0),
        (4, "train", 2, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0),   # case differs: dropped
    ]
    labels = spark.createDataFrame(vals, label_file_schema(CORPUS_LABELS))
    return abstracts, labels


def test_binary_build_by_position_and_split_rules(spark):
    abstracts, labels = _corpus(spark)
    merged = prep.join_labels(abstracts, labels)
    assert merged.columns[3:5] == ["Split", "Number of Annotators"]
    assert prep.label_columns_by_position(merged.columns) == CORPUS_LABELS
    b = prep.build_binary(abstracts, labels, CORPUS_SPEC)
    rows = {r.PMID: r for r in b.collect()}
    assert set(rows) == {1, 2, 3}
    assert rows[1].label[:2] == [1.0, 1.0] and rows[1].split_name == "train"
    assert rows[1].Split == "Train"                 # the file's column is kept
    assert sorted(r["__index_level_0__"] for r in rows.values()) == [0, 1, 2]
    dropped = prep.dropped_split_rows(merged).collect()
    assert [(r.Split, r.n_dropped) for r in dropped] == [("train", 1)]


def test_repeated_ids_equal_an_inner_join(spark, tmp_path):
    abstracts, labels = _corpus(spark)
    abstracts = abstracts.union(abstracts.where("PMID < 3")).union(
        spark.createDataFrame([(1, "t1b", "another text")], abstracts.schema))      # PMID 1: 3 texts, two of them equal
    labels = labels.union(labels.where("PMID = 1").withColumn("Has Human Subjects", F.lit(0.0)))   # PMID 1: 2 label rows
    plain = prep.join_labels(abstracts, labels).where("Split IN ('Train', 'Validation', 'Test')")
    built = prep.build_binary(abstracts, labels, CORPUS_SPEC)
    cols = ["PMID", "Title", "Abstract", "Split", "Has Human Subjects"]
    assert sorted(map(str, built.select(cols).collect())) == sorted(map(str, plain.select(cols).collect()))
    assert built.where("PMID = 1").count() == 6
    index = [r[prep.INDEX_COL] for r in built.collect()]
    assert len(set(index)) == len(index)
    paths = prep.build_all(abstracts, labels, labels, CORPUS_SPEC, f"file://{tmp_path}/all")
    counts = {k: spark.read.parquet(p).count() for k, p in paths.items()}
    assert counts == {"binary": plain.count(), "soft": plain.count(), "nli": 14 * plain.count()}


def test_missing_splits_are_errors(spark):
    df = spark.createDataFrame([(1, "train")], "id long, split string")
    with pytest.raises(Exception, match="validation or test"):
        prep.eval_split(df).collect()
    with pytest.raises(Exception, match="no split"):
        prep.split_alias(df, {"validation": "dev"}).collect()


def test_heading_terms(spark):
    df = spark.createDataFrame([(1, [("Asthma", ["drug therapy"], True)]), (2, [("Asthma", ["genetics"], True)]),
                                (3, [("asthma", ["Drug Therapy"], False)]), (4, None)],
                               "id long, mesh array<struct<name:string,qualifiers:array<string>,major:boolean>>")
    terms = [("Asthma", "drug therapy")]
    assert [r.id for r in prep.mesh_term_filter(df, "mesh", terms).collect()] == [1]
    assert [r.id for r in prep.mesh_term_filter(df, "mesh", terms, major_only=False).collect()] == [1, 3]
    assert [r.id for r in prep.mesh_term_filter(df, "mesh", [("asthma", None)]).collect()] == [1, 2]


def test_nli_expansion_rows_and_negation(spark):
    abstracts, labels = _corpus(spark)
    b = prep.build_binary(abstracts, labels, CORPUS_SPEC, with_index=False)
    nli = prep.build_nli(b, CORPUS_SPEC)
    assert nli.count() == 14 * b.count()
    assert set(nli.columns) >= {"PMID", "Title", "Abstract", "Hypothesis", "Entailment", "Positive", "Label_idx"}
    got = {(r.PMID, r.Label_idx, r.Positive): r.Entailment for r in nli.collect()}
    # PMID 1: label 7 (Has Comparator Group) is missing -> positive keeps null, negative gives 0
    assert got[(1, 7, True)] is None and got[(1, 7, False)] == 0.0
    # PMID 2: label 3 is NaN -> negative gives 0
    assert got[(2, 3, False)] == 0.0
    # 0/1 labels: entail(pos) + entail(neg) = 1
    for (pmid, idx, pos), v in got.items():
        if pos and v in (0.0, 1.0):
            assert v + got[(pmid, idx, False)] == 1.0
    # Aggregate (label 0) has no hypothesis
    assert 0 not in {k[1] for k in got}


def test_drop_rename_alias_and_eval_fallback(spark):
    df = spark.createDataFrame([(1, "train", 0.5), (2, "test", 1.0)], "id long, split string, y double")
    with pytest.raises(ValueError):
        prep.drop_columns(df, "nope")
    assert prep.drop_columns(df, "y").columns == ["id", "split"]
    assert "label" in prep.rename_label(df, "y").columns
    assert prep.split_alias(df, {"train": "train"}).collect() == df.collect()   # equal names: no-op
    assert [r.split for r in prep.split_alias(df, {"test": "dev"}).collect()] == ["train", "dev"]
    # no validation split: evaluation falls back to test
    assert [r.id for r in prep.eval_split(df).collect()] == [2]


def test_keyed_update_and_missing_ids(spark):
    target = spark.createDataFrame([("1", None), ("2", "old"), ("3", None)], "id string, mesh string")
    upd = spark.createDataFrame([("1", "D1, D2"), ("3", "")], "id string, mesh string")
    out = {r.id: r.mesh for r in prep.keyed_update(target, upd, "id", "mesh").collect()}
    assert out == {"1": "D1, D2", "2": "old", "3": ""}
    twice = spark.createDataFrame([("1", "x", 1), ("1", "y", 2), ("1", None, 3)], "id string, mesh string, at int")
    assert {r.id: r.mesh for r in prep.keyed_update(target, twice, "id", "mesh", order="at").collect()} == {"1": "y", "2": "old", "3": None}
    miss = prep.missing_ids(target, upd, "id").collect()
    assert [r.id for r in miss] == ["2"]


def test_concat_text_skips_nulls_and_keeps_inputs(spark):
    df = spark.createDataFrame([("a", None, "c")], "x string, y string, z string")
    r = prep.concat_text_columns(df, ["x", "y", "z"], delimiter="|").first()
    assert r.sentence == "a|c" and r.x == "a"


def test_candidate_filter_whole_words(spark):
    df = spark.createDataFrame([("Asthma/drug therapy",), ("asthmatic",), ("HYPERTENSION x",)], "t string")
    out = prep.candidate_term_filter(df, "t", ["asthma", "hypertension"]).collect()
    assert [r.t for r in out] == ["Asthma/drug therapy", "HYPERTENSION x"]
    assert F is not None
