import corpus_pipeline
from brute import SF001
from pyspark.sql import functions as F


def test_stages_on_planted_documents(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    items = spark.read.parquet(f"{SF001}/benchmark.parquet")
    item = max((r.text for r in items.collect()), key=len)
    base = docs.where("lang = 'en' AND n_chars > 800").orderBy("doc_id").first().text.split()
    plant = [(9001, "idiot moron you stupid worthless scum trash pathetic loser clown"), (9002, " ".join(f"q{i} z{i}" for i in range(60)) + " " + item),
             (9003, " ".join(f"clean{i} word{i}" for i in range(80))), (9004, " ".join(base)), (9005, " ".join([*base[:-1], "changed"])),
             (9006, None), (9007, "")]
    rows = spark.createDataFrame([(i, t, "en", "src1", len(t or "")) for i, t in plant], docs.schema)
    frame, columns = docs.union(rows), docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, SF001).checkpoint()
        if name != "source_mix":
            assert frame.columns == columns and [f.dataType for f in frame.schema] == [f.dataType for f in docs.schema]
        seen[name] = {r.doc_id for r in frame.select("doc_id").collect()}
    assert 9001 not in seen["toxicity"] and 9003 in seen["source_mix"]
    assert len({9004, 9005} & seen["jaccard_join"]) <= 1
    assert 9002 in seen["jaccard_join"] and 9002 not in seen["decontamination"]
    assert {9006, 9007} <= seen["source_mix"]
    assert seen["source_mix"] == seen["decontamination"]
    assert frame.where("taken > 2 * size").count() == 0
    assert frame.agg(F.sum("taken")).first()[0] > 0


def test_stages_on_edge_cases(spark):
    """Nulls, ties, repeated rows and clashing names; and an empty table through every stage."""
    clash = "_toxicity string, _removed string, _leaks string, _jaccard_row string, _jaccard_n string, _line_dedup string, _tox string"
    rows = [(1, "one two three four five six seven", "en", "a", 33), (1, "one two three four five six seven", "en", "a", 33), (2, None, None, None, None),
            (3, "", "en", "a", 0), (None, "ten eleven twelve thirteen fourteen fifteen", "en", None, 44), (4, " \n\t ", "de", "b", 4)]
    docs = spark.createDataFrame([(*r, *["x"] * 7) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {clash}")
    for frame, ids in ((docs, [1, 2, 3, 4, None]), (docs.limit(0), [])):
        for name, stage in corpus_pipeline.STAGES:
            before = frame
            frame = stage(spark, frame, SF001).checkpoint()
            if name != "source_mix":
                assert frame.columns == before.columns and all(r._toxicity == "x" and r._leaks == "x" for r in frame.collect())
            assert {r.doc_id for r in frame.collect()} == set(ids), name
        if ids:
            assert frame.count() == 5                  # the third stage keeps one of the repeated rows
