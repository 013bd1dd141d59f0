"""Repeated ids, null groups, broken bodies and empty landing folders: cases of ordinary input."""
import math
import os

import pytest
from pyspark.sql import functions as F

from labelforge.operators import harvest as H
from labelforge.operators import positions as P
from labelforge.operators.models import nli_collapse
from labelforge.streaming.ingest import ingest_available
from labelforge.zero_shot import score_pairs

NLI = "PMID long, Title string, Abstract string, Hypothesis string, Entailment double, Positive boolean, Label_idx long"


def test_pairs_of_a_repeated_id_are_scored_by_their_own_texts(spark):
    pairs = [(7, "t", text, hyp, 1.0, pos, 0) for text in ("red fox", "blue whale") for hyp, pos in (("red fox", True), ("blue whale", False))]
    scored = score_pairs(spark.createDataFrame(pairs, NLI))
    got = sorted((r.premise, r.Positive, r.score) for r in scored.collect())
    assert sorted(s for _, _, s in got) == [0.0, 0.0, 1.0, 1.0] and len({p for p, _, _ in got}) == 2
    decisions = nli_collapse(scored).collect()
    assert sorted((r.PMID, r.margin, r.decision) for r in decisions) == [(7, -1.0, False), (7, 1.0, True)]


def test_a_document_that_comes_twice_decides_once(spark):
    rows = [(1, 0, True, 0.75), (1, 0, False, 0.25), (1, 0, True, 0.75), (1, 0, False, 0.25), (2, 0, False, 0.5), (3, 0, True, None)]
    out = nli_collapse(spark.createDataFrame(rows, "PMID long, Label_idx long, Positive boolean, score double"))
    assert sorted((r.PMID, r.margin) for r in out.collect() if r.margin is not None) == [(1, 0.5), (2, -0.5)]
    assert out.where("PMID = 3").first().margin is None


def record(i, attributes="", text="text"):
    return (f"<PubmedArticle{attributes}><MedlineCitation><PMID>{i}</PMID><Article><Abstract><AbstractText>{text}</AbstractText></Abstract>"
            "</Article></MedlineCitation></PubmedArticle>")


BODY = ("<?xml version='1.0'?><PubmedArticleSet>" + record(1) + record(2, ' Status="x"') + "\n" + record(3)[:60] + record(4, "\n a='b'", "line\nline")
        + "<PubmedArticle/>" + record(5)[:70])


@pytest.mark.parametrize("read", [H.read_bodies, H.read_body_chunks])
def test_every_start_tag_is_a_record_or_in_quarantine(spark, tmp_path, read):
    (tmp_path / "one.xml").write_text(BODY)
    (tmp_path / "two.xml").write_text("<PubmedArticleSet>" + record(6) + "</PubmedArticleSet>")
    good, bad = H.quarantine(H.xml_records(read(spark, str(tmp_path))))
    assert sorted(r[0] for r in good.select(f"{H.PARSED}.pmid").collect()) == ["1", "2", "4", "6"]
    assert bad.count() == 3 and {r.error for r in bad.collect()} >= {"no id"}


def test_chunks_give_the_same_records_at_any_split_size(spark, tmp_path):
    body = "<PubmedArticleSet>" + "".join(record(i, text="word " * (i % 40)) for i in range(300)) + "</PubmedArticleSet>"
    (tmp_path / "big.xml").write_text(body)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    want = sorted(r.record for r in H.xml_records(H.read_bodies(spark, str(tmp_path))).collect())
    assert len(want) == 300
    try:
        for size in ("3000", "20000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            chunks = H.read_body_chunks(spark, str(tmp_path))
            assert chunks.select(F.spark_partition_id()).distinct().count() > 2
            assert sorted(r.record for r in H.xml_records(chunks).collect()) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_nothing_landed_is_an_empty_table(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    out = ingest_available(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    assert out.columns == ["PMID", "Abstract"] and out.count() == 0
    (tmp_path / "in" / "a.xml").write_text("<s>" + record(9) + "</s>")
    assert [r.PMID for r in ingest_available(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt")).collect()] == [9]


@pytest.mark.parametrize("method", ["arrow", "window"])
def test_a_null_group_has_running_values(spark, method):
    rows = [(g, i, math.sin(i * 3)) for g in (None, "a", "b") for i in range(30)]
    df = spark.createDataFrame(rows, "g string, i int, v double").repartition(5)
    out = P.running_max_and_lag(df, "g", ["i"], "v", num_partitions=7, method=method).collect()
    assert len(out) == 90
    for r in out:
        earlier = [math.sin(k * 3) for k in range(r.i + 1)]
        assert r.best_so_far == max(earlier)
        assert r.prev_value == (earlier[-2] if r.i else None)


def test_running_sums_of_a_null_group(spark):
    df = spark.createDataFrame([(g, i, 1) for g in (None, "a") for i in range(20)], "g string, i int, n long")
    out = P.running_sums(df, "g", F.col("i"), ["n"], num_partitions=6).collect()
    assert len(out) == 40 and all(r.before_n == r.i for r in out)
