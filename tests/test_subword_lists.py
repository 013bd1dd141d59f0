"""Model tokens, bounded lists, metrics by group and the table function."""
import random

import pytest
from pyspark.sql import functions as F

from labelforge.functions import subword as W
from labelforge.operators import harvest as H
from labelforge.operators import metrics as M
from labelforge.operators.positions import bounded_lists

PATH, END = "/opt/tokenizers/byte_bpe_50k.json", 50256


def test_sequences_of_model_tokens(spark):
    vocabulary = W.read_vocabulary(PATH)
    texts = ["one two three", "", None, "naïve 日本 <|endoftext|> \n tabs\t", "word " * 600]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    out = {r.i: r for r in W.with_subword_sequence(df, "t", vocabulary, 10_000, END, END, END).collect()}
    tokenizer = W._tokenizer(vocabulary)
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert out[i].n_tokens == len(ids) and out[i].truncated == (len(ids) > 510)
        want = [END, *ids[:510], END]
        assert out[i].input_ids == want + [END] * (512 - len(want))
        assert out[i].attention_mask == [1] * len(want) + [0] * (512 - len(want))
    back = df.select("t", W.decoder(vocabulary)(W.encoder(vocabulary)(F.col("t"))).alias("u")).collect()
    assert all(r.t == r.u for r in back)
    rate = W.truncation_rate(df, "t", vocabulary, 512).first()
    assert (rate.n, rate.n_truncated, rate.rate) == (5, 1, 0.2)
    with pytest.raises(ValueError):
        W.with_subword_sequence(df, "t", vocabulary, 1, END, END, END)


def test_lists_of_a_hot_key_are_cut(spark):
    random.seed(1)
    rows = [("hot", i) for i in range(500)] + [(None, i) for i in range(7)] + [("one", 3)]
    random.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v int").repartition(6)
    out = {(r.k, r.part): r["values"] for r in bounded_lists(df, "k", F.struct("v"), F.col("v"), 64, num_partitions=9).collect()}
    assert {k for k in out} == {*(("hot", p) for p in range(8)), (None, 0), ("one", 0)}
    assert [v for p in range(8) for v in out[("hot", p)]] == list(range(500)) and out[(None, 0)] == list(range(7))


def test_metrics_by_group_equal_those_of_each_group(spark):
    random.seed(4)
    rows = [(random.choice(["a", "b", None]), [random.random() for _ in range(3)], [float(random.random() < 0.4) for _ in range(3)]) for _ in range(200)]
    df = spark.createDataFrame(rows, "g string, logits array<double>, label array<double>")
    got = {r.g: r for r in M.metrics_by(df, ["g"], 3).collect()}
    assert set(got) == {"a", "b", None}
    for g, r in got.items():
        one = df.where(F.col("g").eqNullSafe(F.lit(g)))
        want = M.multi_label_metrics(one, 3).first()
        assert r.n == one.count() and all(r[k] == pytest.approx(want[k]) for k in [*M.MULTI_LABEL_KEYS, "combined_score"])


def test_table_function_from_sql(spark, tmp_path):
    body = "<s><PubmedArticle a='1'><MedlineCitation><PMID>5</PMID></MedlineCitation></PubmedArticle><PubmedArticle><x>"
    (tmp_path / "b.xml").write_text(body)
    H.register_table_functions(spark)
    H.read_bodies(spark, str(tmp_path)).createOrReplaceTempView("lf_test_bodies")
    rows = spark.sql("SELECT number, pmid, has_abstract, error IS NULL AS fine FROM body_records(TABLE(lf_test_bodies) PARTITION BY path) ORDER BY number").collect()
    assert [tuple(r) for r in rows] == [(0, "5", False, True), (1, None, None, False)]


def test_a_tokenizer_gets_few_characters_at_a_time(monkeypatch):
    import pandas as pd
    vocabulary, given = W.read_vocabulary(PATH), []
    real = W._tokenizer(vocabulary)

    class Watched:
        def encode_batch(self, texts, **options):
            given.append(sum(map(len, texts)))
            return real.encode_batch(texts, **options)

        def decode_batch(self, ids, **options):
            given.append(sum(map(len, ids)))
            return real.decode_batch(ids, **options)
    monkeypatch.setattr(W, "_tokenizer", lambda v: Watched())
    texts = pd.Series(["word " * 20_000, None, "", *["some words here " * 600] * 100], dtype=object)
    ids = W.encoder(vocabulary).func(texts)
    assert ids[1] is None and list(ids[5]) == real.encode(texts[5], add_special_tokens=False).ids
    assert W.counter(vocabulary).func(texts).tolist() == [0 if i is None else len(i) for i in ids]
    assert list(W.decoder(vocabulary).func(ids)) == texts.tolist()
    cut = W.cutter(vocabulary, 7).func(texts)
    assert cut["n"].tolist() == W.counter(vocabulary).func(texts).tolist() and [list(c) for c in cut["ids"]] == [[] if i is None else list(i)[:7] for i in ids]
    assert len(given) > 12 and max(given) <= W.CHUNK
