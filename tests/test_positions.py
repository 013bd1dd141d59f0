import pandas as pd
import pytest
from pyspark.sql import functions as F

from labelforge.operators.positions import running_max_and_lag, with_batch_id, with_row_index


@pytest.mark.parametrize("parts", [1, 4, 50])
def test_row_index_is_dense_and_partition_independent(spark, parts):
    df = spark.range(0, 1000).select((F.col("id") * 7919 % 1000).alias("k"))
    out = with_row_index(df, ["k"], "pos", num_partitions=parts)
    got = sorted((r.k, r.pos) for r in out.collect())
    assert got == [(k, k) for k in range(1000)]


def test_batches_are_consecutive(spark):
    df = spark.range(0, 23).withColumnRenamed("id", "k")
    out = with_batch_id(df, ["k"], 5).collect()
    assert {r.k: r.batch_id for r in out} == {k: k // 5 for k in range(23)}


@pytest.mark.parametrize("parts,method", [(1, "window"), (3, "window"), (16, "window"),
                                          (1, "arrow"), (3, "arrow"), (16, "arrow")])
def test_running_max_with_a_hot_group(spark, parts, method):
    # group "hot" holds most rows, so it spans several range partitions
    rows = [("hot", t, float((t * 37) % 101)) for t in range(600)]
    rows += [(f"g{i}", t, float((t * 13 + i) % 17)) for i in range(5) for t in range(20)]
    df = spark.createDataFrame(rows, "g string, t long, v double")
    out = running_max_and_lag(df, "g", ["t"], "v", num_partitions=parts, method=method).toPandas()
    pdf = pd.DataFrame(rows, columns=["g", "t", "v"]).sort_values(["g", "t"])
    pdf["best"] = pdf.groupby("g")["v"].cummax()
    pdf["prev"] = pdf.groupby("g")["v"].shift()
    m = out.merge(pdf, on=["g", "t"])
    assert len(m) == len(rows)
    assert (m.best_so_far == m.best).all()
    assert ((m.prev_value == m.prev) | (m.prev_value.isna() & m.prev.isna())).all()


def test_row_index_after_a_shuffle(spark):
    # input arrives from shuffles in no fixed order: positions must still be dense and exact
    left = spark.range(0, 4000).repartition(13).select(F.col("id").alias("k"))
    right = spark.range(0, 4000).repartition(7).select(F.col("id").alias("k"), (F.col("id") % 5).alias("g"))
    df = left.join(right.hint("merge"), "k").select("k", F.concat(F.lit("x"), F.col("k").cast("string")).alias("payload"))
    out = with_row_index(df, ["k"], "pos", num_partitions=9)
    got = sorted((r.k, r.pos) for r in out.collect())
    assert got == [(k, k) for k in range(4000)]
    scan = running_max_and_lag(df.select("k", (F.col("k") % 3).alias("g"), F.col("k").cast("double").alias("v")),
                               "g", ["k"], "v", num_partitions=5)
    rows = scan.collect()
    assert all(r.best_so_far == r.v for r in rows)
    assert all((r.prev_value is None) == (r.k < 3) for r in rows)
