import math

from pyspark.sql import functions as F

from labelforge.functions import labels as L


def _one(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_negate_label_python_truthiness(spark):
    # int(not y): 0 -> 1, 1 -> 0, missing / NaN -> 0 (NaN is truthy)
    got = _one(spark, [(0.0,), (1.0,), (None,), (float("nan"),), (0.3,)], "y double",
               L.negate_label(F.col("y")))
    assert got == [1.0, 0.0, 0.0, 0.0, 0.0]


def test_threshold_is_strict_and_nan_is_negative(spark):
    got = _one(spark, [([0.5, 0.5000001, float("nan"), -3.0, None],)], "s array<double>",
               L.threshold_scores(F.col("s")))
    assert got == [[0, 1, 0, 0, 0]]


def test_argmax_first_on_ties_and_nan_largest(spark):
    got = _one(spark, [([1.0, 3.0, 3.0],), ([0.0, float("nan"), 5.0],), ([2.0],)], "v array<double>",
               L.argmax(F.col("v")))
    assert got == [1, 1, 0]


def test_decode_keeps_vector_order_and_renders_python_list(spark):
    names = ["Aggregate", "Has Study Drug(s)", "Has Human Subjects"]
    df = spark.createDataFrame([([1, 0, 1],), ([0, 0, 0],)], "p array<int>")
    out = df.select(L.python_list_text(L.decode_multi_hot(F.col("p"), names)).alias("t")).collect()
    assert [r.t for r in out] == ["['Aggregate', 'Has Human Subjects']", "[]"]


def test_pack_labels_quotes_names_with_spaces_and_parentheses(spark):
    cols = ["Has Study Drug(s)", "Has Human Subjects"]
    df = spark.createDataFrame([(1.0, 0.0)], "`Has Study Drug(s)` double, `Has Human Subjects` double")
    assert df.select(L.pack_labels(cols)).first()[0] == [1.0, 0.0]


def test_decode_class_and_split_assignment(spark):
    df = spark.createDataFrame([(0,), (2,), (18,), (19,)], "i long")
    out = df.select(L.decode_class(F.col("i") % 3, ["a", "b", "c"]).alias("n"),
                    L.split_of_key(F.col("i")).alias("s")).collect()
    assert [r.n for r in out] == ["a", "c", "a", "b"]
    assert [r.s for r in out] == ["Train", "Train", "Validation", "Test"]
    assert not math.isnan(1.0)
