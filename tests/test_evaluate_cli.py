import tempfile

from pyspark.sql import types as T

from labelforge.evaluate import evaluate
from labelforge.sources import files as IO


def test_evaluate_multi_label_files(spark):
    rows = [(1, [0.9, 0.2], [1.0, 0.0]), (2, [0.6, 0.7], [1.0, 1.0]), (3, [0.1, 0.8], [0.0, 0.0])]
    df = spark.createDataFrame(rows, "row_id long, logits array<double>, label array<double>")
    out = evaluate(df, ["A", "B"], tempfile.mkdtemp(prefix="lf-eval-"))
    m = spark.read.json(out["metrics"]).first()
    assert abs(m.f1_micro - 2 * 3 / (2 * 3 + 1 + 0)) < 1e-12 and m.eval_samples == 3
    schema = T.StructType([T.StructField("metric", T.StringType()), T.StructField("A", T.DoubleType()),
                           T.StructField("B", T.DoubleType())])
    mat = {r.metric: r for r in IO.read_csv_table(spark, out["per_label"], schema).collect()}
    assert mat["recall"].A == 1.0 and mat["precision"].B == 0.5
    preds = sorted((r["index"], r.prediction) for r in IO.read_predictions(spark, out["predictions"]).collect())
    assert preds == [(0, "['A']"), (1, "['A', 'B']"), (2, "['B']")]


def test_evaluate_single_label(spark):
    df = spark.createDataFrame([(1, [0.1, 0.9], 1), (2, [0.8, 0.2], 1)], "row_id long, logits array<double>, label int")
    out = evaluate(df, ["neg", "pos"], tempfile.mkdtemp(prefix="lf-eval-"))
    assert spark.read.json(out["metrics"]).first().accuracy == 0.5
    preds = sorted((r["index"], r.prediction) for r in IO.read_predictions(spark, out["predictions"]).collect())
    assert preds == [(0, "pos"), (1, "neg")]
