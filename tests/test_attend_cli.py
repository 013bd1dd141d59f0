import numpy as np
import pytest
from conftest import SF001
from pyspark.sql import functions as F

from labelforge import attend
from labelforge.sources import files as IO


def test_label_attention_from_embeddings_to_files(spark, tmp_path):
    emb = spark.read.parquet(f"{SF001}/embeddings.parquet")
    split = F.when(F.col("vec_id") % 5 == 0, "test").otherwise("train")
    IO.write_splits(emb.withColumn("split_name", split), str(tmp_path / "emb"))
    out = attend.run(spark, str(tmp_path / "emb"), [f"class {i}" for i in range(10)], str(tmp_path / "out"))
    rows = emb.collect()
    train = [r for r in rows if r.vec_id % 5]
    means = np.array([np.mean([r.embedding for r in train if r.label == c], axis=0) for c in range(10)], float)
    hits, n = 0, 0
    for r in rows:
        if r.vec_id % 5 == 0:
            x = np.array(r.embedding, float)
            cos = means @ x / (np.linalg.norm(means, axis=1) * np.linalg.norm(x))
            hits, n = hits + (int(cos.argmax()) == r.label), n + 1
    assert spark.read.json(out["metrics"]).first().accuracy == pytest.approx(hits / n)
    assert IO.read_predictions(spark, out["predictions"]).count() == n == spark.read.parquet(out["scores"]).count()


def test_multi_hot_labels_and_missing_ones(spark, tmp_path):
    rows = [(i, [1.0, 0.0], [1.0, 0.0], "train") for i in range(5)] + [(9, [0.0, 1.0], [0.0, 1.0], "train"), (10, [0.9, 0.1], [1.0, 0.0], "test")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label array<double>, split_name string")
    IO.write_splits(frame, str(tmp_path / "emb"))
    out = attend.run(spark, str(tmp_path / "emb"), ["a", "b"], str(tmp_path / "out"))
    assert spark.read.json(out["metrics"]).first().f1_micro == 1.0
    with pytest.raises(ValueError, match="every label needs one"):
        attend.run(spark, str(tmp_path / "emb"), ["a", "b", "c"], str(tmp_path / "out"))
    with pytest.raises(ValueError, match="unknown kind"):
        attend.run(spark, str(tmp_path / "emb"), ["a", "b"], str(tmp_path / "out"), kind="dot")
