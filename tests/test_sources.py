import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelforge.operators import trials as TR
from labelforge.session import work_path
from labelforge.sources import files as IO


def test_csv_round_trip_keeps_quotes_newlines_and_blanks(spark):
    rows = [(1, 'say "hi", then\nleave', "  padded  "), (2, "", None), (3, "a\r\nb", "x")]
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("a", T.StringType()),
                           T.StructField("b", T.StringType())])
    path = work_path(spark, "csv-test")
    IO.write_csv(spark.createDataFrame(rows, schema), path)
    back = sorted(tuple(r) for r in IO.read_csv_table(spark, path, schema).collect())
    assert back[0] == rows[0]
    assert back[1][0] == 2 and back[1][2] is None
    assert back[2] == rows[2]


def test_split_files_extension_rules(spark):
    assert IO.check_split_files({"train": "a/train.json", "validation": "a/v.jsonl"}) == "json"
    with pytest.raises(ValueError):
        IO.check_split_files({"train": "a/train.csv", "validation": "a/v.json"})
    with pytest.raises(ValueError):
        IO.check_split_files({"train": "a/train.csv", "test": "a/t.parquet"})
    with pytest.raises(ValueError):
        IO.check_split_files({"validation": "a/v.csv"})


def test_training_log_single_pretty_printed_document(spark):
    doc = {"best_metric": 0.25, "best_model_checkpoint": "run/step-70", "epoch": 3.0, "global_step": 90,
           "log_history": [{"epoch": 1.0, "learning_rate": 0.001, "loss": 0.8, "step": 10},
                           {"epoch": 1.0, "eval_loss": 0.5, "eval_f1_micro": 0.6, "step": 30},
                           {"epoch": 2.0, "eval_loss": 0.25, "eval_f1_micro": 0.7, "step": 70},
                           {"epoch": 3.0, "eval_loss": 0.375, "eval_f1_micro": 0.75, "step": 90}]}
    d = tempfile.mkdtemp(prefix="lf-trainer-")
    with open(os.path.join(d, "trainer_state.json"), "w") as fh:
        json.dump(doc, fh, indent=2)
    rows = TR.read_training_log(spark, d, multi_line=True).withColumn("run_id", F.lit("r"))
    assert rows.count() == 4
    best = TR.best_checkpoint(rows).first()
    # the best checkpoint is the one of lowest evaluation loss, not the last
    assert (best.best_step, best.best_metric) == (70, 0.25)
