"""Physical-plan properties the scale design relies on (checked on sf0.001)."""
import re

import __spark_entry__ as E
from conftest import SF001


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_reads_no_text_and_one_small_shuffle(spark):
    p = _plan(E.queries()["nli_summary"](spark, SF001))
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", p)
    assert not any("text" in s for s in scans)            # column pruning reaches the scan
    assert "Generate inline" in p                           # hypotheses inlined, no cross join
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_metrics_are_one_aggregation_pass(spark):
    p = _plan(E.queries()["metrics_all"](spark, SF001))
    assert p.count("Exchange SinglePartition") == 1
    assert "hashpartitioning" not in p                      # no per-label shuffle
    assert "Generate explode" not in p and "posexplode" not in p


def test_label_scoring_has_no_join_and_one_python_pass(spark):
    p = _plan(E.queries()["cosine_label_matrix"](spark, SF001))
    assert "Join" not in p
    assert p.count("ArrowEvalPython") == 1


def test_xml_quarantine_runs_once(spark):
    p = _plan(E.queries()["xml_abstracts"](spark, SF001))
    assert p.count("ArrowEvalPython") == 1                  # one parse gives every field
    assert "xpath" not in p


def test_dataset_texts_are_shuffled_once(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = _plan(E.queries()["build_binary"](spark, SF001))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    text_scans = [s for s in re.findall(r"FileScan parquet \[([^\]]*)\]", p) if "text" in s]
    assert len(text_scans) == 1                             # only the join reads and moves the texts
    moved = [m for m in re.findall(r"Exchange (\w+)\(", p) if m == "rangepartitioning"]
    assert not moved                                        # positions come from the checkpoint, no text is range-sorted


def test_trial_choice_is_partial_aggregation(spark):
    p = _plan(E.queries()["best_trial"](spark, SF001))
    assert "partial_max" in p                              # combined map-side before the shuffle
    assert "Window" not in p


def test_running_window_never_partitions_by_trial_alone(spark):
    p = _plan(E.queries()["trial_progress"](spark, SF001))
    specs = re.findall(r"windowspecdefinition\(([^)]*)\)", p)
    row_level = [s for s in specs if "timestamp" in s]        # windows over the trial rows themselves
    assert all("_lf_pid" in s for s in row_level)
    assert row_level or "MapInPandas" in p                    # or the sorted partitions are scanned in place


def test_positions_read_materialised_partition_tags(spark):
    p = _plan(E.queries()["row_position"](spark, SF001))
    assert "Exchange SinglePartition" not in p.split("BroadcastExchange")[0]   # rows never meet in one task
    assert "Scan ExistingRDD" in p or "LogicalRDD" in p or "RDDScan" in p      # read from the checkpoint
