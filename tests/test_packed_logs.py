"""The landed logs hold many trials to a file: their number does not grow with that of the trials."""
import glob
import json

import pytest
from pyspark.sql import functions as F

from labelforge.operators import trials as TR
from labelforge.plans import trial_proofs as P


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("events"))
    rows = spark.range(0, 300, 1, 2).select(
        F.col("id").alias("event_id"), (F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60)).alias("ts"), F.col("id").alias("user_id"),
        F.when(F.col("id") % 3 == 0, "error").when(F.col("id") % 3 == 1, "a b").alias("event_type"), (F.col("id") % 90).cast("double").alias("value"),
        F.concat(F.lit('{"k": '), F.col("id") % 7, F.lit("}")).alias("props"))
    rows.write.parquet(f"{d}/events.parquet")
    return d


def files(root):
    return [p for p in glob.glob(f"{root}/**/*", recursive=True) if "/part-" in p]


def test_files_of_results_do_not_grow_with_the_trials(spark, events):
    root = P._land_results(spark, events)
    assert len([p for p in files(root) if "checkpoint_tmp" not in p]) <= 3 * 2      # models, input partitions
    got = P.src_trial_json(spark, events).collect()
    assert len(got) == 300 and {r.model for r in got} == {"error", "a%20b", "__HIVE_DEFAULT_PARTITION__"}
    assert sum(r.trial_id is None for r in got) == 100 and len({r.event_id for r in got}) == 300


def test_files_of_progress_do_not_grow_with_the_trials(spark, events, monkeypatch):
    roots, read = [], TR.read_trial_progress
    monkeypatch.setattr(P.TR, "read_trial_progress", lambda s, root, schema: roots.append(root) or read(s, root, schema))
    assert P.src_trial_csv(spark, events).count() == 300 and len(files(roots[0])) <= 3 * 2


def test_files_of_policies_do_not_grow_with_the_trials(spark, events):
    assert len(files(P._land_policy(spark, events))) <= 2 * 8                        # copies, shuffle partitions
    assert P.src_policy_log(spark, events).count() == 2 * 300


def test_errors_of_many_trials_in_one_file_are_read_by_line(spark, tmp_path):
    block = "Failure # 1\r\nTraceback:\n  File \"x.py\"\n{}Error: trial stopped\n\n"
    (tmp_path / "a.txt").write_text("".join(block.format(e) for e in ("Value", "Key", "Value")) + "no Error: inside\nKeyError: at the end")
    out = TR.trial_failures(spark, str(tmp_path))
    assert {r.error_type: r.n for r in out.collect()} == {"ValueError": 2, "KeyError": 2}
    assert "wholetext" not in json.dumps(out._jdf.queryExecution().toString()).lower()


def test_errors_land_in_few_files(spark, events, monkeypatch):
    roots, read = [], TR.trial_failures
    monkeypatch.setattr(P.TR, "trial_failures", lambda s, root: roots.append(root) or read(s, root))
    assert sum(r.n for r in P.trial_failures(spark, events).collect()) == 100 and len(files(roots[0])) <= 2
