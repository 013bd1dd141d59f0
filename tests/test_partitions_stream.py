"""Results do not depend on the partition count; the stream equals the batch."""
import pytest

import __spark_entry__ as E
from conftest import SF001
from oracle_check import compare, duck_connect

PICK = ["metrics_all", "build_binary", "trial_progress", "batch_ids", "seeded_shuffle",
        "cosine_label_matrix", "threshold_sweep", "best_trial", "nli_summary"]


@pytest.mark.parametrize("parts", [1, 200])
def test_partition_count_independence(spark, parts):
    duck = duck_connect(SF001)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        for name in PICK:
            problems, _, _ = compare(spark, duck, E.queries()[name], E.oracle_sql()[name], SF001)
            assert not problems, (name, problems)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_stream_equals_batch(spark):
    q = E.queries()
    stream = sorted(tuple(r) for r in q["stream_ingest"](spark, SF001).collect())
    bounded = sorted(tuple(r) for r in q["stream_ingest_bounded"](spark, SF001).collect())
    batch = sorted((int(r.PubMedID), r.Abstract) for r in q["xml_abstracts"](spark, SF001).collect())
    assert stream == batch == bounded
