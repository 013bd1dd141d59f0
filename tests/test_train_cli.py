import tempfile

from labelforge.operators import prepare as prep
from labelforge.plans import standins as S
from labelforge.sources import files as IO
from labelforge.train import train_and_evaluate
from conftest import SF001


def test_train_and_evaluate_on_written_dataset(spark):
    d = tempfile.mkdtemp(prefix="lf-train-")
    b = prep.build_binary(S.abstracts(spark, SF001), S.binary_labels(spark, SF001), S.SPEC)
    IO.write_splits(b, f"{d}/binary")
    out = train_and_evaluate(spark, f"{d}/binary", S.LABELS, f"{d}/run", ["Title", "Abstract"], max_iter=5)
    assert set(out) >= {"scores_validation", "scores_test", "validation_metrics", "test_per_label"}
    m = spark.read.json(out["validation_metrics"]).first()
    assert 0.0 <= m.f1_micro <= 1.0 and m.eval_samples > 0
