import tempfile

from conftest import SF001
from labelforge.operators import prepare as prep
from labelforge.plans import standins as S
from labelforge.sources import files as IO
from labelforge.zero_shot import run


def test_zero_shot_run(spark):
    d = tempfile.mkdtemp(prefix="lf-zs-")
    b = prep.build_binary(S.abstracts(spark, SF001), S.binary_labels(spark, SF001), S.SPEC, with_index=False)
    nli = prep.build_nli(b, S.SPEC)
    IO.write_splits(nli, f"{d}/nli")
    out = run(spark, f"{d}/nli", f"{d}/zs", "test")
    n_pairs = nli.filter("split_name = 'test'").count()
    assert spark.read.parquet(out["pair_scores"]).count() == n_pairs
    assert spark.read.parquet(out["decisions"]).count() == n_pairs // 2
    m = spark.read.json(out["metrics"]).first()
    assert 0.0 <= m.f1 <= 1.0
