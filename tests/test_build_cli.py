import os
import tempfile

from labelforge.build import build_from_csv
from labelforge.schemas import CORPUS_LABELS


def test_build_from_csv_end_to_end(spark):
    d = tempfile.mkdtemp(prefix="lf-build-")
    with open(os.path.join(d, "abstracts.csv"), "w") as fh:
        fh.write('PMID,Title,Abstract\n1,T1,"An abstract, with ""quotes""\nand a newline"\n2,T2,Plain text\n'
                 '3,T3,Third\n')
    head = "PMID,Split,Number of Annotators," + ",".join(CORPUS_LABELS) + "\n"
    for name, vals in (("binary.csv", ["1", "0", "1", "0", "1", "0", "1", "0"]),
                       ("soft.csv", ["1", "0.5", "0.25", "0", "1", "0", "0.75", "0"])):
        with open(os.path.join(d, name), "w") as fh:
            fh.write(head)
            fh.write("1,Train,2," + ",".join(vals) + "\n")
            fh.write("2,Validation,3," + ",".join(vals) + "\n")
            fh.write("3,Other,1," + ",".join(vals) + "\n")       # unknown split: dropped
    out = os.path.join(d, "out")
    paths = build_from_csv(spark, os.path.join(d, "abstracts.csv"), os.path.join(d, "binary.csv"),
                           os.path.join(d, "soft.csv"), out)
    binary = spark.read.parquet(paths["binary"])
    assert binary.count() == 2
    row = binary.filter("PMID = 1").first()
    assert row.Abstract == 'An abstract, with "quotes"\nand a newline'
    assert row.label == [1.0, 0.0, 1.0, 0.0, 1.0, 0.0, 1.0, 0.0]
    soft = spark.read.parquet(paths["soft"]).filter("PMID = 1").first()
    assert soft.label[1] == 0.5
    nli = spark.read.parquet(paths["nli"])
    assert nli.count() == 14 * 2
    names = [r.value for r in spark.read.text(paths["labels"]).collect()]
    assert names == CORPUS_LABELS


def test_custom_label_set_has_no_nli(spark):
    import pytest
    from labelforge.operators.prepare import build_nli
    from labelforge.schemas import LabelSpec
    d = tempfile.mkdtemp(prefix="lf-build2-")
    with open(os.path.join(d, "a.csv"), "w") as fh:
        fh.write("PMID,Title,Abstract\n1,T1,first\n2,T2,second\n")
    with open(os.path.join(d, "b.csv"), "w") as fh:
        fh.write("PMID,Split,Number of Annotators,Aggregate,Has Human Subjects\n1,Train,2,1,0\n2,Test,1,0,1\n")
    paths = build_from_csv(spark, f"{d}/a.csv", f"{d}/b.csv", f"{d}/b.csv", f"{d}/out")
    assert "nli" not in paths and spark.read.parquet(paths["binary"]).count() == 2
    with pytest.raises(ValueError):
        build_nli(spark.read.parquet(paths["binary"]), LabelSpec(labels=["Aggregate", "Has Human Subjects"]))
