import os
import tempfile

from pyspark.sql import types as T

from labelforge.harvest_cli import ingest, plan
from labelforge.sources import files as IO

BODY = ("<PubmedArticleSet>"
        "<PubmedArticle><MedlineCitation><PMID>1</PMID><Article><Abstract><AbstractText>one</AbstractText>"
        "</Abstract></Article><MeshHeadingList><MeshHeading><DescriptorName UI='D1'>x</DescriptorName>"
        "</MeshHeading></MeshHeadingList></MedlineCitation></PubmedArticle>"
        "<PubmedArticle><MedlineCitation><PMID>2</PMID><Article><Abstract><AbstractText>two &amp; more"
        "</AbstractText></Abstract></Article></MedlineCitation></PubmedArticle>"
        "<PubmedArticle><MedlineCitation><PMID>3</PMID><Article><Abstract>broken & bad</Abstract>"
        "</Article></MedlineCitation></PubmedArticle>"
        "</PubmedArticleSet>")


def test_plan_and_ingest(spark):
    d = tempfile.mkdtemp(prefix="lf-harvest-")
    with open(os.path.join(d, "ids.csv"), "w") as fh:
        fh.write("PMID,Split\n" + "".join(f"{i},Train\n" for i in range(1, 6)))
    os.makedirs(os.path.join(d, "landing"))
    with open(os.path.join(d, "landing", "batch0.xml"), "w") as fh:
        fh.write(BODY)
    req = IO.read_csv_table(spark, plan(spark, os.path.join(d, "ids.csv"), os.path.join(d, "plan"), 2),
                            T.StructType([T.StructField("batch_id", T.LongType()), T.StructField("n_ids", T.LongType()),
                                          T.StructField("ids", T.StringType()), T.StructField("request", T.StringType())]))
    assert sorted((r.batch_id, r.ids) for r in req.collect()) == [(0, "1,2"), (1, "3,4"), (2, "5")]
    out = ingest(spark, os.path.join(d, "ids.csv"), os.path.join(d, "landing"), os.path.join(d, "out"), 2)
    s = T.StructType([T.StructField("PubMedID", T.StringType()), T.StructField("Abstract", T.StringType()),
                      T.StructField("MeshID", T.StringType())])
    mesh = {r.PubMedID: (r.Abstract, r.MeshID) for r in IO.read_csv_table(spark, out["mesh"], s).collect()}
    assert mesh == {"1": ("one", "D1"), "2": ("two & more", None)}
    lt = T.StructType([T.StructField(n, T.LongType()) for n in ("batch_id", "n_requested", "n_received", "n_missing")])
    ledger = sorted(tuple(r) for r in IO.read_csv_table(spark, out["ledger"], lt).collect())
    assert ledger == [(0, 2, 2, 0), (1, 2, 0, 2), (2, 1, 0, 1)]
    assert spark.read.json(out["quarantine"]).count() == 1
