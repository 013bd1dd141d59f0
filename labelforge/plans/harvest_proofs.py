"""Proof queries: harvest planning, XML/text record parsing, ledger and the
streaming ingest (W1, W2, F1-F6, S8, J7, X5, O5, ST1).

Fixture: every document is rendered as a ``PubmedArticle`` record (MeSH
headings = its lang and source; no Abstract element when the text is shorter
than 100 characters), 250 records per body file, landed under the session's
shared folder. Expected values are the original texts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from labelforge.operators import harvest as H
from labelforge.operators import prepare as prep
from labelforge.plans import standins as S
from labelforge.plans.registry import proof
from labelforge.session import work_path
from labelforge.streaming import ingest

SHORT = 100  # texts below this length are rendered without an abstract

POS_SQL = "row_number() OVER (ORDER BY doc_id) - 1"
BATCHES_SQL = f"SELECT doc_id, {POS_SQL} AS pos, ({POS_SQL}) // 250 AS batch_id FROM documents"
IDS_SQL = ("SELECT batch_id, count(*) AS n_ids, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) "
           f"AS ids FROM ({BATCHES_SQL}) b GROUP BY batch_id")
ESC_SQL = "replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
RECORD_SQL = (
    "'<PubmedArticle><MedlineCitation><PMID>' || CAST(doc_id AS VARCHAR) || '</PMID><Article>' || "
    f"CASE WHEN n_chars >= {SHORT} THEN '<Abstract><AbstractText>' || {ESC_SQL.format(x='text')} || "
    "'</AbstractText></Abstract>' ELSE '' END || '</Article><MeshHeadingList>' || "
    f"'<MeshHeading><DescriptorName UI=\"' || {ESC_SQL.format(x='lang')} || '\">' || {ESC_SQL.format(x='lang')} || "
    "'</DescriptorName></MeshHeading>' || "
    f"'<MeshHeading><DescriptorName UI=\"' || {ESC_SQL.format(x='source')} || '\">' || {ESC_SQL.format(x='source')} || "
    "'</DescriptorName></MeshHeading>' || '</MeshHeadingList></MedlineCitation></PubmedArticle>'")


def _planned(spark, d):
    return H.plan_batches(S.table(spark, d, "documents"), "doc_id", H.DEFAULT_BATCH_SIZE)


def _land_xml(spark, d):
    return S.landed(spark, d, "_land_xml", lambda: _land_xml_now(spark, d))


def _land_xml_now(spark, d):
    docs = S.table(spark, d, "documents")
    planned = _planned(spark, d)
    rec = planned.join(docs, "doc_id").select(
        "batch_id", "pos",
        H.render_xml_record(F.col("doc_id"), F.when(F.col("n_chars") >= SHORT, F.col("text")),
                            [F.col("lang"), F.col("source")]).alias("rec"))
    return H.land_bodies(rec, work_path(spark, "xml-bodies"))


def _records(spark, d, path=None):
    path = path or _land_xml(spark, d)
    return H.xml_records(H.read_bodies(spark, path))


@proof("batch_ids", BATCHES_SQL)
def batch_ids(spark, d):
    return _planned(spark, d)


@proof("batch_id_strings", IDS_SQL)
def batch_id_strings(spark, d):
    return H.batch_id_strings(_planned(spark, d), "doc_id")


@proof("request_plan",
       f"SELECT batch_id, '{H.REQUEST_BASE}' || '&id=' || ids || '&retmode=xml' AS request "
       f"FROM ({IDS_SQL}) i")
def request_plan(spark, d):
    ids = H.batch_id_strings(_planned(spark, d), "doc_id")
    return ids.select("batch_id", H.request_text(F.col("ids"), retmode="xml", rettype=None).alias("request"))


@proof("src_xml_records", f"SELECT CAST(doc_id AS VARCHAR) AS PMID, {RECORD_SQL} AS record FROM documents")
def src_xml_records(spark, d):
    rec = H.parse_records(_records(spark, d))
    return rec.select(F.col(f"{H.PARSED}.pmid").alias("PMID"), "record")


@proof("xml_abstracts",
       f"SELECT CAST(doc_id AS VARCHAR) AS PubMedID, text AS Abstract FROM documents WHERE n_chars >= {SHORT}")
def xml_abstracts(spark, d):
    return H.abstracts_from_records(_records(spark, d))


@proof("xml_mesh_long",
       "SELECT CAST(doc_id AS VARCHAR) AS PubMedID, lang AS MeshID FROM documents UNION ALL "
       "SELECT CAST(doc_id AS VARCHAR), source FROM documents")
def xml_mesh_long(spark, d):
    return H.mesh_long(_records(spark, d))


@proof("xml_mesh_joined",
       "SELECT CAST(doc_id AS VARCHAR) AS PubMedID, lang || ', ' || source AS MeshID FROM documents")
def xml_mesh_joined(spark, d):
    return H.mesh_joined(_records(spark, d))


@proof("abstract_fallback",
       f"SELECT CAST(doc_id AS VARCHAR) AS PMID, CASE WHEN n_chars >= {SHORT} THEN text "
       f"ELSE '{H.ABSTRACT_MISSING}' END AS Abstract FROM documents")
def abstract_fallback(spark, d):
    return H.abstracts_with_fallback(_records(spark, d))


@proof("split_records",
       f"SELECT batch_id, CAST(pos - batch_id * 250 AS INTEGER) AS rec_idx, text AS record FROM ({BATCHES_SQL}) b "
       "JOIN documents USING (doc_id)")
def split_records(spark, d):
    docs = S.table(spark, d, "documents")
    rec = _planned(spark, d).join(docs, "doc_id").select("batch_id", "pos", F.col("text").alias("rec"))
    path = H.land_bodies(rec, work_path(spark, "text-bodies"), wrap=("", ""),
                         separator=H.TEXT_RECORD_SEPARATOR)
    bodies = H.read_bodies(spark, path).select(
        F.regexp_extract("path", r"batch_id=(\d+)", 1).cast("long").alias("batch_id"), "body")
    return bodies.select("batch_id", F.posexplode(H.split_text_records(F.col("body")))
                         .alias("rec_idx", "record"))


@proof("harvest_missing_ids", f"SELECT doc_id FROM documents WHERE n_chars < {SHORT}")
def harvest_missing_ids(spark, d):
    received = H.abstracts_from_records(_records(spark, d)).select(
        F.col("PubMedID").cast("long").alias("doc_id"))
    return prep.missing_ids(S.table(spark, d, "documents"), received, "doc_id")


@proof("harvest_ledger",
       "SELECT batch_id, count(*) AS n_requested, count(*) FILTER (WHERE n_chars >= 100) AS n_received, "
       f"count(*) FILTER (WHERE n_chars < 100) AS n_missing FROM ({BATCHES_SQL}) b JOIN documents USING (doc_id) "
       "GROUP BY batch_id")
def harvest_ledger(spark, d):
    received = H.abstracts_from_records(_records(spark, d))
    return H.harvest_ledger(_planned(spark, d), received, "doc_id")


@proof("harvest_coverage",
       "SELECT (SELECT count(DISTINCT doc_id) FROM documents) AS n_requested, "
       f"(SELECT count(DISTINCT doc_id) FROM documents WHERE n_chars >= {SHORT}) AS n_received")
def harvest_coverage(spark, d):
    received = H.abstracts_from_records(_records(spark, d))
    req = S.table(spark, d, "documents").agg(F.countDistinct("doc_id").alias("n_requested"))
    got = received.agg(F.countDistinct("PubMedID").alias("n_received"))
    return req.select("n_requested", got.scalar().alias("n_received"))


@proof("append_batches",
       f"SELECT batch_id, CAST(doc_id AS VARCHAR) AS PubMedID FROM ({BATCHES_SQL}) b JOIN documents USING (doc_id) "
       f"WHERE n_chars >= {SHORT}")
def append_batches(spark, d):
    # all batches in one read of the landing folder, not a loop over files
    rec = _records(spark, d).withColumn(
        "batch_id", F.regexp_extract("path", r"batch_id=(\d+)", 1).cast("long"))
    good, _ = H.quarantine(rec)
    return good.filter(F.col(f"{H.PARSED}.has_abstract")).select("batch_id", F.col(f"{H.PARSED}.pmid").alias("PubMedID"))


@proof("stream_ingest",
       f"SELECT doc_id AS PMID, text AS Abstract FROM documents WHERE n_chars >= {SHORT}")
def stream_ingest(spark, d):
    src = _land_xml(spark, d)
    base = work_path(spark, "stream-ingest")
    return ingest.ingest_available(spark, src, f"{base}/table", f"{base}/checkpoint", bounded_state=False)


@proof("stream_ingest_bounded",
       f"SELECT doc_id AS PMID, text AS Abstract FROM documents WHERE n_chars >= {SHORT}")
def stream_ingest_bounded(spark, d):
    # endless-feed form: dedup state bounded by a watermark on landing time
    src = _land_xml(spark, d)
    base = work_path(spark, "stream-ingest-bounded")
    return ingest.ingest_available(spark, src, f"{base}/table", f"{base}/checkpoint")


@proof("xml_dirty_bodies",
       f"SELECT CAST(doc_id AS VARCHAR) AS PubMedID, text AS Abstract FROM documents WHERE n_chars >= {SHORT} AND doc_id % 7 <> 0")
def xml_dirty_bodies(spark, d):
    """Every record landed twice, in different bodies, and each seventh broken
    by a bare ampersand: one row per id stays, the broken ones are quarantined."""
    docs = S.table(spark, d, "documents")

    def land():
        good = H.render_xml_record(F.col("doc_id"), F.when(F.col("n_chars") >= SHORT, F.col("text")), [F.col("lang")])
        rec = F.when(F.col("doc_id") % 7 == 0, F.replace(good, F.lit("</PMID>"), F.lit(" & </PMID>"))).otherwise(good)
        once = _planned(spark, d).join(docs, "doc_id").select("batch_id", "pos", rec.alias("rec"))
        return H.land_bodies(once.union(once.select(F.col("batch_id") + 1, "pos", "rec")), work_path(spark, "dirty-bodies"))
    return H.abstracts_from_records(H.one_per_id(_records(spark, d, S.landed(spark, d, "dirty-bodies", land))))


@proof("src_xml_chunks", f"SELECT CAST(doc_id AS VARCHAR) AS PMID, {RECORD_SQL} AS record FROM documents")
def src_xml_chunks(spark, d):
    """The bodies read in splits, by record end."""
    records = H.parse_records(H.xml_records(H.read_body_chunks(spark, _land_xml(spark, d))))
    return records.select(F.col(f"{H.PARSED}.pmid").alias("PMID"), "record")


MESH_TERMS = [("de", "src3"), ("fr", "src1"), ("en", None)]


@proof("candidate_mesh_filter",
       "SELECT CAST(doc_id AS VARCHAR) AS PMID FROM documents WHERE "
       "(lang = 'de' AND source = 'src3' OR lang = 'fr' AND source = 'src1' OR lang = 'en') AND (doc_id % 3 = 0 OR doc_id % 4 = 0)")
def candidate_mesh_filter(spark, d):
    """Headings with qualifiers and major topics, parsed from landed records: topic = lang, qualifier = source."""
    def build():
        flag = [F.when(F.col("doc_id") % n == 0, F.lit("Y")).otherwise(F.lit("N")) for n in (3, 4)]
        record = F.concat(
            F.lit("<PubmedArticle><MedlineCitation><PMID>"), F.col("doc_id").cast("string"),
            F.lit('</PMID><MeshHeadingList><MeshHeading><DescriptorName MajorTopicYN="'), flag[0], F.lit('">'), H.xml_escape(F.col("lang")),
            F.lit('</DescriptorName><QualifierName MajorTopicYN="'), flag[1], F.lit('">'), H.xml_escape(F.col("source")),
            F.lit("</QualifierName></MeshHeading></MeshHeadingList></MedlineCitation></PubmedArticle>"))
        path = work_path(spark, "mesh-bodies")
        S.table(spark, d, "documents").select(record.alias("value")).write.text(path)
        return path
    records = H.parse_records(H.xml_records(H.read_body_chunks(spark, S.landed(spark, d, "_mesh_bodies", build))))
    held = records.select(F.col(f"{H.PARSED}.pmid").alias("PMID"), F.col(f"{H.PARSED}.headings").alias("headings"))
    return prep.mesh_term_filter(held, "headings", MESH_TERMS).select("PMID")


@proof("udtf_body_records",
       f"SELECT CAST(doc_id AS VARCHAR) AS pmid, CASE WHEN n_chars >= {SHORT} THEN text END AS abstract FROM documents")
def udtf_body_records(spark, d):
    """U3: the records of each body by a table function that SQL calls."""
    H.register_table_functions(spark)
    H.read_bodies(spark, _land_xml(spark, d)).createOrReplaceTempView("lf_bodies")
    return spark.sql("SELECT pmid, abstract FROM body_records(TABLE(lf_bodies) PARTITION BY path) WHERE error IS NULL")
