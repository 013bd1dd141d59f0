"""Harvest: batch planning, response-body parsing and the ingest ledger.

No request is sent from here. A harvest is planned as a table (ids → fixed-size
batches → comma-joined id strings → request text), and the returned bodies,
landed as files, are parsed as a table: one row per body file (whole text),
split into one row per record, and every record is parsed once, in an
Arrow-batched pass that gives all its fields or the reason it is quarantined.
Bodies are bounded by the batch size, so a row never holds more than one
batch.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelforge.operators.positions import with_batch_id

RECORD_END = "</PubmedArticle>"
#: From a start tag (with or without attributes) to the record's end, or to where the next one starts or the body ends:
#: a record that was cut off comes out too, and is quarantined when it is parsed.
RECORD_PATTERN = rf"(?s)<PubmedArticle(?=[\s/>])[^>]*>.*?(?:{RECORD_END}|(?=<PubmedArticle[\s/>])|\z)"
ABSTRACT_MISSING = "Abstract not available"

# ---------------------------------------------------------------------------
# The request layout of the records service (base address,
# utility and database) and the record separator of its text responses.
# ---------------------------------------------------------------------------
REQUEST_BASE = "http://eutils.ncbi.nlm.nih.gov/entrez/eutils/efetch.fcgi?db=pubmed"
TEXT_RECORD_SEPARATOR = "\n\n\n"
DEFAULT_BATCH_SIZE = 250
# ---------------------------------------------------------------------------


# W1 / W2 / F6 ---------------------------------------------------------------
def plan_batches(ids: DataFrame, key: str, batch_size: int = DEFAULT_BATCH_SIZE) -> DataFrame:
    """(key, pos, batch_id): ids in key order, ``batch_size`` per batch."""
    return with_batch_id(ids.select(key).distinct(), [key], batch_size)


def batch_id_strings(planned: DataFrame, key: str) -> DataFrame:
    """(batch_id, n_ids, ids): the batch's ids comma-joined in order. A batch
    holds at most ``batch_size`` ids, so the list per group is bounded."""
    return planned.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n_ids"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col(key).cast("string").alias("id")))),
                                 lambda x: x["id"]), ",").alias("ids"))


def request_text(ids: Column, retmode: str | None = "text", rettype: str | None = "abstract",
                 retstart: int | None = None, retmax: int | None = None,
                 base: str = REQUEST_BASE, extra: dict[str, str] | None = None) -> Column:
    """Request string: base, ``&id=``, then each optional part only when set,
    then any extra ``&key=value`` parameters in the given order."""
    parts = [F.lit(base), F.lit("&id="), ids]
    for name, value in (("retmode", retmode), ("rettype", rettype),
                        ("retstart", retstart), ("retmax", retmax), *(extra or {}).items()):
        if value is not None:
            parts.append(F.lit(f"&{name}={value}"))
    return F.concat(*parts)


# F1 -------------------------------------------------------------------------
def split_text_records(body: Column, separator: str = TEXT_RECORD_SEPARATOR,
                       n_ids: Column | None = None) -> Column:
    """Text body → array of records, each stripped of surrounding white space.

    A body fetched for a single id is never split: it is one record, as is.
    """
    import re
    parts = F.split(body, re.escape(separator))
    split = F.transform(parts, lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    return split if n_ids is None else F.when(n_ids == 1, F.array(body)).otherwise(split)


# S8 -------------------------------------------------------------------------
def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """One row per landed body file: (path, body). ``wholetext`` must be given
    to ``text()`` itself."""
    return (spark.read.text(path, wholetext=True)
                 .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body")))


def read_body_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Bodies of any size in splits: (path, body), a row for each record end.

    The record's end tag is the line separator, so a task reads a part of a file
    and a row holds one record with what stands before it. The end tag is put
    back where a start tag precedes it; what follows the last record of a body
    has none, so a record cut off there stays cut off.
    """
    raw = spark.read.option("lineSep", RECORD_END).text(path)
    starts = F.col("value").rlike(r"<PubmedArticle[\s/>]")
    # a body whose last record is cut off ends without the separator: it parses to an error with the end tag, too
    return raw.select(F.col("_metadata.file_path").alias("path"),
                      F.when(starts, F.concat("value", F.lit(RECORD_END))).otherwise(F.col("value")).alias("body"))


def xml_records(bodies: DataFrame, body_col: str = "body") -> DataFrame:
    """One row per start tag of a ``PubmedArticle``, raw text kept: whole records, and what there is of cut-off ones."""
    return (bodies.select("*", F.explode(F.regexp_extract_all(F.col(body_col), F.lit(RECORD_PATTERN), 0))
                          .alias("record"))
                  .drop(body_col))


class BodyRecords:
    """Table function: the records of response bodies, for SQL.

    ``SELECT * FROM body_records(TABLE(bodies) PARTITION BY path)`` gives (path,
    number, pmid, has_abstract, abstract, error) for each start tag of a body; a
    task holds one body at a time.
    """

    def eval(self, row):
        import re
        found = re.finditer(RECORD_PATTERN.replace(r"\z", r"\Z"), row["body"] or "")
        for number, match in enumerate(found):
            fields = record_fields(match.group(0))
            yield row["path"], number, fields["pmid"], fields["has_abstract"], fields["abstract"], fields["error"]


def register_table_functions(spark: SparkSession) -> None:
    made = F.udtf(BodyRecords, returnType="path string, number int, pmid string, has_abstract boolean, abstract string, error string")
    spark.udtf.register("body_records", made)


RECORD_FIELDS = T.StructType([
    T.StructField("pmid", T.StringType()), T.StructField("has_abstract", T.BooleanType()),
    T.StructField("abstract", T.StringType()), T.StructField("mesh", T.ArrayType(T.StringType())),
    T.StructField("headings", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()), T.StructField("qualifiers", T.ArrayType(T.StringType())), T.StructField("major", T.BooleanType())]))),
    T.StructField("error", T.StringType())])
PARSED = "_lf_parsed"


def heading_fields(heading: ET.Element) -> dict:
    """Topic, qualifiers, and whether the topic or one of its qualifiers is a major one."""
    topic, qualifiers = heading.find("DescriptorName"), heading.findall("QualifierName")
    return {"name": None if topic is None else topic.text, "qualifiers": [q.text for q in qualifiers],
            "major": any(x is not None and x.get("MajorTopicYN") == "Y" for x in (topic, *qualifiers))}


def record_fields(record: str | None) -> dict:
    """One parse of a raw record: the first id, every text node under Abstract
    joined by one space (blanks kept), its headings and their descriptor ids; or
    the error that keeps it out."""
    out = dict.fromkeys(RECORD_FIELDS.names)
    try:
        root = ET.fromstring(record or "")
    except ET.ParseError as err:
        return out | {"error": str(err)}
    pmid = root.find("MedlineCitation/PMID")
    if pmid is None or not (pmid.text or "").strip():
        return out | {"error": "no id"}
    found = root.findall("MedlineCitation/Article/Abstract")
    return {"pmid": pmid.text, "has_abstract": bool(found),
            "abstract": " ".join(t for a in found for t in a.itertext()) if found else None,
            "headings": [heading_fields(h) for h in root.iterfind(".//MeshHeading")],
            "mesh": [h.get("UI") for h in root.iterfind(".//MeshHeading/DescriptorName") if h.get("UI") is not None],
            "error": None}


@F.pandas_udf(RECORD_FIELDS)
def _parse_records(records: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([record_fields(r) for r in records], columns=RECORD_FIELDS.names, dtype=object)


def parse_records(records: DataFrame, record_col: str = "record") -> DataFrame:
    """Adds the parsed fields of each record, once: one Arrow pass gives id,
    abstract, MeSH ids and the error flag together. Declared nondeterministic,
    so the optimizer never copies the parse into a pushed-down filter."""
    if PARSED in records.columns:
        return records
    return records.withColumn(PARSED, _parse_records.asNondeterministic()(F.col(record_col)))


def quarantine(records: DataFrame, record_col: str = "record") -> tuple[DataFrame, DataFrame]:
    """(good, bad) records, parsed; bad ones are malformed or have no id and
    carry an ``error`` column."""
    parsed = parse_records(records, record_col)
    error = F.col(f"{PARSED}.error")
    return parsed.filter(error.isNull()), parsed.filter(error.isNotNull()).withColumn("error", error).drop(PARSED)


def _good(records: DataFrame, record_col: str, *columns: Column) -> DataFrame:
    """The columns of every record that parses; the others are left to ``quarantine``."""
    return parse_records(records, record_col).filter(F.col(f"{PARSED}.error").isNull()).select(*columns)


def one_per_id(records: DataFrame, record_col: str = "record") -> DataFrame:
    """Parsed records without repeats: of an id that came back several times the
    record of the first body (by path, then content) stays; bad records go."""
    good, _ = quarantine(records, record_col)
    return (good.withColumn("_lf_at", F.struct("path", F.xxhash64(record_col)))
            .groupBy(F.col(f"{PARSED}.pmid").alias("_lf_id")).agg(F.min_by(PARSED, "_lf_at").alias(PARSED)).drop("_lf_id"))


# F2 - F5 --------------------------------------------------------------------
def abstracts_from_records(records: DataFrame, record_col: str = "record") -> DataFrame:
    """(PubMedID, Abstract); records without an abstract are dropped."""
    p = F.col(PARSED)
    return (_good(records, record_col, PARSED).filter(p["has_abstract"])
            .select(p["pmid"].alias("PubMedID"), p["abstract"].alias("Abstract")))


def abstracts_with_fallback(records: DataFrame, record_col: str = "record") -> DataFrame:
    """(PMID, Abstract) for every record; a missing or empty abstract reads
    ``Abstract not available``."""
    p = F.col(PARSED)
    return _good(records, record_col, p["pmid"].alias("PMID"),
                 F.coalesce(F.nullif(p["abstract"], F.lit("")), F.lit(ABSTRACT_MISSING)).alias("Abstract"))


def mesh_long(records: DataFrame, record_col: str = "record") -> DataFrame:
    p = F.col(PARSED)
    return (_good(records, record_col, PARSED)
            .select(p["pmid"].alias("PubMedID"), F.explode(p["mesh"]).alias("MeshID")))


def mesh_joined(records: DataFrame, record_col: str = "record") -> DataFrame:
    p = F.col(PARSED)
    return _good(records, record_col, p["pmid"].alias("PubMedID"), F.array_join(p["mesh"], ", ").alias("MeshID"))


# X5 -------------------------------------------------------------------------
def harvest_ledger(planned: DataFrame, received: DataFrame, key: str,
                   received_key: str = "PubMedID") -> DataFrame:
    """Per batch: ids asked for, ids returned, ids missing."""
    got = received.select(F.col(received_key).cast(planned.schema[key].dataType).alias(key)).distinct()
    marked = planned.join(got.withColumn("_lf_got", F.lit(1)), key, "left")
    return marked.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n_requested"),
        F.count("_lf_got").alias("n_received"),
        (F.count(F.lit(1)) - F.count("_lf_got")).alias("n_missing"))


# Fixture side: render records as a records service would return them -------
def xml_escape(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;"), ">", "&gt;")


def render_xml_record(pmid: Column, abstract: Column | None, mesh: list[Column]) -> Column:
    """One ``<PubmedArticle>``; the Abstract element is left out when
    ``abstract`` is null."""
    heads = [F.concat(F.lit('<MeshHeading><DescriptorName UI="'), xml_escape(m),
                      F.lit('">'), xml_escape(m), F.lit("</DescriptorName></MeshHeading>"))
             for m in mesh]
    abstract_el = F.when(abstract.isNotNull(), F.concat(
        F.lit("<Abstract><AbstractText>"), xml_escape(abstract),
        F.lit("</AbstractText></Abstract>"))).otherwise(F.lit(""))
    return F.concat(
        F.lit("<PubmedArticle><MedlineCitation><PMID>"), pmid.cast("string"), F.lit("</PMID><Article>"),
        abstract_el, F.lit("</Article><MeshHeadingList>"), F.concat(*heads) if heads else F.lit(""),
        F.lit("</MeshHeadingList></MedlineCitation></PubmedArticle>"))


def land_bodies(records: DataFrame, path: str, wrap: tuple[str, str] = ("<PubmedArticleSet>", "</PubmedArticleSet>"),
                separator: str = "") -> str:
    """Group rendered records (pos, batch_id, rec) into one body per batch and
    write each body as its own file (``batch_id=<n>/part-…``)."""
    # the texts move once and are sorted once, by batch: collecting a batch and writing it both go along that order
    dealt = records.repartition("batch_id").sortWithinPartitions("batch_id")
    bodies = dealt.groupBy("batch_id").agg(
        F.concat(F.lit(wrap[0]),
                 F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "rec"))),
                                          lambda x: x["rec"]), separator),
                 F.lit(wrap[1])).alias("value"))
    conf, by_hash = records.sparkSession.conf, "spark.sql.execution.useObjectHashAggregateExec"
    before = conf.get(by_hash)
    try:
        conf.set(by_hash, "false")
        bodies.write.mode("overwrite").partitionBy("batch_id").text(path)
    finally:
        conf.set(by_hash, before)
    return path
