"""Incremental ingest of landed response bodies (Structured Streaming).

Each body file is read once (file source + checkpoint), split into records,
parsed with the same pass as the batch path, and appended to a Parquet table;
malformed records and such without a whole-number id go to a quarantine table
beside it and never stop the stream. Duplicate ids are dropped within a
watermark on the body's landing time, so the state holds only the ids seen
within ``delay`` of the newest file; ``bounded_state=False`` keeps every id
ever seen instead (for a feed that is known to end).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelforge.operators import harvest as H


def parsed_stream(spark: SparkSession, src_dir: str, key: str = "PMID", delay: str = "1 day",
                  bounded_state: bool = True) -> DataFrame:
    """(key, Abstract, error, record): parsed records with an abstract, repeats
    dropped, and the bad records with their error."""
    raw = (spark.readStream.text(src_dir, wholetext=True)
                .select(F.col("value").alias("body"),
                        F.col("_metadata.file_modification_time").alias("landed_at")))
    p = F.col(H.PARSED)
    ident = p["pmid"].try_cast("long")
    rows = (H.parse_records(H.xml_records(raw))
            .withColumn("error", F.coalesce(p["error"], F.when(ident.isNull(), F.lit("id is no whole number"))))
            .filter(F.col("error").isNotNull() | p["has_abstract"])
            .select(ident.alias(key), p["abstract"].alias("Abstract"), "error",
                    F.when(F.col("error").isNotNull(), F.col("record")).alias("record"), "landed_at",
                    F.when(F.col("error").isNull(), F.concat(F.lit("id "), ident.cast("string")))
                    .otherwise(F.sha2("record", 256)).alias("_lf_once")))
    if bounded_state:
        rows = rows.withWatermark("landed_at", delay).dropDuplicatesWithinWatermark(["_lf_once"])
    else:
        rows = rows.dropDuplicates(["_lf_once"])
    return rows.drop("landed_at", "_lf_once")


def ingest_available(spark: SparkSession, src_dir: str, out_dir: str, checkpoint_dir: str,
                     key: str = "PMID", bounded_state: bool = True) -> DataFrame:
    """Process every body that has landed so far, then stop; return the table.

    A batch writes folders of its own number (overwritten if it runs again), so
    a restarted stream repeats no row. Bad records: ``<out_dir>-quarantine``.
    Nothing landed yet: an empty table.
    """
    schema = f"`{key}` long, Abstract string"
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{out_dir}/ingest_batch=-1")
    stream = parsed_stream(spark, src_dir, key, bounded_state=bounded_state)

    def land(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        batch.filter("error IS NULL").select(key, "Abstract").write.mode("overwrite").parquet(f"{out_dir}/ingest_batch={number}")
        bad = batch.filter("error IS NOT NULL").select("error", "record")
        bad.write.mode("overwrite").parquet(f"{out_dir}-quarantine/ingest_batch={number}")
        batch.unpersist()

    q = (stream.writeStream.foreachBatch(land).outputMode("append")
         .option("checkpointLocation", checkpoint_dir)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(f"{schema}, ingest_batch long").parquet(out_dir).drop("ingest_batch")
