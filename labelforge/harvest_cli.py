"""Command line: plan a harvest and ingest the bodies that came back.

    python -m labelforge.harvest_cli plan   --ids labels.csv --save_dir plan/ [--batch_size 250]
    python -m labelforge.harvest_cli ingest --ids labels.csv --bodies landing/ --save_dir out/

``plan`` writes the request table (batch id, ids, request text) — fetching is
left to whatever moves files, no request is sent from here. ``ingest`` reads
every landed XML body in one scan, quarantines malformed records, keeps one
record per id, and writes (as CSV with a header) the abstracts, the ids with their MeSH ids joined by
", ", and the per-batch ledger of ids asked for / returned / missing.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelforge.operators import harvest as H
from labelforge.operators.prepare import keyed_update
from labelforge.session import command_session
from labelforge.sources import files as IO


def requested_ids(spark: SparkSession, ids_csv: str, key: str = "PMID") -> DataFrame:
    return (spark.read.option("header", "true").csv(ids_csv)
                 .select(F.col(key).cast("long").alias(key)).filter(F.col(key).isNotNull()).distinct())


def plan(spark: SparkSession, ids_csv: str, save_dir: str, batch_size: int = H.DEFAULT_BATCH_SIZE,
         key: str = "PMID") -> str:
    planned = H.plan_batches(requested_ids(spark, ids_csv, key), key, batch_size)
    ids = H.batch_id_strings(planned, key)
    out = ids.select("batch_id", "n_ids", "ids", H.request_text(F.col("ids"), retmode=None, rettype=None)
                     .alias("request"))
    IO.write_csv(out, f"{save_dir}/requests")
    return f"{save_dir}/requests"


def ingest(spark: SparkSession, ids_csv: str, bodies: str, save_dir: str,
           batch_size: int = H.DEFAULT_BATCH_SIZE, key: str = "PMID") -> dict[str, str]:
    # one scan and one parse; every output reads the landed table
    landed = f"{save_dir}/parsed"
    H.parse_records(H.xml_records(H.read_bodies(spark, bodies))).write.mode("overwrite").parquet(landed)
    parsed = spark.read.parquet(landed)
    bad = H.quarantine(parsed)[1]
    records = H.one_per_id(parsed)
    abstracts = H.abstracts_from_records(records)
    mesh = H.mesh_joined(records)
    paths = {"abstracts": f"{save_dir}/pmid_w_abstracts", "mesh": f"{save_dir}/mesh_data_with_abstracts",
             "ledger": f"{save_dir}/ledger", "quarantine": f"{save_dir}/quarantine"}
    IO.write_csv(abstracts, paths["abstracts"])
    # ids never returned keep a missing MeSH value; returned ones get "" when they have none
    IO.write_csv(keyed_update(abstracts, mesh, "PubMedID", "MeshID"), paths["mesh"])
    planned = H.plan_batches(requested_ids(spark, ids_csv, key), key, batch_size)
    IO.write_csv(H.harvest_ledger(planned, abstracts, key), paths["ledger"])
    bad.select("path", "record", "error").write.mode("overwrite").json(paths["quarantine"])
    return paths


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    ap.add_argument("command", choices=["plan", "ingest"])
    ap.add_argument("--ids", required=True)
    ap.add_argument("--save_dir", required=True)
    ap.add_argument("--work_dir", help="shared folder for intermediate tables (else spark.checkpoint.dir)")
    ap.add_argument("--bodies")
    ap.add_argument("--batch_size", type=int, default=H.DEFAULT_BATCH_SIZE)
    args = ap.parse_args(argv)
    spark = command_session("labelforge-harvest", args.work_dir)
    if args.command == "plan":
        print(plan(spark, args.ids, args.save_dir, args.batch_size))
    else:
        for name, path in ingest(spark, args.ids, args.bodies, args.save_dir, args.batch_size).items():
            print(f"{name}\t{path}")


if __name__ == "__main__":
    main()
