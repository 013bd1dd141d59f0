"""Command line: build the binary, soft and NLI datasets from the three CSV
files (abstracts, binary labels, soft labels).

    python -m labelforge.build --abstracts A.csv --binary_labels B.csv \
        --soft_labels S.csv --save_dir out/

The label columns are read from the binary file's header (every column after
PMID, Split and Number of Annotators, in file order); the manifest of label
names is written next to the datasets.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from labelforge.operators.prepare import build_all
from labelforge.schemas import ABSTRACT_SCHEMA, CORPUS_SPEC, LabelSpec, label_file_schema
from labelforge.session import command_session
from labelforge.sources.files import read_csv_table, write_label_manifest


def header_labels(spark: SparkSession, path: str) -> list[str]:
    """Label column names from a label file's header row (the reader looks at
    the header only; no schema inference pass)."""
    return spark.read.option("header", "true").csv(path).columns[3:]


def build_from_csv(spark: SparkSession, abstracts: str, binary_labels: str, soft_labels: str,
                   save_dir: str, spec: LabelSpec | None = None) -> dict[str, str]:
    labels = header_labels(spark, binary_labels)
    if spec is None:
        spec = CORPUS_SPEC if labels == CORPUS_SPEC.labels else LabelSpec(labels=labels)
    schema = label_file_schema(labels)
    # the texts span lines, so their CSV is parsed by one task a file: parse it once
    landed = f"{save_dir}/abstracts"
    read_csv_table(spark, abstracts, ABSTRACT_SCHEMA).write.mode("overwrite").parquet(landed)
    bin_df = read_csv_table(spark, binary_labels, schema, multi_line=False)
    soft_df = read_csv_table(spark, soft_labels, schema, multi_line=False)
    paths = build_all(spark.read.parquet(landed), bin_df, soft_df, spec, save_dir)
    names = spark.createDataFrame(list(enumerate(labels)), "label_idx long, label_name string")
    paths["labels"] = write_label_manifest(names, f"{save_dir}/labels")
    return paths


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    ap.add_argument("--abstracts", required=True)
    ap.add_argument("--binary_labels", required=True)
    ap.add_argument("--soft_labels", required=True)
    ap.add_argument("--save_dir", required=True)
    ap.add_argument("--work_dir", help="shared folder for intermediate tables (else spark.checkpoint.dir)")
    args = ap.parse_args(argv)
    spark = command_session("labelforge-build", args.work_dir)
    for name, path in build_from_csv(spark, args.abstracts, args.binary_labels,
                                     args.soft_labels, args.save_dir).items():
        print(f"{name}\t{path}")


if __name__ == "__main__":
    main()
