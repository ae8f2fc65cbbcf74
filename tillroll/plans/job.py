"""Batch job: raw invoice lines to stored tables.

    spark-submit tillroll/plans/job.py --raw lines.csv --out marts
    python -m tillroll.plans.job --raw lines.csv --out marts --warehouse
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tillroll.plans import marts
from tillroll.schemas import RAW_LINES
from tillroll.sources import sinks, tables, warehouse


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    raw = tables.read_table(spark, args.raw, args.format, RAW_LINES if args.format in ("csv", "json") else None)
    stored = marts.run_pipeline(raw, args.out, partition_by=tuple(args.partition_by or ()))
    sinks.save_report(marts.business_report(stored), f"{args.out}/business_report")
    if args.warehouse:
        warehouse.create_namespaces(spark)
        warehouse.create_tables(spark)
        warehouse.load_warehouse(spark, stored)
        warehouse.warehouse_counts(spark).show(truncate=False)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--raw", required=True, help="file or folder of raw invoice lines")
    p.add_argument("--format", default="csv", choices=["csv", "json", "parquet", "orc"])
    p.add_argument("--out", required=True, help="folder for the stored tables")
    p.add_argument("--partition-by", nargs="*", help="fact columns to partition by, e.g. Year Month")
    p.add_argument("--warehouse", action="store_true", help="also load the catalog tables")
    return p


def main() -> None:
    args = parser().parse_args()
    spark = SparkSession.builder.appName("tillroll-marts").getOrCreate()
    run(spark, args)
    spark.stop()


if __name__ == "__main__":
    main()
