"""python -m patchloom --blocks PATH --out PATH [--region R | --regions R,S] [--year Y] [--augment] [--limit N]"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .plans.pipeline import RegionConfig, index
from .sources.patches import blocks
from .sources.records import write_index


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="patchloom", description="Annotates label patches and writes their index.")
    p.add_argument("--blocks", required=True)
    p.add_argument("--out", required=True)
    some = p.add_mutually_exclusive_group()
    some.add_argument("--region", action="append", help="repeat for several; default: all that are there")
    some.add_argument("--regions", help="several, with commas between them")
    p.add_argument("--year", type=int)
    p.add_argument("--augment", action="store_true")
    p.add_argument("--limit", type=int)
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("patchloom").getOrCreate()
    rows = blocks(spark, a.blocks, layer="mapbiomas", year=a.year)
    wanted = a.region or [r.strip() for r in (a.regions or "").split(",") if r.strip()]
    rows = rows.where(F.col("region").isin(wanted)) if wanted else rows
    if rows.select("region").isEmpty():
        p.error("no region to work on")
    write_index(index(rows.withColumnRenamed("data", "code"), RegionConfig(with_augmentation=a.augment, limit=a.limit)), a.out)


if __name__ == "__main__":
    main()
