"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separators of `[^\x20\x09-\x0D]+` words.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, one machine gets a temporary folder and a
    cluster an error, as executors do not see each other's folders."""
    ctx = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or ctx.getCheckpointDir()
    if not folder:
        if not ctx.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="patchloom-")
        ctx.setCheckpointDir(folder)
    return folder.rstrip("/")


def materialise(df: DataFrame, *partition_by: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back: lineage ends there, and lost
    executors cost no recomputation of what stands above."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/patchloom-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of materialise() that nothing reads any more, and lets Spark drop the shuffles
    that no plan can need."""
    ctx = SparkSession.active().sparkContext
    for t in tables:
        path = ctx._jvm.org.apache.hadoop.fs.Path(t._written)
        path.getFileSystem(ctx._jsc.hadoopConfiguration()).delete(path, True)
    ctx._jvm.System.gc()


def row_key(id_col: str, text_col: str) -> list[Column]:
    """Two columns that tell rows apart by id and text. Repeated rows share a key, and so a
    result; a null id has its own value."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("k1"), F.xxhash64(F.col(text_col)).alias("k2")]


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def held_out(id_col: Column, mod: int, rest: int) -> Column:
    """crc32 of the id as text, modulo mod, is rest. A null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % mod == rest


def text_bytes(df: DataFrame, text_col: str = "text") -> int:
    """UTF-8 bytes of a column, one pass over it."""
    return df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
