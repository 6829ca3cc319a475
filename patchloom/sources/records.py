"""JSON documents, JSON Lines indexes and split lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

INDEX_SCHEMA = "patch_id string, image_path string, label_path string, region string, year int, label_valid_fraction double, dominant_class string, class_counts map<string,bigint>, class_fractions map<string,double>, caption struct<question:string,answer:string>, qa struct<vqa_presence:array<struct<class:string,question:string,answer:string>>>, grounding_converted struct<question:string,answer:struct<present:boolean,union_bbox:array<double>,component_bboxes:array<array<double>>>>"
META_SCHEMA = "scene_file string, patch_id string, row int, col int, patch_size int, valid_fraction double, bands array<string>, region string, year int"


def read_index(spark: SparkSession, path: str, schema: str | StructType = INDEX_SCHEMA) -> DataFrame:
    """Records of JSON Lines files; blank lines vanish, broken ones keep their text in _corrupt_record.
    A missing path gives no rows."""
    full = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    wide = StructType(full.fields).add("_corrupt_record", "string")
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p):
        return spark.createDataFrame([], wide)
    return spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def read_documents(spark: SparkSession, root: str, schema: str = META_SCHEMA, pattern: str = "meta.json") -> DataFrame:
    """JSON documents of all folders below root, with file, their path."""
    return spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).json(root).withColumn("file", F.col("_metadata.file_path"))


def write_index(df: DataFrame, path: str, mode: str = "error") -> None:
    """Nulls are written out, so that an absent box reads null and not missing."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def rewrite_index(spark: SparkSession, path: str, to: str, change: Callable[[DataFrame], DataFrame], schema: str = INDEX_SCHEMA, dry_run: bool = False) -> tuple[int, int]:
    """Reads an index, changes it, writes it to a new place; records read and written. A dry run writes nothing."""
    if path.rstrip("/") == to.rstrip("/"):
        raise ValueError("an index is not written over while it is read")
    got = read_index(spark, path, schema)
    out = change(got)
    n = got.count()
    if dry_run:
        return n, 0
    write_index(out, to)
    return n, spark.read.text(to).count()


def migrate_legacy(df: DataFrame) -> DataFrame:
    """Grounding that older records keep inside qa moves to the top, where none is."""
    inside = "grounding_converted" in df.schema["qa"].dataType.names
    if not inside:
        return df
    lifted = F.coalesce("grounding_converted", "qa.grounding_converted") if "grounding_converted" in df.columns else F.col("qa.grounding_converted")
    return df.withColumn("grounding_converted", lifted).withColumn("qa", F.when(F.col("qa").isNotNull(), F.col("qa").dropFields("grounding_converted")))


def read_splits(spark: SparkSession, folder: str) -> DataFrame:
    """split, line of train.txt, val.txt and test.txt in a folder."""
    lines = spark.read.option("pathGlobFilter", "{train,val,test}.txt").text(folder)
    return lines.select(F.regexp_extract(F.col("_metadata.file_name"), r"(\w+)\.txt$", 1).alias("split"), F.col("value").alias("line"))
