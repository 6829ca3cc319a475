"""Patches, scenes and label layers, as block rows (one array a patch) or pixel rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_SCHEMA = "patch_id string, layer string, band int, h int, w int, data array<int>, nodata double, transform array<double>, crs string, region string, year int"
SIDE = 8
TILES_ACROSS = 20


def blocks(spark: SparkSession, path: str, layer: str | None = None, region: str | None = None, year: int | None = None) -> DataFrame:
    """Block rows under a Parquet path that is partitioned by region and year; the filters prune folders and columns."""
    out = spark.read.parquet(path)
    for name, value in (("layer", layer), ("region", region), ("year", year)):
        out = out if value is None else out.where(F.col(name) == value)
    return out


def write_blocks(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy("region", "year").parquet(path)


def single_band(df: DataFrame) -> DataFrame:
    """Block rows, with an error for a patch and layer of several bands."""
    bad = df.groupBy("patch_id", "layer").agg(F.min("band").alias("lo"), F.max("band").alias("hi")).where("lo < hi").select(F.col("patch_id").alias("__p"), F.col("layer").alias("__l"))
    told = F.raise_error(F.concat(F.lit("a label layer has one band: "), F.col("layer"), F.lit(" of "), F.col("patch_id"))).cast("boolean")
    joined = df.join(bad, F.col("patch_id").eqNullSafe(F.col("__p")) & F.col("layer").eqNullSafe(F.col("__l")), "left")
    return joined.where(F.when(F.col("__l").isNull(), True).otherwise(told)).select(*df.columns)  # a filter, so that no plan prunes it


def to_pixels(df: DataFrame, col: str = "data") -> DataFrame:
    """One row a pixel: the other columns, r, c, v."""
    rest = [c for c in df.columns if c != col]
    return df.select(*rest, F.posexplode(col).alias("__i", "v")).withColumn("r", F.floor(F.col("__i") / F.col("w")).cast("int")).withColumn("c", (F.col("__i") % F.col("w")).cast("int")).drop("__i")


def to_blocks(px: DataFrame, keys: list[str], h: Column, w: Column) -> DataFrame:
    """Pixels (r, c, v) back to one array a key, row by row."""
    own = px.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("r", "c", "v"))).alias("p"))
    return own.select(*keys, h.alias("h"), w.alias("w"), F.transform("p", lambda x: x["v"]).alias("data"))


def code_of(v: Column, label: Column) -> Column:
    """The driver's vectors as land-cover codes: a value, shifted by the label, in one of six bins."""
    u = v.cast("double") + ((label % 5) - 2) * F.lit(0.05)
    return F.when(u < -0.20, 4).when(u < -0.02, 3).when(u < 0.06, 15).when(u < 0.12, 18).when(u < 0.20, 33).otherwise(24)


def from_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """patch_id, region, year, h, w, code: each vector of 64 numbers as a patch of 8 by 8 codes."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return v.select(F.col("vec_id").alias("patch_id"), F.concat(F.lit("region"), F.col("vec_id") % 5).alias("region"), (F.lit(2020) + F.col("vec_id") % 3).cast("int").alias("year"), F.lit(SIDE).alias("h"), F.lit(SIDE).alias("w"), F.transform("embedding", lambda x: code_of(x, F.col("label"))).alias("code"))


def mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels r, c, v (code) of one scene that the patches tile, twenty to a row."""
    p = from_vectors(spark, sf_dir).select("patch_id", "w", "code")
    px = to_pixels(p, "code")
    return px.select((F.floor(F.col("patch_id") / TILES_ACROSS) * SIDE + F.col("r")).cast("int").alias("r"), (F.col("patch_id") % TILES_ACROSS * SIDE + F.col("c")).cast("int").alias("c"), "v")
