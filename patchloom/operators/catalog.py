"""Scene catalog, regions, splits, index records: the tables around the rasters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G


@dataclass(frozen=True)
class ExportConfig:
    start: str
    end: str
    max_cloud: float = 10.0
    min_area_km2: float = 6000.0
    scale: int = 10

    def validate(self) -> ExportConfig:
        if self.start > self.end or self.max_cloud < 0 or self.min_area_km2 <= 0 or self.scale <= 0:
            raise ValueError(f"not a sound export: {self}")
        return self


def candidates(scenes: DataFrame, cfg: ExportConfig, box: list[Column] | None = None) -> DataFrame:
    """Scenes (acquired, cloud_pct, area_km2[, x1, y1, x2, y2]) in [start, end), clear and large enough, that meet the box."""
    cfg.validate()
    out = scenes.where((F.col("acquired") >= F.lit(cfg.start).cast("timestamp")) & (F.col("acquired") < F.lit(cfg.end).cast("timestamp"))).where(F.col("cloud_pct") < cfg.max_cloud).where(F.col("area_km2") >= cfg.min_area_km2)
    return out if box is None else out.where(G.boxes_meet(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), *box))


def least_cloudy(scenes: DataFrame) -> DataFrame:
    """One row: the least cloudy scene, the lowest id of equals, with its day as yyyyMMdd; Spark plans a top-1."""
    named = scenes.withColumn("day", F.date_format("acquired", "yyyyMMdd"))
    if "system_index" in scenes.columns:
        named = named.withColumn("scene_id", F.coalesce("scene_id", "system_index"))
    return named.orderBy("cloud_pct", "scene_id").limit(1)


def regions(names: DataFrame, col: str = "name") -> DataFrame:
    """Distinct regions of folders `{region}_s2_..._original`."""
    return names.where(F.col(col).endswith("_original") & F.col(col).contains("_s2_")).select(F.split_part(F.col(col), F.lit("_s2_"), F.lit(1)).alias("region")).distinct()


def scene_file(files: DataFrame, year: int) -> DataFrame:
    """region, path of its scene image of the year; none or several in a region are errors."""
    own = files.groupBy("region").agg(F.count_if(F.col("name").rlike(rf"^S2_RGBNIR_{year}_.*\.tif$")).alias("n"), F.max(F.when(F.col("name").rlike(rf"^S2_RGBNIR_{year}_.*\.tif$"), F.col("name"))).alias("path"))
    return own.select("region", F.when(F.col("n") == 1, F.col("path")).when(F.col("n") == 0, F.raise_error(F.concat(F.lit("no scene image for "), "region"))).otherwise(F.raise_error(F.concat(F.lit("several scene images for "), "region"))).alias("path"))


def label_paths(region: Column, year: int) -> dict[str, Column]:
    """Where the five label layers of a region lie."""
    tail = F.concat(F.lit("_"), region, F.lit("_scene.tif"))
    names = {"mapbiomas": f"MapBiomas_{year}", "prodes_deforestation": f"PRODES_deforestation_{year}", "prodes_hydrography": f"PRODES_hydrography_{year}", "prodes_no_forest": "PRODES_no_forest", "prodes_residual": "PRODES_residual"}
    return {k: F.concat(F.lit(v), tail) for k, v in names.items()}


def splits(lines: DataFrame) -> DataFrame:
    """lines (split, line) to patch_id, split: blanks drop, and of a repeated id the later of train, val, test wins."""
    order = F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 1).otherwise(2)
    ids = lines.select(F.trim("line").alias("patch_id"), "split", order.alias("o")).where("patch_id <> ''")
    return ids.groupBy("patch_id").agg(F.max_by("split", "o").alias("split"))


def inherit_split(augmented: DataFrame, split: DataFrame) -> DataFrame:
    """Turned patches of a source with a known split: patch_id, split."""
    own = split.select(F.col("patch_id").alias("__s"), "split")
    return augmented.where("angle <> 0").join(own, F.col("source_patch_id") == F.col("__s")).select("patch_id", "split")


def append_new(have: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """have and the rows of new whose keys it lacks, once each."""
    return have.unionByName(new.dropDuplicates(keys).join(have, keys, "left_anti"))


def last_record(records: DataFrame, key: str = "patch_id", position: str = "pos") -> DataFrame:
    """Of each id that is not empty, the record of the last position."""
    rest = [c for c in records.columns if c != key]
    own = records.where(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    return own.groupBy(key).agg(F.max_by(F.struct(*rest), position).alias("r")).select(key, "r.*")


def matches(ids: DataFrame, targets: DataFrame, col: str = "patch_id") -> DataFrame:
    """Distinct rows whose id, or whose part after the last slash, is among targets; empty ids never are."""
    t = targets.select(F.col(targets.columns[0]).alias("__t")).where("__t <> ''").distinct()
    full = ids.where(F.col(col) != "").withColumn("__last", F.element_at(F.split(col, "/"), -1))
    found = full.select("*", F.explode(F.array_distinct(F.array(F.col(col), F.col("__last")))).alias("__one")).join(t, F.col("__one") == F.col("__t"), "left_semi")
    return found.select(*ids.columns).distinct()


def pending(wanted: DataFrame, done: DataFrame, key: str = "patch_id", overwrite: bool = False) -> DataFrame:
    """wanted with status: exists where done has the key and nothing is overwritten, else written."""
    have = done.select(F.col(key).alias("__d")).distinct().withColumn("__have", F.lit(True))
    status = F.when(F.col("__have") & F.lit(not overwrite), "exists").otherwise("written")
    return wanted.join(have, F.col(key) == F.col("__d"), "left").withColumn("status", status).drop("__d", "__have")


def first_label(patches: DataFrame, meta: DataFrame, five: DataFrame, plain: DataFrame) -> DataFrame:
    """The label to use for each patch: the one its record names, else the reclassified one, else the plain one."""
    named = lambda df, c: df.select(F.col("patch_id").alias(f"__{c}"), F.col("path").alias(c)).dropDuplicates([f"__{c}"])
    out = patches
    for df, c in ((meta, "a"), (five, "b"), (plain, "d")):
        out = out.join(named(df, c), F.col("patch_id") == F.col(f"__{c}"), "left")
    return out.withColumn("label", F.coalesce("a", "b", "d")).drop("a", "b", "d", "__a", "__b", "__d")


def with_record(index: DataFrame, docs: DataFrame, key: str = "patch_id", name: str = "meta") -> DataFrame:
    """index with each record's document as a struct, null where there is none; of a repeated key the largest."""
    own = docs.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__k")).agg(F.max(F.struct(*(c for c in docs.columns if c != key))).alias(name))
    return index.join(own, F.col(key) == F.col("__k"), "left").drop("__k")


def rank_in(group: str, *order: Column) -> Column:
    return F.row_number().over(Window.partitionBy(group).orderBy(*order))
