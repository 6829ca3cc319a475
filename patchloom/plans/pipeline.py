"""From scene pixels to an annotated index: one lazy plan for many regions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classes as K
from ..operators import annotate, raster, scene, stats


@dataclass(frozen=True)
class RegionConfig:
    min_label_valid_frac: float = stats.MIN_VALID_FRAC
    with_augmentation: bool = False
    limit: int | None = None
    patch_root: str = "patches"
    image_name: str = f"{scene.IMAGE}.tif"
    label_name: str = f"{scene.RECLASSIFIED}.tif"
    caption: annotate.CaptionConfig = field(default_factory=annotate.CaptionConfig)
    grounding: annotate.GroundingConfig = field(default_factory=annotate.GroundingConfig)


def index(patches: DataFrame, cfg: RegionConfig = RegionConfig()) -> DataFrame:
    """patches (patch_id, region, year, h, w, and code, or cls if it is reclassified) to annotated index
    records. No shuffle: every stage works inside a patch's row."""
    array = "cls" if "cls" in patches.columns else "code"
    base = raster.augment(patches, array) if cfg.with_augmentation else patches
    counted = stats.kept(stats.with_counts(base if array == "cls" else stats.with_classes(base)), cfg.min_label_valid_frac)
    file = lambda name: F.concat(F.lit(f"{cfg.patch_root.rstrip('/')}/"), F.col("patch_id").cast("string"), F.lit(f"/{name}"))
    counted = counted if cfg.limit is None else counted.limit(cfg.limit)
    shaped = annotate.with_grounding(annotate.with_caption(stats.with_spatial(counted), cfg.caption), cfg.grounding)
    names = F.array(*map(F.lit, K.CLASS_NAMES))
    g = F.col("grounding")
    return shaped.select(
        F.col("patch_id").cast("string").alias("patch_id"), file(cfg.image_name).alias("image_path"), file(cfg.label_name).alias("label_path"), "region", "year", F.col("valid_frac").alias("label_valid_fraction"), "dominant_class",
        F.map_from_arrays(names, F.col("counts")).alias("class_counts"), F.map_from_arrays(names, F.col("fracs")).alias("class_fractions"), "caption",
        F.struct(F.struct(F.col("dominant_class"), F.array_max("fracs").alias("dominant_fraction"), F.transform("secondary_classes", K.class_name).alias("secondary_classes"), F.map_filter(F.map_from_arrays(names, F.col("phrases")), lambda k, v: v.isNotNull()).alias("spatial_phrases"), F.map_filter(F.map_from_arrays(names, F.col("spatial")), lambda k, v: v.isNotNull()).alias("spatial_stats")).alias("m")).getField("m").alias("caption_meta"),
        F.struct(annotate.presence(F.col("fracs")).alias("vqa_presence")).alias("qa"),
        F.struct(F.lit(annotate.GROUNDING_QUESTION).alias("question"), F.struct(g["present"].alias("present"), g["union_bbox"].alias("union_bbox"), g["component_bboxes"].alias("component_bboxes")).alias("answer")).alias("grounding_converted"),
    )


def index_of_scene(pixels: DataFrame, layers: dict[str, DataFrame], h: int, w: int, region: str, year: int, size: int = 256, stride: int = 256, bands: tuple[str, ...] = scene.BANDS, nodata: float | None = None, layer_nodata: dict[str, float | None] | None = None, cfg: RegionConfig = RegionConfig(), stem: str = "scene") -> DataFrame:
    """A scene (r, c, bands) and its label layers (r, c, value) on its grid to annotated index records: windows,
    layers, reclassified labels, annotations. One join for each layer and one shuffle into windows."""
    known = layer_nodata or {}
    own = scene.patches(scene.filled(pixels, layers, known), h, w, size, stride, bands, tuple(layers), nodata, stem=stem)
    cls = scene.reclassified(own).withColumn("cls", F.col(scene.RECLASSIFIED)).drop(*bands, *layers, scene.RECLASSIFIED)
    return index(cls.withColumn("region", F.lit(region)).withColumn("year", F.lit(year)), cfg)
