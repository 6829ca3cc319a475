"""Captions, presence questions, grounding boxes and their write-back, all inside a patch's row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classes as K
from ..functions import geometry as G
from ..functions import text as X
from .components import CONVERTED, shape_of


@dataclass(frozen=True)
class CaptionConfig:
    min_dominant_frac: float = 0.5
    min_secondary_frac: float = 0.01
    max_secondary: int = 3
    no_spatial: bool = False


@dataclass(frozen=True)
class GroundingConfig:
    top_k: int = 3
    min_area_px: int = 16
    min_area_frac: float = 0.001
    threshold: float = 0.01


# Wording of questions.
CAPTION_QUESTION = "Describe the image"
PRESENCE_QUESTION = "Is there any {} areas in the image?"
GROUNDING_QUESTION = "return the coordinates of the deforestated area."


def secondary(fracs: Column, order: Column, cfg: CaptionConfig = CaptionConfig()) -> Column:
    """Class ids to name after the dominant one: water and urban first, then by share; needs pixels."""
    frac = lambda k: F.element_at(fracs, k + 1)
    forced = F.filter(F.array(F.lit(3), F.lit(4)), lambda k: (k != order[0]) & (frac(k) >= 0.01))
    most = F.least(F.size(forced) + cfg.max_secondary, F.lit(4))
    rest = F.filter(F.slice(order, 2, len(K.CLASS_NAMES)), lambda k: ~F.array_contains(forced, k) & (frac(k) >= cfg.min_secondary_frac))
    return F.slice(F.concat(forced, rest), F.lit(1), most)


def phrases(spatial: Column, fracs: Column, order: Column) -> Column:
    """A phrase by class, null for absent classes; intermixing is told of the dominant class alone."""
    return F.transform(spatial, lambda s, k: X.spatial_phrase(s, F.when(order[0] == k, F.element_at(fracs, k + 1))))


def caption(fracs: Column, order: Column, extra: Column, said: Column, cfg: CaptionConfig = CaptionConfig()) -> Column:
    name = K.class_name
    frac = lambda k: F.element_at(fracs, k + 1)
    about = lambda k: F.concat(name(k), F.lit(" (about "), X.percent(frac(k)), F.lit("%)"))
    top, most = order[0], frac(order[0])
    first = F.when(most >= cfg.min_dominant_frac, F.concat(F.lit("The image is dominated by "), about(top), F.lit("."))).otherwise("The image shows mixed land cover.")
    second = F.when(F.size(extra) > 0, F.concat(F.lit("Secondary classes include "), X.list_text(F.transform(extra, about)), F.lit(".")))

    def told(k: Column) -> Column:
        phrase = F.lit(None).cast("string") if cfg.no_spatial else F.element_at(said, k + 1)
        return F.concat(X.capitalize(name(k)), F.lit(" "), X.verb(name(k)), F.lit(" "), phrase, F.lit("."))

    others = F.array_compact(F.transform(F.slice(extra, 1, 2), told))
    return F.concat_ws(" ", first, second, told(top), others, X.mixture_sentence(most, X.entropy(fracs)))


def with_caption(patches: DataFrame, cfg: CaptionConfig = CaptionConfig()) -> DataFrame:
    """patches with spatial statistics plus class_order, secondary_classes, phrases, caption. Rows
    without counts pass through with null."""
    out = patches.withColumn("class_order", K.ranked(F.col("counts")))
    out = out.withColumn("secondary_classes", secondary(F.col("fracs"), F.col("class_order"), cfg))
    out = out.withColumn("phrases", phrases(F.col("spatial"), F.col("fracs"), F.col("class_order")))
    answer = caption(F.col("fracs"), F.col("class_order"), F.col("secondary_classes"), F.col("phrases"), cfg)
    return out.withColumn("caption", F.when(F.col("counts").isNotNull(), F.struct(F.lit(CAPTION_QUESTION).alias("question"), answer.alias("answer"))))


def presence(fracs: Column, question: str = PRESENCE_QUESTION, names: tuple[str, ...] = K.CLASS_NAMES) -> Column:
    """A yes or no question for each class, in class order; null without fractions."""
    one = [F.struct(F.lit(n).alias("class"), F.lit(question.format(n)).alias("question"), F.when(fracs[K.CLASS_NAMES.index(n)] > 0, "yes").otherwise("no").alias("answer")) for n in names]
    return F.when(fracs.isNotNull(), F.array(*one))


def with_grounding(patches: DataFrame, cfg: GroundingConfig = GroundingConfig()) -> DataFrame:
    """patches with shapes plus grounding: pixel_count, n_components, kept_components, present,
    union_bbox and component_bboxes (normalised), union_px and component_px (pixels, inclusive)."""
    s = shape_of(CONVERTED)
    least = G.area_threshold(F.col("valid"), cfg.min_area_px, cfg.min_area_frac)
    comps = F.coalesce(s["comps"], F.from_json(F.lit("[]"), "array<struct<id:bigint,area:bigint,x1:bigint,y1:bigint,x2:bigint,y2:bigint>>"))
    big = F.filter(comps, lambda c: c["area"] >= least)
    by_area = F.transform(F.array_sort(F.transform(big, lambda c: F.struct((-c["area"]).alias("o"), c["id"].alias("id"), c.alias("c")))), lambda x: x["c"])
    top = F.slice(by_area, 1, cfg.top_k) if cfg.top_k > 0 else by_area
    out = patches.withColumn("__comps", comps).withColumn("__top", top).withColumn("__n", F.coalesce(s["n"], F.lit(0).cast("long")))
    ends = [F.array_min(F.transform("__comps", lambda c: c["x1"])), F.array_min(F.transform("__comps", lambda c: c["y1"])), F.array_max(F.transform("__comps", lambda c: c["x2"])), F.array_max(F.transform("__comps", lambda c: c["y2"]))]
    ratio = F.when(F.col("valid") > 0, F.col("__n") / F.col("valid")).otherwise(0.0)
    present = (F.col("valid") > 0) & (F.col("__n") > 0) & (ratio >= cfg.threshold)
    box = lambda a, b, c, d: F.array(*G.normalize_box(a, b, c, d, F.col("w"), F.col("h")))
    union = F.when(F.col("__n") > 0, F.array(*ends))
    boxes = F.transform("__top", lambda c: box(c["x1"], c["y1"], c["x2"], c["y2"]))
    none = F.array().cast("array<array<double>>")
    grounding = F.struct(
        F.col("__n").alias("pixel_count"), F.size("__comps").cast("long").alias("n_components"), F.size("__top").cast("long").alias("kept_components"), present.alias("present"),
        F.when(present, box(*ends)).alias("union_bbox"), F.when(present, boxes).otherwise(none).alias("component_bboxes"), union.alias("union_px"), F.col("__top").alias("component_px"),
    )
    return out.withColumn("grounding", grounding).drop("__comps", "__top", "__n")


def write_back(index: DataFrame, answers: DataFrame, key: str, column: str, overwrite: bool = True, position: str | None = None) -> DataFrame:
    """index with `column` of answers by key; without overwrite a value that is there stays. Of a repeated
    key the answer of the last position counts; without a position a repeated key is an error."""
    own = answers.select(F.col(key).alias("__k"), F.col(column).alias("__v"), (F.col(position) if position else F.lit(0)).alias("__at"))
    last = own.groupBy("__k").agg(F.max_by(F.struct("__v"), "__at").alias("__one"), F.count("*").alias("__n"))
    value = F.col("__one.__v")
    if not position:
        value = F.when(F.col("__n") == 1, value).otherwise(F.raise_error(F.concat(F.lit("several answers for "), F.col("__k").cast("string"))).cast(answers.schema[column].dataType))
    new = last.select("__k", value.alias("__new"))
    old = F.col(column) if column in index.columns else F.lit(None)
    value = F.coalesce(F.col("__new"), old) if overwrite else F.coalesce(old, F.col("__new"))
    return index.join(new, F.col(key) == F.col("__k"), "left").withColumn(column, value).drop("__k", "__new")
