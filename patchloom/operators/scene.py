"""From a scene's pixels to patches: bands and layers on one grid, windows as rows, layers as blocks,
and the join of images with their labels.

A patch is one row with an array for each band and layer. Pixels meet their layers once, by an
equi-join on the scene's grid, and are gathered into windows once, whatever the number of bands and
layers; everything after that works inside a row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import classes as K
from ..functions import geometry as G
from . import raster

# Bands of an exported image, and the names of a patch's files.
BANDS = ("B2", "B3", "B4", "B8")
IMAGE, LABEL, RECLASSIFIED = "s2_rgbnir", "mapbiomas", "mapbiomas_5c"


def select_bands(scene: DataFrame, bands: Sequence[str] = BANDS, keys: Sequence[str] = ("r", "c")) -> DataFrame:
    return scene.select(*keys, *bands)


def label_band(scene: DataFrame, year: int, keys: Sequence[str] = ("r", "c")) -> DataFrame:
    """The land-cover band of a year, by its computed name, as `value`."""
    return scene.select(*keys, F.col(f"classification_{year}").alias("value"))


def grid(spark: SparkSession, h: int, w: int) -> DataFrame:
    """All pixels r, c of a grid."""
    return spark.range(h * w).select(F.floor(F.col("id") / w).cast("int").alias("r"), (F.col("id") % w).cast("int").alias("c"))


def on_grid(source: DataFrame, h: int, w: int, src_t: tuple, dst_t: tuple, value: str = "value", src_nodata: float | None = None) -> DataFrame:
    """A layer brought to the reference grid and clipped to it: what every export is."""
    return raster.resample_nearest(source, grid(source.sparkSession, h, w), src_t, dst_t, value, src_nodata)


def features(table: DataFrame, box: Sequence[Column], year: int | None = None) -> DataFrame:
    """Polygons (xs, ys[, year]) whose box meets the region's, of a year if one is given."""
    out = table if year is None else table.where(F.col("year") == year)
    return out.where(G.boxes_meet(F.array_min("xs"), F.array_min("ys"), F.array_max("xs"), F.array_max("ys"), *box))


def feature_layers(pixels: DataFrame, sources: dict[str, DataFrame], box: Sequence[Column], year: int, yearly: Sequence[str] = ("deforestation",), bin_size: int = 64) -> dict[str, DataFrame]:
    """Each polygon source burnt into the grid as 1, as a layer (r, c, value); only `yearly` sources are of one year."""
    burn = lambda name, t: raster.rasterize_rings(pixels.select("r", "c"), features(t, box, year if name in yearly else None), 1, bin_size)
    return {name: burn(name, t).withColumnRenamed("burnt", "value") for name, t in sources.items()}


def _part(cells: str, name: str) -> Column:
    return F.transform(cells, lambda x: x[name])


def patches(pixels: DataFrame, h: int, w: int, size: int = 256, stride: int = 256, bands: Sequence[str] = BANDS, layers: Sequence[str] = (), nodata: float | None = None, max_empty: float = raster.MAX_EMPTY_FRACTION, stem: str = "scene", transform: Sequence[float] | None = None) -> DataFrame:
    """Windows of a scene that are not nearly empty: patch_id, row, col, h, w, valid_fraction, an array for
    each band and layer, and transform where the scene's is given."""
    tiled = raster.tile(pixels, h, w, size, stride)
    ok = G.any_band_valid(F.array(*(F.col(b).cast("double") for b in bands)), F.lit(nodata).cast("double"))
    cell = F.struct((F.col("pr") * size + F.col("pc")).alias("i"), *bands, *layers)
    own = tiled.groupBy("row", "col").agg(F.avg(ok.cast("int")).alias("valid_fraction"), F.array_sort(F.collect_list(cell)).alias("cells"))
    own = own.where(F.col("valid_fraction") >= 1 - max_empty)
    out = own.select(raster.tile_id(F.lit(stem), F.col("row"), F.col("col")).alias("patch_id"), "row", "col", F.lit(size).alias("h"), F.lit(size).alias("w"), "valid_fraction", *(_part("cells", c).alias(c) for c in (*bands, *layers)))
    if transform is not None:
        at = G.window_origin([F.lit(float(x)) for x in transform], F.col("row"), F.col("col"))
        out = out.withColumn("transform", F.array(*(x.cast("double") for x in at)))
    return out


def meta(own: DataFrame, scene_file: str, region: str, year: int, bands: Sequence[str] = BANDS) -> DataFrame:
    """The nine fields of a patch's record."""
    return own.select(F.lit(scene_file).alias("scene_file"), "patch_id", "row", "col", F.col("h").alias("patch_size"), "valid_fraction", F.array(*map(F.lit, bands)).alias("bands"), F.lit(region).alias("region"), F.lit(year).alias("year"))


def filled(pixels: DataFrame, layers: dict[str, DataFrame], layer_nodata: dict[str, float | None]) -> DataFrame:
    """pixels with each layer's value; where a layer has none, its nodata, or 0 if it has no nodata."""
    out = raster.attach(pixels, layers, ["r", "c"])
    return out.select(*pixels.columns, *(F.coalesce(F.col(n), F.lit(layer_nodata.get(n) or 0).cast("int")).alias(n) for n in layers))


def reclassified(own: DataFrame, layer: str = LABEL, name: str = RECLASSIFIED) -> DataFrame:
    """own plus the array of class ids of a layer."""
    return own.withColumn(name, F.transform(layer, K.reclassify))


def blocks(own: DataFrame, bands: Sequence[str], layers: Sequence[str], nodata: float | None = None, layer_nodata: dict[str, float | None] | None = None) -> DataFrame:
    """A row for each layer and band of a patch: patch_id, layer, band, h, w, data, nodata. A label layer keeps
    its own nodata and has the image's where it has none; reclassified labels have 255."""
    known = dict(layer_nodata or {})

    def value_of(name: str) -> float | None:
        if name == RECLASSIFIED:
            return float(K.IGNORE)
        return nodata if known.get(name) is None else known[name]

    one = lambda layer, band, col, none: F.struct(F.lit(layer).alias("layer"), F.lit(band).alias("band"), F.col(col).cast("array<int>").alias("data"), F.lit(none).cast("double").alias("nodata"))
    rows = [one(IMAGE, k, b, nodata) for k, b in enumerate(bands, 1)] + [one(n, 1, n, value_of(n)) for n in layers]
    return own.select("patch_id", "h", "w", F.explode(F.array(*rows)).alias("b")).select("patch_id", "b.layer", "b.band", "h", "w", "b.data", "b.nodata")


def patch_ids(rows: DataFrame, layer: str | None = None, in_order: bool = False) -> DataFrame:
    """Distinct patch ids, of the patches with a layer if one is named; sorted only for a sink that wants it."""
    own = rows if layer is None else rows.where(F.col("layer") == layer)
    ids = own.select("patch_id").distinct()
    return ids.orderBy("patch_id") if in_order else ids


def with_layers(rows: DataFrame, required: Sequence[str]) -> DataFrame:
    """Block rows of the patches that have all required layers."""
    have = rows.where(F.col("layer").isin(list(required))).groupBy("patch_id").agg(F.count_distinct("layer").alias("n"))
    return rows.join(have.where(F.col("n") == len(set(required))), "patch_id", "left_semi")


def image_with_label(rows: DataFrame, image: str = IMAGE, label: str = RECLASSIFIED) -> DataFrame:
    """patch_id, h, w, cls: the label of each patch that has an image and a label; others drop out."""
    images = patch_ids(rows, image)
    return rows.where(F.col("layer") == label).select("patch_id", "h", "w", F.col("data").alias("cls")).join(images, "patch_id", "left_semi")


def remap_status(rows: DataFrame, source: str = LABEL, made: str = RECLASSIFIED) -> DataFrame:
    """patch_id, status: missing without the source layer, exists if the other is there, else written."""
    own = rows.groupBy("patch_id").agg(F.max(F.col("layer") == source).alias("has"), F.max(F.col("layer") == made).alias("made"))
    return own.select("patch_id", F.when(~F.col("has"), "missing").when(F.col("made"), "exists").otherwise("written").alias("status"))


def observed(df: DataFrame, name: str, **counters: Column) -> tuple[DataFrame, Observation]:
    """df with counters that are complete once an action on it has run, at no further pass."""
    seen = Observation(name)
    return df.observe(seen, *(F.count_if(c).alias(k) for k, c in counters.items())), seen
