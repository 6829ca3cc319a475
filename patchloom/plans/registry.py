"""Names of queries, the functions that build them, and SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classes as K
from ..functions import geometry as G
from ..functions import text as X
from ..operators import annotate, catalog, raster, scene, stats
from ..operators.components import CONVERTED, with_shapes
from ..sources import patches as P
from . import oracle as O
from .pipeline import RegionConfig, index, index_of_scene

QUERIES: dict = {}
ORACLE_SQL: dict = {}
SIZE = 32


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def keep(f):  # noqa: ANN001, ANN202
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.with_counts(stats.with_classes(P.from_vectors(spark, sf_dir)))


def dp(c, n: int = 6):  # noqa: ANN001, ANN201
    """Rounded for comparison, and never a negative zero."""
    return F.round(c, n) + F.lit(0.0)


def shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_shapes(counted(spark, sf_dir).drop("code"))


def spatial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.with_spatial(counted(spark, sf_dir).drop("code"))


@query("class_fractions", O.CLASS_FRACTIONS)
def class_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fractions and dominant class of the patches with enough valid pixels."""
    c = stats.kept(counted(spark, sf_dir))
    return c.select("patch_id", "valid", dp(F.col("valid_frac")).alias("valid_frac"), "dominant_class", *(F.col("counts")[k].alias(f"n_{n}") for k, n in enumerate(K.CLASS_NAMES)), *(dp(F.col("fracs")[k]).alias(f"frac_{n}") for k, n in enumerate(K.CLASS_NAMES)))


@query("dominant_class", O.DOMINANT_CLASS)
def dominant_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(spark, sf_dir).groupBy("dominant_class").agg(F.count("*").alias("patches"))


@query("remap_histogram", O.REMAP_HISTOGRAM)
def remap_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(counted(spark, sf_dir)).select(F.col("cls").cast("long").alias("cls"), "pixels", dp(F.col("pct")).alias("pct"))


@query("patch_histogram", O.PATCH_HISTOGRAM)
def patch_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the classes that a patch has, the ignored one included."""
    e = counted(spark, sf_dir).select("patch_id", F.explode(F.concat(F.transform("counts", lambda n, k: F.struct(k.cast("long").alias("cls"), n.alias("n"))), F.array(F.struct(F.lit(255).cast("long").alias("cls"), (F.col("total") - F.col("valid")).alias("n"))))).alias("e"))
    return e.select("patch_id", "e.cls", "e.n").where("n > 0")


@query("kept_dropped_report", O.KEPT_DROPPED)
def kept_dropped_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.report(counted(spark, sf_dir)).withColumn("pct", dp(F.col("pct")))


@query("summary_json", O.SUMMARY_JSON)
def summary_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.summary_json(counted(spark, sf_dir))


def scene_shape(sf_dir: str, spark: SparkSession) -> tuple[int, int]:
    n = table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0] + 1
    return -(-n // P.TILES_ACROSS) * P.SIDE, P.TILES_ACROSS * P.SIDE


def tiles(spark: SparkSession, sf_dir: str, stride: int) -> DataFrame:
    h, w = scene_shape(sf_dir, spark)
    px = raster.tile(P.mosaic(spark, sf_dir), h, w, SIZE, stride).withColumn("b2", F.when(F.col("v") == 4, 0).otherwise(F.col("v")))
    t = raster.valid_tiles(px, ["b2"], F.lit(None).cast("double"))
    return t.select(raster.tile_id(F.lit("scene"), F.col("row"), F.col("col")).alias("tile_id"), F.col("pixels"), dp(F.col("valid_fraction")).alias("valid_fraction"))


@query("tile_valid_fraction", O.tiles(32))
def tile_valid_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles(spark, sf_dir, SIZE)


@query("tile_sliding", O.tiles(16))
def tile_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles(spark, sf_dir, SIZE // 2)


@query("rotate_pixels", O.ROTATE_PIXELS)
def rotate_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums over the pixels of each turned patch that tell every place apart."""
    a = raster.augment(P.from_vectors(spark, sf_dir)).where("angle <> 0")
    px = a.select("patch_id", "angle", F.posexplode("code").alias("i", "v"))
    return px.groupBy("patch_id", "angle").agg(F.sum((F.col("i") + 1) * F.col("v")).cast("long").alias("place_sum"), F.sum((F.col("i") + 1) * (F.col("i") + 1) * F.col("v")).cast("long").alias("square_sum"))


@query("rotate_transform", O.ROTATE_TRANSFORM)
def rotate_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transforms of a patch and of its turns, true to the footprint and in the compatible form."""
    p = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("patch_id"))
    t = [F.lit(10.0), F.lit(0.0), F.lit(500000.0), F.lit(0.0), F.lit(-10.0), F.lit(9000000.0)]
    t = G.window_origin(t, F.floor(F.col("patch_id") / 20) * 8, F.col("patch_id") % 20 * 8)
    out = None
    for angle in raster.ANGLES:
        for compat in (False, True):
            one = p.select("patch_id", F.lit(angle).alias("angle"), F.lit(compat).alias("compat"), *(v.cast("double").alias(n) for n, v in zip("abcdef", G.rotate_transform(angle, t, F.lit(8), F.lit(8), compat), strict=True)))
            out = one if out is None else out.unionByName(one)
    return out.select("patch_id", "angle", "compat", *(dp(F.col(n)).alias(n) for n in "abcdef"))


@query("augment_union", O.AUGMENT_UNION)
def augment_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = raster.augment(P.from_vectors(spark, sf_dir))
    return stats.with_counts(stats.with_classes(a)).select("patch_id", "source_patch_id", F.col("angle").cast("long").alias("angle"), F.col("counts")[0].alias("n_forest"), "valid")


def split_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split files from documents: by id, with blanks, and ids that stand in two files."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    part = F.when(F.col("doc_id") % 10 < 7, "train").when(F.col("doc_id") % 10 < 9, "val").otherwise("test")
    first = d.select(part.alias("split"), F.when(F.col("doc_id") % 50 == 49, " ").otherwise(F.concat(F.lit(" "), (F.col("doc_id") % 400).cast("string"))).alias("line"))
    return first


@query("split_inherit", O.SPLIT_INHERIT)
def split_inherit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.inherit_split(raster.augment(P.from_vectors(spark, sf_dir)), catalog.splits(split_lines(spark, sf_dir)))


@query("split_append_anti", O.SPLIT_APPEND)
def split_append_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = catalog.splits(split_lines(spark, sf_dir))
    new = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("patch_id"), F.lit("train").alias("split"))
    return catalog.append_new(have, new.union(new), ["patch_id"])


@query("nearest_resample", O.NEAREST_RESAMPLE)
def nearest_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mosaic on a finer, shifted grid that overhangs it; forest codes stand for nodata."""
    h, w = scene_shape(sf_dir, spark)
    grid = scene.grid(spark, h * 10 // 7 + 8, w * 10 // 7 + 8)
    return raster.resample_nearest(P.mosaic(spark, sf_dir), grid, (10.0, 0.0, 0.0, 0.0, -10.0, 0.0), (7.0, 0.0, -13.0, 0.0, -7.0, 9.0), "v", src_nodata=3, dst_nodata=255).select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.col("v").cast("long").alias("v"))


@query("export_band", O.EXPORT_BAND)
def export_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A year's land-cover band on the reference grid; what the source does not reach is 0."""
    h, w = scene_shape(sf_dir, spark)
    years = P.mosaic(spark, sf_dir).select("r", "c", F.col("v").alias("classification_2020"), (F.col("v") + 1).alias("classification_2021"))
    out = scene.on_grid(scene.label_band(years, 2021), h * 10 // 7 + 8, w * 10 // 7 + 8, (10.0, 0.0, 0.0, 0.0, -10.0, 0.0), (7.0, 0.0, 0.0, 0.0, -7.0, 0.0))
    return out.groupBy(F.col("r").cast("long").alias("r")).agg(F.sum("value").cast("long").alias("total"), F.count_if(F.col("value") > 0).alias("inside"))


@query("label_attach", O.LABEL_ATTACH)
def label_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five layers on the mosaic's grid, each with pixels missing."""
    px = P.mosaic(spark, sf_dir)
    names = ("mapbiomas", "deforestation", "no_forest", "residual", "hydrography")
    layers = {n: px.where((F.col("r") + F.col("c")) % (k + 2) != 0).select("r", "c", (F.col("v") * 10 + k).alias("value")) for k, n in enumerate(names)}
    out = raster.attach(px.select("r", "c"), layers, ["r", "c"])
    return out.groupBy(F.col("r").cast("long").alias("r")).agg(*(F.count(n).alias(f"n_{n}") for n in names), *(F.sum(n).cast("long").alias(f"sum_{n}") for n in names))


def rows_burnt(burnt: DataFrame, value: str = "burnt") -> DataFrame:
    return burnt.groupBy(F.col("r").cast("long").alias("r")).agg(F.sum(value).cast("long").alias("burnt"), F.sum(F.col(value) * F.col("c")).cast("long").alias("place_sum"))


@query("rasterize_points", O.RASTERIZE_POINTS)
def rasterize_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 160).cast("double").alias("x"), (F.col("l_suppkey") * 7 % 128).cast("double").alias("y"))
    h, w = (int(v) + 1 for v in pts.agg(F.max("y"), F.max("x")).first())
    return rows_burnt(raster.rasterize_points(scene.grid(spark, h, w), pts, 1.0))


def rings(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    """Quadrilaterals around suppliers."""
    x, y = ((F.col("s_suppkey") * 37 + shift) % 150).cast("double"), ((F.col("s_suppkey") * 53 + shift) % 120).cast("double")
    return table(spark, sf_dir, "supplier").select(F.array(x, x + 6, x + 8, x - 1).alias("xs"), F.array(y, y - 2, y + 5, y + 4).alias("ys"), (F.lit(2019) + F.col("s_suppkey") % 3).alias("year"))


def ring_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, w = (int(v) + 1 for v in rings(spark, sf_dir).agg(F.max(F.array_max("ys")), F.max(F.array_max("xs"))).first())
    return scene.grid(spark, h, w)


@query("rasterize_rings", O.RASTERIZE_RINGS)
def rasterize_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rings burnt into the grid that holds them."""
    return rows_burnt(raster.rasterize_rings(ring_grid(spark, sf_dir), rings(spark, sf_dir), 1, 32))


@query("feature_layers", O.FEATURE_LAYERS)
def feature_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four polygon sources that meet a region, one of them of a single year, as layers."""
    box = [F.lit(v) for v in (20.0, 10.0, 100.0, 90.0)]
    layers = scene.feature_layers(ring_grid(spark, sf_dir), {name: rings(spark, sf_dir, n) for name, n in O.FEATURE_SOURCES.items()}, box, 2020, bin_size=32)
    out = None
    for name, layer in layers.items():
        one = rows_burnt(layer, "value").select(F.lit(name).alias("layer"), "*")
        out = one if out is None else out.unionByName(one)
    return out


LAYER_NODATA = {"mapbiomas": None, "deforestation": 99.0}


def scene_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, DataFrame], int, int]:
    """The mosaic as a scene of two bands, and two label layers with pixels missing."""
    px = P.mosaic(spark, sf_dir)
    bands = px.select("r", "c", F.when(F.col("v") == 4, 0).otherwise(F.col("v")).alias("B2"), F.when(F.col("v") == 33, 33).otherwise(0).alias("B8"))
    layers = {"mapbiomas": px.where((F.col("r") * 7 + F.col("c")) % 11 != 0).select("r", "c", F.col("v").alias("value")), "deforestation": px.where((F.col("r") + F.col("c")) % 2 != 0).select("r", "c", (F.col("v") * 10 + 1).alias("value"))}
    return bands, layers, *scene_shape(sf_dir, spark)


def scene_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands, layers, h, w = scene_of(spark, sf_dir)
    return scene.patches(scene.filled(bands, layers, LAYER_NODATA), h, w, SIZE, SIZE, ("B2", "B8"), tuple(layers), transform=(10.0, 0.0, 500000.0, 0.0, -10.0, 9000000.0))


def scene_blocks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scene.blocks(scene.reclassified(scene_rows(spark, sf_dir)), ("B2", "B8"), (*LAYER_NODATA, scene.RECLASSIFIED), -1.0, LAYER_NODATA)


def place_sum(array: str):  # noqa: ANN201
    """A sum that tells every place of an array apart."""
    return F.aggregate(F.transform(array, lambda v, i: (i + 1).cast("long") * v), F.lit(0).cast("long"), lambda a, x: a + x)


@query("scene_patches", O.SCENE_PATCHES)
def scene_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of the scene with bands and layers, and the origins of their transforms."""
    p = scene_rows(spark, sf_dir)
    return p.select("patch_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), dp(F.col("valid_fraction")).alias("valid_fraction"), F.col("transform")[2].alias("origin_x"), F.col("transform")[5].alias("origin_y"), place_sum("B2").alias("b2_sum"), place_sum("B8").alias("b8_sum"), place_sum("mapbiomas").alias("label_sum"))


@query("scene_blocks", O.SCENE_BLOCKS)
def scene_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands, aligned and reclassified layers of every patch as blocks, each with its nodata."""
    b = scene_blocks_of(spark, sf_dir)
    return b.select("patch_id", "layer", F.col("band").cast("long").alias("band"), "nodata", place_sum("data").alias("place_sum"), F.size("data").cast("long").alias("pixels"))


def incomplete_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of patches of which a third lack an image, and a third the label."""
    at = F.regexp_extract_all("patch_id", F.lit(r"_[rc](\d+)"), F.lit(1))
    k = (F.floor(at[0].cast("int") / SIZE) + F.floor(at[1].cast("int") / SIZE)) % 3
    b = scene_blocks_of(spark, sf_dir)
    return b.where(~((k == 0) & F.col("layer").isin(scene.LABEL, scene.RECLASSIFIED)) & ~((k == 1) & F.col("layer").isin(scene.IMAGE, scene.RECLASSIFIED)))


@query("image_label_join", O.IMAGE_LABEL_JOIN)
def image_label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches that have an image and a reclassified label; others drop out."""
    j = scene.image_with_label(scene.with_layers(incomplete_blocks(spark, sf_dir), [scene.IMAGE, scene.LABEL]))
    return j.select("patch_id", F.size(F.filter("cls", lambda v: v != K.IGNORE)).cast("long").alias("valid"))


@query("remap_status", O.REMAP_STATUS)
def remap_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scene.remap_status(incomplete_blocks(spark, sf_dir))


@query("index_of_scene", O.INDEX_OF_SCENE)
def index_of_scene_(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a scene and its layers to index records, in one plan."""
    bands, layers, h, w = scene_of(spark, sf_dir)
    r = index_of_scene(bands, layers, h, w, "region0", 2020, SIZE, SIZE, ("B2", "B8"), layer_nodata=LAYER_NODATA, cfg=RegionConfig(min_label_valid_frac=0.5))
    return r.select("patch_id", "image_path", "label_path", dp(F.col("label_valid_fraction")).alias("label_valid_fraction"), "dominant_class", F.col("class_counts")["water"].alias("n_water"))


@query("augment_transforms", O.AUGMENT_TRANSFORMS)
def augment_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transforms of turned patches, as they stand in the turned rows."""
    p = P.from_vectors(spark, sf_dir)
    t = G.window_origin([F.lit(v) for v in (10.0, 0.0, 500000.0, 0.0, -10.0, 9000000.0)], F.floor(F.col("patch_id") / 20) * 8, F.col("patch_id") % 20 * 8)
    a = raster.augment(p.withColumn("transform", F.array(*(x.cast("double") for x in t)))).where("angle <> 0")
    return a.select("patch_id", "angle", *(dp(F.col("transform")[k]).alias(n) for k, n in enumerate("abcdef")))


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    x, y = (F.col("o_orderkey") * 13 % 360).cast("double"), (F.col("o_custkey") * 7 % 180).cast("double")
    return o.select(F.concat(F.lit("scene"), F.col("o_orderkey")).alias("scene_id"), F.col("o_orderdate").cast("timestamp").alias("acquired"), (F.col("o_orderkey") * 31 % 1000 / 10).alias("cloud_pct"), G.ring_area(F.array(x, x + 100, x + 100, x), F.array(y, y, y + F.col("o_orderkey") % 120, y + F.col("o_orderkey") % 120)).alias("area_km2"), x.alias("x1"), y.alias("y1"), (x + 100).alias("x2"), (y + F.col("o_orderkey") % 120).alias("y2"))


CATALOG = catalog.ExportConfig("1995-01-01", "1997-01-01", 40.0, 6000.0)


@query("catalog_filter", O.CATALOG_FILTER)
def catalog_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes in the date range that are clear, large and meet a box."""
    box = [F.lit(v) for v in (100.0, 50.0, 180.0, 90.0)]
    return catalog.candidates(scenes(spark, sf_dir), CATALOG, box).select("scene_id", F.date_format("acquired", "yyyyMMdd").alias("day"), dp(F.col("cloud_pct")).alias("cloud_pct"), dp(F.col("area_km2")).alias("area_km2"))


@query("catalog_top1", O.CATALOG_TOP1)
def catalog_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = [F.lit(v) for v in (100.0, 50.0, 180.0, 90.0)]
    return catalog.least_cloudy(catalog.candidates(scenes(spark, sf_dir), CATALOG, box)).select("scene_id", "day", dp(F.col("cloud_pct")).alias("cloud_pct"))


@query("cloud_bitmask", O.CLOUD_BITMASK)
def cloud_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", dp(raster.cloud_free(F.col("value"), F.col("event_id") * 37 % 8192)).alias("value"))


@query("feature_semi_join", O.FEATURE_SEMI)
def feature_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of a year whose box meets the scene's."""
    o = scenes(spark, sf_dir).withColumn("year", F.year("acquired"))
    return o.where("year = 1996").where(G.boxes_meet(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), *G.point_box(F.lit(200.0), F.lit(60.0), 0.02))).groupBy("year").agg(F.count("*").alias("features"), dp(F.sum("area_km2")).alias("area"))


@query("connected_components", O.CONNECTED)
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = shaped(spark, sf_dir).select("patch_id", F.explode(F.filter("shapes", lambda s: s["cls"] < CONVERTED)).alias("s"))
    return s.select("patch_id", F.col("s.cls").cast("long").alias("cls"), F.explode("s.comps").alias("k")).select("patch_id", "cls", F.col("k.id").alias("comp_id"), F.col("k.area").alias("area"), F.col("k.x1").alias("x1"), F.col("k.y1").alias("y1"), F.col("k.x2").alias("x2"), F.col("k.y2").alias("y2"))


@query("component_sizes", O.COMPONENT_SIZES)
def component_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the component sizes of each class of a patch."""
    s = spatial(spark, sf_dir).select("patch_id", F.posexplode("spatial").alias("cls", "s")).where("s is not null")
    return s.select("patch_id", F.col("cls").cast("long").alias("cls"), F.col("s.pixel_count").alias("pixel_count"), F.col("s.n_cc").cast("long").alias("n_cc"), *(dp(F.col(f"s.{k}")).alias(k) for k in ("largest_cc_frac", "median_cc_patch_frac", "p90_cc_patch_frac", "small_cc_area_frac", "small_cc_share")), F.col("s.n_small_cc_patch").cast("long").alias("n_small_cc_patch"), F.col("s.n_large_cc_patch").cast("long").alias("n_large_cc_patch"))


@query("contact_ratio", O.CONTACT_RATIO)
def contact_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = shaped(spark, sf_dir).select("patch_id", F.explode(F.filter("shapes", lambda s: s["cls"] < CONVERTED)).alias("s"))
    return s.select("patch_id", F.col("s.cls").cast("long").alias("cls"), F.col("s.boundary").alias("boundary"), F.col("s.contact").alias("contact"), dp(F.when(F.col("s.boundary") > 0, F.col("s.contact") / F.col("s.boundary")).otherwise(0.0)).alias("contact_ratio"))


@query("spatial_moments", O.MOMENTS)
def spatial_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spatial(spark, sf_dir).select("patch_id", F.posexplode("spatial").alias("cls", "s")).where("s is not null")
    return s.select("patch_id", F.col("cls").cast("long").alias("cls"), *(dp(F.col(f"s.{k}")).alias(k) for k in ("centroid_y", "centroid_x", "var_x", "var_y")), F.round(F.col("s.elongation"), 3).alias("elongation"))


def grounded(spark: SparkSession, sf_dir: str, least: int = 4) -> DataFrame:
    return annotate.with_grounding(shaped(spark, sf_dir), annotate.GroundingConfig(3, least, 0.001, 0.01))


@query("grounding_boxes", O.GROUNDING_BOXES)
def grounding_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest components of converted land, in pixels and normalised."""
    g = grounded(spark, sf_dir).where("grounding.present").select("patch_id", F.posexplode(F.arrays_zip(F.col("grounding.component_px").alias("px"), F.col("grounding.component_bboxes").alias("bb"))).alias("k", "z"))
    return g.select("patch_id", (F.col("k") + 1).cast("long").alias("rank"), F.col("z.px.id").alias("comp_id"), F.col("z.px.area").alias("area"), *(dp(F.col("z.bb")[i]).alias(n) for i, n in enumerate(("nx1", "ny1", "nx2", "ny2"))))


@query("grounding_union", O.GROUNDING_UNION)
def grounding_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.col("grounding")
    return grounded(spark, sf_dir).select("patch_id", g["pixel_count"].alias("pixel_count"), g["n_components"].alias("n_components"), g["kept_components"].alias("kept_components"), g["present"].alias("present"), *(dp(g["union_bbox"][i]).alias(n) for i, n in enumerate(("nx1", "ny1", "nx2", "ny2"))))


@query("grounding_writeback", O.WRITEBACK)
def grounding_writeback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fresh answers beside older ones that a third of the records have."""
    answers = grounded(spark, sf_dir).select("patch_id", F.col("grounding.pixel_count").cast("long").alias("answer")).where("answer > 0")
    old = counted(spark, sf_dir).select("patch_id", F.when(F.col("patch_id") % 3 == 0, F.lit(-1).cast("long")).alias("answer"))
    over = annotate.write_back(old, answers, "patch_id", "answer").withColumnRenamed("answer", "overwritten")
    keep = annotate.write_back(old, answers, "patch_id", "answer", overwrite=False).select(F.col("patch_id").alias("p"), F.col("answer").alias("kept"))
    return over.join(keep, F.col("patch_id") == F.col("p")).select("patch_id", "overwritten", "kept")


@query("writeback_repeats", O.WRITEBACK_REPEATS)
def writeback_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three answers for a record, in no order; the last by position counts."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("patch_id"))
    answers = e.select("patch_id", F.explode(F.slice(F.array(F.lit(3), F.lit(1), F.lit(2)), 1, 3)).alias("pos")).where("pos <= patch_id % 4").withColumn("answer", F.col("patch_id") * 10 + F.col("pos"))
    return annotate.write_back(e.withColumn("answer", F.lit(-1).cast("long")), answers, "patch_id", "answer", position="pos")


@query("entropy_mixture", O.ENTROPY)
def entropy_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = counted(spark, sf_dir)
    h = X.entropy(F.col("fracs"))
    return c.select("patch_id", dp(h).alias("entropy"), X.mixture_sentence(F.array_max("fracs"), h).alias("mixture"))


@query("secondary_classes", O.SECONDARY)
def secondary_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = counted(spark, sf_dir).where("valid > 0").withColumn("o", K.ranked(F.col("counts")))
    s = annotate.secondary(F.col("fracs"), F.col("o"))
    return c.select("patch_id", F.array_join(F.transform("o", lambda k: k.cast("string")), ",").alias("class_order"), F.array_join(F.transform(s, K.class_name), ",").alias("secondary"), X.percent(F.array_max("fracs")).alias("percent"))


def captioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate.with_caption(spatial(spark, sf_dir).where("valid > 0"))


@query("spatial_phrases", O.PHRASES)
def spatial_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = captioned(spark, sf_dir).select("patch_id", F.posexplode("phrases").alias("cls", "phrase")).where("phrase is not null")
    return p.select("patch_id", F.col("cls").cast("long").alias("cls"), "phrase")


@query("captions", O.CAPTIONS)
def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captioned(spark, sf_dir).select("patch_id", F.col("caption.answer").alias("caption"))


@query("vqa_presence", O.VQA)
def vqa_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = counted(spark, sf_dir).select("patch_id", F.posexplode(annotate.presence(F.col("fracs"))).alias("cls", "q"))
    return q.select("patch_id", F.col("cls").cast("long").alias("cls"), F.col("q.question").alias("question"), F.col("q.answer").alias("answer"))


@query("index_records", O.INDEX_RECORDS)
def index_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated records with their patches, as the index keeps them."""
    r = index(P.from_vectors(spark, sf_dir), RegionConfig())
    return r.select("patch_id", "region", F.col("year").cast("long").alias("year"), dp(F.col("label_valid_fraction")).alias("label_valid_fraction"), "dominant_class", F.col("class_counts")["water"].alias("n_water"), dp(F.col("class_fractions")["water"]).alias("frac_water"), F.col("grounding_converted.answer.present").alias("present"), F.size("qa.vqa_presence").cast("long").alias("n_questions"))


@query("index_dedupe_last", O.DEDUPE_LAST)
def index_dedupe_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.when(F.col("user_id") % 11 == 0, "").otherwise(F.concat(F.lit("p"), F.col("user_id") % 300)).alias("patch_id"), F.col("event_id").alias("pos"), dp(F.col("value")).alias("value"))
    return catalog.last_record(e)


@query("patch_id_match", O.ID_MATCH)
def patch_id_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    ids = o.select(F.when(F.col("o_orderkey") % 17 == 0, "").when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("root/p"), F.col("o_custkey"))).otherwise(F.concat(F.lit("p"), F.col("o_custkey"))).alias("patch_id"))
    targets = table(spark, sf_dir, "customer").where("c_custkey % 5 = 0").select(F.concat(F.lit("p"), F.col("c_custkey")))
    return catalog.matches(ids, targets)


@query("region_discovery", O.REGIONS)
def region_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    names = n.select(F.concat(F.lower("n_name"), F.when(F.col("n_nationkey") % 3 == 0, "_s2_2020_original").when(F.col("n_nationkey") % 3 == 1, "_s2_x_s2_2021_original").otherwise("_s2_2020")).alias("name"))
    return catalog.regions(names.union(names))


@query("scene_paths", O.SCENE_PATHS)
def scene_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one scene image of a year by region, and where its labels lie."""
    r = table(spark, sf_dir, "region")
    files = r.select(F.lower("r_name").alias("region"), F.explode(F.array(F.concat(F.lit("S2_RGBNIR_2020_"), F.lower("r_name"), F.lit("_scene.tif")), F.lit("S2_RGBNIR_2021_x.tif"), F.lit("MapBiomas_2020.tif"))).alias("name"))
    found = catalog.scene_file(files, 2020)
    return found.select("region", "path", *(c.alias(k) for k, c in catalog.label_paths(F.col("region"), 2020).items()))


@query("label_fallback", O.LABEL_FALLBACK)
def label_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("patch_id"))
    of = lambda k, n: p.where(F.col("patch_id") % k == 0).select("patch_id", F.concat(F.col("patch_id"), F.lit(n)).alias("path"))
    return catalog.first_label(p, of(5, "/named.tif"), of(3, "/five.tif"), of(2, "/label.tif"))


@query("skip_existing", O.SKIP_EXISTING)
def skip_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("patch_id"))
    return catalog.pending(p, p.where("patch_id % 4 = 1")).groupBy("status").agg(F.count("*").alias("patches"))


@query("json_transform", O.JSON_TRANSFORM)
def json_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records parsed with broken ones counted, mapped and written as JSON text."""
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 50 == 0, "{broken").otherwise(F.col("props")).alias("props"))
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select("event_id", F.when(k.isNotNull(), F.to_json(F.struct((k * 2).alias("k")))).alias("record"), k.isNull().alias("error"))


@query("component_rotation", O.COMPONENT_ROTATION)
def component_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components by class over patches and all their turns: a turn changes none."""
    a = stats.with_classes(raster.augment(P.from_vectors(spark, sf_dir))).select("patch_id", "angle", "h", "w", "cls")
    s = with_shapes(a).select("angle", F.explode(F.filter("shapes", lambda s: s["cls"] < CONVERTED)).alias("s"))
    return s.groupBy(F.col("angle").cast("long").alias("angle"), F.col("s.cls").cast("long").alias("cls")).agg(F.sum(F.size("s.comps")).cast("long").alias("components"), F.sum("s.n").cast("long").alias("pixels"))
