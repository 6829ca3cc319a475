"""Class statistics of patches. Everything about one patch is computed inside its row; only reports
over many patches shuffle, and those combine before they do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classes as K
from .components import with_shapes

MIN_VALID_FRAC = 0.80


def with_classes(patches: DataFrame) -> DataFrame:
    """patches plus cls: the code array reclassified."""
    return patches.withColumn("cls", F.transform("code", K.reclassify))


def with_counts(patches: DataFrame) -> DataFrame:
    """plus counts (five classes), valid, total, valid_frac, fracs, dominant_class."""
    out = patches.withColumn("counts", K.class_counts(F.col("cls")))
    out = out.withColumn("valid", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).withColumn("total", F.size("cls").cast("long"))
    return out.withColumn("valid_frac", F.when(F.col("total") > 0, F.col("valid") / F.col("total")).otherwise(0.0)).withColumn("fracs", K.fractions(F.col("counts"))).withColumn("dominant_class", K.dominant(F.col("counts")))


def kept(patches: DataFrame, min_valid_frac: float = MIN_VALID_FRAC) -> DataFrame:
    return patches.where(F.col("valid_frac") >= min_valid_frac)


def histogram(patches: DataFrame) -> DataFrame:
    """cls, pixels, pct over all patches, the ignored class included, zero-filled."""
    dim = patches.sparkSession.createDataFrame([(k,) for k in (*range(len(K.CLASS_NAMES)), K.IGNORE)], "cls int")
    per = F.array(*(F.struct(F.lit(k).alias("cls"), F.col("counts")[k].alias("n")) for k in range(len(K.CLASS_NAMES))), F.struct(F.lit(K.IGNORE).alias("cls"), (F.col("total") - F.col("valid")).alias("n")))
    sums = patches.select(F.explode(per).alias("e")).groupBy("e.cls").agg(F.sum("e.n").alias("pixels"))
    every = sums.agg(F.sum("pixels").alias("all"))
    return F.broadcast(dim).join(sums, "cls", "left").crossJoin(F.broadcast(every)).select("cls", F.coalesce("pixels", F.lit(0)).cast("long").alias("pixels"), F.when(F.col("all") > 0, F.coalesce("pixels", F.lit(0)) * 100 / F.col("all")).otherwise(0.0).alias("pct"))


def report(patches: DataFrame, min_valid_frac: float = MIN_VALID_FRAC) -> DataFrame:
    """status (kept, dropped, all), class_name, pixels, pct of the status."""
    status = F.when(F.col("valid_frac") >= min_valid_frac, "kept").otherwise("dropped")
    named = F.array(*(F.struct(F.lit(name).alias("class_name"), F.col("counts")[k].alias("n")) for k, name in enumerate(K.CLASS_NAMES)))
    both = patches.select(F.explode(F.array(status, F.lit("all"))).alias("status"), named.alias("named")).select("status", F.explode("named").alias("e"))
    sums = both.groupBy("status", "e.class_name").agg(F.sum("e.n").alias("pixels"))
    per = sums.groupBy("status").agg(F.sum("pixels").alias("of"))
    return sums.join(F.broadcast(per), "status").select("status", "class_name", "pixels", F.when(F.col("of") > 0, F.col("pixels") * 100 / F.col("of")).otherwise(0.0).alias("pct"))


def percentile(sorted_values: Column, q: float) -> Column:
    """Linear interpolation in a sorted array."""
    pos = (F.size(sorted_values) - 1) * F.lit(q)
    lo = F.floor(pos)
    at = lambda k: F.element_at(sorted_values, (k + 1).cast("int"))
    return at(lo) + (at(F.ceil(pos)) - at(lo)) * (pos - lo)


def spatial_stats(s: Column, valid: Column, h: Column, w: Column) -> Column:
    """The fifteen statistics of a class's shape record with its sorted areas. Integer sums become doubles in one closed form."""
    n, areas = s["n"], s["areas"]
    count = F.size(areas)
    base = F.greatest(valid, F.lit(1))
    shares = F.transform(areas, lambda a: a / base)
    small = F.filter(areas, lambda a: (a <= 32) | (a / base < 0.002))
    large = F.filter(areas, lambda a: (a / base >= 0.02) | (a >= n * 0.10))
    sx, sy = F.greatest(w - 1, F.lit(1)), F.greatest(h - 1, F.lit(1))
    vx = (n * s["sxx"] - s["sx"] * s["sx"]) / (n * n).cast("double") / (sx * sx)
    vy = (n * s["syy"] - s["sy"] * s["sy"]) / (n * n).cast("double") / (sy * sy)
    cov = (n * s["sxy"] - s["sx"] * s["sy"]) / (n * n).cast("double") / (sx * sy)
    trace = vx + vy
    det = F.greatest(vx * vy - cov * cov, F.lit(0.0))
    root = F.sqrt(F.greatest(trace * trace - det * 4.0, F.lit(0.0)))
    elongation = F.sqrt(((trace + root) / 2) / F.greatest((trace - root) / 2, F.lit(1e-12)))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    return F.when(n > 0, F.struct(
        n.alias("pixel_count"), count.alias("n_cc"), (F.array_max(areas) / n).alias("largest_cc_frac"), percentile(shares, 0.5).alias("median_cc_patch_frac"), percentile(shares, 0.9).alias("p90_cc_patch_frac"),
        (total(small) / n).alias("small_cc_area_frac"), (F.size(small) / count).alias("small_cc_share"), F.size(small).alias("n_small_cc_patch"), F.size(large).alias("n_large_cc_patch"),
        (s["sy"] / n / sy).alias("centroid_y"), (s["sx"] / n / sx).alias("centroid_x"), vx.alias("var_x"), vy.alias("var_y"), elongation.alias("elongation"),
        F.when(s["boundary"] > 0, s["contact"] / s["boundary"]).otherwise(0.0).alias("contact_ratio"),
    ))


def with_spatial(patches: DataFrame) -> DataFrame:
    """patches with counts plus shapes and spatial: an array of statistics by class, null for absent ones."""
    shaped = with_shapes(patches)
    fields = ("n", "sx", "sy", "sxx", "syy", "sxy", "boundary", "contact")
    sized = F.transform(F.slice("shapes", 1, len(K.CLASS_NAMES)), lambda s: F.when(s.isNotNull(), F.struct(*(s[k].alias(k) for k in fields), F.array_sort(F.transform(s["comps"], lambda x: x["area"])).alias("areas"))))
    return shaped.withColumn("__sized", sized).withColumn("spatial", F.transform("__sized", lambda s: spatial_stats(s, F.col("valid"), F.col("h"), F.col("w")))).drop("__sized")


def summary_json(patches: DataFrame) -> DataFrame:
    """One JSON text: class ids, code map and pixel counts of the classes present."""
    counts = patches.select(F.posexplode("counts").alias("cls", "n")).groupBy("cls").agg(F.sum("n").alias("n")).where("n > 0")
    listed = counts.agg(F.array_sort(F.collect_list(F.struct("cls", "n"))).alias("c"))
    code_map = F.lit(", ".join(f'"{c}": {k}' for k, codes in K.CODES_BY_CLASS.items() for c in codes))
    body = F.array_join(F.transform("c", lambda x: F.concat(F.lit('"'), x["cls"].cast("string"), F.lit('": '), x["n"].cast("string"))), ", ")
    return listed.select(F.concat(F.lit('{"ignore_value": 255, "class_ids": [0, 1, 2, 3, 4], "code_map": {'), code_map, F.lit('}, "global_counts": {'), body, F.lit("}}")).alias("summary"))
