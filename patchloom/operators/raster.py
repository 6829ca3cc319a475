"""Rasters as pixel tables and block arrays: tiling, alignment, rotation, rasterising, attaching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G

MAX_EMPTY_FRACTION = 0.95
ANGLES = (90, 180, 270)


def tile_origins(r: Column, c: Column, h: int, w: int, size: int, stride: int) -> Column:
    """Origins (row, col) of the windows that hold a pixel; windows that would pass the edge do not
    exist. Neighbouring windows overlap if stride < size and leave gaps if stride > size."""

    def along(v: Column, n: int) -> Column:
        last = (n - size) // stride
        first = F.greatest(F.lit(0), F.ceil((v - size + 1) / stride)).cast("int")
        upto = F.least(F.lit(last), F.floor(v / stride)).cast("int")
        steps = F.when(first <= upto, F.sequence(first, F.greatest(first, upto))).otherwise(F.array().cast("array<int>"))
        return F.transform(steps, lambda k: k * stride)

    return F.flatten(F.transform(along(r, h), lambda y: F.transform(along(c, w), lambda x: F.struct(y.alias("row"), x.alias("col")))))


def tile(pixels: DataFrame, h: int, w: int, size: int = 256, stride: int = 256) -> DataFrame:
    """pixels (r, c, ...) of one scene of h by w, by window: row, col, pr, pc (place in the window), and
    the rest. Windows that do not overlap need no explode."""
    if stride == size:
        inside = pixels.where((F.col("r") < h // size * size) & (F.col("c") < w // size * size))
        out = inside.withColumn("row", (F.floor(F.col("r") / size) * size).cast("int")).withColumn("col", (F.floor(F.col("c") / size) * size).cast("int"))
    else:
        out = pixels.withColumn("__o", F.explode(tile_origins(F.col("r"), F.col("c"), h, w, size, stride)))
        out = out.withColumn("row", F.col("__o.row")).withColumn("col", F.col("__o.col")).drop("__o")
    return out.withColumn("pr", F.col("r") - F.col("row")).withColumn("pc", F.col("c") - F.col("col"))


def tile_id(stem: Column, row: Column, col: Column) -> Column:
    return F.concat(stem, F.lit("_r"), row.cast("string"), F.lit("_c"), col.cast("string"))


def valid_tiles(tiled: DataFrame, bands: list[str], nodata: Column, max_empty: float = MAX_EMPTY_FRACTION) -> DataFrame:
    """row, col, pixels, valid_fraction of windows that are not nearly empty."""
    ok = G.any_band_valid(F.array(*(F.col(b).cast("double") for b in bands)), nodata)
    return tiled.groupBy("row", "col").agg(F.count("*").alias("pixels"), F.avg(ok.cast("int")).alias("valid_fraction")).where(F.col("valid_fraction") >= 1 - max_empty)


def augment(patches: DataFrame, array_col: str | tuple[str, ...] = "code", angles: tuple[int, ...] = ANGLES, compat: bool = False) -> DataFrame:
    """patches and their turns: patch_id gets _rot{angle}, source_patch_id and angle tell where from, and
    a transform, where there is one, turns too (compat as in rotate_transform). Rows that are turns
    already are not turned again. The source is read once; turning is index arithmetic inside the row."""
    base = patches if "angle" in patches.columns else patches.withColumn("source_patch_id", F.col("patch_id").cast("string")).withColumn("angle", F.lit(0))
    turn = F.explode(F.when(F.col("angle") == 0, F.array(*map(F.lit, (0, *angles)))).otherwise(F.array(F.lit(0))))
    out = base.withColumn("patch_id", F.col("patch_id").cast("string")).withColumn("__turn", turn)

    def by_angle(same: Column, of) -> Column:  # noqa: ANN001
        for angle in angles:
            same = F.when(F.col("__turn") == angle, of(angle)).otherwise(same)
        return same

    h, w = F.col("h"), F.col("w")
    changed = {c: by_angle(F.col(c), lambda angle, c=c: G.rotate_array(angle, F.col(c), h, w)) for c in ((array_col,) if isinstance(array_col, str) else array_col)}
    if "transform" in base.columns:
        own = [F.col("transform")[k] for k in range(6)]
        changed["transform"] = by_angle(F.col("transform"), lambda angle: F.when(F.col("transform").isNotNull(), F.array(*(x.cast("double") for x in G.rotate_transform(angle, own, h, w, compat)))))
    on_side = F.col("__turn").isin(90, 270)
    changed |= {"h": F.when(on_side, w).otherwise(h), "w": F.when(on_side, h).otherwise(w)}
    changed["patch_id"] = F.when(F.col("__turn") == 0, F.col("patch_id")).otherwise(F.concat("patch_id", F.lit("_rot"), F.col("__turn").cast("string")))
    changed["angle"] = F.col("angle") + F.col("__turn")
    # under names of their own first, or lambdas would see the new h and w
    names = [c for c in out.columns if c != "__turn"]
    return out.select(*(changed.get(c, F.col(c)).alias(f"__{c}") for c in names)).select(*(F.col(f"__{c}").alias(c) for c in names))


def resample_nearest(source: DataFrame, to: DataFrame, src_t: tuple, dst_t: tuple, value: str, src_nodata: float | None = None, dst_nodata: float | None = None) -> DataFrame:
    """The source (r, c, value) on the grid of `to` (r, c): each target pixel's centre goes through both
    affine transforms to the source pixel that holds it. An equi-join on that pixel; no source pixel, or
    source nodata, becomes the target's nodata, else 0. A coordinate change between reference systems
    is a change of dst_t's expression."""
    a, b, c, d, e, f = dst_t
    sa, sb, sc, sd, se, sf = src_t
    det = sa * se - sb * sd
    if not det:
        raise ValueError("the source transform has no inverse")
    px, py = F.col("c") + 0.5, F.col("r") + 0.5
    x, y = px * a + py * b + c - sc, px * d + py * e + f - sf
    grid = to.withColumn("__c", F.floor((x * se - y * sb) / det)).withColumn("__r", F.floor((y * sa - x * sd) / det))
    own = source.select(F.col("r").alias("__sr"), F.col("c").alias("__sc"), F.col(value).alias("__v"))
    if src_nodata is not None:
        own = own.where(F.col("__v") != src_nodata)
    fill = dst_nodata if dst_nodata is not None else src_nodata if src_nodata is not None else 0
    return grid.join(own, (F.col("__r") == F.col("__sr")) & (F.col("__c") == F.col("__sc")), "left").withColumn(value, F.coalesce("__v", F.lit(fill))).drop("__r", "__c", "__sr", "__sc", "__v")


def attach(pixels: DataFrame, layers: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Left joins of single-band layers (keys, value) on one grid; a layer with two values for a pixel is an error."""
    out = pixels
    for name, layer in layers.items():
        one = layer.groupBy(*keys).agg(F.max("value").alias(name), F.count("*").alias("__n"))
        one = one.withColumn(name, F.when(F.col("__n") == 1, F.col(name)).otherwise(F.raise_error(F.concat(F.lit(f"layer {name} has bands: "), F.col("__n").cast("string"))).cast("int"))).drop("__n")
        out = out.join(one, keys, "left")
    return out


def rasterize_points(grid: DataFrame, points: DataFrame, cell: float = 1.0, value: int = 1) -> DataFrame:
    """grid (r, c) with burnt: value where a point (x, y) falls in the cell, else 0. Points are reduced
    to cells before the join."""
    cells = points.select(F.floor(F.col("y") / cell).cast("int").alias("r"), F.floor(F.col("x") / cell).cast("int").alias("c")).distinct().withColumn("__hit", F.lit(value))
    return grid.join(cells, ["r", "c"], "left").withColumn("burnt", F.coalesce("__hit", F.lit(0))).drop("__hit")


def rasterize_rings(grid: DataFrame, rings: DataFrame, value: int = 1, bin_size: int = 64) -> DataFrame:
    """grid (r, c) with burnt: value where the pixel's centre lies in a ring (xs, ys). Rings and pixels
    meet by coarse bins of the ring's box, an equi-join."""
    lo = lambda a: F.floor(F.array_min(a) / bin_size)
    hi = lambda a: F.floor(F.array_max(a) / bin_size)
    binned = rings.select("xs", "ys", F.explode(F.sequence(lo("xs"), hi("xs"))).alias("bx")).select("*", F.explode(F.sequence(lo("ys"), hi("ys"))).alias("by"))
    px = grid.select("r", "c").withColumn("bx", F.floor((F.col("c") + 0.5) / bin_size)).withColumn("by", F.floor((F.col("r") + 0.5) / bin_size))
    hit = px.join(binned, ["bx", "by"]).where(G.inside_ring(F.col("c") + 0.5, F.col("r") + 0.5, F.col("xs"), F.col("ys"))).select("r", "c").distinct().withColumn("__hit", F.lit(value))
    return grid.join(hit, ["r", "c"], "left").withColumn("burnt", F.coalesce("__hit", F.lit(0))).drop("__hit")


def cloud_free(value: Column, qa: Column) -> Column:
    """value, or null where bit 10 or 11 of the quality band is set."""
    return F.when(qa.bitwiseAND((1 << 10) | (1 << 11)) == 0, value)
