"""Expressions that word numbers: percents, lists, phrases of shape and place, captions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(frac: Column) -> Column:
    """Whole percents, halves to even."""
    return F.rint(frac * 100).cast("int").cast("string")


def capitalize(s: Column) -> Column:
    return F.concat(F.upper(F.left(s, F.lit(1))), F.lower(F.substring(s, 2, 1 << 30)))


def verb(label: Column) -> Column:
    return F.when(label.endswith("areas"), "are").otherwise("is")


def list_text(items: Column) -> Column:
    """a / a and b / a, b, and c."""
    n = F.size(items)
    head = F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(0))), ", ")
    return F.when(n <= 1, F.coalesce(F.try_element_at(items, F.lit(1)), F.lit(""))).when(n == 2, F.array_join(items, " and ")).otherwise(F.concat(head, F.lit(", and "), F.element_at(items, -1)))


def entropy(fracs: Column) -> Column:
    """Normalised to [0, 1] by the number of classes; 0 for no pixels."""
    h = F.aggregate(fracs, F.lit(0.0), lambda a, v: a - F.when(v > 0, v * F.ln(v)).otherwise(0.0))
    return h / F.ln(F.size(fracs).cast("double"))


def location(cx: Column, cy: Column) -> Column:
    """Where a centroid lies, by thirds; null in the middle."""
    horiz = F.when(cx <= 0.33, "left").when(cx >= 0.67, "right")
    vert = F.when(cy <= 0.33, "upper").when(cy >= 0.67, "lower")
    return F.when(horiz.isNotNull() & vert.isNotNull(), F.concat(F.lit("mostly in the "), vert, F.lit("-"), horiz)).when(horiz.isNotNull(), F.concat(F.lit("mostly on the "), horiz, F.lit(" side"))).when(vert.isNotNull(), F.concat(F.lit("mostly in the "), vert, F.lit(" part")))


def structure(s: Column) -> Column:
    """The first rule that fits the components of a class; s has the fields of spatial statistics."""
    n, most, touch = s["n_cc"], s["largest_cc_frac"], s["contact_ratio"]
    counted = F.concat(F.lit("in "), n.cast("string"), F.lit(" regions"))
    scattered = F.concat(F.lit("scattered "), counted)
    few = n <= 5
    specks = (n >= 6) & (s["median_cc_patch_frac"] <= 0.0015) & (s["p90_cc_patch_frac"] <= 0.01)
    small = ((n >= 8) & (s["small_cc_share"] >= 0.70)) | ((s["small_cc_area_frac"] >= 0.55) & (s["n_large_cc_patch"] == 0))
    return (
        F.when((most >= 0.95) & (touch < 0.40), "a single contiguous region")
        .when((most >= 0.85) & few & (touch >= 0.55), "a main region interwoven with other classes")
        .when((most >= 0.85) & few, "a single main block")
        .when((most >= 0.60) & (n <= 8), F.when(few, counted).otherwise("a few clustered regions"))
        .when(specks | small, F.when(few, scattered).otherwise("scattered in small regions"))
        .when(n >= 10, "scattered in many regions")
        .when(n >= 5, F.when(few, scattered).otherwise("scattered in multiple regions"))
        .otherwise(counted)
    )


def spatial_phrase(s: Column, dom_frac: Column) -> Column:
    """Structure, shape, place and intermixing; dom_frac is null but for the dominant class."""
    spread = s["var_x"] + s["var_y"]
    shape = F.when(s["elongation"] >= 3.0, "forming a linear band").when((s["elongation"] <= 1.5) & (spread <= 0.02), "compact")
    concentrated = (s["largest_cc_frac"] >= 0.60) | (spread <= 0.05) | (s["n_cc"] <= 3)
    mixed = F.when((dom_frac < 0.75) & (s["contact_ratio"] >= 0.55), "with substantial intermixing")
    return F.when(s["pixel_count"] > 0, F.concat_ws(", ", structure(s), shape, F.when(concentrated, location(s["centroid_x"], s["centroid_y"])), mixed))


def mixture_sentence(dom_frac: Column, h: Column) -> Column:
    return F.when((dom_frac >= 0.90) & (h <= 0.15), "Land cover is highly homogeneous.").when(h >= 0.65, "Land cover is highly mixed across classes.").when(h >= 0.45, "Land cover is moderately mixed.").otherwise("Land cover is slightly mixed.")
