"""The land-cover class dictionary and expressions over class arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class names by id, the code of pixels to ignore, and source codes by class id.
CLASS_NAMES = ("forest", "pasture", "agriculture", "water", "urban")
IGNORE = 255
CODES_BY_CLASS = {0: (3, 5, 6, 49), 1: (15,), 2: (18, 19, 39, 40, 41), 3: (33,), 4: (24,)}
CONVERTED = (1, 2)


def reclassify(code: Column) -> Column:
    """A source code to its class id; codes without one, and null, to IGNORE."""
    out = F.lit(IGNORE)
    for cls, codes in CODES_BY_CLASS.items():
        out = F.when(code.isin(*codes), cls).otherwise(out)
    return out


def class_counts(cls: Column) -> Column:
    """Zero-filled pixel counts of the five classes, in id order, without exploding the array."""

    def count(k: int) -> Column:  # Spark gives a lambda's second argument the index, so k is bound here
        return F.size(F.filter(cls, lambda x: x == k)).cast("long")

    return F.array(*map(count, range(len(CLASS_NAMES))))


def class_name(cls: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, CLASS_NAMES)), cls + 1)


def dominant(counts: Column) -> Column:
    """Name of the class with most pixels, the lowest id of equals; "none" without any."""
    return F.when(F.array_max(counts) > 0, class_name(F.array_position(counts, F.array_max(counts)).cast("int") - 1)).otherwise("none")


def ranked(counts: Column) -> Column:
    """Class ids by falling count, ids of equals rising."""
    pairs = F.transform(counts, lambda n, i: F.struct((-n).alias("n"), i.cast("int").alias("cls")))
    return F.transform(F.array_sort(pairs), lambda x: x["cls"])


def fractions(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.transform(counts, lambda n: F.when(total > 0, n / total).otherwise(0.0))
