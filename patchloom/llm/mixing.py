"""Mixing sources to target weights by Efraimidis-Spirakis sampling; DataFrame functions only.

Each source has a target in words. Complete epochs of a source come first; the rest of its
target is a fraction of one more epoch: documents ordered by an exponential key -ln(u) / w
(u uniform from a hash of the id and a seed, w the document's quality weight) and taken by the
prefix sum of their sizes until the target is met. The last of them is taken in part, so a
source's words equal its target rounded down.

The order inside a source is never sorted in one task: keys fall into cells of equal width in ln(key),
cells are counted, and those with many rows are cut into as many equal buckets as it takes, which
are even as a cell is narrow, whatever the weights. Sizes are summed by cell and by bucket, and only
rows of one bucket are sorted together. So a source that holds a third of all rows is spread over
all tasks; no task has more of a source than its CELLS sums or a cell's sums.

Defined cases: null text has size 0 and is taken 0 times; a null source is a source, the last
in order; null or non-positive weights count as 1; repeated rows tie and are ordered by size;
empty input gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE_WORD, materialise, read

#: Rows that a bucket of a source holds at most on average.
BUCKET_ROWS = 2_000
#: Cells of ln(key), CELL_STEP a unit, from -LOG_LEAST on.
CELLS, CELL_STEP, LOG_LEAST = 16_384, 164, 60


def uniform(id_col: Column, seed: str = "mix") -> Column:
    """In (0, 1), the same for an id in every run: 52 bits of an MD5 digest."""
    digits = F.substring(F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(f"/{seed}"))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(2**52)


def targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = (3.0, 1.0, 2.0)) -> DataFrame:
    """sizes: source, source_size; returns with target. Weights repeat over the sources by code
    point, null last. target = min(cap * size, level * weight), the level at which targets sum
    to share * all sizes: what resharing the excess by weight ends in. One row a source."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    nth = (F.row_number().over(by_name) - 1) % len(weights)
    w = F.element_at(F.array(*map(F.lit, weights)), (nth + 1).cast("int"))
    most = F.col("source_size") * F.lit(cap)
    ranked = sizes.withColumn("w", w).withColumn("most", most)
    upto = Window.orderBy(F.col("most") / F.col("w"), F.col("source").isNull(), "source")
    every = Window.partitionBy()
    # Sources fill up in the order of most / w. With the first k - 1 full, the level is what is left over the
    # weights left; it rises with k while that level would overfill the k-th source, and falls after.
    ranked = ranked.withColumn("filled", F.coalesce(F.sum("most").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    ranked = ranked.withColumn("open_w", F.sum("w").over(upto.rowsBetween(0, Window.unboundedFollowing)))
    ranked = ranked.withColumn("level", (F.sum("source_size").over(every) * F.lit(share) - F.col("filled")) / F.col("open_w"))
    level = F.max("level").over(every)
    return ranked.select(*sizes.columns, F.coalesce(F.least("most", level * F.col("w")), F.col("most"), F.lit(0.0)).alias("target"))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: DataFrame | None = None, seed: str = "mix") -> DataFrame:
    """name (the source, a null one as well), doc_id, source, size, key, place (of the key, in cells), cell."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(SPACE_WORD)), F.lit(0)).cast("long")
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"))  # no text beyond here
    w = F.lit(1.0)
    if weights is not None:
        sized = sized.join(weights, F.col("doc_id") == F.col("labelled"), "left")
        w = F.coalesce(F.when(F.col("weight") > 0, F.col("weight").cast("double")), w)
    name = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("name")
    sized = sized.select(name, "doc_id", "source", "size", (-F.log(uniform(F.col("doc_id"), seed)) / w).alias("key"))
    place = F.least(F.lit(CELLS - 1e-6), F.greatest(F.lit(0.0), (F.log("key") + LOG_LEAST) * CELL_STEP))
    return materialise(sized.withColumn("place", place).withColumn("cell", F.floor("place").cast("int")))


def bucketed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows with bucket and before_cell (the sizes in earlier cells of the source); and name, source, source_size."""
    cells = materialise(rows.groupBy("name", "source", "cell").agg(F.sum("size").alias("in_cell"), F.count("*").alias("n")))
    by_cell = Window.partitionBy("name").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("in_cell").over(by_cell), F.lit(0)).alias("before_cell")
    cut = cells.select("name", "cell", before, F.ceil(F.col("n") / BUCKET_ROWS).alias("buckets"))
    rows = rows.join(cut, ["name", "cell"]).withColumn("bucket", F.floor((F.col("place") - F.col("cell")) * F.col("buckets")))
    return rows, cells.groupBy("name", "source").agg(F.sum("in_cell").alias("source_size"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: DataFrame | None = None, share: float = 1.5, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target, key, taken. weights: labelled (an id, once), weight."""
    rows, sources = bucketed(keyed(docs, id_col, text_col, source_col, weights, seed))
    goals = targets(sources, share).drop("source")
    goals = goals.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    goals = materialise(goals.withColumn("rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size"))))
    sums = rows.groupBy("name", "cell", "bucket").agg(F.sum("size").alias("in_bucket"))
    by_bucket = Window.partitionBy("name", "cell").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("name", "cell", "bucket", F.coalesce(F.sum("in_bucket").over(by_bucket), F.lit(0)).alias("before_bucket"))
    rows = rows.join(sums, ["name", "cell", "bucket"]).join(goals, "name")
    inside = Window.partitionBy("name", "cell", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before_cell") + F.col("before_bucket") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - start))
    return rows.select("doc_id", "source", "size", "source_size", "target", "key", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))


def quality_weights(labels: DataFrame) -> DataFrame:
    """labelled, weight: 2 for good, 0.5 for bad, 1 for a null label; rows without a label weigh 1. A
    document that is labelled more than once has its best label."""
    best = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("labelled")).agg(F.max("quality").alias("q"))
    return best.select("labelled", F.when(F.col("q") == 1, 2.0).when(F.col("q") == 0, 0.5).otherwise(1.0).alias("weight"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(read(spark, sf_dir, "documents"), weights=quality_weights(read(spark, sf_dir, "labels")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = r"""
WITH best AS (SELECT doc_id AS labelled, max(quality) AS q FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
sized AS (
  SELECT d.doc_id, d.source,
         coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         -ln((('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '') || '/mix'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
           / CASE WHEN q = 1 THEN 2.0 WHEN q = 0 THEN 0.5 ELSE 1.0 END AS k
  FROM documents d LEFT JOIN best ON d.doc_id = labelled),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][1 + ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3)::INT]::DOUBLE AS w,
             (source_size * 2)::DOUBLE AS most FROM per),
f AS (SELECT *, coalesce(sum(most) OVER (ORDER BY most / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
             sum(w) OVER (ORDER BY most / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w,
             sum(source_size) OVER () * 1.5::DOUBLE AS total FROM w),
l AS (SELECT *, (total - filled) / open_w AS lev FROM f),
t AS (SELECT source, source_size, least(most, (max(lev) OVER ()) * w) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
r AS (SELECT s.doc_id, s.size, e.source_size, e.target, e.epochs, floor(e.target - e.epochs * e.source_size) AS rest,
             coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM sized s JOIN e ON s.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - start)))::BIGINT AS taken FROM r
"""
