"""Benchmark decontamination; DataFrame functions only.

Benchmark items become the set of their windows of ten consecutive words (of all words, if an item
has fewer), normalised, each as a 64-bit hash. Documents are scanned once: a text is normalised and
cut into words, each of its windows is hashed, and the hashes probe the broadcast set. Only ids,
places and word counts leave the scan. Hits are then verified word by word inside the rows of the
documents that have any. A document's hit words are the union of its verified windows.

The set of hashes is broadcast only while it is small: its size is counted first, and beyond
MAX_BROADCAST_WINDOWS the same join runs as a shuffle join that Spark splits where it is skewed. So
it is with the list of hits, of at most MAX_BROADCAST_HITS.

Defined cases: null text has no words; an item with fewer words than a window is one window, an
item without words none; null item ids are never listed but their windows count; equal windows
of several items list each item; repeated document rows have the same result each; an empty
benchmark leaves all documents clean; other columns are not read, and clean() keeps them under
any name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, materialise, read, row_key

#: Words are what stands between ASCII characters other than letters and digits.
BETWEEN = "".join(chr(c) for c in range(1, 128) if not chr(c).isalnum())
WINDOW = 10
#: 8 bytes each, about 40 MB as a hashed relation.
MAX_BROADCAST_WINDOWS = 2_000_000
#: Some 50 bytes each.
MAX_BROADCAST_HITS = 500_000


def words_of(text: Column) -> Column:
    """Words with A-Z lower-cased; none for null."""
    plain = F.replace(F.translate(text, UPPER + BETWEEN, LOWER + " " * len(BETWEEN)), F.lit("\0"), F.lit(" "))
    return F.coalesce(F.array_remove(F.split(plain, " "), ""), F.array().cast("array<string>"))


def windows(benchmark: DataFrame, n: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row a distinct window and item: item_id, w (its words), h (its hash)."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item_id"), words_of(F.col(text_col)).alias("ws")).where(F.size("ws") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("ws") - (n - 1)))
    cut = items.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("ws", s, n))).alias("w")).distinct()
    return cut.withColumn("h", F.xxhash64("w"))


def hashes(ws: Column, length: int) -> Column:
    """The hashes of all windows of that length, by their start."""
    none = F.array().cast("array<bigint>")
    return F.when(F.size(ws) >= length, F.transform(F.sequence(F.lit(1), F.size(ws) - (length - 1)), lambda s: F.xxhash64(F.slice(ws, s, length)))).otherwise(none)


def scan(docs: DataFrame, found: DataFrame, lengths: list[int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, k1, k2 (the row's key), nth, h: a row with nth = 0 a document, where h is its number of words,
    and a row for each window whose hash is in found; nth counts windows by length, then by start."""
    few = found.select(F.col("h").alias("want")).distinct()
    if found.count() <= MAX_BROADCAST_WINDOWS:
        few = F.broadcast(few)
    ws = docs.select(F.col(id_col).alias("doc_id"), *row_key(id_col, text_col), words_of(F.col(text_col)).alias("ws"))
    all_ = F.concat(F.array(F.size("ws").cast("long")), *(hashes(F.col("ws"), n) for n in lengths))
    rows = ws.select("doc_id", "k1", "k2", F.posexplode(all_).alias("nth", "h"))
    return rows.join(few, (F.col("h") == F.col("want")) & (F.col("nth") > 0), "left").where("nth = 0 or want is not null").drop("want")


def hits(docs: DataFrame, scanned: DataFrame, found: DataFrame, lengths: list[int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """k1, k2, item_id, start (0-based word), length of each occurrence of a window, verified."""
    some = scanned.where("nth > 0").groupBy("k1", "k2").agg(F.collect_set(F.struct("nth", "h")).alias("maybe"))
    if scanned.where("nth > 0").count() <= MAX_BROADCAST_HITS:
        some = F.broadcast(some)
    texts = docs.select(*row_key(id_col, text_col), F.col(text_col).alias("raw")).join(some, ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    texts = texts.withColumn("ws", words_of(F.col("raw")))
    # nth counts from 1 over the windows of the first length, then the second and so on
    count = [F.greatest(F.lit(0), F.size("ws") - n + 1) for n in lengths]
    before = [reduce(lambda x, y: x + y, count[:k], F.lit(0)) for k in range(len(lengths))]

    def place(c: Column) -> Column:
        start, length = c["nth"] - 1, F.lit(lengths[0])
        for k in range(1, len(lengths)):
            later = c["nth"] > before[k]
            start, length = F.when(later, c["nth"] - 1 - before[k]).otherwise(start), F.when(later, F.lit(lengths[k])).otherwise(length)
        return F.struct(c["h"].alias("h"), start.cast("long").alias("start"), length.cast("long").alias("length"), F.slice("ws", (start + 1).cast("int"), length).alias("own"))

    each = texts.select("k1", "k2", F.explode(F.transform("maybe", place)).alias("p")).select("k1", "k2", "p.*")
    return each.join(found, "h").where("own = w").select("k1", "k2", "item_id", "start", "length")


def search(docs: DataFrame, benchmark: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The scan's rows of documents (doc_id, k1, k2, n_words), and the verified hits."""
    found = materialise(windows(benchmark, n))
    lengths = sorted((r[0] for r in found.select(F.size("w")).distinct().collect()), reverse=True) or [n]  # n at most
    scanned = materialise(scan(docs, found, lengths, id_col, text_col))
    return scanned.where("nth = 0").select("doc_id", "k1", "k2", F.col("h").alias("n_words")), hits(docs, scanned, found, lengths, id_col, text_col)


def report(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    base, found = search(docs, benchmark, n, id_col, text_col)
    found = materialise(found)
    spans = found.groupBy("k1", "k2", "start").agg(F.max("length").alias("length"))
    seen = Window.partitionBy("k1", "k2").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("upto", F.coalesce(F.max(F.col("start") + F.col("length")).over(seen), F.lit(0)))
    covered = spans.groupBy("k1", "k2").agg(F.sum(F.greatest(F.lit(0), F.col("start") + F.col("length") - F.greatest("start", "upto"))).alias("n_hit"))
    items = found.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    per = covered.join(items, ["k1", "k2"])
    listed = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return base.join(per, ["k1", "k2"], "left").select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that hold a window of the benchmark."""
    bad = materialise(search(docs, benchmark, n, id_col, text_col)[1].select("k1", "k2").distinct())
    if bad.count() <= MAX_BROADCAST_HITS:
        bad = F.broadcast(bad)
    k1, k2 = row_key(id_col, text_col)
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), k1, k2)
    return held.join(bad, ["k1", "k2"], "left_anti").select("row.*")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rk,
             coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, ws[s : s + 9] AS w FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS s FROM b WHERE len(ws) > 0)),
tok AS (SELECT rk, ws, unnest(range(1, len(ws) + 1)) AS s FROM d),
m AS (SELECT rk, item_id, s, len(w) AS n FROM tok JOIN bw ON ws[s] = w[1] AND ws[s : s + len(w) - 1] = w),
cov AS (SELECT rk, count(DISTINCT p) AS n_hit FROM (SELECT rk, unnest(range(s, s + n)) AS p FROM m) GROUP BY rk),
it AS (SELECT rk, list_sort(list_distinct(list(item_id::VARCHAR))) AS items FROM m GROUP BY rk)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (rk) LEFT JOIN it USING (rk)
"""
