"""op9 against its SQL, and its defined cases."""

import duckdb
import pytest
from pyspark.sql import functions as F

from patchloom.llm import mixing

from .util import SF, frame, same_rows

DOCS = "doc_id long, text string, source string, clash int"


@pytest.mark.parametrize("rows", [mixing.BUCKET_ROWS, 3])
def test_query_equals_sql(spark, monkeypatch, rows):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", rows)
    same_rows(mixing.op9_mixing(spark, SF), mixing.OP9_SQL)


def test_targets_reshare_excess(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 300), (None, 90)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    total = 1.5 * 1400
    assert got["a"] == 20 and got[None] == 180  # capped at twice their size
    assert abs(sum(got.values()) - total) < 1e-6
    assert got["b"] <= 2000 and got["c"] <= 600


@pytest.mark.parametrize("rows", [[], [(None, None, None, 1), (1, "", "s", 1), (1, "", "s", 1)]])
def test_empty_and_null(spark, rows):
    got = mixing.mix(frame(spark, rows, DOCS)).collect()
    assert len(got) == len(rows) and all(r["taken"] == 0 and r["size"] == 0 for r in got)


def test_words_come_to_the_target_and_reruns_agree(spark):
    rows = [(i, "w " * (i % 37), f"s{i % 3}" if i % 4 else None, 0) for i in range(400)]
    one = mixing.mix(frame(spark, rows, DOCS))
    got = one.collect()
    for r in one.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g")).collect():
        assert r["t"] == int(r["g"] + 1e-9)
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(frame(spark, rows[::-1], DOCS).repartition(7)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}


@pytest.mark.parametrize("weight", [1e-6, 0.5, 1.0, 40.0])
def test_buckets_are_even_at_any_weight(spark, monkeypatch, weight):
    """Of one source, as many rows as it takes to cut cells."""
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 20)
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.lit("s").alias("source"))
    weights = spark.range(60_000).select(F.col("id").alias("labelled"), F.lit(weight).alias("weight"))
    rows = mixing.bucketed(mixing.keyed(docs, weights=weights))[0]
    sizes = [r["count"] for r in rows.groupBy("cell", "bucket").count().collect()]
    assert sum(sizes) == 60_000 and max(sizes) <= 60
