"""op4 against its SQL and a brute force on odd texts."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from patchloom.llm import decontaminate as D

from .util import SF, frame, same_rows

DOCS = "doc_id long, text string, k1 int, raw string"
ITEMS = "item_id long, text string, w string"
WORDS = "one two three four five six seven eight nine ten eleven twelve"
ROWS = [
    (1, f"x {WORDS} y", 1, ""), (2, WORDS.upper(), 1, ""), (3, WORDS.replace(" ", "--!"), 1, ""), (4, None, 1, ""), (5, "", 1, ""), (6, "one two three", 1, ""), (None, WORDS, 1, ""),
    (7, "ÉTÉ été KelvinK short item", 1, ""), (8, "ÉTÉ", 1, ""), (9, "été", 1, ""), (1, f"x {WORDS} y", 1, ""), (10, "a a a a a a a a a a a a a", 1, ""), (11, "z " * 4000 + WORDS, 1, ""),
    (12, "ΟΔΟΣ.ΑΒΓ", 1, ""), (13, "xΟΔΟΣ ΟΔΟΣ", 1, ""), (14, "İ I i ǅ straße STRASSE ﬁ", 1, ""), (15, "a\0b\x7fc three-four", 1, ""), (16, "one two three one two three", 1, ""),
]
BENCH = [(1, WORDS, ""), (2, "été", ""), (3, None, ""), (4, "!!", ""), (5, "a a a a a a a a a a", ""), (10, "one TWO three", ""), (2, "été", ""), (20, "ΟΔΟΣ", ""), (21, "İ i", ""), (22, "ı", ""), (23, "straße", ""), (24, "two three one", ""), (25, "b c", "")]


def words(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text):
    ws, hit, items = words(text), set(), set()
    for item, t, _ in BENCH:
        own = words(t)
        for w in [own[i : i + 10] for i in range(max(1, len(own) - 9))] if own else []:
            for s in range(len(ws) - len(w) + 1):
                if ws[s : s + len(w)] == w:
                    hit.update(range(s, s + len(w)))
                    items.add(str(item))
    return len(ws), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)


def test_query_equals_sql(spark):
    same_rows(D.op4_decontaminate(spark, SF), D.OP4_SQL)


@pytest.mark.parametrize("limit", [D.MAX_BROADCAST_WINDOWS, 0])
def test_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(D, "MAX_BROADCAST_WINDOWS", limit)
    monkeypatch.setattr(D, "MAX_BROADCAST_HITS", limit)
    got = sorted(map(tuple, D.report(frame(spark, ROWS, DOCS), frame(spark, BENCH, ITEMS)).collect()), key=repr)
    assert got == sorted(((r[0], *brute(r[1])) for r in ROWS), key=repr)


def test_empty_tables(spark):
    assert D.report(frame(spark, [], DOCS), frame(spark, BENCH, ITEMS)).count() == 0
    assert not any(r["contaminated"] for r in D.report(frame(spark, ROWS, DOCS), frame(spark, [], ITEMS)).collect())


def test_clean_keeps_columns_and_clean_rows(spark):
    out = D.clean(frame(spark, ROWS, DOCS).withColumn("a.b", F.lit(1)).withColumn("__k1", F.lit(2)), frame(spark, BENCH, ITEMS))
    assert out.columns == ["doc_id", "text", "k1", "raw", "a.b", "__k1"]
    assert sorted((r["doc_id"] for r in out.collect()), key=repr) == sorted((r[0] for r in ROWS if not brute(r[1])[4]), key=repr)
