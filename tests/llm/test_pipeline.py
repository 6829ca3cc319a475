"""The pipeline: each stage's decisions on its own input, and what it returns."""

import os
import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

import corpus_pipeline as P
from patchloom.llm import mixing, ngram_jaccard, toxicity
from patchloom.llm.common import materialise, read

from .test_decontaminate import words
from .util import SF


def without_repeats(texts, window=400, words_each=51):
    """Texts without bytes in repeated strings of 400 bytes or 51 words, and whether any are gone."""
    # white space between two words that go goes with them
    raws = [(t or "").encode() for t in texts]
    at = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0d]+", b)] for b in raws]
    seen = Counter(hash(b[i : i + window]) for b in raws for i in range(len(b) - window + 1))
    strings = [[tuple(b[x:y] for x, y in s[i : i + words_each]) for i in range(len(s) - words_each + 1)] for b, s in zip(raws, at, strict=True)]
    seen_words = Counter(w for own in strings for w in own)
    out = []
    for k, b in enumerate(raws):
        cover = bytearray(len(b))
        gone = [(i, i + window) for i in range(len(b) - window + 1) if seen[hash(b[i : i + window])] > 1]
        words = {j for i, w in enumerate(strings[k]) if seen_words[w] > 1 for j in range(i, i + words_each)}
        gone += [(at[k][j][0], at[k][j + (j + 1 in words)][1]) for j in words]
        for x, y in gone:
            cover[x:y] = b"\1" * (y - x)
        out.append((bytes(c for c, o in zip(b, cover, strict=True) if not o).decode("utf-8", "ignore"), bool(gone)))
    return out


def test_stages_take_effect(spark, tmp_path):
    docs = read(spark, SF, "documents")
    items = [words(r["text"]) for r in read(spark, SF, "benchmark").collect()]
    grams = {tuple(w[i : i + 10]) for w in items for i in range(max(1, len(w) - 9))}
    columns, last, names = docs.columns, docs, []
    for name, stage in P.STAGES[:-1]:
        out = materialise(stage(spark, last, SF))
        assert out.columns == columns
        ids, before = {r["doc_id"] for r in out.collect()}, {r["doc_id"]: r["text"] for r in last.collect()}
        assert ids <= set(before)
        if name == "toxicity":
            model = toxicity.train(last, read(spark, SF, "labels"), toxicity.categories())
            verdicts = toxicity.classify(last, model, list(toxicity.categories())).collect()
            assert ids == {r["doc_id"] for r in verdicts if not r["toxic"]}
        if name == "ngram_jaccard":
            firsts = {r["component_id"] for r in ngram_jaccard.join(last).collect()}
            assert ids == firsts
        if name == "suffix_dedup":
            assert ids == set(before)
            rows = [(r["doc_id"], r["text"]) for r in last.collect()]
            after = {r["doc_id"]: r["text"] for r in out.collect()}
            for (i, text), (want, gone) in zip(rows, without_repeats([t for _, t in rows]), strict=True):
                assert after[i] == (want if gone else text)
        if name == "decontaminate":
            bad = {i for i, t in before.items() if any(tuple(w[k : k + 10]) in grams for w in [words(t)] for k in range(len(w)))}
            assert ids == set(before) - bad
        last, names = out, [*names, name]
    mixed = P.mix_sources(spark, last, SF).collect()
    last.write.parquet(str(tmp_path / "last"))
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/last/*.parquet'")
    c.execute(f"create view labels as select * from '{os.path.join(SF, 'labels.parquet')}'")
    want = {r[0]: r[1:] for r in c.execute(mixing.OP9_SQL).fetchall()}
    assert {r["doc_id"]: (r["size"], r["source_size"], r["target"], r["taken"]) for r in mixed} == want
    assert len(mixed) == last.count() and any(r["taken"] for r in mixed)
    assert names == ["toxicity", "ngram_jaccard", "suffix_dedup", "decontaminate"]


def test_repeated_rows_and_clashing_columns(spark):
    """Of repeated rows one stays; columns of any name are kept."""
    text = "one two three four five six seven eight"
    rows = [(1, text, "a", 1), (1, text, "a", 1), (2, text + " nine", "b", 2), (None, text, "a", 3), (3, "", "a", 4), (3, "", "a", 5), (4, None, None, 6), (5, "quite other words than those that stand there", "a", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, gone int")
    docs = docs.withColumn("k1", F.lit(1)).withColumn("comp", F.lit(None).cast("string")).withColumn("a.b", F.lit(2)).withColumn("row", F.lit(3))
    out = P.drop_near_copies(spark, docs, SF)
    assert out.columns == docs.columns
    assert sorted(((r["doc_id"], r["gone"]) for r in out.collect()), key=repr) == sorted([(1, 1), (3, 4), (3, 5), (4, 6), (5, 7)], key=repr)
    assert P.drop_near_copies(spark, docs.limit(0), SF).count() == 0
