"""op3 against a brute force over all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from patchloom.llm import suffix_dedup as S
from patchloom.llm.common import read

from .util import SF, frame

DOCS = "doc_id long, text string, h long, spans string"


def brute(texts, w):
    raws = [(t or "").encode() for t in texts]
    n = Counter(hash(b[i : i + w]) for b in raws for i in range(len(b) - w + 1))
    out = []
    for b in raws:
        cover = bytearray(len(b))
        for i in range(len(b) - w + 1):
            if n[hash(b[i : i + w])] > 1:
                cover[i : i + w] = b"\1" * w
        kept = bytes(x for x, y in zip(b, cover, strict=True) if not y)
        spans = sum(1 for i in range(len(b)) if cover[i] and (not i or not cover[i - 1]))
        out.append((len(b), sum(cover), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, other = text(40), text(25)
    rows = [text(r.randint(0, 60)) for _ in range(12)]
    rows += [f"{text(5)} {passage} {text(5)}" for _ in range(4)] + [passage + other, other + passage, passage * 2]
    rows += ["a" * 900, "a" * 500, "ab" * 300, None, "", "x", rows[0], rows[0]]
    return rows


@pytest.mark.parametrize(("seed", "window", "gram"), [(1, 40, 16), (2, 100, 16), (3, 61, 9)])
def test_brute_force(spark, seed, window, gram):
    texts = corpus(seed)
    docs = frame(spark, [(i, t, 1, "") for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: tuple(r)[1:] for r in S.report(docs, S.find(docs, window=window, gram=gram)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, window)


def test_windows_of_a_large_bucket_at_full_depth():
    r = random.Random(2)
    bodies = [np.frombuffer(bytes(r.choice(b"ab") for _ in range(r.randint(9, 40))), np.uint8) for _ in range(60)]
    n = Counter(b[i : i + 9].tobytes() for b in bodies for i in range(len(b) - 8))
    want = [[n[b[i : i + 9].tobytes()] > 1 for i in range(len(b) - 8)] for b in bodies]
    for how in (S.at_full_depth(bodies, 9), S.refine(bodies, np.zeros(60, bool), 9)):
        assert [x.tolist() for x in how] == want


@pytest.mark.parametrize(("hot", "size"), [(1, S.GROUP_BYTES), (3, S.GROUP_BYTES), (3, 200), (S.HOT, 200)])
def test_hot_buckets_are_refined(spark, monkeypatch, hot, size):
    """Nearly all buckets are hot or large here, or those of the passage that many different texts share."""
    monkeypatch.setattr(S, "HOT", hot)
    monkeypatch.setattr(S, "GROUP_BYTES", size)
    r = random.Random(6)
    texts = corpus(7) + [f"{r.random()} {'shared ' * 3}{'passage of some length, ' * 3}{r.random()}" for _ in range(12)]
    docs = frame(spark, [(i, t, 1, "") for i, t in enumerate(texts)], DOCS)
    got = {x["doc_id"]: tuple(x)[1:] for x in S.report(docs, S.find(docs, window=60, gram=16)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 60)


def test_400_bytes_of_all_documents(spark):
    docs = read(spark, SF.replace("0.001", "0.01"), "documents")
    rows = [(x["doc_id"], x["text"]) for x in docs.select("doc_id", "text").collect()]
    got = {x["doc_id"]: tuple(x)[1:5] for x in S.op3_suffix_dedup(spark, SF.replace("0.001", "0.01")).collect()}
    assert [got[i] for i, _ in rows] == brute([t for _, t in rows], 400)


def test_chunks_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 300)
    texts = corpus(4)
    docs = frame(spark, [(i, t, 1, "") for i, t in enumerate(texts)], DOCS)
    batch = pa.record_batch([pa.array([1] * len(texts)), pa.array([1] * len(texts)), pa.array(texts)], ["k1", "k2", "text"])
    found = list(S.pieces(S.byte_symbols(batch), 40))
    assert all(len(b) <= 300 + 2 * 40 for b, _ in found)
    got = {r["doc_id"]: tuple(r)[1:] for r in S.report(docs, S.find(docs, window=40, gram=16)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 40)


def test_repeated_rows_nulls_and_empty(spark):
    rows = [(1, "y" * 450, 0, ""), (1, "y" * 450, 0, ""), (None, "q" + "z" * 10, 0, ""), (None, None, 0, "")]
    docs = frame(spark, rows, DOCS)
    got = sorted((tuple(r)[:4] for r in S.report(docs, S.find(docs)).collect()), key=repr)
    assert got == sorted([(1, 450, 450, 1), (1, 450, 450, 1), (None, 11, 0, 0), (None, 0, 0, 0)], key=repr)
    none = frame(spark, [], DOCS)
    assert S.report(none, S.find(none)).count() == 0


def test_cut(spark):
    passage = "é" * 210
    docs = spark.createDataFrame([(1, f"a{passage}b", "x", 212), (2, f"{passage}c", "x", 211), (3, None, "x", None)], "doc_id long, text string, source string, n_chars long")
    docs = docs.withColumn("k1", F.lit(7)).withColumn("spans", F.lit(None).cast("int")).withColumn("a.b", F.lit("c"))
    out = {r["doc_id"]: r for r in S.cut(docs, S.find(docs)).collect()}
    assert out[1].asDict().keys() == set(docs.columns) and out[2]["k1"] == 7 and out[2]["spans"] is None
    assert (out[1]["text"], out[1]["n_chars"]) == ("ab", 2) and out[2]["text"] == "c" and out[3]["text"] is None


def brute_words(texts, n):
    split = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + n]) for w in split for i in range(len(w) - n + 1))
    out = []
    for w in split:
        cover = [False] * len(w)
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                cover[i : i + n] = [True] * n
        out.append([x for x, y in zip(w, cover, strict=True) if not y])
    return out


@pytest.mark.parametrize(("seed", "words", "gram"), [(1, 9, 3), (5, 12, 4)])
def test_word_windows_brute_force(spark, seed, words, gram):
    texts = corpus(seed) + ["x " * 40, "word \n\tword  " * 20]
    docs = frame(spark, list(enumerate(texts)), "doc_id long, text string")
    found = S.either(S.find_words(docs, words=words, gram=gram))
    got = {r["doc_id"]: (r["text"] or "").encode().split() for r in S.cut(docs, found).collect()}
    assert [got[i] for i in range(len(texts))] == brute_words(texts, words)


def test_pipeline_cuts_51_short_words(spark):
    """A passage of 51 words, far below 400 bytes, in otherwise different documents; one of 50 words stays."""
    r = random.Random(8)
    text = lambda n: " ".join("".join(r.choice("abcdef") for _ in range(r.randint(2, 5))) for _ in range(n))
    over, under, long = text(51), text(50), "z" * 450
    assert len(over) < 400
    rows = [f"{text(30)} {over} {text(30)}" for _ in range(3)] + [f"{text(30)} {under} {text(30)}" for _ in range(3)] + [f"{text(30)} {long} {text(3)}" for _ in range(2)]
    docs = spark.createDataFrame([(i, t, "x", len(t)) for i, t in enumerate(rows)], "doc_id long, text string, source string, n_chars long")
    out = {x["doc_id"]: x["text"] for x in corpus_pipeline.cut_repeats(spark, docs, "").collect()}
    assert not any(over in out[i] for i in range(3)) and all(len(out[i].split()) == 60 for i in range(3))
    assert [out[i] for i in range(3, 6)] == rows[3:6]
    assert not any(long in out[i] for i in (6, 7))
