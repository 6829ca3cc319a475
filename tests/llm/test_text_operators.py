"""op1, op2, op6, op10: contracts, held-out quality and defined cases."""

import math
import random
import zlib
from collections import Counter, defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import pytest

from patchloom.llm import langid, lm_score, quality, toxicity
from patchloom.llm.common import read

from .util import SF, frame

DOCS = "doc_id long, text string, lang string, score double"
ODD = [(1, None, None, 0.0), (None, "a b", "en", 0.0), (2, "", "en", 0.0), (3, "a b a b a b\n\n a b a b", "en", 0.0), (3, "a b a b a b\n\n a b a b", "en", 0.0), (4, "ÀÉ \x1c x " * 30_000, "fr", 0.0), (5, "123 !!", "fr", 0.0)]


# --- language-model scoring ---


def test_lm_beats_its_base(spark):
    """On held-out and training texts, of a corpus that is not tiny."""
    got = lm_score.op1_lm_score(spark, SF.replace("0.001", "0.01")).collect()
    for flag in (True, False):
        own = [r for r in got if r["held_out"] == flag]
        assert sum(r["score"] for r in own) > sum(r["base_score"] for r in own)


def test_lm_contract(spark):
    docs = [(r["doc_id"], r["text"]) for r in read(spark, SF, "documents").select("doc_id", "text").collect()]
    got = {r["doc_id"]: r for r in lm_score.op1_lm_score(spark, SF).collect()}
    words = {i: (t or "").encode().lower().split() + [None] for i, t in docs}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in words}
    c = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in words.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel_tol=1e-9)


def test_lm_defined_cases(spark):
    got = lm_score.score(frame(spark, ODD, DOCS)).collect()
    assert len(got) == len(ODD) and all(r["score"] < 0 and r["n_tokens"] >= 1 for r in got)
    assert len({(r["doc_id"], r["score"]) for r in got if r["doc_id"] == 3}) == 1
    assert lm_score.score(frame(spark, [], DOCS)).count() == 0


def test_huffman_paths_tell_classes_apart():
    code = lm_score.Code(np.arange(lm_score.CLASSES, dtype=float) ** 2)
    paths = {tuple((int(code.place[k]), int(code.bit[k])) for k in range(b, b + d)) for b, d in zip(code.base, code.depth, strict=True)}
    assert len(paths) == lm_score.CLASSES
    assert math.isclose(sum(2.0**-d for d in code.depth), 1.0)


def test_decisions_of_documents_are_apart():
    code = lm_score.Code(np.ones(lm_score.CLASSES))
    r = np.random.default_rng(1)
    seqs = [r.integers(0, lm_score.CLASSES, n).astype(np.uint8) for n in (1, 5, 40)]
    slots, place, bit, group = lm_score.class_decisions(code, seqs)
    for i, s in enumerate(seqs):
        own_slots, own_place, own_bit, _ = lm_score.class_decisions(code, [s])
        at = group == i
        assert (place[at] == own_place).all() and (bit[at] == own_bit).all()
        assert all((a[at] == b).all() for a, b in zip(slots, own_slots, strict=True))
    n, n1 = lm_score.so_far(place, bit, group)
    seen = Counter()
    for k in range(len(bit)):
        key = (group[k], place[k])
        assert (n[k], n1[k]) == (seen[key, 0] + seen[key, 1], seen[key, 1])
        seen[key, bit[k]] += 1


def brute_mix(model, code, seqs):
    """log10 of sequences of classes, decision by decision, from the counts and weights of a model."""
    out = []
    for seq in seqs:
        total, seen = 0.0, {}
        slots, place, bit, _ = lm_score.class_decisions(code, [seq])
        for k in range(len(bit)):
            x = []
            for own, (n, n1) in zip(slots, model.counts, strict=True):
                x.append(math.log((n1[own[k]] + 0.3) / (n[own[k]] - n1[own[k]] + 0.3)))
            sure = sum(model.counts[model.gate_by][0][slots[model.gate_by][k]] > c for c in lm_score.CONFIDENCE)
            ones, zeros = seen.get((place[k], 1), 0), seen.get((place[k], 0), 0)
            x.append(math.log((ones + 0.4) / (zeros + 0.4)))
            z = min(11, max(-11, sum(w[place[k] * 4 + sure] * v for w, v in zip(model.w, x, strict=True))))
            p = 1 / (1 + math.exp(-z))
            c = place[k] * lm_score.BUCKETS + min(lm_score.BUCKETS - 1, max(0, int(z * 2 + lm_score.BUCKETS / 2)))
            p = (p + (model.hits[1][c] + 8 * p) / (model.hits[0][c] + 8)) / 2
            total += math.log10(min(1 - 1e-6, max(1e-6, p if bit[k] else 1 - p)))
            seen[place[k], bit[k]] = seen.get((place[k], bit[k]), 0) + 1
        out.append(total)
    return out


def test_mixed_scores_equal_brute_force_and_sum_to_one():
    r = np.random.default_rng(4)
    code = lm_score.Code(r.integers(1, 100, lm_score.CLASSES).astype(float))
    n1, n0 = ([r.integers(0, 9, size).astype(np.float32) for size in lm_score.CLASS_TABLES] for _ in range(2))
    model = lm_score.Mixer([(a + b, a) for a, b in zip(n1, n0, strict=True)], True, 3)
    model.w += r.normal(0, 0.1, model.w.shape).astype(np.float32)
    model.hits[0] = r.integers(10, 90, model.hits.shape[1])
    model.hits[1] = np.floor(model.hits[0] * r.random(model.hits.shape[1]))
    seqs = [r.integers(0, lm_score.CLASSES, n).astype(np.uint8) for n in (1, 7, 30)]
    want = brute_mix(model, code, seqs)
    model.frozen()
    got = model.log10(lm_score.class_decisions(code, seqs), len(seqs))
    assert np.allclose(got, want, rtol=1e-3, atol=1e-3)
    prefix = seqs[1]
    nexts = [np.append(prefix, k).astype(np.uint8) for k in range(lm_score.CLASSES)]
    more = model.log10(lm_score.class_decisions(code, nexts), len(nexts)) - got[1]
    assert math.isclose((10**more).sum(), 1, rel_tol=1e-3)


def test_left_out_decisions_equal_brute_force():
    """A decision among the counts sees them without itself, at every slot."""
    r = np.random.default_rng(7)
    code = lm_score.Code(r.integers(1, 100, lm_score.CLASSES).astype(float))
    seqs = [r.integers(0, 9, n).astype(np.uint8) for n in (1, 40, 300)]
    slots, place, bit, group = lm_score.class_decisions(code, seqs)
    counts = [(np.bincount(s, minlength=z).astype(np.float32), np.bincount(s, bit, z).astype(np.float32)) for s, z in zip(slots, lm_score.CLASS_TABLES, strict=True)]
    model = lm_score.Mixer(counts, True, 3)
    x, gate = model.evidence(slots, place, bit, group)
    for s, (n, n1), own in zip(slots, counts, x, strict=False):
        others, ones = n[s] - 1, n1[s] - bit
        assert np.allclose(own, np.log((ones + 0.3) / (others - ones + 0.3)), atol=1e-5)
    sure = np.searchsorted(lm_score.CONFIDENCE, counts[3][0][slots[3]] - 1)
    assert (gate == place * 4 + sure).all()


@pytest.mark.parametrize("kind", ["classes", "words"])
def test_lm_learns_from_all_that_training_has(spark, monkeypatch, kind):
    """What the refining table counts are all decisions of all training documents, or of all words met once."""
    got, plain = {}, lm_score.learned

    def learned(model, *args):
        own = plain(model, *args)
        got["classes" if own.local else "words"] = own.counts[0], own.hits
        return own

    monkeypatch.setattr(lm_score, "learned", learned)
    docs = [(i, " ".join(f"w{(i * j) % 50} o{i}x{j}" for j in range(1, 20)), "en", 0.0) for i in range(60)]
    lm_score.score(frame(spark, docs, DOCS)).collect()
    (n, n1), hits = got[kind]  # the first table has every decision once
    assert hits[0].sum() == n.sum() > 0 and hits[1].sum() == n1.sum()


def test_decisions_that_follow_one_another_share_a_line_of_slots():
    """Four decisions of a path lie in one line of 16 slots of a context; no two places of a context share a slot."""
    code = lm_score.Code(np.arange(1, lm_score.CLASSES + 1, dtype=float) ** 3)
    hashed = [k for k, size in enumerate(lm_score.CLASS_TABLES) if size == lm_score.SLOTS]
    met = {}
    for c in range(lm_score.CLASSES):
        slots, place, _, _ = lm_score.class_decisions(code, [np.array([5, 6, 7, c], np.uint8)])
        for k in hashed:
            own = slots[k][-code.depth[c] :]
            assert all(len(set(own[a : a + 4] >> 4)) == 1 for a in range(0, len(own), 4))
            met.update({(k, int(s)): met.get((k, int(s)), set()) | {int(p)} for s, p in zip(own, place[-code.depth[c] :], strict=True)})
    assert len(met) == len(hashed) * (lm_score.CLASSES - 1) and all(len(p) == 1 for p in met.values())
    slots, place, _, _ = lm_score.spell_decisions([bytes([b]) for b in range(256)])
    for own in slots[1:]:  # the first byte of each word has the same contexts
        own, at = own.reshape(256, 2, 8)[:, 0], place.reshape(256, 2, 8)[:, 0]
        assert len({*zip(own.ravel().tolist(), at.ravel().tolist(), strict=True)}) == len(set(own.ravel().tolist())) == 255
        assert (own[:, :4] >> 4 == own[:, :1] >> 4).all() and (own[:, 4:] >> 4 == own[:, 4:5] >> 4).all()


def test_evidence_of_many_decisions_equals_brute_force():
    """More decisions than are looked up at a time."""
    r = np.random.default_rng(3)
    code = lm_score.Code(r.integers(1, 100, lm_score.CLASSES).astype(float))
    slots, place, bit, group = lm_score.class_decisions(code, [r.integers(0, lm_score.CLASSES, n).astype(np.uint8) for n in (900, 2500)])
    assert len(bit) > 2 * lm_score.STEP
    n1, n0 = ([r.integers(1, 90, size).astype(np.float32) for size in lm_score.CLASS_TABLES] for _ in range(2))
    n, own1 = lm_score.so_far(place, bit, group)
    for frozen in (False, True):
        model = lm_score.Mixer([(a + b, a) for a, b in zip(n1, n0, strict=True)], True, 3)
        x, gate = (model.frozen() if frozen else model).evidence(slots, place, bit, group)
        for k, s in enumerate(slots):
            ones, zeros = n1[k][s] - (0 if frozen else bit), n0[k][s] - (0 if frozen else 1 - bit)
            assert np.allclose(x[k], np.log((ones + 0.3) / (zeros + 0.3)), atol=1e-5)
        assert np.allclose(x[-1], np.log((own1 + 0.4) / (n - own1 + 0.4)), atol=1e-5)
        assert (gate == place * 4 + np.searchsorted(lm_score.CONFIDENCE, (n0[3] + n1[3])[slots[3]] - (not frozen))).all()
        z = np.clip((model.w[:, gate] * x).sum(0), -11, 11)
        assert np.allclose(model.mixed(x, gate), z, atol=1e-4)


def test_numbered_words_equal_split():
    texts = ["  A b\x0b\tA ", "", " ", "\u00c9 \u00e9 x\x1cy \x85 z\u00a0b", "b", "\r\n"]
    number = defaultdict(count().__next__)
    for a, z in ((0, 2), (2, 3), (3, 6)):
        ids, ends = lm_score.numbered(pa.array(texts)[a:z], number)
        words = list(number)
        got = [[words[k] for k in ids[s:e]] for s, e in zip([0, *ends[:-1]], ends, strict=True)]
        assert got == [t.encode().lower().split() for t in texts[a:z]]
    assert list(number.values()) == list(range(len(number)))


def test_lm_contract_holds_over_many_blocks(spark, monkeypatch):
    docs = [(i, None if i % 9 == 0 else " ".join(f"W{(i * j) % 13}" for j in range(i % 7)) + " " * (i % 3), "en", 0.0) for i in range(80)]
    columns = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "train_tokens"]
    want = lm_score.score(frame(spark, docs, DOCS)).select(columns).orderBy("doc_id").collect()
    monkeypatch.setattr(lm_score, "PIECE", 40)
    monkeypatch.setattr(lm_score, "BLOCK_TOKENS", 25)
    blocks = lm_score.number_words(frame(spark, docs, DOCS).coalesce(1), "doc_id", "text")
    assert blocks.select("block").distinct().count() > 3
    got = lm_score.score(frame(spark, docs, DOCS)).select(columns).orderBy("doc_id").collect()
    assert all(a[:4] == b[:4] and a[5] == b[5] and math.isclose(a[4], b[4], rel_tol=1e-9) for a, b in zip(want, got, strict=True))


# --- language identification ---


def test_two_classes_are_a_context_of_their_own():
    """Words after the same two classes share a slot whatever the third; after other second classes they do not."""
    code = lm_score.Code(np.ones(lm_score.CLASSES))
    one, same, other = ([np.array(x, np.uint8)] for x in ([1, 2, 3, 9], [7, 2, 3, 9], [1, 8, 3, 9]))
    at = -code.depth[9]
    slots = [lm_score.class_decisions(code, x)[0] for x in (one, same, other)]
    assert len(slots[0]) == 5
    shared = [(np.array_equal(a[at:], b[at:]), np.array_equal(a[at:], c[at:])) for a, b, c in zip(*slots, strict=True)]
    assert shared.count((True, False)) == 1


def test_langid_held_out(spark):
    truth = {r["doc_id"]: r["lang"] for r in read(spark, SF, "documents").collect()}
    got = [r for r in langid.op2_langid(spark, SF).collect() if r["held_out"]]
    assert got and sum(r["lang_pred"] == truth[r["doc_id"]] for r in got) >= 0.97 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def brute_ppm(counts, text, order):
    """Bits of a text under one language's trees, byte by byte."""
    t, bits = b"   " + text, 0.0
    for i in range(3, len(t)):
        for k in range(order, -1, -1):
            seen = {s: c for (ctx, s), c in counts[k].items() if ctx == t[i - k : i]}
            if not seen:
                continue
            n, q = sum(seen.values()), len(seen)
            if t[i] in seen:
                bits += math.log2((n + q) / seen[t[i]])
                break
            bits += math.log2((n + q) / q)
        else:
            bits += 8
    return bits


def test_trees_keep_their_order_at_any_size(spark):
    """More than 3,000,000 distinct strings of four bytes, which made trees one byte shallower."""
    r = np.random.default_rng(3)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789!#$%&()*+,-./:;<=>?[]^_{|}~", np.uint8)
    rows = [(i, letters[r.integers(0, len(letters), 500_000)].tobytes().decode(), "xx") for i in range(8)]
    docs = frame(spark, rows, "doc_id long, text string, lang string")
    trees = langid.learn(docs, docs.doc_id >= 0)
    assert trees.order == langid.ORDER and len(trees.keys) > 3_000_000


@pytest.mark.parametrize("order", [3, 2, 0])
def test_code_lengths_equal_brute_force(spark, order):
    r = random.Random(3)
    rows = [(i, "".join(r.choice("ab c" if i % 2 else "bd e") for _ in range(30)), "xy"[i % 2], 0.0) for i in range(12)]
    docs = frame(spark, rows, DOCS)
    trees = langid.learn(docs, docs.doc_id >= 0, order=order)
    texts = ["abba cab", "dd ebe", "zzé", "a"]
    got = trees.texts([t.encode() for t in texts])
    for j, lang in enumerate(trees.langs):
        counts = [Counter() for _ in range(order + 1)]
        for _, t, own, _ in rows:
            if own == lang:
                b = b"   " + t.encode()
                for i in range(3, len(b)):
                    for k in range(order + 1):
                        counts[k][b[i - k : i], b[i]] += 1
        for i, t in enumerate(texts):
            assert math.isclose(got[i, j], brute_ppm(counts, t.encode(), order), rel_tol=1e-4)


def test_langid_defined_cases(spark):
    docs = frame(spark, ODD, DOCS)
    got = langid.identify(docs, langid.learn(docs, docs.doc_id.isNotNull())).collect()
    by = {r["doc_id"]: r["lang_pred"] for r in got}
    assert len(got) == len(ODD) and by[1] == by[2] == by[5] == "und" and by[4] == "fr" and by[3] == "en"
    assert langid.learn(docs, docs.doc_id < 0) is None
    assert {r["lang_pred"] for r in langid.identify(docs, None).collect()} == {"und"}
    shallow = langid.learn(docs, docs.doc_id.isNotNull(), max_nodes=12)
    assert shallow.order < 3
    whole = langid.learn(docs, docs.doc_id.isNotNull())
    two, three = (whole.texts([b"a b " * k]) for k in (2, 3))
    assert np.allclose(whole.texts([b"a b " * 700_000]), two + 699_998 * (three - two), rtol=1e-6)


# --- quality ---


def brute_quality(text):
    t = text or ""
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    n = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if n[tuple(words[i : i + 3])] > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(hit), failed


def test_quality_equals_brute_force(spark):
    docs = [tuple(r) for r in read(spark, SF, "documents").select("doc_id", "text").collect()][:120] + [(r[0], r[1]) for r in ODD if len(r[1] or "") < 1000]
    for _, t in docs:
        assert quality.score(t)[:6] == brute_quality(t)


def test_quality_keeps_good_and_drops_bad(spark):
    got = {r["doc_id"]: r for r in quality.op6_quality(spark, SF).collect()}
    labels = [(r["doc_id"], r["quality"]) for r in read(spark, SF, "labels").collect()]
    good = [got[i]["kept"] for i, q in labels if q == 1 and not got[i]["base_failed"]]
    bad = [got[i]["kept"] for i, q in labels if q == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.1 * len(bad)
    assert quality.rules(frame(spark, [], DOCS)).count() == 0
    assert [r["kept"] for r in quality.rules(frame(spark, ODD[:1], DOCS)).collect()] == [False]
    assert quality.clean_text("Good line.\nhome | about | more\nGood line.\nno stop\n\nA cookie notice.") == "Good line."


# --- toxicity ---


def test_toxicity_chain_out_of_fold():
    r = random.Random(1)
    neutral = [f"w{i}".encode() for i in range(300)]
    words, poor, toxic = [], [], []
    for _ in range(900):
        own = set(r.sample(neutral, 25))
        p, t = r.random() < 0.3, r.random() < 0.15
        own |= {b"spam"} if p else set()
        own |= set(r.sample([b"idiot", b"moron", b"clown"], 2)) if t else set()
        words.append(own)
        poor.append(float(p))
        toxic.append(float(t))
    model = toxicity.fit_chain(words, np.arange(900) % 5, [np.array(poor), np.array(toxic)])
    oof, y, _ = model["oof"]
    assert ((oof > model["cut"]) == (y == 1)).mean() > 0.98
    assert len(model["links"][1][1]) == 1  # the later model reads the earlier probability
    assert toxicity.chain_logits(model, {b"idiot", b"clown", b"w3"})[-1] > model["cut"] > toxicity.chain_logits(model, {b"w3", b"w4"})[-1]


def test_toxicity_query(spark):
    truth = {r["doc_id"]: r["toxic"] for r in read(spark, SF, "labels").collect()}
    got = {r["doc_id"]: r["toxic"] for r in toxicity.op10_toxicity(spark, SF).collect()}
    clean = [got[i] for i, t in truth.items() if not t]
    assert sum(clean) <= 0.03 * len(clean)


def test_toxicity_held_out(spark):
    """Fitted on the labels of even ids, some 2,000; odd ids are what it has not seen (0.82 caught)."""
    folder = SF.replace("0.001", "0.1")
    docs, labels = read(spark, folder, "documents"), read(spark, folder, "labels")
    model = toxicity.train(docs, labels.where("doc_id % 2 = 0"), toxicity.categories())
    got = {r["doc_id"]: r["toxic"] for r in toxicity.classify(docs, model, list(toxicity.categories())).collect()}
    odd = [(got[r["doc_id"]], r["toxic"]) for r in labels.collect() if r["doc_id"] % 2 and r["doc_id"] in got]
    caught = [g for g, t in odd if t == 1]
    alarms = [g for g, t in odd if t == 0]
    assert len(caught) >= 100 and sum(caught) >= 0.75 * len(caught) and sum(alarms) <= 0.02 * len(alarms)


def test_toxicity_defined_cases(spark):
    docs = frame(spark, ODD, DOCS)
    none = frame(spark, [], "doc_id long, quality int, toxic int")
    assert toxicity.train(docs, none, toxicity.categories()) is None
    assert not any(r["toxic"] for r in toxicity.classify(docs, None, ["toxic"]).collect())
    one = frame(spark, [(3, 1, 0), (3, None, 0), (4, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, one, toxicity.categories())
    assert not any(r["toxic"] for r in toxicity.classify(docs, model, list(toxicity.categories())).collect())
    assert toxicity.drop_toxic(docs, model).count() == len(ODD)
