"""Language-model scoring by logistic context mixing.

A text is a sequence of words and one end. Each is coded in binary decisions. A word's class comes
first, as the path of a Huffman code: the most frequent words are classes of their own, others
share a class by their last two bytes, and new words are an escape. Inside a shared class a word
has its share of the class's count, less a discount for new words; after the escape it is spelled
bit by bit, a space ending it. A training document's own use of a word is left out of the choice,
so a word that training has once is new there, which is where escape and spelling are learned.

Every decision is predicted by several predictors, each a pair of counts under a hashed context:
for classes the last one, two and three classes, the last frequent word, and the decisions that
this document took at the same place so far, which adapt as it is read; for spelling the last one,
two and three bytes. Their log-odds are combined by weights that a gate selects (the decision's
place and how often its context was seen), learned online, and the result is refined by a table of
what came true at such a prediction. The product of the decisions is the text's probability.

Counts cover all training documents. They are summed in each task, then over tasks; count tables
have a fixed number of slots, so the model's size is bounded at any input. The mixing weights learn
from all training documents (for spelling, all words that training has once), each without its own
counts: every task goes online through its own, and the tasks' weights are averaged by how often
each gate was met. Then the refining table counts what came true in the same documents. Words are
numbered by block of documents, so that corpus counts reach documents as one dictionary a block:
texts are read once and never shuffled.

Defined cases: null text is empty and has its end alone; a null id counts as the empty text for the
choice of training documents; with nothing to train on every count is 0; repeated rows each count;
an empty table gives no rows; other columns are not read; texts of any length are scored whole.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from copy import copy
from itertools import count, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, held_out, materialise, read

FREQUENT, ENDINGS = 190, 62
ESCAPE, END, CLASSES = FREQUENT + ENDINGS, FREQUENT + ENDINGS + 1, FREQUENT + ENDINGS + 2
SLOTS = 1 << 20
SPELL_SLOTS = 1 << 18
#: So many times the mixing weights go through all training documents or words.
LEARN_ROUNDS = 2
BLOCK_WORDS, BLOCK_TOKENS = 500_000, 8_000_000
#: Bytes of text whose words are numbered at a time; a block ends after one.
PIECE = 4 << 20
#: So many tokens (or bytes of words) are turned into decisions at a time, and weights move after so many decisions.
CHUNK, STEP = 25_000, 10_000
#: Slots that are summed together.
PART, COUNTS = 4096, "part int, body binary"
CONFIDENCE = np.array([0.5, 4.5, 40.5])
BUCKETS = 24


def stretch(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def hashed(x: np.ndarray) -> np.ndarray:
    return ((x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int32)


# --- decisions: (slots by predictor, gate place, bit, group) -------------------------------------------------
#
# A decision's slot is the hash of its context, some bits of it turned by the decision's key. Four decisions of a path
# that follow one another have keys that differ in the last four bits alone, so they meet in the cache.


class Code:
    """A Huffman code over classes: each class's path of (place, bit)."""

    def __init__(self, totals: np.ndarray) -> None:
        heap = [(float(n) + 0.5, i, i) for i, n in enumerate(totals)]
        heapq.heapify(heap)
        up: dict[int, tuple[int, int]] = {}
        for node in range(len(totals), 2 * len(totals) - 1):
            (a, _, i), (b, _, j) = heapq.heappop(heap), heapq.heappop(heap)
            up[i], up[j] = (node, 0), (node, 1)
            heapq.heappush(heap, (a + b, node, node))
        places, bits, keys, self.depth = [], [], [], []
        lines: dict[int, int] = {}
        for s in range(len(totals)):
            path = []
            while s in up:
                s, bit = up[s]
                path.append((s - len(totals), bit))
            self.depth.append(len(path))
            places += [p for p, _ in reversed(path)]
            bits += [b for _, b in reversed(path)]
            for d, (p, _) in enumerate(reversed(path)):
                line, own = (lines.setdefault(p, 16 * len(lines)), 1) if d % 4 == 0 else (line, 2 * own + bits[len(keys) - 1])
                keys.append(line + own)
        self.depth = np.array(self.depth)
        self.place, self.bit, self.key = np.array(places, np.int32), np.array(bits, np.int8), np.array(keys, np.int32)
        self.base = np.cumsum(self.depth) - self.depth


def class_decisions(code: Code, seqs: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """By context, slots in its table; place, bit, and the number of the sequence."""
    s = np.concatenate(seqs).astype(np.int64)
    lens = np.array([len(x) for x in seqs])
    doc = np.repeat(np.arange(len(seqs)), lens)
    begin = np.repeat(np.cumsum(lens) - lens, lens)
    at = np.arange(len(s))

    def back(k: int) -> np.ndarray:
        return np.where(at - k >= begin, s[np.maximum(at - k, 0)], END)

    p1, p2, p3 = back(1), back(2), back(3)
    seen = np.maximum.accumulate(np.where(s < 64, at, -1))
    seen = np.concatenate([[-1], seen[:-1]])
    common = np.where(seen >= begin, s[np.maximum(seen, 0)], END)
    depth = code.depth[s]
    ends = np.cumsum(depth)
    path = np.repeat(code.base[s] - ends + depth, depth)
    path += np.arange(len(path))
    place, bit, key = (x.take(path, mode="clip") for x in (code.place, code.bit, code.key))
    two = p2 * CLASSES + p1
    slots = [place, np.repeat((p1 * CLASSES).astype(np.int32), depth) + place]
    for c in (two, p3 * CLASSES * CLASSES + two + (1 << 40), common * CLASSES + p1 + (1 << 44)):
        slots.append(np.repeat(hashed(c) & (SLOTS - 1), depth) ^ key)
    return slots, place, bit, np.repeat(doc.astype(np.int32), depth)


CLASS_TABLES = [CLASSES, CLASSES * CLASSES, SLOTS, SLOTS, SLOTS]


def spell_decisions(words: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """The bits of words and the space after each; contexts do not reach into other words."""
    b = np.frombuffer(b"".join(b"   " + w + b" " for w in words), np.uint8).astype(np.int64)
    lens = np.array([len(w) + 1 for w in words])
    starts = np.cumsum(lens + 3) - lens
    at = np.repeat(starts - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
    word = np.repeat(np.arange(len(words), dtype=np.int32), lens)
    place, bit, key = (x.take(b[at], axis=0) for x in (BYTE_PLACE, BYTE_BIT, BYTE_KEY))
    one, two, three = b[at - 1], b[at - 2], b[at - 3]
    slots = [(one[:, None] * 256).astype(np.int32) + place]
    for c in (two << 8 | one | 1 << 24, three << 16 | two << 8 | one | 1 << 25):
        slots.append((hashed(c) & (SPELL_SLOTS - 1))[:, None] ^ key)
    return [x.ravel() for x in slots], place.ravel(), bit.ravel(), np.repeat(word, 8)


#: By byte, the places, values and keys of its bits; a line of slots for the first four, one for the others after each.
_K, _BYTE = np.arange(8), np.arange(256)[:, None]
BYTE_PLACE = (1 << _K | _BYTE >> (8 - _K)).astype(np.int32)
BYTE_BIT = (_BYTE >> (7 - _K) & 1).astype(np.int8)
BYTE_KEY = np.where(_K < 4, BYTE_PLACE, 16 * (1 + (_BYTE >> 4)) + (1 << _K % 4 | BYTE_PLACE & (1 << _K % 4) - 1)).astype(np.int32)
SPELL_TABLES = [65536, SPELL_SLOTS, SPELL_SLOTS]


def so_far(place: np.ndarray, bit: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often a group took each decision before, and how often as 1. Groups come one after another."""
    key = place.astype(np.uint8)
    order = np.argsort(key, kind="stable")
    p, g = key.take(order, mode="clip"), (group * 2 + bit).take(order, mode="clip")
    b = g & 1
    g >>= 1
    first = np.ones(len(p), bool)
    first[1:] = (p[1:] != p[:-1]) | (g[1:] != g[:-1])
    run = np.flatnonzero(first)
    ones = np.cumsum(b, dtype=np.int32) - b
    size = np.diff(np.append(run, len(p)))
    n, n1 = np.empty(len(p), np.int32), np.empty(len(p), np.int32)
    n[order] = np.arange(len(p), dtype=np.int32) - np.repeat(run.astype(np.int32), size)
    n1[order] = ones - np.repeat(ones[run], size)
    return n, n1


class Mixer:
    """Counts, gated weights and the refining table of one kind of decision."""

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]], local: bool, gate_by: int) -> None:
        self.counts, self.local, self.gate_by, self.without = counts, local, gate_by, None
        self.inputs = len(counts) + local
        self.w = np.full((self.inputs, 256 * 4), 0.3, np.float32)
        self.hits = np.zeros((2, 256 * BUCKETS), np.float32)

    def frozen(self) -> Mixer:
        """For decisions that are not among the counts: of each slot only its log-odds and confidence."""
        if self.counts is not None:
            self.odds = [np.log((n1 + 0.3) / (n - n1 + 0.3)).astype(np.float32) for n, n1 in self.counts]
            self.sure = np.searchsorted(CONFIDENCE, self.counts[self.gate_by][0]).astype(np.int8)
            self.counts = self.without = None
        return self

    def left_out(self) -> tuple[list[np.ndarray], np.ndarray]:
        """For decisions that are among the counts: by slot and bit the log-odds without one such decision, and by
        slot the confidence. They are worked out once in a task."""
        if self.without is None:
            odds = []
            for n, n1 in self.counts:
                less = np.maximum(n - 1, 0)
                both = np.empty((len(n), 2), np.float32)
                for bit in (0, 1):
                    ones = np.maximum(n1 - np.float32(bit), 0)
                    both[:, bit] = np.log((ones + np.float32(0.3)) / (np.maximum(less - ones, 0) + np.float32(0.3)))
                odds.append(both.ravel())
            sure = np.searchsorted(CONFIDENCE, np.maximum(self.counts[self.gate_by][0] - 1, 0)).astype(np.int8)
            self.without = odds, sure
        return self.without

    def evidence(self, slots: list, place: np.ndarray, bit: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of each predictor, and the gate. Decisions that are among the counts leave themselves out."""
        (tables, sure), counted = ((self.odds, self.sure), 0) if self.counts is None else (self.left_out(), 1)
        x, gate = np.empty((self.inputs, len(place)), np.float32), np.empty(len(place), np.intp)
        if self.local:
            n, n1 = so_far(place, bit, group)
            log = np.log(np.arange(int(n.max(initial=0)) + 1, dtype=np.float32) + np.float32(0.4))
        for a in range(0, len(place), STEP):  # so many stay in the cache
            own = slice(a, a + STEP)
            y = bit[own].astype(np.intp)
            for k, (odds, s) in enumerate(zip(tables, slots, strict=True)):
                at = s[own].astype(np.intp)
                if k == self.gate_by:
                    gate[own] = place[own] * 4 + sure.take(at, mode="clip")
                if counted:
                    at += at
                    at += y
                odds.take(at, out=x[k, own], mode="clip")
            if self.local:
                x[-1, own] = log.take(n1[own], mode="clip") - log.take(n[own] - n1[own], mode="clip")
        return x, gate

    def cell(self, z: np.ndarray, place: np.ndarray) -> np.ndarray:
        return place * BUCKETS + np.clip((z * 2 + BUCKETS / 2).astype(np.int32), 0, BUCKETS - 1)

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        z = np.empty(len(gate), np.float32)
        for a in range(0, len(gate), STEP):
            own = slice(a, a + STEP)
            to = np.multiply(self.w[0].take(gate[own], mode="clip"), x[0, own], out=z[own])
            for w, odds in zip(self.w[1:], x[1:, own], strict=True):
                to += w.take(gate[own], mode="clip") * odds
        return np.clip(z, -11, 11, out=z)

    def learn(self, decisions: tuple, rate: float, step: int = STEP) -> np.ndarray:
        """Online: weights move after every step of decisions. Returns how often each gate was met."""
        _, _, bit, _ = decisions
        x, gate = self.evidence(*decisions)
        for a in range(0, len(bit), step):
            g, y, own = gate[a : a + step], bit[a : a + step], x[:, a : a + step]
            e = y - squash(self.mixed(own, g))
            many = np.bincount(g, minlength=self.w.shape[1]) + 20
            for k in range(self.inputs):
                self.w[k] += rate * np.bincount(g, e * own[k], self.w.shape[1]) / many / 4
        return np.bincount(gate, minlength=self.w.shape[1])

    def came_true(self, decisions: tuple) -> np.ndarray:
        """By cell of the refining table, how many decisions there were and how many were 1."""
        _, place, bit, _ = decisions
        c = self.cell(self.mixed(*self.evidence(*decisions)), place)
        n0, n1 = np.bincount(c * 2 + bit, minlength=2 * self.hits.shape[1]).reshape(-1, 2).T
        return np.array([n0 + n1, n1], float)

    def log10(self, decisions: tuple, groups: int) -> np.ndarray:
        """Sums of log10 probabilities by group."""
        _, place, bit, group = decisions
        z = self.mixed(*self.evidence(*decisions))
        p = squash(z)
        c = self.cell(z, place).astype(np.intp)
        met = self.hits[0] + 8
        p = (self.hits[1] / met / 2).take(c, mode="clip") + p * (4 / met + np.float32(0.5)).take(c, mode="clip")
        p = np.clip(np.where(bit == 1, p, 1 - p), 1e-6, 1 - 1e-6)
        return np.bincount(group, np.log(p), groups) / np.log(10)


# --- passes ---------------------------------------------------------------------------------------------------


def numbered(texts: pa.Array, number: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the words of texts, and where each text's end; new words get the next numbers. A-Z count as a-z."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded, ends = words.flatten().dictionary_encode(), words.offsets.to_numpy()[1:] - words.offsets[0].as_py()
    own, at = coded.dictionary.cast(pa.binary()).to_pylist(), coded.indices.to_numpy()
    if b"" in own:  # before leading and after trailing white space
        kept = at != own.index(b"")
        at, ends = at[kept], np.append(0, np.cumsum(kept))[ends]
    return np.array([number[w] if w else -1 for w in own], np.int32).take(at), ends


def number_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Blocks: a row a document with its words' numbers in its block, and a row for each word of a block."""
    schema = "block long, doc_id long, held boolean, ids binary, n_bytes long, wid int, word binary, n long"
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.int64()]
    names = [f.split()[0] for f in schema.split(", ")]

    def row_batch(size: int, block: int, **cols) -> pa.RecordBatch:  # noqa: ANN003
        cols["block"] = np.full(size, block)
        return pa.RecordBatch.from_arrays([pa.array(cols[c], k) if c in cols else pa.nulls(size, k) for c, k in zip(names, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 24
        number: dict[bytes, int] = defaultdict(count().__next__)
        counts, tokens = np.zeros(0, np.int64), 0

        def words() -> Iterator[pa.RecordBatch]:
            own = list(number)
            for a in range(0, len(own), 20_000):
                part = own[a : a + 20_000]
                yield row_batch(len(part), block, wid=np.arange(a, a + len(part)), word=part, n=counts[a : a + len(part)])

        for b in batches:
            texts = b.column(2).fill_null("")
            n_bytes = pc.binary_length(texts).to_numpy()
            cuts = np.flatnonzero(np.diff(np.cumsum(n_bytes, dtype=np.int64) // PIECE)) + 1
            for a, z in pairwise([0, *cuts.tolist(), len(texts)]):
                ids, ends = numbered(texts[a:z], number)
                counts = np.concatenate([counts, np.zeros(len(number) - len(counts), np.int64)])
                held = b.column(1)[a:z].to_numpy(zero_copy_only=False)
                counts += np.bincount(ids[np.repeat(~held, np.diff(ends, prepend=0))], minlength=len(counts))
                own = pa.Array.from_buffers(pa.large_binary(), z - a, [None, pa.py_buffer(np.append(0, ends).astype(np.int64) * 4), pa.py_buffer(ids)])
                yield row_batch(z - a, block, doc_id=b.column(0)[a:z], held=b.column(1)[a:z], ids=own.cast(pa.binary()), n_bytes=n_bytes[a:z])
                tokens += len(ids)
                if len(number) > BLOCK_WORDS or tokens > BLOCK_TOKENS:
                    yield from words()
                    block, tokens = block + 1, 0
                    number = defaultdict(count().__next__)
                    counts = np.zeros(0, np.int64)
        yield from words()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col), 10, 0).alias("held"), F.col(text_col))
    return rows.mapInArrow(run, schema)


def class_of(word: bytes, n: int, top: dict[bytes, int]) -> int:
    """The class that documents outside training give a word; inside, a word with n = 1 is an escape."""
    if not n:
        return ESCAPE
    own = top.get(word)
    return FREQUENT + (word[-1] * 31 + word[-2:][0] * 7) % ENDINGS if own is None else own


def corpus_counts(blocks: DataFrame) -> DataFrame:
    """word, block, wid, c (its count in training), first (one row a word); rows of a word stand together."""
    own = Window.partitionBy("word").orderBy("block", "wid")  # one sort for both
    every = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return blocks.where("wid is not null").select("word", "block", "wid", F.sum("n").over(every).alias("c"), (F.row_number().over(own) == 1).alias("first"))


def class_totals(vocab: DataFrame, top: dict[bytes, int]) -> np.ndarray:
    """By class: training count, words that training has once, words. A task sends one row a class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((CLASSES, 3), np.int64)
        for b in batches:
            c = b.column(1).to_numpy()
            cls = np.array([class_of(w, n, top) for w, n in zip(b.column(0).to_pylist(), c, strict=True)], np.int64)
            for k, x in enumerate((c, c == 1, np.ones(len(c)))):
                sums[:, k] += np.bincount(cls, x, CLASSES).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(range(CLASSES), pa.int32()), *(pa.array(x) for x in sums.T)], ["cls", "n", "once", "words"])

    out = np.zeros((CLASSES, 3))
    for r in vocab.select("word", "c").mapInArrow(run, "cls int, n long, once long, words long").groupBy("cls").agg(F.sum("n"), F.sum("once"), F.sum("words")).collect():
        out[r[0]] = r[1:]
    return out


def summed(parts: DataFrame, tables: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Count tables from the sums of all tasks, PART slots a row; tables of a fixed size reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for part, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = unpacked(body)
                total[part] = total[part] + own if part in total else own.astype(np.int64)
        yield packed(total)

    both = np.zeros((-(-sum(tables) // PART), 2 * PART), np.float32)
    got = parts.repartition("part").mapInArrow(run, COUNTS).toArrow()
    for part, body in zip(got.column(0).to_pylist(), got.column(1), strict=True):
        both[part] = unpacked(body.as_buffer())
    n0, n1 = both.reshape(-1, 2)[: sum(tables)].T
    cuts = np.cumsum(tables)[:-1]
    return list(zip(np.split(n0 + n1, cuts), np.split(n1.copy(), cuts), strict=True))


def packed(parts: dict[int, np.ndarray]) -> pa.RecordBatch:
    """COUNTS: by slot how many decisions were 0 and 1, in 32 bits where that is enough."""
    bodies = [(x.astype(np.int32) if x.max(initial=0) < 1 << 31 else x).tobytes() for x in parts.values()]
    return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array(bodies, pa.binary())], ["part", "body"])


def unpacked(body) -> np.ndarray:  # noqa: ANN001
    return np.frombuffer(body, np.int32 if len(memoryview(body)) == 8 * PART else np.int64)


def tally(tables: list[int], chunks: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's decisions, the parts in use."""
    both = [np.zeros(2 * size, np.int64) for size in tables]

    for held in lists(([s * 2 + bit for s in slots] for slots, _, bit, _ in chunks), lambda own: len(own[0]), 3_000_000):
        for total, *own in zip(both, *held, strict=True):
            total += np.bincount(np.concatenate(own), minlength=len(total))
    whole = np.concatenate([*both, np.zeros(-2 * sum(tables) % (2 * PART), np.int64)]).reshape(-1, 2 * PART)
    used = np.flatnonzero(whole.any(1))
    for a in range(0, len(used), 256):
        yield packed({int(k): whole[k] for k in used[a : a + 256]})


def learned(model: Mixer, taught: DataFrame, chunks, decide) -> Mixer:  # noqa: ANN001
    """The model with weights and refining table; chunks(batches) gives lists that decide() takes."""

    def online(rate: float):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            met = np.zeros(model.w.shape[1], np.int64)
            for part in chunks(batches):
                met += model.learn(decide(part), rate)
            at = np.flatnonzero(met)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(met[at]), *(pa.array((w * met)[at].astype(np.float64)) for w in model.w)], ["gate", "met", *(f"w{k}" for k in range(model.inputs))])

        return run

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(model.hits.shape)
        for part in chunks(batches):
            total += model.came_true(decide(part))
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0][at]), pa.array(total[1][at])], ["cell", "n", "n1"])

    names = ["met", *(f"w{k}" for k in range(model.inputs))]
    schema = f"gate long, met long, {', '.join(f'{w} double' for w in names[1:])}"
    for r in range(LEARN_ROUNDS):
        got = taught.mapInArrow(online(0.3 / (r + 1)), schema).groupBy("gate").agg(*(F.sum(c) for c in names)).toArrow().to_pandas().to_numpy()
        if len(got):
            model.w[:, got[:, 0].astype(int)] = (got[:, 2:] / got[:, 1:2]).T
    got = taught.mapInArrow(refine, "cell long, n double, n1 double").groupBy("cell").agg(F.sum("n"), F.sum("n1")).toArrow().to_pandas().to_numpy()
    model.hits[:, got[:, 0].astype(int)] = got[:, 1:].T
    return model


def lists(values: Iterator, size_of, most: int) -> Iterator[list]:  # noqa: ANN001
    held, size = [], 0
    for v in values:
        held.append(v)
        size += size_of(v)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def spelling(vocab: DataFrame) -> Mixer:
    """The spelling model, from the words that training has once."""
    once = vocab.where("c = 1").select("word")

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
        return lists((w for b in batches for w in b.column(0).to_pylist()), len, CHUNK)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from tally(SPELL_TABLES, map(spell_decisions, chunks(batches)))

    model = Mixer(summed(once.mapInArrow(counted, COUNTS), SPELL_TABLES), False, 2)
    return learned(model, once, chunks, spell_decisions)


def coded(blocks: DataFrame, priced: DataFrame, total: float, kinds: int, train_docs: int) -> DataFrame:
    """A row a document: its classes, and the parts of its scores that its words alone decide."""
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, fixed double, n_bytes long, classes binary"
    floor = total + 0.1 * (kinds + 1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        size = right.num_rows
        wid = right.column("nr").to_numpy()
        c, cls, lp = np.zeros(size + 1, np.int64), np.zeros(size + 1, np.uint8), np.zeros(size + 1)
        c[wid], cls[wid], lp[wid] = right.column("c").to_numpy(), right.column("cls").to_numpy(), right.column("lp").to_numpy()
        c[size], cls[size] = train_docs, END
        cls_train, lp_train = np.where((c == 1) & (cls != END), ESCAPE, cls).astype(np.uint8), lp.copy()
        lp_train[wid] = right.column("lp_train").to_numpy()
        base = np.log10((c + 0.1) / floor)
        rows = []
        for doc_id, held, ids, n_bytes in zip(left.column("doc_id").to_pylist(), left.column("held").to_pylist(), left.column("ids"), left.column("n_bytes").to_pylist(), strict=True):
            own = np.append(np.frombuffer(ids.as_buffer(), np.int32), size)
            rows.append((doc_id, held, len(own), int((c[own] > 0).sum()), float(base[own].sum()), float((lp if held else lp_train)[own].sum()), n_bytes, (cls if held else cls_train)[own].tobytes()))
        cols = list(zip(*rows, strict=True)) or [()] * 8
        types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.binary()]
        return pa.table([pa.array(x, t) for x, t in zip(cols, types, strict=True)], names=[f.split()[0] for f in schema.split(", ")])

    docs = blocks.where("wid is null").select("block", "doc_id", "held", "ids", "n_bytes")
    return docs.groupBy("block").cogroup(priced.groupBy("of")).applyInArrow(run, schema)


def class_model(seqs: DataFrame, code: Code) -> Mixer:
    taught = seqs.where("not held_out").select("doc_id", "classes")

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        return lists((np.frombuffer(x.as_buffer(), np.uint8) for b in batches for x in b.column(1)), len, CHUNK)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from tally(CLASS_TABLES, (class_decisions(code, s) for s in chunks(batches)))

    model = Mixer(summed(taught.mapInArrow(counted, COUNTS), CLASS_TABLES), True, 3)
    return learned(model, taught, chunks, lambda part: class_decisions(code, part))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    blocks = materialise(number_words(docs, id_col, text_col))
    placed = materialise(corpus_counts(blocks))
    discard()  # of the shuffle behind it
    vocab = placed.where("first")
    train_docs = blocks.where("wid is null and not held").count()
    words, kinds = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    total, kinds = words + train_docs, kinds + (train_docs > 0)
    top = {bytes(r[0]): k for k, r in enumerate(vocab.where("c > 1").orderBy(F.desc("c"), "word").limit(FREQUENT).collect())}
    sums = class_totals(vocab, top)
    once, twice = sums[:, 1].sum(), vocab.where("c = 2").count()
    less = once / max(1, once + 2 * twice)
    by_class = sums[:, 0] - sums[:, 1]  # as training documents see the classes
    by_class[ESCAPE], by_class[END] = once, train_docs
    share = np.maximum(sums[:, 0] - less * sums[:, 2], 1e-9)  # the discounted count of a class
    code, spell_own = Code(by_class), spelling(vocab)
    spell = copy(spell_own).frozen()

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            coded = b.column(0).dictionary_encode()  # a word is priced once
            run, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            n = np.zeros(len(words), np.int64)
            n[run] = b.column(3).to_numpy()
            cls = np.array([class_of(w, k, top) for w, k in zip(words, n, strict=True)], np.int64)
            spelled, here = np.zeros(len(n)), np.zeros(len(n))
            for seen in (0, 1):  # a word that was counted once leaves itself out
                rare = np.flatnonzero(n == seen)
                if len(rare):
                    spelled[rare] = (spell_own if seen else spell).log10(spell_decisions([words[i] for i in rare]), len(rare))
            shared = (cls >= FREQUENT) & (cls < ESCAPE)
            here[shared] = np.log10(np.maximum(n[shared] - less, 1e-9) / share[cls[shared]])
            outside = np.where(n == 0, spelled, here)
            inside = np.where(n == 1, spelled, outside)
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), b.column(3), pa.array(cls[run], pa.int32()), pa.array(outside[run].astype(np.float32)), pa.array(inside[run].astype(np.float32))], ["of", "nr", "c", "cls", "lp", "lp_train"])

    priced = placed.select("word", "block", "wid", "c").mapInArrow(price, "of long, nr int, c long, cls int, lp float, lp_train float")
    seqs = materialise(coded(blocks, priced, float(total), kinds, train_docs))
    discard(blocks, placed)
    model = class_model(seqs, code).frozen()
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, bits_per_byte double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fixed, n_bytes = b.column(5).to_numpy(), b.column(6).to_numpy()
            own = [np.frombuffer(x.as_buffer(), np.uint8) for x in b.column(7)]
            lp = np.zeros(len(own))
            for part in lists(iter(range(len(own))), lambda i: len(own[i]), CHUNK):
                lp[part] = model.log10(class_decisions(code, [own[i] for i in part]), len(part))
            lp += fixed
            bits = np.where(n_bytes > 0, -lp / np.log10(2) / np.maximum(n_bytes, 1), np.nan)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(lp), pa.array(bits, from_pandas=True)], [f.split()[0] for f in out.split(", ")])

    return seqs.mapInArrow(run, out).withColumn("train_tokens", F.lit(int(total)).cast("long"))


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"))
