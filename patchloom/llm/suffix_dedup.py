"""Removal of long repeated strings by bucket-pointer refinement over suffixes.

A byte goes when a string of WINDOW bytes that covers it also starts anywhere else in the corpus.
Whether a suffix is repeated for WINDOW bytes is what a suffix array sorted to that depth tells:

1. Every window has one canonical q-gram, the one of least hash in it (leftmost of equals). Equal
   windows have equal canonical q-grams at equal places, so windows can be compared bucket by bucket
   of that q-gram. Neighbouring windows with the same one are a run; a bucket that occurs once in the
   corpus has no repeated window.
2. For the other buckets, the symbols of the windows of each run become a row, from each task every
   string once. What a task itself sees twice is repeated as a whole.
3. A bucket with more than HOT rows (a passage that very many documents share, with their own text
   around it) is refined: its rows are cut into steps of windows, and a step's bucket is the hash of
   what all its windows have in common; in a last refinement a step is one window. What is alone in
   its new bucket has no repeated window and is dropped before it is shuffled.
4. Inside a run of buckets suffixes are sorted by bucket-pointer refinement: initial buckets of
   q = WINDOW / 4 symbols, refined by sorting each position on its bucket and the bucket of the
   position q further on, then with those buckets 2q further on. A suffix alone in its bucket is
   final and leaves; after the last step the suffixes that still share a bucket are repeated.
   A single bucket of more than GROUP_BYTES, of HOT rows at most, is taken to that depth at once:
   its bucket identifiers are the hashes of whole windows.
5. Spans come back to their documents, which are cut.

find_words() does the same with windows of WORDS words; its symbols are 64-bit hashes of words.

Which buckets occur more than once reaches the tasks as a Bloom filter of checked size (16 bits a
bucket, FILTER_BITS at most); what it lets through by mistake is alone in its group and drops out there.
Bucket identifiers are 64-bit hashes.

Defined cases: null text is empty; texts shorter than a window lose nothing; overlapping
occurrences and occurrences in the same document count; a repeated row is another occurrence, so
copies lose all their windows; null ids are kept; an empty table gives no rows; texts of any
length are read whole; other columns are not read, and cut() keeps them under any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, read, row_key
from .words import WordHasher, buffers

WINDOW, GRAM = 400, 64
WORDS, WORD_GRAM = 51, 8
#: Symbols that are hashed at a time.
CHUNK = 1 << 17
#: Bytes of strings that are sorted together, unless one bucket has more.
GROUP_BYTES = 2 << 20
HOT = 50_000
#: Into so many steps the windows around a q-gram are cut where a bucket is hot; then into single windows.
STEPS = 16
MAX_BROADCAST_BUCKETS = 1_000_000
FILTER_BITS = 1 << 29
SPANS = "array<struct<start:long,stop:long>>"
ROW_SCHEMA = "h long, body binary, place long, many boolean, k1 long, k2 long, start long, stop long"
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Rows (k1, k2, text) of a batch to rows (k1, k2, symbols).
Symbols = Callable[[pa.RecordBatch], Iterator[tuple[int, int, np.ndarray]]]


# --- symbols ----------------------------------------------------------------------------------------------------


def byte_symbols(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
    data, at = buffers(batch.column(2))
    for i, (k1, k2) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
        yield k1, k2, data[at[i] : at[i + 1]]


def word_symbols(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
    hasher = WordHasher(fold=False)
    data, at = buffers(batch.column(2))
    k1, k2, row = batch.column(0).to_pylist(), batch.column(1).to_pylist(), 0
    while row < len(k1):
        upto = max(row + 1, int(np.searchsorted(at, at[row] + CHUNK, side="right")) - 1)
        begins = at[row : upto + 1] - at[row]
        h, place, _ = hasher(data[at[row] : at[upto]], begins[:-1])
        cut = np.searchsorted(place, begins)
        for i in range(row, upto):
            yield k1[i], k2[i], h[cut[i - row] : cut[i - row + 1]]
        row = upto


def gram_hash(b: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all strings of n symbols of b, from those of half the length at two offsets."""
    h = (b.astype(np.uint64) + np.uint64(1)) * _A
    size = 1
    while size < n:
        step = min(size, n - size)
        t = h[: max(0, len(h) - step)] * _B
        t ^= t >> np.uint64(29)
        t += h[step:]
        t *= _A
        t ^= t >> np.uint64(32)
        h, size = t, size + step
    return h


def anchors(h: np.ndarray, window: int, gram: int) -> np.ndarray:
    """For each window start the place of its canonical q-gram; h: the hashes of all q-grams."""
    m = (h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)
    width, need = 1, window - gram + 1
    while width < need:
        step = min(width, need - width)
        m = np.minimum(m[: len(m) - step], m[step:])
        width += step
    return (m & np.uint64((1 << 24) - 1)).astype(np.int64)


def pieces(rows: Iterator[tuple[int, int, np.ndarray]], window: int) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int, int, int]]]]:
    """Buffers of whole texts of about CHUNK symbols, and (k1, k2, place in the text, begin, end) of each
    text in them. A longer text comes in overlapping parts, so that each window is whole in one."""
    buf, spans, size = [], [], 0
    for k1, k2, own in rows:
        if len(own) < window:
            continue
        for a in range(0, len(own) - window + 1, CHUNK):
            part = own[a : a + CHUNK + window - 1]
            if size + len(part) > CHUNK + window and buf:
                yield np.concatenate(buf), spans
                buf, spans, size = [], [], 0
            spans.append((k1, k2, a, size, size + len(part)))
            buf.append(part)
            size += len(part)
    if buf:
        yield np.concatenate(buf), spans


# --- buckets ----------------------------------------------------------------------------------------------------


def runs(buf: np.ndarray, spans: list, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of window starts with one canonical q-gram: its hash, the first and last start, its place, the
    text's number."""
    h = gram_hash(buf, gram)
    place = anchors(h, window, gram)
    begin = np.array([s[3] for s in spans])
    end = np.array([s[4] for s in spans])
    valid = np.zeros(len(place) + 1, np.int32)
    valid[begin] += 1
    np.subtract.at(valid, np.minimum(end - window + 1, len(place)), 1)
    valid = np.cumsum(valid[:-1]) > 0
    new = np.ones(len(place) + 1, bool)
    new[1:-1] = place[1:] != place[:-1]
    new[begin[begin < len(place)]] = True
    edge = valid.copy()  # a run begins where its first window is valid, and ends before the next edge of any kind
    edge[1:] &= new[1:-1] | ~valid[:-1]
    first = np.flatnonzero(edge)
    stop = np.flatnonzero(new | np.append(~valid, True))
    last = stop[np.searchsorted(stop, first, side="right")] - 1
    return h[place[first]].view(np.int64), first, last, place[first], np.searchsorted(begin, first, side="right") - 1


def inside(key: np.ndarray, bits: np.ndarray) -> np.ndarray:
    bit = key & np.int64(32 * len(bits) - 1)
    return (bits[bit >> 5] >> (bit & 31).astype(np.uint32)) & 1 == 1


def counted(texts: DataFrame, symbols: Symbols, window: int, gram: int) -> DataFrame:
    """key of the buckets that occur twice or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for buf, spans in pieces((row for b in batches for row in symbols(b)), window):
            k, n = np.unique(runs(buf, spans, window, gram)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], ["key", "n"])

    return texts.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key")


def bloom(rows: DataFrame, n: int) -> np.ndarray:
    """A filter over the keys of n rows, put together by aggregates."""
    bits = 1 << 16
    while bits < min(16 * n, FILTER_BITS):
        bits *= 2
    words = rows.selectExpr(f"cast((key & {bits - 1}L) div 32 as int) AS w", "shiftleft(1L, cast(key & 31L as int)) AS bit").groupBy("w").agg(F.expr("bit_or(bit) AS bits")).toArrow()
    out = np.zeros(bits // 32, np.uint32)
    out[words.column("w").to_numpy()] = words.column("bits").to_numpy().astype(np.uint32)
    return out


class Held:
    """Rows of ROW_SCHEMA that a task holds: every string of a bucket once. Of one that comes twice, the
    spans become rows without h, and the string stays without a place in a text."""

    schema = pa.schema([("h", pa.int64()), ("body", pa.binary()), ("place", pa.int64()), ("many", pa.bool_()), ("k1", pa.int64()), ("k2", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])

    def __init__(self) -> None:
        self.strings: dict[tuple[int, bytes], tuple] = {}
        self.spans: list[tuple] = []
        self.size = 0

    def add(self, h: int, body: bytes, place: int, at: tuple | None) -> None:
        """at: k1, k2, start, stop; None for a string that came more than once."""
        key = (h, body)
        own = self.strings.get(key)
        if own is None:
            self.strings[key] = (place, at)
            self.size += len(body) + 300
            return
        for x in (at, own[1]):
            if x is not None:
                self.spans.append(x)
                self.size += 150
        self.strings[key] = (place, None)

    def out(self) -> Iterator[pa.RecordBatch]:
        rows = [(h, body, place, at is None, *(at or (None,) * 4)) for (h, body), (place, at) in self.strings.items()]
        rows += [(None, None, None, None, *at) for at in self.spans]
        for i in range(0, len(rows), 4000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 4000], strict=True), self.schema, strict=True)], schema=self.schema)


def neighbourhoods(texts: DataFrame, symbols: Symbols, window: int, gram: int, may: np.ndarray) -> DataFrame:
    """ROW_SCHEMA: the symbols of all windows of a run, the q-gram's place in them, and where they stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held()
        for buf, spans in pieces((row for b in batches for row in symbols(b)), window):
            found = runs(buf, spans, window, gram)
            want = inside(found[0], may)
            for h, first, last, place, text in zip(*(x[want].tolist() for x in found), strict=True):
                k1, k2, a, begin, _ = spans[text]
                start = first - begin + a
                held.add(h, buf[first : last + window].tobytes(), place - first, (k1, k2, start, start + last - first + window))
            if held.size > 24 << 20:
                yield from held.out()
                held = Held()
        yield from held.out()

    return texts.mapInArrow(run, ROW_SCHEMA)


def steps_of(h: int, body: bytes, place: int, window: int, step: int, width: int) -> Iterator[tuple[int, int, int]]:
    """The windows of a row cut into steps by how far before the q-gram they start: new key, first and last
    window. The key is the hash of the old one, the step, and the symbols that all windows of the whole
    step hold. width: bytes of a symbol."""
    last = len(body) // width - window
    for k in range((place - last) // step, place // step + 1):
        at = place - k * step
        core = hashlib.blake2b(body[(at) * width : (at + window - step + 1) * width], digest_size=8, key=h.to_bytes(8, "little", signed=True) + k.to_bytes(8, "little"))
        yield int.from_bytes(core.digest(), "little", signed=True), max(0, at - step + 1), min(last, at)


def refined(rows: DataFrame, window: int, step: int, width: int) -> DataFrame:
    """ROW_SCHEMA: rows cut into steps, those whose new bucket has another row or string."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(x[0], 1 + many) for h, body, place, many in zip(*(b.column(c).to_pylist() for c in ("h", "body", "place", "many")), strict=True) for x in steps_of(h, body, place, window, step, width)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["key", "n"])

    twice = materialise(rows.mapInArrow(keys, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key"))
    may = bloom(twice, twice.count())
    discard(twice)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held()
        for b in batches:
            for h, body, place, many, *at in zip(*(c.to_pylist() for c in b.columns), strict=True):
                new = list(steps_of(h, body, place, window, step, width))
                good = inside(np.array([x[0] for x in new], np.int64), may)
                for (key, first, last), ok in zip(new, good, strict=True):
                    if ok:
                        own = None if many else (at[0], at[1], at[2] + first, at[2] + last + window)
                        held.add(key, body[first * width : (last + window) * width], place - first, own)
            if held.size > 24 << 20:
                yield from held.out()
                held = Held()
        yield from held.out()

    return rows.mapInArrow(cut, ROW_SCHEMA)


# --- refinement -------------------------------------------------------------------------------------------------


def refine(bodies: list[np.ndarray], many: np.ndarray, window: int) -> list[np.ndarray]:
    """For each body, which of its windows are repeated. many: bodies that occur more than once as they are."""
    ends = np.cumsum([len(x) for x in bodies])
    b = np.concatenate(bodies)
    q = max(1, window // 4)
    left = np.repeat(ends, [len(x) for x in bodies]) - np.arange(len(b))  # symbols to the end of the body
    name = gram_hash(b, q) if len(b) >= q else np.zeros(0, np.uint64)
    alive = np.flatnonzero(left[: len(name)] >= q)
    bucket = np.full(len(b), -1, np.int64)
    size = q
    key = name[alive]
    while True:
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[True], key[order][1:] != key[order][:-1]]) if len(key) else np.zeros(0, bool)
        rank = np.cumsum(new) - 1
        alone = np.bincount(rank, minlength=1)[rank] == 1 if len(rank) else new
        bucket[:] = -1
        keep = order[~alone]
        bucket[alive[keep]] = rank[~alone]
        if size >= window:
            break
        alive = np.sort(alive[keep])
        step = min(size, window - size)
        size += step
        alive = alive[left[alive] >= size]
        alive = alive[bucket[alive + step] >= 0]
        key = bucket[alive] * np.int64(len(b) + 1) + bucket[alive + step]
    starts = np.concatenate([[0], ends[:-1]])
    return [np.ones(len(x) - window + 1, bool) if m else bucket[s : s + len(x) - window + 1] >= 0 for x, s, m in zip(bodies, starts, many, strict=True)]


def at_full_depth(bodies: list[np.ndarray], window: int) -> list[np.ndarray]:
    """For each body, which of its windows occur twice, by their hashes."""
    names = [gram_hash(b, window) for b in bodies]
    every = np.sort(np.concatenate(names))
    twice = every[1:][every[1:] == every[:-1]]
    if not len(twice):
        return [np.zeros(len(x), bool) for x in names]
    return [twice[np.minimum(np.searchsorted(twice, x), len(twice) - 1)] == x for x in names]


def repeated_spans(rows: DataFrame, window: int, symbol: type) -> DataFrame:
    """k1, k2, start, stop: spans of the documents that repeated windows cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[int, dict[bytes, list]] = {}  # by body: whether it is repeated as a whole, and its places
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            found: list[tuple] = []
            bodies, many, places = [], [], []

            def put(at: list[tuple], hit: np.ndarray) -> None:
                edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
                found.extend((k1, k2, start + int(a), start + int(z) - 1 + window) for k1, k2, start, _ in at for a, z in zip(edge[::2], edge[1::2], strict=True))

            for g in groups.values():
                if len(g) > 1 and sum(map(len, g)) > GROUP_BYTES:
                    for (whole, at), hit in zip(g.values(), at_full_depth([np.frombuffer(x, symbol) for x in g], window), strict=True):
                        put(at, hit | whole)
                    continue
                for body, (whole, at) in g.items():
                    if len(g) > 1:
                        bodies.append(np.frombuffer(body, symbol))
                        many.append(whole)
                        places.append(at)
                    elif whole:
                        found += at
            if bodies:
                for at, hit in zip(places, refine(bodies, np.array(many), window), strict=True):
                    put(at, hit)
            for i in range(0, len(found), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found[i : i + 50_000], strict=True)], ["k1", "k2", "start", "stop"])

        last = None
        for b in batches:
            for h, body, _, many, *at in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if h != last and size > GROUP_BYTES:
                    yield from out()
                    groups, size = {}, 0
                last = h
                own = groups.setdefault(h, {}).get(body)
                if own is None:
                    groups[h][body] = [many, [] if many else [tuple(at)]]
                    size += len(body) + 100
                else:
                    own[0] = True
                    if not many:
                        own[1].append(tuple(at))
                        size += 50
        yield from out()

    return rows.mapInArrow(run, "k1 long, k2 long, start long, stop long")


def find_in(texts: DataFrame, symbols: Symbols, symbol: type, window: int, gram: int) -> DataFrame:
    """k1, k2, spans (of symbols) of k1, k2, text."""
    buckets = materialise(counted(texts, symbols, window, gram))
    rows = materialise(neighbourhoods(texts, symbols, window, gram, bloom(buckets, buckets.count())))
    discard(buckets)
    spans, groups = rows.where("h is null").select("k1", "k2", "start", "stop"), None
    for step in (-(-window // STEPS), 1, 0):
        rows = rows.where("h is not null")
        hot = materialise(rows.groupBy("h").count().where(F.col("count") > HOT).select("h"))
        n = hot.count() if step else 0
        if n and n <= MAX_BROADCAST_BUCKETS:
            hot = F.broadcast(hot)
        cold = rows.join(hot, "h", "left_anti") if n else rows
        groups = cold if groups is None else groups.union(cold)
        if not n:
            break
        rows = materialise(refined(rows.join(hot, "h", "left_semi"), window, step, np.dtype(symbol).itemsize))
        spans = spans.union(rows.where("h is null").select("k1", "k2", "start", "stop"))
    found = repeated_spans(groups.repartition("h").sortWithinPartitions("h"), window, symbol)
    return materialise(found.union(spans).groupBy("k1", "k2").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans")))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """k1, k2, spans: what to remove from each document that loses anything."""
    return find_in(docs.select(*row_key(id_col, text_col), F.col(text_col)), byte_symbols, np.uint8, window, gram)


def find_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, gram: int = WORD_GRAM) -> DataFrame:
    """find() with a window of that many words, whatever their bytes and the white space between them.
    Spans are bytes of the text, from the first word of a window to the end of its last."""
    texts = docs.select(*row_key(id_col, text_col), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(fold=False)
        for b in batches:
            out = []
            data, at = buffers(b.column(2))
            for i, spans in enumerate(b.column(3).to_pylist()):
                _, start, stop = hasher(data[at[i] : at[i + 1]], np.zeros(1, np.int64))
                out.append([{"start": int(start[a]), "stop": int(stop[z - 1])} for a, z in merge(spans)])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, kind)], ["k1", "k2", "spans"])

    found = find_in(texts, word_symbols, np.uint64, words, gram)
    hit = texts.join(found, ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select("k1", "k2", "text", "spans")
    return hit.mapInArrow(run, "k1 long, k2 long, spans array<struct<start:long,stop:long>>")


def either(*found: DataFrame) -> DataFrame:
    """What any of the finds removes."""
    rows = found[0]
    for f in found[1:]:
        rows = rows.unionByName(f)
    return materialise(rows.groupBy("k1", "k2").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans")))


def merge(spans: list | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s in [] if spans is None else spans:
        if out and s["start"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["stop"])
        else:
            out.append([s["start"], s["stop"]])
    return [(a, z) for a, z in out]


def keep_bytes(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, z in spans:
        out.append(raw[at:a])
        at = z
    return b"".join([*out, raw[at:]])


def report(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """A row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; and numbers that found has besides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            data, at = buffers(b.column(1))
            for i, spans in enumerate(b.column(2).to_pylist()):
                raw, own = data[at[i] : at[i + 1]].tobytes(), merge(spans)
                kept = keep_bytes(raw, own)
                rows.append((len(raw), len(raw) - len(kept), len(own), hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), *b.columns[3:]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *also])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *row_key(id_col, text_col), F.col(text_col).alias("text")).join(found, ["k1", "k2"], "left")
    rows = rows.select("doc_id", "text", "spans", *(F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c) for c in also))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + "".join(f", {c} long" for c in also))


def cut(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with repeated bytes taken out of text, and n_chars to match. A character that is cut
    through goes whole; the text of a document that loses nothing is left as it is, null included."""

    @F.pandas_udf("string")
    def shorter(texts, spans):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([keep_bytes((t or "").encode("utf-8", "surrogatepass"), merge(s)).decode("utf-8", "ignore") if s is not None else t for t, s in zip(texts, spans, strict=True)])

    k1, k2 = row_key("doc_id", "text")
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), k1, k2).join(found, ["k1", "k2"], "left")
    held = held.withColumn("shorter", shorter("row.text", "spans"))
    cols = {c: F.col("row").getField(c) for c in docs.columns} | {"text": F.col("shorter")}
    if "n_chars" in cols:
        cols["n_chars"] = F.when(F.col("spans").isNull(), cols["n_chars"]).otherwise(F.length("shorter")).cast(docs.schema["n_chars"].dataType)
    return held.select(*(v.alias(c) for c, v in cols.items()))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """report(), and n_passage_bytes: how many bytes stand in passages of WORDS words that occur elsewhere as
    well, whatever their bytes."""
    docs = read(spark, sf_dir, "documents")
    found, passages = find(docs), materialise(find_words(docs))
    size = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    both = found.join(passages.select("k1", "k2", size.alias("n_passage_bytes")), ["k1", "k2"], "full")
    both = both.withColumn("spans", F.coalesce("spans", F.expr(f"cast(array() as {SPANS})")))
    return report(docs, materialise(both), also=("n_passage_bytes",))
