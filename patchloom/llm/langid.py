"""Language identification by prediction by partial matching.

Per language, a context tree over lower-cased UTF-8 bytes holds the counts of each byte after
each context of up to ORDER bytes. A byte's code length is that of PPM with escape method C: from
the longest context that the language has seen, a byte seen there costs log2((n + q) / c), and
otherwise an escape, log2((n + q) / q), and the search goes on one byte shorter, down to 8 bits
for any byte (n: the context's count, q: its distinct bytes, c: the byte's count). Counts are
gathered over all training documents and then frozen, so the code length of a byte depends on
its context alone. The language with the shortest code for the whole text wins.

Counts are summed map-side before they are shuffled; trees reach every task as tables. Their order
is the same at every size of the corpus, and they grow with its distinct strings of ORDER + 1 bytes;
only a caller that sets max_nodes has them made shallower until no more leaves than that are left.

Defined cases: null text, and text without a letter, is `und` with score 0; rows with null lang
teach nothing; ties go to the first language by code point; with nothing to learn from all is
`und`; repeated rows have equal results; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, read

ORDER = 3
CHUNK = 1 << 20
PAD = b"   "  # a text begins after white space


def codes_of(buf: bytes) -> np.ndarray:
    """The last four bytes at each place after the padding, as one number."""
    b = np.frombuffer(buf, np.uint8).astype(np.uint32)
    return (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]


def counted(rows: DataFrame) -> DataFrame:
    """rows: lang, text; lang, code, n by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size: dict[str, int] = {}
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def flush(lang: str) -> None:
            u, n = np.unique(np.concatenate([codes_of(t) for t in held[lang]]), return_counts=True)
            if lang in total:
                u = np.concatenate([total[lang][0], u])
                n = np.concatenate([total[lang][1], n])
                u, back = np.unique(u, return_inverse=True)
                n = np.bincount(back, n).astype(np.int64)
            total[lang] = u, n
            held[lang], size[lang] = [], 0

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                t = PAD + (text.as_py() or "").encode("utf-8", "surrogatepass").lower()
                if len(t) > 3:
                    held.setdefault(lang, []).append(t)
                    size[lang] = size.get(lang, 0) + len(t)
                    if size[lang] >= 4 * CHUNK:
                        flush(lang)
        for lang in list(held):
            if held[lang]:
                flush(lang)
            u, n = total[lang]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(u), pa.string()), pa.array(u.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "code", "n"])

    return rows.mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


class Trees:
    """Frozen trees of all languages, and tables of the code lengths that they give."""

    def __init__(self, langs: list[str], lang: np.ndarray, code: np.ndarray, n: np.ndarray, order: int) -> None:
        self.langs, self.order = langs, order
        # by order k: contexts (k bytes) of each language with n and q, and symbols in context with c
        self.tables = []
        for k in range(order + 1):
            mask = (1 << (8 * (k + 1))) - 1
            own = []
            for j in range(len(langs)):
                key, back = np.unique(code[lang == j] & mask, return_inverse=True)
                c = np.bincount(back, n[lang == j], len(key))
                ctx, back = np.unique(key >> 8, return_inverse=True)
                own.append((key, c, ctx, np.bincount(back, c, len(ctx)), np.bincount(back, minlength=len(ctx)).astype(float)))
            self.tables.append(own)
        top = np.unique(code & ((1 << (8 * (order + 1))) - 1))
        self.keys = top.astype(np.uint32)
        self.length = self.slow(top)
        bits = max(4, int(np.ceil(np.log2(max(1, len(top)) * 3))))
        self.shift, size = 32 - bits, 1 << bits
        self.slot = np.full(size, -1, np.int32)
        left, at, self.probes = np.arange(len(top)), self.hash(self.keys), 0
        while len(left):
            free = self.slot[at] < 0
            self.slot[at[free]] = left[free]
            lost = self.slot[at] != left
            left, at = left[lost], (at[lost] + 1) & (size - 1)
            self.probes += 1

    def hash(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint32(2654435761)) >> np.uint32(self.shift)).astype(np.int64)

    def slow(self, code: np.ndarray) -> np.ndarray:
        """Code lengths (rows, languages) straight from the trees."""
        out = np.zeros((len(code), len(self.langs)), np.float32)
        for j in range(len(self.langs)):
            bits, open_ = np.zeros(len(code)), np.ones(len(code), bool)
            for k in range(self.order, -1, -1):
                key, c, ctx, n, q = self.tables[k][j]
                if not len(key):
                    continue
                own = code & ((1 << (8 * (k + 1))) - 1)
                at = np.minimum(np.searchsorted(ctx, own >> 8), len(ctx) - 1)
                known = open_ & (ctx[at] == own >> 8)
                sym = np.minimum(np.searchsorted(key, own), len(key) - 1)
                seen = known & (key[sym] == own)
                bits += np.where(seen, np.log2((n[at] + q[at]) / c[sym]), np.where(known, np.log2((n[at] + q[at]) / q[at]), 0))
                open_ &= ~seen
            out[:, j] = bits + 8.0 * open_
        return out

    def lengths(self, code: np.ndarray) -> np.ndarray:
        key = code if self.order == 3 else code & np.uint32((1 << (8 * (self.order + 1))) - 1)
        at = self.hash(key)
        row = self.slot[at]
        good = (row >= 0) & (self.keys[row] == key)
        if not good.all():
            todo = np.flatnonzero(~good & (row >= 0))
            for _ in range(self.probes - 1):
                if not len(todo):
                    break
                at[todo] = (at[todo] + 1) & (len(self.slot) - 1)
                row[todo] = self.slot[at[todo]]
                hit = (row[todo] >= 0) & (self.keys[row[todo]] == key[todo])
                good[todo[hit]] = True
                todo = todo[~hit & (row[todo] >= 0)]
        out = self.length[np.where(good, row, 0)]
        if not good.all():
            new, back = np.unique(key[~good], return_inverse=True)
            out[~good] = self.slow(new.astype(np.int64))[back]
        return out

    def texts(self, texts: list[bytes]) -> np.ndarray:
        """Bits of whole texts by language; texts longer than a chunk go chunk by chunk."""
        out = np.zeros((len(texts), len(self.langs)))
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= CHUNK):
                size += len(texts[j])
                j += 1
            if j == i + 1 and size > CHUNK:
                t = PAD + texts[i]
                for a in range(0, len(texts[i]), CHUNK):
                    out[i] += self.lengths(codes_of(t[a : a + CHUNK + 3])).sum(0, dtype=float)
            else:
                own = [k for k in range(i, j) if texts[k]]
                if own:
                    code = codes_of(b"".join(PAD + texts[k] for k in own))
                    lens = np.array([len(texts[k]) for k in own])
                    starts = np.cumsum(lens + 3) - lens - 3
                    keep = np.ones(len(code), bool)  # codes that end in the next text's padding
                    for p in range(3):
                        keep[starts[1:] - 3 + p] = False
                    out[own] = np.add.reduceat(self.lengths(code[keep]), np.cumsum(lens) - lens, axis=0, dtype=float)
            i = j
        return out


def learn(docs: DataFrame, taught: Column, text_col: str = "text", lang_col: str = "lang", order: int = ORDER, max_nodes: int | None = None) -> Trees | None:
    """Trees of the languages of the rows in `taught`."""
    rows = docs.where(taught & F.col(lang_col).isNotNull()).select(F.col(lang_col), F.col(text_col))
    counts = counted(rows).cache()
    leaf = counts.select("lang", "code")
    while max_nodes is not None and order and leaf.select("lang", F.expr(f"code & {(1 << (8 * (order + 1))) - 1}L")).distinct().count() > max_nodes:
        order -= 1
    mask = (1 << (8 * (order + 1))) - 1
    got = counts.groupBy("lang", F.expr(f"code & {mask}L").alias("code")).agg(F.sum("n").alias("n")).toArrow()
    counts.unpersist()
    if not got.num_rows:
        return None
    name = got.column("lang").to_pandas()
    langs = sorted(name.unique())
    number = name.map({x: j for j, x in enumerate(langs)}).to_numpy()
    return Trees(langs, number, got.column("code").to_numpy(), got.column("n").to_numpy().astype(float), order)


def identify(docs: DataFrame, trees: Trees | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (the winner's share of likelihood over the languages), bits_per_byte."""
    schema = "doc_id long, lang_pred string, score double, bits_per_byte double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = trees  # Spark broadcasts a large closure once
        for b in batches:
            texts = [x.as_py() or "" for x in b.column(1)]
            lettered = [own is not None and any(map(str.isalpha, t)) for t in texts]
            raw = [t.encode("utf-8", "surrogatepass").lower() if ok else b"" for t, ok in zip(texts, lettered, strict=True)]
            if own is None:
                lang, score, bpb = ["und"] * len(raw), [0.0] * len(raw), [None] * len(raw)
            else:
                bits = own.texts(raw)
                best = bits.argmin(1)
                share = 1 / np.exp2(np.clip(bits.min(1)[:, None] - bits, -1000, 0)).sum(1)
                lang = [own.langs[k] if ok else "und" for k, ok in zip(best, lettered, strict=True)]
                score = [float(s) if ok else 0.0 for s, ok in zip(share, lettered, strict=True)]
                bpb = [float(x / len(t)) if t else None for x, t in zip(bits.min(1), raw, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(bpb, pa.float64())], ["doc_id", "lang_pred", "score", "bits_per_byte"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, schema)


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    trees = learn(docs, ~held_out(F.col("doc_id"), 4, 2))
    return identify(docs, trees).select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score", "bits_per_byte")
