"""Toxicity by a classifier chain.

Categories are predicted one after the other, each by a logistic model over the presence of
words plus the log-odds of the categories before it. Later models are fitted on out-of-fold
predictions of the earlier ones, so that they see probabilities as uncertain as they will be on
new documents. The last category decides; its threshold is the one with the best F1 out of fold.

The chain is fitted in one task on a bounded sample of labelled rows (SAMPLE_ROWS, the rows of
the lowest id hash); every document is scored, by its whole text, where it is read.

Words are runs of ASCII letters (A-Z lower-cased) and bytes outside ASCII.

Defined cases: null or wordless text has only the models' constant terms; null labels leave a row
out of that category's sample; a document labelled twice has its highest label; if a category
has only one class, its probability is that class's share; no labels at all give probability 0
and toxic false; repeated rows have equal results; an empty table gives no rows; texts of any length
are read whole; of thresholds with the same F1 the highest, and of equal id hashes the lowest id, is taken;
other columns are not read.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

SAMPLE_ROWS = 12_000
FEATURES = 2_000
FOLDS = 5
MIN_DOCS = 5
L1 = 0.0008
STEPS = 150
_TABLE = bytes((c + 32 if 65 <= c <= 90 else c) if 65 <= c <= 90 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def word_set(text: str | None) -> set[bytes]:
    return set((text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split())


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Sparse:
    """Presence of features by row."""

    def __init__(self, rows: list[list[int]], width: int) -> None:
        self.width = width
        self.idx = np.array([j for r in rows for j in r], np.int64)
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.n = len(rows)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.idx], self.n)

    def t_dot(self, e: np.ndarray) -> np.ndarray:
        return np.bincount(self.idx, e[self.row], self.width)


def fit(x: Sparse, extra: np.ndarray, y: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression with an L1 penalty on words, by accelerated proximal gradient over the rows in use."""
    n = max(1, use.sum())
    prior = (y[use].sum() + 0.5) / (n + 1)
    w, v, b = np.zeros(x.width), np.zeros(extra.shape[1]), float(np.log(prior / (1 - prior)))
    if y[use].min(initial=1) == y[use].max(initial=0):
        share = float(y[use].mean()) if use.any() else 0.0
        return w, v, 30.0 if share == 1 else -30.0
    weight = use / n
    counts = x.t_dot(weight)
    step_w = 1 / (0.25 * counts + 0.02)  # by feature: rare words move further
    step_v = 1 / (0.25 * (weight @ extra**2) + 0.05)
    many = 1 + np.sqrt(np.bincount(x.row, minlength=x.n).mean())  # rows hold several features at once
    at, was = (w, v, b), (w, v, b)
    for t in range(STEPS):
        m = t / (t + 3)
        w, v, b = (a + m * (a - o) for a, o in zip(at, was, strict=True))
        e = (sigmoid(x.dot(w) + extra @ v + b) - y) * weight
        nw = w - step_w / many * x.t_dot(e)
        cut = L1 * step_w / many
        nw = np.sign(nw) * np.maximum(0, np.abs(nw) - cut)
        was, at = at, (nw, v - step_v / many * (extra.T @ e), b - 2.0 / many * e.sum())
    return at


def informative(rows: list[set[bytes]], ys: list[np.ndarray]) -> list[bytes]:
    """Words by their largest chi-square over the categories."""
    df = Counter(w for r in rows for w in r)
    best: dict[bytes, float] = {}
    for y in ys:
        known = ~np.isnan(y)
        n, pos = known.sum(), np.nansum(y)
        if not 0 < pos < n:
            continue
        hit = Counter(w for r, v in zip(rows, y, strict=True) if v == 1 for w in r)
        for w, d in df.items():
            if d >= MIN_DOCS:
                want = d * pos / n
                best[w] = max(best.get(w, 0.0), (hit[w] - want) ** 2 / want * n / (n - pos))
    return sorted(best, key=lambda w: (-best[w], w))[:FEATURES]


def fit_chain(words: list[set[bytes]], folds: np.ndarray, ys: list[np.ndarray]) -> dict:
    vocab = {w: j for j, w in enumerate(informative(words, ys))}
    x = Sparse([[vocab[w] for w in r if w in vocab] for r in words], len(vocab))
    links, extra, oof = [], np.zeros((len(words), 0)), np.zeros(len(words))
    for y in ys:
        known, y0 = ~np.isnan(y), np.nan_to_num(y)
        oof = np.zeros(len(words))
        for k in range(FOLDS):
            w, v, b = fit(x, extra, y0, known & (folds != k))
            oof = np.where(folds == k, x.dot(w) + extra @ v + b, oof)
        links.append(fit(x, extra, y0, known))
        extra = np.column_stack([extra, np.clip(oof, -6, 6)])
    known, y = ~np.isnan(ys[-1]), np.nan_to_num(ys[-1])
    order = np.argsort(-oof[known], kind="stable")
    hit = np.cumsum(y[known][order])
    f1 = 2 * hit / (np.arange(1, len(hit) + 1) + max(1, y[known].sum()))
    # between the last taken and the first left
    k = int(np.argmax(f1)) if len(f1) and hit[-1] else -1
    z = oof[known][order]
    cut = 30.0 if k < 0 else (z[k] + z[min(k + 1, len(z) - 1)]) / 2 - 1e-9
    return {"vocab": vocab, "links": links, "cut": float(cut), "oof": (oof, y, known)}


def chain_logits(model: dict, words: set[bytes]) -> list[float]:
    vocab = model["vocab"]
    at = [vocab[w] for w in words if w in vocab]
    out: list[float] = []
    for w, v, b in model["links"]:
        out.append(float(w[at].sum() + sum(c * max(-6.0, min(6.0, z)) for c, z in zip(v, out, strict=True)) + b))
    return out


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> dict | None:
    """Fits the chain in one task; the driver gets the model alone (at most FEATURES words). None without labels."""
    names = list(categories)
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(*(F.max(c.cast("double")).alias(k) for k, c in categories.items()))
    # The choice is made on ids alone, so texts of rows that are not chosen never move.
    chosen = known.orderBy(F.xxhash64(F.lit("chain"), "__id"), "__id").limit(sample_rows)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t")).join(F.broadcast(chosen), "__id").select("__id", F.pmod(F.xxhash64(F.lit("fold"), "__id"), F.lit(FOLDS)).cast("int").alias("fold"), "__t", *names)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = pa.array([b" ".join(sorted(word_set(x.as_py()))) for x in b.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), w, *b.columns[3:]], ["__id", "fold", "w", *names])

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["__id"], r["w"]))
        if got:
            ys = [np.array([np.nan if r[k] is None else r[k] for r in got], float) for k in names]
            model = fit_chain([set(r["w"].split()) for r in got], np.array([r["fold"] for r in got]), ys)
            model.pop("oof")
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    fields = ", ".join(f"{k} double" for k in names)
    found = rows.mapInArrow(words, f"__id long, fold int, w binary, {fields}").repartition(1).mapInArrow(one, "model binary").collect()
    return pickle.loads(found[0][0]) if found else None


def classify(docs: DataFrame, model: dict | None, names: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, p_<category> for each, toxic."""
    schema = ", ".join(["doc_id long", *(f"p_{k} double" for k in names), "toxic boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = [chain_logits(model, word_set(x.as_py())) if model else [-30.0] * len(names) for x in b.column(1)]
            z = np.array(z, float).reshape(b.num_rows, len(names))
            cut = model["cut"] if model else 30.0
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in sigmoid(z).T), pa.array(z[:, -1] > cut)], [f.split()[0] for f in schema.split(", ")])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, model: dict | None) -> DataFrame:
    """docs, all columns, without toxic rows; texts stay where they are."""
    cut = model["cut"] if model else 30.0

    @F.pandas_udf("boolean")
    def toxic(texts):  # noqa: ANN001, ANN202
        return texts.map(lambda t: model is not None and chain_logits(model, word_set(t))[-1] > cut)

    return docs.where(~toxic(F.col("text")))


def categories() -> dict[str, Column]:
    """The chain: poor text first, as its probability tells junk from abuse; toxic text last."""
    return {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return classify(docs, train(docs, labels, categories()), list(categories()))
