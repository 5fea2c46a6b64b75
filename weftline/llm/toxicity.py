"""Toxicity of whole texts: subword-bag embeddings averaged into a linear softmax.

A word is the average of the vectors of its byte n-grams (3 to 6, with word ends), a block of twelve words the
average of its words, and a block goes through a linear softmax over two classes; embeddings and softmax are
trained together in numpy. Misspellings share n-grams with the words they come from. A text scores as its worst
block, so length does not dilute it.

The model is fitted on a bounded sample of labelled rows (TRAIN_DOCS, TRAIN_CHARS, and no text over
LONGEST_TRAIN code points); every whole text is scored.

Defined results: a null or wordless text scores as the bias of the model; without labels of both classes every
score is 0; labels that repeat a doc_id count once, by their maximum; null labels and null ids are not learned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import kernel as K
from weftline.llm.common import small_arrow_batches

TRAIN_DOCS, TRAIN_CHARS, LONGEST_TRAIN = 6000, 20_000_000, 20_000
BUCKETS_LOG2, DIM, BLOCK_WORDS, GRAMS = 16, 16, 12, (3, 4, 5, 6)
EPOCHS, MEAN_EPOCHS, BATCH, RATE, DECAY = 24, 4, 500, 0.03, 1e-5
#: n-grams of fewer training texts than this have no vector.
LEAST_TEXTS = 5
CUT = 0.3
_SEP = K.PUNCT | K.SPACE


def grams(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(n-gram buckets sorted by word, n-grams of each word, words) of bytes; words shorter than two bytes have one or none."""
    b = np.concatenate(([32], np.where(_SEP[b], 32, K.LOWER[b]), [32])).astype(np.uint32)
    gap = b == 32
    start = np.flatnonzero(~gap[1:] & gap[:-1]) + 1
    word = np.cumsum(np.append(False, ~gap[1:] & gap[:-1])) - 1
    holes = np.concatenate(([0], np.cumsum(gap)))
    code, g, w = b.copy(), [], []
    n = len(b)
    for size in range(2, max(GRAMS) + 1):
        code = code[:-1] * np.uint32(0x01000193) + b[size - 1 :] + np.uint32(size)
        if size in GRAMS and n >= size:
            i = np.arange(n - size + 1)
            ok = holes[i + size - 1] == holes[i + 1]
            h = code[ok] * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            g.append((h * np.uint32(0x85EBCA77)) >> np.uint32(32 - BUCKETS_LOG2))
            w.append(word[i[ok] + gap[i[ok]]])
    g, w = np.concatenate(g), np.concatenate(w)
    order = np.argsort(w, kind="stable")
    return g[order].astype(np.uint16), np.bincount(w, minlength=len(start)), start - 1


def features(col: pa.Array):
    """(first row, words of each row, n-grams of each word, n-gram buckets), by chunks of rows."""
    for i, _, b, starts in K.chunked(col, 1 << 18):
        g, n, at = grams(b)
        yield i, np.diff(np.append(np.searchsorted(at, starts), len(at))), n, g


def _segment_sum(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    c = np.concatenate(([0.0], np.cumsum(x, dtype=np.float64)))
    e = np.cumsum(n)
    return c[e] - c[e - n]


def blocks_of(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(blocks of each row, words of each block)."""
    n = -(-words // BLOCK_WORDS)
    size = np.full(int(n.sum()), BLOCK_WORDS)
    last = np.cumsum(n)[n > 0] - 1
    size[last] = (words - (n - 1) * BLOCK_WORDS)[n > 0]
    return n, size


def block_logits(t: np.ndarray, words, n, g) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block averages, blocks of each row, words of each block) under n-gram scores t."""
    s = _segment_sum(t[g], n) / np.maximum(n, 1)
    nb, size = blocks_of(words)
    return _segment_sum(s, size) / size, nb, size


class Model:
    def __init__(self, t: np.ndarray, bias: float, fitted: bool = True):
        self.t, self.bias, self.fitted = t.astype(np.float32), float(bias), fitted

    def scores(self, col: pa.Array) -> np.ndarray:
        out = np.full(len(col), self.bias)
        for i, words, n, g in features(col):
            if len(n):
                z, nb, _ = block_logits(self.t, words, n, g)
                live = np.flatnonzero(nb > 0)
                out[i + live] = self.bias + np.maximum.reduceat(z, (np.cumsum(nb) - nb)[live])
        return 1 / (1 + np.exp(-np.clip(out, -40, 40))) if self.fitted else np.zeros(len(col))


def fit(texts: list[str], y: np.ndarray) -> Model:
    size = 1 << BUCKETS_LOG2
    if len(texts) == 0 or y.min() == y.max():
        return Model(np.zeros(size), 0.0, False)
    order = np.random.default_rng(5).permutation(len(texts))
    texts, y = [texts[i] for i in order], y[order].astype(np.float64)
    batches, batch = [], min(BATCH, max(20, len(texts) // 12))
    for a in range(0, len(texts), batch):
        parts = [x[1:] for x in features(pa.array(texts[a : a + batch]))]
        batches.append((*(np.concatenate(c) for c in zip(*parts, strict=True)), y[a : a + batch]))
    seen = np.zeros(size, np.int64)
    for words, n, g, _ in batches:
        text = np.repeat(np.repeat(np.arange(len(words), dtype=np.int64), words), n)
        seen += np.bincount(np.unique(text << BUCKETS_LOG2 | g) & (size - 1), minlength=size)
    common = seen >= LEAST_TEXTS
    rng = np.random.default_rng(7)
    emb = rng.normal(0, 0.1, (size, DIM)) * common[:, None]
    soft = rng.normal(0, 0.1, (DIM, 2))
    bias = np.array([0.0, np.log(y.mean() / (1 - y.mean()))])
    state = [(p, np.zeros_like(p), np.zeros_like(p)) for p in (emb, soft, bias)]
    step = 0
    for epoch in range(EPOCHS):
        for words, n, g, yy in batches:
            step += 1
            w = soft[:, 1] - soft[:, 0]
            z, nb, bs = block_logits((emb @ w).astype(np.float32), words, n, g)
            live = np.flatnonzero(nb > 0)
            at = (np.cumsum(nb) - nb)[live]
            row = np.repeat(np.arange(len(live)), nb[live])
            if epoch < MEAN_EPOCHS:
                share = 1.0 / nb[live][row]
                doc = np.add.reduceat(z, at) / nb[live]
            else:
                doc = np.maximum.reduceat(z, at)
                share = (z == doc[row]).astype(np.float64)
                share /= np.add.reduceat(share, at)[row]
            p = 1 / (1 + np.exp(-np.clip(doc + bias[1] - bias[0], -40, 40)))
            d = (p - yy[live]) / len(live)
            per_block = d[row] * share / bs
            hot = np.repeat(per_block, bs) / np.maximum(n, 1)
            used = np.repeat(hot != 0, n)
            dt = np.bincount(g[used], weights=np.repeat(hot, n)[used], minlength=size) * common
            dw = emb.T @ dt
            grads = (np.outer(dt, w) + DECAY * emb, np.stack([-dw, dw], 1), np.array([-d.sum(), d.sum()]))
            for (q, m, v), gr in zip(state, grads, strict=True):
                m += 0.1 * (gr - m)
                v += 0.01 * (gr * gr - v)
                q -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(emb @ (soft[:, 1] - soft[:, 0]), bias[1] - bias[0])


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The bounded sample of labelled rows: crc32 of doc_id modulo 4 is not 2, in the order of another hash of it."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    known = known.withColumn("u", F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 20)) / float(1 << 20))
    many = known.count()
    rows = known.where(F.col("u") < TRAIN_DOCS / max(many, 1)).orderBy("u").limit(TRAIN_DOCS).select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("toxic"))
    text = docs.select(F.col("doc_id").alias("__id"), "text").where(F.length("text") <= LONGEST_TRAIN)
    return text.join(F.broadcast(rows), "__id").select("toxic", F.lower("text").alias("text"))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    texts, y, held = [], [], 0
    for r in sorted(training_rows(docs, labels).collect(), key=lambda r: hash_order(r["text"])):
        held += len(r["text"])
        if held > TRAIN_CHARS:
            break
        texts.append(r["text"])
        y.append(int(r["toxic"] > 0))
    return fit(texts, np.array(y))


def hash_order(text: str) -> tuple[int, str]:
    import zlib

    return zlib.crc32(text.encode()), text


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns keep of docs and score double."""
    small_arrow_batches(docs.sparkSession)
    slim = docs.select(*[docs[c] for c in keep], F.lower(docs["text"]).alias("__text"))
    schema = slim.drop("__text").schema.add("__score", "double")
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            s = known.value.scores(b.column(b.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s)], names=[*b.schema.names[:-1], "__score"])

    return slim.mapInArrow(run, schema)


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    out = score(docs.select("doc_id", "text"), model, ["doc_id"])
    return out.select("doc_id", held.alias("held_out"), F.col("__score").alias("score"), F.when(F.col("__score") >= CUT, 1).otherwise(0).alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose score is below CUT."""
    return score(docs, train(docs, labels), docs.columns).where(F.col("__score") < CUT).drop("__score").select(*docs.columns)
