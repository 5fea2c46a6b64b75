"""Language of whole texts: nearest centroid over normalised TF-IDF vectors of byte n-grams.

Runs of n-grams of one to four bytes (letters only, words parted by one space) are counted over the whole text
in DIMS hashed dimensions, weighted 1 + ln(count) times idf and normalised. Each language has several
centroids, found by spherical k-means; a text takes the language of the centroid with the largest cosine. A
text farther from its centroid than nearly all training texts is marked as rejected.

The model is fitted on a bounded hash sample of labelled rows of every language (some SAMPLE rows a language, fewer where
that would be more than TOTAL rows, LEAST at least); every whole text is classified.

Defined results: und and score 0 for null texts and texts without a letter, and for all texts when nothing
could be learned; equal cosines go to the language first by code point.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import kernel as K
from weftline.llm.common import small_arrow_batches

SAMPLE, LEAST, TOTAL, CENTROIDS, DIMS_LOG2, ROUNDS = 800, 40, 32_000, 4, 12, 12
DIMS = 1 << DIMS_LOG2
REJECT_SHARE = 0.005
_LETTER = np.array([c >= 128 or chr(c).isalpha() for c in range(256)])


def counts(col: pa.Array):
    """(first row, dense n-gram counts, rows by DIMS), by chunks of rows."""
    for i, j, b, starts in K.chunked(col, 1 << 17):
        b = np.where(_LETTER[b], K.LOWER[b], 32)
        ends = np.zeros(len(b), bool)
        ends[starts[1:] - 1] = True
        keep = (b != 32) | np.concatenate(([True], b[:-1] != 32)) | ends
        row = np.repeat(np.arange(j - i), np.diff(np.append(starts, len(b))))[keep]
        b = b[keep].astype(np.uint32)
        out = np.zeros((j - i) * DIMS, np.float32)
        code = np.zeros(len(b), np.uint32)
        for n in range(1, 5):
            code = (code[: len(b) - n + 1] if n == 1 else code[:-1]) * np.uint32(0x01000193) + b[n - 1 :] + np.uint32(n)
            if not len(code):
                break
            h = code * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            h = (h * np.uint32(0x85EBCA77)) >> np.uint32(32 - DIMS_LOG2)
            same = row[: len(code)] == row[n - 1 :]
            out += np.bincount(row[: len(code)][same] * DIMS + h[same], minlength=len(out)).astype(np.float32)
        yield i, out.reshape(j - i, DIMS)


class Model:
    def __init__(self, langs: list[str], of: np.ndarray, centroids: np.ndarray, idf: np.ndarray, least: np.ndarray):
        self.langs, self.of, self.centroids, self.idf, self.least = langs, of, centroids, idf, least

    def vectors(self, c: np.ndarray) -> np.ndarray:
        v = np.log1p(c) * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def predict(self, col: pa.Array):
        lang, score, rejected = [], np.zeros(len(col)), np.ones(len(col), bool)
        for i, c in counts(col):
            sim = self.vectors(c) @ self.centroids.T
            best = sim.argmax(1)
            top = sim[np.arange(len(sim)), best]
            lang += [self.langs[self.of[k]] for k in best]
            score[i : i + len(sim)] = np.clip(top, 0, 1)
            rejected[i : i + len(sim)] = top < self.least[best]
        return lang, score, rejected


def fit(langs: list[str], c: np.ndarray) -> Model | None:
    if not len(langs):
        return None
    names = sorted(set(langs), key=lambda x: x.encode())
    y = np.array([names.index(x) for x in langs])
    idf = np.log((1 + len(c)) / (1 + (c > 0).sum(0))).astype(np.float32) + np.float32(0.1)
    v = Model([], None, None, idf, None).vectors(c)
    cents, of, least = [], [], []
    for k in range(len(names)):
        x = v[y == k]
        n = min(CENTROIDS, len(x))
        m = x[:1]
        for _ in range(n - 1):  # farthest first
            m = np.vstack([m, x[(x @ m.T).max(1).argmin()]])
        for _ in range(ROUNDS):
            a = (x @ m.T).argmax(1)
            m = np.vstack([x[a == i].sum(0) if (a == i).any() else m[i] for i in range(n)])
            m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
        sim = x @ m.T
        a = sim.argmax(1)
        for i in range(n):
            own = sim[a == i, i]
            cents.append(m[i])
            of.append(k)
            least.append(np.quantile(own, REJECT_SHARE) if len(own) else 1.0)
    return Model(names, np.array(of), np.vstack(cents).astype(np.float32), idf, np.array(least))


def train(docs: DataFrame) -> Model | None:
    small_arrow_batches(docs.sparkSession)
    usable = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull()
    known = docs.where(usable)
    langs = known.groupBy("lang").count().collect()
    if not langs:
        return None
    each = max(LEAST, min(SAMPLE, TOTAL // len(langs)))
    share = F.create_map(*[F.lit(x) for r in langs for x in (r["lang"], min(1.0, each / r["count"]))])
    u = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1 << 20)) / float(1 << 20)
    rows = known.where(u < F.coalesce(F.element_at(share, F.col("lang")), F.lit(0.0))).select("doc_id", "lang", F.lower("text").alias("text"))

    def vec(batches):
        for b in batches:
            out = []
            for _, c in counts(b.column(2)):
                out += [r.astype(np.float16 if r.max() < 2048 else np.float32).tobytes() for r in c]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), pa.array(out, pa.binary())], names=["doc_id", "lang", "v"])

    got = rows.mapInArrow(vec, "doc_id long, lang string, v binary").collect()
    got = sorted(got, key=lambda r: (r["doc_id"], r["lang"], bytes(r["v"])))
    dense = [np.frombuffer(r["v"], np.float16 if len(r["v"]) == 2 * DIMS else np.float32).astype(np.float32) for r in got]
    return fit([r["lang"] for r in got], np.stack(dense) if dense else np.zeros((0, DIMS), np.float32))


def language_report(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(train(docs))

    def run(batches):
        for b in batches:
            m = model.value
            lang, score, rejected = m.predict(b.column(1)) if m else (["und"] * b.num_rows, np.zeros(b.num_rows), np.ones(b.num_rows, bool))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected), b.column(2)], names=["doc_id", "lang_pred", "score", "rejected", "letters"])

    slim = docs.select("doc_id", F.lower("text").alias("text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    out = slim.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean, letters boolean")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), F.when(F.col("letters"), F.col("lang_pred")).otherwise("und").alias("lang_pred"), F.when(F.col("letters"), F.col("score")).otherwise(0.0).alias("score"), (F.col("rejected") | ~F.col("letters")).alias("rejected"))
