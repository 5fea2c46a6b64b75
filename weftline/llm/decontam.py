"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items are partitioned by the size of their shingle set (powers of two). For a partition of sizes up to s the
documents are seen as windows of 2 s shingles, each half over its neighbour, so an item of s shingles lies
whole in one window and a containment of 0.8 is a Jaccard of at least 0.19 with that window, however long the
document. Windows and items have 64 MinHash values; one equal value makes a candidate (missed with a chance of
1e-6 at worst). Minima of windows are put together from minima of half windows, level by level, so all
partitions cost one pass. Each candidate is verified against the shingle set of the whole document.

Words are runs of letters, digits and non-ASCII characters of the lower-cased text; a shingle is five of them.

Defined results: a text of fewer than five words has its whole sequence as one shingle, so a short item is found in
documents that are nothing else; wordless and null texts match nothing; an item_id with several texts
counts as several items, of which the fullest match is returned; rows that repeat a doc_id are searched one by
one and give one row an item.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import kernel as K
from weftline.llm.common import lookup_join, small_arrow_batches, stage

SHINGLE, MINHASHES = 5, 64
#: Items searched in one pass over the documents; more are searched in blocks of about as many.
ITEMS_A_PASS = 20_000
_SEP = K.PUNCT | K.SPACE


class Items:
    """Benchmark items by size class: sets, and the table from MinHash values to items."""

    def __init__(self, ids: list, texts: list[str], threshold: float):
        self.ids, self.sets, self.threshold, by = [], [], threshold, {}
        self.mult = K.multipliers(MINHASHES, 3)
        for first, counts, words in K.word_hashes(pa.array(texts, pa.string()), _SEP):
            n, h = K.shingles(counts, words, SHINGLE)
            at = np.cumsum(n) - n
            low = K.minima(n, h, self.mult)
            for r in np.flatnonzero(n > 0):
                s = np.unique(h[at[r] : at[r] + n[r]])
                by.setdefault(int(len(s)).bit_length(), []).append((self.codes(low[r]), len(self.ids)))
                self.ids.append(ids[first + r])
                self.sets.append(s)
        self.tables = {}
        for j, rows in by.items():
            code = np.concatenate([c for c, _ in rows])
            item = np.repeat([i for _, i in rows], MINHASHES)
            order = np.argsort(code, kind="stable")
            self.tables[j] = (code[order], item[order])

    @staticmethod
    def codes(low: np.ndarray) -> np.ndarray:
        return K.mix(low + np.arange(1, MINHASHES + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))

    def candidates(self, n: np.ndarray, h: np.ndarray) -> set[tuple[int, int]]:
        """(row, item) pairs with an equal MinHash value in some window."""
        found: set[tuple[int, int]] = set()
        if not self.tables or not len(h):
            return found
        level = min(self.tables)
        half = 1 << level
        blocks = -(-n // half)
        row = np.repeat(np.arange(len(n)), blocks)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        at = (np.cumsum(n) - n)[row] + nth * half
        low = np.stack([np.minimum.reduceat(h * m, at) for m in self.mult], 1)
        while True:
            if level in self.tables:
                win = low.copy()
                same = row[1:] == row[:-1]
                win[:-1][same] = np.minimum(win[:-1][same], low[1:][same])
                code, item = self.tables[level]
                c = self.codes(win)
                lo = np.searchsorted(code, c.ravel())
                hit = np.flatnonzero(code[np.minimum(lo, len(code) - 1)] == c.ravel())
                for x in hit:
                    k, r = lo[x], int(row[x // MINHASHES])
                    while k < len(code) and code[k] == code[lo[x]]:
                        found.add((r, int(item[k])))
                        k += 1
            if level >= max(self.tables):
                return found
            level += 1
            first = np.flatnonzero(nth % 2 == 0)
            low = np.minimum.reduceat(low, first, axis=0)
            row, nth = row[first], nth[first] // 2

    def matches(self, col: pa.Array):
        for first, counts, words in K.word_hashes(col, _SEP):
            n, h = K.shingles(counts, words, SHINGLE)
            at = np.cumsum(n) - n
            doc = None
            for r, i in sorted(self.candidates(n, h)):
                if doc != r:
                    doc, own = r, np.unique(h[at[r] : at[r] + n[r]])
                s = self.sets[i]
                k = np.searchsorted(own, s)
                shared = int((own[np.minimum(k, len(own) - 1)] == s).sum())
                if shared >= self.threshold * len(s):
                    yield first + r, self.ids[i], len(s), shared


def contaminated(docs: DataFrame, bench: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment): documents that hold at least threshold of an item."""
    spark = docs.sparkSession
    small_arrow_batches(spark)
    items = bench.where("text is not null").select("item_id", F.lower("text").alias("text")).distinct()
    passes = -(-items.count() // ITEMS_A_PASS)
    slim = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"))
    schema = "doc_id long, item_id long, n_shingles long, n_shared long, containment double"
    out = spark.createDataFrame([], schema)
    for p in range(passes):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(passes)) == p).collect()
        known = spark.sparkContext.broadcast(Items([r["item_id"] for r in rows], [r["text"] for r in rows], threshold))

        def run(batches, known=known):
            for b in batches:
                found = list(known.value.matches(b.column(1)))
                doc, item, n, shared = zip(*found, strict=True) if found else ((),) * 4
                n, shared = np.array(n, np.int64), np.array(shared, np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc, pa.int64())), pa.array(item, pa.int64()), pa.array(n), pa.array(shared), pa.array(shared / np.maximum(n, 1))], names=["doc_id", "item_id", "n_shingles", "n_shared", "containment"])

        out = out.union(slim.mapInArrow(run, schema)) if p else slim.mapInArrow(run, schema)
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("containment", "n_shared", "n_shingles")).alias("m"))
    return best.select("doc_id", "item_id", "m.n_shingles", "m.n_shared", "m.containment")


def drop_contaminated(docs: DataFrame, bench: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of docs that hold no item; rows with a null doc_id stay unless they are found themselves."""
    bad = stage(contaminated(docs, bench, threshold).select(F.col("doc_id").alias("__bad")).distinct(), "bad")
    return lookup_join(docs, bad, docs["doc_id"].eqNullSafe(bad["__bad"]), "left_anti")


DECONTAM_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM w)),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM b)),
n AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shingles, n_shared, n_shared::DOUBLE / n_shingles AS containment
FROM m JOIN n USING (item_id) WHERE n_shared >= 0.8 * n_shingles
"""
