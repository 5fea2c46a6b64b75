"""Vector code compression: each of 16 parts of a vector becomes the number of its nearest codebook entry.

Nearest entries are found exactly, with few exact distances. A part is described by the sum of its components and the norm of
what they differ from their mean by; the difference of two sums and of two norms bounds the distance from below. All entries
are bounded over the whole part first; those that can still be nearer than the entry with the least bound are
bounded again over halves, quarters and so on; what survives is measured in integers. Bounds are lowered by more than floats can err by,
so no nearest entry is lost.

The codebooks (entries times components) are all that goes to the driver and to tasks; a round sums the parts of each entry in
every task and then over tasks, in integers. Every pass reads the vectors anew from their source, which cuts no lineage and writes no copy.

Defined results: vectors that are null or hold a null, NaN, infinity or a double beyond 32-bit floats are dropped. Vectors of another length are of
another space: each length has codebooks of its own (MAX_LENGTHS at most), and parts of a length that 16 does not divide differ by
one component. Fewer than 64 vectors give fewer entries. Equal vec_ids are taken in order of their vectors, null ones last. Repeated rows
count as often as they occur. An error beyond a long is given as the largest long. Other columns are not read. An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import lookup_join, stage
from weftline.llm.mixing import _key

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
MAX_LENGTHS = 64
#: Sums go over tasks in limbs of so many bits, each of which fits a long over eight million tasks.
LIMB, LIMBS = 40, 5
_BIG = (1 << 63) - 1

Codebook = list[np.ndarray]


def usable(vector: Column) -> Column:
    """Whether a vector has neither null nor non-finite components."""
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(2.0**128)), F.lit(False))), F.lit(False))


def integers(values: np.ndarray) -> np.ndarray:
    """floor(256 * x), as int64 or, where that could overflow, as Python integers."""
    x = values.astype(np.float64)
    if not len(x) or np.abs(x).max() < 2.0**40:
        return np.floor(x * SCALE).astype(np.int64)
    return np.array([int(v) * SCALE if abs(v) >= 2.0**50 else math.floor(v * SCALE) for v in x.tolist()], object)


def bounds_of(length: int) -> list[tuple[int, int]]:
    return [(p * length // PARTS, (p + 1) * length // PARTS) for p in range(PARTS)]


def _safe(x: np.ndarray, entries: np.ndarray) -> bool:
    """Whether int64 holds every square and product that nearest() forms."""
    if x.dtype == object or entries.dtype == object:
        return False
    most = max(int(np.abs(a).max()) if a.size else 0 for a in (x, entries))
    n = x.shape[1]
    return max(64 * PARTS, n) * n * most * most < 1 << 62


def _levels(n: int) -> list[np.ndarray]:
    """Starts of 1, 2, 4, ... blocks of n components, down to blocks of two."""
    return [np.arange(b) * n // b for b in (1 << i for i in range(n.bit_length())) if b == 1 or 2 * b <= n]


def _means(x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(block sums over the roots of the block sizes, norm of the rest), so that differences bound the distance from below."""
    size = np.diff(np.append(starts, x.shape[1]))
    s = np.add.reduceat(x, starts, axis=1)
    rest = (np.add.reduceat(x * x, starts, axis=1) * size - s * s) / size
    return s / np.sqrt(size), np.sqrt(rest.sum(axis=1))


def nearest(x: np.ndarray, entries: np.ndarray, count: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, lower at ties, and its squared distance) for the rows of x; count adds up exact distances."""
    if not x.shape[1]:
        return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    if not _safe(x, entries):
        x, entries = x.astype(object), entries.astype(object)
        far = [[int(((a - e) ** 2).sum()) for e in entries] for a in x]
        at = [min(range(len(f)), key=f.__getitem__) for f in far]
        return np.array(at, np.int64), np.array([f[i] for f, i in zip(far, at, strict=True)], object)
    slack = 1e-12 * ((x * x).sum(axis=1, dtype=np.float64)[:, None] + (entries * entries).sum(axis=1, dtype=np.float64)[None, :])
    row = col = best = None
    for starts in _levels(x.shape[1]):
        (sx, rx), (se, re) = _means(x, starts), _means(entries, starts)
        if row is None:
            low = (rx[:, None] - re[None, :]) ** 2 + ((sx[:, None, :] - se[None, :, :]) ** 2).sum(axis=2) - slack
            first = low.argmin(axis=1)
            best = ((x - entries[first]) ** 2).sum(axis=1)
            row, col = np.nonzero(low <= best[:, None])
        else:
            low = (rx[row] - re[col]) ** 2 + ((sx[row] - se[col]) ** 2).sum(axis=1) - slack[row, col]
            keep = low <= best[row]
            row, col = row[keep], col[keep]
    exact = ((x[row] - entries[col]) ** 2).sum(axis=1)
    if count is not None:
        count[0] += len(row) + len(x)
    at = np.flatnonzero(np.diff(row, prepend=-1))
    least = np.minimum.reduceat(exact, at)
    n = np.diff(np.append(at, len(row)))
    return np.minimum.reduceat(np.where(exact == np.repeat(least, n), col, len(entries)), at), least


def _blocks(vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, their integer vectors) for each length in a column of lists without nulls."""
    values = integers(np.asarray(vectors.flatten()))
    size = np.asarray(pa.compute.list_value_length(vectors), np.int64)
    first = np.cumsum(size) - size
    for length in np.unique(size).tolist():
        rows = np.flatnonzero(size == length)
        yield length, rows, values[first[rows][:, None] + np.arange(length)[None, :]]


def _summer(books: dict[int, Codebook]) -> Callable:
    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {n: [np.zeros(e.shape, object) for e in book] for n, book in books.items()}
        used = {n: [np.zeros(len(e), np.int64) for e in book] for n, book in books.items()}
        for batch in batches:
            for length, _, x in _blocks(batch.column(0)):
                for p, (a, b) in enumerate(bounds_of(length)):
                    at, _ = nearest(x[:, a:b], books[length][p])
                    part = np.zeros(books[length][p].shape, x.dtype)
                    np.add.at(part, at, x[:, a:b])
                    sums[length][p] += part
                    used[length][p] += np.bincount(at, minlength=len(used[length][p]))
        rows = [(n, p, e, i, [*((s >> (LIMB * j)) & ((1 << LIMB) - 1) for j in range(LIMBS - 1)), s >> (LIMB * (LIMBS - 1))], int(u)) for n, book in sums.items() for p, part in enumerate(book) for e, (entry, u) in enumerate(zip(part, used[n][p], strict=True)) if u for i, s in enumerate(map(int, entry))]
        if rows:
            cols = list(zip(*rows, strict=True))
            yield pa.record_batch([*(pa.array(c, pa.int32()) for c in cols[:4]), *(pa.array([x[j] for x in cols[4]], pa.int64()) for j in range(LIMBS)), pa.array(cols[5], pa.int64())], _SUMS)

    return add_up


_SUMS = ["length", "part", "entry", "pos", *(f"s{j}" for j in range(LIMBS)), "n"]


def _narrow(entries: list[list[int]], width: int) -> np.ndarray:
    fits = all(abs(x) < 1 << 50 for e in entries for x in e)
    return np.array(entries, np.int64 if fits else object).reshape(len(entries), width)


def first_entries(kept: DataFrame, entries: int = ENTRIES) -> dict[int, Codebook]:
    """The parts of the vectors with the smallest ids, for each length of vectors."""
    lengths = [r["n"] for r in kept.groupBy(F.size("embedding").alias("n")).agg(F.lit(1).alias("one")).limit(MAX_LENGTHS + 1).collect()]
    if len(lengths) > MAX_LENGTHS:
        raise ValueError(f"vectors of more than {MAX_LENGTHS} lengths")
    out = {}
    for n in lengths:
        rows = kept.where(F.size("embedding") == n).orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()
        whole = [[int(x) for x in integers(np.array(r["embedding"], np.float64))] for r in rows]
        out[n] = [_narrow([v[a:b] for v in whole], b - a) for a, b in bounds_of(n)]
    return out


def next_entries(kept: DataFrame, books: dict[int, Codebook]) -> dict[int, Codebook]:
    """One round: every entry becomes the floor of the mean of its parts; unused ones stay."""
    sums = kept.select("embedding").mapInArrow(_summer(books), ", ".join(f"{c} {'int' if i < 4 else 'long'}" for i, c in enumerate(_SUMS)))
    got = sums.groupBy("length", "part", "entry", "pos").agg(*(F.sum(c).alias(c) for c in _SUMS[4:])).collect()
    new = {n: [[[int(x) for x in e] for e in part] for part in book] for n, book in books.items()}
    for r in got:
        new[r["length"]][r["part"]][r["entry"]][r["pos"]] = sum(r[f"s{j}"] << (LIMB * j) for j in range(LIMBS)) // r["n"]
    return {n: [_narrow(part, books[n][p].shape[1]) for p, part in enumerate(book)] for n, book in new.items()}


def train(kept: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> dict[int, Codebook]:
    """Codebooks by length of vectors; kept(vec_id, embedding) holds usable vectors."""
    books = first_entries(kept, entries)
    for _ in range(rounds):
        books = next_entries(kept, books)
    return books


def digest(book: Codebook) -> str:
    return hashlib.sha256(",".join(str(int(x)) for part in book for e in part for x in e).encode()).hexdigest()


def _coder(books: dict[int, Codebook]) -> Callable:
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors, lengths = [""] * batch.num_rows, [0] * batch.num_rows, [0] * batch.num_rows
            for length, rows, x in _blocks(batch.column(2)):
                found = [nearest(x[:, a:b], books[length][p]) for p, (a, b) in enumerate(bounds_of(length))]
                for i, r in enumerate(rows.tolist()):
                    codes[r] = "".join(f"{at[i]:02x}" for at, _ in found)
                    errors[r], lengths[r] = min(_BIG, sum(int(d[i]) for _, d in found)), length
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(errors, pa.int64()), pa.array(lengths, pa.int32())], ["vec_id", "label", "code", "error", "length"])

    return code


def encode(kept: DataFrame, books: dict[int, Codebook]) -> DataFrame:
    """(vec_id, label, code, error, length) of every row of kept(vec_id, label, embedding)."""
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    return kept.select("vec_id", "label", "embedding").mapInArrow(_coder(books), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long, length int")


def code_report(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Codes and errors of all usable vectors, the error of each label's rows together, and the checksum of the codebooks."""
    kept = vectors.select("vec_id", "label", "embedding").where(usable(F.col("embedding")))
    books = train(kept, entries, rounds)
    coded = stage(encode(kept, books).withColumn("k", _key(F.col("label").cast("string"))), "codes")
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    by = stage(coded.groupBy("k").agg(F.least(total, F.lit(_BIG).cast("decimal(38,0)")).cast("long").alias("label_error")), "labels")
    sha = F.lit(None).cast("string")
    for n, book in books.items():
        sha = F.when(F.col("length") == n, F.lit(digest(book))).otherwise(sha)
    return lookup_join(coded, by, "k").select("vec_id", "code", "error", "label_error", sha.alias("codebooks_sha256"))


def _round_sql(i: int) -> str:
    return f"""
a{i} AS (
  SELECT r, part, e, s FROM (
    SELECT v.r, v.part, c.e, sum((v.x - c.x) * (v.x - c.x)) AS s FROM v JOIN c{i} c ON v.part = c.part AND v.pos = c.pos GROUP BY v.r, v.part, c.e)
  QUALIFY row_number() OVER (PARTITION BY r, part ORDER BY s, e) = 1)"""


def _means_sql(i: int) -> str:
    return f"""
c{i + 1} AS (
  SELECT c.e, c.part, c.pos, coalesce((m.s - (m.s % m.n + m.n) % m.n) // m.n, c.x)::BIGINT AS x
  FROM c{i} c LEFT JOIN (SELECT a.e, v.part, v.pos, sum(v.x) AS s, count(*) AS n FROM v JOIN a{i} a ON a.r = v.r AND a.part = v.part GROUP BY 1, 2, 3) m
    ON m.e = c.e AND m.part = c.part AND m.pos = c.pos)"""


CODES_SQL = f"""
WITH k AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS r, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (
  SELECT r, (i - 1) // (n // 16) AS part, (i - 1) % (n // 16) AS pos, floor(256 * x::DOUBLE)::BIGINT AS x
  FROM (SELECT r, len(embedding) AS n, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM k)),
c0 AS (SELECT r AS e, part, pos, x FROM v WHERE r < 64),{_round_sql(0)},{_means_sql(0)},{_round_sql(1)},{_means_sql(1)},{_round_sql(2)},
h AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, e, pos)) AS codebooks_sha256 FROM c2),
o AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY part) AS code, sum(s)::BIGINT AS error FROM a2 GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM o JOIN k USING (r), h
"""
