"""Document fingerprints by a homomorphic multiset hash, in DataFrame functions only.

A text is a multiset of pieces: its paragraphs (lines), cut into runs of six words. Each piece is hashed into
a wide vector, and the fingerprint is the sum of the vectors, modulo powers of two: EQUAL lanes of 32 bits of
the paragraphs' own hashes decide equality whatever their order; LIKE longs hold two 32-bit counters each of
single hash bits of the pieces, whose centred values approximate the cosine of two multisets (the upper counter has
31 bits; no text has so many pieces, as a string holds less than 2^31 bytes). Sums and differences of vectors insert and delete paragraphs (add, subtract) without reading the rest.

Defined results: a null text counts as empty; the empty text has no pieces and the zero fingerprint, and two
zero fingerprints are alike (1), a zero and another not (0); rows that repeat a doc_id are ordered by a hash of
the text; a lone document is its own next one; null ids come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import lookup_join, stage

EQUAL, LIKE = 8, 32
_FIELD = (1 << 32) - 1
_BITS = 1 | (1 << 32)
_TOP = (1 << 63) - 1
#: About so many rows share a bucket of neighbouring ids.
BUCKET_ROWS, HISTOGRAM = 2000, 4096


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda p: p != "")


def _lanes(text: Column) -> Column:
    whole = F.transform(paragraphs(text), lambda p: F.xxhash64(p))
    piece = F.transform(F.regexp_extract_all(text, F.lit(r"[^ \n]+(?: +[^ \n]+){0,5}"), F.lit(0)), lambda p: F.xxhash64(p))

    def equal(i):
        return F.aggregate(F.col("w"), F.lit(0).cast("long"), lambda s, h: (s + F.shiftrightunsigned(F.xxhash64(h, F.lit(i)), 32)).bitwiseAND(0xFFFFFFFF))

    def like(i):
        step = lambda s, h: (s + F.shiftrightunsigned(h, i).bitwiseAND(_BITS)).bitwiseAND(_TOP)
        return F.aggregate(F.col("p"), F.lit(0).cast("long"), step)

    return whole, piece, equal, like


def with_lanes(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the vector of column text as array<long> out; columns w, p are scratch."""
    whole, piece, equal, like = _lanes(F.col(text))
    df = df.withColumn("w", whole).withColumn("p", piece)
    parts = [equal(i) for i in range(EQUAL)] + [like(i) for i in range(LIKE)] + [F.size("p").cast("long")]
    return df.withColumn(out, F.array(*parts)).drop("w", "p")


def add(a: Column, b: Column) -> Column:
    """The vector of two multisets put together."""
    return F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x, i: F.when(i < EQUAL, (x["a"] + x["b"]).bitwiseAND(0xFFFFFFFF)).otherwise((x["a"] + x["b"]).bitwiseAND(_TOP)))


def subtract(a: Column, b: Column) -> Column:
    """The vector of a without the pieces of b, which it must hold."""
    return F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x, i: F.when(i < EQUAL, (x["a"] - x["b"]).bitwiseAND(0xFFFFFFFF)).otherwise(x["a"] - x["b"]))


def as_text(v: Column) -> Column:
    return F.lower(F.array_join(F.transform(v, lambda x, i: F.when(i < EQUAL, F.lpad(F.hex(x), 8, "0")).otherwise(F.hex(x))), "."))


def likeness(a: Column, b: Column) -> Column:
    """Cosine of the centred counters, 0 to 1; exactly 1 for equal vectors."""

    def centred(v, k):
        n = F.element_at(v, -1)
        return F.transform(F.slice(v, EQUAL + 1, LIKE), lambda x: (2 * F.shiftrightunsigned(x, 32 * k).bitwiseAND(_FIELD) - n).cast("double"))

    def dot(x, y):
        s = None
        for k in range(2):
            part = F.aggregate(F.zip_with(centred(x, k), centred(y, k), lambda p, q: p * q), F.lit(0.0), lambda t, z: t + z)
            s = part if s is None else s + part
        return s

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(a == b, 1.0).when(norm > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / norm))).otherwise(0.0)


def _buckets(docs: DataFrame) -> Column:
    """Buckets of neighbouring ids of about BUCKET_ROWS rows: equal widths, each cut again by its own count."""
    ends = docs.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).first()
    if ends["a"] is None:
        return F.lit(0).cast("long")
    width = (ends["b"] - ends["a"]) // HISTOGRAM + 1
    first = F.floor((F.col("doc_id") - ends["a"]) / F.lit(width)).cast("int")
    held = {r["i"]: -(-r["count"] // BUCKET_ROWS) for r in docs.where("doc_id is not null").groupBy(first.alias("i")).count().collect()}
    start, at = {}, 1
    for i in sorted(held):
        start[i] = at
        at += held[i]
    table = F.create_map(*[F.lit(x) for i in held for x in (i, start[i] * (1 << 31) + held[i])])
    cell = F.element_at(table, first)
    base, n = F.shiftright(cell, 31), cell.bitwiseAND((1 << 31) - 1)
    inside = (F.col("doc_id") - ends["a"] - first.cast("long") * width).cast("double") / width
    return F.coalesce(base + F.least(F.floor(inside * n), n - 1), F.lit(0)).cast("long")


def with_next(docs: DataFrame, carry: list[str]) -> DataFrame:
    """Adds next_<c> for each carried column: its value in the next row, ascending doc_id, the first after the last.

    docs(doc_id, text, ...). Rows are dealt once by bucket of neighbouring ids; the first row of each bucket also
    goes to the end of the bucket before.
    """
    bucket = _buckets(docs)
    keyed = docs.withColumns({"__b": bucket, "__t": F.xxhash64(F.coalesce(F.col("text"), F.lit("")))})
    order = F.struct(F.col("doc_id").isNotNull().alias("n"), "doc_id", "__t")
    firsts = docs.select("doc_id", "text").withColumns({"__b": bucket, "__t": F.xxhash64(F.coalesce(F.col("text"), F.lit("")))}).groupBy("__b").agg(F.min(order).alias("m"))
    # a row for each bucket of BUCKET_ROWS documents, not for each document
    line = Window.partitionBy(F.lit(1)).orderBy("__b")
    firsts = stage(firsts.withColumn("__before", F.coalesce(F.lag("__b").over(line), F.max("__b").over(Window.partitionBy(F.lit(1))))).select(F.col("m.doc_id").alias("f_id"), F.col("m.__t").alias("f_t"), "__before"), "firsts")
    on = keyed["doc_id"].eqNullSafe(firsts["f_id"]) & (keyed["__t"] == firsts["f_t"])
    rows = lookup_join(keyed, firsts, on, "left")
    own = F.struct(F.col("__b").alias("b"), F.lit(False).alias("tail"))
    rows = rows.withColumn("__at", F.explode(F.when(F.col("__before").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("__before").alias("b"), F.lit(True).alias("tail"))))))
    rows = rows.withColumns({"__b": F.col("__at.b"), "__tail": F.col("__at.tail")})
    w = Window.partitionBy("__b").orderBy("__tail", F.col("doc_id").asc_nulls_first(), "__t")
    out = rows.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in carry])
    return out.where(~F.col("__tail")).select(*docs.columns, *[f"next_{c}" for c in carry])


def fingerprint_report(docs: DataFrame) -> DataFrame:
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = with_next(with_lanes(d, "text", "v"), ["text", "v"])
    d = d.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("cut", F.floor(F.col("n_chars") / 4).cast("int"))
    d = d.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars - cut as int)), substring(next_text, 1, cut))"))
    d = with_lanes(d.drop("text", "next_text"), "edited", "e")
    return d.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_text(F.col("v")).alias("fingerprint"), as_text(F.col("e")).alias("edited_fingerprint"), likeness(F.col("v"), F.col("e")).alias("near_edited"), likeness(F.col("v"), F.col("next_v")).alias("near_next"))
