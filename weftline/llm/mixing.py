"""Mixing sources to target weights with hash thresholds, in words, without sorting.

Every document has a 60-bit hash. Words are summed by source and hash bucket; the bucket in which a source's
budget runs out is the only one refined, until one hash is left, and everything below is taken by a filter. The
document at the boundary does not fit; what is left of the budget gives a smaller, nested threshold among the
documents behind it that still can fit, until the rest is within a thousandth of the target.

Defined results: a null text has size 0 and takes nothing; a null source is a source of its own, the last; rows
that repeat a doc_id within a source have one hash and are taken together; a null doc_id hashes as an empty
text. Without any words all targets are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import lookup_join, stage

WORD = r"[^\x20\x09-\x0D]+"
BITS, STEP = 60, 12
MOST = 3
#: A source's budget counts as met when what is left is at most this share of its target.
TOLERANCE = 0.001


def _key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def _hash(doc_id: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id"), _key(F.col("source")).alias("k"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), _hash(F.col("doc_id")).alias("h"))


def targets(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(k, source_size, target, whole, room): one row a source. The windows run over sources, not documents."""
    s = rows.groupBy("k").agg(F.sum("size").alias("source_size"))
    every = Window.partitionBy(F.lit(1))
    rank = F.row_number().over(every.orderBy("k")) - 1
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("long"))
    before = every.orderBy(F.col("source_size") / F.col("w"), "k").rowsBetween(Window.unboundedPreceding, -1)
    cap = MOST * F.col("source_size")
    over = lambda what: F.coalesce(F.sum(what).over(before), F.lit(0))
    lam = (F.sum("source_size").over(every) - over(cap)) / (F.sum("w").over(every) - over(F.col("w")))
    s = s.withColumn("full", lam * F.col("w") > cap)
    held = lambda what: F.sum(F.when(F.col("full"), what).otherwise(0)).over(every)
    rest = (F.sum("source_size").over(every) - held(cap)) / F.greatest(F.sum("w").over(every) - held(F.col("w")), F.lit(1))
    s = s.withColumn("target", F.when(F.col("full"), cap.cast("double")).otherwise(F.least(rest * F.col("w"), cap.cast("double"))))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    s = s.withColumn("whole", F.least(whole, F.lit(MOST)))
    room = F.when(F.col("whole") >= MOST, 0).otherwise(F.floor(F.col("target") - F.col("whole") * F.col("source_size"))).cast("long")
    return s.select("k", "source_size", "target", "whole", room.alias("room"))


def _boundary(units: DataFrame, state: DataFrame, n: int) -> DataFrame:
    """(k, at, before): per source the first hash that does not fit its room and the words below it; none if all fit."""
    cand = lookup_join(units, state, "k", "inner", n).where("h >= start and size <= room")
    found = None
    for shift in range(BITS - STEP, -1, -STEP):
        if found is None:
            part, base = cand.withColumn("before", F.lit(0).cast("long")), F.lit(0)
        else:
            part = lookup_join(cand, found.select("k", "bucket", "before"), "k", "inner", n).where(F.shiftright("h", shift + STEP) == F.col("bucket")).drop("bucket")
        hist = part.groupBy("k", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("s"), F.min("h").alias("lo"), F.max("h").alias("hi"), F.first("room").alias("room"), F.first("before").alias("base"))
        cum = F.sum("s").over(Window.partitionBy("k").orderBy("bucket"))
        over = hist.withColumn("before", F.col("base") + cum - F.col("s")).where(F.col("before") + F.col("s") > F.col("room"))
        found = stage(over.groupBy("k").agg(F.min(F.struct("bucket", "before", "lo", "hi")).alias("b")).select("k", "b.*"), "bound")
        if found.where("lo < hi").isEmpty():
            break
    return found.select("k", F.col("lo").alias("at"), "before")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> tuple[DataFrame, DataFrame]:
    """(rows, plan): rows has doc_id, k, size, h; plan per source its target, whole copies and thresholds."""
    rows = stage(sizes(docs), "sizes")
    plan = stage(targets(rows, weights), "plan")
    n = plan.count()
    units = stage(rows.where("size > 0").groupBy("k", "h").agg(F.sum("size").alias("size")), "units")
    state = plan.select("k", "target", "room", F.lit(0).cast("long").alias("start"))
    cuts = None
    while True:
        state = stage(state.where(F.col("room") > TOLERANCE * F.col("target")), "state")
        if state.isEmpty():
            break
        bound = _boundary(units, state, n)
        got = stage(state.join(bound, "k", "left"), "pass")
        cut = got.select("k", "start", F.coalesce("at", F.lit(1 << BITS)).alias("stop"), F.col("room").alias("cap"))
        cuts = cut if cuts is None else cuts.union(cut)
        state = got.where("at is not null").select("k", "target", (F.col("room") - F.col("before")).alias("room"), (F.col("at") + 1).alias("start"))
    if cuts is None:
        plan = plan.withColumn("cuts", F.expr("cast(null as array<struct<start:bigint,stop:bigint,cap:bigint>>)"))
    else:
        plan = plan.join(cuts.groupBy("k").agg(F.collect_list(F.struct("start", "stop", "cap")).alias("cuts")), "k", "left")
    plan = stage(plan.drop("room"), "plan")
    shared = stage(rows.where("size > 0").groupBy("k", "h").agg(F.sum("size").alias("unit"), F.count("*").alias("c")).where("c > 1").drop("c"), "shared")
    if shared.isEmpty():
        rows = rows.withColumn("unit", F.col("size"))
    else:
        rows = lookup_join(rows, shared, ["k", "h"]).withColumn("unit", F.coalesce("unit", "size"))
    return rows, plan


def _copies() -> Column:
    extra = F.exists("cuts", lambda c: (F.col("h") >= c["start"]) & (F.col("h") < c["stop"]) & (F.col("unit") <= c["cap"]))
    return F.col("whole") + F.when((F.col("size") > 0) & F.coalesce(extra, F.lit(False)), 1).otherwise(0)


def mix_report(docs: DataFrame) -> DataFrame:
    rows, plan = mix(docs)
    out = lookup_join(rows, plan, "k")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * _copies()).alias("taken"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as often as the mix takes it (no row: not taken). A row without words stays once."""
    rows, plan = mix(docs)
    n = plan.count()
    shared = rows.where("unit > size").select("k", "h", "unit").distinct()
    d = docs.withColumns({"__k": _key(docs["source"]), "__h": _hash(docs["doc_id"]), "__size": F.coalesce(F.regexp_count(docs["text"], F.lit(WORD)), F.lit(0)).cast("long")})
    plan = plan.select(F.col("k").alias("__k"), F.col("whole").alias("__whole"), F.col("cuts").alias("__cuts"))
    d = lookup_join(d, plan, "__k", "left", n)
    shared = stage(shared.select(F.col("k").alias("__k"), F.col("h").alias("__h"), F.col("unit").alias("__unit")), "shared")
    d = d.withColumn("__unit", F.col("__size")) if shared.isEmpty() else lookup_join(d, shared, ["__k", "__h"])
    unit = F.coalesce("__unit", "__size")
    extra = F.exists("__cuts", lambda c: (F.col("__h") >= c["start"]) & (F.col("__h") < c["stop"]) & (unit <= c["cap"]))
    copies = F.when(F.col("__size") == 0, 1).otherwise(F.col("__whole") + F.when(F.coalesce(extra, F.lit(False)), 1).otherwise(0))
    d = d.withColumn("__copies", copies.cast("int")).where("__copies > 0")
    return d.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*[d[c] for c in docs.columns])


MIX_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
s0 AS (SELECT k, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY k) - 1) % 3 + 1)::BIGINT AS w FROM d GROUP BY k),
s1 AS (
  SELECT *, ((sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER b, 0))::DOUBLE
             / (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::DOUBLE) * w > 3 * source_size AS full_
  FROM s0 WINDOW b AS (ORDER BY source_size::DOUBLE / w::DOUBLE, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s2 AS (
  SELECT k, source_size, CASE WHEN full_ THEN (3 * source_size)::DOUBLE ELSE least(
      ((sum(source_size) OVER () - sum(CASE WHEN full_ THEN 3 * source_size ELSE 0 END) OVER ())::DOUBLE
       / greatest(sum(w) OVER () - sum(CASE WHEN full_ THEN w ELSE 0 END) OVER (), 1)::DOUBLE) * w, (3 * source_size)::DOUBLE) END AS target
  FROM s1),
s AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3)::BIGINT ELSE 0 END AS whole FROM s2),
p AS (SELECT *, CASE WHEN whole >= 3 THEN 0 ELSE floor(target - whole * source_size)::BIGINT END AS room FROM s),
u AS (SELECT k, h, sum(size)::BIGINT AS size, row_number() OVER (PARTITION BY k ORDER BY h) AS i FROM d WHERE size > 0 GROUP BY k, h),
fit AS (
  SELECT k, 0::BIGINT AS i, NULL::BIGINT AS h, room AS cap, room, target, FALSE AS took, room <= 0.001 * target AS done FROM p
  UNION ALL
  SELECT f.k, u.i, u.h,
         CASE WHEN NOT f.done AND u.size <= f.cap AND u.size > f.room THEN f.room ELSE f.cap END,
         CASE WHEN NOT f.done AND u.size <= f.cap AND u.size <= f.room THEN f.room - u.size ELSE f.room END,
         f.target,
         NOT f.done AND u.size <= f.cap AND u.size <= f.room,
         f.done OR (u.size <= f.cap AND u.size > f.room AND f.room <= 0.001 * f.target)
  FROM fit f JOIN u ON u.k = f.k AND u.i = f.i + 1)
SELECT d.doc_id, d.size, p.source_size, p.target,
       (d.size * (p.whole + CASE WHEN d.size > 0 AND coalesce(f.took, FALSE) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN p USING (k) LEFT JOIN fit f ON f.k = d.k AND f.h = d.h
"""
