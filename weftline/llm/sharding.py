"""Histogram sort of documents into shards of near equal bytes, with one exchange of the rows.

The key of a row is the hash of its text, so equal texts are neighbours. Splitters are sought by counting, over
all partitions, the exact bytes below candidate keys; each round probes only the bucket that holds a splitter
256 times finer, until it holds a single unit, and the cut goes to the nearer side of it. A group of equal texts
is one unit, and stays in one shard, unless it is larger than both the largest document and a twentieth of a
shard; then its rows are units of their own, ordered by the hash of doc_id. Sub-ranges of a shard, four at least and so
many that each has some RANGE_BYTES, bound what one task sorts.

Defined results: a null text counts as empty (16 bytes); rows equal in doc_id and text are one unit; fewer
documents than shards leave shards empty.
"""

from __future__ import annotations

import json
from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import stage

BITS, FIRST, STEP = 60, 12, 8
TOLERANCE = 0.05
#: Least sub-ranges of a shard, and the bytes that one should have at most.
SUB, RANGE_BYTES = 4, 256 << 20


def _key(*cols: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*cols), 64 - BITS)


def splitters(units: DataFrame, targets: list[int]) -> dict[int, tuple[int, int, int]]:
    """For each byte position: (key of the unit in which it falls, bytes below it, its bytes).

    units(key, size). What reaches the driver is at most 4096 or 256 counts a splitter in a round.
    """
    done: dict[int, tuple[int, int, int]] = {}
    open_: dict[int, tuple[int, int]] = {t: (0, 0) for t in targets}  # prefix, bytes below it
    depth = 0
    while open_:
        step = min(FIRST if depth == 0 else STEP, BITS - depth)
        prefix = F.shiftrightunsigned("key", BITS - depth)
        part = units if depth == 0 else units.where(prefix.isin(sorted({p for p, _ in open_.values()})))
        hist = part.groupBy(F.shiftrightunsigned("key", BITS - depth - step).alias("b")).agg(F.sum("size").alias("s"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()
        of: dict[int, list] = {}
        for r in sorted(hist, key=lambda r: r["b"]):
            of.setdefault(r["b"] >> step, []).append(r)
        depth += step
        for t, (p, below) in list(open_.items()):
            for r in of[p]:
                if below + r["s"] > t or r is of[p][-1]:
                    break
                below += r["s"]
            if r["lo"] == r["hi"]:
                done[t] = (r["lo"], below, r["s"])
                del open_[t]
            else:
                open_[t] = (r["b"], below)
    return done


def cuts(base: DataFrame, shards: int, sub: int = SUB) -> list[tuple[int, int]]:
    """Lower ends (g, e) of all sub-ranges but the first, and the heavy groups, from base(g, d, size)."""
    tot = base.agg(F.sum("size").alias("t"), F.max("size").alias("m")).first()
    if not tot["t"]:
        return [], []
    limit = max(TOLERANCE * tot["t"] / shards, tot["m"])
    groups = base.groupBy(F.col("g").alias("key")).agg(F.sum("size").alias("size"))
    heavy = sorted(r["key"] for r in groups.where(F.col("size") > limit).collect())  # fewer than shards / TOLERANCE
    targets = sorted({j * tot["t"] // (shards * sub) for j in range(1, shards * sub)})
    at = splitters(stage(groups, "groups"), targets)
    found = {}
    for g in sorted({at[t][0] for t in targets if at[t][0] in set(heavy)}):
        inside = {t - at[t][1]: t for t in targets if at[t][0] == g}
        rows = base.where(F.col("g") == g).select(F.col("d").alias("key"), "size")
        for i, (d, below, size) in splitters(rows, list(inside)).items():
            found[inside[i]] = (g, d, at[inside[i]][1] + below, size)
    out = []
    for t in targets:
        g, e, below, size = found.get(t) or (at[t][0], 0, *at[t][1:])
        out.append((g, e) if t - below <= below + size - t else (g, e + 1))
    bounds = [out[bisect_right(targets, j * tot["t"] // (shards * sub)) - 1] for j in range(1, shards * sub)]
    return bounds, heavy


def _below(bounds: list[tuple[int, int]], g: Column, e: Column) -> Column:
    """How many bounds lie at or below (g, e): a look-up by the first bits of g, then a count of the few bounds that share them."""
    inside: list[list[dict]] = [[] for _ in range(1 << FIRST)]
    for bg, be in bounds:
        inside[bg >> (BITS - FIRST)].append({"g": bg, "e": be})
    table, before = [], 0
    for cell in inside:
        table.append({"b": before, "in": cell})
        before += len(cell)
    cells = F.from_json(F.lit(json.dumps(table)), "array<struct<b:int,in:array<struct<g:bigint,e:bigint>>>>")
    own = F.get(cells, F.shiftright(g, BITS - FIRST).cast("int"))
    return own["b"] + F.size(F.filter(own["in"], lambda x: (x["g"] < g) | ((x["g"] == g) & (x["e"] <= e))))


def place(docs: DataFrame, shards: int = 40, sub: int = SUB) -> DataFrame:
    """docs with its columns, shard int and slot long (columns of these names are replaced); the rows cross one exchange."""
    text = F.coalesce(docs["text"], F.lit(""))
    keyed = {"__size": F.octet_length(text).cast("long") + 16, "__g": _key(text), "__d": _key(docs["doc_id"])}
    base = stage(docs.select(*[c.alias(n[2:]) for n, c in keyed.items()]), "keys")
    total = base.agg(F.sum("size").alias("t")).first()["t"] or 0
    sub = max(sub, -(-total // (shards * RANGE_BYTES)))
    bounds, heavy = cuts(base, shards, sub)

    def ranged(df: DataFrame, g: str, d: str) -> Column:
        e = F.when(F.col(g).isin(heavy), F.col(d)).otherwise(F.lit(0).cast("long")) if heavy else F.lit(0).cast("long")
        return _below(bounds, F.col(g), e)

    rows = sorted((r["p"], r["count"]) for r in base.select(ranged(base, "g", "d").alias("p")).groupBy("p").count().collect())
    start, offset = {}, {}
    for p, n in rows:
        offset[p] = start.get(p // sub, 0)
        start[p // sub] = offset[p] + n
    first = F.create_map(*[F.lit(x).cast(t) for p, o in offset.items() for x, t in ((p, "int"), (o, "long"))]) if offset else F.expr("cast(map() as map<int,bigint>)")
    out = docs.withColumns(keyed)
    out = out.withColumn("__p", ranged(out, "__g", "__d"))
    order = Window.partitionBy("__p").orderBy("__g", "__d", docs["doc_id"])
    out = out.withColumn("__slot", F.element_at(first, F.col("__p")) + F.row_number().over(order) - 1)
    drop = {"shard", "slot"}
    return out.select(*[out[c] for c in docs.columns if c not in drop], F.floor(F.col("__p") / sub).cast("int").alias("shard"), F.col("__slot").cast("long").alias("slot"))


def shard_report(docs: DataFrame, shards: int = 40) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", "text")
    placed = place(slim.select("doc_id", "text"), shards)
    return placed.select("doc_id", (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
