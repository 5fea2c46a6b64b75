"""Ranked context digests from neighbouring rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.joins import band_pairs
from weftline.operators.split import _cut


def evidence(rows: DataFrame, by: str, pos: str, tokens) -> DataFrame:
    """(by, pos, token, cnt): token counts of each row."""
    return rows.select(by, pos, F.explode(tokens).alias("token")).groupBy(by, pos, "token").agg(F.count("*").alias("cnt"))


def positions(rows: DataFrame, by: str, key: str, out: str = "pos") -> DataFrame:
    """Adds the place (from 1) of each row in its group by key, which is unique there.

    Rows are dealt by ranges of (by, key) and numbered within a range; counts of the ranges before give the offsets, so
    that a large group is numbered by many tasks.
    """
    dealt = _cut(rows.repartitionByRange(by, key).withColumn("__p", F.spark_partition_id()))
    sizes = dealt.groupBy(by, "__p").agg(F.count("*").alias("__c"))
    before = F.coalesce(F.sum("__c").over(Window.partitionBy(by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col(by).alias("__by"), F.col("__p").alias("__q"), before.alias("__o"))
    at = F.row_number().over(Window.partitionBy(by, "__p").orderBy(key))
    j = dealt.withColumn("__n", at).join(sizes, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__p") == F.col("__q")))
    return j.select(*rows.columns, (F.col("__n") + F.col("__o")).cast("int").alias(out))


def neighbour_tokens(rows: DataFrame, ev: DataFrame, by: str, pos: str, k: int) -> DataFrame:
    """(by, pos, token, df, tot) over the k rows on each side."""
    return source_tokens(band_pairs(rows, by, pos, k), ev, by, pos)


def source_tokens(pairs: DataFrame, ev: DataFrame, by: str, pos: str) -> DataFrame:
    """(by, pos, token, df, tot) over the source rows of pairs(by, pos, n_pos)."""
    e = ev.select(by, F.col(pos).alias("n_pos"), "token", "cnt")
    return pairs.join(e, [by, "n_pos"]).groupBy(by, pos, "token").agg(F.count("*").alias("df"), F.sum("cnt").alias("tot"))


def top_tokens(scored: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The n best tokens of each row, with their rank."""
    w = Window.partitionBy(*by).orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def joined(ranked: DataFrame, by: list[str]) -> DataFrame:
    s = F.array_sort(F.collect_list(F.struct("rank", "token")))
    return ranked.groupBy(*by).agg(F.array_join(F.transform(s, lambda x: x["token"]), " ").alias("digest"))


def idf(ev: DataFrame, group: str) -> DataFrame:
    """(token, idf): ln((N + 1) / (df + 1)) over groups."""
    n = ev.agg(F.count_distinct(group).alias("n"))
    return ev.groupBy("token").agg(F.count_distinct(group).alias("df")).join(F.broadcast(n)).select("token", "df", F.log((F.col("n") + 1) / (F.col("df") + 1)).alias("idf"))


def tiered(near: DataFrame, call: DataFrame, pool: DataFrame, by: list[str], sizes: tuple[int, int, int]) -> DataFrame:
    """Three tiers of tokens, each without those of the tiers before; score columns decide, then the token.

    near, call and pool are (by, token, score).
    """
    order = [F.desc("score"), "token"]
    a = top_tokens(near, by, order, sizes[0]).withColumn("tier", F.lit(1))
    b = top_tokens(call.join(a.select(*by, "token"), [*by, "token"], "left_anti"), by, order, sizes[1]).withColumn("tier", F.lit(2))
    used = a.select(*by, "token").union(b.select(*by, "token"))
    c = top_tokens(pool.join(used, [*by, "token"], "left_anti"), by, order, sizes[2]).withColumn("tier", F.lit(3))
    cols = [*by, "tier", "rank", "token"]
    return a.select(cols).union(b.select(cols)).union(c.select(cols))


def with_predictions(ev: DataFrame, pred: DataFrame, by: str, pos: str, tokens, weight: int = 2) -> DataFrame:
    """Evidence of a second pass: each token of a row's predicted name counts weight times more."""
    more = pred.select(by, pos, F.explode(tokens).alias("token")).groupBy(by, pos, "token").agg((F.count("*") * weight).alias("cnt"))
    return ev.select(by, pos, "token", "cnt").unionByName(more).groupBy(by, pos, "token").agg(F.sum("cnt").alias("cnt"))


def by_role(callees: DataFrame, callers: DataFrame, ev: DataFrame, by: str, pos: str, n: int) -> DataFrame:
    """(by, pos, role, digest): the n best tokens over both kinds of neighbours, parted by who holds them.

    callees and callers are (by, pos, n_pos); role is callees, callers or both.
    """
    pairs = callees.withColumn("r", F.lit(1)).union(callers.withColumn("r", F.lit(2)))
    e = ev.select(by, F.col(pos).alias("n_pos"), "token", "cnt")
    g = pairs.join(e, [by, "n_pos"]).groupBy(by, pos, "token").agg(F.count("*").alias("df"), F.sum("cnt").alias("tot"), F.bit_or("r").alias("r"))
    role = F.when(F.col("r") == 1, "callees").when(F.col("r") == 2, "callers").otherwise("both")
    top = top_tokens(g, [by, pos], [F.desc("df"), F.desc("tot"), "token"], n).withColumn("role", role)
    return joined(top, [by, pos, "role"])


def balanced(callees: DataFrame, callers: DataFrame, ev: DataFrame, by: str, pos: str, n: int) -> DataFrame:
    """(by, pos, role, digest): the n best tokens of callees and of callers, each on its own."""
    out = []
    for role, pairs in (("callees", callees), ("callers", callers)):
        top = top_tokens(source_tokens(pairs, ev, by, pos), [by, pos], [F.desc("df"), F.desc("tot"), "token"], n)
        out.append(joined(top, [by, pos]).withColumn("role", F.lit(role)))
    return out[0].unionByName(out[1])


def budgeted(neighbours: DataFrame, weighted: DataFrame, by: str, pos: str, cap: int, kinds: list[str] | None = None) -> DataFrame:
    """(by, pos, order, role, kind, digest): each neighbour in order gives its best tokens until cap tokens are used.

    neighbours(by, pos, n_pos, role, order) has order from 1; weighted(by, pos, kind, token, weight) is the typed evidence.
    A neighbour gives max(3, cap / neighbours) tokens at most, over all kinds, or a third of that (at least one) of each of
    the kinds in turn. The budget before a neighbour is what those before it left, a running sum of what each offers.
    """
    w = Window.partitionBy(by, pos)
    nb = neighbours.withColumn("m", F.greatest(F.lit(3), F.floor(F.lit(cap) / F.count("*").over(w))).cast("int"))
    e = weighted.select(by, F.col(pos).alias("n_pos"), "kind", "token", "weight")
    j = nb.join(e, [by, "n_pos"])
    part = [by, pos, "order"] + (["kind"] if kinds else [])
    j = j.withColumn("rank", F.row_number().over(Window.partitionBy(*part).orderBy(F.desc("weight"), "token")))
    if kinds:
        each = F.greatest(F.lit(1), F.floor(F.col("m") / len(kinds))).cast("int")
        offer = j.where(F.col("rank") <= each)
        size = offer.groupBy(by, pos, "order").agg(F.count("*").alias("offered"))
        used = F.coalesce(F.sum("offered").over(w.orderBy("order").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        left = size.withColumn("left", F.lit(cap) - used).where("left > 0").select(by, pos, "order", "left")
        # The last neighbour within the budget has its share cut to what is left.
        short = F.greatest(F.lit(1), F.floor(F.least(F.col("m"), F.col("left")) / len(kinds)))
        kept = offer.join(left, [by, pos, "order"]).where(F.col("rank") <= short)
        place = F.create_map(*[F.lit(x) for i, k in enumerate(kinds) for x in (k, i)])
        kept = kept.withColumn("kind_at", place[F.col("kind")])
    else:
        offer = j.where(F.col("rank") <= F.col("m"))
        size = offer.groupBy(by, pos, "order").agg(F.count("*").alias("offered"))
        used = F.coalesce(F.sum("offered").over(w.orderBy("order").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        left = size.withColumn("left", F.lit(cap) - used).where("left > 0").select(by, pos, "order", "left")
        kept = offer.join(left, [by, pos, "order"]).where(F.col("rank") <= F.col("left")).withColumn("kind", F.lit("all")).withColumn("kind_at", F.lit(0))
    s = F.array_sort(F.collect_list(F.struct("rank", "token")))
    return kept.groupBy(by, pos, "order", "role", "kind", "kind_at").agg(F.array_join(F.transform(s, lambda x: x["token"]), " ").alias("digest"))


def provenance(pairs: DataFrame, ev: DataFrame, units: DataFrame, by: str, pos: str, n: int) -> DataFrame:
    """(by, pos, token, origin): whether a digest token comes from the row's own unit, from others, from both or from unknown ones.

    units(by, pos, unit) may have null units, which are unknown; rows with a null unit are left out.
    """
    own = units.where("unit is not null").select(by, pos, F.col("unit").alias("mine"))
    src = units.select(by, F.col(pos).alias("n_pos"), F.col("unit").alias("theirs"))
    e = ev.select(by, F.col(pos).alias("n_pos"), "token", "cnt")
    j = pairs.join(own, [by, pos]).join(src, [by, "n_pos"]).join(e, [by, "n_pos"])
    g = j.groupBy(by, pos, "token").agg(F.count("*").alias("df"), F.sum("cnt").alias("tot"), F.coalesce(F.bool_or(F.col("theirs") == F.col("mine")), F.lit(False)).alias("same"), F.coalesce(F.bool_or(F.col("theirs") != F.col("mine")), F.lit(False)).alias("diff"))
    origin = F.when(~F.col("same") & ~F.col("diff"), "unknown").when(F.col("same") & F.col("diff"), "both").when(F.col("same"), "same_file_only").otherwise("different_file_only")
    return top_tokens(g, [by, pos], [F.desc("df"), F.desc("tot"), "token"], n).select(by, pos, "token", origin.alias("origin"))


def unit_share(pairs: DataFrame, units: DataFrame, by: str, pos: str) -> DataFrame:
    """(by, pos, same, other, unknown): shares of a row's sources by unit, and expected: (unit size - 1) / (group size - 1)."""
    own = units.where("unit is not null")
    size = own.groupBy(by, "unit").agg(F.count("*").alias("n_f"))
    group = units.groupBy(by).agg(F.count("*").alias("n_b"))
    src = units.select(by, F.col(pos).alias("n_pos"), F.col("unit").alias("theirs"))
    j = pairs.join(own, [by, pos]).join(src, [by, "n_pos"])
    g = j.groupBy(by, pos, "unit").agg(F.avg((F.coalesce(F.col("theirs") == F.col("unit"), F.lit(False))).cast("double")).alias("same"), F.avg(F.col("theirs").isNull().cast("double")).alias("unknown"))
    g = g.withColumn("other", 1.0 - F.col("same") - F.col("unknown"))
    return g.join(size, [by, "unit"]).join(group, by).select(by, pos, "same", "other", "unknown", ((F.col("n_f") - 1) / F.greatest(F.col("n_b") - 1, F.lit(1))).alias("expected"))


def cover(names: DataFrame, digest: DataFrame, by: str, pos: str, tokens) -> DataFrame:
    """(by, pos, n, any_hit, first_hit, all_hit): which of a row's name tokens its digest tokens (by, pos, token) hold."""
    own = names.select(by, pos, F.posexplode(tokens).alias("at", "token"))
    hit = digest.select(by, pos, "token").distinct().withColumn("hit", F.lit(1))
    j = own.join(hit, [by, pos, "token"], "left").na.fill(0, ["hit"])
    return j.groupBy(by, pos).agg(F.count("*").alias("n"), F.max("hit").alias("any_hit"), F.max(F.when(F.col("at") == 0, F.col("hit"))).alias("first_hit"), F.min("hit").alias("all_hit"))
