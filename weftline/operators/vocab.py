"""Vocabularies: counts, ordering, cap, reserved ids, encoding with a character fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.ranges import running
from weftline.operators.split import _cut


def build(tokens: DataFrame, column: str, min_count: int = 1, cap: int | None = None, reserved: int = 0, alphabetical: bool = False) -> DataFrame:
    """(token, cnt, id): ids follow count then token, or the alphabet, after the reserved ones.

    Distinct tokens are numbered by ranges of the order. cap keeps the most frequent, equal counts by the alphabet: the least
    count that stays is found in the counts of counts, and only the tokens of that count are numbered for it.
    """
    c = tokens.groupBy(F.col(column).alias("token")).agg(F.count("*").alias("cnt")).where(F.col("cnt") >= min_count)
    if cap is not None:
        c = _most_frequent(_cut(c), cap)
    return running(c, ["token"] if alphabetical else [F.desc("cnt"), "token"], number="id").withColumn("id", F.col("id") - 1 + reserved)


def _most_frequent(c: DataFrame, cap: int) -> DataFrame:
    sizes = running(c.groupBy("cnt").agg(F.count("*").alias("n")), [F.desc("cnt")], {"upto": F.col("n")})
    edge = sizes.where((F.col("upto") >= cap) & (F.col("upto") - F.col("n") < cap)).select(F.col("cnt").alias("edge"), (cap - F.col("upto") + F.col("n")).alias("room"))  # one row at most
    j = c.join(F.broadcast(edge), how="left") if cap > 0 else c.limit(0).selectExpr("*", "1L as edge", "0L as room")
    whole = j.where("edge is null or cnt > edge").select("token", "cnt")
    some = running(j.where("cnt = edge"), ["token"]).where("i <= room").select("token", "cnt")
    return whole.unionByName(some)


def pad(ids: Column, n: int, fill: int = 0) -> Column:
    return F.slice(F.concat(ids, F.array_repeat(F.lit(fill), n)), 1, n)


def encode(rows: DataFrame, key: str, tokens: Column, vocab: DataFrame, unknown: int) -> DataFrame:
    """(key, ids): token ids in order; a token outside the vocabulary goes by its characters, then as unknown."""
    t = rows.select(key, F.posexplode(tokens).alias("pos", "token"))
    known = t.join(vocab.select("token", "id"), "token", "left")
    chars = known.where("id is null").select(key, "pos", F.posexplode(F.split("token", "")).alias("sub", "token"))
    spelled = chars.where("token <> ''").join(vocab.select("token", "id"), "token", "left").select(key, "pos", "sub", F.coalesce("id", F.lit(unknown)).alias("id"))
    whole = known.where("id is not null").select(key, "pos", F.lit(0).alias("sub"), "id")
    s = F.array_sort(F.collect_list(F.struct("pos", "sub", "id")))
    return whole.union(spelled).groupBy(key).agg(F.transform(s, lambda x: x["id"]).alias("ids"))


def decode(rows: DataFrame, key: str, ids: str, vocab: DataFrame, skip: tuple[int, ...] = (), unknown: str = "<UNK>") -> DataFrame:
    """(key, name, words): the name that the ids spell, and its tokens, where a run of one-character tokens is one word.

    Ids of skip (padding, start, end) go; ids outside the vocabulary read as unknown. White space around underscores goes, and outer
    underscores. Null or empty ids give an empty name. A run of characters ends at the next longer token, an underscore or the end.
    """
    t = rows.select(key, F.posexplode_outer(ids).alias("pos", "id")).where(F.col("id").isNull() | ~F.col("id").isin(list(skip) or [None]) if skip else F.lit(True))
    t = t.join(vocab.select("id", "token"), "id", "left").withColumn("token", F.when(F.col("id").isNotNull(), F.coalesce("token", F.lit(unknown))))
    seq = F.transform(F.array_sort(F.collect_list(F.when(F.col("token").isNotNull(), F.struct("pos", "token")))), lambda x: x["token"])
    g = t.groupBy(key).agg(seq.alias("ts"))
    name = F.trim(F.btrim(F.regexp_replace(F.array_join("ts", ""), r"\s*_\s*", "_"), F.lit("_")))
    single = lambda x: (F.length(x) == 1) & (x != "_")
    mark = F.transform("ts", lambda x, i: F.when((i > 0) & single(x) & single(F.get("ts", i - 1)), x).otherwise(F.concat(F.lit("\u0001"), x)))
    words = F.filter(F.split(F.array_join(mark, ""), "\u0001"), lambda w: w != "")
    d = g.select(key, name.alias("name"), words.alias("words"))
    return rows.select(key).distinct().join(d, key, "left").select(key, F.coalesce("name", F.lit("")).alias("name"), F.coalesce("words", F.array().cast("array<string>")).alias("words"))
