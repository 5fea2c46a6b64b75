"""Assembly and comparison of prediction tables: fallback joins, common keys, picks, categories, tallies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.metrics import edit_similarity
from weftline.functions.names import split_name
from weftline.operators.blocks import best_sets
from weftline.operators.split import _cut


def first_writer(rows: DataFrame, by: list[str], key: str, offsets: list[int], order: list[str]) -> DataFrame:
    """Rows expanded to key + each offset; of the rows that meet at a key the first in order stays, then the first offset."""
    at = rows.select("*", F.posexplode(F.array(*map(F.lit, offsets))).alias("__p", "__o")).withColumn("__key", F.col(key) + F.col("__o"))
    w = Window.partitionBy(*by, "__key").orderBy(*order, "__p")
    best = at.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__o", "__p")
    return best.drop(key).withColumnRenamed("__key", key)


def join_or_weaker(left: DataFrame, right: DataFrame, keys: list[str], weaker: list[str], order: list[str], value: str) -> DataFrame:
    """Adds value of the right row with the same keys, or else of the first in order with the same weaker keys, and how.

    how is "key", "weaker" or null. Nulls in a key match nothing.
    """
    strong = right.groupBy(*keys).agg(F.min_by(value, F.struct(*order)).alias("__s"), F.lit(True).alias("__hs"))
    weak = right.groupBy(*weaker).agg(F.min_by(value, F.struct(*order)).alias("__w"), F.lit(True).alias("__hw"))
    j = left.join(strong, keys, "left").join(weak, weaker, "left")
    how = F.when(F.col("__hs"), "key").when(F.col("__hw"), "weaker")
    return j.select(*left.columns, F.when(F.col("__hs"), F.col("__s")).otherwise(F.col("__w")).alias(value), how.alias("how"))


def with_default(left: DataFrame, right: DataFrame, keys: list[str], defaults: dict) -> DataFrame:
    """Left join whose unmatched rows get default values."""
    hit = right.select(*keys, *defaults, F.lit(True).alias("__hit"))
    j = left.join(hit, keys, "left")
    return j.select(*left.columns, *[F.when(F.col("__hit"), F.col(c)).otherwise(F.lit(v)).alias(c) for c, v in defaults.items()])


def common(arms: dict[str, DataFrame], keys: list[str], value: str) -> DataFrame:
    """(keys, one value column an arm) of the keys that every arm has; one shuffle of all arms together."""
    long = reduce(DataFrame.unionByName, [df.select(*keys, F.col(value).alias("v")).withColumn("arm", F.lit(a)) for a, df in arms.items()])
    g = long.groupBy(*keys).agg(F.count_distinct("arm").alias("n"), *[F.min(F.when(F.col("arm") == a, F.col("v"))).alias(a) for a in arms])
    return g.where(F.col("n") == len(arms)).drop("n")


def max_confidence(arms: list[tuple[Column, Column]]) -> Column:
    """Value of the arm (confidence, value) of highest confidence; of equal ones the first."""
    n = len(arms)
    return F.greatest(*[F.struct(c.alias("c"), F.lit(n - i).alias("i"), v.alias("v")) for i, (c, v) in enumerate(arms)])["v"]


def name_category(names: DataFrame, train: DataFrame, name: str) -> DataFrame:
    """Adds category: seen (a training name), novel_known (all sub-tokens in training names) or novel_oov."""
    known = train.select(F.col(name)).distinct().withColumn("__seen", F.lit(True))
    tokens = train.select(F.explode(split_name(F.col(name))).alias("t")).distinct()
    parts = names.select(name).distinct().select(name, F.explode(F.array_distinct(split_name(F.col(name)))).alias("t"))
    oov = parts.join(tokens, "t", "left_anti").select(name).distinct().withColumn("__oov", F.lit(True))
    j = names.join(known, name, "left").join(oov, name, "left")
    empty = F.size(split_name(F.col(name))) <= 0
    cat = F.when(F.col("__seen"), "seen").when(F.col("__oov") | empty | F.col(name).isNull(), "novel_oov").otherwise("novel_known")
    return j.select(*names.columns, cat.alias("category"))


def reverse_pick(sim: Column, threshold: float, retrieved: Column, generated: Column) -> Column:
    """struct(pick, retrieved): the retrieved name where its similarity is at the threshold or above, the generated one elsewhere."""
    over = F.coalesce(sim >= threshold, F.lit(False))
    return F.struct(F.when(over, retrieved).otherwise(generated).alias("pick"), over.alias("retrieved"))


def forward_pick(score: Column, threshold: float, retrieved: Column, generated: Column) -> Column:
    """struct(pick, retrieved): the generated name, but where its score is at the threshold or below and there is a retrieved one."""
    weak = F.coalesce(score <= threshold, F.lit(False)) & retrieved.isNotNull()
    return F.struct(F.when(weak, retrieved).otherwise(generated).alias("pick"), weak.alias("retrieved"))


def difficulty(n_calls: Column, seen: Column) -> Column:
    return F.when(n_calls > 0, "easy").when(seen, "hard_seen").otherwise("hard_unseen")


def error_kind(pred: Column, true: Column, pred_known: Column, true_known: Column) -> Column:
    """correct, wrong_unseen_target, close, phantom or wrong_seen: the first that holds."""
    return F.when(pred == true, "correct").when(~true_known, "wrong_unseen_target").when(edit_similarity(pred, true) > 0.7, "close").when(~pred_known, "phantom").otherwise("wrong_seen")


def wins(rows: DataFrame, group: str, a: str, b: str, margin: float = 0.005) -> DataFrame:
    """One row of counts of groups where the mean of a is above b by more than margin, b above a, and neither."""
    g = rows.groupBy(group).agg(F.avg(a).alias("a"), F.avg(b).alias("b"))
    return g.agg(F.count_if(F.col("a") > F.col("b") + margin).alias("a_wins"), F.count_if(F.col("b") > F.col("a") + margin).alias("b_wins"), F.count_if(F.abs(F.col("a") - F.col("b")) <= margin).alias("ties"))


def best_by_group(rows: DataFrame, group: str, score: list[str], tie: str) -> DataFrame:
    """The row of each group with the greatest scores; of equal ones the smallest tie."""
    w = Window.partitionBy(group).orderBy(*[F.desc(s) for s in score], tie)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def extremes(rows: DataFrame, score: str, tie: str, n: int) -> DataFrame:
    """The n rows of lowest and of highest score, with end; each is a top-n that every partition cuts first."""
    low = rows.orderBy(F.asc(score), tie).limit(n).withColumn("end", F.lit("worst"))
    return low.unionByName(rows.orderBy(F.desc(score), tie).limit(n).withColumn("end", F.lit("best")))


def shared_names(rows: DataFrame, name: str, holder: str) -> DataFrame:
    """One row: names, names held by more than one holder, rows of such names, and their share of all rows."""
    g = rows.groupBy(name).agg(F.count("*").alias("c"), F.count_distinct(holder).alias("h"))
    many = F.col("h") > 1
    dup = F.coalesce(F.sum(F.when(many, F.col("c"))), F.lit(0))
    return g.agg(F.count("*").alias("names"), F.count_if(many).alias("shared"), dup.alias("rows_shared"), (dup / F.greatest(F.sum("c"), F.lit(1))).alias("share"))


def relabelled_means(groups: DataFrame, share: str, linked: Column, cuts: list[float], n: str, value: str) -> DataFrame:
    """For each cut-off: groups counted near (linked, or share at the cut or above) and far, row-weighted and group means."""
    c = F.explode(F.array(*map(F.lit, cuts))).alias("cut")
    g = groups.select("*", c).withColumn("side", F.when(linked | (F.col(share) >= F.col("cut")), "near").otherwise("far"))
    return g.groupBy("cut", "side").agg(F.count("*").alias("groups"), (F.sum(F.col(value) * F.col(n)) / F.sum(n)).alias("row_mean"), F.avg(value).alias("group_mean"))


def bucket_profile(rows: DataFrame, bucket: Column, value: str) -> DataFrame:
    """Mean, population deviation and count by bucket, and what the mean says: above 0.55 code, above 0.45 balanced, else ext."""
    g = rows.groupBy(bucket.alias("bucket")).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count("*").alias("n"))
    return g.withColumn("reading", F.when(F.col("mean") > 0.55, "trust code").when(F.col("mean") > 0.45, "balanced").otherwise("trust ext"))


def failure_tags(n_calls: Column, n_tokens: Column) -> Column:
    """Patterns of a failed prediction, which may overlap: no calls; and a short, long or other name."""
    size = F.when(n_tokens <= 1, "short_name").when(n_tokens > 5, "long_name").otherwise("other")
    return F.array_compact(F.array(F.when(n_calls == 0, "no_ext_calls"), size))


def last_of_chunks(rows: DataFrame, keys: list[str], chunk: str) -> tuple[DataFrame, DataFrame]:
    """(merged, counts): the row of the last chunk for each key; per chunk its keys and those an earlier chunk had."""
    w = Window.partitionBy(*keys).orderBy(F.desc(chunk))
    merged = rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    one = rows.select(*keys, chunk).distinct()
    first = one.withColumn("again", (F.row_number().over(Window.partitionBy(*keys).orderBy(chunk)) > 1).cast("int"))
    return merged, first.groupBy(chunk).agg(F.count("*").alias("n"), F.sum("again").alias("dup"))


def rerank(candidates: DataFrame, query: str, order: str) -> DataFrame:
    """Best candidate of each query by sim + .05 (times the name is among them - 1) + .1 Jaccard of calls + .05 ratio of blocks.

    candidates(query, name, sim, q_calls, calls, q_blocks, blocks, order); a tie goes to the first in order.
    """
    freq = F.count("*").over(Window.partitionBy(query, "name"))
    inter, union = F.size(F.array_intersect("q_calls", "calls")), F.size(F.array_union("q_calls", "calls"))
    jac = F.when((F.size("q_calls") == 0) | (F.size("calls") == 0), 0.0).otherwise(inter / union)
    ratio = F.when((F.col("q_blocks") > 0) & (F.col("blocks") > 0), F.least("q_blocks", "blocks") / F.greatest("q_blocks", "blocks")).otherwise(0.0)
    scored = candidates.withColumn("score", F.col("sim") + 0.05 * (freq - 1) + 0.1 * jac + 0.05 * ratio)
    w = Window.partitionBy(query).orderBy(F.desc(F.round("score", 9)), order)
    return scored.withColumn("__n", F.row_number().over(w)).where("__n = 1").select(query, "name", "score", order)


def own_identifier(strings: Column) -> Column:
    """The string most like an identifier: of two sub-tokens or more, then the longest, then the last in order; null if none."""
    ident = F.filter(strings, lambda s: s.rlike("^[A-Za-z_][A-Za-z0-9_]*$"))
    ranked = F.transform(ident, lambda s: F.struct((F.size(split_name(s)) >= 2).alias("two"), F.length(s).alias("n"), s.alias("s")))
    return F.array_max(ranked)["s"]


def grid(rows: DataFrame, cuts: dict[str, list[float]]) -> DataFrame:
    """Rows once for each point of a grid of weights; the grid is a literal, never a table."""
    for c, values in cuts.items():
        rows = rows.select("*", F.explode(F.array(*map(F.lit, values))).alias(c))
    return rows


#: Sets of at most WHOLE shared elements are met by all their subsets (63), larger ones by blocks; asked sets are dealt to PARTIAL blocks at least.
WHOLE, PARTIAL = 6, 8


def best_jaccard(asked: DataFrame, classes: DataFrame) -> DataFrame:
    """(s, g, j): for each asked set s of a group g the highest Jaccard to a class that another group holds too; exact, no row where none shares an element.

    asked(s, g) and classes(s, n_h, only) hold sorted arrays of different strings, each class once with the number of groups that hold it
    and the only one if it is one; g and only are structs, so that a null group is a group.

    The best match of S is the best of |U| / (|S| + |T| - |U|) over the subsets U of S and the smallest T that contains U: a T that
    shares more than U is met again by a larger U. So small classes send their subsets once with their size, and small sets are never
    paired, however common an element is. A pair with a large set is compared in a task of its two blocks, without leaving
    it but for the best score. Elements of one set only are in no subset. A subset goes by 96 bits of hashes, an element of a large set by 64.
    """
    df = classes.select("s").union(asked.select("s")).distinct().select(F.explode("s").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    classes = _cut(_shared(classes, df))
    asked = _cut(_shared(asked, df).withColumn("id", F.monotonically_increasing_id()))
    equal = asked.hint("merge").join(classes.select("s", "n_h", "only"), "s").where((F.col("n_h") > 1) | (F.col("only") != F.col("g"))).select("id", F.lit(1.0).alias("j"))
    found = equal.unionByName(_best_subsets(asked, classes)).unionByName(_best_blocks(asked, classes))
    return asked.select("id", "s", "g").hint("merge").join(found.groupBy("id").agg(F.max("j").alias("j")), "id").select("s", "g", "j")


def _shared(sets: DataFrame, df: DataFrame) -> DataFrame:
    """Adds c: the elements of s that other sets hold too, rare ones first."""
    kept = sets.select("s").distinct().select("s", F.explode("s").alias("t")).hint("merge").join(df.where(F.col("df") > 1), "t")
    c = kept.groupBy("s").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "t"))), lambda x: x["t"]).alias("c"))
    return sets.hint("merge").join(c, "s", "left").withColumn("c", F.coalesce("c", F.array().cast("array<string>")))


def _subsets(sets: DataFrame, *columns: str | Column) -> DataFrame:
    """columns with u (two hashes) and k (its size), a row for each subset of the small sets."""
    t, n = F.array_sort("c"), F.size("c")
    bit = lambda i: F.call_function("shiftleft", F.lit(1), i)
    every = F.transform(F.sequence(F.lit(1), bit(F.least(n, F.lit(WHOLE))) - 1), lambda m: F.filter(t, lambda _, i: m.bitwiseAND(bit(i)) != 0))
    u = F.explode(every).alias("__u")
    rows = sets.where((n > 0) & (n <= WHOLE)).select(*columns, u)
    return rows.select(*[c for c in rows.columns if c != "__u"], F.struct(F.xxhash64("__u").alias("a"), F.hash("__u").alias("b")).alias("u"), F.size("__u").alias("k"))


def _best_subsets(asked: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, j): the best score over the subsets of asked sets, of sets that a group other than g holds. All steps share one exchange by subset."""
    u = _subsets(classes, F.size("s").alias("n"), (F.col("n_h") > 1).alias("many"), F.when(F.col("n_h") == 1, F.col("only")).alias("only")).repartition("u")
    by = u.groupBy("u", "many", "only").agg(F.min("n").alias("n"))
    first = by.groupBy("u").agg(F.min(F.when(F.col("many"), F.col("n"))).alias("several"), F.min(F.when(~F.col("many"), F.struct("n", "only"))).alias("sole"))
    # The second best sole holder answers those who are the first one themselves.
    other = by.join(first.where("sole is not null").select("u", F.col("sole.only").alias("o")), "u").where(~F.col("many") & (F.col("only") != F.col("o"))).groupBy("u").agg(F.min("n").alias("second"))
    index = first.join(other, "u", "left")
    q = _subsets(asked, "id", "g", F.size("s").alias("n_s")).join(index, "u")
    n = F.least("several", F.when(F.col("sole.only") != F.col("g"), F.col("sole.n")).otherwise(F.col("second")))
    return q.select("id", (F.col("k") / (F.col("n_s") + n - F.col("k"))).alias("j")).where("j is not null").groupBy("id").agg(F.max("j").alias("j"))


def _best_blocks(asked: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, j): the same for pairs of which one side is large."""
    hashes = F.transform("c", lambda t: F.xxhash64(t)).alias("es")
    n, many, big = F.size("s").cast("long").alias("n"), (F.col("n_h") > 1).alias("many"), F.size("c") > WHOLE
    x = lambda c: asked.where(c & (F.size("c") > 0)).select("id", F.xxhash64("g").alias("g"), n, hashes)
    y = lambda c: classes.where(c & (F.size("c") > 0)).select(n, many, F.coalesce(F.xxhash64("only"), F.lit(0)).alias("only"), hashes)
    return best_sets(x(big), y(F.lit(True)), PARTIAL).unionByName(best_sets(x(~big), y(big), PARTIAL))


def vocabulary_oracle(rows: DataFrame, train: DataFrame, key: str, name: str) -> DataFrame:
    """(key, best): the highest multiset F1 of each row's name against all training names.

    The second and further occurrences of a sub-token are elements of their own, so that multisets are sets; F1 is 2 J / (1 + J), and the best
    Jaccard J of sets is found without pairs of names.
    """
    nth = lambda ts: F.transform(ts, lambda t, i: F.concat_ws(" ", t, F.size(F.filter(F.slice(ts, 1, i), lambda x: x == t)).cast("string")))
    bag = F.array_sort(nth(split_name(F.col(name))))
    none = F.struct(F.lit(None).cast("string").alias("h"))
    asked = rows.select(bag.alias("s")).distinct().select("s", none.alias("g"))
    classes = train.select(bag.alias("s")).distinct().where(F.size("s") > 0).select("s", F.lit(2).cast("long").alias("n_h"), none.alias("only"))
    best = best_jaccard(asked, classes).select("s", "j")
    return rows.select(key, bag.alias("s")).join(best, "s", "left").select(key, F.coalesce(2.0 * F.col("j") / (1.0 + F.col("j")), F.lit(0.0)).alias("best"))


def best_in_other_group(names: DataFrame, train: DataFrame, name: str, group: str) -> DataFrame:
    """(name, group, best): highest Jaccard of full sub-token sets to a training name that another group holds; exact.

    A training name equal to the row's own counts 1 if another group has it. Names of equal sets are one class.
    """
    key = names.select(F.col(name).alias("x"), F.col(group).alias("g")).distinct()
    held = train.select(F.col(name).alias("y"), F.col(group).alias("h")).distinct()
    bag = lambda c: F.array_sort(F.array_distinct(split_name(F.col(c))))
    spread = held.groupBy("y").agg(F.count("*").alias("n_h"), F.min("h").alias("only"))
    same = spread.select(F.col("y").alias("x"), "n_h", "only")
    exact = F.col("n_h").isNotNull() & ((F.col("n_h") > 1) | ~F.col("only").eqNullSafe(F.col("g")))
    k = _cut(key.join(same, "x", "left").select("x", F.struct(F.col("g").alias("h")).alias("g"), bag("x").alias("s"), exact.alias("exact")))
    owners = held.select(bag("y").alias("s"), F.struct("h").alias("h")).distinct().where(F.size("s") > 0)
    classes = owners.groupBy("s").agg(F.count("*").alias("n_h"), F.min("h").alias("only"))
    best = best_jaccard(k.where(~F.col("exact") & (F.size("s") > 0)).select("s", "g").distinct(), classes)
    out = k.join(best, ["s", "g"], "left")
    return out.select(F.col("x").alias(name), F.col("g.h").alias(group), F.when(F.col("exact"), 1.0).otherwise(F.coalesce("j", F.lit(0.0))).alias("best"))


def f1_pairs(names: DataFrame, name: str) -> DataFrame:
    """(a, b, f1) of names a < b that share a sub-token: set-based F1, by a join on sub-tokens."""
    t = names.select(F.col(name).alias("x")).distinct().select("x", F.array_distinct(split_name(F.col("x"))).alias("ts"))
    t = t.select("x", F.size("ts").alias("n"), F.explode("ts").alias("t"))
    a, b = t.select(F.col("x").alias("a"), F.col("n").alias("n_a"), "t"), t.select(F.col("x").alias("b"), F.col("n").alias("n_b"), "t")
    g = a.join(b, "t").where("a < b").groupBy("a", "b", "n_a", "n_b").agg(F.count("*").alias("i"))
    return g.select("a", "b", (2.0 * F.col("i") / (F.col("n_a") + F.col("n_b"))).alias("f1"))
