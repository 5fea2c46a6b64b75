"""Joins beyond equality, each as an equi-join that Catalyst can shuffle or broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators.blocks import like_sets, pack
from weftline.operators.ranges import carried
from weftline.operators.split import _cut


#: Rows that a task sorts.
TASK_ROWS = 1_000_000


def _tasks(spark: SparkSession, rows: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def tolerance_join(left: DataFrame, right: DataFrame, by: list[str], key: str, offsets: list[int]) -> DataFrame:
    """For each left row the right row at key + the first offset that has one; adds prio (null: none).

    The right side is laid out once for each offset, so the left side is shuffled once and keeps its other columns,
    nulls and repeated rows as they are. Several right rows at a key count as one: the smallest by their other columns.
    Both sides are dealt by the keys to as many tasks as their rows ask for, before anything is sorted, so that what a task sorts does not grow.
    """
    other = [c for c in right.columns if c not in (*by, key)]
    right = _cut(right)
    tasks = _tasks(left.sparkSession, left.count() + right.count() * len(offsets))
    at = F.posexplode(F.array(*map(F.lit, offsets))).alias("prio", "offset")
    spread = right.select("*", at).select(*by, (F.col(key) - F.col("offset")).alias(key), F.struct("prio", *other).alias("__b"))
    best = spread.repartition(tasks, *by, key).groupBy(*by, key).agg(F.min("__b").alias("__b"))
    return left.repartition(tasks, *by, key).join(best, [*by, key], "left").select(*left.columns, *[F.col(f"__b.{c}").alias(c) for c in ("prio", *other)])


def with_name_fallback(left: DataFrame, right: DataFrame, by: list[str], key: str, offsets: list[int], names: list[str], value: str) -> DataFrame:
    """tolerance_join, and for rows without a hit the value of the right row of the same names (the smallest); adds how."""
    hit = tolerance_join(left, right.select(*by, key, value), by, key, offsets)
    named = right.groupBy(*names).agg(F.min(value).alias("__v"))
    j = hit.join(named, names, "left")
    got = F.coalesce(F.when(F.col("prio").isNotNull(), F.col(value)), F.col("__v"))
    how = F.when(F.col("prio").isNotNull(), "address").when(F.col("__v").isNotNull(), "name")
    return j.select(*left.columns, got.alias(value), how.alias("how"))


def first_label(left: DataFrame, labels: DataFrame, by: list[str], key: str, offsets: list[int], name: str, order: str) -> DataFrame:
    """Adds name: of the labels at key + any of the offsets the first in their own order, or null.

    Labels that start with one underscore, which compilers make, are passed over; two underscores are a name.
    """
    fit = labels.where(F.col(name).isNotNull() & ~(F.col(name).startswith("_") & ~F.col(name).startswith("__")))
    at = F.explode(F.array(*map(F.lit, offsets))).alias("__o")
    spread = fit.select(*by, F.col(key).alias("__k"), name, order, at).select(*by, (F.col("__k") - F.col("__o")).alias(key), name, order)
    best = spread.groupBy(*by, key).agg(F.min_by(name, F.struct(order, name)).alias(name))
    return left.join(best, [*by, key], "left").select(*left.columns, name)


def address_number(text: Column) -> Column:
    """The number of a hexadecimal address, with or without 0x and leading zeros; null for other text."""
    digits = F.regexp_extract(F.trim(text), "^(?:0[xX])?([0-9a-fA-F]{1,16})$", 1)
    return F.when(digits != "", F.conv(digits, 16, 10).cast("decimal(20,0)"))


def same_address(left: DataFrame, right: DataFrame, by: list[str], address: str) -> DataFrame:
    """Rows of left with the row of right of the same address, however each writes it (the smallest row, if several); rows without one are left out."""
    other = [c for c in right.columns if c not in (*by, address)]
    r = right.withColumn("__a", address_number(F.col(address))).groupBy(*by, "__a").agg(F.min(F.struct(*other)).alias("__r"))
    j = left.withColumn("__a", address_number(F.col(address))).join(r, [*by, "__a"])
    return j.select(*left.columns, *[F.col(f"__r.{c}").alias(c) for c in other])


def three_way(left: DataFrame, graphs: DataFrame, by: str, address: str, name: str, graph: str) -> DataFrame:
    """Adds graph and how: a graph at the address, else at address + 4, else one of the row's name.

    graphs(by, address, name, graph); address or name may be null and then match nothing.
    """
    at = graphs.where(F.col(address).isNotNull()).select(by, F.explode(F.array(F.struct(F.lit(0).alias("p"), F.col(address).alias("a")), F.struct(F.lit(1).alias("p"), (F.col(address) - 4).alias("a")))).alias("s"), graph)
    at = at.groupBy(by, F.col("s.a").alias(address)).agg(F.min(F.struct("s.p", graph)).alias("__a"))
    named = graphs.where(F.col(name).isNotNull()).groupBy(by, name).agg(F.min(graph).alias("__n"))
    j = left.join(at, [by, address], "left").join(named, [by, name], "left")
    how = F.when(F.col("__a.p") == 0, "address").when(F.col("__a.p") == 1, "plus4").when(F.col("__n").isNotNull(), "name")
    return j.select(*left.columns, F.coalesce(f"__a.{graph}", "__n").alias(graph), how.alias("how"))


def prefix_overlap(left: DataFrame, right: DataFrame, name: str, least: int = 5) -> DataFrame:
    """(left name, right name) that are equal, or one of which starts with the other where the left has at least so many characters.

    All prefixes of the longer name are generated and joined by equality, so no pair of unrelated names is made.
    """
    a, b = left.select(F.col(name).alias("a")).distinct(), right.select(F.col(name).alias("b")).distinct()
    cut = lambda c: F.explode(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substring(F.col(c), F.lit(1), i)))
    down = b.where("length(b) > 0").select("b", cut("b").alias("a")).join(a, "a").where((F.col("a") == F.col("b")) | (F.length("a") >= least))
    up = a.where(F.length("a") >= least).select("a", cut("a").alias("b")).join(b, "b")
    return down.select("a", "b").union(up.select("a", "b")).distinct()


def overlap_of(pairs: DataFrame, sets: DataFrame, owner: str, element: str) -> DataFrame:
    """(a, b, inter, ratio) of given pairs of owners: shared multiset size over the size of a."""
    c = sets.groupBy(owner, element).agg(F.count("*").alias("k"))
    a = c.select(F.col(owner).alias("a"), element, F.col("k").alias("ka"))
    b = c.select(F.col(owner).alias("b"), element, F.col("k").alias("kb"))
    n = c.groupBy(F.col(owner).alias("a")).agg(F.sum("k").alias("n"))
    inter = pairs.join(a, "a").join(b, ["b", element]).groupBy("a", "b").agg(F.sum(F.least("ka", "kb")).alias("inter"))
    return pairs.join(inter, ["a", "b"], "left").join(n, "a").select("a", "b", F.coalesce("inter", F.lit(0)).alias("inter"), (F.coalesce("inter", F.lit(0)) / F.col("n")).alias("ratio"))


def band_pairs(rows: DataFrame, by: str, pos: str, k: int) -> DataFrame:
    """(by, pos, n_pos) of the rows within k positions of each other, itself excluded: an equi-join on shifted positions."""
    shifted = rows.select(by, F.col(pos).alias("n_pos")).withColumn("d", F.explode(F.sequence(F.lit(-k), F.lit(k)))).where("d <> 0")
    return rows.select(by, pos).join(shifted.select(by, "n_pos", (F.col("n_pos") + F.col("d")).alias(pos)), [by, pos])


def overlap_pairs(sets: DataFrame, owner: str, element: str, least: float, min_size: int) -> DataFrame:
    """(a, b, inter, coef): pairs of owners by overlap coefficient, by an exact prefix filter.

    A pair at the least shares ceil(least * n) of the smaller set, so one of the smaller's first n - ceil(least * n) + 1
    elements, rare ones first, is in the larger: only those are joined with all elements, and the shared elements of candidates are
    counted by joins. Where there are FEW owners at most, each element has instead a bit for each of its owners, and equal ones are counted
    together, so that elements are shuffled once and no owner's elements are sorted. Rows hold an element or an array of elements.
    """
    few = [r[0] for r in sets.select(owner).where(F.col(owner).isNotNull()).distinct().limit(FEW + 1).collect()]
    if len(few) <= FEW:
        return _overlap_by_bits(sets, owner, element, few, least, min_size)
    s = _elements(sets, F.col(owner), element).select(F.col("o").alias(owner), F.col("e").alias(element)).distinct()
    n = s.groupBy(owner).agg(F.count("*").alias("n")).where(F.col("n") >= min_size)
    df = s.groupBy(element).agg(F.count("*").alias("df"))
    s = _cut(s.join(n, owner).join(df, element).where("df > 1").withColumn("at", F.row_number().over(Window.partitionBy(owner).orderBy("df", element))))
    # Elements of one owner are in no pair; leaving them out first only moves the others forward.
    single = F.col("n") - F.count("*").over(Window.partitionBy(owner))
    s = s.withColumn("at", F.col("at") + single)
    first = s.where(F.col("at") <= F.col("n") - F.ceil(least * F.col("n") - 1e-9) + 1)
    a = first.select(F.col(owner).alias("x"), F.col("n").alias("n_x"), element)
    b = s.select(F.col(owner).alias("y"), F.col("n").alias("n_y"), element)
    smaller = (F.col("n_x") < F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("x") < F.col("y")))
    cand = a.join(b, element).where(smaller).select("x", "y", "n_x").distinct()
    j = shared(cand, s.select(owner, element), owner, element).join(cand, ["x", "y"])
    j = j.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "inter", (F.col("inter") / F.col("n_x")).alias("coef"))
    return j.where(F.col("coef") >= least)


#: Owners that are bits of one number.
FEW = 62


def _elements(sets: DataFrame, o: Column, element: str) -> DataFrame:
    """(o, e), a row for each element, from rows of an element or of an array of elements; nulls are left out."""
    many = isinstance(sets.schema[element].dataType, T.ArrayType)
    e = F.explode(F.array_distinct(element)) if many else F.col(element)
    return sets.select(o.alias("o"), e.alias("e")).where("o is not null and e is not null")


def _overlap_by_bits(sets: DataFrame, owner: str, element: str, owners: list, least: float, min_size: int) -> DataFrame:
    kind = sets.schema[owner].dataType
    names = F.array(*map(F.lit, owners)).cast(T.ArrayType(kind))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.array_position(names, F.col(owner)) - 1).cast("int"))
    held = _elements(sets, F.when(F.col(owner).isNotNull(), bit), element).groupBy("e").agg(F.bit_or("o").alias("m"))
    held = _cut(held.groupBy("m").agg(F.count("*").alias("c")))
    at = F.filter(F.sequence(F.lit(0), F.lit(max(len(owners) - 1, 0))), lambda i: F.call_function("shiftright", F.col("m"), i).bitwiseAND(F.lit(1)) == 1)
    held = held.select("c", at.alias("os"))
    n = held.select(F.explode("os").alias("o"), "c").groupBy("o").agg(F.sum("c").alias("n")).where(F.col("n") >= min_size)
    both = F.explode(F.flatten(F.transform("os", lambda x: F.transform(F.filter("os", lambda y: y > x), lambda y: F.struct(x.alias("x"), y.alias("y"))))))
    j = held.select("c", both.alias("p")).groupBy("p.x", "p.y").agg(F.sum("c").alias("inter"))
    j = j.join(n.select(F.col("o").alias("x"), F.col("n").alias("n_x")), "x").join(n.select(F.col("o").alias("y"), F.col("n").alias("n_y")), "y")
    a, b = F.get(names, F.col("x")), F.get(names, F.col("y"))
    return j.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), "inter", (F.col("inter") / F.least("n_x", "n_y")).alias("coef")).where(F.col("coef") >= least)


def shared(pairs: DataFrame, sets: DataFrame, owner: str, element: str) -> DataFrame:
    """(x, y, inter): how many elements the owners of each pair share (no row: none).

    An element of x meets y by equality on (y, element) and is added up within tasks, so no set is ever a single row.
    """
    x = pairs.select("x", "y").join(sets.select(F.col(owner).alias("x"), element), "x")
    return x.join(sets.select(F.col(owner).alias("y"), element), ["y", element]).groupBy("x", "y").agg(F.count("*").alias("inter"))


def _hashed(sets: DataFrame, owner: str, element: str) -> DataFrame:
    """(o, es): the elements of each owner as sorted 64-bit hashes. Rows hold an element or an array of elements, of which no row is made; nulls are left out."""
    s = sets.where(F.col(element).isNotNull() & F.col(owner).isNotNull())
    if not isinstance(sets.schema[element].dataType, T.ArrayType):
        return s.groupBy(F.col(owner).alias("o")).agg(F.array_sort(F.collect_set(F.xxhash64(element))).alias("es"))
    es = F.array_sort(F.array_distinct(F.transform(F.array_compact(element), lambda x: F.xxhash64(x))))
    s = s.select(F.col(owner).alias("o"), es.alias("es")).where(F.size("es") > 0)
    if s.groupBy("o").agg(F.count("*").alias("c")).where("c > 1").isEmpty():
        return s
    return s.groupBy("o").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("es")))).alias("es"))


def _similar_classes(sets: DataFrame, owner: str, element: str, least: float) -> tuple[DataFrame, DataFrame]:
    """(member, both): member(rep, o, n) names the class of each owner by its smallest owner; both(x, y, inter, jaccard) are the pairs of classes, by blocks.

    Owners are whole numbers. Their sets are read twice: for the classes, by 128 bits of them, and for those of the smallest owners.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    own = _hashed(sets, owner, element)
    kind = _cut(own.select("o", F.struct(F.xxhash64("es").alias("a"), F.xxhash64(F.lit(1), "es").alias("b")).alias("k"), F.size("es").cast("long").alias("n")))
    rep = kind.groupBy("k").agg(F.min("o").alias("rep"))
    member = _cut(kind.hint("merge").join(rep, "k").select("rep", "o", "n"))
    lead = member.where("rep = o").select("o").distinct()
    packed = own.select(F.col("o").cast("long").alias("rep"), F.size("es").cast("long").alias("n"), "es").mapInArrow(pack("es"), "rep long, n long, es binary")
    lead = lead.select(F.col("o").cast("long").alias("rep"))
    both = like_sets(packed.join(lead if lead.count() > FEW_ROWS else F.broadcast(lead), "rep", "left_semi"), least)
    return member, both.select("x", "y", "inter", (F.col("inter") / (F.col("n_x") + F.col("n_y") - F.col("inter"))).alias("jaccard"))


#: Whole numbers of a broadcast table.
FEW_ROWS = 500_000


def similar_pairs(sets: DataFrame, owner: str, element: str, least: float) -> DataFrame:
    """(a, b, inter, jaccard) of all pairs of owners with Jaccard least (above 0) of their full sets, exact; rows hold an element or an array of elements.

    Owners of identical sets are one class, for which its smallest owner stands; classes meet by blocks in tasks of their own, so that only
    pairs that count are shuffled.
    """
    member, both = _similar_classes(sets, owner, element, least)
    a, b = member.select(F.col("rep").alias("x"), F.col("o").alias("a"), "n"), member.select(F.col("rep").alias("y"), F.col("o").alias("b"))
    same = a.join(b, F.col("x") == F.col("y")).where("a < b").select("a", "b", F.col("n").alias("inter"), F.lit(1.0).alias("jaccard"))
    near = both.join(a.drop("n"), "x").join(b, "y").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "inter", "jaccard")
    return same.union(near)


def similar_links(sets: DataFrame, owner: str, element: str, least: float) -> tuple[DataFrame, DataFrame]:
    """(owners, classes): what similar_pairs finds, without the pairs of copies.

    owners(owner, class_id, size, links): each owner with its class of identical sets (its smallest owner), the class's size and the
    owners of Jaccard least or more, itself left out. classes(a, b, inter, jaccard): pairs of different classes. Rows grow with owners and pairs
    of different sets.
    """
    member, both = _similar_classes(sets, owner, element, least)
    both = _cut(both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "inter", "jaccard"))
    size = member.groupBy("rep").agg(F.count("*").alias("size"))
    ends = both.select(F.col("a").alias("rep"), F.col("b").alias("other")).union(both.select("b", "a"))
    far = ends.join(size.select(F.col("rep").alias("other"), "size"), "other").groupBy("rep").agg(F.sum("size").alias("far"))
    own = size.join(far, "rep", "left").select("rep", "size", (F.col("size") - 1 + F.coalesce("far", F.lit(0))).alias("links"))
    return member.join(own, "rep").select(F.col("o").alias(owner), F.col("rep").alias("class_id"), "size", "links"), both


def nearest(left: DataFrame, right: DataFrame, by: str, lkey: str, rkey: str, rid: str) -> DataFrame:
    """Adds near (right rid) and delta: the closest right key of the same group; ties go to the earlier key, then the smaller id.

    Both sides are one order of (group, key), dealt by ranges: the last right key at or before a row and the first behind it are carried
    within a range and from range to range, so that a group of any size is shared by many tasks.
    """
    one = right.where(F.col(rkey).isNotNull()).groupBy(by, rkey).agg(F.min(rid).alias("__id"))
    l_kind = left.select(F.struct(*left.columns).alias("p")).schema["p"].dataType
    r = one.select(by, F.col(rkey).alias("__k"), F.lit(0).alias("__side"), F.lit(None).cast("long").alias("__n"), F.lit(None).cast(l_kind).alias("__l"), F.struct(F.col(rkey).alias("k"), F.col("__id").alias("r")).alias("__hit"))
    hit_kind = r.schema["__hit"].dataType
    s = _cut(left.withColumn("__n", F.monotonically_increasing_id()))
    u = s.select(by, F.col(lkey).cast(r.schema["__k"].dataType).alias("__k"), F.lit(1).alias("__side"), "__n", F.struct(*left.columns).alias("__l"), F.lit(None).cast(hit_kind).alias("__hit"))
    u = carried(r.unionByName(u), ["__k", "__side", "__n"], {"__p": F.col("__hit")}, {"__a": F.col("__hit")}, [by]).where("__side = 1")
    dp, dn = F.col("__k") - F.col("__p.k"), F.col("__a.k") - F.col("__k")
    first = F.col("__a").isNull() | (dp <= dn)
    return u.select("__l.*", F.when(first, F.col("__p.r")).otherwise(F.col("__a.r")).alias("near"), F.when(first, dp).otherwise(dn).alias("delta"))


def interval_join(points: DataFrame, ranges: DataFrame, point: str, width: int) -> DataFrame:
    """Points with the half-open range [lo, hi) that holds them, joined on cells of the given width."""
    cells = ranges.withColumn("__c", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    return points.withColumn("__c", F.floor(F.col(point) / width)).join(cells, "__c").where((F.col(point) >= F.col("lo")) & (F.col(point) < F.col("hi"))).drop("__c")


def longest_prefix(rows: DataFrame, known: DataFrame, text: str, prefix: str, sep: str) -> DataFrame:
    """Adds prefix: the longest known one that ends at a separator; candidates are generated and joined by equality."""
    parts = F.split(F.col(text), sep)
    cut = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), sep))
    cand = rows.select(text).distinct().withColumn(prefix, F.explode(cut))
    best = cand.join(known.select(prefix).distinct(), prefix).groupBy(text).agg(F.max_by(prefix, F.length(prefix)).alias(prefix))
    return rows.join(best, text, "left")


def vote(rows: DataFrame, query: str, label: str, sim: str) -> DataFrame:
    """Majority label of each query's neighbours; ties by best similarity, then label."""
    g = rows.groupBy(query, label).agg(F.count("*").alias("votes"), F.max(sim).alias("best"))
    return g.groupBy(query).agg(F.min_by(F.struct(label, "votes"), F.struct(-F.col("votes"), -F.col("best"), label)).alias("w")).select(query, "w.*")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
