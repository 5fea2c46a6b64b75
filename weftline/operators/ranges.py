"""Running sums, row numbers and carried values over one global order, or over groups of any size, by many tasks.

Rows are dealt by ranges of the order and written once, so ranges stay as they are. Windows run inside a range. What earlier
ranges add is a table with a row for each range at most, because only the first group of a range can have begun
before it; that table is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.split import _cut

Order = list[str | Column]


def ranged(rows: DataFrame, order: Order) -> DataFrame:
    """Rows with __r, the number of their range; ranges ascend with the order. Rows of equal order share a range."""
    return _cut(rows.repartitionByRange(*order).withColumn("__r", F.spark_partition_id()))


def _earlier(per_range: DataFrame, by: list[str], later: bool = False) -> Window:
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))  # over ranges, not rows
    return w.orderBy("__r").rowsBetween(1, Window.unboundedFollowing) if later else w.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)


def _brought(rows: DataFrame, brought: DataFrame, by: list[str]) -> DataFrame:
    b = brought.select(F.col("__r").alias("__q"), *[F.col(c).alias(f"__by_{c}") for c in by], *[c for c in brought.columns if c not in ("__r", *by)])
    on = F.col("__r") == F.col("__q")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    return rows.join(F.broadcast(b), on, "left")


def running(rows: DataFrame, order: Order, sums: dict[str, Column] | None = None, by: list[str] | None = None, number: str = "i") -> DataFrame:
    """Adds the row's number (from 1) in the order of its group, and for each name the sum of its column up to and with the row.

    The order must tell rows of a group apart. Nulls add nothing; a sum without any value is 0.
    """
    by, sums = by or [], sums or {}
    own = {f"__v{n}": F.coalesce(c, F.lit(0)) for n, c in enumerate(sums.values())}
    r = ranged(rows.withColumns(own) if own else rows, [*by, *order])
    totals = r.groupBy("__r", *by).agg(F.count("*").alias("__c"), *[F.sum(v).alias(f"__t{n}") for n, v in enumerate(own)])
    w = _earlier(totals, by)
    before = totals.select("__r", *by, F.sum("__c").over(w).alias("__b"), *[F.sum(f"__t{n}").over(w).alias(f"__b{n}") for n in range(len(own))]).where("__b is not null")
    at = Window.partitionBy("__r", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumns({"__n": F.row_number().over(Window.partitionBy("__r", *by).orderBy(*order))} | {f"__s{n}": F.sum(v).over(at) for n, v in enumerate(own)})
    j = _brought(r, before, by)
    added = [(F.col(f"__s{n}") + F.coalesce(f"__b{n}", F.lit(0))).alias(name) for n, name in enumerate(sums)]
    return j.select(*[c for c in rows.columns if c not in (number, *sums)], (F.col("__n") + F.coalesce("__b", F.lit(0))).alias(number), *added)


def carried(rows: DataFrame, order: Order, before: dict[str, Column] | None = None, after: dict[str, Column] | None = None, by: list[str] | None = None) -> DataFrame:
    """Adds for each name of before the last non-null value of its column at or before the row, for each of after the first at or behind it.

    Values do not leave their group. The order must tell rows of a group apart.
    """
    by, before, after = by or [], before or {}, after or {}
    own = {f"__v{n}": c for n, c in enumerate([*before.values(), *after.values()])}
    names = [*before, *after]
    r = ranged(rows.withColumns(own), [*by, *order])
    w = Window.partitionBy("__r", *by).orderBy(*order)
    up, down = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    r = r.withColumns({"__n": F.row_number().over(w)} | {f"__s{n}": F.last(v, True).over(up) if n < len(before) else F.first(v, True).over(down) for n, v in enumerate(own)})
    place = lambda v: F.when(F.col(v).isNotNull(), F.col("__n"))
    ends = r.groupBy("__r", *by).agg(*[(F.max_by if n < len(before) else F.min_by)(v, place(v)).alias(f"__t{n}") for n, v in enumerate(own)])
    past, ahead = _earlier(ends, by), _earlier(ends, by, later=True)
    brought = ends.select("__r", *by, *[(F.last(f"__t{n}", True).over(past) if n < len(before) else F.first(f"__t{n}", True).over(ahead)).alias(f"__b{n}") for n in range(len(own))])
    brought = brought.where(F.coalesce(*[F.when(F.col(f"__b{n}").isNotNull(), 1) for n in range(len(own))]).isNotNull())
    j = _brought(r, brought, by)
    return j.select(*[c for c in rows.columns if c not in names], *[F.coalesce(f"__s{n}", f"__b{n}").alias(name) for n, name in enumerate(names)])


def at_ranks(rows: DataFrame, by: str, value: str, ranks: dict[str, Column]) -> DataFrame:
    """(by, one column a name): of a group's n non-null values, ascending, the one at each rank; ranks are expressions over n, from 1."""
    known = rows.where(F.col(value).isNotNull()).select(by, value)
    counted = known.groupBy(by, value).agg(F.count("*").alias("__k"))
    r = running(counted, [value], {"__upto": F.col("__k")}, [by]).withColumn("__from", F.col("__upto") - F.col("__k"))
    sizes = known.groupBy(by).agg(F.count("*").alias("n"))
    asked = sizes.select(F.col(by).alias("__g"), *[c.cast("long").alias(f"__at_{name}") for name, c in ranks.items()])
    hit = r.join(asked, F.col(by).eqNullSafe(F.col("__g")))
    inside = lambda name: (F.col(f"__at_{name}") > F.col("__from")) & (F.col(f"__at_{name}") <= F.col("__upto"))
    return hit.groupBy(by).agg(*[F.max(F.when(inside(name), F.col(value))).alias(name) for name in ranks])
