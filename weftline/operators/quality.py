"""Assertions over tables: each check is a row (check, ok, detail); require() raises when one fails."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_range(df: DataFrame, label: str, least: int | None = None, most: int | None = None, exact: int | None = None) -> DataFrame:
    """Row count against bounds."""
    n = F.col("n")
    ok = F.lit(True)
    for bound, test in ((exact, n == F.lit(exact)), (least, n >= F.lit(least)), (most, n <= F.lit(most))):
        if bound is not None:
            ok = ok & test
    return df.agg(F.count("*").alias("n")).select(F.lit(label).alias("check"), ok.alias("ok"), n.cast("string").alias("detail"))


def no_match(df: DataFrame, label: str, column: str, patterns: list[str]) -> DataFrame:
    """No value may hold one of the forbidden texts."""
    bad = F.lit(False)
    for p in patterns:
        bad = bad | F.col(column).contains(p)
    g = df.agg(F.count_if(bad).alias("n"))
    return g.select(F.lit(label).alias("check"), (F.col("n") == 0).alias("ok"), F.col("n").cast("string").alias("detail"))


def buckets_present(df: DataFrame, label: str, column: str, wanted: list[str]) -> DataFrame:
    """Every wanted bucket must have rows."""
    g = df.where(F.col(column).isin(wanted)).agg(F.array_sort(F.array_except(F.array(*map(F.lit, wanted)), F.collect_set(column))).alias("missing"))
    return g.select(F.lit(label).alias("check"), (F.size("missing") == 0).alias("ok"), F.array_join("missing", ",").alias("detail"))


def share_at_least(df: DataFrame, label: str, condition, least: float) -> DataFrame:
    """At least this share of rows must fulfil the condition; an empty table does not."""
    g = df.agg(F.count("*").alias("n"), F.count_if(condition).alias("k"))
    share = F.col("k") / F.greatest(F.col("n"), F.lit(1))
    return g.select(F.lit(label).alias("check"), (share >= least).alias("ok"), F.concat_ws("/", "k", "n").alias("detail"))


def share_at_most(df: DataFrame, label: str, condition, most: float) -> DataFrame:
    g = df.agg(F.count("*").alias("n"), F.count_if(condition).alias("k"))
    return g.select(F.lit(label).alias("check"), (F.col("k") <= most * F.greatest(F.col("n"), F.lit(1))).alias("ok"), F.concat_ws("/", "k", "n").alias("detail"))


def median_at_least(df: DataFrame, label: str, column: str, least: float) -> DataFrame:
    g = df.agg(F.percentile(column, F.lit(0.5)).alias("m"))
    return g.select(F.lit(label).alias("check"), (F.coalesce("m", F.lit(float("-inf"))) >= least).alias("ok"), F.round("m", 6).cast("string").alias("detail"))


def reproduces(new: DataFrame, old: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(checked, mismatch): rows of both tables by key, and those whose value differs; nulls are equal."""
    j = new.select(*keys, F.col(column).alias("a")).join(old.select(*keys, F.col(column).alias("b")), keys)
    return j.agg(F.count("*").alias("checked"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("mismatch"))


def disagreements(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Count by the values of two flags that should agree, and whether they do."""
    return rows.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n")).withColumn("agree", F.col("a").eqNullSafe(F.col("b")))


def require(checks: DataFrame) -> DataFrame:
    """The checks, all of which hold; raises ValueError with those that do not (a handful of rows)."""
    bad = checks.where("not coalesce(ok, false)").collect()
    if bad:
        raise ValueError("; ".join(f"{r['check']}: {r['detail']}" for r in bad))
    return checks
