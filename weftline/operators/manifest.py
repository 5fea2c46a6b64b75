"""Keyed assembly of many sources in one shuffle, and counts of named sets of present and absent sources."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def assemble(sources: dict[str, DataFrame], key: str, columns: list[str], several: list[str] | None = None) -> DataFrame:
    """(key, columns, mask): one row a key of any source.

    A column is taken from the first source, in the order given, that has a value for the key (the smallest value, if its rows differ);
    a source without it counts as null. mask has a bit for each source that has the key. For each name of
    several, a source or not, n_<name> counts the different values of that column over all rows of the key. Null keys are dropped.
    """
    several = several or []
    kinds = {c: df.schema[c].dataType for df in reversed(sources.values()) for c in (*columns, *several) if c in df.columns}
    rows = [df.select(F.col(key), F.lit(i).alias("__s"), *[(F.col(c) if c in df.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in kinds]) for i, df in enumerate(sources.values())]
    first = [F.min(F.when(F.col(c).isNotNull(), F.struct("__s", c)))[c].alias(c) for c in columns]
    counts = [F.count_distinct(c).alias(f"n_{c}") for c in several]
    mask = F.bit_or(F.expr("shiftleft(1L, __s)")).alias("mask")
    return reduce(DataFrame.unionByName, rows).where(F.col(key).isNotNull()).groupBy(key).agg(*first, *counts, mask)


Has = Callable[[str], Column]

# The named sets of the coverage report, in order.
SETS: dict[str, Callable[[Has], Column]] = {
    "ir but no stripped binary": lambda h: h("ir") & ~h("stripped"),
    "stripped binary but no ir": lambda h: h("stripped") & ~h("ir"),
    "labels but no graphs": lambda h: h("labels") & ~h("graphs"),
    "graphs but no labels": lambda h: h("graphs") & ~h("labels"),
    "debug binary but no labels": lambda h: h("debug") & ~h("labels"),
    "labels but no debug binary": lambda h: h("labels") & ~h("debug"),
    "graphs but not in match index": lambda h: h("graphs") & ~h("match") & h("main"),
    "remote only": lambda h: h("remote") & ~h("main") & ~h("extra"),
    "local only, all corpora": lambda h: ~h("remote"),
    "local only, main corpus": lambda h: ~h("remote") & h("main") & ~h("extra"),
    "in match index but not in split": lambda h: h("match") & ~h("split"),
    "in split but no graphs": lambda h: h("split") & ~h("graphs"),
    "remote ir but no local ir": lambda h: h("remote_ir") & ~h("ir"),
    "local ir but no remote ir": lambda h: h("ir") & ~h("remote_ir") & h("remote"),
    "remote labels but no local labels": lambda h: h("remote_labels") & ~h("labels"),
    "remote graphs but no local graphs": lambda h: h("remote_graphs") & ~h("graphs"),
    "stripped copies of different builds": lambda h: F.col("n_stripped_id") > 1,
    "debug copies of different builds": lambda h: F.col("n_debug_id") > 1,
}


def coverage(assembled: DataFrame, sources: list[str], sets: dict[str, Callable[[Has], Column]] = SETS) -> DataFrame:
    """(set, n): keys in each named set, all counted in one pass."""
    has = lambda s: F.col("mask").bitwiseAND(F.lit(1 << sources.index(s))) != 0
    counts = assembled.agg(*[F.count_if(rule(has)).alias(f"c{i}") for i, rule in enumerate(sets.values())])
    named = F.explode(F.array(*[F.struct(F.lit(name).alias("set"), F.col(f"c{i}").alias("n")) for i, name in enumerate(sets)]))
    return counts.select(named.alias("x")).select("x.*")
