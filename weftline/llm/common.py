"""Staged tables, checked look-up joins and connected components, shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A look-up side is broadcast within this many rows and bytes of its columns; beyond either the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where that is unset and the master is local."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="weftline-")
    return _OWN[app]


def stage(df: DataFrame, name: str = "t") -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Deletes staged tables that no later plan reads."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._staged_at)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_arrow_batches(spark: SparkSession) -> None:
    """Texts can be long: keeps an Arrow batch to a thousand rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _width(dt) -> int:
    """Bytes of a value of a fixed-width type with its overhead in a row, or 0 for types of any length."""
    if dt.typeName() == "struct":
        inside = [_width(f.dataType) for f in dt.fields]
        return 16 + sum(inside) if all(inside) else 0
    return 0 if dt.typeName() in ("string", "binary", "array", "map", "variant") else 16


def fits_broadcast(small: DataFrame) -> bool:
    """Counts the rows of a staged table, and the bytes of its columns of any length, against the two bounds."""
    fixed, loose = 16, []
    for f in small.schema.fields:
        w = _width(f.dataType)
        fixed += w
        if not w:
            loose.append(F.octet_length(F.col(f.name)) if f.dataType.typeName() in ("string", "binary") else F.octet_length(F.to_json(F.array(f.name))))
    size = sum((F.coalesce(x, F.lit(0)) for x in loose), F.lit(0))
    r = small.agg(F.count("*").alias("n"), F.sum(size.cast("long")).alias("b")).first()
    return r["n"] <= BROADCAST_ROWS and r["n"] * fixed + (r["b"] or 0) <= BROADCAST_BYTES


def lookup_join(big: DataFrame, small: DataFrame, on: str | list[str] | Column, how: str = "left", rows: int | None = None, fits: bool | None = None) -> DataFrame:
    """Joins with a staged small side, broadcast only when it is within the bounds of rows and bytes.

    rows: its row count where that is known and all columns are of fixed width; fits: the answer where it is known.
    """
    if fits is None:
        fits = fits_broadcast(small) if rows is None else rows <= BROADCAST_ROWS
    return big.join(F.broadcast(small) if fits else small, on, how)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest node reachable from each node that has an edge.

    edges(a, b) of one orderable type; self-loops, repeats and nulls are dropped. Returns (node, component). Alternates
    large-star and small-star steps, each round written to the shared folder; a hot node is a skewed
    join key that adaptive execution splits, and its minimum is a partial aggregate.
    """
    spark = edges.sparkSession
    e = stage(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    mark = _mark(e)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("a"), F.col("m"), "u")
        small = small.where("a <> m").select(F.col("a").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        before, e = e, stage(small.where("u <> v").distinct(), "cc")
        unstage(before)
        after = _mark(e)
        if after == mark:
            break
        mark = after
    else:
        raise RuntimeError("components did not settle")
    lone = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return stage(lone.union(roots).groupBy("node").agg(F.min("component").alias("component")), "cc")


def _mark(e: DataFrame) -> tuple:
    r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
    return (r["n"], r["h"])
