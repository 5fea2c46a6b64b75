"""Exhaustive top-k retrieval by cosine, as blocked matrix products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries and index rows multiplied at a time, and rows of either that a task holds. A task's Python takes some tens of MB by these, whatever the tables.
ASKED, BLOCK, HELD = 256, 2048, 32_768


def knn(queries: DataFrame, index: DataFrame, k: int, masked: bool = False) -> DataFrame:
    """(q_id, t_id, t_label, sim, rank) for queries(q_id, v) against index(t_id, t_label, v), unit vectors.

    Both sides are dealt to blocks of some HELD rows, as many as their counts ask for, and every block of queries meets
    every block of the index in a task of its own; each keeps its own k best, so one shuffle of k rows a query and
    block gives the answer. Ties: lower t_id. Matrix products find candidates, doubles summed in order decide.
    masked: queries have an array allow of groups (null: all) and the index has t_group; a query meets only index rows of its groups, which are
    picked out inside the task, so neither side is copied for the mask. A query without such rows has no result.
    """
    n_q, n_t = max(1, -(-queries.count() // HELD)), max(1, -(-index.count() // HELD))
    n_q, n_t = max(n_q, min(8, n_q * n_t * 8)), n_t
    deal = lambda df, key, c, n: df.withColumn(c, F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = deal(queries, "q_id", "bq", n_q).withColumn("bt", every(n_t))
    t = deal(index, "t_id", "bt", n_t).withColumn("bq", every(n_q))
    keys = ["bq", "bt"]

    def top(left: pa.Table, right: pa.Table) -> pa.Table:
        return block_top(left, right, k, masked)

    part = q.groupBy(*keys).cogroup(t.groupBy(*keys)).applyInArrow(top, "q_id long, t_id long, t_label int, sim double")
    w = Window.partitionBy("q_id").orderBy(F.round("sim", 12).desc(), "t_id")
    return part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def block_top(left: pa.Table, right: pa.Table, k: int, masked: bool = False) -> pa.Table:
    """The k best of a block of the index for each query of a block; vectors become doubles a few at a time."""
    if not left.num_rows or not right.num_rows:
        return _SCHEMA.empty_table()
    ids, queries, rows = right["t_id"].to_numpy(), _matrix(left["v"]), _matrix(right["v"])
    more = min(k + 8, len(rows))
    barred = _barred(left["allow"], right["t_group"]) if masked else None
    parts = []
    for start in range(0, len(queries), ASKED):
        x = queries[start : start + ASKED].astype(np.float64)
        best_s, best_i = np.full((len(x), 0), 0.0), np.zeros((len(x), 0), np.int64)
        for at in range(0, len(rows), BLOCK):
            stop = min(at + BLOCK, len(rows))
            now = x @ rows[at:stop].astype(np.float64).T
            if barred is not None:
                now[barred(start, start + len(x), at, stop)] = -np.inf
            s = np.hstack([best_s, now])
            i = np.hstack([best_i, np.broadcast_to(np.arange(at, stop), now.shape)])
            order = np.lexsort((ids[i], -np.round(s, 12)), axis=1)[:, :more]
            best_s, best_i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
        exact = np.where(best_s == -np.inf, -np.inf, np.einsum("ij,ikj->ik", x, rows[best_i].astype(np.float64)))
        order = np.lexsort((ids[best_i], -np.round(exact, 12)), axis=1)[:, :k]
        parts.append((np.take_along_axis(exact, order, 1), np.take_along_axis(best_i, order, 1)))
    best_s, best_i = np.vstack([p[0] for p in parts]), np.vstack([p[1] for p in parts])
    out = [pa.array(np.repeat(left["q_id"].to_numpy(), best_s.shape[1])), pa.array(ids[best_i].ravel()), right["t_label"].take(pa.array(best_i.ravel())).combine_chunks(), pa.array(best_s.ravel())]
    return pa.Table.from_arrays(out, schema=_SCHEMA).filter(pa.array(best_s.ravel() > -np.inf))


def knn_masked(queries: DataFrame, index: DataFrame, allowed: DataFrame, k: int) -> DataFrame:
    """knn among the index rows whose group a query's group allows; the mask is lifted where fewer than k rows survive it.

    queries(q_id, q_group, v), index(t_id, t_label, t_group, v), allowed(q_group, t_group).
    """
    size = index.groupBy("t_group").agg(F.count("*").alias("n"))
    allowed = allowed.distinct()
    held = allowed.join(size, "t_group").groupBy("q_group").agg(F.sum("n").alias("n"), F.collect_list("t_group").alias("allow")).where(F.col("n") >= k)
    asked = queries.join(held.select("q_group", "allow"), "q_group", "left").select("q_id", "v", "allow")
    return knn(asked, index.select("t_id", "t_label", "t_group", "v"), k, masked=True)


def _barred(allow: pa.ChunkedArray, groups: pa.ChunkedArray):
    """A function of a range of queries and one of index rows that gives where (query, index row) is outside the query's groups; a row a different list."""
    coded = groups.combine_chunks().dictionary_encode()
    code = coded.indices.fill_null(len(coded.dictionary)).to_numpy()
    place = {g: i for i, g in enumerate(coded.dictionary.to_pylist())}
    lists: dict = {}
    own = np.array([lists.setdefault(None if x is None else tuple(x), len(lists)) for x in allow.to_pylist()])
    table = np.zeros((len(lists), len(place) + 1), bool)
    for x, i in lists.items():
        if x is not None:
            table[i] = True
            table[i, [place[g] for g in x if g in place]] = False
    return lambda a, b, c, d: table[own[a:b, None], code[None, c:d]]


def similar_groups(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """(q_group, t_group) whose sets of a(q_group, e) and b(t_group, e) have Jaccard least or more; an empty set is like none."""
    a, b = a.distinct(), b.distinct()
    n_a, n_b = a.groupBy("q_group").agg(F.count("*").alias("n_a")), b.groupBy("t_group").agg(F.count("*").alias("n_b"))
    inter = a.join(b, "e").groupBy("q_group", "t_group").agg(F.count("*").alias("i"))
    j = inter.join(n_a, "q_group").join(n_b, "t_group")
    return j.where(F.col("i") / (F.col("n_a") + F.col("n_b") - F.col("i")) >= least).select("q_group", "t_group")


_SCHEMA = pa.schema([("q_id", pa.int64()), ("t_id", pa.int64()), ("t_label", pa.int32()), ("sim", pa.float64())])


def _matrix(col: pa.ChunkedArray) -> np.ndarray:
    flat = col.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)
