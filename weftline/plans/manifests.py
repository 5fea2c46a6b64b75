"""Keyed assembly of thirteen tables by their ids, and the named coverage sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import manifest as M
from weftline.plans.base import registry

QUERIES, ORACLES, query = registry()

# Source: table, id, other columns. The order settles which source a column is taken from.
_SOURCES = {
    "ir": ("documents", "doc_id", {"lang": "lang", "source": "source"}),
    "stripped": ("sale_lines", "sale_id", {"stripped_id": "vendor_id", "flag": "flag"}),
    "labels": ("labels", "doc_id", {"quality": "quality"}),
    "graphs": ("embeddings", "vec_id", {"label": "label"}),
    "debug": ("client_changes", "client_id", {"debug_id": "city", "source": "source"}),
    "match": ("benchmark", "item_id", {}),
    "split": ("conversations", "conv_id", {}),
    "main": ("pages", "page_id", {}),
    "extra": ("items", "item_id", {"brand": "brand"}),
    "remote": ("sales", "sale_id", {"flag": "status"}),
    "remote_ir": ("clicks", "click_id", {}),
    "remote_labels": ("stamps", "stamp_id", {"source": "source"}),
    "remote_graphs": ("orders", "o_orderkey", {}),
}
_COLUMNS, _SEVERAL = ["lang", "source", "flag", "quality", "label", "brand"], ["stripped_id", "debug_id"]


def _assembled(t):
    sources = {n: getattr(t, table).select(F.col(key).alias("id"), *[F.col(c).alias(a) for a, c in cols.items()]) for n, (table, key, cols) in _SOURCES.items()}
    return M.assemble(sources, "id", _COLUMNS, _SEVERAL)


_ALL = ", ".join((*_COLUMNS, *_SEVERAL))
_UNION = " UNION ALL BY NAME ".join(f"SELECT {key} AS id, {i} AS s{''.join(f', {c} AS {a}' for a, c in cols.items())} FROM {table}" for i, (table, key, cols) in enumerate(_SOURCES.values()))
_FIRST = ", ".join(f"arg_min({c}, {{'s': s, 'v': {c}}}) FILTER ({c} IS NOT NULL) AS {c}" for c in _COLUMNS)
_SQL = f"u AS ({_UNION}), m AS (SELECT id, {_FIRST}, count(DISTINCT stripped_id) AS n_stripped_id, count(DISTINCT debug_id) AS n_debug_id, bit_or(1::BIGINT << s) AS mask FROM u WHERE id IS NOT NULL GROUP BY id)"


@query(f"WITH {_SQL} SELECT * FROM m")
def manifest_rows(t):
    """One row an id of any table, with what the first table that knows says, and which tables have it."""
    return _assembled(t)


_BIT = {n: f"(mask >> {i}) % 2 = 1" for i, n in enumerate(_SOURCES)}
_NOT = {n: f"(mask >> {i}) % 2 = 0" for i, n in enumerate(_SOURCES)}
_RULES = [
    (_BIT["ir"], _NOT["stripped"]), (_BIT["stripped"], _NOT["ir"]), (_BIT["labels"], _NOT["graphs"]), (_BIT["graphs"], _NOT["labels"]),
    (_BIT["debug"], _NOT["labels"]), (_BIT["labels"], _NOT["debug"]), (_BIT["graphs"], _NOT["match"], _BIT["main"]),
    (_BIT["remote"], _NOT["main"], _NOT["extra"]), (_NOT["remote"],), (_NOT["remote"], _BIT["main"], _NOT["extra"]), (_BIT["match"], _NOT["split"]),
    (_BIT["split"], _NOT["graphs"]), (_BIT["remote_ir"], _NOT["ir"]), (_BIT["ir"], _NOT["remote_ir"], _BIT["remote"]),
    (_BIT["remote_labels"], _NOT["labels"]), (_BIT["remote_graphs"], _NOT["graphs"]), ("n_stripped_id > 1",), ("n_debug_id > 1",),
]
_EACH = " UNION ALL ".join(f"SELECT '{n}' AS set, count(*) FILTER ({' AND '.join(r)}) AS n FROM m" for n, r in zip(M.SETS, _RULES, strict=True))


@query(f"WITH {_SQL} {_EACH}")
def coverage_sets(t):
    return M.coverage(_assembled(t), list(_SOURCES))
