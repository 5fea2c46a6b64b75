"""Named queries over the driver's tables and the SQL that gives the same rows."""

from __future__ import annotations

from weftline.plans import assembly, context, graphs, joins, manifests, names, retrieval, splits, stats

_ALL = (names, stats, joins, context, splits, retrieval, assembly, graphs, manifests)
QUERIES = {k: f for m in _ALL for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in _ALL for k, s in m.ORACLES.items()}
