"""A task of the neighbour search takes memory by its blocks, not by the rows it holds, and gives the same neighbours."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from weftline.operators import retrieval


def _sides(n_q, n_t):
    rng = np.random.default_rng(4)
    vectors = lambda n: pa.array(list(rng.normal(size=(n, 64)).astype(np.float32)), pa.list_(pa.float32()))
    left = pa.table({"q_id": np.arange(n_q), "v": vectors(n_q), "allow": pa.array([None if i % 3 == 0 else [i % 3] for i in range(n_q)], pa.list_(pa.int32()))})
    right = pa.table({"t_id": np.arange(n_t)[::-1].copy(), "t_label": np.arange(n_t, dtype=np.int32), "t_group": np.arange(n_t, dtype=np.int32) % 4, "v": vectors(n_t)})
    return left, right


@pytest.mark.parametrize("masked", [False, True])
def test_memory_of_a_block(masked):
    left, right = _sides(2048, 16_384)
    tracemalloc.start()
    retrieval.block_top(left, right, 5, masked)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6


@pytest.mark.parametrize("masked", [False, True])
def test_a_block_equals_brute_force(masked, monkeypatch):
    monkeypatch.setattr(retrieval, "ASKED", 7)
    monkeypatch.setattr(retrieval, "BLOCK", 11)
    left, right = _sides(30, 95)
    got = retrieval.block_top(left, right, 3, masked).to_pylist()
    a, b = (np.array(t["v"].to_pylist(), np.float64) for t in (left, right))
    want = []
    for q in range(30):
        allow = left["allow"][q].as_py() if masked else None
        hits = [(-float(a[q] @ b[i]), right["t_id"][i].as_py()) for i in range(95) if allow is None or i % 4 in allow]
        want += [(q, t) for _, t in sorted(hits)[:3]]
    assert [(r["q_id"], r["t_id"]) for r in got] == want
