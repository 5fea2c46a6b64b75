"""Product codes, rolling windows and packing: against brute force, on odd rows, and their SQL."""

import bisect
import hashlib
import math
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from weftline.llm import codes, packing, queries, rolling
from weftline.llm.skiplist import SkipList

DATA = "/root/testdata/sf0.001"
P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string"


@pytest.mark.parametrize("name", ["op11_codes", "op12_rolling"])
@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    cur = con.execute(queries.ORACLES[name])
    df = queries.QUERIES[name](spark, DATA)
    assert df.columns == [c[0] for c in cur.description]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, cur.fetchall()))


def test_skip_list():
    r, s, own = random.Random(2), SkipList(), []
    for _ in range(6000):
        v = r.randrange(300) if r.random() < 0.7 else r.choice([-(10**12), 0, 10**15])
        if own and r.random() < 0.45:
            v = r.choice(own)
            s.remove(v)
            own.remove(v)
        else:
            n = r.randrange(1, 4)
            s.add(v, n)
            for _ in range(n):
                bisect.insort(own, v)
        assert s.size == len(own)
        if own:
            k = r.randrange(len(own))
            assert s.at(k + 1) == own[k]
    for v in list(own):
        s.remove(v)
    with pytest.raises(KeyError):
        s.remove(1)
    with pytest.raises(IndexError):
        s.at(1)


def _windows(rows, w):
    out = []
    for doc_id, _, _, source in rows:
        at = _time(doc_id)
        got = [] if at is None else [x for x in rows if x[3] == source and _time(x[0]) is not None and at - w <= _time(x[0]) < at]
        n = sorted(len(x[1]) for x in got if x[1] is not None)
        pick = lambda a, b: n[-(-a * len(n) // b) - 1] if n else None  # noqa: E731, B023
        out.append((doc_id, w, at, len(got), sum(n), len({x[2] for x in got} - {None}), pick(1, 2), pick(99, 100)))
    return out


def _time(doc_id):
    return None if doc_id is None else 60 * ((doc_id + zlib.crc32(str(doc_id).encode()) % 1000) // 6)


@pytest.mark.parametrize("slice_rows", [1, 16, 4096])
def test_rolling_against_brute_force(spark, slice_rows):
    r = random.Random(slice_rows)
    rows = [(r.choice([None, 7, r.randrange(-500, 4000)]), r.choice([None, "", "é" * r.randrange(9), "x" * r.randrange(400)]), r.choice([None, "en", "de", "fr"]), r.choice([None, "a", "a", "a", "b"])) for _ in range(400)]
    rows += [rows[5]] * 30
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "doc_id as k", "1 as event_s", "'q' as w", "2 as part", "3 as n_events")
    got = rolling.rolling_report(df, slice_rows=slice_rows)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, _windows(rows, 1800) + _windows(rows, 86400)))


def test_rolling_edges(spark):
    assert rolling.rolling_report(spark.createDataFrame([], DOCS)).count() == 0
    far = 9 * 10**18
    got = {(r["doc_id"], r["window_s"]): r for r in rolling.rolling_report(spark.createDataFrame([(far, "a", "en", "s"), (1, None, None, None)], DOCS)).collect()}
    assert len(got) == 4 and got[far, 1800]["event_s"] is None and got[far, 1800]["n_events"] == 0
    assert got[1, 86400]["event_s"] == _time(1) and got[1, 86400]["median_chars"] is None


def test_rolling_slices_follow_density(spark):
    """A source with most rows is cut into many slices, an even one into few; results do not depend on it."""
    rows = spark.range(3000).selectExpr("case when id % 10 < 8 then 'hot' else 'cold' end as k", "id * 60 div 8 as event_s", "id % 50 as len", "'en' as lang")
    d = {(r["k"], r["w"]): r["d"] for r in rolling._slices(rows, (86400,), 256).collect()}
    assert 4 * d["hot", 86400] <= d["cold", 86400] < 86400


@pytest.mark.parametrize("width", [1, 2, 3, 4, 7, 16, 33])
def test_nearest_is_exact_with_ties_and_clusters(width):
    r = np.random.default_rng(width)
    e = r.integers(-300, 300, (64, width))
    e[9] = e[4]
    x = np.concatenate([r.integers(-300, 300, (300, width)), e[r.integers(0, 64, 300)] + r.integers(-2, 3, (300, width)), e])
    count = [0]
    at, far = codes.nearest(x, e, count)
    d = ((x[:, None, :] - e[None, :, :]) ** 2).sum(axis=2)
    assert (at == d.argmin(axis=1)).all() and (far == d.min(axis=1)).all()
    big = codes.nearest(x.astype(object) * 2**70, e.astype(object) * 2**70)
    assert (big[0] == at).all() and big[1][0] == int(far[0]) << 140


def test_clusters_leave_few_exact_distances():
    r = np.random.default_rng(1)
    e = r.integers(-2000, 2000, (64, 64))
    x = e[r.integers(0, 64, 2000)] + r.integers(-3, 4, (2000, 64))
    count = [0]
    codes.nearest(x, e, count)
    assert count[0] < 0.1 * 2000 * 64


def _brute(rows, entries=64, rounds=2):
    kept = sorted((x for x in rows if x[1] is not None and all(v is not None and math.isfinite(v) for v in x[1])), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    q = [[math.floor(256 * np.float64(np.float32(v))) if abs(v) < 1e30 else int(np.float32(v)) * 256 for v in x[1]] for x in kept]
    out, books = [], []
    for p in range(16):
        part = [v[p * len(v) // 16 : (p + 1) * len(v) // 16] for v in q]
        book = [list(v) for v in part[:entries]]
        dist = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b, strict=True))
        near = lambda v: min(range(len(book)), key=lambda i: (dist(v, book[i]), i))  # noqa: E731, B023
        for _ in range(rounds):
            at = [near(v) for v in part]
            for i in range(len(book)):
                own = [v for v, a in zip(part, at, strict=True) if a == i]
                if own:
                    book[i] = [sum(c) // len(own) for c in zip(*own, strict=True)]
        out.append([(near(v), dist(v, book[near(v)])) for v in part])
        books.append(book)
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    err = [min(2**63 - 1, sum(o[i][1] for o in out)) for i in range(len(kept))]
    return sorted((repr(x[0]), "".join(f"{o[i][0]:02x}" for o in out), err[i], min(2**63 - 1, sum(e for e, y in zip(err, kept, strict=True) if y[2] == x[2])), sha) for i, x in enumerate(kept))


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("scale", [1.0, 1e20, 1e38])
def test_codes_against_brute_force(spark, scale):
    r = random.Random(4)
    rows = [(r.choice([None, i, i // 2]), [float(np.float32(r.uniform(-1, 1) * scale)) for _ in range(35)], r.choice([None, 1, 2])) for i in range(90)]
    rows += [rows[3]] * 5 + [(200, None, 1), (201, [1.0] * 34 + [None], 1), (202, [float("nan")] + [1.0] * 34, 1), (203, [float("inf")] * 35, None), (204, [None] * 35, 2)]
    df = spark.createDataFrame(rows, VECTORS).selectExpr("*", "vec_id as code", "label as k", "1 as error", "2 as length")
    got = sorted((repr(x[0]), *tuple(x)[1:]) for x in codes.code_report(df).collect())
    assert got == _brute(rows)


def test_codes_edges(spark):
    assert codes.code_report(spark.createDataFrame([], VECTORS)).count() == 0
    assert codes.code_report(spark.createDataFrame([(1, None, 1)], VECTORS)).count() == 0
    two = codes.code_report(spark.createDataFrame([(1, [0.5] * 16, 1), (2, [0.25] * 32, None), (3, [], 1)], VECTORS)).collect()
    assert [(r["vec_id"], r["code"], r["error"]) for r in sorted(two)] == [(i, "00" * 16, 0) for i in (1, 2, 3)]
    assert len({r["codebooks_sha256"] for r in two}) == 3


def _naive_fit(lengths, capacity):
    left, out = [], [None] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        b = next((b for b, room in enumerate(left) if room >= lengths[i]), len(left))
        if b == len(left):
            left.append(capacity)
        out[i] = (b, capacity - left[b])
        left[b] -= lengths[i]
    return out


def test_first_fit_decreasing():
    r = random.Random(8)
    for n in (0, 1, 2, 3, 64, 65, 700):
        lengths = [r.choice([1, r.randrange(1, 100), 64, 128]) for _ in range(n)]
        assert list(zip(*packing.first_fit_decreasing(lengths, 128), strict=True)) == _naive_fit(lengths, 128)
    with pytest.raises(ValueError):
        packing.first_fit_decreasing([129], 128)


def _tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    return t


def test_word_tokenizer_gives_the_ids_of_the_whole_text(monkeypatch):
    t, r = _tokenizer(), random.Random(1)
    letters = "abAB zZ  .,!'’s-́̈̇̊WwÉéİıßΣςσ×÷ÿñ0123٣½ⅷ 　\t\n\r\x1c\x85|<>#&_€中文日本語😀ḍK̸=@\u0000ﬁǅ"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 70))) for _ in range(3000)]
    texts += ["<|endoftext|> it's we'll x'sy's", "don't.,", "É.", "é.,", "W̊", "ẘ", "", " "]
    monkeypatch.setattr(packing, "CACHED_WORDS", 300)
    w = packing.WordTokenizer(P.path("word_bpe_49k.json"))
    for i in range(0, len(texts), 500):
        ids, ends = w(pa.array(texts[i : i + 500], pa.large_string()))
        for text, a, b in zip(texts[i : i + 500], np.append(0, ends[:-1]), ends, strict=True):
            assert ids[a:b].tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_packing_holds_every_id_once(spark):
    r = random.Random(6)
    words = "the of merge tournament Straße, naïve x1y2 (don't) 日本".split()
    rows = [(r.choice([None, i]), r.choice([None, "", " \n", " ".join(r.choice(words) for _ in range(r.randrange(700)))])) for i in range(120)]
    rows += [(500, "same text of a copy")] * 40 + [(501, " ".join(words * 2500)), (502, "q" * 30000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as piece", "2 as length", "3 as start", "4 as sequence_id")
    cut = packing.pieces(df, P.path("word_bpe_49k.json"), 256)
    out = packing.pack(cut, 256, 40).collect()
    t = _tokenizer()
    want = sorted((repr(d), [*t.encode(x or "", add_special_tokens=False).ids, 1]) for d, x in rows)
    need = sorted((d, s, min(256, len(ids) - s), zlib.crc32(np.array(ids[s : s + 256], "<u4").tobytes()), len(ids)) for d, ids in want for s in range(0, len(ids), 256))
    assert sorted((repr(x["doc_id"]), x["start"], x["length"], x["ids_crc32"], x["doc_tokens"]) for x in out) == need
    groups = {}
    for x in out:
        groups.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for g in groups.values():
        at = 0
        for offset, length in sorted(g):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(x["length"] for x in out)
    assert len(groups) * 256 <= total * 1.1
    again = {(x["piece"], x["sequence_id"], x["offset"]) for x in packing.pack(cut.repartition(3), 256, 40).collect()}
    assert again == {(x["piece"], x["sequence_id"], x["offset"]) for x in out}


def test_long_rows_are_tokenized_in_parts(monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", 1000)
    texts = ["ab cd", "the river runs, " * 400, None, "x" * 5000, "end"]
    batch = pa.record_batch([pa.array(range(5)), pa.array(texts)], ["doc_id", "text"])
    (out,) = packing._cutter(P.path("word_bpe_49k.json"), 10**9, 1)(iter([batch]))
    t = _tokenizer()
    assert out.column("length").to_pylist() == [len(t.encode(x or "", add_special_tokens=False).ids) + 1 for x in texts]


def test_packing_empty(spark):
    assert packing.pack_report(spark.createDataFrame([], "doc_id long, text string"), P.path("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("page", ["<script " * 131072, "<![CDATA[" * 116508, "<p>" * 170000 + "</div>" * 85000, "<b>" * 150000 + "x<br>" * 100000, "<div " + "a" * 1048576 + " =>x", '<script "<script" ' * 58000], ids=["script", "cdata", "stray", "inline", "letters", "quotes"])
def test_broken_markup_takes_linear_time(page):
    import time

    from weftline.llm import htmlmain

    began = time.process_time()
    htmlmain.extract(page)
    assert time.process_time() - began < 8


@pytest.mark.parametrize(("num", "den"), [(90, 100), (80, 100)])
def test_counts_never_part_a_linked_pair(num, den):
    """Pairs at the threshold, in one size class and in two, with few and many counters, hashes that fall together, and copies."""
    from weftline.llm import setjoin

    t, r = setjoin.Threshold(num, den), np.random.default_rng(num)
    apart = 0
    for n in (1, 2, 9, 10, 64, 500, 3000, 9000, 40000):
        for hot in (False, True):
            base = r.integers(0, 2**63, n, dtype=np.uint64)
            base = np.unique(base << np.uint64(30)) if hot else np.unique(base)
            for more in (0, (den - num) * len(base) // num, (den - num) * len(base) // num // 2):
                other = np.unique(np.concatenate([base, r.integers(0, 2**63, more, dtype=np.uint64)]))
                union = len(np.union1d(base, other))
                assert den * len(np.intersect1d(base, other)) >= num * union
                counts = setjoin.count_matrix([setjoin.counts_of(base, t), setjoin.counts_of(other, t)])
                assert setjoin.near_forest(counts, np.array([len(base), len(other)]), t) == [(0, 1)]
        if n >= 64:
            pair = [np.unique(r.integers(0, 2**63, n, dtype=np.uint64)) for _ in range(2)]
            pair[1] = np.unique(np.concatenate([pair[1][: n // 2], pair[0][: n // 2]]))
            counts = setjoin.count_matrix([setjoin.counts_of(x, t) for x in pair])
            apart += not setjoin.near_forest(counts, np.array([len(x) for x in pair]), t)
    assert apart == 5  # sets half alike are told apart at every size
