"""Operators against brute force, their SQL, round trips and held-out accuracy on the smallest tables."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.llm import decontam, fingerprint, htmlmain, kernel, licenses, linededup, queries, setjoin, toxicity
from weftline.llm.common import connected_components

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages"):
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def texts(con):
    return dict(con.execute("select doc_id, text from documents").fetchall())


@needs_data
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, con, name):
    got = queries.QUERIES[name](spark, DATA)
    cur = con.execute(queries.ORACLES[name])
    at = [[c[0] for c in cur.description].index(c) for c in got.columns]
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r[i] for i in at) for r in cur.fetchall())


@needs_data
def test_mix_comes_near_its_targets(spark, con):
    source = dict(con.execute("select doc_id, source from documents").fetchall())
    taken, target = Counter(), {}
    for r in queries.op1_mixing(spark, DATA).collect():
        assert r["taken"] in [k * r["size"] for k in range(4)]
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 0.03 * target[s] for s in target)


@needs_data
def test_language_held_out(spark, con):
    lang = dict(con.execute("select doc_id, lang from documents").fetchall())
    held = [r for r in queries.op2_language(spark, DATA).collect() if r["held_out"]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in held)
    assert np.mean([lang[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.97


def test_toxicity_reads_unseen_misspellings():
    rng = random.Random(1)
    syllables = ["the", "an", "er", "ti", "on", "es", "re", "nd", "ou", "ha"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    text = lambda *bad: " ".join(rng.sample(x := [word() for _ in range(80)] + list(bad), len(x)))
    known, unseen = ["stupid", "pathetic", "worthless"], ["stuppid", "pathetiic", "worthles"]
    y = np.array([i % 5 == 0 for i in range(400)]).astype(int)
    model = toxicity.fit([text(rng.choice(known), rng.choice(known)) if t else text() for t in y], y)
    score = model.scores(pa.array([text(w) for w in unseen * 10] + [text() for _ in range(60)]))
    assert np.mean([p > n for p in score[:30] for n in score[30:]]) > 0.9
    assert np.isclose(model.scores(pa.array([None, "", "..."])), model.scores(pa.array([""]))[0]).all()


@needs_data
def test_fingerprint_edits_and_likeness(spark, texts):
    ids = sorted(texts)
    nxt = dict(zip(ids, ids[1:] + ids[:1], strict=True))
    near = []
    for r in queries.op3_fingerprints(spark, DATA).collect():
        t = texts[r["doc_id"]]
        q = len(t) // 4
        edited = t[: len(t) - q] + texts[nxt[r["doc_id"]]][:q]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and r["n_chars"] == len(t)
        near.append(r["near_edited"] > r["near_next"])
    assert np.mean(near) > 0.97


def test_fingerprint_is_a_multiset_hash(spark):
    d = spark.createDataFrame([("a b\nc d\ne f", "e f\na b\nc d", "a b\nc d", "e f")], "x string, y string, s string, t string")
    for c in "xyst":
        d = fingerprint.with_lanes(d, c, f"v{c}")
    r = d.select("vx", "vy", fingerprint.add(F.col("vs"), F.col("vt")).alias("sum"), "vs", fingerprint.subtract(F.col("vx"), F.col("vt")).alias("cut")).first()
    assert r["vx"] == r["vy"] == r["sum"] and r["vs"] == r["cut"]


def test_fingerprint_likeness_of_very_long_texts(spark):
    """100,000 pieces: far more than a counter of 16 bits holds."""
    n = 100_000
    x, other = [f"x{i}" for i in range(n)], [f"y{i}" for i in range(n)]
    d = spark.createDataFrame([("\n".join(x), "\n".join(x[: 3 * n // 4] + other[: n // 4]), "\n".join(other))], "x string, kept string, other string")
    d = d.repartition(1)  # else the optimizer computes the vectors
    for c in d.columns:
        d = fingerprint.with_lanes(d, c, f"v{c}")
    r = d.select("vx", "vkept", "vother").withColumns({c: fingerprint.likeness(F.col("vx"), F.col(f"v{c}")) for c in ("kept", "other")}).first()
    bits = lambda v: [v[fingerprint.EQUAL + i] >> 32 * k & 0xFFFFFFFF for k in range(2) for i in range(fingerprint.LIKE)]
    assert r["vx"][-1] == n and all(abs(2 * c - n) < 6 * n**0.5 for c in bits(r["vx"]))
    assert r["kept"] > 0.6 and r["other"] < 0.5


@needs_data
def test_shards(spark, texts):
    got = queries.op8_sharding(spark, DATA).collect()
    size, slots, of = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        b = texts[r["doc_id"]].encode()
        assert r["size"] == len(b) + 16 and r["text_crc32"] == zlib.crc32(b) and r["law"] == "bytes" and r["grown_shard"] is None
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        of[texts[r["doc_id"]]].add(r["shard"])
    biggest = max(r["size"] for r in got)
    assert set(size) <= set(range(40)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(size.values()) - sum(size.values()) / 40 <= biggest
    group = Counter()
    for t in texts.values():
        group[t] += len(t.encode()) + 16
    assert all(len(of[t]) == 1 for t in of if group[t] <= biggest)


def test_word_hashes_by_brute_force():
    rows = ["", None, "One two  THREE", "one two three four", "é É x", "x" * 3, " lead", "a\x0bb"]
    seen: dict[str, int] = {}
    for first, counts, h in kernel.word_hashes(pa.array(rows)):
        at = 0
        for r, c in enumerate(counts):
            want = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), rows[first + r] or ""))
            assert len(want) == c
            for w, x in zip(want, h[at : at + c], strict=True):
                assert seen.setdefault(w, int(x)) == int(x)
            at += c
    assert len(set(seen.values())) == len(seen)


def test_long_text_hashes_like_short_ones():
    words = [f"w{i % 1000}" for i in range(400_000)]
    (_, n, h), = kernel.word_hashes(pa.array([" ".join(words)]))
    (_, _, s), = kernel.word_hashes(pa.array([" ".join(words[:1000])]))
    assert n[0] == len(words) and (h.reshape(-1, 1000) == s).all()


def test_link_forest_and_blocks_by_brute_force():
    rng = random.Random(3)
    t = setjoin.Threshold(90, 100)
    for _ in range(30):
        base = [rng.getrandbits(60) for _ in range(rng.choice([12, 60, 200]))]
        sets = []
        for _ in range(25):
            s = {x for x in base if rng.random() > rng.choice([0, 0.02, 0.06])} | {rng.getrandbits(60) for _ in range(rng.choice([0, 1, 3]))}
            sets.append(np.unique(np.array(sorted(s), np.uint64)))
        u = {i: i for i in range(25)}

        def root(u, a):
            while u[a] != a:
                a = u[a]
            return a

        v = dict(u)
        for a, b in setjoin.link_forest(sets, t):
            v[root(v, a)] = root(v, b)
        for a in range(25):
            for b in range(a):
                n = len(np.intersect1d(sets[a], sets[b]))
                if 100 * n >= 90 * (len(sets[a]) + len(sets[b]) - n):
                    u[root(u, a)] = root(u, b)
                    if list(sets[a]) != list(sets[b]):
                        assert np.intersect1d(setjoin.set_blocks(sets[a], t), setjoin.set_blocks(sets[b], t)).size
        assert {(a, b) for a in range(25) for b in range(25) if root(u, a) == root(u, b)} == {(a, b) for a in range(25) for b in range(25) if root(v, a) == root(v, b)}


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (300, 300), (None, 5)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(e).collect()}
    assert all(got[i] == 0 for i in [*range(41), 100]) and got[201] == got[200] == 200 and 300 not in got


def test_decontam_finds_short_items_in_long_documents(spark):
    rng = random.Random(5)
    item = " ".join(f"q{rng.randrange(10**6)}" for _ in range(30))
    filler = [f"w{rng.randrange(10**6)}" for _ in range(50_000)]
    hit = " ".join([*filler[:31_001], item.upper().replace(" ", ", "), *filler[31_001:]])
    docs = spark.createDataFrame([(1, hit), (2, " ".join(filler)), (3, " ".join(item.split()[:15]))], "doc_id long, text string")
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    assert [tuple(r) for r in decontam.contaminated(docs, bench).collect()] == [(1, 9, 26, 26, 1.0)]


def test_line_dedup_keeps_one_of_each_group(spark):
    line = " ".join(f"term{i}" for i in range(80))
    docs = spark.createDataFrame([(1, f"Head one\n{line}"), (2, f"{line.replace('term40', 'term4o')}\ntail"), (3, f"  {line.upper()}!\nHead two"), (4, "***\n***")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_lines"], r["n_kept"]) for r in linededup.dedup_report(docs).collect()}
    assert got == {1: (2, 2), 2: (2, 1), 3: (2, 1), 4: (2, 2)}


def test_line_dedup_meets_every_pair_of_one_word(spark):
    """One word changed, added or left out in lines of all lengths."""
    rng = random.Random(5)
    docs = []
    for i in range(60):
        w = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(3 + i)]
        at = rng.randrange(len(w))
        long = "".join(rng.choices("qrstuvwxyz", k=max(0, len(w) // 2 - 1)))
        other = w[:at] + [[w[at][:-1] + "z"], [w[at], "qq"], [w[at] + long]][i % 3] + w[at + 1 :]
        docs += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(other))]
    within = [i for i in range(60) if len(docs[2 * i + 1][1]) - len(docs[2 * i][1]) <= 0.1 * len(docs[2 * i + 1][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["n_kept"] for r in linededup.dedup_report(df).collect()}
    assert len(within) > 50 and all(got[2 * i] == 1 and got[2 * i + 1] == 0 for i in within)


def test_line_dedup_meets_every_pair_of_a_key(spark, monkeypatch):
    """Lines that share all keys, each with one copy among them that is neither the least line nor near in order."""
    monkeypatch.setattr(linededup, "SLOT", 16)
    rng, base = random.Random(8), [f"basewrd{c}" for c in "abcdefghi"]
    docs = []
    for i in range(40):
        z = "".join(rng.choices("abcdefghijklmnopqrst", k=24))
        docs += [(2 * i + j, " ".join([*base[:5], x, *base[5:]])) for j, x in enumerate((z, z[:12] + "z" + z[13:]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["n_kept"] for r in linededup.dedup_report(df).collect()}
    assert got == {i: 1 - i % 2 for i in range(80)}


def test_licenses_are_inherited_from_the_nearest_directory(spark):
    files = spark.createDataFrame(
        [("/a/LICENSE", "Released under the MIT License.", True), ("/a/b/LICENSE", "Licensed under the Apache License, Version 2.0.", True), ("/a/x.c", "code", False), ("/a/b/c/y.c", "code", False), ("/a/b/z.c", "x\nThis work is licensed under the GNU General Public License, version 3.", False), ("/q/w.c", "licensed to nobody", False), (None, None, None)],
        "path string, text string, is_license boolean",
    )
    got = {r["path"]: (r["license"], r["origin"]) for r in licenses.scan(files).collect()}
    assert got["/a/x.c"] == ("MIT", "dir:/a") and got["/a/b/c/y.c"] == ("Apache-2.0", "dir:/a/b") and got["/a/b/z.c"] == ("GPL-3.0", "own") and got["/q/w.c"] == got[None] == (None, "none")


def test_licenses_of_headers_and_whole_files(spark):
    from weftline.llm import notices

    words = lambda t, mark: "\n".join(f"{mark} {' '.join(w)}" for w in (t.split()[i : i + 9] for i in range(0, len(t.split()), 9)))
    rows = [
        ("/a/LICENSE", "MIT License\n\nCopyright (c) 2020 Some One\n\n" + words(notices._MIT, "") + "\n\n" + words(notices._MIT_REST, ""), True, "MIT"),
        ("/b/LICENSE", "Copyright 2001 X\n\n" + words(f"{notices._BSD} {notices._BSD_NAME} {notices._BSD_REST}", ""), True, "BSD-3-Clause"),
        ("/c/LICENSE", "Copyright 2001 X\n\n" + words(f"{notices._BSD} {notices._BSD_REST}", ""), True, "BSD-2-Clause"),
        ("/d/x.c", "/*\n" + words(notices._APACHE, " *") + "\n */\n\nint main() { return 0; }", False, "Apache-2.0"),
        ("/e/x.py", "#!/bin/python\n\n" + words(notices._gnu("General Public License", "3"), "#") + "\n\nimport os", False, "GPL-3.0"),
        ("/f/x.py", "# SPDX-License-Identifier: WTFPL\nimport os", False, "WTFPL"),
        ("/g/x.py", "the software is provided to the user\n\nand the license of the car\nis in the bag", False, None),
        ("/a/y/z.c", "code", False, "MIT"),
    ]
    files = spark.createDataFrame([r[:3] for r in rows] + [(f"/z/{i}.c", "the one of the two and to", False) for i in range(40)], "path string, text string, is_license boolean")
    got = {r["path"]: r["license"] for r in licenses.scan(files).collect()}
    assert {r[0]: got[r[0]] for r in rows} == {r[0]: r[3] for r in rows}


def test_license_cosines_equal_brute_force(spark):
    import math

    from weftline.llm import notices

    texts = ["Released under the MIT License", "This file is licensed under the Apache License, Version 2.0", "nothing here of it", "Licensed to the GNU\nLicensed under CC BY-NC 4.0 by me"]
    files = spark.createDataFrame([(f"/{i}", t, False) for i, t in enumerate(texts * 3)], "path string, text string, is_license boolean")
    bag = lambda t: Counter(re.findall(r"[a-z0-9]+", t.lower()))
    df = Counter(w for t in texts * 3 for w in set(bag(t)))
    idf = lambda w: math.log((len(texts) * 3 + 1) / (df[w] + 1)) + 1
    norm = lambda b: math.sqrt(sum((c * idf(w)) ** 2 for w, c in b.items()))
    cos = lambda a, b: sum(c * b[w] * idf(w) ** 2 for w, c in a.items()) / (norm(a) * norm(b))
    for r in licenses.scan(files).collect():
        best = max((cos(bag(x), bag(t)) for x in texts[int(r["path"][1:]) % 4].split("\n") for _, t in notices.TEMPLATES))
        if best >= licenses.SIMILARITY:
            assert abs(r["similarity"] - best) < 1e-9
        else:
            assert r["license"] is None


def test_license_of_a_line_with_common_words_at_any_size(spark):
    line = "This file is released under the MIT License."
    for n in (30, 3000):
        common = [(f"/c/{i}.c", "this file is not\nlong", False) for i in range(n)]
        named = [(f"/l/{i}.c", f"x\n{line}", False) for i in range(max(1, n // 100))]
        files = spark.createDataFrame(common + named, "path string, text string, is_license boolean")
        got = [(r["license"], r["similarity"]) for r in licenses.scan(files).where("path like '/l/%'").collect()]
        assert len(got) == len(named) and all(x == "MIT" and s > 0.9 for x, s in got)


PAGE = "<html><head><title>x</title></head><body><header><h1>Site</h1></header><div class='cookie-notice'><p>{f}</p></div><ul class=menu><li><a>One</a></li></ul><main><article><h1>T &amp; t</h1><p>{f} <b>bo</b>ld.</p><p>Short.</p><div class='ad-slot'>{f}</div><p>End.</p></article><section id='comments'><p>{f}</p></section></main><aside><p>{f}</p></aside><form>{f}</form><footer>c</footer></body></html>"


def test_html_keeps_the_article():
    f = "Some words that go on for long enough to surge over the limit of a block of text."
    assert htmlmain.extract(PAGE.format(f=f)) == f"T & t {f} bold. Short. End."


def test_html_of_unknown_markup():
    """No article, no known names: long lines with short ones between them stay, links and short ends go."""
    f = "Some words that go on for long enough to surge over the limit of a block of text."
    menu = "".join(f"<div class=q{i}><a href=x>Entry {i}</a></div>" for i in range(9))
    page = f"<body><div id=k1>{menu}</div><div class=zz><div>{f}</div><div>Tiny.</div><div>{f} more</div></div><div>{menu}</div><div>(c) 2020 Someone</div></body>"
    assert htmlmain.extract(page) == f"{f} Tiny. {f} more"
    assert htmlmain.extract(f"<form><div class='content has-sidebar'><article><p>{f}</p><p>x</p></article></div><div class='sidebar'>{f}</div></form>") == f"{f} x"


@needs_data
def test_html_of_the_table(con, monkeypatch):
    """Articles of the table, also without article tags, section names and known words; not without the line blocks."""
    import html

    rows = [r[0] for r in con.execute("select html from pages").fetchall()]
    want = []
    for page in rows:
        art = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        parts = (re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>", "", x))).strip() for x in re.split(r"<(?!/?b>)[^>]*>", art))
        want.append(" ".join(p for p in parts if p))
    good = lambda pages: sum(htmlmain.extract(p) == w for p, w in zip(pages, want, strict=True))
    plain = [re.sub(r"(</?)(article|main|footer|nav|aside|header)>", r"\1div>", p).replace('class="ad"', 'class="k7"') for p in rows]
    assert good(rows) == good(plain) == len(rows)
    monkeypatch.setattr(htmlmain, "stretches", lambda weight: [(0, len(weight))])
    assert good(rows) < len(rows) / 4 and good(plain) == 0


def test_edit_bound_equals_brute_force(spark):
    r, rows = random.Random(3), [("a", "ab"), ("ab", "a"), ("x" * 30, "x" * 31), ("x" * 9, "x" * 10), ("x" * 30, "y" * 30)]
    for _ in range(400):
        w = ["".join(r.choices("abé", k=r.randint(1, 4))) for _ in range(r.randint(1, 14))]
        v = list(w)
        for _ in range(r.randint(1, 3)):
            i = r.randrange(len(v))
            v[i : i + r.randint(0, 1)] = ["".join(r.choices("abé", k=r.randint(1, 4)))] * r.randint(0, 1) or v[i : i + 1]
        if w != v:
            rows.append((" ".join(w), " ".join(v)))

    def distance(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            q = [i]
            for j, y in enumerate(b, 1):
                q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
            p = q
        return p[-1]

    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", linededup.within_edits(F.col("a"), F.col("b")).alias("w")).collect()
    assert 20 < sum(x["w"] for x in got) < len(got)
    for x in got:
        assert x["w"] == (10 * distance(x["a"], x["b"]) <= max(len(x["a"]), len(x["b"])))


@needs_data
def test_line_links_against_brute_force(spark, con, texts):
    """Of the pairs of lines within the edit similarity (found by shared rare words and character runs) 0.9 end in one group."""
    found = defaultdict(list)
    for d, t in sorted(texts.items()):
        for pos, line in enumerate((t or "").lower().split("\n")):
            w = re.findall(r"[^\W_]+", line)
            if w:
                found[" ".join(w)].append((d, pos))
    lines = sorted(x for x in found if len(x) <= 600)
    held = defaultdict(set)
    for i, x in enumerate(lines):
        w = x.split()
        for f in {*w, *zip(w, w[1:]), *(x[k : k + 9] for k in range(len(x) - 8) if len(x) <= 200)}:
            held[f].add(i)
    pairs = {(a, b) for g in held.values() if len(g) <= 40 for a in g for b in g if a < b and min(len(lines[a]), len(lines[b])) >= 0.9 * max(len(lines[a]), len(lines[b]))}
    frame = pa.table({"a": [lines[a] for a, _ in pairs], "b": [lines[b] for _, b in pairs]})
    true = con.sql("select a, b from frame where levenshtein(a, b) <= floor(greatest(length(a), length(b)) * 0.1 + 1e-9)").fetchall()
    gone = {(r["doc_id"], r["pos"]) for r in linededup.duplicate_lines(spark.read.parquet(f"{DATA}/documents.parquet")).collect()}
    # The first occurrence of a line goes exactly when an earlier line of its group stays.
    hit = [sum(found[x][0] in gone for x in p) >= 1 for p in true]
    assert len(true) > 200 and np.mean(hit) >= 0.9


def test_rare_words_make_the_keys_of_lines(spark):
    """Two or three common words make no key of their own; pairs of several keys meet, those of far lengths do not."""
    rng, docs = random.Random(4), []
    for i in range(600):
        w = ["".join(rng.choices("abcdefghijklmnop", k=8)) for _ in range(9)]
        docs.append((i, " ".join([*w, *"an at by in of to".split()])))
    lines = linededup.occurrences(spark.createDataFrame(docs, "doc_id long, text string"))
    assert linededup.candidate_pairs(lines, lines.where("few is not null").select("h", "k", "len", F.explode("few").alias("key"))).count() < 10
    line = F.expr("named_struct('h', id, 'k', id, 'len', if(id = 9, 300, 100))").alias("line")
    held = spark.range(10).select(line, F.explode(F.expr("array(struct(1 as key, 2L as n1, 3L as n2, 4L as n3), struct(2 as key, 3L as n1, 4L as n2, 1L as n3))")).alias("t"))
    held = held.select("line", F.col("t.key").cast("long").alias("key"), "t.n1", "t.n2", "t.n3")
    none = spark.createDataFrame([], "x struct<h: long, k: long>, y struct<h: long, k: long>")
    comp = spark.createDataFrame([], "node struct<h: long, k: long>, component struct<h: long, k: long>")
    rest = linededup.rest_pairs(held, comp, none)
    assert sorted((r["x"]["h"], r["y"]["h"]) for r in rest.collect()) == [(i, j) for i in range(9) for j in range(i + 1, 9)]


def test_line_pairs_grow_with_lines(spark):
    """A large group of near copies and one of a shared passage: pairs stay within a few a line."""
    rng, base = random.Random(2), [f"t{i}" for i in range(40)]
    rows = []
    for n in (200, 800):
        for i in range(n):
            w = list(base)
            w[rng.randrange(40)] = f"x{i}"
            rows.append((n, i, " ".join(f"{n}{x}" for x in w)))
            rows.append((n, i + n, " ".join([f"{n}{x}" for x in base[:30]] + [f"y{rng.random()}" for _ in range(30)])))
    docs = spark.createDataFrame(rows, "n int, doc_id long, text string")
    count = {}
    for n in (200, 800):
        lines = linededup.occurrences(docs.where(f"n = {n}")).cache()
        short = lines.where("few is not null").select("h", "k", "len", F.explode("few").alias("key"))
        count[n] = linededup.candidate_pairs(lines, short).count()
    assert count[800] < 5 * count[200] and count[800] < 12 * 1600
    got = linededup.dedup_report(docs.where("n = 800").drop("n")).agg(F.sum("n_kept")).first()[0]
    assert got <= 800 + 8
