"""N-gram Jaccard self-join of whole texts, exact, as connected groups.

Method: set-relation skipping. Each set is cut by a hash of its elements into blocks of the token order, and
index lists are kept by (size class, block position, content of the block): when two sets differ in at most d
elements, more blocks than d cannot all be hit, so a linked pair meets in the list of an untouched block, and
every list of other positions or contents is skipped whole. Inside a list, counts of elements by hash drop pairs far below
the threshold: two sets differ in at least as many elements as their counts differ by, so no linked pair is lost. In the groups that remain, a set's overlaps are derived from the
computed overlaps of a highly similar set (its leader): bounds skip it entirely, or only the few elements in
which the two differ are counted.

Lists are keyed by blocks rather than by single prefix elements because a passage that a third of all
documents share makes a prefix list quadratic; a block that holds nothing but that passage is rare.

Defined results: a null or wordless text has an empty set (n_shingles 0) and is its own component; a null
doc_id is never linked (component_id null); rows that repeat a doc_id are one node, so they share a component;
equal sets are always linked. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm import kernel as K
from weftline.llm.common import connected_components, lookup_join, shuffle_partitions, small_arrow_batches, stage

#: Fewest and most counters of a set.
COUNTERS = (64, 4096)
#: Members of a list or group compared in one task; larger ones are compared as pairs of such blocks.
BLOCK = 2048


class Threshold:
    """Jaccard >= num/den in whole numbers, and the size classes and blocks that follow from it."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.ends = [self._largest(1)]
        apart = (den - num) / (den + num)
        #: Counters an element, so that the counts of sets half alike differ by more than linked sets may.
        self.dense = 2 * (1.3 * apart / 0.57) ** 2

    def counters(self, k: int) -> int:
        """How many counters sets of class k have: a power of two."""
        want = int(self.ends[k] * self.dense)
        return min(COUNTERS[1], max(COUNTERS[0], 1 << max(0, want - 1).bit_length()))

    def apart(self, total):
        """Most elements by which the two sets of a linked pair differ, whose sizes add up to total."""
        return total * (self.den - self.num) // (self.den + self.num)

    def _largest(self, a: int) -> int:
        return a * self.den // self.num

    def need(self, total):
        """Least overlap of a linked pair whose sizes add up to total."""
        return -(-self.num * total // (self.num + self.den))

    def size_class(self, n: int) -> int:
        while self.ends[-1] < n:
            self.ends.append(self._largest(self.ends[-1] + 1))
        return int(np.searchsorted(self.ends, n))

    def blocks(self, k: int) -> tuple[int, int]:
        """(most elements in which a pair of class k differs, number of blocks)."""
        top = self.ends[k] + self._largest(self.ends[k])
        d = top * (self.den - self.num) // (self.den + self.num)
        return d, (3 * (d + 1) + 1) // 2


def _i64(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _sets(col: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for first, counts, words in K.word_hashes(col):
        n, h = K.shingles(counts, words, k)
        yield first, n, h


def counts_of(u: np.ndarray, t: Threshold) -> bytes:
    """How many elements of a set fall to each counter, at most 255."""
    if not len(u):
        return b""
    n = t.counters(t.size_class(len(u)))
    return np.minimum(np.bincount(((u >> np.uint64(20)) % np.uint64(n)).astype(np.int64), minlength=n), 255).astype(np.uint8).tobytes()


def profiles(docs: DataFrame, k: int, t: Threshold) -> DataFrame:
    """(doc_id, n, hi, lo, sk): size, two sums that name the set, and its counts by hash."""
    small_arrow_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            ids, n_all, hi, lo, sk = b.column(0), [], [], [], []
            for _, counts, h in _sets(b.column(1), k):
                at = np.cumsum(counts) - counts
                for a, c in zip(at.tolist(), counts.tolist(), strict=True):
                    u = np.unique(h[a : a + c])
                    n_all.append(len(u))
                    hi.append(u.sum(dtype=np.uint64))
                    lo.append(K.mix(u ^ np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64))
                    sk.append(counts_of(u, t))
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(n_all, pa.int64()), pa.array(_i64(np.array(hi, np.uint64))), pa.array(_i64(np.array(lo, np.uint64))), pa.array(sk, pa.binary())], names=["doc_id", "n", "hi", "lo", "sk"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, hi long, lo long, sk binary")


def set_blocks(u: np.ndarray, t: Threshold) -> np.ndarray:
    """Names of the index lists that a set is put into."""
    own, out = t.size_class(len(u)), []
    for k in (own, own - 1):
        if k < 0:
            continue
        d, p = t.blocks(k)
        if d == 0:
            continue
        salt = np.uint64((k + 1) * 0xA24BAED4963EE407 % (1 << 64))
        part = (K.mix(u ^ salt) >> np.uint64(16)) % np.uint64(p)
        order = np.argsort(part, kind="stable")
        part, v = part[order], K.mix(u[order] + np.uint64(11))
        at = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        out.append(K.mix(np.add.reduceat(v, at) + K.mix(part[at] + salt)))
        if len(at) <= d:  # too few filled blocks to promise an untouched one: the empty ones count as well
            out.append(K.mix(np.setdiff1d(np.arange(p, dtype=np.uint64), part[at]) + salt) ^ np.uint64(0xE7037ED1A0B428DB))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shared_lists(docs: DataFrame, k: int, t: Threshold) -> DataFrame:
    """(list, doc_id) of the index lists with at least two documents; lists of equal members are kept once a task.

    Postings cross the exchange packed by partition, sixteen bytes each.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)

    def flush(names: list, ids: list):
        s, d = np.concatenate(names), np.concatenate(ids)
        pid = (s % np.uint64(parts)).astype(np.int64)
        order = np.argsort(pid, kind="stable")
        s, d, pid = s[order], d[order], pid[order]
        at = np.flatnonzero(np.concatenate(([True], pid[1:] != pid[:-1])))
        end = np.append(at[1:], len(pid))
        return pa.RecordBatch.from_arrays([pa.array(pid[at]), pa.array([s[a:b].tobytes() for a, b in zip(at, end, strict=True)], pa.binary()), pa.array([d[a:b].tobytes() for a, b in zip(at, end, strict=True)], pa.binary())], names=["pid", "names", "ids"])

    def post(batches):
        names, ids, held = [], [], 0
        for b in batches:
            doc = b.column(0).to_numpy(zero_copy_only=False)
            for first, counts, h in _sets(b.column(1), k):
                at = np.cumsum(counts) - counts
                for r, (a, c) in enumerate(zip(at.tolist(), counts.tolist(), strict=True)):
                    if c and len(x := set_blocks(np.unique(h[a : a + c]), t)):
                        names.append(x)
                        ids.append(np.full(len(x), doc[first + r], np.int64))
                        held += len(x)
                        if held > 1_000_000:
                            yield flush(names, ids)
                            names, ids, held = [], [], 0
        if held:
            yield flush(names, ids)

    def meet(batches):
        names, ids = [], []
        for b in batches:
            names += [np.frombuffer(x, np.uint64) for x in b.column(1).to_pylist()]
            ids += [np.frombuffer(x, np.int64) for x in b.column(2).to_pylist()]
        if not names:
            return
        s, d = np.concatenate(names), np.concatenate(ids)
        del names, ids
        order = np.argsort(s, kind="stable")
        s, d = s[order], d[order]
        new = np.concatenate(([True], s[1:] != s[:-1]))
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(s)))
        live = np.repeat(size > 1, size)
        s, d = s[live], d[live]
        if not len(s):
            return
        at = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        size = np.diff(np.append(at, len(s)))
        member = np.add.reduceat(K.mix(d.view(np.uint64)), at)  # what the members add up to: equal lists go once
        _, keep = np.unique(K.mix(member) + size.astype(np.uint64), return_index=True)
        once = np.zeros(len(at), bool)
        once[keep] = True
        live = np.repeat(once, size)
        name = np.repeat(K.mix(member), size)[live]
        for a in range(0, len(name), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(_i64(name[a : a + 100_000].copy())), pa.array(d[live][a : a + 100_000])], names=["list", "doc_id"])

    posted = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(post, "pid long, names binary, ids binary")
    return posted.repartition(parts, "pid").mapInArrow(meet, "list long, doc_id long").distinct()


def in_blocks(df: DataFrame, key: str, sizes: DataFrame) -> DataFrame:
    """Adds b1, b2: groups over BLOCK members are cut into blocks and go out once for each pair of blocks.

    sizes(key, m) holds the groups with more than BLOCK members.
    """
    df = lookup_join(df, sizes, key).withColumn("c", F.coalesce(F.ceil(F.col("m") / BLOCK), F.lit(1)).cast("int"))
    df = df.withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("c")).cast("int"))
    df = df.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("c") - 1))).where("c = 1 or o <> own")
    return df.withColumn("b1", F.least("own", "o")).withColumn("b2", F.greatest("own", "o")).drop("m", "c", "own", "o")


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows equal in their first columns, from a sorted stream."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        new = np.zeros(b.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), b.num_rows]
        for a, e in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(a, e - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


class Union:
    def __init__(self, n: int):
        self.root, self.edges = np.arange(n), []

    def join(self, x: int, y: int) -> None:
        a, b = self.root[x], self.root[y]
        if a != b:
            self.root[self.root == b] = a
            self.edges.append((x, y))


def count_matrix(rows: list[bytes]) -> np.ndarray:
    """The counts of sets side by side, over the fewest counters that one of them has (counts at 255 may be more, which only brings sets nearer)."""
    low = min(map(len, rows))
    out = np.empty((len(rows), low), np.int16)
    for i, r in enumerate(rows):
        out[i] = np.minimum(np.frombuffer(r, np.uint8).reshape(-1, low).sum(axis=0, dtype=np.int64), 255)
    return out


def near_forest(counts: np.ndarray, size: np.ndarray, t: Threshold) -> list[tuple[int, int]]:
    """Edges that connect what all pairs connect whose counts do not differ by more than those of a linked pair may."""
    u = Union(len(counts))
    for x in range(len(counts) - 1):
        todo = np.flatnonzero(u.root[x + 1 :] != u.root[x]) + x + 1
        todo = todo[np.abs(counts[todo] - counts[x]).sum(axis=1, dtype=np.int64) <= t.apart(size[todo] + size[x])] if len(todo) else todo
        for y in todo:
            u.join(x, int(y))
    return u.edges


def link_forest(sets: list[np.ndarray], t: Threshold) -> list[tuple[int, int]]:
    """Edges that connect exactly what the links (Jaccard at least num/den) connect."""
    m = len(sets)
    size = np.array([len(s) for s in sets])
    off = np.cumsum(size) - size
    _, tok = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(int(tok.max()) + 1, np.int16)
    u, known = Union(m), {}
    lead, extra = np.full(m, -1), np.full(m, 1 << 60)

    def own(x):
        return tok[off[x] : off[x] + size[x]]

    for x in range(m):
        need = t.need(size + size[x])
        p = lead[x]
        if p >= 0:
            o = known[p]
            most = np.minimum(o + extra[x], np.minimum(size, size[x]))
            todo = np.flatnonzero((most >= need) & (u.root != u.root[x]))
            if not len(todo):
                continue
            mark[own(x)] += 1
            mark[own(p)] -= 1
            got = np.array([o[y] + mark[own(y)].sum() for y in todo])
            mark[own(x)] = 0
            mark[own(p)] = 0
            for y in todo[got >= need[todo]]:
                u.join(x, int(y))
        else:
            mark[own(x)] = 1
            o = np.add.reduceat(mark[tok], off).astype(np.int64) if m > 1 else np.array([size[x]])
            mark[own(x)] = 0
            linked = o >= need
            known[x] = o
            nearer = linked & (size - o < extra)
            lead[nearer], extra[nearer] = x, (size - o)[nearer]
            for y in np.flatnonzero(linked & (u.root != u.root[x])):
                u.join(x, int(y))
    return u.edges


def _edges(ids: np.ndarray, pairs: list) -> pa.RecordBatch:
    p = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(ids[p[:, 0]]), pa.array(ids[p[:, 1]])], names=["a", "b"])


def _large(df: DataFrame, key: str) -> DataFrame:
    return stage(df.groupBy(key).agg(F.count("*").alias("m")).where(F.col("m") > BLOCK), "large")


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of documents(doc_id, text)."""
    spark = docs.sparkSession
    t = Threshold(num, den)
    prof = stage(profiles(docs, k, t), "profile")
    sets = prof.where("n > 0 and doc_id is not null")
    classes = sets.groupBy("n", "hi", "lo").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c"))
    copies = stage(sets.join(classes.where("c > 1"), ["n", "hi", "lo"]).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")), "copies")
    reps = sets.join(copies.select(F.col("a").alias("doc_id")).distinct(), "doc_id", "left_anti")
    reps = reps.select("doc_id", "n", "sk")

    lists = stage(shared_lists(docs.select("doc_id", "text"), k, t).join(reps, "doc_id"), "lists")
    lists = in_blocks(lists, "list", _large(lists, "list")).select("list", "b1", "b2", "doc_id", "n", "sk")

    def near(batches):
        for g in groups(batches, 3):
            if g.num_rows > 1:
                if e := near_forest(count_matrix(g.column(5).to_pylist()), g.column(4).to_numpy(), t):
                    yield _edges(g.column(3).to_numpy(), e)

    parts = shuffle_partitions(spark)
    near_edges = stage(lists.repartition(parts, "list", "b1", "b2").sortWithinPartitions("list", "b1", "b2").mapInArrow(near, "a long, b long").distinct(), "near")
    families = connected_components(near_edges).select(F.col("node").alias("doc_id"), F.col("component").alias("family"))
    families = in_blocks(families, "family", _large(families, "family")).select("family", "b1", "b2", "doc_id")
    families = stage(families, "family")

    def links(batches):
        for g in groups(batches, 3):
            if g.num_rows > 1:
                sets = []
                for _, counts, h in _sets(g.column(4), k):
                    at = np.cumsum(counts) - counts
                    sets += [np.unique(h[a : a + c]) for a, c in zip(at.tolist(), counts.tolist(), strict=True)]
                ids, live = g.column(3).to_numpy(), [i for i, s in enumerate(sets) if len(s)]
                if len(live) > 1 and (e := link_forest([sets[i] for i in live], t)):
                    yield _edges(ids[live], e)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = lookup_join(texts, families, "doc_id", "inner").select("family", "b1", "b2", "doc_id", "text")
    linked = stage(held.repartition(parts, "family", "b1", "b2").sortWithinPartitions("family", "b1", "b2").mapInArrow(links, "a long, b long"), "links")
    comp = connected_components(linked.union(copies))
    comp = comp.select(F.col("node").alias("doc_id"), "component")
    out = lookup_join(prof.select("doc_id", "n"), comp, "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs with one document of each group left: its smallest doc_id.

    Rows with a null doc_id or an empty set stay. Rows that repeat a doc_id with different texts are documents of their own,
    told apart by a hash of id and text; of rows equal in both the least by their other columns stays.
    """
    again = stage(docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("again_id")).agg(F.count("*").alias("c")).where("c > 1").select("again_id"), "again")
    if again.isEmpty():
        comp = stage(jaccard_components(docs, k, num, den), "comp")
        gone = stage(comp.where("component_id <> doc_id").select(F.col("doc_id").alias("gone_id")), "gone")
        return lookup_join(docs, gone, docs["doc_id"] == gone["gone_id"], "left_anti")
    named = lookup_join(docs, again, docs["doc_id"] == again["again_id"])
    named = named.withColumn("__key", F.when(F.col("again_id").isNotNull(), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id")))
    first = Window.partitionBy("__key").orderBy(*[F.col(c) for c in docs.columns])
    named = named.withColumn("__n", F.when(F.col("again_id").isNotNull(), F.row_number().over(first)).otherwise(1)).where("__n = 1")
    comp = stage(jaccard_components(named.select(F.col("__key").alias("doc_id"), "text"), k, num, den), "comp")
    gone = stage(comp.where("component_id <> doc_id").select(F.col("doc_id").alias("gone_id")), "gone")
    return lookup_join(named, gone, named["__key"] == gone["gone_id"], "left_anti").select(*docs.columns)
