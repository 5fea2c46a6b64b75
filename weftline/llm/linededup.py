"""Fuzzy line dedup: hash blocks of normalised lines, pigeonhole joins, edit similarity; in DataFrame functions only.

Lines are normalised to their words (lower case, runs of letters and digits) and equal ones grouped first, by 128 bits.
Each distinct line gets a few keys of several hash blocks, so that two lines with some blocks changed still share a key.
In a plain SimHash every word votes on every bit: one changed word in 27 flips some six of 64 bits and hardly a key
survives (README: 41 % of true pairs were met). Here a block takes its bits from one word alone: words fall
into KEYS parts by their hashes, and the least BLOCKS hashes of a part make its key, longer words first; a part of fewer than
FEWEST words takes those of the next too, since keys of two or three common words met lines by chance, with the square of the
lines. One changed word touches two of the four parts at most (more where parts are small), and of longer lines the least hashes outlast several changes. Lines of up to SHORT
characters have instead the hashes of the line without each word, single words those of their first and last characters.

Lines with equal keys are candidates. First the lines of a key are sorted by their further keys, and each meets the least
line and its two predecessors, which links most copies by pairs that grow with lines. Then, for each key whose lines are in
several connected groups, all its pairs of lines from different groups and with lengths in the same or adjacent classes meet (once, under the least key that they share), so that no pair of a key is left out; pairs
within a group need no link. Pairs whose lengths or counts of letters differ by more edits than allowed go, which loses
none; the others are verified by edit similarity (1 - edits / longer length >= SIMILARITY).
Of each connected group of lines the first occurrence (doc_id, text hash, line number) stays.

Defined results: lines without letters or digits are never duplicates and stay; a null text has one empty line;
rows that repeat doc_id and text are one document, and null ids come first. What is left of a pair beyond LONG characters
when common ends and the bounds have not settled it is compared by proportional pieces, which bounds the distance from above.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import connected_components, fits_broadcast, lookup_join, shuffle_partitions, stage, unstage

SIMILARITY = 0.9
#: Keys a line, and words a key, at most and where a part has fewer.
KEYS, BLOCKS, FEWEST = 4, 6, 4
#: Characters of a line that has keys without a word; of what is left of a pair that is compared in a band at once, or after bounds; of a piece.
SHORT, BAND, LONG, PIECE = 120, 200, 20_000, 1_000
#: Letters that are counted, as many to a long; each count is a byte.
LETTERS = ("etaoins", "hrdlucm")
#: Lines of a key that meet the others in one task.
SLOT = 1_000
#: Width of a class of lengths, in logarithms: lines within the edits are in the same or in adjacent classes.
STEP = 0.106
#: Where the parts of the 64-bit hashes begin.
_MARKS = [(i << 64) // KEYS - (1 << 63) for i in range(KEYS)]


def normal(line: Column) -> Column:
    """The words of a line in lower case, joined by single spaces."""
    return F.btrim(F.regexp_replace(line, r"[^\p{L}\p{N}]+", " "))


def _text() -> Column:
    return F.coalesce("text", F.lit(""))


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc, doc_id, pos, h, k, len, key0.., few) of each line with a letter or digit: where it is, 128 bits, length and keys of its normal form."""
    text = _text()
    d = docs.select(F.xxhash64(F.col("doc_id"), text).alias("doc"), "doc_id", F.posexplode(F.split(F.lower(text), "\n")).alias("pos", "line"))
    # A cheap test of the line itself: one of its words would be pushed below and split the line twice.
    d = d.where(F.col("line").rlike(r"[\p{L}\p{N}]")).select("doc", "doc_id", "pos", normal(F.col("line")).alias("line"))
    own = [F.char_length("line").alias("len"), F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("k")]
    one = F.when(~F.col("line").contains(" "), F.col("line")).alias("one")
    d = d.select("doc", "doc_id", "pos", *own, F.transform(F.split("line", " "), _word).alias("t"), one)
    marks = F.array(*[F.lit(m) for m in _MARKS])
    few = F.when(F.col("len") <= SHORT, _short_keys(F.col("t"), F.col("one")))
    d = d.select("doc", "doc_id", "pos", "h", "k", "len", F.sort_array(F.concat(F.array_distinct("t"), marks)).alias("s"), few.alias("few"))
    at = [F.array_position("s", F.lit(m)).cast("int").alias(f"p{j}") for j, m in enumerate(_MARKS)]
    d = d.select("doc", "doc_id", "pos", "h", "k", "len", F.when(F.col("len") > SHORT // 2, F.concat("s", "s")).alias("s"), "few", *at, (F.size("s") + 1).alias(f"p{KEYS}"))
    words = lambda j: F.col(f"p{j + 1}") - F.col(f"p{j}") - 1
    # The words of the next part follow behind its mark.
    length = lambda j: F.when(words(j) < FEWEST, FEWEST + 1).otherwise(F.least(F.lit(BLOCKS), words(j)))
    key = lambda j: F.when((words(j) > 0) & (F.col(f"p{KEYS}") - KEYS > 2) & (F.col("len") > SHORT // 2), F.xxhash64(F.lit(j), F.slice("s", F.col(f"p{j}") + 1, length(j))))
    return d.select("doc", "doc_id", "pos", "h", "k", "len", *[key(j).alias(f"key{j}") for j in range(KEYS)], "few")


def _word(x: Column) -> Column:
    """The hash of a word; in each part longer words, which are less common, come before those of up to three bytes."""
    short = 1 << (62 - (KEYS - 1).bit_length() + 1)
    return F.xxhash64(x).bitwiseAND(F.lit(~short)).bitwiseOR(F.when(F.octet_length(x) <= 3, F.lit(short)).otherwise(F.lit(0).cast("long")))


def _short_keys(t: Column, one: Column) -> Column:
    """Hashes of the words of a short line (of hashes t), in any order, and of those without each word; of a single word its first and last characters."""
    part = lambda x: F.shiftright(x, 8)  # noqa: E731  # sums of as many as a short line has fit a long
    total = F.aggregate(t, F.lit(0).cast("long"), lambda s, x: s + part(x))
    whole = F.array(F.xxhash64(F.lit("cut"), total))
    cut = F.flatten(F.transform(F.array(total), lambda s: F.transform(t, lambda x: F.xxhash64(F.lit("cut"), s - part(x)))))
    ends = F.array(F.xxhash64(F.lit("head"), F.substring(one, 1, 5)), F.xxhash64(F.lit("tail"), F.substring(one, -5, 5)))
    return F.array_distinct(F.when(F.size(t) > 1, F.concat(whole, cut)).when(F.char_length(one) >= 10, F.concat(whole, ends)).otherwise(whole))


def held_lines(keys: DataFrame, short: DataFrame) -> DataFrame:
    """(line, key, n1..): the lines (struct h, k, len) of each key that several lines share, with their further keys.

    keys(h, k, len, key0..) and short(h, k, len, key) have a row for each occurrence of a line at least.
    """
    line = F.struct("h", "k", "len").alias("line")
    names = [f"key{j}" for j in range(KEYS)]
    # A key has its number or kind in its hash, so that all share one column.
    each = keys.select("h", F.explode(F.array(*names)).alias("key")).where("key is not null").union(short.select("h", "key"))
    multi = stage(each.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("key"), "multi")
    fits = fits_broadcast(multi)
    further = [f"n{i}" for i in range(1, KEYS)]
    turned = F.array(*[F.struct(*[F.col(names[(j + i) % KEYS]).alias(f"n{i}") for i in range(KEYS)]) for j in range(KEYS)])
    held = keys.where("key0 is not null or key1 is not null or key2 is not null or key3 is not null")
    held = held.select(line, F.explode(turned).alias("t")).select("line", F.col("t.n0").alias("key"), *[f"t.{c}" for c in further])
    held = lookup_join(held.where("key is not null"), multi, "key", "left_semi", fits=fits)
    few = lookup_join(short.select(line, "key"), multi, "key", "left_semi", fits=fits)
    held = stage(held.select("line", "key", *further).union(few.select("line", "key", *[F.lit(None).cast("long") for _ in further])).dropDuplicates(["line", "key"]), "held")
    unstage(multi)
    return held


def candidate_pairs(keys: DataFrame, short: DataFrame) -> DataFrame:
    """(x, y): the first pairs of lines (struct h, k) that share a key, x the smaller; see the module for which of them."""
    return _neighbours(held_lines(keys, short))


def _neighbours(held: DataFrame) -> DataFrame:
    """(x, y): each line of a key with the least one and its two predecessors."""
    # Among the lines of a key those with equal further keys are adjacent.
    w = Window.partitionBy("key").orderBy(*[f"n{i}" for i in range(1, KEYS)], "line")
    near = held.select("line", F.array(F.first("line").over(w), F.lag("line", 1).over(w), F.lag("line", 2).over(w)).alias("xs"))
    near = near.select("line", F.explode("xs").alias("x")).where("x is not null and x <> line")
    near = near.select(F.least("x", "line").alias("x"), F.greatest("x", "line").alias("y"))
    return _ends(near.where(_alike(near, "x", "y"))).distinct()


def rest_pairs(held: DataFrame, comp: DataFrame, met: DataFrame) -> DataFrame:
    """(x, y): all pairs of lines that share a key, are in different connected groups and have not met; exact.

    comp(node, component) are the groups so far (a line without one is a group), met(x, y) the pairs so far. Of the largest
    group of a key no two lines meet, so a key of copies costs as many pairs as it has other lines. Lines meet those of the
    same and adjacent classes of lengths, under the least key that they share. A key of many lines is dealt to as many
    tasks as it has SLOT lines.
    """
    own = F.struct("line.h", "line.k")
    group = comp.select(F.col("node").alias("id"), "component")
    further = [f"n{i}" for i in range(1, KEYS)]
    at = held.select("key", "line", *further, own.alias("id")).join(group, "id", "left").select("key", "line", *further, F.coalesce("component", "id").alias("g"))
    by = at.groupBy("key", F.col("g.h").alias("gh"), F.col("g.k").alias("gk")).agg(F.count("*").alias("n"))
    by = by.groupBy("key").agg(F.max(F.struct("n", F.struct(F.col("gh").alias("h"), F.col("gk").alias("k")).alias("g"))).alias("top"), F.count("*").alias("groups"), F.sum("n").alias("n"))
    slots = F.ceil(F.col("n") / SLOT).cast("int").alias("slots")
    at = stage(at.join(by.where("groups > 1").select("key", F.col("top.g").alias("top"), slots), "key"), "at")
    size = F.floor(F.log(F.col("line.len")) / STEP).cast("int")
    few = at.where("g <> top").select("key", F.col("line").alias("u"), F.col("g").alias("gu"), *[F.col(c).alias(f"u{c}") for c in further], F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), size.alias("c"))
    few = few.withColumn("size", F.explode(F.sequence(F.col("c") - 1, F.col("c") + 1)))
    all_ = at.select("key", F.col("line").alias("v"), F.col("g").alias("gv"), *[F.col(c).alias(f"v{c}") for c in further], "top", F.pmod(F.xxhash64("line.k"), F.col("slots")).cast("int").alias("slot"), size.alias("size"))
    both = few.join(all_, ["key", "size", "slot"])
    lesser = lambda c: F.coalesce((F.col(f"u{c}") == F.col(f"v{c}")) & (F.col(f"u{c}") < F.col("key")), F.lit(False))
    both = both.where((F.col("gu") != F.col("gv")) & ((F.col("gv") == F.col("top")) | (F.col("u") < F.col("v"))) & ~F.greatest(*[lesser(c) for c in further]) & _alike(both, "u", "v"))
    both = both.select(F.least("u", "v").alias("x"), F.greatest("u", "v").alias("y"))
    out = stage(_ends(both).distinct().join(met, ["x", "y"], "left_anti"), "rest")
    unstage(at)
    return out


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(*[F.struct(f"{c}.h", f"{c}.k").alias(c) for c in "xy"])


def _alike(pairs: DataFrame, x: str, y: str) -> Column:
    """False only when the lengths, or the counts of letters where the lines have them, differ by more edits than are allowed."""
    most = _most(F.col(f"{x}.len"), F.col(f"{y}.len"))
    out = F.abs(F.col(f"{x}.len") - F.col(f"{y}.len")) <= most
    if "l0" in pairs.schema[x].dataType.names:
        part = lambda c, i: F.shiftright(c, 8 * i).bitwiseAND(F.lit(255).cast("long"))
        both = [(part(F.col(f"{x}.l{j}"), i), part(F.col(f"{y}.l{j}"), i)) for j, s in enumerate(LETTERS) for i in range(len(s))]
        over = lambda ab: sum((F.greatest(a - b, F.lit(0).cast("long")) for a, b in ab[1:]), F.greatest(ab[0][0] - ab[0][1], F.lit(0).cast("long")))
        out = out & (over(both) <= most) & (over([(b, a) for a, b in both]) <= most)
    return out


def _most(a: Column, b: Column) -> Column:
    """The edits allowed between texts of two lengths."""
    return F.floor(F.greatest(a, b) * (1 - SIMILARITY) + 1e-9).cast("int")


def _letters(norm: Column, letters: str) -> Column:
    """How often each letter is in a text, 255 at most, a byte each. An edit takes one letter away and adds one, at most."""
    count = lambda c: F.least(F.octet_length(norm) - F.octet_length(F.replace(norm, F.lit(c), F.lit(""))), F.lit(255)).cast("long")
    return sum((F.shiftleft(count(c), 8 * i) for i, c in enumerate(letters[1:], 1)), count(letters[0]))


def _texts_of(docs: DataFrame, lines: DataFrame, ends: DataFrame) -> DataFrame:
    """(line, norm, l0..): the normal form of each line of ends(h, k) and its counts of letters, read again at one of its occurrences."""
    found = lookup_join(lines.select("h", "k", "doc", "doc_id", "pos"), ends, ["h", "k"], "left_semi")
    once = found.groupBy("h", "k").agg(F.min("doc").alias("doc"), F.min("doc_id").alias("id"), F.min("pos").alias("pos"), F.count("*").alias("c"))
    # Most lines occur once, where the three least values are its place; of the others a first place is taken.
    several = found.join(once.where("c > 1").select("h", "k"), ["h", "k"], "left_semi").groupBy("h", "k").agg(F.min(F.struct("doc", F.col("doc_id").alias("id"), "pos")).alias("at"))
    places = once.where("c = 1").select("h", "k", "doc", "id", "pos").union(several.select("h", "k", "at.doc", "at.id", "at.pos"))
    where = places.groupBy("doc", "id").agg(F.collect_list(F.struct("pos", F.struct("h", "k").alias("line"))).alias("at"))
    where = stage(where, "where")
    source = docs.select(F.xxhash64(F.col("doc_id"), _text()).alias("doc"), "doc_id", _text().alias("text"))
    same = (source["doc"] == where["doc"]) & source["doc_id"].eqNullSafe(where["id"])
    read = lookup_join(source, where, same, "inner").select(F.split(F.lower("text"), "\n").alias("ls"), "at")
    read = read.select(F.explode(F.transform("at", lambda a: F.struct(a["line"].alias("line"), F.get("ls", a["pos"]).alias("raw")))).alias("f"))
    read = read.select("f.line", normal(F.col("f.raw")).alias("norm")).dropDuplicates(["line"])
    out = stage(read.select("line", "norm", *[_letters(F.col("norm"), s).alias(f"l{j}") for j, s in enumerate(LETTERS)]), "norms")
    unstage(where)
    return out


def duplicate_lines(docs: DataFrame) -> DataFrame:
    """(doc, doc_id, pos) of each line that goes: all of a connected group but its first occurrence."""
    slim = docs.select("doc_id", "text")
    lines = stage(occurrences(slim), "lines")
    held = held_lines(lines, lines.where("few is not null").select("h", "k", "len", F.explode("few").alias("key")))
    ends = stage(held.select("line.h", "line.k").distinct(), "ends")
    norms = _texts_of(slim, lines, ends)
    counts = [f"l{j}" for j in range(len(LETTERS))]
    bare = held.withColumn("id", F.struct("line.h", "line.k")).join(norms.select(F.col("line").alias("id"), *counts), "id")
    full = stage(bare.select(F.struct("line.*", *counts).alias("line"), "key", *[f"n{i}" for i in range(1, KEYS)]), "held")
    pairs = stage(_neighbours(full), "pairs")
    fits = fits_broadcast(norms)
    linked = _verified(pairs, norms, fits)
    first = connected_components(linked)
    rest = rest_pairs(full, first, pairs)
    more = _verified(rest, norms, fits)
    comp = connected_components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    # Only lines that are repeated or linked can lose an occurrence; the others need no order.
    again = lines.groupBy("h", "k").agg(F.count("*").alias("c")).where("c > 1").select("h", "k", F.struct("h", "k").alias("g"))
    both = comp.select("node.h", "node.k", F.col("component").alias("g"), F.lit(1).alias("l")).union(again.withColumn("l", F.lit(0)))
    group = stage(both.groupBy("h", "k").agg(F.max(F.struct("l", "g")).alias("m")).select("h", "k", "m.g"), "group")
    occ = F.struct(F.col("doc_id").isNotNull().alias("n"), "doc_id", "doc", "pos")
    found = stage(lookup_join(lines.select("h", "k", occ.alias("occ")), group, ["h", "k"], "inner"), "occ")
    keep = stage(found.groupBy("g").agg(F.min("occ").alias("keep")), "keep")
    lost = lookup_join(found, keep, "g", "inner").where("occ <> keep").select("occ.doc", "occ.doc_id", "occ.pos")
    out = stage(lost.distinct(), "lost")
    unstage(lines, held, ends, norms, full, pairs, linked, first, rest, more, comp, group, found, keep)
    return out


def _verified(pairs: DataFrame, norms: DataFrame, fits: bool) -> DataFrame:
    """(a, b): the pairs (x, y) of lines within the edit similarity."""
    # Dealt before the joins: a filter is pushed below a later repartition and would run in the few tasks of the pairs.
    dealt = pairs.repartition(4 * shuffle_partitions(pairs.sparkSession), "x", "y")
    cmp = lookup_join(dealt, norms.select(F.col("line").alias("x"), F.col("norm").alias("a")), "x", "inner", fits=fits)
    cmp = lookup_join(cmp, norms.select(F.col("line").alias("y"), F.col("norm").alias("b")), "y", "inner", fits=fits)
    return stage(cmp.where(within_edits(F.col("a"), F.col("b"))).select(F.col("x").alias("a"), F.col("y").alias("b")), "linked")


def _let(value: Column, f) -> Column:
    """f(value) with value computed once."""
    return F.transform(F.array(value), f)[0]


def _common_prefix(a: Column, b: Column) -> Column:
    """Number of equal leading characters of two different texts, by bisection."""
    steps = F.sequence(F.length(F.bin(F.least(F.length(a), F.length(b)).cast("long"))) - 1, F.lit(0), F.lit(-1))

    def add(at, k):
        more = (at + F.pow(F.lit(2.0), k)).cast("int")
        return F.when(F.substring(a, F.lit(1), more) == F.substring(b, F.lit(1), more), more).otherwise(at)

    return F.aggregate(steps, F.lit(0), add)


def _core(a: Column, b: Column, f) -> Column:
    """f(x, y) of what is left of two different texts when common ends, which do not change the distance, are cut."""

    def cut(t):
        n = F.length(t["x"]) + F.length(t["y"])
        return _let(_common_prefix(t["x"], t["y"]), lambda k: F.struct(F.reverse(F.substring(t["x"], k + 1, n)).alias("x"), F.reverse(F.substring(t["y"], k + 1, n)).alias("y")))

    return _let(cut(_let_pair(a, b)), lambda h: _let(cut(h), lambda r: f(r["x"], r["y"])))


def _let_pair(a: Column, b: Column) -> Column:
    return F.struct(a.alias("x"), b.alias("y"))


def _pieces(t: Column) -> Column:
    """The words x and y of two texts in pieces (struct x, y of arrays of texts) that begin at words which each has once.

    About one word in eight is looked at, fewer of texts of more than 1,024 words. Both have as many pieces.
    """
    rate = F.greatest(F.lit(8), F.floor(F.greatest(F.size(t["x"]), F.size(t["y"])) / 128))
    some = lambda w: F.sort_array(F.filter(w, lambda x: F.pmod(F.xxhash64(x), rate) == 0))
    once = lambda w: _let(some(w), lambda s: F.filter(s, lambda x, i: ~F.coalesce(F.get(s, i - 1) == x, F.lit(False)) & ~F.coalesce(F.get(s, i + 1) == x, F.lit(False))))
    cut = lambda w, marks: F.split(F.array_join(F.transform(w, lambda x: F.when(F.array_contains(marks, x), F.concat(F.lit("\n"), x)).otherwise(x)), " "), "\n")
    return _let(F.array_intersect(once(t["x"]), once(t["y"])), lambda marks: F.struct(cut(t["x"], marks).alias("x"), cut(t["y"], marks).alias("y")))


def _shares(a: Column, b: Column) -> Column:
    """Two texts (struct x, y of arrays) cut into as many pieces of at most PIECE characters, at proportional places."""
    n = F.ceil(F.greatest(F.char_length(a), F.char_length(b)) / (PIECE - 1))
    at = lambda t, i: F.floor(F.char_length(t).cast("long") * i / n).cast("int")
    cut = lambda t: F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.substring(t, at(t, i) + 1, at(t, i + 1) - at(t, i)))
    return F.struct(cut(a).alias("x"), cut(b).alias("y"))


def within_edits(a: Column, b: Column) -> Column:
    """True when the edit distance of two texts is within 1 - SIMILARITY of the longer length.

    Common ends do not change the distance and are cut. What is left may be short enough to settle the case; else the
    edits of words at equal places, then of pieces that begin at the same words, bound the distance from above
    and may settle it, and runs of four characters from below; otherwise the rest is compared in a band (by proportional pieces beyond LONG characters).
    """
    most = _most(F.char_length(a), F.char_length(b))
    total = lambda edits: F.aggregate(edits, F.lit(0), lambda s, e: s + e)
    by_words = lambda t: total(F.zip_with(t["x"], t["y"], lambda p, q: F.when(p == q, 0).otherwise(F.levenshtein(p, q))))
    by_piece = lambda t: total(F.zip_with(t["x"], t["y"], lambda p, q: F.when(p == q, 0).otherwise(_let(F.greatest(F.char_length(p), F.char_length(q)), lambda n: F.when(n <= PIECE, _core(p, q, F.levenshtein)).otherwise(n)))))
    grams = lambda x: F.array_distinct(F.regexp_extract_all(x, F.lit("(?=(....))"), 1))
    # An edit spoils at most four runs of four characters.
    far = lambda x, y: _let(F.struct(grams(x).alias("x"), grams(y).alias("y")), lambda g: F.greatest(F.size(F.array_except(g["x"], g["y"])), F.size(F.array_except(g["y"], g["x"]))) > 4 * most)

    def bounded(t):
        same = F.size(t["x"]) == F.size(t["y"])
        return F.when(same & (F.when(same, by_words(t)) <= most), True).otherwise(_let(_pieces(t), by_piece) <= most)

    def settled(x, y):
        n, edits = F.greatest(F.char_length(x), F.char_length(y)), F.call_function("levenshtein", x, y, most) >= 0
        bound = _let(F.struct(F.split(x, " ").alias("x"), F.split(y, " ").alias("y")), bounded)
        return F.when(n <= most, True).when(n <= BAND, edits).when(bound, True).when(n <= PIECE, edits).when(far(x, y), False).when(n <= LONG, edits).otherwise(_let(_shares(x, y), by_piece) <= most)

    return F.when(F.abs(F.char_length(a) - F.char_length(b)) > most, False).otherwise(_core(a, b, settled))


def dedup_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_kept, kept_sha256): every document after line dedup."""
    lost = duplicate_lines(docs)
    gone = stage(lost.groupBy("doc", F.col("doc_id").alias("id")).agg(F.collect_list("pos").alias("gone")), "gone")
    d = docs.select("doc_id", _text().alias("text")).withColumn("doc", F.xxhash64("doc_id", "text"))
    d = lookup_join(d, gone, (d["doc"] == gone["doc"]) & d["doc_id"].eqNullSafe(gone["id"]))
    d = d.select("doc_id", "gone", F.split("text", "\n").alias("ls"))
    left = F.array_except(F.sequence(F.lit(0), F.size("ls") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("ls")).otherwise(F.transform(left, lambda i: F.get("ls", i)))
    d = d.select("doc_id", F.size("ls").cast("long").alias("n_lines"), kept.alias("kept"))
    return d.select("doc_id", "n_lines", F.size("kept").cast("long").alias("n_kept"), F.sha2(F.array_join("kept", "\n").cast("binary"), 256).alias("kept_sha256"))
