"""Column metrics of a predicted against a true name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.names import canonical_name, normalize_name, split_name


def _once(f, **values: Column) -> Column:
    """f of values that are computed once a row, however often f uses them, inside its lambdas too."""
    kept = F.struct(*[v.alias(name) for name, v in values.items()])
    return F.transform(F.array(kept), lambda s: f(*[s[name] for name in values]))[0]


def multiset_overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays."""
    count = lambda arr, t: F.size(F.filter(arr, lambda x: x == t))
    return _once(lambda a, b: F.aggregate(F.array_distinct(a), F.lit(0), lambda s, t: s + F.least(count(a, t), count(b, t))), a=a, b=b)


def prf(pred: Column, true: Column) -> Column:
    """struct(tp, n_pred, n_true, precision, recall, f1) of sub-tokens; both empty 1, one empty 0."""

    def scores(tp, n, m):
        both, none = (n == 0) & (m == 0), (n == 0) | (m == 0) | (tp == 0)
        p, r = tp / n, tp / m
        pick = lambda x: F.when(both, 1.0).when(none, 0.0).otherwise(x)
        return F.struct(tp.alias("tp"), n.alias("n_pred"), m.alias("n_true"), pick(p).alias("precision"), pick(r).alias("recall"), pick(2.0 * tp / (n + m)).alias("f1"))

    return _once(lambda a, b: _once(scores, tp=multiset_overlap(a, b), n=F.size(a), m=F.size(b)), a=split_name(pred), b=split_name(true))


def set_f1(a: Column, b: Column) -> Column:
    inter = F.size(F.array_intersect(a, b))
    total = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(2.0 * inter / total)


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def overlap_coefficient(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b))))


def char_ngrams(s: Column, n: int = 3) -> Column:
    """The set of n-grams; a shorter text is its own."""
    long_ = F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - n + 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(n)))
    return F.array_distinct(F.when(F.length(s) < n, F.array(s)).otherwise(long_))


def char_ngram_dice(pred: Column, true: Column, n: int = 3) -> Column:
    dice = lambda x, y: 2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))
    of = lambda a, b: F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(_once(dice, x=char_ngrams(a, n), y=char_ngrams(b, n)))
    return _once(of, a=normalize_name(pred), b=normalize_name(true))


def edit_similarity(pred: Column, true: Column) -> Column:
    like = lambda a, b: F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(1.0 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))
    return _once(like, a=normalize_name(pred), b=normalize_name(true))


def exact_match(pred: Column, true: Column) -> Column:
    return normalize_name(pred) == normalize_name(true)


def exact_forms(pred: Column, true: Column) -> Column:
    """struct of the four exact matches: normalised, raw, canonical and an F1 of 1 (which forgives the order of sub-tokens)."""
    return F.struct(exact_match(pred, true).alias("normalised"), (pred == true).alias("raw"), (canonical_name(pred) == canonical_name(true)).alias("canonical"), (prf(pred, true)["f1"] == 1.0).alias("f1_one"))


def top_k_match(candidates: Column, true: Column, k: int) -> Column:
    return F.exists(F.slice(candidates, 1, k), lambda c: normalize_name(c) == normalize_name(true))


def reward(pred: Column, true: Column) -> Column:
    # Every letter and digit is part of a word, accented ones too; underscores part words.
    parts = F.size(F.split(pred, r"[^\p{L}\p{N}]+"))
    length = F.greatest(F.lit(0.0), 1.0 - 0.02 * F.greatest(parts - 10, F.lit(0)))
    return 0.6 * prf(pred, true)["f1"] + 0.2 * char_ngram_dice(pred, true) + 0.1 * (pred == true).cast("double") + 0.1 * length


def cluster_f1(pred: Column, true: Column, clusters: Column) -> Column:
    """Sub-token F1 after a predicted token that shares a cluster with a true one is replaced by the first such.

    clusters is a map of token to array of cluster ids.
    """
    a, b = split_name(pred), split_name(true)
    of = lambda t: F.coalesce(F.try_element_at(clusters, t), F.array().cast("array<int>"))
    swap = lambda p: F.coalesce(F.get(F.filter(b, lambda t: F.arrays_overlap(of(p), of(t))), F.lit(0)), p)
    rep = F.transform(a, lambda p: F.when(F.array_contains(b, p), p).otherwise(swap(p)))
    n, m, tp = F.size(a), F.size(b), multiset_overlap(rep, b)
    return F.when((n == 0) & (m == 0), 1.0).when((n == 0) | (m == 0), 0.0).otherwise(2.0 * tp / (n + m))


def all_metrics(pred: Column, true: Column) -> Column:
    """struct of precision, recall, f1, exact, ngram and edit."""
    s = prf(pred, true)
    return F.struct(s["precision"].alias("precision"), s["recall"].alias("recall"), s["f1"].alias("f1"), exact_match(pred, true).alias("exact"), char_ngram_dice(pred, true).alias("ngram"), edit_similarity(pred, true).alias("edit"))
