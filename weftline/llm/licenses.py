"""License scan: sparse TF-IDF cosine of lines, blocks and licence files to templates, then the nearest ancestor's licence.

What is compared with the templates (notices, headers and licence texts) are the lines of a file and, with all but the
notices, its blocks (lines between blank ones, joined, without comment marks) and, of licence files (is_license), the
whole text. A file's licence is
that of its part with the largest cosine to a template, SIMILARITY at least; an SPDX tag names it outright. Weights are
tf times idf; document frequencies of all words of the parts compared are counted over all files. A licence file also
gives its licence to its directory; a file without one of its own takes that of the nearest directory above it, by a
join on ancestor paths.

Defined results: null and empty texts and null paths have no licence of their own, null paths inherit none;
equal cosines go to the template first in order, equal licence files of a directory to the larger cosine, then
the smaller path; rows that repeat a path are scanned one by one. Licences without a template, bare names and
titles, and one-line notices wrapped over lines are not recognised.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import lookup_join, stage
from weftline.llm.notices import TEMPLATES

SIMILARITY = 0.75
#: What comments begin their lines with.
_MARK = r"(?m)^[ \t]*(?:/\*+|\*+/|\*+|//+|#+|;+|--+|%+|<!--)?[ \t]*"


def tokens(text: str) -> list[str]:
    import re

    return re.findall(r"[a-z0-9]+", text.lower())


#: Templates of at most so many words are notices, which single lines are compared with; blocks and files are compared with longer ones.
NOTICE = 25
VOCAB = sorted({t for _, x in TEMPLATES for t in tokens(x)})


def _words(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(line), F.lit(r"[a-z0-9]+|[^\x00-\x7F]+"), F.lit(0))


def _idf(n: int, df: int) -> float:
    return math.log((n + 1) / (df + 1)) + 1


def frequencies(files: DataFrame) -> DataFrame:
    """(t, df): in how many files each word is; words are counted within tasks before they are shuffled."""
    held = files.select(F.explode(F.array_distinct(_words(F.coalesce("text", F.lit(""))))).alias("t"))
    return held.groupBy("t").agg(F.count("*").alias("df"))


def term_weights(counts: DataFrame, n: int) -> dict[str, float]:
    """idf of each template term, from the frequencies of all words in n files."""
    df = {r["t"]: r["df"] for r in counts.where(F.col("t").isin(VOCAB)).collect()}
    return {t: _idf(n, df.get(t, 0)) for t in VOCAB}


def _texts(long: bool) -> list[str]:
    return [x for _, x in TEMPLATES if (len(tokens(x)) > NOTICE) == long]


def _told(idf: dict[str, float], long: bool) -> str:
    """A pattern of the telling terms: only a part with one of a template's can reach SIMILARITY; the weights say which they are."""
    return "(?<![a-z0-9])(?:" + "|".join(sorted({t for x in _texts(long) for t in _telling(x, idf)})) + ")(?![a-z0-9])"


def _enough(part: Column, idf: dict[str, float]) -> Column:
    """True when the terms that a part shares with some longer template have weight enough for SIMILARITY.

    A cosine is at most the length of the template's part that is shared, over the template's length.
    """
    shared = F.array_intersect(_words(part), F.array(*map(F.lit, VOCAB)))

    def adding(weight):
        return lambda s, t: s + F.coalesce(F.try_element_at(weight, t), F.lit(0.0))

    def any_of(own):
        out = F.lit(False)
        for x in _texts(long=True):
            sq = {t: (c * idf[t]) ** 2 for t, c in Counter(tokens(x)).items()}
            weight = F.create_map(*[F.lit(y) for kv in sq.items() for y in kv])
            out = out | (F.aggregate(own, F.lit(0.0), adding(weight)) >= SIMILARITY**2 * sum(sq.values()) * (1 - 1e-9))
        return out

    return F.transform(F.array(shared), any_of)[0]


def parts(files: DataFrame, idf: dict[str, float]) -> Column:
    """The lines, blocks and (of licence files) whole text that can reach SIMILARITY, each once."""
    text = F.coalesce(files["text"], F.lit(""))
    short, long = _told(idf, False), _told(idf, True)
    plain = F.regexp_replace(text, _MARK, "")
    none = F.array().cast("array<string>")
    blocks = F.filter(F.split(plain, r"\n[ \t\r]*\n"), lambda b: F.btrim(b, F.lit(" \t\r\n")).contains("\n"))
    whole = F.when(F.coalesce(files["is_license"], F.lit(False)), F.array(plain)).otherwise(none) if "is_license" in files.columns else none
    near = lambda x: F.lower(x).rlike(long) & _enough(x, idf)
    lines = F.split(text, "\n")
    # No part shares more with a template than the text that holds it.
    every = F.concat(F.filter(lines, lambda x: F.lower(x).rlike(short) | near(x)), F.filter(F.concat(blocks, whole), near))
    return F.array_distinct(F.when(near(text), every).otherwise(F.filter(lines, lambda x: F.lower(x).rlike(short))))


def own_license(files: DataFrame) -> DataFrame:
    """The files without text, with __row, license string and similarity double of each row's own text (null and 0 if none)."""
    n = files.count()
    counts = stage(frequencies(files), "df")
    idf = term_weights(counts, n)
    tag = F.nullif(F.regexp_extract(F.coalesce("text", F.lit("")), r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+-]+)", 1), F.lit(""))
    rows = stage(files.withColumns({"__row": F.monotonically_increasing_id(), "__parts": parts(files, idf), "__tag": tag}).drop("text"), "rows")
    own = rows.where("size(__parts) > 0").select("__row", F.explode("__parts").alias("line"))
    scores = _scores(own.select("line").distinct(), counts, idf, n)
    best = stage(lookup_join(own, scores, "line", "inner").groupBy("__row").agg(F.max("best").alias("__best")), "best")
    out = lookup_join(rows.drop("__parts"), best, "__row")
    hit = F.col("__best.s") >= SIMILARITY
    names = F.array(*[F.lit(name) for name, _ in TEMPLATES])
    near = F.when(hit, F.element_at(names, -F.col("__best.i")))
    score = F.when(F.col("__tag").isNotNull(), 1.0).otherwise(F.coalesce("__best.s", F.lit(0.0)))
    return out.withColumns({"license": F.coalesce("__tag", near), "similarity": score}).drop("__best", "__tag")


def _scores(lines: DataFrame, counts: DataFrame, idf: dict[str, float], n: int) -> DataFrame:
    """(line, best): the largest cosine s of each line to a template and -i of that template; counts has the frequencies of all words."""
    tf = stage(lines.select("line", F.explode(_words(F.col("line"))).alias("t")).groupBy("line", "t").agg(F.count("*").alias("tf")), "tf")
    words = stage(tf.select("t").distinct(), "words")
    df = stage(lookup_join(counts, words, "t", "left_semi"), "df")
    weight = F.log((n + 1) / (F.col("df") + 1)) + 1
    dots, sizes = [], []
    for i, (_, x) in enumerate(TEMPLATES, 1):
        own = Counter(tokens(x))
        sizes.append(math.sqrt(sum((c * idf[t]) ** 2 for t, c in own.items())))
        mine = F.create_map(*[F.lit(y) for t, c in own.items() for y in (t, c * idf[t] ** 2)])
        dots.append(F.sum(F.col("tf") * F.coalesce(F.try_element_at(mine, F.col("t")), F.lit(0.0))).alias(f"d{i}"))
    sums = lookup_join(tf, df, "t", "inner").groupBy("line").agg(F.sqrt(F.sum(F.pow(F.col("tf") * weight, F.lit(2.0)))).alias("norm"), *dots)
    cands = [F.struct(F.round(F.col(f"d{i}") / (F.col("norm") * size), 12).alias("s"), F.lit(-i).alias("i")) for i, size in enumerate(sizes, 1)]
    return stage(sums.select("line", F.array_max(F.array(*cands)).alias("best")), "scores")


def _telling(template: str, idf: dict[str, float]) -> set[str]:
    """Terms, rare ones first, without which a part's cosine to the template stays below SIMILARITY."""
    tf = Counter(tokens(template))
    sq = [((c * idf[t]) ** 2, t) for t, c in sorted(tf.items(), key=lambda x: (-idf[x[0]], -x[1], x[0]))]
    total, left, out = sum(x for x, _ in sq), sum(x for x, _ in sq), set()
    for x, t in sq:
        if math.sqrt(left / total) < SIMILARITY - 1e-9:
            break
        out.add(t)
        left -= x
    return out


def ancestors(path: Column) -> Column:
    """Directories above a path /a/b/file, as structs (depth, dir): /a/b, /a and the root."""
    part = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(part) - 1), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(part, 1, k), "/").alias("dir")))


def scan(files: DataFrame) -> DataFrame:
    """Licences of files(path, text, is_license): all their columns but text, with license, similarity, origin."""
    keep = [c for c in files.columns if c not in ("text", "license", "similarity", "origin")]
    own = stage(own_license(files.select(*keep, "text")), "own")
    parent = F.element_at(ancestors(F.col("path")), -1)["dir"]
    given = own.where("is_license and license is not null and path is not null")
    dirs = stage(given.groupBy(parent.alias("dir")).agg(F.min_by("license", F.struct(-F.col("similarity"), "path")).alias("given")), "dirs")
    needy = own.where("license is null and path is not null").select("__row", F.explode(ancestors(F.col("path"))).alias("a")).select("__row", "a.depth", "a.dir")
    heir = lookup_join(needy, dirs, "dir", "inner").groupBy("__row").agg(F.max(F.struct("depth", "dir", "given")).alias("h"))
    out = own.join(heir, "__row", "left")
    origin = F.when(F.col("license").isNotNull(), "own").when(F.col("h").isNotNull(), F.concat(F.lit("dir:"), F.col("h.dir"))).otherwise("none")
    return out.select(*keep, F.coalesce("license", "h.given").alias("license"), "similarity", origin.alias("origin"))


def license_report(docs: DataFrame) -> DataFrame:
    """documents as files: /source/doc_id div 1000/doc_id div 50/doc_id, those with doc_id mod 10 = 0 as licence files."""
    part = lambda n: F.floor(F.col("doc_id") / n).cast("string")
    path = F.concat(F.lit("/"), F.coalesce("source", F.lit("none")), F.lit("/"), part(1000), F.lit("/"), part(50), F.lit("/"), F.col("doc_id").cast("string"))
    files = docs.select("doc_id", path.alias("path"), "text", F.coalesce(F.col("doc_id") % 10 == 0, F.lit(False)).alias("is_license"))
    return scan(files).select("doc_id", "path", "license", "similarity", "origin")
