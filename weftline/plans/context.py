"""Context digests and evidence over documents; rule classes over IR-like text."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import code as C
from weftline.functions import names as N
from weftline.operators import digest as D
from weftline.operators import ir as I
from weftline.operators import joins as J
from weftline.operators.split import _cut
from weftline.plans.base import registry

QUERIES, ORACLES, query = registry()

_STOP = ", ".join(f"'{w}'" for w in sorted(set(N.STOP)))
_CAMEL = "regexp_replace(regexp_replace(s, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g')"
_TOKEN = f"length(token) > 2 AND length(token) < 25 AND NOT regexp_full_match(token, '[0-9]+') AND token NOT IN ({_STOP})"
# Pages stand for functions: their hosts for binaries, their numbers for addresses, their markup for code.
_D = "d AS (SELECT page_id AS doc_id, split_part(url, '/', 3) AS source, html, split_part(url, '/', 4) AS unit, row_number() OVER (PARTITION BY split_part(url, '/', 3) ORDER BY page_id) AS pos FROM pages)"
# The bracket is doubled so that the character before a name is never part of the match before it.
_EV = f"""raw AS (SELECT source, pos, unnest(regexp_extract_all(html, '"((?:[^"\\\\\n]|\\\\.){{3,200}})"', 1)) AS s FROM d UNION ALL SELECT source, pos, s FROM (SELECT source, pos, unnest(regexp_extract_all(replace(html, '(', '(('), '(?:^|[^\\p{{L}}\\p{{N}}_])([A-Za-z_][A-Za-z0-9_]{{2,}})\\s*\\(', 1)) AS s FROM d) WHERE NOT starts_with(s, 'FUN_') AND NOT starts_with(s, 'sub_') AND NOT starts_with(s, '_') AND lower(s) NOT IN ({_STOP})), ev AS (SELECT source, pos, token, count(*) AS cnt FROM (SELECT source, pos, unnest(string_split_regex(lower({_CAMEL}), '[^a-z0-9]+')) AS token FROM raw) WHERE {_TOKEN} GROUP BY 1, 2, 3)"""
_NEAR = "near AS (SELECT a.source, a.pos, e.token, count(*) AS df, sum(e.cnt)::BIGINT AS tot FROM d a JOIN ev e ON e.source = a.source AND e.pos BETWEEN a.pos - 2 AND a.pos + 2 AND e.pos <> a.pos GROUP BY 1, 2, 3)"
# Callees of a function are the next ones at three times its position, callers the reverse.
_CALLEE = "callee AS (SELECT a.source, a.pos, b.pos AS n_pos FROM d a JOIN d b ON b.source = a.source AND b.pos IN (3 * a.pos, 3 * a.pos + 1)), caller AS (SELECT source, n_pos AS pos, pos AS n_pos FROM callee)"


def _rows(t):
    d = t.pages.select(F.col("page_id").alias("doc_id"), F.split_part("url", F.lit("/"), F.lit(3)).alias("source"), F.split_part("url", F.lit("/"), F.lit(4)).alias("unit"), "html")
    return _cut(D.positions(d.withColumn("tokens", C.evidence_tokens(F.col("html"))).drop("html"), "source", "doc_id"))


def _evidence(t):
    d = _rows(t)
    return d, _cut(D.evidence(d, "source", "pos", "tokens"))


def _calls(d):
    to = F.explode(F.array(F.col("pos") * 3, F.col("pos") * 3 + 1)).alias("n_pos")
    callee = d.select("source", "pos", to).join(d.select("source", F.col("pos").alias("n_pos")), ["source", "n_pos"], "left_semi").select("source", "pos", "n_pos")
    return callee, callee.select("source", F.col("n_pos").alias("pos"), F.col("pos").alias("n_pos"))


@query(f"WITH {_D}, {_EV}, {_NEAR}, r AS (SELECT *, row_number() OVER (PARTITION BY source, pos ORDER BY df DESC, tot DESC, token) AS rank FROM near) SELECT d.doc_id, string_agg(token, ' ' ORDER BY rank) AS digest FROM r JOIN d USING (source, pos) WHERE rank <= 40 GROUP BY d.doc_id")
def band_digest(t):
    d, ev = _evidence(t)
    near = D.neighbour_tokens(d.select("source", "pos"), ev, "source", "pos", 2)
    top = D.top_tokens(near, ["source", "pos"], [F.desc("df"), F.desc("tot"), "token"], 40)
    return D.joined(top, ["source", "pos"]).join(d.select("source", "pos", "doc_id"), ["source", "pos"]).select("doc_id", "digest")


@query(f"WITH {_D}, {_EV}, n AS (SELECT count(DISTINCT source) AS n FROM ev), df AS (SELECT token, count(DISTINCT source) AS df FROM ev GROUP BY token) SELECT token, df, round(ln((n + 1)::DOUBLE / (df + 1)), 9) AS idf FROM df, n")
def token_idf(t):
    _, ev = _evidence(t)
    return D.idf(ev, "source").select("token", "df", F.round("idf", 9).alias("idf"))


@query(f"WITH {_D}, {_EV}, {_NEAR}, one AS (SELECT source, pos, token, df * 1000000 + tot AS score, row_number() OVER (PARTITION BY source, pos ORDER BY df * 1000000 + tot DESC, token) AS rank FROM near), t1 AS (SELECT * FROM one WHERE rank <= 24), c AS (SELECT a.source, a.pos, e.token, sum(e.cnt)::BIGINT AS score FROM d a JOIN ev e ON e.source = a.source AND (e.pos = a.pos * 2 OR e.pos * 2 = a.pos) AND e.pos <> a.pos GROUP BY 1, 2, 3), two AS (SELECT c.*, row_number() OVER (PARTITION BY source, pos ORDER BY score DESC, token) AS rank FROM c ANTI JOIN t1 USING (source, pos, token)), t2 AS (SELECT * FROM two WHERE rank <= 16), p AS (SELECT source, token, count(*) AS score FROM ev GROUP BY 1, 2), p40 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, token) AS k FROM p) WHERE k <= 56), three AS (SELECT d.source, d.pos, p40.token, score, row_number() OVER (PARTITION BY d.source, d.pos ORDER BY score DESC, p40.token) AS rank FROM d JOIN p40 ON p40.source = d.source WHERE NOT EXISTS (SELECT 1 FROM t1 WHERE t1.source = d.source AND t1.pos = d.pos AND t1.token = p40.token) AND NOT EXISTS (SELECT 1 FROM t2 WHERE t2.source = d.source AND t2.pos = d.pos AND t2.token = p40.token)) SELECT tier, rank, count(*) AS n, count(DISTINCT token) AS tokens, min(token) AS first, max(token) AS last FROM (SELECT 1 AS tier, rank, token FROM t1 UNION ALL SELECT 2, rank, token FROM t2 UNION ALL SELECT 3, rank, token FROM three WHERE rank <= 16) GROUP BY 1, 2")
def tier_digest(t):
    d, ev = _evidence(t)
    rows = d.select("source", "pos")
    near = D.neighbour_tokens(rows, ev, "source", "pos", 2).select("source", "pos", "token", (F.col("df") * 1000000 + F.col("tot")).alias("score"))
    link = rows.select("source", "pos", (F.col("pos") * 2).alias("n_pos"))
    link = link.union(link.select("source", F.col("n_pos").alias("pos"), F.col("pos").alias("n_pos"))).join(rows, ["source", "pos"], "left_semi")
    call = link.join(ev.withColumnRenamed("pos", "n_pos"), ["source", "n_pos"]).groupBy("source", "pos", "token").agg(F.sum("cnt").alias("score"))
    pool = D.top_tokens(ev.groupBy("source", "token").agg(F.count("*").alias("score")), ["source"], [F.desc("score"), "token"], 56).drop("rank")
    pool = rows.join(pool, "source").select("source", "pos", "token", "score")  # 24 + 16 + 16 are enough to fill the third tier
    r = D.tiered(near, call, pool, ["source", "pos"], (24, 16, 16))
    return r.groupBy("tier", "rank").agg(F.count("*").alias("n"), F.count_distinct("token").alias("tokens"), F.min("token").alias("first"), F.max("token").alias("last")).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {_D}, {_EV}, {_NEAR}, own AS (SELECT e.source, e.pos, e.token, (n.token IS NOT NULL)::INT AS hit FROM ev e LEFT JOIN near n ON n.source = e.source AND n.pos = e.pos AND n.token = e.token), s AS (SELECT source, pos, max(hit) AS any_hit, min(hit) AS all_hit FROM own GROUP BY 1, 2) SELECT source, count(*) AS n, sum(any_hit)::BIGINT AS any_hit, sum(all_hit)::BIGINT AS all_hit FROM s GROUP BY source")
def evidence_cover(t):
    d, ev = _evidence(t)
    near = D.neighbour_tokens(d.select("source", "pos"), ev, "source", "pos", 2).select("source", "pos", "token", F.lit(1).alias("hit"))
    own = ev.select("source", "pos", "token").join(near, ["source", "pos", "token"], "left").na.fill(0)
    s = own.groupBy("source", "pos").agg(F.max("hit").alias("a"), F.min("hit").alias("b"))
    return s.groupBy("source").agg(F.count("*").alias("n"), F.sum("a").alias("any_hit"), F.sum("b").alias("all_hit"))


_INTRINSIC = ("x86_is_nan", "forder_f64", "FADD_rne", "fsub_rne", "fmul", "fdiv", "fsqrt", "cast_sfloat64", "cast_sint", "cast_uint", "fconvert", "fround", "hlt", "__ud2", "ud2", "int3", "fadd_is_nan", "cast_uint_fround", "pcmpeqb")
_CLASSES = ("FP_ISNAN", "FP_CMP", "FP_ADD", "FP_SUB", "FP_MUL", "FP_DIV", "FP_SQRT", "FP_CAST_TO_FLOAT", "FP_CAST_TO_INT", "FP_CAST_TO_INT", "FP_CONVERT", "FP_ROUND", "TRAP", "TRAP", "TRAP", "TRAP", "FP_ISNAN", "FP_CAST_TO_INT", "INTRINSIC_OTHER")


@query("SELECT " + str(list(_CLASSES)) + f"[1 + (p_partkey % {len(_CLASSES)})::INT] AS cls, count(*) AS n FROM part GROUP BY 1")
def classify_rules(t):
    name = F.element_at(F.array(*map(F.lit, _INTRINSIC)), (F.col("p_partkey") % len(_INTRINSIC) + 1).cast("int"))
    return t.part.groupBy(I.intrinsic_token(F.concat(F.lit("intrinsic:"), name)).alias("cls")).agg(F.count("*").alias("n"))


@query("SELECT tok, count(*) AS n FROM (SELECT CASE WHEN v IN (15, 31, 63, 255, 256, 1024, 4096, 65536) THEN 'LIT_' || CASE v WHEN 15 THEN 'MASK4' WHEN 31 THEN 'MASK5' WHEN 63 THEN 'MASK6' WHEN 255 THEN 'BYTE_MASK' WHEN 256 THEN 'K256' WHEN 1024 THEN 'K1024' WHEN 4096 THEN 'PAGE' ELSE 'K64K' END WHEN v <= 16 THEN 'LIT_' || v WHEN v BETWEEN 32 AND 126 THEN 'LIT_CHR' WHEN bit_count(v) = 1 THEN 'LIT_POW2_' || log2(v)::INT WHEN v < 4096 THEN 'LIT_SMALL12' ELSE 'LIT_HI' || length(to_hex(v)) END AS tok FROM (SELECT l_orderkey AS v FROM lineitem)) GROUP BY tok")
def literal_classes(t):
    stmt = F.concat(F.lit("00000001: RAX := 0x"), F.hex("l_orderkey"))
    return t.lineitem.select(F.explode(I.literal_tokens(stmt)).alias("tok")).groupBy("tok").agg(F.count("*").alias("n"))


@query("WITH t AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[A-Za-z]+|[0-9]+'), lambda w: lower(w)), lambda w: length(w) >= 2)[1:8] AS v2 FROM documents) SELECT doc_id, array_to_string(v2, ' ') AS v2 FROM t")
def string_tokens(t):
    return t.documents.select("doc_id", F.array_join(N.string_tokens_v2(F.col("text")), " ").alias("v2"))


_RANKED = "SELECT source, pos, token, df, tot, {extra} row_number() OVER (PARTITION BY source, pos ORDER BY df DESC, tot DESC, token) AS rank FROM"


@query(f"WITH {_D}, {_EV}, {_CALLEE}, g AS (SELECT n.source, n.pos, e.token, count(*) AS df, sum(e.cnt)::BIGINT AS tot, bit_or(n.r) AS r FROM (SELECT *, 1 AS r FROM callee UNION ALL SELECT *, 2 FROM caller) n JOIN ev e ON e.source = n.source AND e.pos = n.n_pos GROUP BY 1, 2, 3), k AS ({_RANKED.format(extra='r,')} g) SELECT source, pos, CASE r WHEN 1 THEN 'callees' WHEN 2 THEN 'callers' ELSE 'both' END AS role, string_agg(token, ' ' ORDER BY rank) AS digest FROM k WHERE rank <= 40 GROUP BY ALL")
def role_digest(t):
    d, ev = _evidence(t)
    callee, caller = _calls(d)
    return D.by_role(callee, caller, ev, "source", "pos", 40).select("source", "pos", "role", "digest")


@query(f"WITH {_D}, {_EV}, {_CALLEE}, g AS (SELECT n.source, n.pos, n.role, e.token, count(*) AS df, sum(e.cnt)::BIGINT AS tot FROM (SELECT *, 'callees' AS role FROM callee UNION ALL SELECT *, 'callers' FROM caller) n JOIN ev e ON e.source = n.source AND e.pos = n.n_pos GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY source, pos, role ORDER BY df DESC, tot DESC, token) AS rank FROM g) SELECT source, pos, role, string_agg(token, ' ' ORDER BY rank) AS digest FROM k WHERE rank <= 20 GROUP BY ALL")
def balanced_digest(t):
    d, ev = _evidence(t)
    callee, caller = _calls(d)
    return D.balanced(callee, caller, ev, "source", "pos", 20).select("source", "pos", "role", "digest")


_ORDERED = "nb AS (SELECT *, row_number() OVER (PARTITION BY source, pos ORDER BY role, n_pos) AS o, greatest(3, 40 // count(*) OVER (PARTITION BY source, pos)) AS m FROM (SELECT *, 'callee' AS role FROM callee UNION ALL SELECT *, 'caller' FROM caller))"


def _neighbours(d):
    from pyspark.sql import Window

    callee, caller = _calls(d)
    nb = callee.withColumn("role", F.lit("callee")).union(caller.withColumn("role", F.lit("caller")))
    return nb.withColumn("order", F.row_number().over(Window.partitionBy("source", "pos").orderBy("role", "n_pos")))


@query(f"WITH {_D}, {_EV}, {_CALLEE}, {_ORDERED}, n AS (SELECT count(*) AS n FROM d), df AS (SELECT token, count(*) AS df FROM ev GROUP BY token), w AS (SELECT e.*, round(ln((n.n + 1)::DOUBLE / (df.df + 1)) * least(cnt, 3), 9) AS w FROM ev e JOIN df USING (token), n), k AS (SELECT nb.*, w.token, row_number() OVER (PARTITION BY nb.source, nb.pos, o ORDER BY w DESC, w.token) AS rank FROM nb JOIN w ON w.source = nb.source AND w.pos = nb.n_pos), f AS (SELECT * FROM k WHERE rank <= m), z AS (SELECT source, pos, o, count(*) AS c FROM f GROUP BY 1, 2, 3), l AS (SELECT *, 40 - coalesce(sum(c) OVER (PARTITION BY source, pos ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM z) SELECT f.source, f.pos, f.o AS \"order\", f.role, string_agg(f.token, ' ' ORDER BY rank) AS digest FROM f JOIN l USING (source, pos, o) WHERE rest > 0 AND rank <= rest GROUP BY ALL")
def budget_digest(t):
    d, ev = _evidence(t)
    return D.budgeted(_neighbours(d), _weighted(d, ev, F.lit("all")), "source", "pos", 40).select("source", "pos", "order", "role", "digest")


def _weighted(d, ev, kind):
    n = ev.groupBy("token").agg(F.count("*").alias("df"))
    total = d.agg(F.count("*").alias("n"))
    w = ev.join(n, "token").join(F.broadcast(total))  # one row
    weight = F.round(F.log((F.col("n") + 1) / (F.col("df") + 1)) * F.least("cnt", F.lit(3)), 9)
    return w.select("source", "pos", kind.alias("kind"), "token", weight.alias("weight"))


@query(f"WITH {_D}, {_EV}, {_CALLEE}, {_ORDERED}, n AS (SELECT count(*) AS n FROM d), df AS (SELECT token, count(*) AS df FROM ev GROUP BY token), w AS (SELECT e.*, CASE WHEN length(token) <= 4 THEN 'short' WHEN length(token) <= 7 THEN 'middle' ELSE 'long' END AS kind, round(ln((n.n + 1)::DOUBLE / (df.df + 1)) * least(cnt, 3), 9) AS w FROM ev e JOIN df USING (token), n), k AS (SELECT nb.*, w.kind, w.token, row_number() OVER (PARTITION BY nb.source, nb.pos, o, kind ORDER BY w DESC, w.token) AS rank FROM nb JOIN w ON w.source = nb.source AND w.pos = nb.n_pos), f AS (SELECT * FROM k WHERE rank <= greatest(1, m // 3)), z AS (SELECT source, pos, o, count(*) AS c FROM f GROUP BY 1, 2, 3), l AS (SELECT *, 40 - coalesce(sum(c) OVER (PARTITION BY source, pos ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM z) SELECT f.source, f.pos, f.o AS \"order\", f.role, f.kind, string_agg(f.token, ' ' ORDER BY rank) AS digest FROM f JOIN l USING (source, pos, o) WHERE rest > 0 AND rank <= greatest(1, least(m, rest) // 3) GROUP BY ALL")
def typed_digest(t):
    """The budget is shared by three kinds of tokens, by their lengths."""
    d, ev = _evidence(t)
    n = F.length("token")
    kind = F.when(n <= 4, "short").when(n <= 7, "middle").otherwise("long")
    return D.budgeted(_neighbours(d), _weighted(d, ev, kind), "source", "pos", 40, ["short", "middle", "long"]).select("source", "pos", "order", "role", "kind", "digest")


_PRED = "pr AS (SELECT source, pos, token, 2 * count(*) AS cnt FROM (SELECT source, pos, unnest(string_split_regex(lower(regexp_replace(regexp_replace(s, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g')), '[^a-z0-9]+')) AS token FROM (SELECT source, pos, unit || 'Reader' AS s FROM d)) WHERE " + _TOKEN + " GROUP BY ALL)"


@query(f"WITH {_D}, {_EV}, {_PRED}, bt AS (SELECT source, pos, token, sum(cnt)::BIGINT AS cnt FROM (SELECT * FROM ev UNION ALL SELECT * FROM pr) GROUP BY ALL), g AS (SELECT a.source, a.pos, e.token, count(*) AS df, sum(e.cnt)::BIGINT AS tot FROM d a JOIN bt e ON e.source = a.source AND e.pos BETWEEN a.pos - 2 AND a.pos + 2 AND e.pos <> a.pos GROUP BY 1, 2, 3), k AS ({_RANKED.format(extra='')} g) SELECT source, pos, string_agg(token, ' ' ORDER BY rank) AS digest FROM k WHERE rank <= 40 GROUP BY 1, 2")
def second_pass_digest(t):
    d, ev = _evidence(t)
    pred = d.select("source", "pos", F.concat("unit", F.lit("Reader")).alias("p"))
    both = D.with_predictions(ev, pred, "source", "pos", N.digest_tokens(F.col("p")))
    top = D.top_tokens(D.neighbour_tokens(d.select("source", "pos"), both, "source", "pos", 2), ["source", "pos"], [F.desc("df"), F.desc("tot"), "token"], 40)
    return D.joined(top, ["source", "pos"])


_UNIT = "u AS (SELECT source, pos, CASE WHEN doc_id % 7 <> 0 THEN doc_id % 3 END AS unit FROM d), pairs AS (SELECT a.source, a.pos, b.pos AS n_pos FROM d a JOIN d b ON b.source = a.source AND b.pos BETWEEN a.pos - 2 AND a.pos + 2 AND b.pos <> a.pos)"


def _units(d):
    return d.select("source", "pos", F.when(F.col("doc_id") % 7 != 0, F.col("doc_id") % 3).alias("unit"))


@query(f"WITH {_D}, {_EV}, {_UNIT}, g AS (SELECT p.source, p.pos, e.token, count(*) AS df, sum(e.cnt)::BIGINT AS tot, coalesce(bool_or(x.unit = o.unit), false) AS same, coalesce(bool_or(x.unit <> o.unit), false) AS diff FROM pairs p JOIN u o ON o.source = p.source AND o.pos = p.pos AND o.unit IS NOT NULL JOIN u x ON x.source = p.source AND x.pos = p.n_pos JOIN ev e ON e.source = p.source AND e.pos = p.n_pos GROUP BY 1, 2, 3), k AS ({_RANKED.format(extra='same, diff,')} g) SELECT CASE WHEN NOT same AND NOT diff THEN 'unknown' WHEN same AND diff THEN 'both' WHEN same THEN 'same_file_only' ELSE 'different_file_only' END AS origin, count(*) AS n FROM k WHERE rank <= 40 GROUP BY 1")
def token_provenance(t):
    d, ev = _evidence(t)
    pairs = J.band_pairs(d, "source", "pos", 2)
    return D.provenance(pairs, ev, _units(d), "source", "pos", 40).groupBy("origin").agg(F.count("*").alias("n"))


@query(f"WITH {_D}, {_UNIT}, s AS (SELECT p.source, p.pos, o.unit, avg(coalesce(x.unit = o.unit, false)::INT) AS same, avg((x.unit IS NULL)::INT) AS unknown FROM pairs p JOIN u o ON o.source = p.source AND o.pos = p.pos AND o.unit IS NOT NULL JOIN u x ON x.source = p.source AND x.pos = p.n_pos GROUP BY ALL) SELECT s.source, s.pos, round(same, 9) AS same, round(1 - same - unknown, 9) AS other, round(unknown, 9) AS unknown, round((f.n - 1)::DOUBLE / greatest(b.n - 1, 1), 9) AS expected FROM s JOIN (SELECT source, unit, count(*) AS n FROM u GROUP BY ALL) f ON f.source = s.source AND f.unit = s.unit JOIN (SELECT source, count(*) AS n FROM u GROUP BY ALL) b ON b.source = s.source")
def unit_share(t):
    d = _rows(t)
    r = D.unit_share(J.band_pairs(d, "source", "pos", 2), _units(d), "source", "pos")
    return r.select("source", "pos", *[F.round(c, 9).alias(c) for c in ("same", "other", "unknown", "expected")])


@query(f"WITH {_D}, {_EV}, {_NEAR}, k AS ({_RANKED.format(extra='')} near), g AS (SELECT source, pos, token FROM k WHERE rank <= 40), w AS (SELECT source, pos, unnest(string_split_regex(lower(split_part(source, '.', 1) || '_' || unit || '_class'), '[^a-z0-9]+')) AS token, unnest(range(0, len(string_split_regex(lower(split_part(source, '.', 1) || '_' || unit || '_class'), '[^a-z0-9]+')))) AS ix FROM d), h AS (SELECT w.*, (g.token IS NOT NULL)::INT AS hit FROM w LEFT JOIN g ON g.source = w.source AND g.pos = w.pos AND g.token = w.token WHERE w.token <> ''), c AS (SELECT source, pos, max(hit) AS a, max(hit) FILTER (ix = 0) AS f, min(hit) AS l FROM h GROUP BY 1, 2) SELECT source, count(*) AS n, sum(a)::BIGINT AS any_hit, sum(f)::BIGINT AS first_hit, sum(l)::BIGINT AS all_hit FROM c GROUP BY source")
def name_cover(t):
    d, ev = _evidence(t)
    top = D.top_tokens(D.neighbour_tokens(d.select("source", "pos"), ev, "source", "pos", 2), ["source", "pos"], [F.desc("df"), F.desc("tot"), "token"], 40)
    name = F.concat_ws("_", F.split_part("source", F.lit("."), F.lit(1)), "unit", F.lit("class"))
    c = D.cover(d.select("source", "pos", name.alias("nm")), top, "source", "pos", F.filter(F.split(F.lower("nm"), "[^a-z0-9]+"), lambda x: x != ""))
    return c.groupBy("source").agg(F.count("*").alias("n"), *[F.sum(x).alias(x) for x in ("any_hit", "first_hit", "all_hit")])
