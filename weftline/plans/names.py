"""Names: splitting, scoring, masking, vocabularies (over part and nation)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import metrics as M
from weftline.functions import names as N
from weftline.operators import vocab as V
from weftline.operators.split import _cut
from weftline.plans.base import registry

QUERIES, ORACLES, query = registry()

_NAME = "replace(p_name, ' ', '_') || p_type || 'Item'"


def _names(t) -> DataFrame:
    return t.part.select("p_partkey", F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), "p_type", F.lit("Item")).alias("name"), "p_brand")


def _pairs(t) -> DataFrame:
    # Names are few bytes and much work: dealt to a fixed number of tasks, as a small file or exchange is read by one or two.
    tasks = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    n = _names(t).select("p_partkey", "name").repartition(tasks, "p_partkey")
    return n.join(n.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("name").alias("true")), "p_partkey").withColumnRenamed("name", "pred")


def _sql_split(x: str) -> str:
    camel = f"regexp_replace(regexp_replace(trim(replace({x}, ' ', ''), '_.'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g')"
    return f"list_filter(list_transform(string_split_regex({camel}, '[_.\\-]+'), lambda t: lower(trim(t))), lambda t: t <> '')"


def _sql_norm(x: str) -> str:
    return f"lower(trim(replace({x}, ' ', ''), '_.'))"


_PAIRS = f"n AS (SELECT p_partkey, {_NAME} AS name FROM part), pairs AS (SELECT a.p_partkey, a.name AS pred, b.name AS truth FROM n a JOIN n b ON b.p_partkey = a.p_partkey + 1)"
_TP = "list_sum(list_transform(list_distinct(a), lambda t: least(len(list_filter(a, lambda x: x = t)), len(list_filter(b, lambda x: x = t)))))"
_F1 = f"f AS (SELECT p_partkey, pred, truth, coalesce({_TP}, 0)::INT AS tp, len(a)::INT AS n_pred, len(b)::INT AS n_true FROM (SELECT *, {_sql_split('pred')} AS a, {_sql_split('truth')} AS b FROM pairs))"


def _grams(x: str) -> str:
    return f"list_distinct(CASE WHEN length({x}) < 3 THEN [{x}] ELSE list_transform(range(1, greatest(length({x}) - 1, 2)), lambda i: substr({x}, i, 3)) END)"


_DICE = f"d AS (SELECT p_partkey, CASE WHEN x = '' OR y = '' THEN 0.0 WHEN x = y THEN 1.0 ELSE 2.0 * len(list_intersect(gx, gy)) / (len(gx) + len(gy)) END AS dice, CASE WHEN x = y THEN 1.0 WHEN x = '' OR y = '' THEN 0.0 ELSE 1.0 - levenshtein(x, y)::DOUBLE / greatest(length(x), length(y)) END AS edit FROM (SELECT *, {_grams('x')} AS gx, {_grams('y')} AS gy FROM (SELECT p_partkey, {_sql_norm('pred')} AS x, {_sql_norm('truth')} AS y FROM pairs)))"


@query(f"SELECT p_partkey, (i - 1)::INT AS pos, toks[i] AS token FROM (SELECT p_partkey, toks, unnest(range(1, len(toks) + 1)) AS i FROM (SELECT p_partkey, {_sql_split(_NAME)} AS toks FROM part))")
def split_name(t):
    return _names(t).select("p_partkey", F.posexplode(N.split_name(F.col("name"))).alias("pos", "token"))


@query(f"WITH {_PAIRS}, {_F1} SELECT p_partkey, tp, n_pred, n_true, round(CASE WHEN tp = 0 THEN 0.0 ELSE 2.0 * tp / (n_pred + n_true) END, 9) AS f1, round(CASE WHEN tp = 0 THEN 0.0 ELSE tp::DOUBLE / n_pred END, 9) AS prec, round(CASE WHEN tp = 0 THEN 0.0 ELSE tp::DOUBLE / n_true END, 9) AS rec FROM f")
def subtoken_f1(t):
    p = _pairs(t).withColumn("m", M.prf(F.col("pred"), F.col("true")))
    return p.select("p_partkey", "m.tp", "m.n_pred", "m.n_true", F.round("m.f1", 9).alias("f1"), F.round("m.precision", 9).alias("prec"), F.round("m.recall", 9).alias("rec"))


@query(f"WITH {_PAIRS}, {_DICE} SELECT p_partkey, round(dice, 9) AS dice3, round(edit, 9) AS edit_sim FROM d")
def dice_edit(t):
    p = _pairs(t)
    return p.select("p_partkey", F.round(M.char_ngram_dice(F.col("pred"), F.col("true")), 9).alias("dice3"), F.round(M.edit_similarity(F.col("pred"), F.col("true")), 9).alias("edit_sim"))


@query(f"WITH {_PAIRS}, {_F1}, {_DICE} SELECT p_partkey, round(0.6 * CASE WHEN tp = 0 THEN 0.0 ELSE 2.0 * tp / (n_pred + n_true) END + 0.2 * dice + 0.1 * (pred = truth)::INT::DOUBLE + 0.1 * greatest(0.0, 1.0 - 0.02 * greatest(len(string_split_regex(pred, '[^A-Za-z0-9]+')) - 10, 0)), 9) AS reward FROM f JOIN d USING (p_partkey)")
def reward(t):
    return _pairs(t).select("p_partkey", F.round(M.reward(F.col("pred"), F.col("true")), 9).alias("reward"))


@query(f"WITH {_PAIRS}, {_F1} SELECT p_partkey, (pred = truth) AS em_raw, ({_sql_norm('pred')} = {_sql_norm('truth')}) AS em_norm, (2 * tp = n_pred + n_true) AS em_f1, list_contains(list_transform([pred, upper(truth), 'x'][1:2], lambda c: {_sql_norm('c')}), {_sql_norm('truth')}) AS em_top2 FROM f")
def em_variants(t):
    p = _pairs(t).withColumn("m", M.prf(F.col("pred"), F.col("true")))
    top = M.top_k_match(F.array("pred", F.upper("true"), F.lit("x")), F.col("true"), 2)
    return p.select("p_partkey", (F.col("pred") == F.col("true")).alias("em_raw"), M.exact_match(F.col("pred"), F.col("true")).alias("em_norm"), (2 * F.col("m.tp") == F.col("m.n_pred") + F.col("m.n_true")).alias("em_f1"), top.alias("em_top2"))


_CANON_OF = "array_to_string(list_filter(string_split('::' || regexp_replace(regexp_replace(regexp_replace({0}, '\\(.*\\)$', ''), '<[^<>]*>', ''), '<[^<>]*>', ''), '::')[-2:], lambda p: p <> ''), '_')"


@query(f"WITH p AS (SELECT p_partkey, replace(p_name, ' ', '_') AS a, CASE p_partkey % 5 WHEN 0 THEN replace(p_name, ' ', '_') WHEN 1 THEN replace(p_name, ' ', '_') || '(int)' WHEN 2 THEN upper(replace(p_name, ' ', '_')) WHEN 3 THEN split_part(p_name, ' ', 2) || '_' || split_part(p_name, ' ', 1) ELSE 'std::' || replace(p_name, ' ', '_') END AS b FROM part) SELECT p_partkey, {_sql_norm('b')} = {_sql_norm('a')} AS normalised, a = b AS raw, {_CANON_OF.format('b')} = {_CANON_OF.format('a')} AS canonical, list_sort({_sql_split('b')}) = list_sort({_sql_split('a')}) AS f1_one FROM p")
def exact_forms(t):
    """The four exact matches of a name with itself, a signature, capitals, its words turned round and a namespace."""
    a = F.replace("p_name", F.lit(" "), F.lit("_"))
    word = lambda i: F.split_part("p_name", F.lit(" "), F.lit(i))
    k = F.col("p_partkey") % 5
    b = F.when(k == 0, a).when(k == 1, F.concat(a, F.lit("(int)"))).when(k == 2, F.upper(a)).when(k == 3, F.concat(word(2), F.lit("_"), word(1))).otherwise(F.concat(F.lit("std::"), a))
    return t.part.select("p_partkey", a.alias("a"), b.alias("b")).select("p_partkey", M.exact_forms(F.col("b"), F.col("a")).alias("m")).select("p_partkey", "m.*")


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 3 THEN replace(p_name, ' ', '_') || CASE WHEN p_partkey % 8 = 3 THEN '' ELSE ' rest' END ELSE replace(p_name, ' ', '_') END AS answer FROM part")
def answer_phrases(t):
    """Names out of generated sentences: with an end mark, a full stop, nothing behind, and without the phrase."""
    a, k = F.replace("p_name", F.lit(" "), F.lit("_")), F.col("p_partkey") % 4
    said = F.concat(F.lit("  The predicted function name is "), a)
    text = F.when(k == 0, F.concat(said, F.lit("</s> and more."))).when(k == 1, F.concat(said, F.lit(".  \n"))).when(k == 2, said).otherwise(F.concat(a, F.when(F.col("p_partkey") % 8 == 3, "...").otherwise(" rest.\n")))
    return t.part.select("p_partkey", N.answer_phrase(text).alias("answer"))


@query(f"WITH {_PAIRS}, s AS (SELECT p_partkey, list_distinct({_sql_split('pred')}) AS a, list_distinct({_sql_split('truth')}) AS b FROM pairs), i AS (SELECT p_partkey, len(list_intersect(a, b)) AS i, len(a) AS n, len(b) AS m FROM s) SELECT p_partkey, round(i::DOUBLE / (n + m - i), 9) AS jaccard, round(i::DOUBLE / least(n, m), 9) AS overlap, round(2.0 * i / (n + m), 9) AS set_f1 FROM i")
def set_metrics(t):
    a, b = N.split_name(F.col("pred")), N.split_name(F.col("true"))
    return _pairs(t).select("p_partkey", F.round(M.jaccard(a, b), 9).alias("jaccard"), F.round(M.overlap_coefficient(a, b), 9).alias("overlap"), F.round(M.set_f1(a, b), 9).alias("set_f1"))


@query(f"WITH x AS (SELECT unnest(list_filter(list_transform(string_split(replace(regexp_replace({_NAME}, '([a-z])([A-Z])', '\\1_\\2', 'g'), '_', chr(1) || '_' || chr(1)), chr(1)), lambda t: lower(t)), lambda t: t <> '')) AS token FROM part), c AS (SELECT token, count(*) AS cnt FROM x GROUP BY token) SELECT token, cnt, row_number() OVER (ORDER BY cnt DESC, token) + 3 AS id, row_number() OVER (ORDER BY token) + 2 AS alpha_id FROM c")
def votes_vocab(t):
    tok = _names(t).select(F.explode(N.votes_subtokens(F.col("name"))).alias("token"))
    alpha = V.build(tok, "token", reserved=3, alphabetical=True).select("token", F.col("id").alias("alpha_id"))
    return V.build(tok, "token", reserved=4).join(alpha, "token").select("token", "cnt", F.col("id").cast("long").alias("id"), F.col("alpha_id").cast("long").alias("alpha_id"))


@query("WITH v AS (SELECT w AS token, row_number() OVER (ORDER BY count(*) DESC, w) + 9 AS id FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY w), top AS (SELECT * FROM v ORDER BY id LIMIT 4), t AS (SELECT p_partkey, i, string_split(p_name, ' ')[i] AS token FROM (SELECT *, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS i FROM part)), k AS (SELECT t.*, top.id FROM t LEFT JOIN top USING (token)), s AS (SELECT p_partkey, i, 0 AS j, id FROM k WHERE id IS NOT NULL UNION ALL SELECT p_partkey, i, unnest(range(1, length(token) + 1)), 3 FROM k WHERE id IS NULL) SELECT p_partkey, string_agg(id::VARCHAR, ',' ORDER BY i, j) AS ids FROM s GROUP BY p_partkey")
def vocab_encode(t):
    tok = F.split("p_name", " ")
    v = V.build(t.part.select(F.explode(tok).alias("w")), "w", cap=4, reserved=10)
    return V.encode(t.part, "p_partkey", tok, v, 3).select("p_partkey", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query("SELECT p_partkey, replace(p_name, ' ', '_') AS name, replace(p_name, ' ', '|_|') AS words, list_contains((SELECT list(w) FROM (SELECT w FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part UNION ALL SELECT '_' FROM part) GROUP BY w ORDER BY count(*) DESC, w LIMIT 8)), split_part(p_name, ' ', 1)) AS whole FROM part")
def vocab_decode(t):
    """Names to ids and back: eight frequent words have ids, others go by their characters, whose runs become words again."""
    words = F.split("p_name", " ")
    parts = t.part.select("p_partkey", F.split(F.replace("p_name", F.lit(" "), F.lit("\u0001_\u0001")), "\u0001").alias("ts"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("token"))
    chars = F.filter(F.split(F.replace("p_name", F.lit(" "), F.lit("")), ""), lambda c: c != "")
    frequent = V.build(t.part.select(F.explode(F.concat(words, F.array(F.lit("_")))).alias("w")), "w", cap=8, reserved=4)
    v = _cut(frequent.unionByName(V.build(t.part.select(F.explode(chars).alias("w")), "w", reserved=12)))
    ids = V.encode(parts, "p_partkey", F.col("ts"), v, 3)
    whole = parts.select("p_partkey", "token").join(v.select("token", F.lit(True).alias("whole")), "token", "left").select("p_partkey", F.coalesce("whole", F.lit(False)).alias("whole"))
    return V.decode(ids, "p_partkey", "ids", v, (0, 1, 2)).select("p_partkey", "name", F.array_join("words", "|").alias("words")).join(whole, "p_partkey")


@query(f"SELECT p_partkey, md5(array_to_string({_sql_split(_NAME)}, '|')) AS body, sha1(p_brand || ':' || p_partkey::VARCHAR || ':7') AS seed, sha256({_NAME}) AS fp FROM part")
def body_hashes(t):
    n = _names(t)
    return n.select("p_partkey", N.body_hash(N.split_name(F.col("name"))).alias("body"), F.sha1(F.concat_ws(":", "p_brand", F.col("p_partkey").cast("string"), F.lit("7")).cast("binary")).alias("seed"), F.sha2(F.col("name").cast("binary"), 256).alias("fp"))


@query("WITH d AS (SELECT doc_id, text, split_part(text, ' ', 2) AS name FROM documents) SELECT doc_id, md5(CASE WHEN name <> '' AND instr(text, name) > 0 THEN substr(text, 1, instr(text, name) - 1) || '<F>' || substr(text, instr(text, name) + length(name)) ELSE text END) AS first_sub, md5(CASE WHEN name <> '' THEN replace(text, name, '<F>') ELSE text END) AS all_sub FROM d")
def masking(t):
    d = t.documents.select("doc_id", "text", F.split_part("text", F.lit(" "), F.lit(2)).alias("name"))
    return d.select("doc_id", F.md5(N.mask_first(F.col("text"), F.col("name"), "<F>").cast("binary")).alias("first_sub"), F.md5(N.mask_all(F.col("text"), F.col("name"), "<F>").cast("binary")).alias("all_sub"))


_CANON = "regexp_replace(regexp_replace(regexp_replace(q, '\\(.*\\)$', ''), '<[^<>]*>', ''), '<[^<>]*>', '')"


@query(f"WITH n AS (SELECT p_partkey, p_brand || '::' || p_type || '<int>::' || replace(p_name, ' ', '_') || '(int, char)' AS q FROM part) SELECT p_partkey, array_to_string(list_filter(string_split('::' || {_CANON}, '::')[-2:], lambda p: p <> ''), '_') AS canon FROM n")
def canonical_names(t):
    q = F.concat("p_brand", F.lit("::"), "p_type", F.lit("<int>::"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("(int, char)"))
    return t.part.select("p_partkey", N.canonical_name(q).alias("canon"))


@query("SELECT n_nationkey, split_part(n_name, '_', 1) AS package, CASE WHEN n_regionkey < 4 THEN 'O' || n_regionkey ELSE 'default' END AS opt, n_name AS program FROM nation")
def binary_ids(t):
    b = t.nation.select("n_nationkey", F.when(F.col("n_regionkey") < 4, F.concat("n_name", F.lit("_O"), "n_regionkey")).otherwise(F.col("n_name")).alias("b"))
    return b.select("n_nationkey", N.package_of(F.col("b")).alias("package"), N.opt_of(F.col("b")).alias("opt"), N.program_of(F.col("b")).alias("program"))
