"""Prediction assembly: fallback joins, common keys, picks, categories and tallies."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import names as N
from weftline.operators import joins as J
from weftline.operators import predictions as P
from weftline.plans.base import registry
from weftline.plans.retrieval import _S, _knn

QUERIES, ORACLES, query = registry()


@query("WITH x AS (SELECT o_orderkey + unnest([0, 4, -4]) AS k, unnest([0, 1, 2]) AS p, o_orderkey, o_custkey FROM orders WHERE o_orderkey % 3 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY o_orderkey, p) AS n FROM x) SELECT k, o_custkey FROM r WHERE n = 1")
def first_writer(t):
    rows = t.orders.where("o_orderkey % 3 = 0").select(F.lit(0).alias("g"), F.col("o_orderkey").alias("k"), F.col("o_orderkey").alias("at"), "o_custkey")
    return P.first_writer(rows, ["g"], "k", [0, 4, -4], ["at"]).select("k", "o_custkey")


@query("WITH l AS (SELECT o_orderkey, o_custkey % 50 AS g, o_orderpriority AS nm FROM orders WHERE o_orderkey % 2 = 0), r AS (SELECT o_custkey % 50 AS g, o_orderkey AS k, o_orderpriority AS nm, o_custkey AS v FROM orders WHERE o_orderkey % 2 = 1), h AS (SELECT l.o_orderkey, r.v, row_number() OVER (PARTITION BY l.o_orderkey ORDER BY o.p, r.v) AS n FROM l, (SELECT unnest([0, 1, 2]) AS p, unnest([0, -5, 5]) AS d) o JOIN r ON r.g = l.g AND r.k = l.o_orderkey + o.d), b AS (SELECT g, nm, min(v) AS v FROM r GROUP BY 1, 2) SELECT l.o_orderkey, coalesce(h.v, b.v) AS v, CASE WHEN h.v IS NOT NULL THEN 'address' WHEN b.v IS NOT NULL THEN 'name' END AS how FROM l LEFT JOIN h ON h.o_orderkey = l.o_orderkey AND h.n = 1 LEFT JOIN b ON b.g = l.g AND b.nm = l.nm")
def name_fallback(t):
    o = t.orders.select("o_orderkey", (F.col("o_custkey") % 50).alias("g"), F.col("o_orderpriority").alias("nm"), F.col("o_custkey").alias("v"))
    left = o.where("o_orderkey % 2 = 0").drop("v")
    right = o.where("o_orderkey % 2 = 1")
    return J.with_name_fallback(left, right, ["g"], "o_orderkey", [0, -5, 5], ["g", "nm"], "v").select("o_orderkey", "v", "how")


@query("WITH f AS (SELECT p_partkey, p_size AS g, p_partkey % 97 AS a, p_name AS nm FROM part WHERE p_partkey % 2 = 0), c AS (SELECT p_size AS g, p_partkey % 89 AS a, p_name AS nm, p_partkey AS graph FROM part WHERE p_partkey % 2 = 1), x AS (SELECT g, a, min(graph) AS v FROM c GROUP BY 1, 2), n AS (SELECT g, nm, min(graph) AS v FROM c GROUP BY 1, 2) SELECT f.p_partkey, coalesce(e.v, q.v, n.v) AS graph, CASE WHEN e.v IS NOT NULL THEN 'address' WHEN q.v IS NOT NULL THEN 'plus4' WHEN n.v IS NOT NULL THEN 'name' END AS how FROM f LEFT JOIN x e ON e.g = f.g AND e.a = f.a LEFT JOIN x q ON q.g = f.g AND q.a = f.a + 4 LEFT JOIN n ON n.g = f.g AND n.nm = f.nm")
def three_way_match(t):
    p = t.part.select("p_partkey", F.col("p_size").alias("g"), F.col("p_name").alias("nm"))
    left = p.where("p_partkey % 2 = 0").withColumn("a", F.col("p_partkey") % 97)
    graphs = p.where("p_partkey % 2 = 1").select("g", "nm", (F.col("p_partkey") % 89).alias("a"), F.col("p_partkey").alias("graph"))
    return J.three_way(left, graphs, "g", "a", "nm", "graph").select("p_partkey", "graph", "how")


@query("WITH l AS (SELECT p_partkey, p_brand, p_name, p_size FROM part WHERE p_partkey % 3 = 0), r AS (SELECT * FROM part WHERE p_partkey % 3 = 1), s AS (SELECT p_brand, p_name, p_size, min(p_partkey) AS v FROM r GROUP BY ALL), w AS (SELECT p_brand, p_name, min(p_partkey) AS v FROM r GROUP BY ALL) SELECT l.p_partkey, coalesce(s.v, w.v) AS v, CASE WHEN s.v IS NOT NULL THEN 'key' WHEN w.v IS NOT NULL THEN 'weaker' END AS how FROM l LEFT JOIN s USING (p_brand, p_name, p_size) LEFT JOIN w USING (p_brand, p_name)")
def weaker_key(t):
    p = t.part.select("p_partkey", "p_brand", "p_name", "p_size")
    right = p.where("p_partkey % 3 = 1").withColumn("v", F.col("p_partkey"))
    return P.join_or_weaker(p.where("p_partkey % 3 = 0"), right, ["p_brand", "p_name", "p_size"], ["p_brand", "p_name"], ["p_partkey"], "v").select("p_partkey", "v", "how")


@query("SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, 0) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def default_join(t):
    return P.with_default(t.documents.select("doc_id"), t.labels.select("doc_id", "quality", "toxic"), ["doc_id"], {"quality": -1, "toxic": 0})


@query("SELECT user_id, min(event_id) FILTER (event_type = 'view') AS view, min(event_id) FILTER (event_type = 'click') AS click, min(event_id) FILTER (event_type = 'purchase') AS purchase FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY user_id HAVING count(DISTINCT event_type) = 3")
def common_keys(t):
    arms = {a: t.events.where(F.col("event_type") == a).select("user_id", "event_id") for a in ("view", "click", "purchase")}
    return P.common(arms, ["user_id"], "event_id")


@query("WITH e AS (SELECT label, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c FROM embeddings), p AS (SELECT label, CASE WHEN a >= b AND a >= c THEN 'a' WHEN b >= c THEN 'b' ELSE 'c' END AS arm FROM e) SELECT label, arm, count(*) AS n FROM p GROUP BY 1, 2")
def confidence_pick(t):
    arms = [(F.col("embedding")[i].cast("double"), F.lit(a)) for i, a in enumerate("abc")]
    return t.embeddings.groupBy("label", P.max_confidence(arms).alias("arm")).agg(F.count("*").alias("n"))


_NAMES = "p AS (SELECT p_partkey, p_brand, p_size, p_name || '_' || p_size AS nm, p_partkey % 2 = 0 AS train FROM part), w AS (SELECT p_partkey, unnest(string_split_regex(lower(replace(nm, ' ', '')), '[_.\\-]+')) AS t FROM p)"


def _parts(t):
    return t.part.select("p_partkey", "p_brand", "p_size", F.concat_ws("_", "p_name", "p_size").alias("nm"))


@query(f"WITH {_NAMES}, k AS (SELECT DISTINCT t FROM w JOIN p USING (p_partkey) WHERE train), s AS (SELECT DISTINCT nm FROM p WHERE train), o AS (SELECT DISTINCT p_partkey FROM w WHERE t NOT IN (SELECT t FROM k)) SELECT CASE WHEN nm IN (SELECT nm FROM s) THEN 'seen' WHEN p_partkey IN (SELECT p_partkey FROM o) THEN 'novel_oov' ELSE 'novel_known' END AS category, count(*) AS n, sum(p_partkey)::BIGINT AS keys FROM p WHERE NOT train GROUP BY 1")
def name_categories(t):
    p = _parts(t)
    c = P.name_category(p.where("p_partkey % 2 = 1"), p.where("p_partkey % 2 = 0"), "nm")
    return c.groupBy("category").agg(F.count("*").alias("n"), F.sum("p_partkey").alias("keys"))


@query(f"WITH {_NAMES}, s AS (SELECT DISTINCT nm FROM p WHERE train), x AS (SELECT a.p_partkey, lower(replace(a.nm, ' ', '')) AS t, lower(replace(b.nm, ' ', '')) AS q, a.nm AS tn, b.nm AS qn, a.p_size FROM p a JOIN p b ON b.p_partkey = a.p_partkey + 1), y AS (SELECT *, tn IN (SELECT nm FROM s) AS tk, qn IN (SELECT nm FROM s) AS qk, CASE WHEN t = q THEN 1.0 ELSE 1.0 - levenshtein(t, q)::DOUBLE / greatest(length(t), length(q)) END AS e FROM x) SELECT CASE WHEN tn = qn THEN 'correct' WHEN NOT tk THEN 'wrong_unseen_target' WHEN e > 0.7 THEN 'close' WHEN NOT qk THEN 'phantom' ELSE 'wrong_seen' END AS kind, CASE WHEN p_size % 3 > 0 THEN 'easy' WHEN tk THEN 'hard_seen' ELSE 'hard_unseen' END AS stratum, count(*) AS n FROM y GROUP BY 1, 2")
def error_kinds(t):
    p = _parts(t)
    known = p.where("p_partkey % 2 = 0").select("nm").distinct()
    x = p.join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("nm").alias("pred")), "p_partkey")
    x = x.join(known.withColumn("tk", F.lit(True)), "nm", "left").join(known.select(F.col("nm").alias("pred"), F.lit(True).alias("qk")), "pred", "left").na.fill(False)
    kind = P.error_kind(F.col("pred"), F.col("nm"), F.col("qk"), F.col("tk"))
    return x.groupBy(kind.alias("kind"), P.difficulty(F.col("p_size") % 3, F.col("tk")).alias("stratum")).agg(F.count("*").alias("n"))


@query("WITH g AS (SELECT source, avg(quality) AS a, avg(toxic) AS b FROM documents JOIN labels USING (doc_id) GROUP BY source) SELECT count(*) FILTER (a > b + 0.005) AS a_wins, count(*) FILTER (b > a + 0.005) AS b_wins, count(*) FILTER (abs(a - b) <= 0.005) AS ties FROM g")
def group_wins(t):
    return P.wins(t.documents.select("doc_id", "source").join(t.labels, "doc_id"), "source", "quality", "toxic")


@query("SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, lang DESC, doc_id) AS n FROM documents) WHERE n = 1")
def best_by_group(t):
    return P.best_by_group(t.documents.select("source", "doc_id", "n_chars", "lang"), "source", ["n_chars", "lang"], "doc_id").select("source", "doc_id", "n_chars")


@query("(SELECT o_orderkey, o_totalprice, 'worst' AS \"end\" FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 15) UNION ALL (SELECT o_orderkey, o_totalprice, 'best' FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15)")
def extremes(t):
    return P.extremes(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 15)


@query("WITH g AS (SELECT p_name, count(*) AS c, count(DISTINCT p_brand) AS h FROM part GROUP BY p_name) SELECT count(*) AS names, count(*) FILTER (h > 1) AS shared, coalesce(sum(c) FILTER (h > 1), 0)::BIGINT AS rows_shared, round(coalesce(sum(c) FILTER (h > 1), 0)::DOUBLE / greatest(sum(c), 1), 9) AS share FROM g")
def shared_names(t):
    return P.shared_names(t.part, "p_name", "p_brand").withColumn("share", F.round("share", 9))


@query("WITH g AS (SELECT p_brand, avg((p_size > 25)::INT) AS share, count(*) AS n, avg(p_retailprice) AS v FROM part GROUP BY p_brand), c AS (SELECT *, unnest([0.4, 0.5, 0.6])::DOUBLE AS cut FROM g) SELECT cut, CASE WHEN p_brand = 'Brand#1' OR share >= cut THEN 'near' ELSE 'far' END AS side, count(*) AS groups, round(sum(v * n) / sum(n), 6) AS row_mean, round(avg(v), 6) AS group_mean FROM c GROUP BY 1, 2")
def cut_sensitivity(t):
    g = t.part.groupBy("p_brand").agg(F.avg((F.col("p_size") > 25).cast("int")).alias("share"), F.count("*").alias("n"), F.avg("p_retailprice").alias("v"))
    r = P.relabelled_means(g, "share", F.col("p_brand") == "Brand#1", [0.4, 0.5, 0.6], "n", "v")
    return r.select("cut", "side", "groups", F.round("row_mean", 6).alias("row_mean"), F.round("group_mean", 6).alias("group_mean"))


@query("WITH g AS (SELECT CASE WHEN p_size % 7 = 0 THEN '0 ext' WHEN p_size % 7 <= 3 THEN '1-3 ext' ELSE '4+ ext' END AS bucket, (p_partkey % 100) / 100.0::DOUBLE AS v FROM part) SELECT bucket, round(avg(v), 9) AS mean, round(stddev_pop(v), 9) AS std, count(*) AS n, CASE WHEN avg(v) > 0.55 THEN 'trust code' WHEN avg(v) > 0.45 THEN 'balanced' ELSE 'trust ext' END AS reading FROM g GROUP BY bucket")
def gate_profile(t):
    rows = t.part.select((F.col("p_size") % 7).alias("k"), (F.col("p_partkey") % 100 / 100.0).alias("v"))
    return P.bucket_profile(rows, N.call_bucket(F.col("k")), "v").select("bucket", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"), "n", "reading")


@query("WITH f AS (SELECT p_size % 4 AS k, len(string_split(p_name, ' ')) + p_size % 6 - 1 AS n FROM part WHERE p_partkey % 3 <> 0), g AS (SELECT unnest(list_filter([CASE WHEN k = 0 THEN 'no_ext_calls' END, CASE WHEN n <= 1 THEN 'short_name' WHEN n > 5 THEN 'long_name' ELSE 'other' END], lambda x: x IS NOT NULL)) AS tag FROM f) SELECT tag, count(*) AS n FROM g GROUP BY tag")
def failure_patterns(t):
    n = F.size(F.split("p_name", " ")) + F.col("p_size") % 6 - 1
    f = t.part.where("p_partkey % 3 <> 0").select(F.explode(P.failure_tags(F.col("p_size") % 4, n)).alias("tag"))
    return f.groupBy("tag").agg(F.count("*").alias("n"))


_CHUNKS = "c AS (SELECT l_orderkey AS k, l_linenumber % 4 AS chunk, min(l_partkey) AS v FROM lineitem GROUP BY 1, 2)"


def _chunks(t):
    return t.lineitem.groupBy(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") % 4).alias("chunk")).agg(F.min("l_partkey").alias("v"))


@query(f"WITH {_CHUNKS} SELECT k, max(chunk) AS chunk, arg_max(v, chunk) AS v FROM c GROUP BY k")
def chunk_merge(t):
    return P.last_of_chunks(_chunks(t), ["k"], "chunk")[0]


@query(f"WITH {_CHUNKS}, n AS (SELECT chunk, row_number() OVER (PARTITION BY k ORDER BY chunk) AS i FROM c) SELECT chunk, count(*) AS n, count(*) FILTER (i > 1) AS dup FROM n GROUP BY chunk")
def chunk_counts(t):
    return P.last_of_chunks(_chunks(t), ["k"], "chunk")[1]


@query(f"WITH {_S}, c AS (SELECT q_id, t_label, sim, t_id, [q_id % 3, 10 + q_id % 5] AS a, [t_id % 3, 10 + t_id % 5] AS b, q_id % 9 AS x, t_id % 9 AS y, count(*) OVER (PARTITION BY q_id, t_label) AS f FROM k WHERE rank <= 5), z AS (SELECT *, sim + 0.05 * (f - 1) + 0.1 * len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) + CASE WHEN x > 0 AND y > 0 THEN 0.05 * least(x, y) / greatest(x, y) ELSE 0 END AS score FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(score, 9) DESC, t_id) AS n FROM z) SELECT q_id, t_label AS name, round(score, 6) AS score FROM r WHERE n = 1")
def rerank(t):
    calls = lambda c: F.array(F.col(c) % 3, F.col(c) % 5 + 10)
    c = _knn(t, 5).select("q_id", F.col("t_label").alias("name"), "sim", "t_id", calls("q_id").alias("q_calls"), calls("t_id").alias("calls"), (F.col("q_id") % 9).alias("q_blocks"), (F.col("t_id") % 9).alias("blocks"))
    return P.rerank(c, "q_id", "t_id").select("q_id", "name", F.round("score", 6).alias("score"))


@query(f"WITH {_S}, g AS (SELECT k.*, a.w, round(sim + a.w * (t_id % 7) / 10.0, 9) AS s FROM k, (SELECT unnest([0.0, 0.05, 0.1, 0.2, 0.4])::DOUBLE AS w) a WHERE rank <= 5), r AS (SELECT *, row_number() OVER (PARTITION BY w, q_id ORDER BY s DESC, t_id) AS n FROM g) SELECT w, count(*) AS n, count(*) FILTER (label = t_label) AS hits FROM r WHERE n = 1 GROUP BY w")
def rerank_grid(t):
    own = t.embeddings.select(F.col("vec_id").alias("q_id"), "label")
    g = P.grid(_knn(t, 5), {"w": [0.0, 0.05, 0.1, 0.2, 0.4]})
    s = F.round(F.col("sim") + F.col("w") * (F.col("t_id") % 7) / 10.0, 9)
    best = g.groupBy("w", "q_id").agg(F.min_by("t_label", F.struct(-s, "t_id")).alias("t_label")).join(own, "q_id")
    return best.groupBy("w").agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("t_label")).alias("hits"))


@query(f"WITH {_S}, g AS (SELECT k.*, a.tau FROM k, (SELECT unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95])::DOUBLE AS tau) a WHERE rank = 1) SELECT tau, count(*) FILTER (round(sim, 9) >= tau) AS retrieved, count(*) FILTER (label = CASE WHEN round(sim, 9) >= tau THEN t_label ELSE q_id % 10 END) AS hits FROM g GROUP BY tau")
def similarity_sweep(t):
    own = t.embeddings.select(F.col("vec_id").alias("q_id"), "label")
    g = P.grid(_knn(t, 1).join(own, "q_id"), {"tau": [0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]})
    over = F.round("sim", 9) >= F.col("tau")
    return g.groupBy("tau").agg(F.count_if(over).alias("retrieved"), F.count_if(F.col("label") == F.when(over, F.col("t_label")).otherwise(F.col("q_id") % 10)).alias("hits"))


@query("WITH p AS (SELECT p_partkey, string_split(p_name, ' ') || [p_type] AS ws FROM part), n AS (SELECT p_partkey, list_sort(list_filter(list_transform(ws, lambda w: lower(w)), lambda w: w <> '')) AS a FROM p), x AS (SELECT DISTINCT a FROM n WHERE p_partkey % 2 = 1), y AS (SELECT DISTINCT a AS b FROM n WHERE p_partkey % 2 = 0), f AS (SELECT a, max(2.0 * list_sum(list_transform(list_distinct(a), lambda t: least(len(list_filter(a, lambda u: u = t)), len(list_filter(b, lambda u: u = t))))) / (len(a) + len(b))) AS best FROM x, y GROUP BY a) SELECT p_partkey, round(best, 9) AS best FROM n JOIN f USING (a) WHERE p_partkey % 2 = 1")
def vocabulary_oracle(t):
    p = t.part.select("p_partkey", F.concat_ws("_", F.replace("p_name", F.lit(" "), F.lit("_")), "p_type").alias("nm"))
    return P.vocabulary_oracle(p.where("p_partkey % 2 = 1"), p.where("p_partkey % 2 = 0"), "p_partkey", "nm").select("p_partkey", F.round("best", 9).alias("best"))


_CENSUS = "t AS (SELECT g, nm, list_distinct(list_filter(string_split(lower(nm), '_'), lambda w: w <> '')) AS ws, count(*) AS c FROM p GROUP BY ALL), b AS (SELECT x.g, x.nm, x.c, max(CASE WHEN x.nm = y.nm THEN 1.0 WHEN len(list_intersect(x.ws, y.ws)) = 0 THEN 0.0 ELSE len(list_intersect(x.ws, y.ws))::DOUBLE / len(list_distinct(list_concat(x.ws, y.ws))) END) AS j FROM t x LEFT JOIN t y ON y.g <> x.g GROUP BY ALL)"


def _census(p):
    j = p.join(P.best_in_other_group(p, p, "nm", "g"), ["nm", "g"])
    b = F.when(F.col("best") >= 1, "exact").when(F.col("best") >= 0.5, "j>=0.5").when(F.col("best") > 0, "j>0").otherwise("none")
    return j.withColumn("bucket", b)


@query(f"WITH p AS (SELECT p_brand AS g, p_type || '_' || replace(p_name, ' ', '_') AS nm, p_partkey FROM part), {_CENSUS} SELECT CASE WHEN j >= 1 THEN 'exact' WHEN j >= 0.5 THEN 'j>=0.5' WHEN j > 0 THEN 'j>0' ELSE 'none' END AS bucket, sum(c)::BIGINT AS n FROM b GROUP BY 1")
def similarity_census(t):
    p = t.part.select(F.col("p_brand").alias("g"), F.concat_ws("_", "p_type", F.replace("p_name", F.lit(" "), F.lit("_"))).alias("nm"))
    return _census(p).groupBy("bucket").agg(F.count("*").alias("n"))


@query(f"WITH p AS (SELECT split_part(url, '/', 3) AS g, array_to_string(regexp_extract_all(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '[a-z]+'), '_') AS nm, page_id FROM pages), {_CENSUS} SELECT page_id, CASE WHEN j >= 1 THEN 'exact' WHEN j >= 0.5 THEN 'j>=0.5' WHEN j > 0 THEN 'j>0' ELSE 'none' END AS bucket, round(coalesce(j, 0), 9) AS best FROM b JOIN p USING (g, nm)")
def title_census(t):
    """The title of every page against the titles of all other hosts; all four buckets occur."""
    title = F.lower(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    p = t.pages.select("page_id", F.split_part("url", F.lit("/"), F.lit(3)).alias("g"), F.array_join(F.regexp_extract_all(title, F.lit("[a-z]+"), F.lit(0)), "_").alias("nm"))
    return _census(p).select("page_id", "bucket", F.round("best", 9).alias("best"))


@query("WITH n AS (SELECT DISTINCT replace(p_name, ' ', '_') AS a, list_distinct(string_split(lower(p_name), ' ')) AS ws FROM part) SELECT x.a, y.a AS b, round(2.0 * len(list_intersect(x.ws, y.ws)) / (len(x.ws) + len(y.ws)), 9) AS f1 FROM n x JOIN n y ON x.a < y.a WHERE len(list_intersect(x.ws, y.ws)) > 0")
def f1_matrix(t):
    n = t.part.select(F.replace("p_name", F.lit(" "), F.lit("_")).alias("nm")).distinct()
    return P.f1_pairs(n, "nm").select("a", "b", F.round("f1", 9).alias("f1"))


@query("WITH s AS (SELECT p_size, list(DISTINCT replace(p_name, ' ', CASE WHEN p_partkey % 2 = 0 THEN '_' ELSE '' END)) AS ss FROM part GROUP BY p_size), x AS (SELECT p_size, unnest(ss) AS s FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY (len(string_split(s, '_')) >= 2) DESC, length(s) DESC, s DESC) AS n FROM x) SELECT p_size, s AS pick FROM r WHERE n = 1")
def own_identifier(t):
    s = F.when(F.col("p_partkey") % 2 == 0, F.replace("p_name", F.lit(" "), F.lit("_"))).otherwise(F.replace("p_name", F.lit(" "), F.lit("")))
    return t.part.groupBy("p_size").agg(F.collect_set(s).alias("ss")).select("p_size", P.own_identifier(F.col("ss")).alias("pick"))
