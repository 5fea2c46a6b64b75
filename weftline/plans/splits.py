"""Split design over documents, benchmark, orders and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import joins as J
from weftline.operators import split as P
from weftline.plans.base import registry

QUERIES, ORACLES, query = registry()


def _docs(t):
    words = F.size(F.split("text", " "))
    return t.documents.select("doc_id", "lang", "source", F.md5(F.col("text").cast("binary")).alias("body"), words.alias("words"), F.split_part("text", F.lit(" "), F.lit(1)).alias("name"), (F.col("doc_id") % 5 == 0).alias("test"))


_DOCS = "d AS (SELECT doc_id, lang, source, md5(text) AS body, len(string_split(text, ' ')) AS words, split_part(text, ' ', 1) AS name, doc_id % 5 = 0 AS test FROM documents)"


@query(f"WITH {_DOCS}, r AS (SELECT *, row_number() OVER (PARTITION BY body, lang ORDER BY doc_id) AS n FROM d) SELECT doc_id, body FROM r WHERE n = 1")
def body_dedup(t):
    return P.keep_first(_docs(t), ["body", "lang"], ["doc_id"]).select("doc_id", "body")


@query(f"WITH {_DOCS} SELECT lang, count(*) AS n, count(*) FILTER (name IN (SELECT name FROM d WHERE NOT test)) AS seen_name, count(*) FILTER (words >= 10 AND body IN (SELECT body FROM d WHERE NOT test AND words >= 10)) AS seen_body, count(*) FILTER (EXISTS (SELECT 1 FROM d x WHERE NOT x.test AND x.name = d.name AND x.body = d.body)) AS seen_both FROM d WHERE test GROUP BY lang")
def leakage(t):
    d = _docs(t)
    return P.leakage(d.where("not test"), d.where("test"), "lang", "name", "body", "words")


@query(f"WITH {_DOCS}, x AS (SELECT d.*, body IN (SELECT body FROM d WHERE NOT test) AS leaked, row_number() OVER (PARTITION BY test, body ORDER BY doc_id) AS n FROM d) SELECT test, CASE WHEN words < 5 THEN 'short' WHEN test AND leaked THEN 'body_in_train' WHEN NOT test AND n > 1 THEN 'duplicate' ELSE 'kept' END AS reason, count(*) AS n FROM x GROUP BY 1, 2")
def reject_reasons(t):
    from pyspark.sql import Window

    d = _docs(t)
    train = d.where("not test").select("body").distinct().withColumn("leaked", F.lit(True))
    d = d.join(train, "body", "left").withColumn("n", F.row_number().over(Window.partitionBy("test", "body").orderBy("doc_id")))
    rules = [("short", F.col("words") < 5), ("body_in_train", F.col("test") & F.col("leaked")), ("duplicate", ~F.col("test") & (F.col("n") > 1))]
    return d.groupBy("test", F.coalesce(P.first_reason(rules), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_totalprice < 1000 THEN 'cheap' END, CASE WHEN o_orderstatus = 'P' THEN 'pending' END, CASE WHEN o_orderpriority LIKE '5%' THEN 'low' END], lambda x: x IS NOT NULL), ';') AS reasons FROM orders")
def eligibility(t):
    rules = [("cheap", F.col("o_totalprice") < 1000), ("pending", F.col("o_orderstatus") == "P"), ("low", F.col("o_orderpriority").startswith("5"))]
    return t.orders.select("o_orderkey", F.array_join(P.all_reasons(rules), ";").alias("reasons"))


@query("WITH a AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS tier FROM documents WHERE doc_id % 17 <> 3 UNION ALL SELECT doc_id, 'val' FROM documents WHERE doc_id % 11 = 0 UNION ALL SELECT -1, 'train'), g AS (SELECT doc_id, count(DISTINCT tier) AS n FROM a GROUP BY doc_id) SELECT problem, count(*) AS n FROM (SELECT CASE WHEN d.doc_id IS NULL THEN 'phantom' WHEN g.n IS NULL THEN 'unassigned' WHEN g.n > 1 THEN 'overlap' END AS problem FROM documents d FULL JOIN g ON g.doc_id = d.doc_id) WHERE problem IS NOT NULL GROUP BY problem")
def split_guard(t):
    d = t.documents.select("doc_id")
    a = d.where("doc_id % 17 <> 3").withColumn("tier", F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train"))
    a = a.union(d.where("doc_id % 11 = 0").withColumn("tier", F.lit("val"))).union(t.spark.sql("select -1L, 'train'"))
    return P.violations(a, d, "doc_id", "tier").groupBy("problem").agg(F.count("*").alias("n"))


@query("WITH RECURSIVE s AS (SELECT DISTINCT source AS o, unnest(string_split(lower(text), ' ')) AS e FROM documents), n AS (SELECT o, count(*) AS n FROM s GROUP BY o HAVING count(*) >= 20), p AS (SELECT a.o AS a, b.o AS b, count(*) AS inter FROM s a JOIN s b ON a.e = b.e AND a.o < b.o GROUP BY 1, 2), e0 AS (SELECT a, b FROM p JOIN n x ON x.o = a JOIN n y ON y.o = b WHERE inter::DOUBLE / least(x.n, y.n) >= 0.35), e AS (SELECT a, b FROM e0 UNION ALL SELECT b, a FROM e0), r AS (SELECT a AS node, a AS c FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.node) SELECT node, min(c) AS component FROM r GROUP BY node")
def families(t):
    """Components of the sources that share words."""
    s = t.documents.select("source", F.split(F.lower("text"), " ").alias("e"))
    return P.components(J.overlap_pairs(s, "source", "e", 0.35, 20))


@query("WITH RECURSIVE s AS (SELECT DISTINCT vendor_id AS o, item_id AS e FROM sale_lines WHERE vendor_id IS NOT NULL AND item_id IS NOT NULL), n AS (SELECT o, count(*) AS n FROM s GROUP BY o HAVING count(*) >= 20), p AS (SELECT a.o AS a, b.o AS b, count(*) AS inter FROM s a JOIN s b ON a.e = b.e AND a.o < b.o GROUP BY 1, 2), e0 AS (SELECT a, b FROM p JOIN n x ON x.o = a JOIN n y ON y.o = b WHERE inter::DOUBLE / least(x.n, y.n) >= 0.7), e AS (SELECT a, b FROM e0 UNION ALL SELECT b, a FROM e0), r AS (SELECT a AS node, a AS c FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.node) SELECT node, min(c) AS component FROM r GROUP BY node")
def families_all(t):
    """Components of all vendors that sell the same items."""
    return P.components(J.overlap_pairs(t.sale_lines.select("vendor_id", F.col("item_id").alias("e")), "vendor_id", "e", 0.7, 20))


_BUILDS = """r AS (SELECT l_suppkey % 10 AS program, l_suppkey AS build, l_partkey % 20 AS tok, count(*) AS cnt FROM lineitem GROUP BY 1, 2, 3),
n AS (SELECT program, build, sum(cnt) AS n, row_number() OVER (PARTITION BY program ORDER BY build) AS i FROM r GROUP BY 1, 2),
i AS (SELECT b.program, b.build, a.build AS other, sum(least(a.cnt, b.cnt)) AS inter FROM r a JOIN r b ON a.program = b.program AND a.tok = b.tok AND a.build < b.build GROUP BY 1, 2, 3),
e AS (SELECT i.program, i.build, list(other) AS preds FROM i JOIN n ON n.program = i.program AND n.build = i.build WHERE inter / n.n::DOUBLE >= 0.85 GROUP BY 1, 2),
o AS (SELECT n.program, n.build, n.i, coalesce(preds, []) AS preds FROM n LEFT JOIN e ON e.program = n.program AND e.build = n.build),
g AS (SELECT program, build, i, true AS kept, [build] AS held FROM o WHERE i = 1
  UNION ALL SELECT o.program, o.build, o.i, NOT list_has_any(g.held, o.preds), CASE WHEN list_has_any(g.held, o.preds) THEN g.held ELSE list_append(g.held, o.build) END FROM g JOIN o ON o.program = g.program AND o.i = g.i + 1)"""


@query(f"WITH RECURSIVE {_BUILDS} SELECT program, build, kept FROM g")
def dup_builds(t):
    rows = t.lineitem.select((F.col("l_suppkey") % 10).alias("program"), F.col("l_suppkey").alias("build"), (F.col("l_partkey") % 20).alias("tok")).groupBy("program", "build", "tok").agg(F.count("*").alias("cnt"))
    return P.duplicate_builds(rows, 0.85)


_BASKETS = _BUILDS.replace("SELECT l_suppkey % 10 AS program, l_suppkey AS build, l_partkey % 20 AS tok, count(*) AS cnt FROM lineitem GROUP BY 1, 2, 3", "SELECT vendor_id AS program, sale_id AS build, item_id AS tok, count(*) AS cnt FROM sale_lines WHERE vendor_id IS NOT NULL AND sale_id IS NOT NULL AND item_id IS NOT NULL GROUP BY 1, 2, 3").replace("0.85", "0.95")


@query(f"WITH RECURSIVE {_BASKETS} SELECT program, build, kept FROM g")
def dup_baskets(t):
    """Sales of each vendor whose items lie in an earlier kept sale of the vendor."""
    s = t.sale_lines.where("vendor_id is not null and sale_id is not null and item_id is not null")
    return P.duplicate_builds(s.select(F.col("vendor_id").alias("program"), F.col("sale_id").alias("build"), F.col("item_id").alias("tok"), F.lit(1).alias("cnt")))


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR || ':5'), doc_id) AS n FROM documents) WHERE n <= 3")
def capped_sample(t):
    return P.capped_sample(t.documents.select("source", "doc_id"), "source", "doc_id", 3, 5)


@query("WITH b AS (SELECT source, count(DISTINCT lang) AS n FROM documents GROUP BY source) SELECT d.source, count(*) AS n FROM documents d JOIN b ON b.source = d.source AND b.n = 4 GROUP BY d.source")
def paired_slice(t):
    full = t.documents.groupBy("source").agg(F.count_distinct("lang").alias("k")).where("k = 4")
    return t.documents.join(full, "source", "left_semi").groupBy("source").agg(F.count("*").alias("n"))


_ROLES = {"xproject_FT": ["Brand#1", "Brand#2", "Brand#3"], "xproject_NCT": ["Brand#4"], "val_xproj": ["Brand#5", "Brand#6"]}


@query("WITH m AS (SELECT DISTINCT p_brand, substr(p_brand, 7)::INT % 8 AS fam FROM part), r AS (SELECT *, CASE WHEN p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') THEN 'xproject_FT' WHEN p_brand = 'Brand#4' THEN 'xproject_NCT' WHEN p_brand IN ('Brand#5', 'Brand#6') THEN 'val_xproj' ELSE 'train_pool' END AS role FROM m), f AS (SELECT fam, bool_or(role = 'xproject_FT') AS ft, bool_or(role = 'xproject_NCT') AS nct, bool_or(role = 'train_pool') AS pool, bool_or(role = 'val_xproj') AS val FROM r GROUP BY fam) SELECT p_brand, role, CASE WHEN ft AND pool AND role = 'xproject_FT' THEN 'xproject_NCT' ELSE role END AS new_role, CASE WHEN ft AND pool THEN 'far_with_pool' WHEN val AND (ft OR nct) THEN 'val_with_test' END AS warning FROM r JOIN f USING (fam)")
def role_repair(t):
    m = t.part.select("p_brand").distinct().withColumn("fam", F.substring("p_brand", 7, 9).cast("int") % 8)
    m = m.withColumn("role", P.role_of(F.col("p_brand"), _ROLES, "train_pool"))
    return P.repaired_roles(m, "fam", "role", "xproject_FT", "xproject_NCT", "train_pool", "val_xproj").select("p_brand", "role", "new_role", "warning")


@query("WITH g AS (SELECT *, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT doc_id FROM g WHERE n >= CASE WHEN source LIKE '%1%' THEN 5 ELSE 45 END")
def size_filter(t):
    return P.size_filter(t.documents.select("doc_id", "source"), "source", 45, F.col("source").contains("1"), 5).select("doc_id")


_POLICY = "a AS (SELECT doc_id, md5(text) AS body, lang AS name, doc_id % 13 = 0 AS dyn, CASE doc_id % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS tier FROM documents), j AS (SELECT *, CASE WHEN tier = 'train' AND row_number() OVER (PARTITION BY tier, body, name ORDER BY doc_id) > 1 THEN 'duplicate' WHEN tier <> 'train' AND body IN (SELECT body FROM a WHERE tier = 'train') THEN 'body_in_train' WHEN tier <> 'train' AND dyn THEN 'in_dynsym' ELSE 'kept' END AS outcome FROM a)"


def _judged(t):
    tier = F.when(F.col("doc_id") % 5 == 0, "test").when(F.col("doc_id") % 5 == 1, "val").otherwise("train")
    a = t.documents.select("doc_id", F.md5(F.col("text").cast("binary")).alias("body"), F.col("lang").alias("name"), tier.alias("tier"))
    return P.policy(a, "tier", "body", "name", F.col("doc_id") % 13 == 0, ["doc_id"])


@query(f"WITH {_POLICY} SELECT tier, count(*) AS raw, count(*) FILTER (outcome = 'body_in_train') AS body, count(*) FILTER (outcome = 'in_dynsym') AS dynsym, count(*) FILTER (outcome = 'duplicate') AS duplicate, count(*) FILTER (outcome = 'kept') AS scored FROM j GROUP BY tier")
def policy_accounting(t):
    return P.policy_counts(_judged(t), "tier")


@query(f"WITH {_POLICY} SELECT doc_id, tier, outcome FROM j WHERE outcome <> 'kept'")
def policy_dropped(t):
    return _judged(t).where("outcome <> 'kept'").select("doc_id", "tier", "outcome")


_FNS = "f AS (SELECT doc_id, source, split_part(text, ' ', 1) AS name, md5(text) AS body, len(string_split(text, ' ')) AS words, doc_id % 13 = 0 AS dyn, [lang || '_' || split_part(text, ' ', 2)] AS al FROM documents), tr AS (SELECT * FROM f WHERE doc_id % 5 <> 0), te AS (SELECT * FROM f WHERE doc_id % 5 = 0), nm AS (SELECT name AS a FROM tr UNION SELECT unnest(al) FROM tr)"


@query(f"WITH {_FNS} SELECT source, count(*) AS n, round(100.0 * count(*) FILTER (name IN (SELECT a FROM nm) OR al[1] IN (SELECT a FROM nm)) / count(*), 1) AS name_pct, round(100.0 * count(*) FILTER (words >= 10 AND body IN (SELECT body FROM tr WHERE words >= 10)) / greatest(count(*) FILTER (words >= 10), 1), 1) AS body_pct, round(100.0 * count(*) FILTER ((name, body) IN (SELECT (name, body) FROM tr)) / count(*), 1) AS name_and_body_pct, round(100.0 * count(*) FILTER (dyn) / count(*), 1) AS exported_pct FROM te GROUP BY source")
def leakage_pct(t):
    """Names (with an alias each), bodies and both that training documents hold, and exported rows, per cent of each source's test documents."""
    word = lambda i: F.split_part("text", F.lit(" "), F.lit(i))
    f = t.documents.select("doc_id", "source", word(1).alias("name"), F.md5(F.col("text").cast("binary")).alias("body"), F.size(F.split("text", " ")).alias("words"), (F.col("doc_id") % 13 == 0).alias("dyn"), F.array(F.concat("lang", F.lit("_"), word(2))).alias("al"))
    return P.leakage_table(f.where("doc_id % 5 <> 0"), f.where("doc_id % 5 = 0"), "source", "name", "body", "words", "dyn", "al")


_OPTS = """f AS (SELECT l_suppkey AS program, l_linenumber % 4 AS opt, l_partkey % 300 AS name, l_returnflag || l_linestatus AS body, l_quantity AS words, row_number() OVER (PARTITION BY l_suppkey, l_linenumber % 4, l_partkey % 300 ORDER BY l_orderkey * 10 + l_linenumber) AS i FROM lineitem),
o AS (SELECT * FROM f WHERE i = 1), b AS (SELECT DISTINCT program, opt FROM f),
m AS (SELECT x.program, x.opt AS opt1, y.opt AS opt2, count(*) AS n_shared, count(*) FILTER (x.body = y.body) AS same, count(*) FILTER (greatest(x.words, y.words) >= 10) AS n_big, count(*) FILTER (x.body = y.body AND greatest(x.words, y.words) >= 10) AS same_big FROM o x JOIN o y ON x.program = y.program AND x.name = y.name AND x.opt < y.opt GROUP BY 1, 2, 3),
p AS (SELECT x.program, x.opt AS opt1, y.opt AS opt2, coalesce(n_shared, 0) AS n_shared, coalesce(same, 0) AS same, coalesce(n_big, 0) AS n_big, coalesce(same_big, 0) AS same_big FROM b x JOIN b y ON x.program = y.program AND x.opt < y.opt LEFT JOIN m ON m.program = x.program AND m.opt1 = x.opt AND m.opt2 = y.opt)"""


def _opt_pairs(t):
    f = t.lineitem.select(F.col("l_suppkey").alias("program"), (F.col("l_linenumber") % 4).alias("opt"), (F.col("l_partkey") % 300).alias("name"), F.concat("l_returnflag", "l_linestatus").alias("body"), F.col("l_quantity").alias("words"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    return P.build_identity(f, "program", "opt", "name", "body", "words", "at")


@query(f"WITH {_OPTS} SELECT * FROM p")
def opt_pairs(t):
    return _opt_pairs(t)


@query(f"WITH {_OPTS}, s AS (SELECT opt1, opt2, same::DOUBLE / n_shared AS r FROM p WHERE n_shared > 0) SELECT opt1, opt2, count(*) AS n, round(quantile_cont(r, 0.5), 9) AS median, round(max(r), 9) AS high, count(*) FILTER (r >= 0.5) AS half FROM s GROUP BY 1, 2")
def opt_levels(t):
    return P.identity_by_levels(_opt_pairs(t)).select("opt1", "opt2", "n", F.round("median", 9).alias("median"), F.round("high", 9).alias("high"), "half")
