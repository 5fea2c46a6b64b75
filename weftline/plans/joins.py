"""Joins beyond equality over lineitem, orders, events and pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.operators import ir as I
from weftline.operators import joins as J
from weftline.plans.base import registry

QUERIES, ORACLES, query = registry()


@query("WITH l AS (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem WHERE l_linenumber = 1), r AS (SELECT l_suppkey, l_orderkey AS k, min(l_partkey) AS part FROM lineitem WHERE l_linenumber <> 1 GROUP BY 1, 2), o AS (SELECT unnest([0, 1, 2]) AS prio, unnest([0, -4, 4]) AS off_), h AS (SELECT l.l_suppkey, l.l_orderkey, prio, part, row_number() OVER (PARTITION BY l.l_suppkey, l.l_orderkey ORDER BY prio) AS n FROM l, o JOIN r ON r.l_suppkey = l.l_suppkey AND r.k = l.l_orderkey + off_) SELECT l.l_suppkey, l.l_orderkey, h.prio, h.part FROM l LEFT JOIN h ON h.l_suppkey = l.l_suppkey AND h.l_orderkey = l.l_orderkey AND h.n = 1")
def tolerance_join(t):
    left = t.lineitem.where("l_linenumber = 1").select("l_suppkey", "l_orderkey").distinct()
    right = t.lineitem.where("l_linenumber <> 1").groupBy("l_suppkey", "l_orderkey").agg(F.min("l_partkey").alias("part"))
    return J.tolerance_join(left, right, ["l_suppkey"], "l_orderkey", [0, -4, 4])


@query("WITH a AS (SELECT o_orderkey AS k, o_custkey FROM orders WHERE o_orderkey % 3 = 0), b AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderkey % 5 < 3) SELECT a.k, CASE WHEN x.s IS NOT NULL THEN 'exact' WHEN y.s IS NOT NULL THEN 'plus4' END AS kind, coalesce(x.s, y.s) AS status FROM a LEFT JOIN b x ON x.k = a.k LEFT JOIN b y ON y.k + 4 = a.k")
def plus4_match(t):
    a = t.orders.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("k"), F.lit(0).alias("g"))
    b = t.orders.where("o_orderkey % 5 < 3").select(F.col("o_orderkey").alias("k"), F.lit(0).alias("g"), F.col("o_orderstatus").alias("status"))
    m = J.tolerance_join(a, b, ["g"], "k", [0, -4])
    return m.select("k", F.when(F.col("prio") == 0, "exact").when(F.col("prio") == 1, "plus4").alias("kind"), "status")


@query("WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS k FROM events WHERE event_type = 'purchase'), c AS (SELECT event_id AS rid, user_id, epoch_us(ts) AS k FROM events WHERE event_type = 'click'), h AS (SELECT e.event_id, c.rid, abs(e.k - c.k) AS delta, row_number() OVER (PARTITION BY e.event_id ORDER BY abs(e.k - c.k), c.k, c.rid) AS n FROM e JOIN c USING (user_id)) SELECT e.event_id, h.rid AS near, h.delta FROM e LEFT JOIN h ON h.event_id = e.event_id AND h.n = 1")
def nearest_join(t):
    e = t.events.select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("k"))
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "k")
    right = e.where("event_type = 'click'").select(F.col("event_id").alias("rid"), "user_id", F.col("k").alias("rk"))
    return J.nearest(left, right, "user_id", "k", "rk", "rid").select("event_id", "near", "delta")


@query("WITH r AS (SELECT r_regionkey, r_regionkey * 1000 AS lo, r_regionkey * 1000 + 700 AS hi FROM region) SELECT r_regionkey, count(*) AS n, min(l_orderkey) AS first, max(l_orderkey) AS last FROM lineitem JOIN r ON l_orderkey >= lo AND l_orderkey < hi GROUP BY r_regionkey")
def interval_join(t):
    r = t.region.select("r_regionkey", (F.col("r_regionkey") * 1000).cast("long").alias("lo"), (F.col("r_regionkey") * 1000 + 700).cast("long").alias("hi"))
    j = J.interval_join(t.lineitem.select("l_orderkey"), r, "l_orderkey", 250)
    return j.groupBy("r_regionkey").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first"), F.max("l_orderkey").alias("last"))


@query("WITH p AS (SELECT page_id, split_part(url, '?', 1) AS u FROM pages), k AS (SELECT DISTINCT array_to_string(string_split(u, '/')[1:n], '/') AS prefix FROM p, (SELECT unnest([3, 4]) AS n) WHERE page_id % 2 = 0), h AS (SELECT page_id, max_by(prefix, length(prefix)) AS prefix FROM p JOIN k ON u = prefix OR starts_with(u, prefix || '/') GROUP BY page_id) SELECT page_id, prefix FROM p LEFT JOIN h USING (page_id)")
def prefix_join(t):
    p = t.pages.select("page_id", F.split_part("url", F.lit("?"), F.lit(1)).alias("u"))
    parts = F.split("u", "/")
    known = p.where("page_id % 2 = 0").select(F.explode(F.array(*[F.array_join(F.slice(parts, 1, n), "/") for n in (3, 4)])).alias("prefix"))
    return J.longest_prefix(p, known, "u", "prefix", "/").select("page_id", "prefix")


_SETS = "s AS (SELECT DISTINCT source AS o, unnest(string_split(lower(text), ' ')) AS e FROM documents)"


@query(f"WITH {_SETS}, n AS (SELECT o, count(*) AS n FROM s GROUP BY o HAVING count(*) >= 20), p AS (SELECT a.o AS a, b.o AS b, count(*) AS inter FROM s a JOIN s b ON a.e = b.e AND a.o < b.o GROUP BY 1, 2) SELECT a, b, inter, round(inter::DOUBLE / least(x.n, y.n), 9) AS coef FROM p JOIN n x ON x.o = a JOIN n y ON y.o = b WHERE inter::DOUBLE / least(x.n, y.n) >= 0.35")
def overlap_pairs(t):
    """Sources by the words they share."""
    s = t.documents.select("source", F.split(F.lower("text"), " ").alias("e"))
    return J.overlap_pairs(s, "source", "e", 0.35, 20).select("a", "b", "inter", F.round("coef", 9).alias("coef"))


@query("WITH s AS (SELECT DISTINCT vendor_id AS o, item_id AS e FROM sale_lines WHERE vendor_id IS NOT NULL AND item_id IS NOT NULL), n AS (SELECT o, count(*) AS n FROM s GROUP BY o HAVING count(*) >= 20), p AS (SELECT a.o AS a, b.o AS b, count(*) AS inter FROM s a JOIN s b ON a.e = b.e AND a.o < b.o GROUP BY 1, 2) SELECT a, b, inter, round(inter::DOUBLE / least(x.n, y.n), 9) AS coef FROM p JOIN n x ON x.o = a JOIN n y ON y.o = b WHERE inter::DOUBLE / least(x.n, y.n) >= 0.35")
def overlap_pairs_all(t):
    """All vendors by the items of their sales."""
    p = J.overlap_pairs(t.sale_lines.select("vendor_id", F.col("item_id").alias("e")), "vendor_id", "e", 0.35, 20)
    return p.select("a", "b", "inter", F.round("coef", 9).alias("coef"))


@query("WITH s AS (SELECT DISTINCT doc_id, unnest(string_split(lower(text), ' ')) AS e FROM documents), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM s a JOIN s b ON a.e = b.e AND a.doc_id < b.doc_id GROUP BY 1, 2) SELECT a, b, inter, round(inter::DOUBLE / (x.n + y.n - inter), 9) AS jaccard FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE inter::DOUBLE / (x.n + y.n - inter) >= 0.5")
def set_sim_join(t):
    """Jaccard of the full word sets of documents; copies are classes until the last join."""
    s = t.documents.select("doc_id", F.split(F.lower("text"), " ").alias("e"))
    return J.similar_pairs(s, "doc_id", "e", 0.5).select("a", "b", "inter", F.round("jaccard", 9).alias("jaccard"))


@query("WITH s AS (SELECT DISTINCT doc_id, unnest(string_split(lower(text), ' ')) AS e FROM documents), n AS (SELECT doc_id, count(*) AS n, list_sort(list(e)) AS es FROM s GROUP BY doc_id), c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY es) AS class_id, count(*) OVER (PARTITION BY es) AS size FROM n), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM s a JOIN s b ON a.e = b.e AND a.doc_id <> b.doc_id GROUP BY 1, 2), l AS (SELECT a AS doc_id, count(*) AS links FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE inter::DOUBLE / (x.n + y.n - inter) >= 0.5 GROUP BY 1) SELECT c.doc_id, class_id, size, coalesce(links, 0) AS links FROM c LEFT JOIN l USING (doc_id)")
def set_sim_links(t):
    """Each document with its class of equal word sets and the number of documents like it."""
    s = t.documents.select("doc_id", F.split(F.lower("text"), " ").alias("e"))
    return J.similar_links(s, "doc_id", "e", 0.5)[0]


@query("WITH c AS (SELECT l_suppkey AS o, l_partkey % 40 AS e, count(*) AS k FROM lineitem GROUP BY 1, 2), n AS (SELECT o, sum(k) AS n FROM c GROUP BY o), p AS (SELECT o AS a, o + 1 AS b FROM n) SELECT a, b, coalesce(sum(least(x.k, coalesce(y.k, 0))), 0)::BIGINT AS inter, round(coalesce(sum(least(x.k, coalesce(y.k, 0))), 0)::DOUBLE / any_value(n.n), 9) AS ratio FROM p JOIN n ON n.o = a LEFT JOIN c x ON x.o = a LEFT JOIN c y ON y.o = b AND y.e = x.e GROUP BY a, b")
def build_identity(t):
    """Shared multiset of each supplier with the next one."""
    s = t.lineitem.select("l_suppkey", (F.col("l_partkey") % 40).alias("e"))
    pairs = s.select(F.col("l_suppkey").alias("a"), (F.col("l_suppkey") + 1).alias("b")).distinct()
    return J.overlap_of(pairs, s, "l_suppkey", "e").select("a", "b", "inter", F.round("ratio", 9).alias("ratio"))


@query("WITH a AS (SELECT DISTINCT replace(p_name, ' ', '') AS a FROM part), b AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS b FROM part UNION SELECT DISTINCT replace(p_name, ' ', '') || 'x' FROM part WHERE p_partkey % 3 = 0) SELECT a, b FROM a, b WHERE a = b OR (length(a) > 4 AND (starts_with(b, a) OR starts_with(a, b)))")
def prefix_overlap(t):
    joined = F.replace("p_name", F.lit(" "), F.lit(""))
    a = t.part.select(joined.alias("nm"))
    b = t.part.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("nm")).union(t.part.where("p_partkey % 3 = 0").select(F.concat(joined, F.lit("x"))))
    return J.prefix_overlap(a, b, "nm")


@query("SELECT a.l_orderkey, count(*) AS pairs, count(*) FILTER (a.l_partkey = b.l_partkey) AS same_part FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND a.l_returnflag <> b.l_returnflag GROUP BY a.l_orderkey")
def pairs_self(t):
    a = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey")
    b = a.select("l_orderkey", *[F.col(c).alias(f"b_{c}") for c in a.columns[1:]])
    j = a.join(b, "l_orderkey").where("l_linenumber < b_l_linenumber and l_returnflag <> b_l_returnflag")
    return j.groupBy("l_orderkey").agg(F.count("*").alias("pairs"), F.count_if(F.col("l_partkey") == F.col("b_l_partkey")).alias("same_part"))


@query("WITH d AS (SELECT doc_id, true AS d FROM documents), l AS (SELECT DISTINCT doc_id, true AS l FROM labels), b AS (SELECT DISTINCT item_id AS doc_id, true AS b FROM benchmark) SELECT coalesce(d, false) AS in_documents, coalesce(l, false) AS in_labels, coalesce(b, false) AS in_benchmark, count(*) AS n FROM d FULL JOIN l USING (doc_id) FULL JOIN b USING (doc_id) GROUP BY 1, 2, 3")
def venn(t):
    has = lambda df, c: df.select("doc_id").distinct().withColumn(c, F.lit(True))
    j = has(t.documents, "d").join(has(t.labels, "l"), "doc_id", "full_outer").join(has(t.benchmark.withColumnRenamed("item_id", "doc_id"), "b"), "doc_id", "full_outer")
    flag = lambda c: F.coalesce(c, F.lit(False))
    return j.groupBy(flag("d").alias("in_documents"), flag("l").alias("in_labels"), flag("b").alias("in_benchmark")).agg(F.count("*").alias("n"))


@query("WITH a AS (SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A'), r AS (SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R') SELECT (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM r)) AS both, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM r)) AS only_a, (SELECT count(*) FROM (SELECT * FROM r EXCEPT SELECT * FROM a)) AS only_r, (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM r)) AS any_")
def set_ops(t):
    flag = lambda f: t.lineitem.where(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("k"))
    a, r = flag("A"), flag("R")
    parts = (("both", a.intersect(r)), ("only_a", a.subtract(r)), ("only_r", r.subtract(a)), ("any_", a.union(r).distinct()))
    rows = None
    for name, df in parts:
        one = df.agg(F.count("*").alias("n")).withColumn("what", F.lit(name))
        rows = one if rows is None else rows.union(one)
    return rows.groupBy().pivot("what", [n for n, _ in parts]).agg(F.first("n"))


@query("WITH l AS (SELECT l_orderkey, l_linenumber, l_returnflag, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS c, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos, CASE WHEN l_returnflag = 'R' THEN l_linenumber END AS mark, l_partkey, l_suppkey, l_extendedprice FROM lineitem), w AS (SELECT l_orderkey, pos, last_value(mark IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section, lead(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY pos) AS nxt, lag(l_returnflag, 2) OVER (PARTITION BY l_orderkey ORDER BY pos) AS prev2 FROM l) SELECT coalesce(section, 0) AS section, coalesce(nxt, '-') AS nxt, coalesce(prev2, '-') AS prev2, count(*) AS n FROM w GROUP BY 1, 2, 3")
def carry_forward(t):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    lines = t.lineitem.select("l_orderkey", "l_returnflag", *order)
    w = Window.partitionBy("l_orderkey").orderBy(*order)
    lines = lines.withColumns({"nxt": F.lead("l_returnflag").over(w), "prev2": F.lag("l_returnflag", 2).over(w)})
    mark = F.when(F.col("l_returnflag") == "R", F.col("l_linenumber"))
    r = I.carry_forward(lines, ["l_orderkey"], order, mark, "section")
    return r.groupBy(F.coalesce("section", F.lit(0)).alias("section"), F.coalesce("nxt", F.lit("-")).alias("nxt"), F.coalesce("prev2", F.lit("-")).alias("prev2")).agg(F.count("*").alias("n"))


@query("WITH e AS (SELECT DISTINCT user_id AS src, (user_id * 7 + event_id) % 150 AS dst FROM events WHERE event_type = 'view'), o AS (SELECT src AS u, count(*) AS outs FROM e GROUP BY src), i AS (SELECT dst AS u, count(*) AS ins FROM e GROUP BY dst), d AS (SELECT u, coalesce(outs, 0) AS outs, coalesce(ins, 0) AS ins FROM o FULL JOIN i USING (u)) SELECT u, outs, ins, CASE WHEN outs > 0 AND ins > 0 THEN 'both' WHEN outs > 0 THEN 'caller' WHEN ins > 0 THEN 'callee' ELSE 'neither' END AS stratum, (SELECT count(*) FROM e WHERE src = u AND dst <= src) AS back FROM d")
def call_graph(t):
    e = t.events.where("event_type = 'view'").select(F.col("user_id").alias("src"), ((F.col("user_id") * 7 + F.col("event_id")) % 150).alias("dst")).distinct()
    out = e.groupBy(F.col("src").alias("u")).agg(F.count("*").alias("outs"), F.count_if(F.col("dst") <= F.col("src")).alias("back"))
    d = out.join(e.groupBy(F.col("dst").alias("u")).agg(F.count("*").alias("ins")), "u", "full_outer").na.fill(0)
    s = F.when((F.col("outs") > 0) & (F.col("ins") > 0), "both").when(F.col("outs") > 0, "caller").when(F.col("ins") > 0, "callee").otherwise("neither")
    return d.select("u", "outs", "ins", s.alias("stratum"), "back")


@query("WITH g AS (SELECT o_orderkey AS k FROM orders), l AS (SELECT l_orderkey * 2 AS k, CASE l_partkey % 3 WHEN 0 THEN '_p' WHEN 1 THEN '__p' ELSE 'p' END || l_partkey AS name, l_orderkey * 10 + l_linenumber AS at FROM lineitem), h AS (SELECT g.k, l.name, row_number() OVER (PARTITION BY g.k ORDER BY l.at, l.name) AS n FROM g JOIN l ON l.k = g.k OR l.k = g.k + 4 WHERE NOT (starts_with(name, '_') AND NOT starts_with(name, '__'))) SELECT g.k, h.name FROM g LEFT JOIN h ON h.k = g.k AND h.n = 1")
def first_label(t):
    """The first label at an address or four behind it whose name no compiler made."""
    name = F.concat(F.when(F.col("l_partkey") % 3 == 0, "_p").when(F.col("l_partkey") % 3 == 1, "__p").otherwise("p"), "l_partkey")
    labels = t.lineitem.select((F.col("l_orderkey") * 2).alias("k"), name.alias("name"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    return J.first_label(t.orders.select(F.col("o_orderkey").alias("k")), labels, [], "k", [0, 4], "name", "at")


@query("SELECT a.o_orderkey, b.o_custkey AS cust FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey WHERE b.o_orderkey % 3 < 2")
def same_address(t):
    """One side writes addresses with 0x, the other as bare digits, filled up with zeros or not."""
    k = F.lower(F.hex("o_orderkey"))
    left = t.orders.select("o_orderkey", F.concat(F.lit("0x"), k).alias("addr"))
    bare = F.when(F.col("o_orderkey") % 3 == 0, F.lpad(k, 8, "0")).otherwise(F.upper(k))
    right = t.orders.where("o_orderkey % 3 < 2").select(bare.alias("addr"), F.col("o_custkey").alias("cust"))
    return J.same_address(left, right, [], "addr").select("o_orderkey", "cust")
