"""Statistics over documents, labels, lineitem and pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import stats as S
from weftline.plans.base import registry

QUERIES, ORACLES, query = registry()

# A score for the labelled rows: a hash of doc_id in [0, 1), the same in both engines.
_SCORE = "(('0x' || substr(md5(doc_id::VARCHAR), 1, 6))::INT % 1000) / 1000.0::DOUBLE"


def _scored(t):  # noqa: ANN001
    score = (F.conv(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 6), 16, 10).cast("long") % 1000) / 1000.0
    return t.labels.select("doc_id", "quality", "toxic", score.alias("score"))


@query("WITH g AS (SELECT lang, avg(quality) AS m, count(quality) AS n, sum(quality) AS s FROM documents JOIN labels USING (doc_id) GROUP BY lang) SELECT sum(n)::BIGINT AS n, round(sum(s) / sum(n), 9) AS micro, count(*) AS groups, round(avg(m), 9) AS macro, round(sum(m * n) / sum(n), 9) AS weighted FROM g")
def micro_macro(t):
    r = S.micro_macro(t.documents.select("doc_id", "lang").join(t.labels, "doc_id"), "lang", "quality")
    return r.select("n", *[(F.round(c, 9) if c != "groups" else F.col(c)).alias(c) for c in ("micro", "groups", "macro", "weighted")])


@query("SELECT lang, source, grouping(lang)::INT AS g_lang, grouping(source)::INT AS g_source, count(*) AS n, sum(n_chars)::BIGINT AS chars, count(DISTINCT text) AS texts FROM documents GROUP BY GROUPING SETS ((lang, source), (lang), (source), ())")
def strata_sets(t):
    d = t.documents
    return d.groupingSets([["lang", "source"], ["lang"], ["source"], []], "lang", "source").agg(F.grouping("lang").cast("int").alias("g_lang"), F.grouping("source").cast("int").alias("g_source"), F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.count_distinct("text").alias("texts"))


@query("SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS f_lines, count(*) FILTER (l_linestatus = 'O') AS o_lines FROM lineitem GROUP BY l_returnflag")
def crosstab(t):
    p = t.lineitem.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).count()
    return p.select("l_returnflag", F.coalesce("F", F.lit(0)).alias("f_lines"), F.coalesce("O", F.lit(0)).alias("o_lines"))


@query("WITH r AS (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT source, max(n_chars) FILTER (i = least(n - 1, floor(0.25 * n))) AS p25, max(n_chars) FILTER (i = least(n - 1, floor(0.5 * n))) AS p50, max(n_chars) FILTER (i = least(n - 1, floor(0.9 * n))) AS p90 FROM r GROUP BY source")
def nearest_rank_pct(t):
    return S.nearest_rank(t.documents, "source", "n_chars", [0.25, 0.5, 0.9])


@query("SELECT lang, list_sort(list(n_chars))[(count(*) // 2 + 1)::INT] AS upper_median, quantile_cont(n_chars::DOUBLE, 0.5) AS median, round(stddev_pop(n_chars::DOUBLE), 6) AS std FROM documents GROUP BY lang")
def medians(t):
    d = t.documents.select("lang", "n_chars")
    rest = d.groupBy("lang").agg(F.percentile("n_chars", F.lit(0.5)).alias("median"), F.round(F.stddev_pop(F.col("n_chars").cast("double")), 6).alias("std"))
    u = S.upper_median(d, "lang", "n_chars").withColumnRenamed("lang", "l")
    return rest.join(u, F.col("lang").eqNullSafe(F.col("l"))).drop("l")


@query("SELECT CASE WHEN n_chars < 100 THEN '0-99' WHEN n_chars < 1000 THEN '100-999' WHEN n_chars < 5000 THEN '1000-4999' ELSE '5000+' END AS bucket, count(*) AS n FROM documents GROUP BY 1")
def hist(t):
    c = F.col("n_chars")
    return t.documents.groupBy(F.when(c < 100, "0-99").when(c < 1000, "100-999").when(c < 5000, "1000-4999").otherwise("5000+").alias("bucket")).agg(F.count("*").alias("n"))


@query(f"WITH r AS (SELECT quality, row_number() OVER (ORDER BY {_SCORE} DESC, doc_id) AS i, count(*) OVER () AS n FROM labels), g AS (SELECT unnest([0.05, 0.1, 0.2, 0.5, 1.0])::DOUBLE AS share, unnest([5, 10, 20, 50, 100]) AS q), m AS (SELECT count(*) AS n FROM labels), k AS (SELECT 'round' AS rule, share, greatest(round_even(share * n, 0), 1) AS k FROM g, m UNION ALL SELECT 'int', share, greatest(floor(share * n), 1) FROM g, m UNION ALL SELECT 'percent', share, greatest(n * q // 100, 1) FROM g, m) SELECT rule, share, count(*) AS kept, round(avg(quality), 9) AS mean FROM r JOIN k ON i <= k GROUP BY rule, share")
def selective(t):
    """Mean quality of the best-scored rows at each share, by the three rules that say how many rows a share keeps."""
    s, shares = _scored(t), [0.05, 0.1, 0.2, 0.5, 1.0]
    out = [S.selective(s, "score", "quality", "doc_id", shares, rule).withColumn("rule", F.lit(rule)) for rule in S.CUTS]
    return reduce(DataFrame.unionByName, out).select("rule", "share", "kept", F.round("mean", 9).alias("mean"))


@query(f"WITH s AS (SELECT doc_id, quality, {_SCORE} AS score FROM labels) SELECT doc_id, row_number() OVER w AS i, round(avg(1.0 - quality) OVER (w ROWS UNBOUNDED PRECEDING), 9) AS risk FROM s WINDOW w AS (ORDER BY score DESC, doc_id)")
def risk_curve(t):
    return S.ranked_curve(_scored(t), "score", "quality", "doc_id").select("doc_id", "i", F.round("risk", 9).alias("risk"))


@query(f"WITH s AS (SELECT doc_id, quality, {_SCORE} AS score FROM labels), r AS (SELECT avg(1.0 - quality) OVER (ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING) AS risk FROM s) SELECT round(avg(risk), 9) AS aurc, count(*) AS n FROM r")
def aurc(t):
    return S.aurc(_scored(t), "score", "quality", "doc_id").select(F.round("aurc", 9).alias("aurc"), "n")


@query(f"WITH s AS (SELECT quality, {_SCORE} AS score FROM labels), b AS (SELECT least(floor(score * 10), 9) AS b, count(*) AS n, avg(score) AS c, avg(quality) AS a FROM s GROUP BY 1) SELECT round(sum(abs(c - a) * n) / sum(n), 9) AS ece, sum(n)::BIGINT AS n FROM b")
def ece(t):
    return S.ece(_scored(t), "score", "quality").select(F.round("ece", 9).alias("ece"), "n")


@query(f"WITH s AS (SELECT quality, {_SCORE} AS score FROM labels) SELECT coalesce(sum(CASE WHEN p.score > q.score THEN 2 WHEN p.score = q.score THEN 1 ELSE 0 END), 0)::BIGINT AS twice_u, (SELECT count(*) FROM s WHERE quality = 1) AS pos, (SELECT count(*) FROM s WHERE quality = 0) AS neg FROM s p, s q WHERE p.quality = 1 AND q.quality = 0")
def auc(t):
    return S.auc(_scored(t), "score", "quality").select("twice_u", "pos", "neg")


_P_VALUE = "CASE WHEN z < 2 THEN 1 - 2 / sqrt(pi()) * z * exp(-z * z) * (1 + list_reduce(list_prepend(0::DOUBLE, range(50, 0, -1)::DOUBLE[]), lambda a, k: (1 + a) * (2 * z * z / (2 * k + 1)))) ELSE exp(-z * z) / sqrt(pi()) / (z + list_reduce(list_prepend(0::DOUBLE, range(60, 0, -1)::DOUBLE[]), lambda a, k: (k / 2) / (z + a))) END"


@query(f"WITH r AS (SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS only_a, count(*) FILTER (quality = 0 AND toxic = 1) AS only_b, count(*) FILTER (quality = 1 AND toxic = 1) AS both, count(*) FILTER (quality = 0 AND toxic = 0) AS neither FROM labels), c AS (SELECT *, CASE WHEN only_a + only_b > 0 THEN pow((abs(only_a - only_b) - 1)::DOUBLE, 2) / (only_a + only_b) ELSE 0.0 END AS x FROM r), z AS (SELECT *, sqrt(x / 2) AS z FROM c) SELECT only_a, only_b, \"both\", neither, round(x, 9) AS chi2, round(CASE WHEN only_a + only_b = 0 THEN 1.0 ELSE {_P_VALUE} END, 9) AS p_value FROM z")
def mcnemar(t):
    return S.mcnemar(t.labels, "quality", "toxic").withColumns({"chi2": F.round("chi2", 9), "p_value": F.round("p_value", 9)})


@query(f"WITH g AS (SELECT unnest(range(0, 4001))::DOUBLE / 100 AS chi2), z AS (SELECT *, sqrt(chi2 / 2) AS z FROM g), q AS (SELECT min(chi2) AS chi2, {_P_VALUE} AS p FROM z GROUP BY z), o AS (SELECT o_orderkey, (o_custkey % 4001)::DOUBLE / 100 AS chi2 FROM orders) SELECT o_orderkey, round(p, 9) AS p_value FROM o JOIN q USING (chi2)")
def chi2_tails(t):
    """The tail probability of a chi-squared value from 0 to 40 for every order."""
    return t.orders.select("o_orderkey", F.round(S.chi2_tail((F.col("o_custkey") % 4001) / 100.0), 9).alias("p_value"))


@query(f"WITH s AS (SELECT doc_id, quality, toxic, {_SCORE} AS score FROM labels) SELECT count(*) AS n, count(*) FILTER (greatest(quality, toxic) = 1) AS oracle, count(*) FILTER (quality = toxic) AS ties, count(*) FILTER (CASE WHEN score >= 0.5 THEN quality ELSE toxic END = greatest(quality, toxic)) AS routed_right, count(*) FILTER (quality <> toxic) AS contested, count(*) FILTER (quality <> toxic AND CASE WHEN score >= 0.5 THEN quality ELSE toxic END = 1) AS contested_right FROM s")
def complement(t):
    pick = F.when(F.col("score") >= 0.5, F.col("quality")).otherwise(F.col("toxic"))
    best, apart = F.greatest("quality", "toxic"), F.col("quality") != F.col("toxic")
    return _scored(t).agg(F.count("*").alias("n"), F.count_if(best == 1).alias("oracle"), F.count_if(~apart).alias("ties"), F.count_if(pick == best).alias("routed_right"), F.count_if(apart).alias("contested"), F.count_if(apart & (pick == 1)).alias("contested_right"))


@query(f"WITH s AS (SELECT quality AS a, toxic AS b, {_SCORE} >= 0.5 AS u FROM labels) SELECT count(*) AS n, round(avg((a > b)::INT), 9) AS prefers_a, round(avg((b > a)::INT), 9) AS prefers_b, round(avg((a = b)::INT), 9) AS ties, round(avg(CASE WHEN a = b THEN 1 ELSE (u = (a > b))::INT END), 9) AS accuracy, round(coalesce(avg((u = (a > b))::INT) FILTER (a <> b), 0), 9) AS contested, round(avg(greatest(a, b) - CASE WHEN u THEN a ELSE b END), 9) AS regret FROM s")
def routing_stats(t):
    r = S.routing(_scored(t), "quality", "toxic", F.col("score") >= 0.5)
    return r.select("n", *[F.round(c, 9).alias(c) for c in r.columns if c != "n"])


@query("WITH s AS (SELECT quality::DOUBLE AS a, toxic::DOUBLE AS b, lang AS p, CASE WHEN source LIKE '%1%' THEN 'en' ELSE lang END AS q FROM labels JOIN documents USING (doc_id)) SELECT count(*) AS n, count(*) FILTER (a = 1 AND b = 1) AS both, count(*) FILTER (a = 1 AND b <> 1) AS only_a, count(*) FILTER (a <> 1 AND b = 1) AS only_b, count(*) FILTER (a > b + 1e-9) AS a_wins, count(*) FILTER (b > a + 1e-9) AS b_wins, count(*) FILTER (abs(a - b) <= 1e-9) AS ties, count(*) FILTER (p IS NOT DISTINCT FROM q) AS same_prediction, round(avg(a), 9) AS mean_a, round(avg(b), 9) AS mean_b, round(avg(greatest(a, b)), 9) AS oracle FROM s")
def complementarity(t):
    d = t.documents.select("doc_id", F.col("lang").alias("p"), F.when(F.col("source").contains("1"), "en").otherwise(F.col("lang")).alias("q"))
    r = S.complementarity(t.labels.join(d, "doc_id"), "quality", "toxic", "p", "q")
    return r.select(*[F.round(c, 9).alias(c) if c in ("mean_a", "mean_b", "oracle") else F.col(c) for c in r.columns])


@query(f"WITH s AS (SELECT doc_id, quality, toxic, {_SCORE} AS score FROM labels), g AS (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9])::DOUBLE AS tau), v AS (SELECT tau, avg(CASE WHEN score >= tau THEN quality ELSE toxic END) AS m FROM s, g WHERE doc_id % 2 = 0 GROUP BY tau), b AS (SELECT tau FROM v ORDER BY round(m, 9) DESC, tau LIMIT 1) SELECT tau, count(*) AS n, round(avg(CASE WHEN score >= tau THEN quality ELSE toxic END), 9) AS mean FROM s, b WHERE doc_id % 2 = 1 GROUP BY tau")
def tau_sweep(t):
    s = _scored(t)
    val = S.threshold_sweep(s.where("doc_id % 2 = 0"), "score", "quality", "toxic", [0.1, 0.3, 0.5, 0.7, 0.9])
    best = val.agg(F.max_by("tau", F.struct(F.round("mean", 9), -F.col("tau"))).alias("tau"))
    test = s.where("doc_id % 2 = 1").join(F.broadcast(best))
    return test.groupBy("tau").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("score") >= F.col("tau"), F.col("quality")).otherwise(F.col("toxic"))), 9).alias("mean"))


@query("WITH g AS (SELECT label, avg(embedding[1]::DOUBLE) AS v, row_number() OVER (ORDER BY label) - 1 AS g, count(*) OVER () AS n FROM embeddings GROUP BY label), d AS (SELECT rep, ('0x' || substr(md5('42:' || rep || ':' || i), 1, 12))::BIGINT % (SELECT max(n) FROM g) AS g FROM range(1000) r(rep), (SELECT unnest(range(0, (SELECT max(n) FROM g))) AS i)), m AS (SELECT rep, avg(v) AS mean FROM d JOIN g USING (g) GROUP BY rep) SELECT count(*) AS reps, round(quantile_cont(mean, 0.025), 9) AS low, round(quantile_cont(mean, 0.975), 9) AS high FROM m")
def bootstrap_ci(t):
    g = t.embeddings.groupBy("label").agg(F.avg(F.col("embedding")[0].cast("double")).alias("v"))
    r = S.interval(S.bootstrap_means(g, "label", "v", 1000))
    return r.select("reps", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


_POISSON = " + ".join(f"(u < {x})::INT" for x in S.POISSON)


@query(f"WITH d AS (SELECT quality::DOUBLE AS v, b, md5('42:' || doc_id || ':' || b) AS h FROM labels, range(125) r(b) WHERE quality IS NOT NULL), u AS (SELECT b * 8 + j AS rep, v, ('0x' || substr(h, (j * 4 + 1)::INT, 4))::INT AS u FROM d, range(8) s(j)), m AS (SELECT rep, sum(v * ({_POISSON})) / sum({_POISSON}) AS mean FROM u GROUP BY rep) SELECT count(*) AS reps, round(quantile_cont(mean, 0.025), 9) AS low, round(quantile_cont(mean, 0.975), 9) AS high FROM m")
def bootstrap_rows_ci(t):
    """Interval of the mean quality over all labelled rows, 1,000 resamples of rows."""
    r = S.interval(S.bootstrap_rows(t.labels, "doc_id", "quality", 1000))
    return r.select("reps", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


@query("WITH g AS (SELECT source, avg(quality) - avg(toxic) AS d, row_number() OVER (ORDER BY source) - 1 AS g, count(*) OVER () AS n FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY source), p AS (SELECT rep, ('0x' || substr(md5('0:' || rep || ':' || i), 1, 12))::BIGINT % (SELECT max(n) FROM g) AS g FROM range(10000) r(rep), (SELECT unnest(range(0, (SELECT max(n) FROM g))) AS i)), m AS (SELECT list_sort(list(mean)) AS m FROM (SELECT rep, avg(d) AS mean FROM p JOIN g USING (g) GROUP BY rep)) SELECT round(avg(d), 9) AS delta, count(*) FILTER (d > 0) AS higher, count(*) AS groups, round(any_value(m[251]), 9) AS low, round(any_value(m[9750]), 9) AS high FROM g, m")
def paired_bootstrap_ci(t):
    """Quality against toxicity by source, 10,000 resamples of sources."""
    r = S.paired_bootstrap(t.documents.select("doc_id", "source").join(t.labels, "doc_id"), "source", "quality", "toxic")
    return r.select("higher", "groups", *[F.round(c, 9).alias(c) for c in ("delta", "low", "high")])


@query("SELECT event_type, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER () > 0.1 AS collapsed, rank() OVER (ORDER BY count(*) DESC, event_type) AS rank FROM events GROUP BY event_type ORDER BY n DESC LIMIT 3")
def top_values(t):
    from pyspark.sql import Window

    every = Window.partitionBy(F.lit(1))
    g = t.events.groupBy("event_type").agg(F.count("*").alias("n"))
    g = g.select("event_type", "n", (F.col("n") / F.sum("n").over(every) > 0.1).alias("collapsed"), F.rank().over(every.orderBy(F.desc("n"), "event_type")).cast("long").alias("rank"))
    return g.where("rank <= 3")


_LIFT = "SELECT o_orderstatus, CASE WHEN o_orderstatus <> first AND base > 0 THEN round(100 * (m - base) / base, 6) END AS lift, CASE WHEN o_orderstatus = first THEN '(base)' WHEN base > 0 THEN CASE WHEN m >= base THEN '+' ELSE '' END || printf('%.1f', 100 * (m - base) / base) || '%' ELSE 'N/A' END AS label FROM r, f"


@query(f"WITH r AS (SELECT o_orderstatus, avg(o_totalprice) AS m FROM orders GROUP BY 1), f AS (SELECT m AS base, o_orderstatus AS first FROM r ORDER BY o_orderstatus LIMIT 1) {_LIFT}")
def relative_lift(t):
    r = t.orders.groupBy("o_orderstatus").agg(F.avg("o_totalprice").alias("m"))
    return S.relative_lift(r, "o_orderstatus", "m").select("o_orderstatus", F.round("lift", 6).alias("lift"), "label")


@query(f"WITH r AS (SELECT o_orderstatus, avg(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE o_totalprice END) AS m FROM orders GROUP BY 1), f AS (SELECT m AS base, o_orderstatus AS first FROM r ORDER BY o_orderstatus LIMIT 1) {_LIFT}")
def lift_without_base(t):
    """The first run's value is 0, so lifts are not available."""
    r = t.orders.groupBy("o_orderstatus").agg(F.avg(F.when(F.col("o_orderstatus") == "F", 0.0).otherwise(F.col("o_totalprice"))).alias("m"))
    return S.relative_lift(r, "o_orderstatus", "m").select("o_orderstatus", F.round("lift", 6).alias("lift"), "label")


@query("SELECT CASE WHEN json_extract(props, '$.k')::INT >= 50 THEN 'hi' ELSE 'lo' END AS half, event_type, count(*) AS n, sum(json_extract(props, '$.k')::INT)::BIGINT AS k_sum FROM events GROUP BY 1, 2")
def json_props(t):
    k = F.from_json("props", "k int")["k"]
    return t.events.select("event_type", k.alias("k")).groupBy(F.when(F.col("k") >= 50, "hi").otherwise("lo").alias("half"), "event_type").agg(F.count("*").alias("n"), F.sum("k").alias("k_sum"))
