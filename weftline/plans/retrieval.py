"""Retrieval, voting and routing over embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import joins as J
from weftline.operators import predictions as A
from weftline.operators import retrieval as R
from weftline.operators import router as U
from weftline.operators import stats as S
from weftline.plans.base import registry

QUERIES, ORACLES, query = registry()


def _knn(t, k):
    e = t.embeddings
    q = e.where("vec_id % 5 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("v"))
    i = e.where("vec_id % 5 <> 0").select(F.col("vec_id").alias("t_id"), F.col("label").alias("t_label"), F.col("embedding").alias("v"))
    return R.knn(q, i, k)


_S = "s AS (SELECT q.vec_id AS q_id, q.label, t.vec_id AS t_id, t.label AS t_label, list_dot_product(q.embedding::DOUBLE[], t.embedding::DOUBLE[]) AS sim FROM embeddings q, embeddings t WHERE q.vec_id % 5 = 0 AND t.vec_id % 5 <> 0), k AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(sim, 12) DESC, t_id) AS rank FROM s)"


@query(f"WITH {_S} SELECT label, count(*) AS n, count(*) FILTER (label = t_label) AS hits FROM k WHERE rank = 1 GROUP BY label")
def knn_macro(t):
    own = t.embeddings.select(F.col("vec_id").alias("q_id"), "label")
    return _knn(t, 1).join(own, "q_id").groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("t_label")).alias("hits"))


@query(f"WITH {_S}, h AS (SELECT label, avg((label = t_label)::INT) AS m, count(*) AS n, sum((label = t_label)::INT) AS s FROM k WHERE rank = 1 GROUP BY label) SELECT round(sum(s) / sum(n), 9) AS micro, round(avg(m), 9) AS macro FROM h")
def knn_accuracy(t):
    own = t.embeddings.select(F.col("vec_id").alias("q_id"), "label")
    r = _knn(t, 1).join(own, "q_id").withColumn("hit", (F.col("label") == F.col("t_label")).cast("int"))
    return S.micro_macro(r, "label", "hit").select(F.round("micro", 9).alias("micro"), F.round("macro", 9).alias("macro"))


@query(f"WITH {_S} SELECT q_id, max(t_id) FILTER (rank = 1) AS top1, max(t_id) FILTER (rank = 2) AS top2, round(max(sim) FILTER (rank = 1) - max(sim) FILTER (rank = 2), 6) AS margin FROM k WHERE rank <= 2 GROUP BY q_id")
def knn_margin(t):
    at = lambda c, r: F.max(F.when(F.col("rank") == r, F.col(c)))
    return _knn(t, 2).groupBy("q_id").agg(at("t_id", 1).alias("top1"), at("t_id", 2).alias("top2"), F.round(at("sim", 1) - at("sim", 2), 6).alias("margin"))


@query(f"WITH {_S}, v AS (SELECT q_id, t_label, count(*) AS votes, max(sim) AS best FROM k WHERE rank <= 5 GROUP BY 1, 2), w AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY votes DESC, best DESC, t_label) AS n FROM v) SELECT q_id, t_label, votes FROM w WHERE n = 1")
def knn_vote(t):
    return J.vote(_knn(t, 5), "q_id", "t_label", "sim")


_SETS = "fp AS (SELECT label, list_distinct([label % 4, 4 + label % 3, 7 + label % 2, 9 + label % 5]) AS f FROM (SELECT DISTINCT label FROM embeddings)), jac AS (SELECT x.label AS a, y.label AS b, len(list_intersect(x.f, y.f))::DOUBLE / len(list_distinct(list_concat(x.f, y.f))) AS j FROM fp x, fp y)"


@query(f"WITH {_S}, {_SETS}, ok AS (SELECT s.q_id, s.t_id, s.t_label, s.sim, j.j >= 0.3 AS fits FROM s JOIN jac j ON j.a = s.q_id % 7 AND j.b = s.t_label), c AS (SELECT q_id, count(*) FILTER (fits) AS n FROM ok GROUP BY q_id), r AS (SELECT ok.q_id, t_id, t_label, row_number() OVER (PARTITION BY ok.q_id ORDER BY round(sim, 12) DESC, t_id) AS rank FROM ok JOIN c USING (q_id) WHERE fits OR c.n < 3) SELECT q_id, t_id, t_label FROM r WHERE rank <= 3")
def knn_filtered(t):
    """Neighbours among labels whose fingerprint is like that of the query's group; the mask is lifted below three survivors."""
    e = t.embeddings
    prints = e.select(F.col("label")).distinct().select("label", F.explode(F.array_distinct(F.array(F.col("label") % 4, F.col("label") % 3 + 4, F.col("label") % 2 + 7, F.col("label") % 5 + 9))).alias("e"))
    allowed = R.similar_groups(prints.select(F.col("label").alias("q_group"), "e"), prints.select(F.col("label").alias("t_group"), "e"), 0.3)
    q = e.where("vec_id % 5 = 0").select(F.col("vec_id").alias("q_id"), (F.col("vec_id") % 7).cast("int").alias("q_group"), F.col("embedding").alias("v"))
    i = e.where("vec_id % 5 <> 0").select(F.col("vec_id").alias("t_id"), F.col("label").alias("t_label"), F.col("label").alias("t_group"), F.col("embedding").alias("v"))
    return R.knn_masked(q, i, allowed, 3).select("q_id", "t_id", "t_label")


@query(f"WITH {_S}, b AS (SELECT q_id, t_label, sim FROM k WHERE rank = 1) SELECT CASE WHEN round(sim, 9) >= 0.5 THEN 'retrieved' ELSE 'fallback' END AS arm, count(*) AS n, sum(CASE WHEN round(sim, 9) >= 0.5 THEN t_label ELSE q_id % 10 END)::BIGINT AS picks FROM b GROUP BY 1")
def hybrid_pick(t):
    over = F.round("sim", 9) >= 0.5
    k = _knn(t, 1).select(F.when(over, "retrieved").otherwise("fallback").alias("arm"), F.when(over, F.col("t_label")).otherwise(F.col("q_id") % 10).alias("pick"))
    return k.groupBy("arm").agg(F.count("*").alias("n"), F.sum("pick").alias("picks"))


@query(f"WITH {_S}, b AS (SELECT q_id, t_label, CASE WHEN (q_id % 13) / 13.0::DOUBLE <= 0.4 THEN 'retrieved' ELSE 'generated' END AS arm FROM k WHERE rank = 1) SELECT arm, count(*) AS n, sum(CASE WHEN arm = 'retrieved' THEN t_label ELSE q_id % 10 END)::BIGINT AS picks FROM b GROUP BY 1")
def hybrid_forward(t):
    """The generated label, and the nearest one's where the generator's score is low."""
    p = A.forward_pick(F.col("q_id") % 13 / 13.0, 0.4, F.col("t_label").cast("long"), F.col("q_id") % 10)
    k = _knn(t, 1).select(p.alias("p")).select(F.when(F.col("p.retrieved"), "retrieved").otherwise("generated").alias("arm"), F.col("p.pick").alias("pick"))
    return k.groupBy("arm").agg(F.count("*").alias("n"), F.sum("pick").alias("picks"))


def _features(t):
    v = F.col("embedding")
    f = t.embeddings.select("vec_id", *[v[i].cast("double").alias(f"f{i}") for i in range(4)], (F.col("label") < 5).cast("double").alias("y"), (F.abs(v[0].cast("double")) + 0.001).alias("w"), F.col("label").cast("double").alias("label"))
    return f.where("vec_id % 2 = 0"), f.where("vec_id % 2 = 1")


_F = [f"f{i}" for i in range(4)]


@query()
def router_mlp(t):
    train, test = _features(t)
    return U.mlp_router(train, _F, "y", "w", "vec_id").transform(test).select("vec_id", "prediction")


@query()
def router_gbt(t):
    train, test = _features(t)
    return U.gbt_router(train, _F, "y", "w", 10).transform(test).select("vec_id", "prediction")


@query()
def router_logistic(t):
    train, test = _features(t)
    return U.logistic_router(train, _F, "y", "w").transform(test).select("vec_id", "prediction")


@query()
def abstain_gbt(t):
    train, test = _features(t)
    return U.abstention(train, _F, "y", 10).transform(test).select("vec_id", "prediction")


def _heads(t):
    """Three heads' scores in tenths, so that ties occur; the router's label is the head of the best score, the first of equal ones."""
    train, test = _features(t)
    scores = {h: F.round(F.abs(F.col(f"f{i}")) * 10) / 10 for i, h in enumerate(("generator", "retriever", "decoder"))}
    head, weight = U.best_head(scores)
    return [d.withColumns({"head": head, "gap": weight}) for d in (train, test)]


@query("WITH e AS (SELECT vec_id, list_transform(embedding[1:3], lambda x: round_even(abs(x::DOUBLE) * 10, 0) / 10) AS s FROM embeddings) SELECT vec_id, (list_position(s, list_max(s)) - 1)::DOUBLE AS head, round(list_max(s) - list_min(s) + 0.001, 9) AS gap FROM e")
def head_labels(t):
    train, test = _heads(t)
    return train.unionByName(test).select("vec_id", "head", F.round("gap", 9).alias("gap"))


@query()
def router_multi(t):
    """20 trees a class (300 by default)."""
    train, test = _heads(t)
    return U.multi_router(train, _F, "head", "gap", [0.0, 1.0, 2.0], 20).transform(test).select("vec_id", "head", "prediction")


@query()
def weighted_resample(t):
    """How often each training row of the router is drawn."""
    train, _ = _features(t)
    return U.resample(train.select("vec_id", "w"), "w", "vec_id").groupBy("vec_id").agg(F.count("*").alias("times"))


@query("WITH d AS (SELECT embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings) SELECT round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(regr_r2(y, x), 6) AS r2 FROM d")
def ols_fit(t):
    d = t.embeddings.select(F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    (slope,), intercept, r2 = U.ols(d, ["x"], "y")
    one = F.struct(*[F.lit(round(v, 6)).alias(n) for n, v in (("slope", slope), ("intercept", intercept), ("r2", r2))])
    return t.spark.range(1).select(one.alias("m")).select("m.*")
