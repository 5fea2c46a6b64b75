"""Routers between predictors, and expected-outcome regressors, with Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _assemble(features: list[str], scale: bool = False) -> list:
    out = [VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="keep")]
    return [*out, StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True)] if scale else [VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")]


#: Buckets over which cumulative weights are summed: a bucket is one window task, all buckets are one small table.
BUCKETS = 1024
#: Cells that a row's stretch of the total is spread over at once.
_STEP = 1024


def resample(rows: DataFrame, weight: str, key: str, n: Column | int | None = None, seed: int = 0) -> DataFrame:
    """n rows drawn with replacement, each with a chance in proportion to its weight (three times the rows by default, 60,000 at most).

    n may be an expression over the number of rows, n_rows. Rows lie behind each other on a line of the total weight, by buckets
    of their hashed key (which tells rows apart), in whole steps of 2^-50; draws are hashed points on that line. Both fall into n cells, and a point
    takes the row that covers it in its cell. Weights that are null or not positive are never drawn. Nothing runs
    while the plan is built.
    """
    n = F.least(F.col("n_rows") * 3, F.lit(60_000)) if n is None else F.lit(n) if isinstance(n, int) else n
    known = rows.where(F.col(weight) > 0).withColumns({"__w": F.col(weight).cast("double"), "__b": F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(BUCKETS))})
    total = known.agg(F.sum("__w").alias("__total"), F.count("*").alias("n_rows"))  # one row
    known = known.join(F.broadcast(total)).withColumn("__q", F.greatest(F.round(F.col("__w") / F.col("__total") * float(1 << 50)).cast("long"), F.lit(1)))
    sums = known.groupBy("__b").agg(F.sum("__q").alias("__t"), F.first("n_rows").alias("n_rows"))
    every = Window.partitionBy(F.lit(1))  # over buckets
    before = F.sum("__t").over(every.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    base = sums.select("__b", F.coalesce(before, F.lit(0)).alias("__base"), F.sum("__t").over(every).alias("__end"), n.cast("long").alias("__n"))
    upto = F.sum("__q").over(Window.partitionBy("__b").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    line = known.withColumn("__up", upto).join(F.broadcast(base), "__b").withColumn("__hi", F.col("__base") + F.col("__up")).withColumn("__lo", F.col("__hi") - F.col("__q"))
    cell = lambda x: F.floor(x / F.col("__end") * F.col("__n")).cast("long")
    step = F.lit(_STEP).cast("long")
    outer = F.explode(F.sequence(cell(F.col("__lo")), cell(F.col("__hi")), step))
    inner = F.explode(F.sequence("__from", F.least(F.col("__from") + step - 1, cell(F.col("__hi")))))
    spread = line.withColumn("__from", outer).withColumn("__cell", inner)
    draws = base.select("__n", "__end").limit(1).where("__n > 0")
    draws = draws.select("__n", "__end", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, step)).alias("__from")).repartition("__from")
    draws = draws.select("__n", "__end", F.explode(F.sequence("__from", F.least(F.col("__from") + step, F.col("__n")) - 1)).alias("__i"))
    point = F.pmod(F.xxhash64(F.lit(seed), F.lit("draw"), "__i"), F.col("__end"))
    draws = draws.select("__n", "__end", point.alias("__u")).select("__u", cell(F.col("__u")).alias("__cell"))
    return spread.join(draws, "__cell").where((F.col("__u") >= F.col("__lo")) & (F.col("__u") < F.col("__hi"))).select(*rows.columns)


def mlp_router(train: DataFrame, features: list[str], label: str, weight: str, key: str):
    """Scaled features, hidden layers 64 and 32, trained on a weight-proportional resample (no weights in this model)."""
    net = MultilayerPerceptronClassifier(layers=[len(features), 64, 32, 2], labelCol=label, featuresCol="features", seed=0, maxIter=100)
    return Pipeline(stages=[*_assemble(features, True), net]).fit(resample(train, weight, key))


def gbt_router(train: DataFrame, features: list[str], label: str, weight: str, trees: int = 300):
    m = GBTClassifier(labelCol=label, weightCol=weight, maxIter=trees, maxDepth=3, stepSize=0.05, seed=0)
    return Pipeline(stages=[*_assemble(features), m]).fit(train)


def best_head(scores: dict[str, Column]) -> tuple[Column, Column]:
    """(number of the head of the highest score, weight): ties go to the head named first; the weight is best minus worst and a thousandth."""
    top = F.greatest(*scores.values())
    head = F.coalesce(*[F.when(s == top, F.lit(i)) for i, s in enumerate(scores.values())])
    return head.cast("double"), top - F.least(*scores.values()) + 1e-3


class MultiRouter:
    """One boosted classifier a class against the rest; the class of the largest margin wins, the first of equal ones in the tie order."""

    def __init__(self, models: dict[float, object], ties: list[float]):
        self.models, self.ties = models, ties

    def transform(self, rows: DataFrame) -> DataFrame:
        own = rows.columns
        out = rows
        for c in self.ties:
            raw = self.models[c].transform(out.select(*out.columns)) if c in self.models else out.withColumn("rawPrediction", F.lit(None))
            margin = vector_to_array("rawPrediction")[1] if c in self.models else F.lit(float("-inf"))
            out = raw.withColumn(f"margin_{int(c)}", margin).select(*out.columns, f"margin_{int(c)}")
        margins = {c: F.col(f"margin_{int(c)}") for c in self.ties}
        top = F.greatest(*margins.values()) if len(margins) > 1 else next(iter(margins.values()))
        return out.select(*own, *margins.values(), F.coalesce(*[F.when(m == top, F.lit(c)) for c, m in margins.items()]).alias("prediction"))


def multi_router(train: DataFrame, features: list[str], label: str, weight: str, ties: list[float], trees: int = 300) -> MultiRouter:
    """A router over the classes of ties, which are in the order in which equal margins are settled. A class without rows is never chosen."""
    seen = {r[0] for r in train.select(label).distinct().limit(len(ties) + 1).collect()}
    models = {}
    for c in ties:
        if c in seen and len(seen) > 1:
            m = GBTClassifier(labelCol="__own", weightCol=weight, maxIter=trees, maxDepth=3, stepSize=0.05, seed=0)
            models[c] = Pipeline(stages=[*_assemble(features), m]).fit(train.withColumn("__own", (F.col(label) == c).cast("double")))
    return MultiRouter(models, [c for c in ties if c in seen] or ties[:1])


def logistic_router(train: DataFrame, features: list[str], label: str, weight: str):
    return Pipeline(stages=[*_assemble(features, True), LogisticRegression(labelCol=label, weightCol=weight)]).fit(train)


def abstention(train: DataFrame, features: list[str], outcome: str, trees: int = 300):
    return Pipeline(stages=[*_assemble(features), GBTRegressor(labelCol=outcome, maxIter=trees, maxDepth=3, stepSize=0.05, seed=0)]).fit(train)


def ols(rows: DataFrame, features: list[str], outcome: str):
    """Coefficients, intercept and R² of a least-squares fit."""
    m = Pipeline(stages=[*_assemble(features), LinearRegression(labelCol=outcome, solver="normal")]).fit(rows).stages[-1]
    return list(m.coefficients), m.intercept, m.summary.r2


def ablation(train: DataFrame, test: DataFrame, groups: dict[str, list[str]], label: str, weight: str) -> list[tuple[str, float]]:
    """Accuracy of the logistic router without each feature group."""
    out = []
    for name in ("none", *groups):
        use = [f for g, fs in groups.items() if g != name for f in fs]
        p = logistic_router(train, use, label, weight).transform(test)
        out.append((name, p.agg(F.avg((F.col("prediction") == F.col(label)).cast("double"))).first()[0]))
    return out
