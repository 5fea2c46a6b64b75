"""Evaluation statistics as aggregates and windows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.ranges import at_ranks, running


def micro_macro(rows: DataFrame, group: str, value: str) -> DataFrame:
    """One row: n, micro mean, groups, macro mean (mean of group means) and the size-weighted mean of group means."""
    g = rows.groupBy(group).agg(F.avg(value).alias("m"), F.count(value).alias("n"), F.sum(value).alias("s"))
    return g.agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("micro"), F.count("*").alias("groups"), F.avg("m").alias("macro"), (F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("weighted"))


def upper_median(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, upper_median): sorted[n // 2] of each group's values."""
    return at_ranks(rows, group, value, {"upper_median": F.floor(F.col("n") / 2) + 1})


def nearest_rank(rows: DataFrame, group: str, value: str, shares: list[float]) -> DataFrame:
    """Per group sorted[min(n - 1, int(q n))] for each share q, from counts of distinct values."""
    return at_ranks(rows, group, value, {f"p{round(q * 100)}": F.least(F.col("n") - 1, F.floor(F.lit(q) * F.col("n"))) + 1 for q in shares})


def ranked_curve(rows: DataFrame, score: str, outcome: str, tie: str) -> DataFrame:
    """Rows with i, their place by falling score (equal ones by tie), and kept, risk and gain: the outcomes up to and with the row, their mean loss and sum."""
    r = rows.select(score, outcome, tie)
    known = F.when(F.col(outcome).isNotNull(), 1)
    c = running(r, [F.desc(score), tie], {"kept": known, "gain": F.col(outcome).cast("double")})
    return c.withColumn("risk", 1.0 - F.try_divide("gain", "kept"))


#: How many of n rows a share c keeps: the nearest whole number (halves to even), the whole part, or whole per cents of n.
CUTS = {
    "round": lambda n, c: F.bround(n * F.lit(c)),
    "int": lambda n, c: F.floor(n * F.lit(c)),
    "percent": lambda n, c: F.floor(n * F.lit(round(c * 100)) / 100),
}


def selective(rows: DataFrame, score: str, outcome: str, tie: str, shares: list[float], cut: str = "int") -> DataFrame:
    """(share, kept, mean): mean outcome of the best-scored rows that each share keeps by a rule of CUTS, one row at least."""
    at = F.explode(F.array(*[F.struct(F.lit(c).alias("share"), F.greatest(CUTS[cut](F.col("n"), c).cast("long"), F.lit(1)).alias("k")) for c in shares]))
    cuts = rows.agg(F.count("*").alias("n")).select(at.alias("c")).select("c.*")  # a row for each share
    j = ranked_curve(rows, score, outcome, tie).join(F.broadcast(cuts), F.col("i") == F.col("k"))
    return j.select("share", F.col("i").alias("kept"), F.try_divide("gain", "kept").alias("mean"))


def aurc(rows: DataFrame, score: str, outcome: str, tie: str) -> DataFrame:
    """Area under the risk-coverage curve: the mean of running risks, best scores first."""
    return ranked_curve(rows, score, outcome, tie).agg(F.avg("risk").alias("aurc"), F.count("*").alias("n"))


def ece(rows: DataFrame, conf: str, outcome: str, bins: int = 10) -> DataFrame:
    b = rows.groupBy(F.least(F.floor(F.col(conf) * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.avg(conf).alias("c"), F.avg(outcome).alias("a"))
    return b.agg((F.sum(F.abs(F.col("c") - F.col("a")) * F.col("n")) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def auc(rows: DataFrame, score: str, outcome: str) -> DataFrame:
    """Mann-Whitney, ties half: scores are first counted, so the running sum has a row for each distinct score."""
    s = rows.groupBy(score).agg(F.sum(F.when(F.col(outcome) == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(outcome) == 1, 0).otherwise(1)).alias("q"))
    below = F.coalesce(F.sum("q").over(Window.partitionBy(F.lit(1)).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = s.withColumn("u", F.col("p") * (2 * below + F.col("q")))
    return s.agg(F.sum("u").alias("twice_u"), F.sum("p").alias("pos"), F.sum("q").alias("neg"), F.try_divide(F.sum("u"), 2.0 * F.sum("p") * F.sum("q")).alias("auc"))


def erfc(x: Column) -> Column:
    """The complementary error function to some 14 digits: below 2 by the series of erf, above by its continued fraction."""
    z = F.abs(x.cast("double"))
    term = F.lit(0.0)
    for k in range(50, 0, -1):  # 2z/sqrt(pi) exp(-z²) (1 + 2z²/3 (1 + 2z²/5 (1 + ...)))
        term = (1.0 + term) * (2.0 * z * z / (2 * k + 1))
    near = 1.0 - 2.0 / math.sqrt(math.pi) * z * F.exp(-z * z) * (1.0 + term)
    rest = F.lit(0.0)
    for k in range(60, 0, -1):
        rest = (k / 2.0) / (z + rest)
    far = F.exp(-z * z) / math.sqrt(math.pi) / (z + rest)
    tail = F.when(z < 2.0, near).otherwise(far)
    return F.when(x < 0, 2.0 - tail).otherwise(tail)


def chi2_tail(chi2: Column) -> Column:
    """Probability that chi-squared with one degree of freedom is at least this."""
    return erfc(F.sqrt(chi2 / 2.0))


def mcnemar(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Discordant counts, chi-squared with continuity correction and its p-value (1 without discordant rows)."""
    only = lambda x, y: F.count_if((F.col(x) == 1) & (F.col(y) == 0))
    r = rows.agg(only(a, b).alias("only_a"), only(b, a).alias("only_b"), F.count_if((F.col(a) == 1) & (F.col(b) == 1)).alias("both"), F.count_if((F.col(a) == 0) & (F.col(b) == 0)).alias("neither"))
    n = F.col("only_a") + F.col("only_b")
    r = r.withColumn("chi2", F.when(n > 0, F.pow((F.abs(F.col("only_a") - F.col("only_b")) - 1).cast("double"), F.lit(2.0)) / n).otherwise(0.0))
    return r.withColumn("p_value", F.when(n > 0, chi2_tail(F.col("chi2"))).otherwise(1.0))


def bootstrap_means(groups: DataFrame, key: str, value: str, reps: int, seed: int = 42) -> DataFrame:
    """(rep, mean): group means resampled with replacement; the draw i of a repetition takes group number hash(seed, rep, i) mod n.

    groups is one row a group (pre-aggregated), so the product with reps stays small.
    """
    n = groups.count()
    numbered = groups.select(F.col(value).alias("v"), (F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(key)) - 1).alias("g"))
    spark = groups.sparkSession
    draw = spark.range(reps).select(F.col("id").alias("rep"), F.explode(F.sequence(F.lit(0), F.lit(max(n - 1, 0)))).alias("i"))
    pick = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "rep", "i").cast("binary")), 1, 12), 16, 10).cast("long") % max(n, 1)
    return draw.withColumn("g", pick).join(numbered, "g").groupBy("rep").agg(F.avg("v").alias("mean"))


#: Of 65,536 equally likely draws, those that give a Poisson weight (of mean 1) of at least 1, 2, ...
POISSON = [round(65536 * (1 - sum(math.exp(-1) / math.factorial(j) for j in range(k)))) for k in range(1, 9)]


def bootstrap_rows(rows: DataFrame, key: str, value: str, reps: int, seed: int = 42) -> DataFrame:
    """(rep, mean): means of reps resamples of rows, in one pass.

    A row weighs in each repetition a Poisson number of mean 1, drawn by eight repetitions from one hash of (seed, key, block): the
    limit of drawing rows with replacement. Weighted sums are added up within tasks, so reps rows leave each.
    """
    block = F.explode(F.sequence(F.lit(0), F.lit((reps - 1) // 8))).alias("b")
    r = rows.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(value).cast("double").alias("v"), block)
    h = F.md5(F.concat_ws(":", F.lit(seed), "k", "b").cast("binary"))
    r = r.select("v", "b", h.alias("h")).select("v", "b", "h", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("j"))
    u = F.conv(F.substring(F.col("h"), F.col("j") * 4 + 1, F.lit(4)), 16, 10).cast("int")
    w = sum((F.when(u < t, 1).otherwise(0) for t in POISSON), F.lit(0))
    r = r.select((F.col("b") * 8 + F.col("j")).alias("rep"), "v", w.alias("w")).where(F.col("rep") < reps)
    return r.groupBy("rep").agg(F.try_divide(F.sum(F.col("w") * F.col("v")), F.sum("w")).alias("mean"))


def paired_bootstrap(rows: DataFrame, group: str, a: str, b: str, reps: int = 10_000, seed: int = 0) -> DataFrame:
    """One row: the mean over groups of (mean a - mean b), its interval, and groups of a positive difference.

    The interval's ends are the sorted resampled means at places reps / 40 and reps - reps / 40 - 1, counted from 0 (250 and 9749 of
    10,000). Only group differences and the reps means are numbered or sorted.
    """
    d = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(group).agg((F.avg(a) - F.avg(b)).alias("d"))
    means = F.sort_array(F.collect_list("mean"))
    low = reps // 40
    ends = bootstrap_means(d, group, "d", reps, seed).agg(means.alias("m")).select(F.get("m", F.lit(low)).alias("low"), F.get("m", F.lit(reps - low - 1)).alias("high"))
    top = d.agg(F.avg("d").alias("delta"), F.count_if(F.col("d") > 0).alias("higher"), F.count("*").alias("groups"))
    return top.join(F.broadcast(ends))


def interval(means: DataFrame, low: float = 0.025, high: float = 0.975) -> DataFrame:
    return means.agg(F.count("*").alias("reps"), F.percentile("mean", F.lit(low)).alias("low"), F.percentile("mean", F.lit(high)).alias("high"))


def routing(rows: DataFrame, a: str, b: str, take_a: Column) -> DataFrame:
    """One row on a choice between two scores: n, shares of rows that prefer a, prefer b and tie, accuracy over all rows (a tie is right) and over contested ones, and mean regret."""
    x, y = F.col(a), F.col(b)
    right = F.when(x != y, take_a == (x > y)).otherwise(True)
    share = lambda c: F.avg(c.cast("double"))
    contested = F.coalesce(F.avg(F.when(x != y, right.cast("double"))), F.lit(0.0))
    regret = F.avg(F.greatest(x, y) - F.when(take_a, x).otherwise(y))
    return rows.agg(F.count("*").alias("n"), share(x > y).alias("prefers_a"), share(y > x).alias("prefers_b"), share(x == y).alias("ties"), share(right).alias("accuracy"), contested.alias("contested"), regret.alias("regret"))


def complementarity(rows: DataFrame, a: str, b: str, pred_a: str, pred_b: str) -> DataFrame:
    """One row: exact rows (a score of 1) of both and of one only, wins by more than 1e-9 and ties, rows of the same prediction (null equals null), and the means of a, b and the better one."""
    x, y = F.col(a), F.col(b)
    n = lambda c: F.count_if(c)
    return rows.agg(
        F.count("*").alias("n"), n((x == 1) & (y == 1)).alias("both"), n((x == 1) & (y != 1)).alias("only_a"), n((x != 1) & (y == 1)).alias("only_b"),
        n(x > y + 1e-9).alias("a_wins"), n(y > x + 1e-9).alias("b_wins"), n(F.abs(x - y) <= 1e-9).alias("ties"),
        n(F.col(pred_a).eqNullSafe(F.col(pred_b))).alias("same_prediction"), F.avg(x).alias("mean_a"), F.avg(y).alias("mean_b"), F.avg(F.greatest(x, y)).alias("oracle"),
    )


def relative_lift(runs: DataFrame, order: str, value: str) -> DataFrame:
    """Adds lift, in per cent of the first run's value, and its label: (base), +x.x%, -x.x%, or N/A where the base is not above 0."""
    base = runs.agg(F.min_by(value, order).alias("__base"), F.min(order).alias("__first"))  # one row
    j = runs.join(F.broadcast(base))
    first = F.col(order) == F.col("__first")
    lift = F.when(F.col("__base") > 0, 100.0 * (F.col(value) - F.col("__base")) / F.col("__base"))
    sign = F.when(lift >= 0, "+").otherwise("")
    label = F.when(first, "(base)").when(lift.isNull(), "N/A").otherwise(F.concat(sign, F.format_string("%.1f", lift), F.lit("%")))
    return j.select(*runs.columns, F.when(~first, lift).alias("lift"), label.alias("label"))


def threshold_sweep(rows: DataFrame, sim: str, if_over: str, otherwise: str, grid: list[float]) -> DataFrame:
    """(tau, n, mean): mean outcome when rows with sim >= tau take one arm and the rest the other."""
    g = rows.withColumn("tau", F.explode(F.array(*map(F.lit, grid))))
    return g.groupBy("tau").agg(F.count("*").alias("n"), F.avg(F.when(F.col(sim) >= F.col("tau"), F.col(if_over)).otherwise(F.col(otherwise))).alias("mean"))
