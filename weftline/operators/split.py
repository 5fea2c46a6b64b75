"""Leakage-controlled splits: keep-first dedup, reject reasons, families, duplicate builds, guards."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds, or null."""
    return F.coalesce(*[F.when(c, F.lit(name)) for name, c in rules])


def all_reasons(rules: list[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules]))


def size_filter(rows: DataFrame, group: str, least: int, held_out: Column, least_held_out: int) -> DataFrame:
    """Rows of groups with enough rows; groups whose rows are held out need fewer."""
    w = Window.partitionBy(group)
    return rows.withColumn("__n", F.count("*").over(w)).where(F.col("__n") >= F.when(held_out, least_held_out).otherwise(least)).drop("__n")


def role_of(package: Column, lists: dict[str, list[str]], rest: str) -> Column:
    """The first role whose list has the package, or rest."""
    return F.coalesce(*[F.when(package.isin(names), F.lit(role)) for role, names in lists.items()], F.lit(rest))


def repaired_roles(members: DataFrame, family: str, role: str, far: str, near: str, pool: str, val: str) -> DataFrame:
    """Adds new_role and warning: a far role whose family has members in the training pool becomes near.

    A family with both a validation and a far or near member gets a warning and no change. Null families stand alone.
    """
    w = Window.partitionBy(family)
    has = lambda r: F.bool_or(F.col(role) == r).over(w) & F.col(family).isNotNull()
    moved = has(far) & has(pool)
    warn = F.when(moved, "far_with_pool").when(has(val) & (has(far) | has(near)), "val_with_test")
    return members.withColumns({"new_role": F.when(moved & (F.col(role) == far), near).otherwise(F.col(role)), "warning": warn})


def policy(rows: DataFrame, tier: str, body: str, name: str, exported: Column, order: list[str], train: str = "train") -> DataFrame:
    """Adds outcome: training rows keep the first of each (body, name), others lose bodies seen in train, then exported ones.

    Outcomes are kept, duplicate, body_in_train and in_dynsym; nothing is removed, so the dropped set stays for strata.
    """
    seen = rows.where(F.col(tier) == train).select(F.col(body).alias("__b")).distinct().withColumn("__seen", F.lit(True))
    j = rows.join(seen, F.col(body) == F.col("__b"), "left").drop("__b")
    first = F.row_number().over(Window.partitionBy(tier, body, name).orderBy(*order))
    is_train = F.col(tier) == train
    out = F.when(is_train & (first > 1), "duplicate").when(~is_train & F.col("__seen"), "body_in_train").when(~is_train & exported, "in_dynsym").otherwise("kept")
    return j.withColumn("outcome", out).drop("__seen")


def policy_counts(judged: DataFrame, tier: str) -> DataFrame:
    """Per tier: raw, body, dynsym, duplicate and scored rows, which add up."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    return judged.groupBy(tier).agg(F.count("*").alias("raw"), n("body_in_train").alias("body"), n("in_dynsym").alias("dynsym"), n("duplicate").alias("duplicate"), n("kept").alias("scored"))


def guarded(assignments: DataFrame, ids: DataFrame, key: str, tier: str, bypass: str | None = None) -> DataFrame:
    """(key, tier) of the ids; raises ValueError on an id in two tiers, and on unassigned ones unless bypass names their tier."""
    twice = assignments.groupBy(key).agg(F.count_distinct(tier).alias("n")).where("n > 1").select(key, F.lit("overlap").alias("problem"))
    lone = ids.select(key).distinct().join(assignments.select(key), key, "left_anti").select(key, F.lit("unassigned").alias("problem"))
    bad = twice if bypass else twice.unionByName(lone)
    worst = bad.groupBy("problem").agg(F.count("*").alias("n"), F.min(key).alias("first")).collect()
    if worst:
        raise ValueError("; ".join(f"{r['n']} {r['problem']}, first {r['first']}" for r in worst))
    one = assignments.groupBy(key).agg(F.min(tier).alias(tier))
    j = ids.select(key).distinct().join(one, key, "left")
    return j.withColumn(tier, F.coalesce(tier, F.lit(bypass))) if bypass else j


def leakage(train: DataFrame, test: DataFrame, group: str, name: str, body: str, tokens: str, min_tokens: int = 10) -> DataFrame:
    """Per group of the test rows: n, names seen in train, bodies (of min_tokens at least) seen, both seen together."""
    names = train.select(F.col(name)).distinct().withColumn("s_name", F.lit(True))
    bodies = train.where(F.col(tokens) >= min_tokens).select(F.col(body)).distinct().withColumn("s_body", F.lit(True))
    both = train.select(name, body).distinct().withColumn("s_both", F.lit(True))
    t = test.join(names, name, "left").join(bodies, body, "left").join(both, [name, body], "left")
    big = F.col(tokens) >= min_tokens
    return t.groupBy(group).agg(F.count("*").alias("n"), F.count_if("s_name").alias("seen_name"), F.count_if(big & F.col("s_body")).alias("seen_body"), F.count_if("s_both").alias("seen_both"))


def leakage_table(train: DataFrame, test: DataFrame, group: str, name: str, body: str, tokens: str, exported: str, aliases: str | None = None, min_tokens: int = 10) -> DataFrame:
    """Per group of the test rows, in per cent to one digit: names (or one of their aliases) seen in training, bodies seen among those of min_tokens at least, names and bodies seen together, and exported rows.

    Training names are their aliases too. Seen names and bodies are joined by equality; rows of the test side are told apart by a number.
    """
    known = train.select(F.col(name).alias("__a"))
    test = test.withColumn("__id", F.monotonically_increasing_id())
    asked = test.select("__id", F.col(name).alias("__a"))
    if aliases:
        known = known.union(train.select(F.explode(aliases)))
        asked = asked.union(test.select("__id", F.explode(aliases)))
    named = asked.join(known.distinct(), "__a", "left_semi").select("__id").distinct().withColumn("__named", F.lit(True))
    bodies = train.where(F.col(tokens) >= min_tokens).select(F.col(body)).distinct().withColumn("__body", F.lit(True))
    both = train.select(name, body).distinct().withColumn("__both", F.lit(True))
    t = test.join(named, "__id", "left").join(bodies, body, "left").join(both, [name, body], "left")
    big = F.col(tokens) >= min_tokens
    share = lambda c, n: F.round(100.0 * F.count_if(c) / F.greatest(n, F.lit(1)), 1)
    n = F.count("*")
    return t.groupBy(group).agg(n.alias("n"), share(F.col("__named"), n).alias("name_pct"), share(big & F.col("__body"), F.count_if(big)).alias("body_pct"), share(F.col("__both"), n).alias("name_and_body_pct"), share(F.col(exported), n).alias("exported_pct"))


def build_identity(functions: DataFrame, program: str, opt: str, name: str, body: str, tokens: str, order: str, min_tokens: int = 10) -> DataFrame:
    """(program, opt1, opt2, n_shared, same, n_big, same_big): for each two builds of a program, functions of one name and how many have one body.

    big pairs have min_tokens on a side at least. Of several functions of a name in a build the first in order counts, of equal ones the smallest body. Builds that share no
    name have zeros. Builds meet by (program, name), so only names that both have make rows.
    """
    one = functions.groupBy(program, opt, name).agg(F.min_by(F.struct(F.col(body).alias("b"), F.col(tokens).alias("t")), F.struct(order, body, tokens)).alias("f"))
    builds = functions.select(program, opt).distinct()
    pairs = builds.withColumnRenamed(opt, "opt1").join(builds.withColumnRenamed(opt, "opt2"), program).where("opt1 < opt2")
    a = one.select(program, name, F.col(opt).alias("opt1"), F.col("f").alias("x"))
    b = one.select(program, name, F.col(opt).alias("opt2"), F.col("f").alias("y"))
    same, big = F.col("x.b") == F.col("y.b"), F.greatest("x.t", "y.t") >= min_tokens
    met = a.join(b, [program, name]).where("opt1 < opt2").groupBy(program, "opt1", "opt2").agg(F.count("*").alias("n_shared"), F.count_if(same).alias("same"), F.count_if(big).alias("n_big"), F.count_if(same & big).alias("same_big"))
    return pairs.join(met, [program, "opt1", "opt2"], "left").na.fill(0, ["n_shared", "same", "n_big", "same_big"])


def identity_by_levels(pairs: DataFrame) -> DataFrame:
    """(opt1, opt2, n, median, high, half): over pairs that share a name, the share of equal bodies: median, greatest, and pairs of a half at least."""
    share = F.col("same") / F.col("n_shared")
    return pairs.where("n_shared > 0").groupBy("opt1", "opt2").agg(F.count("*").alias("n"), F.percentile(share, F.lit(0.5)).alias("median"), F.max(share).alias("high"), F.count_if(share >= 0.5).alias("half"))


def violations(assignments: DataFrame, ids: DataFrame, key: str, tier: str) -> DataFrame:
    """(key, problem): ids in two tiers, without one, or assigned but unknown."""
    tiers = assignments.groupBy(key).agg(F.count_distinct(tier).alias("n"))
    j = ids.select(key).distinct().withColumn("known", F.lit(True)).join(tiers, key, "full_outer")
    why = F.when(F.col("known").isNull(), "phantom").when(F.col("n").isNull(), "unassigned").when(F.col("n") > 1, "overlap")
    return j.select(key, why.alias("problem")).where("problem is not null")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of edges(a, b): the smallest node that each node reaches. Nulls are dropped; a loop is a node by itself.

    Edges are drawn to smaller nodes in two steps a round: every node hands its larger neighbours its smallest one, then its smaller neighbours
    and itself. Stars are left, after some log of the longest path; a round is known to change nothing by a count and
    a sum of hashes of its edges.
    """
    e = edges.where("a is not null and b is not null").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    every = _cut(e)
    e = _cut(every.where("u <> v"))
    mark = _mark(e)
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low"))
        e = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        low = e.groupBy("u").agg(F.min("v").alias("low"))
        down = e.join(low, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        e = _cut(down.unionByName(low.select("u", F.col("low").alias("v"))).distinct())
        now = _mark(e)
        if now == mark:
            nodes = every.select(F.explode(F.array("u", "v")).alias("node")).distinct()
            lead = e.select(F.col("u").alias("node"), F.col("v").alias("lead"))
            return nodes.join(lead, "node", "left").select("node", F.coalesce("lead", "node").alias("component"))
        mark = now
    raise RuntimeError("components did not settle")


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


_OWN: dict[str, str] = {}


def _shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names or the context has; a temporary one only where both are unset and the master is local."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        import tempfile

        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="weftline-")
    return _OWN[app]


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _cut(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Cuts lineage by a Parquet table in the shared folder: it survives lost executors, is compressed, and later plans read only their columns."""
    return _cut_all(df.sparkSession, [df], codec)


def _cut_all(spark: SparkSession, parts: Iterable[DataFrame], codec: str | None = None) -> DataFrame:
    """Frames of one schema as one table, written one after the other.

    What was shuffled for a frame is deleted once it is written, since nothing reads it again.
    """
    path, schema = f"{_shared_dir(spark)}/cut-{uuid.uuid4().hex}", None
    was = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        for df in parts:
            write = df.write.mode("append")
            (write.option("compression", codec) if codec else write).parquet(path)
            schema = df.schema
    finally:
        spark.conf.unset(_CLEAN) if was is None else spark.conf.set(_CLEAN, was)
    return spark.read.schema(schema).parquet(path)


def contained_builds(rows: DataFrame, least: float, min_total: int, among: DataFrame | None = None) -> DataFrame:
    """(program, build, in_build): builds of which a share of least of the multiset lies in an earlier build of their program (of among, if given).

    rows(program, build, tok, cnt), one row a token. Tokens go in order of the builds that hold them. An earlier build without any of a
    build's first tokens, before which more than 1 - least of it lies, cannot hold enough of it, so only those are joined.
    """
    group = ["program", "build"]
    held = (rows if among is None else among).select("program", F.col("build").alias("in_build"), "tok", F.col("cnt").alias("k"))
    cand = _first_tokens(rows, least, min_total, among).select(*group, "tok", "n").join(held, ["program", "tok"]).where("in_build < build").select(*group, "in_build", "n").distinct()
    inter = cand.join(rows, group).join(held, ["program", "in_build", "tok"]).groupBy(*group, "in_build", "n").agg(F.sum(F.least("cnt", "k")).alias("inter"))
    return inter.where(F.col("inter") / F.greatest("n", F.lit(1)) >= least).select(*group, "in_build")


def _first_tokens(rows: DataFrame, least: float, min_total: int, among: DataFrame | None = None) -> DataFrame:
    """The first tokens of builds that others hold too, with n, the size of their build, and df, the builds that hold them."""
    group = ["program", "build"]
    df = (rows if among is None else among).groupBy("program", "tok").agg(F.count("*").alias("df"))
    upto = Window.partitionBy(*group).orderBy("df", "tok").rowsBetween(Window.unboundedPreceding, -1)
    r = rows.join(df, ["program", "tok"], "left").withColumn("df", F.coalesce("df", F.lit(0)))
    r = r.withColumns({"n": F.sum("cnt").over(Window.partitionBy(*group)), "before": F.coalesce(F.sum("cnt").over(upto), F.lit(0))})
    return r.where((F.col("n") >= min_total) & (F.col("df") > (1 if among is None else 0)) & ((F.col("n") - F.col("before")) / F.greatest("n", F.lit(1)) >= least))


def duplicate_builds(rows: DataFrame, least: float = 0.95, min_total: int = 1) -> DataFrame:
    """(program, build, kept): a build is dropped if least of its multiset of hashes lies in one kept before it.

    rows(program, build, tok, cnt). Builds of equal multisets (by 126 bits of summed hashes) are one class, which its first build decides: the
    others lie in it, or where it does. A build of which all containing builds are decided is decided: each round decides the first
    undecided build of every program at least, mostly all but long chains, by joins.
    """
    group = ["program", "build"]
    # The hash of a multiset is the sum of its elements' hashes, so lines need no count of their own first.
    part = lambda seed: F.sum(F.shiftrightunsigned(F.xxhash64("tok", F.lit(seed)), 22).cast("decimal(14,0)") * F.col("cnt").cast("decimal(19,0)"))
    same = _cut(rows.groupBy(*group).agg(*[part(i).alias(f"h{i}") for i in range(3)], F.sum("cnt").alias("n")))
    kind = ["program", "h0", "h1", "h2", "n"]
    builds = _cut(same.join(same.groupBy(*kind).agg(F.min("build").alias("first")), kind).select(*group, "n", "first"))
    lead = builds.where("build = first").select(*group)
    rows = _cut(rows.join(lead, group, "left_semi").groupBy(*group, "tok").agg(F.sum("cnt").alias("cnt")))
    decided = _first_builds(rows, least, min_total).withColumnRenamed("build", "first")
    copy = (F.col("build") > F.col("first")) & (F.col("n") >= min_total) & (F.lit(least) <= 1.0)
    return builds.join(decided, ["program", "first"]).select(*group, (F.col("kept") & ~copy).alias("kept"))


#: Pairs of a token's lines beyond which (for each line) builds are decided by batches, and builds of a program in the first batch.
DENSE, BATCH = 20, 64


def _first_builds(rows: DataFrame, least: float, min_total: int) -> DataFrame:
    """(program, build, kept), by all containments at once, or by batches where builds share so many tokens that their pairs grow with the square.

    A batch holds the first undecided builds of every program. It is decided by itself, and later builds that lie in those it keeps are
    dropped before the next one, of twice as many. So builds meet those that are kept, mostly few, and those of their batch.
    """
    met = _first_tokens(rows, least, min_total).agg(F.sum("df")).first()[0] or 0
    if met <= DENSE * rows.count():
        return _greedy(rows, least, min_total)
    group, size, done = ["program", "build"], BATCH, None
    while not rows.isEmpty():
        at = F.row_number().over(Window.partitionBy("program").orderBy("build"))
        order = _cut(rows.select(*group).distinct().withColumn("at", at))
        now, later = (rows.join(order.where(c).select(*group), group, "left_semi") for c in (F.col("at") <= size, F.col("at") > size))
        decided = _cut(_greedy(now, least, min_total))
        kept = now.join(decided.where("kept").select(*group), group, "left_semi")
        gone = _cut(contained_builds(later, least, min_total, kept).select(*group).distinct())
        part = decided.unionByName(gone.withColumn("kept", F.lit(False)))
        done = part if done is None else done.unionByName(part)
        rows, size = _cut(later.join(gone, group, "left_anti")), 2 * size
    return done


def _greedy(rows: DataFrame, least: float, min_total: int) -> DataFrame:
    group = ["program", "build"]
    builds = rows.select(*group).distinct()
    open_ = _cut(contained_builds(rows, least, min_total))
    dropped = None
    while not open_.isEmpty():
        undecided = open_.select(*group).distinct()
        kept = builds.join(undecided, group, "left_anti")
        kept = kept if dropped is None else kept.join(dropped, group, "left_anti")
        now = open_.join(kept.select("program", F.col("build").alias("in_build")), ["program", "in_build"], "left_semi").select(*group).distinct()
        dropped = _cut(now if dropped is None else dropped.unionByName(now))
        gone = dropped.select("program", F.col("build").alias("in_build"))
        open_ = _cut(open_.join(dropped, group, "left_anti").join(gone, ["program", "in_build"], "left_anti"))
    if dropped is None:
        return builds.withColumn("kept", F.lit(True))
    return builds.join(dropped.withColumn("d", F.lit(True)), group, "left").select(*group, F.col("d").isNull().alias("kept"))


def capped_sample(rows: DataFrame, group: str, key: str, n: int, seed: int) -> DataFrame:
    """n rows of each group at most, without replacement, in the order of a seeded hash."""
    u = F.md5(F.concat_ws(":", F.col(key), F.lit(seed)).cast("binary"))
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(u, key))).where(F.col("__r") <= n).drop("__r")
