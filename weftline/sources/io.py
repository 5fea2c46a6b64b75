"""Readers and writers with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_tsv(spark: SparkSession, path: str, schema: T.StructType, header: bool = True) -> DataFrame:
    """Ragged rows keep what fits, and their text in _corrupt_record if the schema has that column."""
    return spark.read.schema(schema).option("sep", "\t").option("header", header).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value): one row a line, numbered inside each file, which is read as one split."""
    whole = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value"))
    return whole


def file_key(path_column: str = "file"):
    """The file name without folder and extension, as a key."""
    return F.regexp_extract(path_column, r"([^/]+?)(?:\.[A-Za-z0-9]+)?$", 1)


def log_pairs(lines: DataFrame) -> DataFrame:
    """(file, line_no, target, output) of a line "target: ..." followed by a line "output: ..."."""
    from pyspark.sql import Window

    nxt = F.lead("value").over(Window.partitionBy("file").orderBy("line_no"))
    p = lines.withColumn("__n", nxt).where(F.col("value").startswith("target:") & F.col("__n").startswith("output:"))
    return p.select("file", "line_no", F.trim(F.substring_index("value", ":", -1)).alias("target"), F.trim(F.regexp_extract("__n", "^output:(.*)$", 1)).alias("output"))


def zip_shards(left: DataFrame, right: DataFrame, strict: bool = False) -> DataFrame:
    """Rows of two (shard, pos, ...) tables side by side; strict fails on a row without its partner."""
    if not strict:
        return left.join(right, ["shard", "pos"])
    j = left.withColumn("__l", F.lit(True)).join(right.withColumn("__r", F.lit(True)), ["shard", "pos"], "full_outer")
    return j.withColumn("__ok", F.assert_true(F.col("__l").isNotNull() & F.col("__r").isNotNull(), "shards differ in length")).where("__ok is null").drop("__l", "__r", "__ok")


def tsv_cells(df: DataFrame) -> DataFrame:
    """Lists joined by semicolons, booleans as 0 and 1, nulls empty: every column as a string."""

    def cell(f):
        c = F.col(f.name)
        if isinstance(f.dataType, T.ArrayType):
            return F.array_join(F.transform(c, lambda x: x.cast("string")), ";")
        return (c.cast("int") if isinstance(f.dataType, T.BooleanType) else c).cast("string")

    return df.select(*[F.coalesce(cell(f), F.lit("")).alias(f.name) for f in df.schema])


def write_tsv(df: DataFrame, path: str) -> None:
    tsv_cells(df).write.option("sep", "\t").option("header", True).csv(path)


def write_jsonl(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    w = df.write.partitionBy(*partition_by) if partition_by else df.write
    w.json(path)


def chunked(df: DataFrame, order: str, size: int = 8000) -> DataFrame:
    """Adds chunk: number of the run of size rows in the given order, counted inside range partitions."""
    from pyspark.sql import Window

    ranged = df.repartitionByRange(F.col(order)).withColumn("__p", F.spark_partition_id())
    counts = {r["__p"]: r["count"] for r in ranged.groupBy("__p").count().collect()}
    start, at = {}, 0
    for p in sorted(counts):
        start[p], at = at, at + counts[p]
    base = F.create_map(*[F.lit(x).cast(t) for p, s in start.items() for x, t in ((p, "int"), (s, "long"))]) if start else F.lit(None)
    n = F.row_number().over(Window.partitionBy("__p").orderBy(order)) - 1
    return ranged.withColumn("chunk", F.floor((F.element_at(base, F.col("__p")) + n) / size)).drop("__p")


def remaining(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The rows of an append-only manifest that are still to do."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def markdown_table(df: DataFrame, most: int = 200) -> str:
    """A small result as a Markdown table; more than most rows are an error, never cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the result has more than {most} rows")
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, rows)])


def markdown_report(parts: list[tuple[str, DataFrame]]) -> str:
    """Titled small results, one below the other."""
    return "\n\n".join(f"## {title}\n\n{markdown_table(df)}" for title, df in parts) + "\n"


def read_objects(spark: SparkSession, folder: str, schema: T.StructType, wanted: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): one JSON object a file, named by its key; wanted keys without a readable file are counted by reason.

    rows has the wanted keys that were read; rejects(reason, n) counts missing and malformed ones.
    """
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    whole = spark.read.option("wholetext", True).text(folder).select(file_key("_metadata.file_path").alias("__file"), "value")
    got = whole.select("__file", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("o"))
    got = got.select("__file", *[F.col(f"o.{f.name}").alias(f.name) for f in schema.fields], F.col("o._corrupt_record").isNotNull().alias("__bad"))
    j = wanted.select(F.col(key).alias("__file")).distinct().join(got, "__file", "left")
    reason = F.when(F.col("__bad").isNull(), "missing").when(F.col("__bad"), "malformed")
    rejects = j.select(reason.alias("reason")).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))
    return j.where("not __bad").drop("__bad").withColumnRenamed("__file", "file_key"), rejects


def read_positional(spark: SparkSession, path: str, names: list[str], header: bool = False, sep: str = "\t") -> tuple[DataFrame, DataFrame]:
    """(rows, ragged): text by position; rows with another number of cells go to ragged(value, cells).

    header: the first line of each file is not data, whatever it says; blank lines are skipped then.
    """
    if header:
        lines = spark.read.schema("value string").option("header", True).option("sep", "\u0001").option("quote", "").csv(path)
    else:
        lines = spark.read.text(path)
    lines = lines.withColumn("__c", F.split("value", sep))
    good = lines.where(F.size("__c") == len(names))
    rows = good.select(*[F.get("__c", F.lit(i)).alias(n) for i, n in enumerate(names)])
    return rows, lines.where(F.size("__c") != len(names)).select("value", F.size("__c").alias("cells"))


def counts_by_folder(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(folder, n): files below a folder, listed by the reader and counted by their parent."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("path")
    return files.groupBy(F.element_at(F.split("path", "/"), -2).alias("folder")).agg(F.count("*").alias("n"))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, v) of .npy matrices, read by Arrow batches of one file; the row is its place in the file."""
    import pyarrow as pa

    def run(batches):
        import io as _io

        import numpy as np

        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                m = np.load(_io.BytesIO(raw), allow_pickle=False)
                m = m.reshape(len(m), -1).astype(np.float32)
                for at in range(0, len(m), 4096):
                    part = m[at : at + 4096]
                    v = pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, max(1, part.shape[1])), pa.int32()), pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(at, at + len(part))), v], names=["file", "row", "v"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, row long, v array<float>")


def write_partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    """One scan to many outputs: a JSON folder for each mode and tier, rows dealt by them first so that each has few files."""
    df.repartition(*by).write.partitionBy(*by).json(path)


def fingerprint(spark: SparkSession, folder: str, *args) -> str:
    """sha256 of the names, sizes and times of the files below a folder and of the arguments, whatever their order of listing.

    Files add their hashes up within tasks, so no task or row holds them all.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", F.unix_micros("modificationTime").alias("t"))
    h = F.sha2(F.concat_ws("|", "path", "length", "t"), 256)
    parts = files.select(*[F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)").alias(f"p{i}") for i in range(4)])
    one = "|".join(map(str, parts.agg(F.count("*"), *[F.sum(c) for c in parts.columns]).first()))
    return spark.range(1).select(F.sha2(F.concat_ws("|", F.lit(one), *[F.lit(repr(a)) for a in args]), 256).alias("h")).first()["h"]


def cached(spark: SparkSession, source: str, cache: str, build, *args) -> DataFrame:
    """The table that build() gives for the files of source, written once for each state of them and the arguments.

    It is written beside its place and renamed, so a reader sees a whole table or none.
    """
    at = f"{cache.rstrip('/')}/{fingerprint(spark, source, *args)}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(at).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(path(at)):
        build().write.mode("overwrite").parquet(at + ".part")
        if not fs.rename(path(at + ".part"), path(at)) and not fs.exists(path(at)):
            raise OSError(f"cannot rename to {at}")
    return spark.read.parquet(at)


def read_config(path: str) -> dict:
    """A YAML file of settings; needs the yaml package."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs the yaml package") from e
    with open(path) as f:
        return yaml.safe_load(f)
