"""The thin queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import codes, decontam, fingerprint, htmlmain, langid, licenses, linededup, mixing, packing, rolling, setjoin, sharding, toxicity
from weftline.llm.common import load


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(load(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_report(load(spark, sf_dir, "documents"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_report(load(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_report(load(spark, sf_dir, "documents"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(load(spark, sf_dir, "documents"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlmain.main_text(load(spark, sf_dir, "pages"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_report(load(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.jaccard_components(load(spark, sf_dir, "documents"), 3, 90, 100)


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.code_report(load(spark, sf_dir, "embeddings"))


def op12_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.rolling_report(load(spark, sf_dir, "documents"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_report(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_language, op3_fingerprints, op4_toxicity, op5_lines, op6_licenses, op7_html, op8_sharding, op9_decontamination, op10_jaccard, op11_codes, op12_rolling, op13_packing)}

JACCARD_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, least(len(w), 1)) + 1)) AS i FROM t)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 90 * (a.n + b.n - o)),
r AS (SELECT x AS doc_id, x AS c FROM (SELECT DISTINCT x FROM e) UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id WHERE r.c < e.y)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, least(t.doc_id, coalesce(m.c, t.doc_id)) AS component_id
FROM t LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m USING (doc_id)
"""

ORACLES = {"op1_mixing": mixing.MIX_SQL, "op9_decontamination": decontam.DECONTAM_SQL, "op10_jaccard": JACCARD_SQL, "op11_codes": codes.CODES_SQL, "op12_rolling": rolling.ROLLING_SQL}
