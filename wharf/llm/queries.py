"""Registered queries of the corpus operators: each applies its operator with
production parameters to the whole table and derives the digest columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wharf.llm import pii
from wharf.llm.common import table
from wharf.llm.decontam import find_contaminated
from wharf.llm.exact_dedup import exact_dedup
from wharf.llm.license_scan import scan_licenses
from wharf.llm.mixing import mix
from wharf.llm.packing import pack
from wharf.llm.periodic_runs import find_periodic_runs
from wharf.llm.quality import score_quality
from wharf.llm.simhash import hexed, near_duplicates
from wharf.llm.substring_dedup import remove_repeats
from wharf.llm.toxicity import score_toxicity
from wharf.llm.url_filter import filter_urls, labelled_table
from wharf.llm.whitening import whiten


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[pii.n_of(k).alias(f"n_{k}") for k in pii.KINDS],
                        F.sha2(pii.written("base"), 256).alias("base_sha256"), pii.written("spans").alias("spans"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), labelled_table(spark))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(table(spark, sf_dir, "documents"), hash_all=True)
    return out.withColumnRenamed("full_hash", "text_sha256")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", hexed().alias("fingerprint"), "component_id")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id, text; with h = crc32(doc_id) divisible by 10, words from h' % n on repeat the first p of them.

    h' is h / 10, p is 1 + floor((n - a) / (3 + h' % 8)). A null doc_id has no h.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words):
        n = F.size(words)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: words[
            F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int")]), " ")

    # The words are bound once, as the element of a one-element array.
    words = F.array(F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))
    text = F.transform(words, lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(F.lit("")))[0]
    return docs.select("doc_id", F.when(F.pmod(h, F.lit(10)) == 0, text).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_periodic_runs(planted(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.col("strongest")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[best[c].alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


LLM_QUERIES = {f.__name__: f for f in (
    op1_pii, op2_url_filter, op3_exact_dedup, op4_decontamination, op5_license_scan, op6_toxicity,
    op7_quality, op8_substring_dedup, op9_mixing, op10_simhash, op11_periodic_runs, op12_packing,
    op13_whitening)}

LLM_ORACLES = {
    "op3_exact_dedup": """
        WITH lowered AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                     'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
        FROM lowered WINDOW same AS (PARTITION BY norm)""",
}
