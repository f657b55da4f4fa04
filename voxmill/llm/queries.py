"""The registered corpus queries, one for each operator, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.llm import bpe, ctph, decontaminate, htmlmain, pii, simhash, suffixes, toxicity, unitdedup, wavelet
from voxmill.llm.common import table

#: The vocabulary file of the registered queries.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def spans_text(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_email to n_phone count the spans of the patterns, as base_sha256 digests them; n_added counts the others."""
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    of_kind = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    counts = [of_kind(k).alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"), (F.size("spans") - F.size(base)).cast("long").alias("n_added"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    grammar = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, grammar).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op5_ctph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctph.compare_neighbours(table(spark, sf_dir, "documents"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = htmlmain.extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["stop"] - r["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = wavelet.write_shards(table(spark, sf_dir, "documents"), TOKENIZER)
    return wavelet.read_shards(files, digest_only=True)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_decode(docs, TOKENIZER).drop("text")
    return coded.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = unitdedup.remove_repeats(table(spark, sf_dir, "documents"))
    spans = F.concat_ws(",", F.transform("removed", lambda r: F.concat_ws(":", r["start"].cast("string"), r["stop"].cast("string"))))
    kept_in = F.coalesce(F.transform("removed", lambda r: r["kept_in"]), F.array().cast("array<long>"))
    return found.select("doc_id", F.size(kept_in).cast("long").alias("n_removed"), spans.alias("removed_spans"), kept_in.alias("kept_in"), F.length("kept_text").cast("long").alias("n_chars_kept"), F.sha2("kept_text", 256).alias("kept_sha256"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_pii, op2_simhash, op3_decontaminate, op4_toxicity, op5_ctph, op6_html, op7_suffixes, op8_wavelet, op9_bpe, op10_line_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op3_decontaminate": decontaminate.ORACLE}
