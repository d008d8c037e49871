"""One query for each corpus operator, with the parameters meant for production."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcells.llm import bpe, bpe_automaton, centroids, periodic_runs, pii, sql
from gridcells.llm.common import read_table, scratch_path, texts
from gridcells.llm.decontaminate import find_passages
from gridcells.llm.quality_classifier import score_quality
from gridcells.llm.quality_rules import quality_rules
from gridcells.llm.secret_scan import find_secrets, joined
from gridcells.llm.simhash import near_duplicates
from gridcells.llm.substring_dedup import remove_repeated_passages
from gridcells.llm.url_filters import judge_captures, page_captures, page_list_events
from gridcells.llm.warc import read_archives, write_archives

RANKS = "byte_bpe_multi_50k.tiktoken"
MERGES = "byte_bpe_50k.json"


def n_spans(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")


def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_passages(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_passages(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda n, h: n + h["end"] - h["start"])
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
                      F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
                      (F.size("hits") > 0).alias("contaminated"))


def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    write_archives(read_table(spark, sf_dir, "pages"), folder)
    return read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_secrets(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", *map(n_spans, ("assign", "access", "hex")),
                      F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "model")), 256).alias("base_sha256"),
                      joined(F.col("spans")).alias("spans"))


def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    return bpe.digests(bpe.encode(read_table(spark, sf_dir, "documents"), tokenizers.path(RANKS), tokenizers.PATTERN, and_decode=True))


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find_personal_data(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", *map(n_spans, pii.KINDS[:4]),
                      F.sha2(pii.joined(F.filter("spans", lambda s: s["kind"] != pii.KINDS[4])), 256).alias("base_sha256"),
                      pii.joined(F.col("spans")).alias("spans"))


def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    out = judge_captures(page_captures(pages), page_list_events(pages))
    return out.select(F.col("id").alias("page_id"), "host", "verdict", "pattern", "list_name", "listed_since", "n_active")


def centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.digests(centroids.cluster_vectors(read_table(spark, sf_dir, "embeddings")))


def word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.with_planted_periods(texts(read_table(spark, sf_dir, "documents")))
    return periodic_runs.digests(periodic_runs.find_runs(docs))


def bpe_automaton_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    out = bpe_automaton.encode(read_table(spark, sf_dir, "documents"), tokenizers.path(MERGES), and_decode=True, packed=True)
    return out.select("doc_id", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {
    "op1_substring_dedup": substring_dedup,
    "op2_warc_bundles": warc_bundles,
    "op3_simhash_near_dedup": simhash_near_dedup,
    "op4_url_filters": url_filters,
    "op5_quality_rules": line_quality,
    "op6_secret_scan": secret_scan,
    "op7_byte_bpe": byte_bpe,
    "op8_personal_data": personal_data,
    "op9_decontaminate": decontaminate,
    "op10_quality_classifier": quality_classifier,
    "op11_centroid_clustering": centroid_clustering,
    "op12_periodic_runs": word_runs,
    "op13_bpe_automaton": bpe_automaton_digests,
}
ORACLE: dict[str, str] = {
    "op1_substring_dedup": sql.SUBSTRING_DEDUP,
    "op2_warc_bundles": sql.WARC,
    "op4_url_filters": sql.URL_FILTERS,
    "op5_quality_rules": sql.QUALITY,
    "op9_decontaminate": sql.DECONTAMINATE,
    "op11_centroid_clustering": sql.CENTROIDS,
}
