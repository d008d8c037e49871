"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

1. quality rules: rejected documents go, and failing lines go from the others;
2. SimHash near-dedup: of each group the document with the smallest id stays;
3. benchmark decontamination: benchmark passages are cut out of the texts;
4. secret scans: found secrets are replaced by a mark;
5. byte-level BPE: texts become token ids, which are decoded again to check them.

All stages but the last return the columns of their input (``n_chars`` follows a changed text).
A null or empty text is rejected by the first stage, so later stages meet none from here; each of them
takes them all the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcells.llm import bpe
from gridcells.llm.common import drop_path, read_table, scratch_path
from gridcells.llm.decontaminate import remove_passages
from gridcells.llm.quality_rules import keep_good
from gridcells.llm.secret_scan import redact
from gridcells.llm.simhash import keep_one


# Workers of earlier stages stay beside those that encode, so these remember less and forget after each task.
TOKEN_MEMORY = bpe.Memory(matches=200_000, pairs=100_000, texts=1 << 20, release=True)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs, shingle=3, max_bits=2)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove_passages(docs, read_table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids``, and the digest of the decoded bytes."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = bpe.encode(docs, ranks, public_tokenizers.PATTERN, and_decode=True, memory=TOKEN_MEMORY)
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality rules", quality), ("simhash near-dedup", near_dedup), ("benchmark decontamination", decontaminate),
          ("secret scans", secrets), ("byte-level bpe", tokens)]

#: Fingerprints, the character models and BPE are beyond SQL; tests/llm/test_pipeline.py has a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, beginning with the table of documents.  A stage's files go when the next one is written."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            drop_path(spark, before)
        before = path
    return docs
