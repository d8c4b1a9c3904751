"""Corpus preparation: five stages, each an operator of ``ashlar.llm`` on all that its predecessor kept.

Every function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
``run`` applies them to ``documents``, writing each stage's rows to the shared folder and reading them again, so that a
lost executor costs one stage's tasks at most.  A stage's own tables go once its rows are written, and those once the next stage's are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ashlar.llm import _common as C
from ashlar.llm import bpe, linededup, mixing, neardup, quality

RANKS = "byte_bpe_multi_50k.tiktoken"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the document rules, or whose host (source) does, go."""
    name = C.free_name(docs.columns, "quality")
    return quality.assess(docs).where(F.col(name)["kept"]).select(*[C.keyed(c) for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines are deleted; a document of which nothing is left goes; n_chars follows the text."""
    name = C.free_name(docs.columns, "n_removed_lines")
    left = linededup.dedup_lines(docs).where((F.col(name) == 0) | (F.col("text") != ""))
    return left.withColumn("n_chars", F.when(F.col(name) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*[C.keyed(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8 or more) the document of least id stays."""
    own, own_hash, hashed, n = C.free_names(docs.columns, "own", "own_hash", "hashed", "n")
    kept = neardup.near_duplicates(docs).where("kept").select(F.col("doc_id").alias(own), F.col("text_hash").alias(own_hash)).distinct()
    rows = docs.withColumn(hashed, F.xxhash64("text"))
    rows = rows.join(kept, F.col("doc_id").eqNullSafe(F.col(own)) & (F.col(hashed) == F.col(own_hash)), "left_semi")
    first = Window.partitionBy("doc_id", hashed).orderBy(hashed)  # of rows that repeat one stays
    return rows.withColumn(n, F.row_number().over(first)).where(F.col(n) == 1).select(*[C.keyed(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights: documents repeat by Poisson counts and are shuffled globally."""
    return mixing.mix_sources(docs).select(*[C.keyed(c) for c in docs.columns])


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digest of what they decode to."""
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    coded = bpe.decode(bpe.encode(docs.select("doc_id", "lang", "source", "text"), path, pattern), path, pattern)
    exact = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return coded.select("doc_id", "lang", "source", "n_tokens", "token_ids", F.sha2("decoded", 256).alias("decoded_sha256"), exact.alias("decodes_exactly"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mix), ("bpe", tokenize)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = C.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with C.scratch(spark):
            docs = C.written(stage(spark, docs, sf_dir), name, keep=True)
        if before is not None:
            C.dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)


#: Byte-level BPE is beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
