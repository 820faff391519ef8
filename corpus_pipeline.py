"""Cleans `documents` for training: bad, repeated and leaked texts go, the rest is encoded."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.bpe_stream import encode_and_check
from veilframe.llm.common import column, free_name
from veilframe.llm.compression_quality import quality_score
from veilframe.llm.exact_dedup import drop_duplicates, only_rows, row_hash
from veilframe.llm.parity_join import near_copies
from veilframe.llm.queries import QUALITY_THRESHOLD, quality_model
from veilframe.llm.string_tiling import benchmark_blocks, is_contaminated
from veilframe.session import stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 and more stay, as they are. Null is scored as empty; repeated rows fare alike."""
    return docs.where(quality_score(F.col("text"), quality_model(spark, docs, sf_dir)) >= QUALITY_THRESHOLD)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null: empty) the row with the largest doc_id stays; of rows equal in every column one."""
    return drop_duplicates(docs, keep="largest")


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies, linked by five-word shingles at a Jaccard similarity of 0.8 and more, the smallest doc_id stays.

    Texts without words are no copies of anything. Rows without doc_id lose; rows equal in every column are one row.
    """
    mark = free_name(docs.columns, "row_hash")
    marked = docs.withColumn(mark, row_hash(docs))
    return only_rows(marked, near_copies(marked, carry=(mark,)).where("kept"), "doc_id", mark)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tiles cover 0.6 and more of the words of a benchmark item go. Null and empty texts stay."""
    blocks = list(benchmark_blocks(spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    return docs.where(~is_contaminated(F.col("text"), blocks))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns but the text, with its tokens (little-endian 32-bit numbers), how many, and whether they decode to it.

    Null is encoded as empty. The new columns take the next free name where docs has one of theirs.
    """
    tokens, count, same, both = (free_name(docs.columns, n) for n in ("tokens", "n_tokens", "roundtrip", "encoded"))
    encoded = docs.withColumn(both, encode_and_check(F.col("text"), public_tokenizers.path("byte_bpe_50k.json")))
    ids = column(both).getField("tokens")
    return encoded.select(
        *[column(c) for c in docs.columns if c != "text"], (F.octet_length(ids) / 4).cast("long").alias(count), ids.alias(tokens),
        column(both).getField("roundtrip").alias(same),
    )


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_encoding", bpe_encoding),
]
#: Compression, sketches and encoding have no SQL; the stages are tested one by one against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
