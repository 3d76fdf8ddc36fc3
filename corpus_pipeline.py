"""The training-corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

The stages go from cheap and narrowing to dear: toxic documents are rejected, near-duplicates are reduced to
the document of the smallest id, documents contaminated by benchmark items are dropped, personal data is
masked, and the rest is encoded. Every stage works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import decontaminate, neardup, personal, pieces, toxicity
from marlstone.llm.common import Scratch, table

STAGES = [
    ("toxicity", toxicity.stage),
    ("near_duplicates", neardup.stage),
    ("decontamination", decontaminate.stage),
    ("personal_data", personal.stage),
    ("sentencepiece", pieces.stage),
]

#: A trained classifier, MinHash components and subword encoding have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``: doc_id, lang, source, n_tokens, token_ids, text."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.cut(stage(spark, docs, sf_dir))
        scratch.release()
    return docs
