"""The corpus pipeline: quality rules, toxicity, near-duplicates, decontamination, pieces.

Each stage is a function of the session, the documents its predecessor kept, and the
folder of the tables. All but the last return the columns of documents.

Null and empty texts fail the quality rules and go; the other stages would keep them.
Repeated rows go or stay together until the near-duplicate stage keeps one. Texts of any
length are read whole. Empty tables stay empty. Columns besides those of documents are
carried along.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tiltscale.llm import decontam, pieces, quality, simhash, toxicity
from tiltscale.llm.shared import materialize, read

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents the rules reject, and without boilerplate lines."""
    return quality.clean(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents predicted toxic; the classifier learns from the labelled documents of ``sf_dir``."""
    index = toxicity.fit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, index)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates."""
    return simhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without words that benchmark windows hit, and without documents made up of them."""
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its number of pieces and the hashes of its ids and of the text they decode to."""
    return pieces.digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("toxicity", toxic),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pieces", sentence_pieces),
]

#: SQL has no classifier or tokenizer; each stage is tested against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = materialize(docs, f"stage-{k}")
    return docs
