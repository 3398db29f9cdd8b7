"""The corpus pipeline: language ID, exact dedup, near-duplicate dedup, PII masking and packing, one after the other.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. All but the last return the columns
of ``documents``; the last returns pieces of packed token sequences. run() writes each stage's rows to the shared folder and
reads them again, so a lost executor never repeats an earlier stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quire.llm.exact_dedup import drop_exact_duplicates
from quire.llm.language_id import fold, keep_known_languages, learn
from quire.llm.ngram_join import drop_near_duplicates
from quire.llm.packing import pack
from quire.llm.pii import mask_in_place, session_key
from quire.shared import Scratch

#: Near duplicates: words of a shingle, and the least similarity in percent.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that are in one of the languages learned from labelled rows. What goes has no letter (so null and empty
    texts go), or is like no language at all. Where no row has a language, nothing is known and all go."""
    langs, prototypes = learn(docs.where(fold() != 0))
    return keep_known_languages(docs, langs, prototypes)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for A-Z and a-z, the document of the largest id stays; null counts as empty and as the smallest id;
    repeated rows stay once."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are connected by links of similarity, the one of the smallest id stays; of different texts of one id, only
    those that are no copies. A document with a null id or without words stays."""
    return drop_near_duplicates(docs, SHINGLE_WORDS, SIMILAR_PERCENT)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts get pseudonyms under the session's key (spark.quire.piiKey, a random one where that is unset); no document
    goes, null texts stay null."""
    return mask_in_place(docs, session_key(spark))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of all documents in sequences of at most 4096; a null text is its end token."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("pii", pii), ("packing", packing)]

#: SQL has no language ID, Feistel network or tokenizer; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
