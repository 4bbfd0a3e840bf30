"""The corpus pipeline: documents in, cleaned and encoded documents out.

A stage takes what its predecessor kept and returns a DataFrame, which is written as
Parquet and read again for the next. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import (
    byte_bpe,
    decontaminate,
    quality_classifier,
    similar,
    simhash,
    substring_dedup,
)
from millrace.llm._scratch import written
from millrace.sources import read_table


def drop_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not find to be bad more likely than not.

    So all stay where no label can be used. A null text has no words and goes by its site;
    repeated rows share one verdict; no documents give none.
    """
    judged = quality_classifier.classify(docs, read_table(spark, sf_dir, "labels"))
    return judged.where("keep").select(*docs.columns)


def _alike_in_fingerprint(texts: DataFrame) -> DataFrame:
    found = simhash.near_duplicates(texts, doc_id="number")
    return found.where("doc_id <> component_id").select("doc_id", "component_id")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id.

    Texts are linked as in ``simhash.near_duplicates``, by fingerprints that differ in two bits
    at most, and also if their 5-word similarity is 0.8 or more; a group is what links of
    either kind connect. A null id counts as the largest; of several texts with one id the one
    with the smallest hashes stays, and of rows equal in id and text one. Texts without words
    (null, empty, blank) all have fingerprint zero and are one group. No documents give none.
    """
    return similar.keep_one(docs, also=_alike_in_fingerprint)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 35 words or more that occur elsewhere.

    A text that loses nothing stays as it is; of others the words that are left stay,
    one blank between two, which may be none.
    """
    cut = substring_dedup.remove_repeats(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    size = F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col("n_chars"))
    changed = {"text": text, "n_chars": size.cast("long")}
    return cut.select(*(changed.get(c, F.col(c)).alias(c) for c in docs.columns))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark, a short one included.

    A null or blank text contains nothing, and a blank item is nowhere. Of two rows with one
    id only the one whose text has an item goes. Without items all documents stay.
    """
    return decontaminate.without_items(docs, read_table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document (little-endian, 32 bits), and whether decoding gives its text back.

    A null text is empty and has no token. Each row gives one, repeated ones too.
    """
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own = docs.select("doc_id", "lang", "source", "text", F.sha2("text", 256).alias("sha"))
    coded = byte_bpe.round_trip(own, path, public_tokenizers.PATTERN)
    same = F.sha2("decoded", 256) == F.coalesce("sha", F.sha2(F.lit(""), 256))
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", same.alias("exact"))


STAGES = [
    ("quality classifier", drop_bad),
    ("near copies", drop_near_copies),
    ("repeated passages", cut_repeats),
    ("benchmark leaks", drop_leaks),
    ("byte-level BPE", encode),
]

# Boosting, wide fingerprints and byte-pair merging are beyond SQL; tests compare each
# stage with a plain version on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = written(docs, "stage")
    return docs
