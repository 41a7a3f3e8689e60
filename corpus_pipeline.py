"""The corpus pipeline: quality, near-duplicates, personal data, mixing, token ids.

Every stage takes documents (doc_id, text, lang, source, n_chars) and works on all that its
predecessor kept; all but the last return the same columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import byte_bpe, cotraining, mixing, personal_data, weighted_minhash
from trackloom.llm.frames import cut

BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the co-trained classifier keeps."""
    model = cotraining.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = cotraining.score(docs, model)
    return kept.filter(F.col(kept.columns[-1])).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of equal and near-duplicate texts, the one of the least id; rows without
    id stay.  Of repeated rows of one id the first by text stays."""
    classes = cut(weighted_minhash.classes(docs).filter(F.col("doc_id").isNotNull()))
    dropped = cut(classes.filter("doc_id <> class_id").select("doc_id").distinct())
    kept = weighted_minhash.semi(docs, dropped, "doc_id", "left_anti")
    repeated = cut(classes.groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    if repeated.isEmpty():
        return kept
    several = weighted_minhash.semi(kept, repeated, "doc_id").groupBy("doc_id").agg(
        F.min(F.struct("text", *(c for c in docs.columns if c not in ("doc_id", "text")))).alias("row"))
    one = several.select("doc_id", "row.*").select(*docs.columns)
    return weighted_minhash.semi(kept, repeated, "doc_id", "left_anti").unionByName(one)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with personal data replaced by their kinds; n_chars follows the text."""
    model = personal_data.fit(docs)
    found = personal_data.analysed(docs, "text", model)
    clean = personal_data.redacted("text", "all_spans")
    return found.withColumn("text", clean).withColumn(
        "n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: each document as often as systematic sampling emits it."""
    mixed = mixing.mix(docs, "source", mixing.words(F.col("text")), "doc_id")
    return mixing.emitted(mixed, docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix, with digests of the ids and of the bytes decoded from them; rows, repeated
    ones too, pass one to one, a null text has no ids, an empty table stays empty."""
    ranks = byte_bpe.read_ranks(BYTE_RANKS)
    coded = byte_bpe.round_trip(docs.select("doc_id", "source", "text"), ranks, ids=True)
    return coded.select("doc_id", "source", "n_tokens", "token_ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("personal data", private),
    ("source mixing", mix),
    ("byte BPE", token_ids),
]

#: No SQL: the classifier, the sampling and the merges are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each stage's rows are written once for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
