"""A corpus pipeline of five stages, each of which works on what its predecessor kept.

``quality``          texts that fail the quality rules go
``near_duplicates``  of every group of near duplicates the smallest doc_id stays
``decontamination``  texts contaminated by benchmark passages go
``pii``              personal data is replaced by a mark of its kind
``encoding``         the ids of the kept texts, and their digests

Stage functions take (spark, docs, sf_dir).  ``run`` writes each stage's
result as Parquet in the shared folder and reads it again.

Null and empty texts fail the first stage.  Rows without a doc_id are judged
like others, but are no near duplicates of any.  Of repeated rows of a doc_id
and text one stays; rows of one doc_id with different texts are judged apart,
except that the near-duplicate stage drops a doc_id as a whole.  Extra columns
pass through, whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import codec, decontaminate, jaccard, pii, quality
from lexmill.llm.common import free, scratch, table

#: The tokenizer of the last stage.
VOCABULARY = "word_bpe_49k.json"

#: No single SQL statement expresses components of similar documents or BPE.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = pii.redact(docs)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return codec.encode(docs, public_tokenizers.path(VOCABULARY), full=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids")


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("encoding", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        # A stage's own tables go when its result is written, and so does the result that it read.
        with scratch(spark) as keep:
            before, docs = docs, keep(stage(spark, docs, sf_dir), f"stage-{name}")
        free(before)
    return docs
