"""Corpus pipeline: toxicity filter, near-duplicate removal, masking of personal data, mixing of sources, tokenization.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the columns
of documents. Nulls, empty texts and tables, repeated rows and extra columns are handled as the operators state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import byte_bpe, jaccard_join, mixing, pii, toxicity
from plumbline.llm.common import Scratch
from plumbline.llm.queries import BPE_FILE

#: Characters of a batch of texts that are tokenized together: half the operator's own, as Python workers of the stages before
#: still hold memory of the executor then.
BATCH_CHARS = 4_000_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    bpe = byte_bpe.ByteBPE(spark, public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN)
    encoded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), batch_chars=BATCH_CHARS)
    return bpe.decode(encoded).select("doc_id", "lang", "source", F.size("token_ids").cast("bigint").alias("n_tokens"), F.octet_length("decoded").cast("bigint").alias("n_bytes"), "token_ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("pii", mask_personal_data),
    ("mixing", mix),
    ("byte_bpe", tokenize),
]

#: No stage but mixing can be written in SQL as a whole; tests compare the pipeline with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage before it is written to the shared folder and read back, so none runs twice."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
