"""Documents to token shards in five stages; each reads what the one before it kept.

Every stage but the last returns the columns of its documents, whatever their names. Defined results: an empty table goes
through as one; a null text has no words, so the quality rules reject it; a row with a null id is judged by the quality rules
and mixed like any other, has no near duplicate and no benchmark item, and is encoded before all ids; rows that repeat an
id stay or go together in the second and third stage and are separate documents in the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.llm.decontamination import decontaminated
from barloom.llm.mixing import mixed
from barloom.llm.near_dedup import deduplicated
from barloom.llm.quality import keep_good
from barloom.llm.storage import rewritten
from barloom.llm.token_output import default_tokenizer, read_shards, token_shards


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule of the policy."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near duplicates."""
    return deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 80 % of the shingles of no benchmark item."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document taken twice is two rows."""
    return mixed(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, read back from the shards."""
    return read_shards(rewritten(token_shards(docs, default_tokenizer()), "tokens"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_output", token_output),
]

#: Rounding at random and tokenizing have no SQL. The tests hold the quality rules and the decontamination against SQL, near
#: duplicates against all pairs, shares and copies of the mix against a plain water level, and ids against the library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = rewritten(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
