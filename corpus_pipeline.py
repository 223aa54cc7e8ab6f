"""Corpus pipeline: five stages, each on all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet to the shared folder and read again as the next one's docs. All but
the last return the columns of ``documents``: doc_id, text, lang, source,
n_chars (n_chars follows the text as the stages change it).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from epochloom.llm import decontaminate, pieces, quality_rules, secrets, simhash
from epochloom.llm.common import materialise, read


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines that break a rule are cut out of the rest."""
    return quality_rules.clean_documents(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the smallest id stays."""
    return simhash.drop_near_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth of their words in benchmark windows go."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span found is replaced by [SECRET]; no document goes."""
    return secrets.mask_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document left."""
    return pieces.tokenise_documents(docs)


STAGES = [
    ("quality rules", rules),
    ("simhash near-dedup", near_copies),
    ("benchmark decontamination", benchmark),
    ("secret scans", mask_secrets),
    ("sentencepiece encoding", tokens),
]

#: The fingerprints, spans and token digests can't be had in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
