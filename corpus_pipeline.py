"""A corpus pipeline of five operators: language ID, line dedup, near-duplicates, suffix dedup, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all
but the last return the columns of ``documents``, and any others that there are, whatever their
names. Between stages the rows are written as Parquet in the shared folder and read again; what a
stage replaces is removed.

In every stage an empty table stays empty. A null or empty text has no letter and goes in the first
stage; later ones would keep it as it is (a null text has no lines, no shingles and no bytes, and is
packed as the separator alone). A very long text is one row, handled whole by one task. Repeated rows are one
document: the third stage keeps one of them. Of equal documents, and of groups of near-duplicates, the
least doc_id stays; a null doc_id is last there, and first among equal chunks of lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelens import session
from tracelens.llm import jaccard, langid, lines, packing, suffix

#: No SQL: the language model's decisions and the packing plan can't be expressed in it.
ORACLE_SQL = None


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars of the texts as they are now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the classifier knows; the others go."""
    return langid.identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chunks of lines that an earlier document has are cut out."""
    return _counted(lines.dedup(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the least id."""
    return jaccard.one_of_each(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that start earlier are cut out."""
    return _counted(suffix.dedup(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their sequence and offset."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("suffix_dedup", suffix_dedup),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = session.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if last is not None:
            session.drop_table(last)
        last = docs
    return docs
