"""From raw documents to packed training sequences: quality rules, near-duplicates, personal data, source mix, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the columns of documents,
whatever they are, clashing names included. In every stage a null or empty text is a document without words, a text is read whole
however long it is, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shoal.llm import minhash, mixing, packing, pii, quality
from shoal.llm.shared import materialise, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go, null and empty texts among them, as they have too few words; repeated rows are judged alike."""
    return quality.quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest doc_id: five-word shingles, similarity 0.8. Rows that repeat
    a doc_id become one; rows with a null doc_id stay, as nothing names them; texts without words link with nothing."""
    return minhash.keep_one(docs, k=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Values in texts are replaced by pseudonyms under the session's key or one of this run; null texts stay null. n_chars still counts the
    text it was made for, formats keep nearly all lengths."""
    return pii.pseudonymise(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, rows repeated; a null source is one of its own, a text without words goes as its source
    does. The draw is by doc_id, so rows without one draw alike."""
    return mixing.mix(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences; each copy of a row is a document of its own, a null text its closing id alone."""
    return packing.pack(materialise(packing.pieces(docs)))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("packed_sequences", packed_sequences),
]

ORACLE_SQL = None  # near-duplicate components and tokenizer ids are beyond SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
