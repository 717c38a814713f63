"""A training-data pipeline of five stages; each reads what its predecessor wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stillfresh.llm import mixing, ngram_join, packing, secrets, toxicity
from stillfresh.llm.common import materialize, read_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on ``labels``, scores under 0.5; all their columns.

    Null and empty texts have the score of a text without words and stay; long texts are
    scored whole; repeated rows share their fate; null ids are scored like others. No labels
    or no documents: no rejections, no rows. Columns of any other name pass through.
    """
    return toxicity.drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word runs are alike by 0.8 or more, the smallest id.

    Texts without words and null ids stay, as they are linked with nothing; rows that repeat
    an id are one document and stay together. Texts count whole. No documents: no rows.
    """
    return ngram_join.keep_first(docs, width=5, percent=80)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its secrets replaced by a mark, ``n_chars`` counted again.

    Null texts stay null, empty ones empty; long texts are read whole; repeated rows are
    rewritten alike. No documents: no rows.
    """
    return secrets.redact_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample by probabilities that meet the source, language and topic targets; all columns.

    A null source, language or text counts as empty. Each id draws once, so rows that repeat
    an id in one cell share their fate. Documents without words weigh nothing and stay. No
    documents: no rows.
    """
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens: the columns of query op7.

    Null texts are empty and have the end id only; long texts are cut into as many pieces as
    they need; repeated rows and null ids are packed like others. No documents: no rows.
    """
    return packing.packing_digest(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", keep_one_of_near_copies),
    ("secret_scans", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: The label model, the exact join and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each returns is a written table."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
