"""Training-corpus pipeline over ``documents``: five stages, each a table for the next.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame.  The first four
return the columns of ``documents``; the last returns the packed pieces.  The
classifier stage learns from the labels of the documents that reach it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notedrift.llm import language, packing, pii, quality, simhash
from notedrift.llm.queries import pattern, vocabulary_file
from notedrift.session import materialize
from notedrift.sources.tables import table

#: Documents under this quality score go.
QUALITY = 0.3


def _packed(docs: DataFrame, *names: str) -> DataFrame:
    """The whole row as ``row``, and the named columns beside it: no name of an operator meets a column of the table."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[F.col(f"`{c}`").alias(c) for c in names])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified stay.

    A null or empty text has no language and goes; repeated rows are judged alike; an empty table stays empty;
    other columns are kept, whatever their names.
    """
    model = language.train(docs, "text", "lang")
    found = language.identify(_packed(docs, "text", "lang", "source"), model, "text", "lang", "source")
    return found.where("verdict.accepted").select("row.*")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of at least QUALITY stay.

    A null text scores as an empty one; repeated rows score alike; without any label every score is one half; an
    empty table stays empty; other columns are kept.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.score(model, F.col("text")) >= QUALITY)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: 3-word shingles, 3 bits.

    Null and empty texts are one group, and so are repeated rows; an empty table stays empty; other columns are kept.
    """
    return simhash.one_of_each(docs, shingle=3, max_bits=3)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind; ``n_chars`` follows the new text.

    A null text stays null; repeated rows are changed alike; an empty table stays empty; other columns
    are kept, whatever their names.
    """
    found = pii.find(_packed(docs, "text"), pii.train(docs), "text", "pii")
    found = found.select("row", pii.redacted(F.col("text"), F.col("pii.spans")).alias("new"))
    new = {"text": F.col("new"), "n_chars": F.char_length("new").cast("long")}
    return found.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the texts in sequences of at most 1024 tokens.

    A null text is one piece, the end token; repeated rows are packed each; an empty table gives no pieces.
    """
    return packing.pack(docs, vocabulary_file("byte_bpe_50k.json"), pattern(), end_id=2, capacity=1024)


STAGES = [
    ("language ID", language_stage),
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("PII", personal_data_stage),
    ("best-fit packing", packing_stage),
]

#: The stages train models and pack sequences, which SQL cannot express; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{k}")
    return docs
