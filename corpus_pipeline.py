"""Corpus cleaning as a chain of stages over `documents`, each written as Parquet and read again by the next.

Language ID drops what it rejects, line dedup cuts repeated lines (and drops texts of which nothing is left), SimHash keeps
one document of each group, decontamination drops documents with passages of the benchmark, and what stays is encoded.
All stages but the last return the columns of documents.

Rows without a doc_id go through as rows of their own. Texts that are null, empty or without a letter are rejected by the
first stage; lang teaches where it isn't null, and where it always is, only texts without a letter go. Rows that repeat
doc_id and text share the decisions of line dedup, and one of them stays after SimHash. An empty table gives an empty
result, an empty benchmark drops nothing, columns beyond those of documents are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriframe.llm import language_id
from veriframe.llm.common import fold, table
from veriframe.llm.decontamination import drop_contaminated
from veriframe.llm.line_dedup import line_dedup
from veriframe.llm.sentencepiece import encode
from veriframe.llm.simhash import keep_one
from veriframe.scratch import materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told. The models learn from the stage's own input, outside the held-out fold."""
    try:
        models = language_id.fit(docs, fold(F.col("doc_id"), language_id.FOLDS) != 0)
    except ValueError:  # no labelled text
        models = None
    return language_id.keep_identified(docs, models)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines, n_chars counted anew; texts that consisted of repeated lines go."""
    own = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)}
    others = tuple(c for c in docs.columns if c not in own)
    cut = line_dedup(docs, carry=others).filter(~F.coalesce("emptied", F.lit(False)))
    return cut.select(*((own[c] if c in own else F.col("carried").getField(c)).alias(c) for c in docs.columns))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each SimHash component."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark: a window of eight words of any item, or two items that may be shorter."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"), one_window=True)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and n_tokens of each document."""
    return encode(docs).withColumn("n_tokens", F.coalesce(F.size("ids"), F.lit(0)).cast("long"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash_dedup", dedup_near),
    ("decontamination", decontaminate),
    ("sentencepiece", encode_pieces),
]

#: Fingerprints, models and encodings are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the result of each is a table in the shared folder, so a failed run repeats one stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
