"""A corpus from raw documents to packed sequences: language, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and the rows that its predecessor kept; all but the
last return the columns of documents. Nulls and empty tables pass through as the operators say.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import langid, packing, simhash, suffix
from quadrille.llm.queries import vocabulary
from quadrille.session import shared_dir

__all__ = ["STAGES", "ORACLE_SQL", "run"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; the others (no letter, no language over 0.4) go."""
    return langid.keep_identified(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id stays.

    Texts link whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, counted
    out for the candidates that 256-bit SimHashes give (see :func:`simhash.similar_groups`).
    Rows without an id stay only if their whole group has none; rows that share the id stay.
    """
    return simhash.keep_one(docs, width=5, least=0.8)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of 200-byte strings are cut from the texts, the first stays.

    Only whole characters go; n_chars is counted anew where a text changes. A text that
    consists of later copies only is dropped with its row.
    """
    rest = F.struct(*[c for c in docs.columns if c != "text"]).alias("rest")  # columns named as a result stay
    cut = suffix.deduplicate(docs.select("doc_id", "text", rest), length=200, keep_first=True, chars=True)
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept").cast("string")).otherwise(F.col("text"))
    out = cut.where("n_removed = 0 or octet_length(kept) > 0").select("rest.*", text.alias("text"), changed.alias("__quadrille_changed"))
    if "n_chars" in docs.columns:
        n = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("__quadrille_changed"), n).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, each with its sequence of at most 4096 tokens and its place there."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("sequences", sequences),
]

#: A trained model, connected components and suffix order are beyond plain SQL; the tests hold
#: every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.schema(docs.schema).parquet(path)
    return docs
