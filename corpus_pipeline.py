"""From documents to packed training sequences, in five stages that each work on all the one before kept.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next stage's documents.
Stages carry the columns of the documents as they are; where a stage changes the text, ``n_chars`` (if it is there)
follows. NULL and empty texts, repeated rows, further columns and empty tables are treated as the operators state.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinrun.llm.common import row_key, stored, table, text_of
from twinrun.llm.lines import drop_repeated_lines
from twinrun.llm.ngrams import jaccard_join
from twinrun.llm.packing import pack_documents
from twinrun.llm.quality import quality
from twinrun.llm.substrings import drop_repeated_spans


def _with_text(docs: DataFrame, found: DataFrame, text: Column) -> DataFrame:
    """The documents' columns out of ``doc`` structs, in their order, with another text."""

    def column(name: str) -> Column:
        if name == "text":
            return text.alias("text")
        if name == "n_chars":
            return F.length(text).cast(docs.schema["n_chars"].dataType).alias("n_chars")
        return F.col(f"doc.`{name}`").alias(name)

    return found.select(*[column(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the threshold table rejects go."""
    return docs.where(quality(text_of("text"))["kept"])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a line found in ten documents or more, the first occurrence stays; documents stay, even if without lines."""
    found = drop_repeated_lines(docs, min_docs=10, keep_first=True)
    return _with_text(docs, found, F.col("kept"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a group of near duplicates, the document with the least doc_id stays. Documents without words are no
    duplicates of each other; rows with the same doc_id and text are one document."""
    joined = jaccard_join(docs)
    least = joined.where("node IS NOT NULL AND doc_id <=> class_id").groupBy("label").agg(F.min(F.struct("r1", "r2")).alias("r"))
    stay = least.select("r.r1", "r.r2").union(joined.where("node IS NULL").select("r1", "r2").distinct())
    keyed = docs.select(F.struct("*").alias("doc"), *[k.alias(a) for k, a in zip(row_key(F.col("doc_id"), text_of("text")), ("r1", "r2"))])
    return keyed.join(stay, ["r1", "r2"], "left_semi").dropDuplicates(["r1", "r2"]).select("doc.*")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages of 20 words or more that start earlier go; the other words keep the white space after them."""
    found = drop_repeated_spans(docs, layout=True)
    return _with_text(docs, found, F.col("kept"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in sequences."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: SQL has no MinHash join and no packing; the tests hold all stages against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
