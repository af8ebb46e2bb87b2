"""A training-corpus pipeline: each stage works on all its predecessor kept, and its decisions take effect."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskworks.llm import decontamination, line_dedup, ngram_join, sentencepiece_codec, toxicity_chain
from maskworks.llm.queries import PIECE_MODEL
from maskworks.llm.store import table, written


#: Columns that the operators add and the stages use: a document's own columns of these names are put aside meanwhile.
_ADDED = {"rejected", "leaks", "lines_before", "lines_removed", *(f"p_{c}" for c in toxicity_chain.CATEGORIES)}


def _apart(docs: DataFrame) -> DataFrame:
    """``docs`` with columns whose names the operators need under other names."""
    return docs.select(*[F.col(f"`{c}`").alias(f"__own_{c}" if c in _ADDED else c) for c in docs.columns])


def _back(out: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents again, under their own names."""
    return out.select(*[F.col(f"`__own_{c}`" if c in _ADDED else f"`{c}`").alias(c) for c in columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject.

    Null and empty texts stay, as do rows with a null id, which have no label; very long texts are judged
    whole. Repeated rows and equal ids are judged each by its text. Without labels nothing is rejected; no
    documents give none. All columns stay as they are, whatever their names.
    """
    chain = toxicity_chain.train(docs, table(spark, sf_dir, "labels"))
    return _back(toxicity_chain.score(_apart(docs), spark.sparkContext.broadcast(chain)).where("not rejected"), docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the chunks and runs of lines that stand elsewhere; one that nothing is left of goes.

    Null texts and texts that were blank before stay as they are. Of equal passages that with the smallest id
    stays, a null id last; rows that agree in id and text count as one and all stay. ``n_chars``, where there
    is one, follows the text of a changed document; other columns stay, whatever their names.
    """
    out = line_dedup.dedup_lines(_apart(docs)).where("lines_removed = 0 or text rlike '[^\\\\s]'")
    if "n_chars" in docs.columns:
        size = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("lines_removed") > 0, size).otherwise(F.col("n_chars")))
    return _back(out, docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id; a null id comes last.

    Null texts and texts without a word are in no group and all stay. Of rows that agree in id and text one
    stays. Very long texts are compared whole; no documents give none. All columns stay as they are.
    """
    return ngram_join.one_of_each(docs).select(*[F.col(f"`{c}`") for c in docs.columns])


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold nothing of the benchmark.

    Null and empty texts stay; very long ones are searched whole, piece by piece. Repeated rows and equal or
    null ids are judged each by its text. An empty benchmark lets all stay. All columns stay as they are.
    """
    return _back(decontamination.find_leaks(_apart(docs), table(spark, sf_dir, "benchmark")).where("size(leaks) = 0"), docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every kept document as digests of its piece ids and of the text they decode to.

    A null text counts as empty and has no pieces. Repeated rows and equal or null ids are rows of their own;
    very long texts are encoded whole; no documents give none. Other columns are not read.
    """
    coded = sentencepiece_codec.digests(docs.select("doc_id", "text"), public_tokenizers.path(PIECE_MODEL))
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [("toxicity", toxicity), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", benchmark), ("SentencePiece encoding and decoding", pieces)]

#: The classifier and the alignment are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs, "stage")
    return docs
