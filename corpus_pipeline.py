"""A corpus pipeline of five stages over ``documents``; each stage's result is written and reread as the next one's input."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm import labelled, line_dedup, mixing, near_dedup, packing, toxicity
from stratalog.llm.scratch import Scratch

REJECT = 0.7


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learnt from the labels, scores below ``REJECT``; null texts count as empty."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels, labelled.fold(F.col("id"), 3) != 1)
    return toxicity.score(docs, model, keep_text=True).where(F.col("score") < REJECT).select("row.*")


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of repeated three-line windows; ``n_chars`` follows the text where lines go."""
    clean = line_dedup.without_repeats(docs)
    new = {"text": F.col("text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("row.n_chars"))}
    return clean.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates, and all others; rows that share an id go or stay together."""
    copies = near_dedup.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the curriculum takes, in training order."""
    return mixing.curriculum(docs)


def _stored_order(docs: DataFrame) -> list[Column]:
    """Where a row stands in its files, whose names begin with the writing task's number, or in the frame if it has no files."""
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        return [F.monotonically_increasing_id()]
    name = docs["_metadata.file_name"]
    return [F.regexp_extract(name, r"^part-(\d+)", 1).try_cast("bigint"), name, docs["_metadata.row_index"]]


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens, in the order of the stored training sequence."""
    return packing.pack(docs, _stored_order(docs))


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", remove_repeated_lines),
    ("minhash_near_dedup", keep_one_of_each_group),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Trained models and tokenizers have no SQL form: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.table(f"{k}-{name}", stage(spark, docs, sf_dir))
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
