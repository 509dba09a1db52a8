"""A corpus from raw documents to packed training sequences.

Each stage is (name, function of spark, docs and sf_dir); what it returns is
written as Parquet and read again before the next one.  All but the last return
the columns of documents, whatever those are called.

Every row is a document of its own, whatever its doc_id: what a stage finds in one
row drops or changes that row alone.  Where the first of several documents stays,
a smaller doc_id comes first, of equal ones the smaller text, and null ids last.
Labels are those of the doc_id.  A null or empty text is never toxic by a lexicon, near
anything or a copy, and stays; only what loses all its words in the third stage goes.
Of an empty table each stage makes an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalith.llm import blocks
from stratalith.llm.decontamination import leaks
from stratalith.llm.minhash_dedup import near_duplicates
from stratalith.llm.packing import pack
from stratalith.llm.substring_dedup import substring_dedup
from stratalith.llm.toxicity import SAMPLE, learned, scored


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number for each row in a column of a name that docs don't have, and the name."""
    row = "_row"
    while row in map(str.lower, docs.columns):
        row += "_"
    return blocks.by_row(docs, row), row


def texts(rows: DataFrame, row: str) -> DataFrame:
    """What the operators read, with a row's number as doc_id."""
    return rows.select(F.col(row).alias("doc_id"), "text")


def without(rows: DataFrame, row: str, bad: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows whose numbers aren't among the doc_ids of bad, with the columns of docs."""
    return rows.join(bad.select(F.col("doc_id").alias(row)).distinct(), row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the toxicity model rejects."""
    rows, row = numbered(docs)
    model = learned(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"), SAMPLE)
    return without(rows, row, scored(texts(rows, row), model).filter("predicted = 1"), docs)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group (shingles of five words, similarity 0.8)."""
    rows, row = numbered(docs)
    return without(rows, row, near_duplicates(texts(rows, row), words=5, percent=80).filter("not kept"), docs)


def substring_cut(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts word windows that an earlier document has; documents left without words go."""
    rows, row = numbered(docs)
    kept = substring_dedup(texts(rows, row)).select("doc_id", "n_words", "n_removed", "kept_text")
    changed = blocks.stored(kept, "cut").filter("n_removed > 0").select(F.col("doc_id").alias(row), F.struct("n_words", "n_removed", "kept_text").alias(f"{row}_cut"))
    of = lambda name: F.col(f"{row}_cut.{name}")
    both = rows.join(changed, row, "left").filter(of("n_removed").isNull() | (of("n_removed") < of("n_words")))
    text = F.when(of("n_removed").isNotNull(), of("kept_text")).otherwise(F.col("text"))
    out = {c: F.col(f"`{c}`") for c in docs.columns} | {"text": text}
    if "n_chars" in out:
        out["n_chars"] = F.when(of("n_removed").isNotNull(), F.length(text)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return both.select(*[v.alias(c) for c, v in out.items()])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    rows, row = numbered(docs)
    return without(rows, row, leaks(texts(rows, row), spark.read.parquet(f"{sf_dir}/benchmark.parquet")), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into windows of tokens."""
    return pack(docs.select("doc_id", "text"))


STAGES = [("toxicity", toxicity), ("minhash_dedup", minhash_dedup), ("substring_dedup", substring_cut), ("decontamination", decontamination), ("packing", packing)]

#: SQL can't express the stages; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = blocks.stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
