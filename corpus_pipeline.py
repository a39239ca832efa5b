"""A training-data pipeline of five stages, each over all that the one before kept.

toxicity (documents that it rejects go), line dedup (lines go, and documents that lose all words), near-duplicate removal (one document of
each group stays), benchmark decontamination (contaminated documents go) and mixing of the sources to target weights (the
documents that the mix emits, with copy_no).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import decontam, lines, minhash, mixing, toxicity
from gridloom.llm.scratch import Scratch, unused


def _identified(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number of its own for each document, and that column's name.

    A document is a doc_id with a text: its number is the doc_id, but for null ids, and ids that several texts share, it is a
    negative hash of id and text, which no given id that is not negative can be. Rows that repeat are one document.
    """
    (own,) = unused(docs, "document")
    th = F.xxhash64("text")
    several = docs.select("doc_id", th.alias("th")).groupBy("doc_id").agg(F.min("th").alias("lo"), F.max("th").alias("hi")).filter("lo < hi AND doc_id IS NOT NULL")
    hashed = F.xxhash64("doc_id", "text").bitwiseOR(-(1 << 63))
    if several.isEmpty():
        return docs.withColumn(own, F.coalesce("doc_id", hashed)), own
    several = several.select(F.col("doc_id").alias(f"{own}_id"))
    marked = docs.join(several, F.col("doc_id") == F.col(f"{own}_id"), "left")
    return marked.withColumn(own, F.when(F.col(f"{own}_id").isNull(), F.coalesce("doc_id", hashed)).otherwise(hashed)).drop(f"{own}_id"), own


def _kept(docs: DataFrame, own: str, kept: DataFrame) -> DataFrame:
    """Rows of docs whose number is a doc_id of kept. Kept ids grow with the documents, so they are never broadcast."""
    ids = kept.select(F.col("doc_id").alias(f"{own}_kept")).hint("merge")
    return docs.join(ids, F.col(own) == F.col(f"{own}_kept"), "left_semi").drop(own)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold of a model trained on the labels, held-out ones aside.

    Each row is judged by its own text: null and empty ones stay, rows that repeat stay or go together. All columns stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(spark, docs, labels, ~toxicity.held_out(F.col("doc_id")))
    return toxicity.keep_clean(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that are like an earlier one, with all columns; a document that loses every word goes.

    Null, empty and wordless texts lose nothing and stay; rows that repeat lose the same lines, and stay or go together.
    """
    (had,) = unused(docs, "had_words")
    words = lambda c: F.coalesce(F.col(c).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    left = lines.dedup_lines(spark, docs.withColumn(had, words("text")))
    return left.filter(~F.col(had) | words("text")).drop(had)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each near-duplicate group, at five words and 0.8; documents without an id come first.

    Null, empty and wordless texts are like nothing and stay. Rows that repeat are one document and stay together. Texts
    that share an id, or have none, are judged each for itself. An empty table gives no rows, and all columns stay.
    """
    docs, own = _identified(docs)
    found = minhash.near_duplicates(spark, docs.select(F.col(own).alias("doc_id"), "text"), 5, 80)
    return _kept(docs, own, found.filter("kept").select("doc_id").distinct())


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark.

    Null, empty and wordless texts are clean. Texts that share an id, or have none, are judged each for itself, and rows that
    repeat alike. An empty table gives no rows, and all columns stay.
    """
    docs, own = _identified(docs)
    found = decontam.overlap(spark, docs.select(F.col(own).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _kept(docs, own, found.filter("NOT contaminated").select("doc_id").distinct())


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix emits, with copy_no (_copy_no, if there is such a column): a document that it takes twice has two rows.

    A null text has size 0 and a null source is a source; rows that repeat are documents of their own. Columns stay.
    """
    return mixing.mix(spark, docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: The first stage trains a model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written and read again."""
    tmp = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = tmp.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
