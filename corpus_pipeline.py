"""A corpus pipeline of five stages over `documents`; each takes what its predecessor kept and its decisions take effect.

Stages but the last return the columns of documents. Each is written as Parquet and read again by the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochal.llm import linededup, mixing, ngramjoin, packing, toxicity
from epochal.llm.common import Scratch, keep_ids, plain, table


#: Rows and bytes of text that go to a Python worker at a time: what both sides hold of a batch, several times over while it is worked on.
BATCH_ROWS, BATCH_BYTES = 1_000, 4 << 20


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5. The lexicon is learnt from `documents` and `labels` as they came."""
    _small_batches(spark)
    lexicon = toxicity.fit(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, lexicon).where("__score < 0.5").select(*_names(docs))


def lines_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that repeat; n_chars follows the text where it has changed."""
    _small_batches(spark)
    out = linededup.line_dedup(docs, Scratch(spark))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("__n_dropped") > 0, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*_names(docs))


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id. Five words and a similarity of 0.8, as for all near-duplicate stages.

    Documents without words are no copies of each other. Where rows repeat a doc_id, each is judged by its own text: rows that are equal in both are one document
    without more ado, others are told apart by a hash of both, the least of which stays where ids are equal. Null ids stay.
    """
    _small_batches(spark)
    scratch = Scratch(spark)
    repeated = not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
    if not repeated:
        classes = ngramjoin.join_classes(docs, scratch, words=5, num=80, den=100)
        gone = scratch.write(classes.where("component_id <> doc_id").select("doc_id"))
        return keep_ids(docs, gone, "left_anti").select(*_names(docs))
    own = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    keyed = docs.withColumn("__key", own)
    one = keyed.where("__key is not null").select("__key", F.struct(*_names(docs)).alias("__row"), F.xxhash64(*_names(docs)).alias("__order"))
    one = scratch.write(one.groupBy("__key").agg(F.min_by("__row", "__order").alias("__row")))
    texts = one.select(F.col("__key").alias("doc_id"), F.col("__row.text").alias("text"))
    classes = ngramjoin.join_classes(texts, scratch, words=5, num=80, den=100).select(F.col("doc_id").alias("__key"), "component_id")
    first = F.min_by("__key", F.struct("__id", "__key")).alias("__key")
    kept = scratch.write(classes.join(one.select("__key", F.col("__row.doc_id").alias("__id")), "__key").groupBy("component_id").agg(first).select("__key"))
    rest = keyed.where("__key is null").select(*_names(docs))
    return keep_ids(one, kept, key="__key").select("__row.*").unionByName(rest)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mix_documents(docs, Scratch(spark))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of at most 1024 ids."""
    _small_batches(spark)
    return packing.pack(docs.select("doc_id", "text"), Scratch(spark))


def _names(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in plain(docs).columns]


STAGES = [("toxicity", toxic_out), ("line dedup", lines_out), ("n-gram Jaccard join", near_copies_out), ("mixing sources", mixed), ("best-fit packing", packed)]

#: SQL cannot state the toxicity stage nor the tokenizer; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.write(docs)
    return docs
