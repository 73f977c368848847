"""From raw documents to packed training sequences: five stages, each an operator of ``ranqa.llm``.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``; all but the last return the columns of ``documents``.

1. quality: documents that the co-trained classifier rejects go.
2. lines: boilerplate lines of a source go; ``n_chars`` follows the text.
3. near copies: one document of each group stays, the one with the smallest id (and digest, when texts share it).
4. benchmark: contaminated documents go.
5. packing: pieces of the documents with their places in sequences.

Nulls, empty texts, repeated rows and empty tables pass as the operators define.  Rows that link with nothing (null ids and blank
texts included) all stay in stage 3.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranqa.llm import decontaminate, line_dedup, ngram_join, packing, quality
from ranqa.llm.common import maybe_broadcast, table
from ranqa.session import prepare, write_shared

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = docs.select(*COLUMNS)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).where(F.col("p_quality") >= quality.THRESHOLD).select(*COLUMNS)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    out = line_dedup.line_dedup(docs.select(*COLUMNS))
    n = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n).select(*COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = docs.select(*COLUMNS)
    found = write_shared(ngram_join.near_documents(docs).where("n_links > 0"))
    rows = docs.withColumn("__digest", F.xxhash64(F.coalesce("text", F.lit(""))))

    def without(rows: DataFrame, keys: DataFrame) -> DataFrame:
        k = keys.select(F.col("doc_id").alias("__k"), F.col("digest").alias("__d")).distinct()
        return rows.join(maybe_broadcast(k), (F.col("doc_id") == F.col("__k")) & (F.col("__digest") == F.col("__d")), "left_anti")

    first = (F.col("doc_id") == F.col("class_id")) & (F.col("digest") == F.col("class_digest"))
    # representatives that several rows repeat: one of them stays
    repeated = found.where(first).groupBy("doc_id", "digest").agg(F.count("*").alias("n")).where("n > 1")
    if repeated.limit(1).count() == 0:
        return without(rows, found.where(~first)).select(*COLUMNS)
    single = without(rows, found.where(~first).select("doc_id", "digest").unionByName(repeated.select("doc_id", "digest")))
    chosen = (rows.join(repeated.select(F.col("doc_id").alias("__k"), "digest"),
                        (F.col("doc_id") == F.col("__k")) & (F.col("__digest") == F.col("digest")), "left_semi")
              .dropDuplicates(["doc_id", "__digest"]))
    return single.select(*COLUMNS).unionByName(chosen.select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    out = decontaminate.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return out.where("not contaminated").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packing.pack_documents(docs.select(*COLUMNS))


STAGES = [
    ("quality_classifier", reject_poor),
    ("line_dedup", drop_boilerplate),
    ("ngram_join", keep_one_of_each_group),
    ("decontaminate", drop_contaminated),
    ("packing", pack),
]

#: SQL cannot express the classifier, the tiling and the tokeniser; tests compare with brute-force versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = write_shared(docs)
    return docs
