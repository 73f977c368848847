"""End-to-end corpus jobs: assemble the question-answer corpus from template
files and catalog tables, export it, and split a Q/A table for fine-tuning.

All steps stay DataFrames; the only hand-off is a written table (the Q/A
parquet), which is also what makes a failed export restartable.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranqa.functions.keyed import DEFAULT_SEED
from ranqa.operators.permute import in_permuted_order, permuted
from ranqa.operators.split import VAL_FRACTION, finetune_split
from ranqa.operators.tagger import DEFAULT_LEXICON, Lexicon
from ranqa.operators.templates import (NUM_SAMPLES, SYSTEM_PROMPT, expand_advanced, expand_base,
                                       indexed_entities, negative_questions, no_entity_questions,
                                       union_corpus, with_records)
from ranqa.sources.catalog import distinct_catalog, read_templates
from ranqa.sources.sinks import write_jsonl, write_splits
from ranqa.sources.tables import read_any

# records per task of the shuffled export
EXPORT_ROWS = 500_000


def assemble_corpus(spark: SparkSession, *, base_path: str, advanced_path: str, negative_path: str,
                    no_entity_path: str, catalog_tables: list[DataFrame], catalog_column: str = "Q",
                    num_samples: int = NUM_SAMPLES, seed: int = DEFAULT_SEED,
                    lexicon: Lexicon = DEFAULT_LEXICON, keep_blank: bool = True) -> DataFrame:
    """The four generators over template files and a catalog column, unioned
    in corpus order (base, advanced, negative, no-entity)."""
    ents = indexed_entities(distinct_catalog(catalog_tables, catalog_column))
    parts = [
        expand_base(read_templates(spark, base_path), entities=ents, num_samples=num_samples, seed=seed,
                    lexicon=lexicon, keep_blank=keep_blank),
        expand_advanced(read_templates(spark, advanced_path), entities=ents, num_samples=num_samples,
                        seed=seed, lexicon=lexicon, keep_blank=keep_blank),
        negative_questions(read_templates(spark, negative_path), keep_blank=keep_blank),
        no_entity_questions(read_templates(spark, no_entity_path), lexicon=lexicon, keep_blank=keep_blank),
    ]
    return union_corpus(parts)


def export_corpus(corpus: DataFrame, out_dir: str, *, seed: int = DEFAULT_SEED,
                  prompt: str = SYSTEM_PROMPT) -> dict[str, int]:
    """Write the Q/A table as parquet, then, reading that table back, the chat
    records (each kind shuffled, kinds in corpus order) as JSONL; return
    record counts per kind and total.

    The corpus is generated once.  A record's place is a keyed bijection of its id within its kind, so the
    shuffled export moves every record once and neither samples nor sorts the whole table.
    """
    spark = corpus.sparkSession
    qa_path = os.path.join(out_dir, "qa")
    (corpus.select("kind", "kind_ord", "id", F.col("question").alias("Q"), F.col("answer").alias("A"))
     .write.mode("overwrite").parquet(qa_path))
    qa = spark.read.parquet(qa_path)
    kinds = qa.groupBy("kind", "kind_ord").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last")).orderBy(
        "kind_ord").collect()  # one row per kind
    counts = {r["kind"]: r["n"] for r in kinds}
    counts["total"] = sum(counts.values())
    rows = qa.select("kind", "kind_ord", "id", F.col("Q").alias("question"), F.col("A").alias("answer"))
    shuffled, n = shuffled_by_kind(rows, {r["kind"]: r["last"] for r in kinds}, seed)
    tasks = max(1, -(-counts["total"] // EXPORT_ROWS), min(spark.sparkContext.defaultParallelism, counts["total"]))
    records = with_records(in_permuted_order(shuffled, "place", n, tasks), prompt).select(F.col("record.*"))
    write_jsonl(records, os.path.join(out_dir, "conversations"))
    return counts


def shuffled_by_kind(rows: DataFrame, last: dict[str, int], seed: int = DEFAULT_SEED) -> tuple[DataFrame, int]:
    """``rows`` (``kind``, ``id`` from 1 up to the kind's ``last``) with ``place``: kinds one after the other in the order given,
    a keyed permutation inside each; and the number of places."""
    start, at = {}, 0
    for kind, n in last.items():
        start[kind] = at
        at += n
    per_kind = lambda values: F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in values.items()], F.lit(1))
    place = per_kind(start) + permuted(F.col("id") - 1, per_kind(last), seed)
    return rows.withColumn("place", place.cast("long")), at


def read_qa_table(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """A Q/A table in any Spark format, reduced to its ``Q``/``A`` columns
    (plus the record key when present)."""
    df = read_any(spark, path, fmt)
    keys = [c for c in ("kind", "id") if c in df.columns]
    return df.select(*keys, "Q", "A")


def export_finetuning(qa: DataFrame, out_dir: str, *, fraction: float = VAL_FRACTION,
                      seed: int = DEFAULT_SEED, exact: bool = True,
                      keys: list[str] | None = None) -> DataFrame:
    """Split into train/val (``ceil(fraction*n)`` validation rows when
    ``exact``), rename to query/response, shuffle each side and write
    ``out_dir/split=train`` and ``out_dir/split=val`` as JSONL."""
    if keys is None:
        keys = [c for c in ("kind", "id") if c in qa.columns]
        if not keys or qa.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").limit(1).count():
            # a Q/A table without a key, or whose ids repeat: the content and the number of its
            # occurrence (equal rows are interchangeable), whatever the file layout
            qa = (qa.groupBy("Q", "A").agg(F.count(F.lit(1)).alias("_n"))
                  .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n")))).drop("_n")
                  .withColumn("_row", F.xxhash64("Q", "A")))
            keys = ["_row", "_copy"]
    split = finetune_split(qa, keys, fraction=fraction, seed=seed, exact=exact)
    write_splits(split, out_dir)
    return split
