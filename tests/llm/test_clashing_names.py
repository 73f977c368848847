"""Given columns with the names that operators use inside, in any case, pass through untouched."""

import pytest
from pyspark.sql import functions as F

from ranqa.llm import chat_format, decontaminate, license_scan, line_dedup, packing, pii, quality, suffix_dedup, toxicity
from ranqa.llm.common import free_name

INNER = ["__drop", "__HOST", "__kept", "__key", "__k", "__in0", "__In1", "__text", "__t", "key", "found_key", "doc_text", "item",
         "seed", "__label", "__id", "__digest", "label", "family", "word", "d", "k", "bytes", "kept", "stretches"]


def documents(spark, n=40):
    line = "\nthe same line\nanother same line"
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("text of page "), F.col("id").cast("string"),
                                                                     F.lit(" mail a@b.org vile"), F.lit(line)).alias("text"),
                               F.lit("h").alias("source"), F.lit("en").alias("lang"), F.lit(9).cast("long").alias("n_chars"))
    return df.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in INNER])


def untouched(out, n=40):
    rows = out.collect()
    assert len(rows) == n
    for r in rows:
        assert all(r[c] == f"{c}{r.doc_id}" for c in INNER), r


def test_free_name(spark):
    assert free_name("__key", documents(spark)) == "__key_" and free_name("__host", documents(spark)) == "__host_"


@pytest.mark.parametrize("bound", [10**6, 0])
def test_lines(spark, bound):
    out = line_dedup.line_dedup(documents(spark), broadcast_rows=bound)
    untouched(out)
    assert {r.n_dropped for r in out.collect()} == {2}


def test_columns_are_appended_beside_them(spark):
    docs = documents(spark)
    untouched(pii.pseudonymise(docs, b"k"))
    untouched(license_scan.scan_licenses(docs))
    labels = spark.range(40).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"),
                                    (F.col("id") % 2).cast("int").alias("quality"))
    untouched(toxicity.score(docs, toxicity.fit(docs, labels)))
    untouched(quality.score(docs, quality.fit(docs, labels)))


@pytest.mark.parametrize("chars", [10**7, 0])
def test_decontamination(spark, chars):
    bench = documents(spark, 3).select(F.col("doc_id").alias("item_id"), "text", "key", "__in0", F.col("seed").alias("t"))
    out = decontaminate.decontaminate(documents(spark), bench, broadcast_chars=chars)
    untouched(out)
    assert out.where("contaminated").count() >= 3


def test_operators_that_read_only_their_columns(spark):
    docs = documents(spark)
    assert packing.pack_documents(docs).count() == 40
    assert suffix_dedup.remove_repeats(docs).count() == 40
    turns = docs.select(F.col("doc_id").alias("conv_id"), F.lit(1).alias("turn"), F.lit("user").alias("role"), "text", *INNER)
    assert chat_format.format_conversations(turns).count() == 40
