"""Site-relative line frequency: drop a host's boilerplate lines.  DataFrame expressions only.

For every host: pages containing a line / pages of the host.  Lines above
``max_ratio`` (and on at least ``min_pages`` pages, so that small hosts, where one page is
already a large share, lose nothing) are dropped from that host's pages.

Lines are the parts between ``\\n``, compared exactly; blank lines are neither
counted nor dropped.  A repeated line counts once per page.  Defined results: null text stays
null with 0 lines; an empty text has one blank line; a null host is a host of
its own; repeated rows count as pages of their own; an empty table gives no row; every other column is
carried through untouched, whatever its name.

Scale: one partial aggregation over (host, line digest); text is not shuffled
when the boilerplate table is proven small, and joined by line otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ranqa.llm.common import BROADCAST_ROWS, free_name, row_key, table
from ranqa.session import write_shared

MAX_RATIO, MIN_PAGES = 0.08, 4


def _digest(line: Column) -> Column:
    """128 bits of a line as two longs."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(line, F.lit(7)).alias("b"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO,
                min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, a, b, n_pages, host_pages) of the lines above the ratio, ``(a, b)`` being the line's digest."""
    pages = docs.select(F.col(host).alias("host"), F.col(text).alias("text"))
    totals = pages.groupBy("host").agg(F.count("*").alias("host_pages"))
    keys = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda s: F.trim(s) != ""), _digest))
    counts = (pages.select("host", F.explode(keys).alias("d")).groupBy("host", "d.a", "d.b")
              .agg(F.count("*").alias("n_pages")).where(F.col("n_pages") >= min_pages))
    return (counts.join(totals, counts["host"].eqNullSafe(totals["host"])).drop(totals["host"])
            .where(F.col("n_pages") > F.lit(max_ratio) * F.col("host_pages")))


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", host: str = "source", text: str = "text",
               max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES,
               broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` with the text's boilerplate lines removed, plus ``n_lines`` and ``n_dropped`` (existing columns of
    these names are replaced)."""
    found = write_shared(boilerplate(docs, host, text, max_ratio, min_pages))
    bare = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")])
    of, drop, kept, key, k = (free_name(c, bare) for c in ("__host", "__drop", "__kept", "__key", "__k"))  # unlike any given column
    if found.limit(broadcast_rows + 1).count() <= broadcast_rows:
        per_host = found.groupBy(F.col("host").alias(of)).agg(F.collect_set(F.struct("a", "b")).alias(drop))
        marked = bare.join(F.broadcast(per_host), F.col(f"`{host}`").eqNullSafe(F.col(of)), "left").drop(of)
    else:  # line by line, then once per page
        rows = bare.select(F.col(f"`{host}`").alias("host"), row_key(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).alias("k"),
                           F.explode(F.array_distinct(F.transform(_lines(F.col(f"`{text}`")), _digest))).alias("d"))
        rows = rows.select("host", "k", "d.a", "d.b").distinct()
        hit = rows.join(found.select(F.col("host").alias("h2"), F.col("a").alias("a2"), F.col("b").alias("b2")),
                        F.col("host").eqNullSafe(F.col("h2")) & (F.col("a") == F.col("a2"))
                        & (F.col("b") == F.col("b2")), "left_semi")
        per_page = hit.groupBy(F.col("k").alias(k), F.col("host").alias(of)).agg(F.collect_set(F.struct("a", "b")).alias(drop))
        marked = (bare.withColumn(key, row_key(F.col(f"`{doc_id}`"), F.col(f"`{text}`")))
                  .join(per_page, (F.col(key) == F.col(k)) & F.col(f"`{host}`").eqNullSafe(F.col(of)), "left").drop(k, key, of))
    whole = F.col(f"`{text}`")
    lines = _lines(whole)
    stays = F.filter(lines, lambda s: (F.trim(s) == "") | ~F.array_contains(F.col(drop), _digest(s)))
    marked = marked.withColumn(kept, F.when(F.col(drop).isNull() | whole.isNull(), lines).otherwise(stays))
    return (marked.withColumn("n_lines", F.when(whole.isNull(), 0).otherwise(F.size(lines)).cast("long"))
            .withColumn("n_dropped", F.when(whole.isNull(), 0).otherwise(F.col("n_lines") - F.size(kept)).cast("long"))
            .withColumn(text, F.when(F.col("n_dropped") > 0, F.concat_ws("\n", kept)).otherwise(whole)).drop(drop, kept))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its source as host: lines, dropped lines, length and digest of what stays."""
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("kept_chars"),
                      F.md5(F.col("text").cast("binary")).alias("kept_md5"))


OP7_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, text,
             CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS lines FROM documents),
l AS (SELECT rid, source, generate_subscripts(lines, 1) AS i, unnest(lines) AS line FROM d),
pages AS (SELECT source, count(*) AS host_pages FROM d GROUP BY source),
freq AS (SELECT source, line, count(DISTINCT rid) AS n FROM l WHERE trim(line) <> '' GROUP BY source, line),
bad AS (SELECT f.source, f.line FROM freq f JOIN pages p ON f.source IS NOT DISTINCT FROM p.source
        WHERE n >= {MIN_PAGES} AND n > CAST({MAX_RATIO} AS DOUBLE) * host_pages),
k AS (SELECT l.rid, count(b.line) AS n_dropped,
        string_agg(l.line, chr(10) ORDER BY l.i) FILTER (b.line IS NULL) AS kept
      FROM l LEFT JOIN bad b ON l.source IS NOT DISTINCT FROM b.source AND l.line = b.line GROUP BY l.rid)
SELECT d.doc_id, CAST(len(d.lines) AS BIGINT) AS n_lines, CAST(coalesce(k.n_dropped, 0) AS BIGINT) AS n_dropped,
  CAST(CASE WHEN d.text IS NULL THEN NULL ELSE length(coalesce(k.kept, '')) END AS BIGINT) AS kept_chars,
  CASE WHEN d.text IS NULL THEN NULL ELSE md5(coalesce(k.kept, '')) END AS kept_md5
FROM d LEFT JOIN k ON d.rid = k.rid
"""
