"""Chat formatting with typed content parts, as DataFrame expressions only.

A conversation becomes one training string.  Template of a turn::

    ### <role>: <content> </turn>\\n

A visitor walks a turn's typed parts in order: text parts contribute their
escaped text, every other part an ordered placeholder ``<|kind:i|>`` (``i``
counts the attachments of the conversation), an attachment reference and the
number of tokens the placeholder stands for.

Control strings inside texts are escaped reversibly: a backslash doubles, and
``###``, ``</turn>`` and ``<|`` get a backslash in front; in roles ``:`` is
written ``\\;``.  An escaped text never holds `` </turn>``, so splitting at the
turn end reads the turns back.

Defined results: null text or role counts as empty; rows that repeat
(conv_id, turn) are all kept, ordered by (turn, role, text); a null conv_id is
one conversation; a null turn sorts first; a null part list is no part, an unknown part kind
is a zero-token attachment; an empty table gives no row; other columns are ignored,
whatever their names.  A conversation is
one output row, so its turns meet in one aggregation buffer: memory is that
of the longest conversation's own text, whatever its copies.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEAD, MID, END, SEP = "### ", ": ", " </turn>", "\n"
PARTS = ("array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>")


@dataclass(frozen=True)
class Expansion:
    """Tokens that one attachment placeholder stands for."""

    image_patch: int = 14
    audio_tokens_per_second: float = 25.0
    document_tokens_per_page: int = 512


def escape(c: Column) -> Column:
    """Reversible escape of control strings."""
    c = F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for control in ("###", "</turn>", "<|"):
        c = F.replace(c, F.lit(control), F.lit("\\" + control))
    return c


def unescape(c: Column) -> Column:
    """Inverse of :func:`escape`."""
    return F.regexp_replace(c, r"\\(\\|###|</turn>|<\|)", "$1")


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit(":"), F.lit("\\;"))


def unescape_role(c: Column) -> Column:
    return unescape(F.regexp_replace(c, r"(?<!\\)((?:\\\\)*)\\;", "$1:"))


def text_parts(text: Column) -> Column:
    """A plain text as a list of one text part."""
    null = F.lit(None)
    return F.array(F.struct(
        F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), null.cast("string").alias("ref"),
        null.cast("int").alias("width"), null.cast("int").alias("height"), null.cast("double").alias("seconds"),
        null.cast("int").alias("pages"))).cast(PARTS)


def _tokens(p: Column, e: Expansion) -> Column:
    nz = lambda c: F.coalesce(c, F.lit(0))
    image = F.ceil(nz(p["width"]) / e.image_patch) * F.ceil(nz(p["height"]) / e.image_patch)
    return (F.when(p["kind"] == "image", image.cast("long"))
            .when(p["kind"] == "audio", F.ceil(nz(p["seconds"]) * e.audio_tokens_per_second).cast("long"))
            .when(p["kind"] == "document", nz(p["pages"]).cast("long") * e.document_tokens_per_page)
            .otherwise(F.lit(0).cast("long")))


def format_conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text", parts: str | None = None, loss_role: str = "assistant",
                         expansion: Expansion = Expansion()) -> DataFrame:
    """One row per conversation: ``conv_id, formatted, loss_spans, attachments, expanded_tokens``.

    ``loss_spans`` are 0-based code point (start, length) spans of ``formatted``
    under the loss mask: the contents of ``loss_role`` turns, without markers.
    ``attachments`` has (turn_index, index, kind, ref, tokens) in order.
    ``parts`` names a column of type ``PARTS``; without it ``text`` is the only part.
    """
    content = F.col(parts).cast(PARTS) if parts else text_parts(F.col(text))
    rows = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.struct(F.col(turn).alias("t"), F.coalesce(F.col(role), F.lit("")).alias("r"),
                 F.filter(F.coalesce(content, F.array().cast(PARTS)), lambda p: p.isNotNull()).alias("p")).alias("m"))
    conv = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("ms"))

    is_text = lambda p: F.coalesce(p["kind"], F.lit("text")) == "text"
    media = lambda m: F.filter(m["p"], lambda p: ~is_text(p))
    # attachments before each turn: running count over the turns
    zero = F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("at"))
    conv = conv.withColumn("at", F.aggregate(
        "ms", zero, lambda acc, m: F.struct((acc["n"] + F.size(media(m))).alias("n"),
                                            F.concat(acc["at"], F.array(acc["n"])).alias("at")))["at"])

    def visit(m: Column, at: Column) -> Column:
        start = F.struct(F.lit("").alias("s"), at.alias("k"))
        return F.aggregate(m["p"], start, lambda acc, p: F.when(
            is_text(p), F.struct(F.concat(acc["s"], escape(p["text"])).alias("s"), acc["k"].alias("k"))).otherwise(
            F.struct(F.concat(acc["s"], F.lit("<|"), escape_role(p["kind"]), F.lit(":"), acc["k"].cast("string"),
                              F.lit("|>")).alias("s"), (acc["k"] + 1).alias("k"))))["s"]

    conv = conv.withColumn("ts", F.zip_with("ms", "at", lambda m, at: F.struct(
        m["r"].alias("role"), F.concat(F.lit(HEAD), escape_role(m["r"]), F.lit(MID)).alias("head"),
        visit(m, at).alias("body"))))
    attach = F.flatten(F.transform(F.zip_with("ms", "at", lambda m, at: F.struct(m.alias("m"), at.alias("at"))),
                                   lambda x, i: F.transform(media(x["m"]), lambda p, j: F.struct(
                                       i.alias("turn_index"), (x["at"] + j).alias("index"), p["kind"].alias("kind"),
                                       p["ref"].alias("ref"), _tokens(p, expansion).alias("tokens")))))
    spans = F.aggregate(
        "ts", F.struct(F.lit(0).cast("long").alias("at"),
                       F.array().cast("array<struct<start:long,length:long>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(t["head"]) + F.length(t["body"]) + len(END) + len(SEP)).cast("long").alias("at"),
            F.when(t["role"] == loss_role, F.concat(acc["spans"], F.array(F.struct(
                (acc["at"] + F.length(t["head"])).cast("long").alias("start"),
                F.length(t["body"]).cast("long").alias("length"))))).otherwise(acc["spans"]).alias("spans")))
    formatted = F.concat_ws("", F.transform("ts", lambda t: F.concat(t["head"], t["body"], F.lit(END + SEP))))
    return (conv.select("conv_id", formatted.alias("formatted"), spans["spans"].alias("loss_spans"),
                        attach.alias("attachments"))
            .withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"),
                                                       lambda a, x: a + x["tokens"])))


def read_back(formatted: Column) -> Column:
    """Turns ``array<struct<role, text>>`` parsed from a formatted conversation."""
    pieces = F.filter(F.split(formatted, F.lit(END + SEP)), lambda s: s != "")

    def turn(s: Column) -> Column:
        head_end = F.instr(s, ":")
        return F.struct(unescape_role(F.substring(s, F.lit(len(HEAD) + 1), head_end - 1 - len(HEAD))).alias("role"),
                        unescape(F.substring(s, head_end + len(MID), F.length(s))).alias("text"))

    return F.transform(pieces, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """Unescaped text under the loss mask, spans joined with nothing between."""
    return F.concat_ws("", F.transform(spans, lambda s: unescape(
        F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))))


PROBE = r"\### Assistant: </turn> ok"


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations plus conversation -7 (control strings in its texts), digests read back from the output."""
    from ranqa.llm.common import table

    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                           T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], schema)
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(probe)
    out = format_conversations(rows)
    back = out.select("conv_id", "formatted", "expanded_tokens", read_back(F.col("formatted")).alias("turns"),
                      loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    digest = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(digest, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


OP2_SQL = r"""
WITH rows AS (
  SELECT CAST(conv_id AS BIGINT) conv_id, CAST(turn AS BIGINT) turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, replace(replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), '<|', '\<|') AS body,
    replace(replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), '<|', '\<|'), ':', '\;') AS head
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + length(head) + 2 + length(body) + 9) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
