"""Question-answer corpus generation: template expansion over an entity catalog.

Four generators, one DataFrame each, all with the same output columns
``kind, id, sample_no, template_id, entity, question, labels, answer``:

* ``expand_base``: every template x ``num_samples`` draws, slot
  ``{package_name}`` filled with a drawn entity (whitespace removed);
* ``expand_advanced``: as base with four slots (entity, year, location,
  weather), each drawn independently per row, replaced in that order;
* ``no_entity_questions``: each template once, entity ``''``, labels tagged;
* ``negative_questions``: each text once, entity and labels ``''``.

Labels are tagged on the *template*, never on the filled text.  Each row's
draws are the four 32-bit slices of one md5 digest of
``(seed, kind, sample_no, template_id)``: reproducible, independent of
partitioning, and a re-run task draws the same values.  The sample axis is a
generator (``explode(sequence)``), not a join, and the entity lookup is an
equi-join on a dense catalog index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ranqa.functions.keyed import DEFAULT_SEED, digest_slice, keyed_digest
from ranqa.functions.text import json_object, strip_whitespace
from ranqa.operators.indexing import dense_index_counted
from ranqa.operators.tagger import DEFAULT_LEXICON, Lexicon, tag_string
from ranqa.session import bounded_broadcast

# Fixed values equal to the reference's.
NUM_SAMPLES = 1200
ENTITY_SLOT = "{package_name}"
YEAR_SLOT = "{year}"
LOCATION_SLOT = "{location}"
WEATHER_SLOT = "{weather}"
YEAR_RANGE = (2015, 2023)        # inclusive
ANSWER_ENTITY_KEY = "套餐名称"
ANSWER_LABELS_KEY = "关键信息"
LOCATIONS = [
    "北京", "天津", "河北", "山西", "内蒙古",
    "辽宁", "吉林", "黑龙江", "上海", "江苏",
    "浙江", "安徽", "福建", "江西", "山东",
    "河南", "湖北", "湖南", "广东", "广西",
    "海南", "重庆", "四川", "贵州", "云南",
    "西藏", "陕西", "甘肃", "青海", "宁夏",
    "新疆", "台湾", "香港", "澳门",
]
WEATHERS = ["天气晴朗", "天气多云", "天气阴沉", "天气寒冷",
            "天气炎热", "天气下雨", "天气下雪", "天气雾霾",
            "晴朗", "晴", "多云", "阴", "雨", "雪", "雾"]
# The system prompt as the reference's string literal evaluates (its adjacent
# literals swallow the empty quotes of the second example).
SYSTEM_PROMPT = ("你是中国移动（chinamobile）的问答助手。针对用户问话，提取出“套餐名称”及业务关键信息。"
                 "并以json格式提供，例如：如果套餐名称或关键信息存在，就填上具体内容，"
                 "如{\"套餐名称\":\"xxx\"，\"关键信息\":\"xxx，xxx，...\"},如果不存在，就置为空字符串，"
                 "例如：{\"套餐名称\":，\"关键信息\":}")

KINDS = ("base", "advanced", "negative", "no_entity")   # corpus order
OUT_COLS = ["kind", "id", "sample_no", "template_id", "entity", "question", "labels", "answer"]


def answer_json(entity, labels) -> Column:
    """``{"<entity key>": "...", "<labels key>": "..."}`` with ", " / ": " separators."""
    e = F.col(entity) if isinstance(entity, str) else entity
    lab = F.col(labels) if isinstance(labels, str) else labels
    return json_object([(ANSWER_ENTITY_KEY, e), (ANSWER_LABELS_KEY, lab)])


def indexed_entities(catalog: DataFrame, name_col: str = "name") -> tuple[DataFrame, int]:
    """Distinct raw entity names with a dense index ``idx`` and their
    whitespace-free form ``entity``; plus their count.

    The reference draws from the distinct *raw* names and strips whitespace
    after the draw, so the index runs over raw names; stripping is done here
    once per entity instead of once per generated row.
    """
    names = catalog.select(F.col(name_col).alias("name")).where(F.col("name").isNotNull()).distinct()
    idx, n = dense_index_counted(names, ["name"])
    return idx.withColumn("entity", strip_whitespace("name")), n


def ordered_templates(templates: DataFrame, keep_blank: bool = True,
                      order_cols: list[str] | None = None) -> tuple[DataFrame, int]:
    """``template_id, template`` plus dense ``template_ord`` in ``order_cols`` order
    (default ``template_id``).  Blank lines are templates like any other; ``keep_blank=False`` leaves them out."""
    order_cols = order_cols or ["template_id"]
    cols = list(dict.fromkeys(["template_id", "template", *order_cols]))
    t = templates.select(*cols).where(F.col("template").isNotNull())
    if not keep_blank:
        t = t.where(F.col("template") != "")
    return dense_index_counted(t, order_cols, "template_ord")


# Base templates are filled like ``str.format(package_name=...)``: scanned left
# to right, "{{" and "}}" are literal braces, "{package_name}" is the field,
# and any other brace makes the call fail (the template is dropped).  Each
# token is wrapped in two control characters once per template; the fill is
# then plain literal replacement per row.
FORMAT_TOKEN = r"\{\{|\}\}|\{package_name\}|[{}]"
_OPEN, _CLOSE = "\u0001", "\u0002"


def _format_marked(template: Column) -> Column:
    return F.regexp_replace(template, FORMAT_TOKEN, _OPEN + "$0" + _CLOSE)


def _valid_base(marked: Column) -> Column:
    return ~(F.instr(marked, _OPEN + "{" + _CLOSE) > 0) & ~(F.instr(marked, _OPEN + "}" + _CLOSE) > 0)


def template_rejects(templates: DataFrame) -> DataFrame:
    """``template_id, template, reason`` of the base templates that cannot be filled: null ones, and those with a
    brace other than ``{{``, ``}}`` and the plain entity slot (``{package_name!r}`` and format specs included).

    :func:`expand_base` generates nothing for exactly these rows; a job that must not lose any
    checks that this table is empty.
    """
    bad = ~_valid_base(_format_marked(F.col("template")))
    reason = F.when(F.col("template").isNull(), "null").when(bad, "format")
    return templates.select("template_id", "template", reason.alias("reason")).where("reason is not null")


def _fill_base(marked: Column, entity: Column) -> Column:
    out = F.replace(marked, F.lit(_OPEN + "{{" + _CLOSE), F.lit("{"))
    out = F.replace(out, F.lit(_OPEN + "}}" + _CLOSE), F.lit("}"))
    return F.replace(out, F.lit(_OPEN + ENTITY_SLOT + _CLOSE), entity)


SAMPLE_BLOCK = 64             # samples generated per (template, block) row
ROWS_PER_TASK = 500_000       # target generated rows per task


def _samples(templates: DataFrame, num_samples: int, lexicon: Lexicon, n_templates: int) -> DataFrame:
    """Tag each template once, then fan it out to ``num_samples`` rows.

    The template table is tiny (and may sit in one partition after its
    index), so the fan-out is two-level: (template, block) rows are spread
    over enough tasks with a small hash shuffle, then each block explodes to
    its samples inside its task.  The generated rows never cross a shuffle.
    """
    spark = templates.sparkSession
    n_blocks = -(-num_samples // SAMPLE_BLOCK)
    tasks = max(spark.sparkContext.defaultParallelism,
                -(-(n_templates * num_samples) // ROWS_PER_TASK))
    blocks = (templates.withColumn("labels", tag_string(F.col("template"), lexicon))
              .withColumn("_blk", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
              .repartition(min(tasks, max(1, n_templates * n_blocks)), "template_id", "_blk"))
    lo = F.col("_blk") * F.lit(SAMPLE_BLOCK)
    hi = F.least(lo + F.lit(SAMPLE_BLOCK), F.lit(num_samples)) - F.lit(1)
    return blocks.withColumn("sample_no", F.explode(F.sequence(lo, hi))).drop("_blk")


def _draw_entity(rows: DataFrame, entities: tuple[DataFrame, int], seed: int, kind: str) -> DataFrame:
    """One md5 per row; its first 32 bits pick the entity (equi-join on the index)."""
    ents, n_entities = entities
    rows = (rows.withColumn("_digest", keyed_digest(seed, F.lit(kind), F.col("sample_no"), F.col("template_id")))
            .withColumn("_eidx", F.pmod(digest_slice(F.col("_digest"), 0), F.lit(n_entities))))
    ents = bounded_broadcast(ents.select(F.col("idx").alias("_eidx"), "entity"), known_rows=n_entities)
    return rows.join(ents, "_eidx")


def _finish(rows: DataFrame, n_t: int, question: Column, kind: str) -> DataFrame:
    return (rows
            .withColumn("id", F.col("sample_no").cast("bigint") * F.lit(n_t) + F.col("template_ord") + F.lit(1))
            .withColumn("question", question)
            .withColumn("answer", answer_json("entity", "labels"))
            .withColumn("kind", F.lit(kind))
            .select(*OUT_COLS))


def expand_base(templates: DataFrame, catalog: DataFrame | None = None, *, num_samples: int = NUM_SAMPLES,
                seed: int = DEFAULT_SEED, lexicon: Lexicon = DEFAULT_LEXICON,
                name_col: str = "name", keep_blank: bool = True,
                entities: tuple[DataFrame, int] | None = None) -> DataFrame:
    """Base kind.  Pass ``entities=indexed_entities(catalog)`` to share one
    catalog index between generators."""
    t, n_t = ordered_templates(templates, keep_blank)
    t = t.withColumn("_marked", _format_marked(F.col("template"))).where(_valid_base(F.col("_marked")))
    entities = entities or indexed_entities(catalog, name_col)
    rows = _draw_entity(_samples(t, num_samples, lexicon, n_t), entities, seed, "base")
    return _finish(rows, n_t, _fill_base(F.col("_marked"), F.col("entity")), "base")


def expand_advanced(templates: DataFrame, catalog: DataFrame | None = None, *,
                    num_samples: int = NUM_SAMPLES, seed: int = DEFAULT_SEED,
                    lexicon: Lexicon = DEFAULT_LEXICON, name_col: str = "name",
                    locations: list[str] = LOCATIONS, weathers: list[str] = WEATHERS,
                    years: tuple[int, int] = YEAR_RANGE, keep_blank: bool = True,
                    entities: tuple[DataFrame, int] | None = None) -> DataFrame:
    """Advanced kind: entity, year, location, weather drawn independently per
    row from the four 32-bit slices of one digest, replaced in that order."""
    t, n_t = ordered_templates(templates, keep_blank)
    entities = entities or indexed_entities(catalog, name_col)
    rows = _draw_entity(_samples(t, num_samples, lexicon, n_t), entities, seed, "advanced")
    d = F.col("_digest")
    year = (F.lit(years[0]) + F.pmod(digest_slice(d, 1), F.lit(years[1] - years[0] + 1))).cast("string")
    loc = F.element_at(F.array(*[F.lit(x) for x in locations]),
                       (F.pmod(digest_slice(d, 2), F.lit(len(locations))) + 1).cast("int"))
    wea = F.element_at(F.array(*[F.lit(x) for x in weathers]),
                       (F.pmod(digest_slice(d, 3), F.lit(len(weathers))) + 1).cast("int"))
    filled = F.replace(F.replace(F.replace(F.replace(
        F.col("template"), F.lit(ENTITY_SLOT), F.col("entity")),
        F.lit(YEAR_SLOT), year), F.lit(LOCATION_SLOT), loc), F.lit(WEATHER_SLOT), wea)
    return _finish(rows, n_t, filled, "advanced")


def no_entity_questions(templates: DataFrame, *, lexicon: Lexicon = DEFAULT_LEXICON,
                        keep_blank: bool = True, order_cols: list[str] | None = None) -> DataFrame:
    t, _ = ordered_templates(templates, keep_blank, order_cols)
    return (t.withColumn("id", F.col("template_ord") + F.lit(1))
            .withColumn("sample_no", F.lit(0).cast("int"))
            .withColumn("entity", F.lit(""))
            .withColumn("question", F.col("template"))
            .withColumn("labels", tag_string(F.col("template"), lexicon))
            .withColumn("answer", answer_json("entity", "labels"))
            .withColumn("kind", F.lit("no_entity"))
            .select(*OUT_COLS))


def negative_questions(texts: DataFrame, *, keep_blank: bool = True,
                       order_cols: list[str] | None = None) -> DataFrame:
    t, _ = ordered_templates(texts, keep_blank, order_cols)
    return (t.withColumn("id", F.col("template_ord") + F.lit(1))
            .withColumn("sample_no", F.lit(0).cast("int"))
            .withColumn("entity", F.lit(""))
            .withColumn("question", F.col("template"))
            .withColumn("labels", F.lit(""))
            .withColumn("answer", answer_json("entity", "labels"))
            .withColumn("kind", F.lit("negative"))
            .select(*OUT_COLS))


def conversation_record(id_col, system, user, assistant) -> Column:
    """``struct<id, conversations: array<struct<from, value>>>``: system, user, assistant."""
    def turn(role: str, value) -> Column:
        v = value if isinstance(value, Column) else F.col(value)
        return F.struct(F.lit(role).alias("from"), v.alias("value"))

    i = F.col(id_col) if isinstance(id_col, str) else id_col
    sysv = system if isinstance(system, Column) else F.lit(system)
    return F.struct(i.alias("id"), F.array(turn("system", sysv), turn("user", user),
                                           turn("assistant", assistant)).alias("conversations"))


def with_records(corpus: DataFrame, prompt: str = SYSTEM_PROMPT) -> DataFrame:
    """Add the chat record and its JSON text to generated rows."""
    rec = conversation_record("id", F.lit(prompt), "question", "answer")
    return corpus.withColumn("record", rec).withColumn("record_json", F.to_json(F.col("record")))


def union_corpus(parts: list[DataFrame]) -> DataFrame:
    """Bag union in corpus order; ``(kind, id)`` is the record key (ids restart per kind)."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    return out.withColumn("kind_ord", order)


def conversation_regroup(turns: DataFrame) -> DataFrame:
    """Turn table (conv_id, turn, role, text) -> one record per conversation with every
    turn: ``conv_id, conversations array<struct<turn, from, value>>`` in turn order
    (turns that repeat a number follow role and text)."""
    t = F.struct(F.col("turn"), F.col("role").alias("from"), F.col("text").alias("value"))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(t)).alias("conversations"))


def conversation_turns(records: DataFrame) -> DataFrame:
    """Inverse of :func:`conversation_regroup`."""
    return records.select("conv_id", F.explode("conversations").alias("t")).select(
        "conv_id", "t.turn", F.col("t.from").alias("role"), F.col("t.value").alias("text"))


def exchange_records(turns: DataFrame) -> DataFrame:
    """Every turn of a turn table (conv_id, turn, role, text) in a question-answer record or listed as unmatched.

    A user turn and the assistant turn with the next number make one row: ``conv_id, turn, role, id, status, question, answer``
    with status ``record`` and ``id`` dense from 1 in (conv_id, turn) order; the assistant turn is in it.  Other turns have a row of
    their own without id: ``unanswered`` (user), ``unasked`` (assistant) or ``other role``.  Rows that repeat a (conv_id,
    turn, role) are matched in the order of their texts.  A null text is ''.
    """
    number = Window.partitionBy("conv_id", "turn", "role").orderBy(F.col("text").asc_nulls_first())
    t = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text",
                     F.row_number().over(number).alias("copy")).withColumn("text", F.coalesce("text", F.lit("")))
    # both sides of an exchange under the user turn's number: one aggregation instead of a join
    side = F.when(F.col("role") == "user", "u").when(F.col("role") == "assistant", "a")
    at = F.when(F.col("role") == "assistant", F.col("turn") - 1).otherwise(F.col("turn"))
    sides = t.where(side.isNotNull()).select("conv_id", at.alias("at"), "copy", side.alias("side"), "text")
    met = sides.groupBy("conv_id", "at", "copy").agg(F.max(F.when(F.col("side") == "u", F.col("text"))).alias("question"),
                                                      F.max(F.when(F.col("side") == "a", F.col("text"))).alias("answer"))
    both = F.col("question").isNotNull() & F.col("answer").isNotNull()
    pairs, _ = dense_index_counted(met.where(both), ["conv_id", "at", "copy"], "idx")
    records = pairs.select("conv_id", F.col("at").alias("turn"), F.lit("user").alias("role"), (F.col("idx") + 1).alias("id"),
                           F.lit("record").alias("status"), "question", "answer")
    asked = F.col("question").isNotNull()
    alone = met.where(~both).select(
        "conv_id", F.when(asked, F.col("at")).otherwise(F.col("at") + 1).alias("turn"),
        F.when(asked, "user").otherwise("assistant").alias("role"), F.lit(None).cast("long").alias("id"),
        F.when(asked, "unanswered").otherwise("unasked").alias("status"), "question", "answer")
    other = t.where(side.isNull()).select("conv_id", "turn", "role", F.lit(None).cast("long").alias("id"),
                                          F.lit("other role").alias("status"), F.col("text").alias("question"),
                                          F.lit(None).cast("string").alias("answer"))
    return records.unionByName(alone).unionByName(other)
