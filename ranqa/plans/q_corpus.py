"""Registered queries of the corpus side: catalog, tagging, template expansion,
answers, chat records, split, shuffle."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ranqa.functions.text import strip_whitespace
from ranqa.operators.corpus_jobs import shuffled_by_kind
from ranqa.operators.indexing import dense_index_counted
from ranqa.operators.permute import in_permuted_order, permuted
from ranqa.operators.split import (VAL_FRACTION, exact_split, finetune_split, hash_split,
                                   keyed_shuffle)
from ranqa.operators.tagger import keyword_hits, tag_labels, tag_string
from ranqa.operators.templates import (KINDS, LOCATIONS, SYSTEM_PROMPT, WEATHERS, conversation_record,
                                       conversation_regroup, conversation_turns, exchange_records,
                                       expand_advanced, expand_base, indexed_entities, negative_questions,
                                       no_entity_questions, template_rejects, union_corpus, with_records)
from ranqa.plans.registry import register
from ranqa.plans.sql_common import (q, sql_answer, sql_hash60, sql_keyword_hits, sql_list, sql_permuted,
                                    sql_strip_ws, sql_tag_labels, sql_tag_string)
from ranqa.session import shared_dir
from ranqa.sources.catalog import column_union, distinct_catalog, read_lines
from ranqa.sources.sinks import read_jsonl, write_jsonl, write_splits
from ranqa.sources.tables import table

# Parameters of the registered queries (not the reference's data, which is not
# shipped): a lexicon that occurs in the driver's prose, and the sample count.
TEST_LEXICON = [
    ("english", ["the", "and", "ing"]),
    ("suffix", ["tion", "ción"]),
    ("german", ["und", "ein"]),
    ("romance", ["que", "les"]),
    ("license", ["Licen", "SPDX"]),
    ("contact", ["@", "http"]),
    ("secret", ["token", "password"]),
]
SAMPLES = 1200
SEED = 42


# ---------------------------------------------------------------- inputs ---

def sheets(spark, sf):
    """Catalog "sheets": part names and nation names carry column Q; supplier has none."""
    return [table(spark, sf, "part").select(F.col("p_name").alias("Q"), "p_partkey"),
            table(spark, sf, "supplier"),
            table(spark, sf, "nation").select(F.col("n_name").alias("Q"))]


def base_templates(spark, sf):
    b = table(spark, sf, "benchmark")
    return b.select(F.col("item_id").alias("template_id"),
                    F.regexp_replace("text", r"^\S+", "{package_name}").alias("template"))


def advanced_templates(spark, sf):
    return base_templates(spark, sf).select(
        "template_id", F.concat(F.lit("{location} {year} {weather} "), F.col("template")).alias("template"))


def turn_texts(spark, sf, role):
    c = table(spark, sf, "conversations").where(F.col("role") == role)
    return c.select(F.col("conv_id").alias("template_id"), "turn", F.col("text").alias("template"))


def catalog(spark, sf):
    return distinct_catalog(sheets(spark, sf), "Q", "name")


def corpus(spark, sf):
    ents = indexed_entities(catalog(spark, sf))      # one catalog index for both kinds
    parts = [
        expand_base(base_templates(spark, sf), entities=ents, num_samples=SAMPLES, seed=SEED,
                    lexicon=TEST_LEXICON),
        expand_advanced(advanced_templates(spark, sf), entities=ents, num_samples=SAMPLES, seed=SEED,
                        lexicon=TEST_LEXICON),
        negative_questions(turn_texts(spark, sf, "assistant"), order_cols=["template_id", "turn"]),
        no_entity_questions(turn_texts(spark, sf, "user"), lexicon=TEST_LEXICON,
                            order_cols=["template_id", "turn"]),
    ]
    return union_corpus(parts)


SQL_NAMES = """
names AS (
  SELECT DISTINCT name FROM (SELECT p_name AS name FROM part UNION ALL SELECT n_name AS name FROM nation)
  WHERE name IS NOT NULL),
ents AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS idx, count(*) OVER () AS n FROM names)"""

SQL_BASE_TPL = r"""
btpl0 AS (
  SELECT item_id AS template_id, regexp_replace(text, '^\S+', '{package_name}') AS template
  FROM benchmark WHERE text IS NOT NULL),
btpl AS (
  SELECT *, row_number() OVER (ORDER BY template_id) - 1 AS template_ord, count(*) OVER () AS n_t
  FROM btpl0)"""


def _slice(dg: str, i: int) -> str:
    return f"CAST('0x' || substr({dg}, {8 * i + 1}, 8) AS BIGINT)"


def _sql_samples(kind: str, tpl: str) -> str:
    return f"""
{kind}_s AS (
  SELECT t.*, g.range AS sample_no FROM {tpl} t CROSS JOIN range(0, {SAMPLES}) g),
{kind}_h AS (SELECT *, md5(concat_ws('|', {q(str(SEED))}, {q(kind)}, sample_no, template_id)) AS dg FROM {kind}_s),
{kind}_d AS (
  SELECT s.*, e.name AS raw_name FROM {kind}_h s JOIN ents e
    ON e.idx = {_slice('s.dg', 0)} % e.n),
{kind}_e AS (SELECT *, {sql_strip_ws('raw_name')} AS entity FROM {kind}_d)"""


SQL_BMARKED = r"""
bmarked AS (
  SELECT *, regexp_replace(template, '\{\{|\}\}|\{package_name\}|[{}]', chr(1) || '\0' || chr(2), 'g') AS marked
  FROM btpl)"""
SQL_BVALID = ("(SELECT * FROM bmarked WHERE NOT (contains(marked, chr(1) || '{' || chr(2)) "
              "OR contains(marked, chr(1) || '}' || chr(2))))")
SQL_BFILL = ("replace(replace(replace(marked, chr(1) || '{{' || chr(2), '{'), chr(1) || '}}' || chr(2), '}'), "
             "chr(1) || '{package_name}' || chr(2), entity)")

SQL_BASE = f"""
{SQL_BASE_TPL},
{SQL_BMARKED},
{_sql_samples('base', SQL_BVALID)},
base AS (
  SELECT 'base' AS kind, sample_no * n_t + template_ord + 1 AS id, sample_no, template_id, entity,
         {SQL_BFILL} AS question,
         {sql_tag_string('template', TEST_LEXICON)} AS labels
  FROM base_e)"""

_YEAR = f"CAST(2015 + {_slice('dg', 1)} % 9 AS VARCHAR)"
_LOC = f"{sql_list(LOCATIONS)}[{_slice('dg', 2)} % {len(LOCATIONS)} + 1]"
_WEA = f"{sql_list(WEATHERS)}[{_slice('dg', 3)} % {len(WEATHERS)} + 1]"

SQL_ADV = f"""
atpl AS (
  SELECT template_id, '{{location}} {{year}} {{weather}} ' || template AS template, template_ord, n_t FROM btpl),
{_sql_samples('advanced', 'atpl')},
advanced AS (
  SELECT 'advanced' AS kind, sample_no * n_t + template_ord + 1 AS id, sample_no, template_id, entity,
         replace(replace(replace(replace(template, '{{package_name}}', entity), '{{year}}', {_YEAR}),
                 '{{location}}', {_LOC}), '{{weather}}', {_WEA}) AS question,
         {sql_tag_string('template', TEST_LEXICON)} AS labels
  FROM advanced_e)"""


def _sql_turn_kind(kind: str, role: str, tagged: bool) -> str:
    labels = sql_tag_string("text", TEST_LEXICON) if tagged else "''"
    return f"""
{kind} AS (
  SELECT '{kind}' AS kind, row_number() OVER (ORDER BY conv_id, turn) AS id, 0 AS sample_no,
         conv_id AS template_id, '' AS entity, text AS question, {labels} AS labels
  FROM conversations WHERE role = '{role}' AND text IS NOT NULL)"""


SQL_CORPUS = ("WITH " + SQL_NAMES + "," + SQL_BASE + "," + SQL_ADV + "," +
              _sql_turn_kind("negative", "assistant", False) + "," +
              _sql_turn_kind("no_entity", "user", True) + """,
corpus0 AS (
  SELECT * FROM base UNION ALL SELECT * FROM advanced UNION ALL SELECT * FROM negative
  UNION ALL SELECT * FROM no_entity),
corpus AS (SELECT *, """ + sql_answer("entity", "labels") + """ AS answer FROM corpus0)
""")


def _rec_sql(id_: str, user: str, assistant: str) -> str:
    return (f"CAST(to_json({{'id': {id_}, 'conversations': [{{'from': 'system', 'value': {q(SYSTEM_PROMPT)}}}, "
            f"{{'from': 'user', 'value': {user}}}, {{'from': 'assistant', 'value': {assistant}}}]}}) AS VARCHAR)")


# --------------------------------------------------------------- queries ---

@register("catalog_distinct", "S1 U1 A9: column union over sheets, distinct",
          "WITH " + SQL_NAMES + " SELECT name FROM names")
def catalog_distinct(spark, sf):
    return catalog(spark, sf)


@register("catalog_bag_counts", "S1 U1: bag union before distinct, multiplicity per name", """
SELECT name, count(*) AS n FROM (SELECT p_name AS name FROM part UNION ALL SELECT n_name AS name FROM nation)
WHERE name IS NOT NULL GROUP BY name""")
def catalog_bag_counts(spark, sf):
    return column_union(sheets(spark, sf), "Q", "name").groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@register("strip_whitespace", "X6: Unicode whitespace removal over names and chat turns", f"""
SELECT 'part' AS src, p_partkey AS k1, 0 AS k2, {sql_strip_ws('p_name')} AS stripped,
       length(p_name) - length({sql_strip_ws('p_name')}) AS removed FROM part
UNION ALL
SELECT 'conversations', conv_id, turn, {sql_strip_ws('text')},
       length(text) - length({sql_strip_ws('text')}) FROM conversations""")
def strip_ws_q(spark, sf):
    p = table(spark, sf, "part").select(F.lit("part").alias("src"), F.col("p_partkey").alias("k1"),
                                        F.lit(0).cast("bigint").alias("k2"), F.col("p_name").alias("t"))
    c = table(spark, sf, "conversations").select(F.lit("conversations").alias("src"),
                                                 F.col("conv_id").alias("k1"), F.col("turn").alias("k2"),
                                                 F.col("text").alias("t"))
    u = p.unionByName(c).withColumn("stripped", strip_whitespace("t"))
    return u.select("src", "k1", "k2", "stripped",
                    (F.char_length("t") - F.char_length("stripped")).alias("removed"))


@register("keyword_tags", "D9 J4 J5 A10 X11: per-document keyword hits and distinct labels", f"""
SELECT doc_id, array_to_string({sql_keyword_hits('text', TEST_LEXICON)}, ',') AS hits,
       len({sql_keyword_hits('text', TEST_LEXICON)}) AS n_hits,
       {sql_tag_string('text', TEST_LEXICON)} AS labels FROM documents""")
def keyword_tags(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", keyword_hits("text", TEST_LEXICON).alias("hits"))
    return d.select("doc_id", F.array_join("hits", ",").alias("hits"), F.size("hits").alias("n_hits"),
                    F.array_join(F.array_distinct("hits"), ",").alias("labels"))


@register("keyword_tag_counts", "D9 + count: documents per label and language", f"""
SELECT lab AS label, lang, count(*) AS n_docs
FROM (SELECT lang, unnest({sql_tag_labels('text', TEST_LEXICON)}) AS lab FROM documents)
GROUP BY lab, lang""")
def keyword_tag_counts(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "text")
    return (d.select("lang", F.explode(tag_labels("text", TEST_LEXICON)).alias("label"))
            .groupBy("label", "lang").agg(F.count(F.lit(1)).alias("n_docs")))


_CORPUS_COLS = "kind, id, sample_no, template_id, entity, question, labels, answer"


@register("template_base", "D10 J1 J2 G1 X7 W6: base templates x keyed entity draws",
          SQL_CORPUS + f"SELECT {_CORPUS_COLS} FROM corpus WHERE kind = 'base'")
def template_base(spark, sf):
    return expand_base(base_templates(spark, sf), catalog(spark, sf), num_samples=SAMPLES, seed=SEED,
                       lexicon=TEST_LEXICON)


@register("template_advanced", "D13 J3 X8: four-slot templates, independent draws per row",
          SQL_CORPUS + f"SELECT {_CORPUS_COLS} FROM corpus WHERE kind = 'advanced'")
def template_advanced(spark, sf):
    return expand_advanced(advanced_templates(spark, sf), catalog(spark, sf), num_samples=SAMPLES,
                           seed=SEED, lexicon=TEST_LEXICON)


@register("template_no_entity", "D11 P11: one row per template, empty entity, tagged labels",
          SQL_CORPUS + f"SELECT {_CORPUS_COLS} FROM corpus WHERE kind = 'no_entity'")
def template_no_entity(spark, sf):
    return no_entity_questions(turn_texts(spark, sf, "user"), lexicon=TEST_LEXICON,
                               order_cols=["template_id", "turn"])


@register("template_negative", "D12 P11: negatives, both answer fields empty",
          SQL_CORPUS + f"SELECT {_CORPUS_COLS} FROM corpus WHERE kind = 'negative'")
def template_negative(spark, sf):
    return negative_questions(turn_texts(spark, sf, "assistant"), order_cols=["template_id", "turn"])


@register("answer_json", "X13 P11: answer objects of every corpus record (entity, tagged labels)",
          SQL_CORPUS + "SELECT kind, id, entity, labels, answer FROM corpus")
def answer_json_q(spark, sf):
    return corpus(spark, sf).select("kind", "id", "entity", "labels", "answer")


@register("qa_table", "S6 U3 X13: the merged Q/A table with JSON answers",
          SQL_CORPUS + "SELECT kind, id, question AS Q, answer AS A FROM corpus")
def qa_table(spark, sf):
    return corpus(spark, sf).select("kind", "id", F.col("question").alias("Q"), F.col("answer").alias("A"))


def _kind_sizes(spark, sf):
    """Ids of every kind run from 1 to this number: known from the inputs, not from the generated rows."""
    n = base_templates(spark, sf).where("template is not null").count() * SAMPLES
    turns = lambda role: turn_texts(spark, sf, role).where("template is not null").count()
    return {"base": n, "advanced": n, "negative": turns("assistant"), "no_entity": turns("user")}


@register("conversation_records", "D14 X14 U2 T4 S4: chat records of the corpus, kinds in order, permuted within each",
          SQL_CORPUS + f""",
sized AS (SELECT *, CASE WHEN kind IN ('base', 'advanced') THEN (SELECT count(*) FROM btpl) * {SAMPLES}
                    ELSE count(*) OVER (PARTITION BY kind) END AS kind_n FROM corpus),
starts AS (SELECT kind, max(kind_n) AS n FROM sized GROUP BY kind),
placed AS (
  SELECT s.*, {sql_permuted('s.id - 1', 's.kind_n', SEED)} + coalesce((
      SELECT sum(n) FROM starts t WHERE list_position({sql_list(list(KINDS))}, t.kind) < list_position({sql_list(list(KINDS))}, s.kind)), 0)
    AS place FROM sized s)
SELECT kind, id, CAST(place AS BIGINT) AS place, {_rec_sql('id', 'question', 'answer')} AS record_json FROM placed""")
def conversation_records(spark, sf):
    # rows move once, before the JSON with its constant prompt is built
    rows, n = shuffled_by_kind(corpus(spark, sf), _kind_sizes(spark, sf), SEED)
    ordered = in_permuted_order(rows, "place", n, spark.sparkContext.defaultParallelism)
    return with_records(ordered).select("kind", "id", "place", "record_json")


@register("corpus_counts", "D16 A12 U2 U4: records per kind and in total (rollup)",
          SQL_CORPUS + """
SELECT kind, count(*) AS n FROM corpus GROUP BY ROLLUP (kind)""")
def corpus_counts(spark, sf):
    return corpus(spark, sf).rollup("kind").agg(F.count(F.lit(1)).alias("n"))


def _qa(spark, sf):
    return corpus(spark, sf).select("kind", "id", F.col("question").alias("Q"), F.col("answer").alias("A"))


_SQL_SPLIT = SQL_CORPUS + f""",
qa AS (SELECT kind, id, question AS Q, answer AS A,
              {sql_hash60(SEED, q('split'), 'kind', 'id')} AS h FROM corpus),
ranked AS (SELECT *, row_number() OVER (ORDER BY h, kind, id) AS rn, count(*) OVER () AS n FROM qa)
"""


@register("split_exact", "G2 D15 P1 P2 T4: exact-size split, renamed, shuffled for export",
          _SQL_SPLIT + f"""
SELECT kind, id, CASE WHEN rn <= ceil({VAL_FRACTION} * n) THEN 'val' ELSE 'train' END AS split,
       Q AS query, A AS response, {sql_hash60(SEED, q('shuffle'), 'kind', 'id')} AS shuffle_key
FROM ranked""")
def split_exact(spark, sf):
    # the input is the generated corpus (expensive to re-derive): materialise it once
    return finetune_split(_qa(spark, sf), ["kind", "id"], seed=SEED, materialize=True)


_HASH_CUT = int(VAL_FRACTION * (1 << 60))


@register("split_hash", "G2: one-pass split by keyed hash threshold (expected size)",
          _SQL_SPLIT + f"""
SELECT kind, id, CASE WHEN h < {_HASH_CUT} THEN 'val' ELSE 'train' END AS split FROM qa""")
def split_hash(spark, sf):
    return hash_split(_qa(spark, sf), ["kind", "id"], seed=SEED).select("kind", "id", "split")


@register("split_sizes", "G2: split sizes, exact vs hash mode, over corpus and chat turns",
          _SQL_SPLIT + f""",
turns AS (
  SELECT conv_id, turn, {sql_hash60(SEED, q('split'), 'conv_id', 'turn')} AS h FROM conversations),
turns_ranked AS (SELECT *, row_number() OVER (ORDER BY h, conv_id, turn) AS rn, count(*) OVER () AS n FROM turns)
SELECT 'corpus' AS source, 'exact' AS mode, CASE WHEN rn <= ceil({VAL_FRACTION} * n) THEN 'val' ELSE 'train' END AS split,
       count(*) AS n FROM ranked GROUP BY ALL
UNION ALL
SELECT 'corpus', 'hash', CASE WHEN h < {_HASH_CUT} THEN 'val' ELSE 'train' END, count(*) FROM qa GROUP BY ALL
UNION ALL
SELECT 'turns', 'exact', CASE WHEN rn <= ceil({VAL_FRACTION} * n) THEN 'val' ELSE 'train' END, count(*)
FROM turns_ranked GROUP BY ALL
UNION ALL
SELECT 'turns', 'hash', CASE WHEN h < {_HASH_CUT} THEN 'val' ELSE 'train' END, count(*) FROM turns GROUP BY ALL""")
def split_sizes(spark, sf):
    qa = _qa(spark, sf)
    turns = table(spark, sf, "conversations").select("conv_id", "turn")
    out = []
    for src, df, keys in (("corpus", qa, ["kind", "id"]), ("turns", turns, ["conv_id", "turn"])):
        for mode, fn in (("exact", exact_split), ("hash", hash_split)):
            kw = {"materialize": True} if fn is exact_split and src == "corpus" else {}
            out.append(fn(df, keys, seed=SEED, **kw).groupBy("split").agg(F.count(F.lit(1)).alias("n"))
                       .select(F.lit(src).alias("source"), F.lit(mode).alias("mode"), "split", "n"))
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return res


@register("keyed_shuffle", "T4: reproducible shuffle of the chat-turn table", f"""
SELECT conv_id, turn, role, {sql_hash60(SEED, q('shuffle'), 'conv_id', 'turn')} AS shuffle_key
FROM conversations""")
def keyed_shuffle_q(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    return keyed_shuffle(c, ["conv_id", "turn"], seed=SEED)


@register("permuted_turns", "T4: keyed bijection of the turn table, rows moved to their places", f"""
WITH t AS (SELECT conv_id, turn, role, row_number() OVER (ORDER BY conv_id, turn, role, text) - 1 AS i, count(*) OVER () AS n
           FROM conversations)
SELECT conv_id, turn, role, {sql_permuted('i', 'n', SEED)} AS place FROM t""")
def permuted_turns(spark, sf):
    t = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    idx, n = dense_index_counted(t, ["conv_id", "turn", "role", "text"], "i")
    placed = idx.select("conv_id", "turn", "role", permuted("i", n, SEED).alias("place"))
    return in_permuted_order(placed, "place", n, spark.sparkContext.defaultParallelism)


def _scratch(spark, name):
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


@register("line_files", "S3 X9: chat turns written as several line files and read back with their line numbers", f"""
SELECT row_number() OVER (ORDER BY conv_id, turn, role, text) - 1 AS line_no,
  CASE WHEN turn % 3 = 2 THEN '' ELSE conv_id || '|' || turn || '|' || regexp_replace(text, '[\\r\\n]+', ' ', 'g') END AS value
FROM conversations WHERE text IS NOT NULL""")
def line_files(spark, sf):
    c = table(spark, sf, "conversations").where("text is not null")
    line = F.when(F.col("turn") % 3 == 2, "").otherwise(
        F.concat_ws("|", "conv_id", "turn", F.regexp_replace("text", r"[\r\n]+", " ")))
    path = _scratch(spark, "lines")
    (c.select("conv_id", "turn", "role", "text", line.alias("value")).repartitionByRange(5, "conv_id", "turn", "role", "text")
     .sortWithinPartitions("conv_id", "turn", "role", "text").select("value").write.text(path))
    return read_lines(spark, path)


@register("jsonl_nested", "S4: nested chat records written as JSON Lines and read back, null fields kept", f"""
SELECT conv_id AS id, turn, role AS "from", text AS value, CAST(NULL AS VARCHAR) AS note FROM conversations""")
def jsonl_nested(spark, sf):
    g = conversation_regroup(table(spark, sf, "conversations")).select(
        F.col("conv_id").alias("id"), F.col("conversations"), F.lit(None).cast("string").alias("note"))
    path = _scratch(spark, "records")
    write_jsonl(g, path)
    back = read_jsonl(spark, path, "id long, conversations array<struct<turn: long, `from`: string, value: string>>, note string")
    return back.select("id", F.explode("conversations").alias("t"), "note").select("id", "t.turn", "t.from", "t.value", "note")


@register("jsonl_splits", "S5 D15 G2: train and validation JSON Lines written in one pass and read back", f"""
WITH t AS (SELECT conv_id, turn, role, text, {sql_hash60(SEED, q('split'), 'conv_id', 'turn')} AS h FROM conversations),
ranked AS (SELECT *, row_number() OVER (ORDER BY h, conv_id, turn) AS rn, count(*) OVER () AS n FROM t)
SELECT CASE WHEN rn <= ceil(0.1 * n) THEN 'val' ELSE 'train' END AS split, text AS query,
  CASE WHEN role = 'assistant' THEN role END AS response FROM ranked""")
def jsonl_splits(spark, sf):
    t = exact_split(table(spark, sf, "conversations").select("conv_id", "turn", "role", "text"), ["conv_id", "turn"], fraction=0.1,
                    seed=SEED)
    path = _scratch(spark, "splits")
    write_splits(t.select("split", F.col("text").alias("query"), F.when(F.col("role") == "assistant", F.col("role")).alias("response")),
                 path)
    return read_jsonl(spark, path, "query string, response string, split string").select("split", "query", "response")


@register("turn_records", "D14 D18: every turn in a chat record (user turn + next assistant turn) or listed as unmatched", f"""
WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, role ORDER BY text NULLS FIRST) AS copy FROM conversations),
joined AS (
  SELECT u.conv_id, u.turn, u.role, u.copy, u.text, a.conv_id IS NOT NULL AS answered, a.text AS answer
  FROM t u LEFT JOIN t a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.copy = u.copy AND a.role = 'assistant'
    AND u.role = 'user'),
pairs AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn, copy) AS id FROM joined WHERE answered)
SELECT conv_id, turn, role, id, 'record' AS status,
  {_rec_sql('id', "coalesce(text, '')", "coalesce(answer, '')")} AS record_json FROM pairs
UNION ALL
SELECT conv_id, turn, role, 0, CASE role WHEN 'user' THEN 'unanswered' WHEN 'assistant' THEN 'unasked' ELSE 'other role' END, ''
FROM joined j WHERE NOT answered AND NOT (role = 'assistant' AND EXISTS (
  SELECT 1 FROM t u WHERE u.conv_id = j.conv_id AND u.turn = j.turn - 1 AND u.copy = j.copy AND u.role = 'user'))""")
def turn_records(spark, sf):
    t = exchange_records(table(spark, sf, "conversations"))
    rec = conversation_record(F.col("id"), F.lit(SYSTEM_PROMPT), "question", "answer")
    return t.select("conv_id", "turn", "role", F.coalesce("id", F.lit(0)).alias("id"), "status",
                    F.when(F.col("status") == "record", F.to_json(rec)).otherwise("").alias("record_json"))


@register("conversation_regroup", "D18: whole conversations, every turn kept in order", """
SELECT conv_id, count(*) AS n_turns, string_agg(role, '|' ORDER BY turn, role, text) AS roles,
       string_agg(text, chr(10) ORDER BY turn, role, text) AS texts
FROM conversations GROUP BY conv_id""")
def conversation_regroup_q(spark, sf):
    g = conversation_regroup(table(spark, sf, "conversations"))
    return g.select("conv_id", F.size("conversations").alias("n_turns"),
                    F.array_join(F.col("conversations")["from"], "|").alias("roles"),
                    F.array_join(F.col("conversations")["value"], "\n").alias("texts"))


@register("conversation_turns", "D18 inverse: turns of the regrouped conversations, equal to the turn table",
          "SELECT conv_id, turn, role, text FROM conversations")
def conversation_turns_q(spark, sf):
    return conversation_turns(conversation_regroup(table(spark, sf, "conversations")))


# more than 2,000 keywords: all pairs and some triples of letters, each shared by two labels
BIG_LEXICON = [(f"L{k:02d}", [a + b + c for a in "abcdefghij" for b in "aeiou" for c in chars])
               for k, chars in enumerate(["abcdefghijk", "hijklmnopqr", "qrstuvwxyz ", "a!?.,:;ghi"])]


@register("keyword_tags_large", "D9: over 2,000 keywords on whole texts and a null one, keywords that labels share", f"""
WITH d AS (SELECT doc_id, text AS t FROM documents UNION ALL SELECT -1, NULL),
kw AS (SELECT unnest({sql_list([kw for _, kws in BIG_LEXICON for kw in kws])}) AS k,
              unnest({sql_list([lab for lab, kws in BIG_LEXICON for _ in kws])}) AS l),
hits AS (SELECT doc_id, l FROM d JOIN kw ON contains(d.t, kw.k))
SELECT d.doc_id, count(h.l) AS n_hits, coalesce(string_agg(DISTINCT h.l, ',' ORDER BY h.l), '') AS labels
FROM d LEFT JOIN hits h ON d.doc_id = h.doc_id GROUP BY d.doc_id""")
def keyword_tags_large(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("t")).unionByName(
        spark.range(1).select(F.lit(-1).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("t")))
    hits = d.select("doc_id", keyword_hits("t", BIG_LEXICON).alias("hits"))
    return hits.select("doc_id", F.size("hits").alias("n_hits"),
                       F.array_join(F.array_distinct("hits"), ",").alias("labels"))


@register("template_rejects", "X7: base templates that cannot be filled, by reason", """
WITH t AS (
  SELECT item_id, v, CASE v WHEN 1 THEN '{package_name} ' || text WHEN 2 THEN '{package_name!r} ' || text
    WHEN 3 THEN 'a{b ' || text WHEN 4 THEN '{{x}} ' || text WHEN 5 THEN '' END AS t
  FROM benchmark, (VALUES (1), (2), (3), (4), (5), (6)) AS x(v))
SELECT CASE WHEN t IS NULL THEN 'null' ELSE 'format' END AS reason, CAST(v AS BIGINT) AS variant, count(*) AS n
FROM t WHERE t IS NULL OR v IN (2, 3) GROUP BY ALL""")
def template_rejects_q(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", "text", F.explode(F.array(*map(F.lit, range(1, 7)))).alias("v"))
    text = (F.when(F.col("v") == 1, F.concat(F.lit("{package_name} "), "text"))
            .when(F.col("v") == 2, F.concat(F.lit("{package_name!r} "), "text"))
            .when(F.col("v") == 3, F.concat(F.lit("a{b "), "text")).when(F.col("v") == 4, F.concat(F.lit("{{x}} "), "text"))
            .when(F.col("v") == 5, F.lit("")))
    t = b.select((F.col("item_id") * 10 + F.col("v")).alias("template_id"), text.alias("template"))
    return (template_rejects(t).withColumn("variant", F.col("template_id") % 10)
            .groupBy("reason", "variant").agg(F.count(F.lit(1)).alias("n")))
