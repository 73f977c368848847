import duckdb
from pyspark.sql import functions as F

from ranqa.llm import chat_format as C
from ranqa.llm import line_dedup as L

TURNS = "conv_id long, turn long, role string, text string, formatted string"


def test_round_trip_of_control_strings(spark):
    texts = ["", None, C.PROBE, "\\", "\\\\###", "a </turn>\n### user: b", "<|image:0|>", "é\U0001F600 </turn>", " "]
    roles = ["user", "assistant", "a:b", "x\\;y", "q\\:;", None, "###", "assistant", "user"]
    rows = [(1, i, r, t, "clash") for i, (r, t) in enumerate(zip(roles, texts))]
    out = C.format_conversations(spark.createDataFrame(rows, TURNS))
    got = out.select(C.read_back(F.col("formatted")).alias("t"),
                     C.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert [(x.role, x.text) for x in got.t] == [(r or "", t or "") for r, t in zip(roles, texts)]
    assert got.loss == "" + texts[7]


def test_repeats_nulls_and_order(spark):
    rows = [(None, 1, "assistant", "b", ""), (None, None, "user", "a", ""), (None, 1, "assistant", "b", "")]
    out = C.format_conversations(spark.createDataFrame(rows, TURNS)).collect()
    assert len(out) == 1
    assert out[0].formatted == "### user: a </turn>\n" + 2 * "### assistant: b </turn>\n"
    assert C.format_conversations(spark.createDataFrame([], TURNS)).count() == 0


def test_typed_parts(spark):
    part = "kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int"
    schema = f"conv_id long, turn long, role string, text string, parts array<struct<{part}>>"
    t = lambda s: ("text", s, None, None, None, None, None)
    rows = [(1, 0, "user", "", [t("see "), ("image", None, "a.png", 28, 15, None, None), t(" <|x"), None]),
            (1, 1, "assistant", "", [("audio", None, "b.wav", None, None, 1.5, None)]),
            (1, 2, "user", "", None),
            (1, 3, "user", "", [("document", None, "c.pdf", None, None, None, 3), ("other", None, "d", 1, 1, 1.0, 1)])]
    r = C.format_conversations(spark.createDataFrame(rows, schema), parts="parts").first()
    assert [x.text for x in spark.createDataFrame([(r.formatted,)], "f string")
            .select(C.read_back(F.col("f")).alias("t")).first().t] == [
        "see <|image:0|> <|x", "<|audio:1|>", "", "<|document:2|><|other:3|>"]
    assert [(a.turn_index, a["index"], a.kind, a.ref, a.tokens) for a in r.attachments] == [
        (0, 0, "image", "a.png", 4), (1, 1, "audio", "b.wav", 38), (3, 2, "document", "c.pdf", 1536), (3, 3, "other", "d", 0)]
    assert r.expanded_tokens == 4 + 38 + 1536


def test_plan_is_native(spark):
    plan = C.op2_chat_format(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def lines_fixture(spark):
    rows = [(i, f"head\nown {i}\n\n  \nfoot", "h1" if i % 2 else None, "x") for i in range(20)]
    rows += [(50, None, "h1", "x"), (51, "", "h2", "x"), (52, "head", "h2", "x"), (52, "head", "h2", "x"), (None, "a\na\n", "h2", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_lines string")


def test_lines_both_ways_match_sql(spark):
    docs = lines_fixture(spark)
    con = duckdb.connect()
    pdf = docs.toPandas()
    con.register("documents", pdf)
    norm = lambda rows: sorted(str(tuple(None if x != x else (int(x) if isinstance(x, float) else x) for x in r)) for r in rows)
    want = norm(con.execute(L.OP7_SQL).fetchall())
    for rows in (50_000, 0):  # broadcast and shuffle form
        out = L.line_dedup(docs, broadcast_rows=rows)
        got = out.select(F.col("doc_id").cast("double"), "n_lines", "n_dropped", F.length("text"), F.md5("text"))
        assert norm(got.collect()) == want
        assert out.columns == ["doc_id", "text", "source", "n_lines", "n_dropped"]
    texts = {r.doc_id: r.text for r in L.line_dedup(docs).collect()}
    assert texts[1] == "own 1\n\n  " and texts[0] == "own 0\n\n  " and texts[50] is None
    assert L.line_dedup(docs.limit(0)).count() == 0
