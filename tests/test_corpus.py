import json
import math
import os
import re
import tempfile

from pyspark.sql import functions as F

from ranqa.functions.keyed import keyed_hash32
from ranqa.functions.text import strip_whitespace
from ranqa.operators.split import exact_split, hash_split, val_count
from ranqa.operators.stopwords import max_match, remove_stopwords
from ranqa.operators.tagger import DEFAULT_LEXICON, keyword_hits, tag_string
from ranqa.operators.templates import (LOCATIONS, SYSTEM_PROMPT, WEATHERS, answer_json, expand_advanced,
                                       expand_base, negative_questions, no_entity_questions, template_rejects,
                                       with_records)
from ranqa.sources.catalog import column_union, read_lines
from ranqa.sources.sinks import write_jsonl


def test_keyed_hash_golden(spark):
    v = spark.range(1).select(keyed_hash32(42, F.lit(7), F.lit("a")).alias("h")).first()["h"]
    assert v == 1900125692


def test_tagger_duplicates_and_order(spark):
    lex = [("L1", ["ab", "abc"]), ("L2", ["x"]), ("L3", ["zz"])]
    df = spark.createDataFrame([("x abc",), ("nothing",)], "t string")
    rows = df.select(keyword_hits("t", lex).alias("h"), tag_string("t", lex).alias("s")).collect()
    assert rows[0]["h"] == ["L1", "L1", "L2"] and rows[0]["s"] == "L1,L2"
    assert rows[1]["h"] == [] and rows[1]["s"] == ""


def test_default_lexicon(spark):
    df = spark.createDataFrame([("资费标准和办理流程",)], "t string")
    r = df.select(keyword_hits("t", DEFAULT_LEXICON).alias("h"), tag_string("t").alias("s")).first()
    assert r["h"] == ["产品资费", "产品资费", "业务办理", "业务办理"]
    assert r["s"] == "产品资费,业务办理"
    assert sum(len(k) for _, k in DEFAULT_LEXICON) == 38


def test_answer_json_matches_python(spark):
    vals = [("云 手机\"x\\", "a,b"), ("", ""), ("line\nbreak\ttab", "产品资费")]
    df = spark.createDataFrame(vals, "e string, l string")
    got = [r[0] for r in df.select(answer_json("e", "l")).collect()]
    want = [json.dumps({"套餐名称": e, "关键信息": l}, ensure_ascii=False) for e, l in vals]
    assert got == want


def test_strip_whitespace_unicode(spark):
    df = spark.createDataFrame([("a b　c\td\x1ce f",)], "t string")
    assert df.select(strip_whitespace("t")).first()[0] == "abcdef"


def _templates(spark, rows):
    return spark.createDataFrame(rows, "template_id bigint, template string")


def test_expand_base(spark):
    t = _templates(spark, [(0, "{package_name}的资费是多少"), (1, ""), (2, "{year}年{package_name}"),
                           (3, "介绍一下{package_name}的办理流程")])
    cat = spark.createDataFrame([("云 手机",), ("5G 套餐",), ("云 手机",)], "name string")
    everything = expand_base(t, cat, num_samples=50).collect()
    assert len(everything) == 3 * 50                 # the blank line is a template, {year} is rejected
    assert {r["question"] for r in everything if r["template_id"] == 1} == {""}
    assert [(r.template_id, r.reason) for r in template_rejects(t).collect()] == [(2, "format")]
    out = expand_base(t, cat, num_samples=50, keep_blank=False).collect()
    assert len(out) == 2 * 50
    assert {r["entity"] for r in out} <= {"云手机", "5G套餐"}
    assert all(r["entity"] in r["question"] and "{" not in r["question"] for r in out)
    ids = sorted(r["id"] for r in out)
    assert len(set(ids)) == len(ids) and max(ids) <= 50 * 3
    by_t = {r["template_id"]: r["labels"] for r in out}
    assert by_t[0] == "产品资费" and by_t[3] == "业务办理"
    again = expand_base(t.repartition(3), cat.repartition(2), num_samples=50, keep_blank=False).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))


def test_expand_advanced(spark):
    t = _templates(spark, [(0, "{year}年{location}{weather}时{package_name}怎么收费")])
    cat = spark.createDataFrame([("套餐A",)], "name string")
    out = expand_advanced(t, cat, num_samples=300).collect()
    assert len(out) == 300
    for r in out:
        q = r["question"]
        assert "{" not in q and q.endswith("套餐A怎么收费")
        year = int(q[:4])
        assert 2015 <= year <= 2023
        rest = q[5:]
        assert any(rest.startswith(loc) for loc in LOCATIONS)
        assert any(w + "时" in rest for w in WEATHERS)
        assert r["labels"] == "产品资费"
    assert len({int(r["question"][:4]) for r in out}) == 9


def test_no_entity_negative_records(spark):
    t = _templates(spark, [(5, "活动规则是什么"), (9, "今天天气不错")])
    ne = no_entity_questions(t).orderBy("id").collect()
    assert [r["id"] for r in ne] == [1, 2] and ne[0]["labels"] == "活动规则" and ne[0]["entity"] == ""
    neg = with_records(negative_questions(t)).orderBy("id").collect()
    rec = json.loads(neg[1]["record_json"])
    assert rec == {"id": 2, "conversations": [{"from": "system", "value": SYSTEM_PROMPT},
                                              {"from": "user", "value": "今天天气不错"},
                                              {"from": "assistant",
                                               "value": json.dumps({"套餐名称": "", "关键信息": ""},
                                                                   ensure_ascii=False)}]}


def test_exact_split_size_and_stability(spark):
    df = spark.range(2500).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    a = exact_split(df, ["k"])
    val = sorted(r["k"] for r in a.where("split = 'val'").collect())
    assert len(val) == val_count(2500) == math.ceil(2500 * 0.001) == 3
    assert a.count() == 2500
    b = exact_split(df.repartition(5), ["k"])
    assert sorted(r["k"] for r in b.where("split = 'val'").collect()) == val
    h = hash_split(spark.range(200000).select(F.col("id").alias("k")), ["k"])
    n_val = h.where("split = 'val'").count()
    assert 120 < n_val < 290


def test_column_union_skips_missing(spark):
    a = spark.createDataFrame([("x",), ("y",), (None,)], "Q string")
    b = spark.createDataFrame([(1,)], "other int")
    c = spark.createDataFrame([("x",)], "Q string")
    assert sorted(r[0] for r in column_union([a, b, c], "Q").collect()) == ["x", "x", "y"]


def test_read_lines_and_jsonl(spark):
    d = tempfile.mkdtemp(prefix="ranqa-test-")
    p = os.path.join(d, "t.txt")
    with open(p, "w", encoding="utf-8") as f:
        f.write("a\n\nb\n")
    rows = read_lines(spark, p).orderBy("line_no").collect()
    assert [(r["line_no"], r["value"]) for r in rows] == [(0, "a"), (1, ""), (2, "b")]
    out = os.path.join(d, "out")
    write_jsonl(spark.createDataFrame([("云", None)], "query string, response string"), out)
    lines = [ln for fn in os.listdir(out) if fn.endswith(".json") for ln in open(os.path.join(out, fn), encoding="utf-8")]
    assert json.loads(lines[0]) == {"query": "云", "response": None}


def test_stopwords(spark):
    df = spark.createDataFrame([("the cat  and the hat",)], "t string")
    assert df.select(remove_stopwords("t", ["the", "and"], sep=" ")).first()[0] == "cat hat"
    assert df.select(remove_stopwords("t", ["the", "and"])).first()[0] == " cat    hat"
    words = {"我要", "办理", "云手机", "业务"}
    assert max_match("我要办理云手机业务", words, 3) == ["我要", "办理", "云手机", "业务"]
    df2 = spark.createDataFrame([("我要办理云手机业务",)], "t string")
    got = df2.select(remove_stopwords("t", ["我要"], segmenter="dict", dictionary=sorted(words))).first()[0]
    assert got == "办理云手机业务"


def test_base_fill_follows_str_format(spark):
    tpls = ["{{{package_name}}}", "a {{b}} {package_name}", "{package_name}}", "{year}{package_name}", "{",
            "x}}y", "plain {package_name} and {package_name}", "{{package_name}}"]
    t = _templates(spark, list(enumerate(tpls)))
    cat = spark.createDataFrame([("X",)], "name string")
    got = {r["template_id"]: r["question"] for r in expand_base(t, cat, num_samples=1).collect()}
    for i, tpl in enumerate(tpls):
        try:
            want = tpl.format(package_name="X")
        except (KeyError, ValueError, IndexError):
            assert i not in got, tpl
            continue
        assert got[i] == want, tpl


def test_json_quote_matches_python(spark):
    from ranqa.functions.text import json_quote
    vals = ["a\x01b\x1fc\x7fd", "x\\u001F", "\\\x1f", "\x0e\x0f\x1a", "/<>&'\"", "g\U0001F600h"]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    assert [r[0] for r in df.select(json_quote("s")).collect()] == [json.dumps(v, ensure_ascii=False) for v in vals]


def test_read_lines_order_crlf(spark):
    d = tempfile.mkdtemp(prefix="ranqa-test-")
    p = os.path.join(d, "t.txt")
    lines = [f"line {i}" if i % 7 else "" for i in range(3000)]
    with open(p, "w", encoding="utf-8", newline="") as f:
        f.write("\r\n".join(lines) + "\r\n")
    rows = read_lines(spark, p).orderBy("line_no").collect()
    assert [r["value"] for r in rows] == lines
    assert [r["line_no"] for r in rows] == list(range(3000))


def test_one_tagger_at_every_lexicon_size(spark):
    import ranqa.operators.tagger as tg
    lex = [("L1", ["ab", "abc", "bc"]), ("L2", ["x", "资费", "ab"]), ("L3", ["zz"])]
    texts = [("abc x",), ("资费标准",), ("nothing",), ("zzz ab",), (None,)]
    df = spark.createDataFrame(texts, "t string")
    want = [[lab for lab, kws in lex for k in kws if k in (t or "")] for t, in texts]
    for more in (0, 2500):
        big = lex + [("L4", [f"never{i}" for i in range(more)])]
        assert [r[0] for r in df.select(tg.keyword_hits("t", big)).collect()] == want
    assert want[0] == ["L1", "L1", "L1", "L2", "L2"] and want[4] == []


def test_read_any_formats(spark):
    from ranqa.sources.tables import read_any
    d = tempfile.mkdtemp(prefix="ranqa-test-")
    with open(os.path.join(d, "a.csv"), "w", encoding="utf-8") as f:
        f.write("Q,A\n云手机,x\n宽带,y\n")
    with open(os.path.join(d, "b.jsonl"), "w", encoding="utf-8") as f:
        f.write('{"Q": "云电脑", "A": "z"}\n')
    with open(os.path.join(d, "c.txt"), "w", encoding="utf-8") as f:
        f.write("l1\n\nl3\n")
    assert sorted(r["Q"] for r in read_any(spark, os.path.join(d, "a.csv")).collect()) == sorted(["宽带", "云手机"])
    assert [r["Q"] for r in read_any(spark, os.path.join(d, "b.jsonl")).collect()] == ["云电脑"]
    assert read_any(spark, os.path.join(d, "c.txt")).count() == 3
    cat = column_union([read_any(spark, os.path.join(d, "a.csv")), read_any(spark, os.path.join(d, "b.jsonl"))], "Q")
    assert cat.count() == 3


def test_keyed_draw_helpers(spark):
    from ranqa.functions.keyed import digest_slice, keyed_choice_index, keyed_digest, keyed_randint
    df = spark.range(5000).select(keyed_randint(2015, 2023, 42, F.col("id")).alias("y"),
                                  keyed_choice_index(34, 42, F.col("id")).alias("c"),
                                  digest_slice(keyed_digest(42, F.col("id")), 3).alias("s"))
    r = df.agg(F.min("y"), F.max("y"), F.countDistinct("y"), F.min("c"), F.max("c"), F.max("s")).first()
    assert (r[0], r[1], r[2]) == (2015, 2023, 9)
    assert (r[3], r[4]) == (0, 33) and r[5] < 2 ** 32
    again = spark.range(5000).repartition(7).select(keyed_randint(2015, 2023, 42, F.col("id")).alias("y"))
    assert sorted(x[0] for x in again.collect()) == sorted(x[0] for x in df.select("y").collect())


def test_automaton_gives_the_native_list(spark):
    lex = [("L1", ["ab", "abc", "", "ab"]), ("L2", ["x", "b", "云"]), ("L3", ["zz", "abc"]), ("L1", ["c ab"])]
    texts = ["x abc ab", "", None, "云手机", "zzz", "nothing", "ab" * 5000, "\U0001F600abc"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(3)
    rows = df.select(keyword_hits("t", lex).alias("native"), keyword_hits("t", lex, automaton_from=0).alias("automaton")).collect()
    assert all(r.native == r.automaton for r in rows) and any(len(r.native) > 4 for r in rows)


def test_every_turn_is_in_a_record_or_listed(spark):
    from ranqa.operators.templates import exchange_records
    rows = [(1, 0, "user", "q0"), (1, 1, "assistant", "a0"), (1, 2, "user", "q1"), (1, 3, "user", "q2"), (1, 4, "assistant", "a2"),
            (1, 5, "assistant", "a3"), (1, 6, "system", "s"), (2, 0, "assistant", "x"), (3, 0, "user", None), (3, 1, "assistant", "b"),
            (4, 0, "user", "p"), (4, 0, "user", "r"), (4, 1, "assistant", "c"), (None, 0, "user", "n")]
    got = exchange_records(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()
    records = sorted((r.id, r.conv_id, r.turn, r.question, r.answer) for r in got if r.status == "record")
    assert records == [(1, 1, 0, "q0", "a0"), (2, 1, 3, "q2", "a2"), (3, 3, 0, "", "b"), (4, 4, 0, "p", "c")]
    alone = sorted((str(r.conv_id), r.turn, r.role, r.status) for r in got if r.status != "record")
    assert alone == [("1", 2, "user", "unanswered"), ("1", 5, "assistant", "unasked"), ("1", 6, "system", "other role"),
                     ("2", 0, "assistant", "unasked"), ("4", 0, "user", "unanswered"), ("None", 0, "user", "unanswered")]
    assert 2 * len(records) + len(alone) == len(rows)


def test_stopwords_by_pattern_equal_runs(spark):
    from ranqa.operators.stopwords import PATTERN_WORDS, runs
    stop = ["the", "a.b", "and", "云", "th", "x|y", "(", ""]
    texts = ["the cat and the hat", "theand the", " the\u3000the\tand\n", "a.b aXb a.b", "x|y x (", None, "", "云 云手机 云", "the", "é the"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    many = stop + [f"w{i}" for i in range(PATTERN_WORDS)]
    want = [None if t is None else "".join(k for k in re.findall(r"\s+|\S+", t) if k not in stop) for t in texts]
    assert [r[0] for r in df.select(remove_stopwords("t", stop)).collect()] == want
    assert [r[0] for r in df.select(remove_stopwords("t", many)).collect()] == want
    assert df.select(runs("t")).count() == len(texts)
