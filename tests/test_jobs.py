import glob
import json
import math
import os
import tempfile

from ranqa import api
from ranqa.operators.corpus_jobs import assemble_corpus, export_corpus, export_finetuning, read_qa_table


def _write(d, name, lines):
    p = os.path.join(d, name)
    with open(p, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")
    return p


def _jsonl(folder):
    out = []
    for fn in sorted(glob.glob(os.path.join(folder, "*.json"))):
        with open(fn, encoding="utf-8") as f:
            out += [json.loads(x) for x in f if x.strip()]
    return out


def test_assemble_export_and_split(spark):
    d = tempfile.mkdtemp(prefix="ranqa-jobs-")
    base = _write(d, "base.txt", ["{package_name}的资费标准是什么", "怎么办理{package_name}", ""])
    adv = _write(d, "adv.txt", ["{year}年{location}{weather}，{package_name}有什么活动内容"])
    neg = _write(d, "neg.txt", ["今天天气怎么样", "讲个笑话"])
    noe = _write(d, "noe.txt", ["有哪些活动规则"])
    sheet1 = spark.createDataFrame([("云 手机",), ("5G套餐",)], "Q string")
    sheet2 = spark.createDataFrame([(1,)], "other int")
    sheet3 = spark.createDataFrame([("云 手机", "a"), ("宽带", "b")], "Q string, A string")
    corpus = assemble_corpus(spark, base_path=base, advanced_path=adv, negative_path=neg,
                             no_entity_path=noe, catalog_tables=[sheet1, sheet2, sheet3], num_samples=20)
    out = os.path.join(d, "out")
    counts = export_corpus(corpus, out)
    assert counts == {"base": 60, "advanced": 20, "negative": 2, "no_entity": 1, "total": 83}   # the blank line is a template
    recs = _jsonl(os.path.join(out, "conversations"))
    assert len(recs) == 83
    assert [r["conversations"][0]["from"] for r in recs[:1]] == ["system"]
    kinds_in_order = []
    for r in recs:
        a = json.loads(r["conversations"][2]["value"])
        kinds_in_order.append(a["套餐名称"] != "")
    assert all(kinds_in_order[:80]) and not any(kinds_in_order[80:])   # entity kinds come first
    qa = read_qa_table(spark, os.path.join(out, "qa"), "parquet")
    split = export_finetuning(qa, os.path.join(out, "ft"))
    train = _jsonl(os.path.join(out, "ft", "split=train"))
    val = _jsonl(os.path.join(out, "ft", "split=val"))
    assert len(val) == math.ceil(83 * 0.001) == 1 and len(train) == 82
    assert set(train[0]) == {"query", "response"}
    assert split.count() == 83


def test_api_shapes(spark):
    top = api.search_similar_packages(spark, "云手机", ["移动云手机", "宽带", "云电脑", "云手机套餐"], limit=2)
    names = [r["name"] for r in top.orderBy("rank").collect()]
    assert len(names) == 2 and names[0] in ("移动云手机", "云手机套餐")
    hits = [{"id": 1, "question": "移动云手机", "score": 80.0}, {"id": 2, "question": "宽带", "score": 40.0},
            {"id": 3, "score": 90.0}]
    out = api.search_similar_packages_with_score(spark, "云手机", hits)
    assert out and all(h in hits[:2] for h in out)
    text_ids = [{"id": "a", "question": "移动云手机", "score": 80.0, "extra": [1, 2]}]
    assert api.search_similar_packages_with_score(spark, "云手机", text_ids) == text_ids


def test_repeated_ids_split_exactly(spark):
    d = tempfile.mkdtemp(prefix="ranqa-jobs-")
    qa = spark.createDataFrame([(i % 10, f"q{i // 2}", "a") for i in range(100)], "id long, Q string, A string")
    split = export_finetuning(qa, os.path.join(d, "ft"), fraction=0.08)
    assert split.where("split = 'val'").count() == 8 and split.count() == 100
    assert len(_jsonl(os.path.join(d, "ft", "split=val"))) == 8
