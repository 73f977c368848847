import json
import os
import tempfile

from ranqa.__main__ import main


def test_cli_corpus_finetune_rerank(spark, capsys):
    d = tempfile.mkdtemp(prefix="ranqa-cli-")

    def w(name, lines):
        p = os.path.join(d, name)
        with open(p, "w", encoding="utf-8") as f:
            f.write("\n".join(lines) + "\n")
        return p

    cat = os.path.join(d, "cat")
    spark.createDataFrame([("云手机",), ("宽带",)], "Q string").write.parquet(cat)
    main(["corpus", "--base", w("b.txt", ["{package_name}资费"]), "--advanced", w("a.txt", ["{year}{package_name}"]),
          "--negative", w("n.txt", ["你好"]), "--no-entity", w("e.txt", ["活动规则"]), "--catalog", cat,
          "--samples", "10", "--out", os.path.join(d, "out")])
    counts = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert counts["total"] == 22
    main(["finetune", "--qa", os.path.join(d, "out", "qa"), "--out", os.path.join(d, "ft")])
    sizes = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert sizes == {"train": 21, "val": 1}
    hits = os.path.join(d, "hits")
    spark.createDataFrame([(1, 0, 10, "移动云手机", 80.0), (1, 1, 11, "宽带", 40.0)],
                          "query_id bigint, hit_pos bigint, id bigint, question string, score double").write.parquet(hits)
    queries = os.path.join(d, "queries")
    spark.createDataFrame([(1, "云手机")], "query_id bigint, query_text string").write.parquet(queries)
    main(["rerank", "--hits", hits, "--queries", queries, "--out", os.path.join(d, "rr")])
    metrics = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert metrics["kept_rows"] == spark.read.parquet(os.path.join(d, "rr")).count() >= 1
