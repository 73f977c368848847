import os
import tempfile

from ranqa.sources.catalog import read_lines, read_templates
from ranqa.sources.sinks import read_jsonl, write_jsonl


def test_folder_is_numbered_in_file_order(spark):
    d = tempfile.mkdtemp(prefix="ranqa-lines-")
    files = {"b.txt": b"4\r\n\r\n6", "a.txt": b"0\n1\n\n3\n", "c.txt": b"", "d.txt": "7\n八\n\n".encode()}
    for name, raw in files.items():
        with open(os.path.join(d, name), "wb") as f:
            f.write(raw)
    got = sorted((r.line_no, r.value) for r in read_lines(spark, d).collect())
    assert got == list(enumerate(["0", "1", "", "3", "4", "", "6", "7", "八", ""]))
    named = sorted((r.line_no, os.path.basename(r.file)) for r in read_lines(spark, d, file_col="file").collect())
    assert [f for _, f in named] == ["a.txt"] * 4 + ["b.txt"] * 3 + ["d.txt"] * 3
    assert read_templates(spark, d).columns == ["template_id", "template"]


def test_many_splits_of_one_file(spark):
    d = tempfile.mkdtemp(prefix="ranqa-lines-")
    lines = [f"{i}:" + "x" * (i % 37) if i % 5 else "" for i in range(4000)]
    for k in range(3):
        with open(os.path.join(d, f"{k}.txt"), "w", encoding="utf-8") as f:
            f.write("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        df = read_lines(spark, d)
        got = sorted((r.line_no, r.value) for r in df.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == list(enumerate(lines * 3))


def test_jsonl_keeps_null_fields(spark):
    d = os.path.join(tempfile.mkdtemp(prefix="ranqa-jsonl-"), "out")
    schema = "id long, conversations array<struct<`from`: string, value: string>>, note string"
    rows = [(1, [("user", "云\n\"x\""), ("assistant", None)], None), (2, None, "n"), (3, [], "")]
    write_jsonl(spark.createDataFrame(rows, schema), d)
    text = "".join(open(os.path.join(d, f), encoding="utf-8").read() for f in sorted(os.listdir(d)) if f.endswith(".json"))
    assert '"note":null' in text and '"value":null' in text and "云" in text
    assert sorted((r.id, r.conversations, r.note) for r in read_jsonl(spark, d, schema).collect()) == [
        (i, None if c is None else [tuple(x) for x in c], n) for i, c, n in rows]
