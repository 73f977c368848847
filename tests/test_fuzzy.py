import itertools

from ranqa.functions.fuzzy import weighted_ratio, window_ratio


def lev(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def best_window(a: str, b: str) -> int:
    s, l = sorted((a, b), key=len)
    if not s:
        return 0 if l else 100
    return max(int(100 * (len(s) - lev(s, l[i:i + len(s)])) / len(s) + 0.5) for i in range(len(l) - len(s) + 1))


TEXTS = ["", "ring", "small ring", "ring small", "a very small golden ring indeed", "云手机", "移动云手机套餐", "5G", "!!!", "Ring!", "éa"]


def test_window_ratio_matches_brute_force(spark):
    pairs = list(itertools.product(TEXTS, TEXTS))
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", window_ratio("a", "b").alias("w")).collect():
        assert r.w == best_window(r.a, r.b), r


def test_weighted_ratio(spark):
    pairs = [("small ring", "small ring"), ("ring small", "small ring"), ("Small, ring!", "small ring"), ("!!!", "abc"),
             ("云手机", "移动云手机"), ("ring", "a very small golden ring indeed"), ("", ""), (None, "a"), ("xx", "yy")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in df.select(weighted_ratio("a", "b")).collect()]
    assert got == [100, 95, 100, 0, 90, 90, 0, None, 0]
    swapped = [r[0] for r in df.select(weighted_ratio("b", "a")).collect()]
    assert swapped == got


def test_no_python_in_plan(spark):
    df = spark.createDataFrame([("a", "b")], "a string, b string").select(weighted_ratio("a", "b"), window_ratio("a", "b"))
    assert "Python" not in df._jdf.queryExecution().toString()
