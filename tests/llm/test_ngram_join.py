import random

import pytest

from ranqa.llm import ngram_join as J

SCHEMA = "doc_id long, text string, class_id string"


def grams(text):
    w = (text or "").lower().split()
    n = min(5, len(w))
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if w else frozenset()


def brute(rows):
    sets = [grams(t) if d is not None else frozenset() for d, t, _ in rows]
    n = len(rows)
    links = [[j for j in range(n) if j != i and sets[i] and sets[j]
              and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in range(n)]
    comp = [r[0] for r in rows]
    while True:
        new = [min([comp[i], *(comp[j] for j in links[i])]) if links[i] else comp[i] for i in range(n)]
        if new == comp:
            return sorted(((r[0], c, len(x)) for r, c, x in zip(rows, comp, links)), key=str)
        comp = new


def fixture(seed, groups, size):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefghijklmnop") + rnd.choice("aeiou") + str(rnd.randrange(60))
    rows, k = [], 0
    hot = " ".join(word() for _ in range(30))
    for g in range(groups):
        base = [word() for _ in range(rnd.choice([6, 40, 150, 400]))]
        if g % 3 == 0:
            base += hot.split()
        for _ in range(rnd.choice([1, 1, 2, 5, size])):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 4])):
                w[rnd.randrange(len(w))] = word()
            rows.append((k, rnd.choice([" ", "  ", "\n"]).join(w), "x"))
            k += 1
    rows += [(k, None, "x"), (k + 1, "", "x"), (k + 2, " \n", "x"), (k + 3, "One two", "x"), (k + 4, "one  TWO", "x"),
             (None, rows[0][1], "x"), (k + 5, "z " * 60_000, "x"), rows[0], rows[0], (k + 6, "q w e r", "x")]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("blocks", [{}, {"bucket_block": 8, "verify_rows": 7}])
def test_matches_brute_force(spark, blocks):
    rows = fixture(3, 60, 30)
    out = J.near_documents(spark.createDataFrame(rows, SCHEMA).repartition(5), **blocks)
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in out.collect()), key=str)
    assert got == brute(rows)


def test_hot_group_of_near_copies(spark):
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(400):
        w = list(base)
        w[rnd.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(w), ""))
    out = J.near_documents(spark.createDataFrame(rows, SCHEMA), bucket_block=50, verify_rows=64).collect()
    assert {r.class_id for r in out} == {0}
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in out) == sorted(brute(rows))


def test_near_copies_under_one_id(spark, monkeypatch):
    """Two near copies share an id and have no third; another id is held by a third of all rows."""
    rnd = random.Random(5)
    pair = [f"p{i}" for i in range(60)]
    rows = [(1, " ".join(pair), ""), (1, " ".join([*pair[:59], "other"]), "")]
    base = [f"w{i}" for i in range(120)]
    for i in range(240):
        w = list(base)
        w[rnd.randrange(120)] = f"x{i}"
        rows.append((50 if i % 3 else 100 + i, " ".join(w), ""))
    rows += [(50, " ".join(f"u{i}-{j}" for j in range(20)), "") for i in range(80)]
    rows += [(200 + i, " ".join(f"v{i}-{j}" for j in range(20)), "") for i in range(150)]
    met, deal = [], J.block_pairs
    monkeypatch.setattr(J, "block_pairs", lambda df, *a: met.append(df.count()) or deal(df, *a))
    out = J.near_documents(spark.createDataFrame(rows, SCHEMA), bucket_block=50, verify_rows=64).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in out) == sorted(brute(rows))
    assert met[0] <= J.TREES * len(rows)  # no pairs of the hot id's signatures


def test_recall_of_the_tries():
    for s in (0.8, 0.9):
        d = J.shortest_prefix(s)
        assert 1 - (1 - s ** d) ** J.TREES >= J.TARGET_RECALL > 1 - (1 - s ** (d + 1)) ** J.TREES or d == J.DEPTH


def test_empty(spark):
    assert J.near_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    one = J.near_documents(spark.createDataFrame([(1, None, "")], SCHEMA)).collect()
    assert [(r.doc_id, r.class_id, r.n_links) for r in one] == [(1, 1, 0)]
