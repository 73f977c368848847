from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa

import corpus_pipeline as P
from ranqa.llm import decontaminate, line_dedup, ngram_join, quality
from ranqa.llm.common import table, tokens

SF = "/root/testdata/sf0.001"


def near_ids(rows):
    """Ids to drop by comparing all pairs of texts exactly."""
    sets = [ngram_join.run_set(t) for t in tokens(pa.array([r.text for r in rows], pa.string()))]
    ids = [r.doc_id for r in rows]
    comp = list(ids)
    links = [(i, j) for i in range(len(ids)) for j in range(i) if len(sets[i]) and len(sets[j]) and
             5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))]
    for _ in ids:
        old = list(comp)
        for i, j in links:
            comp[i] = comp[j] = min(comp[i], comp[j])
        if old == comp:
            break
    return {i for i, c in zip(ids, comp) if i != c}


def test_stages_against_brute_force(spark, tmp_path):
    docs = table(spark, SF, "documents")
    kept = P.reject_poor(spark, docs, SF)
    model = quality.fit(docs, table(spark, SF, "labels"))
    rows = docs.orderBy("doc_id").collect()
    col = lambda c: pa.array([r[c] for r in rows], pa.string())
    p = model.score(quality.content_view(col("text")), quality.metadata_view([col("lang"), col("source")], col("text")))[2]
    assert sorted(r.doc_id for r in kept.collect()) == [r.doc_id for r, s in zip(rows, p) if s >= quality.THRESHOLD]

    lines = P.drop_boilerplate(spark, kept, SF)
    con = duckdb.connect()
    con.register("documents", kept.toPandas())
    want = {r[0]: r[3:] for r in con.execute(line_dedup.OP7_SQL).fetchall()}
    import hashlib
    got = lines.collect()
    assert {r.doc_id: (len(r.text), hashlib.md5(r.text.encode()).hexdigest()) for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got) and lines.columns == list(P.COLUMNS)

    one = P.keep_one_of_each_group(spark, lines, SF)
    drop = near_ids(got)
    rest = one.collect()
    assert sorted(r.doc_id for r in rest) == sorted(r.doc_id for r in got if r.doc_id not in drop) and drop

    clean = P.drop_contaminated(spark, one, SF)
    bench = tokens(pa.array([r.text for r in table(spark, SF, "benchmark").collect()]), bare=True)
    texts = tokens(pa.array([r.text for r in rest]), bare=True)
    bad = {r.doc_id for r, t in zip(rest, texts) for b in bench
           if sum(n for n, _, _ in decontaminate.tile(t, b)) >= decontaminate.MIN_COVERAGE * len(b)}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in rest} - bad and bad

    packed = P.pack(spark, clean, SF).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r.doc_id for r in clean.collect())
    whole = P.run(spark, SF).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert Counter(map(key, whole)) == Counter(map(key, packed))


def test_repeated_and_odd_rows(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(30))
    other = " ".join(f"v{i}" for i in range(30))
    rows = [(1, text), (1, text), (2, text), (3, other), (3, "quite another text of six words"), (4, other), (None, text), (5, None), (5, None),
            (6, ""), (7, "zz"), (7, "zz")]
    docs = spark.createDataFrame([(d, t, "en", "s", 0, 9) for d, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, class_id int")
    got = P.keep_one_of_each_group(spark, docs, SF)
    assert got.columns == list(P.COLUMNS)
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(
        [(1, text), (3, other), (3, "quite another text of six words"), (None, text), (5, None), (5, None), (6, ""), (7, "zz")])
    empty = docs.limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, SF).count() == 0
    assert P.drop_boilerplate(spark, docs, SF).count() == len(rows)


def test_near_copies_under_one_id(spark):
    """A group within one id keeps one row; two groups with the same smallest id keep one each."""
    words = [[f"{c}{i}" for i in range(60)] for c in "abc"]
    full, other = ([" ".join([*w[:59], last]) for w in words] for last in ("end", "close"))
    rows = [(1, full[0]), (1, other[0]), (2, full[1]), (2, full[2]), (3, other[1]), (4, other[2]), (4, other[2])]
    docs = spark.createDataFrame([(d, t, "en", "s", 9) for d, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.doc_id, r.text) for r in P.keep_one_of_each_group(spark, docs, SF).collect())
    assert [d for d, _ in got] == [1, 2, 2] and got[0][1] in (full[0], other[0])
    assert {t for _, t in got[1:]} == {full[1], full[2]}
