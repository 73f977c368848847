import hashlib
import random
import re

import numpy as np
import pytest

from ranqa.llm import suffix_dedup as S

SCHEMA = "doc_id long, text string, spans int"


def brute(rows, length):
    seen: dict[bytes, int] = {}
    raws = [(t or "").encode() for _, t, _ in rows]
    for raw in raws:
        for p in range(len(raw) - length + 1):
            w = raw[p:p + length]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for (d, _, _), raw in zip(rows, raws):
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1):
            if seen[raw[p:p + length]] > 1:
                gone[p:p + length] = True
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out.append((d, len(raw), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def fixture(seed, letters):
    rnd = random.Random(seed)
    text = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    shared = [text(rnd.randrange(10, 90)) for _ in range(6)]
    rows = []
    for i in range(70):
        parts = [text(rnd.randrange(0, 40))]
        for _ in range(rnd.randrange(0, 3)):
            s = rnd.choice(shared)
            a = rnd.randrange(0, len(s) // 2)
            parts += [s[a:a + rnd.randrange(5, 80)], text(rnd.randrange(0, 5))]
        rows.append((i, "".join(parts), 1))
    rows += [(90, "ab" * 60, 1), (91, "a" * 75, 1), (92, None, 1), (93, "", 1), (94, rows[3][1], 1), (3, *rows[3][1:]),
             (None, rows[5][1] + "é", 1), (None, "q" * 3, 1), (95, "\x00" * 50, 1), (96, shared[0] + "\x00\x00", 1),
             (97, shared[0] + "\x00", 1), (7, "another text of this id", 1)]
    rnd.shuffle(rows)
    return rows


def result(out):
    from pyspark.sql import functions as F
    cols = out.select("doc_id", F.octet_length("bytes"), F.octet_length("bytes") - F.octet_length("kept"), F.size("spans"),
                      F.sha2("kept", 256))
    return sorted((tuple(r) for r in cols.collect()), key=str)


@pytest.mark.parametrize("seed,letters,length,hot", [(1, "abcdefgh é", 20, 10**6), (2, "ab", 17, 10**6), (3, "abcd", 25, 2),
                                                     (4, "xyz\n", 30, 10**6), (5, "ab", 12, 5)])
def test_matches_brute_force(spark, seed, letters, length, hot):
    rows = fixture(seed, letters)
    out = S.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(4), length=length, hot_rows=hot)
    assert result(out) == brute(rows, length)


def test_hot_passage_and_long_text(spark, monkeypatch):
    rnd = random.Random(8)
    text = lambda n: "".join(rnd.choice("abcdefghij ") for _ in range(n))
    passage = text(460)
    rows = [(i, text(rnd.randrange(100)) + passage[rnd.randrange(30):460 - rnd.randrange(30)] + text(rnd.randrange(100)), 0)
            for i in range(120)]
    long = text(150_000)
    rows += [(500, long, 0), (501, "x" + long[60_000:70_000], 0), (502, text(399), 0)]
    out = S.remove_repeats(spark.createDataFrame(rows, SCHEMA))
    assert result(out) == brute(rows, 400)


def test_multikey_quicksort():
    rnd = np.random.default_rng(1)
    for n, m, k in ((0, 3, 2), (1, 1, 2), (500, 4, 2), (500, 6, 1), (300, 2, 1000)):
        w = rnd.integers(0, k, (n, m), dtype=np.uint64)
        got = w[S.multikey_quicksort(w)]
        assert got.tolist() == sorted(w.tolist())


def test_empty(spark):
    assert S.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_padding_takes_little_more_than_its_rows():
    import tracemalloc

    import numpy as np

    from ranqa.llm.suffix_dedup import _padded

    rnd = np.random.default_rng(1)
    data = rnd.integers(0, 256, 50_000).astype(np.uint8)
    start, size = rnd.integers(0, 49_000, 4_096), rnd.integers(0, 400, 4_096)
    tracemalloc.start()
    out = _padded(data, start, size, 400)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all(bytes(out[i]) == bytes(data[start[i]:start[i] + size[i]]).ljust(400, b"\0") for i in range(0, 4_096, 97))
    assert peak < 4 * out.nbytes


def shared_brute(rows, words):
    held: dict[tuple, set] = {}
    for d, t, _ in rows:
        w = [x for x in re.split(rb"[\x00-\x20]+", (t or "").encode()) if x]
        for p in range(len(w) - words + 1):
            held.setdefault(tuple(w[p:p + words]), set()).add((d, t or ""))
    out = []
    for d, t, _ in rows:
        w = [x for x in re.split(rb"[\x00-\x20]+", (t or "").encode()) if x]
        out.append((d, sum(len(held[tuple(w[p:p + words])]) > 1 for p in range(len(w) - words + 1))))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,letters,words", [(1, "ab", 5), (2, "abcdefgh", 7), (3, "ab\u00e9", 2), (4, "abc", 1)])
def test_shared_runs_match_brute_force(spark, seed, letters, words):
    rnd = random.Random(seed)
    text = lambda n: "".join(rnd.choice(letters) + rnd.choice(["", " ", " ", "\n "]) for _ in range(n))
    passages = [text(rnd.randrange(10, 60)) for _ in range(5)]
    rows = [(i, text(rnd.randrange(30)) + " " + rnd.choice(passages)[rnd.randrange(8):] + " " + text(rnd.randrange(30)), 0)
            for i in range(60)]
    rows += [(70, rows[3][1], 0), rows[4], (None, rows[5][1], 0), (None, rows[6][1], 0), (71, None, 0), (72, "", 0),
             (73, "q r s t u v w " * 9, 0), (74, "z" * 90, 0), (5, "x " + passages[0], 0), (75, passages[1] * 2, 0)]
    out = S.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(4), words=words).select("doc_id", "n_shared")
    assert sorted((tuple(r) for r in out.collect()), key=str) == shared_brute(rows, words)


def test_query_shows_passages_of_over_50_words_below_400_bytes(spark, tmp_path):
    rnd = random.Random(9)
    text = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(3, 8))) for _ in range(n))
    passage, short = text(55), text(50)
    assert len(passage) < 400
    rows = [(1, f"{text(80)} {passage} {text(9)}"), (2, f"{passage} {text(70)}"), (3, f"{text(40)} {short} {text(9)}"),
            (4, f"{short} {text(60)}"), (5, text(200)), (6, f"{passage.replace(passage[:9], 'other')} {text(3)}")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_removed, r.n_shared) for r in S.op1_suffix_dedup(spark, str(tmp_path)).collect()}
    assert {d: n for d, (n, _) in got.items()} == dict.fromkeys(range(1, 7), 0)
    assert [got[d][1] for d in (1, 2, 3, 4, 5)] == [5, 5, 0, 0, 0] and 0 < got[6][1] < 5
