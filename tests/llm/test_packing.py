import bisect
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from ranqa.llm import packing as K

PATHS = (P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def check_plan(counts, capacity):
    out = K.plan(counts, capacity)
    bins: dict[int, list] = {}
    seen: dict[int, list] = {}
    for n, r, m, seq, off in out:
        for i in range(m):
            bins.setdefault(seq + i, []).append((off, n))
            seen.setdefault(n, []).append(r + i)
    assert {n: sorted(v) for n, v in seen.items()} == {n: list(range(c)) for n, c in counts.items() if c}
    for slots in bins.values():
        at = 0
        for off, n in sorted(slots):
            assert off == at
            at += n
        assert at <= capacity
    return len(bins)


def best_fit_decreasing(counts, capacity):
    gaps: list[int] = []
    for n in sorted(Counter(counts).elements(), reverse=True):
        at = bisect.bisect_left(gaps, n)
        rest = gaps.pop(at) - n if at < len(gaps) else capacity - n
        bisect.insort(gaps, rest)
    return len(gaps)


def test_never_above_best_fit_on_the_documents_own_lengths():
    encode = K.encoder(*PATHS)
    for sf in ("sf0.001", "sf0.01"):
        texts = pq.read_table(f"/root/testdata/{sf}/documents.parquet", columns=["text"])["text"].to_pylist()
        counts = Counter(n for t in texts for _, n in K.cut(len(encode(t or "")) + 1, 1024))
        n = check_plan(counts, 1024)
        assert n <= best_fit_decreasing(counts, 1024), sf


def test_plan_is_gapless_and_never_above_best_fit():
    rnd = random.Random(1)
    for capacity in (1, 7, 40, 1024):
        for size in (0, 1, 5, 3000):
            counts = Counter(min(capacity, 1 + int(rnd.expovariate(3 / capacity))) for _ in range(size))
            n = check_plan(counts, capacity)
            bound = -(-sum(k * c for k, c in counts.items()) // capacity)
            assert bound <= n <= best_fit_decreasing(counts, capacity)
    assert check_plan({600: 3, 424: 2, 300: 1, 124: 1}, 1024) == 3  # single and pair complements
    assert check_plan({500: 1, 200: 1, 300: 1, 24: 1}, 1024) == 1   # a triple


def test_ids_are_those_of_tokenizers():
    full = Tokenizer.from_file(PATHS[0])
    fast = K.encoder(*PATHS)
    texts = ["", " ", "a  b\n\n c", "<|endoftext|>", "x<|endoftext|> y", "éèñß übung 12345 it's", "你好 \U0001F600",
             "  x", "a" * 5000, "\t\t \r\n", "İı ǅ", " 's 'S", "\x00\x01", "ሴ́"]
    rnd = random.Random(2)
    texts += ["".join(chr(rnd.choice([rnd.randrange(0x250), 32, 97])) for _ in range(200)) for _ in range(300)]
    for t in texts:
        assert fast(t) == full.encode(t, add_special_tokens=False).ids, repr(t)


def test_pack_documents(spark):
    rnd = random.Random(3)
    words = ["the", "of", "thering", "éau", "12", "\n"]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(int(rnd.expovariate(1 / 300))))) for i in range(120)]
    rows += [(500, None), (500, None), (None, "x"), (501, "word " * 5000), (1, rows[1][1])]
    docs = spark.createDataFrame([(d, t, 9) for d, t in rows], "doc_id long, text string, __SLOT int")
    full = Tokenizer.from_file(PATHS[0])
    want = []
    for d, t in rows:
        ids = [*full.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
        spans = [(0, first)] + [(s, 1024) for s in range(first, len(ids), 1024)]
        want += [(d, k, s, n, zlib.crc32(np.array(ids[s:s + n], "<u4").tobytes())) for k, (s, n) in enumerate(spans)]
    got = K.pack_documents(docs).collect()
    assert Counter(tuple(r)[:5] for r in got) == Counter(want)
    bins: dict[int, list] = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for slots in bins.values():
        ends = np.cumsum([n for _, n in sorted(slots)])
        assert [o for o, _ in sorted(slots)] == [0, *ends[:-1]] and ends[-1] <= 1024
    assert len(bins) <= -(-sum(w[3] for w in want) // 1024) + 1
    assert K.pack_documents(docs.limit(0)).count() == 0
