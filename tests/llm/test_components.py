import random

import numpy as np

from ranqa.llm.components import components, local_forest


def test_components_match_union_find(spark):
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(1000, 1300)] + [(5000, 5000 + i) for i in range(300)]  # a chain and a hub
    edges += [(rnd.randrange(400), rnd.randrange(400)) for _ in range(180)] + [(7, 7), (1000, 1001), (1001, 1000)]
    rnd.shuffle(edges)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    linked = {x for e in edges if e[0] != e[1] for x in e}
    got = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert sorted(tuple(r) for r in got) == sorted((x, find(x)) for x in linked)
    a, b = (np.array(c) for c in zip(*edges))
    names = np.unique(np.concatenate([a, b]))
    local = local_forest(np.searchsorted(names, a), np.searchsorted(names, b), len(names))
    assert all(names[local[i]] == find(x) for i, x in enumerate(names.tolist()))


def test_no_links(spark):
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
