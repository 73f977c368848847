"""Straightforward per-query Python version of the re-rank semantics, used
only as a brute-force check of the Spark operator on small random inputs."""

from __future__ import annotations

import math


def penalty(l1: int, l2: int) -> float:
    d = abs(l1 - l2)
    f = 1 - math.exp(-0.005 * d) if d <= 20 else 1 - math.exp(-2 * (d - 20))
    return 1 - max(0.0, min(f, 0.5))


def minmax(x, lo, hi):
    return 1.0 if hi == lo else (x - lo) / (hi - lo)


def rerank_one(query_text: str, hits: list[dict], limit: int = 5,
               trace: dict | None = None) -> list[tuple[int, int]]:
    """hits: dicts with hit_pos, id, question (or None), score, p (gate), r (rank).
    Returns [(rank, id)] of the kept hits."""
    usable = sorted((h for h in hits if h["question"] is not None), key=lambda h: h["hit_pos"])
    surv = [h for h in usable if h["score"] > 15]
    if not surv:
        return []
    lo, hi = min(h["score"] for h in surv), max(h["score"] for h in surv)
    merge: dict[str, list] = {}

    def add(text, value, seq):
        if text in merge:
            merge[text][0] += value
            merge[text][1] = min(merge[text][1], seq)
        else:
            merge[text] = [value, seq]

    cos = sorted(surv, key=lambda h: (-h["score"], -h["hit_pos"]))[:limit]
    for rank, h in enumerate(cos, 1):
        if h["p"] > 50:
            add(h["question"], minmax(h["score"], lo, hi), rank)
    fz = sorted(usable, key=lambda h: (-h["r"], h["hit_pos"]))[:limit]
    flo, fhi = min(h["r"] for h in fz), max(h["r"] for h in fz)
    items = [(h, penalty(len(h["question"]), len(query_text)) * minmax(float(h["r"]), flo, fhi), fr)
             for fr, h in enumerate(fz, 1)]
    for pr, (h, v, _fr) in enumerate(sorted(items, key=lambda x: (-x[1], x[2])), 1):
        if v > 0.5:
            add(h["question"], v, limit + pr)
    if not merge:
        return []
    best = sorted(usable, key=lambda h: (-h["score"], h["hit_pos"]))[0]
    flag = best["question"] == fz[0]["question"] and best["score"] == float(fz[0]["r"])
    top = sorted(merge.items(), key=lambda kv: (-kv[1][0], kv[1][1]))[:5]
    totals = [t for _, (t, _s) in top]
    tmin, tmax = min(totals), max(totals)
    norms = [minmax(t, tmin, tmax) for t in totals]
    h_val = -sum(n * math.log(n + 1e-10) for n in norms)
    if h_val <= 0 or tmin > 0.9:
        branch, keep = "all", list(range(len(top)))
    elif h_val > 0.95 or flag:
        m = max(norms)
        branch, keep = "dominant", [i for i, n in enumerate(norms) if m - 0.05 <= n <= m]
    else:
        branch, keep = "high", [i for i, n in enumerate(norms) if n > 0.5]
    if trace is not None:
        trace[branch] = trace.get(branch, 0) + 1
    out = []
    for i in keep:
        text = top[i][0]
        last = max((h for h in usable if h["question"] == text), key=lambda h: h["hit_pos"])
        out.append((i + 1, last["id"]))
    return out
