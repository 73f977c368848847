"""The matching-block scores as SQL (DuckDB dialect): recursive search for the longest common block of every open piece.
Used only as the independent oracle of ``functions.blocks``; texts are ASCII and shorter than 200 characters."""

from __future__ import annotations


def _d(x: float) -> str:
    return f"CAST({x} AS DOUBLE)"


# the longest common block of a[alo:ahi] and b[blo:bhi], of equal ones the first in a, then in b, as one number
_BEST = """list_max(flatten([[
    coalesce(list_max([k FOR k IN range(1, least(ahi - i, bhi - j) + 1) IF substr(u, i + 1, k) = substr(v, j + 1, k)]), 0) * 1000000
      + (999 - i) * 1000 + 999 - j
    FOR j IN range(blo, bhi)] FOR i IN range(alo, ahi)]))"""


def _blocks(name: str, pairs: str) -> str:
    """CTEs: ``{name}(u, v, i, j, k)``, the matching blocks of the distinct pairs (u, v) of ``pairs``."""
    return f"""
{name}_r AS (
  SELECT u, v, alo, ahi, blo, bhi, {_BEST} AS m
  FROM (SELECT u, v, 0 AS alo, length(u) AS ahi, 0 AS blo, length(v) AS bhi FROM {pairs})
  UNION ALL
  SELECT u, v, alo, ahi, blo, bhi, {_BEST} AS m
  FROM (SELECT u, v, c.alo, c.ahi, c.blo, c.bhi FROM (
    SELECT u, v, unnest([{{'alo': alo, 'ahi': 999 - m // 1000 % 1000, 'blo': blo, 'bhi': 999 - m % 1000}},
                         {{'alo': 999 - m // 1000 % 1000 + m // 1000000, 'ahi': ahi,
                           'blo': 999 - m % 1000 + m // 1000000, 'bhi': bhi}}]) AS c
    FROM {name}_r WHERE m >= 1000000))
  WHERE alo < ahi AND blo < bhi),
{name} AS (SELECT u, v, 999 - m // 1000 % 1000 AS i, 999 - m % 1000 AS j, m // 1000000 AS k FROM {name}_r WHERE m >= 1000000)"""


_CLEAN = r"trim(lower(regexp_replace({0}, '\W', ' ', 'g')))"


def block_scores(pairs: str) -> str:
    """CTEs that end in ``bs(a, b, ratio, partial, weighted)`` for the pairs (a, b) of the CTE ``pairs``; for WITH RECURSIVE."""
    tok = lambda c: f"list_filter(string_split({c}, ' '), lambda w: w <> '')"
    text = lambda l: f"array_to_string({l}, ' ')"
    part = lambda x, y, neg: f"list_sort(list_filter(list_distinct({x}), lambda w: {neg} list_contains({y}, w)))"
    forms = [("ca", "cb"), ("x", "y"), ("sect", "l"), ("sect", "r"), ("l", "r")]
    plain = " UNION ".join(f"SELECT {u} AS u, {v} AS v FROM fm" for u, v in [("a", "b"), *forms])
    partial = "SELECT a AS u, b AS v FROM fm UNION " + " UNION ".join(f"SELECT {u}, {v} FROM fm WHERE NOT near" for u, v in forms)
    sc = lambda t, u, v: f"(SELECT sc FROM {t} WHERE {t}.u = fm.{u} AND {t}.v = fm.{v})"
    best = lambda t, w: [f"{sc(t, u, v)} * {w}" for u, v in forms[1:]]
    near = ", ".join([sc("rt", "ca", "cb"), *best("rt", _d(0.95))])
    far = ", ".join([sc("rt", "ca", "cb"), f"{sc('pt', 'ca', 'cb')} * scale", *best("pt", f"{_d(0.95)} * scale")])
    apart = "greatest(length(ca), length(cb)) / CAST(greatest(least(length(ca), length(cb)), 1) AS DOUBLE)"
    return f"""
cl AS MATERIALIZED (
  SELECT a, b, {_CLEAN.format('a')} AS ca, {_CLEAN.format('b')} AS cb FROM (SELECT DISTINCT a, b FROM {pairs})),
tk AS (SELECT *, {tok('ca')} AS ta, {tok('cb')} AS tb, {apart} AS apart FROM cl),
ts AS (SELECT *, {part('ta', 'tb', '')} AS tboth FROM tk),
fm AS MATERIALIZED (
  SELECT a, b, ca, cb, {text('list_sort(ta)')} AS x, {text('list_sort(tb)')} AS y, {text('tboth')} AS sect,
    {text(f"list_concat(tboth, {part('ta', 'tb', 'NOT')})")} AS l, {text(f"list_concat(tboth, {part('tb', 'ta', 'NOT')})")} AS r,
    apart < 1.5 AS near, CASE WHEN apart > 8 THEN {_d(0.6)} ELSE {_d(0.9)} END AS scale FROM ts),
wp AS MATERIALIZED (
  SELECT u, v, CASE WHEN length(u) <= length(v) THEN u ELSE v END AS s, CASE WHEN length(u) <= length(v) THEN v ELSE u END AS t
  FROM ({partial})),
sl AS (SELECT DISTINCT s AS u, t AS v FROM wp WHERE s <> t AND s <> ''),
{_blocks('b1', 'sl')},
win AS MATERIALIZED (
  SELECT DISTINCT u AS s, v AS t, substr(v, greatest(j - i, 0) + 1, length(u)) AS w FROM b1
  UNION SELECT u, v, substr(v, length(v) - length(u) + 1, length(u)) FROM sl),
wr AS MATERIALIZED ({plain} UNION SELECT s, w FROM win),
un AS (SELECT u, v FROM wr WHERE u <> v AND u <> '' AND v <> ''),
{_blocks('b2', 'un')},
rt AS MATERIALIZED (
  SELECT wr.u, wr.v, CASE WHEN wr.u = wr.v THEN 1.0 WHEN wr.u = '' OR wr.v = '' THEN 0.0
      ELSE CAST(2 * coalesce(m.n, 0) AS DOUBLE) / (length(wr.u) + length(wr.v)) END AS share,
    CAST(round_even(CAST(100 AS DOUBLE) * share, 0) AS DOUBLE) AS sc
  FROM wr LEFT JOIN (SELECT u, v, sum(k) AS n FROM b2 GROUP BY u, v) m ON m.u = wr.u AND m.v = wr.v),
best_window AS MATERIALIZED (
  SELECT win.s, win.t, max(CASE WHEN rt.share > 0.995 THEN 100 ELSE rt.sc END) AS sc
  FROM win JOIN rt ON rt.u = win.s AND rt.v = win.w GROUP BY win.s, win.t),
pt AS MATERIALIZED (
  SELECT wp.u, wp.v, CAST(CASE WHEN wp.u = wp.v THEN 100 WHEN wp.s = '' THEN 0 ELSE w.sc END AS DOUBLE) AS sc
  FROM wp LEFT JOIN best_window w ON w.s = wp.s AND w.t = wp.t),
bs AS MATERIALIZED (
  SELECT a, b, CAST({sc('rt', 'a', 'b')} AS BIGINT) AS ratio, CAST({sc('pt', 'a', 'b')} AS BIGINT) AS partial,
    CAST(CASE WHEN ca = '' OR cb = '' THEN 0 WHEN near THEN round_even(greatest({near}), 0)
      ELSE round_even(greatest({far}), 0) END AS BIGINT) AS weighted
  FROM fm)"""
