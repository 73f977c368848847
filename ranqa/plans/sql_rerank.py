"""The re-rank stages as one SQL CTE chain (DuckDB dialect), with the edit
ratio or the scorers of ``functions.fuzzy`` in the scorer slots.  Used only as the independent oracle for the Spark plans."""

from __future__ import annotations

from ranqa.plans.fixtures import SQL_HITS_CTE


def sql_lev_ratio(a: str, b: str) -> str:
    L = f"greatest(length({a}), length({b}))"
    return (f"CAST(CASE WHEN {L} = 0 THEN 100 ELSE round(100.0 * ({L} - levenshtein({a}, {b})) / {L}) "
            f"END AS BIGINT)")


def _let(name: str, value: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def sql_window_ratio(a: str, b: str, n: str = "w") -> str:
    first = f"length({a}) <= length({b})"
    windows = (f"list_max(list_transform(range(1, length({n}.l) - length({n}.s) + 2), lambda {n}i: "
               + sql_lev_ratio(f"{n}.s", f"substr({n}.l, {n}i, length({n}.s))") + "))")
    return _let(n, f"{{'s': CASE WHEN {first} THEN {a} ELSE {b} END, 'l': CASE WHEN {first} THEN {b} ELSE {a} END}}",
                f"CASE WHEN length({n}.s) = 0 THEN CASE WHEN length({n}.l) = 0 THEN 100 ELSE 0 END ELSE {windows} END")


def sql_clean(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def sql_weighted_ratio(a: str, b: str) -> str:
    short, far_apart = "least(length(p.a), length(p.b))", "CAST(greatest(length(p.a), length(p.b)) AS DOUBLE)"
    scale = f"CASE WHEN {far_apart} / {short} > 8 THEN 0.6 ELSE 0.9 END"
    tok = lambda c: f"list_sort(string_split({c}, ' '))"
    # distinct tokens of one side in order, by membership in the other
    part = lambda x, y, n, neg: (f"list_filter(list_sort(list_distinct({x})), lambda {n}: "  # noqa: E731
                                 f"{neg} list_contains({y}, {n}))")
    text = lambda *xs: "array_to_string(list_concat(" + ", ".join(xs) + "), ' ')" if len(xs) > 1 else \
        f"array_to_string({xs[0]}, ' ')"
    both = part("q.x", "q.y", "k1", "")
    forms = (f"{{'x': {text('q.x')}, 'y': {text('q.y')}, 'both': {text(both)}, "
             f"'l': {text(both, part('q.x', 'q.y', 'k2', 'NOT'))}, 'r': {text(both, part('q.y', 'q.x', 'k3', 'NOT'))}}}")
    tokens = _let("q", f"{{'x': {tok('p.a')}, 'y': {tok('p.b')}}}", forms)

    def by_token(ratio) -> str:
        pairs = (("t.x", "t.y"), ("t.both", "t.l"), ("t.both", "t.r"), ("t.l", "t.r"))
        return _let("t", tokens, "greatest(" + ", ".join(ratio(x, y) for x, y in pairs) + ")")

    base = f"CAST({sql_lev_ratio('p.a', 'p.b')} AS DOUBLE)"
    near = f"greatest({base}, {by_token(sql_lev_ratio)} * CAST(0.95 AS DOUBLE))"
    far = (f"greatest({base}, {sql_window_ratio('p.a', 'p.b')} * CAST({scale} AS DOUBLE), "
           f"{by_token(sql_window_ratio)} * CAST(0.95 AS DOUBLE) * CAST({scale} AS DOUBLE))")
    return "CAST(" + _let("p", f"{{'a': {sql_clean(a)}, 'b': {sql_clean(b)}}}",
                          f"CASE WHEN {short} = 0 THEN 0 WHEN {far_apart} / {short} < 1.5 THEN round({near}) "
                          f"ELSE round({far}) END") + " AS BIGINT)"


def sql_penalty(len_a: str, len_b: str) -> str:
    d = f"abs({len_a} - {len_b})"
    return (f"(1.0 - greatest(0.0, least(CASE WHEN {d} <= 20 THEN 1.0 - exp(-0.005 * {d}) "
            f"ELSE 1.0 - exp(-2.0 * ({d} - 20)) END, 0.5)))")


def sql_minmax(x: str, lo: str, hi: str) -> str:
    return f"CASE WHEN {hi} = {lo} THEN 1.0 ELSE ({x} - {lo}) / ({hi} - {lo}) END"


LIMIT = 5

RERANK_CTE = SQL_HITS_CTE + f""",
usable AS (SELECT * FROM hits WHERE question IS NOT NULL),
stats AS (
  SELECT query_id, min(score) AS cos_min, max(score) AS cos_max
  FROM usable WHERE score > 15 GROUP BY query_id),
best AS (
  SELECT query_id, question AS best_question, score AS best_score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hit_pos ASC) AS rn
    FROM usable) WHERE rn = 1),
cos_ranked AS (
  SELECT query_id, query_text, hit_pos, id, question, score,
         row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hit_pos DESC) AS cos_rank
  FROM usable WHERE score > 15),
cosine AS (
  SELECT c.*, s.cos_min, s.cos_max,
         {sql_minmax('c.score', 's.cos_min', 's.cos_max')} AS cos_norm,
         @GATE@ AS partial
  FROM cos_ranked c JOIN stats s USING (query_id) WHERE c.cos_rank <= {LIMIT}),
cosine2 AS (SELECT *, CASE WHEN partial > 50 THEN cos_norm END AS cos_contrib FROM cosine),
fz_scored AS (
  SELECT query_id, query_text, hit_pos, id, question,
         @RANK@ AS fuzzy FROM usable),
fz_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fuzzy DESC, hit_pos ASC) AS fuzzy_rank
  FROM fz_scored),
fz_top AS (
  SELECT *, min(fuzzy) OVER (PARTITION BY query_id) AS fz_min,
            max(fuzzy) OVER (PARTITION BY query_id) AS fz_max
  FROM fz_ranked WHERE fuzzy_rank <= {LIMIT}),
fz_norm AS (
  SELECT *, {sql_minmax('CAST(fuzzy AS DOUBLE)', 'fz_min', 'fz_max')} AS fuzzy_norm,
         {sql_penalty('length(question)', 'length(query_text)')} AS penalty
  FROM fz_top),
fuzzy AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fuz_score DESC, fuzzy_rank ASC) AS pen_rank,
         CASE WHEN fuz_score > 0.5 THEN fuz_score END AS fuz_contrib
  FROM (SELECT *, penalty * fuzzy_norm AS fuz_score FROM fz_norm)),
contrib AS (
  SELECT query_id, question, cos_contrib AS contrib, cos_rank AS seq
  FROM cosine2 WHERE cos_contrib IS NOT NULL
  UNION ALL
  SELECT query_id, question, fuz_contrib AS contrib, pen_rank + {LIMIT} AS seq
  FROM fuzzy WHERE fuz_contrib IS NOT NULL AND query_id IN (SELECT query_id FROM stats)),
merged AS (
  SELECT query_id, question, sum(contrib) AS total, min(seq) AS first_seq
  FROM contrib GROUP BY query_id, question),
flags AS (
  SELECT s.query_id,
         coalesce(b.best_question = f.question AND b.best_score = CAST(f.fuzzy AS DOUBLE), false) AS flag
  FROM stats s JOIN best b USING (query_id)
  LEFT JOIN (SELECT * FROM fuzzy WHERE fuzzy_rank = 1) f USING (query_id)),
top AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, first_seq ASC) AS merged_rank
    FROM merged) WHERE merged_rank <= 5),
g1 AS (
  SELECT *, min(total) OVER (PARTITION BY query_id) AS t_min,
            max(total) OVER (PARTITION BY query_id) AS t_max FROM top),
g2 AS (SELECT *, {sql_minmax('total', 't_min', 't_max')} AS norm FROM g1),
g3 AS (
  SELECT *, sum(-(norm * ln(norm + 1e-10))) OVER (PARTITION BY query_id) AS h,
            max(norm) OVER (PARTITION BY query_id) AS max_norm FROM g2),
gated AS (
  SELECT g3.*, f.flag,
         CASE WHEN h <= 0 OR t_min > 0.9 THEN 'all'
              WHEN h > 0.95 OR f.flag THEN 'dominant' ELSE 'high' END AS branch
  FROM g3 LEFT JOIN flags f USING (query_id)),
gated2 AS (
  SELECT *, CASE WHEN branch = 'all' THEN true
                 WHEN branch = 'dominant' THEN norm >= max_norm - 0.05 AND norm <= max_norm
                 ELSE norm > 0.5 END AS keep
  FROM gated),
chosen AS (SELECT * FROM gated2 WHERE keep),
last_hit AS (
  SELECT * FROM (
    SELECT u.*, row_number() OVER (PARTITION BY u.query_id, u.question ORDER BY u.hit_pos DESC) AS rn
    FROM usable u JOIN (SELECT query_id, question FROM chosen) c USING (query_id, question))
  WHERE rn = 1)"""


def with_rerank(select: str, gate=sql_lev_ratio, rank=sql_lev_ratio, score: str | None = None, after_hits: str = "") -> str:
    """``select`` over the re-rank chain; ``score`` replaces the hits' score, ``after_hits`` holds further CTEs."""
    chain = RERANK_CTE
    if score:
        chain = chain.replace("\nhits AS (", "\nhits0 AS (").replace(
            ",\nusable AS (", f",\nhits AS (SELECT * REPLACE ({score} AS score) FROM hits0),\nusable AS (", 1)
    if after_hits:
        chain = chain.replace(",\nusable AS (", f",{after_hits},\nusable AS (", 1)
    return "WITH RECURSIVE " + chain.replace("@GATE@", gate("c.query_text", "c.question")).replace(
        "@RANK@", rank("query_text", "question")) + "\n" + select


def r6(x: str) -> str:
    """Round to 6 decimals and fold -0.0 into 0.0."""
    return f"(round({x}, 6) + 0.0)"
