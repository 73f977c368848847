"""Registered queries of the re-ranking side (hit lists, both branches, fusion,
entropy gate, full re-rank, trace)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ranqa.functions import blocks
from ranqa.functions.fuzzy import weighted_ratio, window_ratio
from ranqa.functions.scoring import lev_ratio, text_length_penalty
from ranqa.operators.rerank import rerank_stages, rerank_trace
from ranqa.plans.fixtures import brand_hits
from ranqa.plans.registry import r6, register
from ranqa.plans.sql_blocks import block_scores
from ranqa.plans.sql_rerank import r6 as s6
from ranqa.plans.sql_rerank import sql_lev_ratio, sql_penalty, sql_weighted_ratio, sql_window_ratio, with_rerank


@register("cosine_hits", "H1 S7 S8: cosine hit lists from the vector index",
          with_rerank("SELECT query_id, query_text, hit_pos, id, question, score, p_brand FROM hits"))
def cosine_hits(spark, sf):
    return brand_hits(spark, sf)


@register("hit_normalise", "P3 P4 P5 A1 W1: survivors > 15, min-max per query",
          with_rerank(f"""
SELECT u.query_id, u.hit_pos, u.score, s.cos_min, s.cos_max,
       {s6('CASE WHEN s.cos_max = s.cos_min THEN 1.0 ELSE (u.score - s.cos_min) / (s.cos_max - s.cos_min) END')}
         AS cos_norm
FROM usable u JOIN stats s USING (query_id) WHERE u.score > 15"""))
def hit_normalise(spark, sf):
    from ranqa.functions.scoring import minmax
    st = rerank_stages(brand_hits(spark, sf))
    return (st.usable.where(F.col("score") > 15).join(st.stats.select("query_id", "cos_min", "cos_max"), "query_id")
            .select("query_id", "hit_pos", "score", "cos_min", "cos_max",
                    r6(minmax("score", "cos_min", "cos_max")).alias("cos_norm")))


@register("hit_topk", "W2 T2 P6: cosine top-limit with the substring gate",
          with_rerank(f"""
SELECT query_id, hit_pos, id, question, cos_rank, {s6('cos_norm')} AS cos_norm, partial,
       {s6('cos_contrib')} AS cos_contrib FROM cosine2"""))
def hit_topk(spark, sf):
    c = rerank_stages(brand_hits(spark, sf)).cosine
    return c.select("query_id", "hit_pos", "id", "question", "cos_rank", r6("cos_norm").alias("cos_norm"),
                    "partial", r6("cos_contrib").alias("cos_contrib"))


@register("length_penalty", "D1 P12 X1-X5: length-difference multiplier per hit",
          with_rerank(f"""
SELECT query_id, hit_pos, length(question) AS len_hit, length(query_text) AS len_query,
       {s6(sql_penalty('length(question)', 'length(query_text)'))} AS penalty FROM usable"""))
def length_penalty_q(spark, sf):
    h = brand_hits(spark, sf)
    return h.select("query_id", "hit_pos", F.char_length("question").alias("len_hit"),
                    F.char_length("query_text").alias("len_query"),
                    r6(text_length_penalty("question", "query_text")).alias("penalty"))


@register("fuzzy_topk_native", "D2 D5 W3 W4 A2 P7: fuzzy top-limit, norm x penalty, gate",
          with_rerank(f"""
SELECT query_id, hit_pos, id, question, fuzzy, fuzzy_rank, {s6('fuzzy_norm')} AS fuzzy_norm,
       {s6('penalty')} AS penalty, {s6('fuz_score')} AS fuz_score, pen_rank,
       {s6('fuz_contrib')} AS fuz_contrib FROM fuzzy
WHERE query_id IN (SELECT query_id FROM stats)"""))
def fuzzy_topk_native(spark, sf):
    f = rerank_stages(brand_hits(spark, sf)).fuzzy
    return f.select("query_id", "hit_pos", "id", "question", "fuzzy", "fuzzy_rank",
                    r6("fuzzy_norm").alias("fuzzy_norm"), r6("penalty").alias("penalty"),
                    r6("fuz_score").alias("fuz_score"), "pen_rank", r6("fuz_contrib").alias("fuz_contrib"))


@register("fuzzy_topk_wratio", "D2 F2: fuzzy branch with the weighted ratio", with_rerank(f"""
SELECT query_id, hit_pos, id, question, fuzzy, fuzzy_rank, {s6('fuz_score')} AS fuz_score, pen_rank FROM fuzzy
WHERE query_id IN (SELECT query_id FROM stats)""",
          rank=sql_weighted_ratio))
def fuzzy_topk_wratio(spark, sf):
    f = rerank_stages(brand_hits(spark, sf), rank_scorer=weighted_ratio).fuzzy
    return f.select("query_id", "hit_pos", "id", "question", "fuzzy", "fuzzy_rank",
                    r6("fuz_score").alias("fuz_score"), "pen_rank")


@register("partial_gate", "P6 F1: cosine top-limit gated by the substring ratio", with_rerank(f"""
SELECT query_id, hit_pos, question, cos_rank, partial, {s6('cos_contrib')} AS cos_contrib FROM cosine2""",
          gate=sql_window_ratio))
def partial_gate(spark, sf):
    c = rerank_stages(brand_hits(spark, sf), gate_scorer=window_ratio).cosine
    return c.select("query_id", "hit_pos", "question", "cos_rank", "partial",
                    r6("cos_contrib").alias("cos_contrib"))


@register("fused_top5", "A4 W5 U5 J11: contributions summed per text, top 5",
          with_rerank(f"""
SELECT query_id, question, {s6('total')} AS total, first_seq, merged_rank FROM top"""))
def fused_top5(spark, sf):
    from pyspark.sql import Window
    m = rerank_stages(brand_hits(spark, sf)).merged
    w = Window.partitionBy("query_id").orderBy(F.col("total").desc(), F.col("first_seq").asc())
    return (m.withColumn("merged_rank", F.row_number().over(w)).where("merged_rank <= 5")
            .select("query_id", "question", r6("total").alias("total"), "first_seq", "merged_rank"))


@register("gate_branch", "A3 A7 A8 D7 P8 P9: normalised totals, spread, branch, keep",
          with_rerank(f"""
SELECT query_id, question, merged_rank, {s6('norm')} AS norm, {s6('h')} AS h, {s6('t_min')} AS t_min,
       flag, branch, keep FROM gated2"""))
def gate_branch(spark, sf):
    g = rerank_stages(brand_hits(spark, sf)).gated
    return g.select("query_id", "question", "merged_rank", r6("norm").alias("norm"), r6("h").alias("h"),
                    r6("t_min").alias("t_min"), "flag", "branch", "keep")


RERANK_SELECT = f"""
SELECT c.query_id, c.merged_rank AS rank, l.query_text, l.hit_pos, l.id, l.score, l.p_brand,
       c.question, {s6('c.total')} AS total, {s6('c.norm')} AS norm, {s6('c.h')} AS h, c.branch
FROM chosen c JOIN last_hit l USING (query_id, question)"""


def _final(df):
    return df.select("query_id", "rank", "query_text", "hit_pos", "id", "score", "p_brand", "question",
                     r6("total").alias("total"), r6("norm").alias("norm"), r6("h").alias("h"), "branch")


@register("rerank_native", "D3 J9 J10 A11 P10: full re-rank, native scorers (flagship)",
          with_rerank(RERANK_SELECT))
def rerank_native(spark, sf):
    return _final(rerank_stages(brand_hits(spark, sf)).result)


@register("rerank_fuzzy", "D3 F1 F2: full re-rank with substring gate and weighted-ratio ranking",
          with_rerank(RERANK_SELECT, gate=sql_window_ratio, rank=sql_weighted_ratio))
def rerank_fuzzy(spark, sf):
    return _final(rerank_stages(brand_hits(spark, sf), gate_scorer=window_ratio,
                                rank_scorer=weighted_ratio).result)


@register("rerank_trace", "S10: every intermediate score per usable hit",
          with_rerank(f"""
SELECT u.query_id, u.hit_pos, u.id, u.question, u.score, s.cos_min, s.cos_max,
       CAST(c.cos_rank AS DOUBLE) AS cos_rank, {s6('c.cos_norm')} AS cos_norm,
       CAST(c.partial AS DOUBLE) AS partial, {s6('c.cos_contrib')} AS cos_contrib,
       CAST(f.fuzzy AS DOUBLE) AS fuzzy, CAST(f.fuzzy_rank AS DOUBLE) AS fuzzy_rank,
       {s6('f.fuzzy_norm')} AS fuzzy_norm, {s6('f.penalty')} AS penalty,
       {s6('f.fuz_score')} AS fuz_score, CAST(f.pen_rank AS DOUBLE) AS pen_rank,
       {s6('f.fuz_contrib')} AS fuz_contrib
FROM usable u LEFT JOIN stats s USING (query_id)
LEFT JOIN cosine2 c ON c.query_id = u.query_id AND c.hit_pos = u.hit_pos
LEFT JOIN (SELECT * FROM fuzzy WHERE query_id IN (SELECT query_id FROM stats)) f
  ON f.query_id = u.query_id AND f.hit_pos = u.hit_pos"""))
def rerank_trace_q(spark, sf):
    # ranks and integer scores are NULL for hits outside a top-limit list;
    # reported as double so a missing value converts alike in every engine
    t = rerank_trace(brand_hits(spark, sf))
    d = {c: F.col(c).cast("double").alias(c) for c in ("cos_rank", "partial", "fuzzy", "fuzzy_rank", "pen_rank")}
    return t.select("query_id", "hit_pos", "id", "question", "score", "cos_min", "cos_max", d["cos_rank"],
                    r6("cos_norm").alias("cos_norm"), d["partial"], r6("cos_contrib").alias("cos_contrib"),
                    d["fuzzy"], d["fuzzy_rank"], r6("fuzzy_norm").alias("fuzzy_norm"), r6("penalty").alias("penalty"),
                    r6("fuz_score").alias("fuz_score"), d["pen_rank"], r6("fuz_contrib").alias("fuz_contrib"))


@register("agreement_flag", "A5 A6 D6: arg-max of both lists and the agreement flag",
          with_rerank("""
SELECT s.query_id, b.best_question, b.best_score, f.question AS fz_question, f.fuzzy AS fz_score, fl.flag
FROM stats s JOIN best b USING (query_id) JOIN flags fl USING (query_id)
LEFT JOIN (SELECT * FROM fuzzy WHERE fuzzy_rank = 1) f USING (query_id)"""))
def agreement_flag(spark, sf):
    sc = rerank_stages(brand_hits(spark, sf)).scored
    return sc.groupBy("query_id").agg(*[F.first(c).alias(c) for c in
                                        ("best_question", "best_score", "fz_question", "fz_score", "flag")])


_HIT_PAIRS = "\nhit_pairs AS (SELECT query_text AS a, question AS b FROM hits WHERE question IS NOT NULL)," + block_scores("hit_pairs")


def _sql_block(score: str):
    return lambda a, b: f"(SELECT bs.{score} FROM bs WHERE bs.a = {a} AND bs.b = {b})"


@register("block_scores", "F1 F2 D2: plain, substring and weighted matching-block scores of query and hit texts",
          with_rerank("SELECT a AS query_text, b AS question, ratio, partial, weighted FROM bs", after_hits=_HIT_PAIRS))
def block_scores_q(spark, sf):
    pairs = brand_hits(spark, sf).where("question is not null").select("query_text", "question").distinct()
    return pairs.select("query_text", "question", blocks.ratio("query_text", "question").alias("ratio"),
                        blocks.partial_ratio("query_text", "question").alias("partial"),
                        blocks.weighted_ratio("query_text", "question").alias("weighted"))


@register("rerank_blocks", "D3 F1 F2 F5: full re-rank, matching-block substring gate and weighted ranking",
          with_rerank(RERANK_SELECT, gate=_sql_block("partial"), rank=_sql_block("weighted"), after_hits=_HIT_PAIRS))
def rerank_blocks(spark, sf):
    return _final(rerank_stages(brand_hits(spark, sf), gate_scorer=blocks.partial_ratio,
                                rank_scorer=blocks.weighted_ratio).result)


# Hit lists whose search score is the texts' own edit ratio: best hit and best text agree, so the flag is true and
# the dominant rule decides.
def _agreeing_hits(spark, sf):
    h = brand_hits(spark, sf)
    return h.withColumn("score", lev_ratio("query_text", "question").cast("double"))


_AGREEING = f"CAST({sql_lev_ratio('query_text', 'question')} AS DOUBLE)"


@register("gate_dominant", "P9 D6 D7 A5 A6: entropy gate where both lists agree (true flag, dominant rule)",
          with_rerank(f"""
SELECT query_id, question, merged_rank, {s6('norm')} AS norm, {s6('h')} AS h, {s6('t_min')} AS t_min,
       flag, branch, keep FROM gated2""", score=_AGREEING))
def gate_dominant(spark, sf):
    g = rerank_stages(_agreeing_hits(spark, sf)).gated
    return g.select("query_id", "question", "merged_rank", r6("norm").alias("norm"), r6("h").alias("h"),
                    r6("t_min").alias("t_min"), "flag", "branch", "keep")


@register("rerank_dominant", "D3 P9: full re-rank where the dominant rule decides", with_rerank(RERANK_SELECT, score=_AGREEING))
def rerank_dominant(spark, sf):
    return _final(rerank_stages(_agreeing_hits(spark, sf)).result)
