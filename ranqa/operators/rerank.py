"""Re-rank search hits for many queries at once.

Input ``hits``: one row per (query, hit) with columns ``query_id``,
``query_text``, ``hit_pos`` (the order the search returned the hits in),
``id``, ``question`` (nullable: hits without one are ignored), ``score``
(cosine x 100) and any payload columns.  ``(query_id, id)`` is unique.

Per query the operator fuses two ranked lists and then decides how many
answers to keep:

1. cosine branch: hits with ``score > min_score``; min-max normalised over all
   of them; the top ``limit`` by score that pass ``gate_scorer > partial_gate``
   contribute their normalised score.  A query without such hits yields nothing.
2. fuzzy branch: the top ``limit`` hits by ``rank_scorer`` (ties: earlier hit);
   min-max normalised over that top list, times the length penalty; above
   ``fuzzy_gate`` the value contributes.
3. contributions are summed per question text; the best ``final_k`` texts are
   normalised again and an entropy-style spread ``H`` picks the rule:
   ``H <= 0`` or smallest total ``> floor_all`` keeps all; ``H > h_dominant`` or
   the agreement flag keeps those within ``band`` of the best; otherwise those
   above ``high``.
4. each kept text maps back to its last hit (by ``hit_pos``), payload intact.

Skew: a single query may own a third of all hits.  Nothing here gathers a
whole query in one task: per-query statistics are partial aggregates, both
top-``limit`` cuts are ``row_number() <= k`` filters that Spark plans as a
map-side ``WindowGroupLimit`` before the shuffle, and everything after the cuts
holds at most ``2*limit`` rows per query.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ranqa.functions.scoring import entropy_term, lev_ratio, minmax, text_length_penalty

# Fixed values (defaults equal to the reference's):
MIN_SCORE = 15.0      # raw score threshold, strict
LIMIT = 5             # top-k of each branch
PARTIAL_GATE = 50     # substring-match gate, strict
FUZZY_GATE = 0.5      # fuzzy-branch gate on normalised x penalty, strict
FINAL_K = 5           # merged texts considered by the entropy gate
EPSILON = 1e-10       # inside the log of the spread statistic
FLOOR_ALL = 0.9       # smallest merged total above this keeps everything
H_DOMINANT = 0.95     # spread above this keeps only the near-best
BAND = 0.05           # "near-best" band below the best normalised total
HIGH = 0.5            # otherwise keep normalised totals above this

KEY = "query_id"


class RerankStages:
    """Every intermediate relation of one re-rank run.

    Each stage is defined on first access only (defining a DataFrame costs
    driver-side analysis), and the whole decision is one chain of
    dependency-level ``withColumns`` steps.
    """

    def __init__(self, hits: DataFrame, *, limit: int = LIMIT, min_score: float = MIN_SCORE,
                 partial_gate: float = PARTIAL_GATE, fuzzy_gate: float = FUZZY_GATE,
                 final_k: int = FINAL_K, epsilon: float = EPSILON, floor_all: float = FLOOR_ALL,
                 h_dominant: float = H_DOMINANT, band: float = BAND, high: float = HIGH,
                 gate_scorer=lev_ratio, rank_scorer=lev_ratio):
        self.hits = hits
        self.p = dict(limit=limit, min_score=min_score, partial_gate=partial_gate, fuzzy_gate=fuzzy_gate,
                      final_k=final_k, epsilon=epsilon, floor_all=floor_all, h_dominant=h_dominant,
                      band=band, high=high)
        self.gate_scorer, self.rank_scorer = gate_scorer, rank_scorer

    @cached_property
    def usable(self) -> DataFrame:
        """Hits with a question."""
        return self.hits.where(F.col("question").isNotNull())

    @cached_property
    def stats(self) -> DataFrame:
        """Per query: min/max survivor score (queries without survivors absent)."""
        survivor = F.col("score") > F.lit(self.p["min_score"])
        return (self.usable.groupBy(KEY)
                .agg(F.min(F.when(survivor, F.col("score"))).alias("cos_min"),
                     F.max(F.when(survivor, F.col("score"))).alias("cos_max"))
                .where(F.col("cos_max").isNotNull()))

    @cached_property
    def scored(self) -> DataFrame:
        """Both top-limit lists (``branch`` cos / fz) with every per-row score and the flag.

        ONE scan of the hits generates every ranked list the decision needs,
        each cut at ``limit`` per (query, list) by one window whose
        ``row_number`` filter is planned as a map-side WindowGroupLimit: the
        shuffle carries at most ``limit`` rows per query, list and task.

        * cos  : survivors (score > min_score) by score, ties later-hit-first
          (reversed arg-sort; normalised order == score order)
        * fz   : every usable hit by the rank scorer, ties earlier-hit-first
        * best : survivors by score, ties earlier-hit-first -> rank 1 = arg-max
          (the arg-max over all hits is a survivor whenever one exists)
        * low  : survivors by ascending score -> rank 1 = min survivor score

        No explicit projection: Catalyst prunes unused columns, and injected
        scorer inputs stay reachable.
        """
        p, limit = self.p, self.p["limit"]
        survivor = F.col("score") > F.lit(p["min_score"])

        def lst(name, ok, k1, k2):
            return F.struct(F.lit(name).alias("branch"), ok.alias("ok"),
                            k1.cast("double").alias("k1"), k2.cast("bigint").alias("k2"))

        fuzzy = self.rank_scorer(F.col("query_text"), F.col("question")).cast("int")
        cand = (self.usable.withColumn("fuzzy", fuzzy)
                .withColumn("_l", F.explode(F.array(
                    lst("cos", survivor, F.col("score"), F.col("hit_pos")),
                    lst("fz", F.lit(True), F.col("fuzzy"), -F.col("hit_pos")),
                    lst("best", survivor, F.col("score"), -F.col("hit_pos")),
                    lst("low", survivor, -F.col("score"), F.lit(0))))))
        w_list = Window.partitionBy(KEY, F.col("_l.branch")).orderBy(F.col("_l.k1").desc(), F.col("_l.k2").desc())
        ranked = (cand.where(F.col("_l.ok"))
                  .withColumns({"branch": F.col("_l.branch"), "rank": F.row_number().over(w_list)})
                  .where(F.col("rank") <= limit)
                  .drop("_l"))

        # <= 4*limit rows per query from here; windows reuse the query partitioning
        w_q = Window.partitionBy(KEY)
        is_cos, is_fz = F.col("branch") == "cos", F.col("branch") == "fz"

        def first_of(cond, c):
            return F.max(F.when(cond & (F.col("rank") == 1), F.col(c))).over(w_q)

        lvl1 = ranked.withColumns({
            "cos_max": first_of(F.col("branch") == "best", "score"),
            "cos_min": first_of(F.col("branch") == "low", "score"),
            "best_question": first_of(F.col("branch") == "best", "question"),
            "best_score": first_of(F.col("branch") == "best", "score"),
            "fz_question": first_of(is_fz, "question"),
            "fz_score": first_of(is_fz, "fuzzy"),
            "fz_min": F.min(F.when(is_fz, F.col("fuzzy"))).over(w_q),
            "fz_max": F.max(F.when(is_fz, F.col("fuzzy"))).over(w_q),
        })
        # queries without survivors drop out (the reference returns nothing)
        lvl1 = lvl1.where(F.col("cos_max").isNotNull() & F.col("branch").isin("cos", "fz"))
        lvl2 = lvl1.withColumns({
            "cos_norm": F.when(is_cos, minmax("score", "cos_min", "cos_max")),
            # null input keeps the (possibly Python) gate scorer off fuzzy rows
            "partial": self.gate_scorer(F.col("query_text"), F.when(is_cos, F.col("question"))).cast("int"),
            "fuzzy_norm": F.when(is_fz, minmax(F.col("fuzzy").cast("double"), F.col("fz_min"), F.col("fz_max"))),
            "penalty": F.when(is_fz, text_length_penalty("question", "query_text")),
            # agreement flag: same text tops both lists and raw score == fuzzy int
            "flag": F.coalesce((F.col("best_question") == F.col("fz_question"))
                               & (F.col("best_score") == F.col("fz_score").cast("double")), F.lit(False)),
        })
        lvl3 = lvl2.withColumns({
            "cos_contrib": F.when(is_cos & (F.col("partial") > F.lit(p["partial_gate"])), F.col("cos_norm")),
            "fuz_score": F.col("penalty") * F.col("fuzzy_norm"),
        })
        w_pen = Window.partitionBy(KEY, "branch").orderBy(F.col("fuz_score").desc(), F.col("rank").asc())
        return lvl3.withColumns({
            "pen_rank": F.when(is_fz, F.row_number().over(w_pen)),
            "fuz_contrib": F.when(is_fz & (F.col("fuz_score") > F.lit(p["fuzzy_gate"])), F.col("fuz_score")),
        })

    @cached_property
    def cosine(self) -> DataFrame:
        return self.scored.where(F.col("branch") == "cos").withColumnRenamed("rank", "cos_rank")

    @cached_property
    def fuzzy(self) -> DataFrame:
        return self.scored.where(F.col("branch") == "fz").withColumnRenamed("rank", "fuzzy_rank")

    @cached_property
    def merged(self) -> DataFrame:
        """Per (query, text): summed contributions; first_seq = dict insertion order."""
        is_cos = F.col("branch") == "cos"
        return (self.scored
                .withColumns({"contrib": F.coalesce("cos_contrib", "fuz_contrib"),
                              "seq": F.when(is_cos, F.col("rank"))
                                      .otherwise(F.col("pen_rank") + F.lit(self.p["limit"]))})
                .where(F.col("contrib").isNotNull())
                .groupBy(KEY, "question")
                .agg(F.sum("contrib").alias("total"), F.min("seq").alias("first_seq"),
                     F.first("flag").alias("flag")))

    @cached_property
    def gated(self) -> DataFrame:
        p = self.p
        return entropy_gate(self.merged, None, final_k=p["final_k"], epsilon=p["epsilon"],
                            floor_all=p["floor_all"], h_dominant=p["h_dominant"], band=p["band"],
                            high=p["high"])

    @cached_property
    def result(self) -> DataFrame:
        """Kept texts mapped to their last hit (dict overwrite), full hit row kept."""
        # the chosen rows (<= final_k per query) are referenced once: joined to
        # the hits holding their text, then one aggregate keeps the last hit
        # (decision columns are constant per group)
        chosen = self.gated.where("keep").select(KEY, "question", F.col("merged_rank").alias("_rank"),
                                                 F.col("total").alias("_total"), F.col("norm").alias("_norm"),
                                                 F.col("h").alias("_h"), F.col("branch").alias("_branch"))
        hit_cols = [c for c in self.hits.columns if c not in (KEY, "question")]
        picked = (self.usable.join(chosen, [KEY, "question"])
                  .groupBy(KEY, "question")
                  .agg(F.max_by(F.struct(*hit_cols), F.col("hit_pos")).alias("hit"),
                       *[F.first(c).alias(c) for c in ("_rank", "_total", "_norm", "_h", "_branch")]))
        return picked.select(KEY, F.col("_rank").alias("rank"), "hit.*", "question",
                             F.col("_total").alias("total"), F.col("_norm").alias("norm"),
                             F.col("_h").alias("h"), F.col("_branch").alias("branch"))


def rerank_stages(hits: DataFrame, **kw) -> RerankStages:
    return RerankStages(hits, **kw)


def entropy_gate(merged: DataFrame, flags: DataFrame | None, *, final_k: int = FINAL_K,
                 epsilon: float = EPSILON, floor_all: float = FLOOR_ALL, h_dominant: float = H_DOMINANT,
                 band: float = BAND, high: float = HIGH) -> DataFrame:
    """Decide which merged texts to keep.

    ``merged``: ``query_id, question, total, first_seq`` and either a
    ``flag`` column or a separate ``flags`` table ``query_id, flag``.  The
    best ``final_k`` texts (ties: first inserted) are min-max normalised;
    ``h = -sum(n*ln(n+epsilon))``; the branch rule is evaluated on unrounded
    values.
    """
    w_q = Window.partitionBy(KEY)
    w_m = Window.partitionBy(KEY).orderBy(F.col("total").desc(), F.col("first_seq").asc())
    top = (merged.withColumn("merged_rank", F.row_number().over(w_m))
           .where(F.col("merged_rank") <= final_k))
    if flags is not None:
        top = top.join(flags, KEY, "left")
    top = top.withColumns({"t_min": F.min("total").over(w_q), "t_max": F.max("total").over(w_q)})
    top = top.withColumn("norm", minmax("total", "t_min", "t_max"))
    top = top.withColumns({"h": F.sum(entropy_term(F.col("norm"), epsilon)).over(w_q),
                           "max_norm": F.max("norm").over(w_q)})
    branch = (F.when((F.col("h") <= 0) | (F.col("t_min") > F.lit(floor_all)), F.lit("all"))
              .when((F.col("h") > F.lit(h_dominant)) | F.col("flag"), F.lit("dominant"))
              .otherwise(F.lit("high")))
    top = top.withColumn("branch", branch)
    keep = (F.when(F.col("branch") == "all", F.lit(True))
            .when(F.col("branch") == "dominant",
                  (F.col("norm") >= F.col("max_norm") - F.lit(band)) & (F.col("norm") <= F.col("max_norm")))
            .otherwise(F.col("norm") > F.lit(high)))
    return top.withColumn("keep", keep)


def attach_queries(hits: DataFrame, queries: DataFrame, text_col: str = "query_text",
                   salt: int = 1) -> DataFrame:
    """Give each hit its query text from ``queries(query_id, <text_col>)``.

    An N:1 equi-join on the query key; hits of queries missing from the table
    are dropped.  The query table is not force-broadcast: AQE broadcasts it
    when its runtime size is small and otherwise splits a hot query's
    partition of the hits (skew join).  ``salt > 1`` additionally replicates
    each query row ``salt`` times and spreads the hits over the salts by
    ``hit_pos``, for clusters without AQE skew handling.
    """
    q = queries.select(F.col(KEY), F.col(text_col).alias("query_text"))
    h = hits.drop("query_text")
    if salt <= 1:
        return h.join(q, KEY)
    q = q.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    h = h.withColumn("_salt", F.pmod(F.xxhash64("hit_pos"), F.lit(salt)))
    return h.join(q, [KEY, "_salt"]).drop("_salt")


def dedupe_hits(hits: DataFrame) -> DataFrame:
    """Keep the last hit (by ``hit_pos``) of each ``(query_id, id)``.

    A repeated id in one hit list overwrites the earlier entry in the
    reference; this restores the unique-id precondition.  The shuffle key
    includes the id, so a large query spreads over many tasks, and the
    aggregate is partial (map-side) first.
    """
    cols = [c for c in hits.columns if c not in (KEY, "id")]
    return (hits.groupBy(KEY, "id").agg(F.max_by(F.struct(*cols), F.col("hit_pos")).alias("_h"))
            .select(KEY, "id", "_h.*").select(*hits.columns))


def rerank(hits: DataFrame, *, dedupe_ids: bool = False, **kw) -> DataFrame:
    """Kept hits per query: ``query_id, rank, <hit columns>, total, norm, h, branch``.

    ``dedupe_ids=True`` first applies :func:`dedupe_hits` (needed only when an
    id can repeat inside one query's hit list).
    """
    return rerank_stages(dedupe_hits(hits) if dedupe_ids else hits, **kw).result


def observed_rerank(hits: DataFrame, name: str = "rerank", **kw):
    """``rerank`` plus an ``Observation`` filled while the result is written:
    kept rows, distinct-free per-branch row counts and the summed totals (the
    counters the reference logs), gathered in the same pass, no extra job."""
    from pyspark.sql import Observation

    obs = Observation(name)
    out = rerank(hits, **kw).observe(
        obs,
        F.count(F.lit(1)).alias("kept_rows"),
        F.sum(F.when(F.col("branch") == "all", 1).otherwise(0)).alias("rows_all"),
        F.sum(F.when(F.col("branch") == "dominant", 1).otherwise(0)).alias("rows_dominant"),
        F.sum(F.when(F.col("branch") == "high", 1).otherwise(0)).alias("rows_high"),
        F.sum(F.when(F.col("rank") == 1, 1).otherwise(0)).alias("queries_answered"),
    )
    return out, obs


def rerank_trace(hits: DataFrame, **kw) -> DataFrame:
    """One row per usable hit with every intermediate score of both branches.

    Replaces per-step logging: a query's whole decision can be read back with
    a filter on ``query_id``.  The two top-limit lists are folded onto their
    hit with one aggregation, then left-joined to the hits.
    """
    st = rerank_stages(hits, **kw)
    is_cos, is_fz = F.col("branch") == "cos", F.col("branch") == "fz"

    def pick(cond, c, name):
        return F.max(F.when(cond, F.col(c))).alias(name)

    per_hit = st.scored.groupBy(KEY, "hit_pos").agg(
        pick(is_cos, "rank", "cos_rank"), pick(is_cos, "cos_norm", "cos_norm"),
        pick(is_cos, "partial", "partial"), pick(is_cos, "cos_contrib", "cos_contrib"),
        pick(is_fz, "fuzzy", "fuzzy"), pick(is_fz, "rank", "fuzzy_rank"),
        pick(is_fz, "fuzzy_norm", "fuzzy_norm"), pick(is_fz, "penalty", "penalty"),
        pick(is_fz, "fuz_score", "fuz_score"), pick(is_fz, "pen_rank", "pen_rank"),
        pick(is_fz, "fuz_contrib", "fuz_contrib"))
    return (st.usable.select(KEY, "hit_pos", "id", "question", "score")
            .join(st.stats.select(KEY, "cos_min", "cos_max"), KEY, "left")
            .join(per_hit, [KEY, "hit_pos"], "left"))


def preview_trace(trace: DataFrame, n: int = 10, order_col: str = "hit_pos") -> DataFrame:
    """The first ``n`` trace rows of every query (the per-query preview the
    step-by-step log printed); a ``row_number() <= n`` cut, planned as a
    partial top-n before the shuffle."""
    w = Window.partitionBy(KEY).orderBy(F.col(order_col).asc())
    return trace.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
