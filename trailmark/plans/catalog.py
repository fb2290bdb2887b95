"""Query catalog: one Spark query per operator, with its oracle SQL.

Each query takes (spark, sf_dir) and returns a lazy DataFrame over the whole
driver tables. Doubles are rounded (``round_to``) the same way as in the SQL
so the two engines can be compared value by value.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.functions.exprs import major_group, round_to
from trailmark.operators import classify, clean, drift, labels, markov, reports, rules, segments, transitions
from trailmark.operators.sequence import ordered_sequence
from trailmark.plans.journey import EVENT_KEY, context
from trailmark.plans.oracle import CTES, GIVEN_CENTRES, R, sql, sql_with, with_scores
from trailmark.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def r6(c):
    return round_to(c, 6)


KEY = ["person_id", "matched_label", "start_date"]
SRC = list(tables.JOB_EVENT_ORDER)

# --------------------------------------------------------------- phase 1: events


@query("scan_union", sql("""select split, count(*) as n_rows, count(distinct person_id) as n_persons from (
      select 'train' as split, * from fx where person_id % 10 < 6
      union all select 'validation', * from fx where person_id % 10 in (6, 7)
      union all select 'test', * from fx where person_id % 10 >= 8) group by split""", "fx"))
def q_scan_union(spark, sf):
    """A1 + D1: the fixture written in one pass as three split files, then
    scanned back: existing files only, stacked by column name."""
    ctx = context(spark, sf)
    m = F.col("person_id") % 10
    split = F.when(m < 6, "train").when(m.isin(6, 7), "validation").otherwise("test")
    ctx._stage("splits", lambda: ctx.raw.withColumn("split", split).withColumn("file", F.col("split")), partition_by=["file"])
    u = tables.load_splits(spark, [f"{stages.data_path(spark, ctx.stage_path('splits'))}/file={n}" for n in ("train", "validation", "test")])
    return u.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"),
                                  F.countDistinct("person_id").alias("n_persons"))


@query("clean_labels", sql(f"select {', '.join(KEY + SRC)} from lab", "lab"))
def q_clean_labels(spark, sf):
    return clean.clean_labels(context(spark, sf).raw).select(*KEY, *SRC)


@query("dedup_events", sql(f"select {', '.join(KEY + SRC)}, matched_code, matched_description from dd", "dd"))
def q_dedup(spark, sf):
    d = clean.dedup_events(clean.clean_labels(context(spark, sf).raw), KEY, SRC)
    return d.select(*KEY, *SRC, "matched_code", "matched_description")


@query("extract_year", sql("select person_id, matched_label, start_date, yr from yd", "yd"))
def q_extract_year(spark, sf):
    d = clean.dedup_events(clean.clean_labels(context(spark, sf).raw), KEY, SRC)
    return clean.with_year(d).select(*KEY, "yr")


@query("year_range", sql("select person_id, matched_label, start_date, yr from ev0", "ev0"))
def q_year_range(spark, sf):
    return context(spark, sf).events.select(*KEY, "yr")


@query("needs_nlp", sql("select person_id, matched_label, start_date, matched_code, needs_nlp from ev", "ev"))
def q_needs_nlp(spark, sf):
    return context(spark, sf).events.select(*KEY, "matched_code", "needs_nlp")


@query("isco_l3", sql("""select occupation_group, count(*) as n_events, count(distinct person_id) as n_persons
    from ev group by occupation_group""", "ev"))
def q_isco_l3(spark, sf):
    return context(spark, sf).events.groupBy("occupation_group").agg(
        F.count(F.lit(1)).alias("n_events"), F.countDistinct("person_id").alias("n_persons"))


@query("combined_text", sql("select person_id, matched_label, start_date, combined_text from ev", "ev"))
def q_combined_text(spark, sf):
    return context(spark, sf).events.select(*KEY, "combined_text")


_MAJOR_SQL = ("case substring(state, 1, 1) " + " ".join(
    f"when '{k}' then '{v}'" for k, v in __import__("trailmark.functions.exprs", fromlist=["x"])
    .MAJOR_GROUPS.items()) + " else 'Other' end")


@query("major_group", sql(f"select state, idx, {_MAJOR_SQL} as major_group from sp", "sp"))
def q_major_group(spark, sf):
    return context(spark, sf).space.withColumn("major_group", major_group("state"))


@query("label_names", sql(f"""select e.person_id, e.matched_label, e.start_date,
      coalesce(d.name, 'Unknown') as group_name
    from ev e left join (select state, state || ' ' || {_MAJOR_SQL} as name from sp) d
      on d.state = e.occupation_group""", "ev", "sp"))
def q_label_names(spark, sf):
    ctx = context(spark, sf)
    dim = ctx.space.select("state", F.concat_ws(" ", "state", major_group("state")).alias("name"))
    return labels.with_names(ctx.events, dim, "occupation_group", "group_name").select(*KEY, "group_name")


@query("hierarchy_pairs", sql("""select cur, nxt, count(*) as n,
      substring(cur, 1, 1) = substring(nxt, 1, 1) as same_l1,
      substring(cur, 1, 2) = substring(nxt, 1, 2) as same_l2,
      coalesce((try_cast(substring(nxt, 1, 1) as integer) - try_cast(substring(cur, 1, 1) as integer)) / 9.0e0, 0.0e0) as direction
    from tr group by cur, nxt""", "tr"))
def q_hierarchy_pairs(spark, sf):
    t = context(spark, sf).transitions.groupBy("cur", "nxt").agg(F.count(F.lit(1)).alias("n"))
    t = labels.hierarchy(labels.hierarchy(t, "cur", "c_"), "nxt", "n_")
    return t.select("cur", "nxt", "n",
                    (F.col("c_l1") == F.col("n_l1")).alias("same_l1"),
                    (F.col("c_l2") == F.col("n_l2")).alias("same_l2"),
                    F.coalesce((F.col("n_l1").try_cast("int") - F.col("c_l1").try_cast("int")) / 9.0,
                               F.lit(0.0)).alias("direction"))


@query("label_check", sql("""select count(*) as coded_rows,
      count_if(not (state is not distinct from substring(split_part(matched_code, '.', 1), 1, 3))) as mismatches
    from mrg where matched_code is not null and trim(matched_code) <> '' and lower(matched_code) <> 'unknown'""", "mrg"))
def q_label_check(spark, sf):
    """B12 on the merged rows (coded and accepted model labels)."""
    ctx = context(spark, sf)
    return labels.label_check(ctx.merged_events(_sql_scores(ctx), classify.CONFIDENCE))


def _sql_scores(ctx):
    """Predicted group and confidence of the uncoded events, made of their text
    lengths: a stand-in for a model's scores that SQL can compute too."""
    return ctx.events.filter("needs_nlp").select(
        *EVENT_KEY, (100 + (F.length("matched_label") * 7) % 800).cast("string").alias("predicted"),
        ((F.length("combined_text") * 37 % 101) / F.lit(100.0)).alias("confidence"))


@query("confidence_gate", sql("""select person_id, matched_label, start_date, predicted from scu where confidence >= 0.35""", "scu"))
def q_confidence_gate(spark, sf):
    """I6."""
    return classify.confidence_gate(_sql_scores(context(spark, sf))).select(*EVENT_KEY, "predicted")


@query("score_histogram", sql(f"""select cast(least(floor(confidence * 20), 19) as integer) as bin,
      cast(least(floor(confidence * 20), 19) as integer) / 20.0e0 as lo, count(*) as n,
      {R('(select count_if(confidence >= 0.35) * 1.0e0 / count(*) from scu)')} as kept_share
    from scu group by cast(least(floor(confidence * 20), 19) as integer)""", "scu"))
def q_score_histogram(spark, sf):
    """I7 on the uncoded events."""
    h = classify.confidence_hist(_sql_scores(context(spark, sf)))
    return h.withColumn("kept_share", r6("kept_share"))


@query("label_drops", sql("""select (select count_if(not needs_nlp) from ev) as coded_rows, (select count_if(needs_nlp) from ev) as uncoded_rows,
      (select count_if(confidence >= 0.35) from scu) as accepted_rows,
      (select count_if(needs_nlp) from ev) - (select count_if(confidence >= 0.35) from scu) as dropped_low_confidence""", "ev", "scu"))
def q_label_drops(spark, sf):
    """A10, label step."""
    ctx = context(spark, sf)
    return labels.label_drops(ctx.events, _sql_scores(ctx), classify.CONFIDENCE)


@query("fallback_transitions", sql("""select person_id, pos, cur, nxt, prev, label_source from (
      select person_id, label_source, state as cur, lead(state) over w as nxt, lag(state) over w as prev,
             cast(row_number() over w - 1 as bigint) as pos
      from mrg window w as (partition by person_id order by yr, start_date, matched_label)) where nxt is not null""", "mrg"))
def q_fallback_transitions(spark, sf):
    """F1 on the merged rows: uncoded events re-enter with their accepted label."""
    ctx = context(spark, sf)
    t = transitions.build_transitions(ctx.merged_events(_sql_scores(ctx), classify.CONFIDENCE))
    return t.select("person_id", "pos", "cur", "nxt", "prev", "label_source")


@query("fallback_learned")
def q_fallback_learned(spark, sf):
    """I4 + I5 + I6 + D1: a classifier fitted on the coded events' texts (distinct
    texts, weighted by their events) labels the uncoded ones; transitions of the
    merged rows by the source of their label."""
    ctx = context(spark, sf)

    def build():
        texts = ctx.coded_events.groupBy("combined_text", "state").agg(F.count(F.lit(1)).cast("double").alias("weight"))
        return classify.train_classifier(texts, "combined_text", "state", weight="weight", num_features=1 << 12, max_iter=15)
    model = _model(ctx, "event_classifier", build)
    texts = ctx.events.filter("needs_nlp").select("combined_text").distinct()
    scored = classify.score(model, texts, "predicted", "confidence").join(
        ctx.events.filter("needs_nlp").select(*EVENT_KEY, "combined_text"), "combined_text")
    t = transitions.build_transitions(ctx.merged_events(scored.select(*EVENT_KEY, "predicted", "confidence"), classify.CONFIDENCE))
    return t.groupBy("label_source").agg(F.count(F.lit(1)).alias("transitions"), F.countDistinct("person_id").alias("persons"))


@query("sector_distribution", sql(f"""select state, count(*) as n,
      {R('count(*) * 100.0e0 / sum(count(*)) over ()', 2)} as pct from ce group by state""", "ce"))
def q_sector_distribution(spark, sf):
    return reports.distribution(context(spark, sf).coded_events, "state")


@query("dataset_stats", sql(f"""select count(*) as total_rows, count(distinct person_id) as unique_users,
      count(distinct occupation_group) as unique_groups, min(yr) as min_year, max(yr) as max_year,
      count(distinct matched_label) as unique_titles,
      {R('avg(case when needs_nlp then 0.0e0 else 100.0e0 end)', 4)} as direct_code_pct,
      {R('avg(case when needs_nlp then 100.0e0 else 0.0e0 end)', 4)} as nlp_fallback_pct from ev""", "ev"))
def q_dataset_stats(spark, sf):
    e = context(spark, sf).events
    # each count of distinct values by itself: together they would expand every row
    unique = lambda c: e.groupBy(c).agg(F.count(c).alias("_n")).agg(F.count_if(F.col("_n") > 0)).scalar()
    return e.agg(F.count(F.lit(1)).alias("total_rows"), F.min("yr").alias("min_year"), F.max("yr").alias("max_year"),
                 round_to(F.avg(F.when(F.col("needs_nlp"), 0.0).otherwise(100.0)), 4).alias("direct_code_pct"),
                 round_to(F.avg(F.when(F.col("needs_nlp"), 100.0).otherwise(0.0)), 4).alias("nlp_fallback_pct")) \
            .select("total_rows", unique("person_id").alias("unique_users"), unique("occupation_group").alias("unique_groups"), "min_year", "max_year",
                    unique("matched_label").alias("unique_titles"), "direct_code_pct", "nlp_fallback_pct")


@query("sequence_stats", sql("""select (select count(*) from tr) as transitions,
      count_if(n >= 2) as entities_2plus, quantile_cont(n, 0.5) as median_length,
      (select count(*) from (select distinct cur, nxt from tr)) as distinct_pairs
    from (select person_id, count(*) as n from ce group by person_id)""", "ce", "tr"))
def q_sequence_stats(spark, sf):
    ctx = context(spark, sf)
    return transitions.sequence_stats(ctx.coded_events, ctx.transitions)


@query("clean_report", sql("""select sum(n_) as rows_in,
      coalesce(sum(case when not ok_ then n_ end), 0) as dropped_label,
      coalesce(sum(case when ok_ then n_ - 1 end), 0) as dropped_duplicate,
      count_if(ok_ and not coalesce(yr_ between 1950 and 2024, false)) as dropped_year,
      count_if(ok_ and coalesce(yr_ between 1950 and 2024, false)) as rows_kept
    from (select person_id, matched_label, start_date, ok_, count(*) as n_,
            try_cast(nullif(regexp_extract(cast(start_date as varchar), '([0-9]{4})', 1), '') as integer) as yr_
          from (select *, coalesce(matched_label is not null and not regexp_matches(matched_label, '^\\s*$')
                  and lower(matched_label) <> 'unknown', false) as ok_ from fx)
          group by person_id, matched_label, start_date, ok_)""", "fx"))
def q_clean_report(spark, sf):
    return clean.clean_report(context(spark, sf).raw)


# --------------------------------------------------------------- phase 2: transitions

TR_COLS = ["person_id", "pos", "yr", "matched_label", "cur", "nxt", "prev", "univ_flag"]


@query("transitions", sql(f"select {', '.join(TR_COLS)} from tr", "tr"))
def q_transitions(spark, sf):
    return context(spark, sf).transitions.select(*TR_COLS)


@query("temporal_features", sql("""select person_id, pos,
      cast(least(greatest(yr - fy, 0), 50) as double) as rr_years_since_first,
      cast(least(greatest(ly - fy, 0), 50) as double) as rr_career_span,
      cast(pos as double) as rr_n_prior_trans,
      least(greatest(pos / greatest(cast(least(greatest(ly - fy, 0), 50) as double), 1.0e0), 0), 10) as rr_transition_velocity
    from (select *, min(yr) over (partition by person_id) as fy, max(yr) over (partition by person_id) as ly from tr)""", "tr"))
def q_temporal_features(spark, sf):
    t = transitions.temporal_features(context(spark, sf).transitions)
    return t.select("person_id", "pos", "rr_years_since_first", "rr_career_span",
                    "rr_n_prior_trans", "rr_transition_velocity")


@query("pair_counts", sql("select cur, nxt, count(*) as n from tr group by cur, nxt", "tr"))
def q_pair_counts(spark, sf):
    return context(spark, sf).transitions.groupBy("cur", "nxt").agg(F.count(F.lit(1)).alias("n"))


@query("weighted_pair_counts", sql(f"""select cur, nxt, {R('sum(exp(0.12e0 * (yr - (select max(yr) from tr))))')} as w
    from tr group by cur, nxt""", "tr"))
def q_weighted_pair_counts(spark, sf):
    t = context(spark, sf).transitions
    return (t.withColumn("_w", markov.recency_weight(t))
             .groupBy("cur", "nxt").agg(r6(F.sum("_w")).alias("w")))


@query("triple_counts", sql("""select prev, cur, nxt, count(*) as n,
      sum(count(*)) over (partition by prev, cur) as n_context
    from tr where prev is not null group by prev, cur, nxt""", "tr"))
def q_triple_counts(spark, sf):
    t = context(spark, sf).transitions.filter(F.col("prev").isNotNull())
    c = t.groupBy("prev", "cur", "nxt").agg(F.count(F.lit(1)).alias("n"))
    ctxs = c.groupBy("prev", "cur").agg(F.sum("n").alias("n_context"))  # derived from the first
    return c.join(ctxs, ["prev", "cur"])


@query("dominant_sector", sql("select person_id, dominant_sector from dom", "dom"))
def q_dominant_sector(spark, sf):
    return drift.dominant_state(context(spark, sf).coded_events)


@query("univ_flag", sql("select person_id, univ_flag from uf", "uf"))
def q_univ_flag(spark, sf):
    return context(spark, sf).univ_flags


@query("self_rates", sql(f"select state, idx, {R('self_rate')} as self_rate, {R('mult')} as mult from sr", "sr"))
def q_self_rates(spark, sf):
    r = context(spark, sf).rates
    return r.select("state", "idx", r6("self_rate").alias("self_rate"), r6("mult").alias("mult"))


@query("sector_space", sql("select state, idx from sp", "sp"))
def q_sector_space(spark, sf):
    return context(spark, sf).space


@query("valid_transitions", sql("""select cur, count(*) as n from tr
    where cur in (select state from sp) and nxt in (select state from sp)
      and (prev is null or prev in (select state from sp)) group by cur""", "tr", "sp"))
def q_valid_transitions(spark, sf):
    ctx = context(spark, sf)
    sp = ctx.space.select("state")
    t = (ctx.transitions.join(sp.withColumnRenamed("state", "cur"), "cur", "left_semi")
         .join(sp.withColumnRenamed("state", "nxt"), "nxt", "left_semi"))
    known_prev = t.join(sp.withColumnRenamed("state", "prev"), "prev", "left_semi")
    t = t.filter(F.col("prev").isNull()).unionByName(known_prev)
    return t.groupBy("cur").agg(F.count(F.lit(1)).alias("n"))


@query("sequence_length_hist", sql("""select least(n, 15) as bucket, count(*) as n from
    (select person_id, count(*) as n from ce group by person_id) group by least(n, 15)""", "ce"))
def q_sequence_length_hist(spark, sf):
    lengths = context(spark, sf).coded_events.groupBy("person_id").agg(F.count(F.lit(1)).alias("len"))
    return reports.clipped_histogram(lengths, "len", 15)


@query("dense_matrix", sql("""select g.cur, g.nxt, coalesce(c.n, 0) as n from grid g
    left join (select cur, nxt, count(*) as n from tr group by cur, nxt) c on c.cur = g.cur and c.nxt = g.nxt""",
                           "grid", "tr"))
def q_dense_matrix(spark, sf):
    ctx = context(spark, sf)
    counts = markov.indexed_counts(ctx.transitions, ctx.space)
    last = markov.n_states(ctx.space) - 1
    grid = ctx.space.select(F.col("idx").alias("cur_idx"), F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("nxt_idx"))
    cells = grid.join(counts, ["cur_idx", "nxt_idx"], "left")
    sp = ctx.space
    return (cells.join(sp.select(F.col("idx").alias("cur_idx"), F.col("state").alias("cur")), "cur_idx")
                 .join(sp.select(F.col("idx").alias("nxt_idx"), F.col("state").alias("nxt")), "nxt_idx")
                 .select("cur", "nxt", F.coalesce(F.col("v"), F.lit(0.0)).cast("bigint").alias("n")))


# --------------------------------------------------------------- phase 3: flagship


@query("transition_matrix", sql(f"select cur, nxt, {R('p', 9)} as p from gm", "gm"))
def q_transition_matrix(spark, sf):
    ctx = context(spark, sf)
    lf = markov.long_form(ctx.global_matrix, ctx.space)
    return lf.select("cur", "nxt", round_to("p", 9).alias("p"))


@query("transition_logprob", sql(f"select person_id, pos, {R('log_prob')} as log_prob, is_self from lp", "lp"))
def q_transition_logprob(spark, sf):
    return context(spark, sf).logprob.select("person_id", "pos", r6("log_prob").alias("log_prob"), "is_self")


RISK_SQL = (f"""select person_id, {R('drift_score')} as drift_score, total_transitions,
      {R('self_loop_rate')} as self_loop_rate, seq_length, dominant_sector from risk""")


@query("drift_scores", sql(RISK_SQL, "risk"))
def q_drift_scores(spark, sf):
    r = context(spark, sf).risk
    return r.select("person_id", r6("drift_score").alias("drift_score"), "total_transitions",
                    r6("self_loop_rate").alias("self_loop_rate"), "seq_length", "dominant_sector")


@query("drift_quantiles", sql(f"""select {R('quantile_cont(drift_score, 0.2)')} as q20,
      {R('quantile_cont(drift_score, 0.5)')} as q50, {R('quantile_cont(drift_score, 0.75)')} as q75,
      {R('quantile_cont(drift_score, 0.8)')} as q80, {R('median(drift_score)')} as median_drift from risk""", "risk"))
def q_drift_quantiles(spark, sf):
    q = reports.exact_quantiles(context(spark, sf).risk, "drift_score", [0.2, 0.5, 0.75, 0.8],
                                ["q20", "q50", "q75", "q80"])
    return q.select(*[r6(c).alias(c) for c in ["q20", "q50", "q75", "q80"]],
                    r6("q50").alias("median_drift"))


@query("drift_hist", sql("""select cast(case when hi = lo then 0 else least(floor((drift_score - lo) / (hi - lo) * 50), 49) end as integer) as bin,
      count(*) as n from risk, (select min(drift_score) as lo, max(drift_score) as hi from risk) group by 1""", "risk"))
def q_drift_hist(spark, sf):
    return drift.drift_histogram(context(spark, sf).risk, 50)


@query("top_drift_risk", sql(f"""select person_id, {R('drift_score')} as drift_score, total_transitions from risk
    order by drift_score desc, person_id limit 10""", "risk"))
def q_top_drift_risk(spark, sf):
    r = context(spark, sf).risk
    return reports.top_n(r, 10, [F.col("drift_score").desc(), F.col("person_id")]) \
        .select("person_id", r6("drift_score").alias("drift_score"), "total_transitions")


# --------------------------------------------------------------- phase 5: rules, reports


RULES_SQL = """select antecedent, consequent,
      floor(pair_count * 1.0e0 / tot * 1e4 + 0.5) / 1e4 as support,
      floor(pair_count * 1.0e0 / ant_count * 1e4 + 0.5) / 1e4 as confidence,
      floor((floor(pair_count * 1.0e0 / ant_count * 1e4 + 0.5) / 1e4) / (con_count * 1.0e0 / tot) * 1e4 + 0.5) / 1e4 as lift,
      (pair_count * 1.0e0 / ant_count) / (con_count * 1.0e0 / tot) as lift_exact, pair_count
    from (select cur as antecedent, nxt as consequent, count(*) as pair_count from tr group by cur, nxt) pc
    join (select cur, count(*) as ant_count from tr group by cur) a on a.cur = pc.antecedent
    join (select nxt, count(*) as con_count from tr group by nxt) c on c.nxt = pc.consequent,
    (select count(*) as tot from tr) t"""


@query("association_rules", sql(f"select antecedent, consequent, support, confidence, lift, {R('lift_exact')} as lift_exact, pair_count from ({RULES_SQL})", "tr"))
def q_association_rules(spark, sf):
    r = rules.association_rules(context(spark, sf).transitions)
    return r.withColumn("lift_exact", r6("lift_exact"))


@query("top_rules", sql(f"""select antecedent, consequent, support, confidence, lift, pair_count from ({RULES_SQL})
    where antecedent <> consequent order by lift desc, antecedent, consequent limit 20""", "tr"))
def q_top_rules(spark, sf):
    r = rules.top_rules(rules.association_rules(context(spark, sf).transitions), 20)
    return r.select("antecedent", "consequent", "support", "confidence", "lift", "pair_count")


@query("top_transitions", sql("""select cur, nxt, count(*) as n,
      substring(cur, 1, 25) || ' -> ' || substring(nxt, 1, 25) as pair_label
    from tr where cur <> nxt group by cur, nxt order by n desc, cur, nxt limit 20""", "tr"))
def q_top_transitions(spark, sf):
    c = context(spark, sf).transitions.filter(F.col("cur") != F.col("nxt")) \
        .groupBy("cur", "nxt").agg(F.count(F.lit(1)).alias("n"))
    top = reports.top_n(c, 20, [F.col("n").desc(), F.col("cur"), F.col("nxt")])
    return top.withColumn("pair_label", labels.pair_label("cur", "nxt"))


@query("topn_per_group", sql("""select cur, nxt, n, rank from (
      select cur, nxt, n, cast(row_number() over (partition by cur order by n desc, nxt) as integer) as rank
      from (select cur, nxt, count(*) as n from tr group by cur, nxt)) where rank <= 3""", "tr"))
def q_topn_per_group(spark, sf):
    c = context(spark, sf).transitions.groupBy("cur", "nxt").agg(F.count(F.lit(1)).alias("n"))
    return reports.top_n_per_group(c, ["cur"], "n", ["nxt"], 3)


@query("transition_heatmap", sql(f"select cur, nxt, count(*) as n, {R('ln(1 + count(*))')} as log_n from tr group by cur, nxt", "tr"))
def q_transition_heatmap(spark, sf):
    h = reports.heatmap_cells(context(spark, sf).transitions)
    return h.withColumn("log_n", r6("log_n"))


# --------------------------------------------------------------- phase 4: split, components

from trailmark.operators import ensemble  # noqa: E402


def _long(ctx, df, keys=()):
    return markov.long_form(df, ctx.model_space, keys)


@query("stratified_split", sql("select person_id, dominant, split from spl", "spl"))
def q_stratified_split(spark, sf):
    return context(spark, sf).split


@query("split_counts", sql("""select split, count(distinct person_id) as users, count(*) as transitions
    from trs group by split""", "trs"))
def q_split_counts(spark, sf):
    # C4: rows were joined to their entity's split once, when the stage was written
    return context(spark, sf).split_transitions.groupBy("split").agg(F.countDistinct("person_id").alias("users"),
                                  F.count(F.lit(1)).alias("transitions"))


@query("capped_sample", sql("""select person_id, pos, cur, split from (
      select *, row_number() over (partition by cur order by md5(cast(person_id as varchar) || '|' || cast(pos as varchar) || '|42'),
                                   person_id, pos) - 1 as rk from trs) where rk < 100""", "trs"))
def q_capped_sample(spark, sf):
    v = context(spark, sf).split_transitions
    return ensemble.capped_sample(v, "cur", 100, 42, ["person_id", "pos"]).select("person_id", "pos", "cur", "split")


@query("recency_matrix", sql(f"select cur, nxt, {R('p', 9)} as p from rect", "rect"))
def q_recency_matrix(spark, sf):
    ctx = context(spark, sf)
    return _long(ctx, ctx.components.rec).select("cur", "nxt", round_to("p", 9).alias("p"))


@query("year_windows", sql("select win, win_label, start_year, end_year from wins", "wins"))
def q_year_windows(spark, sf):
    return context(spark, sf).components.windows


@query("year_window_join", sql("""select t.person_id, t.pos, t.split, t.yr, coalesce(w.win_label, 'global') as win_key
    from trs t left join wins w on t.yr between w.start_year and w.end_year""", "trs", "wins"))
def q_year_window_join(spark, sf):
    ctx = context(spark, sf)
    return markov.assign_window(ctx.split_transitions, ctx.components.windows).select("person_id", "pos", "split", "yr", "win_key")


@query("window_matrices", sql(f"""select w.win_label, m.cur, m.nxt, {R('m.p', 9)} as p
    from wmt m join wins w on w.win = m.win""", "wmt", "wins"))
def q_window_matrices(spark, sf):
    ctx = context(spark, sf)
    c = ctx.components
    lf = _long(ctx, c.wm, ["win"]).join(c.windows.select("win", "win_label"), "win")
    return lf.select("win_label", "cur", "nxt", round_to("p", 9).alias("p"))


@query("market_drift", sql(f"""select w.win_label, {R('sqrt(sum((a.p - b.p) * (a.p - b.p)))')} as drift
    from wmt a join wmt b on a.win = b.win + 1 and a.cur = b.cur and a.nxt = b.nxt
    join wins w on w.win = a.win group by w.win_label""", "wmt", "wins"))
def q_market_drift(spark, sf):
    m = context(spark, sf).components.market
    return m.select("win_label", r6("drift").alias("drift"))


@query("second_order", sql(f"select prev, cur, nxt, n_context, {R('p', 9)} as p from so2", "so2"))
def q_second_order(spark, sf):
    ctx = context(spark, sf)
    so = ctx.components.so
    lf = _long(ctx, so, ["prev_idx", "n_context"]).join(
        ctx.model_space.select(F.col("idx").alias("prev_idx"), F.col("state").alias("prev")), "prev_idx")
    return lf.select("prev", "cur", "nxt", "n_context", round_to("p", 9).alias("p"))


@query("history_prior", sql(f"select person_id, state, {R('p', 9)} as p, {R('p_default', 9)} as p_default from pri", "pri"))
def q_history_prior(spark, sf):
    ctx = context(spark, sf)
    pr = ctx.components.prior.join(ctx.model_space.select(F.col("idx").alias("state_idx"), "state"), "state_idx")
    return pr.select("person_id", "state", round_to("p", 9).alias("p"), round_to("p_default", 9).alias("p_default"))


@query("attribute_boost", sql(f"select flag_value, state, {R('boost', 9)} as boost from bst", "bst"))
def q_attribute_boost(spark, sf):
    ctx = context(spark, sf)
    b = ctx.components.boost.select("flag_value", F.posexplode("p").alias("idx", "boost"))
    return b.join(ctx.model_space, "idx").select("flag_value", "state", round_to("boost", 9).alias("boost"))


@query("archetype_rules", sql(f"""select cluster, n_users, {R('mean_drift')} as mean_drift, {R('mean_len')} as mean_len,
      {R('mean_loop')} as mean_loop, archetype from csum""", "csum"))
def q_archetype_rules(spark, sf):
    s = context(spark, sf).components.cluster_summary
    return s.select("cluster", "n_users", r6("mean_drift").alias("mean_drift"), r6("mean_len").alias("mean_len"),
                    r6("mean_loop").alias("mean_loop"), "archetype")


@query("segment_matrices", sql(f"select archetype, cur, nxt, {R('p', 9)} as p from segm", "segm"))
def q_segment_matrices(spark, sf):
    ctx = context(spark, sf)
    return _long(ctx, ctx.components.seg, ["archetype"]).select("archetype", "cur", "nxt", round_to("p", 9).alias("p"))


@query("annotate_split", sql("select person_id, pos, split, archetype, univ_flag, win_key from anna", "anna"))
def q_annotate_split(spark, sf):
    ctx = context(spark, sf)
    a = ctx.annotated("train").unionByName(ctx.annotated("val")).unionByName(ctx.annotated("test"))
    return a.select("person_id", "pos", "split", "archetype", "univ_flag", "win_key")


@query("backoff_lookup", sql(f"""select a.person_id, a.pos, a.split, {R('coalesce(s.p, g.p)', 9)} as p,
      case when s.p is null then 'global' else 'second_order' end as source
    from trs a join gmt g on g.cur = a.cur and g.nxt = a.nxt
    left join so2 s on s.prev = a.prev and s.cur = a.cur and s.nxt = a.nxt""", "trs", "gmt", "so2"))
def q_backoff_lookup(spark, sf):
    """C8 cell by cell: a row joins the one cell of each matrix that it needs."""
    ctx = context(spark, sf)
    c = ctx.components
    g = _long(ctx, c.glob).withColumnRenamed("p", "_g")
    s = _long(ctx, c.so, ["prev_idx"]).join(ctx.model_space.select(F.col("idx").alias("prev_idx"), F.col("state").alias("prev")), "prev_idx") \
        .select("prev", "cur", "nxt", F.col("p").alias("_s"))
    j = ctx.split_transitions.join(g, ["cur", "nxt"]).join(s, ["prev", "cur", "nxt"], "left")
    return j.select("person_id", "pos", "split", round_to(F.coalesce("_s", "_g"), 9).alias("p"),
                    F.when(F.col("_s").isNull(), F.lit("global")).otherwise(F.lit("second_order")).alias("source"))


# --------------------------------------------------------------- phase 6: ensemble

_GRID_SQL = "(values " + ", ".join(f"({c}, {wh!r}e0, {ws!r}e0, {wa!r}e0, {wr!r}e0)" for c, wh, ws, wa, wr in
                                   ensemble.weight_grid()) + ") gw(combo, wh, ws, wa, wr)"

KEYS = "cur_idx, win, archetype, univ_flag, prev_idx, prior_entity"
JOIN_KEYS = " and ".join(f"{{a}}.{k} is not distinct from {{b}}.{k}" for k in KEYS.split(", "))

TUNE_BODY = f"""select cur_idx, w_hist, w_so, w_arch, tuned, hits, n_rows from (
    select sr.idx as cur_idx,
      coalesce(b.wh, case when sr.self_rate > 0.25 then 0.30e0 when sr.self_rate < 0.10 then 0.20e0 else 0.20e0 end) as w_hist,
      coalesce(b.ws, case when sr.self_rate > 0.25 then 0.10e0 when sr.self_rate < 0.10 then 0.30e0 else 0.20e0 end) as w_so,
      coalesce(b.wa, 0.10e0) as w_arch, b.wh is not null as tuned,
      cast(coalesce(b.hits, 0) as bigint) as hits, cast(coalesce(b.n_rows, 0) as bigint) as n_rows
    from sr left join (
      select cur_idx, wh, ws, wa, hits, n_rows from (
        select h.*, row_number() over (partition by cur_idx order by hits desc, combo) as rk from (
          select t.cur_idx, t.combo, t.wh, t.ws, t.wa, sum(case when t.top = v.nxt_idx then v.c else 0 end) as hits
          from (select {KEYS}, combo, wh, ws, wa, j as top from (
                  select *, row_number() over (partition by {KEYS}, combo order by {R('sc', 12)} desc, j) as r2
                  from (select c.*, gw.*, gw.wr * ((0.6e0 * c.r + 0.4e0 * c.d) * c.b) + gw.wa * (c.a * c.b)
                                 + gw.ws * (c.s * c.b) + gw.wh * (c.h * c.b) as sc
                        from cells c cross join {_GRID_SQL} where c.split = 'val'))
                where r2 = 1) t
          join (select {KEYS}, nxt_idx, count(*) as c from annp where split = 'val' group by all) v
            on {JOIN_KEYS.format(a='v', b='t')}
          group by t.cur_idx, t.combo, t.wh, t.ws, t.wa) h) hb
        join (select cur_idx, count(*) as n_rows from annp where split = 'val' group by cur_idx having count(*) >= 15) n
          using (cur_idx)
      where rk = 1) b on b.cur_idx = sr.idx)"""

TUNE_SQL = sql(TUNE_BODY, "cells", "sr", "annp")

# test-context ensemble vectors under the tuned weights
SCORED_CTES = f"""tw as ({TUNE_BODY}),
    scored as (select c.*, raw / sum(raw) over (partition by {KEYS}) as p
      from (select c.*, (greatest(0.05e0, 1.0e0 - w.w_hist - w.w_so - w.w_arch) * (0.6e0 * c.r + 0.4e0 * c.d)
                  + w.w_arch * c.a + w.w_so * c.s + w.w_hist * c.h) * c.b as raw
            from cells c join tw w on w.cur_idx = c.cur_idx where c.split = 'test') c),
    ranked as (select *, row_number() over (partition by {KEYS} order by {R('p', 12)} desc, j) as rk from scored)"""


@query("tune_weights", TUNE_SQL)
def q_tune_weights(spark, sf):
    return context(spark, sf).weights


@query("ensemble_topk", sql_with(SCORED_CTES, """select cur_idx, win, univ_flag, prev_idx, n_rows,
      string_agg(cast(j as varchar), ',' order by rk) as top5
    from ranked where rk <= 5 group by cur_idx, win, archetype, univ_flag, prev_idx, prior_entity, n_rows""",
                                  "cells", "sr", "annp"))
def q_ensemble_topk(spark, sf):
    ctx = context(spark, sf)
    sc = ensemble.scored_contexts(ctx.annotated("test"), ctx.components, ctx.weights, 5)
    return sc.select("cur_idx", "win", "univ_flag", "prev_idx", F.col("n_rows").cast("bigint").alias("n_rows"),
                     F.concat_ws(",", F.transform("topk", lambda i: i.cast("string"))).alias("top5"))


@query("ensemble_eval", sql_with(SCORED_CTES, f"""select count(*) as n_rows,
      {R('avg(case when a.cur = a.nxt then 1.0e0 else 0.0e0 end)')} as persistence_top1,
      {R('avg(case when r.rk <= 1 then 1.0e0 else 0.0e0 end)')} as top_1,
      {R('avg(case when r.rk <= 3 then 1.0e0 else 0.0e0 end)')} as top_3,
      {R('avg(case when r.rk <= 5 then 1.0e0 else 0.0e0 end)')} as top_5
    from annp a join ranked r on {JOIN_KEYS.format(a='a', b='r')} and r.j = a.nxt_idx
    where a.split = 'test'""", "cells", "sr", "annp"))
def q_ensemble_eval(spark, sf):
    ctx = context(spark, sf)
    e = ensemble.evaluate(ctx.annotated("test"), ctx.components, ctx.weights)
    return e.select("n_rows", *[r6(c).alias(c) for c in ["persistence_top1", "top_1", "top_3", "top_5"]])


# --------------------------------------------------------------- phase 10: rule labelling

from trailmark.operators import rulesets  # noqa: E402


def _case_sql(text: str, rules, default: str | None = rulesets.DEFAULT_LABEL) -> str:
    def cond(p):
        ps = p if isinstance(p, (list, tuple)) else [p]
        return " and ".join("regexp_matches({}, '{}')".format(text, q.replace("'", "''")) for q in ps)
    body = " ".join(f"when {cond(p)} then '{lbl}'" for lbl, p in rules)
    return f"case {body} else {'null' if default is None else repr(default)} end"


DOC_TEXT = "lower(text)"


@query("regex_first_match", sql(f"""select doc_id, {_case_sql(DOC_TEXT, rulesets.CONTENT_RULES)} as label
    from documents"""))
def q_regex_first_match(spark, sf):
    d = tables.table(spark, sf, "documents")
    return d.select("doc_id", rulesets.first_match(F.lower("text"), rulesets.CONTENT_RULES).alias("label"))


@query("regex_compound_rules", sql(f"""select label, count(*) as n from (
    select {_case_sql(DOC_TEXT, rulesets.BROAD_RULES)} as label from documents) group by label"""))
def q_regex_compound(spark, sf):
    d = tables.table(spark, sf, "documents")
    return d.select(rulesets.first_match(F.lower("text"), rulesets.BROAD_RULES).alias("label")) \
            .groupBy("label").agg(F.count(F.lit(1)).alias("n"))


_TITLE = "lower(split_part(text, chr(10), 1))"


@query("regex_cascade", sql(f"""select doc_id, label, pass from (
    select doc_id, coalesce(t1, t2, t3, t4) as label,
      case when t1 is not null then 1 when t2 is not null then 2 when t3 is not null then 3
           when t4 is not null then 4 end as pass
    from (select doc_id, {_case_sql(_TITLE, rulesets.CONTENT_RULES, None)} as t1,
                 {_case_sql(DOC_TEXT, rulesets.CONTENT_RULES, None)} as t2,
                 {_case_sql(_TITLE, rulesets.BROAD_RULES, None)} as t3,
                 {_case_sql(DOC_TEXT, rulesets.BROAD_RULES, None)} as t4 from documents))
    where label is not null"""))
def q_regex_cascade(spark, sf):
    d = tables.table(spark, sf, "documents")
    title = F.lower(F.substring_index("text", "\n", 1))
    out = rulesets.cascade(d, title, F.lower("text"), rulesets.CONTENT_RULES, rulesets.BROAD_RULES)
    return out.select("doc_id", "label", "pass")


_GUESS = _case_sql(DOC_TEXT, rulesets.LANG_RULES, None)


@query("label_agreement", sql(f"""select count(*) as n_rows,
      {R('avg(case when guess is not distinct from lang then 1.0e0 else 0.0e0 end)')} as agreement
    from (select lang, {_GUESS} as guess from documents)"""))
def q_label_agreement(spark, sf):
    d = tables.table(spark, sf, "documents").withColumn(
        "guess", rulesets.first_match(F.lower("text"), rulesets.LANG_RULES, None))
    a = rulesets.agreement(d, "guess", "lang")
    return a.select("n_rows", r6("agreement").alias("agreement"))


@query("label_disagreements", sql(f"""select lang, guess, count(*) as n from (
    select lang, {_GUESS} as guess from documents) where not (guess is not distinct from lang)
    group by lang, guess order by n desc, lang, guess limit 10"""))
def q_label_disagreements(spark, sf):
    d = tables.table(spark, sf, "documents").withColumn(
        "guess", rulesets.first_match(F.lower("text"), rulesets.LANG_RULES, None))
    return rulesets.top_disagreements(d, "lang", "guess", 10)


# --------------------------------------------------------------- phase 7: rerank data path

from trailmark.operators import rerank  # noqa: E402

_FEATURE_SQL = {
    "f_cos": "coalesce(sc.cosine, 0.0e0)",
    "f_log_global": "ln(c.g + 1e-9)",
    "f_log_recency": "ln(c.r + 1e-9)",
    "f_log_second": "ln(c.s + 1e-9)",
    "f_hist": "c.h",
    "f_ysf": "least(coalesce(t.ysf, 0.0e0), 40.0e0) / 40.0e0",
    "f_span": "least(coalesce(t.span, 0.0e0), 40.0e0) / 40.0e0",
    "f_npt": "ln(1.0e0 + coalesce(t.npt, 0.0e0))",
    "f_vel": "least(coalesce(least(greatest(t.npt / greatest(t.span, 1.0e0), 0.0e0), 10.0e0), 0.0e0), 10.0e0) / 10.0e0",
    "f_same_l1": "cast(substring(cs.state, 1, 1) = substring(ks.state, 1, 1) as double)",
    "f_same_l2": "cast(substring(cs.state, 1, 2) = substring(ks.state, 1, 2) as double)",
    "f_direction": """coalesce((try_cast(substring(ks.state, 1, 1) as integer)
                       - try_cast(substring(cs.state, 1, 1) as integer)) / 9.0e0, 0.0e0)""",
    "f_self": "cast(c.cur_idx = c.cand_idx as double)",
    "f_log_incoming": "ln(i.pin + 1e-9)",
    "f_ensemble": "c.p",
}
assert list(_FEATURE_SQL) == rerank.FEATURES


_MD5_TOKEN = "cast(cast('0x' || substr(md5(token), 1, 7) as bigint) % 384 as integer)"
CTES["stx"] = (("sp",), f"""select idx, lower(state || ' [SEP] ' || state || ' ' || {_MAJOR_SQL}) as low from sp""")
CTES["sbk"] = (("stx",), f"""select idx, {_MD5_TOKEN} as bucket,
      sum(case when substr(md5(token), 8, 1) < '8' then 1 else -1 end) as w
    from (select idx, unnest(list_concat(
            list_filter(regexp_split_to_array(low, '\\s+'), lambda w: w <> ''),
            list_transform(range(1, length(low) - 1), lambda i: substr(low, i, 3)))) as token from stx)
    group by idx, 2""")
CTES["scos"] = (("sbk",), """select a.idx as ci, b.idx as ki, sum(a.w * b.w) / (any_value(a.nrm) * any_value(b.nrm)) as cosine
    from (select *, sqrt(sum(w * w * 1.0e0) over (partition by idx)) as nrm from sbk) a
    join (select *, sqrt(sum(w * w * 1.0e0) over (partition by idx)) as nrm from sbk) b on a.bucket = b.bucket
    group by a.idx, b.idx""")


def _score_sql(zero=()) -> str:
    terms = [f"{float(w)!r}e0 * {f}" for i, (w, f) in
             enumerate(zip(rerank.FIXED_WEIGHTS, rerank.FEATURES)) if i not in zero and w != 0.0]
    return R(" + ".join(terms), rerank.SCORE_DIGITS)


RR_CTES = SCORED_CTES + f""",
    tmp as (select person_id, pos, cast(least(greatest(yr - fy, 0), 50) as double) as ysf,
              cast(least(greatest(ly - fy, 0), 50) as double) as span, cast(pos as double) as npt
            from (select *, min(yr) over (partition by person_id) as fy,
                         max(yr) over (partition by person_id) as ly from tr)),
    inc as (select nxt_idx as cand_idx, avg(p) as pin from gmt group by nxt_idx),
    cand as (select a.person_id, a.pos, a.cur_idx, a.nxt_idx, r.j as cand_idx, cast(r.rk - 1 as integer) as rank,
               r.g, r.r, r.s, r.h, r.p
             from annp a join ranked r on {JOIN_KEYS.format(a='a', b='r')}
             where a.split = 'test' and r.rk <= {rerank.TOP_K}),
    feats as (select c.person_id, c.pos, c.cur_idx, c.nxt_idx,
        coalesce(max(case when c.cand_idx = c.nxt_idx then c.rank end) over (partition by c.person_id, c.pos), -1)
          as true_pos, c.rank, c.cand_idx,
        {", ".join(f"{v} as {k}" for k, v in _FEATURE_SQL.items())}
      from cand c join sp cs on cs.idx = c.cur_idx join sp ks on ks.idx = c.cand_idx
      join inc i on i.cand_idx = c.cand_idx
      left join scos sc on sc.ci = c.cur_idx and sc.ki = c.cand_idx
      left join tmp t on t.person_id = c.person_id and t.pos = c.pos),
    rr as (select *, cast(row_number() over (partition by person_id, pos order by score desc, rank) - 1 as integer)
             as new_rank
           from (select *, {_score_sql()} as score from feats))"""

_RR_NEEDS = ("cells", "sr", "annp", "tr", "gmt", "sp", "scos")


def _rr_sql(final: str) -> str:
    return sql_with(RR_CTES, final, *_RR_NEEDS)


def _test_feats(spark, sf):
    return context(spark, sf).candidate_features("test")


@query("pairwise_cosine", sql("""select p.cur, p.nxt, """ + R("coalesce(s.cosine, 0.0e0)") + """ as cosine
    from (select distinct cur, nxt from tr) p join sp c on c.state = p.cur join sp n on n.state = p.nxt
    left join scos s on s.ci = c.idx and s.ki = n.idx""", "tr", "sp", "scos"))
def q_pairwise_cosine(spark, sf):
    """J2 on observed state pairs: cosine of the two state embeddings."""
    ctx = context(spark, sf)
    sp = ctx.space.select("state", "idx")
    pairs = ctx.transitions.select("cur", "nxt").distinct()
    e = ctx.state_embeddings
    j = (pairs.join(sp.select(F.col("state").alias("cur"), F.col("idx").alias("ci")), "cur")
              .join(sp.select(F.col("state").alias("nxt"), F.col("idx").alias("ni")), "nxt")
              .join(e.select(F.col("state_idx").alias("ci"), F.col("emb").alias("_a")), "ci", "left")
              .join(e.select(F.col("state_idx").alias("ni"), F.col("emb").alias("_b")), "ni", "left"))
    return j.select("cur", "nxt", r6(F.coalesce(rerank.dot("_a", "_b"), F.lit(0.0))).alias("cosine"))


@query("candidate_lists", _rr_sql("""select person_id, pos, nxt_idx, true_pos,
      string_agg(cast(cand_idx as varchar), ',' order by rank) as cands
    from feats group by person_id, pos, nxt_idx, true_pos"""))
def q_candidate_lists(spark, sf):
    f = _test_feats(spark, sf)
    return f.groupBy("person_id", "pos", "nxt_idx", "true_pos").agg(
        F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("rank", "cand_idx"))),
                                     lambda s: s["cand_idx"].cast("string"))).alias("cands"))


_ALL_SPLITS = ("select * from anna where split in ('val', 'test')", "select * from anna")


@query("candidate_lists_forced", sql_with(SCORED_CTES.replace("c.split = 'test'", "c.split = 'train'") + f""",
    lst as (select a.person_id, a.pos, a.nxt_idx, list(r.j order by r.rk) as l from annp a join ranked r on {JOIN_KEYS.format(a='a', b='r')}
            where a.split = 'train' and r.split = 'train' and r.rk <= {rerank.TOP_K} group by a.person_id, a.pos, a.nxt_idx),
    frc as (select *, case when list_contains(l, nxt_idx) then l else list_append(l[1:{rerank.TOP_K - 1}], nxt_idx) end as c from lst)""",
    """select person_id, pos, nxt_idx, list_position(c, nxt_idx) - 1 as true_pos, array_to_string(c, ',') as cands from frc""",
    *("cells", "sr", "annp")).replace(*_ALL_SPLITS))
def q_candidate_lists_forced(spark, sf):
    """J8 as the learned ranking is trained: all training rows, the true next forced into the list."""
    ctx = context(spark, sf)
    rows = ctx.annotated("train").select(*rerank.ROW, "nxt_idx", *ensemble.CONTEXT_KEYS[:-1])
    c = rerank.candidate_lists(rows, ctx.components, ctx.weights, force_true=True, values=False)
    return c.select("person_id", "pos", "nxt_idx", F.col("true_pos").cast("long").alias("true_pos"),
                    F.concat_ws(",", F.transform("cands", lambda i: i.cast("string"))).alias("cands"))


@query("candidate_features", _rr_sql(f"""select person_id, pos, cur_idx, nxt_idx, true_pos, rank, cand_idx,
      {", ".join(f"{R(k)} as {k}" for k in rerank.FEATURES)} from feats"""))
def q_candidate_features(spark, sf):
    f = _test_feats(spark, sf)
    return f.select("person_id", "pos", "cur_idx", "nxt_idx", "true_pos", "rank", "cand_idx",
                    *[r6(k).alias(k) for k in rerank.FEATURES])


@query("rerank", _rr_sql("select person_id, pos, cand_idx, rank, new_rank, score from rr"))
def q_rerank(spark, sf):
    r = rerank.rerank(_test_feats(spark, sf), rerank.linear_score())
    return r.select("person_id", "pos", "cand_idx", "rank", "new_rank", "score")


_EVAL_COLS = ["top_1", "top_3", "top_5", "candidate_recall"]


@query("rerank_eval", _rr_sql(f"""select ranking, {", ".join(f"{R(c)} as {c}" for c in _EVAL_COLS)} from (
      select 'ensemble' as ranking, count_if(rank < 1) / n as top_1, count_if(rank < 3) / n as top_3,
             count_if(rank < 5) / n as top_5, count(*) / n as candidate_recall
      from rr, (select count(*) * 1.0e0 as n from (select distinct person_id, pos from rr)) where cand_idx = nxt_idx
      group by n
      union all
      select 'rerank', count_if(new_rank < 1) / n, count_if(new_rank < 3) / n, count_if(new_rank < 5) / n, count(*) / n
      from rr, (select count(*) * 1.0e0 as n from (select distinct person_id, pos from rr)) where cand_idx = nxt_idx
      group by n)"""))
def q_rerank_eval(spark, sf):
    e = rerank.rerank_eval(rerank.rerank(context(spark, sf).feature_lists("test"), lambda col: rerank.linear_score(col=col)))
    return e.select("ranking", *[r6(c).alias(c) for c in _EVAL_COLS])


_GROUPS = list(rerank.FEATURE_GROUPS.items())
_ABL_COLS = ["top1_with_all", "top1_zeroed_out", "top1_drop"]


@query("rerank_ablation", _rr_sql(f"""select feature_group, {R('h_all / n')} as top1_with_all,
      {R('h / n')} as top1_zeroed_out, {R('(h_all - h) / n')} as top1_drop
    from (select count(*) * 1.0e0 as n, sum(t_all) as h_all,
                 {", ".join(f"sum(t{gi}) as h{gi}" for gi in range(len(_GROUPS)))}
          from (select person_id, pos,
                  max(case when r_all = 1 and cand_idx = nxt_idx then 1 else 0 end) as t_all,
                  {", ".join(f"max(case when r{gi} = 1 and cand_idx = nxt_idx then 1 else 0 end) as t{gi}"
                             for gi in range(len(_GROUPS)))}
                from (select *, row_number() over (partition by person_id, pos order by s_all desc, rank) as r_all,
                        {", ".join(f"row_number() over (partition by person_id, pos order by s{gi} desc, rank) as r{gi}"
                                   for gi in range(len(_GROUPS)))}
                      from (select *, {_score_sql()} as s_all,
                              {", ".join(f"{_score_sql(set(idx))} as s{gi}" for gi, (_, idx) in enumerate(_GROUPS))}
                            from feats))
                group by person_id, pos))
    cross join (values {", ".join(f"('{name}', {gi})" for gi, (name, _) in enumerate(_GROUPS))}) g(feature_group, gi)
    cross join lateral (select case gi {" ".join(f"when {gi} then h{gi}" for gi in range(len(_GROUPS)))} end as h)"""))
def q_rerank_ablation(spark, sf):
    a = rerank.ablation(_test_feats(spark, sf))
    return a.select("feature_group", *[r6(c).alias(c) for c in _ABL_COLS])


@query("win_margin", _rr_sql(f"""select person_id, pos, {R('win_prob')} as win_prob,
      {R('win_prob - coalesce(second_prob, 0.0e0)')} as margin
    from (select person_id, pos, max(case when new_rank = 0 then sp_ end) as win_prob,
                 max(case when new_rank = 1 then sp_ end) as second_prob
          from (select *, ex / sum(ex) over (partition by person_id, pos) as sp_
                from (select *, exp(score - max(score) over (partition by person_id, pos)) as ex from rr))
          group by person_id, pos)"""))
def q_win_margin(spark, sf):
    w = rerank.win_margin(rerank.rerank(_test_feats(spark, sf), rerank.linear_score()))
    return w.select("person_id", "pos", r6("win_prob").alias("win_prob"), r6("margin").alias("margin"))


# --------------------------------------------------------------- phase 8: classification metrics, model pieces

from trailmark.sources import stages  # noqa: E402

_GUESS_COL = f"coalesce({_GUESS}, 'none')"


def _docs_with_guess(spark, sf):
    d = tables.table(spark, sf, "documents")
    return d.withColumn("guess", F.coalesce(rulesets.first_match(F.lower("text"), rulesets.LANG_RULES, None),
                                            F.lit("none")))


@query("class_split", sql("""select doc_id, lang,
      case when rk < floor(n * 0.70) then 'train' when rk < floor(n * 0.85) then 'val' else 'test' end as split
    from (select doc_id, lang, row_number() over (partition by lang order by md5(cast(doc_id as varchar) || '|42'), doc_id) - 1 as rk,
                 count(*) over (partition by lang) as n from documents)"""))
def q_class_split(spark, sf):
    d = tables.table(spark, sf, "documents").select("doc_id", "lang")
    return classify.class_split(d, "lang", ["doc_id"], 42)


@query("class_weights", sql(f"""select lang, count(*) as n_c,
      {R('sum(count(*)) over () / (count(*) over () * count(*))')} as weight from documents group by lang"""))
def q_class_weights(spark, sf):
    w = classify.class_weights(tables.table(spark, sf, "documents"), "lang")
    return w.select("lang", "n_c", r6("weight").alias("weight"))


@query("confusion_matrix", sql(f"""select lang, guess, count(*) as n
    from (select lang, {_GUESS_COL} as guess from documents) group by lang, guess"""))
def q_confusion_matrix(spark, sf):
    return classify.confusion_matrix(_docs_with_guess(spark, sf), "lang", "guess")


@query("class_report", sql(f"""with d as (select lang, {_GUESS_COL} as guess from documents),
    cm as (select lang, guess, count(*) as n from d group by lang, guess),
    lb as (select lang as label from cm union select guess from cm),
    per as (select lb.label,
        coalesce((select sum(n) from cm where cm.lang = lb.label and cm.guess = lb.label), 0) as tp,
        coalesce((select sum(n) from cm where cm.lang = lb.label), 0) as support,
        coalesce((select sum(n) from cm where cm.guess = lb.label), 0) as n_pred from lb),
    pr as (select label, tp, support,
        case when n_pred > 0 then tp * 1.0e0 / n_pred else 0.0e0 end as precision,
        case when support > 0 then tp * 1.0e0 / support else 0.0e0 end as recall from per),
    f as (select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0.0e0 end as f1
          from pr)
    select label, {R('precision')} as precision, {R('recall')} as recall, {R('f1')} as f1, cast(support as bigint) as support
    from f
    union all
    select 'weighted avg', {R('sum(precision * support) / sum(support)')}, {R('sum(recall * support) / sum(support)')},
           {R('sum(f1 * support) / sum(support)')}, cast(sum(support) as bigint) from f
    union all
    select 'accuracy', null, null, {R('sum(tp) * 1.0e0 / sum(support)')}, cast(sum(support) as bigint) from f"""))
def q_class_report(spark, sf):
    r = classify.class_report(_docs_with_guess(spark, sf), "lang", "guess")
    return r.select("label", *[r6(c).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("dataset_fingerprint", sql("""select substring(sha256(cast(n_rows as varchar) || '|' || cast(hash_sum as varchar)), 1, 16)
      as fingerprint, n_rows, hash_sum
    from (select count(*) as n_rows,
                 cast(sum(cast(('0x' || substring(md5(coalesce(combined_text, '')), 1, 15)) as bigint)) as decimal(38, 0))
                   as hash_sum from ev)""", "ev"))
def q_dataset_fingerprint(spark, sf):
    return stages.dataset_fingerprint(context(spark, sf).events, ["combined_text"])


@query("ensemble_prob", sql_with(SCORED_CTES, f"""select cur_idx, win, archetype, univ_flag, prev_idx,
      j as state_idx, {R('p', 9)} as p from scored""", "cells", "sr", "annp"))
def q_ensemble_prob(spark, sf):
    ctx = context(spark, sf)
    sc = ensemble.scored_contexts(ctx.annotated("test"), ctx.components, ctx.weights, 5)
    x = sc.select("cur_idx", "win", "archetype", "univ_flag", "prev_idx", F.posexplode("p").alias("state_idx", "p"))
    return x.select("cur_idx", "win", "archetype", "univ_flag", "prev_idx", "state_idx", round_to("p", 9).alias("p"))


@query("segment_breakdown", sql("""select archetype, dominant_sector, n_users, rank from (
      select archetype, dominant_sector, n_users,
             cast(row_number() over (partition by archetype order by n_users desc, dominant_sector) as integer) as rank
      from (select m.archetype, d.dominant_sector, count(*) as n_users
            from smapa m join dom d on d.person_id = m.person_id group by m.archetype, d.dominant_sector))
    where rank <= 3""", "smapa", "dom"))
def q_segment_breakdown(spark, sf):
    ctx = context(spark, sf)
    dom = drift.dominant_state(ctx.coded_events)
    c = _scatter(spark, sf).select("person_id", "archetype").join(dom, "person_id").groupBy("archetype", "dominant_sector") \
        .agg(F.count(F.lit(1)).alias("n_users"))
    return reports.top_n_per_group(c, ["archetype"], "n_users", ["dominant_sector"], 3) \
        .select("archetype", "dominant_sector", "n_users", "rank")


# learned parts (MLlib): ids, signs and fitted values are not engine-portable,
# so these are rows-only checks plus the invariants in tests/.

from trailmark.operators import listwise, profiles  # noqa: E402

_MODELS: dict = {}


def _model(ctx, name, build):
    key = (ctx.spark.sparkContext.applicationId, ctx.sf_dir, ctx.fingerprint, name)
    if key not in _MODELS:
        _MODELS[key] = build()
    return _MODELS[key]


@query("drift_clusters")
def q_drift_clusters(spark, sf):
    """H3 + E13: k-means (k=5, 25 restarts) over standardised drift, length and
    self-loop rate of the drift table, then the per-cluster summary."""
    clustered = drift.cluster_drift(context(spark, sf).risk, k=5)
    return drift.cluster_summary(clustered)


@query("pca_covariance", sql(f"""select a.j as a, b.j as b, {R('sum((a.v - ma.m) * (b.v - mb.m)) / (any_value(nn.n) - 1)', 9)} as cov
    from prf a join prf b on a.i = b.i join prm ma on ma.j = a.j join prm mb on mb.j = b.j, nn group by a.j, b.j""", "prf", "prm", "nn"))
def q_pca_covariance(spark, sf):
    """H7: covariance of the transition profiles."""
    ctx = context(spark, sf)
    c = profiles.covariance(profiles.profiles(ctx.transitions, ctx.space))
    return c.select("a", "b", round_to("cov", 9).alias("cov"))


@query("pca_explained")
def q_pca_explained(spark, sf):
    ctx = context(spark, sf)
    return _model(ctx, "pca", lambda: profiles.pca(ctx.transitions, ctx.space))[0]


@query("pca_coordinates")
def q_pca_coordinates(spark, sf):
    ctx = context(spark, sf)
    return _model(ctx, "pca", lambda: profiles.pca(ctx.transitions, ctx.space))[1]


def _doc_split(spark, sf):
    d = tables.table(spark, sf, "documents").select("doc_id", "text", "lang")
    return classify.class_split(d, "lang", ["doc_id"], 42)


def _doc_model(spark, sf):
    """I3 + I4: balanced class weights, classifier fitted on the train split."""
    def build():
        s = _doc_split(spark, sf)
        w = classify.class_weights(s.filter("split = 'train'"), "lang").select("lang", "weight")
        train = s.filter("split = 'train'").join(F.broadcast(w), "lang")   # one row per class
        return classify.train_classifier(train, "text", "lang", weight="weight")
    return _model(context(spark, sf), f"doc_classifier-{stages.input_signature(spark, [os.path.join(sf, 'documents.parquet')])}", build)


def _doc_scores(spark, sf):
    return classify.score(_doc_model(spark, sf), _doc_split(spark, sf).filter("split = 'test'"))


@query("doc_embeddings")
def q_doc_embeddings(spark, sf):
    """One unit-length vector per document."""
    d = tables.table(spark, sf, "documents").select("doc_id", "text")
    return classify.hashed_embedding(d, "text", "doc_id")


_TOKENS_SQL = """select {key}, unnest(list_concat(
        list_filter(regexp_split_to_array({low}, '\\s+'), lambda w: w <> ''),
        list_transform(range(1, length({low}) - 1), lambda i: substr({low}, i, 3)))) as token"""
_BUCKET_SQL = """cast(cast('0x' || substr(md5(token), 1, 7) as bigint) % 384 as integer) as bucket,
        sum(case when substr(md5(token), 8, 1) < '8' then 1 else -1 end) as w"""


@query("doc_bucket_sums", f"""select doc_id, bucket, cast(w as bigint) as w from (
      select doc_id, {_BUCKET_SQL} from ({_TOKENS_SQL.format(key='doc_id', low="lower(coalesce(text, ''))")} from documents)
      group by doc_id, 2) where w <> 0""")
def q_doc_bucket_sums(spark, sf):
    """I1 in integers: signed token counts per document and bucket."""
    return classify.bucket_sums(tables.table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")


@query("classifier_report")
def q_classifier_report(spark, sf):
    """I5 + I8: scores on the held-out split and the class report."""
    return classify.class_report(_doc_scores(spark, sf), "lang", "predicted")


@query("classifier_report_forest")
def q_classifier_report_forest(spark, sf):
    """I4 with the random forest: class report on the held-out split."""
    def build():
        s = _doc_split(spark, sf)
        w = classify.class_weights(s.filter("split = 'train'"), "lang").select("lang", "weight")
        return classify.train_classifier(s.filter("split = 'train'").join(F.broadcast(w), "lang"), "text", "lang", weight="weight", kind="forest")
    model = _model(context(spark, sf), "doc_forest", build)
    return classify.class_report(classify.score(model, _doc_split(spark, sf).filter("split = 'test'")), "lang", "predicted")


@query("confidence_hist")
def q_confidence_hist(spark, sf):
    """I7."""
    return classify.confidence_hist(_doc_scores(spark, sf))


@query("final_labels")
def q_final_labels(spark, sf):
    """I6 + D1: labelled rows keep their label; held-out rows get the model's
    label when its probability passes the gate, others drop."""
    s = _doc_split(spark, sf)
    coded = s.filter("split <> 'test'").select("doc_id", F.col("lang").alias("label"), F.lit("code").alias("source"))
    gated = classify.confidence_gate(_doc_scores(spark, sf)).select(
        "doc_id", F.col("predicted").alias("label"), F.lit("model").alias("source"))
    return coded.unionByName(gated)


def _learned(spark, sf):
    """Conditional logit over the training rows' lists (true next forced
    in); the penalty is chosen on the top-1 of all validation rows."""
    ctx = context(spark, sf)
    return _model(ctx, "rerank_scorer", lambda: listwise.train(ctx.ranked_lists("train"), ctx.ranked_lists("val")))


@query("rerank_learned_eval")
def q_rerank_learned_eval(spark, sf):
    """J9 + J11: ensemble, fixed linear and learned rankings on test."""
    weights, _ = _learned(spark, sf)
    f = context(spark, sf).ranked_lists("test")
    fixed = rerank.rerank_eval(rerank.rerank(f, listwise.FIXED))
    learned = rerank.rerank_eval(rerank.rerank(f, listwise.Scorer(weights))).filter("ranking = 'rerank'") \
        .withColumn("ranking", F.lit("learned"))
    return fixed.unionByName(learned)


@query("rerank_penalties")
def q_rerank_penalties(spark, sf):
    """Top-1 of every penalty and of the plain ensemble on all validation rows."""
    _, places = _learned(spark, sf)
    names = [f"penalty {p:g}" for p in sorted(listwise.PENALTIES)] + ["ensemble"]
    return spark.createDataFrame([(n, float(v)) for n, v in zip(names, places, strict=True)], "fit string, val_top_1 double")


_TERM_SQL = {t: t if t in rerank.FEATURES else f"{t.removesuffix('_self')} * f_self" for t in listwise.TERMS}


@query("rerank_gradient", _rr_sql("select term, " + R("gradient", 4) + """ as gradient from (
      select """ + ", ".join(f"sum((case when cand_idx = nxt_idx then 1.0e0 else 0.0e0 end - w) * {x}) as {t}" for t, x in _TERM_SQL.items()) + """
      from (select *, greatest(f_ensemble, 1e-9) / sum(greatest(f_ensemble, 1e-9)) over (partition by person_id, pos) as w
            from feats where true_pos >= 0)) unpivot (gradient for term in (""" + ", ".join(listwise.TERMS) + "))"))
def q_rerank_gradient(spark, sf):
    """Gradient of the list likelihood over the test rows, where ranking is the ensemble's."""
    return listwise.gradient(context(spark, sf).ranked_lists("test")).withColumn("gradient", round_to("gradient", 4))


@query("rerank_importance")
def q_rerank_importance(spark, sf):
    """Feature-group importance of the learned ranking, sums to 1; display
    names break after the group's letter (2.L-6)."""
    weights, _ = _learned(spark, sf)
    rows = listwise.group_importance(weights, listwise.spread(context(spark, sf).ranked_lists("train")))
    return spark.createDataFrame(rows, "feature_group string, importance double").withColumn("display", _display("feature_group"))


def _display(col: str):
    """2.L-6: a feature group's name for a chart."""
    return F.regexp_replace(F.regexp_replace(col, "^([^_]*)_", "$1\n"), "_", " ")


@query("state_text_embeddings")
def q_state_text_embeddings(spark, sf):
    """Embedding per state from ``state [SEP] display name`` (hashing
    encoder, unit length)."""
    ctx = context(spark, sf)
    return ctx.state_embeddings.join(ctx.space.select(F.col("idx").alias("state_idx"), "state"), "state_idx") \
            .select("state", "state_idx", "emb")


def _scatter(spark, sf):
    """Every entity of the drift table with its segment (H3 stand-in, H4)."""
    ctx = context(spark, sf)
    clustered = ctx._stage("clustered", lambda: segments.quantile_segments(ctx.risk))
    names = drift.archetype_names(drift.cluster_summary(clustered)).select("cluster", "archetype")
    return clustered.join(names, "cluster")


_SCATTER_SQL = "select person_id, drift_score, seq_length, archetype from smapa"


@query("user_scatter", sql(f"""select person_id, {R('drift_score')} as drift_score, seq_length, archetype
    from ({_SCATTER_SQL})""", "smapa"))
def q_user_scatter(spark, sf):
    """K7: drift x sequence length per entity with its segment."""
    return _scatter(spark, sf).select("person_id", r6("drift_score").alias("drift_score"), "seq_length", "archetype")


@query("segment_centroids", sql(f"""select archetype, count(*) as n_users, {R('avg(drift_score)')} as mean_drift,
      {R('avg(seq_length)')} as mean_length from ({_SCATTER_SQL}) group by archetype""", "smapa"))
def q_segment_centroids(spark, sf):
    """K7: centroid per segment."""
    return _scatter(spark, sf).groupBy("archetype").agg(
        F.count(F.lit(1)).alias("n_users"), r6(F.avg("drift_score")).alias("mean_drift"),
        r6(F.avg("seq_length")).alias("mean_length"))


# --------------------------------------------------------------- closing reports and sinks


@query("rerank_improvement", f"""select metric, before, after, {R('(after - before) * 100.0e0', 4)} as points from (
      select metric, max(case when ranking = 'ensemble' then v end) as before, max(case when ranking = 'rerank' then v end) as after
      from (unpivot (select ranking, top_1, top_3, top_5 from ({ORACLE['rerank_eval']})) on top_1, top_3, top_5 into name metric value v)
      group by metric)""")
def q_rerank_improvement(spark, sf):
    """J11 + J15: hit rates before and after, gain in points."""
    return rerank.improvement(q_rerank_eval(spark, sf)).withColumn("points", round_to("points", 4))


@query("rerank_ablation_report", f"""select feature_group, top1_with_all, top1_zeroed_out, top1_drop,
      {R('top1_drop / top1_with_all * 100.0e0', 4)} as relative_drop_pct,
      cast(row_number() over (order by top1_drop desc, feature_group) as integer) as rank,
      substr(feature_group, 1, 1) || chr(10) || replace(substr(feature_group, 3), '_', ' ') as display from ({ORACLE['rerank_ablation']})""")
def q_rerank_ablation_report(spark, sf):
    """J12 with the relative drop, ordered by drop."""
    a = rerank.ablation_report(q_rerank_ablation(spark, sf))
    return a.withColumn("relative_drop_pct", round_to("relative_drop_pct", 4)).withColumn("display", _display("feature_group"))


@query("win_margin_summary", f"""select count(*) as n_rows, {R('avg(win_prob)')} as mean_win_prob, {R('avg(margin)')} as mean_margin,
      {R('quantile_cont(win_prob, 0.5)')} as median_win_prob from ({ORACLE['win_margin']})""")
def q_win_margin_summary(spark, sf):
    """J13."""
    w = rerank.margin_summary(q_win_margin(spark, sf))
    return w.select("n_rows", *[r6(c).alias(c) for c in ("mean_win_prob", "mean_margin", "median_win_prob")])


def _top_rules_by(name: str, by: str) -> None:
    @query(name, sql(f"""select antecedent, consequent, support, confidence, lift, pair_count from ({RULES_SQL})
        where antecedent <> consequent order by {by} desc, antecedent, consequent limit 15""", "tr"))
    def q(spark, sf):
        """H6: the 15 best rules between different states by one measure."""
        r = rules.top_rules(rules.association_rules(context(spark, sf).transitions), 15, by=by)
        return r.select("antecedent", "consequent", "support", "confidence", "lift", "pair_count")


_top_rules_by("top_rules_by_confidence", "confidence")
_top_rules_by("top_rules_by_support", "support")


@query("drift_export", sql(f"""select *, row_number() over (order by drift_score desc, person_id) as row_number from (
      select person_id, {R('drift_score')} as drift_score, total_transitions, seq_length from risk)""", "risk"))
def q_drift_export(spark, sf):
    """A3 + F9: the whole drift table written as CSV, numbered and ordered by drift, and read back."""
    ctx = context(spark, sf)
    out = ctx.risk.select("person_id", r6("drift_score").alias("drift_score"), "total_transitions", "seq_length")
    return _export(ctx, "drift_csv", out, [F.desc("drift_score"), F.col("person_id")])


def _export(ctx, name: str, rows: DataFrame, order: list) -> DataFrame:
    """Ordered CSV with row numbers from 1 (F9); the number of a row is its place
    in the file set. One group of all rows is numbered by chunks (``sequence``)."""
    path = ctx.stage_path(f"exports/{name}")
    rows = ctx._stage(f"export-rows/{name}", lambda: rows.withColumn("_all", F.lit(0)))
    placed = ordered_sequence(rows, ["_all"], order, position="_at").drop("_all")
    placed = placed.select(*[c for c in placed.columns if c != "_at"], (F.col("_at") + 1).alias("row_number"))
    stages.write_csv(placed.orderBy("row_number"), path)
    return stages.read_csv(ctx.spark, path, placed.schema)


@query("rules_export", sql(f"""select *, row_number() over (order by pair_count desc, antecedent, consequent) as row_number from (
      select antecedent, consequent, pair_count from ({RULES_SQL}))""", "tr"))
def q_rules_export(spark, sf):
    """H5 + F9: all association rules, numbered, as CSV."""
    ctx = context(spark, sf)
    out = rules.association_rules(ctx.transitions).select("antecedent", "consequent", "pair_count")
    return _export(ctx, "rules_csv", out, [F.desc("pair_count"), F.col("antecedent"), F.col("consequent")])


@query("metrics_json", ORACLE["clean_report"])
def q_metrics_json(spark, sf):
    """A4: the drop report written as JSON and read back."""
    ctx = context(spark, sf)
    path = ctx.stage_path("exports/metrics_json")
    out = clean.clean_report(ctx.raw)
    stages.write_metrics(out, path)
    return spark.read.schema(out.schema).json(path)


# A long ordered rule table over codes (two-digit groups, then one-digit ones, then the rest)
CODE_RULES = [(f"group {n}", f"^{n}") for n in range(10, 100)] + [(f"major {n}", f"^{n}") for n in range(10)] + [("other", ".")]


@query("code_rules", sql(f"""select label, count(*) as n from (
      select {_case_sql("coalesce(matched_code, '')", CODE_RULES, 'none')} as label from ev) group by label""", "ev"))
def q_code_rules(spark, sf):
    """B17."""
    e = context(spark, sf).events
    return e.select(rulesets.first_match(F.coalesce("matched_code", F.lit("")), CODE_RULES, "none").alias("label")) \
            .groupBy("label").agg(F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------- k-means segments (H3) with given centres


def _given(ctx):
    return ctx._stage("given-centres", lambda: drift.assign_drift(ctx.risk, GIVEN_CENTRES))


def _given_names(ctx):
    c = _given(ctx)
    return c.join(drift.archetype_names(drift.cluster_summary(c)).select("cluster", "archetype"), "cluster")


@query("kmeans_assign", sql("select person_id, cluster from kclu", "kclu"))
def q_kmeans_assign(spark, sf):
    """H3: nearest of the given centres for every entity."""
    return _given(context(spark, sf)).select("person_id", "cluster")


@query("kmeans_archetypes", sql(f"""select cluster, n_users, {R('mean_drift')} as mean_drift, {R('mean_len')} as mean_len,
      {R('mean_loop')} as mean_loop, archetype from ksum""", "ksum"))
def q_kmeans_archetypes(spark, sf):
    """E13 + H4 on k-means clusters."""
    s = drift.archetype_names(drift.cluster_summary(_given(context(spark, sf))))
    return s.select("cluster", "n_users", *[r6(c).alias(c) for c in ("mean_drift", "mean_len", "mean_loop")], "archetype")


@query("kmeans_breakdown", sql("""select archetype, dominant_sector, n_users, rank from (
      select archetype, dominant_sector, n_users,
             cast(row_number() over (partition by archetype order by n_users desc, dominant_sector) as integer) as rank
      from (select s.archetype, k.dominant_sector, count(*) as n_users from kclu k join ksum s on s.cluster = k.cluster
            group by s.archetype, k.dominant_sector)) where rank <= 3""", "kclu", "ksum"))
def q_kmeans_breakdown(spark, sf):
    """H8 on k-means clusters."""
    c = _given_names(context(spark, sf)).groupBy("archetype", "dominant_sector").agg(F.count(F.lit(1)).alias("n_users"))
    return reports.top_n_per_group(c, ["archetype"], "n_users", ["dominant_sector"], 3).select("archetype", "dominant_sector", "n_users", "rank")


@query("kmeans_centroids", sql(f"""select s.archetype, count(*) as n_users, {R('avg(k.drift_score)')} as mean_drift,
      {R('avg(k.seq_length)')} as mean_length from kclu k join ksum s on s.cluster = k.cluster group by s.archetype""", "kclu", "ksum"))
def q_kmeans_centroids(spark, sf):
    """K7 on k-means clusters."""
    return _given_names(context(spark, sf)).groupBy("archetype").agg(
        F.count(F.lit(1)).alias("n_users"), r6(F.avg("drift_score")).alias("mean_drift"), r6(F.avg("seq_length")).alias("mean_length"))


@query("kmeans_segment_matrices")
def q_kmeans_segment_matrices(spark, sf):
    """G8 with the segments of a fitted k-means (25 restarts) of the training entities."""
    ctx = context(spark, sf, segment_method="kmeans")
    return _long(ctx, ctx.components.seg, ["archetype"]).select("archetype", "cur", "nxt", round_to("p", 9).alias("p"))


# --------------------------------------------------------------- the journey with labelled uncoded events


def _merged(spark, sf):
    """The branch whose uncoded events carry the accepted SQL-made labels."""
    return context(spark, sf, labels_from="scores", scores=_sql_scores)


def _merged_query(name: str, oracle: str, fn) -> None:
    query(f"merged_{name}", with_scores(oracle))(fn)


def q_merged_transitions(spark, sf):
    return _merged(spark, sf).transitions.select("person_id", "pos", "cur", "nxt", "prev", "univ_flag")


def q_merged_space(spark, sf):
    return _merged(spark, sf).space.select("state", "idx")


def q_merged_matrix(spark, sf):
    ctx = _merged(spark, sf)
    return markov.long_form(ctx.global_matrix, ctx.space).select("cur", "nxt", round_to("p", 9).alias("p"))


def q_merged_drift(spark, sf):
    return _merged(spark, sf).risk.select("person_id", r6("drift_score").alias("drift_score"), "total_transitions",
                                          r6("self_loop_rate").alias("self_loop_rate"), "seq_length", "dominant_sector")


def q_merged_split(spark, sf):
    return _merged(spark, sf).split.select("person_id", "dominant", "split")


def q_merged_windows(spark, sf):
    ctx = _merged(spark, sf)
    return ctx.components.market.select("win_label", r6("drift").alias("drift"))


def q_merged_ensemble_eval(spark, sf):
    ctx = _merged(spark, sf)
    e = ensemble.evaluate(ctx.annotated("test"), ctx.components, ctx.weights)
    return e.select("n_rows", *[r6(c).alias(c) for c in ["persistence_top1", "top_1", "top_3", "top_5"]])


_merged_query("transitions", sql("select person_id, pos, cur, nxt, prev, univ_flag from tr", "tr"), q_merged_transitions)
_merged_query("space", sql("select state, idx from sp", "sp"), q_merged_space)
_merged_query("matrix", sql(f"select cur, nxt, {R('p', 9)} as p from gm", "gm"), q_merged_matrix)
_merged_query("drift", sql(f"""select person_id, {R('drift_score')} as drift_score, total_transitions, {R('self_loop_rate')} as self_loop_rate,
    seq_length, dominant_sector from risk""", "risk"), q_merged_drift)
_merged_query("split", sql("select person_id, dominant, split from spl", "spl"), q_merged_split)
_merged_query("market_drift", ORACLE["market_drift"], q_merged_windows)
_merged_query("ensemble_eval", ORACLE["ensemble_eval"], q_merged_ensemble_eval)


# --------------------------------------------------------------- stages and the embedding store


@query("stage_chain", sql("""select step, a_rows, b_rows, a_built, b_built from (select count(*) as n, count(distinct person_id) as u from ev),
    lateral (select * from (values (1, n, u, 1, 1), (2, n, u, 1, 1), (3, n, u, 2, 2), (4, n, u, 2, 3)) t(step, a_rows, b_rows, a_built, b_built))""", "ev"))
def q_stage_chain(spark, sf):
    """A2 + A6: a stage and one after it, 1 built, 2 reused, 3 rebuilt when the
    first one's input changes (the second follows), 4 the second rebuilt after a
    write of it was lost. Rows of both and how often each was built."""
    ctx = context(spark, sf)
    root = os.path.join(ctx.stage_path("chain"), uuid.uuid4().hex)
    a, b, built, out = f"{root}/a", f"{root}/b", {"a": 0, "b": 0}, []

    def run(step, fingerprint):
        def build(name, df):
            built[name] += 1
            return df
        first = stages.stage(spark, a, lambda: build("a", ctx.events), fingerprint, "a")
        second = stages.stage(spark, b, lambda: build("b", first.groupBy("person_id").agg(F.count(F.lit(1)).alias("n"))), "same", "b", after=[a])
        # counted now: a later step drops versions that no one should read any more
        out.append((step, first.count(), second.count(), built["a"], built["b"]))
        return second
    run(1, "first")
    run(2, "first")
    second = run(3, "second")
    stages.discard(spark, b)
    second.limit(0).write.parquet(f"{b}/v-lost")  # data of a write that never committed
    run(4, "second")
    return spark.createDataFrame(out, "step int, a_rows long, b_rows long, a_built int, b_built int")


@query("embedding_store", """with b as (select 1 as run, md5(text) as k from documents where text is not null and doc_id % 3 <> 0
      union all select 2, md5(text) from documents where text is not null and doc_id % 3 <> 1)
    select batch, count(*) as n_keys, min(k) as first_key, max(k) as last_key from (select k, min(run) as batch from b group by k) group by batch""")
def q_embedding_store(spark, sf):
    """Two overlapping batches of documents, the second run twice; keys by the batch that added them."""
    store = os.path.join(context(spark, sf).stage_path("embeddings"), uuid.uuid4().hex)
    d = tables.table(spark, sf, "documents").select("doc_id", "text")
    encode = lambda df: classify.hashed_embedding(df, "text", "key")
    for part in ("doc_id % 3 <> 0", "doc_id % 3 <> 1", "doc_id % 3 <> 1"):
        out = stages.incremental_embeddings(d.filter(part), store, encode)
    return out.groupBy("batch").agg(F.count(F.lit(1)).alias("n_keys"), F.min("key").alias("first_key"), F.max("key").alias("last_key"))
