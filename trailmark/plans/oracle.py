"""Oracle SQL (DuckDB dialect, plain ANSI where possible) for the catalog
queries. The journey fixture and its stages are CTEs; each query text
carries the CTEs it needs."""

from __future__ import annotations

FIXTURE = """select o.o_custkey as person_id,
  case when p.p_partkey % 37 = 0 then 'Unknown'
       when p.p_partkey % 41 = 0 then ' '
       else concat(p.p_name, ' ', p.p_brand) end as matched_label,
  case when p.p_partkey % 5 = 0 then null else p.p_type end as matched_description,
  case when p.p_partkey % 12 = 0 then null
       when p.p_partkey % 12 = 6 then 'unknown'
       else concat(cast(1000 + 150*p.p_size as varchar(9)), '.', cast(p.p_partkey % 20 as varchar(9))) end as matched_code,
  case when l.l_linenumber = 7 then 'n/a'
       else substring(cast(o.o_orderdate as varchar(30)),1,10) end as start_date,
  case when c.c_mktsegment = 'MACHINERY' then null
       else c.c_mktsegment in ('BUILDING','HOUSEHOLD') end as university_studies,
  o.o_orderkey as src_order, l.l_linenumber as src_line, l.l_partkey as src_part, l.l_suppkey as src_supp
from lineitem l
join orders o on l.l_orderkey = o.o_orderkey
join part p on l.l_partkey = p.p_partkey
join customer c on o.o_custkey = c.c_custkey"""

# Centres given to the assignment queries, on standardised drift, length and self-loop rate.
GIVEN_CENTRES = [(-1.25, -0.5, 1.5), (-0.25, 1.25, 0.25), (0.0, -0.75, -0.25), (0.75, 0.5, -0.5), (1.5, -1.0, -0.75)]

# name -> (dependencies, body)
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "fx": ((), FIXTURE),
    "lab": (("fx",), """select * from fx where matched_label is not null
        and not regexp_matches(matched_label, '^\\s*$') and lower(matched_label) <> 'unknown'"""),
    "dd": (("lab",), """select * exclude (rn_) from (select *, row_number() over (
        partition by person_id, matched_label, start_date
        order by src_order, src_line, src_part, src_supp) as rn_ from lab) where rn_ = 1"""),
    "yd": (("dd",), """select *, try_cast(nullif(regexp_extract(cast(start_date as varchar),
        '([0-9]{4})', 1), '') as integer) as yr from dd"""),
    "ev0": (("yd",), "select * from yd where yr between 1950 and 2024"),
    "ev": (("ev0",), """select *,
        case when hc_ then substring(split_part(matched_code, '.', 1), 1, 3) end as occupation_group,
        not hc_ as needs_nlp,
        regexp_replace(coalesce(matched_label, 'None') || ' [SEP] ' ||
          case when matched_description is null or matched_description in ('nan', 'None', '') then ''
               else matched_description end, '^\\s+|\\s+$', '', 'g') as combined_text
        from (select *, coalesce(matched_code is not null and not regexp_matches(matched_code, '^\\s*$')
              and lower(matched_code) <> 'unknown', false) as hc_ from ev0)"""),
    "ce": (("ev",), "select *, occupation_group as state from ev where not needs_nlp"),
    "uf": (("ce",), """select person_id,
        (sum(case when university_studies then 1 else 0 end) * 1.0e0 / greatest(count(university_studies), 1)) >= 0.5 as univ_flag
        from ce group by person_id"""),
    "sq": (("ce",), """select *, state as cur,
        lead(state) over w as nxt, lag(state) over w as prev,
        cast(row_number() over w - 1 as bigint) as pos
        from ce window w as (partition by person_id order by yr, start_date, matched_label)"""),
    "tr": (("sq", "uf"), """select s.*, coalesce(u.univ_flag, false) as univ_flag
        from sq s left join uf u on s.person_id = u.person_id where s.nxt is not null"""),
    "sp": (("tr",), """select state, cast(row_number() over (order by state) - 1 as integer) as idx
        from (select cur as state from tr union select nxt from tr) where state is not null"""),
    "nn": (("sp",), "select count(*) as n from sp"),
    "sr": (("sp", "tr"), """select sp.state, sp.idx, coalesce(r.rate, 0.2e0) as self_rate,
        1.0e0 + 2.0e0 * coalesce(r.rate, 0.2e0) as mult
        from sp left join (select cur, avg(case when cur = nxt then 1.0e0 else 0.0e0 end) as rate
                           from tr group by cur) r on r.cur = sp.state"""),
    "grid": (("sp",), """select a.state as cur, a.idx as cur_idx, b.state as nxt, b.idx as nxt_idx
        from sp a cross join sp b"""),
    # global matrix, long form
    "gm": (("grid", "tr", "sr", "nn"), """select cur, nxt, cur_idx, nxt_idx,
          (v + sv) / (row_sum + n * sv) as p
        from (select *, case when row_sum < 10 then 0.5e0 when row_sum < 100 then 0.1e0 else 0.01e0 end as sv
              from (select *, sum(v) over (partition by cur) as row_sum
                    from (select g.*, coalesce(c.v, 0) * case when g.cur = g.nxt then s.mult else 1.0e0 end as v
                          from grid g
                          left join (select cur, nxt, count(*) * 1.0e0 as v from tr group by cur, nxt) c
                            on c.cur = g.cur and c.nxt = g.nxt
                          join sr s on s.state = g.cur))), nn"""),
    # transition profiles (state i, place j) and the mean profile
    "prf": (("grid", "tr", "nn"), """select cur_idx as i, nxt_idx as j, (c + 0.01e0) / (sum(c) over (partition by cur_idx) + n * 0.01e0) as v
        from (select g.cur_idx, g.nxt_idx, coalesce(t.c, 0.0e0) as c from grid g
              left join (select cur, nxt, count(*) * 1.0e0 as c from tr group by cur, nxt) t on t.cur = g.cur and t.nxt = g.nxt), nn"""),
    "prm": (("prf",), "select j, avg(v) as m from prf group by j"),
    "lp": (("tr", "gm"), """select t.*, ln(greatest(coalesce(g.p, 0), 1e-9)) as log_prob,
        t.cur = t.nxt as is_self
        from tr t left join gm g on g.cur = t.cur and g.nxt = t.nxt"""),
    "dom": (("ce",), """select person_id, state as dominant_sector from (
        select person_id, state, row_number() over (partition by person_id order by c desc, state) as r
        from (select person_id, state, count(*) as c from ce group by person_id, state)) where r = 1"""),
    "risk": (("lp", "ce", "dom"), """select r.person_id, r.drift_score, r.total_transitions,
          r.self_loop_rate, l.seq_length, d.dominant_sector
        from (select person_id, -avg(log_prob) as drift_score, count(*) as total_transitions,
                     avg(case when is_self then 1.0e0 else 0.0e0 end) as self_loop_rate
              from lp group by person_id having count(*) >= 2) r
        left join (select person_id, count(*) as seq_length from ce group by person_id) l
          on l.person_id = r.person_id
        left join dom d on d.person_id = r.person_id"""),

    # ---- split and training components (window size 2, seed 42)
    "spl": (("dom",), """select person_id, dominant_sector as dominant,
        case when rk < floor(n * 0.64) then 'train' when rk < floor(n * 0.80) then 'val' else 'test' end as split
        from (select *, row_number() over (partition by dominant_sector
                 order by md5(cast(person_id as varchar) || '|42'), person_id) - 1 as rk,
                 count(*) over (partition by dominant_sector) as n from dom)"""),
    "trs": (("tr", "spl"), "select t.*, s.split from tr t join spl s on s.person_id = t.person_id"),
    "trn": (("trs",), "select * from trs where split = 'train'"),
    "mxy": (("trn",), "select max(yr) as maxyr from trn"),
    "gmt": (("grid", "trn", "sr", "nn"), """select cur, nxt, cur_idx, nxt_idx, (v + sv) / (row_sum + n * sv) as p
        from (select *, case when row_sum < 10 then 0.5e0 when row_sum < 100 then 0.1e0 else 0.01e0 end as sv
              from (select *, sum(v) over (partition by cur) as row_sum
                    from (select g.*, coalesce(c.v, 0) * case when g.cur = g.nxt then s.mult else 1.0e0 end as v
                          from grid g
                          left join (select cur, nxt, count(*) * 1.0e0 as v from trn group by cur, nxt) c
                            on c.cur = g.cur and c.nxt = g.nxt
                          join sr s on s.state = g.cur))), nn"""),
    "rect": (("grid", "trn", "sr", "nn", "mxy"), """select cur, nxt, cur_idx, nxt_idx, (v + sv) / (row_sum + n * sv) as p
        from (select *, case when row_sum < 10 then 0.5e0 when row_sum < 100 then 0.1e0 else 0.01e0 end as sv
              from (select *, sum(v) over (partition by cur) as row_sum
                    from (select g.*, coalesce(c.v, 0) * case when g.cur = g.nxt then s.mult else 1.0e0 end as v
                          from grid g
                          left join (select cur, nxt, sum(exp(0.12e0 * (yr - maxyr))) as v from trn, mxy group by cur, nxt) c
                            on c.cur = g.cur and c.nxt = g.nxt
                          join sr s on s.state = g.cur))), nn"""),
    "wins": (("trn",), """select win, cast(min(y) as varchar) || '-' || cast(max(y) as varchar) as win_label,
          min(y) as start_year, max(y) as end_year
        from (select y, cast(floor((dense_rank() over (order by y) - 1) / 2) as integer) as win
              from (select distinct yr as y from trn)) group by win"""),
    "trw": (("trn", "wins"), """select t.*, w.win from trn t join wins w on t.yr between w.start_year and w.end_year"""),
    "wmt": (("grid", "trw", "sr", "nn", "wins"), """select win, cur, nxt, cur_idx, nxt_idx, (v + sv) / (row_sum + n * sv) as p
        from (select *, case when zs > 0.70 then 0.5e0 when zs > 0.30 then 0.1e0 else 0.01e0 end as sv
              from (select *, sum(v) over (partition by win, cur) as row_sum,
                           1.0e0 - count_if(v > 0) over (partition by win) / (n * n * 1.0e0) as zs
                    from (select w.win, g.*, coalesce(c.v, 0) * case when g.cur = g.nxt then s.mult else 1.0e0 end as v
                          from wins w cross join grid g
                          left join (select win, cur, nxt, count(*) * 1.0e0 as v from trw group by win, cur, nxt) c
                            on c.win = w.win and c.cur = g.cur and c.nxt = g.nxt
                          join sr s on s.state = g.cur), nn))"""),
    "so2": (("grid", "trn", "sr", "sp"), """select prev, cur, nxt, cur_idx, nxt_idx, n_context, vec / sum(vec) over (partition by prev, cur) as p
        from (select c.prev, c.n_context, g.*, (coalesce(t.n, 0) + 0.01e0) * case when g.nxt = g.cur then s.mult else 1.0e0 end as vec
              from (select prev, cur, count(*) as n_context from trn where prev in (select state from sp)
                    group by prev, cur having count(*) >= 5) c
              join grid g on g.cur = c.cur
              join sr s on s.state = g.cur
              left join (select prev, cur, nxt, count(*) * 1.0e0 as n from trn group by prev, cur, nxt) t
                on t.prev = c.prev and t.cur = c.cur and t.nxt = g.nxt)"""),
    "pri": (("trn", "sp", "nn", "mxy"), """select person_id, state, idx as state_idx, w, total,
          (0.01e0 + w) / (0.01e0 * n + total) as p, 0.01e0 / (0.01e0 * n + total) as p_default
        from (select *, sum(w) over (partition by person_id) as total
              from (select person_id, cur as state, sum(exp(0.15e0 * (yr - maxyr))) as w from trn, mxy
                    group by person_id, cur) u) x join sp using (state), nn where total >= 2"""),
    "bst": (("trn", "sp", "nn"), """select flag_value, state, idx, case when flag_value then bt else bf end as boost from (
        select sp.state, sp.idx,
          case when tt > 0 then least(greatest(((coalesce(n_t, 0) + 0.01e0) / (tt + n * 0.01e0)) / ((coalesce(n_all, 0) + 0.01e0) / (ta + n * 0.01e0)), 0.5e0), 2.0e0) else 1.0e0 end as bt,
          case when tt > 0 then least(greatest(((coalesce(n_f, 0) + 0.01e0) / (tf + n * 0.01e0)) / ((coalesce(n_all, 0) + 0.01e0) / (ta + n * 0.01e0)), 0.5e0), 2.0e0) else 1.0e0 end as bf
        from sp left join (select nxt, count(*) as n_all, count_if(univ_flag) as n_t, count_if(not univ_flag) as n_f
                           from trn group by nxt) c on c.nxt = sp.state,
             (select count(*) as ta, count_if(univ_flag) as tt, count_if(not univ_flag) as tf from trn), nn)
        cross join (values (true), (false)) f(flag_value)"""),
    "rskt": (("trn", "gmt"), """select person_id, -avg(ln(greatest(coalesce(g.p, 0), 1e-9))) as drift_score, count(*) as seq_length,
          avg(case when t.cur = t.nxt then 1.0e0 else 0.0e0 end) as self_loop_rate
        from trn t left join gmt g on g.cur = t.cur and g.nxt = t.nxt group by person_id having count(*) >= 2"""),
    "clu": (("rskt",), """select r.*, cast((drift_score > q0)::int + (drift_score > q1)::int + (drift_score > q2)::int
          + (drift_score > q3)::int as integer) as cluster
        from rskt r, (select quantile_cont(drift_score, 0.2) as q0, quantile_cont(drift_score, 0.4) as q1,
                             quantile_cont(drift_score, 0.6) as q2, quantile_cont(drift_score, 0.8) as q3 from rskt)"""),
    "csum": (("clu",), """select s.*, case when mean_drift > q80 and mean_loop < 0.3 then 'Career Switcher'
          when mean_drift < q20 and mean_loop > 0.5 then 'Sector Loyalist'
          when mean_len > q75 then 'Career Veteran'
          when mean_drift > q50 then 'Gradual Mover' else 'Stable Specialist' end as archetype
        from (select cluster, count(*) as n_users, floor(avg(drift_score) * 1e9 + 0.5) / 1e9 as mean_drift, floor(avg(seq_length) * 1e9 + 0.5) / 1e9 as mean_len,
                     avg(self_loop_rate) as mean_loop from clu group by cluster) s,
             (select quantile_cont(mean_drift, 0.8) as q80, quantile_cont(mean_drift, 0.2) as q20,
                     quantile_cont(mean_drift, 0.5) as q50, quantile_cont(mean_len, 0.75) as q75
              from (select cluster, floor(avg(drift_score) * 1e9 + 0.5) / 1e9 as mean_drift, floor(avg(seq_length) * 1e9 + 0.5) / 1e9 as mean_len from clu group by cluster))"""),
    "smap": (("clu", "csum"), "select c.person_id, s.archetype from clu c join csum s on s.cluster = c.cluster"),
    # segments of every entity of the drift table
    "clua": (("risk",), """select r.*, cast((drift_score > q0)::int + (drift_score > q1)::int + (drift_score > q2)::int
          + (drift_score > q3)::int as integer) as cluster
        from risk r, (select quantile_cont(drift_score, 0.2) as q0, quantile_cont(drift_score, 0.4) as q1,
                             quantile_cont(drift_score, 0.6) as q2, quantile_cont(drift_score, 0.8) as q3 from risk)"""),
    "csua": (("clua",), """select s.*, case when mean_drift > q80 and mean_loop < 0.3 then 'Career Switcher'
          when mean_drift < q20 and mean_loop > 0.5 then 'Sector Loyalist'
          when mean_len > q75 then 'Career Veteran'
          when mean_drift > q50 then 'Gradual Mover' else 'Stable Specialist' end as archetype
        from (select cluster, floor(avg(drift_score) * 1e9 + 0.5) / 1e9 as mean_drift, floor(avg(seq_length) * 1e9 + 0.5) / 1e9 as mean_len,
                     avg(self_loop_rate) as mean_loop from clua group by cluster) s,
             (select quantile_cont(mean_drift, 0.8) as q80, quantile_cont(mean_drift, 0.2) as q20,
                     quantile_cont(mean_drift, 0.5) as q50, quantile_cont(mean_len, 0.75) as q75
              from (select cluster, floor(avg(drift_score) * 1e9 + 0.5) / 1e9 as mean_drift, floor(avg(seq_length) * 1e9 + 0.5) / 1e9 as mean_len from clua group by cluster))"""),
    "smapa": (("clua", "csua"), "select c.*, s.archetype from clua c join csua s on s.cluster = c.cluster"),
    # uncoded events with a score made in SQL, and the labels merged through the gate
    "scu": (("ev",), """select person_id, matched_label, start_date,
          cast(100 + (length(matched_label) * 7) % 800 as varchar) as predicted,
          (length(combined_text) * 37 % 101) / 100.0e0 as confidence from ev where needs_nlp"""),
    "mrg": (("ev", "scu"), """select person_id, matched_label, start_date, yr, needs_nlp, matched_code, occupation_group,
          occupation_group as state, 'code' as label_source from ev where not needs_nlp
        union all select e.person_id, e.matched_label, e.start_date, e.yr, e.needs_nlp, e.matched_code, e.occupation_group, s.predicted, 'model'
        from ev e join scu s on s.person_id = e.person_id and s.matched_label = e.matched_label and s.start_date = e.start_date
        where e.needs_nlp and s.confidence >= 0.35"""),
    # segments from given centres of the standardised features
    "kx": (("risk",), """select r.*, (drift_score - m1) / s1 as x1, (seq_length - m2) / s2 as x2, (self_loop_rate - m3) / s3 as x3
        from risk r, (select avg(drift_score) as m1, stddev_pop(drift_score) as s1, avg(seq_length) as m2, stddev_pop(seq_length) as s2,
                             avg(self_loop_rate) as m3, stddev_pop(self_loop_rate) as s3 from risk)"""),
    "kclu": (("kx",), f"""select * exclude (r_, c_) from (select x.*, k.c_, cast(k.c_ as integer) as cluster, row_number() over (partition by person_id order by
            (x1 - y1) * (x1 - y1) + (x2 - y2) * (x2 - y2) + (x3 - y3) * (x3 - y3), c_) as r_
        from kx x, (values {", ".join(f"({i}, {a!r}e0, {b!r}e0, {c!r}e0)" for i, (a, b, c) in enumerate(GIVEN_CENTRES))}) k(c_, y1, y2, y3)) where r_ = 1"""),
    "ksum": (("kclu",), """select s.*, case when mean_drift > q80 and mean_loop < 0.3 then 'Career Switcher'
          when mean_drift < q20 and mean_loop > 0.5 then 'Sector Loyalist'
          when mean_len > q75 then 'Career Veteran'
          when mean_drift > q50 then 'Gradual Mover' else 'Stable Specialist' end as archetype
        from (select cluster, count(*) as n_users, floor(avg(drift_score) * 1e9 + 0.5) / 1e9 as mean_drift, floor(avg(seq_length) * 1e9 + 0.5) / 1e9 as mean_len,
                     avg(self_loop_rate) as mean_loop from kclu group by cluster) s,
             (select quantile_cont(mean_drift, 0.8) as q80, quantile_cont(mean_drift, 0.2) as q20,
                     quantile_cont(mean_drift, 0.5) as q50, quantile_cont(mean_len, 0.75) as q75
              from (select cluster, floor(avg(drift_score) * 1e9 + 0.5) / 1e9 as mean_drift, floor(avg(seq_length) * 1e9 + 0.5) / 1e9 as mean_len from kclu group by cluster))"""),
    "tra": (("trn", "smap", "csum"), """select t.*, coalesce(m.archetype, 'Stable Specialist') as archetype
        from trn t left join smap m on m.person_id = t.person_id
        where coalesce(m.archetype, 'Stable Specialist') in (select archetype from csum)"""),
    "segm": (("grid", "tra", "sr", "nn", "gmt"), """select archetype, cur, nxt, cur_idx, nxt_idx, (v + sv) / (row_sum + n * sv) as p
        from (select *, case when row_sum < 10 then 0.5e0 when row_sum < 100 then 0.1e0 else 0.01e0 end as sv
              from (select *, sum(v) over (partition by archetype, cur) as row_sum
                    from (select a.archetype, g.*, coalesce(c.v, 0) * case when g.cur = g.nxt then s.mult else 1.0e0 end as v
                          from (select archetype from tra group by archetype having count(*) >= 50) a cross join grid g
                          left join (select archetype, cur, nxt, count(*) * 1.0e0 as v from tra group by archetype, cur, nxt) c
                            on c.archetype = a.archetype and c.cur = g.cur and c.nxt = g.nxt
                          join sr s on s.state = g.cur))), nn
        union all
        select a.archetype, g.cur, g.nxt, g.cur_idx, g.nxt_idx, g.p
        from (select archetype from tra group by archetype having count(*) < 50) a cross join gmt g"""),
    # annotated rows of every split, and the evaluation ones
    "anna": (("trs", "smap", "wins", "sp"), """select t.person_id, t.pos, t.split, t.yr, t.cur, t.nxt, t.prev, t.univ_flag,
          coalesce(m.archetype, 'Stable Specialist') as archetype, coalesce(w.win, -1) as win,
          coalesce(w.win_label, 'global') as win_key, c.idx as cur_idx, n.idx as nxt_idx, p.idx as prev_idx
        from trs t left join smap m on m.person_id = t.person_id
        left join wins w on t.yr between w.start_year and w.end_year
        join sp c on c.state = t.cur join sp n on n.state = t.nxt left join sp p on p.state = t.prev"""),
    "ann": (("anna",), "select * from anna where split in ('val', 'test')"),
    "annp": (("ann", "pri"), """select a.*, case when a.person_id in (select person_id from pri) then a.person_id end
        as prior_entity from ann a"""),
    # component cells for every evaluation context (back-off to global)
    "cells": (("annp", "gmt", "rect", "wmt", "segm", "so2", "pri", "bst"), """select x.*, g.nxt_idx as j,
          g.p as g, r.p as r, coalesce(w.p, g.p) as d, coalesce(a.p, g.p) as a, coalesce(s.p, g.p) as s,
          coalesce(h.p, hd.p_default, g.p) as h, b.boost as b
        from (select split, cur_idx, win, archetype, univ_flag, prev_idx, prior_entity, count(*) as n_rows
              from annp
              group by split, cur_idx, win, archetype, univ_flag, prev_idx, prior_entity) x
        join gmt g on g.cur_idx = x.cur_idx
        join rect r on r.cur_idx = x.cur_idx and r.nxt_idx = g.nxt_idx
        left join wmt w on w.win = x.win and w.cur_idx = x.cur_idx and w.nxt_idx = g.nxt_idx
        left join segm a on a.archetype = x.archetype and a.cur_idx = x.cur_idx and a.nxt_idx = g.nxt_idx
        left join (select p2.idx as prev_idx, so2.* from so2 join sp p2 on p2.state = so2.prev) s
          on s.prev_idx = x.prev_idx and s.cur_idx = x.cur_idx and s.nxt_idx = g.nxt_idx
        left join pri h on h.person_id = x.prior_entity and h.state_idx = g.nxt_idx
        left join (select distinct person_id, p_default from pri) hd on hd.person_id = x.prior_entity
        left join bst b on b.flag_value = x.univ_flag and b.idx = g.nxt_idx"""),
}


def sql(final: str, *needs: str) -> str:
    """Prefix ``final`` with the CTEs it needs (dependencies first)."""
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)

    for n in needs:
        visit(n)
    if not order:
        return final
    return "with " + ",\n".join(f"{n} as ({CTES[n][1]})" for n in order) + "\n" + final


def sql_with(extra: str, final: str, *needs: str) -> str:
    """Like ``sql`` with further CTE definitions (``extra``) after the needed ones."""
    base = sql("", *needs).rstrip()
    return base + ",\n" + extra + "\n" + final


def R(x: str, d: int = 6) -> str:
    """Same half-up rounding as ``round_to`` on the Spark side."""
    return f"floor(({x}) * 1e{d} + 0.5) / 1e{d}"


#: The journey's events when accepted scores label uncoded events too.
_CODED = CTES["ce"][1]


def with_scores(text: str) -> str:
    """The same query over the journey whose uncoded events carry accepted
    labels: only the events it starts from change."""
    merged = f"""{_CODED}
        union all select e.*, s.predicted as state from ev e join ({CTES['scu'][1]}) s
          on s.person_id = e.person_id and s.matched_label = e.matched_label and s.start_date = e.start_date
        where e.needs_nlp and s.confidence >= 0.35"""
    assert _CODED in text
    return text.replace(_CODED, merged)
