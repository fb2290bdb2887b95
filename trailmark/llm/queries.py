"""The operators as queries over their whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm import (caps, fm_decontamination, html_text, language_id, licenses, mixing, near_text, packing, permutation_index,
                           source_divergence, toxicity, vector_codes, warc)
from trailmark.llm.common import table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


def op4_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.nearest(table(spark, sf_dir, "embeddings"))


def op5_minhash_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_text.near_duplicates(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict_languages(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).withColumn("notices", F.array_join("notices", ","))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predict_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_spherical_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (
    op1_html_extraction, op2_best_fit_packing, op3_warc, op4_permutation_index, op5_minhash_hamming, op6_language_id, op7_license_scan,
    op8_toxicity, op9_mixing, op10_spherical_caps, op11_source_divergence, op12_vector_codes, op13_decontamination)}
_BASE32_SQL = " || ".join(
    f"substr('{warc.BASE32}', ((cast('0x' || substr(hex_, {5 * i + 1}, 5) as integer) >> {shift}) & 31) + 1, 1)"
    for i in range(8) for shift in (15, 10, 5, 0))

WARC_SQL = f"""select page_id, n_ as payload_bytes, {_BASE32_SQL} as payload_digest,
  case when page_id <> newest_ then 'revisit' else 'response' end as record_type,
  case when page_id <> newest_ then newest_ end as refers_to, true as verified
from (select page_id, cast(strlen(h_) as bigint) as n_, sha1(h_) as hex_, max(page_id) over (partition by sha256(h_)) as newest_
      from (select page_id, coalesce(html, '') as h_ from pages))"""


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _spelled_sql() -> str:
    out = "' ' || t_ || ' '"
    for old, new in licenses.SPELLINGS * 2:
        out = f"replace({out}, ' {old} ', ' {new} ')"
    return f"trim({out})"


LICENSE_SQL = f"""with u as (
    select 0 as known_, doc_id, '' as license_id, text from documents
    union all select 1, null, license_id, text from (values {", ".join(f"({_sql_text(i)}, {_sql_text(t)})" for i, t in licenses.KNOWN)}) k(license_id, text)),
  l as (select *, row_number() over () as row_ from u),
  x as (select row_, unnest(string_split(lower(coalesce(text, '')), chr(10))) as line_,
               generate_subscripts(string_split(lower(coalesce(text, '')), chr(10)), 1) as at_ from l),
  y as (select row_, at_, trim(regexp_replace(regexp_replace(line_, '{licenses.LIST_MARK}', ''), '{licenses.SEPARATORS}', ' ', 'g')) as t_
        from x where not regexp_matches(line_, '{licenses.COPYRIGHT_LINE}')),
  z as (select row_, at_, {_spelled_sql()} as c_ from y where t_ <> ''),
  w as (select l.known_, l.doc_id, l.license_id, l.row_, coalesce(string_agg(z.c_, ' ' order by z.at_), '') as c_
        from l left join z on z.row_ = l.row_ group by all),
  k as (select sha256(c_) as d_, min(license_id) as license_id from w where known_ = 1 and c_ <> '' group by 1),
  n as (select z.row_, string_agg(distinct k.license_id, ',' order by k.license_id) as notices
        from z join k on k.d_ = sha256(z.c_) group by z.row_)
select w.doc_id, length(w.c_) as canonical_chars, case when w.c_ <> '' then sha256(w.c_) end as digest, k.license_id,
       coalesce(n.notices, '') as notices
from w left join k on w.c_ <> '' and k.d_ = sha256(w.c_) left join n on n.row_ = w.row_ where w.known_ = 0"""

MIX_SQL = """with s as (
    select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as bigint) as size,
           md5('mix' || coalesce(cast(doc_id as varchar), '')) as key_ from documents),
  p as (select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) as at_ from s group by source),
  w as (select *, case (at_ - 1) % 3 when 0 then 3 when 1 then 1 else 2 end as weight_, 2 * source_size as cap_ from p),
  o as (select *, row_number() over (order by cap_ * 1.0e0 / weight_, source nulls last) as rank_,
               (1.5e0 * sum(source_size) over ()
                - coalesce(sum(cap_) over (order by cap_ * 1.0e0 / weight_, source nulls last rows between unbounded preceding and 1 preceding), 0))
               / sum(weight_) over (order by cap_ * 1.0e0 / weight_, source nulls last rows between current row and unbounded following) as level_
        from w),
  f as (select min_by(level_, rank_) filter (where level_ * weight_ <= cap_) as level_ from o),
  t as (select o.source, o.source_size, case when f.level_ is null then o.cap_ * 1.0e0
               else least(o.cap_ * 1.0e0, f.level_ * o.weight_) end as target from o, f),
  b as (select s.*, t.source_size, t.target, coalesce(sum(size) over (partition by s.source order by key_, doc_id, size
               rows between unbounded preceding and 1 preceding), 0) as before_
        from s join t on t.source is not distinct from s.source)
select doc_id, size, source_size, target,
       cast(size * (case when before_ + size / 2.0e0 <= target then 1 else 0 end
                    + case when before_ + source_size + size / 2.0e0 <= target then 1 else 0 end) as bigint) as taken
from b"""

ORACLE: dict[str, str] = {"op3_warc": WARC_SQL, "op7_license_scan": LICENSE_SQL, "op9_mixing": MIX_SQL,
                          "op11_source_divergence": source_divergence.ORACLE_SQL, "op12_vector_codes": vector_codes.ORACLE_SQL,
                          "op13_decontamination": fm_decontamination.ORACLE_SQL}
