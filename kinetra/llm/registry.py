"""Queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, byte_bpe, decontamination, divergence, filter_audit, lm_scoring, near_dedup, pii, quality, sharding, substring_dedup, toxicity, warc


def queries():
    return {
        "op1_sharding": sharding.op1_sharding,
        "op5_warc": warc.op5_warc,
        "op6_pii": pii.op6_pii,
        "op7_substring": substring_dedup.op7_substring,
        "op2_decontamination": decontamination.op2_decontamination,
        "op3_quality": quality.op3_quality,
        "op4_lm_scoring": lm_scoring.op4_lm_scoring,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_bpe": bpe.op9_bpe,
        "op10_near_dedup": near_dedup.op10_near_dedup,
        "op11_filter_audit": filter_audit.op11_filter_audit,
        "op12_divergence": divergence.op12_divergence,
        "op13_byte_bpe": byte_bpe.op13_byte_bpe,
    }


def oracle_sql():
    return {"op5_warc": OP5_SQL, "op7_substring": OP7_SQL, "op10_near_dedup": OP10_SQL, "op11_filter_audit": OP11_SQL, "op12_divergence": OP12_SQL}


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"


def _run(words: int) -> str:
    """A word and those after it, joined by one space."""
    return f"concat_ws(' ', word, {', '.join(f'lead(word, {k}) over w' for k in range(1, words))})"


OP5_SQL = """
with p as (
  select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest
  from pages
), r as (
  select *, min(page_id) over (partition by payload_digest) as first_id, row_number() over (partition by payload_digest order by page_id) as place from p
)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 100 and page_id is not null and place > 1 then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and page_id is not null and place > 1 then first_id end as refers_to
from r
"""

OP7_SQL = f"""
with d as (
  select doc_id, {WORDS.format("coalesce(text, '')")} as ws from documents
), t as (
  select doc_id, len(ws) as n, unnest(ws) as word, generate_subscripts(ws, 1) as i from d
), k as (
  select doc_id, n, i, word, case when i <= n - 12 then md5({_run(13)}) end as k from t window w as (partition by doc_id order by i)
), m as (
  select k, min(doc_id) as low from k where k is not null group by k
), g as (
  select doc_id, i, word, max(case when doc_id > low then 1 else 0 end) over (partition by doc_id order by i rows between 12 preceding and current row) = 1 as gone
  from k left join m using (k)
), o as (
  select doc_id, count(*) as n_words, count(*) filter (gone) as n_removed, string_agg(word, ' ' order by i) filter (not gone) as kept from g group by doc_id
)
select doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from documents left join o using (doc_id)
"""

OP10_SQL = f"""
with recursive d as (
  select doc_id, {WORDS.format(f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')")} as ws from documents
), t as (
  select doc_id, len(ws) as n, unnest(ws) as word, generate_subscripts(ws, 1) as i from d
), s as (
  select doc_id, n, i, md5({_run(5)}) as sh from t window w as (partition by doc_id order by i)
), u as (
  select distinct doc_id, sh from s where i <= greatest(n - 4, 1)
), c as (
  select doc_id, count(*) as n from u group by doc_id
), b as (
  select x.doc_id as a, y.doc_id as b, count(*) as shared from u x join u y on x.sh = y.sh and x.doc_id < y.doc_id group by all
), e as (
  select a, b from b join c p on a = p.doc_id join c q on b = q.doc_id where 100 * shared >= 85 * (p.n + q.n - shared)
), g as (
  select a, b from e union select b, a from e
), r as (
  select a as node, a as low from g
  union
  select g.b, r.low from r join g on g.a = r.node where r.low < g.b
), l as (
  select node, min(low) as low from r group by node
)
select documents.doc_id, coalesce(n, 0) as n_shingles, coalesce(low, documents.doc_id) as component_id, coalesce(low, documents.doc_id) = documents.doc_id as kept
from documents left join c using (doc_id) left join l on node = documents.doc_id
"""

OP11_SQL = """
with d as (
  select doc_id, coalesce(text, '') as text, coalesce(source, '') as part, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws,
    min(doc_id) over (partition by coalesce(text, '')) as low
  from documents
), l as (
  select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels where doc_id is not null group by doc_id
), m as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
    concat(
      case when len(ws) < 50 then 'A' else '' end,
      case when 100 * len(list_distinct(ws)) < 65 * len(ws) then 'B' else '' end,
      case when 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) then 'C' else '' end,
      case when regexp_matches(text, '[#$%&*|]') then 'D' else '' end,
      case when coalesce(doc_id > low, low is not null) then 'E' else '' end
    ) as fails
  from d left join l using (doc_id)
), c as (
  select part, fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from m group by part, fails
), x as (
  select unnest(['A', 'B', 'C', 'D', 'E']) as f
), o as (
  select a.f || b.f || c.f || d.f || e.f as filter_order from x a, x b, x c, x d, x e
  where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), s as (
  select part, filter_order, step, substr(filter_order, step, 1) as own, fails, n, good, toxic,
    translate(substr(filter_order, 1, step - 1), fails, '') <> substr(filter_order, 1, step - 1) as gone, contains(fails, substr(filter_order, step, 1)) as failing
  from c, o, (select unnest([1, 2, 3, 4, 5]) as step)
), r as (
  select part, filter_order, step, own,
    coalesce(sum(n) filter (not gone and not failing), 0) as kept, coalesce(sum(n) filter (not gone and failing), 0) as removed, coalesce(sum(n) filter (gone and failing), 0) as redundant,
    coalesce(sum(n) filter (fails = own), 0) as unique_fails, coalesce(sum(good) filter (not gone and failing), 0) as good_lost, coalesce(sum(toxic) filter (not gone and failing), 0) as toxic_lost
  from s group by all
)
select part, filter_order, step::integer as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
  good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, own))::bigint as shapley
from r
"""

OP12_SQL = f"""
with d as (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as ws
  from documents
), t as (
  select r, lang, source, translate(unnest(ws), '{UPPER}', '{UPPER.lower()}') as term from d
), k as (
  select lang, term from t group by lang, term having count(distinct r) >= 30
), c as (
  select lang, source, term, count(*) as n from t join k using (lang, term) group by all
), v as (
  select lang, count(*) as v from k group by lang
), g as (
  select distinct lang, source from d
), s as (
  select lang, source, (select coalesce(sum(n), 0) from c where c.lang = g.lang and c.source = g.source)::hugeint + 5 * coalesce((select v from v where v.lang = g.lang), 0) as size from g
), l as (
  select lang, term, 1 + (1000000000::hugeint * (sum(n) + 5)) // any_value(size) as q
  from c join (select lang, sum(n)::hugeint + 5 * any_value(v) as size from c join v using (lang) group by lang) using (lang) group by lang, term
), p as (
  select s.lang, s.source, k.term, coalesce(n, 0) as n, 1 + (1000000000::hugeint * (coalesce(n, 0) + 5)) // size as p
  from s join k using (lang) left join c on c.lang = s.lang and c.source = s.source and c.term = k.term
), f as (
  select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
), u as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value
  from g a join g b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source
  union all
  select lang, source, 'term', term, (p - q)::bigint from p join l using (lang, term) where n > 0 and p > q
), z as (
  select *, (row_number() over (partition by lang, source, part order by value desc, item))::integer as rank from u
)
select lang, source, part, item, value, rank from z where part = 'pair' or rank <= 50
"""
