"""One query per operator, with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from histscore.llm import bitplanes, chat, divergence, mixing, orderhash, packing, quality, sharding, simhash, spelling, substring, tokencount, warc
from histscore.llm.common import table
from histscore.llm.registry import ORACLE, QUERIES, register


@register("op1_quality_rules")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality.score_documents(docs, trees)


MIX_SQL = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
    md5(coalesce(doc_id::varchar, '') || '|' || coalesce(text, '')) as k
  from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, [1, 2, 3][1 + (row_number() over (order by source nulls last) - 1) % 3] as weight from s),
r as (select *, sum(source_size) over () as total, sum(weight) over () as weights,
    coalesce(sum(3 * source_size) over (order by 3.0 * source_size / weight, source nulls last
      rows between unbounded preceding and 1 preceding), 0) as used,
    coalesce(sum(weight) over (order by 3.0 * source_size / weight, source nulls last
      rows between unbounded preceding and 1 preceding), 0) as gone
  from w),
l as (select max((total - used)::double / (weights - gone)::double) filter (
    (total - used)::double / (weights - gone)::double <= 3.0 * source_size / weight) as level from r),
t as (select source, source_size,
    case when level * weight > 3 * source_size then (3 * source_size)::double else level * weight end as target
  from w, l),
u as (select *, case when source_size > 0 then target / source_size else 0 end as rate from t),
c as (select d.doc_id, d.source, d.size, d.k, u.source_size, u.target, u.rate, seed,
    floor(u.rate)::bigint + case when ('0x' || substr(md5(d.k || seed::varchar), 1, 13))::bigint / 4503599627370496.0
      < u.rate - floor(u.rate) then 1 else 0 end as copies
  from d join u on d.source is not distinct from u.source, range(16) as z(seed)),
m as (select source, seed, abs(sum(size * copies) - any_value(target)) as off from c group by source, seed),
b as (select source, arg_min(seed, (off, seed)) as seed from m group by source)
select c.doc_id, c.source, c.size, c.source_size, c.target, c.copies, c.size * c.copies as taken
from c join b on c.source is not distinct from b.source and c.seed = b.seed
"""


@register("op2_mix_sources", MIX_SQL)
def op2(spark, sf_dir):
    return mixing.mix_counts(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


CHAT_SQL = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e as (select *,
    4 + length(regexp_replace(role, '([\\#<:])', '\\\1', 'g')) + 2
    + length(replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')) + 8 as chars
  from c)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(chars)::bigint as formatted_chars
from e group by conv_id
"""
#: The planted conversation -7.
TRICKY = "\\### Assistant: </turn> ok"


@register("op3_chat_format", CHAT_SQL)
def op3(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], "conv_id long, turn long, role string, text string")
    return chat.conversation_digest(chat.format_conversations(rows.unionByName(planted)))


@register("op4_simhash_dedup")
def op4(spark, sf_dir):
    groups = simhash.near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@register("op5_substring_dedup")
def op5(spark, sf_dir):
    return substring.removal_digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


SHARD_SQL = r"""
with d as (
  select doc_id, coalesce(strlen(text), 0) as bytes,
    ('0x' || substr(md5(coalesce(doc_id::varchar, 'null')), 1, 10))::bigint as code
  from documents),
e as (select d.*, k as depth, code >> (40 - k) as prefix,
    sum(bytes) over (partition by k, code >> (40 - k)) as shard_bytes,
    count(*) over (partition by k, code >> (40 - k)) as shard_docs
  from d, range(41) as z(k))
select doc_id, bytes,
  case when depth = 0 then '' else right(bin(prefix + (1::bigint << depth)), depth::int) end as shard,
  depth, shard_bytes::bigint as shard_bytes, shard_docs, shard_bytes > 1048576 as over_limit
from e where shard_bytes <= 1048576 or shard_docs = 1
qualify row_number() over (partition by doc_id order by depth) = 1
"""


@register("op6_extendible_sharding", SHARD_SQL)
def op6(spark, sf_dir):
    return sharding.assign_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))


@register("op7_bitplane_tokens")
def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bitplanes.read_token_files(bitplanes.write_token_files(docs))


@register("op8_differencing_packing")
def op8(spark, sf_dir):
    return packing.packed_digest(packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text")))


@register("op9_order_minhash")
def op9(spark, sf_dir):
    return orderhash.fingerprint_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))


WARC_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
g as (select html, max(page_id) as top, count(*) as n from p where strlen(html) >= 1000 group by html)
select p.page_id, strlen(p.html) as payload_bytes, sha1(p.html) as payload_digest,
  case when g.n > 1 and p.page_id <> g.top then 'revisit' else 'response' end as record_type,
  case when g.n > 1 and p.page_id <> g.top then g.top end as refers_to
from p left join g on p.html = g.html
"""


@register("op10_warc_bundles", WARC_SQL)
def op10(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.read_bundles(warc.write_bundles(warc.decide_records(pages)))


@register("op11_spelling_variants")
def op11(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


@register("op12_token_counts")
def op12(spark, sf_dir):
    return tokencount.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))


AUDIT_SQL = r"""
with d as (select coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source,
    row_number() over () as doc from documents),
t as (select lang, source, doc, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from d),
c as (select lang, source, term, count(*) as n, count(distinct doc) as docs from t group by all),
k as (select lang, term, sum(n)::hugeint as n from c group by all having sum(docs) >= 30),
g as (select distinct lang, source from d),
v as (select lang, count(term) as v from (select distinct lang from g) left join k using (lang) group by lang),
s as (select g.lang, g.source, coalesce(sum(c.n) filter (k.term is not null), 0)::hugeint as size
  from g left join c on g.lang = c.lang and g.source = c.source left join k on c.lang = k.lang and c.term = k.term group by all),
p as (select s.lang, s.source, k.term, coalesce(c.n, 0) as n,
    1 + 1000000000::hugeint * (coalesce(c.n, 0) + 5) // (s.size + 5 * v.v) as p
  from s join k using (lang) join v using (lang) left join c on c.lang = s.lang and c.source = s.source and c.term = k.term),
q as (select lang, k.term, 1 + 1000000000::hugeint * (k.n + 5) // (sum(k.n) over (partition by lang) + 5 * v.v) as q
  from k join v using (lang)),
pairs as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
  union all select a.lang, a.source, b.source, 0
  from g a join g b on a.lang = b.lang and a.source <> b.source join v on a.lang = v.lang where v.v = 0),
terms as (select p.lang, p.source, p.term as item, p.p - q.q as value
  from p join q on p.lang = q.lang and p.term = q.term where p.n > 0 and p.p > q.q),
r as (select 'pair' as part, * from pairs union all select 'term' as part, * from terms)
select lang, source, part, item, value::bigint as value,
  (row_number() over (partition by lang, source, part order by value desc, item))::int as rank
from r qualify part = 'pair' or rank <= 50
"""


@register("op13_source_divergence", AUDIT_SQL)
def op13(spark, sf_dir):
    return divergence.audit_sources(table(spark, sf_dir, "documents").select("text", "lang", "source"))


def llm_queries() -> dict:
    return dict(QUERIES)


def llm_oracle() -> dict[str, str]:
    return dict(ORACLE)
