"""The registered queries of the operators in this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import chat, exact, hamming, licences, minhash, mixing, pieces, suffix_tree, toxic, urls


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sampled_segmentations(spark, sf_dir):
    return pieces.sample_segmentations(_table(spark, sf_dir, "documents"), with_ids=False)


def op2_suffix_tree(spark, sf_dir):
    return suffix_tree.score_texts(_table(spark, sf_dir, "documents"), held_out=suffix_tree.held_out())


def op3_chat_perspectives(spark, sf_dir):
    out = chat.perspectives(_table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("masks", lambda m: F.concat_ws("-", m["start"].cast("string"), m["end"].cast("string"))), ",")
    return out.select("conv_id", "participant", "block", "n_turns", "char_offset", "text", spans.alias("masks"), "mask_chars")


def op4_near_groups(spark, sf_dir):
    return minhash.near_groups(_table(spark, sf_dir, "documents"))


def op5_nearest(spark, sf_dir):
    return hamming.nearest(_table(spark, sf_dir, "embeddings"))


def op6_url_filter(spark, sf_dir):
    out = urls.judge_urls(_table(spark, sf_dir, "pages"))
    return out.select("page_id", "host", "path", "rule", "verdict")


def op7_exact_dedup(spark, sf_dir):
    return exact.exact_groups(_table(spark, sf_dir, "documents"))


def op8_license_scan(spark, sf_dir):
    return licences.scan(_table(spark, sf_dir, "documents")).drop("matches")


def op9_toxicity(spark, sf_dir):
    out = toxic.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted", F.size("passages").cast("long").alias("n_passages"))


def op10_pfair_mix(spark, sf_dir):
    return mixing.mix(_table(spark, sf_dir, "documents"))


def queries():
    return {
        f.__name__: f
        for f in (
            op1_sampled_segmentations,
            op2_suffix_tree,
            op3_chat_perspectives,
            op4_near_groups,
            op5_nearest,
            op6_url_filter,
            op7_exact_dedup,
            op8_license_scan,
            op9_toxicity,
            op10_pfair_mix,
        )
    }


def _licence_sql():
    """The licence scan in SQL: places where the mandatory phrases stand, and the share of the template's IDF mass that stands around them."""
    rows = []
    for k, (label, text, phrases) in enumerate(licences.TEMPLATES):
        must = {at + j for at, q in licences._places(text.split(), phrases) for j in range(len(q))}
        rows.append(f"({k}, '{label}', string_split('{text}', ' '), [{', '.join(map(str, sorted(must)))}])")
    base = ", ".join(f"('{label}', string_split('{phrase}', ' '))" for phrase, label in licences.BASE)
    return f"""
with d as (
  select row_number() over () as rid, doc_id,
         trim(regexp_replace(translate(coalesce(text, ''), '{licences.UPPER}', '{licences.LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' ') as plain from documents),
w as (select rid, doc_id, case when plain = '' then [] else string_split(plain, ' ') end as words from d),
p as (select rid, unnest(words) as word, unnest(range(len(words))) as i from w),
t(k, label, words, must) as (values {', '.join(rows)}),
tw as (select k, unnest(words) as word, unnest(range(len(words))) as j from t),
m as (select tw.* from tw join t using (k) where list_contains(t.must, tw.j)),
idf as (
  select v.word, ln((1.0::DOUBLE + (select count(*) from d)) / (1.0::DOUBLE + count(distinct p.rid))) + 0.001::DOUBLE as mass
  from (select distinct word from tw) v left join p using (word) group by v.word),
cand as (select distinct p.rid, m.k, p.i - m.j as o from p join m using (word) where (m.k, m.j) in (select (k, min(j)) from m group by k)),
ok as (
  select c.rid, c.k, c.o from cand c join m using (k) join p on p.rid = c.rid and p.i = c.o + m.j and p.word = m.word
  group by c.rid, c.k, c.o having count(*) = (select len(must) from t where t.k = c.k)),
share as (
  select ok.rid, ok.k, ok.o, least(round(sum(case when p.word = tw.word then idf.mass else 0 end) / sum(idf.mass), 6), 1.0::DOUBLE) as share
  from ok join tw using (k) join idf on idf.word = tw.word left join p on p.rid = ok.rid and p.i = ok.o + tw.j group by ok.rid, ok.k, ok.o),
b(label, words) as (values {base}),
bw as (select label, unnest(words) as word, unnest(range(len(words))) as j, len(words) as n from b),
bp as (select p.rid, bw.label, p.i - bw.j as place from p join bw using (word) group by p.rid, bw.label, p.i - bw.j having count(*) = any_value(bw.n)),
labels as (select rid, label from bp union select share.rid, t.label from share join t using (k))
select w.doc_id, cast(len(w.words) as bigint) as n_words,
       (select count(*) from bp where bp.rid = w.rid) as n_base,
       (select cast(min(place) as bigint) from bp where bp.rid = w.rid) as first_word,
       (select cast(max(place) as bigint) from bp where bp.rid = w.rid) as last_word,
       coalesce((select string_agg(distinct label, ',' order by label) from bp where bp.rid = w.rid), '') as base_labels,
       coalesce((select string_agg(distinct label, ',' order by label) from labels l where l.rid = w.rid), '') as labels,
       coalesce((select max(share) from share s where s.rid = w.rid), 0.0::DOUBLE) as score
from w"""


#: The schedule slot by slot: of the released blocks the earliest deadline first. Weights are whole multiples of 2 ** -49.
MIX_SQL = """
with recursive src as (
  select source, count(*) as n, cast(ceil(count(*) / 16) as bigint) as blocks, cast(pow(count(*), 0.5) * pow(2, 49) as hugeint) as w
  from documents group by source),
a as (
  select list(source order by source nulls last) as names, list(blocks order by source nulls last) as blocks, list(w order by source nulls last) as w,
         list(0::bigint order by source nulls last) as zeros, sum(blocks)::bigint as slots from src),
st as (
  select 0::bigint as slot, 0 as phase, 0::bigint as t0, zeros as done, zeros as base, null::bigint as took, null::bigint as block, null::bigint as release, null::bigint as deadline, null::int as in_phase from a
  union all
  select slot + 1, case when done[pick] + 1 = blocks[pick] then phase + 1 else phase end,
         case when done[pick] + 1 = blocks[pick] then slot + 1 else t0 end, now,
         case when done[pick] + 1 = blocks[pick] then now else base end, pick, done[pick],
         cast((done[pick] - base[pick]) * size // w[pick] as bigint), cast(((done[pick] - base[pick] + 1) * size + w[pick] - 1) // w[pick] as bigint), phase
  from (
    select *, list_transform(range(1, len(done) + 1), lambda k: done[k] + case when k = pick then 1 else 0 end) as now
    from (
      select *, list_sort(list_transform(list_filter(range(1, len(done) + 1), lambda k: done[k] < blocks[k] and (done[k] - base[k]) * size // w[k] <= slot - t0),
               lambda k: {'due': ((done[k] - base[k] + 1) * size + w[k] - 1) // w[k], 'k': k}))[1].k as pick
      from (select st.*, a.blocks, a.w, a.slots, list_sum(list_transform(range(1, len(a.w) + 1), lambda k: case when st.base[k] < a.blocks[k] then a.w[k] else 0 end))::hugeint as size from st, a)
      where slot < slots))),
b as (select a.names[took] as source, block, in_phase as phase, slot - 1 as slot, release, deadline from st, a where took is not null),
h as (select doc_id, source, cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) as h from documents),
r as (
  select doc_id, source, row_number() over (partition by source order by (h >> 8) % (select greatest(1, cast(ceil(count(*) / 4096) as bigint)) from documents), h, doc_id nulls last) - 1 as number from h)
select r.doc_id, r.source, b.block, b.phase, b.slot, b.release, b.deadline, b.slot * 16 + r.number % 16 as position
from r join b on r.source is not distinct from b.source and r.number // 16 = b.block"""


#: Links of shingle sets by counting shared shingles, and everything that can be reached over them.
NEAR_SQL = """
with recursive d as (
  select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as words from documents),
s as (
  select rid, doc_id, list_distinct(case when len(words) = 0 then [] when len(words) < 5 then [array_to_string(words, ' ')]
         else list_transform(range(len(words) - 4), lambda i: array_to_string(words[i + 1 : i + 5], ' ')) end) as grams from d),
g as (select rid, len(grams) as n, unnest(grams) as gram from s),
pairs as (select a.rid as a, b.rid as b, count(*) as shared, any_value(a.n) as na, any_value(b.n) as nb from g a join g b on a.gram = b.gram and a.rid < b.rid group by a.rid, b.rid),
links as (select a, b from pairs where 100 * shared >= 75 * (na + nb - shared)),
edges as (select a, b from links union all select b, a from links),
reach as (select rid, rid as other from s union select reach.rid, edges.b from reach join edges on edges.a = reach.other),
low as (select reach.rid, min(s.doc_id) as component_id from reach join s on s.rid = reach.other group by reach.rid)
select s.doc_id, cast(len(s.grams) as bigint) as n_shingles, low.component_id, s.doc_id is not distinct from low.component_id as kept from s join low using (rid)"""


def oracle_sql():
    return {
        "op4_near_groups": NEAR_SQL,
        "op10_pfair_mix": MIX_SQL,
        "op8_license_scan": _licence_sql(),
        "op3_chat_perspectives": """
with t as (
  select conv_id, cast(turn as bigint) as turn, case when coalesce(trim(role), '') = '' then 'unknown' else role end as role,
         replace(coalesce(text, ''), '<|', '<\\|') as text, coalesce(cast(floor(turn / 256) as bigint), -1) as block
  from conversations),
v as (
  select t.*, p.participant, t.role = p.participant as own,
         case when t.role = p.participant then '<|im_start|>assistant' || chr(10)
              when t.role = 'system' then '<|im_start|>system' || chr(10)
              else '<|im_start|>user name=' || replace(t.role, '<|', '<\\|') || chr(10) end as head
  from t join (select distinct conv_id, role as participant from t where role <> 'system') p
    on t.conv_id is not distinct from p.conv_id),
w as (select *, head || text || '<|im_end|>' || chr(10) as seg from v),
x as (
  select *, sum(length(seg)) over o as upto, row_number() over o as pos
  from w window o as (partition by conv_id, participant order by turn nulls first, role, text rows unbounded preceding))
select conv_id, participant, block, count(*) as n_turns, cast(min(upto - length(seg)) as bigint) as char_offset,
       string_agg(seg, '' order by pos) as text,
       coalesce(string_agg(cast(upto - length(seg) + length(head) as bigint) || '-' || cast(upto - 1 as bigint), ',' order by pos) filter (where own), '') as masks,
       cast(coalesce(sum(length(seg) - length(head) - 1) filter (where own), 0) as bigint) as mask_chars
from x group by conv_id, participant, block""",
        "op6_url_filter": """
with u as (
  select page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) as path
  from pages),
r(verdict, host, path) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
j as (
  select row_number() over () as id, u.* from u),
m as (
  select j.id, arg_max(r.host || r.path, length(r.host || r.path)) as rule, arg_max(r.verdict, length(r.host || r.path)) as verdict
  from j join r on (j.host = r.host or ends_with(j.host, '.' || r.host)) and starts_with(j.path, r.path) group by j.id)
select j.page_id, j.host, j.path, m.rule, coalesce(m.verdict, case when j.host = '' then 'block' else 'allow' end) as verdict
from j left join m on j.id = m.id""",
        "op7_exact_dedup": """
with d as (
  select doc_id, length(coalesce(text, '')) as points, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') as plain from documents)
select doc_id, first_value(doc_id) over o as keep_id, count(*) over (partition by plain) as group_size,
       row_number() over o = 1 as kept, sha256(plain) as text_sha256
from d window o as (partition by plain order by points desc, doc_id nulls last rows between unbounded preceding and unbounded following)""",
    }
