"""Queries over the whole document set: packing, source divergence, manifest; and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, merkle, packing
from .common import table


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenised_pieces(table(spark, sf_dir, "documents"))
    digests = pieces.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"))
    return packing.packed_pieces(digests)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit_manifest(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op11_best_fit_packing, op12_source_divergence, op13_merkle_manifest)}

ORACLE = {
    "op12_source_divergence": r"""
with d as (
  select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as ws from documents
), kept as (
  select lang, term from (select lang, unnest(list_distinct(ws)) as term from d) group by all having count(*) >= 3
), seen as (
  select lang, source, term, count(*) as n from (select lang, source, unnest(ws) as term from d) semi join kept using (lang, term)
  group by all
), groups as (
  select lang, source, coalesce(n, 0) as total, coalesce(v, 0) as v
  from (select distinct lang, source from d) left join (select lang, source, sum(n)::hugeint as n from seen group by all) using (lang, source)
    left join (select lang, count(*) as v from kept group by lang) using (lang)
), shares as (
  select lang, source, term, coalesce(n, 0) as n, (1 + 1000000000::hugeint * (coalesce(n, 0) + 1) // (total + v))::hugeint as p
  from groups join kept using (lang) left join seen using (lang, source, term)
), whole as (
  select lang, term, (1 + 1000000000::hugeint * (s + 1) // (t + v))::hugeint as q
  from (select lang, term, sum(n)::hugeint as s from seen group by all) join (select lang, sum(total)::hugeint as t, any_value(v) as v from groups group by lang) using (lang)
), rows as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f, 0) as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source left join (
    select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as f
    from shares a join shares b on a.lang = b.lang and a.term = b.term group by all) s
    on s.lang = a.lang and s.source = a.source and s.item = b.source
  union all
  select lang, source, 'term', term, (p - q) * (p - q) // q from shares join whole using (lang, term) where n > 0 and p > q
)
select lang, source, part, item, value::bigint as value, rank::integer as rank from (
  select *, row_number() over (partition by lang, source, part order by value desc, encode(item)) as rank from rows)
where part = 'pair' or rank <= 200
""",
    "op13_merkle_manifest": r"""
with recursive crc as (
  select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: xor(c // 2, 3988292384 * (c % 2)))) as t
), d as (
  select doc_id, lang, n_chars,
    coalesce(strlen(doc_id::varchar) || ':' || doc_id::varchar, '-') || coalesce(strlen(source::varchar) || ':' || source::varchar, '-') || coalesce(strlen(lang::varchar) || ':' || lang::varchar, '-') as head, coalesce(strlen(text::varchar) || ':' || text::varchar, '-') as tail from documents
), leaves as (
  select doc_id, lang, sha256(head || coalesce(strlen(n_chars::varchar) || ':' || n_chars::varchar, '-') || tail) as leaf,
    case when n_chars is not null and xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)),
      lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1]))) % 7 = 0 then sha256(head || coalesce(strlen((n_chars::hugeint + 1)::varchar) || ':' || (n_chars::hugeint + 1)::varchar, '-') || tail) end as tampered from d, crc
), placed as (
  select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as p, count(*) over (partition by lang) as n
  from leaves
), nodes as (
  select coalesce('=' || lang, '-') as tree, 0 as level, p, leaf as h, n from placed
  union all
  select tree, level + 1, p // 2, sha256(string_agg(h, '' order by p)), (any_value(n) + 1) // 2
  from nodes where n > 1 group by tree, level, p // 2
), subroots as (
  select tree, h, row_number() over (order by tree) - 1 as p, count(*) over () as n from nodes where n = 1
), upper_nodes as (
  select 0 as level, p, h, n from subroots
  union all
  select level + 1, p // 2, sha256(string_agg(h, '' order by p)), (any_value(n) + 1) // 2
  from upper_nodes where n > 1 group by level, p // 2
), steps as (
  select tree, level, p, n, h, case when p % 2 = 1 then lag(h) over w else '' end as l, case when p % 2 = 0 then coalesce(lead(h) over w, '') else '' end as r
  from nodes window w as (partition by tree, level order by p)
), upper_steps as (
  select level, p, n, h, case when p % 2 = 1 then lag(h) over w else '' end as l, case when p % 2 = 0 then coalesce(lead(h) over w, '') else '' end as r
  from upper_nodes window w as (partition by level order by p)
), fold as (
  select doc_id, leaf, coalesce('=' || lang, '-') as tree, 0 as level, p, coalesce(tampered, leaf) as h, '' as proof from placed
  union all
  select doc_id, leaf, f.tree, f.level + 1, f.p // 2, sha256(s.l || f.h || s.r), f.proof || s.l || s.r
  from fold f join steps s on s.tree = f.tree and s.level = f.level and s.p = f.p where s.n > 1
), tops as (
  select doc_id, leaf, f.tree, f.h, f.proof, s.h as subroot
  from fold f join nodes s on s.tree = f.tree and s.level = f.level and s.p = f.p where s.n = 1
), upper_fold as (
  select doc_id, leaf, t.tree, 0 as level, u.p, t.h, t.proof, subroot from tops t join subroots u using (tree)
  union all
  select doc_id, leaf, tree, f.level + 1, f.p // 2, sha256(s.l || f.h || s.r), f.proof || s.l || s.r, subroot
  from upper_fold f join upper_steps s on s.level = f.level and s.p = f.p where s.n > 1
)
select doc_id, leaf, subroot, u.h as root, sha256(proof) as proof_sha256, f.h as folded_root, f.h = u.h as verified
from upper_fold f join upper_nodes u on u.level = f.level and u.p = f.p and u.n = 1
""",
}
