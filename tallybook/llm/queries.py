"""Queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.session import shared_folder

from . import decontaminate, licenses, lines, mixing, ngram_join, quality, set_queries, shards, substrings, url_rules, warc
from .common import table

URL_RULES = [
    url_rules.rule("allow", "com/"),
    url_rules.rule("block", "example.com/en/"),
    url_rules.rule("allow", "www.example.com/en/"),
    url_rules.rule("block", "net/es/"),
    url_rules.rule("block", "net/fr/"),
]
SHARDS = 16
DOMAIN_WEIGHTS = {"good": 0.9, "low": 0.1, "toxic": 0.0}
QUALITY_COLUMNS = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept".split()


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents")).select(*QUALITY_COLUMNS)


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    return found.withColumn("containment", F.round("containment", 6))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return removed.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(
        "page_id", url_rules.host_of(F.col("url")).alias("host"), lines.html_lines(F.col("html")).alias("lines")
    )
    digest = F.sha2(F.array_join("kept_lines", "\n"), 256).alias("kept_sha256")
    return lines.drop_boilerplate(pages).select("page_id", "host", "n_lines", "n_dropped", digest)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shards.shard_documents(documents, [1.0] * SHARDS, [1.0] * (SHARDS + 1))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return mixing.mixing_rates(documents, labels, DOMAIN_WEIGHTS)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    index = warc.archive_index(pages, shared_folder(spark, "warc"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("similarity", F.round("similarity", 6))


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_quality_rules, op3_url_filters, op4_license_scans, op5_substring_dedup, op6_line_dedup, op7_sharding, op8_source_mixing, op9_warc, op10_benchmark_decontamination)}
QUERIES |= set_queries.QUERIES

WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
HOST = """case when instr(coalesce(url, ''), '://') > 0 then translate(
  regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz') else '' end"""
TEMPLATES = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in licenses.TEMPLATES.items())
LISTS = ", ".join(
    f"('{lang}', {i}, '{word}')" for lang, words in quality.COMMON_WORDS.items() for i, word in enumerate(words)
)

ORACLE = {
    "op1_ngram_jaccard_join": r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents
), s as (
  select distinct doc_id, array_to_string(ws[i:i + 4], ' ') as g
  from w, unnest(range(1, greatest(len(ws) - 3, 2))) as x(i) where len(ws) > 0
), n as (
  select doc_id, count(*) as n from s group by doc_id
), links as (
  select a.doc_id as a, b.doc_id as b from s a join s b using (g) join n x on x.doc_id = a.doc_id join n y on y.doc_id = b.doc_id
  where a.doc_id <> b.doc_id group by a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= 75 * (x.n + y.n - count(*))
), reach(doc_id, c) as (
  select doc_id, doc_id from documents union select links.b, reach.c from reach join links on links.a = reach.doc_id
)
select d.doc_id, coalesce(n.n, 0) as n_shingles, r.c as component_id
from documents d left join n using (doc_id) left join (select doc_id, min(c) as c from reach group by doc_id) r using (doc_id)
""",
    "op2_quality_rules": rf"""
with d as (
  select doc_id, case when lang in ('en', 'de', 'es', 'fr') then lang else '' end as lang, coalesce(text, '') as t
  from documents
), w as (
  select *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws,
    regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g') as rest,
    regexp_replace(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'), '[\p{{Ll}}\p{{Lm}}\p{{Lo}}\p{{M}}]+', '', 'g') as letters
  from d
), win as (
  select doc_id, i, array_to_string(ws[i:i + 7], ' ') as s from w, unnest(range(1, len(ws) - 6)) as x(i)
), twice as (
  select doc_id, i from (select *, count(*) over (partition by doc_id, s) as c from win) where c > 1
), cover as (
  select doc_id, sum(least(8, coalesce(after - i, 8))) as n
  from (select doc_id, i, lead(i) over (partition by doc_id order by i) as after from twice) group by doc_id
), lines as (
  select doc_id, count(*) - count(distinct line) as n
  from (select doc_id, unnest(string_split(t, chr(10))) as line from d)
  where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id
), m as (
  select w.doc_id, w.lang, len(ws) as n_words, length(rest) as word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols, coalesce(lines.n, 0) as n_dup_lines,
    coalesce(cover.n, 0) as n_repeat_words, length(letters) as l,
    length(letters) - length(regexp_replace(letters, '[\p{{Lu}}\p{{Lt}}]', '', 'g')) as upper,
    length(letters) - length(regexp_replace(letters, '\p{{Nd}}', '', 'g')) as digit,
    length(letters) - length(regexp_replace(letters, '\p{{P}}', '', 'g')) as punct
  from w left join cover using (doc_id) left join lines using (doc_id)
), f as (
  select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m
), listed(lang, bin, word) as (values {LISTS}
), seen as (
  select doc_id, lang, lower(x) as word, count(*) as n from (select doc_id, lang, unnest(ws) as x from w) group by all
), words as (
  select f.doc_id, f.lang, base_failed, n_words, bin, coalesce(n, 0) as n
  from f join listed using (lang) left join seen on seen.doc_id = f.doc_id and seen.word = listed.word
), words1 as (
  select doc_id, lang, base_failed, n_words, bin, n from words
  union all select doc_id, lang, any_value(base_failed), any_value(n_words), -1, any_value(n_words) - sum(n)
  from words group by doc_id, lang
), ref_words as (
  select lang, bin, sum(n) / sum(n_words) as q from words1 where not base_failed group by lang, bin
), classes as (
  select doc_id, lang, base_failed, word_chars, unnest(['lower', 'upper', 'digit', 'punct', 'other']) as bin,
    unnest([word_chars - l, upper, digit, punct, l - upper - digit - punct]) as n from f
), ref_classes as (
  select lang, bin, sum(n) / sum(word_chars) as q from classes where not base_failed group by lang, bin
), word_js as (
  select doc_id, any_value(n_words) as size, sqrt(greatest(0, sum(
    case when p > 0 then p * log2(2 * p / (p + q)) else 0 end + case when q > 0 then q * log2(2 * q / (p + q)) else 0 end) / 2)) as js
  from (select doc_id, n_words, n / n_words as p, q from words1 join ref_words using (lang, bin) where n_words >= 60)
  group by doc_id
), class_js as (
  select doc_id, any_value(word_chars) as size, sqrt(greatest(0, sum(
    case when p > 0 then p * log2(2 * p / (p + q)) else 0 end + case when q > 0 then q * log2(2 * q / (p + q)) else 0 end) / 2)) as js
  from (select doc_id, word_chars, n / word_chars as p, q from classes join ref_classes using (lang, bin) where word_chars >= 200)
  group by doc_id
)
select f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and coalesce(c.js <= {quality.MAX_CLASS_DISTANCE} + 2 * sqrt({len(quality.CLASSES) - 1} / (8 * ln(2)) / c.size), true)
    and coalesce(v.js <= {quality.MAX_WORD_DISTANCE} + 1.25 * sqrt({quality.BINS} / (8 * ln(2)) / v.size), true) as kept
from f left join class_js c using (doc_id) left join word_js v using (doc_id)
""",
    "op5_substring_dedup": rf"""
with w as (
  select doc_id, {WORDS} as ws from documents
), win as (
  select doc_id, i, array_to_string(ws[i:i + 34], ' ') as s from w, unnest(range(1, len(ws) - 33)) as x(i)
), twice as (
  select doc_id, i from (select *, count(*) over (partition by s) as c from win) where c > 1
), gone as (
  select distinct doc_id, i + k as j from twice, unnest(range(0, 35)) as y(k)
), kept as (
  select doc_id, j, ws[j] as x from w, unnest(range(1, len(ws) + 1)) as z(j)
  where (doc_id, j) not in (select doc_id, j from gone)
), texts as (
  select doc_id, count(*) as n, string_agg(x, ' ' order by j) as t from kept group by doc_id
)
select w.doc_id, len(ws) as n_words, len(ws) - coalesce(n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from w left join texts using (doc_id)
""",
    "op6_line_dedup": rf"""
with texts as (
  select page_id, {HOST} as host, regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
    '{lines.HIDDEN}', chr(10), 'g'), '{lines.BLOCKS}', chr(10), 'g'), '{lines.TAGS}', '', 'g') as t from pages
), p as (
  select page_id, host, list_filter(list_transform(string_split_regex(t, '[\n\r]+'), lambda x: trim(x, ' ' || chr(9))),
    lambda x: x <> '') as lines from texts
), counts as (
  select host, line, count(*) as n from (select host, unnest(list_distinct(lines)) as line from p where host <> '') group by all
), frequent as (
  select host, list(line) as frequent from counts join (select host, count(*) as total from p group by host) using (host)
  where n >= {lines.MIN_PAGES} and n > {lines.MAX_RATIO} * total group by host
), k as (
  select page_id, host, lines, list_filter(lines, lambda x: not coalesce(list_contains(frequent, x), false)) as kept
  from p left join frequent using (host)
)
select page_id, host, len(lines) as n_lines, len(lines) - len(kept) as n_dropped,
  sha256(coalesce(array_to_string(kept, chr(10)), '')) as kept_sha256 from k
""",
    "op10_benchmark_decontamination": r"""
with i as (
  select item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from benchmark
), d as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents
), ig as (
  select item_id, array_to_string(ws[k:k + 4], ' ') as g, count(*) as n
  from i, unnest(range(1, greatest(len(ws) - 3, 2))) as x(k) where len(ws) > 0 group by all
), weight as (
  select g, 1 + floor(log2((select count(*) from i where len(ws) > 0) / count(*))) as w from ig group by g
), heavy as (
  select 1 + floor(log2(count(*))) as w from i where len(ws) > 0
), dg as (
  select doc_id, len(ws) as n, k, array_to_string(ws[k:k + 4], ' ') as g
  from d, unnest(range(1, greatest(len(ws) - 3, 2))) as x(k) where len(ws) > 0
), near as (
  select distinct doc_id, item_id, dg.n as n, len(i.ws) as m, s
  from dg join ig using (g) join i using (item_id),
    unnest(range(greatest(1, k - greatest(len(i.ws) - 5, 0)), greatest(1, least(k, dg.n - len(i.ws) + 1)) + 1)) as x(s)
), wg as (
  select doc_id, item_id, s, g, count(*) as n from (
    select doc_id, item_id, s, array_to_string(ws[k:least(k + 4, s + m - 1)], ' ') as g
    from near join d using (doc_id), unnest(range(s, greatest(least(s + m, near.n + 1) - 4, s + 1))) as x(k)) group by all
), paired as (
  select coalesce(wg.doc_id, e.doc_id) as doc_id, coalesce(wg.item_id, e.item_id) as item_id, coalesce(wg.s, e.s) as s,
    coalesce(wg.g, e.g) as g, coalesce(wg.n, 0) as a, coalesce(e.n, 0) as b
  from wg full join (select doc_id, item_id, s, g, ig.n as n from near join ig using (item_id)) e
    on wg.doc_id = e.doc_id and wg.item_id = e.item_id and wg.s = e.s and wg.g = e.g
), scored as (
  select doc_id, item_id, s, sum(coalesce(weight.w, heavy.w) * least(a, b)) as common, sum(coalesce(weight.w, heavy.w) * greatest(a, b)) as united
  from paired left join weight using (g) cross join heavy group by all
)
select doc_id, item_id, cast(s - 1 as integer) as start, round(common / united, 6) as similarity from (
  select *, row_number() over (partition by doc_id, item_id order by common / united desc, s) as r
  from scored where 100 * common >= 75 * united) where r = 1
""",
    "op9_warc": """
with p as (
  select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as x from pages
), d as (
  select page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr(
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    cast((cast('0x' || substr(x, 10 * (i // 8) + 1, 10) as bigint) >> (35 - 5 * (i % 8))) & 31 as integer) + 1, 1)), '') as payload_digest
  from p
), f as (
  select *, min(page_id) over (partition by payload_digest) as one from d
)
select page_id, payload_bytes, payload_digest, case when page_id = one then 'response' else 'revisit' end as record_type,
  case when page_id <> one then one end as refers_to from f
""",
    "op4_license_scans": rf"""
with t as (
  select license, list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') as ws
  from (values {TEMPLATES}) as v(license, text)
), tg as (
  select distinct license, least(len(ws), 5) as k, array_to_string(ws[i:i + least(len(ws), 5) - 1], ' ') as g
  from t, unnest(range(1, greatest(len(ws) - 3, 2))) as x(i)
), sized as (
  select license, any_value(k) as k, count(*) as n from tg group by license
), roomy as (
  select license, k, n, (select min(c) from (values (1), (2), (3), (4), (6), (8), (12), (16), (24), (32), (48), (64), (96),
    (128), (192), (256)) as r(c) where c >= n) as c from sized
), d as (
  select doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') as ws
  from documents
), dg as (
  select doc_id, k, i - 1 as p, array_to_string(ws[i:i + k - 1], ' ') as g
  from d, (select distinct k from sized) as ks, unnest(range(1, len(ws) - k + 2)) as x(i)
), hits as (
  select distinct doc_id, license, c, n, p, g, greatest(1, c // 2) as s from dg join tg using (k, g) join roomy using (license)
), held as (
  select doc_id, license, n, w * s as start, count(distinct g) as held
  from hits, unnest(range(greatest(0, (p - c) // s), p // s + 1)) as y(w)
  where w * s <= p and p < w * s + c + s group by all
)
select doc_id, license, round(max(held / n), 6) as containment, cast(arg_max(start, (held / n, -start)) as integer) as start
from held where 100 * held >= 75 * n group by doc_id, license
""",
    "op3_url_filters": r"""
with parsed as (
  select page_id, coalesce(url, '') as u, instr(coalesce(url, ''), '://') as spot from pages
), places as (
  select page_id,
    case when spot > 0 then translate(regexp_extract(substr(u, spot + 3), '^[^/?#]*'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end as host,
    case when spot > 0 then regexp_extract(substr(u, spot + 3), '^[^/?#]*([^?#]*)', 1) else '' end as path
  from parsed
), rules(rule, h, p, verdict) as (
  values ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
    ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'),
    ('net/fr/', 'net', '/fr/', 'block')
), best as (
  select page_id, host, path, r.rule, r.verdict,
    row_number() over (partition by page_id, host, path order by length(r.h) desc, length(r.p) desc) as n
  from places left join rules r on (host = r.h or ends_with(host, '.' || r.h)) and starts_with(path, r.p)
)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from best where n = 1
""",
}
ORACLE |= set_queries.ORACLE
