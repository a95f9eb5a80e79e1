"""The numbered queries over whole tables, and their SQL twins where SQL can say it."""

from __future__ import annotations

import public_tokenizers

from caseloom.llm import (
    chat, decontaminate, exact, filter_audit, fuzzy_lines, language, licenses, main_text, mixing, secret_scan,
    simhash, structure_repair, token_files,
)
from caseloom.llm.tables import read

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

QUERIES = {}
ORACLES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op2_simhash_near_duplicates(spark, sf_dir):
    return simhash.simhash_near_duplicates(read(spark, sf_dir, "documents"))


@query
def op3_benchmark_decontamination(spark, sf_dir):
    return decontaminate.benchmark_overlap(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


ORACLES["op3_benchmark_decontamination"] = r"""
with docs as materialized (select doc_id, text, row_number() over () as k from documents),
lowered as (
  select 'd' as kind, '' as id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t, k from docs
  union all
  select 'b', item_id::varchar, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 0 from benchmark),
words as (select kind, id, k, coalesce(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from lowered),
sized as (select *, least(13, len(w)) as size from words where kind = 'b' and len(w) > 0),
item_windows as (select distinct id, size, array_to_string(w[p + 1:p + size], ' ') as passage from (select *, unnest(range(len(w) - size + 1)) as p from sized)),
doc_windows as (
  select k, p, size, array_to_string(w[p + 1:p + size], ' ') as passage
  from (select k, w, size, unnest(range(len(w) - size + 1)) as p from words, (select distinct size from sized) where kind = 'd' and len(w) >= size)),
found as (select d.k, d.p, d.size, i.id from doc_windows d join item_windows i using (size, passage)),
hit as (select k, count(distinct pos) as n_hit from (select k, unnest(range(p, p + size)) as pos from (select distinct k, p, size from found)) group by k),
items as (select k, count(*) as n_items, sha256(string_agg(id, ',' order by id)) as items_sha256 from (select distinct k, id from found) group by k)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, coalesce(items_sha256, sha256('')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from words join docs d using (k) left join hit using (k) left join items using (k)
where kind = 'd'
"""


@query
def op4_exact_dedup(spark, sf_dir):
    return exact.exact_duplicates(read(spark, sf_dir, "documents"), exact.new_index(spark))


ORACLES["op4_exact_dedup"] = r"""
select doc_id, first_value(doc_id) over (partition by text_sha256 order by chars desc, doc_id) as keep_id,
       count(*) over (partition by text_sha256) as group_size,
       row_number() over (partition by text_sha256 order by chars desc, doc_id) = 1 as kept, text_sha256
from (select doc_id, length(coalesce(text, '')) as chars,
             sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256
      from documents)
"""


@query
def op5_language_id(spark, sf_dir):
    return language.predicted_languages(read(spark, sf_dir, "documents"))


@query
def op9_source_mixing(spark, sf_dir):
    return mixing.mixed_documents(read(spark, sf_dir, "documents"))


@query
def op8_token_output(spark, sf_dir):
    return token_files.token_output(read(spark, sf_dir, "documents"), TOKENIZER)


@query
def op6_line_dedup(spark, sf_dir):
    return fuzzy_lines.fuzzy_line_dedup(read(spark, sf_dir, "documents"), radius=None)


@query
def op10_chat_formatting(spark, sf_dir):
    return chat.repaired_turns(read(spark, sf_dir, "conversations"))


@query
def op1_license_scan(spark, sf_dir):
    return licenses.license_scan(read(spark, sf_dir, "documents"))


@query
def op7_secret_scan(spark, sf_dir):
    return secret_scan.secret_scan(read(spark, sf_dir, "documents"))


@query
def op11_main_text(spark, sf_dir):
    return main_text.extracted_texts(read(spark, sf_dir, "pages"), main_text.trained_field())


# What these pages hold, told without the field: their articles are titles and paragraphs and nothing else.
ORACLES["op11_main_text"] = r"""
with articles as (
  select page_id, url, regexp_split_to_array(regexp_replace(regexp_replace(
           regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|<[^<>]*$|$)', 1), '</?b>', '', 'g'), '<br>', ' ', 'g'), '</?(?:p|h1)>') as parts
  from pages),
texts as (
  select page_id, url, array_to_string(list_filter(list_transform(parts, lambda x: trim(regexp_replace(regexp_replace(replace(x, '&quot;', '"'), '&amp;?', '&', 'g'),
           '\s+', ' ', 'g'), ' ')), lambda x: x <> ''), chr(10) || chr(10)) as text
  from articles)
select page_id, url, text, length(text) as n_chars from texts
"""


@query
def op12_conversation_repair(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations")
    return structure_repair.conversation_audit(turns, structure_repair.damaged_turns(turns))


ORACLES["op12_conversation_repair"] = r"""
with recursive moves(state, edit, initial, next, cost, ins, role) as (values
  ('', 'K', 's', 's', 0, null, null), ('', 'K', 'u', 'u', 0, null, null), ('s', 'K', 'u', 'u', 0, null, null),
  ('u', 'K', 'a', 'a', 0, null, null), ('a', 'K', 'u', 'u', 0, null, null),
  ('', 'R', null, 'u', 3, null, 'user'), ('s', 'R', null, 'u', 3, null, 'user'), ('u', 'R', null, 'a', 3, null, 'assistant'), ('a', 'R', null, 'u', 3, null, 'user'),
  ('', 'IK', 'a', 'a', 3, 'user', null), ('s', 'IK', 'a', 'a', 3, 'user', null), ('u', 'IK', 'u', 'u', 3, 'assistant', null), ('a', 'IK', 'a', 'a', 3, 'user', null),
  ('', 'IR', null, 'a', 6, 'user', 'assistant'), ('s', 'IR', null, 'a', 6, 'user', 'assistant'), ('u', 'IR', null, 'u', 6, 'assistant', 'user'),
  ('a', 'IR', null, 'a', 6, 'user', 'assistant'),
  ('', 'D', null, '', 4, null, null), ('s', 'D', null, 's', 4, null, null), ('u', 'D', null, 'u', 4, null, null), ('a', 'D', null, 'a', 4, null, null)),
endings(state, cost, inserts, roles) as (values ('', 0, '', []::varchar[]), ('s', 6, 'II', ['user:', 'assistant:']), ('u', 3, 'I', ['assistant:']), ('a', 0, '', [])),
spaced as (
  select conv_id, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as name, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text
  from conversations),
names as (select distinct name from spaced),
crc(name, bits, c) as (       -- bit by bit, eight steps to a character of the name
  select name, 0, 4294967295::bigint from names
  union all
  select name, bits + 1, xor(x >> 1, case when x & 1 = 1 then 3988292384::bigint else 0 end)
  from (select name, bits, case when bits % 8 = 0 then xor(c, ascii(name[bits // 8 + 1])::bigint) else c end as x from crc where bits < 8 * length(name))),
marks as (select name, xor(c, 4294967295::bigint) % 20 as mark from crc where bits = 8 * length(name)),
damaged as (
  select conv_id, turn, if(mark = 4, 'user', role) as role,
         case mark when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(if(mark = 3, 2, 1))) as copy
  from spaced join marks using (name) where mark <> 0),
placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as n from damaged),
told as (
  select *, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'b' when row_number() over (partition by conv_id, role, text order by n) > 1 then 'd'
                 when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') then 't' else '' end as fault,
         lag(left(role, 1)) over (partition by conv_id order by n) || left(role, 1) as pair
  from placed),
ids as (select distinct conv_id from conversations),
walk(conv_id, n, state, cost, audit, lines) as (
  select conv_id, 0::bigint, '', 0, '', []::varchar[] from ids
  union all
  select w.conv_id, t.n, m.next, w.cost + m.cost + if(fault = 't' and edit <> 'D', 3, 0), audit || edit,
         list_concat(lines, list_concat(if(ins is null, []::varchar[], [ins || ':']), if(edit = 'D', []::varchar[], [coalesce(m.role, t.role) || ':' || text])))
  from walk w join told t on t.conv_id is not distinct from w.conv_id and t.n = w.n + 1
  join moves m on m.state = w.state and (initial is null or initial = left(t.role, 1)) and (fault not in ('b', 'd') or edit = 'D')
  qualify row_number() over (partition by w.conv_id, m.next order by w.cost + m.cost + if(fault = 't' and edit <> 'D', 3, 0), audit || edit) = 1),
counts as (
  select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 'b') as blank,
         count(*) filter (where fault = 'd') as duplicate, count(*) filter (where fault = 't') as truncated,
         count(*) filter (where pair not in ('su', 'ua', 'au')) as illegal
  from told group by conv_id),
ends as (
  select i.conv_id, w.cost + e.cost as cost, w.audit || e.inserts as audit, list_concat(w.lines, e.roles) as lines
  from ids i left join counts c on c.conv_id is not distinct from i.conv_id
  join walk w on w.conv_id is not distinct from i.conv_id and w.n = coalesce(c.n, 0) join endings e using (state)
  qualify row_number() over (partition by i.conv_id order by w.cost + e.cost, w.audit || e.inserts) = 1)
select e.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
       coalesce(illegal, 0) as illegal, e.cost::bigint as cost, audit, sha256(array_to_string(lines, chr(10))) as repaired_sha256
from ends e left join counts c on c.conv_id is not distinct from e.conv_id
"""


@query
def op13_filter_interactions(spark, sf_dir):
    return filter_audit.filter_interactions(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


ORACLES["op13_filter_interactions"] = r"""
with recursive letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as letter),
orders as (
  select letter as filter_order from letters
  union all
  select filter_order || letter from orders, letters where position(letter in filter_order) = 0
),
words as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
  from documents
),
failing as (
  select d.doc_id, part,
         if(len(w) < 200, 'A', '') || if(100 * len(list_distinct(w)) < 50 * len(w), 'B', '')
         || if(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t), 'C', '')
         || if(regexp_matches(t, '[#$%&*|]'), 'D', '')
         || if(doc_id > min(doc_id) over (partition by t), 'E', '') as mask,
         exists (select 1 from labels l where l.doc_id = d.doc_id and l.quality = 1) as good,
         exists (select 1 from labels l where l.doc_id = d.doc_id and l.toxic = 1) as toxic
  from words d
),
masks as (
  select part, mask, count(*) as n, count(*) filter (where good) as good, count(*) filter (where toxic) as toxic
  from failing group by part, mask
),
steps as (
  select part, filter_order, step, filter_order[step] as letter, mask, n, good, toxic,
         len(regexp_extract(filter_order, if(mask = '', '.*', '[^' || mask || ']*'))) + 1 as gone
  from masks, (select filter_order from orders where len(filter_order) = 5), (select unnest(range(1, 6)) as step)
),
counted as (
  select part, filter_order, step::int as step, any_value(letter) as letter,
         sum(if(gone > step, n, 0))::bigint as kept,
         sum(if(gone = step, n, 0))::bigint as removed,
         sum(if(gone < step and contains(mask, letter), n, 0))::bigint as redundant,
         sum(if(mask = letter, n, 0))::bigint as unique_fails,
         sum(if(gone = step, good, 0))::bigint as good_lost,
         sum(if(gone = step, toxic, 0))::bigint as toxic_lost
  from steps group by part, filter_order, step
)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) over (partition by part, letter))::bigint as shapley
from counted
"""
