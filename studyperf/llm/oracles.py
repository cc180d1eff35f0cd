"""SQL for the queries that it can express, over the same tables, for DuckDB."""

#: Every window of an item's length (the whole of a shorter document) that shares a shingle with it, without fingerprints; the best window of each document and item. Items of fewer than five words: where they stand.
DECONTAMINATE_SQL = r"""
with d as (
  select doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x09-\x0D\x1C-\x20]+'), lambda x: x <> '') as w from documents
), b as (
  select item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x09-\x0D\x1C-\x20]+'), lambda x: x <> '') as w from benchmark
), item as (
  select item_id, len(w) as n, g, count(*) as wanted
  from (select item_id, w, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) as g from b where len(w) >= 5) x group by all
), place as (
  select doc_id, len(w) as size, unnest(range(1, len(w) - 3)) as p, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) as g from d where len(w) >= 5
), window_ as (
  select doc_id, item_id, n, least(n, size) as m, g, wanted, unnest(range(greatest(1, p - least(n, size) + 5), least(p, size - least(n, size) + 1) + 1)) as s from place join item using (g)
), common as (
  select doc_id, item_id, n, m, s, sum(least(times, wanted)) as c
  from (select doc_id, item_id, n, m, s, g, wanted, count(*) as times from window_ group by all) x group by all
), near as (
  select doc_id, item_id, s - 1 as start, c / cast(n + m - 8 - c as double) as similarity from common
), short as (
  select item_id, len(w) as n, array_to_string(w, ' ') as g from b where len(w) between 1 and 4
), at_ as (
  select doc_id, n, unnest(range(0, len(w) - n + 1)) as start, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) as g
  from d, (select distinct n from short) l where len(w) >= n
)
select doc_id, item_id, cast(arg_min(start, struct_pack(a := -similarity, b := start)) as int) as start, max(similarity) as similarity
from near where similarity >= 0.8 group by doc_id, item_id
union all
select doc_id, item_id, cast(min(start) as int), cast(1 as double) from at_ join short using (n, g) group by doc_id, item_id
"""

#: The rules' measures from word lists; windows found twice cover words from their place to the next such window's, five at most.
RULES_SQL = r"""
with d as (
  select row_number() over () as r, doc_id, coalesce(text, '') as t from documents
), m as (
  select r, doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
  from d
), g as (
  select r, unnest(range(1, len(w) - 3)) as p, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) as h from m where len(w) > 5
), twice as (
  select r, p from (select r, p, count(*) over (partition by r, h) as n from g) x where n > 1
), covered as (
  select r, sum(least(5, coalesce(after - p, 5))) as n from (select r, p, lead(p) over (partition by r order by p) as after from twice) x group by r
), c as (
  select doc_id, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
    cast(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as bigint) as n_symbols,
    cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines, cast(coalesce(n, 0) as bigint) as n_repeat_words, len(l) as n_lines,
    length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) as upper_, length(regexp_replace(t, '[^\p{L}]+', '', 'g')) as letters
  from m left join covered using (r)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or 10 * n_symbols > 3 * n_words or 10 * n_dup_lines > 3 * n_lines or word_chars > 20 * n_words or 2 * upper_ > letters) as kept
from (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from c) b
"""

#: A sequence of 20 words that has started before marks its words.
PHRASES_SQL = r"""
with d as (
  select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), place as (
  select doc_id, unnest(range(1, len(w) + 1)) as p, unnest(w) as word,
    unnest(list_transform(range(1, len(w) + 1), lambda i: case when i + 19 <= len(w) then array_to_string(w[i:i + 19], ' ') end)) as seq
  from d
), found as (
  select doc_id, p, word, seq is not null and row_number() over (partition by seq order by doc_id, p) > 1 as again from place
), covered as (
  select doc_id, p, word, max(cast(again as int)) over (partition by doc_id order by p rows between 19 preceding and current row) = 1 as gone from found
), kept as (
  select doc_id, count(*) filter (where gone) as n_removed, string_agg(word, ' ' order by p) filter (where not gone) as t from covered group by doc_id
)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join kept using (doc_id)
"""

#: Strings of 50 bytes that start in a document with a smaller id, united to runs; what lies between the runs is kept.
SUFFIXES_SQL = r"""
with d as (
  select doc_id, encode(coalesce(text, '')) as b from documents
), place as (
  select doc_id, unnest(range(1, octet_length(b) - 48)) as p, unnest(list_transform(range(1, octet_length(b) - 48), lambda i: b[i:i + 49])) as s from d where octet_length(b) >= 50
), shared as (
  select s, min(doc_id) as least_ from place group by s having min(doc_id) < max(doc_id)
), again as (
  select doc_id, p, p > coalesce(lag(p) over (partition by doc_id order by p) + 50, 0) as begins from place join shared using (s) where doc_id > least_
), run as (
  select doc_id, min(p) as a, max(p) + 49 as z from (select *, sum(cast(begins as int)) over (partition by doc_id order by p) as k from again) x group by doc_id, k
), gap as (
  select doc_id, a, z, coalesce(lag(z) over (partition by doc_id order by a), 0) + 1 as after from run
), cut as (
  select doc_id, sum(z - a + 1) as n_removed, count(*) as n_spans, string_agg(hex(b[after:a - 1]), '' order by a) as t, max(z) as z from gap join d using (doc_id) group by doc_id
)
select doc_id, cast(octet_length(b) as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans,
  sha256(unhex(concat(t, hex(b[coalesce(z, 0) + 1:])))) as kept_sha256 from d left join cut using (doc_id)
"""

#: Scores of anchors against all rows; positives and negatives by rank.
NEGATIVES_SQL = r"""
with e as (
  select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
  from embeddings where vec_id is not null and label is not null and list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))
), scored as (
  select a.id as anchor_id, e.id, e.label = a.label as alike, cast(list_dot_product(a.v, e.v) as bigint) as score
  from e a, e where a.id % 100 = 0 and e.id <> a.id
), positive as (
  select * from (select *, row_number() over (partition by anchor_id order by score desc, id) as nth from scored where alike) x where nth <= 5
), negative as (
  select anchor_id, p.id as positive_id, n.id as negative_id, p.score as positive_score, n.score as negative_score,
    row_number() over (partition by anchor_id, p.id order by n.score desc, n.id) as nth
  from positive p join scored n using (anchor_id) where not n.alike and 80 * p.score <= 100 * n.score and 100 * n.score <= 100 * p.score
)
select anchor_id, positive_id, cast(nth as int) as rank, negative_id, positive_score, negative_score from negative where nth <= 5
"""

#: crc32 bit by bit over the UTF-8 bytes; near words share what is left without one code point, or with one blotted out.
VARIANTS_SQL = r"""
with recursive run as (
  select coalesce(cast(doc_id as varchar), '') as id, w, count(*) as n
  from (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) as w from documents) x
  where length(w) >= 7 group by all
), bytes_ as (
  select w, n, flatten(list_transform(string_split(id || ':' || w, ''), lambda x: case when unicode(x) < 128 then [unicode(x)] else [192 + unicode(x) // 64, 128 + unicode(x) % 64] end)) as b from run
), hashed as (
  select w, n, xor(list_reduce(b, lambda c, x: list_reduce([1, 2, 3, 4, 5, 6, 7, 8], lambda y, k: case when y % 2 = 1 then xor(y // 2, 3988292384) else y // 2 end, xor(c, cast(x as bigint))), 4294967295::bigint), 4294967295::bigint) as h from bytes_
), word as (
  select w, cast(sum(n) as bigint) as n from (
    select case when h % 31 = 0 then left(w, cast(h % length(w) as int)) || substr(w, cast(h % length(w) as int) + 2) else w end as w, n from hashed
  ) x where length(w) >= 7 group by w having sum(n) >= 2
), without_ as (
  select distinct w, n, left(w, i - 1) || substr(w, i + 1) as v from (select w, n, unnest(range(1, length(w) + 1)) as i from word) x
), blotted as (
  select w, n, left(w, i - 1) || '*' || substr(w, i + 1) as v from (select w, n, unnest(range(1, length(w) + 1)) as i from word) x
), near_ as (
  select a.w, b.w as other, b.n as m from blotted a join blotted b using (v) where a.w <> b.w
  union all select a.v, a.w, a.n from without_ a join word b on a.v = b.w
  union all select a.w, b.w, b.n from without_ a join word b on a.v = b.w
), best as (
  select w, count(*) as n_near, arg_min(other, struct_pack(m := -m, o := other)) as other, max(m) as m from near_ group by w
), form as (
  select word.w, n, coalesce(n_near, 0) as n_near, case when m >= 10 * n then other end as form, case when m >= 10 * n then m end as form_n from word left join best using (w)
), path as (
  select w, w as last_ from form where form is null
  union all select form.w, last_ from path join form on form.form = path.w
)
select w as word, form, last_ as root, n, n_near, form_n from form join path using (w)
"""
