"""SQL (DuckDB) that gives the rows of the corpus queries that SQL can express, by brute force."""

from __future__ import annotations

import string

from quakelode.llm import licenses

_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
#: Smallest id that each node reaches over links (a, b), which go both ways.
_REACH = "reach as (select id, id as c from nodes union select links.b, reach.c from reach join links on links.a = reach.id), component as (select id, min(c) as component_id from reach group by id)"

MINHASH = rf"""with recursive w as (select doc_id as id, list_filter(regexp_split_to_array({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select id, list_distinct(case when len(w) >= 4 then list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from w),
e as (select id, len(s) as n, unnest(s) as h from s),
pairs as (select a.id as a, b.id as b, count(*) as x, any_value(a.n) as na, any_value(b.n) as nb from e a join e b using (h) where a.id < b.id group by all),
half as (select a, b from pairs where 100*x >= 80*(na + nb - x)),
links as (select a, b from half union all select b, a from half), nodes as (select id from s), {_REACH}
select id as doc_id, len(s)::bigint as n_shingles, component_id, id = component_id as kept from s join component using (id)"""

COSINE = f"""with recursive v as (select vec_id as id, embedding::double[] as x, embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda y: y is null or not isfinite(y))) = 0 and len(list_filter(embedding, lambda y: y <> 0)) > 0 as good from embeddings),
links as (select a.id as a, b.id as b from v a join v b on a.id <> b.id and a.good and b.good and len(a.x) = len(b.x) where list_cosine_similarity(a.x, b.x) >= 0.95),
nodes as (select id from v), {_REACH}, n as (select a as id, count(*) as k from links group by a)
select id as vec_id, coalesce(k, 0) as n_links, component_id, id = component_id as kept from component left join n using (id)"""


def _quoted(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _license_sql() -> str:
    places = [f"list_filter(range(1, len(w) + 1), lambda i: {' and '.join(f'''w[i+{k}] = '{p}' ''' for k, p in enumerate(phrase.split()))}) as p{n}" for n, phrase in enumerate(licenses.PHRASES)]
    told = sorted({" ".join(t.phrase.split()) for t in licenses.TEMPLATES})
    further = max(len(p.split()) for p in told)
    rows = []
    for k, t in enumerate(licenses.TEMPLATES):
        w, phrase = licenses.template_words(t.text), " ".join(t.phrase.split())
        wide = licenses.SHORT_BLOCK if len(w) < licenses.SHORT else licenses.BLOCK
        rows.append(f"({k}, {_quoted(w)}, '{phrase}', {_quoted(licenses.longer_phrases(phrase, told))}::varchar[], '{t.label}', {wide})")
    templates = ", ".join(rows)
    base = "list_filter([" + ", ".join(f"case when len(p{n}) > 0 then '{label}' end" for n, label in enumerate(licenses.PHRASES.values())) + "], lambda x: x is not null)"
    every = "list_concat(list_concat(p0, p1), p2)"
    return rf"""with t as (select doc_id, row_number() over () as r, regexp_split_to_array({_LOWER}, '{licenses.SEPARATORS}') as w from documents),
s as (select *, (w[1] = '')::int as shift, (len(w) > 1 and w[len(w)] = '')::int as tail, {', '.join(places)} from t),
templates as (select *, len(string_split(phrase, ' ')) as parts from (values {templates}) v(k, words, phrase, longer, label, wide)),
b as (select r, wide, pos, list_distinct(w[pos+1:pos+wide]) as b, w[pos+1:pos+wide+{further}] as s from (select r, w, wide, unnest(range(0, greatest(0, len(w) - 1 - wide//2) + 1, wide//2)) as pos from t, (select distinct wide from templates))),
n as (select *, list_filter(range(1, wide - parts + 2), lambda i: array_to_string(s[i:i+parts-1], ' ') = phrase) as places from b join templates using (wide)
where len(list_intersect(b, words)) >= ceil({licenses.CONTAINMENT}::double*len(words) - 1e-9::double)),
m as (select r, label, len(list_intersect(b, words))/len(words)::double as share from n
where phrase = '' or len(list_filter(places, lambda i: len(list_filter(longer, lambda q: array_to_string(s[i:i+len(string_split(q, ' '))-1], ' ') = q)) = 0)) > 0),
g as (select r, list(distinct label) as more, max(share) as share from m group by r)
select doc_id, (len(w) - shift - tail)::bigint as n_words, len({every})::bigint as n_base, (list_min({every}) - 1 - shift)::bigint as first_word, (list_max({every}) - 1 - shift)::bigint as last_word,
array_to_string(list_sort({base}), ',') as base_labels, array_to_string(list_sort(list_distinct(list_concat({base}, coalesce(more, [])))), ',') as labels,
case when len({every}) > 0 then 1.0::double else coalesce(share, 0.0::double) end as score from s left join g using (r)"""


LICENSES = _license_sql()

RESAMPLING = rf"""with t as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)) as t),
d as (select doc_id, row_number() over () as r, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
e as (select r, unnest(w) as w from d), x as (select unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w from benchmark),
h as (select w, hex(encode(w)) as h from (select w from e union select w from x)),
b as (select w, (xor(list_reduce(list_prepend(4294967295, list_transform(range(len(h)//2), lambda i: ('0x' || substr(h, 2*i + 1, 2))::bigint)), lambda c, y: xor(c // 256, t[(xor(c, y) % 256) + 1])), 4294967295) % 10000)::bigint as b from h, t),
s as (select b, count(*) as s from e join b using (w) group by b), q as (select b, count(*) as t from x join b using (w) group by b),
g as (select b, floor(1000*ln((coalesce(t, 0) + 1)::double*((select count(*) from e) + 10000)::double/((s + 1)::double*((select count(*) from x) + 10000)::double)))::bigint as g from s left join q using (b)),
f as (select r, sum(g)::bigint as g from e join b using (w) join g using (b) group by r),
z as (select doc_id, len(w)::bigint as n_features, coalesce(g, 0)::bigint as weight, ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint as h from d left join f using (r)),
v as (select doc_id, n_features, weight, weight + floor(-1000*ln(-ln((h + 0.5::double)/4294967296::double)))::bigint as score from z),
k as (select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id) as k from v)
select doc_id, n_features, weight, score, case when n_features >= 20 and k <= 10*(select count(*) from v where n_features >= 20)//100 then k end as rank from k"""

AUDIT = r"""with w as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
g as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
f as (select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic, ['A', 'B', 'C', 'D', 'E'] as letters,
[len(w) < 200, 100*len(list_distinct(w)) < 50*len(w), 100*length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2*length(text), regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > min(doc_id) over (partition by text), false)] as fails from w left join g using (doc_id)),
m as (select part, list_reduce(list_prepend('', list_filter(letters, lambda c, i: fails[i])), lambda a, c: a || c) as mask, good, toxic, count(*) as n from f group by all),
l as (select unnest(['A', 'B', 'C', 'D', 'E']) as c),
o as (select a.c || b.c || d.c || e.c || f.c as filter_order from l a, l b, l d, l e, l f where len(list_distinct([a.c, b.c, d.c, e.c, f.c])) = 5),
s as (select filter_order, step, filter_order[step] as c, filter_order[1:step-1] as before from o, (select unnest(range(1, 6)) as step)),
x as (select part, filter_order, step, c, good, toxic, n, contains(mask, c) as fails, mask = c as only_it, len(list_filter(string_split(before, ''), lambda b: b <> '' and contains(mask, b))) > 0 as gone from m, s),
y as (select part, filter_order, step, c, sum(case when not fails and not gone then n else 0 end)::bigint as kept, sum(case when fails and not gone then n else 0 end)::bigint as removed, sum(case when fails and gone then n else 0 end)::bigint as redundant, sum(case when only_it then n else 0 end)::bigint as unique_fails, sum(case when fails and not gone and good then n else 0 end)::bigint as good_lost, sum(case when fails and not gone and toxic then n else 0 end)::bigint as toxic_lost from x group by all)
select part, filter_order, step::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) over (partition by part, c)::bigint as shapley from y"""
