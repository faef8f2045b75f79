"""DuckDB SQL for the queries that SQL can express."""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def uniform(seed: str, key: str) -> str:
    return (
        f"(('0x' || substr(md5(cast({seed} // 4 as varchar) || ':' || coalesce(cast({key} as varchar), '')),"
        f" ({seed} % 4) * 8 + 1, 8))::bigint / 4294967296.0::double)"
    )


def mixing(documents: str) -> str:
    """CTEs up to ``drawn``: ``doc_id, source, size`` with ``source_size, target, copies``."""
    return rf"""
sized as (
  select *, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from {documents}),
totals as (
  select source, sum(size)::bigint as source_size,
         (row_number() over (order by source is null, source) - 1) % 3 + 1 as weight
  from sized group by source),
levels as (
  select *, source_size * 3 as cap,
         sum(source_size) over () as total, sum(weight) over () as all_weight,
         sum(source_size * 3) over o as capped, sum(weight) over o as used
  from totals window o as (order by source_size * 3.0 / weight, source rows unbounded preceding)),
steps as (
  select (total - capped + cap)::double / (all_weight - used + weight) as level, cap::double / weight as next_ratio
  from levels),
level as (select coalesce((select level from steps where level <= next_ratio order by next_ratio limit 1), 0.0) as level),
rated as (
  select source, source_size, least((source_size * 3)::double, level * weight) as target,
         case when source_size > 0 then least((source_size * 3)::double, level * weight) / source_size else 0.0 end as rate
  from totals, level),
tried as (
  select s.source, k, abs(sum(size * (floor(rate)::bigint
           + ({uniform('k', 'doc_id')} < rate - floor(rate))::int)) - any_value(target)) as off
  from sized s join rated r on s.source is not distinct from r.source, range(16) t(k) group by s.source, k),
seeds as (select source, first(k order by off, k) as seed from tried group by source),
drawn as (
  select s.*, source_size, target,
         (floor(rate)::bigint + ({uniform('seed', 'doc_id')} < rate - floor(rate))::int)::bigint as copies
  from sized s join rated r on s.source is not distinct from r.source
  join seeds d on s.source is not distinct from d.source)"""


def divergence(documents: str, keys: str = "doc_id") -> str:
    """CTEs up to ``judged``: the rules of ``op11`` per document."""
    space = r"\x20\x09-\x0D"
    classes = [r"a-zß-öø-ÿ", space, r"A-ZÀ-ÖØ-Þ", r".,;:!?''\"()\x2D", "0-9", "#*$%&|<>"]
    gone = [f"(length(t) - length(regexp_replace(t, '[{c}]', '', 'g')))::bigint" for c in classes]
    shares = ", ".join(f"quantile_disc(floor(cls[{i}] * 1000.0 / length(t))::bigint, 0.5)" for i in range(1, 8))

    def js(counts: str, reference: str) -> str:
        p, q = f"{counts}[i]::double / list_sum({counts})", f"{reference}[i]::double / list_sum({reference})"
        half = "case when {p} > 0 then {p} * ln({p} / (({p} + {q}) / 2)) else 0 end"
        part = half.format(p=f"({p})", q=f"({q})") + " + " + half.format(p=f"({q})", q=f"({p})")
        total = f"greatest(list_sum(list_transform(range(1, len({counts}) + 1), lambda i: {part})) / (2 * ln(2)), 0)"
        return f"case when list_sum({counts}) > 0 and list_sum({reference}) > 0 then {total} end"

    def within(value: str, limit: float, bins: str, n: str) -> str:
        return f"coalesce({value} <= {limit} * {limit} + 4.0 * ({bins} - 1) / (8 * ln(2) * nullif({n}, 0)), true)"

    return rf"""
texts as (select {keys}, lang, coalesce(text, '') as t, row_number() over () as rid from {documents}),
parsed as (select *, regexp_extract_all(t, '[^{space}]+') as w, regexp_extract_all(lower(t), '\p{{L}}+') as lw,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{space}]')) as ls,
             [{", ".join(gone)}] as c6 from texts),
classed as (select *, list_append(c6, length(t) - list_sum(c6)::bigint) as cls from parsed),
wins as (select rid, i, w[i : i + 2] as win from classed, unnest(range(1, len(w) - 1)) u(i)),
twice as (select rid, i from wins qualify count(*) over (partition by rid, win) > 1),
rep as (select rid, count(distinct i + k)::bigint as n_repeat_words from twice, range(3) r(k) group by rid),
long as (select * from classed where len(w) >= 50),
vocab as (select lang, w, count(*) as n from (select lang, unnest(lw) as w from long) group by lang, w),
tops as (select lang, list(w order by place) as ref_words, list(n order by place) as tn from
         (select *, row_number() over (partition by lang order by n desc, w) as place from vocab) where place <= 20 group by lang),
totals as (select lang, sum(n)::bigint as total from vocab group by lang),
medians as (select lang, [{shares}] as ref_classes from long group by lang),
refs as (select a.lang, ref_words, list_append(tn, total - list_sum(tn)::bigint) as ref_counts, ref_classes
         from tops a join totals b on a.lang is not distinct from b.lang
         join medians c on a.lang is not distinct from c.lang where total >= 1000),
bins as (select d.*, ref_words, ref_counts, ref_classes,
           list_transform(ref_words, lambda r: len(list_filter(lw, lambda x: x = r))) as b
         from classed d left join refs r on d.lang is not distinct from r.lang),
based as (select bins.*, list_append(b, len(lw) - list_sum(b)::bigint) as cnt, len(w)::bigint as n_words,
            (length(t) - cls[2])::bigint as word_chars, cls[6] as n_symbols,
            (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words
          from bins left join rep using (rid)),
measured as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
               {js("cls", "ref_classes")} as cjs, {js("cnt", "ref_counts")} as wjs from based),
judged as (select *, not base_failed and (n_words < 50 or
             ({within("cjs", 0.18, "7", "word_chars")} and {within("wjs", 0.45, "len(ref_counts)", "len(lw)")})) as kept
           from measured)"""


SQL = {
    "op5_topk": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as v from embeddings
           where vec_id is not null and embedding is not null
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
      from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0)
select * from (
  select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score from s)
where rank <= 10""",
    "op7_decontamination": rf"""
with d as (select doc_id, {WORDS} as w from documents),
b as (select item_id, {WORDS} as w from benchmark where item_id is not null),
p as (select distinct item_id, least(13, len(w)) as m, w[i : i + least(13, len(w)) - 1] as win
      from b, unnest(range(1, len(w) - least(13, len(w)) + 2)) t(i) where len(w) > 0),
ms as (select distinct m from p),
dw as (select doc_id, m, i, w[i : i + m - 1] as win from d, ms, unnest(range(1, len(w) - m + 2)) t(i)),
hits as (select doc_id, item_id, i, dw.m from dw join p on dw.m = p.m and dw.win = p.win),
n as (select doc_id, count(distinct j) as n_hit from (select distinct doc_id, i, m from hits) h,
      unnest(range(i, i + m)) t(j) group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(x, ',' order by x) as names
        from (select distinct doc_id, cast(item_id as varchar) as x from hits) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit,
       coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(names, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join n using (doc_id) left join its using (doc_id)""",
    "op11_divergence": f"""
with {divergence('documents')}
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept from judged""",
    "op12_spelling": rf"""
with runs as (
  select coalesce(doc_id::varchar, '') as id,
         translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as times
  from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) as run from documents)
  where length(run) >= 7 group by all),
bits as (select *, flatten(list_transform(list_transform(string_split(id || ':' || run, ''), lambda c: unicode(c)::bigint),
    lambda u: case when u < 128 then [u, -1, -1, -1, -1, -1, -1, -1, -1]
                   else [192 | (u >> 6), -1, -1, -1, -1, -1, -1, -1, -1, 128 | (u & 63), -1, -1, -1, -1, -1, -1, -1, -1] end))
    as steps from runs),
hashed as (select *, xor(4294967295, list_reduce(steps, lambda c, x: case when x >= 0 then xor(c, x)
    else xor(c >> 1, 3988292384 * (c & 1)) end, 4294967295::bigint)) as h from bits),
cut as (select case when h % 31 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2)
    else run end as word, times from hashed),
words as (select word, sum(times)::bigint as n from cut where length(word) >= 7 group by word having sum(times) >= 2),
less as (select word, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest
         from words, unnest(range(1, length(word) + 1)) t(i)),
pairs as (select a.word, b.word as near from less a join less b on a.rest = b.rest and a.i = b.i and a.word <> b.word
    union select l.word, w.word from less l join words w on l.rest = w.word
    union select w.word, l.word from less l join words w on l.rest = w.word),
close as (select p.word, count(*) as n_near, first(near order by x.n desc, near) as best, max(x.n) as best_n
          from pairs p join words x on p.near = x.word group by p.word),
formed as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when best_n >= 10 * w.n then best end as form,
                  case when best_n >= 10 * w.n then best_n end as form_n from words w left join close using (word)),
chain as (with recursive c as (select word, word as root from formed
    union all select c.word, f.form from c join formed f on c.root = f.word where f.form is not null)
  select c.word, c.root from c join formed f on c.root = f.word where f.form is null)
select word, form, root, n, n_near, form_n from formed join chain using (word)""",
    "op13_collocations": r"""
with pieces as (select row_number() over () as pid, lang, w from (
    select coalesce(lang, 'und') as lang, regexp_extract_all(unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')),
      '[^\x20\x09]+') as w from documents)),
places as (select lang, unnest(w) as w1, unnest(list_append(w[2:], null)) as w2, unnest(list_append(list_append(w[3:], null), null)) as w3
           from pieces where len(w) > 0),
sizes as (select lang, count(*)::bigint as n from places where w1 is not null group by lang),
f as (select lang, w1 as phrase, 1 as m, count(*) as f from places where w1 is not null group by all
      union all select lang, w1 || ' ' || w2, 2, count(*) from places where w2 is not null group by all
      union all select lang, w1 || ' ' || w2 || ' ' || w3, 3, count(*) from places where w3 is not null group by all),
cand as (select lang, phrase, string_split(phrase, ' ') as w, m, f as a from f where m >= 2 and f >= 10),
over as (select lang, p as phrase, max(a) as o from (
    select lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) as p from cand where m = 3) group by all),
free as (select c.* from cand c left join over o using (lang, phrase) where o is null or 100 * o < 50 * a),
cuts as (select lang, phrase, a, k, array_to_string(w[:k], ' ') as lp, array_to_string(w[k + 1:], ' ') as rp
         from free, range(1, 3) t(k) where k < m),
scored as (select c.*, l.f as l, r.f as r, (1000000::hugeint * a * a // (l.f::hugeint * r.f))::bigint as score
           from cuts c join f l on c.lang = l.lang and c.lp = l.phrase join f r on c.lang = r.lang and c.rp = r.phrase),
worst as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1)
select w.lang, row_number() over (partition by w.lang order by score desc, a desc, phrase) as rank,
       phrase, a, l, r, n, score from worst w join sizes using (lang)
qualify rank <= 2000""",
    "op9_mixing": f"""
with {mixing('documents')}
select doc_id, size, source_size, target, size * copies as taken from drawn""",
}
