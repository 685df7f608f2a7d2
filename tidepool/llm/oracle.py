"""SQL of the queries whose contracts damage their tables by a checksum."""

from __future__ import annotations

#: The checksum in SQL, over a list of bytes: its table, and the expression, with {} for the list.
CRC_TABLE = "crc as (select list(list_reduce(range(8), lambda c, k: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i) order by i) t from (select unnest(range(256)) i))"
CRC = "xor(list_reduce({}, lambda c, b: xor(crc.t[xor(c, b) % 256 + 1], c >> 8), cast(4294967295 as bigint)), 4294967295)"
#: UTF-8 bytes of a text of ASCII and Latin-1 letters.
BYTES = "flatten(list_transform(string_split({}, ''), lambda x: case when unicode(x) < 128 then [cast(unicode(x) as bigint)] else [cast(195 as bigint), cast(unicode(x) - 64 as bigint)] end))"

OP12_SQL = (
    f"with recursive {CRC_TABLE},"
    + r"""
m as (select conv_id, turn, coalesce(role, ' ') r, coalesce(text, ' ') t, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') id from conversations),
h as (select m.*, """
    + CRC.format(BYTES.format("id"))
    + r""" % 20 h from m, crc),
d as (select conv_id, turn, case when h = 4 then 'user' else r end r, case h when 1 then '' when 2 then translate(t, '.!?', '') else t end t, unnest(range(case when h = 3 then 2 else 1 end)) copy from h where h <> 0),
p as (select conv_id, turn, r, t, row_number() over (partition by conv_id order by turn nulls first, r, t) n from d),
o as (select conv_id c, n, turn, r, t, left(r, 1) i, not regexp_matches(t, '[^\x20\x09-\x0D]') blank, row_number() over (partition by conv_id, r, t order by n) > 1 again,
  not regexp_matches(t, '[.!?][\x20\x09-\x0D]*$') open, lag(left(r, 1)) over (partition by conv_id order by n) before from p),
stats as (select c, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count(*) filter (blank) blank, count(*) filter (not blank and again) duplicate, count(*) filter (not blank and not again and open) truncated,
  count(*) filter (before is not null and before || i not in ('su', 'ua', 'au')) illegal, count(*) n from o group by c),
step(a, x, b) as (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
ins(a, b, cost, audit, made) as (values (0, 0, 0, '', []), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 2, 'I', ['user:']), (1, 2, 2, 'I', ['user:']), (3, 2, 2, 'I', ['user:']), (2, 3, 2, 'I', ['assistant:']),
  (0, 3, 4, 'II', ['user:', 'assistant:']), (1, 3, 4, 'II', ['user:', 'assistant:'])),
moves as (select c, n, a, a b, 3 cost, 'D' audit, [] made from o, (values (0), (1), (2), (3)) s(a)
  union all select c, n, a, b, case when open then 1 else 0 end, 'K', [r || ':' || t] from o join step on x = i where not blank and not again
  union all select c, n, a, b, case when open then 3 else 2 end, 'R', [case x when 'u' then 'user' else 'assistant' end || ':' || t] from o join step on x <> 's' where not blank and not again),
best as (
  select c, cast(0 as bigint) n, b s, cast(cost as bigint) cost, audit, cast(made as varchar[]) made from stats join ins on a = 0
  union all
  select c, n, s, p.cost, p.audit, p.made from (
    select f.c, f.n + 1 n, i.b s, min({'cost': cast(f.cost + v.cost + i.cost as bigint), 'audit': f.audit || v.audit || i.audit, 'made': list_concat(list_concat(f.made, v.made), cast(i.made as varchar[]))}) p
    from best f join moves v on v.c is not distinct from f.c and v.n = f.n + 1 and v.a = f.s join ins i on i.a = v.b group by f.c, f.n, i.b)),
done as (select st.c, min({'cost': b.cost, 'audit': b.audit, 'made': b.made}) p from stats st join best b on b.c is not distinct from st.c and b.n = st.n and b.s in (0, 3) group by st.c)
select v.conv_id, cast(coalesce(gaps, 0) as bigint) gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate, coalesce(truncated, 0) truncated, coalesce(illegal, 0) illegal,
  coalesce(p.cost, 0) cost, coalesce(p.audit, '') audit, sha256(coalesce(array_to_string(p.made, chr(10)), '')) repaired_sha256
from (select distinct conv_id from conversations) v left join stats on v.conv_id is not distinct from stats.c left join done on v.conv_id is not distinct from done.c
"""
)

OP13_SQL = (
    f"with recursive {CRC_TABLE},"
    + r"""
r as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) w from documents),
e as (select doc_id, w, count(*) n from r where length(w) >= 7 group by all),
h as (select w, n, """
    + CRC.format(BYTES.format("doc_id || ':' || w"))
    + r""" h from e, crc),
a as (select case when h % 31 = 0 then substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) else w end w, n from h),
words as (select w, cast(sum(n) as bigint) n from a where length(w) >= 7 group by w having sum(n) >= 2),
v as (select w, n, i, substr(w, 1, i - 1) || substr(w, i + 1) x from (select *, unnest(range(1, length(w) + 1)) i from words)),
near as (
  select p.w, q.w o, q.n m from v p join v q on p.i = q.i and p.x = q.x and p.w <> q.w
  union select v.w, words.w, words.n from v join words on v.x = words.w
  union select words.w, v.w, v.n from v join words on v.x = words.w),
b as (select w, count(*) n_near, min({'m': -m, 'o': o}) best from near group by w),
f as (select words.w word, case when -best.m >= 10 * n then best.o end form, n, coalesce(n_near, 0) n_near, case when -best.m >= 10 * n then -best.m end form_n from words left join b using (w)),
walk as (select word, word last, 0 k from f union all select walk.word, f.form, k + 1 from walk join f on f.word = walk.last where f.form is not null)
select f.word, form, root, n, n_near, form_n from f join (select word, max_by(last, k) root from walk group by word) using (word)
"""
)
