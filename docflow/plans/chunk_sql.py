"""SQL (DuckDB) of chunking: segmentation by paragraphs and headings, packing, hard cuts. An oracle of its own.

Spans are bytes, SQL's strings are characters; where bytes are needed the text's hexadecimal form is cut.
"""

from __future__ import annotations

from docflow.functions.text import WHITE_SPACE as _JAVA_SPACE

_WS = _JAVA_SPACE.replace(r"\x{9}-\x{d}", r"\x{09}-\x{0d}")
_FENCE = "^ {0,3}(`{3,}|~{3,})"


def size(x: str) -> str:
    return f"((length({x}) + 3) // 4)"


def bytes_of(hexed: str, a: str, b: str) -> str:
    """The text of bytes ``a`` to ``b``."""
    return f"decode(unhex(substr({hexed}, cast(2 * ({a}) + 1 as bigint), cast(2 * (({b}) - ({a})) as bigint))))"


def whole(texts: str) -> str:
    """``whole(id, t, h, n, off)``: trimmed texts of ``texts`` (``id, text``), their hex form, bytes and place."""
    return rf"""trimmed as (select id, regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g') as t, strlen(regexp_extract(text, '^{_WS}*')) as off from ({texts}) where text is not null),
whole as (select id, t, off, hex(encode(t)) as h, strlen(t) as n from trimmed where t <> '')"""


def lines(name: str, source: str, key: str, text: str, at: str = "0") -> str:
    """``name(key, n, a, b, line)``: bytes of each line with its end, and its content without."""
    return rf"""{name}_x as (select {key}, {at} as a0, unnest(range(len(x))) as n, unnest(x) as l from (select *, regexp_extract_all({text}, '[^\n]*\n|[^\n]+$') as x from {source})),
{name} as (select {key}, n, a0 + sum(strlen(l)) over (partition by {key} order by n) - strlen(l) as a, a0 + sum(strlen(l)) over (partition by {key} order by n) as b,
  regexp_replace(l, '\r?\n$|\r$', '') as line from {name}_x)"""


def fences(name: str, source: str, key: str) -> str:
    """``name``: the lines of ``source`` with ``run``, the fence they are, and whether it has an info string."""
    return rf"""{name}_r as (select *, regexp_extract(line, '{_FENCE}', 1) as run0, regexp_replace(line, '{_FENCE}', '') as info from {source}),
{name} as (select {key}, n, a, b, line, case when run0 like '`%' and info like '%`%' then '' else run0 end as run, trim(info, ' ' || chr(9) || chr(13)) <> '' as has_info from {name}_r)"""


_CLOSES = "f.run <> '' and left(f.run, 1) = left(s.opened, 1) and length(f.run) >= length(s.opened) and not f.has_info"


def headings(source: str, text: str = "t") -> str:
    """``units(id, k, a, b)`` of ``source`` (``id, t, n``): sections, or paragraphs where there is no heading."""
    return rf"""{lines('hl', source, 'id', text)},
{fences('hf', 'hl', 'id')},
marks(id, n, opened, para, start) as (
  select f.id, f.n, case when f.run <> '' then f.run else '' end,
    case when f.run = '' and not regexp_matches(f.line, '^ {{0,3}}#{{1,6}}(?:[ \t]|$)') and regexp_matches(f.line, '[^{_WS[1:-1]}]') then f.a else -1 end,
    case when f.run = '' and regexp_matches(f.line, '^ {{0,3}}#{{1,6}}(?:[ \t]|$)') then f.a else -1 end
  from hf f where f.n = 0
  union all
  select f.id, f.n, case when s.opened <> '' then case when {_CLOSES} then '' else s.opened end else f.run end,
    case when s.opened <> '' or f.run <> '' or regexp_matches(f.line, '^ {{0,3}}#{{1,6}}(?:[ \t]|$)') or (s.para >= 0 and regexp_matches(f.line, '^ {{0,3}}(?:=+|-+)[ \t]*$'))
      or not regexp_matches(f.line, '[^{_WS[1:-1]}]') then -1 else f.a end,
    case when s.opened <> '' or f.run <> '' then -1 when regexp_matches(f.line, '^ {{0,3}}#{{1,6}}(?:[ \t]|$)') then f.a
      when s.para >= 0 and regexp_matches(f.line, '^ {{0,3}}(?:=+|-+)[ \t]*$') then s.para else -1 end
  from marks s join hf f on f.id = s.id and f.n = s.n + 1),
starts as (select id, start as a from marks where start >= 0 union select id, 0 from marks where start >= 0),
sections as (select s.id, row_number() over w - 1 as k, s.a, coalesce(lead(s.a) over w, x.n) as b from starts s join {source} x on x.id = s.id window w as (partition by s.id order by s.a)),
{paragraphs(f"(select * from {source} where id not in (select id from starts))", text, 'paras')},
units as (select id, k, a, b from sections union all select id, k, a, b from paras)"""


def paragraphs(source: str, text: str = "t", name: str = "units") -> str:
    return rf"""{name}_x as (select id, unnest(range(len(x))) as k, unnest(x) as p from (select id, regexp_extract_all({text}, '(?s).*?\n(?:\r?\n)+|.+$') as x from {source})),
{name} as (select id, k, sum(strlen(p)) over (partition by id order by k) - strlen(p) as a, sum(strlen(p)) over (partition by id order by k) as b from {name}_x)"""


def _packed(name: str, parts: str, budget: int, overlap: int) -> str:
    """``name(g, seq, i, j)``: runs of consecutive parts ``(g, k, a, b, tok)`` within the budget; a part over it is
    alone. Each run takes again the trailing parts of the one before that fit in ``overlap``."""
    return f"""{name}_s as (select *, sum(tok) over (partition by g order by k) as upto, max(k) over (partition by g) as last,
  sum(case when tok > {budget} then 1 else 0 end) over (partition by g order by k) as large from {parts}),
{name}_j as (select x.g, x.k as i, x.tok > {budget} as over, max(case when x.tok > {budget} then x.k else y.k end) as j, any_value(x.last) as last
  from {name}_s x join {name}_s y on y.g = x.g and y.k >= x.k and (y.k = x.k or (y.large = x.large and y.upto - x.upto + x.tok <= {budget})) group by 1, 2, 3),
{name}_n as (select r.g, r.i, r.j, r.over, case when r.over then r.i + 1 else min(y.k) end as nxt from {name}_j r
  join {name}_s z on z.g = r.g and z.k = r.j join {name}_s y on y.g = r.g and y.k > r.i and y.k <= r.j + 1
  where (r.over or r.j < r.last) and (y.k = r.j + 1 or (not r.over and {overlap} > 0 and z.upto - y.upto + y.tok <= {overlap})) group by r.g, r.i, r.j, r.over),
{name}_c(g, i, seq) as (
  select g, cast(0 as bigint), cast(0 as bigint) from {parts} where k = 0
  union all
  select c.g, cast(n.nxt as bigint), c.seq + 1 from {name}_c c join {name}_n n on n.g = c.g and n.i = c.i),
{name} as (select c.g, c.seq, r.i, r.j, r.over, x.a as a, y.b as b, case when r.over then -1 else y.upto - x.upto + x.tok end as tok
  from {name}_c c join {name}_j r on r.g = c.g and r.i = c.i join {name}_s x on x.g = c.g and x.k = r.i join {name}_s y on y.g = c.g and y.k = r.j)"""


def _rune(x: str, step: int, bound: str) -> str:
    """``x`` moved by ``step`` to the start of a character; not beyond ``bound``."""
    inner = lambda p: f"({p}) > ({bound}) and ({p}) < n and substr(h, cast(2 * ({p}) + 1 as bigint), 1) in ('8', '9', 'A', 'B')"
    if step < 0:
        return f"case when {inner(x)} then case when {inner(f'{x} - 1')} then case when {inner(f'{x} - 2')} then {x} - 3 else {x} - 2 end else {x} - 1 end else {x} end"
    return f"case when {inner(x)} then case when {inner(f'{x} + 1')} then case when {inner(f'{x} + 2')} then {x} + 3 else {x} + 2 end else {x} + 1 end else {x} end"


def _prose(name: str, spans: str, budget: int, overlap: int) -> str:
    """``name(g, piece, since, stop)``: spans ``(g, id, a, b)`` cut at sentences, white space or characters."""
    mark = lambda m: f"select id, sum(strlen(q) + 2) over (partition by id order by k) - 2 as p from (select id, unnest(range(len(x))) as k, unnest(x) as q, len(x) as m from (select id, string_split(t, '{m}') as x from whole)) qualify k < m - 1"
    return rf"""{name}_sent as (select id, list(p order by p) as sents from ({mark('. ')} union all {mark('! ')} union all {mark('? ')}) group by id),
{name}_sp as (select id, list({{'p': e - strlen(q), 'e': e}} order by e) as spaces from (
    select id, q, sum(strlen(q)) over (partition by id order by k) as e from (
      select id, unnest(range(len(x))) as k, unnest(x) as q from (select id, regexp_extract_all(t, '{_WS}|[^{_WS[1:-1]}]+') as x from whole)))
  where regexp_matches(q, '^{_WS}$') group by id),
{name}_in as (select s.g, s.id, s.a, s.b, w.h, w.n, coalesce(t.sents, []) as sents, coalesce(p.spaces, []) as spaces,
    greatest(cast(floor({float(budget)}::double * (cast(s.b - s.a as double) / greatest({size(bytes_of('w.h', 's.a', 's.b'))}, 1))) as bigint), 1) as win,
    greatest(cast(floor({float(overlap)}::double * (cast(s.b - s.a as double) / greatest({size(bytes_of('w.h', 's.a', 's.b'))}, 1))) as bigint), 0) as ov
  from {spans} s join whole w on w.id = s.id left join {name}_sent t on t.id = s.id left join {name}_sp p on p.id = s.id),
{name}_r(g, piece, since, stop) as (
  {_step(name, "cast(a as bigint)", "cast(0 as bigint)", f"{name}_in")}
  union all
  {_step(name, "next_at", "piece + 1", f"(select i.*, r.piece, {_rune('greatest(r.stop - i.ov, r.since + 1)', 1, '-1')} as next_at from {name}_r r join {name}_in i on i.g = r.g where r.stop < i.b)")}),
{name} as (select r.g, r.piece, r.since, r.stop from {name}_r r)"""


def _step(name: str, at: str, piece: str, source: str) -> str:
    """One piece of each span that isn't done, from ``at`` on."""
    cut = """case when since + win >= b then b else coalesce(
        list_max(list_filter(sents, lambda p: p >= since + win - win // 4 and p + 2 <= since + win)) + 1,
        list_max(list_transform(list_filter(spaces, lambda s: s.p >= since + win - win // 4 and s.e <= since + win), lambda s: s.p)), since + win) end"""
    floor = f"select *, {_rune('stop0', -1, 'since')} as stop1 from (select *, cast({cut} as bigint) as stop0 from (select *, {at} as since, {piece} as piece_no from {source}))"
    return f"select g, piece_no, since, cast(case when stop1 <= since then {_rune('since + 1', 1, '-1')} else stop1 end as bigint) from ({floor})"


def chunks(texts: str, budget: int, overlap: int, boundaries: str = "paragraphs", units: str | None = None) -> str:
    """CTEs ending in ``chunks(id, chunk_index, text, start_byte, end_byte, token_count)``.

    ``units`` may be a query of ``id, k, a, b`` over the trimmed texts in place of a segmentation.
    """
    segments = f"units as ({units})" if units else headings("whole") if boundaries == "headings" else paragraphs("whole")
    return f"""{whole(texts)},
{segments},
parts as (select u.id as g, u.k, u.a, u.b, {size(bytes_of('w.h', 'u.a', 'u.b'))} as tok from units u join whole w on w.id = u.id),
{_packed('p1', 'parts', budget, overlap)},
big as (select p.g || '~' || p.seq as u, p.g as id, p.seq, p.a, p.b, {bytes_of('w.h', 'p.a', 'p.b')} as t from p1 p join whole w on w.id = p.g where p.over),
{lines('bl', 'big', 'u', 't', 'a')},
{fences('bf', 'bl', 'u')},
fenced as (select u from bf where run <> '' group by u),
regions(u, n, opened, r, code) as (
  select u, n, run, cast(0 as bigint), run <> '' from bf where n = 0 and u in (select u from fenced)
  union all
  select f.u, f.n, case when s.opened <> '' then case when {_CLOSES} then '' else s.opened end else f.run end,
    case when s.opened <> '' then s.r else s.r + 1 end, s.opened <> '' or f.run <> ''
  from regions s join bf f on f.u = s.u and f.n = s.n + 1),
rparts as (select r.u as g, r.r as k, min(f.a) as a, max(f.b) as b, bool_or(r.code) as code from regions r join bf f on f.u = r.u and f.n = r.n group by 1, 2),
rtok as (select p.*, {size(bytes_of('w.h', 'p.a', 'p.b'))} as tok from rparts p join big x on x.u = p.g join whole w on w.id = x.id),
{_packed('p2', 'rtok', budget, overlap)},
code as (select p.g || '~' || p.seq as v, p.g as u, p.a, p.b from p2 p join rparts r on r.g = p.g and r.k = p.i where p.over and r.code),
cl as (select c.v as g, f.n - min(f.n) over (partition by c.v) as k, f.a, f.b, c.u from code c join bf f on f.u = c.u and f.a >= c.a and f.b <= c.b),
cparts as (select c.g, c.k, c.a, c.b, {size(bytes_of('w.h', 'c.a', 'c.b'))} as tok from cl c join big x on x.u = c.u join whole w on w.id = x.id),
{_packed('p3', 'cparts', budget, overlap)},
plain as (
  select b.u as g, b.id, b.a, b.b from big b where b.u not in (select u from fenced)
  union all select p.g || '~' || p.seq, x.id, p.a, p.b from p2 p join big x on x.u = p.g join rparts r on r.g = p.g and r.k = p.i where p.over and not r.code
  union all select p.g || '~' || p.seq, x.id, p.a, p.b from p3 p join code c on c.v = p.g join big x on x.u = c.u where p.over),
{_prose('cuts', 'plain', budget, overlap)},
found as (
  select g as id, [seq] as place, a, b, tok from p1 where not over
  union all select x.id, [x.seq, p.seq], p.a, p.b, p.tok from p2 p join big x on x.u = p.g where not p.over
  union all select x.id, [x.seq, q.seq, p.seq], p.a, p.b, p.tok from p3 p join code c on c.v = p.g join p2 q on q.g || '~' || q.seq = c.v join big x on x.u = c.u where not p.over
  union all select b.id, [b.seq, c.piece], c.since, c.stop, -1 from cuts c join big b on b.u = c.g
  union all select x.id, [x.seq, q.seq, c.piece], c.since, c.stop, -1 from cuts c join p2 q on q.g || '~' || q.seq = c.g join big x on x.u = q.g
  union all select x.id, [x.seq, q.seq, p.seq, c.piece], c.since, c.stop, -1 from cuts c join p3 p on p.g || '~' || p.seq = c.g join p2 q on q.g || '~' || q.seq = p.g join big x on x.u = q.g),
chunks as (select f.id, cast(row_number() over (partition by f.id order by f.place) - 1 as int) as chunk_index, {bytes_of('w.h', 'f.a', 'f.b')} as text,
    cast(f.a + w.off as int) as start_byte, cast(f.b + w.off as int) as end_byte,
    cast(case when f.tok >= 0 then f.tok else {size(bytes_of('w.h', 'f.a', 'f.b'))} end as int) as token_count
  from found f join whole w on w.id = f.id)"""
