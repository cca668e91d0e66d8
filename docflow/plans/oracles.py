"""SQL (DuckDB) for the registered queries; names and columns are those of :mod:`docflow.plans.queries`."""

from __future__ import annotations

from docflow.plans import chunk_sql as cs

# Unicode's White_Space as a class of RE2.
WS = r"[\x{09}-\x{0d}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_WS = "[^" + WS[1:]
#: The same without the line feed.
INLINE_WS = WS.replace(r"\x{09}-\x{0d}", r"\x{09}\x{0b}-\x{0d}")
_TOKEN = r"[!#$%&''*+.^_`|~0-9A-Za-z-]+"
_VALID = rf'^{_TOKEN}(?:/{_TOKEN})?{WS}*(?:{WS}*;{WS}*{_TOKEN}=(?:{_TOKEN}|"(?:[^"\\\r\n]|\\.)*"){WS}*)*(?:;{WS}*)?$'


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def normal(x: str) -> str:
    """White space normalised."""
    lines = f"regexp_replace({x}, '{INLINE_WS}*\\n{INLINE_WS}*', chr(10), 'g')"
    return trim(f"regexp_replace({lines}, '\\n{{2,}}', chr(10) || chr(10), 'g')")


def size(x: str) -> str:
    return f"cast((length({x}) + 3) // 4 as int)"


def canonical(x: str) -> str:
    return f"case when {valid(x)} then lower({trim(f'split_part({x}, chr(59), 1)')}) end"


def valid(x: str) -> str:
    return f"coalesce(regexp_matches({trim(x)}, '{_VALID}'), false)"


KINDS = (
    "application/pdf", "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "text/html", "text/markdown", "text/plain", "text/x-markdown",
)
_IN_KINDS = "(" + ", ".join(f"'{k}'" for k in KINDS) + ")"

INPUTS = "inputs_once as (select pos, min({'s': source_id, 'a': artifact_id, 'c': chunk, 't': title}) as r from inputs where pos is not null group by pos)"
ERROR = f"""case when coalesce(r.a, '') = '' then 'EMBED_MISSING_ARTIFACT_ID' when coalesce(r.s, '') = '' then 'EMBED_MISSING_SOURCE_ID'
  when not coalesce(regexp_matches(r.c."text", '{NOT_WS}'), false) then 'EMBED_EMPTY_TEXT' when r.c."index" < 0 then 'EMBED_NEGATIVE_INDEX' end"""
TOKENS = f"""case when r.c.token_count > 0 then r.c.token_count else {size('r.c."text"')} end"""
VALID = f"{INPUTS}, good as (select pos, r, cast({TOKENS} as int) as tokens from inputs_once where {ERROR} is null)"

TEXTS = "texts as (select id, min(text) as text from artifacts where text is not null and id is not null group by id)"
STORE = "store as (select object_key as key, max(size) as size from store_objects where object_key is not null group by 1)"
KEYS = "keys as (select distinct raw.key as key from sources where raw.key is not null)"
PAGES = "pages as (select source_id, page_no, max({'w': width, 'h': height, 'r': rotation, 'words': words}) as p from page_layouts group by 1, 2)"
WORDS = f"{PAGES}, ws as (select source_id, page_no, unnest(range(len(p.words))) as k, unnest(p.words) as w from pages)"
CHUNKS = "parts as (select distinct artifact_id, chunk_index, text, start_byte, end_byte from chunks)"


def packing(max_inputs: int, max_tokens: int) -> str:
    return f"""
with recursive {VALID}, d as (select row_number() over (order by pos) - 1 as i, pos, tokens from good),
r(i, pos, bid, n, s) as (
  select i, pos, cast(0 as bigint), cast(1 as bigint), cast(tokens as bigint) from d where i = 0
  union all
  select d.i, d.pos, case when r.n >= {max_inputs} or r.s + d.tokens > {max_tokens} then r.bid + 1 else r.bid end,
    case when r.n >= {max_inputs} or r.s + d.tokens > {max_tokens} then 1 else r.n + 1 end,
    case when r.n >= {max_inputs} or r.s + d.tokens > {max_tokens} then d.tokens else r.s + d.tokens end
  from r join d on d.i = r.i + 1)
select pos, bid as batch_id from r"""


VOLUME = "concat_ws('#', source_id, cast(floor(page_no / 1000) as bigint)) as source_id"
#: Pages of layouts numbered within their volume.
NUMBERED = f"{PAGES}, vol as (select {VOLUME}, page_no, p from pages where p.words is not null), numbered as (select source_id, row_number() over (partition by source_id order by page_no) as number, p from vol)"


def _finite(x: str) -> str:
    return f"case when isnan({x}) then 0 else {x} end"


#: Words of pages in rows: ``i`` is the order from the top, ``q`` that in which they are written.
ROWS = f"""{WORDS},
f as (select source_id, page_no, k, coalesce(w."text", '') as t, {_finite('w.box.x0')} as x0, {_finite('w.box.x1')} as x1, {_finite('w.box.y0')} as y0, {_finite('w.box.y1')} as y1 from ws),
o as (select *, least(y0, y1) as a, greatest(y0, y1) as b, row_number() over (partition by source_id, page_no order by y0, k) as i from f),
r(source_id, page_no, i, row, top, bottom) as (
  select source_id, page_no, i, 0, a, b from o where i = 1
  union all
  select o.source_id, o.page_no, o.i, case when joins then r.row else r.row + 1 end, case when joins then least(r.top, o.a) else o.a end, case when joins then greatest(r.bottom, o.b) else o.b end
  from (select r.*, o.a, o.b, o.i as oi, least(r.bottom, o.b) - greatest(r.top, o.a) >= 0 and least(r.bottom, o.b) - greatest(r.top, o.a) >= 0.5 * least(r.bottom - r.top, o.b - o.a) as joins
    from r join o on o.source_id = r.source_id and o.page_no = r.page_no and o.i = r.i + 1) r
  join o on o.source_id = r.source_id and o.page_no = r.page_no and o.i = r.oi),
units as (select source_id, page_no, row, greatest(coalesce(median((x1 - x0) / length(t)) filter (t <> '' and x1 - x0 > 0 and x1 - x0 < 'inf'::double), 1.0), 1.0) as unit
  from r join o using (source_id, page_no, i) group by 1, 2, 3),
placed as (select o.*, r.row, row_number() over (partition by source_id, page_no order by r.row, o.x0, i) as q from r join o using (source_id, page_no, i)),
written as (select *, lag(row) over w as row0, lag(x1) over w as end0 from placed where t <> '' window w as (partition by source_id, page_no order by q)),
seps as (select w.source_id, w.page_no, w.k, w.q, w.t, case when row0 is null then '' when row0 <> w.row then chr(10)
  else repeat(' ', cast(least(greatest(round((w.x0 - end0) / u.unit), 1), 8) as int)) end as sep from written w join units u using (source_id, page_no, row))"""


def _hashed_pages(seps: str) -> str:
    """``source_id, page_no, t``: texts of pages from ``(source_id, page_no, q, t, sep)``."""
    return f"""select g.source_id, g.page_no, coalesce(string_agg(sep || t, '' order by q), '') as t from (select source_id, page_no from pages where p.words is not null) g
        left join {seps} s on s.source_id = g.source_id and s.page_no = g.page_no group by 1, 2"""


#: A text as it comes back from an archive whose parts can only hold XML's characters.
_XML_TEXT = r"regexp_replace(text, '[^\x09\x0a\x20-\x{d7ff}\x{e000}-\x{fffd}\x{10000}-\x{10ffff}]', ' ', 'g')"
_ARCHIVE = f"""with x as (select doc_id, {normal(f"replace({_XML_TEXT}, chr(10), chr(10) || chr(10))")} as t from documents where text is not null)
        select cast(doc_id as varchar) as id, case when t <> '' then sha256(t) end as hash, case when t = '' then 'NO_CONTENT' end as error from x"""
_FNV = "1099511628211::hugeint % 18446744073709551616::hugeint"
_HEX = "'0123456789ABCDEF'"


_BLOCK = r"[ \t\r]*\n(?s:.*?\n)??"
#: Markdown without its byte-order mark and front matter.
_MARKDOWN = (
    "regexp_replace(case when regexp_matches(text, '^\\x{FEFF}?---') then regexp_replace(text, '^\\x{FEFF}?---" + _BLOCK + "---[ \\t\\r]*(?:\\n|$)', '')"
    + " else regexp_replace(text, '^\\x{FEFF}?\\+\\+\\+" + _BLOCK + "\\+\\+\\+[ \\t\\r]*(?:\\n|$)', '') end, '^\\x{FEFF}', '')"
)


def _hash_vectors(key: str, source: str, text: str) -> str:
    """``key, vector`` of eight numbers from hashes of the text's bytes and the number's place."""
    return f"""h as (select {key}, regexp_extract_all(hex(encode(coalesce({text}, ''))), '..') as p from {source}),
        s as (select {key}, list_reduce(list_prepend(14695981039346656037::hugeint, list_transform(p, lambda q: ((instr({_HEX}, left(q, 1)) - 1) * 16 + instr({_HEX}, right(q, 1)) - 1)::hugeint)),
          lambda a, x: xor(a, x) * {_FNV}) as st from h)
        select {key}, list_transform(range(48, 56), lambda k: cast((xor(st, k::hugeint) * {_FNV}) % 2000 as float) / cast(1000 as float) - cast(1 as float)) as vector from s"""


def _chunked(texts: str, budget: int, overlap: int, columns: str, boundaries: str = "paragraphs", units: str | None = None, more: str = "") -> str:
    return f"with recursive {more}{cs.chunks(texts, budget, overlap, boundaries, units)} select {columns} from chunks"


_SPAN_COLUMNS = "id, chunk_index, start_byte, end_byte, token_count"
_ALL_COLUMNS = "chunk_index, text, start_byte, end_byte, token_count"
_PAGE_UNITS = f"""pt as (select {VOLUME}, page_no, {trim('max(text)')} as t from page_texts group by source_id, page_no having regexp_matches(max(text), '{NOT_WS}')),
ps as (select source_id, t, row_number() over w - 1 as k, sum(strlen(t) + 2) over w - strlen(t) - 2 as a from pt window w as (partition by source_id order by page_no)), """

SQL: dict[str, str] = {
    "content_hash": "select doc_id, sha256(text) as hash, cast(strlen(text) as bigint) as n_bytes from documents",
    "token_estimate": f"select doc_id, {size('text')} as tokens from documents",
    "media_canonical": f"""with k as (select media_type from sources union select media_type from artifacts)
        select media_type, {canonical('media_type')} as canonical, {valid('media_type')} as valid from k""",
    "normalize_whitespace": f"select doc_id, {normal('text')} as normal from documents",
    "front_matter": r"""select doc_id, case doc_id % 3 when 1 then
          case when regexp_matches(t, '^\+\+\+[ \t\r]*\n(?s:.*?\n)??\+\+\+[ \t\r]*(?:\n|$)') then regexp_replace(t, '^\+\+\+[ \t\r]*\n(?s:.*?\n)??\+\+\+[ \t\r]*(?:\n|$)', '') else t end
          else text end as body
        from (select doc_id, text, case doc_id % 3 when 0 then '---' || chr(10) || 'title: x' || chr(10) || '---' || chr(10)
          when 1 then '+++' || chr(10) || 'open' || chr(10) else '+++ ' || chr(10) || 'a = 1' || chr(10) || '+++' || chr(10) end || text as t from documents where text is not null)""",
    "bom_strip": "select doc_id, cast(length(regexp_replace(text, '^\\x{FEFF}', '')) as int) as n from documents where doc_id % 2 = 1 union all select doc_id, cast(length(text) as int) from documents where doc_id % 2 = 0",
    "request_ids": "select distinct pos, 'in-' || pos as request_id from inputs where pos is not null",
    "utf8_repair": f"""with b as (select doc_id, 'a' || chr(65533) || text || case when text <> '' then chr(65533) else '' end || ' z' as t from documents where text is not null)
        select cast(doc_id as varchar) as id, sha256({normal('t')}) as hash from b""",
    "source_validate": """select case when coalesce(id, '') = '' then 'MISSING_ID' when coalesce(media_type, '') = '' then 'MISSING_MEDIA_TYPE' end as error,
        count(*) as n from sources group by 1""",
    "artifact_validate": """select distinct id, case when coalesce(id, '') = '' then 'MISSING_ID' when coalesce(media_type, '') = '' then 'MISSING_MEDIA_TYPE'
        when coalesce(derived_from, '') = '' then 'MISSING_PARENT' end as error from artifacts""",
    "text_artifacts": "select distinct id from artifacts where blob is null and coalesce(text, '') <> ''",
    "text_artifact": "select 'doc-' || doc_id as derived_from, '' as id, 'text/plain' as media_type, true as no_blob, cast(length(text) as int) as length from documents where text is not null",
    "single_text_artifact": """with a as (select distinct id, derived_from, text, blob from artifacts),
        g as (select derived_from, cast(count(*) filter (blob is null and coalesce(text, '') <> '') as bigint) as n,
          min(text) filter (blob is null and coalesce(text, '') <> '') as t from a group by 1)
        select derived_from, n, cast(case when n = 1 then length(t) end as int) as length,
          case when n = 0 then 'NO_TEXT_ARTIFACT' when n > 1 then 'MULTIPLE_TEXT_ARTIFACTS' end as error from g""",
    "provenance_children": "select derived_from as parent, count(distinct id) as children from artifacts where coalesce(derived_from, '') <> '' group by 1",
    "provenance_roots": """with recursive p as (select id, min(coalesce(derived_from, '')) as up from artifacts where coalesce(id, '') <> '' group by 1),
        w(id, up, depth) as (select id, up, 1 from p union all select w.id, p.up, w.depth + 1 from w join p on p.id = w.up where w.depth < 64)
        select id, up as root, depth from w where not exists (select 1 from p where p.id = w.up)""",
    "provenance_sources": """select distinct a.id, exists (select 1 from sources s where s.id = a.derived_from) as from_source from artifacts a""",
    "registry_supports": f"select distinct id, coalesce({canonical('media_type')} in {_IN_KINDS}, false) as supported from sources",
    "registry_dispatch": f"""with {STORE} select distinct s.id, s.media_type, case when coalesce(s.id, '') = '' then 'MISSING_PARENT_ID'
        when {canonical('s.media_type')} is null then 'INVALID_MEDIA_TYPE' when {canonical('s.media_type')} not in {_IN_KINDS} then 'UNSUPPORTED_MEDIA_TYPE'
        when t.size > 4000000 then 'SOURCE_TOO_LARGE' end as error from sources s left join store t on t.key = s.raw.key""",
    "size_guard": "select doc_id, cast(strlen(text) as bigint) as n_bytes from documents where strlen(text) > 4096",
    "text_extract": f"""with n as (select doc_id, {normal('text')} as t from documents where text is not null)
        select cast(doc_id as varchar) as id, nullif(t, '') as text, case when t = '' then 'NO_CONTENT' end as error from n""",
    "markdown_extract": f"""select cast(doc_id as varchar) as id, case when regexp_matches(text, '{NOT_WS}') then 'text/markdown' end as media_type,
        case when regexp_matches(text, '{NOT_WS}') then text end as text, case when not regexp_matches(text, '{NOT_WS}') then 'NO_CONTENT' end as error from documents where text is not null""",
    "docx_extract": _ARCHIVE,
    "html_extract": rf"""with x as (select doc_id, {normal("regexp_replace(text, '[" + chr(92) + "x00-" + chr(92) + "x08" + chr(92) + "x0b-" + chr(92) + "x1f]', ' ', 'g')")} as t from documents where text is not null)
        select cast(doc_id as varchar) as id, case when t <> '' then md5(regexp_replace(t, '[ \t\n\x0b\f\r]+', '', 'g')) end as letters, case when t = '' then 'NO_CONTENT' end as error from x""",
    "pdf_extract": rf"""with x as (select doc_id, {normal("regexp_replace(coalesce(text, ''), '[^" + chr(92) + "x00-" + chr(92) + "xff]', '?', 'g')")} as t from documents)
        select cast(doc_id as varchar) as id, case when t <> '' then '1' end as page, case when t <> '' then cast(length(t) as int) end as length, case when t = '' then 'NO_CONTENT' end as error from x""",
    "paragraph_units": rf"""with {TEXTS}, u as (select id, regexp_extract_all(text, '(?s).*?\n(?:\r?\n)+|.+$') as u from texts),
        f as (select id, unnest(range(len(u))) as unit, unnest(u) as p from u)
        select id, cast(unit as int) as unit, cast(sum(strlen(p)) over (partition by id order by unit) - strlen(p) as int) as start,
          cast(sum(strlen(p)) over (partition by id order by unit) as int) as "end" from f""",
    "line_marks": rf"""with {TEXTS}, l as (select id, unnest(range(len(x))) as n, unnest(x) as line from (select id, regexp_split_to_array(text, '\r?\n') as x from texts))
        select id, cast(n as int) as n, cast(length(regexp_extract(line, '^ {{0,3}}(#{{1,6}})(?:[ \t]|$)', 1)) as int) as atx, regexp_matches(line, '^ {{0,3}}(?:=+|-+)[ \t]*$') as setext,
          regexp_matches(line, '^ {{0,3}}(?:`{{3,}}[^`]*$|~{{3,}})') as fence from l
        where regexp_matches(line, '^ {{0,3}}#{{1,6}}(?:[ \t]|$)') or regexp_matches(line, '^ {{0,3}}(?:=+|-+)[ \t]*$') or regexp_matches(line, '^ {{0,3}}(?:`{{3,}}[^`]*$|~{{3,}})')""",
    "heading_units": f"with recursive {TEXTS}, raw as (select id, text as t, strlen(text) as n from texts where text <> ''), {cs.headings('raw')} select id, cast(k as int) as unit, cast(a as int) as start, cast(b as int) as \"end\" from units",
    "chunk_pack": _chunked("select id, text from texts", 400, 0, _SPAN_COLUMNS, more=TEXTS + ", "),
    "chunk_pack_overlap": _chunked("select id, text from texts", 400, 150, _SPAN_COLUMNS, more=TEXTS + ", "),
    "chunk_headings": _chunked("select id, text from texts", 256, 32, "id, " + _ALL_COLUMNS, "headings", more=TEXTS + ", "),
    "chunk_hard_split": _chunked("select doc_id as id, regexp_replace(text, '\\n+', ' ', 'g') as text from documents", 96, 16, "id as doc_id, " + _ALL_COLUMNS),
    "chunk_defaults": _chunked("select doc_id as id, text from documents", 512, 64, "id as doc_id, chunk_index, start_byte, end_byte, token_count"),
    "chunk_fenced": _chunked(
        "select doc_id as id, 'intro' || chr(10) || '```' || chr(10) || regexp_replace(text, '([.;]) ', '\\1' || chr(10), 'g') || chr(10) || '```' || chr(10) || 'end' as text from documents",
        64, 8, "id as doc_id, " + _ALL_COLUMNS,
    ),
    "chunk_pages": _chunked(
        "select source_id as id, string_agg(t, chr(10) || chr(10) order by k) as text from ps group by 1", 900, 0,
        "id as source_id, chunk_index, start_byte, end_byte, token_count", units="select source_id as id, k, a, a + strlen(t) as b from ps", more=_PAGE_UNITS,
    ),
    "fake_vectors": f"with {_hash_vectors('doc_id', 'documents', 'text')}",
    "embed_vectors": f"with {VALID}, {_hash_vectors('pos', 'good', 'r.c.text')}",
    "chunk_small": f"""with n as (select doc_id, {normal('text')} as t from documents where regexp_matches(text, '{NOT_WS}') and (length(text) + 3) // 4 <= 384)
        select doc_id, cast(1 as bigint) as chunks, cast(strlen(t) as int) as end_byte from n""",
    "embed_validate": f"with {INPUTS} select pos, {ERROR} as error from inputs_once",
    "embed_tokens": f"with {VALID} select pos, tokens from good",
    "embed_batches": packing(96, 20_000),
    "embed_batches_by_count": f"with {VALID} select pos, cast((row_number() over (order by pos) - 1) // 32 as bigint) as batch_id from good",
    "embed_records": f"""with {VALID} select pos, r.s as source_id, r.a as artifact_id, r.c."index" as chunk_index, 8 as dims, tokens as token_count,
        'local' as provider, 'hash' as name from good""",
    "embed_dimensions": f"with {VALID} select 5 as dims, count(*) as n from good having count(*) > 0",
    "embed_block_records": f"""with {VALID} select pos, r.s as source_id, r.a as artifact_id, r.c."index" as chunk_index, 8 as dims, tokens as token_count from good""",
    "embed_poison_records": f"""with {VALID} select pos from good where length(r.c."text") % 97 <> 0""",
    "embed_poison_failures": f"""with {INPUTS} select pos as first_pos, 1 as n, coalesce({ERROR}, 'refused') as code, {ERROR} is null as retryable from inputs_once
        where {ERROR} is not null or length(r.c."text") % 97 = 0""",
    "embed_mismatch": f"with {VALID} select 'EMBED_RESPONSE_MISMATCH' as error_code, false as retryable, count(*) as inputs from good having count(*) > 0",
    "embed_response_match": """with l as (select distinct pos from inputs where pos is not null), r as (select distinct pos from records where pos is not null)
        select case when l.pos is not null then 1 end as asked, case when r.pos is not null then 1 end as answered, count(*) as n from l full join r on l.pos = r.pos group by 1, 2""",
    "store_get": f"with {STORE}, {KEYS} select k.key, s.size, case when s.key is null then 'OBJECT_NOT_FOUND' end as error from keys k left join store s on s.key = k.key",
    "store_exists": f"with {STORE}, {KEYS} select key, key in (select key from store) as exists from keys",
    "store_put": f"with {STORE}, {KEYS} select key, size from store where key not in (select key from keys) union all select key, cast(length(key) as bigint) from keys",
    "store_delete": f"""with {STORE}, {KEYS} select key, 'left' as state from store where key not in (select key from keys)
        union all select key, 'missing' from keys where key not in (select key from store)""",
    "store_delete_if_exists": f"with {STORE}, {KEYS} select key from store where key not in (select key from keys)",
    "store_list": f"with {STORE} select key, size from store where starts_with(key, 'raw/0') order by key",
    "store_range": """with d as (select doc_id, encode(text) as b, octet_length(encode(text)) as n, doc_id * 37 % 900 - 20 as o, doc_id * 11 % 120 - 5 as l from documents)
        select doc_id, case when o < 0 then 'INVALID_ARGUMENT' when n is null then 'OBJECT_NOT_FOUND' when o >= n then 'RANGE_NOT_SATISFIABLE' end as error,
          case when o >= 0 and o < n then lower(substr(hex(b), cast(2 * o + 1 as bigint), cast(2 * case when l < 0 or l > n - o then n - o else l end as bigint))) end as bytes from d""",
    "store_compose": f"""with {CHUNKS}, g as (select artifact_id as key, count(*) as n, string_agg(text, '' order by chunk_index) as t from parts group by 1)
        select key, case when n <= 32 then sha256(t) end as hash, case when n > 32 then 'INVALID_ARGUMENT' end as error from g""",
    "store_compose_levels": f"with {CHUNKS} select artifact_id as key, sha256(string_agg(text, '' order by chunk_index)) as hash from parts group by 1",
    "chunk_integrity": f"""with {CHUNKS}, {TEXTS} select p.artifact_id, p.chunk_index,
        hex(encode(p.text)) = substr(hex(encode(t.text)), 2 * p.start_byte + 1, 2 * (p.end_byte - p.start_byte)) as same from parts p join texts t on t.id = p.artifact_id""",
    "pdf_split_pages": f"""with p as (select {VOLUME}, page_no, max(text) as text from page_texts group by page_texts.source_id, page_no)
        select source_id, cast(row_number() over (partition by source_id order by page_no) as int) as number, sha256(text) as hash from p""",
    "pdf_tsv_words": f"""with {NUMBERED},
        ws as (select source_id, number, unnest(range(len(p.words))) as k, unnest(p.words) as w from numbered),
        f as (select *, min(k) over (partition by source_id, number, w.block) as fb, min(k) over (partition by source_id, number, w.block, w.line) as fl from ws)
        select source_id, cast(number as int) as page, cast(k as int) as word_no, w."text" as "text", round(w.box.x0 + (w.box.x1 - w.box.x0), 4) as x1,
          cast(dense_rank() over (partition by source_id, number order by fb) - 1 as int) as block, cast(dense_rank() over (partition by source_id, number order by fl) - 1 as int) as line, w.conf as conf from f""",
    "pdf_geometry": f"""with {PAGES}, t as (select {VOLUME}, page_no as number, p.w as w, p.h as h, page_no % 6 * 90 - 180 as turn from pages where page_no % 11 <> 0)
        select source_id, number, case when (turn + 360) % 180 = 90 then h else w end as width, case when (turn + 360) % 180 = 90 then w else h end as height, cast((turn + 360) % 360 as int) as rotation from t""",
    "pdf_reading_order": f"""with {WORDS}, s as (select source_id, page_no, k, w."text" as t, case when k = 0 then ''
          when w.block <> lag(w.block) over q then chr(10) || chr(10) when w.line <> lag(w.line) over q then chr(10) else ' ' end as sep from ws window q as (partition by source_id, page_no order by k))
        select g.source_id, g.page_no, sha256(coalesce(string_agg(sep || t, '' order by k), '')) as hash from (select source_id, page_no from pages where p.words is not null) g
        left join s on s.source_id = g.source_id and s.page_no = g.page_no group by 1, 2""",
    "pdf_reading_order_kernel": f"""with recursive {WORDS},
        c as (select source_id, page_no, k, coalesce(w."text", '') as t, case when w.block <> lag(w.block) over q then 1 else 0 end as nb, case when w.line <> lag(w.line) over q then 1 else 0 end as nl
          from ws window q as (partition by source_id, page_no order by k)),
        d as (select source_id, page_no, k as q, t, sum(nb) over w as b, sum(nl) over w as l from c window w as (partition by source_id, page_no order by k)),
        s as (select source_id, page_no, q, t, case when lag(b) over w is null then '' when b > lag(b) over w then chr(10) || chr(10) when l > lag(l) over w then chr(10) else ' ' end as sep
          from d where t <> '' window w as (partition by source_id, page_no order by q)),
        h as ({_hashed_pages('s')})
        select h.source_id, h.page_no, sha256(h.t) as hash, cast(len(p.words) as int) as words from h join pages using (source_id, page_no)""",
    "pdf_rows": f"with recursive {ROWS}, h as ({_hashed_pages('seps')}) select source_id, page_no, sha256(t) as hash, cast(length(t) as int) as length from h",
    "pdf_spans": f"""with recursive {ROWS}, every as (select p.source_id, p.page_no, p.k, p.t, sum(coalesce(strlen(s.sep || s.t), 0)) over (partition by p.source_id, p.page_no order by p.q) as e
          from placed p left join seps s using (source_id, page_no, k))
        select source_id, page_no, cast(k as int) as word_no, cast(e - strlen(t) as int) as start, cast(e as int) as "end" from every""",
    "pdf_char_unit": f"with recursive {ROWS} select source_id, page_no, cast(row as int) as row, round(unit, 6) as unit from units",
    "pdf_program_pages": f"""with p as (select {VOLUME}, page_no, max(text) as text from page_texts group by page_texts.source_id, page_no),
        n as (select source_id, cast(row_number() over (partition by source_id order by page_no) as int) as page, {normal("coalesce(text, '')")} as t from p)
        select source_id, page, sha256(t) as hash, cast(null as varchar) as error from n where t <> ''""",
    "pdf_program_layout": f"""with {NUMBERED} select source_id, cast(number as int) as page, case when coalesce(p.r, 0) % 180 = 0 then p.w else p.h end as width,
          case when coalesce(p.r, 0) % 180 = 0 then p.h else p.w end as height, cast((coalesce(p.r, 0) % 360 + 360) % 360 as int) as rotation, cast(len(p.words) as int) as words,
          sha256(coalesce(array_to_string(list_transform(p.words, lambda w: w."text"), ' '), '')) as hash, cast(null as varchar) as error from numbered""",
    "pdf_program_render": f"""with {NUMBERED}, o as (select source_id, case when coalesce(p.r, 0) % 180 = 0 then p.w else p.h end as w, case when coalesce(p.r, 0) % 180 = 0 then p.h else p.w end as h from numbered where number = 1),
        f as (select *, least(300.0 / 72.0, 2000 / greatest(w, h)) as f from o), s as (select *, cast(least(greatest(round(w * f), 1), 2000) as int) as x, cast(least(greatest(round(h * f), 1), 2000) as int) as y from f)
        select source_id, x as width, y as height, round(x / w, 6) as scale_x, cast(null as varchar) as error from s""",
    "pdf_gap_spaces": f"""with {WORDS}, g as (select source_id, page_no, k, w.box.x0 - lag(w.box.x1) over (partition by source_id, page_no, w.line order by k) as gap from ws)
        select source_id, page_no, cast(k as int) as k, cast(least(greatest(round(gap / 5.0), 1), 8) as int) as spaces from g where gap is not null""",
    "word_conf": f"""with {WORDS}, c as (select source_id, page_no, k, w.conf * 1.5 - 0.5 as c from ws)
        select source_id, page_no, cast(k as int) as word_no, cast(case when c < 0 then -1 when c > 100 then 100 else round(c) end as int) as conf from c""",
    "render_pixel_size": f"""with {PAGES}, s as (select source_id, page_no, p.w as w, p.h as h, least([72.0, 150.0, 300.0, 0.01][page_no % 4 + 1] / 72.0, 2048 / greatest(p.w, p.h)) as f from pages)
        select source_id, page_no, cast(least(greatest(round(w * f), 1), 2048) as int) as w, cast(least(greatest(round(h * f), 1), 2048) as int) as h from s""",
    "render_options": f"""with {PAGES}, k as (select source_id, page_no, page_no % 7 as k from pages)
        select source_id, page_no, cast(case when k = 3 then -1.0 else 150.0 end as double) as dpi, case when k = 4 then 20000 else 2048 end as pixels, case when k = 5 then 101 else 85 end as quality,
          case when k between 1 and 5 or page_no < 1 or page_no > 40000 then 'INVALID_OPTIONS' end as error,
          case when k = 2 then 'Format(9)' when k % 2 = 0 then 'png' else 'jpeg' end as format, case when k = 2 then '' when k % 2 = 0 then 'image/png' else 'image/jpeg' end as media from k""",
    "layout_json": f"""with {PAGES} select {VOLUME}, page_no, p.w as width, sha256(coalesce(array_to_string(list_transform(p.words, lambda w: w."text"), ' '), '')) as hash,
        round(coalesce(list_sum(list_transform(p.words, lambda w: w.box.x1 + w.conf)), 0), 3) as sum from pages""",
    "page_zip": f"""with {PAGES}, t as (select source_id, page_no, max(len(spans)) as spans from page_texts group by 1, 2)
        select coalesce(l.source_id, t.source_id) as source_id, coalesce(l.page_no, t.page_no) as page_no, cast(len(l.p.words) as int) as words, cast(t.spans as int) as spans,
          len(l.p.words) is not distinct from t.spans as agree from pages l full join t on t.source_id = l.source_id and t.page_no = l.page_no""",
    "page_citation": """with p as (select source_id, page_no, strlen(max(text)) as n from page_texts group by 1, 2),
        s as (select source_id, page_no, coalesce(n, 0) as n, sum(coalesce(n, 0)) over (partition by source_id order by page_no) as e from p)
        select source_id, page_no, cast(k * 500 as bigint) as byte from s, unnest(range(0, 1 + cast(e // 500 as bigint))) u(k) where k * 500 >= e - n and k * 500 < e""",
    "slide_order": """with f as (select doc_id, unnest(range(1, 2 + coalesce(n_chars, 0) % 12)) as num from documents)
        select doc_id, 'ppt/slides/slide' || num || '.xml' as name,
          cast(row_number() over (partition by doc_id order by case when num % 3 = 0 then 1 else 0 end, case when num % 3 = 0 then num else -num end) - 1 as int) as rank from f""",
    "flagship": "with recursive "
    + cs.chunks(
        f"""select doc_id as id, case when {canonical('media_type')} = 'text/markdown' then {_MARKDOWN} else {normal('text')} end as text
          from (select doc_id, coalesce(media_type, 'text/plain') as media_type, text from documents)""",
        512, 64, "headings",
    )
    + f""" select id * 1048576 + chunk_index as pos, cast(id as varchar) as source_id, id || '#0' as artifact_id, chunk_index, token_count, 8 as dims
        from chunks where regexp_matches(text, '{NOT_WS}')""",
}
SQL["pptx_extract"] = SQL["docx_extract"]
SQL["line_marks_kernel"] = SQL["line_marks"]
SQL["pdf_tsv_kernel"] = SQL["pdf_tsv_words"]
