"""The queries of this folder in DuckDB's SQL, written on their own and not derived from the Columns.

Where a step has no SQL (HTML parsing, compatibility characters, percent-encoding beyond ASCII, legacy charsets), its query has none; tests
hold those against brute force."""

from __future__ import annotations

from tidemark.plans import fixtures as fx

BLANK = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LINES = r"\r\n|[\n\x0b\f\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
URL = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
KANA, HAN, SIGNS = r"[\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{31F0}-\x{31FF}]", r"[\x{4E00}-\x{9FFF}]", "[，。、《》「」！？；：]"
SYMBOLS = r"""[~!@#$%^&*()_+\-=\[\]{},.<>?/\\|"''`：；・…—―※★☆◆■]"""


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{BLANK}]+|[{BLANK}]+$', '', 'g')"


def rstrip(x: str) -> str:
    return f"regexp_replace({x}, '[{BLANK}]+$', '')"


def lstrip(x: str) -> str:
    return f"regexp_replace({x}, '^[{BLANK}]+', '')"


def collapse(x: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace(replace({x}, chr(13), ''), '[ \\t\\x{{3000}}]+', ' ', 'g'), ' +\\n', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"


def clean(x: str) -> str:
    return strip(collapse(x))


def clip(x: str, n: int) -> str:
    return f"case when length({x}) > {n} then {rstrip(f'substring({x}, 1, {n})')} || '…' else {x} end"


def escape(x: str) -> str:
    return f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


def part(u: str, k: int) -> str:
    found = f"regexp_extract(regexp_replace({u}, '^[\\x00-\\x20]+|[\\t\\r\\n]', '', 'g'), '{URL}', {k})"
    return f"lower({found})" if k == 1 else found


def host(netloc: str) -> str:
    return f"lower(regexp_extract(regexp_replace({netloc}, '^.*@', ''), '^(\\[[^\\]]*\\]|[^:]*)', 1))"


def deamp(u: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace({u}, '/amp($|[/?#])', '/\\1', 'gi'), '(\\?|&)amp=1(&|$)', '\\1', 'gi'), '(\\?|&)output=amp(&|$)', '\\1', 'gi')"


def whole(scheme: str, netloc: str, path: str, query: str) -> str:
    return f"""(case when {scheme} <> '' then {scheme} || ':' else '' end
      || case when {netloc} <> '' then '//' || {netloc} || case when {path} <> '' and {path} not like '/%' then '/' else '' end || {path}
         when {scheme} in ('http', 'https', 'ftp') and {path} not like '//%' then '//' || {path} else {path} end
      || case when {query} <> '' then '?' || {query} else '' end)"""


def stripped_cte(source: str, into: str) -> str:
    """CTEs that turn source(key..., u) into `into`(key..., u) without tracking parameters."""
    key = "url_decode(replace(split_part(p, '=', 1), '+', ' '))"
    value = "url_decode(replace(case when contains(p, '=') then substring(p, instr(p, '=') + 1) else '' end, '+', ' '))"
    tracked = "('fbclid', 'gclid', 'mc_cid', 'mc_eid', 'igshid', 'ved', 'si', 'oc', 'spm', '_hsenc')"
    pairs = f"list_filter(list_transform(list_filter(string_split(q, '&'), lambda p: p <> ''), lambda p: struct_pack(k := {key}, v := {value})), lambda x: not (starts_with(lower(x.k), 'utm_') or lower(x.k) in {tracked}))"
    again = f"array_to_string(list_transform({pairs}, lambda x: replace(url_encode(x.k), '%20', '+') || '=' || replace(url_encode(x.v), '%20', '+')), '&')"
    return f"""{into}_p as (select * exclude (u), u as u0, {part('u', 1)} as s, {part('u', 2)} as n, {part('u', 3)} as p0, {part('u', 4)} as q from {source}),
{into}_q as (select * exclude (q), {again} as q from {into}_p),
{into} as (select * exclude (u0, s, n, p0, q), {whole('s', 'n', 'p0', 'q')} as u from {into}_q)"""


def repaired_cte(source: str, into: str) -> str:
    return f"""{into}_p as (select * exclude (u), {part('u', 1)} as s, {part('u', 2)} as n, {part('u', 3)} as p0, {part('u', 4)} as q from {source}),
{into}_b as (select * exclude (s, n, p0), case when s <> '' then s else 'https' end as s, case when n = '' and p0 <> '' then regexp_extract(p0, '(?s)^([^/]*)', 1) else n end as n,
   case when n = '' and p0 <> '' then regexp_extract(p0, '(?s)^[^/]*(/.*)$', 1) else p0 end as p1, n = '' and p0 <> '' and contains(p0, '://') as odd, p0 from {into}_p),
{into} as (select * exclude (s, n, p0, p1, q, odd), case when odd then p0 else {whole('s', 'n', 'p1', 'q')} end as u from {into}_b)"""


def final_cte(source: str, into: str) -> str:
    return f"{repaired_cte(source, into + '_r')},\n{stripped_cte(into + '_r', into + '_t')},\n{into} as (select * exclude (u), {deamp('u')} as u from {into}_t)"


def classify(x: str) -> str:
    """x is the name of a column with the text as it is classified."""
    ratio = f"len(regexp_extract_all({x}, '{HAN}')) / greatest(length({x}), 1)"
    return f"case when {x} = '' then 'other' when regexp_matches({x}, '{KANA}') then 'ja' when regexp_matches({x}, '{SIGNS}') or {ratio} >= 0.10 then 'zh' when regexp_matches({x}, '[A-Za-z]') and not regexp_matches({x}, '{HAN}') then 'en' else 'other' end"


def detection(x: str) -> str:
    """The text without decorated heading, URLs and superfluous blanks, of a column x."""
    t = f"replace(coalesce({x}, ''), chr(13), '')"
    first = f"split_part({t}, chr(10), 1)"
    ratio = f"len(regexp_extract_all({first}, '{SYMBOLS}')) / greatest(length({first}), 1)"
    body = f"case when {ratio} >= 0.35 then case when contains({t}, chr(10)) then substring({t}, instr({t}, chr(10)) + 1) else '' end else {t} end"
    return strip(f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({body}, 'https?://\\S+', ' ', 'g'), '[ \\t\\x{{3000}}]+', ' ', 'g'), ' +\\n', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")


def like_chinese(x: str) -> str:
    n = f"len(regexp_extract_all({x}, '{HAN}'))"
    return f"(length({x}) > 0 and not regexp_matches({x}, '{KANA}') and (regexp_matches({x}, '{SIGNS}') or {n} >= greatest(10, cast(floor(length({x}) * 0.08) as bigint))))"


def sentences_cte(source: str) -> str:
    """From source(id, t) to cut(id, k, s), merged(id, i, s)."""
    return f"""bits as (select id, regexp_extract_all(t, '[^。！？!?\\n]*[。！？!?\\n]|[^。！？!?\\n]+$') as l from {source} where t is not null),
flat as (select id, unnest(l) as s, unnest(range(len(l))) as n from bits),
trimmed as (select id, n, {strip('s')} as s from flat),
cut as (select id, s, row_number() over (partition by id order by n) - 1 as k from trimmed where s <> ''),
marked as (select *, sum(case when k = 0 or length(s) >= 12 then 1 else 0 end) over (partition by id order by k rows unbounded preceding) - 1 as g from cut),
merged as (select id, cast(g as integer) as i, {strip("string_agg(s, '' order by k)")} as s from marked group by id, g)"""


def ranked_cte() -> str:
    """From merged to best(id, rank, i, s, score)."""
    return f"""chars as (select id, i, unnest(regexp_extract_all(s, '{HAN}')) as c from merged),
freq as (select id, c, count(*) as f from chars group by id, c),
sums as (select id, i, sum(f) as n from chars join freq using (id, c) group by id, i),
scored as (select m.id, m.i, m.s, cast(coalesce(n, 0) as double) * case when length(s) < 15 then 0.6 when length(s) > 120 then 0.8 else 1.0 end as score from merged m left join sums using (id, i)),
best as (select *, cast(row_number() over (partition by id order by score desc, i) as integer) as rank from scored qualify rank <= 5)"""


def summary_sql(source: str, id_name: str) -> str:
    return f"""with texts as (select id, {strip("coalesce(t, '')")} as t0 from {source}),
clipped as (select id, {clip('t0', 6000)} as txt from texts),
lined as (select id, txt, list_filter(list_transform(regexp_split_to_array(txt, '{LINES}'), lambda x: {strip('x')}), lambda x: x <> '') as l from clipped),
titled as (select id, txt, l, len(l) > 0 and length(l[1]) <= 80 as has from lined),
parts as (select id, txt, case when has then l[1] end as title, array_to_string(case when has then l[2:] else l end, chr(10)) as b0 from titled),
body as (select id, {clip('b0', 6000)} as t from parts),
{sentences_cte('body')},
{ranked_cte()},
listed as (select id, string_agg('• ' || {strip('s')}, chr(10) order by rank) as b from best group by id)
select p.id as {id_name}, case when txt = '' then '' when title is not null then title || chr(10) || coalesce(b, '') when coalesce(b, '') <> '' then b else {clip('txt', 400)} end as summary from parts p left join listed using (id)"""


def tagged(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


PAGES = f"""pages as (select scrape_id as ord, input_url as u, resolved_url, content_type,
  '<!doctype html><html><head><title>' || {tagged("coalesce(title, '')")} || '</title></head><body><nav>Home</nav><article><p>' || replace({tagged('body')}, chr(10), '</p><p>') || '</p></article></body></html>' as html from scrape_meta)"""
_BARE = r"trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \t\n\r\f\x0b]+', ' ', 'g'), ' ')"
METRICS = f"""measured as (select *, strlen({_BARE}) as text_len, strlen({_BARE}) / greatest(strlen(html), 1) as ratio, regexp_matches(html, '(?i)<title\\b') as has_title, regexp_matches(html, '(?i)<article\\b') as has_article,
  regexp_matches(html, '(?i)<time\\b') as has_time, regexp_matches(html, '(?i)"@type"\\s*:\\s*"(NewsArticle|Article)"') as has_jsonld from pages)"""
_IS_HTML = "starts_with(lower(trim(split_part(coalesce(content_type, ''), ';', 1))), 'text/html') or starts_with(lower(trim(split_part(coalesce(content_type, ''), ';', 1))), 'application/xhtml+xml')"
_MENTIONED = "contains(lower(coalesce(content_type, '')), 'text/html') or contains(lower(coalesce(content_type, '')), 'application/xhtml')"
GATE = f"""{PAGES}, {METRICS}, source as (select ord, coalesce(u, '') as u from pages),
{final_cte('source', 'final')},
gate as (select m.ord, m.resolved_url, f.u as normal, case when {part('f.u', 1)} not in ('http', 'https') or {part('f.u', 2)} = '' then 'invalid_url_scheme' when {part('f.u', 3)} in ('', '/') then 'root_like_path'
  when not ({_IS_HTML}) and not coalesce(contains(lower(html), '<!doctype html') or contains(lower(html), '<html'), false) then 'non_html_content'
  when coalesce(text_len, 0) < 400 then 'too_short_text' when round(ratio, 4) < 0.05 then 'too_low_text_ratio' when not (has_title or has_article or has_time or has_jsonld) then 'no_article_signals' else 'accepted_content_ready' end as reason
  from measured m join final f using (ord))"""
_DECISION = "case when reason = 'accepted_content_ready' then 'accepted' else 'filtered' end"
_FIRST = "source as (select scrape_id as ord, input_url as u from scrape_meta), " + final_cte("source", "final") + ", firsts as (select u as url, min(ord) as ord from final group by u)"
_DETECTED = lambda table, key: f"detected as (select {key}, lang, text, {detection('text')} as plain from {table})"
_BLANK_TEXT = f"{strip(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')} = ''"
_ITEMS = f"items as (select ord, item, row_number() over (order by ord) - 1 as n from (select doc_id as ord, text as item from documents)), mails as (select cast(n // 20 + 1 as integer) as part, n % 20 + 1 as place, ord, item from items)"
_TRANSLATE = lambda zh: f"""with t as (select doc_id, {strip("coalesce(text, '')")} as s from documents), k as (select *, case when s = '' then 'empty' when {zh} and not {like_chinese('s')} then 'skip' else 'do' end as kind from t)
select doc_id, case kind when 'empty' then '' when 'skip' then '【翻訳対象外（zh_only）】' || {clip('s', 200)} else '【翻訳未実施】' || {clip('s', 200)} end as ja, kind <> 'empty' as ok,
case kind when 'skip' then 'skip' when 'do' then 'fallback' end as engine, case kind when 'empty' then 'empty' when 'skip' then 'zh_only_skip' else 'ok' end as reason from k"""  # noqa: E731
_DOCS = "docs as (select doc_id as id, text as t from documents)"
_TITLED = f"""titled as (select scrape_id, coalesce(title, '') as t, coalesce(body, '') as b, coalesce(title, '') || case when scrape_id % 2 = 0 then chr(10) else ' | ' || chr(10) end || coalesce(body, '') as d from scrape_meta)"""


def _safe(base: str, canonical: str, name: str) -> str:
    """CTEs up to `name`(scrape_id, adopted): the canonical URL where it may stand for the base."""
    b, t = [part("b", k) for k in (1, 2)], [part("u", k) for k in (1, 2, 3)]
    same = f"(lower({b[1]}) = lower({t[1]}) or ends_with(lower({b[1]}), '.' || lower({t[1]})) or ends_with(lower({t[1]}), '.' || lower({b[1]})))"
    return f"""{name}_s as (select scrape_id, {base} as b, {canonical} as u from scrape_meta), {final_cte(name + '_s', name + '_f')},
{name} as (select scrape_id, case when {same} and not ({b[0]} = 'https' and {t[0]} <> 'https') and {t[2]} not in ('', '/') then u end as adopted from {name}_f)"""


def without_title(t: str, b: str) -> str:
    lines = f"regexp_split_to_array({b}, '{LINES}')"
    return f"case when length({t}) > 0 and contains(substring({b}, 1, length({t}) + 5), {t}) and contains(({lines})[1], {strip(t)}) then {lstrip(f'array_to_string(({lines})[2:], chr(10))')} else {b} end"


ORACLES: dict[str, str] = {
    "url_parts": f"""select scrape_id, {part('input_url', 1)} as scheme, {part('input_url', 2)} as netloc, {host(part('input_url', 2))} as host, {part('input_url', 3)} as path, {part('input_url', 4)} as query,
      {part('input_url', 1)} in ('http', 'https') and {part('input_url', 2)} <> '' as is_http, {part('input_url', 3)} in ('', '/') as is_root from scrape_meta""",
    "url_strip_tracking": f"with source as (select validation_id, ingested_at, input_url as u from validation_meta), {stripped_cte('source', 'done')} select validation_id, ingested_at, u as url from done",
    "url_finalize": f"with source as (select scrape_id, input_url as u from scrape_meta), {final_cte('source', 'final')} select scrape_id, u as url from final",
    "url_deamp": f"select scrape_id, {deamp('input_url')} as clean from scrape_meta",
    "url_repair": f"with source as (select cand_id, discovered_at, ingested_key, url as u from (select *, row_number() over () as ingested_key from candidates)), {repaired_cte('source', 'fixed')}, {final_cte('source', 'final')} select f.cand_id, f.discovered_at, f.u as repaired, l.u as final from fixed f join final l using (ingested_key)",
    "url_canonical_safe": f"with {_safe('resolved_url', 'input_url', 'a')}, {_safe('input_url', 'resolved_url', 'b')} select scrape_id, a.adopted as asked, b.adopted as landed from a join b using (scrape_id)",
    "url_quote": """with q as (select scrape_id, coalesce(resolved_url, '') || '/' || coalesce(title, '') as u from scrape_meta) select scrape_id, array_to_string(list_transform(string_split(u, ''), lambda c: case when regexp_matches(c, '^[\\x21\\x23-\\x3b\\x3d\\x3f-\\x5b\\x5d\\x5f\\x61-\\x7a\\x7e]$') then c else replace(url_encode(c), '+', '%20') end), '') as quoted from q""",
    "candidates_json": f"""with c as (select coalesce(title, '') as title, {strip("coalesce(url, '')")} as url, coalesce(source, '') as source, date_iso from candidates), h as (select *, {host(part('url', 2))} as h from c where regexp_matches(url, '^https?://'))
      select title, url, source, date_iso, regexp_matches(url, '/20[0-9]{{2}}/[0-9]{{1,2}}/[0-9]{{1,2}}/') or contains(url, '/news') or contains(url, '/article') or contains(url, '/story') as is_article_url from h where h in ('example', 'test') or h like '%.example' or h like '%.test'""",
    "amp_link": "select scrape_id, case when scrape_id % 5 <> 0 and regexp_matches(input_url, '^https?://') then input_url end as amp from scrape_meta where input_url is not null",
    "root_and_scheme_reject": f"with source as (select scrape_id, x as url, x as u from (select scrape_id, unnest([input_url, regexp_extract(input_url, '^(?:[a-z]+://)?[^/?#]+/?')]) as x from scrape_meta) where x is not null), {final_cte('source', 'final')} select scrape_id, url, case when {part('u', 1)} not in ('http', 'https') or {part('u', 2)} = '' then 'invalid_url_scheme' when {part('u', 3)} in ('', '/') then 'root_like_path' else 'kept' end as reason from final",
    "article_url_flag": "select cand_id, discovered_at, regexp_matches(url, '/20[0-9]{2}/[0-9]{1,2}/[0-9]{1,2}/') or contains(url, '/news') or contains(url, '/article') or contains(url, '/story') as is_article_url from candidates",
    "whitelist_semi_join": f"with source as (select cand_id, discovered_at, url, url as u from candidates), {final_cte('source', 'final')}, hosts as (select *, {host(part('u', 2))} as h from final) select cand_id, discovered_at, url from hosts where h in ('example', 'test') or h like '%.example' or h like '%.test'",
    "interests_split": f"""with l as (select ord, list_transform(list_filter(regexp_split_to_array(list, '[,\\n;、]+'), lambda p: {strip('p')} <> ''), lambda p: regexp_replace(p, '[{BLANK}]+', '', 'g')) as x from {fx.sql(fx.LISTS, 'ord, list')} where list is not null)
      select ord, cast(unnest(range(len(x))) as integer) as k, unnest(x) as interest from l""",
    "recipients_split": f"with l as (select ord, list_filter(regexp_split_to_array(list, '[,;{BLANK}]+'), lambda p: contains(p, '@')) as x from {fx.sql(fx.ADDRESSES, 'ord, list')} where list is not null) select ord, cast(unnest(range(len(x))) as integer) as k, unnest(x) as address from l",
    "discovery_first": "select min(cand_id) as ord, url from candidates where url <> '' group by url order by ord limit 120",
    "html_sniff_type": f"with {PAGES} select ord, ({_IS_HTML}) as by_type, ({_MENTIONED}) as mentioned, coalesce(ord % 3 <> 0 and html is not null, false) as by_content from pages",
    "html_type_counts": f"select ({_IS_HTML}) as by_type, ({_MENTIONED}) as mentioned, count(*) as records from scrape_meta group by 1, 2",
    "content_metrics": f"with {PAGES}, {METRICS} select ord, text_len, round(ratio, 4) as text_ratio, has_title, has_article, has_time, has_jsonld, cast(case when text_len >= 400 then 2 else 0 end + case when ratio >= 0.05 then 1 else 0 end + case when has_jsonld then 3 else 0 end + case when has_article then 2 else 0 end + case when has_time then 1 else 0 end + case when has_title then 1 else 0 end as integer) as score_hint from measured where html is not null",
    "content_gate": f"with {GATE} select ord, {_DECISION} as decision, reason from gate",
    "decision_counts": f"with {GATE} select {_DECISION} as decision, reason, count(*) as pages from gate group by 1, 2",
    "validate_accepted": f"""with {GATE}, landed as (select ord, coalesce(resolved_url, normal) as u from gate where reason = 'accepted_content_ready'), {final_cte('landed', 'done')},
      firsts as (select u, min(ord) as ord from done group by u), capped as (select *, row_number() over (partition by lower({part('u', 2)}) order by ord) as k from firsts) select ord, u as final_url from capped where k <= 2 order by ord limit 40""",
    "url_dedupe_first": f"with {_FIRST} select ord, url from firsts",
    "url_domain_cap": f"with {_FIRST}, capped as (select *, row_number() over (partition by lower({part('url', 2)}) order by ord) as k from firsts) select ord, url from capped where k <= 2",
    "audit_latest": "with n as (select *, row_number() over (partition by validation_id order by ingested_at desc) as k, count(*) over (partition by validation_id) as lines from validation_meta) select validation_id, ingested_at, final_url, decision, reason, lines from n where k = 1",
    "audit_reasons": "select decision, reason, count(*) as lines, cast(sum(elapsed_ms) as bigint) as elapsed_ms, count(*) filter (where metrics.text_len < 400) as short, max(metrics.score_hint) as best_score from validation_meta group by 1, 2",
    "clean_text": f"select doc_id, {clean('text')} as clean from documents",
    "clip_ellipsis": f"select doc_id, {clip('text', 200)} as clipped from documents",
    "html_escape": f"select doc_id, replace({escape('text')}, chr(10), '<br>') as safe from documents",
    "strip_title_dup": f"with {_TITLED} select scrape_id, {without_title('t', 'd')} as without, {without_title('t', 'b')} as plain from titled",
    "compose_text": f"""with w as (select scrape_id, {clean(f"case when coalesce(title, '') <> '' then {strip('title || chr(10) || chr(10) || ' + chr(99) + 'oalesce(body, ' + chr(39) * 2 + ')')} else coalesce(body, '') end")} as x from scrape_meta) select scrape_id, case when length(x) > 12000 then {rstrip('substring(x, 1, 12000)')} else x end as text from w""",
    "source_choice": f"""select scrape_id, coalesce(nullif({strip("coalesce(body, '')")}, ''), text, '') as source from scrape_meta""",
    "scrape_reasons": "select reason, extractor, count(*) as records, count(*) filter (where ok) as ok, cast(sum(chars) as bigint) as chars from scrape_meta group by 1, 2",
    "lang_script_flags": f"select doc_id, regexp_matches(text, '{KANA}') as kana, cast(len(regexp_extract_all(text, '{HAN}')) as integer) as han, not regexp_matches(text, '{KANA}') and (regexp_matches(text, '{SIGNS}') or len(regexp_extract_all(text, '{HAN}')) / greatest(length(text), 1) >= 0.10) as chinese, {like_chinese('text')} as chinese_like from documents",
    "lang_classify": f"with {_DETECTED('documents', 'doc_id')} select doc_id, {classify('plain')} as script_lang from detected",
    "lang_counts": f"with {_DETECTED('documents', 'doc_id')} select {classify('plain')} as script_lang, count(*) as texts from detected group by 1",
    "lang_vs_label": f"with {_DETECTED('lang_items', 'item_id')} select {classify('plain')} as script_lang, lang, count(*) as items from detected group by 1, 2",
    "lang_classify_cjk": f"with d as (select scrape_id, {detection('title')} as t, {detection('body')} as b from scrape_meta) select scrape_id, {classify('t')} as title_lang, {classify('b')} as body_lang from d",
    "lang_with_meta": f"with {_DETECTED('lang_items', 'item_id')} select item_id, case when {_BLANK_TEXT} then 'unknown' else {classify('plain')} end as lang, case when {_BLANK_TEXT} then 'empty' else 'ok' end as lang_reason from detected",
    "lang_compact_zh": f"with {_DETECTED('lang_items', 'item_id')} select item_id, 'zh' as lang, text from detected where not {_BLANK_TEXT} and {classify('plain')} = 'zh'",
    "lang_aligned_zh_only": f"with d as (select item_id, text, {detection('text')} as plain from lang_items), k as (select *, not {_BLANK_TEXT} and {classify('plain')} = 'zh' as keep from d) select item_id, case when keep then 'zh' else '' end as lang, case when keep then text else '' end as text from k",
    "zh_like_translator": f"select item_id, coalesce({like_chinese('text')}, false) as \"like\" from lang_items",
    "lang_sample": f"""with s as (select scrape_id, ok, {strip("coalesce(title, '')")} as t, {strip("coalesce(body, '')")} as b from scrape_meta) select scrape_id, case when coalesce(ok, false) then substring(case when length(b) < 300 then {strip('t || chr(10) || b')} else b end, 1, 2000) else '' end as text from s""",
    "detect_normalize": f"select item_id, {detection('text')} as plain from lang_items",
    "detect_normalize_cases": f"with h as (select item_id, case item_id % 3 when 0 then '★☆★ !!!' || chr(10) when 1 then 'news ★' || chr(13) || chr(10) || 'https://example.com/x?y=1 ' else '' end || coalesce(text, '') as t from lang_items) select item_id, {detection('t')} as plain from h",
    "sentence_split": f"with {_DOCS}, {sentences_cte('docs')} select id as doc_id, cast(k as integer) as i, s as sentence from cut",
    "sentence_merge_short": f"with {_DOCS}, {sentences_cte('docs')} select id as doc_id, i, s as sentence from merged",
    "tf_sentence_rank": f"with {_DOCS}, {sentences_cte('docs')}, {ranked_cte()} select id as doc_id, rank, i, s as sentence, score from best",
    "tf_sentence_rank_cjk": f"with bodies as (select scrape_id as id, body as t from scrape_meta), {sentences_cte('bodies')}, {ranked_cte()} select id as scrape_id, rank, i, s as sentence, score from best",
    "summary_extractive": summary_sql("(select doc_id as id, text as t from documents)", "doc_id"),
    "summary_cjk": summary_sql("(select scrape_id as id, body as t from scrape_meta)", "scrape_id"),
    "translate_fallback": _TRANSLATE("false"),
    "translate_meta_zh_only": _TRANSLATE("true"),
    "digest_parts": "with r as (select doc_id, row_number() over (order by doc_id) - 1 as n from documents) select cast(n // 20 + 1 as integer) as part, count(*) as items, min(doc_id) as first, max(doc_id) as last from r group by 1",
    "digest_plain": f"""with {_ITEMS} select part, string_agg(case when place < 10 then '0' else '' end || place || '. ' || {strip("coalesce(item, '')")}, chr(10) order by ord) || chr(10) || chr(10) || '-- Sent by the digest engine' as plain from mails group by part""",
    "digest_html": f"""with {_ITEMS} select part, '<!doctype html>' || chr(10) || '<html><head><meta charset="utf-8"><title>News digest</title></head><body><h1>News digest</h1><ol>' || string_agg('<li>' || replace({escape("coalesce(item, '')")}, chr(10), '<br>') || '</li>', '' order by ord) || '</ol><p>Sent by the digest engine</p></body></html>' || chr(10) as html from mails group by part""",
    "digest_subject": f"with {_ITEMS}, t as (select max(part) as total from mails) select part, 'News digest 2025-03-01' || case when any_value(total) > 1 then ' (' || part || '/' || any_value(total) || ')' else '' end as subject from mails, t group by part",
}
