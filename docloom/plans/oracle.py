"""SQL of the registered queries, for DuckDB over the same tables.

Written against the operators' definitions, from small SQL builders for the shared scalar forms.
"""

from __future__ import annotations

from docloom.functions.vocabulary import DOCUMENT_EXTENSIONS, DOMAIN_HINTS, PLACEHOLDERS, REQUIREMENT_SCORES, STANDALONE_TITLES, STEM_SUFFIXES, STOP_WORDS, TABLE_LIKE_TERMS
from docloom.operators import audit, evidence, qa

from .tables import RULES, SHEET_KEYS

SP = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
WORD = r"[\p{L}\p{N}_]+"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]" if values else "[]::VARCHAR[]"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{SP}+', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SP}+|{SP}+$', '', 'g')"


def lines(x: str) -> str:
    one = f"regexp_replace(regexp_replace({x}, '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g')"
    return strip(f"regexp_replace({one}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


def yo(x: str) -> str:
    return f"replace(lower({x}), 'ё', 'е')"


def form(x: str) -> str:
    return yo(squeeze(x))


def fold(x: str) -> str:
    return f"replace(lower({squeeze(x)}), 'ß', 'ss')"


def heading_key(x: str) -> str:
    return f"regexp_replace({fold(x)}, '^[ .:;]+|[ .:;]+$', '', 'g')"


def source_form(x: str) -> str:
    return f"regexp_replace({form(x)}, '[.!?,;: ]+$', '')"


def tokens(x: str) -> str:
    return f"list_transform(regexp_extract_all(coalesce({x}, ''), '{WORD}'), lambda t: {yo('t')})"


def stem(w: str) -> str:
    return f"regexp_replace({w}, '^(.{{4,}}?)(?:{'|'.join(STEM_SUFFIXES)})$', '\\1')"


def terms(x: str) -> str:
    return f"list_transform(list_filter({tokens(x)}, lambda t: length(t) > 1 and not list_contains({lst(STOP_WORDS)}, t)), lambda t: {stem('t')})"


def phrase(x: str) -> str:
    return f"array_to_string({terms(x)}, ' ')"


def sentences(x: str) -> str:
    marked = f"regexp_replace(regexp_replace(coalesce({x}, ''), '([.!?;]){SP}+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: {squeeze('s')}), lambda s: s <> '')"


def preview(x: str, n: int) -> str:
    f = squeeze(x)
    return f"case when length({f}) > {n} then regexp_replace(substr({f}, 1, {n - 3}), '\\s+$', '') || '...' else {f} end"


def key(x: str) -> str:
    base = f"regexp_replace({form(x)}, '\\.({'|'.join(DOCUMENT_EXTENSIONS)})$', '')"
    return f"trim(regexp_replace(regexp_replace({base}, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'), ' +', ' ', 'g'))"


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def upper(x: str) -> str:
    return f"(upper({x}) = {x} and lower({x}) <> {x})"


def any_in(x: str, words) -> str:
    return f"len(list_filter({lst(words)}, lambda w: contains({x}, w))) > 0"


CHUNKS = """chunks as (select doc_id as entry_ord, doc_id::varchar as document_id, source as filename, sha256(text) as checksum,
  case when doc_id % 5 <> 0 then lang end as section_id, case when doc_id % 5 <> 0 then 'Part ' || lang end as section_title, source as title,
  case when doc_id % 3 <> 0 then (doc_id % 7 + 1)::int end as page_start, null::varchar as table_id,
  case when doc_id % 11 = 0 then 'unknown' when doc_id % 13 = 0 then 'heading' else 'text' end as content_type, text from documents)"""

PUNCT = r""".,;:!?()\[\]{}"''\-/\\№%+=<>|"""
NOISE = rf"[^\p{{L}}\p{{N}}\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}{PUNCT}]"
OCR_NOISE = rf"[^\p{{L}}\p{{N}}\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}.,;:!?()\[\]{{}}" + r'"' + r"''\-/№]"
TOKEN = "[A-Za-zА-Яа-яЁё0-9]+"

SQL: dict[str, str] = {}
SQL["str01_normalize_lines"] = f"select doc_id, {lines('text')} as normalized from documents"
SQL["str02_token_estimate"] = rf"select doc_id, greatest(1, {count('text', r'[^\s\x0b\x1c-\x1f\x{85}\p{Z}]+')}) as tokens from documents"
SQL["str03_squeeze"] = f"select doc_id, {squeeze('text')} as flat from documents"
SQL["str04_match_forms"] = f"select doc_id, {form('x')} as match_form, {heading_key('x')} as heading_key, {source_form('x')} as source_form from (select doc_id, text as x from documents)"
SQL["str05_tokens"] = f"select doc_id, len(t) as n_tokens, array_to_string(t, ' ') as tokens from (select doc_id, {tokens('text')} as t from documents)"
SQL["str06_stems"] = f"select word, {stem('word')} as stem from (select distinct unnest({tokens('text')}) as word from benchmark)"
SQL["str07_search_tokens"] = f"select doc_id, len(t) as n, len(list_distinct(t)) as n_distinct from (select doc_id, {terms('text')} as t from documents)"
SQL["str08_phrase_form"] = f"select item_id as query_id, {phrase('text')} as phrase from benchmark"
SQL["str09_sentences"] = f'select doc_id, len(s) as n, s[1] as "first", s[-1] as "last" from (select doc_id, {sentences("text")} as s from documents)'
_FORMS = f"list_transform(ls, lambda s: {phrase('s')})"
SQL["str10_sanitize_lines"] = f"""with l as (select doc_id, list_filter(list_transform(string_split(replace(text, chr(13), chr(10)), chr(10)), lambda s: {squeeze('s')}), lambda s: s <> '') as ls, text from documents),
f as (select *, {_FORMS} as fs from l),
k as (select *, list_filter(ls, lambda s, i: fs[i] <> case when i = 1 then '' else fs[i - 1] end) as kept from f),
j as (select doc_id, case when len(kept) > 0 then array_to_string(kept, ' ') else {squeeze('text')} end as joined from k),
h as (select *, string_split(joined, ' ') as w from j),
g as (select *, array_to_string(w[1 : len(w) // 2], ' ') as l, array_to_string(w[len(w) // 2 + 1 : len(w)], ' ') as r from h)
select doc_id, case when len(w) >= 6 and {phrase('l')} = {phrase('r')} then l else joined end as clean from g"""
SQL["str12_preview"] = "select doc_id, " + ", ".join(f"{preview('text', n)} as p{n}" for n in (96, 220, 240, 280)) + " from documents"
SQL["str13_document_key"] = f"select page_id, {key('url')} as key from pages"
SQL["str14_location_label"] = f"""with {CHUNKS} select entry_ord, concat_ws(' - ', filename, case when section_title is not null then 'Document > ' || section_title else 'Document' end,
case when page_start is null then null when entry_ord % 2 = 1 then 'pages ' || page_start || '-' || (page_start + 1) else 'page ' || page_start end) as label from chunks"""
SQL["str18_placeholders"] = f"""select doc_id, ({source_form('v')} = '' or list_contains({lst(PLACEHOLDERS)}, {source_form('v')})) as missing
from (select doc_id, case doc_id % 4 when 0 then 'Нет.' when 1 then ' — ' else source end as v from documents)"""
_PAIRS = """pairs as (select conv_id, turn, text as question, answer from (select *, lead(role) over (partition by conv_id order by turn) as nr,
lead(text) over (partition by conv_id order by turn) as answer from conversations) where role = 'user' and nr = 'assistant')"""
SQL["str19_token_recall"] = f"""with {_PAIRS}, s as (select conv_id, turn, list_distinct({terms('question')}) as w, list_distinct({terms('answer')}) as h from pairs)
select conv_id, turn, case when len(w) = 0 then 0.0 else round(len(list_intersect(w, h)) / len(w), 4) end as recall from s"""
SQL["str20_table_questions"] = f"""select conv_id, turn, (len(list_intersect({tokens('text')}, {lst(qa.TABLE_WORDS)})) > 0 or {any_in(form('text'), (*qa.TABLE_PHRASES, *qa.TABLE_UNITS))}
or (list_contains({tokens('text')}, 'источник') and (contains({form('text')}, '№') or contains({form('text')}, 'номер')))) as table_like from conversations"""

SQL["prd01_rtf_quality"] = rf"""with c as (select doc_id, {lines("coalesce(text, '')")} as t from documents),
m as (select doc_id, length(t)::int as char_count, round(1.0 - {count('t', r'[\x00-\x08\x0e-\x1b\x7f-\x{84}\x{86}-\x{9f}\p{Cf}\p{Co}]')} / greatest(length(t), 1), 3) as printable_ratio,
round({count('t', r'[\x00-\x08\x0b-\x0c\x0e-\x1f\x7f-\x{9f}\p{Cf}\p{Co}]')} / greatest(length(t), 1), 3) as control_ratio, round({count('t', NOISE)} / greatest(length(t), 1), 3) as symbol_noise_ratio,
round({count('t', r'\p{L}')} / greatest(length(t), 1), 3) as alpha_ratio, regexp_extract_all(t, '{TOKEN}') as k, t from c),
w as (select *, coalesce(round(len(list_filter(k, lambda x: length(x) >= 2 and regexp_matches(x, '\p{{L}}'))) / nullif(len(k), 0), 3), 0.0) as word_like_token_ratio,
0 as repeated_symbol_run_count from m)
select doc_id, char_count, printable_ratio, control_ratio, symbol_noise_ratio, alpha_ratio, word_like_token_ratio, repeated_symbol_run_count,
case when char_count = 0 then 'empty_text' when char_count >= 40 and printable_ratio < 0.88 then 'low_printable_ratio' when char_count >= 40 and control_ratio >= 0.06 then 'excessive_control_chars'
when char_count >= 80 and symbol_noise_ratio >= 0.35 and alpha_ratio < 0.35 then 'binary_like_symbol_density' when char_count >= 80 and word_like_token_ratio < 0.18 and symbol_noise_ratio >= 0.22 then 'low_word_quality' end as issue from w"""
SQL["prd02_cid_artifacts"] = rf"""with c as (select doc_id, {lines("case when doc_id % 3 = 0 then '(cid:12)(cid:7) (CID:9)' || text else text end")} as t from documents),
f as (select doc_id, t, regexp_extract_all(t, '(?i)\(cid:\d+\)') as k from c)
select doc_id, len(k) as cid_count, case when len(k) >= 3 and length(array_to_string(k, '')) / greatest(length(t), 1) >= 0.35 then 'cid_artifact_dominated_fragment'
when len(k) >= 8 and len(k) / greatest(length(t), 1) * 100 >= 8 then 'excessive_cid_artifact_density' end as issue from f"""
_LATIN, _DIGIT, _CYR = ("regexp_matches(w, '[A-Za-z]')", "regexp_matches(w, '[0-9]')", r"regexp_matches(w, '[\x{0400}-\x{04FF}]')")
SQL["prd03_ocr_quality"] = rf"""with c as (select doc_id, {lines("coalesce(text, '')")} as t from documents),
m as (select doc_id, t, length(t) as n, greatest(length(t), 1) as safe, {count('t', r'\p{L}')} as alpha, {count('t', r'[\x{0400}-\x{04FF}]')} as cyr, {count('t', OCR_NOISE)} / greatest(length(t), 1) as noise,
{count('t', r'[\x00-\x08\x0e-\x1b\x7f-\x{84}\x{86}-\x{9f}\p{Cf}\p{Co}]')} as bad, regexp_extract_all(t, '{TOKEN}') as k from c),
o as (select *, len(list_filter(k, lambda w: ({_LATIN} and {_CYR}) or (length(w) >= 5 and {_LATIN} and {_DIGIT}))) as mixed,
list_filter(k, lambda w: length(w) >= 5 and (regexp_matches(w, '(?i)curyanuoumas|kapra|c[rt]p?a[pb]k[aа]|k[o0][mм][a-zа-яё0-9]*4[eе]?[cс][tт][bв][eе]') or ({_LATIN} and {_DIGIT} and not {_CYR}))) as odd from m)
select doc_id, case when n = 0 then 'ocr_empty_text' when n >= 8 and 1.0 - bad / safe < 0.85 then 'low_printable_ratio' when n >= 20 and noise >= 0.3 and alpha / safe < 0.7 then 'excessive_mixed_symbol_noise'
when coalesce(cyr / nullif(alpha, 0), 0) < 0.15 and (len(odd) >= 2 or (n <= 80 and len(list_filter(odd, lambda w: {_DIGIT})) > 0)) then 'suspicious_latinized_ru_ocr'
when n >= 12 and coalesce(mixed / nullif(len(k), 0), 0) >= 0.5 and noise >= 0.18 then 'excessive_mixed_symbol_noise' end as issue from o"""
SQL["prd05_block_kinds"] = rf"""with l as (select doc_id, unnest(string_split(text, chr(10))) as x, unnest(range(len(string_split(text, chr(10)))))::int as line from documents),
f as (select *, {squeeze('x')} as s, {heading_key('x')} as k from l)
select doc_id, line, case when s = '' then 'text' when list_contains({lst(STANDALONE_TITLES)}, k) then 'heading' when regexp_matches(s, '^(?:\d+(?:\.\d+)*\.?|[IVXLC]+\.?)\s+.+$') then 'heading'
when regexp_matches(s, '^(?:[-*•]|\d+\.)\s+.+$') then 'list_item' when {upper('s')} and {count('s', '[^ ]+')} between 3 and 12 then 'heading' else 'paragraph' end as kind,
case when regexp_matches(s, '^(\d+(?:\.\d+)*\.?)\s') then least(length(regexp_replace(regexp_extract(s, '^(\d+(?:\.\d+)*\.?)\s', 1), '[^.]', '', 'g')) + 1, 6) else 1 end::int as level from f"""
SQL["prd10_table_like"] = rf"""with f as (select doc_id, lower({squeeze('text')}) as s from documents)
select doc_id, s <> '' and (regexp_matches(s, '\|.+\||;.*;|(?:^|[^\p{{L}}\p{{N}}_])(?:row|column) +\d+(?:[^\p{{L}}\p{{N}}_]|$)') or {any_in('s', TABLE_LIKE_TERMS)}) as table_like from f"""
SQL["prd12_numeric_like"] = r"""with c as (select o_orderkey, unnest([o_orderpriority, regexp_replace(o_orderpriority, '-.*', ',5'), o_totalprice::decimal(12,2)::varchar]) as cell from orders)
select o_orderkey, cell, try_cast(replace(replace(cell, ',', '.'), ' ', '') as double) is not null as numeric from c"""

_ENTRIES = f"""{CHUNKS}, entries as (select *, len({tokens('text')}) as n_tokens, {terms('text')} as terms from chunks)"""
SQL["agg01_corpus_stats"] = f"with {_ENTRIES} select count(distinct (checksum, lower(filename))) as document_count, count(*) as chunk_count, round(avg(n_tokens), 2) as avg_chunk_length from entries"
SQL["agg02_document_frequency"] = f"with {_ENTRIES} select term, count(*) as df from (select unnest(list_distinct(terms)) as term from entries) group by term"
_BM25 = f"""{_ENTRIES}, q as (select query_id, term, count(*) as qtf from (select item_id as query_id, unnest({terms('text')}) as term from benchmark) group by all),
tf as (select entry_ord, dl, term, count(*) as tf from (select entry_ord, len(terms) as dl, unnest(terms) as term from entries) where term in (select term from q) group by all),
df as (select term, count(*) as df from tf group by term), st as (select count(*) as n, greatest(avg(n_tokens), 1.0) as a from entries),
bm as (select query_id, entry_ord, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))) as bm25, count(*) as overlap
from q join df using (term) join tf using (term), st group by all)"""
SQL["rnk01_bm25_search"] = f"""with {_BM25}, r as (select *, round(bm25, 4) as s, row_number() over (partition by query_id order by round(bm25, 4) desc, entry_ord) as rank from bm)
select query_id, rank::int as rank, entry_ord, s as score from r where rank <= 5"""
SQL["jn08_query_postings"] = f"""with {_BM25} select query_id, count(*) as entries, sum(overlap)::bigint as overlaps, any_value(t.n) as terms from bm join (select query_id, count(*) as n from q group by 1) t using (query_id) group by query_id"""
_CLEAN = SQL["str10_sanitize_lines"].replace("with l as", "l as", 1)
_CLEAN_CTE = _CLEAN[: _CLEAN.rindex("select doc_id, case")]
_SHAPE = rf"""sh as (select entry_ord, {squeeze('text')} as flat, n_tokens, section_title from entries),
pen as (select entry_ord, case when {count('flat', r'\p{L}')} = 0 then 1.0 when hd and rp then 0.28 when hd then 0.42 when rp then 0.55 else 1.0 end as shape from
(select *, n_tokens <= 18 and {count('flat', r'\p{Lu}')} / nullif({count('flat', r'\p{L}')}, 0) > 0.7 as hd, coalesce(section_title <> '' and {squeeze('section_title')} = flat, false) as rp from sh)),
cl as (select doc_id as entry_ord, case when len(w2) >= 6 and {phrase('l2')} = {phrase('r2')} then 0.7 else 1.0 end as mirror, clean from
(select doc_id, clean, w2, array_to_string(w2[1 : len(w2) // 2], ' ') as l2, array_to_string(w2[len(w2) // 2 + 1 : len(w2)], ' ') as r2 from
(select doc_id, clean, string_split(clean, ' ') as w2 from (select doc_id, case when len(w) >= 6 and {phrase('l')} = {phrase('r')} then l else joined end as clean from g))))"""
SQL["prd09_penalties"] = f"with {_ENTRIES}, {_CLEAN_CTE}, {_SHAPE} select entry_ord, round(shape * mirror, 4) as penalty from pen join cl using (entry_ord)"
_COMPOSITE = f"""{_BM25}, {_CLEAN_CTE}, {_SHAPE},
qq as (select item_id as query_id, {phrase('text')} as phrase, list_distinct({terms('text')}) as asked from benchmark),
sc as (select query_id, entry_ord, filename, checksum, section_id, text, asked, clean, (bm25 + 0.45 * overlap + case when phrase <> '' and contains(array_to_string(terms, ' '), phrase) then 2.0 else 0.0 end
+ case when phrase <> '' and contains({phrase('section_title')}, phrase) then 1.0 else 0.0 end + case when phrase <> '' and contains({phrase('title')}, phrase) then 0.8 else 0.0 end
+ 0.25 * len(list_intersect(asked, {terms('section_title')})) + 0.15 * len(list_intersect(asked, {terms('title')}))) * shape * mirror + case when len(terms) >= 25 then 0.35 else 0.0 end as raw, round(raw, 8) as score
from bm join qq using (query_id) join entries using (entry_ord) join pen using (entry_ord) join cl using (entry_ord))"""
SQL["rnk02_composite"] = f"with {_COMPOSITE} select query_id, count(*) as n, round(max(score), 3) as best, round(avg(score), 3) as mean from sc where score > 0 group by query_id"
_RANKED = f"""{_COMPOSITE}, r1 as (select *, row_number() over (partition by query_id, lower(filename), checksum, section_id, {phrase('substr(text, 1, 200)')} order by score desc, entry_ord) as a from sc where score > 0),
r2 as (select *, row_number() over (partition by query_id, checksum order by score desc, entry_ord) as b from r1 where a = 1),
r3 as (select *, row_number() over (partition by query_id order by score desc, entry_ord) as rank from r2 where b <= 3)"""
SQL["rnk03_search_top_k"] = f"with {_RANKED} select query_id, rank::int as rank, entry_ord, filename, round(score, 4) as score from r3 where rank <= 5"
_STRIPPED = r"""regexp_replace(lower(x), '^[.,:;!?()\[\]{}"'']+|[.,:;!?()\[\]{}"'']+$', '', 'g')"""
SQL["str11_snippets"] = f"""with {_RANKED}, s1 as (select query_id, rank, clean, string_split(clean, ' ') as w, asked from r3 where rank <= 3),
s2 as (select *, coalesce(list_position(list_transform(w, lambda x: list_contains(asked, {stem(_STRIPPED)})), true), 1) - 1 as hit from s1),
s3 as (select *, greatest(0, length(array_to_string(w[1:hit], ' ')) - 106) as a from s2), s4 as (select *, least(length(clean), a + 320) as b from s3)
select query_id, rank::int as rank, {squeeze("case when a > 0 then '...' else '' end || trim(substr(clean, a + 1, b - a)) || case when b < length(clean) then '...' else '' end")} as snippet from s4"""
SQL["set01_first_wins"] = f"""with {CHUNKS} select entry_ord, filename from (select *, row_number() over (partition by lower(filename), checksum, section_id, {phrase('substr(text, 1, 200)')} order by entry_ord) as rn from chunks) where rn = 1"""
SQL["snk03_upsert_latest"] = f"""with {_ENTRIES}, again as (select * from entries where entry_ord % 3 = 0)
select entry_ord, document_id, 2::bigint as version, n_tokens from again union all
select entry_ord, document_id, 1::bigint, n_tokens from entries where coalesce(checksum, '') not in (select coalesce(checksum, '') from again)"""
SQL["snk04_manifest"] = f"with {CHUNKS} select document_id, lower(filename) as filename, checksum, 'processed' as status from (select *, row_number() over (partition by checksum, lower(filename) order by entry_ord desc) as rn from chunks) where rn = 1"
SQL["snk07_duplicate_files"] = f"with {CHUNKS} select document_id, filename, rn::int as rn from (select *, row_number() over (partition by checksum, lower(filename) order by entry_ord) as rn from chunks) where rn > 1"

_FLAGS = rf"""{CHUNKS}, fl as (select *, {squeeze('text')} as flat, lower({squeeze('text')}) as low from chunks), flagged as (select *, list_sort(list_filter([
case when flat = '' then 'empty_or_whitespace_text' when length(flat) < {audit.SHORT} then 'short_chunk' end, case when section_id is null then 'missing_section' end, case when page_start is null then 'missing_page' end,
case when low <> '' and (regexp_matches(low, '\|.+\||;.*;|(?:^|[^\p{{L}}\p{{N}}_])(?:row|column) +\d+(?:[^\p{{L}}\p{{N}}_]|$)') or {any_in('low', TABLE_LIKE_TERMS)}) then 'table_like_text' end,
case when content_type = 'unknown' then 'unknown_content_type' end], lambda x: x is not null)) as flags from fl)"""
SQL["aud02_quality_flags"] = f"""with {_FLAGS} select document_id, array_to_string(flags, '|') as flags, ((section_id is null)::int + (page_start is null)::int + list_contains(flags, 'short_chunk')::int
+ list_contains(flags, 'table_like_text')::int + (content_type = 'unknown')::int) as notes from flagged"""
_ISSUED = f"""{_FLAGS}, dup as (select flat, count(*) as c from flagged group by flat), issued as (select f.*, list_filter([case when flat = '' then 'empty_or_whitespace_text' end,
case when flat <> '' and length(flat) < 120 then 'short_chunk' end, case when length(flat) > 3000 then 'long_chunk' end, case when section_id is null then 'missing_section' end, case when page_start is null then 'missing_page' end,
case when list_contains(flags, 'table_like_text') then 'table_like_text_without_rich_context' end, case when content_type = 'unknown' then 'unknown_content_type' end,
case when flat <> '' and (content_type = 'heading' or (length(flat) <= 120 and {count('flat', '[^ ]+')} <= 6) or ({count('flat', '[^ ]+')} <= 8 and suffix(flat, ':'))) then 'heading_only_or_low_context' end,
case when flat <> '' and c > 1 then 'duplicate_or_repeated_text' end], lambda x: x is not null) as issues from flagged f join dup using (flat))"""
SQL["aud03_issue_codes"] = f"with {_ISSUED} select document_id, array_to_string(issues, '|') as issues from issued"
SQL["agg05_flag_counts"] = f"with {_FLAGS} select flag, count(*) as n from (select unnest(flags) as flag from flagged) group by flag"
SQL["agg06_issue_counts"] = f"with {_ISSUED} select issue, count(*) as n from (select unnest(issues) as issue from issued) group by issue"
SQL["agg06_lengths"] = f"with {CHUNKS}, n as (select length({squeeze('text')})::int as n from chunks) select count(*) as total, round(avg(n), 2) as avg_len, median(n) as median_len, min(n) as min_len, max(n) as max_len from n"
SQL["agg06_top_issue_files"] = f"""with {_ISSUED}, p as (select filename, sum(len(issues))::bigint as issues, count(*) as chunks from issued group by filename)
select * from (select *, (row_number() over (order by issues desc, filename))::int as rank from p) where rank <= 10"""
SQL["aud04_compact_buckets"] = rf"""with {CHUNKS}, f as (select *, {squeeze('text')} as flat from chunks), l as (select *, replace(lower(flat), 'ß', 'ss') as low from f),
b as (select case when content_type = 'text' and flat <> '' and length(flat) < 250 then case when {any_in('low', audit.SERVICE_TERMS)} then 'service_or_boilerplate'
when {any_in('low', ('содержание', 'оглавление', 'table of contents'))} or regexp_matches(flat, '{audit.TOC_PATTERN}') then 'toc_or_list_fragment'
when regexp_matches(low, '{audit.FORMULA_PATTERN}') or {any_in('low', audit.FORMULA_TERMS)} then 'formula_or_calculation_micro_evidence'
when regexp_matches(low, '{audit.SYMBOL_PATTERN}') or {any_in('low', audit.POLLUTANT_TERMS)} then 'pollutant_or_equipment_micro_evidence'
when {count('flat', WORD)} <= 8 and coalesce({upper('flat')} or {fold('section_title')} = regexp_replace(low, '^[ .:;]+|[ .:;]+$', '', 'g'), false) then 'title_or_cover_fragment'
when length(flat) < 120 then 'real_low_value_tail' else 'other_compact_text' end end as bucket from l) select bucket, count(*) as n from b where bucket is not null group by bucket"""
SQL["agg10_corpus_audit"] = """select d.doc_id::varchar as document_id, source as filename, case when l.doc_id is null then 'unknown' when quality = 1 then 'processed' else 'duplicate' end as status,
length(coalesce(text, ''))::int as text_chars, concat_ws('|', case when length(coalesce(text, '')) < 500 then 'low_text' end, case when d.doc_id % 6 < 1 then 'no_chunks' end,
case when l.doc_id is null then 'missing_from_index' end, case when text is null then 'null_text_metrics' end) as problems from documents d left join (select distinct on (doc_id) * from labels) l on d.doc_id = l.doc_id"""
SQL["jn04_missing_from_index"] = "select source, count(*) as missing from documents where doc_id not in (select doc_id from labels) group by source"
SQL["agg11_batch_summary"] = f"""with {CHUNKS}, s as (select *, case when row_number() over (partition by checksum order by entry_ord) = 1 then 'processed' else 'duplicate' end as status from chunks)
select filename, status, count(*) as n, sum(length(text))::bigint as chars from s group by all"""
SQL["rnk08_preview_limits"] = f"""with l as (select doc_id, list_filter(string_split(text, chr(10)), lambda s: {squeeze('s')} <> '') as ls from documents)
select doc_id, len(ls) as total, least(len(ls), 3) as shown, len(ls) > 3 as truncated, array_to_string(list_transform(ls[1:3], lambda s: {preview('s', 60)}), '|') as preview from l"""
_T = f"""(select case when sheet = 1 then p_brand else p_brand || ' ' || sheet end as table_id, p_brand as filename, 'Sheet ' || sheet as sheet,
list([p_name, p_type, p_size::varchar, p_retailprice::decimal(12,2)::varchar] order by p_partkey) as body from (select *, p_partkey // {SHEET_KEYS} + 1 as sheet from part) group by p_brand, sheet)"""
SQL["str17_table_row_texts"] = f"""with r as (select table_id, sheet, len(body) + 1 as row_count, unnest(body) as row, unnest(range(len(body))) as pos from {_T})
select table_id, (pos + 2)::int as row_index, row_count, 5 as column_count, 'Таблица ' || table_id || '. Лист: ' || sheet || '. Раздел: Document > Parts' || chr(10) || 'Строка ' || (pos + 2) || ' из ' || row_count || '.' || chr(10)
|| 'Колонки: part name: ' || row[1] || '; type: ' || row[2] || '; size: ' || row[3] || '; retail price: ' || row[4] as text from r"""
SQL["stc04_table_rows"] = f'select table_id, len(body) as rows, 2 as "first", (len(body) + 1)::int as "last" from {_T}'
_HEAD = "part name type size retail price"


def _table_sql() -> str:
    per, matched = [], []
    for category, words in RULES.tables.items():
        gains = [f"case when contains('{_HEAD}', {q(w)}) then 0.34 when contains(low, {q(w)}) then 0.14 else 0.0 end" for w in (x.lower().replace("ё", "е") for x in words)]
        per.append(f"struct_pack(score := round({' + '.join(gains)}, 2), category := {q(category)})")
        matched += [f"case when contains('{_HEAD}', {q(w.lower().replace('ё', 'е'))}) or contains(low, {q(w.lower().replace('ё', 'е'))}) then {q(w)} end" for w in words]
    return f"""tt as (select table_id, filename, len(body) + 1 as row_count, array_to_string(list_transform(body, lambda r: array_to_string(r, ' | ')), ' ') as body_text from {_T}),
lo as (select *, {form('body_text')} as low from tt), pe as (select *, [{', '.join(per)}] as per, list_sort(list_distinct(list_filter([{', '.join(matched)}], lambda x: x is not null))) as matched from lo),
be as (select *, list_max(list_transform(per, lambda p: p.score)) as best from pe),
ev as (select table_id, filename, row_count, 4 as column_count, 'part name|type|size|retail price' as headers, case when best > 0 then list_filter(per, lambda p: p.score = best)[1].category else 'unknown' end as category,
case when best > 0 then array_to_string(list_sort(list_transform(list_filter(per, lambda p: p.score > 0), lambda p: p.category)), '|') else 'unknown' end as tags,
round(least(0.08 + least(best, 0.68) + 0.12 + 0.06 + 0.04, 0.95), 2) as score, array_to_string(matched, '|') as terms, len(matched) as n_terms, {preview("'" + _HEAD + " ' || body_text", 280)} as snippet from be)"""


SQL["evd03_table_evidence"] = f"with {_table_sql()} select * exclude (n_terms, filename) from ev"
SQL["rnk06_ranked_tables"] = f"with {_table_sql()} select table_id, category, score, row_count from ev where score >= 0.25 order by score desc, n_terms desc, row_count desc, lower(filename) desc, table_id desc limit 10"
SQL["agg04_table_summary"] = f"with {_table_sql()} select category, count(*) as n from ev where score >= 0.25 group by category"

_BENCH = f"""bs as (select item_id as query_id, text as query, {squeeze('text')} as start from benchmark),
dw as (select doc_id, source, {squeeze('text')} as flat from documents), ex as (select query_id, arg_min(source, doc_id) as expected from bs join dw on start <> '' and contains(flat, start) group by query_id)"""
_EVAL = f"""{_RANKED}, {_BENCH}, top as (select query_id, rank, filename, expected from r3 left join ex using (query_id) where rank <= 5),
per as (select query_id, count(*) as n_hits, min(case when k <> '' and (k = f or contains(f, k) or (f <> '' and contains(k, f))) then rank end)::int as best_rank from
(select *, {key('expected')} as k, {key('filename')} as f from top) group by query_id),
res as (select bs.query_id, coalesce(expected, '') as expected, coalesce(n_hits, 0) as n_hits, best_rank, case when coalesce(n_hits, 0) = 0 then 'no_results' when expected is null then 'passed' when best_rank is not null then 'passed' else 'expected_not_found' end as status
from bs left join ex using (query_id) left join per using (query_id))"""
SQL["agg08_retrieval_eval"] = f"with {_EVAL} select query_id, expected, n_hits, coalesce(best_rank, 0) as best_rank, status from res"
SQL["agg07_qa_summary"] = f"""with {_EVAL} select count(*) as questions, count_if(expected <> '')::bigint as with_source, count_if(expected <> '' and best_rank <= 1)::bigint as hit_at_1, count_if(expected <> '' and best_rank <= 3)::bigint as hit_at_3,
count_if(expected <> '' and best_rank <= 5)::bigint as hit_at_5, coalesce(round(count_if(expected <> '' and best_rank <= 5) / nullif(count_if(expected <> ''), 0), 4), 0.0) as source_hit_rate, count_if(n_hits = 0)::bigint as no_hits from res"""
SQL["qae02_failure_taxonomy"] = f"""with {_EVAL} select category, count(query_id) as n from (select unnest({lst(qa.CATEGORIES)}) as category) left join
(select query_id, case when expected = '' then {q(qa.CATEGORIES[0])} when n_hits = 0 then {q(qa.CATEGORIES[1])} when best_rank is null then {q(qa.CATEGORIES[2])} when best_rank > 1 then {q(qa.CATEGORIES[3])} else {q(qa.CATEGORIES[4])} end as category from res) using (category) group by category"""
SCORES, HINTS = REQUIREMENT_SCORES, DOMAIN_HINTS
_SPLIT = f"""{CHUNKS}, k as (select *, entry_ord % 4 as k from chunks), sp as (select document_id, content_type, section_title, page_start,
case k when 1 then concat_ws(chr(10), section_title, section_title, text) when 2 then coalesce(section_title, '1. Head') else text end as text,
case when k = 3 then ['Document', 'Table of Contents', coalesce(section_title, 'Оглавление')] else ['Document', section_title] end as path from k),
ln as (select *, {strip("coalesce(text, '')")} as s from sp), l2 as (select *, list_filter(list_transform(string_split(s, chr(10)), lambda x: {strip('x')}), lambda x: x <> '') as ls, {fold('text')} as flat,
{heading_key("coalesce(section_title, path[-1])")} as title, list_filter(list_transform(path, lambda x: {heading_key('x')}), lambda x: x <> '') as p from ln),
fl5 as (select document_id, coalesce(len(list_filter(p[1:len(p) - 1], lambda x: list_contains({lst(('содержание', 'оглавление', 'table of contents'))}, x))) > 0 and not list_contains({lst(('содержание', 'оглавление', 'table of contents'))}, p[-1]), false) as toc_parent,
coalesce(len(ls) >= 2 and {fold('ls[1]')} <> '' and {fold('ls[1]')} = {fold('ls[2]')}, false) as duplicate_heading,
s <> '' and not list_contains({lst(('содержание', 'оглавление', 'table of contents'))}, title) and not ({any_in('flat', audit.SERVICE_TERMS)}) and len(ls) <= 2 and length(s) <= 120 and {count('s', WORD)} <= 10
and ((title <> '' and {heading_key('s')} = title) or (len(ls) = 1 and (regexp_matches(s, '^(?:(?i:\\d+(?:\\.\\d+)*\\.?|[ivxlc]+\\.?))\\s+\\S+') or ({upper('s')} and {count('s', WORD)} <= 8)))) as heading_only,
false as service_table, page_start is null as no_page from l2)"""
SQL["aud05_splitter_flags"] = f"with {_SPLIT} select * from fl5"
SQL["agg12_splitter_summary"] = f"""with {_SPLIT} select count(distinct document_id) as documents, count_if(toc_parent)::bigint as toc_parent, count_if(duplicate_heading)::bigint as duplicate_heading, count_if(heading_only)::bigint as heading_only,
count_if(service_table)::bigint as service_table, count_if(no_page)::bigint as no_page, count(distinct case when toc_parent or duplicate_heading or service_table then document_id end) as documents_with_failures from fl5"""
SQL["stc02_section_paths"] = """select 'n' || n_nationkey as section_id, 'Document > ' || r_name || ' > ' || n_name as path from nation join region on n_regionkey = r_regionkey
union all select 'r' || r_regionkey, 'Document > ' || r_name from region union all select 'root', 'Document'"""
SQL["rnk07_hit_at_k"] = f"with {_EVAL} select query_id, best_rank is not null and best_rank <= 1 as hit_at_1, best_rank is not null and best_rank <= 3 as hit_at_3, best_rank is not null and best_rank <= 5 as hit_at_5 from res where expected <> ''"
SQL["rnk09_top_hits"] = f"with {_RANKED} select query_id, string_agg(filename, '|' order by rank) as top from r3 where rank <= 3 group by query_id"
_FILE = r"regexp_extract(url, '([^/?#]+)(?:[?#].*)?$', 1)"
_WANT = f"""f as (select page_id as file_id, {_FILE} as filename from pages), w as (select distinct case when page_id % 3 = 0 then {_FILE} else upper({_FILE}) || '.PDF' end as expected from pages
union select 'absent report 77' union select 'en')"""
SQL["set02_selection"] = f"""with {_WANT}, b as (select distinct file_id, filename from f)
select file_id, filename from (select *, row_number() over (partition by filename order by file_id) as rn from b) where rn = 1"""
_CONTAINED = 8
_TIERS = f"""{_WANT}, e as (select expected, {key('expected')} as k, {key("regexp_extract(expected, '^([^,]+)', 1)")} as alt from w), fk as (select file_id, filename, {key('filename')} as fkey from f),
ks as (select distinct expected, greatest(length(k), length(alt)) as longest, unnest([k, alt]) as k from e), t as (
select expected, file_id, 1 as tier from e join fk on lower(trim(expected)) = lower(filename) and trim(expected) <> ''
union select expected, file_id, 2 from ks join fk on k = fkey and k <> ''
union select expected, file_id, 3 from ks join fk on k <> '' and fkey <> '' and longest >= {_CONTAINED} and (contains(fkey, k) or contains(k, fkey))
union select expected, file_id, 4 from ks join fk on len(list_filter(string_split(k, ' '), lambda x: not list_contains({lst(('book', 'chapter', 'section', 'table', 'книга', 'раздел', 'таблица', 'том'))}, x))) >= 3
and len(list_filter(string_split(k, ' '), lambda x: not list_contains({lst(('book', 'chapter', 'section', 'table', 'книга', 'раздел', 'таблица', 'том'))}, x) and not list_contains(string_split(fkey, ' '), x))) = 0),
bt as (select expected, min(tier) as tier from t group by 1), n as (select expected, tier, count(distinct file_id) as n_files from t join bt using (expected, tier) group by all),
mm as (select expected, case when n_files is null then 'missing' when n_files = 1 then 'matched' else 'ambiguous' end as status,
coalesce(['exact_filename', 'normalized_filename_or_stem', 'bounded_contains', 'token_subset'][tier], case when k = '' and alt = '' then 'empty' else 'none' end) as method, coalesce(n_files, 0) as n_files from e left join n using (expected))"""
SQL["jn05_match_files"] = f"with {_TIERS} select distinct expected, status, method, n_files from mm"
SQL["agg09_coverage"] = f"with {_TIERS} select status, method, count(*) as n from (select distinct * from mm) group by all"
# requirement windows: sentences packed by their cumulative lengths, a window a step
_WINDOWS = rf"""recursive s0 as (select doc_id, list_filter(string_split(regexp_replace({squeeze('text')}, '([.!?;]) ', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') as ss from documents),
se as (select doc_id, ss, list_transform(range(len(ss) + 1), lambda n: coalesce(list_sum(list_transform(ss[1:n], lambda x: length(x) + 1)), 0)::bigint) as ends from s0),
wk as (select doc_id, 0::bigint as a0, greatest(1, len(list_filter(ends, lambda x: x <= ends[1] + {evidence.WINDOW_CHARS} + 1)) - 1)::bigint as z0, len(ss) as n from se where len(ss) > 0 union all
select wk.doc_id, wk.z0, greatest(wk.z0 + 1, len(list_filter(se.ends, lambda x: x <= se.ends[wk.z0 + 1] + {evidence.WINDOW_CHARS} + 1)) - 1)::bigint, wk.n from wk join se on wk.doc_id = se.doc_id where wk.z0 < wk.n),
wp as (select wk.doc_id, a0, case when z0 > a0 + 1 or length(ss[a0 + 1]) <= {evidence.WINDOW_CHARS} then [array_to_string(ss[a0 + 1:z0], ' ')]
else list_transform(range((length(ss[a0 + 1]) + {evidence.WINDOW_CHARS} - 1) // {evidence.WINDOW_CHARS}), lambda i: trim(substr(ss[a0 + 1], (i * {evidence.WINDOW_CHARS} + 1)::bigint, {evidence.WINDOW_CHARS}))) end as ws from wk join se on wk.doc_id = se.doc_id),
wu as (select doc_id, a0, unnest(ws) as w, unnest(range(len(ws))) as piece from wp), wn as (select doc_id, w, (row_number() over (partition by doc_id order by a0, piece) - 1)::int as win from wu)"""
SQL["str15_requirement_windows"] = f"""with {_WINDOWS} select d.doc_id, coalesce(n, 0)::int as n_windows, coalesce(longest, 0)::int as longest from documents d
left join (select doc_id, count(*) as n, max(length(w)) as longest from wn group by doc_id) using (doc_id)"""


def _requirements_sql(query: str = "") -> str:
    """Requirement candidates: categories of windows, the first of equal texts of a section, ranked within a document."""
    lists = {c: f"list_filter({lst(terms)}, lambda x: contains(low, x))" for c, terms in RULES.requirements.items()}
    base = ", ".join(f"case when len(h_{i}) > 0 then struct_pack(base := {REQUIREMENT_SCORES[c]}::double, category := {q(c)}) end" for i, c in enumerate(lists))
    every = "list_sort(list_distinct(" + "".join(f"list_concat(h_{i}, " for i in range(len(lists))) + "[]::VARCHAR[]" + ")" * len(lists) + "))"
    why = ", ".join(f"case when len(h_{i}) > 0 then {q(c + '_marker')} end" for i, c in enumerate(lists))
    hay = f"where contains({yo("concat_ws(' ', w, category, filename, coalesce(section_title, ''), array_to_string(terms, ' '), array_to_string(reasons, ' '))")}, {q(query.lower().replace('ё', 'е'))})" if query else ""
    return f"""{_WINDOWS}, lw as (select wn.doc_id, win, w, {yo('w')} as low, source as filename, lang as section_id, case when wn.doc_id % 2 = 0 then lang end as section_title from wn join documents d on wn.doc_id = d.doc_id),
hs as (select *, {', '.join(f'{v} as h_{i}' for i, v in enumerate(lists.values()))}, len(list_filter({lst(DOMAIN_HINTS)}, lambda x: contains(low, x))) as hints, coalesce(section_title, '') <> '' as titled from lw),
bs0 as (select *, list_max(list_filter([{base}], lambda x: x is not null)) as best, {every} as terms,
list_sort(list_distinct(list_filter([{why}, case when hints > 0 then 'domain_hint' end, case when titled then 'section_context' end], lambda x: x is not null))) as reasons from hs),
rq0 as (select *, best.category as category, round(least(best.base + least(0.12::double, 0.03::double * (len(terms) - 1)) + least(0.12::double, 0.04::double * hints) + case when titled then 0.02::double else 0.0::double end, 0.95::double), 2) as score from bs0 where best is not null),
rq1 as (select *, row_number() over (partition by doc_id, section_id, lower(w) order by win) as rn from (select * from rq0 where score >= 0.45) {hay}),
rq as (select *, (row_number() over (partition by doc_id order by score desc, len(terms) desc, filename desc, win))::int as rank from rq1 where rn = 1)"""


SQL["evd01_requirements"] = f"with {_requirements_sql()} select doc_id::varchar as document_id, win, category, array_to_string(terms, '|') as terms, array_to_string(reasons, '|') as reasons, score from rq"
SQL["rnk05_requirements_per_document"] = f"with {_requirements_sql()} select doc_id::varchar as document_id, rank, category, score from rq where rank <= 2"
SQL["agg03_requirements_summary"] = f"with {_requirements_sql()} select category, count(*) as n, count(distinct doc_id) as documents from rq group by category"
SQL["prd11_query_filter"] = f"with {_requirements_sql('license')} select doc_id::varchar as document_id, win, category, score from rq"
_PROC = f"""pr as (select doc_id as k, doc_id::varchar as document_id, source, lang, text, doc_id % 11 <> 0 as has_s, doc_id % 13 <> 0 as has_b, doc_id % 17 <> 0 as has_c,
case doc_id % 3 when 1 then 'table' when 2 then 'image' else 'paragraph' end as kind, case when doc_id % 4 <> 0 then (doc_id % 4)::int end as page from documents where doc_id % 7 <> 0)"""
SQL["src13_typed_documents"] = """select doc_id, doc_id % 7 <> 0 as is_object, case when doc_id % 7 <> 0 then doc_id::varchar end as document_id, case when doc_id % 7 <> 0 and doc_id % 11 <> 0 then 2 else 0 end as n_sections,
case when doc_id % 7 <> 0 and doc_id % 13 <> 0 then 1 else 0 end as n_blocks, case when doc_id % 7 <> 0 and doc_id % 3 = 1 then 1 else 0 end as n_tables, case when doc_id % 7 <> 0 and doc_id % 17 <> 0 then 1 else 0 end as n_chunks,
case when doc_id % 7 <> 0 and doc_id % 13 <> 0 and doc_id % 4 <> 0 then (doc_id % 4)::int end as page from documents"""
SQL["aud01_chunk_records"] = rf"""with {_PROC}, a as (select *, k % 5 <> 0 and has_s as sec, {squeeze('text')} as flat, case when has_b and kind = 'table' then 't1' end as table_id, case when has_b then page end as pg from pr where has_c),
b as (select *, case when not has_b then 'unknown' when kind = 'image' then 'image' when kind = 'table' then case when contains(lower(flat), 'строка') or contains(lower(flat), 'row') then 'table_row' else 'table' end else 'text' end as ct,
case when sec then {squeeze("'Part ' || lang")} end as st, lower(flat) as low from a),
f as (select *, list_sort(list_filter([case when flat = '' then 'empty_or_whitespace_text' when length(flat) < 120 then 'short_chunk' end, case when not sec then 'missing_section' end, case when pg is null then 'missing_page' end,
case when low <> '' and (regexp_matches(low, '\|.+\||;.*;|(?:^|[^\p{{L}}\p{{N}}_])(?:row|column) +\d+(?:[^\p{{L}}\p{{N}}_]|$)') or {any_in('low', TABLE_LIKE_TERMS)}) then 'table_like_text' end,
case when ct = 'unknown' then 'unknown_content_type' end, case when has_b and kind = 'image' then 'image_or_ocr_limited' end], lambda x: x is not null)) as fl from b)
select document_id, ct as content_type, 'pdf' as source_type, st as section_title, case when sec then 'Document>' || st else '' end as path, pg as page_start, pg as page_end, table_id, case when table_id is not null and sec then st end as table_title,
case when table_id is not null then 'A,B' else '' end as headers, case when table_id is not null then 2 end as row_count,
concat_ws(' - ', source || '.pdf', case when table_id is not null then 'table t1' when sec then 'Document > ' || st end, case when pg is not null then 'page ' || pg end) as location_label, array_to_string(fl, ',') as flags,
((not sec)::int + (pg is null)::int + list_contains(fl, 'short_chunk')::int + (list_contains(fl, 'table_like_text') and table_id is null)::int + (ct = 'image' or list_contains(fl, 'image_or_ocr_limited'))::int + (ct = 'unknown')::int) as notes,
length(substr(flat, 1, 300))::int as preview from f"""
SQL["prd04_ocr_candidates"] = f"""with {_PROC}, s as (select *, coalesce(case when has_b and kind <> 'image' then length(trim(text)) end, 0) = 0 as nt from pr),
g as (select *, list_filter([case when nt then 'no_text' end, case when not has_b then 'no_blocks' end, case when not has_c then 'no_chunks' end], lambda x: x is not null) as sg from s)
select document_id, len(sg) >= 2 as ocr_candidate, case when len(sg) >= 2 then 'pdf_without_text' end as reason, array_to_string(sg, ',') as signals from g"""
SQL["agg14_ocr_summary"] = """select count(*) as files, count_if(turn % 5 > 2)::bigint as success, count_if(turn % 5 = 0)::bigint as "empty", count_if(turn % 5 = 1)::bigint as unsupported, count_if(turn % 5 = 2)::bigint as failed,
coalesce(round(avg(case when turn % 5 > 2 then length(text) end), 2), 0.0) as avg_text_chars from conversations"""
_F = [q(x) for x in qa.FAILURES]
_DIAG = f"""i as (select conv_id, turn, conv_id % 10 as k, text, case conv_id % 10 when 9 then 'Таблица: ' || text when 8 then text || ' scanned' else text end as question,
case when conv_id % 10 = 0 then ' ' else 'Doc ' || (conv_id % 10) || '.pdf' end as expected, case when conv_id % 10 = 5 then 'no_hits' end as reason,
case when turn % 2 = 0 then 'doc ' || (conv_id % 10) when turn % 5 = 1 then 'other' end as hit, case when turn % 3 <> 0 then (turn % 7) / 10.0 end as overlap from conversations),
j as (select *, {form("question || ' ' || expected")} as words, hit is not null and hit = 'doc ' || k and k <> 0 as found, overlap < 0.15 as low, k = 6 as done from i),
dg as (select conv_id, turn, case when k = 0 then {_F[0]} when k = 1 then {_F[1]} when k = 2 then {_F[2]} when k = 3 then {_F[3]} when k = 7 then {_F[2]} when k = 4 then {_F[4]}
when {any_in('words', qa.SCAN_STEMS)} then {_F[9]} when {any_in('words', qa.TABLE_STEMS)} and (overlap is null or low or not found) then {_F[8]}
when k = 5 or hit is null then {_F[10]} when coalesce(low, false) and found then {_F[7]} when not found and done then {_F[5]} when not found then {_F[6]} else {_F[11]} end as failure from j)"""
SQL["qae02_diagnosis"] = f"with {_DIAG} select conv_id, turn, failure from dg"
SQL["agg13_failure_counts"] = f"with {_DIAG}, ev as (select unnest({lst(qa.FAILURES)}) as failure, unnest(range(12))::int as place) select place, failure, (select count(*) from dg where dg.failure = ev.failure) as n from ev"
