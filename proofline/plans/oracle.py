"""SQL that DuckDB runs on the same tables, one text per registered query that SQL can express."""

from __future__ import annotations

from proofline.functions.tokens import NUMBER_WORDS, STOP_WORDS

# Rows of the OCR files with their reason, as SQL: fields by a scan of quoted or plain pieces.
_OCR = r"""
with src as (
  select distinct raw_id, pdf, page, line_no, coalesce(dialect, 'plain') as dialect, regexp_replace(raw_line, '\r$', '') as line from ocr_raw),
heads as (
  select pdf, page, string_split(min(regexp_replace(line, '^' || chr(65279), '')), chr(9)) as cols from src where line_no = 1 group by pdf, page),
data as (
  select s.*, h.cols from src s join heads h on s.pdf = h.pdf and s.page = h.page where s.line_no <> 1),
judged as (
  select *, line is null or trim(line, ' ' || chr(9)) = '' as blank,
    dialect = 'quoted' and not regexp_full_match(line, '(?:"(?:[^"]|"")*"|[^"\t]*)(?:\t(?:"(?:[^"]|"")*"|[^"\t]*))*') as misquoted from data),
split as (
  select *, case when blank or misquoted then null when dialect = 'quoted'
    then list_transform(regexp_extract_all(chr(9) || line, '\t("(?:[^"]|"")*"|[^"\t]*)', 1),
           lambda x: case when x like '"%' then replace(x[2:-2], '""', '"') else x end)
    else string_split(line, chr(9)) end as f from judged),
cells as (
  select *, len(f) = len(cols) or (len(f) = len(cols) - 1 and cols[-1] = 'text'
      and f[list_position(cols, 'level')] in ('1', '2', '3', '4')) as fits,
    f[list_position(cols, 'level')] as level, f[list_position(cols, 'conf')] as conf,
    case when list_position(cols, 'text') <= len(f) then f[list_position(cols, 'text')] else '' end as text,
    list_transform(['page_num', 'block_num', 'par_num', 'line_num', 'word_num', 'left', 'top', 'width', 'height'],
      lambda c: f[list_position(cols, c)]) as counts from split),
reasons as (
  select *, case when blank then 'column_count' when misquoted then 'quoting' when not fits then 'column_count'
    when not regexp_full_match(level, '[1-5]') or not regexp_full_match(conf, '-1|[0-9]+(\.[0-9]+)?')
      or try_cast(conf as double) > 100 or len(list_filter(counts, lambda c: not regexp_full_match(c, '[0-9]+'))) > 0
    then 'value' end as reason from cells)
"""

_W = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _blanks(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_W}+', ' ', 'g'), ' ')"


def _quotes(x: str) -> str:
    return f"translate({x}, '‘’‚‛“”„‟', repeat(chr(39), 4) || repeat(chr(34), 4))"


def _norm(x: str) -> str:
    divided = rf"[-\x{{AD}}\x{{2010}}]{_W}*[\n\r\x{{2028}}\x{{2029}}]{_W}*(\p{{Ll}})"
    return _blanks(f"regexp_replace({_quotes(x)}, '{divided}', '\\1', 'g')")


def _count(h: str, n: str) -> str:
    return f"(case when {n} = '' then 0 else cast((length({h}) - length(replace({h}, {n}, ''))) // greatest(length({n}), 1) as int) end)"


def _kind(n: str) -> str:
    return f"(case when {n} = 0 then 'missing' when {n} = 1 then 'unique' when {n} > 1 then 'ambiguous' end)"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _inside(text: str, token: str, flags: str = "") -> str:
    """A token without an ASCII letter or digit beside it; this dialect has no look-around, so the text is padded."""
    return f"regexp_matches(' ' || {text} || ' ', '{flags}[^0-9A-Za-z]' || regexp_escape({token}) || '[^0-9A-Za-z]')"


def _sentences(x: str) -> str:
    cut = rf"string_split(regexp_replace({x}, '([.!?])[ \t\n\f\r]+', '\1' || chr(1), 'g'), chr(1))"
    return f"list_filter(list_transform({cut}, lambda s: {_norm('s')}), lambda s: s <> '')"


_SUM = "s as (select distinct on (id) id, claims, sources from summaries)"
_CLAIMS = _SUM + ", claims_x as (select id, cast(generate_subscripts(claims, 1) - 1 as int) as claim, unnest(claims) as claim_text from s)"
_UNITS = "u as (select distinct on (unit_id) * from md_units)"
_PAGES = "p as (select distinct on (page_id) * from pdf_pages)"
_LOC = """l as (select *, cast(row_number() over (partition by id, claim order by locator_id) - 1 as int) as nth
  from (select distinct on (locator_id) * from locators))"""
_REV = "r as (select distinct on (review_id) * from reviews)"
_DECLARED = "d as (select id, unnest(sources) as src from s)"
_NUMBERS = "list_transform(regexp_extract_all(claim_text, '[0-9][0-9.,]*%?'), lambda t: rtrim(t, '.,'))"
_NUMBER_WORDS = f"list_filter({_list(NUMBER_WORDS)}, lambda w: {_inside('lower(claim_text)', 'w')})"
_FOUND = f"""{_SUM}, {_DECLARED}, {_UNITS}, {_PAGES}, {_LOC},
 cfg as (select * from (values ('default', true), ('supplement', false), ('compendium', false)) t(name, takes)),
 ok as (select d.id, src.name as source, src.markdown is not null as md_ok from d join cfg on cfg.name = src.name where not (src.markdown is not null and not takes)),
 ui as (select id, source, kind, line, col, count(*) as units, min(text) as unit_text, min_by(section, text) as unit_section from u group by all),
 pi as (select id, source, backend, page, count(*) as pages, min(text) as page_text from p group by all),
 f as (select l.*, ok.id is not null as source_ok, md_ok, units, unit_section, pages, {_norm('l.exact')} as needle, {_norm('unit_text')} as hay, {_norm("coalesce(page_text, '')")} as page_hay
   from l left join ok on ok.id = l.id and ok.source = l.source
   left join ui on ui.id = l.id and ui.source = l.source and ui.kind = l.markdown.unit and ui.line = l.markdown.line and ui.col = l.markdown.col
   left join pi on pi.id = l.id and pi.source = l.source and pi.backend = l.pdf.backend and pi.page = l.pdf.page),
 found as (select *, {_count('hay', 'needle')} as md_count, {_count('page_hay', 'needle')} as pdf_count from f)"""
_LEGS = f"""{_FOUND}, per as (select id, claim, count(*) as n, bool_and(not (source_ok and (pages is null or pdf_count <> 1))) as pdf_ok from found group by all),
 hits as (select distinct l.id, l.claim, l.nth, u.source from l join u on u.id = l.id where u.source = 'default' and {_count(_norm('u.text'), _norm('l.exact'))} = 1),
 md as (select id, claim, source, count(*) as hits from hits group by all),
 legs as (select per.id, per.claim, list_concat(case when pdf_ok then ['pdf'] else [] end, case when md.source is not null then [md.source] else [] end) as legs
   from per left join md on md.id = per.id and md.claim = per.claim and md.hits = per.n)"""
_WORDS = f"""list_distinct(list_filter(regexp_extract_all(translate({_norm('claim_text')}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z]+'),
  lambda w: length(w) >= 4 and not list_contains({_list(STOP_WORDS)}, w)))"""
# This dialect has no look-around: every quote first gets a sign for whether it may open (1), close (2), do both (3) or neither.
_ALNUM = r"'[\p{L}\p{N}]'"


def _phrases(x: str) -> str:
    def marked(q: str, i: int) -> str:
        side = lambda at: f"regexp_matches(coalesce(ch[{at}], ' '), {_ALNUM})"
        sign = f"case when {side('i - 1')} and {side('i + 1')} then chr(4) when {side('i + 1')} then chr(1) when {side('i - 1')} then chr(2) else chr(3) end"
        text = f"array_to_string(list_transform(range(1, len(ch) + 1), lambda i: case when ch[i] = {q} then {sign} else ch[i] end), '')"
        found = f"regexp_extract_all({text}, '(?s)[' || chr(1) || chr(3) || '](.*?)[' || chr(2) || chr(3) || ']', 1)"
        return f"list_transform({found}, lambda f: translate(f, chr(1) || chr(2) || chr(3) || chr(4), repeat({q}, 4)))"

    both = f"list_concat({marked('chr(34)', 0)}, {marked('chr(39)', 1)})"
    return f"list_filter(list_transform({both}, lambda f: {_norm('f')}), lambda f: f <> '')"


_CHARS = f"{_CLAIMS}, ch_x as (select *, string_split(claim_text, '') as ch from claims_x)"
_REQUIRED = f"list_sort(list_distinct(list_concat(list_concat({_NUMBERS}, {_NUMBER_WORDS}), {_phrases('claim_text')})))"


def _object(fields: dict[str, str]) -> str:
    parts = ", ".join(f"""'"{k}":' || to_json({v})""" for k, v in fields.items())
    return "'{' || array_to_string(list_filter([" + parts + "], lambda x: x is not null), ',') || '}'"


def _terms(x: str) -> str:
    """Runs of capitalised words: all other words become a sign that the rest is split at."""
    words = f"list_filter(string_split_regex(s, '{_W}+'), lambda w: w <> '')[2:]"
    signed = f"list_transform({words}, lambda w: case when regexp_matches(w, '(?s)^\\p{{Lu}}.*\\p{{Ll}}') then w else chr(1) end)"
    runs = f"list_transform(string_split(array_to_string({signed}, chr(2)), chr(1)), lambda r: list_filter(string_split(r, chr(2)), lambda w: w <> ''))"
    kept = f"list_transform(list_filter({runs}, lambda r: len(r) >= 2), lambda r: array_to_string(r, ' '))"
    return f"flatten(list_transform(string_split_regex({x}, '[.!?]'), lambda s: {kept}))"


_COVERS = f"case when list_contains({_list(NUMBER_WORDS)}, t) then {_inside('exact', 't', '(?i)')} else {_inside('exact', 't')} end"
_SECTION = "case when len(markdown.section) > 0 then markdown.section end"
_MARKDOWN = _object({"column": "markdown.col", "line": "markdown.line", "section": _SECTION, "unit": "markdown.unit"})
_PDF = _object({"backend": "pdf.backend", "page": "pdf.page"})
_CANONICAL = f"""{_LOC}, j as (select id, claim, nth, '{{"exact":' || to_json({_norm('exact')}) || case when markdown is not null then ',"markdown":' || {_MARKDOWN} else '' end
   || case when pdf is not null then ',"pdf":' || {_PDF} else '' end || ',"source":' || to_json(coalesce(source, 'default')) || '}}' as one from l),
 canon as (select id, claim, '[' || string_agg(one, ',' order by nth) || ']' as canonical from j group by all)"""
_LINES = "string_split(text, chr(10))"

_SPANS = f"""{_UNITS}, n_x as (select *, {_norm('text')} as n from u), sn_x as (select *, {_sentences('n')} as ss from n_x),
 all_x as (select *, case when len(ss) > 1 then list_append(ss, n) else ss end as spans from sn_x),
 one_x as (select *, unnest(spans) as exact, generate_subscripts(spans, 1) - 1 as span_ord from all_x),
 spans_x as (select * from one_x where {_count('n', 'exact')} = 1)"""

ORACLE: dict[str, str] = {
    "p2_found": _OCR + "select distinct raw_id, reason from reasons where reason is not null",
    "p2_loaded": _OCR
    + """select raw_id, pdf, page, line_no, cast(level as int) as level, cast(counts[1] as bigint) as page_num,
  cast(counts[2] as bigint) as block_num, cast(counts[3] as bigint) as par_num, cast(counts[4] as bigint) as line_num,
  cast(counts[5] as bigint) as word_num, cast(counts[6] as bigint) as left_px, cast(counts[7] as bigint) as top_px,
  cast(counts[8] as bigint) as width, cast(counts[9] as bigint) as height, cast(conf as double) as conf, text
  from reasons where reason is null""",
    "norm_documents": f"select doc_id, {_norm('text')} as norm, sha256({_norm('text')}) as digest from documents",
    "norm_whitespace_only": f"select distinct unit_id, {_blanks('text')} as norm from md_units",
    "fold_quotes": f"select doc_id, {_quotes('text')} as folded from documents",
    "units_by_line": f"""with x as (select doc_id, unnest({_LINES}) as line, generate_subscripts({_LINES}, 1) as line_no from documents)
 select doc_id, line_no, {_blanks('line')} as unit from x where {_blanks('line')} <> ''""",
    "unit_index": f"with {_UNITS} select id, source, kind, line, col, count(*) as units from u group by all",
    "sentences": f"""with {_UNITS}, x as (select unit_id, {_sentences('text')} as ss from u)
 select unit_id, unnest(ss) as sentence, generate_subscripts(ss, 1) - 1 as pos from x""",
    "candidate_spans": f"""with {_SPANS}
 select id, source, ord as unit_ord, span_ord, exact, line, col, kind as unit from spans_x""",
    "propose_scored": f"""with {_CHARS}, {_SPANS}, w as (select id, claim, {_REQUIRED} as required from ch_x),
 m as (select w.id, claim, exact, line, col, source, ord, span_ord, len(list_filter(required, lambda t: {_COVERS})) as matched from w join spans_x x on x.id = w.id where len(required) > 0),
 r as (select *, row_number() over (partition by id, claim order by matched desc, strlen(exact), source, line, col, ord, span_ord) as rank from m where matched > 0)
 select id, claim, rank, matched, exact, line, col from r where rank <= 3""",
    "document_terms": f"""with x as (select doc_id, {_terms('text')} as f from documents)
 select doc_id, unnest(f) as term, generate_subscripts(f, 1) - 1 as pos from x""",
    "claim_hash": f"with {_CLAIMS} select id, claim, claim_text, sha256(claim_text) as claim_hash from claims_x",
    "numeric_tokens": f"""with {_CLAIMS}, x as (select id, claim, {_NUMBERS} as t from claims_x)
 select id, claim, unnest(t) as token, generate_subscripts(t, 1) - 1 as pos from x""",
    "number_words": f"with {_CLAIMS} select id, claim, unnest({_NUMBER_WORDS}) as token from claims_x",
    "quoted_phrases": f"""with {_CHARS}, x as (select id, claim, {_phrases('claim_text')} as f from ch_x)
 select id, claim, unnest(f) as phrase, generate_subscripts(f, 1) - 1 as pos from x""",
    "required_tokens": f"with {_CHARS} select id, claim, {_REQUIRED} as tokens from ch_x",
    "token_coverage": f"""with {_CHARS}, {_LOC}, e as (select id, claim, list(exact) as exacts from l group by all),
 x as (select c.id, c.claim, unnest({_REQUIRED}) as token, exacts from ch_x c join e on e.id = c.id and e.claim = c.claim)
 select id, claim, token from x where len(list_filter(exacts, lambda t: case when list_contains({_list(NUMBER_WORDS)}, token) then {_inside('t', 'token', '(?i)')} else {_inside('t', 'token')} end)) = 0""",
    "canonical_json_hash": f"with {_CANONICAL} select id, claim, canonical, sha256(canonical) as digest from canon",
    "review_stale": f"""with {_CLAIMS}, {_CANONICAL}, {_REV},
 one as (select distinct on (id, claim) * from (select r.* from r join s on s.id = r.id where claim < len(claims)) order by id, claim, review_id)
 select o.id, 'stale_review_claim' as code, o.claim, 1 as n from one o join claims_x c on c.id = o.id and c.claim = o.claim where o.claim_sha256 is distinct from sha256(claim_text)
 union all select o.id, 'stale_review_evidence', o.claim, 1 from one o join canon c on c.id = o.id and c.claim = o.claim where o.evidence_sha256 is distinct from sha256(canonical)""",
    "content_words": f"with {_CLAIMS} select id, claim, unnest({_WORDS}) as word from claims_x",
    "word_coverage": f"""with {_CLAIMS}, {_LOC}, e as (select id, claim, list(exact) as exacts from l group by all),
 x as (select c.id, c.claim, unnest({_WORDS}) as word, exacts from claims_x c join e on e.id = c.id and e.claim = c.claim)
 select id, claim, word from x where len(list_filter(exacts, lambda t: {_inside('t', 'word', '(?i)')})) = 0""",
    "locator_outcomes": f"""with {_FOUND} select locator_id, coalesce(units, 0) as units, {_kind('md_count')} as markdown_outcome,
 case when pages is not null then {_kind('pdf_count')} end as pdf_outcome from found""",
    "weak_sections": f"""with {_FOUND} select id, claim from found group by all having bool_and(source_ok and md_ok and coalesce(units = 1, false)
 and len(list_filter(coalesce(unit_section, []), lambda h: contains(lower(h), 'gal') or contains(lower(h), 'vor'))) > 0)""",
    "stale_sections": f"""with {_FOUND} select id, claim, nth as locator from found where source_ok and md_ok and units = 1 and md_count = 1
 and len(markdown.section) > 0 and coalesce(unit_section, []) <> markdown.section""",
    "altered_sections": f"with {_FOUND} select id, claim, nth as locator from found where source_ok and md_ok and markdown is not null and units = 1 and md_count = 1",
    "doubled_entries": f"with {_CLAIMS}, {_LOC} select distinct l.id, 'duplicate_entry' as code, l.claim from l join claims_x c on c.id = l.id and c.claim = l.claim join s on s.id = l.id where sources is not null",
    "stale_hash": f"""with {_CLAIMS}, {_LOC}, e as (select id, claim, min_by(claim_sha256, nth) as h from l group by all)
 select e.id, case when claim >= len(claims) then 'entry_out_of_range' else 'stale_hash' end as code, claim
 from e join s on s.id = e.id where claim >= len(claims) or h is distinct from sha256(claims[claim + 1])""",
    "missing_entries": f"""with {_CLAIMS}, {_LOC} select c.id, 'missing_evidence_entry' as code, c.claim from claims_x c join s on s.id = c.id
 where sources is not null and not exists (select 1 from l where l.id = c.id and l.claim = c.claim)""",
    "unused_sources": f"""with {_SUM}, {_DECLARED}, {_LOC} select id, src.name as source from d
 where not exists (select 1 from l where l.id = d.id and coalesce(l.source, 'default') = d.src.name)""",
    "unknown_sources": f"""with {_SUM}, {_DECLARED}, {_LOC}
 select l.id, case when d.id is null then 'unknown_source' else 'markdown_locator_mismatch' end as code, claim, l.source
 from l join s on s.id = l.id and s.sources is not null left join d on d.id = l.id and d.src.name = l.source
 where d.id is null or (d.src.markdown is null) <> (l.markdown is null)""",
    "unnormalized_exact": f"""with {_LOC} select id, case when {_norm('exact')} = '' then 'empty_exact' else 'unnormalized_exact' end as code, claim
 from l where {_norm('exact')} <> exact""",
    "review_missing": f"""with {_CLAIMS}, {_REV} select c.id, 'missing_review' as code, c.claim, 1 as n from claims_x c
 where not exists (select 1 from r where r.id = c.id and r.claim = c.claim)
 union all select r.id, 'unknown_review_claim', claim, count(*) from r join s on s.id = r.id where claim >= len(claims) group by all""",
    "review_unsupported": f"""with {_SUM}, {_REV}, x as (select r.* from r join s on s.id = r.id where claim < len(claims))
 select id, 'unsupported_verdict' as code, claim, count(*) as n from x where coalesce(verdict, '') <> 'supported' group by all
 union all select id, 'duplicate_review_claim', claim, count(*) - 1 from x group by all having count(*) > 1""",
    "legs": f"with {_LEGS} select id, claim, array_to_string(legs, ',') as legs, len(legs) >= 2 as corroborated from legs",
    "locate_literals": f"""with {_UNITS}, n as (select unit_id, {_norm('text')} as hay from u),
 c as (select candidate_id, {_norm('exact')} as needle from (select distinct on (candidate_id) * from candidates)),
 h as (select candidate_id, unit_id, {_count('hay', 'needle')} as hits from c join n on needle <> '' and contains(hay, needle)),
 g as (select candidate_id, count(*) as places, count(*) filter (hits = 1) as singles, min(unit_id) filter (hits = 1) as one from h group by all)
 select c.candidate_id as literal, coalesce(places, 0) as places, case when singles = 1 then one end as unique_key,
 case when singles = 1 then 'unique' when places > 0 then 'ambiguous' else 'missing' end as outcome from c left join g on g.candidate_id = c.candidate_id""",
    "locate_pages": f"""with {_PAGES}, {_LOC}, n as (select id, page, {_norm('text')} as hay from p where backend = 'mutool-native'),
 c as (select id, locator_id, {_norm('exact')} as needle from l),
 h as (select locator_id, page, {_count('hay', 'needle')} as hits from c join n on n.id = c.id and needle <> '' and contains(hay, needle)),
 g as (select locator_id, count(distinct page) as pages, min(page) as page, max(hits) as most from h group by all)
 select c.locator_id as literal, coalesce(pages, 0) as pages, case when pages = 1 then page end as page,
 case when pages is null then 'missing' when pages > 1 then 'many' when most > 1 then 'repeated' else 'ok' end as outcome
 from c left join g on g.locator_id = c.locator_id""",
    "extract_markdown": f"""with {_PAGES}, x as (select id, source, page, {_norm("coalesce(text, '')")} as t from p where backend = 'mutool-native')
 select id, source, string_agg('## Page ' || page || chr(10) || chr(10) || case when t = '' then '' else t || chr(10) || chr(10) end, '' order by page) as markdown,
 count(*) as pages, count(*) filter (t <> '') as paragraphs from x group by all""",
    "source_pages": f"with {_LOC} select id, source, pdf.backend as backend, count(distinct pdf.page) as cited_pages from l group by all",
    "ocr_page_text": _OCR
    + f""", w as (select *, {_blanks('text')} <> '' as worded from reasons where reason is null),
 g as (select pdf, page, line_no, text, try_cast(conf as double) as c, [counts[2], counts[3], counts[4]] as k,
   lag([counts[2], counts[3], counts[4]]) over (partition by pdf, page order by line_no) as before from w where worded)
 select pdf, page, string_agg(case when before is null then '' when before = k then ' ' else chr(10) end || text, '' order by line_no) as text,
   avg(c) filter (c >= 0) as mean_confidence, count(*) as words from g group by all""",
}

# The roll-up composes the texts above: one row per issue, with its severity.
_ERRORS = ["stale_hash", "missing_entries", "unused_sources", "unknown_sources", "unnormalized_exact", "token_coverage"]
_COUNTED = ["review_missing", "review_unsupported", "review_stale"]
_NAMED = f"""{_SUM}, {_DECLARED}, cfg as (select * from (values ('default', true, ['md/{{id}}.md', 'md/{{id}}/{{id}}.md'], 'pdfs/{{id}}.pdf'),
  ('supplement', false, [], 'pdfs/{{id}}-supp.pdf'), ('compendium', false, [], 'pdfs/compendium/{{id}}.pdf')) t(name, takes, mds, pdf)),
 dc as (select d.id, src, takes, mds, cfg.pdf as pdf_template from d left join cfg on cfg.name = src.name)"""
_SOURCE_ISSUES = f"""with {_NAMED} select id from dc where takes is null or (not takes and src.markdown is not null)
 union all select id from dc where takes and src.markdown is not null and not list_contains(list_transform(mds, lambda t: replace(t, '{{id}}', id)), src.markdown.source)
 union all select id from dc where takes is not null and not (not takes and src.markdown is not null) and src.pdf is not null and src.pdf.source <> replace(pdf_template, '{{id}}', id)"""
_LOCATOR_ISSUES = f"""with {_FOUND} select id from found where source_ok and md_ok and markdown is not null and (units is null or units > 1 or md_count <> 1
   or (len(markdown.section) > 0 and coalesce(unit_section, []) <> markdown.section))
 union all select id from found where source_ok and (pages is null or pdf_count is null or pdf_count <> 1)"""
_ISSUES = "issues_x as (" + " union all ".join(
    [f"select id, 'error' as severity from ({ORACLE[k]})" for k in _ERRORS]
    + [f"select id, 'error' from (select id, unnest(range(n)) from ({ORACLE[k]}))" for k in _COUNTED]
    + [f"select id, 'error' from ({q})" for q in (_SOURCE_ISSUES, _LOCATOR_ISSUES)]
    + [f"select id, 'warning' from (select distinct id, claim from ({ORACLE['word_coverage']}))", f"select id, 'warning' from ({ORACLE['weak_sections']})", f"select id, 'warning' from ({ORACLE['legs']}) where not corroborated"]
) + ")"
_ROLLUP = f"""with {_ISSUES}, b as (select distinct on (id) id, sources is null as missing from summaries),
 c as (select id, count(*) filter (severity = 'error') as errors, count(*) filter (severity = 'warning') as warnings from issues_x group by id),
 g as (select id, count(*) as entries, count(*) filter (corroborated) as corroborated from ({ORACLE['legs']}) group by id),
 rollup_x as (select b.id, case when missing then 'missing' when coalesce(errors, 0) > 0 then 'invalid' else 'valid' end as outcome, coalesce(errors, 0) as errors,
   coalesce(warnings, 0) as warnings, coalesce(entries, 0) as entries, coalesce(corroborated, 0) as corroborated, coalesce(entries, 0) - coalesce(corroborated, 0) as single_leg
   from b left join c on c.id = b.id left join g on g.id = b.id)"""
ORACLE |= {
    "check_rollup": f"{_ROLLUP} select * from rollup_x",
    "check_report": f"""{_ROLLUP} select count(*) filter (outcome <> 'missing') as checked, count(*) filter (outcome = 'valid') as valid, count(*) filter (outcome = 'invalid') as invalid,
 count(*) filter (outcome = 'missing') as skipped, coalesce(sum(corroborated), 0)::bigint as corroborated, coalesce(sum(single_leg), 0)::bigint as single_leg from rollup_x""",
    "audit_rollup": f"""{_ROLLUP} select count(*) as total, count(*) filter (outcome = 'valid') as valid, count(*) filter (outcome = 'missing') as missing, count(*) filter (outcome = 'invalid') as invalid,
 coalesce(sum(case when outcome = 'invalid' then errors + warnings end), 0)::bigint as issues_shown from rollup_x""",
}
