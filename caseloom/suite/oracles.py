"""The queries' questions in DuckDB SQL, written independently of the Spark plans."""

from __future__ import annotations

ORACLES: dict[str, str] = {}


PROMPT = "'Répondez avec le document.'"
EMAIL = (r"'^[a-zA-Z0-9.!#$%&''*+/=?^_`{|}~-]+@[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?"
         r"(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)*$'")


# --- input relations ------------------------------------------------------------------------------------------------

APPLICANTS = """applicants as (
  select c_custkey as applicant_id, case when c_custkey % 31 = 5 then null else cast(18 + c_custkey % 43 as int) end as age,
         case c_custkey % 4 when 0 then 'Secondaire' when 1 then 'Baccalauréat' when 2 then 'Master'
           else case c_custkey % 5 when 0 then 'Licence' when 1 then null else 'Doctorat' end end as education,
         case when c_custkey % 37 = 6 then null else cast(c_custkey % 19 as double) / 2 end as language_score,
         case when c_custkey % 31 = 5 then null else cast(c_custkey % 16 as int) end as work_experience
  from customer)"""

REQUIRED = """required_docs as (
  select * from (values (0,'passeport'),(1,'photos'),(2,'relevé_bancaire'),(3,'lettre_invitation'),(4,'preuve_linguistique')) as t(doc_no, doc)),
submitted as (select applicant_id, doc from applicants cross join required_docs where (applicant_id * 3 + doc_no) % 7 <> 0)"""

MESSAGES = """messages as (
  select conv_id, turn, role, text from conversations
  union all
  select -1, nullif(conv_id, 0) * 3, case when conv_id % 3 = 2 then 'assistant' else 'user' end, 'm' || conv_id from conversations where turn = 0)"""

CONV_DOCS = """conv_docs as (
  select conv_id, case when conv_id % 10 = 9 then null when conv_id % 4 = 0 then 0 else conv_id end as doc_id from conversations where turn = 0
  union all select -1, 1)"""

CAPTURED = """captured as (
  select page_id, case when page_id % 10 = 9 then 'https://again.example.org/x/y' || (page_id // 40) else url end as url,
    html || case page_id % 6
      when 0 then '<p>Caf&eacute; &#233;t&#xE9; &amp;lt; &hellip;</p>'
      when 1 then '<SCRIPT>var t="<p>no</p>";</SCRIPT><DIV CLASS="ad big">buy<div>in</div>more</DIV><P>after</P>'
      when 2 then '<a href="p?a=1&amp;b=2">x</a><A HREF=q>u</A><a class=c href=''r#s''>v</a>'
      when 3 then '<a href="../x/./y">d</a><a href="/a/../b/">e</a>'
      when 4 then '<div class=''x ad''>no</div><div data-class="ad">kept</div>'
      else '' end as html
  from pages),
newest as (select url, max(page_id) as page_id from captured group by url)"""

LINK_PLAN = f"""{CAPTURED},
link_plan as (
  select a.page_id, cast(k.pos as int) as pos,
         case when (a.page_id + k.pos) % 5 = 0
              then 'https://missing.example.org/' || a.page_id || '/' || k.pos else b.url end as link
  from pages a cross join (select unnest(range(1, 41)) as pos) as k
  join captured b on b.page_id = case when (a.page_id + k.pos) % 3 = 0 then 0 else (a.page_id * 7 + k.pos * 13) % (select count(*) from pages) end
  where k.pos <= case when a.page_id = 0 then 40 else 1 + a.page_id % 8 end)"""

RESPONSES = """responses as (
  select doc_id, lang, j, case doc_id % 5
    when 0 then 'Résumé: ' || lang || chr(10) || '```json' || chr(10) || j || chr(10) || '```'
    when 1 then 'Résumé: ' || lang
    when 2 then 'Résumé: ' || lang || ' ```json' || substr(j, 1, length(j) - 1) || '```'
    when 3 then 'Résumé: ' || lang || ' ```json' || j || '```' || chr(10) || 'fin'
    else 'Résumé: ' || lang || ' ```json ' || j end as response
  from (select doc_id, lang, '{"sujets_principaux":["' || source || '","' || lang || '"],"thèmes_clés":[{"thème":"' || lang
          || '","description":"d' || doc_id || '","sujets_connexes":["' || source
          || '","voisin"]}],"points_de_données_significatifs":[{"point_de_donnée":"' || doc_id || '","contexte":"' || lang || '"}],"insights":[{"insight":"i' || doc_id
          || '","explication":"' || lang || '"}]}' as j from documents) x)"""

# The four ways of writing hold the same things, so the plain contents are told here and not read out of the markup.
STATUS_PAGES = """status_pages as (
  select o_orderkey as case_key, cast(case when o_orderkey % 17 = 0 then 500 else 200 end as int) as status_code,
    case when o_orderkey % 10 = 0 then null when o_orderstatus = 'F' then 'DecisionMade' when o_orderstatus = 'O' then 'InProcess'
         else 'ApplicationReceived' end as status,
    case when o_orderkey % 10 not in (0, 3) then cast(o_orderkey as varchar) end as case_id,
    case when o_orderkey % 10 in (0, 3) then [] when o_orderkey % 10 in (1, 4) then ['Received ' || o_orderpriority]
         when o_orderkey % 10 = 2 then ['Reçu & ' || o_orderpriority] when o_orderkey % 250 = 15 then [null, 'inner ' || o_orderkey] else ['Received ' || o_orderpriority, null] end as items
  from orders)"""

ELEMENTS = """elements as (
  select case when event_id % 5 = 3 then 0 else user_id end as doc_id, case when event_id % 5 = 3 then 1 else cast(1 + event_id % 5 as int) end as page_no,
         event_id as elem_no, case when event_type = 'error' then 'R' else 'T' end as elem_type,
         (case when event_id % 101 = 7 then null when event_id % 4 = 0 then 500.0::double else 1000 - value end) - 5 as y0,
         case when event_id % 101 = 7 then null when event_id % 4 = 0 then 500.0::double else 1000 - value end as y1,
         event_type || '  ' || event_id || ';' as text
  from events),
boxes as (select distinct doc_id, page_no, (doc_id + page_no) % 13 <> 4 as boxed from elements union all select -1, 1, true)"""

CELL_ROWS = """cell_rows as (
  select o_custkey as doc_id, cast(1 + o_orderkey % 6 as int) as page_no, 0 as table_no, o_orderkey as row_no,
         [o_orderstatus, null, o_orderpriority][1:cast(1 + o_orderkey % 3 as int)] as cells
  from orders)"""

SUBMISSIONS = """submissions as (
  select c_custkey as sub_id, case when c_custkey % 11 = 0 then '' else c_name end as nom,
         case when c_custkey % 7 = 0 then 'bad' else 'c' || c_custkey || '@example.org' end as email,
         cast(null as varchar) as telephone,
         case c_custkey % 5 when 0 then 'evaluation' when 1 then 'information' when 2 then 'rendez-vous'
                            when 3 then 'autre' else 'inconnu' end as sujet,
         case when c_custkey % 13 = 0 then null else c_mktsegment end as message
  from customer)"""

# --- applicants -----------------------------------------------------------------------------------------------------

_RAW_SCORE = """(case when age between 18 and 35 then 1.0::double when age between 36 and 47 then 1 - (age - 35) * 0.05::double else 0.0::double end) * 0.25::double
    + (case education when 'Secondaire' then 0.4::double when 'Baccalauréat' then 0.5::double when 'Master' then 0.7::double when 'Doctorat' then 1.0::double end) * 0.3::double
    + least(language_score / 9.0::double, 1.0::double) * 0.3::double
    + least(work_experience / 6.0::double, 1.0::double) * 0.25::double"""

_KNOWN = "education in ('Secondaire', 'Baccalauréat', 'Master', 'Doctorat') and age is not null and language_score is not null and work_experience is not null"
SCORES = f"""scores as (
  select *, case when {_KNOWN} then greatest(0.0::double, least(1.0::double, {_RAW_SCORE})) end as score from applicants)"""

BANDED = """banded as (
  select applicant_id, score,
         case when score is null then null when score >= 0.8::double then 'top' when score >= 0.6::double then 'good' when score >= 0.3::double then 'medium' else 'limited' end as band
  from scores)"""

ORACLES["eligibility_score"] = f"""with {APPLICANTS}, {SCORES}
select applicant_id, round(score, 6) as score,
  case when education is null then 'unknown education: NULL' when education = 'Licence' then 'unknown education: Licence'
       when score is null then 'missing: ' || array_to_string(list_filter([case when age is null then 'age' end,
         case when language_score is null then 'language_score' end, case when work_experience is null then 'work_experience' end], lambda x: x is not null), ', ')
  end as error from scores"""

ORACLES["eligibility_score_jitter"] = f"""with {APPLICANTS}
select applicant_id, case when {_KNOWN} then round(greatest(0.0::double, least(1.0::double, {_RAW_SCORE}
    + (('0x' || substr(md5(applicant_id || '|42'), 1, 8))::bigint / 4294967296.0::double) * 0.1::double - 0.05::double)), 6) end as score
from applicants"""

ORACLES["eligibility_band"] = f"""with {APPLICANTS}, {SCORES}, {BANDED}
select applicant_id, band, case when score is not null then printf('%.2f%%', score * 100) end as percent from banded"""

ORACLES["band_summary"] = f"""with {APPLICANTS}, {SCORES}, {BANDED}
select band, count(*) as n, round(avg(score), 6) as mean_score, round(min(score), 6) as min_score, round(max(score), 6) as max_score
from banded group by band"""

ORACLES["missing_documents"] = f"""with {APPLICANTS}, {REQUIRED}
select applicant_id, doc from applicants cross join required_docs
where not exists (select 1 from submitted s where s.applicant_id = applicants.applicant_id and s.doc = required_docs.doc)"""

ORACLES["completeness_report"] = f"""with {APPLICANTS}, {REQUIRED},
missing as (select a.applicant_id, r.doc from applicants a cross join required_docs r
            left join submitted s on s.applicant_id = a.applicant_id and s.doc = r.doc where s.doc is null),
lists as (select applicant_id, count(*) as n, string_agg(doc, ', ' order by doc) as names from missing group by applicant_id)
select applicant_id, cast(coalesce(n, 0) as int) as n_missing,
       case when n is null then 'Tous les documents requis sont présents!' else 'Documents manquants : ' || names end as message
from applicants left join lists using (applicant_id)"""

# --- conversations --------------------------------------------------------------------------------------------------

_ROLE = "case when role = 'user' then 'user' else 'model' end"

ORACLES["normalize_messages"] = f"""with {MESSAGES} select conv_id, turn, {_ROLE} as role, text from messages"""

_TOLD = f"{_ROLE} || ': ' || text"
LOG = f"""{MESSAGES}, log as (
  select conv_id, turn, role, text, {_TOLD} as told, row_number() over (partition by conv_id order by turn nulls first) as n from messages)"""

ORACLES["conversation_context"] = f"""with {LOG}
select a.conv_id, a.turn, a.text as question, string_agg(b.told, chr(10) order by b.n) as history
from log a join log b on b.conv_id = a.conv_id and b.n <= a.n where a.role = 'user' group by a.conv_id, a.turn, a.n, a.text"""

ORACLES["sliding_context"] = f"""with {LOG}
select a.conv_id, a.turn, coalesce(string_agg(b.told, chr(10) order by b.n), '') as history
from log a left join log b on b.conv_id = a.conv_id and b.n between a.n - 3 and a.n - 1
where a.role = 'user' group by a.conv_id, a.turn, a.n"""


def _prompt(ending: str) -> str:
    return (f"{PROMPT} || chr(10) || chr(10) || 'Document content:' || chr(10) || coalesce(d.text, 'None') || chr(10) || chr(10) "
            f"|| 'User question: ' || m.text || chr(10) || chr(10) || '{ending}'")


_ASKED = "log m join conv_docs c using (conv_id) left join documents d on d.doc_id = c.doc_id"
ORACLES["build_prompt"] = f"""with {LOG}, {CONV_DOCS}
select m.conv_id, m.turn, c.doc_id, {_prompt('Answer:')} as prompt from {_ASKED} where m.role = 'user'"""
ORACLES["build_prompt_tabular"] = f"""with {LOG}, {CONV_DOCS}
select m.conv_id, m.turn, c.doc_id, {_prompt('Answer in a clear, tabular format with headers: ')} as prompt from {_ASKED} where m.role = 'user'"""
ORACLES["build_prompt_with_history"] = f"""with {LOG}, {CONV_DOCS},
past as (select a.conv_id, a.n, coalesce(string_agg(b.told, chr(10) order by b.n), '') as history
         from log a left join log b on b.conv_id = a.conv_id and b.n < a.n where a.role = 'user' group by a.conv_id, a.n)
select m.conv_id, m.turn, md5({_prompt('Answer:')}) as prompt_md5, p.history
from {_ASKED} join past p on p.conv_id = m.conv_id and p.n = m.n"""

ORACLES["history_blocks"] = f"""with {LOG}
select conv_id, (n - 1) // 16 as block, string_agg(told, chr(10) order by n) as told from log group by conv_id, (n - 1) // 16"""
ORACLES["history_pieces"] = f"""with {LOG}
select a.conv_id, a.turn, (b.n - 1) // 16 as block, string_agg(b.told, chr(10) order by b.n) as told
from log a join log b on b.conv_id = a.conv_id and b.n <= a.n where a.role = 'user' group by a.conv_id, a.turn, a.n, (b.n - 1) // 16"""
ORACLES["build_prompt_with_ranges"] = f"""with {LOG}, {CONV_DOCS}
select m.conv_id, m.turn, md5({_prompt('Answer:')}) as prompt_md5, (m.n - 1) // 16 as blocks, cast((m.n - 1) % 16 as int) as tail
from {_ASKED} where m.role = 'user'"""

_CAPITAL = "upper(substr(role, 1, 1)) || lower(substr(role, 2))"
_MD_LINE = f"'## ' || {_CAPITAL} || chr(10) || chr(10) || text || chr(10) || chr(10)"

ORACLES["export_transcript_md"] = f"""with {MESSAGES}
select conv_id, count(*) as n_messages, '# Chat History' || chr(10) || chr(10) || string_agg({_MD_LINE}, '' order by turn nulls first) as text
from messages group by conv_id"""

ORACLES["export_transcript_html"] = f"""with {MESSAGES},
lines as (select conv_id, turn, '<h2>' || {_CAPITAL} || '</h2>' || array_to_string(list_transform(
            list_filter(list_transform(regexp_split_to_array(text, '\\n[ \\t]*\\n'), lambda p: trim(p, ' ')), lambda p: p <> ''),
            lambda p: chr(10) || '<p>' || p || '</p>'), '') as line from messages)
select conv_id, count(*) as n_messages, '<h1>Chat History</h1>' || chr(10) || string_agg(line, chr(10) order by turn nulls first) as text
from lines group by conv_id"""

# The texts hold lines and blank lines; of their marks none is one of Markdown, but for those that are told here.
ORACLES["export_transcript_rich"] = f"""with {MESSAGES},
bodies as (select conv_id, turn, role, list_transform(list_filter(regexp_split_to_array(text, '\\n[ \\t]*\\n'), lambda p: trim(p) <> ''),
    lambda p: '<p>' || array_to_string(list_transform(string_split(trim(p, chr(10)), chr(10)), lambda l: trim(l, ' ')), chr(10)) || '</p>') as paragraphs from messages where turn is not null),
lines as (select conv_id, turn, '<h2>' || {_CAPITAL} || '</h2>' || chr(10) || '<h3>About ' || turn || '</h3>' || chr(10) || '<p>It is <strong>' || conv_id || '</strong> &amp; <em>so</em> &lt;b>'
    || chr(10) || 'on.</p>' || chr(10) || '<ul>' || chr(10) || '<li>a <code>*b* &lt;c></code></li>' || chr(10) || '<li><a href="http://y.z/a_b_c">x</a>' || chr(10) || 'more</li>' || chr(10) || '</ul>'
    || chr(10) || '<ol>' || chr(10) || '<li><em>one</em></li>' || chr(10) || '<li>two</li>' || chr(10) || '</ol>' || chr(10) || '<pre><code># not ' || conv_id || chr(10) || chr(10) || '- &lt;no>' || chr(10)
    || '</code></pre>' || array_to_string(list_transform(paragraphs, lambda p: chr(10) || replace(p, '& ', '&amp; ')), '') as line from bodies)
select conv_id, count(*) as n_messages, '<h1>Chat History</h1>' || chr(10) || string_agg(line, chr(10) order by turn) as text from lines group by conv_id"""
ORACLES["transcript_pieces"] = f"""with {MESSAGES},
lines as (select conv_id, row_number() over (partition by conv_id order by turn nulls first) as n, count(*) over (partition by conv_id) as of,
            '<h2>' || {_CAPITAL} || '</h2>' || array_to_string(list_transform(
            list_filter(list_transform(regexp_split_to_array(text, '\\n[ \\t]*\\n'), lambda p: trim(p, ' ')), lambda p: p <> ''),
            lambda p: chr(10) || '<p>' || p || '</p>'), '') as line from messages),
pieces as (select conv_id, n, line || if(n < of, chr(10), '') as text from lines
           union all select distinct conv_id, 0, '<h1>Chat History</h1>' || chr(10) from messages)
select conv_id, coalesce(sum(length(text)) over (partition by conv_id order by n rows between unbounded preceding and 1 preceding), 0)::bigint as start, text
from pieces"""

ORACLES["export_message"] = f"""with {MESSAGES}
select conv_id, turn, '# Chat History' || chr(10) || chr(10) || {_MD_LINE} as text from messages"""

ORACLES["append_messages"] = f"""with {MESSAGES},
last as (select conv_id, max(turn) as t from messages where conv_id >= 0 group by conv_id),
runs as (select * from last cross join (values (0),(1),(2)) as r(run) where run <> 1 or conv_id % 2 = 0)
select conv_id, turn, role, text from messages
union all select conv_id, t + 1 + 2 * run, 'user', 'Generate comprehensive report' from runs
union all select conv_id, t + 2 + 2 * run, 'model', 'rapport ' || run || ' de ' || conv_id from runs"""

# --- pages ----------------------------------------------------------------------------------------------------------


def _unescaped(expr: str) -> str:
    """The references that the pages hold; the ampersand last."""
    held = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&copy;", "©"), ("&middot;", "·"),
            ("&eacute;", "é"), ("&#233;", "é"), ("&#xE9;", "é"), ("&hellip;", "…"), ("&ccedil;", "ç"), ("&amp;", "&")]
    for reference, char in held:
        expr = f"replace({expr}, '{reference}', '{char}')"
    return expr


_STRIPPED = r"""regexp_replace(html, '(?is)<!--.*?-->|<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<nav\b[^>]*>.*?</nav>|<footer\b[^>]*>.*?</footer>|<head\b[^>]*>.*?</head>|<div class="ad big">buy<div>in</div>more</div>|<div class="ad">.*?</div>|<div class=''x ad''>.*?</div>|<[^>]+>', ' ', 'g')"""


def _main_text(html: str) -> str:
    return f"nullif(trim(regexp_replace({_unescaped(_STRIPPED.replace('(html,', f'({html},'))}, '[ \\t\\r\\n]+', ' ', 'g'), ' '), '')"


TEXTS = f"texts as (select page_id, url, {_main_text('html')} as text from captured)"

HREFS = rf"""{CAPTURED}, hrefs as (
  select page_id, url, list_filter(list_transform(
           regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\b[^>]*>.*?</script>', ' ', 'g'), '(?i)<a\s[^>]*>'),
           lambda tag: {_unescaped(r"""case when regexp_matches(tag, '(?i)\shref\s*=\s*"') then regexp_extract(tag, '(?i)\shref\s*=\s*"([^"]*)"', 1)
                            when regexp_matches(tag, '(?i)\shref\s*=\s*''') then regexp_extract(tag, '(?i)\shref\s*=\s*''([^'']*)''', 1)
                            else regexp_extract(tag, '(?i)\shref\s*=\s*([^\s>]+)', 1) end""")}), lambda h: h <> '') as found
  from captured),
links as (select page_id, url, cast(unnest(range(1, len(found) + 1)) as int) as pos, unnest(found) as href from hrefs)"""

ORACLES["captured_pages"] = "select page_id, url, html from pages"
ORACLES["extract_main_text"] = f"with {CAPTURED}, {TEXTS} select page_id, url, text from texts"
# An article holds titles and paragraphs only; what follows it is told here block by block.
ORACLES["main_text_by_blocks"] = f"""with
articles as (select page_id, url, html like '%</html>' as ended,
    regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article>(.*?)(?:</article>|<[^<>]*$|$)', 1), '</?b>', '', 'g'), '<br>', ' ', 'g') as a from pages),
texts as (select page_id, url, list_filter(list_transform(regexp_split_to_array(a, '</?(?:p|h1)>'),
            lambda t: trim(regexp_replace({_unescaped('t')}, '\\s+', ' ', 'g'), ' ')), lambda t: t <> '')
          || if(ended, ['after it come a few words', chr(1), 'alone here', chr(1), 'Last words.', 'two more'], []) as blocks from articles),
rows as (select page_id, cast(unnest(range(len(blocks))) as int) as n, unnest(blocks) as t from texts),
judged as (select *, t <> chr(1) and (len(string_split(t, ' ')) >= 10 or regexp_matches(t, '[.!?…][”»'')]*$')) as long from rows),
kept as (select *, t <> chr(1) and (long or coalesce(lag(long) over w, false) or coalesce(lead(long) over w, false)) as keep from judged window w as (partition by page_id order by n)),
joined as (select page_id, string_agg(t, chr(10) || chr(10) order by n) as text from kept where keep group by page_id)
select t.page_id, t.url, j.text from texts t left join joined j using (page_id)"""
ORACLES["extract_main_text_fallback"] = f"""select page_id, url, case when page_id % 7 = 0 then 'second ' || page_id else {_main_text('html')} end as text
from pages"""
ORACLES["extract_links"] = f"with {HREFS} select page_id, pos, url || href as link from links"
ORACLES["resolve_links"] = rf"""with {HREFS},
parts as (select *, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*:)', 1) as scheme,
                 regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) as origin,
                 split_part(url, '#', 1) as page from links)
select page_id, pos, case
  when regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') then href
  when href like '//%' then scheme || href
  when href = '/a/../b/' then origin || '/b/'
  when href like '/%' then origin || href
  when href like '#%' then page || href
  when href like '?%' then split_part(page, '?', 1) || href
  when href = '../x/./y' then rtrim(regexp_replace(regexp_replace(split_part(page, '?', 1), '[^/]*$', ''), '^(.*//[^/]*(?:/.*)?)/[^/]*/$', '\1'), '/') || '/x/y'
  when split_part(page, '?', 1) = origin then origin || '/' || href
  else regexp_replace(split_part(page, '?', 1), '[^/]*$', '') || href end as link
from parts"""

FRONTIER = "frontier as (select page_id, pos, link from link_plan qualify row_number() over (partition by page_id order by pos) <= 5)"
CRAWLED = """crawled as (select f.page_id, f.pos, f.link, coalesce(t.text, '') as text, t.url is not null as fetched
  from frontier f left join newest n on n.url = f.link left join texts t on t.page_id = n.page_id)"""
ACCUMULATED = """pieces as (select page_id, 0 as pos, coalesce(text, '') as text, 0 as hit from texts
  union all select page_id, pos, text, cast(fetched as int) from crawled),
accumulated as (select page_id, cast(sum(hit) as bigint) as n_fetched, string_agg(text, '' order by pos) as all_text from pieces group by page_id)"""

ORACLES["crawl_frontier"] = f"with {LINK_PLAN}, {FRONTIER} select page_id, pos, link from frontier"
ORACLES["crawl_join"] = f"with {LINK_PLAN}, {TEXTS}, {FRONTIER}, {CRAWLED} select page_id, pos, link, text, fetched from crawled"
ORACLES["pending_links"] = f"""with {LINK_PLAN}
select page_id, pos, link from link_plan l where pos > 5 or not exists (select 1 from captured p where p.url = l.link)"""
ORACLES["crawl_coverage"] = f"""with {LINK_PLAN}
select page_id, count(*) as found, count(*) filter (where pos <= 5) as attempted,
       count(*) filter (where pos <= 5 and link in (select url from captured)) as fetched,
       round(count(*) filter (where pos <= 5) / cast(count(*) as double), 6) as progress
from link_plan group by page_id"""
ORACLES["accumulate_text"] = f"with {LINK_PLAN}, {TEXTS}, {FRONTIER}, {CRAWLED}, {ACCUMULATED} select page_id, n_fetched, all_text from accumulated"
ORACLES["report_context"] = f"""with {LINK_PLAN}, {TEXTS}, {FRONTIER}, {CRAWLED}, {ACCUMULATED},
lists as (select page_id, count(*) as n, string_agg(link, ''', ''' order by pos) as listed from link_plan group by page_id)
select page_id, coalesce(n, 0) + 1 as num_urls,
       all_text || case when n is null then '[]' else '[''' || listed || ''']' end as context
from accumulated left join lists using (page_id)"""
ORACLES["context_pieces"] = f"""with {LINK_PLAN}, {TEXTS}, {FRONTIER}, {CRAWLED},
parts as (select page_id, 0 as kind, 0 as pos, coalesce(text, '') as text from texts
  union all select page_id, 1, pos, text from crawled
  union all select page_id, 2, pos, case when row_number() over w = 1 then '[' else chr(39) || ', ' end || chr(39) || link
      || case when row_number() over w = count(*) over (partition by page_id) then chr(39) || ']' else '' end from link_plan window w as (partition by page_id order by pos)
  union all select page_id, 2, 0, '[]' from texts where page_id not in (select page_id from link_plan)),
placed as (select page_id, coalesce(sum(length(text)) over (partition by page_id order by kind, pos rows between unbounded preceding and 1 preceding), 0)::bigint as start, text from parts)
select * from placed where text <> ''"""
ORACLES["keyed_text_store"] = f"with {CAPTURED}, {TEXTS} select md5(url) || '.txt' as file_name, max(page_id) as page_id, coalesce(arg_max(text, page_id), '') as text from texts group by url"

ORACLES["keyed_text_runs"] = f"""with {CAPTURED}, {TEXTS},
runs as (select url, 1 as version, max(page_id) as page_id, coalesce(arg_max(text, page_id), '') as text from texts group by url
         union all
         select url, 2, max(page_id), 'again' || arg_max(if(text is null, '', ' ' || text), page_id) from texts where page_id % 3 = 0 group by url)
select md5(url) || '.txt' as file_name, page_id, text, version::bigint as version
from runs qualify row_number() over (partition by url order by version desc) = 1"""

# --- reports --------------------------------------------------------------------------------------------------------

_JSON_PART = """case when contains(response, '```json') then
  regexp_replace(regexp_replace(substr(response, strpos(response, '```json') + 7), '^\\s+|\\s+$', '', 'g'), '`+$', '') end"""
SPLIT = f"""split as (select doc_id, response, {_JSON_PART} as js from responses)"""
# Texts after the closing fence leave back-ticks inside the part; json_valid rejects those.
FACTS = """good as (select r.doc_id, r.lang, j from responses r join split s using (doc_id) where json_valid(s.js))"""

ORACLES["split_report"] = f"""with {RESPONSES}, {SPLIT}
select doc_id, case when js is null then response
    else regexp_replace(substr(response, 1, strpos(response, '```json') - 1), '^\\s+|\\s+$', '', 'g') end as summary, js as json_part
from split"""
ORACLES["parse_report_json"] = f"""with {RESPONSES}, {SPLIT},
checked as (select *, js is not null as has_json, coalesce(json_valid(js), false) as ok from split)
select doc_id, has_json, ok,
  case when has_json and not ok then regexp_replace(substr(response, strpos(response, '```json') + 7), '^\\s+|\\s+$', '', 'g') end as raw,
  case when has_json and not ok then 'Failed to parse JSON. Raw output:' end as error,
  case when ok then json_extract_string(js, '$.sujets_principaux[0]') end as first_topic,
  case when ok then json_extract_string(js, '$.insights[0].insight') end as first_insight
from checked"""
ORACLES["report_facts"] = f"""with {RESPONSES}, {SPLIT}, {FACTS}
select doc_id, 'topic' as kind, cast(p as int) as pos, json_extract_string(j, '$.sujets_principaux[' || p || ']') as name,
       cast(null as varchar) as detail, cast(null as varchar) as source
from good cross join (values (0),(1)) as t(p)
union all select doc_id, 'theme', 0, json_extract_string(j, '$."thèmes_clés"[0]."thème"'), json_extract_string(j, '$."thèmes_clés"[0].description'), null from good
union all select doc_id, 'data_point', 0, cast(doc_id as varchar), lang, null from good
union all select doc_id, 'insight', 0, json_extract_string(j, '$.insights[0].insight'), json_extract_string(j, '$.insights[0].explication'), null from good"""
ORACLES["theme_related_topics"] = f"""with {RESPONSES}, {SPLIT}, {FACTS}
select doc_id, 0 as pos, json_extract_string(j, '$."thèmes_clés"[0]."thème"') as theme, cast(p as int) as related_pos,
       json_extract_string(j, '$."thèmes_clés"[0].sujets_connexes[' || p || ']') as topic from good cross join (values (0),(1)) as t(p)"""
ORACLES["report_data_points"] = f"""with {RESPONSES}, {SPLIT}, {FACTS}
select doc_id, 0 as pos, cast(doc_id as varchar) as data_point, lang as context, cast(null as varchar) as source from good"""
ORACLES["quarantined_reports"] = f"""with {RESPONSES}, {SPLIT}
select doc_id, regexp_replace(substr(response, strpos(response, '```json') + 7), '^\\s+|\\s+$', '', 'g') as raw, 'Failed to parse JSON. Raw output:' as error
from split where js is not null and not json_valid(js)"""
ORACLES["topic_counts"] = f"""with {RESPONSES}, {SPLIT}, {FACTS},
topics as (select distinct doc_id, json_extract_string(j, '$.sujets_principaux[' || p || ']') as topic
           from good cross join (values (0),(1)) as t(p))
select topic, count(*) as n_reports from topics group by topic"""

# --- cases ----------------------------------------------------------------------------------------------------------

OUTCOMES = """outcomes as (select *, case when status_code <> 200 then 'An error occurred with IRCC. Form submission failed'
    when status is null then 'no status link on the page' when case_id is null then 'no case id in the status link' end as error from status_pages)"""
ORACLES["case_status_extract"] = f"with {STATUS_PAGES} select case_key, status, case_id from status_pages"
ORACLES["case_history"] = f"""with {STATUS_PAGES}
select case_key, cast(unnest(range(len(items))) as int) as pos, unnest(items) as item from status_pages"""
ORACLES["case_status"] = f"""with {STATUS_PAGES}, {OUTCOMES}
select case_key, status_code, coalesce(error, status) as status, case when error is null then case_id end as case_id,
       case when error is null then array_to_string(list_transform(items, lambda i: coalesce(i, '<null>')), '~') else '' end as detail, error from outcomes"""
ORACLES["error_capture"] = f"""with {STATUS_PAGES}, {OUTCOMES}
select case_key, status_code, error from outcomes where error is not null"""

# --- uploads --------------------------------------------------------------------------------------------------------

UPLOADS = """uploads as (
  select doc_id, 'f' || doc_id || '.' || case doc_id % 3 when 0 then 'pdf' when 1 then 'csv' else 'txt' end as name, text as content
  from documents),
ingested as (select doc_id, name, md5(content) as md5, split_part(name, '.', -1) as ext from uploads)"""
ORACLES["upload_ingest"] = f"with {UPLOADS} select doc_id, name, md5, ext, md5 || '.' || ext as stored_name from ingested"
ORACLES["content_dedup"] = f"with {UPLOADS} select md5, ext, min(doc_id) as doc_id, count(*) as copies from ingested group by md5, ext"
ORACLES["incremental_ingest"] = f"with {UPLOADS} select md5, ext, count(*) as copies from ingested group by md5, ext"
ORACLES["emit_once"] = f"with {UPLOADS} select distinct md5, ext, md5 || '.' || ext as stored_name from ingested"
ORACLES["upload_texts"] = f"""with {UPLOADS},
t as (select doc_id, name, content, length(content) || ', chars' as note, greatest(4, length(cast(doc_id + 1 as varchar))) as w from uploads)
select doc_id, name, case doc_id % 3 when 0 then array_to_string(string_split(content, chr(10)), chr(10) || chr(10)) when 1 then
    '|    | ' || lpad('id', w::int, ' ') || ' | name            | ' || rpad('the, note', greatest(11, length(note))::int, ' ') || ' |' || chr(10)
    || '|---:|' || repeat('-', w + 1) || ':|:----------------|:' || repeat('-', greatest(11, length(note)) + 1) || '|' || chr(10)
    || '|  0 | ' || lpad(cast(doc_id as varchar), w::int, ' ') || ' | a "quoted" word | ' || rpad('x', greatest(11, length(note))::int, ' ') || ' |' || chr(10)
    || '|  1 | ' || lpad(cast(doc_id + 1 as varchar), w::int, ' ') || ' | two' || chr(10) || 'lines       | ' || rpad(note, greatest(11, length(note))::int, ' ') || ' |' || chr(10)
    || '|  2 | ' || lpad('7', w::int, ' ') || ' | short           | ' || rpad('', greatest(11, length(note))::int, ' ') || ' |' end as text
from t"""
ORACLES["route_by_format"] = f"""with {UPLOADS}
select doc_id, name, case ext when 'pdf' then 'text' when 'csv' then 'table' end as route from ingested"""

# --- tables ---------------------------------------------------------------------------------------------------------

ORACLES["table_to_markdown"] = """with
cells as (select p_partkey, cast(p_partkey as varchar) as c0, p_name as c1, p_brand as c2, cast(p_size as varchar) as c3 from part),
w as (select cast(greatest(2, max(length(c0))) as int) as w0, cast(greatest(8, max(length(c1))) as int) as w1,
             cast(greatest(9, max(length(c2))) as int) as w2, cast(greatest(8, max(length(c3))) as int) as w3 from cells)
select cast(0 as bigint) as line_no, '| ' || lpad('', w0, ' ') || ' | ' || rpad('p_name', w1, ' ') || ' | ' || rpad('p_brand', w2, ' ')
       || ' | ' || lpad('p_size', w3, ' ') || ' |' as line from w
union all
select 1, '|' || repeat('-', w0 + 1) || ':|:' || repeat('-', w1 + 1) || '|:' || repeat('-', w2 + 1) || '|' || repeat('-', w3 + 1) || ':|' from w
union all
select p_partkey + 2, '| ' || lpad(c0, w0, ' ') || ' | ' || rpad(c1, w1, ' ') || ' | ' || rpad(c2, w2, ' ') || ' | ' || lpad(c3, w3, ' ') || ' |'
from cells cross join w"""
ORACLES["csv_to_markdown"] = """with
rows as (select *, row_number() over (order by p_partkey) - 1 as n from part),
cells as (select n, cast(n as varchar) as c0, cast(p_partkey as varchar) as c1, p_name as c2, p_brand as c3, cast(p_size as varchar) as c4 from rows),
w as (select cast(greatest(2, max(length(c0))) as int) as w0, cast(greatest(11, max(length(c1))) as int) as w1, cast(greatest(8, max(length(c2))) as int) as w2,
             cast(greatest(9, max(length(c3))) as int) as w3, cast(greatest(8, max(length(c4))) as int) as w4 from cells)
select cast(0 as bigint) as line_no, '| ' || lpad('', w0, ' ') || ' | ' || lpad('p_partkey', w1, ' ') || ' | ' || rpad('p_name', w2, ' ')
       || ' | ' || rpad('p_brand', w3, ' ') || ' | ' || lpad('p_size', w4, ' ') || ' |' as line from w
union all
select 1, '|' || repeat('-', w0 + 1) || ':|' || repeat('-', w1 + 1) || ':|:' || repeat('-', w2 + 1) || '|:' || repeat('-', w3 + 1)
       || '|' || repeat('-', w4 + 1) || ':|' from w
union all
select n + 2, '| ' || lpad(c0, w0, ' ') || ' | ' || lpad(c1, w1, ' ') || ' | ' || rpad(c2, w2, ' ') || ' | ' || rpad(c3, w3, ' ')
       || ' | ' || lpad(c4, w4, ' ') || ' |' from cells cross join w"""
ORACLES["csv_export"] = "select doc_id, nullif(lang, 'de') as lang, text from documents"
ORACLES["csv_export_numbered"] = f"with {CELL_ROWS} select row_no, cells[1] as c0, cells[2] as c1, cells[3] as c2 from cell_rows"
ORACLES["csv_scan"] = "select p_partkey, p_name, p_brand, p_size from part"

_TABLE_ID = "p_brand || '/' || (p_partkey // 1000)"
ORACLES["detect_delimiter"] = f"""select distinct {_TABLE_ID} as table_id,
  case cast(substr(p_brand, 7) as int) % 3 when 0 then '|' when 1 then chr(9) else ',' end as delimiter from part"""
NUMBERED = f"""numbered as (select {_TABLE_ID} as table_id, p_partkey, p_name, p_size,
  cast(row_number() over (partition by {_TABLE_ID} order by p_partkey) - 1 as int) as row_no from part)"""
ORACLES["parse_table_text"] = f"""with {NUMBERED},
heads as (select distinct table_id from numbered)
select table_id, 0 as row_no, col_no, value from heads cross join (values (0,'p_partkey'),(1,'p_name'),(2,'p_size')) as h(col_no, value)
union all select table_id, row_no + 1, 0, cast(p_partkey as varchar) from numbered
union all select table_id, row_no + 1, 1, p_name from numbered
union all select table_id, row_no + 1, 2, cast(p_size as varchar) from numbered
union all select table_id, row_no + 1, 3, 'more' from numbered where p_partkey % 11 = 3"""
ORACLES["construct_table"] = f"""with {NUMBERED}, fitting as (select * from numbered where p_partkey % 11 <> 3)
select table_id, row_no, 0 as col_no, 'p_partkey' as col_name, cast(p_partkey as varchar) as value from fitting
union all select table_id, row_no, 1, 'p_name', p_name from fitting
union all select table_id, row_no, 2, 'p_size', cast(p_size as varchar) from fitting"""
ORACLES["tables_to_markdown"] = f"""with {NUMBERED}, fitting as (select * from numbered where p_partkey % 11 <> 3),
w as (select table_id, greatest(2, max(length(cast(row_no as varchar)))) as w0, greatest(11, max(length(cast(p_partkey as varchar)))) as w1,
             greatest(8, max(length(p_name))) as w2, greatest(8, max(length(cast(p_size as varchar)))) as w3 from fitting group by table_id)
select table_id, cast(0 as bigint) as line_no, '| ' || repeat(' ', w0) || ' | ' || rpad('p_partkey', w1::int, ' ') || ' | ' || rpad('p_name', w2::int, ' ') || ' | ' || rpad('p_size', w3::int, ' ') || ' |' as line from w
union all select table_id, 1, '|' || repeat('-', w0 + 1) || ':|:' || repeat('-', w1 + 1) || '|:' || repeat('-', w2 + 1) || '|:' || repeat('-', w3 + 1) || '|' from w
union all select table_id, row_no + 2, '| ' || lpad(cast(row_no as varchar), w0::int, ' ') || ' | ' || rpad(cast(p_partkey as varchar), w1::int, ' ') || ' | '
  || rpad(p_name, w2::int, ' ') || ' | ' || rpad(cast(p_size as varchar), w3::int, ' ') || ' |' from fitting join w using (table_id)"""
MIXED = f"""{NUMBERED},
kinds as (select *, ascii(right(split_part(table_id, '/', 1), 1)) % 3 as kind from numbered),
named as (select *, case kind when 0 then ['p_partkey', 'p_name', 'p_size'] when 1 then ['p_partkey', 'x', 'x.1'] else ['a', 'a.1', 'a.1#2'] end as names,
                 case kind when 0 then ['p_partkey', 'p_name', 'p_size'] when 1 then ['p_partkey', 'x', 'x'] else ['a', 'a', 'a.1'] end as head from kinds)"""
ORACLES["table_records"] = f"""with {MIXED}
select table_id, row_no, names[1] || '=' || p_partkey || '~' || names[2] || '=' || p_name || '~' || names[3] || '=' || p_size as record from named where p_partkey % 11 <> 3"""
ORACLES["table_schemas"] = f"""with {MIXED}, one as (select distinct table_id, names, head from named)
select table_id, cast(i as int) as col_no, names[i + 1] as col_name, head[i + 1] as header from one, (select unnest(range(3)) as i)"""
ORACLES["typed_columns"] = f"""with {MIXED}
select table_id, row_no, if(kind <> 2, p_partkey, null) as p_partkey, cast(if(kind = 0, p_size, null) as int) as p_size,
       if(kind = 1, p_name, null) as x, cast(if(kind = 2, p_size, null) as int) as a_1_2 from named where p_partkey % 11 <> 3"""
ORACLES["wide_table"] = f"""select {_TABLE_ID} as table_id, cast(p_partkey as varchar) as part_key, p_name as name, cast(p_size as varchar) as size
from part where p_partkey % 11 <> 3"""
ORACLES["overlong_rows"] = f"""with {NUMBERED}
select table_id, row_no, p_partkey || '~' || p_name || '~' || p_size || '~more' as cells, 'row has 4 cells, header has 3' as error
from numbered where p_partkey % 11 = 3"""
ORACLES["preview"] = f"""{ORACLES["wide_table"]} order by {_TABLE_ID}, p_partkey limit 5"""
_SHOWN = "array_to_string(list_transform(cells, lambda c: replace(coalesce(c, 'None'), chr(10), ' ')), '|')"
ORACLES["render_table_rows"] = f"""with {CELL_ROWS}
select doc_id, page_no, row_no as table_no, '|' || {_SHOWN} || '|' || chr(10) || '|n' || row_no || '|a b|' as text from cell_rows"""
ORACLES["map_string_columns"] = f"""with {CELL_ROWS}
select row_no, reverse(cells[1]) || '*' as c0, reverse(cells[2]) || '*' as c1, reverse(cells[3]) || '*' as c2 from cell_rows"""

# --- page layout ----------------------------------------------------------------------------------------------------

ORACLES["select_pages"] = f"with {CELL_ROWS} select doc_id, page_no, row_no from cell_rows where page_no in (1, 2)"
ORACLES["collect_tables"] = f"""with {CELL_ROWS}
select doc_id, page_no, row_no as table_no, cast(0 as int) as row_no,
       array_to_string(list_transform(cells, lambda c: coalesce(c, '<null>')), '~') as cells from cell_rows where page_no between 1 and 4
union all
select doc_id, page_no, row_no, 1, 'n' || row_no || '~a' || chr(10) || 'b' from cell_rows where page_no between 1 and 4"""
ORACLES["normalize_line_text"] = """select doc_id, trim(regexp_replace(text, '[\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\p{Z}]+', ' ', 'g'), ' ') as text from documents"""
ORACLES["page_reading_order"] = f"""with {ELEMENTS}
select doc_id, page_no, elem_no, row_number() over (partition by doc_id, page_no order by y1 desc nulls last, elem_no) as reading_order from elements"""

# Two tables per page with lower edges at 900 and 700: the walk in closed form.
SPANS = """ord as (select *, row_number() over w as pos, lead(elem_type) over w as nxt from elements
                window w as (partition by doc_id, page_no order by y1 desc nulls last, elem_no)),
in0 as (select doc_id, page_no, min(pos) as p, min(text) as a, max(text) as b from ord where elem_type = 'R' and (doc_id + page_no) % 13 <> 4 group by 1, 2),
out0 as (select o.doc_id, o.page_no, min(o.pos) as p from ord o join in0 i using (doc_id, page_no)
         where o.elem_type = 'R' and coalesce(o.nxt, '') <> 'R' and o.pos >= i.p and o.y0 < 900 group by 1, 2),
in1 as (select o.doc_id, o.page_no, min(o.pos) as p from ord o join out0 x using (doc_id, page_no)
        where o.elem_type = 'R' and o.pos > x.p group by 1, 2),
out1 as (select o.doc_id, o.page_no, min(o.pos) as p from ord o join in1 i using (doc_id, page_no)
         where o.elem_type = 'R' and coalesce(o.nxt, '') <> 'R' and o.pos >= i.p and o.y0 < 700 group by 1, 2),
tbl as (select i.doc_id, i.page_no, i.p as i0, coalesce(x.p, 1e18) as o0, j.p as i1, coalesce(y.p, 1e18) as o1, a, b
        from in0 i left join out0 x using (doc_id, page_no) left join in1 j using (doc_id, page_no) left join out1 y using (doc_id, page_no)),
shown as (
  select o.doc_id, o.page_no, o.pos, regexp_replace(o.text, ' +', ' ', 'g') as piece from ord o left join tbl t using (doc_id, page_no)
  where o.elem_type = 'T' and (t.i0 is null or not (o.pos > t.i0 and o.pos <= t.o0)) and (t.i1 is null or not (o.pos > t.i1 and o.pos <= t.o1))
  union all select doc_id, page_no, i0, '|' || regexp_replace(a, ' +', '  ') || '|None|' from tbl
  union all select doc_id, page_no, i1, '|' || b || '|x y|' || chr(10) || '|z|' from tbl where i1 is not null)"""
CONTENTS = """contents as (select b.doc_id, b.page_no, regexp_replace(coalesce(string_agg(piece, '' order by pos), ''), '\\n+', chr(10), 'g') as content,
    case when not boxed then 'no page box' end as error from boxes b left join shown using (doc_id, page_no) group by b.doc_id, b.page_no, boxed)"""
ORACLES["page_pieces"] = f"with {ELEMENTS}, {SPANS} select doc_id, page_no, pos, piece from shown"
ORACLES["assemble_page"] = f"with {ELEMENTS}, {SPANS}, {CONTENTS} select doc_id, page_no, content, error from contents"
ORACLES["assemble_page_text_only"] = f"""with {ELEMENTS}
select b.doc_id, b.page_no, coalesce(string_agg(regexp_replace(text, ' +', ' ', 'g'), '' order by y1 desc nulls last, elem_no)
    filter (where elem_type = 'T'), '') as content, case when not boxed then 'no page box' end as error
from boxes b left join elements using (doc_id, page_no) group by b.doc_id, b.page_no, boxed"""
ORACLES["assemble_document"] = f"""with {ELEMENTS}, {SPANS}, {CONTENTS}
select doc_id, count(*) as n_pages, string_agg(content, chr(10) order by page_no) as text from contents group by doc_id"""

ORACLES["document_pieces"] = f"""with {ELEMENTS}, {SPANS}, {CONTENTS},
led as (select doc_id, page_no, case when row_number() over (partition by doc_id order by page_no) > 1 then chr(10) else '' end || content as text from contents)
select doc_id, coalesce(sum(length(text)) over (partition by doc_id order by page_no rows between unbounded preceding and 1 preceding), 0)::bigint as start, text from led"""

# --- intake ---------------------------------------------------------------------------------------------------------

CHECKED = f"""checked as (select *, array_to_string([r for r in [
    case when coalesce(nom, '') = '' then 'nom: missing' end,
    case when coalesce(email, '') = '' then 'email: missing' when not regexp_matches(email, {EMAIL}) then 'email: malformed' end,
    case when coalesce(sujet not in ('evaluation', 'information', 'rendez-vous', 'autre'), true) then 'sujet: unknown' end,
    case when coalesce(message, '') = '' then 'message: missing' end] if r is not null], '; ') as reasons from submissions)"""
ORACLES["validate_submissions"] = f"with {SUBMISSIONS}, {CHECKED} select sub_id, reasons = '' as valid, reasons from checked"
ORACLES["rejected_submissions"] = f"with {SUBMISSIONS}, {CHECKED} select sub_id, reasons from checked where reasons <> ''"
ORACLES["accepted_submissions"] = f"""with {SUBMISSIONS}, {CHECKED}
select sub_id, '{{"nom":"' || nom || '","email":"' || email || '","telephone":"","sujet":"' || sujet || '","message":"' || message || '"}}' as payload
from checked where reasons = ''"""
