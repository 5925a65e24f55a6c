"""Reference queries with two texts: Spark's, and one for DuckDB that is written apart, so that one checks the other.

Ranked cuts are limits or keyed windows; totals come from partial aggregates; containment of texts starts from equal pieces
of them, never from a nested loop over two tables.
"""

from ..functions import text as T
from .dialect import DUCK, SPARK

PAIRS: dict[str, tuple[str, str]] = {}


def pair(duck: str):
    """Registers the Spark text that the function returns beside DuckDB's."""

    def add(f):
        PAIRS[f.__name__] = (f(), duck)
        DOCS[f.__name__] = f.__doc__
        return f

    return add


DOCS: dict[str, str] = {}

# Wording of gaps and of the gap prompt, the route of papers without one, the year staleness is counted from.
UNNAMED = "未分类"
NOW = 2026
NO_MAP = "第一轮 — 尚无覆盖信息，需要广覆盖探索。"
NO_GAPS = "各路线覆盖较均衡，主要缺口是探索未出现的新路线。"
ASK = "。请生成填补以上缺口的查询。"

COVERAGE = f"""select coalesce(nullif(route, ''), nullif(category, ''), '{UNNAMED}') as route, count(*) as paper_count, max(case when year <> 0 then year end) as latest_year, min(paper_id) as first_paper,
  bool_or(evidence_type = 'review') as has_review, bool_or(evidence_type = 'original_experiment') as has_original, bool_or(has_limitation) as has_counter_example from scored group by 1"""

#: DuckDB's own way to the same table.
D_COVERAGE = f"""select r as route, count(*) as paper_count, max(year) filter (year <> 0) as latest_year, min(paper_id) as first_paper, max(cast(evidence_type = 'review' as int)) = 1 as has_review,
  max(cast(evidence_type = 'original_experiment' as int)) = 1 as has_original, sum(cast(has_limitation as int)) > 0 as has_counter_example
from (select *, case when route is not null and route <> '' then route when category is not null and category <> '' then category else '{UNNAMED}' end as r from scored) group by r"""


@pair(f"select route, paper_count, latest_year, has_review, has_original, has_counter_example from ({D_COVERAGE})")
def coverage_map():
    """A1: papers, latest year and kinds of evidence of every route; a limitation is a counter-example."""
    return f"select route, paper_count, latest_year, has_review, has_original, has_counter_example from ({COVERAGE})"


@pair(f"""with c as ({D_COVERAGE})
select route, route || '（仅 ' || paper_count || ' 篇）' as gap from c where paper_count <= 1
union all select route, route || '（缺综述）' from c where paper_count >= 3 and not has_review
union all select route, route || '（缺反例/限制）' from c where paper_count >= 3 and has_review and not has_counter_example
union all select route, route || '（最新仅 ' || latest_year || ' 年）' from c where latest_year < {NOW} - 3""")
def coverage_gaps():
    """Thin, else unreviewed, else uncontested routes; a route can be stale besides."""
    return f"""select route, explode(filter(array(
  case when paper_count <= 1 then concat(route, '（仅 ', paper_count, ' 篇）') when not has_review and paper_count >= 3 then concat(route, '（缺综述）') when not has_counter_example and paper_count >= 3 then concat(route, '（缺反例/限制）') end,
  case when {NOW} - latest_year > 3 then concat(route, '（最新仅 ', latest_year, ' 年）') end), x -> x is not null)) as gap from ({COVERAGE})"""


D_LINES = f"""with c as ({D_COVERAGE}), s as (
  select route, paper_count, first_paper, 1 as k, '仅' || paper_count || '篇' as status from c where paper_count <= 1
  union all select route, paper_count, first_paper, 2, '缺综述' from c where paper_count >= 3 and not has_review
  union all select route, paper_count, first_paper, 3, '缺反例' from c where paper_count >= 3 and not has_counter_example
  union all select route, paper_count, first_paper, 4, '最新' || latest_year || '年' from c where latest_year < {NOW} - 3),
l as (select route, paper_count, first_paper, route || '：' || string_agg(status, '、' order by k) as line from s group by route, paper_count, first_paper)"""

LINES = f"""with c as ({COVERAGE}), l as (select route, paper_count, first_paper, filter(array(
  case when paper_count <= 1 then concat('仅', paper_count, '篇') end, case when not has_review and paper_count >= 3 then '缺综述' end,
  case when not has_counter_example and paper_count >= 3 then '缺反例' end, case when {NOW} - latest_year > 3 then concat('最新', latest_year, '年') end), x -> x is not null) as status from c)"""


@pair(f"{D_LINES} select route, paper_count, line from l")
def gap_lines():
    """Every condition that holds for a route."""
    return f"{LINES} select route, paper_count, concat(route, '：', array_join(status, '、')) as line from l where size(status) > 0"


@pair(f"{D_LINES} select case when (select count(*) from c) = 0 then '{NO_MAP}' when count(*) = 0 then '{NO_GAPS}' else string_agg(line, '；' order by paper_count, first_paper) || '{ASK}' end as prompt from l")
def gap_text():
    """The text for the next round, thin routes first, routes of equal size in order of their first paper."""
    return f"""{LINES}, p as (select count(*) as routes, transform(array_sort(collect_list(case when size(status) > 0 then struct(paper_count, first_paper, concat(route, '：', array_join(status, '、')) as line) end)), x -> x.line) as lines from l)
select case when routes = 0 then '{NO_MAP}' when size(lines) = 0 then '{NO_GAPS}' else concat(array_join(lines, '；'), '{ASK}') end as prompt from p"""


@pair(f"select cast(row_number() over (order by paper_count desc, first_paper) as int) as place, route, '  ' || route || ': ' || paper_count || '篇 (最新' || coalesce(cast(latest_year as varchar), 'None') || ', 综述=' || case when has_review then 'True' else 'False' end || ', 反例=' || case when has_counter_example then 'True' else 'False' end || ')' as line from ({D_COVERAGE})")
def coverage_summary():
    """Routes by papers, most first, as lines of a report."""
    return f"""select cast(row_number() over (order by paper_count desc, first_paper) as int) as place, route,
  concat('  ', route, ': ', paper_count, '篇 (最新', coalesce(cast(latest_year as string), 'None'), ', 综述=', initcap(has_review), ', 反例=', initcap(has_counter_example), ')') as line from ({COVERAGE})"""


ROUTES_IN = " ".join(f"when {i} then '{r}'" for i, r in enumerate(T.ROUTE_KEYWORDS))


def _covered(name: str, text: str) -> str:
    """For each route whether some text holds a key word of it: one aggregate, no join."""
    hits = ", ".join(f"max({' or '.join(f'contains(lower({text}), {chr(39)}{w}{chr(39)})' for w in words)}) as r{i}" for i, words in enumerate(T.ROUTE_KEYWORDS.values()))
    return f"select {'run, ' if name else ''}{hits} from manifest{' group by run' if name else ''}"


D_KEYS = "(values " + ", ".join(f"('{r}', '{w}')" for r, words in T.ROUTE_KEYWORDS.items() for w in words) + ") k(route, word)"
STACK = f"stack({len(T.ROUTE_KEYWORDS)}, " + ", ".join(f"'{r}', r{i}" for i, r in enumerate(T.ROUTE_KEYWORDS)) + ")"


@pair(f"select route, count(*) filter (contains(lower(query), word)) > 0 as covered from {D_KEYS}, manifest group by route union all select 'unknown', false")
def route_keyword_cover():
    """whether any query holds a key word of each route; an unknown route is not covered."""
    return f"select {STACK} as (route, covered) from ({_covered('', 'query')}) union all select 'unknown', false"


D_RUNS = f"(select distinct run, route from manifest, {D_KEYS} where contains(lower(query), word))"


@pair(f"""with r as {D_RUNS}, n as (select count(distinct run) as n from manifest), c as (select route, count(*) as runs from r group by route)
select route, runs, runs = n as in_all, count(*) filter (runs = n) over () as common, count(*) over () as reached, count(*) filter (runs = n) over () >= 4 as stable from c, n""")
def run_stability():
    """In how many runs each route has a query; runs are stable if four routes or more have one in all of them."""
    return f"""with r as (select run, {STACK} as (route, covered) from ({_covered('run', 'query')})), c as (select route, count_if(covered) as runs, count(*) as n from r group by route having count_if(covered) > 0)
select route, runs, runs = n as in_all, count_if(runs = n) over () as common, count(*) over () as reached, count_if(runs = n) over () >= 4 as stable from c"""


D_FAMILY = "(select lower(r_name) as family, lower(n_name) as route from nation join region on r_regionkey = n_regionkey union select lower(r_name), lower(r_name) from region)"


@pair(f"""with raw as (select distinct c_custkey % 5 as run, case when c_custkey % 5 = 4 and n_regionkey = 2 then 'unheard of' else n_name end as route from customer join nation on n_nationkey = c_nationkey),
c as (select family, count(distinct run) as runs from raw join {D_FAMILY} f on f.route = lower(raw.route) group by family)
select family, runs, runs = 5 as backbone, sum(cast(runs = 5 as int)) over () >= 4 as stable from c""")
def family_backbone():
    """Runs whose raw routes reach each family; four families or more in every run are a stable backbone."""
    return """with m as (select distinct lower(r_name) as family, explode(array(lower(n_name), lower(r_name))) as route from nation join region on r_regionkey = n_regionkey),
raw as (select distinct c_custkey % 5 as run, if(c_custkey % 5 = 4 and n_regionkey = 2, 'unheard of', lower(n_name)) as route from customer join nation on n_nationkey = c_nationkey),
c as (select family, count(distinct run) as runs from raw join m on m.route = raw.route group by family)
select family, runs, runs = 5 as backbone, count_if(runs = 5) over () >= 4 as stable from c"""


@pair(f"""with r as {D_RUNS}, a as (select route from r where run = 2), b as (select route from r where run = 3)
select 'both' as kind, route from a where route in (select route from b) union all select 'either', route from (select route from a union select route from b) union all select 'first', route from a where route not in (select route from b)""")
def route_sets():
    """Routes that two runs share, that either has, that only the first has."""
    return f"""with r as (select run, {STACK} as (route, covered) from ({_covered('run', 'query')})), s as (select route, max(covered and run = 2) as a, max(covered and run = 3) as b from r group by route)
select explode(filter(array(case when a and b then 'both' end, case when a or b then 'either' end, case when a and not b then 'first' end), x -> x is not null)) as kind, route from s"""


# ---- query strings ---------------------------------------------------------------------------------------------

D_WORD = "case when contains(trim({0}, '\"'''), ' ') or contains(trim({0}, '\"'''), '-') then '\"' || trim({0}, '\"''') || '\"' else trim({0}, '\"''') end"
D_ROUTE = D_WORD.format("trim(route)")


@pair(f"""with r as (select distinct p_type as route from part), q as (select route, k, 'TITLE-ABS-KEY(' || {D_ROUTE} || ') AND TITLE-ABS-KEY(' || w || ')' as query
  from r, (values (1, 'shrinkage'), (2, '"curing stress"'), (3, 'shrinkage')) v(k, w) where k = 1 or (length(route) % 2 = 0) = (k = 2))
select distinct route, query from q""")
def coverage_query_builder():
    """Each route with the first target property and with the first failure problem, unless that repeats a query."""
    term = lambda x: f"case when regexp_like({x}, '[ -]') then concat('\"', {x}, '\"') else {x} end"
    bare = "regexp_replace(route, '^[ \"\\']+|[ \"\\']+$', '')".replace("\\'", "\\'")
    return f"""with r as (select distinct p_type as route, if(length(p_type) % 2 = 0, 'curing stress', 'shrinkage') as problem from part), t as (select route, {term(bare)} as term, {term("problem")} as problem from r)
select route, explode(array_distinct(array(concat('TITLE-ABS-KEY(', term, ') AND TITLE-ABS-KEY(shrinkage)'), concat('TITLE-ABS-KEY(', term, ') AND TITLE-ABS-KEY(', problem, ')')))) as query from t"""


#: Intents: keywords with synonyms, phrases, exclusions and limits; lists may be empty, scalars null.
INTENTS = """select p_partkey as id, array(split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)) as keywords, map(split_part(p_name, ' ', 1), array(lower(p_brand), 'light-curing')) as synonyms,
  case p_size % 4 when 0 then array() when 1 then array('degree of conversion') when 2 then array('a W/2 b', lower(p_type)) else array('x', 'gel point', 'c PRE/1 d') end as must_include,
  if(p_size % 3 = 0, array(p_brand, 'dental coating'), array()) as exclude, if(p_size % 7 = 0, 'Lee', null) as author, if(p_size % 5 = 0, 'MIT', null) as affiliation,
  if(p_size % 2 = 0, 1990 + p_size, null) as year_from, if(p_size % 5 <> 0, 2030 - p_size, null) as year_to, case p_size % 3 when 0 then 'ar' when 1 then 're' end as document_type,
  if(p_size % 6 = 1, array('MATE', 'CHEM'), array()) as subject_area, if(p_size % 8 = 0, '', 'english') as language from part"""


def compiled(must="must_include", exclude="exclude", people=True) -> str:
    """X1 to X3 as an expression over an intent's columns; `people` keeps author and affiliation."""
    wrap = lambda x: f"if(regexp_like(trim(both '\"\\'' from trim({x})), '[ -]'), concat('\"', trim(both '\"\\'' from trim({x})), '\"'), trim(both '\"\\'' from trim({x})))"
    group = f"transform(keywords, k -> case when synonyms[k] is null or size(synonyms[k]) = 0 then {wrap('k')} else concat('(', array_join(concat(array({wrap('k')}), transform(synonyms[k], s -> {wrap('s')})), ' OR '), ')') end)"
    tokens = "array_join(transform(filter(split(p, '[ \\t\\n]+'), w -> w <> ''), w -> trim(both '\"\\'' from w)), ' PRE/0 ')"
    phrases = f"transform({must}, p -> case when contains(p, ' PRE/') or contains(p, ' W/') then p when contains(p, ' ') then {tokens} else {wrap('p')} end)"
    main = f"array_join(concat({group}, {phrases}), ' AND ')"
    body = f"case when {main} = '' then null when size({exclude}) > 0 then concat('TITLE-ABS-KEY((', {main}, ') AND NOT (', array_join(transform({exclude}, e -> {wrap('e')}), ' OR '), '))') else concat('TITLE-ABS-KEY(', {main}, ')') end"
    who = "case when author <> '' then concat('AUTH(', author, ')') end, case when affiliation <> '' then concat('AFFIL(', affiliation, ')') end, " if people else ""
    return f"""concat_ws(' AND ', {body}, {who}case when coalesce(year_from, 0) <> 0 then concat('PUBYEAR > ', year_from - 1) end, case when coalesce(year_to, 0) <> 0 then concat('PUBYEAR < ', year_to + 1) end,
  case when document_type <> '' then concat('DOCTYPE(', document_type, ')') end, case when size(subject_area) > 0 then concat('SUBJAREA(', array_join(subject_area, ' OR '), ')') end, case when language <> '' then concat('LANGUAGE(', language, ')') end)"""


#: The same strings put together from the columns of part, without lists.
D_FIRST = "'((' || split_part(p_name, ' ', 1) || ' OR ' || case when contains(p_brand, ' ') or contains(p_brand, '-') then '\"' || lower(p_brand) || '\"' else lower(p_brand) end || ' OR \"light-curing\") AND ' || split_part(p_name, ' ', 2)"
D_SAME = "split_part(p_name, ' ', 1) = split_part(p_name, ' ', 2)"
D_TYPE = "case when contains(p_type, ' ') then replace(lower(p_type), ' ', ' PRE/0 ') when contains(p_type, '-') then '\"' || lower(p_type) || '\"' else lower(p_type) end"


def _duck_compiled(must: bool, exclude: bool, people: bool) -> str:
    group = "case when contains(p_brand, ' ') or contains(p_brand, '-') then '\"' || lower(p_brand) || '\"' else lower(p_brand) end"
    one = f"'(' || split_part(p_name, ' ', 1) || ' OR ' || {group} || ' OR \"light-curing\")'"
    two = f"case when {D_SAME} then {one} else split_part(p_name, ' ', 2) end"
    tail = "'x AND gel PRE/0 point'" + ("" if must else " || ' AND c PRE/1 d'")
    phrases = f"case p_size % 4 when 0 then '' when 1 then ' AND degree PRE/0 of PRE/0 conversion' when 2 then ' AND a W/2 b AND ' || {D_TYPE} else ' AND ' || {tail} end"
    main = f"({one} || ' AND ' || {two} || {phrases})"
    brand = D_WORD.format("p_brand")
    body = f"case when p_size % 3 = 0 then '(' || {main} || ') AND NOT (' || {brand} || ' OR \"dental coating\")' else {main} end" if exclude else main
    who = "|| case when p_size % 7 = 0 then ' AND AUTH(Lee)' else '' end || case when p_size % 5 = 0 then ' AND AFFIL(MIT)' else '' end" if people else ""
    return f"""'TITLE-ABS-KEY(' || {body} || ')' {who} || case when p_size % 2 = 0 then ' AND PUBYEAR > ' || (1989 + p_size) else '' end || case when p_size % 5 <> 0 then ' AND PUBYEAR < ' || (2031 - p_size) else '' end
  || case p_size % 3 when 0 then ' AND DOCTYPE(ar)' when 1 then ' AND DOCTYPE(re)' else '' end || case when p_size % 6 = 1 then ' AND SUBJAREA(MATE OR CHEM)' else '' end || {{}}"""


D_LANGUAGE = "case when p_size % 8 = 0 then '' else ' AND LANGUAGE(english)' end"


@pair(f"select p_partkey as id, {_duck_compiled(False, True, True).format(D_LANGUAGE)} as query from part")
def compile_intent():
    """The query string of each intent."""
    return f"select id, {compiled()} as query from ({INTENTS})"


@pair(f"""select distinct id, query from (select p_partkey as id, {_duck_compiled(False, True, True).format(D_LANGUAGE)} as query from part
  union all select p_partkey, {_duck_compiled(True, False, False).format("' AND LANGUAGE(english)'")} from part where p_size % 4 <> 0
  union all select p_partkey, {_duck_compiled(False, False, False).format("' AND LANGUAGE(english)'")} from part where p_size % 3 = 0)""")
def compile_multi():
    """The full query; with phrases, one of their first two without exclusions; with exclusions, one without them.
    The two others know no author or affiliation and are in English."""
    return f"""select id, explode(array_distinct(array_compact(array({compiled()}, case when size(must_include) > 0 then {compiled("slice(must_include, 1, 2)", "array()", False).replace("language <> ''", "true").replace("'LANGUAGE(', language, ')'", "'LANGUAGE(english)'")} end,
  case when size(exclude) > 0 then {compiled("must_include", "array()", False).replace("language <> ''", "true").replace("'LANGUAGE(', language, ')'", "'LANGUAGE(english)'")} end)))) as query from ({INTENTS})"""


TEXTS = "select p_partkey as id, concat(replace(p_name, ' ', ', '), ',', p_brand) as keywords, case when p_size % 3 = 0 then '' else concat(split_part(p_name, ' ', 1), ':', p_type, ',x|', p_brand, ': y ') end as synonyms, case p_size % 3 when 0 then '1999' when 1 then '2001,2020' else concat(cast(1990 + p_size as varchar(20)), ', 2020,1') end as years from part"


@pair(f"""with t as ({TEXTS}), s as (select id, unnest(string_split(synonyms, '|')) as entry from t where synonyms <> ''),
g as (select id, list(trim(split_part(entry, ':', 1)) || '=' || array_to_string(list_transform(string_split(split_part(entry, ':', 2), ','), lambda x: trim(x)), '/') order by trim(split_part(entry, ':', 1))) as synonyms from s group by id)
select t.id, array_to_string(list_transform(string_split(keywords, ','), lambda x: trim(x)), '/') as keywords, coalesce(array_to_string(g.synonyms, ';'), '') as synonyms,
  case when length(years) - length(replace(years, ',', '')) = 1 then cast(trim(split_part(years, ',', 1)) as int) end as year_from, case when length(years) - length(replace(years, ',', '')) = 1 then cast(trim(split_part(years, ',', 2)) as int) end as year_to
from t left join g on g.id = t.id""")
def intent_from_text():
    """Lists, a map of any keys and, from just two parts, years, out of command-line texts."""
    return f"""with t as (select id, transform(split(keywords, ','), x -> trim(x)) as keywords, if(synonyms = '', map(), transform_values(str_to_map(synonyms, '\\\\|', ':'), (k, v) -> transform(split(v, ','), x -> trim(x)))) as synonyms, split(years, ',') as years from ({TEXTS}))
select id, array_join(keywords, '/') as keywords, array_join(array_sort(transform(map_entries(synonyms), e -> concat(trim(e.key), '=', array_join(e.value, '/')))), ';') as synonyms,
  case when size(years) = 2 then cast(trim(years[0]) as int) end as year_from, case when size(years) = 2 then cast(trim(years[1]) as int) end as year_to from t"""


# ---- ranking and metrics ----------------------------------------------------------------------------------------

#: What each query returned and added: a paper's or route's first query, in order of query, has it as new.
RUN = """with h as (select qid, paper_id, score, p_brand as route from query_hits join part on p_partkey = paper_id),
p as (select paper_id, min(qid) as first from h group by paper_id), r as (select route, min(qid) as first from h where score >= 20 group by route), n as (select first as qid, count(*) as new_routes from r group by first),
m as (select h.qid, count(*) as returned, count_if(h.qid = p.first) as new_candidates, count_if(h.qid = p.first and score >= 20) as new_scored, count_if(h.qid = p.first and score >= 70) as new_relevant, sum(score) / 100e0 as cost from h join p on p.paper_id = h.paper_id group by h.qid)
select m.*, coalesce(new_routes, 0) as new_routes from m left join n on n.qid = m.qid"""

D_RUN = """select qid, count(*) as returned, count(*) filter (qid = f) as new_candidates, count(*) filter (qid = f and score >= 20) as new_scored, count(*) filter (qid = f and score >= 70) as new_relevant, sum(score) / 100e0 as cost,
  count(distinct route) filter (qid = g and score >= 20) as new_routes
from (select h.*, p_brand as route, min(qid) over (partition by paper_id) as f, min(case when score >= 20 then qid end) over (partition by p_brand) as g from query_hits h join part on p_partkey = paper_id) group by qid"""


@pair(f"select qid, returned, new_candidates, new_scored, new_relevant, new_routes, round(1e0 - new_candidates / greatest(cast(returned as double), 1e0), 6) as duplicate_rate from ({D_RUN})")
def query_run_metrics():
    """A5: what each query added; a query that returned nothing has a duplicate rate of 1."""
    return f"select qid, returned, new_candidates, new_scored, new_relevant, new_routes, round(1e0 - new_candidates / cast(greatest(returned, 1) as double), 6) as duplicate_rate from ({RUN})"


def return_score(n="returned", r="new_relevant", u="new_candidates", f="new_routes", s="new_scored", c="cost") -> str:
    """O6 as an expression: N returned, R relevant, U candidates, F routes, S scored, C seconds."""
    return f"case when {n} = 0 then 0e0 else 40e0 * {r} / {n} + 20e0 * {u} / {n} + 25e0 * least({f} / 2e0, 1e0) - 10e0 * least({c} / 120e0, 1e0) - 5e0 * (case when {u} > 0 then 1e0 - {s} / cast({u} as double) else 0e0 end) end"


@pair(f"""select qid, round(40e0 * new_relevant / returned + 20e0 * new_candidates / returned + case when new_routes >= 2 then 25e0 else 12.5e0 * new_routes end - case when cost >= 120 then 10e0 else cost / 12e0 end
  - coalesce(5e0 - 5e0 * new_scored / nullif(cast(new_candidates as double), 0e0), 0e0), 6) as return_score from ({D_RUN}) order by return_score desc, qid limit 5""")
def query_return_score():
    """Return of each query, five best."""
    return f"select qid, round({return_score()}, 6) as return_score from ({RUN}) order by return_score desc, qid limit 5"


@pair("select paper_id, score, cast(row_number() over (order by score desc, paper_id) as int) as place from scored where score >= 70 qualify place <= 20")
def threshold_filter():
    """F2, O1: scores of at least 70, best first, twenty of them."""
    return "select paper_id, score, cast(row_number() over (order by score desc, paper_id) as int) as place from (select paper_id, score from scored where score >= 70 order by score desc, paper_id limit 20)"


@pair("""with c as (select term, prio, rec, pos, min((prio, rec, pos)) over (partition by lower(term)) as f from (select *, case dim when 'historical' then 0 when 'route' then 1 when 'synonym' then 2 end as prio from terms) where prio is not null)
select term, cast(row_number() over (order by prio, rec, pos) as int) as place from c where (prio, rec, pos) = f qualify place <= 50""")
def historical_topn():
    """Historical, then route, then synonym terms without case, the first fifty."""
    return """select term, cast(row_number() over (order by f) as int) as place from (select min_by(term, struct(prio, rec, pos)) as term, min(struct(prio, rec, pos)) as f from (select *, case dim when 'historical' then 0 when 'route' then 1 when 'synonym' then 2 end as prio from terms) where prio is not null
  group by lower(term) order by f limit 50)"""


# ---- containment ----------------------------------------------------------------------------------------------------


@pair(f"""with h as (select distinct {T.canonicalize(DUCK, "p_type")} as t from part), l as (select distinct {T.canonicalize(DUCK, "split_part(p_name, ' ', 1)")} as t from part)
select t as term from h where exists (select 1 from l where l.t <> '' and (contains(h.t, l.t) or contains(l.t, h.t)))""")
def semantic_cover():
    """Fixed terms that some learned term holds or is held by, after canonicalisation. Terms meet by the first five
    letters of the shorter (all, if fewer) among the pieces of that length of the longer."""
    grams = lambda t: f"transform(filter(flatten(transform(sequence(1, 5), n -> transform(sequence(1, length({t})), i -> struct(n as n, substring({t}, i, n) as g)))), x -> length(x.g) = x.n), x -> x.g)"
    return f"""with h as (select distinct {T.canonicalize(SPARK, "p_type")} as t from part), l as (select distinct {T.canonicalize(SPARK, "split_part(p_name, ' ', 1)")} as t from part),
k as (select h.t as term from (select t, explode(array_distinct({grams("t")})) as g from h where t <> '') h join (select t, substring(t, 1, 5) as g from l where t <> '') l on l.g = h.g where contains(h.t, l.t)
  union all select h.t from (select t, explode(array_distinct({grams("t")})) as g from l where t <> '') l join (select t, substring(t, 1, 5) as g from h where t <> '') h on h.g = l.g where contains(l.t, h.t)
  union all select t from h where t = '' and exists (select 1 from l where t <> ''))
select distinct term from k"""


@pair(f"""with p as (select paper_id, citation_count, lower(title) as t, year, unnest({T.DUCK_WORDS.format("title")}) as word from papers), q as (select distinct split_part(lower(title), ' ', 1) || ' ' || split_part(lower(title), ' ', 2) as query from papers where length(title) < 60),
w as (select query, unnest({T.DUCK_WORDS.format("query")}) as word from q), n as (select query, count(distinct word) as words from w group by query),
m as (select distinct query, word, paper_id, citation_count from w join p using (word) where year < 2015), h as (select query, paper_id, citation_count from m join n using (query) group by query, paper_id, citation_count, words having count(*) = words)
select query, paper_id, cast(0 as int) as depth, cast(count(*) over (partition by query) as bigint) as total_hits from h qualify row_number() over (partition by query order by citation_count desc, paper_id) <= 50""")
def keyword_recall():
    """Papers before 2015 whose title has all words of a query, the fifty most cited of each, marked depth 0, with
    the number there are. Papers and queries meet by a query's rarest word. Titles of under 60 letters give the queries: their
    first two words."""
    words = "array_distinct(regexp_extract_all(lower({}), '[^ -/:-@\\\\[-`\\\\{{-~]+', 0))"
    return f"""with p as (select paper_id, citation_count, {words.format("title")} as words from papers where year < 2015), w as (select *, explode(words) as word from p), f as (select word, count(*) as n from w group by word),
q as (select query, {words.format("query")} as words from (select distinct concat(split_part(lower(title), ' ', 1), ' ', split_part(lower(title), ' ', 2)) as query from papers where length(title) < 60)),
r as (select query, words, min_by(q.word, struct(coalesce(n, 0), q.word)) as word from (select *, explode(words) as word from q) q left join f on f.word = q.word group by query, words),
h as (select query, paper_id, citation_count from r join w on w.word = r.word where forall(r.words, x -> array_contains(w.words, x))), t as (select query, count(*) as total_hits from h group by query)
select h.query, h.paper_id, cast(0 as int) as depth, total_hits from (select *, row_number() over (partition by query order by citation_count desc, paper_id) as n from h) h join t on t.query = h.query where n <= 50"""


@pair("""with g as (select item_id as probe, title from gold union all select paper_id + 1000000, upper(title) from papers)
select probe, lower(left(title, 120)) in (select lower(left(title, 120)) from papers) as found from g""")
def source_exists():
    """Whether a paper of the same title (its first 120 letters, without case) is there."""
    return """with g as (select item_id as probe, lower(substr(title, 1, 120)) as t from gold union all select paper_id + 1000000, lower(substr(title, 1, 120)) from papers)
select probe, s.t is not null as found from g left join (select distinct lower(substr(title, 1, 120)) as t from papers) s on s.t = g.t"""


@pair(f"""with t as (select paper_id, route, category, {T.stems(DUCK, "title")} as words from scored)
select a.paper_id, b.paper_id as other, round(case when a.route <> '' and a.route = b.route then 1e0 else greatest(case when a.category <> '' and a.category = b.category then 0.6e0 else 0e0 end,
  case when len(a.words) = 0 or len(b.words) = 0 then 0e0 else len(list_intersect(a.words, b.words)) / cast(len(a.words) + len(b.words) - len(list_intersect(a.words, b.words)) as double) end) end, 6) as similarity
from cites join t a on a.paper_id = src join t b on b.paper_id = dst""")
def title_jaccard():
    """Similarity of a paper and one it cites: equal route 1, equal category 0.6, or the titles' Jaccard index."""
    return f"""with t as (select paper_id, route, category, {T.stems(SPARK, "title")} as words from scored)
select a.paper_id, b.paper_id as other, round(greatest(case when a.route <> '' and a.route = b.route then 1e0 else 0e0 end, case when a.category <> '' and a.category = b.category then 0.6e0 else 0e0 end, {T.jaccard(SPARK, "a.words", "b.words")}), 6) as similarity
from cites join t a on a.paper_id = src join t b on b.paper_id = dst"""


@pair("select distinct c as concept, contains(lower(c), 'shrinkage') or contains(lower(c), 'contraction') or contains(lower(c), 'stress') as anchor from (select p_type as c from part union all select p_name from part union all select case p_size % 3 when 0 then 'Curing stress' when 1 then p_brand || ' Shrinkage' else 'contraction' end from part)")
def anchor_concepts():
    """concepts that hold a target word."""
    return f"select distinct c as concept, exists({T.sql_list(SPARK, T.ANCHORS)}, a -> contains(lower(c), a)) as anchor from (select p_type as c from part union all select p_name from part union all select case p_size % 3 when 0 then 'Curing stress' when 1 then concat(p_brand, ' Shrinkage') else 'contraction' end from part)"


# ---- papers that were seen, citations -------------------------------------------------------------------------------

KEY = T.dedup_key(SPARK, "doi", "title", "year")
D_KEY = "case when coalesce(doi, '') <> '' then 'doi:' || rtrim(lower(trim(doi)), '.') else 'title:' || regexp_replace(lower(title), '[^a-z0-9]', '', 'g') || ':' || coalesce(cast(year as varchar), 'None') end"


@pair(f"with h as (select qid, paper_id, seq, {D_KEY} as k from query_hits join papers using (paper_id)) select qid, paper_id, seq from h where not exists (select 1 from h e where e.k = h.k and e.qid < h.qid)")
def anti_join_seen():
    """What each query returns that no earlier query has returned, by cross-source key."""
    return f"with k as (select paper_id, {KEY} as k from papers), h as (select qid, h.paper_id, seq, k from query_hits h join k on k.paper_id = h.paper_id), f as (select k, min(qid) as first from h group by k) select qid, paper_id, seq from h join f on f.k = h.k where qid = first"


@pair("select paper_id, arg_min(channel, channel * 1000000000 + origin) as channel, arg_min(origin, channel * 1000000000 + origin) as origin from (select dst as paper_id, 1 as channel, src as origin from cites union all select paper_id, 2, qid from query_hits) group by paper_id")
def channel_union():
    """Citation and keyword pools, the citation channel's row first."""
    return "select paper_id, f.channel, f.origin from (select paper_id, min(struct(channel, origin)) as f from (select dst as paper_id, 1 as channel, src as origin from cites union all select paper_id, 2, qid from query_hits) group by paper_id)"


@pair("select src, dst from (select src, dst, row_number() over (partition by src order by dst) as n from cites qualify n <= 40) r where dst in (select p_partkey from part) qualify row_number() over (partition by src order by n) <= 20")
def citation_backward():
    """G1: of the first forty references of each paper, the first twenty that are there."""
    return "select src, dst from (select c.src, c.dst, row_number() over (partition by c.src order by c.dst) as n from (select src, dst from (select *, row_number() over (partition by src order by dst) as m from cites) where m <= 40) c left semi join part on p_partkey = c.dst) where n <= 20"


@pair("""select dst, src, cited from (select c.dst, c.src, coalesce(cited, 0) as cited from cites c left join (select dst, count(*) as cited from cites group by dst) g on g.dst = c.src)
qualify row_number() over (partition by dst order by cited desc, src) <= 20""")
def citation_forward():
    """Citing papers of each paper, most cited first, twenty."""
    return """with deg as (select dst, count(*) as cited from cites group by dst)
select dst, src, cited from (select c.dst, c.src, coalesce(g.cited, 0) as cited, row_number() over (partition by c.dst order by coalesce(g.cited, 0) desc, c.src) as n from cites c left join deg g on g.dst = c.src) where n <= 20"""


RELATED = "select a, b, together from (select x.dst as a, y.dst as b, count(*) as together from cites x join cites y on y.src = x.src and y.dst <> x.dst group by x.dst, y.dst) t"


@pair(f"{RELATED} qualify row_number() over (partition by a order by together desc, b) <= 10")
def cocitation():
    """The ten papers cited with each paper most often."""
    return f"select a, b, together from (select *, row_number() over (partition by a order by together desc, b) as n from ({RELATED})) where n <= 10"


D_SEEDS = "(select paper_id from scored where score >= 70 and doi is not null order by score desc, paper_id limit 5)"


@pair(f"""with b as (select src as seed, dst as paper_id, 1 as kind, row_number() over (partition by src order by dst) as n from cites where src in {D_SEEDS} qualify n <= 15),
d as (select dst, count(*) as cited from cites group by dst), f as (select c.dst as seed, c.src as paper_id, 2 as kind, row_number() over (partition by c.dst order by coalesce(cited, 0) desc, c.src) as n from cites c left join d on d.dst = c.src where c.dst in {D_SEEDS} qualify n <= 15),
r as (select a as seed, b as paper_id, 3 as kind, row_number() over (partition by a order by together desc, b) as n from ({RELATED}) where a in {D_SEEDS} qualify n <= 10),
u as (select x.*, s.score from (from b union all from f union all from r) x join scored s on s.paper_id = seed), k as (select u.*, {D_KEY} as k from u join papers using (paper_id))
select paper_id, kind, seed from k where k not in (select {D_KEY} from scored) qualify row_number() over (partition by k order by score, seed desc, kind desc, n desc) = 1""")
def expansion_union():
    """References, citing and related papers (15, 15, 10) of the five best seeds; the last of a cross-source key
    wins, papers that are scored already are left out."""
    return f"""with s as (select paper_id as seed, score from scored where score >= 70 and doi is not null order by score desc, paper_id limit 5), d as (select dst, count(*) as cited from cites group by dst),
b as (select seed, dst as paper_id, 1 as kind, row_number() over (partition by seed order by dst) as n from cites join s on seed = src),
f as (select seed, c.src as paper_id, 2 as kind, row_number() over (partition by seed order by coalesce(cited, 0) desc, c.src) as n from cites c join s on seed = c.dst left join d on d.dst = c.src),
r as (select seed, paper_id, 3 as kind, row_number() over (partition by seed order by together desc, paper_id) as n from (select seed, y.dst as paper_id, count(*) as together from cites x join s on seed = x.dst join cites y on y.src = x.src and y.dst <> x.dst group by seed, y.dst)),
u as (select u.*, score from (select * from b where n <= 15 union all select * from f where n <= 15 union all select * from r where n <= 10) u join s on s.seed = u.seed),
k as (select u.*, {KEY} as k from u join papers p on p.paper_id = u.paper_id), l as (select k, max_by(struct(paper_id, kind, seed), struct(-score, seed, kind, n)) as last from k group by k)
select last.paper_id, last.kind, last.seed from l left anti join (select {KEY} as k from scored) g on g.k = l.k"""
