"""DuckDB's own texts for queries of one text: written apart from it, with other means, so that an error of meaning shows."""

from ..functions.text import ANCHORS, CANONICAL, STEMS, STOP
from .evaluation import D_DOI
from .pairs import D_KEY

_STOPS = ", ".join(f"'{w}'" for w in STOP)
_CUT = " ".join(f"when ends_with(w, '{e}') and length(w) - {len(e)} >= 3 then left(w, -{len(e)})" for e in STEMS)
_PLAIN = "replace(replace(trim(trim(trim(lower({0})), '\"'), ''''), '-', ''), ' ', '')"


def _canonical(x: str) -> str:
    """Suffixes are cut one after the other by length, not by a pattern."""
    t = f"(case when right({_PLAIN.format(x)}, 1) = 's' and right({_PLAIN.format(x)}, 2) <> 'ss' then left({_PLAIN.format(x)}, -1) else {_PLAIN.format(x)} end)"
    for suffix in CANONICAL:
        t = f"(select case when ends_with(v, '{suffix}') then left(v, length(v) - {len(suffix)}) else v end from (select {t} as v))"
    return t


_PRIO = "case dim when 'historical' then 0 when 'route' then 1 when 'synonym' then 2 else 3 end"
_RELAX = "select p_partkey as id, replace(p_name, ' ', ' AND ') || ' AND ' || p_type || ' AND ' || p_brand || case when p_size % 4 = 0 then '' else ' AND shrinkage' end || case when p_size % 3 = 0 then ' AND curing stress' else '' end as query from part"
_IS_ANCHOR = " or ".join(f"contains(lower(c), '{a}')" for a in ANCHORS)

TEXTS = {
    "family_map": "select r_name as family, lower(n_name) as member, n_nationkey from nation join region on r_regionkey = n_regionkey union select r_name, lower(n_name), n_nationkey from region join nation on lower(n_name) = lower(r_name)",
    "prefilter_gate": "select qid, len(list(distinct paper_id))::bigint as n, len(list(distinct paper_id)) >= 31 as filtered from query_hits group by qid",
    "prompt_rows": "select paper_id, title, ifnull(year::varchar, '?') as year, case when abstract is null or abstract = '' then '(no abstract)' else left(abstract, 500) || (case when length(abstract) >= 501 then '...' else '' end) end as abstract from papers",
    "year_range": "select paper_id, year from papers where year between 2000 and 2010",
    "early_papers": "select paper_id, year from papers where not (year > 2015)",
    "dedup_cross_source": f"select min(paper_id) as paper_id, k as dedup_key from (select paper_id, {D_KEY} as k from papers) group by k",
    "dedup_by_id": "select distinct on (paper_id) paper_id, qid, seq, score from query_hits order by paper_id, seq, qid, score",
    "ordered_unique": "with f as (select route, min(paper_id) as first_paper from scored group by route) select route, first_paper, (select count(*) from f g where g.first_paper <= f.first_paper)::int as place from f",
    "cross_dim_dedup": "select t.rec, t.dim, t.term from terms t join (select rec, lower(trim(term)) as k, min((dim, pos)) as f from terms group by all) m on m.rec = t.rec and m.f = (t.dim, t.pos)",
    "distinct_queries": "select lower(p_type) as query from part group by 1",
    "doi_normalize": f"select paper_id, {D_DOI} as doi from papers",
    "multi_get": "with r as (select dst from cites where src = 1 group by dst order by dst limit 50) select paper_id, title from papers join r on dst = paper_id where length(title) > 0",
    "topk_per_query": "select qid, h.paper_id, h.seq, h.score, i::int as place from (select qid, list({paper_id: paper_id, seq: seq, score: score} order by score desc, seq, paper_id) as l from query_hits group by qid), unnest(l[1:25]) with ordinality as u(h, i)",
    "coverage_merge": "with t as (select qid, h.paper_id as paper_id, h.score as score, i from (select qid, list({paper_id: paper_id, seq: seq, score: score} order by score desc, seq, paper_id) as l from query_hits group by qid), unnest(l[1:25]) with ordinality as u(h, i)) select * from (select paper_id, arg_min(qid, qid * 100 + i) as qid, arg_min(score, qid * 100 + i) as score from t group by paper_id) where score >= 70",
    "seed_topk": "select paper_id, score, doi from scored where score > 69 and doi <> '' qualify row_number() over (order by score desc, paper_id) < 6",
    "early_cited_topk": "select paper_id, year, citation_count from papers where year < 2016 qualify row_number() over (order by ifnull(citation_count, 0) desc, paper_id) < 31",
    "last_used_queries": "select l.session_id, step, action_type from search_log l join (select session_id, max(step) as last from search_log group by session_id) m on m.session_id = l.session_id where step > last - 10",
    "terms_distinct": "with f as (select rec, lower(term) as k, min((dim, pos)) as f from terms group by all) select t.rec, t.term, (select count(*) from f g where g.rec = t.rec and g.f <= f.f)::int as place from terms t join f on f.rec = t.rec and f.f = (t.dim, t.pos)",
    "historical_queries": f"with c as (select distinct term, {_canonical('term')} as ckey from (select distinct term from terms)), t as (select ckey, rec, {_PRIO} as prio, pos, t.term from terms t join c on c.term = t.term where ckey <> '') select arg_min(rec, (rec, prio, pos)) as rec, arg_min(term, (rec, prio, pos)) as term, '\"' || arg_min(term, (rec, prio, pos)) || '\" AND \"polymerization shrinkage\"' as query from t group by ckey",
    "canonicalize": f"select term, {_canonical('term')} as ckey from (select p_type as term from part union select p_name from part union select 'thiol-ene polymerizations' union select 'polymerization' union select ' \"Glass\" ')",
    "tokenize_stem": f"select distinct paper_id, case {_CUT} else w end as stem from (select paper_id, unnest(string_split_regex(lower(abstract), '[^a-z0-9-]+')) as w from papers) where length(w) > 2 and w not in ({_STOPS})",
    "relax_queries": f"""with q as ({_RELAX}), c as (select id, query, c, i, {_IS_ANCHOR} as anchor from (select id, query, unnest(string_split(query, ' AND ')) as c, generate_subscripts(string_split(query, ' AND '), 1) as i from q)),
o as (select *, count(*) over (partition by id) as n, count(*) filter (anchor) over (partition by id) as anchors, row_number() over (partition by id, anchor order by i) as place from c), k as (select unnest(range(1, 4)) as less)
select distinct id, query, string_agg(c, ' AND ' order by anchor, i) as relaxed from o, k where n > 2 and anchors > 0 and n - anchors > 1 and n - anchors - less >= 1 and (anchor or place <= n - anchors - less) group by id, query, less""",
    "cache_key": "select p_partkey, left(sha256(lower(p_name)), 16) as query_hash from part",
    "cache_last_wins": "select o_custkey as k, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as v from orders group by o_custkey",
    "papers_first_wins": "select o_custkey as k, arg_min(o_orderkey, (o_orderdate, o_orderkey)) as v from orders group by o_custkey",
    "entry_fields": "select p_partkey, (1950 + p_size)::int as year, p_size || '-' || (p_size + 9) as pages, '10.1000/x' || p_size as doi, p_partkey::int as cited, p_name as venue from part",
    "html_title_links": "select page_id, trim(coalesce(string_split(string_split(html, '<title>')[2], '</title>')[1], '')) as title, (len(string_split(html, '<a href=\"')) - 1)::int as links from pages",
    "domain_context": "select n_name as domain, case when n_name = 'FRANCE' then 'optics' when n_name = 'CHINA' then 'motors' else 'photocuring' end as context from nation",
    "citation_bfs": "with s as (select paper_id from scored where score >= 70 and doi <> '' order by score desc, paper_id limit 5), w as (select dst as node, 1 as depth from cites semi join s on src = paper_id union all select b.dst, 2 from cites a semi join s on a.src = paper_id join cites b on b.src = a.dst) select node, min(depth)::int as depth from w group by node",
}
