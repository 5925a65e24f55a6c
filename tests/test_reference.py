"""Reference queries against DuckDB, literal cases, judged operators, the loop, files and the stream."""

import json
import sys

import duckdb
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from scholion import engine
from scholion.__main__ import main
from scholion.functions import text as T
from scholion.operators import assist, bfs, judge, loop, mmr, parsing, recovery
from scholion.operators.numbering import numbered
from scholion.plans import evaluation, pairs, registry
from scholion.plans.bindings import TABLES
from scholion.plans.dialect import SPARK
from scholion.sources import files
from scholion.streaming.search_log import windowed_cost


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not import the tests


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def rows(names, got):
    order = sorted(range(len(names)), key=lambda i: names[i])
    number = lambda x: not isinstance(x, bool) and (isinstance(x, int | float) or type(x).__name__ == "Decimal")
    return sorted(repr(tuple(round(float(r[i]), 6) if number(r[i]) else r[i] for i in order)) for r in got)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) & set(registry.ORACLES)))
def test_against_duckdb(spark, duck, sf, name):
    df = registry.QUERIES[name](spark, sf)
    want = duck.execute(registry.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, want.fetchall())


def test_result_counts_of_thousands(spark, tmp_path):
    spark.sql("select id as page_id, '' as url, '' as html from range(1000) union all select id + 999000, '', '' from range(2000) union all select null, '', ''").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got, want = registry.QUERIES["result_count"](spark, str(tmp_path)), con.execute(registry.ORACLES["result_count"]).fetchall()
    assert rows(got.columns, got.collect()) == rows(["page_id", "total"], want) and len(want) == 3001


@pytest.mark.parametrize("name", ["benchmark_eval", "route_recall", "missed_items", "failure_five_way", "doi_funnel", "deep_rank", "semantic_cover", "route_keyword_cover", "batch_ids", "prefilter_recall_first", "global_merge", "pool_rank", "keyword_recall"])
def test_plans_without_nested_loops_or_one_task_windows(spark, sf, name):
    plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    # a table of one row, or of a row for each route or range, may meet all others
    joins = [line for line in plan.splitlines() if "BroadcastNestedLoopJoin" in line and " Cross" not in line and "LeftOuter" not in line]
    assert not joins and "CartesianProduct" not in plan


# ---- literal cases ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("build", "given", "want"),
    [(T.normalize_doi, "' https://doi.org/10.1/A. '", "10.1/a"), (T.canonicalize, "'thiol-ene polymerizations'", "thiolene"), (T.canonicalize, "'polymerization'", ""), (T.cache_key, "' AbC '", "ba7816bf8f01cfea"), (T.quoted, "'light-curing'", '"light-curing"')],
)
def test_literals(spark, build, given, want):
    assert spark.sql(f"select {build(SPARK, given)}").first()[0] == want


def test_stems(spark):
    got = spark.sql(f"select {T.stems(SPARK, chr(39) + 'Studies of shrinkage stresses using thiols' + chr(39))}").first()[0]
    assert set(got) == {"shrinkage", "stresse", "thiol"}


def test_dedup_keys(spark):
    key = lambda doi, title, year: spark.sql(f"select {T.dedup_key(SPARK, 'doi', 'title', 'year')} from values ({doi}, {title}, {year}) t(doi, title, year)").first()[0]
    assert key("' 10.1/AB. '", "'x'", "1") == "doi:10.1/ab"
    assert key("cast(null as string)", "'低收缩'", "2020") == "title::2020" and key("''", "'A b-1'", "cast(null as int)") == "title:ab1:None"


@pytest.mark.parametrize(("n", "r", "u", "f", "s", "c", "want"), [(10, 2, 5, 1, 5, 60, 25.5), (10, 0, 0, 0, 0, 0, 0.0), (10, 1, 4, 0, 2, 0, 9.5), (0, 0, 0, 0, 0, 5, 0.0), (10, 0, 0, 4, 3, 240, 15.0)])
def test_return_score(spark, n, r, u, f, s, c, want):
    assert float(spark.sql(f"select {pairs.return_score(str(n), str(r), str(u), f'{f}e0', str(s), f'{c}e0')}").first()[0]) == pytest.approx(want)


def _scored(spark, rows):
    spark.createDataFrame(rows, "paper_id bigint, route string, category string, year int, evidence_type string, has_limitation boolean").createOrReplaceTempView("scored")


def test_gaps_by_hand(spark):
    _scored(spark, [(1, "two", "c", 2024, "simulation", False), (2, "two", "c", 2023, "simulation", False), (3, "", "one", 2020, "review", True), (4, None, None, 0, "review", True)])
    assert sorted(r.gap for r in spark.sql(pairs.PAIRS["coverage_gaps"][0]).collect()) == ["one（仅 1 篇）", "one（最新仅 2020 年）", "未分类（仅 1 篇）"]
    assert spark.sql(pairs.PAIRS["gap_text"][0]).first().prompt == "one：仅1篇、最新2020年；未分类：仅1篇。请生成填补以上缺口的查询。"
    three = [(i, "r", "", 2025, kind, limited) for i, (kind, limited) in enumerate([("review", False), ("simulation", False), ("original_experiment", False)])]
    _scored(spark, three)
    assert [r.gap for r in spark.sql(pairs.PAIRS["coverage_gaps"][0]).collect()] == ["r（缺反例/限制）"]
    _scored(spark, [(i, "r", "", 2025, "simulation", True) for i in range(3)])
    assert [r.gap for r in spark.sql(pairs.PAIRS["coverage_gaps"][0]).collect()] == ["r（缺综述）"]
    got = spark.sql(pairs.PAIRS["coverage_map"][0]).first()
    assert (got.paper_count, got.latest_year, got.has_review, got.has_original, got.has_counter_example) == (3, 2025, False, False, True)
    _scored(spark, [])
    assert spark.sql(pairs.PAIRS["gap_text"][0]).first().prompt == pairs.NO_MAP
    _scored(spark, [(1, "a", "", 2025, "review", True), (2, "a", "", 2025, "review", True)])
    assert spark.sql(pairs.PAIRS["gap_text"][0]).first().prompt == pairs.NO_GAPS


def test_compiled_intent(spark):
    intent = """select array('photocuring', 'composite') as keywords, map('photocuring', array('photopolymerization', 'light-curing')) as synonyms, array('degree of conversion') as must_include, array('coating') as exclude,
      null as author, '' as affiliation, 2020 as year_from, 2025 as year_to, 'ar' as document_type, array() as subject_area, 'english' as language"""
    assert spark.sql(f"select {pairs.compiled()} from ({intent})").first()[0] == 'TITLE-ABS-KEY(((photocuring OR photopolymerization OR "light-curing") AND composite AND degree PRE/0 of PRE/0 conversion) AND NOT (coating)) AND PUBYEAR > 2019 AND PUBYEAR < 2026 AND DOCTYPE(ar) AND LANGUAGE(english)'


def test_authors_and_abstracts(spark):
    got = spark.sql(f"select {evaluation.authors(chr(39) + 'Lee T.Y., Bowman C.N.' + chr(39))} as a").first().a
    assert [tuple(x) for x in got] == [("Lee", "T.Y"), ("Bowman", "C.N")]
    assert spark.sql(f"select {evaluation.abstract('map(' + chr(39) + 'b' + chr(39) + ', array(0, 2), ' + chr(39) + 'a' + chr(39) + ', array(1))')}").first()[0] == "b a b"
    assert spark.sql(f"select {evaluation.abstract('cast(null as map<string, array<int>>)')}").first()[0] is None


# ---- judged operators -----------------------------------------------------------------------------------------------------


def test_lenient_answers():
    assert parsing.objects('```json\n[{"a": 1}]\n```') == [{"a": 1}]
    assert parsing.objects('x [{"a": 1}, {"b": }] {"c": {"d": "}"}}') == [{"a": 1}, {"c": {"d": "}"}}] and parsing.objects(None) == []
    assert parsing.label({"index": 1.0, "score": 3}) is None and parsing.label({"index": 1, "score": 3.9, "aspect": "z", "has_limitation": "false"}) == {"idx": 1, "score": 3, "reason": "", "category": "z", "route": "", "info_gain": 0.0, "evidence_type": "unknown", "has_limitation": True}
    assert parsing.decisions(json.dumps([{"index": 15, "decision": "UNCERTAIN"}, {"index": 16, "decision": "IRRELEVANT"}]), 15) == [(15, "UNCERTAIN"), (16, "IRRELEVANT")]
    assert parsing.decisions("no", 15, 2) == [(15, "UNCERTAIN"), (16, "UNCERTAIN")]
    assert parsing.dimension('```\n{"metrics": [" a ", 3, ""]}```', "metrics") == ["a"] and parsing.dimension("{", "metrics") == []
    assert parsing.matrix('x {"a": } {"process": ["p"], "other": ["q"]} y') == {"process": ["p"]}
    assert parsing.families('[{"representative": "a"}, {"family": "b"}]') == [{"representative": "a"}]
    assert parsing.canonical('[{"raw": "a", "canonical": "b"}]', ["a", "c"]) == {"a": "b", "c": "c"}
    assert parsing.ontology('[{"route": "a", "type": "process_parameter", "family": "f"}]', ["a", "b", "b"]) == [{"route": "a", "type": "process_parameter", "family": "", "strategy": ""}, {"route": "b", "type": "strategy_family", "family": "b", "strategy": "b"}]
    assert parsing.roles('[{"index": 0}, 3]') == [{"idx": 0, "role": "OTHER", "why": ""}] and parsing.gap_queries('["a ", 1, ""]') == ["a"]
    got = parsing.knowledge('{"problem": "p", "synonyms": "s", "physical_mechanisms": [{"cause": "c"}, 1], "search_hypotheses": [{"hypothesis": "h", "queries": "q"}]}')
    assert got["synonyms"] == ["s"] and got["physical_mechanisms"] == [{"cause": "c", "mechanism": "", "effect": ""}] and got["search_hypotheses"][0]["support_type"] == "unspecified" and got["search_hypotheses"][0]["queries"] == ["q"]
    assert parsing.knowledge("[]") is None
    assert parsing.query_lines('1. "TITLE-ABS-KEY(a)"\n- TITLE-ABS-KEY(b)\nno\n') == ["TITLE-ABS-KEY(a)", "TITLE-ABS-KEY(b)"] and parsing.query_lines('["x", " "]') == ["x"]


def _papers(spark, n):
    return spark.createDataFrame([(i, f"paper {i}") for i in range(n)], "paper_id bigint, title string").repartition(5)


@pytest.mark.parametrize("n", [14, 15, 16, 29, 30, 31, 47])
def test_prefilter_loses_nothing_at_the_edges_of_batches(spark, n):
    got = assist.prefilter(judge.FakeJudge({}), _papers(spark, n), "q")
    assert sorted(r.paper_id for r in got.collect()) == list(range(n))


def test_prefilter_drops_only_what_is_irrelevant(spark):
    gone = {0, 16, 31, 46}
    got = assist.prefilter(judge.FakeJudge(dict.fromkeys(gone, "IRRELEVANT")), _papers(spark, 47), "q")
    assert {r.paper_id for r in got.collect()} == set(range(47)) - gone
    broken = judge.ScriptedJudge(lambda op, p: "sorry" if "[16]" in p else '[{"index": 0, "decision": "RELEVANT"}, {"index": 99, "decision": "RELEVANT"}]' if "[0]" in p else None)
    assert {r.paper_id for r in assist.prefilter(broken, _papers(spark, 47), "q").collect()} == {0, *range(15, 47)}


def _relevant(op, payload):
    """Scores, routes and kinds by the number that a line begins with."""
    import re

    return json.dumps([{"index": int(n), "score": 60 + int(n) % 40, "route": f"r{int(n) % 3}", "evidence_type": "review", "has_limitation": True} for n in re.findall(r"^\[(\d+)\]", payload, re.M)])


def test_relevance_and_other_judged_operators(spark):
    papers = _papers(spark, 40).withColumn("year", F.lit(None).cast("int")).withColumn("abstract", F.lit("x" * 600)).withColumn("citation_count", F.col("paper_id").cast("int"))
    got = assist.relevance(judge.ScriptedJudge(_relevant), papers, "q", 90, 5).collect()
    assert [(r.paper_id, r.score) for r in got] == [(39, 99), (38, 98), (37, 97), (36, 96), (35, 95)]
    asked = judge.requests("x", spark.createDataFrame([("[1] a",)], "payload string"))
    answer = judge.FakeJudge({1: "IRRELEVANT"}).run(asked)
    assert judge.ReplayJudge(answer).run(asked).first().response == answer.first().response
    assert judge.ReplayJudge(answer.limit(0)).run(asked).first().response is None
    near = judge.LexicalJudge().run(judge.requests("x", spark.createDataFrame([("thiol networks\n[0] thiol resin\n[1] glass",)], "payload string"))).first().response
    assert json.loads(near) == [{"index": 0, "score": 33}, {"index": 1, "score": 0}]
    said = {"roles": '[{"index": 1, "role": "REVIEW", "why": "w"}, {"index": 7}]', "extract": '{"problem": "p", "strategy_routes": ["a", " "]}', "normalize": '[{"raw": "a", "canonical": "A"}]', "classify": "?", "queries": '["TITLE-ABS-KEY(a)"]', "gaps": '["g"]'}
    j = judge.ScriptedJudge(lambda op, p: said[op])
    few = numbered(papers.where("paper_id < 3"), F.col("paper_id"))
    assert [(r.paper_id, r.role) for r in assist.roles(j, few, "q").collect()] == [(1, "REVIEW")]
    record = assist.extract(j, papers.where("paper_id = 3")).first()
    assert (record.paper_id, record.strategy_routes, len(record.source_text), record.extractor_version, record.confidence) == (3, ["a"], 500, "1.1", 1.0)
    assert sorted(map(tuple, assist.normalize(spark, j, ["a", "b", "a"]).collect())) == [("a", "A"), ("b", "b")]
    assert [tuple(r) for r in assist.classify(spark, j, ["a"]).collect()] == [("a", "strategy_family", "a", "a")]
    assert [r.query for r in assist.plain_queries(spark, j, "q").collect()] == ["TITLE-ABS-KEY(a)"]
    assert [r.query for r in assist.gap_queries(spark, j, "q", "", "g", ["u"]).collect()] == ["g"]


def _model(op, payload):
    """A whole model: terms, families, queries, decisions and labels, all fixed functions of the payload."""
    import re

    if op == "dimension":
        dim = payload.rsplit(" ", 1)[-1]
        return json.dumps({dim: {"target_properties": ["shrinkage"], "failure_problem": ["stress"], "metrics": ["shrinkage"]}.get(dim, [])})
    if op == "routes":
        return json.dumps({"strategy_route": ["thiol-ene", "filler"] if "mainstream" in payload else ["thiol ene", "spiro"]})
    if op == "families":
        return json.dumps([{"family": r, "representative": r.split("-")[0], "members": [r]} for r in re.findall(r"^- (.*)$", payload, re.M)])
    if op == "exploration":
        return '[{"query": "resin", "strategy": "x"}, {"query": "resin"}]'
    if op == "gaps":
        return json.dumps(["glass", "resin"] if "glass" not in payload else [])
    lines = re.findall(r"^\[(\d+)\] (.*)$", payload, re.M)
    if op == "prefilter":
        return json.dumps([{"index": int(n), "decision": "IRRELEVANT" if "junk" in t else "UNCERTAIN"} for n, t in lines])
    return json.dumps([{"index": int(n), "score": 90 if "thiol" in t else 80 if "filler" in t else 40, "route": next((w for w in ("thiol", "filler", "glass") if w in t), ""), "evidence_type": "review", "has_limitation": "filler" in t} for n, t in lines])


def test_iterative_search(spark):
    titles = [f"thiol shrinkage {i}" for i in range(4)] + [f"filler shrinkage stress {i}" for i in range(3)] + [f"resin junk {i}" for i in range(40)] + ["glass thiol", "glass filler"]
    papers = spark.createDataFrame([(i, t, 2000 + i % 20, None, f"10.1/{i}" if i % 2 == 0 else None, i) for i, t in enumerate(titles)], "paper_id bigint, title string, year int, abstract string, doi string, citation_count int")
    cites = spark.createDataFrame([(0, 48), (0, 47), (5, 0)], "src bigint, dst bigint")
    j = judge.ScriptedJudge(_model)
    got = loop.run(j, loop.PaperSearch(papers), "q", spark, target=3, max_rounds=3, cites=cites, papers=papers)
    assert [m[2] for m in got.manifest[:6]] == ["TITLE-ABS-KEY(thiol) AND TITLE-ABS-KEY(shrinkage)", "TITLE-ABS-KEY(thiol) AND TITLE-ABS-KEY(stress)", "TITLE-ABS-KEY(filler) AND TITLE-ABS-KEY(shrinkage)", "TITLE-ABS-KEY(filler) AND TITLE-ABS-KEY(stress)", "TITLE-ABS-KEY(spiro) AND TITLE-ABS-KEY(shrinkage)", "TITLE-ABS-KEY(spiro) AND TITLE-ABS-KEY(stress)"]
    metrics = {r["query"]: r for r in got.metrics.collect()}
    assert len(metrics) == 8 and got.rounds == 2  # resin once; after glass in the second round the model asks for no more
    first, fourth, resin = (metrics[got.manifest[i][2]] for i in (0, 3, 6))
    assert (first.returned, first.new_candidates, first.new_scored, first.new_relevant, first.new_routes, first.duplicate_rate) == (4, 4, 4, 4, 1, 0.0)
    assert (fourth.returned, fourth.new_candidates, fourth.duplicate_rate) == (3, 0, 1.0)
    assert (resin.returned, resin.new_candidates, resin.new_scored) == (40, 40, 0)  # over thirty: screened, all junk
    assert {r.paper_id for r in got.qualified.collect()} == {0, 1, 2, 3, 4, 5, 6, 47, 48}  # 47 and 48 by citation, then by query
    assert {r.paper_id for r in got.merged.collect()} == {0, 1, 2, 3, 4, 5, 6}  # citations never enter the merge of queries
    best = [r.paper_id for r in got.best.orderBy("place").collect()]
    assert len(best) == 3 and best[0] in (0, 1, 2, 3) and best[1] in (4, 5, 6)
    stages = {(r.stage, r.n) for r in got.funnel.distinct().groupBy("stage").agg(F.count("*").alias("n")).collect()}
    assert ("qualified", 4) in stages and loop.run(j, loop.PaperSearch(papers), "q", spark, max_rounds=0).best is None
    again = loop.run(j, loop.PaperSearch(papers), "q", spark, target=3, max_rounds=3, cites=cites, papers=papers)
    assert sorted(map(tuple, again.best.collect())) == sorted(map(tuple, got.best.collect())) and again.manifest == got.manifest


def test_term_matrix_without_routes_fails(spark):
    with pytest.raises(ValueError, match="strategy route"):
        assist.term_matrix(spark, judge.ScriptedJudge(lambda op, p: "{}"), "q")


# ---- graphs, numbers, files, stream --------------------------------------------------------------------------------------


def test_expand_keeps_the_first_layer(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 1), (3, None)], "src bigint, dst bigint")
    seeds = spark.createDataFrame([(1,)], "s bigint")
    assert sorted(map(tuple, bfs.expand(edges, seeds, 2).collect())) == [(1, 2), (2, 1), (3, 1)]
    assert bfs.expand(edges, seeds, 0).count() == 0


def test_references_are_cut_before_they_are_looked_up(spark):
    cites = spark.createDataFrame([(1, d) for d in range(2, 80)], "src bigint, dst bigint")
    papers = spark.createDataFrame([(i,) for i in [1, 3, *range(41, 80)]], "paper_id bigint")
    got = recovery.references(cites, papers, papers.where("paper_id = 1"), 20)
    assert [(r.dst, r.n) for r in got.orderBy("n").collect()] == [(3, 1), (41, 2)]  # the first forty references are 2 to 41


def test_numbered_counts_over_ranges(spark):
    got = numbered(spark.range(0, 1000, 1, 7).repartition(9), F.desc("id")).collect()
    assert sorted((r.place, r.id) for r in got) == [(n, 1000 - n) for n in range(1, 1001)]


HTML = """<span class="results-count">1,234 documents</span><table><tr id="resultDataRow0"><td><a id="resultDataRow0t" href="/p?1">A <b>title</b></a><span class="doc-author">Lee T.Y. (123), Wu, View all</span><span class="doc-year">in 1999</span>
<span class="doc-publication">Some Journal 1999, 39, pp. 12-15</span><span class="doc-citation-count">cited 7</span><div class="doc-abstract">Abstract: text</div><span class="doc-type">Review paper</span><p>doi 10.1000/ab.c).</p></td></tr><tr id="resultDataRow1"><td>none</td></tr></table>"""


def test_files(spark, tmp_path):
    (tmp_path / "in.csv").write_text('﻿文献标题,Title,Year,DOI,Authors,Page start\n,"A ""b""\nc",2001,10.1/x,"Lee T.Y., Wu",5\n ,,2002,,,\nD,E,n/a\n', encoding="utf-8")
    got = sorted(files.result_csv(spark, str(tmp_path / "in.csv")).collect(), key=lambda r: r.title)
    assert [(r.title, r.year, r.paper_id, r.pages, [tuple(a) for a in r.authors]) for r in got] == [('A "b"\nc', 2001, "scopus:10.1/x", "5", [("Lee", "T.Y"), ("Wu", "")]), ("D", None, "scopus:D", None, [])]
    e = files.entries(spark.createDataFrame([(HTML,), (None,)], "html string")).collect()
    assert len(e) == 1 and (e[0].title, e[0].year, e[0].doi, e[0].venue, e[0].volume, e[0].pages, e[0].citation_count, e[0].abstract, e[0].document_type, e[0].total_count) == ("Atitle", 1999, "10.1000/ab.c", "Some Journal", "39", "12-15", 7, "text", "Review", 1234)
    assert [tuple(a) for a in e[0].authors] == [("Lee", "T.Y"), ("Wu", "")]
    assert e[0].scopus_url == "https://www.scopus.com/p?1" and e[0].paper_id == "scopus:10.1000/ab.c"
    work = {"id": "W1", "display_name": "T", "doi": "https://doi.org/10.1/a", "publication_year": 2000, "authorships": [{"author": {"display_name": "Ann B Lee"}}], "abstract_inverted_index": {"b": [1], "a": [0]}, "primary_location": {"source": {"display_name": "J"}}, "referenced_works": ["W2"]}
    (tmp_path / "w.json").write_text(json.dumps({"results": [work, {"id": "W3"}]}))
    (tmp_path / "one.json").write_text(json.dumps(work))
    w = files.works_json(spark, str(tmp_path / "w.json")).collect()
    assert [(r.paper_id, r.title, r.doi, r.abstract, r.venue, [tuple(a) for a in r.authors], r.referenced_works) for r in w] == [("openalex:W1", "T", "10.1/a", "a b", "J", [("Lee", "Ann B")], ["W2"])]
    assert files.works_json(spark, str(tmp_path / "one.json")).first().title == "T"
    (tmp_path / "b.json").write_text(json.dumps({"questions": [{"id": "q1", "question": "?", "key_papers": [{"doi": "10.1/A", "year": 2000}, {"doi": "x", "must_hit": False}]}, {"id": "q1", "key_papers": []}]}))
    assert [(r.question_id, r.position, r.doi, r.must_hit) for r in files.benchmark(spark, str(tmp_path / "b.json")).orderBy("position").collect()] == [("q1", 0, "10.1/A", True), ("q1", 1, "x", False)]
    (tmp_path / "q.json").write_text(json.dumps([["a AND b", "direct", "t"], "c", ["d"]]))
    assert [r.query for r in files.frozen_queries(spark, str(tmp_path / "q.json"), 2).orderBy("place").collect()] == ["a AND b", "c"]
    files.export_csv(spark.createDataFrame([("T", 0, 0, [("Lee", "A"), ("Wu", "")])], "title string, citation_count int, year int, authors array<struct<surname: string, given_name: string>>"), str(tmp_path / "out"), "it's")
    out = next((tmp_path / "out").glob("part-*")).read_bytes().decode()
    head, line = out.split("\r\n")[:2]
    assert head == "\ufeff" + ",".join(f'"{c}"' for c in files.EXPORT)
    assert line == '"T","Lee A; Wu","","","","","","0","","","","it\'s",""'
    assert [r.title for r in files.seed_csv(spark, str(tmp_path / "out")).collect()] == []
    files.save_manifest(spark, str(tmp_path / "m"), [(1, "cov_0", "q", "coverage")], "?", "pc")
    assert json.loads(next((tmp_path / "m").glob("part-*")).read_text())["queries"] == [{"round": 1, "qid": "cov_0", "query": "q", "strategy": "coverage"}]


def test_engine(spark, tmp_path):
    papers = spark.createDataFrame([(i, f"thiol resin {i}", 2000 + i, None, None, i, "J") for i in range(30)], "paper_id bigint, title string, year int, abstract string, doi string, citation_count int, venue string")
    e = engine.Engine(spark, papers, str(tmp_path / "store"))
    got = e.search("thiol AND resin", 20, (2005, 2026))
    assert [r.paper_id for r in got.orderBy("place").collect()] == [str(i) for i in range(26, 6, -1)] and e.total_count == 22
    assert e.search("thiol AND resin", 20, (2005, 2026)).count() == 20 and e.cost["queries"] == 1  # from the cache
    assert e.search("thiol AND resin", 5, (2005, 2026)).count() == 5 and e.cost["queries"] == 2  # another limit
    assert e.search("glass").count() == 0 and e.cost["queries"] == 2 and e.total_count == 0
    log = e.session_log().collect()
    assert [(r.step, r.action_type, r.result_count) for r in log] == [(1, "search", 20), (2, "search", 5)] and log[1].result_ids == ["26", "25", "24", "23", "22"]
    e.record("detail", 2.0)
    assert e.get_cost_summary()["api_calls_by_type"] == {"search": 2, "detail": 1} and e.get_cost_summary()["detail_pages_visited"] == 1
    e.reset_cost()
    assert e.cost["queries"] == 0 and e.session_id != e.new_session()
    assert e.compile(keywords=["light-curing"], year_from=2020) == 'TITLE-ABS-KEY("light-curing") AND PUBYEAR > 2019 AND LANGUAGE(english)'
    assert e.search_by_intent(keywords=["thiol"], year_to=2003).count() == 4
    e.to_csv_multi([got, got], str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 40
    asked = spark.createDataFrame([("u", {"b": "2", "a": "1"}), ("u", None)], "url string, params map<string, string>")
    recorded = spark.createDataFrame([('u?{"a": "1", "b": "2"}', "x")], "key string, response string")
    assert sorted(r.response for r in engine.replayed(asked, recorded).collect()) == ["x", "{}"]


def test_command_line(spark, sf, tmp_path):
    assert main(["compile", "--keywords", "a, light-curing", "--synonyms", "a:b, c|d:e", "--years", "2000,2005", "--exclude", "x"], spark) == ['TITLE-ABS-KEY(((a OR b OR c) AND "light-curing") AND NOT (x)) AND PUBYEAR > 1999 AND PUBYEAR < 2006 AND LANGUAGE(english)']
    assert main(["run", "paper_count", sf], spark) == ["{'papers': 200}"]
    spark.createDataFrame([(1, "glass resin", 2001, None, None, 3, "J")], "paper_id bigint, title string, year int, abstract string, doi string, citation_count int, venue string").write.parquet(str(tmp_path / "p"))
    assert main(["search", "resin", "--papers", str(tmp_path / "p"), "--store", str(tmp_path / "s"), "--years", "2000,"], spark) == ["1 found", "1. glass resin (2001)"]


def test_stream(spark, sf, tmp_path):
    whole = spark.read.parquet(f"{sf}/events.parquet")
    batch = windowed_cost(whole)
    whole.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = windowed_cost(spark.readStream.schema(whole.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("costs").outputMode("complete").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    key = lambda r: (r.start, r.action_type, r.calls, round(r.seconds, 6))
    assert sorted(map(key, spark.table("costs").collect())) == sorted(map(key, batch.collect()))
    assert batch.agg({"calls": "sum"}).first()[0] == whole.count()


def test_mmr_takes_papers_of_lower_scores(spark):
    rows = [(g, 100 * g + i, 90 - i // 10, "a", "x", [f"w{i}"]) for g in (1, 2) for i in range(40)] + [(1, 190, 60, "b", "y", ["z"]), (2, 290, 30, "b", "y", ["z"]), (None, 5, None, "a", "x", [])]
    df = spark.createDataFrame(rows, "year int, paper_id bigint, score int, route string, category string, words array<string>")
    got = {(r.year, r.place): r.paper_id for r in mmr.rerank(df, "year").collect()}
    want = {}
    for year in (1, 2, None):
        left, chosen = sorted((r for r in rows if r[0] == year), key=lambda r: (-(r[2] or 0), r[1])), []
        same = lambda a, b: max(float(a[3] == b[3]), 0.6 * (a[4] == b[4]), len({*a[5]} & {*b[5]}) / max(1, len({*a[5]} | {*b[5]})))
        while left and len(chosen) < 10:
            chosen.append(max(left, key=lambda r: round(0.7 * (r[2] or 0) / 100 - 0.3 * max((same(r, c) for c in chosen), default=0.0), 12)))
            left.remove(chosen[-1])
        want |= {(year, i): r[1] for i, r in enumerate(chosen, 1)}
    assert got == want and got[1, 2] == 190
