"""Readers of result exports, work records, result pages and benchmarks, and the exports' writers."""

import json
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.evaluation import abstract, authors, rendered

# An export's columns and a scored export's, in order, and the source's headers for each field.
EXPORT = ("title", "authors", "year", "doi", "journal", "volume", "pages", "citation_count", "document_type", "abstract", "scopus_url", "search_query", "retrieved_at")
SCORED = ("title", "authors", "year", "doi", "score", "category", "route", "info_gain", "reason", "abstract")
HEADERS = {
    "文献标题": "title", "Title": "title",
    "年份": "year", "Year": "year",
    "DOI": "doi",
    "链接": "scopus_url", "Link": "scopus_url",
    "摘要": "abstract", "Abstract": "abstract",
    "作者": "authors", "Authors": "authors",
    "来源出版物名称": "venue", "Source title": "venue",
    "卷": "volume", "Volume": "volume",
    "页": "pages", "Pages": "pages", "Page start": "pages",
    "被引频次": "citation_count", "Cited by": "citation_count",
    "文献类型": "document_type", "Document Type": "document_type",
}
AUTHOR = "array<struct<surname: string, given_name: string>>"
PAPER = f"paper_id string, title string, authors {AUTHOR}, year int, abstract string, doi string, scopus_url string, venue string, volume string, pages string, citation_count int, document_type string, source string"


def result_csv(spark: SparkSession, path: str) -> DataFrame:
    """Papers of a result export: the first non-blank header of each field, lenient numbers. Short rows are kept,
    rows without a title are not; multi-line cells and a byte-order mark are read."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    cell = lambda field: [F.nullif(F.trim(F.regexp_replace(F.col(f"`{h}`"), r"^\s+|\s+$", "")), F.lit("")) for h, f in HEADERS.items() if f == field and h in raw.columns]
    rows = raw.select(*(F.coalesce(*cell(f), F.lit(None).cast("string")).alias(f) for f in dict.fromkeys(HEADERS.values()))).where("title is not null")
    return rows.select(
        F.concat(F.lit("scopus:"), F.coalesce("doi", F.substring("title", 1, 80))).alias("paper_id"), "title", F.expr(f"if(authors is null, cast(array() as {AUTHOR}), {authors('authors')})").alias("authors"), F.expr("try_cast(year as int)").alias("year"),
        "abstract", "doi", "scopus_url", "venue", "volume", "pages", F.expr("try_cast(citation_count as int)").alias("citation_count"), "document_type", F.lit("scopus").alias("source"),
    )


def seed_csv(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """The first n rows of an export that have a title and a DOI."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).where("coalesce(title, '') <> '' and coalesce(doi, '') <> ''")
    return rows if n is None else rows.limit(n)


WORK = (
    "id string, title string, display_name string, doi string, publication_year int, cited_by_count int, type string, authorships array<struct<author: struct<display_name: string>>>, "
    "abstract_inverted_index map<string, array<int>>, primary_location struct<source: struct<display_name: string>>, referenced_works array<string>, related_works array<string>"
)


def works_json(spark: SparkSession, path: str) -> DataFrame:
    """Work records as papers, with the works they refer to and are related to. The last word of a name is the
    surname, the DOI's URL prefix goes, the title falls back to the display name, the abstract is put together from its
    inverted index; works without any title go. A file holds works, or a list of them under `results`."""
    raw = spark.read.schema(f"results array<struct<{WORK}>>, {WORK}").option("multiLine", True).json(path)
    names = [c.strip().split()[0] for c in re.sub(r"<[^<>]*(?:<[^<>]*(?:<[^<>]*>[^<>]*)*>[^<>]*)*>", "", WORK).split(",")]
    works = raw.select(F.explode(F.coalesce("results", F.array(F.struct(*names)))).alias("w")).select("w.*")
    title = F.coalesce(F.nullif("title", F.lit("")), F.nullif("display_name", F.lit("")))
    people = "transform(filter(transform(coalesce(authorships, array()), a -> trim(a.author.display_name)), n -> n <> ''), n -> named_struct('surname', element_at(split(n, ' +'), -1), 'given_name', array_join(slice(split(n, ' +'), 1, size(split(n, ' +')) - 1), ' ')))"
    own = F.coalesce(F.nullif("id", F.lit("")), F.substring(title, 1, 80))
    return works.select(
        F.concat(F.lit("openalex:"), own).alias("paper_id"), title.alias("title"), F.expr(people).alias("authors"), F.col("publication_year").alias("year"), F.expr(abstract("abstract_inverted_index")).alias("abstract"), F.expr("nullif(replace(doi, 'https://doi.org/', ''), '')").alias("doi"),
        F.lit(None).cast("string").alias("scopus_url"), F.col("primary_location.source.display_name").alias("venue"), F.lit(None).cast("string").alias("volume"), F.lit(None).cast("string").alias("pages"), F.col("cited_by_count").alias("citation_count"), F.col("type").alias("document_type"),
        F.lit("openalex").alias("source"), "referenced_works", "related_works",
    ).where("title is not null")


def benchmark(spark: SparkSession, path: str) -> DataFrame:
    """(question_id, question, position and fields of each key paper) of a benchmark file; must_hit is true unless it
    says otherwise. Of questions of one id the first counts."""
    papers = "array<struct<doi: string, title: string, authors: string, year: int, route: string, role: string, must_hit: boolean>>"
    raw = spark.read.schema(f"version string, questions array<struct<id: string, question: string, question_en: string, research_routes: array<string>, key_papers: {papers}, stop_criterion: string>>").option("multiLine", True).json(path)
    asked = raw.select(F.posexplode("questions").alias("n", "q")).groupBy(F.col("q.id").alias("question_id")).agg(F.min_by("q", "n").alias("q"))
    rows = asked.select("question_id", F.col("q.question").alias("question"), F.posexplode("q.key_papers").alias("position", "p"))
    return rows.select("question_id", "question", "position", "p.*").withColumn("must_hit", F.coalesce("must_hit", F.lit(True)))


def frozen_queries(spark: SparkSession, path: str, budget: int | None = None) -> DataFrame:
    """(place, query): the first column of a frozen list of queries, in order, `budget` of them."""
    rows = spark.read.option("wholetext", True).text(path).select(F.posexplode(F.from_json("value", "array<string>")).alias("place", "row"))
    out = rows.select("place", F.when(F.col("row").startswith("["), F.element_at(F.from_json("row", "array<string>"), 1)).otherwise(F.col("row")).alias("query"))
    return out if budget is None else out.where(F.col("place") < budget)


# ---- result pages -------------------------------------------------------------------------------------------------------

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Node:
    def __init__(self, tag="", attrs=(), parent=None):
        self.tag, self.attrs, self.parent, self.children = tag, dict(attrs), parent, []

    def all(self):
        for c in self.children:
            if isinstance(c, _Node):
                yield c
                yield from c.all()

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)

    def stripped(self) -> str:
        return "".join(t.strip() for t in self._texts())

    def _texts(self):
        for c in self.children:
            yield from [c] if isinstance(c, str) else c._texts()

    def has(self, tag, cls=None, part=None, **attrs) -> bool:
        names = (self.attrs.get("class") or "").split()
        return (tag is None or self.tag == tag) and (cls is None or cls in names) and (part is None or part in (self.attrs.get("class") or "")) and all((self.attrs.get(k) or "").startswith(v) if v else k in self.attrs for k, v in attrs.items())

    def first(self, *ways):
        """The first node that the first way with any node finds: (tag, class, part of the class, attribute prefixes)."""
        for tag, cls, part, attrs in ways:
            for n in self.all():
                if n.has(tag, cls, part, **attrs):
                    return n
        return None


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node()

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, attrs, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def _way(tag, cls=None, part=None, **attrs):
    return tag, cls, part, attrs


def page(html: str | None) -> tuple[list[dict], int]:
    """(the entries of a result page that have a title, the stated count)."""
    tree = _Tree()
    tree.feed(html or "")
    root = tree.root
    ways = (lambda n: n.has("tr", id="resultDataRow"), lambda n: n.has("div", "document-list-item") or n.has("div", "search-result-item") or n.has("article", "result-item"), lambda n: n.tag == "tr" and n.first(_way("a", id="resultDataRow")))
    entries = next((found for way in ways if (found := [n for n in root.all() if way(n)])), [])
    count = next((int(m[0].replace(",", "")) for n in (root.first(_way("span", "results-count")), root.first(_way(None, **{"data-testid": "results-count"})), next((n for n in root.all() if n.tag == "span" and re.search(r"\d[\d,]*\s+(?:document|result)", n.text(), re.I)), None)) if n and (m := re.search(r"[\d,]*\d", n.stripped()))), 0)
    return [e for n in entries if (e := entry(n))], count


def entry(n: _Node) -> dict | None:
    """One entry of a result page as a paper; None without a title."""
    link = n.first(_way("a", id="resultDataRow"), _way("a", "document-title-link"), _way("a", title=""))
    if not link or not link.stripped():
        return None
    said = lambda *ways: x.stripped() if (x := n.first(*ways)) else None
    found = lambda pattern, text, group=0, flags=0: m[group] if text and (m := re.search(pattern, text, flags)) else None
    title, url = link.stripped(), link.attrs.get("href") or ""
    listed = re.sub(r"\(\d+\)", "", said(_way("span", "doc-author"), _way("span", part="author"), _way("div", "author-list")) or "")
    people = [p.strip().rstrip(".") for p in listed.split(",")]
    people = [p.split(None, 1) for p in people if p and not p.lower().startswith(("view", "et al", "…"))]
    issue = said(_way("span", "doc-publication"), _way("span", part="pub"))
    year = found(r"(?:19|20)\d{2}", said(_way("span", "doc-year"), _way("span", part="year"), _way("time"))) or found(r"(?:19|20)\d{2}", issue)
    place = said(_way("span", "doc-publication"), _way("span", part="journal"), _way("span", part="source"))
    venue = re.sub(r"\b(?:19|20)\d{2}\b", "", (place or "").split(",")[0].strip()).strip()
    volume = found(r"(?:Volume|Vol\.?)\s*(\d+)", issue, 1, re.I) or next((p for p in map(str.strip, (issue or "").split(",")) if p.isdigit() and len(p) <= 3), None)
    cited = found(r"\d+", said(_way("span", "doc-citation-count"), _way("span", part="citation"), _way("span", part="cited")))
    summary = re.sub(r"\AAbstract\s*[:：]\s*", "", said(_way("div", "doc-abstract"), _way("div", part="abstract"), _way("p", part="abstract")) or "", flags=re.I) or said(_way("div", "AbstractHidden"), _way("span", part="abstract"))
    kind = said(_way("span", "doc-type"), _way("span", part="doctype"))
    doi = (found(r"10\.\d{4,}/\S+", n.text()) or "").rstrip(".,;:)") or None
    return {
        "paper_id": f"scopus:{doi or title[:80]}", "title": title, "authors": [{"surname": p[0], "given_name": p[1] if len(p) > 1 else ""} for p in people], "year": int(year) if year else None, "abstract": summary or None, "doi": doi,
        "scopus_url": url if not url or url.startswith("http") else "https://www.scopus.com" + url, "venue": venue or None, "volume": volume, "pages": found(r"(?:pp?\.?\s*)?(\d+[-–]\d+)", issue, 1), "citation_count": int(cited) if cited else None,
        "document_type": next((v for k, v in (("review", "Review"), ("conference", "Conference Paper"), ("article", "Article")) if k in (kind or "").lower()), kind or None), "source": "scopus",
    }


def entries(pages: DataFrame, html: str = "html") -> DataFrame:
    """(total_count and a paper's columns) for each entry of result pages; a page that cannot be read gives none."""
    names = [c.split()[0] for c in PAPER.replace(AUTHOR, "x").split(", ")]

    def run(batches):
        for rows in batches:
            out = [e | {"total_count": total} for p in rows[html] for got, total in [page(p)] for e in got]
            yield pd.DataFrame({"total_count": [e["total_count"] for e in out], **{c: pd.Series([e[c] for e in out], dtype=object) for c in names}})

    return pages.select(html).mapInPandas(run, f"total_count int, {PAPER}")


# ---- exports --------------------------------------------------------------------------------------------------------------


def _written(cells: DataFrame, path: str) -> None:
    """One file, a byte-order mark, all cells quoted, lines ended by CRLF."""
    line = F.concat_ws(",", *(F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"')) for c in cells.columns))
    head = cells.sparkSession.range(1).select(F.lit("\ufeff" + ",".join(f'"{c}"' for c in cells.columns)).alias("value"))
    head.unionByName(cells.select(line.alias("value"))).coalesce(1).write.option("lineSep", "\r\n").mode("overwrite").text(path)


def _cells(papers: DataFrame, columns, query: str, at: str) -> DataFrame:
    have = {"journal": "venue"}
    years = "if(coalesce(year, 0) = 0, '', cast(year as string))"
    special = {"authors": rendered("authors") if dict(papers.dtypes).get("authors", "").startswith("array") else "coalesce(authors, '')", "year": years, "search_query": f"'{query}'".replace("\\", ""), "retrieved_at": f"'{at}'"}
    special |= {"info_gain": "if(coalesce(info_gain, 0) = 0, '', replace(format_number(info_gain, 2), ',', ''))"}
    out = []
    for c in columns:
        name = have.get(c, c)
        out.append(F.expr(special[c]).alias(c) if c in special and (c in papers.columns or c in ("search_query", "retrieved_at")) else F.coalesce(F.col(name).cast("string"), F.lit("")).alias(c) if name in papers.columns else F.lit("").alias(c))
    return papers.select(*out)


def export_csv(papers: DataFrame, path: str, query: str = "", retrieved_at: str = "") -> None:
    """K1, K2: papers as an export of thirteen columns; missing ones and nulls are empty, so is year 0."""
    _written(_cells(papers, EXPORT, query.replace("'", "''"), retrieved_at), path)


def export_scored_csv(scored: DataFrame, path: str) -> None:
    """K3: scored papers as an export of ten columns, the abstract's first thousand letters."""
    _written(_cells(scored.withColumn("abstract", F.substring("abstract", 1, 1000)), SCORED, "", ""), path)


def save_manifest(spark: SparkSession, path: str, queries: list[tuple[int, str, str, str]], question: str = "", benchmark_id: str = "", timestamp: str = "") -> None:
    """K6: a run's manifest as one JSON text; queries are (round, qid, query, strategy)."""
    config = {"max_rounds": 3, "threshold": 70, "per_query_quota": 25, "max_papers_per_query": 200, "n_queries_first_round": 8, "n_queries_gap_round": 4}
    body = {"timestamp": timestamp, "research_question": question, "benchmark_id": benchmark_id, "config": config, "query_count": len(queries), "queries": [dict(zip(("round", "qid", "query", "strategy"), q, strict=True)) for q in queries]}
    spark.createDataFrame([(json.dumps(body, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)


# ---- as queries ---------------------------------------------------------------------------------------------------------

RESULT_PAGES = """select p_partkey, concat('<span class="results-count">', cast(p_partkey as varchar(20)), ' documents</span><', case p_size % 3 when 0 then 'tr id="resultDataRow0"' when 1 then 'div class="x search-result-item"' else 'article class="result-item"' end, '><a ',
  case p_size % 2 when 0 then 'class="document-title-link" href="/p/1"' else 'title="t" href="http://h/1"' end, '> ', p_name, ' </a><span class="doc-author">Lee T.Y. (77), ', split_part(p_name, ' ', 1), ', View all</span><span class="doc-publication">', p_type, ' ', cast(1950 + p_size as varchar(20)),
  ', ', cast(p_size as varchar(20)), ', pp. 3-', cast(p_size as varchar(20)), '</span><span class="n-cited">by ', cast(p_partkey as varchar(20)), '</span><p class="abstract">ABSTRACT: ', p_brand, '</p><span class="doc-type">', case p_size % 4 when 0 then 'A review' when 1 then 'Conference' when 2 then 'article' else 'Note' end,
  '</span> 10.1000/x', cast(p_size as varchar(20)), ').</', case p_size % 3 when 0 then 'tr' when 1 then 'div' else 'article' end, '>') as html from part"""


def result_entries(spark, sf_dir):
    """Every field of the entries of result pages of three forms."""
    from ..plans.bindings import register

    register(spark, sf_dir, RESULT_PAGES)
    people = rendered("authors")
    return entries(spark.sql(RESULT_PAGES)).select("total_count", "paper_id", "title", F.expr(people).alias("authors"), "year", "doi", "scopus_url", "venue", "volume", "pages", "citation_count", "abstract", "document_type")


ORACLES = {
    "result_entries": """select cast(p_partkey as int) as total_count, 'scopus:10.1000/x' || p_size as paper_id, p_name as title, 'Lee T.Y; ' || split_part(p_name, ' ', 1) as authors, cast(1950 + p_size as int) as year, '10.1000/x' || p_size as doi, case when p_size % 2 = 0 then 'https://www.scopus.com/p/1' else 'http://h/1' end as scopus_url,
  p_type as venue, p_size::varchar as volume, '3-' || p_size as pages, cast(p_partkey as int) as citation_count, p_brand as abstract, case p_size % 4 when 0 then 'Review' when 1 then 'Conference Paper' when 2 then 'Article' else 'Note' end as document_type from part"""
}
QUERIES = {"result_entries": result_entries}
