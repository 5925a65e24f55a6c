"""What judges answer: one lenient reader of JSON in text, and a parser for each kind of answer.

A parser takes a response (null is an empty text) and returns plain values; with() makes a table of them. Nothing here
raises on a malformed answer: it gives the parser's empty value.
"""

import json
import re

import pandas as pd
from pyspark.sql import DataFrame

# The dimensions of a term matrix, in order, and the lists of a knowledge record.
DIMENSIONS = ("material_system", "composition", "strategy_route", "physical_mechanism", "process", "target_properties", "application", "failure_problem", "metrics")
LISTS = ("strategy_routes", "materials", "characterization_methods", "concepts", "synonyms", "broader_terms", "historical_terms")
_DECODER = json.JSONDecoder()


def unfenced(text: str | None) -> str:
    """The text without a code fence around it."""
    return re.sub(r"\A\s*```[^\n]*\n?|\s*```\s*\Z", "", text or "") if (text or "").lstrip().startswith("```") else (text or "").strip()


def _outermost(text: str, left: str, right: str):
    lo, hi = text.find(left), text.rfind(right)
    if lo < 0 or hi < lo:
        return None
    try:
        return json.loads(text[lo : hi + 1])
    except ValueError:
        return None


def array(text: str | None) -> list | None:
    """The outermost array, or None."""
    got = _outermost(unfenced(text), "[", "]")
    return got if isinstance(got, list) else None


def scattered(text: str) -> list[dict]:
    """The objects that can be read at the braces of a text, from left to right; one inside another is part of it."""
    out, at = [], text.find("{")
    while at >= 0:
        try:
            got, end = _DECODER.raw_decode(text, at)
            out.append(got)
        except ValueError:
            end = at + 1
        at = text.find("{", end)
    return out


def obj(text: str | None) -> dict | None:
    """The outermost object, or the first that can be read, or None."""
    text = unfenced(text)
    got = _outermost(text, "{", "}")
    return got if isinstance(got, dict) else next(iter(scattered(text)), None)


def objects(text: str | None) -> list[dict]:
    """The objects of the outermost array; if that cannot be read, every object that can."""
    got = array(text)
    return [x for x in got if isinstance(x, dict)] if got is not None else scattered(unfenced(text))


def rows(text: str | None) -> list[dict]:
    """The objects of the outermost array; none if it cannot be read."""
    return [x for x in array(text) or [] if isinstance(x, dict)]


def texts(value) -> list[str]:
    """A list's texts without blanks around them; a text alone is a list of one."""
    value = [value] if isinstance(value, str) else value if isinstance(value, list) else []
    return [x.strip() for x in value if isinstance(x, str) and x.strip()]


def decisions(text: str | None, first: int, size: int = 15) -> list[tuple[int, str]]:
    """(index, decision) of a pre-filter's answer; all of the batch are UNCERTAIN if it cannot be read."""
    got = array(text)
    if got is None or not all(isinstance(x, dict) for x in got):
        return [(first + i, "UNCERTAIN") for i in range(size)]
    return [(x.get("index", -1), x.get("decision", "UNCERTAIN")) for x in got]


def label(x: dict) -> dict | None:
    """One label with defaults; None without an integer index or a numeric score."""
    n, score = x.get("index", -1), x.get("score", 0)
    if not isinstance(n, int) or not isinstance(score, int | float):
        return None
    try:
        gain = float(x.get("info_gain") or 0)
    except (TypeError, ValueError):
        gain = 0.0
    said = lambda *keys: next((str(x[k]) for k in keys if x.get(k)), "")
    return {"idx": int(n), "score": int(score), "reason": said("reason"), "category": said("category", "aspect"), "route": said("route"), "info_gain": gain, "evidence_type": said("evidence_type") or "unknown", "has_limitation": bool(x.get("has_limitation"))}


def dimension(text: str | None, dim: str) -> list[str]:
    """The terms of one dimension."""
    got = _outermost(unfenced(text), "{", "}")
    return texts(got[dim]) if isinstance(got, dict) and isinstance(got.get(dim), list) else []


def matrix(text: str | None) -> dict[str, list[str]]:
    """The terms of every dimension that an answer has."""
    got = obj(text) or {}
    return {d: texts(got[d]) for d in DIMENSIONS if isinstance(got.get(d), list)}


def families(text: str | None) -> list[dict]:
    """Route families that have a representative."""
    return [x for x in rows(text) if x.get("representative")]


def queries(text: str | None) -> list[dict]:
    """Exploration queries."""
    return [{"query": x["query"], "strategy": x.get("strategy", "")} for x in rows(text) if x.get("query")]


def gap_queries(text: str | None) -> list[str]:
    """Query texts of an answer."""
    return texts(array(text) or [])


def roles(text: str | None) -> list[dict]:
    """(index, role, why), OTHER where no role is given."""
    return [{"idx": x.get("index", -1), "role": x.get("role", "OTHER"), "why": x.get("why", "")} for x in rows(text)]


def canonical(text: str | None, raw: list[str]) -> dict[str, str]:
    """Raw to canonical route, itself where the answer has none."""
    said = {x["raw"]: x["canonical"] for x in rows(text) if x.get("raw") and x.get("canonical")}
    return {**{r: r for r in raw}, **said}


def ontology(text: str | None, routes: list[str]) -> list[dict]:
    """Kind, family and strategy of each route; what is no strategy has neither; a route that is left out is its own."""
    out = []
    for x in rows(text):
        if x.get("route"):
            kind = x.get("type", "strategy_family")
            out.append({"route": x["route"], "type": kind} | {k: x.get(k, "") if kind == "strategy_family" else "" for k in ("family", "strategy")})
    seen = {x["route"] for x in out}
    return out + [{"route": r, "type": "strategy_family", "family": r, "strategy": r} for r in dict.fromkeys(routes) if r not in seen]


def knowledge(text: str | None) -> dict | None:
    """What an extractor learnt from a paper; None without an object."""
    got = _outermost(unfenced(text), "{", "}")
    if not isinstance(got, dict) or not got:
        return None
    part = lambda name, keys: [{k: x.get(k) or "" for k in keys} for x in got.get(name) or [] if isinstance(x, dict)]
    asked = [x for x in got.get("search_hypotheses") or [] if isinstance(x, dict)]
    hypotheses = [{k: x.get(k) or "" for k in ("hypothesis", "rationale", "evidence")} | {"support_type": x.get("support_type") or "unspecified", "queries": texts(x.get("queries"))} for x in asked]
    return {"problem": got.get("problem", ""), **{k: texts(got.get(k)) for k in LISTS}, "physical_mechanisms": part("physical_mechanisms", ("cause", "mechanism", "effect")), "search_hypotheses": hypotheses}


def query_lines(text: str | None) -> list[str]:
    """A list of query texts; else the lines that hold one, without their numbers and quotes."""
    got = array(text)
    if got is not None:
        return texts(got)
    lines = (re.sub(r"\A(?:\d[.)]|- )\s*", "", line.strip()) for line in unfenced(text).split("\n"))
    return [x for x in (re.sub(r'\A"(.*)"\Z', r"\1", line) for line in lines) if "TITLE-ABS-KEY" in x]


def parsed(responses: DataFrame, parser, schema: str, key: str = "request_key", response: str = "response") -> DataFrame:
    """(key, n, columns of schema) of what the parser makes of each response: dicts, or values of a single column."""
    names = [c.strip().split()[0] for c in re.sub(r"<[^<>]*(?:<[^<>]*>[^<>]*)*>", "", schema).split(",")]

    def run(batches):
        for batch in batches:
            got = [(k, n, x if isinstance(x, dict) else {names[0]: x}) for k, r in zip(batch[key], batch[response], strict=True) for n, x in enumerate(parser(r))]
            yield pd.DataFrame({key: [g[0] for g in got], "n": [g[1] for g in got], **{c: pd.Series([g[2].get(c) for g in got], dtype=object) for c in names}})

    return responses.select(key, response).mapInPandas(run, f"`{key}` {responses.schema[key].dataType.simpleString()}, n int, {schema}")
