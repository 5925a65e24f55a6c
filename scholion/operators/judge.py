"""Relevance judgement behind an interface: requests in, responses out, written before they are used.

A request is (op, request_key, payload); the key is a hash of the other two, so a recorded answer can be replayed. Answers
may differ from call to call, so each() writes them to the shared folder before anything reads them.
"""

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.bindings import register
from ..plans.dialect import SPARK
from . import parsing
from .bfs import checkpoint
from .parsing import label, objects  # noqa: F401

LABELS = "idx int, score int, reason string, category string, route string, info_gain double, evidence_type string, has_limitation boolean"


class Judge:
    """run() answers requests (op, request_key, payload) with rows (op, request_key, response)."""

    def run(self, requests: DataFrame) -> DataFrame:
        raise NotImplementedError


class ReplayJudge(Judge):
    """Answers from a table of recorded responses; what was not recorded has no response."""

    def __init__(self, recorded: DataFrame):
        self.recorded = recorded

    def run(self, requests):
        return requests.select("op", "request_key").join(self.recorded.select("op", "request_key", "response"), ["op", "request_key"], "left")


class ScriptedJudge(Judge):
    """Answers by a function of (op, payload), the same for the same request."""

    def __init__(self, answer):
        self.answer = answer

    def run(self, requests):
        answer = self.answer

        def said(batches):
            for rows in batches:
                yield pd.DataFrame({"op": rows["op"], "request_key": rows["request_key"], "response": [answer(o, p) for o, p in zip(rows["op"], rows["payload"], strict=True)]})

        return requests.mapInPandas(said, "op string, request_key string, response string")


class FakeJudge(ScriptedJudge):
    """Scripted decisions by the global index that a payload lists as [n]; UNCERTAIN where the script says nothing."""

    def __init__(self, decisions: dict[int, str]):
        super().__init__(lambda op, payload: json.dumps([{"index": int(n), "decision": decisions.get(int(n), "UNCERTAIN")} for n in re.findall(r"\[(\d+)\]", payload or "")]))


class LexicalJudge(Judge):
    """Scores of numbered titles by the Jaccard index of their stems and the question's (the payload's first line), in
    hundredths: a deterministic stand-in of our own."""

    def run(self, requests):
        lines = requests.selectExpr("op", "request_key", "split(payload, '\\n')[0] as question", "explode(regexp_extract_all(payload, r'\\[(\\d+)\\] ([^\\n]*)', 0)) as line")
        rows = lines.selectExpr("op", "request_key", "cast(regexp_extract(line, r'\\[(\\d+)\\]', 1) as int) as idx", f"{T.stems(SPARK, 'line')} as a", f"{T.stems(SPARK, 'question')} as b")
        scored = rows.selectExpr("op", "request_key", f"struct(idx as index, cast(floor(100e0 * ({T.jaccard(SPARK, 'a', 'b')})) as int) as score) as x")
        return scored.groupBy("op", "request_key").agg(F.to_json(F.array_sort(F.collect_list("x"))).alias("response"))


def requests(op: str, batches: DataFrame) -> DataFrame:
    """(op, request_key, payload) of rows with a payload."""
    return batches.select(F.lit(op).alias("op"), F.sha2(F.concat(F.lit(op), "payload"), 256).alias("request_key"), "payload")


def each(judge: Judge, op: str, rows: DataFrame) -> DataFrame:
    """rows (with a payload) and the judge's response to each, written to the shared folder."""
    keyed = rows.withColumn("request_key", F.sha2(F.concat(F.lit(op), "payload"), 256))
    asked = keyed.select(F.lit(op).alias("op"), "request_key", "payload").distinct()
    answers = checkpoint(judge.run(asked)).select("request_key", "response")
    return keyed.join(answers, "request_key", "left").drop("request_key", "payload")


def parse_labels(responses: DataFrame, key: str = "request_key", response: str = "response") -> DataFrame:
    """(key, label columns) of every label in the responses; a response without any gives no row."""
    return parsing.parsed(responses, lambda r: [y for x in objects(r) if (y := label(x))], LABELS, key, response).drop("n")


def _words(d):
    """Two papers' stems: a title and the question, which is the title of the first key paper that a paper has."""
    asked = "select title as question from gold where item_id = (select min(item_id) from gold where length(title) > 40)"
    return f"select paper_id, {T.stems(d, 'title')} as a, {T.stems(d, 'question')} as b from papers cross join ({asked}) q"


def lexical_sql(d):
    """The lexical judge's score of every title."""
    return f"with w as ({_words(d)}) select paper_id, cast(floor(100e0 * ({T.jaccard(d, 'a', 'b')})) as int) as score from w"


def lexical_relevance(spark, sf_dir):
    """L1 with the deterministic lexical judge: titles against a benchmark title (one row)."""
    text = lexical_sql(SPARK)
    register(spark, sf_dir, text)
    return spark.sql(text)


RESPONSES = """select o_orderkey, concat(case when o_orderkey % 2 = 0 then concat('```json', chr(10)) else 'Answer: ' end, case when o_orderkey % 5 = 0 then '[{"bad": }, ' else '[' end, '{"index": ', cast(o_orderkey % 15 as varchar(20)), ', "score": ', cast(o_orderkey % 101 as varchar(20)),
  '.7, "aspect": "', o_orderpriority, '", "reason": "a } b"}', case when o_orderkey % 3 = 0 then ', {"index": "x", "score": 1}' else '' end, ']', case when o_orderkey % 2 = 0 then concat(chr(10), '```') else '' end) as response from orders"""


def lenient_labels(spark, sf_dir):
    """Labels out of fenced, chatty and broken responses."""
    register(spark, sf_dir, RESPONSES)
    return parse_labels(spark.sql(RESPONSES), "o_orderkey").select("o_orderkey", "idx", "score", "category", "evidence_type")


LABEL_ORACLE = "select o_orderkey, cast(o_orderkey % 15 as int) as idx, cast(o_orderkey % 101 as int) as score, o_orderpriority as category, 'unknown' as evidence_type from orders"
