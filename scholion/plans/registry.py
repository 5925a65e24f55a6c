"""The reference queries as callables and their SQL for DuckDB."""

from ..operators import batches, bfs, judge, loop, mmr, recovery
from ..sources import files
from . import evaluation, oracles  # noqa: F401  the first adds its pairs
from .bindings import oracle, register
from .catalog import BUILD
from .dialect import DUCK, SPARK
from .pairs import DOCS, PAIRS


def _run(name, text, doc):
    def run(spark, sf_dir):
        register(spark, sf_dir, text)
        return spark.sql(text)

    run.__name__, run.__doc__ = name, doc
    return run


QUERIES = {name: _run(name, build(SPARK), build.__doc__) for name, build in BUILD.items()} | {name: _run(name, text, DOCS[name]) for name, (text, _) in PAIRS.items()}
QUERIES |= recovery.QUERIES | batches.QUERIES | loop.QUERIES | files.QUERIES | {f.__name__: f for f in (mmr.mmr_rerank, bfs.citation_bfs, judge.lexical_relevance, judge.lenient_labels)}
ORACLES = {name: oracle(build(DUCK)) for name, build in BUILD.items()} | {name: oracle(duck) for name, (_, duck) in PAIRS.items()}
ORACLES |= {name: oracle(text) for name, text in (recovery.ORACLES | batches.ORACLES | files.ORACLES).items()} | {"mmr_rerank": oracle(mmr.ORACLE), "citation_bfs": oracle(bfs.ORACLE), "lexical_relevance": oracle(judge.lexical_sql(DUCK)), "lenient_labels": oracle(judge.LABEL_ORACLE)}
ORACLES |= {name: oracle(text) for name, text in oracles.TEXTS.items()}
