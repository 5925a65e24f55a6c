"""python -m scholion COMMAND: compile an intent, search a table of papers, run a registered query, count a store."""

import argparse
import sys

from pyspark.sql import SparkSession


def intent(args) -> dict:
    """Lists at commas, synonyms `word:a,b|word2:c`, years as just two numbers."""
    parts = lambda x, by=",": [p.strip() for p in x.split(by) if p.strip()] if x else []
    pairs = [p.split(":", 1) for p in parts(args.synonyms, "|") if ":" in p]
    years = parts(args.years)
    out = {"keywords": parts(args.keywords), "synonyms": {k.strip(): parts(v) for k, v in pairs}, "must_include": parts(args.must_include), "exclude": parts(args.exclude), "document_type": args.document_type}
    return out | ({"year_from": int(years[0]), "year_to": int(years[1])} if len(years) == 2 else {})


def main(argv: list[str], spark: SparkSession | None = None) -> list[str]:
    """The lines that a command prints."""
    parser = argparse.ArgumentParser(prog="scholion", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("compile", help="the query string of an intent")
    for name in ("keywords", "synonyms", "must-include", "exclude", "years", "document-type"):
        one.add_argument(f"--{name}", default=None)
    two = commands.add_parser("search", help="hits among the papers of a parquet table")
    two.add_argument("query")
    two.add_argument("--papers", required=True)
    two.add_argument("--store", required=True)
    two.add_argument("--limit", type=int, default=20)
    two.add_argument("--years", default=None)
    two.add_argument("--csv", default=None)
    three = commands.add_parser("run", help="a registered query over a folder of tables")
    three.add_argument("name")
    three.add_argument("tables")
    three.add_argument("--out", default=None)
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()

    from .engine import Engine
    from .plans import registry

    if args.command == "compile":
        return [Engine(spark, spark.range(0).selectExpr("id as paper_id"), "/nowhere").compile(**intent(args))]
    if args.command == "search":
        engine = Engine(spark, spark.read.parquet(args.papers), args.store)
        first, _, last = (args.years or "").partition(",")
        hits = engine.search(args.query, args.limit, (int(first) if first.strip() else None, int(last) if last.strip() else None))
        if args.csv:
            engine.to_csv(hits, args.csv, args.query)
        return [f"{engine.total_count} found", *(f"{r.place}. {r.title} ({r.year or '?'})" for r in hits.select("place", "title", "year").orderBy("place").collect())]
    got = registry.QUERIES[args.name](spark, args.tables)
    if args.out:
        got.write.mode("overwrite").parquet(args.out)
        return [args.out]
    return [str(r.asDict(recursive=True)) for r in got.limit(100).collect()]


if __name__ == "__main__":
    print("\n".join(main(sys.argv[1:])))
