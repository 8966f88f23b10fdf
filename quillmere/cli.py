"""Command line: build an index, search it, ask it, evaluate it."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from quillmere import config
from quillmere.engine import Engine
from quillmere.operators import evaluation, retrieval
from quillmere.session import local_session
from quillmere.sources import readers, sinks


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillmere")
    parser.add_argument("--index", required=True, help="folder of the index")
    parser.add_argument("--cores", default="*")
    sub = parser.add_subparsers(dest="command", required=True)
    build = sub.add_parser("build")
    build.add_argument("corpus")
    build.add_argument("lexicon")
    build.add_argument("--kinds", default=".md,.txt,.json")
    for name in ("search", "ask"):
        p = sub.add_parser(name)
        p.add_argument("text", nargs="+")
        p.add_argument("--mode", default="full" if name == "search" else "react")
    evaluate = sub.add_parser("evaluate")
    evaluate.add_argument("items", help="JSON lines of evaluation items")
    args = parser.parse_args(argv)
    spark = local_session(args.cores)
    engine = Engine(spark, args.index, config.load())
    if args.command == "build":
        engine.build(readers.corpus(spark, args.corpus, tuple(args.kinds.split(","))), readers.lexicon_json(spark, args.lexicon)).show()
    elif args.command == "search":
        engine.search(args.text, args.mode).orderBy("query_id", "rank").show(truncate=80)
    elif args.command == "ask":
        for row in engine.answer(args.text, args.mode).collect():
            print(row["answer"], row["citations"], row["confidence"], sep="\n")
    else:
        items = readers.eval_items(spark, args.items)
        gold = items.select(F.col("qid").alias("query_id"), F.explode("gold_chunk_ids").alias("chunk_id"))
        asked = items.select(F.col("qid").alias("query_id"), F.col("question").alias("text"))
        tables = {m: evaluation.mean_metrics(evaluation.retrieval_metrics(engine.search(asked, m, 30), gold)) for m in retrieval.MODES}
        print(sinks.markdown_report("Retrieval", tables))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
