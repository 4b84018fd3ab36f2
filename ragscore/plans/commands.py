"""Command line: python -m ragscore.plans.commands evaluate | generate | leaderboard."""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import SparkSession

from ragscore.functions.adapters import critic_for, has_service, model_for, row_system
from ragscore.operators.judging import mock_critic
from ragscore.operators.taskgen import mock_reply
from ragscore.plans import evaluate as E
from ragscore.plans.generation import TaskConfig, generate
from ragscore.sources import io
from ragscore.sources.settings import Settings


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="ragscore")
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("evaluate", help="run a system over an evaluation set and report its metrics")
    run.add_argument("--dataset", required=True)
    run.add_argument("--rag", required=True, help="module:callable that makes an object with run(sample, top_k=...)")
    run.add_argument("--top_k", type=int, default=5)
    run.add_argument("--judged", action="store_true", help="add the scores of the critic that the settings name")
    run.add_argument("--offline-critic", action="store_true", help="add canned scores instead, named offline_..., to try things with")
    run.add_argument("--output-dir", default="results")
    run.add_argument("--system-name", default="system")
    make = commands.add_parser("generate", help="make an evaluation set from a Parquet corpus (doc_id, text)")
    make.add_argument("--corpus", required=True)
    make.add_argument("--output", required=True)
    make.add_argument("--limit", type=int)
    make.add_argument("--doc-limit", type=int)
    make.add_argument("--test", action="store_true")
    board = commands.add_parser("leaderboard", help="write index.json of a folder of result files")
    board.add_argument("--folder", required=True)
    return parser


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> str:
    """Runs one command; returns the path that it wrote."""
    args = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("ragscore").getOrCreate()
    if args.command == "leaderboard":
        return io.save_leaderboard(io.load_results(spark, args.folder), args.folder)
    if args.command == "generate":
        limit = args.doc_limit if args.doc_limit is not None else 100 if args.test else None
        corpus = io.load_corpus(spark.read.parquet(args.corpus), "doc_id", "text", limit=limit)
        settings = Settings.read()
        if not has_service(settings):
            print("No service or key is set: questions are canned.")
        io.save_jsonl(generate(corpus, TaskConfig.sized(args.limit, args.test), llm=model_for(settings, mock_reply)), args.output, single_file=True)
        return args.output
    settings = Settings.read()
    if args.judged and not has_service(settings):
        raise ValueError("--judged needs a service and its key; --offline-critic adds canned scores, marked as such")
    samples = io.load_jsonl(spark, args.dataset)
    io.load_system(args.rag)  # fails here rather than in a task
    critic = critic_for(settings, mock_critic) if args.judged else mock_critic if args.offline_critic else None
    plan = E.default_plan(args.top_k, "sample_id", critic=critic, judged=critic is not None, judged_prefix="" if args.judged else "offline_")
    plan.validate(E.labelled_columns(samples))
    outputs = row_system(lambda spec=args.rag: io.load_system(spec))(samples, args.top_k).persist()
    results = plan.run(E.views_of(samples, outputs)).persist()
    print(io.console(results))
    print(io.markdown(results))
    path = io.save_result(results, args.output_dir, args.system_name, Path(args.dataset).name, {"top_k": args.top_k, "bertscore": False, "llm_metrics": args.judged})
    outputs.unpersist()
    results.unpersist()
    return path


if __name__ == "__main__":
    main()
