"""Command line: analyze, gen-labels, feedback stats/list/import/clear."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from seams.config import EngineConfig


def session(name: str = "seams") -> SparkSession:
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()


def _short(name: str, width: int = 40) -> str:
    return name if len(name) <= width else "…" + name[-width + 1 :]


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="seams", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("analyze", help="rank pairs of components")
    a.add_argument("--code", action="append", default=[], help="root of a source tree")
    a.add_argument("--docs", help="folder of documents")
    a.add_argument("--traces", action="append", default=[], help="trace log")
    a.add_argument("--repo", help="git repository")
    a.add_argument("--labels", help="JSON file of labelled pairs")
    a.add_argument("--feedback", help="folder of the decision log")
    a.add_argument("--output", default="seams-output")
    a.add_argument("--top", type=int, default=20)
    a.add_argument("--model", help="folder of a saved model, to rank by where there are too few labels")
    a.add_argument("--as-of", type=float, help="epoch seconds of now")
    g = sub.add_parser("gen-labels", help="template of labels from the last report")
    g.add_argument("--output", default="seams-output")
    g.add_argument("--feedback")
    g.add_argument("--top", type=int, default=50)
    g.add_argument("--to", default="labels.json")
    f = sub.add_parser("feedback", help="the decision log")
    f.add_argument("action", choices=("stats", "list", "import", "clear"))
    f.add_argument("--feedback", required=True)
    f.add_argument("--file", help="JSON file to import")
    f.add_argument("--overwrite", action="store_true", help="imported decisions replace stored ones")
    return p


def main(arguments: list[str] | None = None) -> int:
    from seams.operators import feedback, rank
    from seams.plans.engine import Engine

    args = _parser().parse_args(arguments)
    spark = session()
    if args.command == "analyze":
        config = EngineConfig(code_roots=tuple(args.code), document_folder=args.docs, trace_files=tuple(args.traces), repository=args.repo, labels_file=args.labels, feedback_path=args.feedback, output=args.output, top_k=args.top, as_of=args.as_of, saved_model=args.model)
        result = Engine(spark, config).analyze()
        if result.ranked is None:
            print("no units found")
            return 1
        for r in rank.top(result.ranked, args.top).collect():
            print(f"{r.boundary_score:6.3f} {'#' * round(20 * r.boundary_score):20} {_short(r.comp_a)} | {_short(r.comp_b)} -> {r.suggested_service}")
        for r in () if result.clusters is None else result.clusters.where("cluster >= 0").groupBy("cluster").agg(F.array_sort(F.collect_list("unit")).alias("units")).orderBy("cluster").collect():
            print(f"cluster {r.cluster}: {', '.join(map(_short, r.units))}")
    elif args.command == "gen-labels":
        ranked = spark.read.parquet(f"{args.output}/ranked")
        stored = feedback.labels(feedback.FeedbackLog(spark, args.feedback).read()) if args.feedback else spark.createDataFrame([], "comp_a string, comp_b string, label int")
        rows = [{"comp_a": r.comp_a, "comp_b": r.comp_b, "label": r.label, "_comment": f"score {r.boundary_score:.4f}"} for r in feedback.template(ranked, stored, args.top).orderBy(F.desc("boundary_score"), "comp_a", "comp_b").collect()]
        with open(args.to, "w", encoding="utf-8") as f:
            json.dump(rows, f, indent=2)
        print(f"{len(rows)} pairs, {sum(r['label'] is None for r in rows)} without a label")
    else:
        log = feedback.FeedbackLog(spark, args.feedback)
        if args.action == "stats":
            print(json.dumps(feedback.sufficiency(log.stats()).first().asDict()))
        elif args.action == "list":
            for r in log.entries().collect():
                print(r.decided_at, r.label, r.comp_a, r.comp_b)
        elif args.action == "clear":
            print(log.clear())
        else:
            with open(os.path.abspath(args.file), encoding="utf-8") as f:
                rows = [(x.get("comp_a"), x.get("comp_b"), None if x.get("label") is None else str(x["label"]), i) for i, x in enumerate(json.load(f))]
            given = spark.createDataFrame(rows, "comp_a string, comp_b string, label string, seq bigint")
            if not args.overwrite:
                known = feedback.labels(log.read()).select(F.col("comp_a").alias("ka"), F.col("comp_b").alias("kb"))
                given = given.join(known, (F.least("comp_a", "comp_b") == F.col("ka")) & (F.greatest("comp_a", "comp_b") == F.col("kb")), "left_anti")
            print("added %d, skipped %d" % log.bulk(given))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
