"""The command line: python -m factloom VERB ..."""

from __future__ import annotations

import argparse
import json
import subprocess
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from factloom.operators.graph import CONFIDENCES
from factloom.plans import engine
from factloom.streaming import watch


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="factloom")
    verbs = top.add_subparsers(dest="verb", required=True)
    scan = verbs.add_parser("scan")
    scan.add_argument("target")
    scan.add_argument("--out", required=True)
    scan.add_argument("--include", action="append", default=[])
    scan.add_argument("--disable-default-ignore", action="append", default=[])
    for flag in ("--no-default-ignores", "--allow-output-inside-target", "--export-vault", "--replace-output"):
        scan.add_argument(flag, action="store_true")
    scan.add_argument("--config")
    for name in ("status", "refresh", "watch", "query", "overview", "doctor", "export", "open", "clean"):
        verbs.add_parser(name).add_argument("output")
    choice = verbs.choices
    for name in ("status", "doctor"):
        choice[name].add_argument("--json", action="store_true")
    choice["watch"].add_argument("--interval", type=float, default=watch.INTERVAL)
    choice["query"].add_argument("--node", required=True)
    choice["query"].add_argument("--depth", type=int, default=1)
    choice["query"].add_argument("--direction", choices=("out", "in", "both"), default="out")
    choice["query"].add_argument("--include-containment", action="store_true")
    choice["query"].add_argument("--confidence", action="append", choices=CONFIDENCES, default=[])
    choice["overview"].add_argument("--limit", type=int, default=12)
    choice["open"].add_argument("--system", action="store_true")
    choice["clean"].add_argument("--yes", action="store_true")
    return top


def run(args: argparse.Namespace) -> int:
    if args.verb == "clean":
        engine.clean(args.output, yes=args.yes)
        return 0
    if args.verb == "open":
        page = Path(args.output).resolve() / engine.VAULT / "index.md"
        print(page)
        return subprocess.run(["xdg-open", str(page)], check=False).returncode if args.system else 0
    spark = SparkSession.builder.appName("factloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    say = lambda x: print(json.dumps(x, indent=2, sort_keys=True, default=str))
    if args.verb == "scan":
        options = engine.Options(tuple(args.include), tuple(args.disable_default_ignore), args.no_default_ignores, args.allow_output_inside_target, args.export_vault, args.replace_output, config=args.config)
        say(engine.scan(spark, args.target, args.out, options)["quality"])
        return 0
    if args.verb == "refresh":
        say(engine.refresh(spark, args.output)["refresh"])
        return 0
    if args.verb == "watch":
        watch.watch(spark, args.output, interval=args.interval, tell=say)
        return 0
    if args.verb == "export":
        print(engine.export_vault(spark, args.output))
        return 0
    if args.verb == "query":
        found = engine.query(spark, args.output, args.node, depth=args.depth, direction=args.direction, confidence=tuple(args.confidence), containment=args.include_containment)
        tables = {k: [r.asDict() for r in found[k].toLocalIterator()] for k in ("matches", "nodes", "edges", "evidence")}
        say(tables | {"warnings": found["warnings"], "traversal": {"depth": args.depth, "direction": args.direction, "confidence": args.confidence}})
        return 2 if found["warnings"] else 0
    if args.verb == "overview":
        found = engine.overview(spark, args.output, args.limit)
        say(found)
        return 0 if found["freshness"] == "current" else 2
    if args.verb == "doctor":
        found = engine.doctor(spark, args.output)
        say(found) if args.json else print("\n".join([found["status"], *[f"{'ok  ' if c['passed'] else 'FAIL'} {c['name']}: {c['value']}" for c in found["checks"]]]))
        return 0 if found["status"] == "passed" else 2
    found = engine.status(spark, args.output)
    say(found) if args.json else print(found["freshness"])
    return 0 if found["freshness"] == "current" else 2


def main(argv: list[str] | None = None) -> int:
    try:
        return run(parser().parse_args(argv))
    except ValueError as x:
        print(f"error: {x}", file=sys.stderr)
        return 1
