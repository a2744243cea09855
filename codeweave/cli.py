"""Command line: index, status, query, trace, related, hotspots, patterns, summarize, serve."""

from __future__ import annotations

import argparse
import json
import os


def session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("codeweave").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="codeweave", description=__doc__)
    p.add_argument("--index", help="folder of the index (default: .codeweave in the project)")
    sub = p.add_subparsers(dest="command", required=True)
    for name, arguments in {
        "index": ["path", "--force"], "status": ["path"], "query": ["symbol"], "trace": ["a", "b"], "related": ["symbol"], "hotspots": [], "patterns": [],
        "hot-paths": ["symbol"], "module": ["path"], "search": ["text"], "summarize": ["path", "--force"], "serve": ["path"],
    }.items():
        c = sub.add_parser(name)
        c.add_argument("--project", default=".")
        for a in arguments:
            if a.startswith("--"):
                c.add_argument(a, action="store_true")
            else:
                c.add_argument(a, **({"nargs": "?", "default": "."} if a == "path" and name != "module" else {}))
        if name in ("hotspots",):
            c.add_argument("-n", type=int, default=20)
        if name == "serve":
            c.add_argument("--port", type=int, default=8420)
    args = p.parse_args(argv)
    from codeweave.operators.store import Index
    from codeweave.plans import index as plan

    root = args.path if args.command in ("index", "status", "summarize", "serve") else args.project
    folder = args.index or os.path.join(os.path.abspath(root), ".codeweave")
    spark = session()
    show = lambda x: print(json.dumps(x, indent=1, default=str))
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    if args.command == "index":
        show(plan.run(spark, root, folder, args.force))
        return 0
    index = Index(spark, folder)
    if not index.state()["version"]:
        print(f"no index in {folder}: run `index` first")
        return 1
    if args.command == "summarize":
        show(plan.summarize(spark, root, folder, skip_fresh=not args.force))
        return 0
    views = plan.Views(index)
    if args.command == "serve":
        from codeweave.server import serve

        serve(views, root, args.port)
    elif args.command == "status":
        show(views.overview())
    elif args.command == "query":
        show(rows(views.symbol(args.symbol)))
    elif args.command == "trace":
        show(rows(views.trace(args.a, args.b)))
    elif args.command == "related":
        show(rows(views.related(args.symbol)))
    elif args.command == "hotspots":
        show(rows(views.hotspots(args.n)))
    elif args.command == "hot-paths":
        show(rows(views.hot_paths(args.symbol)))
    elif args.command == "module":
        show(rows(views.module(args.path)))
    elif args.command == "search":
        show(rows(views.search(args.text)))
    else:
        show(views.patterns())
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
