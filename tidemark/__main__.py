"""Command line: run, check or explain a declared job; list the queries of this session's jobs."""

from __future__ import annotations

import argparse
import json
import sys

from tidemark.plans import job as jobs
from tidemark.plans.chains import report


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidemark")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, text in (("run", "start a job and wait for it"), ("check", "validate a job"), ("explain", "the chains of a job and its plan"), ("graph", "the job graph as JSON")):
        commands.add_parser(name, help=text).add_argument("job")
    given = parser.parse_args(args)
    definition = jobs.load(given.job)
    graph = jobs.graph_of(definition)
    if given.command == "check":
        print(f"{graph.name}: {len(graph.vertices)} vertices, {len(graph.edges)} edges")
    elif given.command == "graph":
        print(json.dumps(graph.to_dict(), indent=1))
    elif given.command == "explain":
        r = report(graph)
        print(f"tasks {r.tasks_before} -> {r.tasks_after}, slots {r.slots}")
        print("\n".join(" -> ".join(c) for c in r.chains))
    else:
        from tidemark.session import build_session

        spark = build_session(graph.name, conf=graph.config.spark_conf())
        for query in jobs.run_job(spark, definition):
            if hasattr(query, "awaitTermination"):
                query.awaitTermination()
    return 0


if __name__ == "__main__":
    sys.exit(main())
