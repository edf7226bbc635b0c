"""Commands: analyze, check, deps, init, version."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

VERSION = "0.1.0"


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="treeloom")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("analyze", "check", "deps"):
        c = sub.add_parser(name)
        c.add_argument("path")
        c.add_argument("--out", help="folder for JSON sections")
        c.add_argument("--format", choices=["text", "json", "csv", "dot"], default="text")
        c.add_argument("--max-complexity", type=int, default=19)
    sub.add_parser("init").add_argument("--strictness", choices=["relaxed", "standard", "strict"], default="standard")
    sub.add_parser("version")
    a = p.parse_args(argv)
    from treeloom.sources import config, files, sinks

    if a.command == "version":
        print(VERSION)
        return 0
    if a.command == "init":
        print(config.template(a.strictness))
        return 0
    from treeloom.plans.analyze import Project
    from treeloom.runtime import local_session

    spark = local_session()
    found = files.scripts(files.collect(spark, a.path), f"file:{a.path}", exclude=list(config.Config().exclude))
    project = Project(spark, found.select(F.col("path").alias("file_path"), "content"), config.load(a.path))
    if a.command == "check":
        bad = sinks.rows(project.check(a.max_complexity))
        print(sinks.to_text("violations", bad))
        return int(bool(bad))
    deps = project.dependencies()
    sections = dict(deps) if a.command == "deps" else {**project.complexity(), **project.dead_code(), **deps, "coupling": project.coupling(), "clones": project.clones()}
    if a.format == "dot":
        print(sinks.to_dot(sinks.rows(deps["modules"].select("id", "risk")), sinks.rows(deps["edges"].select("src", "dst", "edge_type"))))
    elif a.out:
        (sinks.write_csv if a.format == "csv" else sinks.write_json)(sections, a.out)
    else:
        for name, frame in sections.items():
            print(sinks.to_text(name, sinks.rows(frame, 50)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
