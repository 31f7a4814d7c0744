"""python -m symdex [--full] [--quiet] [ROOT]: refresh the index of a project. Also: search QUERY, symbol NAME, overview PATH, status, summary."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession

from symdex.api import Engine
from symdex.functions.render import bar

COMMANDS = ("search", "symbol", "overview", "status", "summary", "refresh")


def arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser("symdex", description=__doc__)
    p.add_argument("--full", action="store_true", help="build anew")
    p.add_argument("--quiet", action="store_true", help="print nothing")
    p.add_argument("--root", help="the project, for commands other than refresh")
    p.add_argument("--limit", type=int, default=10)
    p.add_argument("words", nargs="*", help="the project's folder, or a command and its argument")
    a = p.parse_args(argv)
    a.command = a.words[0] if a.words and a.words[0] in COMMANDS else "refresh"
    rest = a.words[1:] if a.words and a.words[0] in COMMANDS else a.words
    a.argument = " ".join(rest)
    if a.command == "refresh" and rest:
        a.root = rest[0]
    return a


def main(argv: list[str] | None = None) -> int:
    a = arguments(sys.argv[1:] if argv is None else argv)
    spark = SparkSession.builder.appName("symdex").getOrCreate()

    def show(phase: str, current: int, total: int, detail: str) -> None:
        if not a.quiet:
            print(f"  {phase:<9}{bar(current, total)} {detail}", flush=True)

    engine = Engine(spark, a.root, progress=show)
    if a.command != "refresh":
        print({"search": lambda: engine.render_search(a.argument, a.limit), "symbol": lambda: engine.render_symbols(a.argument), "overview": lambda: engine.render_overview(a.argument), "status": engine.render_status, "summary": engine.project_summary}[a.command]())
        return 0
    began = time.time()
    done = engine.refresh(a.full)
    if not a.quiet:
        print(f"  {done['total_files']} files, {done['total_chunks']} chunks, {done['skipped_files']} skipped, {time.time() - began:.1f} s")
    return 0


if __name__ == "__main__":
    sys.exit(main())
