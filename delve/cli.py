"""Command line: ``python -m delve.cli index TARGET`` and ``python -m delve.cli search PATTERN TARGET``."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import SparkSession

from delve.functions.patterns import PatternError, compile_patterns
from delve.operators import render
from delve.operators.index import Index, IndexChanged, update_index
from delve.operators.scope import Scope, parse_instant
from delve.operators.search import list_files, search, search_stats
from delve.sources.corpus import list_objects, read_objects
from delve.streaming.watch import watch


def parent_prefixes(target: str) -> list[str]:
    """The target and the folders above it, nearest first."""
    parts = target.rstrip("/").split("/")
    return ["/".join(parts[:k]) for k in range(len(parts), 0, -1) if any(parts[:k])]


def discover(spark: SparkSession, target: str, name: str = ".delve") -> tuple[str, str] | None:
    """(index folder, folder it indexes) of the nearest parent that has an index."""
    for folder in parent_prefixes(target):
        if Index(spark, f"{folder}/{name}").manifest.generation:
            return f"{folder}/{name}", folder
    return None


def remember(file: str | Path, target: str, index: str) -> None:
    """Note where the index of a target lies that is not below it."""
    places = recalled(file)
    if places.get(target) != index:
        Path(file).parent.mkdir(parents=True, exist_ok=True)
        Path(file).write_text(json.dumps({**places, target: index}, indent=1, sort_keys=True))


def recalled(file: str | Path) -> dict[str, str]:
    """Index folders by target; a file that is missing or damaged remembers nothing."""
    try:
        places = json.loads(Path(file).read_text())
    except (OSError, ValueError):
        return {}
    return places if isinstance(places, dict) else {}


def recall(file: str | Path, target: str) -> tuple[str, str] | None:
    """(index folder, folder it indexes) of the nearest remembered parent of the target."""
    places = recalled(file)
    return next(((places[p], p) for p in parent_prefixes(target) if p in places), None)


def consistent(open_index: Callable[[], Index], produce: Callable[[Index], Iterator[str]]) -> Iterator[str]:
    """What ``produce`` yields of one generation: if a newer one takes its files away, start again, but not once lines are out."""
    for attempt in (0, 1):
        index, out = open_index(), 0
        try:
            for line in produce(index):
                out += 1
                yield line
            return
        except Exception as e:
            if not index.changed():
                raise
            if out or attempt:
                raise IndexChanged(f"generation {index.manifest.generation} was replaced during the search") from e


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="delve")
    p.add_argument("--locations", default=str(Path.home() / ".delve" / "locations.json"), help="where indexes elsewhere are remembered")
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("index")
    i.add_argument("target")
    i.add_argument("--index")
    i.add_argument("--strategy", choices=["auto", "trigram", "sparse"], default="auto")
    for flag in ("--rebuild", "--purge-deleted", "--watch", "--json", "--progress"):
        i.add_argument(flag, action="store_true")
    i.add_argument("--interval", type=float, default=60)
    i.add_argument("--cycles", type=int, help=argparse.SUPPRESS)
    s = sub.add_parser("search")
    s.add_argument("words", nargs="*")
    s.add_argument("-e", "--regexp", action="append", default=[])
    s.add_argument("-g", "--glob", action="append", default=[])
    for flags in (("-F", "--fixed-strings"), ("-i", "--ignore-case"), ("-S", "--smart-case"), ("-s", "--case-sensitive"), ("-w", "--word-regexp"), ("-a", "--text"), ("-l", "--files-with-matches"), ("--files",), ("-c", "--count"), ("--count-matches",), ("-n", "--line-number"), ("-N", "--no-line-number"), ("--column",), ("--heading",), ("--no-heading",), ("-q", "--quiet"), ("--json",), ("--stats",)):
        s.add_argument(*flags, action="store_true")
    s.add_argument("-m", "--max-count", type=int)
    s.add_argument("--match-window", type=int, default=0)
    for flags in (("-A", "--after-context"), ("-B", "--before-context"), ("-C", "--context")):
        s.add_argument(*flags, type=int, default=0)
    s.add_argument("--color", choices=["auto", "always", "never"], default="auto")
    for flag in ("--index", "--key-prefix", "--key-regex", "--since", "--until"):
        s.add_argument(flag)
    return p


def run(spark: SparkSession, argv: list[str], now: datetime | None = None) -> Iterator[str]:
    """Output lines of a command; the last yields nothing but sets ``run.code``."""
    args = parser().parse_args(argv)
    now = now or datetime.now(timezone.utc)
    run.code = 0
    if args.command == "index":
        root = args.target.rstrip("/")
        where = args.index or f"{root}/.delve"
        strategy = None if args.strategy == "auto" else args.strategy

        if args.index:
            remember(args.locations, root, args.index)
        events: list[str] = []
        progress = (lambda event: events.append(json.dumps(event))) if args.progress else None

        def once(rebuild: bool) -> dict:
            listing = list_objects(spark, root, exclude=".delve/")
            return update_index(spark, where, None, root, strategy, rebuild, args.purge_deleted, listing=listing, fetch=lambda wanted: read_objects(spark, root, wanted), progress=progress)

        for line in watch(once, args.interval, rebuild=args.rebuild, cycles=args.cycles) if args.watch else list(watch(once, 0, rebuild=args.rebuild, cycles=1))[:1]:
            yield from events
            events.clear()
            yield line
        return
    targets = list(args.words)
    patterns = list(args.regexp)
    if not patterns and not args.files:
        patterns, targets = targets[:1], targets[1:]
    if len(targets) != 1:
        raise SystemExit("give a pattern and one target")
    target = targets[0].rstrip("/")
    found = (args.index, target) if args.index else discover(spark, target) or recall(args.locations, target)
    if not found:
        raise SystemExit(f"no index above {target}")
    yield from consistent(lambda: Index(spark, found[0]), lambda index: _search(index, args, target, patterns, now))


def _search(index: Index, args: argparse.Namespace, target: str, patterns: list[str], now: datetime) -> Iterator[str]:
    inside = target.removeprefix(index.manifest.source).lstrip("/")
    bound = lambda x, until=False: parse_instant(x, now, until) if x else None
    scope = Scope(inside, args.key_prefix, args.key_regex, tuple(args.glob), bound(args.since), bound(args.until, True))
    if args.files:
        lines = [r["key"] for r in list_files(index, scope).toLocalIterator()]
        run.code = render.exit_code(bool(lines), False)
        yield from lines
        return
    try:
        program = compile_patterns(patterns, args.fixed_strings, args.word_regexp, args.ignore_case, args.smart_case and not args.case_sensitive)
    except PatternError as e:
        run.code = 2
        yield f"error: {e}"
        return
    hits = 0
    if args.quiet:
        run.code = render.exit_code(not search(index, program, scope, "documents").limit(1).isEmpty(), False)
        return
    if args.files_with_matches:
        for r in search(index, program, scope, "documents").orderBy("key").toLocalIterator():
            hits += 1
            yield r["key"]
    elif args.count or args.count_matches:
        for r in search(index, program, scope, "count_matches" if args.count_matches else "count_lines", max_count=args.max_count).orderBy("key").toLocalIterator():
            hits += 1
            yield f"{r['key']}:{r['n']}"
    elif args.match_window:
        for line in render.window_lines(search(index, program, scope, "windows", max_count=args.max_count, window=args.match_window).orderBy("key", "line").toLocalIterator()):
            hits += 1
            yield line
    else:
        before, after = args.before_context or args.context, args.after_context or args.context
        rows = search(index, program, scope, "lines", before, after, args.max_count).orderBy("key", "line").toLocalIterator()
        if args.json:
            for line in render.json_lines(rows):
                hits += '"match"' in line
                yield line
        else:
            color = args.color == "always" or (args.color == "auto" and sys.stdout.isatty())
            for line in render.standard_lines(rows, not args.no_line_number, args.column, args.heading and not args.no_heading, bool(before or after), color, args.text):
                hits += 1
                yield line
    if args.stats:
        yield render.stats_line(search_stats(index, program, scope))
    run.code = render.exit_code(bool(hits), False)


def main() -> int:
    spark = SparkSession.builder.appName("delve").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for line in run(spark, sys.argv[1:]):
        print(line)
    return run.code


if __name__ == "__main__":
    sys.exit(main())
