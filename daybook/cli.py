"""Commands over a vault: `python -m daybook.cli <command>`. Each prints one JSON envelope and gives an exit code."""

from __future__ import annotations

import argparse
import json
import os
import sys
from datetime import date
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .functions.dates import is_iso_date, now_in, parse_since
from .operators import analysis, search
from .operators.tables import Diary
from .sources import vault as notes_vault
from .sources import writers
from .sources.segments import SegmentedIndex
from .streaming.watch import watch

INDEX = ".index"
ENVIRONMENT, CONFIG = "DAYBOOK_VAULT", "~/.config/daybook.json"


def read_config(path: str = CONFIG) -> dict:
    """The user's settings; a file that is missing or not as it should be counts as empty."""
    try:
        held = json.loads(Path(path).expanduser().read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return {}
    return held if isinstance(held, dict) else {}


def resolve_vault(flag: str | None, environment: dict | None = None, config: dict | None = None) -> str | None:
    """The vault that the flag names, else the environment, else the user's settings."""
    environment = os.environ if environment is None else environment
    return flag or environment.get(ENVIRONMENT) or (read_config() if config is None else config).get("vault")


def session() -> SparkSession:
    return SparkSession.builder.appName("daybook").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="daybook")
    top.add_argument("--vault")
    top.add_argument("--zone", default="UTC", help="time zone of today and now")
    commands = top.add_subparsers(dest="command", required=True)
    add = lambda name, *options: [c := commands.add_parser(name), [c.add_argument(*a, **k) for a, k in options]]
    flag = lambda *names: (names, {"action": "store_true"})
    opt = lambda *names, **k: (names, k)
    span = [opt("--since"), opt("--from", dest="start"), opt("--to", dest="end")]
    add("init")
    add("recall", opt("query", nargs="?"), opt("--entity"), opt("--relation"), opt("--type", dest="kind"), opt("--limit", type=int, default=search.DEFAULT_LIMIT), flag("--digest"), *span)
    add("reflect", opt("--since"), flag("--md"))
    add("remember", opt("text", nargs="?", help="from standard input without it"), opt("--mood"), opt("--tags"), opt("--relation", action="append", default=[], help="verb=A,B"), opt("--date"), opt("--time"), opt("--checkin"))
    add("forget", opt("ids", nargs="*"), opt("--entity"), flag("--redact"), flag("--dry-run"))
    add("entities", opt("--type", dest="kind"))
    add("merge", opt("source"), opt("into"))
    add("import", opt("folder"), flag("--dry-run"))
    add("reindex")
    add("watch", opt("--seconds", type=float, default=30.0), opt("--rounds", type=int, help="stop after so many changes"))
    return top


def nested(df: DataFrame) -> list[dict]:
    return [json.loads(r) for r in df.toJSON().toLocalIterator()]


def window(args, today: date, otherwise: str | None) -> tuple[str | None, str | None]:
    """The inclusive range that --since, or --from and --to, ask for."""
    if args.since or (otherwise and not (getattr(args, "start", None) or getattr(args, "end", None))):
        found = parse_since(args.since or otherwise, today)
        if not found:
            raise ValueError("Invalid date filter.")
        return found
    for d in (args.start, args.end):
        if d and not is_iso_date(d):
            raise ValueError("Invalid date filter.")
    return args.start, args.end


def current(spark: SparkSession, root: str) -> Diary:
    return notes_vault.current_index(spark, root, f"{root}/{INDEX}/tables")


def run_recall(spark, root, args, today):
    diary = current(spark, root)
    if args.digest:
        return nested(analysis.digest(diary, *window(args, today, "7d")))[0]
    start, end = window(args, today, None)
    kept = SegmentedIndex(spark, f"{root}/{INDEX}/segments")
    kept.sync(diary.entries)  # only what has changed is indexed
    index = kept.open()
    found = nested(search.recall(diary, index, args.query, args.entity, args.relation, args.kind, start, end, args.limit))
    context = nested(search.entity_context(diary, args.entity if args.entity is not None else args.query))
    return {"query": args.query, "entity": args.entity, "relation": args.relation, "type": args.kind, "count": found[0]["total"] if found else 0, "results": found, "entity_context": context}


def run_reflect(spark, root, args, today):
    start, end = (args.since and parse_since(args.since, today)) or parse_since("30d", today)
    report = analysis.reflect(current(spark, root), start, end)
    out = {"period": {"from": start, "to": end}, **{name: nested(df) for name, df in report.items()}}
    if args.md:
        day, clock = now_in(args.zone)
        path = Path(root, INDEX, "reflect", f"{day.replace('-', '')}-{clock.replace(':', '')}.md")
        writers.write_file(path, writers.render_report(report, start, end))
        out["md_path"] = str(path)
    return out


def run_remember(spark, root, args, today):
    text = args.text if args.text is not None else sys.stdin.read()
    if not text.strip():
        raise ValueError("Nothing to remember.")
    told = [r.partition("=") for r in args.relation]
    relations = {verb: [t.strip() for t in targets.split(",") if t.strip()] for verb, _, targets in told}
    tags = [t.strip() for t in (args.tags or "").split(",") if t.strip()]
    out = writers.remember(root, text, today, args.time or now_in(args.zone)[1], args.date, args.mood, tags, relations, args.checkin)
    current(spark, root)
    return out


def run_forget(spark, root, args, today):
    if args.entity:
        n = notes_vault.forget_entity(spark, root, args.entity, args.redact, args.dry_run)
    elif args.ids:
        n = writers.forget(root, args.ids, args.redact, args.dry_run)
    else:
        raise ValueError("Nothing to forget: name entries or an entity.")
    if not args.dry_run:
        current(spark, root)
    return {"forgotten": n, "redacted": args.redact, "dry_run": args.dry_run}


def run_import(spark, root, args, today):
    if not os.path.isdir(args.folder):
        raise ValueError(f"Source folder not found: {args.folder}")
    out = notes_vault.import_folder(spark, args.folder, root, args.dry_run)
    if not args.dry_run:
        notes_vault.rebuild(spark, root, f"{root}/{INDEX}/tables")
    return out


def run_merge(spark, root, args, today):
    n = writers.merge_entities(root, args.source, args.into)
    current(spark, root)
    return {"links_rewritten": n}


def run_watch(spark, root, args, today):
    """Sync and print a line for each change, until interrupted (or after so many)."""
    current(spark, root)
    seen = []

    def on_change(diff, number):
        line = {"batch": number, **notes_vault.sync(spark, root, f"{root}/{INDEX}/tables")}
        seen.append(line)
        print(json.dumps(line), flush=True)
        if args.rounds and len(seen) >= args.rounds:
            raise KeyboardInterrupt

    query = watch(spark, root, f"{root}/{INDEX}/tables/files", on_change, f"{root}/{INDEX}/watch-{os.getpid()}", args.seconds)
    try:
        query.awaitTermination()
    except KeyboardInterrupt:
        query.stop()
    return {"changes": len(seen)}


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=print) -> int:
    args = parser().parse_args(argv)
    root = resolve_vault(args.vault)
    if not root or (args.command != "init" and not os.path.isdir(root)):
        out(writers.envelope(error=f"Vault not found: {root}" if root else "No vault configured.", hint=f"Use --vault, {ENVIRONMENT} or {CONFIG}."))
        return 1
    today = date.fromisoformat(now_in(args.zone)[0])
    try:
        if args.command == "init":
            writers.init_vault(root)
            data = {"vault": root, "state": writers.vault_state(root)}
        else:
            spark = spark or session()
            simple = {
                "entities": lambda: {"entities": nested(analysis.entity_list(current(spark, root), args.kind))},
                "reindex": lambda: notes_vault.rebuild(spark, root, f"{root}/{INDEX}/tables"),
            }
            runs = {"recall": run_recall, "reflect": run_reflect, "remember": run_remember, "forget": run_forget, "import": run_import, "merge": run_merge, "watch": run_watch}
            data = simple[args.command]() if args.command in simple else runs[args.command](spark, root, args, today)
    except (ValueError, OSError) as e:
        out(writers.envelope(error=str(e)))
        return 1
    out(writers.envelope(data))
    return 0


if __name__ == "__main__":
    sys.exit(main())
