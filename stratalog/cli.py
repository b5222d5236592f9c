"""Thin command line over ``stratalog.plans.commands``: ``python -m stratalog.cli <command> ...``."""

from __future__ import annotations

import argparse
import datetime as dt
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import settings
from .functions.hashing import ALGORITHMS
from .functions.paths import resolve_alias
from .operators import catalog
from .plans import commands, verify
from .sources.store import Store, locate
from .streaming import log as event_log

VERSION = "0.1"


def _day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="stratalog")
    top.add_argument("--algorithm", choices=list(ALGORITHMS))
    top.add_argument("--config", help="general settings, a JSON object")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *flags: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        for f in ("--dest", "--db-path"):
            p.add_argument(f)
        for f in flags:
            p.add_argument(f, action="store_true")
        return p

    p = command("sort", "--dry-run", "--no-recursive", "--skip-duplicates", "--no-carry-sidecars", "--overwrite-sidecar-tags", "--no-ledger")
    for f in ("--source", "--copyright", "--camera-owner", "--path-template", "--events"):
        p.add_argument(f, default="")
    p.add_argument("--ignore", action="append", default=[])
    p.add_argument("--since", type=_day)
    p.add_argument("--before", type=_day)
    command("verify")
    p = command("status", "--json", "--no-recursive")
    p.add_argument("--source", required=True)
    p.add_argument("--ignore", action="append", default=[])
    p = command("doctor", "--json")
    p.add_argument("--source")
    p.add_argument("--run")
    command("stats", "--json")
    command("clean", "--dry-run")
    p = command("retry", "--dry-run")
    p.add_argument("--run")
    command("resume")
    p = command("query", "--json", "--list", "--pairs")
    p.add_argument("what", choices=["runs", "run", "files", "duplicates", "errors", "skipped", "inventory"])
    p.add_argument("--run", default="")
    p.add_argument("--source")
    for f in ("--from", "--to", "--imported-from", "--imported-to"):
        p.add_argument(f, type=_day, dest=f.strip("-").replace("-", "_") + ("_" if f == "--from" else ""))
    sub.add_parser("version")
    sub.add_parser("events").add_argument("--events", required=True)
    return top


#: Settings that files may give, by the argument they stand in for.
SETTINGS = ("algorithm", "dest", "copyright", "camera_owner", "path_template", "skip_duplicates", "no_carry_sidecars", "overwrite_sidecar_tags", "no_recursive")


def with_settings(a: argparse.Namespace) -> argparse.Namespace:
    """Arguments under the settings files: ignore lists add up, ``+name`` destinations are looked up among the aliases."""
    given = frozenset(k for k in SETTINGS if getattr(a, k, None))
    found = settings.of_source(getattr(a, "source", None) or None, a.config, given)
    for k in SETTINGS:
        if k not in given and k in found and hasattr(a, k):
            setattr(a, k, found[k])
    a.algorithm = a.algorithm or "sha1"
    if hasattr(a, "ignore"):
        a.ignore = [*found.get("ignore", []), *a.ignore]
    if getattr(a, "dest", None):
        a.dest = resolve_alias(a.dest, found.get("aliases", {}))
    return a


def _query(store: Store, a: argparse.Namespace) -> tuple[DataFrame, DataFrame | None]:
    files, runs = store.files, store.runs
    run_id = catalog.resolve_run(runs, a.run) if a.run else None
    if a.what == "runs":
        return catalog.list_runs(runs, files), catalog.runs_summary(runs, files)
    if a.what == "run":
        return catalog.files_of_run(files, run_id), catalog.run_summary(files, run_id)
    if a.what == "duplicates":
        return (catalog.duplicate_pairs if a.pairs and not a.list else catalog.duplicates)(files, run_id), None
    if a.what == "errors":
        return catalog.errors(files, runs, run_id), catalog.error_summary(files, run_id)
    if a.what == "skipped":
        return catalog.skipped(files, run_id), catalog.skip_summary(files, run_id)
    if a.what == "inventory":
        found = catalog.inventory(files)
        return found, catalog.date_summary(found)
    captured = (a.from_, a.to) if a.from_ or a.to else None
    imported = (a.imported_from, a.imported_to) if a.imported_from or a.imported_to else None
    found = catalog.query_files(files, runs, captured, imported, a.source)
    return found, catalog.date_summary(found)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "version":
        print(VERSION)
        return 0
    if a.command == "events":
        spark = spark or SparkSession.builder.appName("stratalog").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        for line in event_log.lines(spark, a.events):
            print(line)
        return 0
    a = with_settings(a)
    if getattr(a, "json", False) and getattr(a, "list", False):
        raise SystemExit("--list and --json exclude each other")
    spark = spark or SparkSession.builder.appName("stratalog").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store = None
    if a.dest and a.command not in ("verify", "status"):
        path = locate(spark, a.dest, a.db_path, write_marker=a.command == "sort" and not a.dry_run)
        store = Store(spark, path, create=a.command == "sort" or not os.path.isdir(path) and a.command in ("clean",))
    show = lambda df, summary=None: print(commands.as_json(getattr(a, "what", a.command), a.dest or "", df, summary) if getattr(a, "json", False) else commands.as_table(df))
    if a.command == "sort":
        options = commands.IngestOptions(
            algorithm=a.algorithm, recursive=not a.no_recursive, since=a.since, before=a.before, skip_duplicates=a.skip_duplicates, dry_run=a.dry_run, ledger=not a.no_ledger,
            carry_sidecars=not a.no_carry_sidecars, overwrite_sidecar_tags=a.overwrite_sidecar_tags, copyright=a.copyright, owner=a.camera_owner, ignore=a.ignore, events=a.events or None,
            **({"template": a.path_template} if a.path_template else {}),
        )
        out = commands.run_ingest(spark, store, a.source, a.dest, options)
        print(json.dumps({k: v for k, v in out.items() if k != "plan"}))
        return int(out["errors"] > 0)
    if a.command == "verify":
        result = commands.run_verify(spark, a.dest, a.algorithm)
        show(result.where(F.col("status") != "verified").drop("content"))
        return int(verify.counters(result).collect()[0]["mismatches"] > 0)
    if a.command == "status":
        show(commands.run_status(spark, a.source, not a.no_recursive, a.ignore))
    elif a.command == "doctor":
        show(commands.run_doctor(spark, store, a.source, a.run))
    elif a.command == "stats":
        for df in commands.run_stats(store).values():
            show(df)
    elif a.command == "clean":
        out = commands.run_clean(spark, a.dest, store, a.dry_run)
        print(json.dumps(out))
        print(commands.clean_summary(out))
    elif a.command in ("retry", "resume"):
        out = commands.run_retry(spark, store, a.dest, a.run, commands.IngestOptions(dry_run=a.dry_run)) if a.command == "retry" else commands.run_resume(spark, store)
        print(json.dumps({k: v for k, v in out.items() if k != "plan"}))
    else:
        found, summary = _query(store, a)
        if a.list:
            print("\n".join(commands.as_list(found)))
        else:
            show(found, summary)
    return 0


if __name__ == "__main__":
    sys.exit(main())
