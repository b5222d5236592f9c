"""Whole commands, composed of operators: ingest, verify, status, doctor, queries, stats, clean, retry and resume."""

from __future__ import annotations

import datetime as dt
import json
import os
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import media, xmp
from ..functions.formats import SIDECARS, Registry
from ..functions.hashing import digest_by_format, file_digest
from ..functions.paths import DEFAULT_TEMPLATE, extension, is_temporary, parse_copyright
from ..operators import catalog, doctor, ledger, sidecars
from ..settings import LOCAL
from ..sources import ledger as ledger_files
from ..sources import tree as trees
from ..sources.store import Store, folder_size
from ..streaming import log as event_log
from ..workdir import numbered, tables
from . import execute, ingest, verify
from .progress import Observed

LEDGER, IGNORE = ".stratalog-ledger.jsonl", ".stratalogignore"
ALWAYS = (LEDGER, IGNORE, LOCAL)


@dataclass
class IngestOptions:
    algorithm: str = "sha1"
    recursive: bool = True
    since: dt.date | None = None
    before: dt.date | None = None
    skip_duplicates: bool = False
    dry_run: bool = False
    ledger: bool = True
    carry_sidecars: bool = True
    overwrite_sidecar_tags: bool = False
    template: str = DEFAULT_TEMPLATE
    language: str = "en"
    copyright: str = ""
    owner: str = ""
    ignore: list[str] = field(default_factory=list)
    registry: Registry = field(default_factory=Registry)
    #: Folder of the event log that progress is appended to; none without it.
    events: str | None = None
    #: Paths to take, ``(path)``; all others are left alone.
    only: DataFrame | None = None


def _now() -> dt.datetime:
    return dt.datetime.now(dt.UTC).replace(tzinfo=None, microsecond=0)


def _source(spark: SparkSession, source: str, options: IngestOptions) -> DataFrame:
    tree = trees.walk_tree(spark, source, recursive=options.recursive, scopefile=IGNORE, prune=options.ignore)
    rows = trees.classified(tree, options.registry, ignore=options.ignore, always=ALWAYS, carry_sidecars=options.carry_sidecars)
    return rows.join(options.only, "path", "left_semi") if options.only is not None else rows


def run_ingest(spark: SparkSession, store: Store, source: str, archive: str, options: IngestOptions | None = None) -> dict:
    """Take a source tree into an archive; returns the run's id and counters. A dry run plans and writes nothing."""
    options = options or IngestOptions()
    started, run_id = _now(), str(uuid.uuid4())
    stamp = f"{started:%Y%m%d_%H%M%S}"
    rows = _source(spark, source, options)
    found = rows.where("reason is null and format != 'sidecar'")
    kinds = options.registry.by_name()
    hooks = {k: f.digest for k, f in kinds.items() if f.digest}
    digest = digest_by_format(hooks)(F.col("path"), F.lit(options.algorithm), F.col("format")) if hooks else file_digest(F.col("path"), F.lit(options.algorithm))
    dated = found.select(
        "path", "rel_path", "dir", "name", F.col("path").alias("source_path"), "ext", "length", "format",
        media.captured_in(F.col("format"), F.col("path"), options.registry).alias("capture_date"), digest.alias("checksum"),
    )
    table = tables(spark, "ingest")  # neither a lost executor nor the catalogue's growth changes what was decided
    dated = table("dated", dated.withColumn("error", F.when(F.col("checksum").isNull(), F.lit("open hashable reader: the file can't be read"))))
    tell = lambda rows: event_log.append(event_log.of_files(rows, _now()), options.events) if options.events and not options.dry_run else None
    ids = store.files.agg(F.coalesce(F.max("id"), F.lit(0)).alias("n")).collect()[0]["n"]
    numbered_ = table("numbered", numbered(table, dated, ["rel_path"]).withColumn("id", F.col("seq") + 1 + ids))
    unknown = F.lit(None).cast("string")
    tell(numbered_.select("id", F.col("rel_path").alias("path"), "checksum", F.col("length").alias("bytes_total"), F.lit(None).cast("bigint").alias("bytes_copied"), unknown.alias("ended"), unknown.alias("message")))
    plan = ingest.planned(numbered_, store.files, stamp, options.algorithm, options.template, options.language, options.since, options.before, options.skip_duplicates)
    found_sidecars = rows.where("format = 'sidecar'").select("path", "dir", "name")
    attached = sidecars.attached_on_ingest(numbered_, found_sidecars)
    of_media = attached.where("media_path is not null").groupBy(F.col("media_path").alias("path")).agg(F.array_sort(F.collect_list("path")).alias("sidecars"))
    date = F.col("capture_date")
    rights = parse_copyright(options.copyright).column(date, None, options.language) if options.copyright else F.lit("")
    plan = plan.join(of_media, "path", "left").withColumns({"sidecars": F.coalesce("sidecars", F.array().cast("array<string>")), "packet": F.when(F.col("format").isin(*(k for k, f in kinds.items() if f.tags == "sidecar")), xmp.packet(rights, F.lit(options.owner))), "rights": rights, "owner": F.lit(options.owner)})
    skipped = rows.where("reason is not null").select("path", "rel_path", "reason").unionByName(sidecars.orphans(attached).join(rows.select("path", "rel_path"), "path").select("path", "rel_path", "reason"))
    plan = table("plan", plan)
    n_skipped = skipped.count()
    if options.dry_run:
        counts = ingest.counters(plan).collect()[0].asDict()
        return {"run_id": run_id, **counts, "skipped": counts["skipped"] + n_skipped, "plan": plan}

    copied = Observed()
    attempt = lambda rows: copied.watch("copy", execute.executed(rows, archive, options.algorithm, options.overwrite_sidecar_tags, kinds), execute.counters())
    plan, done = ingest.settled(plan, attempt, table)
    counts = ingest.counters(plan).collect()[0].asDict()
    counts["skipped"] += n_skipped
    counts |= {f"{k}_observed": v for k, v in copied.totals("copy").items()}
    result = plan.join(done, "id", "left").withColumns({
        "final": F.coalesce("status", F.when(F.col("outcome") == "error", "failed").when(F.col("outcome") == "skip", "skipped").otherwise("complete")),
        "problem": F.coalesce(done["error"], plan["error"]),
    })
    ended = F.when(F.col("final").isin("failed", "mismatch"), "error").when(F.col("final") == "skipped", "skip").otherwise(F.when(F.col("is_duplicate"), "duplicate").otherwise("complete"))
    tell(result.select("id", F.col("rel_path").alias("path"), unknown.alias("checksum"), F.col("length").alias("bytes_total"), F.col("copied_bytes").alias("bytes_copied"), ended.alias("ended"), F.coalesce("problem", "reason").alias("message")))
    at = F.lit(_now()).cast("timestamp_ntz")
    taken = F.col("final") == "complete"
    new = result.select(
        "id", F.lit(run_id).alias("run_id"), "source_path", F.when(F.col("dest_rel").isNotNull(), F.concat(F.lit(archive + "/"), "dest_rel")).alias("dest_path"), "dest_rel", "checksum",
        F.lit(options.algorithm).alias("algorithm"), F.when(F.col("outcome") == "skip", F.col("reason")).alias("skip_reason"), F.col("final").alias("status"), "is_duplicate", "capture_date",
        F.col("length").alias("file_size"), at.alias("extracted_at"), at.alias("hashed_at"), F.when(taken, at).alias("copied_at"), F.when(taken, at).alias("verified_at"),
        F.lit(None).cast("timestamp_ntz").alias("tagged_at"), F.col("problem").alias("error"), F.coalesce("carried", F.array().cast("array<string>")).alias("carried_sidecars"),
    )
    run = spark.createDataFrame([(run_id, "1", os.path.abspath(source), os.path.abspath(archive), options.algorithm, 0, options.recursive, started, _now(), "completed")], store.runs.schema)
    store.append("files", new)
    store.append("runs", run)
    counts["errors"] = result.where(F.col("final").isin("failed", "mismatch")).count()
    if options.ledger:
        head = {"version": 4, "run_id": run_id, "run": started.isoformat() + "Z", "algorithm": options.algorithm, "destination": archive, "recursive": options.recursive}
        lines = result.select("rel_path", F.when(F.col("final").isin("failed", "mismatch"), "error").otherwise(F.col("outcome")).alias("status"), "checksum", F.col("dest_rel").alias("destination"), "matches", F.coalesce("problem", "reason").alias("reason"), "carried")
        lines = lines.unionByName(skipped.select("rel_path", F.lit("skip").alias("status"), "reason"), allowMissingColumns=True)
        with ledger_files.LedgerWriter(os.path.join(source, LEDGER), head) as writer:
            for r in lines.orderBy("rel_path").toLocalIterator():
                writer.write({"path": r["rel_path"], "status": r["status"], "checksum": r["checksum"], "destination": r["destination"], "matches": r["matches"], "reason": r["reason"], "sidecars": r["carried"] or None})
    return {"run_id": run_id, **counts}


def run_verify(spark: SparkSession, archive: str, default: str = "sha1") -> DataFrame:
    """Every visible file of an archive with its status; see ``verify.whole_tree``."""
    rows = trees.classified(trees.walk_tree(spark, archive).where(~F.col("name").startswith(".")))
    return verify.whole_tree(rows.select("path", "dir", "name", "format"), verify.verified_files, default)


def run_status(spark: SparkSession, source: str, recursive: bool = True, ignore: list[str] | None = None) -> DataFrame:
    tree = trees.classified(trees.walk_tree(spark, source, recursive=recursive, scopefile=IGNORE, prune=ignore or []), ignore=ignore, always=ALWAYS, carry_sidecars=False)
    lines = ledger_files.read_ledger(spark, os.path.join(source, LEDGER))
    if lines is None:
        lines = ledger_files.parsed(spark.createDataFrame([], "ledger string, seq bigint, value string"))
    fold = ledger.folded(ledger.entries(lines).drop("ledger"))
    found = tree.select(F.col("rel_path").alias("path"), "reason")
    return ledger.source_status(found.where("reason is null"), found.where("reason is not null"), fold)


def run_doctor(spark: SparkSession, store: Store | None = None, source: str | None = None, run_prefix: str | None = None) -> DataFrame:
    """Report of the last ledger run of a source, or with a store of one run: the named one, else the source's or the latest."""
    if store is None:
        if run_prefix:
            raise ValueError("a run needs a catalogue")
        lines = ledger_files.read_ledger(spark, os.path.join(source, LEDGER))
        if lines is None:
            raise FileNotFoundError(f"no ledger in {source}")
        rows = ledger.latest_entries(ledger.with_runs(lines)).select("path", "status", F.col("reason").alias("message"))
        return doctor.report_counts(rows)
    if run_prefix:
        run_id = catalog.resolve_run(store.runs, run_prefix)
    else:
        latest = (catalog.latest_run(store.runs, source).collect() if source else []) or catalog.latest_run(store.runs).collect()
        if not latest:
            raise LookupError("no finished run")
        run_id = latest[0]["id"]
    return doctor.report_counts(doctor.problem_entries(catalog.errors(store.files, store.runs, run_id), catalog.skipped(store.files, run_id), catalog.duplicates(store.files, run_id)))


def run_stats(store: Store) -> dict[str, DataFrame]:
    files, runs = store.files, store.runs
    return {"stats": catalog.archive_stats(files, runs), "formats": catalog.format_shares(files), "last_run": catalog.last_run_date(runs)}


def run_clean(spark: SparkSession, archive: str, store: Store | None = None, dry_run: bool = False) -> dict:
    """Remove leftover temporary files and orphaned sidecars; compact the catalogue unless a run is active."""
    tree = trees.walk_tree(spark, archive, dotdirs=True).select("path", "name")
    paths = lambda df: (r["path"] for r in df.select("path").toLocalIterator())
    out = {
        "temporary": execute.cleaned(paths(tree.where(is_temporary(F.col("name"), execute.TEMPORARY))), dry_run),
        "orphans": execute.cleaned(paths(sidecars.orphaned_in_archive(tree)), dry_run), "compacted": False, "size_before": None, "size_after": None,
    }
    if store is not None and not dry_run and not catalog.has_active_runs(store.runs).collect()[0]["active"]:
        out["size_before"] = folder_size(store.path)
        store.compact()
        out |= {"compacted": True, "size_after": folder_size(store.path)}
    return out


def clean_summary(out: dict) -> str:
    """What a clean did in one line; counts of nothing are left out."""
    plural = lambda n, word: f"{n} {word}{'' if n == 1 else 's'}"
    done = [plural(out[k]["removed"], word) for k, word in (("temporary", "temp file"), ("orphans", "orphaned sidecar")) if out[k]["removed"]]
    errors = out["temporary"]["errors"] + out["orphans"]["errors"]
    parts = ["Cleaned " + ", ".join(done) if done else "No orphaned files found"]
    parts += [plural(errors, "removal error")] if errors else []
    parts += [f"Reclaimed {out['size_before'] - out['size_after']} B from the catalogue"] if out["compacted"] else []
    return " | ".join(parts)


def run_retry(spark: SparkSession, store: Store, archive: str, run_prefix: str | None = None, options: IngestOptions | None = None) -> dict:
    """Ingest the failed files of a run again, with that run's algorithm, where they still exist."""
    run = store.runs.where(F.col("id") == catalog.resolve_run(store.runs, run_prefix)) if run_prefix else catalog.latest_run(store.runs)
    row = run.collect()[0]
    options = options or IngestOptions()
    bad = catalog.errors(store.files, store.runs, row["id"])
    there = trees.walk_tree(spark, row["source"], recursive=True).select("path")
    kept = catalog.retryable(bad, there, ~F.lower(extension(F.col("source_path"))).isin(*SIDECARS))
    only = kept.select(F.col("source_path").alias("path")).distinct()
    options.algorithm, options.only = row["algorithm"], tables(spark, "retry")("only", only)  # the run itself appends to the catalogue
    return run_ingest(spark, store, row["source"], archive, options)


def run_resume(spark: SparkSession, store: Store, options: IngestOptions | None = None) -> dict:
    """Ingest the newest interrupted run's source again under a fresh id, and mark the old run as interrupted."""
    found = catalog.latest_interrupted(store.runs).collect()
    if not found:
        raise LookupError("no interrupted run")
    row = found[0]
    options = options or IngestOptions()
    options.algorithm, options.recursive = row["algorithm"], row["recursive"]
    out = run_ingest(spark, store, row["source"], row["destination"], options)
    interrupt(store, row["id"])
    return out


def interrupt(store: Store, run_id: str) -> None:
    """Mark a run that will not finish."""
    store.finish_run(run_id, "interrupted", _now())


def as_json(name: str, archive: str, results: DataFrame, summary: DataFrame | None = None) -> str:
    """Envelope of a query's results."""
    plain = [json.loads(r) for r in results.toJSON().collect()]
    total = json.loads(summary.toJSON().collect()[0]) if summary is not None else {"count": len(plain)}
    return json.dumps({"query": name, "dir": archive, "results": plain, "summary": total}, ensure_ascii=False)


def as_table(results: DataFrame) -> str:
    """Text table: columns as wide as their longest value in bytes, two spaces apart."""
    rows = [results.columns] + [["" if v is None else str(v) for v in r] for r in results.collect()]
    widths = [max(len(x[k].encode()) for x in rows) for k in range(len(results.columns))]
    return "\n".join("  ".join(v + " " * (w - len(v.encode())) for v, w in zip(r, widths, strict=True)).rstrip() for r in rows)


def as_list(results: DataFrame) -> list[str]:
    return [r["source_path"] for r in results.select("source_path").toLocalIterator()]

