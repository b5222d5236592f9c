"""The stage with side effects: copy, verify, promote and sidecars, one task per partition of the plan.

Every step can run again: a copy goes to a temporary name and is renamed once it has been verified, so a retried task
finds either nothing, a leftover it overwrites, or the finished file.
"""

from __future__ import annotations

import os
import shutil
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formats import Format
from ..functions.hashing import file_hash
from ..functions.xmp import merged_text
from ..sources.store import replace_text

TEMPORARY = ".stratalog-tmp"
RESULT = "id bigint, status string, error string, copied_bytes bigint, carried array<string>"


def _synced(path: str) -> None:
    with open(path, "rb") as f:
        os.fsync(f.fileno())


def copy_file(source: str, dest: str, checksum: str, algorithm: str, digest: Callable[[str, str], str] = file_hash) -> tuple[str, str | None, int]:
    """(status, error, bytes). The source's modification time is kept; a wrong copy is removed."""
    temporary = os.path.join(os.path.dirname(dest), f".{os.path.basename(dest)}{TEMPORARY}")
    try:
        os.makedirs(os.path.dirname(dest), exist_ok=True)
        shutil.copyfile(source, temporary)
        _synced(temporary)
        shutil.copystat(source, temporary)
    except OSError as e:
        return "failed", f"copy: {e}", 0
    try:
        actual = digest(temporary, algorithm)
        if actual != checksum:
            os.remove(temporary)
            return "mismatch", f"verify: checksum {actual}, expected {checksum}", 0
        size = os.path.getsize(temporary)
        os.replace(temporary, dest)
    except OSError as e:
        return "failed", f"promote: {e}", 0
    return "complete", None, size


def copy_sidecars(sidecars: list[str], dest: str) -> list[str]:
    """Sidecars beside their media file, under its new name; returns the extensions that were carried."""
    done = []
    for path in sidecars:
        ext = os.path.splitext(path)[1].lower()
        try:
            shutil.copyfile(path, dest + ext)
            _synced(dest + ext)
            shutil.copystat(path, dest + ext)
            done.append(ext)
        except OSError:
            continue
    return done


def tag(dest: str, carried: list[str], packet: str | None, rights: str, owner: str, overwrite: bool, embed: Callable[[str, str, str], None] | None = None) -> str | None:
    """Tags inside a media file by ``embed``, or beside a media file: merged into its carried XMP sidecar, else a packet of its own. Returns what went wrong."""
    try:
        if embed:
            if rights or owner:
                embed(dest, rights, owner)
        elif ".xmp" in carried and (rights or owner):
            with open(dest + ".xmp", encoding="utf-8") as f:
                old = f.read()
            new = merged_text(old, rights, owner, overwrite)
            if new != old:
                replace_text(dest + ".xmp", new)
        elif packet and ".xmp" not in carried:
            replace_text(dest + ".xmp", packet)
    except (OSError, UnicodeDecodeError) as e:
        return f"tag {dest}: {e}"
    return None


def executed(plan: DataFrame, archive: str, algorithm: str = "sha1", overwrite_tags: bool = False, formats: dict[str, Format] | None = None) -> DataFrame:
    """``RESULT`` for the rows of ``plan`` that have a ``dest_rel``; ``sidecars``, ``packet``, ``rights``, ``owner`` and ``format`` may be missing.

    What is copied is verified by the format's own digest, if it has one; a format that keeps tags in the file writes them there.
    """
    defaults = {"sidecars": F.array().cast("array<string>"), "packet": F.lit(None).cast("string"), "rights": F.lit(""), "owner": F.lit(""), "format": F.lit(None).cast("string")}
    own = formats or {}
    rows = plan.withColumns({k: v for k, v in defaults.items() if k not in plan.columns}).where("dest_rel is not null").select("id", "source_path", "dest_rel", "checksum", *defaults)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for r in part.itertuples(index=False):
                dest = os.path.join(archive, r.dest_rel)
                kind = own.get(r.format)
                status, error, size = copy_file(r.source_path, dest, r.checksum, algorithm, kind.digest if kind and kind.digest else file_hash)
                carried = copy_sidecars(list(r.sidecars), dest) if status == "complete" else []
                if status == "complete":
                    error = tag(dest, carried, r.packet, r.rights or "", r.owner or "", overwrite_tags, kind.write_tags if kind and kind.tags == "embed" else None)
                out.append((r.id, status, error, size, carried))
            yield pd.DataFrame(out, columns=["id", "status", "error", "copied_bytes", "carried"])

    return rows.mapInPandas(run, RESULT)


def counters() -> dict[str, Column]:
    """What is observed of a copy stage while it runs."""
    return {"files": F.count("*"), "bytes": F.sum("copied_bytes"), "failed": F.count_if(F.col("status") != "complete")}


def cleaned(paths: Iterable[str], dry_run: bool = False) -> dict[str, int]:
    """Remove files; counts of removed files, errors and bytes."""
    out = {"removed": 0, "errors": 0, "bytes": 0}
    for path in paths:
        try:
            size = os.path.getsize(path)
            if not dry_run:
                os.remove(path)
            out["removed"] += 1
            out["bytes"] += size
        except OSError:
            out["errors"] += 1
    return out
