"""Directory trees as DataFrames, by a Python data source: hidden, empty and linked files are rows like others."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.formats import HEADER_BYTES, SIDECARS, Registry
from ..functions.globs import cleaned, ignored_file, to_regex
from ..functions.paths import extension
from ..workdir import tables

FORMAT = "stratalog_tree"
SCHEMA = "path string, rel_path string, dir string, name string, is_symlink boolean, length bigint, header binary, unreadable string, content binary"


class _Span(NamedTuple):
    """Files of one folder from ``first`` to ``last`` in lexical order, and the rules that hold there."""

    folder: str
    first: str
    last: str
    rules: tuple[tuple[str, str], ...]


class _Part(InputPartition):
    def __init__(self, spans: list[_Span]):
        super().__init__(0)
        self.spans = spans


def _fits(pattern: str, name: str, rel: str) -> bool:
    regex = to_regex(pattern)
    return regex is not None and (re.match(regex, name) is not None or re.match(regex, rel) is not None)


def _below(rel: str, scope: str) -> str | None:
    return rel if not scope else rel[len(scope) + 1 :] if rel.startswith(scope + "/") else None


def folder_ignored(rel: str, rules: Iterable[tuple[str, str]]) -> bool:
    """Whether a rule ``(scope, pattern)`` skips a folder: only ``x/`` and ``x/**`` name folders."""
    for scope, pattern in rules:
        base = pattern[:-1] if pattern.endswith("/") else pattern[:-3] if pattern.endswith("/**") else ""
        below = _below(rel, scope)
        if base and below is not None and _fits(base, os.path.basename(rel), below):
            return True
    return False


def file_ignored(rel: str, rules: Iterable[tuple[str, str]]) -> bool:
    """Whether a rule ``(scope, pattern)`` hides a file: by its name or by its path below the scope."""
    for scope, pattern in rules:
        below = _below(rel, scope)
        if below is not None and not pattern.endswith("/") and _fits(pattern, os.path.basename(rel), below):
            return True
    return False


def scope_rules(scope: str, text: str) -> tuple[tuple[str, str], ...]:
    """The rules of an ignore file: a trimmed pattern per line, without blank lines and comments."""
    return tuple((scope, p) for p in cleaned(text.split("\n")) if not p.startswith("#"))


def opened(root: str, rel: str, whole: bool = False) -> tuple:
    """A file's row of ``SCHEMA``: what can't be read says so, links aren't followed."""
    path = os.path.join(root, rel)
    linked, header, error, size, content = os.path.islink(path), None, None, None, None
    try:
        size = os.lstat(path).st_size
        if not linked:
            with open(path, "rb") as f:
                header = f.read(HEADER_BYTES)
                if whole:
                    content = header + f.read()
            if not header:
                error = "EOF"
    except OSError as e:
        error = e.strerror or str(e)
    return path, rel, os.path.dirname(rel), os.path.basename(rel), linked, size, header, error, content


class TreeReader(DataSourceReader):
    """Options: path, recursive, dotdirs (enter them), content (read bytes), files (a partition's files), prune (globs), scopefile.

    The driver walks the folders, reads their ignore files and cuts their files into spans; it holds one folder's names at a
    time. Tasks list the span again and open the files.
    """

    def __init__(self, options: dict):
        self.root = os.path.abspath(options["path"])
        flag = lambda k, default: str(options.get(k, default)).lower() == "true"
        self.recursive, self.dotdirs, self.content = flag("recursive", "true"), flag("dotdirs", "false"), flag("content", "false")
        self.per_part = int(options.get("files", "2000"))
        self.scope_file = options.get("scopefile", "")
        self.prune = tuple(("", p) for p in options.get("prune", "").split("\n") if p)

    def _spans(self) -> Iterator[tuple[int, _Span]]:
        stack = [("", self.prune)]
        while stack:
            rel, rules = stack.pop()
            folders, names = [], []
            if self.scope_file:
                try:
                    with open(os.path.join(self.root, rel, self.scope_file), encoding="utf-8", errors="replace") as f:
                        rules = rules + scope_rules(rel, f.read())
                except OSError:
                    pass
            with os.scandir(os.path.join(self.root, rel)) as entries:
                for e in entries:
                    path = f"{rel}/{e.name}" if rel else e.name
                    if not e.is_dir(follow_symlinks=False):
                        names.append(e.name)
                    elif self.recursive and (self.dotdirs or not e.name.startswith(".")) and not folder_ignored(path, rules):
                        folders.append((path, rules))
            names.sort()
            for i in range(0, len(names), self.per_part):
                part = names[i : i + self.per_part]
                yield len(part), _Span(rel, part[0], part[-1], rules)
            stack.extend(sorted(folders, reverse=True))

    def partitions(self) -> list[InputPartition]:
        parts, spans, size = [], [], 0
        for n, span in self._spans():
            if spans and size + n > self.per_part:
                parts.append(_Part(spans))
                spans, size = [], 0
            spans.append(span)
            size += n
        return [*parts, _Part(spans)]

    def _files(self, span: _Span) -> Iterator[str]:
        with os.scandir(os.path.join(self.root, span.folder)) as entries:
            names = sorted(e.name for e in entries if span.first <= e.name <= span.last and not e.is_dir(follow_symlinks=False))
        for name in names:
            rel = f"{span.folder}/{name}" if span.folder else name
            if not file_ignored(rel, span.rules):
                yield rel

    def read(self, partition: _Part) -> Iterator[tuple]:
        for span in partition.spans:
            for rel in self._files(span):
                yield opened(self.root, rel, self.content)


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def read_tree(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(TreeSource)
    reader = spark.read.format(FORMAT).option("path", path)
    for k, v in options.items():
        reader = reader.option(k, "\n".join(v) if isinstance(v, list) else str(v).lower() if isinstance(v, bool) else v)
    return reader.load()


#: What a listing finds: a file, or a folder with the rules that hold in it.
LISTED = "is_folder boolean, rel string, rules array<struct<scope: string, pattern: string>>"


def walk_tree(spark: SparkSession, path: str, recursive: bool = True, dotdirs: bool = False, content: bool = False, prune: list[str] | None = None, scopefile: str = "", files: int = 2000) -> DataFrame:
    """``read_tree`` for trees of many folders: they are listed by tasks, a level of the tree at a time, each folder once.

    A level's folders are a table, and so are the files found; the driver sees their numbers only. Each task then opens about
    ``files`` files. The folders must be there for all executors.
    """
    root, table = os.path.abspath(path), tables(spark, "walk")

    def listed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for folder, given in zip(part["rel"], part["rules"], strict=True):
                rules, found = tuple((r["scope"], r["pattern"]) for r in given), []
                if scopefile:
                    try:
                        with open(os.path.join(root, folder, scopefile), encoding="utf-8", errors="replace") as f:
                            rules += scope_rules(folder, f.read())
                    except OSError:
                        pass
                with os.scandir(os.path.join(root, folder)) as entries:
                    for e in entries:
                        rel = f"{folder}/{e.name}" if folder else e.name
                        if not e.is_dir(follow_symlinks=False):
                            if not file_ignored(rel, rules):
                                found.append((False, rel, None))
                        elif recursive and (dotdirs or not e.name.startswith(".")) and not folder_ignored(rel, rules):
                            found.append((True, rel, [{"scope": s, "pattern": p} for s, p in rules]))
                        if len(found) >= 10000:
                            yield pd.DataFrame(found, columns=["is_folder", "rel", "rules"])
                            found = []
                yield pd.DataFrame(found, columns=["is_folder", "rel", "rules"])

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for part in parts:
            for k in range(0, len(part), 64 if content else len(part)):
                yield pd.DataFrame([opened(root, rel, content) for rel in part["rel"][k : k + (64 if content else len(part))]], columns=names)

    folders = spark.createDataFrame([("", [("", p) for p in prune or []])], "rel string, rules array<struct<scope: string, pattern: string>>")
    levels, n, most = [], 1, 4 * spark.sparkContext.defaultParallelism
    while n:
        levels.append(table(f"level-{len(levels)}", folders.repartition(min(n, most)).mapInPandas(listed, LISTED)))
        folders = levels[-1].where("is_folder").select("rel", "rules")
        n = folders.count()
    found = reduce(DataFrame.unionByName, levels).where("not is_folder").select("rel")
    return found.repartition(max(1, -(-found.count() // files)), "rel").mapInPandas(read, SCHEMA)


def classified(tree: DataFrame, registry: Registry | None = None, ignore: list[str] | None = None, always: tuple[str, ...] = (), carry_sidecars: bool = True) -> DataFrame:
    """``tree`` with ``ext``, ``format`` and ``reason``; ignored files are gone.

    Reasons, the first that holds: symlink, dotfile, detection error, unsupported format. Sidecars have the format
    ``sidecar`` while they are carried.
    """
    registry = registry or Registry()
    rows = tree.where(~ignored_file(F.col("name"), F.col("rel_path"), ignore or [], always)).withColumn("ext", extension(F.col("name")))
    rows = rows.withColumn("detected", registry.detect(F.col("ext"), F.col("header")))
    return rows.withColumns({"format": F.when(F.lit(carry_sidecars) & F.lower("ext").isin(*SIDECARS), F.lit("sidecar")).otherwise(F.col("detected")), "reason": _reason(carry_sidecars)}).drop("detected")


def _reason(carry_sidecars: bool) -> Column:
    sidecar = F.lit(carry_sidecars) & F.lower("ext").isin(*SIDECARS)
    return (
        F.when(F.col("is_symlink"), F.lit("symlink"))
        .when(F.col("name").startswith("."), F.lit("dotfile"))
        .when(sidecar, F.lit(None).cast("string"))
        .when(F.col("unreadable").isNotNull(), F.concat(F.lit("detection error: "), F.col("unreadable")))
        .when(F.col("detected").isNull(), F.concat(F.lit("unsupported format: "), F.lower("ext")))
    )
