"""Diagnosis of problem files: ordered rules over status and message, and the grouped report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    category: str
    section: str
    severity: str
    statuses: tuple[str, ...]
    patterns: tuple[str, ...]


_FAILED, _SKIPPED = ("error", "failed"), ("skip", "skipped")

#: The rules in order; a message fits if it holds one of the patterns, whatever its case.
RULES = (
    Rule("Corrupted metadata", "errors", "actionable", _FAILED, ("extract date:",)),
    Rule("Corrupt file structure", "errors", "actionable", _FAILED, ("open hashable reader:", "hash payload:")),
    Rule("Disk or permission error", "errors", "actionable", _FAILED, ("permission denied", "input/output error", "no such file", "no space left", "read ", "write ")),
    Rule("Copy failure", "errors", "actionable", _FAILED, ("copy:",)),
    Rule("Integrity mismatch", "errors", "actionable", ("mismatch", "error"), ("verify:",)),
    Rule("Tag injection failed", "errors", "actionable", ("tag_failed", "error"), ("tag ",)),
    Rule("Database error", "errors", "actionable", _FAILED, ("dedup check:", "complete with dedup check:", "promote:", "relocate")),
    Rule("Unsupported format", "skipped", "informational", _SKIPPED, ("unsupported format:",)),
    Rule("Previously imported", "skipped", "informational", _SKIPPED, ("previously imported",)),
    Rule("Outside date range", "skipped", "informational", _SKIPPED, ("outside date range:",)),
    Rule("Symbolic link", "skipped", "informational", _SKIPPED, ("symlink",)),
    Rule("Hidden file", "skipped", "informational", _SKIPPED, ("dotfile",)),
    Rule("Detection error", "skipped", "actionable", _SKIPPED, ("detection error:",)),
    Rule("Unexpected error", "errors", "actionable", ("error", "failed", "mismatch", "tag_failed"), ("",)),
)


def rule_order(status: Column, message: Column) -> Column:
    """Number from 1 of the first rule that fits; null for none."""
    text = F.lower(F.coalesce(message, F.lit("")))
    out = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(RULES, 1))):
        fits = F.lit(False)
        for p in rule.patterns:
            fits = fits | text.contains(p)
        out = F.when(status.isin(*rule.statuses) & fits, F.lit(k)).otherwise(out)
    return out


def _of_rule(order: Column, field: str) -> Column:
    return F.element_at(F.array(*(F.lit(getattr(r, field)) for r in RULES)), order)


def classified(rows: DataFrame, status: str = "status", message: str = "message") -> DataFrame:
    """``rows`` with ``rule_order``, ``category``, ``section`` and ``severity``; all null where no rule fits."""
    out = rows.withColumn("rule_order", rule_order(F.col(status), F.col(message)))
    return out.withColumns({f: _of_rule(F.col("rule_order"), f) for f in ("category", "section", "severity")})


def problem_entries(errors: DataFrame, skipped: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Bag union ``(path, status, message)``: a duplicate in an error status is there twice."""
    part = lambda df, status, message: df.select(F.col("source_path").alias("path"), status.alias("status"), message.alias("message"))
    return (
        part(errors, F.col("status"), F.col("error"))
        .unionByName(part(skipped, F.lit("skip"), F.col("skip_reason")))
        .unionByName(part(duplicates, F.lit("duplicate"), F.lit(None).cast("string")))
    )


def report(rows: DataFrame) -> DataFrame:
    """A row per problem file: its path and the order, section, category and severity of its rule.

    Successes, duplicates and entries that no rule fits are left out; ``duplicate_count`` has the duplicates.
    """
    found = classified(rows.where(~F.col("status").isin("copy", "complete", "duplicate"))).where("rule_order is not null")
    return found.select("rule_order", "section", "category", "severity", "path")


def report_counts(rows: DataFrame) -> DataFrame:
    """How many files each category has, in rule order."""
    return report(rows).groupBy("rule_order", "section", "category", "severity").agg(F.count("*").alias("files")).orderBy("rule_order")


def duplicate_count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if(F.col("status") == "duplicate").alias("duplicates"))
