"""Display text: short ids, counts, sizes, durations, dates, annotations and XML escaping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DASH, DOTS = "—", "…"


def short_checksum(checksum: Column) -> Column:
    return F.when(F.coalesce(checksum, F.lit("")) == "", F.lit(DASH)).when(F.length(checksum) > 8, F.concat(F.left(checksum, F.lit(8)), F.lit(DOTS))).otherwise(checksum)


def short_id(value: Column) -> Column:
    return F.when(F.length(value) > 8, F.concat(F.left(value, F.lit(8)), F.lit(DOTS))).otherwise(value)


def with_commas(n: Column) -> Column:
    return F.format_number(n, 0)


def one_decimal(n: Column, unit: int) -> Column:
    """``n / unit`` with one decimal, rounded as C's printf rounds the quotient as a double.

    A tie is decided by where the double lies: 16 d - i and that plus 4 d are exact differences of nearby numbers, so
    their sum has the sign of 20 d - i.
    """
    n = n.cast("bigint")
    quotient = n / F.lit(unit)
    tenths, rest = F.floor(n * 10 / F.lit(unit)).cast("bigint"), F.pmod(n * 10, F.lit(unit))
    side = (quotient * 16.0 - (tenths * 2 + 1)) + quotient * 4.0
    up = F.when(rest * 2 == unit, (side > 0) | ((side == 0) & (tenths % 2 == 1))).otherwise(rest * 2 > unit)
    tenths = tenths + up.cast("bigint")
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def _scaled(n: Column, units: list[tuple[int, str]]) -> Column:
    out = None
    for size, unit in units:
        text = F.concat(one_decimal(n, size), F.lit(f" {unit}"))
        out = F.when(n >= size, text) if out is None else out.when(n >= size, text)
    return out.otherwise(F.format_string("%d B", n.cast("bigint")))


def decimal_size(n: Column) -> Column:
    return _scaled(n, [(10**9, "GB"), (10**6, "MB"), (10**3, "KB")])


def binary_size(n: Column) -> Column:
    return _scaled(n, [(1 << 30, "GB"), (1 << 20, "MB"), (1 << 10, "KB")])


def seconds_between(started: Column, finished: Column) -> Column:
    """Seconds as a double, never negative; null while unfinished."""
    micros = F.timestamp_diff("MICROSECOND", started, finished)
    return F.when(finished.isNotNull(), F.greatest(F.lit(0.0), micros / F.lit(1e6)))


def duration(started: Column, finished: Column) -> Column:
    """``0.8s``, ``23s``, ``1m 23s`` or ``1h 5m 12s``; a dash while unfinished."""
    exact = seconds_between(started, finished)
    whole = F.floor(exact).cast("bigint")
    h, m, s = (whole / 3600).cast("bigint"), ((whole % 3600) / 60).cast("bigint"), whole % 60
    return (
        F.when(exact.isNull(), F.lit(DASH))
        .when(exact < 1, F.concat(one_decimal(exact * 1e6, 1_000_000), F.lit("s")))
        .when(h > 0, F.format_string("%dh %dm %ds", h, m, s))
        .when(m > 0, F.format_string("%dm %ds", m, s))
        .otherwise(F.format_string("%ds", s))
    )


def day(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd"), F.lit(DASH))


def day_and_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def plural(word: str, n: Column) -> Column:
    return F.when(n == 1, F.lit(word)).otherwise(F.lit(word + "s"))


def counted(n: Column, word: str) -> Column:
    """``3 files``; null for none, so that joins of such parts leave it out."""
    return F.when(n > 0, F.concat_ws(" ", n.cast("string"), plural(word, n)))


def sidecar_note(extensions: Column) -> Column:
    """``" [+xmp +aae]"``, empty for no extensions."""
    marks = F.transform(extensions, lambda e: F.concat(F.lit("+"), F.regexp_replace(e, r"^\.(?=.)", "")))
    return F.when(F.coalesce(F.size(extensions), F.lit(0)) <= 0, F.lit("")).otherwise(F.concat(F.lit(" ["), F.array_join(marks, " "), F.lit("]")))


def sidecar_order(extensions: Column) -> Column:
    """Unique extensions, ``.xmp`` and ``.aae`` first, others as they came."""
    unique = F.array_distinct(extensions)
    first = F.filter(F.array(F.lit(".xmp"), F.lit(".aae")), lambda e: F.array_contains(unique, e))
    return F.concat(first, F.filter(unique, lambda e: ~e.isin(".xmp", ".aae")))


def outcome_line(verb: Column, source: Column, detail: Column) -> Column:
    return F.format_string("%s %s -> %s", verb, source, detail)


def xml_escape(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def wrap(text: str, indent: str, width: int) -> list[str]:
    """Greedy lines of at most ``width`` characters; a longer word stands alone."""
    lines, line = [], ""
    for word in text.split():
        if line and len(indent) + len(line) + 1 + len(word) > width:
            lines.append(indent + line)
            line = word
        else:
            line = f"{line} {word}" if line else word
    return [*lines, indent + line] if line else lines
