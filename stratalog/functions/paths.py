"""Paths, file names and path templates as Column expressions; templates are parsed once, on the driver."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashing import algorithm_id, algorithm_name

DEFAULT_TEMPLATE = "{year}/{month}-{monthname}"
PATH_TOKENS = frozenset({"year", "month", "monthname", "day", "hour", "minute", "second", "ext"})
COPYRIGHT_TOKENS = frozenset({"year", "month", "monthname", "day"})
FORBIDDEN = ':*?"<>|'

#: Month abbreviations by language; English stands in for the others.
MONTHS = {
    "en": "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec",
    "fr": "Jan Fév Mar Avr Mai Jun Jul Aoû Sep Oct Nov Déc",
    "de": "Jan Feb Mär Apr Mai Jun Jul Aug Sep Okt Nov Dez",
    "es": "Ene Feb Mar Abr May Jun Jul Ago Sep Oct Nov Dic",
    "it": "Gen Feb Mar Apr Mag Giu Lug Ago Set Ott Nov Dic",
    "pt": "Jan Fev Mar Abr Mai Jun Jul Ago Set Out Nov Dez",
    "nl": "Jan Feb Mrt Apr Mei Jun Jul Aug Sep Okt Nov Dec",
    "ja": "1月 2月 3月 4月 5月 6月 7月 8月 9月 10月 11月 12月",
    "zh": "1月 2月 3月 4月 5月 6月 7月 8月 9月 10月 11月 12月",
    "ko": "1월 2월 3월 4월 5월 6월 7월 8월 9월 10월 11월 12월",
    "ru": "Янв Фев Мар Апр Май Июн Июл Авг Сен Окт Ноя Дек",
}


def month_name(date: Column, language: str = "en") -> Column:
    names = MONTHS.get(language, MONTHS["en"]).split()
    return F.element_at(F.array(*(F.lit(n) for n in names)), F.month(date))


def detect_language(env: dict[str, str] | None = None) -> str:
    """Language of the first of LANGUAGE, LC_ALL, LC_TIME, LANG that names one; C and POSIX don't."""
    env = dict(os.environ) if env is None else env
    for name in ("LANGUAGE", "LC_ALL", "LC_TIME", "LANG"):
        value = env.get(name, "").split(":")[0].split(".")[0].split("@")[0]
        if value and value not in ("C", "POSIX"):
            return re.split("[_-]", value)[0].lower()
    return "en"


class TemplateError(ValueError):
    pass


@dataclass(frozen=True)
class Template:
    """Literals and tokens in order."""

    parts: tuple[tuple[str, bool], ...]

    def column(self, date: Column, ext: Column | None = None, language: str = "en") -> Column:
        tokens = {
            "year": F.date_format(date, "yyyy"), "month": F.date_format(date, "MM"), "monthname": month_name(date, language), "day": F.date_format(date, "dd"),
            "hour": F.date_format(date, "HH"), "minute": F.date_format(date, "mm"), "second": F.date_format(date, "ss"),
            "ext": F.lit("") if ext is None else F.regexp_replace(F.lower(ext), r"^\.", ""),
        }
        return F.concat(*(tokens[text] if is_token else F.lit(text) for text, is_token in self.parts))


def _scan(raw: str, tokens: frozenset[str]) -> Template:
    parts, rest = [], raw
    while rest:
        literal, brace, tail = re.match(r"([^{}]*)([{}]?)(.*)", rest, re.DOTALL).groups()
        if literal:
            parts.append((literal, False))
        if brace == "}":
            raise TemplateError(f"template {raw!r}: '}}' without '{{'")
        if not brace:
            break
        name, closing, rest = re.match(r"([^{}]*)([{}]?)(.*)", tail, re.DOTALL).groups()
        if closing != "}":
            raise TemplateError(f"template {raw!r}: " + ("nested '{'" if closing else "unclosed '{'"))
        if not name:
            raise TemplateError(f"template {raw!r}: empty token")
        if name not in tokens:
            raise TemplateError(f"template {raw!r}: unknown token {{{name}}}")
        parts.append((name, True))
    return Template(tuple(parts))


def parse_template(raw: str) -> Template:
    """A directory template: not empty, relative, no character that some platform forbids, no ``.`` or ``..`` component."""
    if not raw:
        raise TemplateError("template is empty")
    template = _scan(raw, PATH_TOKENS)
    if raw.startswith("/"):
        raise TemplateError(f"template {raw!r} is absolute")
    literals = "".join(text for text, is_token in template.parts if not is_token)
    if bad := [c for c in literals if c in FORBIDDEN or c == "\0"]:
        raise TemplateError(f"template {raw!r}: character {bad[0]!r} is not allowed")
    expanded = "".join("x" if is_token else text for text, is_token in template.parts)
    if {".", ".."} & set(expanded.split("/")):
        raise TemplateError(f"template {raw!r}: '.' and '..' are not allowed")
    return template


def parse_copyright(raw: str) -> Template:
    """A text template with date tokens only and no rules on paths."""
    return _scan(raw, COPYRIGHT_TOKENS)


def extension(path: Column) -> Column:
    """From the last dot of the last component, with ``/`` and ``\\`` as separators; a hidden file is all extension."""
    return F.when(path == ".", F.lit("")).otherwise(F.regexp_extract(path, r"(\.[^./\\]*)$", 1))


def run_stamp(started: Column) -> Column:
    return F.date_format(started, "yyyyMMdd_HHmmss")


def destination(date: Column, algorithm: str, checksum: Column, ext: Column, duplicate: Column, stamp: Column, template: str = DEFAULT_TEMPLATE, language: str = "en") -> Column:
    """``<dir>/<date>_<time>-<algorithm id>-<checksum><ext>``, under ``duplicates/<run stamp>/`` for a duplicate."""
    folder = parse_template(template).column(date, ext, language)
    name = F.concat(run_stamp(date), F.lit(f"-{algorithm_id(algorithm)}-"), checksum, F.lower(ext))
    path = F.concat_ws("/", folder, name)
    return F.when(duplicate, F.concat_ws("/", F.lit("duplicates"), stamp, path)).otherwise(path)


def parsed_name(name: Column) -> Column:
    """Struct ``(checksum, algorithm, ok)`` of a generated file name; ``algorithm`` is empty where the name can't tell.

    Names are ``<15 characters>-<id>-<checksum>`` or, older, ``<15 characters>_<checksum>``, with 8 or more checksum characters.
    """
    stem = F.when(name.contains("."), F.regexp_extract(name, r"^(.*)\.[^.]*$", 1)).otherwise(name)
    new = r"^.{15}-([0-9]+)-(.{8,})$"
    old = r"^.{15}_(.{8,})$"
    number = F.regexp_extract(stem, new, 1)
    known = algorithm_name(F.nullif(number, F.lit("")).try_cast("int"))
    tail = F.regexp_extract(stem, old, 1)
    by_length = F.when(F.length(tail) == 40, F.lit("sha1")).when(F.length(tail) == 64, F.lit("sha256")).otherwise(F.lit(""))
    none = F.struct(F.lit("").alias("checksum"), F.lit("").alias("algorithm"), F.lit(False).alias("ok"))
    return (
        F.when(stem.rlike(new) & (known != ""), F.struct(F.regexp_extract(stem, new, 2).alias("checksum"), known.alias("algorithm"), F.lit(True).alias("ok")))
        .when(stem.rlike(old), F.struct(tail.alias("checksum"), by_length.alias("algorithm"), F.lit(True).alias("ok")))
        .otherwise(none)
    )


def display_destination(label: Column, relative: Column) -> Column:
    return F.when(F.coalesce(label, F.lit("")) == "", relative).otherwise(F.concat_ws("/", label, relative))


def is_temporary(name: Column, marker: str) -> Column:
    return name.contains(marker)


def temporary_path(path: Column, marker: str) -> Column:
    """The name under which a copy is written before it is promoted: hidden, beside its destination."""
    folder, name = F.regexp_extract(path, r"^(.*/)?[^/]*$", 1), F.regexp_extract(path, r"([^/]*)$", 1)
    return F.concat(folder, F.lit("."), name, F.lit(marker))


def is_generated_sidecar(name: Column, current_names: bool = False) -> Column:
    """Sidecar names that the archive itself gives; ``current_names`` also takes ``-<id>-`` names, not only ``_`` ones."""
    pattern = r"^\d{8}_\d{6}_[0-9a-f]+\..+\.xmp$"
    if current_names:
        pattern = r"^\d{8}_\d{6}(_|-\d+-)[0-9a-f]+\..+\.xmp$"
    return name.rlike(pattern)


def resolve_alias(value: str, aliases: dict[str, str], home: str | None = None) -> str:
    """``+name`` to its path, with ``~`` expanded; other values as they are."""
    if not value.startswith("+"):
        return value
    name = value[1:]
    if name not in aliases:
        raise KeyError(f"unknown alias {name!r}; known: {', '.join(sorted(aliases)) or 'none'}")
    path = aliases[name]
    if path == "~" or path.startswith("~/"):
        path = (home or os.path.expanduser("~")) + path[1:]
    return path
