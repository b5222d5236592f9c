"""Ignore patterns: doublestar globs compiled to regular expressions on the driver."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(4096)
def to_regex(glob: str) -> str | None:
    """``*`` and ``?`` stay within a component, ``**`` spans any number of them; null for a malformed pattern."""
    out, i, braces = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**", i) and (i == 0 or glob[i - 1] == "/") and (i + 2 == len(glob) or glob[i + 2] == "/"):
            if i + 2 == len(glob):
                out.append(".*")
                i += 2
            else:
                out.append("(?:[^/]*/)*")
                i += 3
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[":
            end = glob.find("]", i + 2)
            if end < 0:
                return None
            body = glob[i + 1 : end].replace("\\", "\\\\")
            body = "^" + body[1:] if body[0] in "!^" else body
            out.append(f"(?!/)[{body}]")
            i = end
        elif c == "{":
            braces += 1
            out.append("(?:")
        elif c == "}" and braces:
            braces -= 1
            out.append(")")
        elif c == "," and braces:
            out.append("|")
        elif c == "\\":
            if i + 1 == len(glob):
                return None
            i += 1
            out.append(re.escape(glob[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return None if braces else "^" + "".join(out) + "$"


def cleaned(patterns: list[str]) -> list[str]:
    """Trimmed, without empties and repeats, in order."""
    return list(dict.fromkeys(p for p in (x.strip() for x in patterns) if p))


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def ignored_file(name: Column, relative: Column, patterns: list[str], always: tuple[str, ...] = ()) -> Column:
    """A file is ignored if a pattern fits its name or its relative path; patterns that end in ``/`` are for directories."""
    regexes = [r for p in cleaned(patterns) if not p.endswith("/") and (r := to_regex(p))]
    return _any([name.isin(*always)] if always else []) | _any([name.rlike(r) | relative.rlike(r) for r in regexes])


def ignored_directory(name: Column, relative: Column, patterns: list[str]) -> Column:
    """Only ``x/`` and ``x/**`` name directories."""
    tests = []
    for p in cleaned(patterns):
        base = p[:-1] if p.endswith("/") else p[:-3] if p.endswith("/**") else ""
        if base and (r := to_regex(base)):
            tests.append(name.rlike(r) | relative.rlike(r))
    return _any(tests)


def within_scope(relative: Column, scope: Column) -> Column:
    """The path below ``scope`` (empty: the root); null where it lies outside."""
    return F.when(F.coalesce(scope, F.lit("")) == "", relative).when(relative.startswith(F.concat(scope, F.lit("/"))), F.substr(relative, F.length(scope) + 2))


def _in_scopes(name: Column, relative: Column, scopes: dict[str, list[str]], fits) -> Column:
    """Whether patterns fit under their scope: the root's ("") or that of the folder whose ignore file gives them."""
    tests = []
    for scope, patterns in scopes.items():
        below = within_scope(relative, F.lit(scope))
        tests.append(below.isNotNull() & fits(name, below, patterns))
    return _any(tests)


def hidden_file(name: Column, relative: Column, scopes: dict[str, list[str]]) -> Column:
    return _in_scopes(name, relative, scopes, ignored_file)


def hidden_folder(name: Column, relative: Column, scopes: dict[str, list[str]]) -> Column:
    return _in_scopes(name, relative, scopes, ignored_directory)
