"""Settings of a command: a general file, a source's own file and what the command line says."""

from __future__ import annotations

import json
import os

LOCAL = ".stratalog.json"


def read(path: str) -> dict:
    """A JSON object of settings; none if the file is missing."""
    try:
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
    except FileNotFoundError:
        return {}
    if not isinstance(found, dict):
        raise ValueError(f"{path}: settings must be an object")
    return found


def merged(general: dict, local: dict, given: frozenset[str] = frozenset()) -> dict:
    """``general`` under ``local``: ignore lists are joined, alias maps united with the local one winning, and any other
    setting is the local one's unless the command line has ``given`` it."""
    out = dict(general)
    for key, value in local.items():
        if key == "ignore":
            out[key] = [*general.get(key, []), *value]
        elif key == "aliases":
            out[key] = {**general.get(key, {}), **value}
        elif key not in given:
            out[key] = value
    return out


def of_source(source: str | None, general_path: str | None = None, given: frozenset[str] = frozenset()) -> dict:
    general = read(general_path) if general_path else {}
    return merged(general, read(os.path.join(source, LOCAL)) if source else {}, given)
