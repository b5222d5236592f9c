"""XMP sidecars: rendering a packet, and merging tags into an existing one."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import xml_escape

#: The packet's parts and namespaces as readers expect them.
HEAD = '<?xpacket begin="﻿" id="W5M0MpCehiHzreSzNTczkc9d"?>\n<x:xmpmeta xmlns:x="adobe:ns:meta/">\n  <rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">\n    <rdf:Description rdf:about=""'
TAIL = '\n    </rdf:Description>\n  </rdf:RDF>\n</x:xmpmeta>\n<?xpacket end="w"?>\n'
NAMESPACES = {"dc": "http://purl.org/dc/elements/1.1/", "xmpRights": "http://ns.adobe.com/xap/1.0/rights/", "aux": "http://ns.adobe.com/exif/1.0/aux/"}
RIGHTS = ("<dc:rights>\n        <rdf:Alt>\n          <rdf:li xml:lang=\"x-default\">", "</rdf:li>\n        </rdf:Alt>\n      </dc:rights>")
MARKED = "<xmpRights:Marked>True</xmpRights:Marked>"
OWNER = ("<aux:OwnerName>", "</aux:OwnerName>")


def _declared(prefix: str) -> str:
    return f'\n      xmlns:{prefix}="{NAMESPACES[prefix]}"'


def packet(rights: Column, owner: Column) -> Column:
    """A packet with the tags that are not empty; null if both are (nothing to write)."""
    has_rights, has_owner = F.coalesce(rights, F.lit("")) != "", F.coalesce(owner, F.lit("")) != ""
    text = F.concat(
        F.lit(HEAD),
        F.when(has_rights, F.lit(_declared("dc") + _declared("xmpRights"))).otherwise(F.lit("")),
        F.when(has_owner, F.lit(_declared("aux"))).otherwise(F.lit("")),
        F.lit(">"),
        F.when(has_rights, F.concat(F.lit("\n      " + RIGHTS[0]), xml_escape(rights), F.lit(RIGHTS[1] + "\n      " + MARKED))).otherwise(F.lit("")),
        F.when(has_owner, F.concat(F.lit("\n      " + OWNER[0]), xml_escape(owner), F.lit(OWNER[1]))).otherwise(F.lit("")),
        F.lit(TAIL),
    )
    return F.when(has_rights | has_owner, text)


_ESCAPES = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&apos;"})


def _with_element(content: str, pattern: str, element: str, prefixes: tuple[str, ...], overwrite: bool) -> str:
    """``content`` with one element set: an existing one is kept unless ``overwrite``, a missing one goes to the end."""
    present = re.search(pattern, content, re.DOTALL)
    if present:
        return content[: present.start()] + element + content[present.end() :] if overwrite else content
    end = content.rfind("</rdf:Description>")
    if end < 0:
        return content
    content = content[:end] + "      " + element + "\n    " + content[end:]
    for prefix in prefixes:
        if f'xmlns:{prefix}="' not in content:
            content = re.sub(r"(<rdf:Description\b[^>]*?)(/?>)", lambda m, p=prefix: m[1] + _declared(p) + m[2], content, count=1)
    return content


def merged_text(content: str, rights: str, owner: str, overwrite: bool) -> str:
    """An existing packet with the tags set; text without a description element comes back unchanged."""
    if "</rdf:Description>" not in content:
        return content
    if rights:
        content = _with_element(content, r"<dc:rights>.*?</dc:rights>", RIGHTS[0] + rights.translate(_ESCAPES) + RIGHTS[1], ("dc",), overwrite)
        content = _with_element(content, r"<xmpRights:Marked>.*?</xmpRights:Marked>", MARKED, ("xmpRights",), overwrite)
    if owner:
        content = _with_element(content, r"<aux:OwnerName>.*?</aux:OwnerName>", OWNER[0] + owner.translate(_ESCAPES) + OWNER[1], ("aux",), overwrite)
    return content


def merged(content: Column, rights: Column, owner: Column, overwrite: bool = False) -> Column:
    @F.pandas_udf("string")
    def merge(c: pd.Series, r: pd.Series, o: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else merged_text(x, y or "", z or "", overwrite) for x, y, z in zip(c, r, o, strict=True)], dtype=object)

    return merge(content, rights, owner)
