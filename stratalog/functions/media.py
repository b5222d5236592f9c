"""Readers of dates in media bytes, as vectorised UDFs. None of them raises: what can't be read has no date."""

from __future__ import annotations

import mmap
import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import dates
from .formats import Registry

DATE_TIME, EXIF_IFD, DATE_TIME_ORIGINAL = 0x0132, 0x8769, 0x9003
_ASCII, _LONG_TYPES = 2, {3: "H", 4: "I"}
Found = tuple[str | None, str | None]


def tiff_dates(data: bytes) -> Found:
    """(original, modified) date texts of a TIFF structure, from its first directory and the EXIF one."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8:
        return None, None

    def directory(at: int) -> dict[int, tuple[int, int, bytes]]:
        (count,) = struct.unpack_from(order + "H", data, at)
        out = {}
        for k in range(count):
            tag, kind, n, value = struct.unpack_from(order + "HHI4s", data, at + 2 + 12 * k)
            out.setdefault(tag, (kind, n, value))
        return out

    def text(entry) -> str | None:
        if entry is None or entry[0] != _ASCII:
            return None
        _, n, value = entry
        if n > 4:
            (at,) = struct.unpack(order + "I", value)
            value = data[at : at + n]
        return value[:n].split(b"\0")[0].decode("ascii", "replace") or None

    def number(entry) -> int | None:
        kind = entry and _LONG_TYPES.get(entry[0])
        return struct.unpack_from(order + kind, entry[2])[0] if kind else None

    first = directory(struct.unpack_from(order + "I", data, 4)[0])
    below = number(first.get(EXIF_IFD))
    inner = directory(below) if below else {}
    return text(inner.get(DATE_TIME_ORIGINAL)), text(first.get(DATE_TIME))


def jpeg_dates(data: bytes) -> Found:
    at = 2
    while data[:2] == b"\xff\xd8" and at + 4 <= len(data) and data[at] == 0xFF:
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        if marker == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            return tiff_dates(data[at + 10 : at + 2 + size])
        if marker == 0xDA:
            break
        at += 2 + size
    return None, None


def boxes(data: bytes, at: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(type, first byte of the body, end) of the ISO base-media boxes between two places."""
    end = len(data) if end is None else min(end, len(data))
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1:
            size = struct.unpack_from(">Q", data, body)[0]
            body += 8
        elif size == 0:
            size = end - at
        if size < body - at:
            return
        yield kind, body, min(at + size, end)
        at += size


def _box(data: bytes, name: bytes, at: int = 0, end: int | None = None) -> tuple[int, int] | None:
    return next(((a, b) for kind, a, b in boxes(data, at, end) if kind == name), None)


def item_dates(data: bytes) -> Found:
    """HEIC and AVIF: the meta box lists an ``Exif`` item and where its bytes lie; 4 bytes before the TIFF give its offset."""
    meta = _box(data, b"meta")
    if not meta:
        return None, None
    info, where = _box(data, b"iinf", meta[0] + 4, meta[1]), _box(data, b"iloc", meta[0] + 4, meta[1])
    if not info or not where:
        return None, None
    wanted = None
    start = info[0] + (6 if data[info[0]] == 0 else 8)
    for kind, a, _ in boxes(data, start, info[1]):
        version = data[a]
        if kind == b"infe" and version >= 2:
            number, skip = (struct.unpack_from(">H", data, a + 4)[0], 8) if version == 2 else (struct.unpack_from(">I", data, a + 4)[0], 10)
            if data[a + skip : a + skip + 4] == b"Exif":
                wanted = number
                break
    if wanted is None:
        return None, None
    at, version = where[0] + 4, data[where[0]]
    sizes = data[at], data[at + 1]
    offset_size, length_size, base_size, index_size = sizes[0] >> 4, sizes[0] & 15, sizes[1] >> 4, sizes[1] & 15 if version else 0
    at += 2

    def take(n: int) -> int:
        nonlocal at
        at += n
        return int.from_bytes(data[at - n : at], "big")

    for _ in range(take(2 if version < 2 else 4)):
        number = take(2 if version < 2 else 4)
        method = take(2) & 15 if version else 0
        take(2)
        base = take(base_size)
        spans = []
        for _ in range(take(2)):
            take(index_size)
            spans.append((base + take(offset_size), take(length_size)))
        if number == wanted:
            if method != 0:  # not counted from the file's start
                return None, None
            body = b"".join(data[a : a + n] if n else data[a:] for a, n in spans)
            return tiff_dates(body[4 + int.from_bytes(body[:4], "big") :])
    return None, None


def _tiff_at(data: bytes) -> int:
    return min((i for sig in (b"II*\0", b"MM\0*") if (i := data.find(sig)) >= 0), default=-1)


def cr3_dates(data: bytes) -> Found:
    moov = _box(data, b"moov")
    for kind, a, b in boxes(data, *moov) if moov else ():
        if kind == b"uuid" and (i := _tiff_at(data[a:b])) >= 0:
            body, whole = data[a:b], (None, None)
            while i >= 0:
                body = body[i:]
                found = _quiet(tiff_dates)(body)
                whole = (whole[0] or found[0], whole[1] or found[1])
                i = _tiff_at(body[4:])
                i = i + 4 if i >= 0 else -1
            return whole
    return None, None


def raf_dates(data: bytes) -> Found:
    at, size = struct.unpack_from(">II", data, 0x54)
    return jpeg_dates(data[at : at + size])


def png_dates(data: bytes) -> tuple[str | None, str | None, str | None]:
    """EXIF texts of the first chunk that has any, and the creation time of a text chunk."""
    at, exif, created = 8, (None, None), None
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if kind == b"eXIf" and exif == (None, None):
            exif = _quiet(tiff_dates)(body)
        elif kind == b"tEXt" and body.lower().startswith(b"creation time\0"):
            created = created or body.split(b"\0", 1)[1].decode("latin-1")
        at += 12 + size
    return *exif, created


def mp4_seconds(data: bytes) -> int | None:
    """Creation time of the movie header in seconds since 1904."""
    moov = _box(data, b"moov")
    head = moov and _box(data, b"mvhd", *moov)
    if not head:
        return None
    return struct.unpack_from(">Q" if data[head[0]] == 1 else ">I", data, head[0] + 4)[0]


def _quiet(read: Callable):
    def safe(data: bytes):
        try:
            return read(data)
        except (struct.error, IndexError, ValueError, KeyError, RecursionError):
            return (None, None)

    return safe


READERS: dict[str, Callable[[bytes], Found]] = {"tiff": tiff_dates, "jpeg": jpeg_dates, "heic": item_dates, "avif": item_dates, "cr3": cr3_dates, "raf": raf_dates}


FIELDS = StructType([StructField("original", StringType()), StructField("modified", StringType()), StructField("created", StringType()), StructField("seconds", LongType())])


def _fields(kind: str | None, data) -> list:
    """Date texts and seconds of some media bytes (or a mapped file) by the kind of reader."""
    row: list = [None, None, None, None]
    if kind == "mp4":
        got = _quiet(mp4_seconds)(data)
        row[3] = got if isinstance(got, int) and got < 1 << 40 else None
    elif kind == "png":
        row[:3] = [*_quiet(png_dates)(data), None][:3]
    elif kind in READERS:
        row[:2] = _quiet(READERS[kind])(data)
    return row


def _frame(rows: list[list]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["original", "modified", "created", "seconds"]).astype({"seconds": "Int64"})


@F.pandas_udf(FIELDS)
def media_fields(kind: pd.Series, content: pd.Series) -> pd.DataFrame:
    return _frame([_fields(k if data is not None else None, data if data is None else bytes(data)) for k, data in zip(kind, content, strict=True)])


@F.pandas_udf(FIELDS)
def file_fields(kind: pd.Series, path: pd.Series) -> pd.DataFrame:
    """Like ``media_fields`` for files that the executors can open: mapped, so only the parts that are looked at are read."""

    def read(k, p):
        try:
            with open(p, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
                return _fields(k, data)
        except (OSError, ValueError, TypeError):  # a file that is missing, empty or not named
            return _fields(None, b"")

    return _frame([read(k, p) for k, p in zip(kind, path, strict=True)])


def _kind(format_name: Column, registry: Registry | None) -> Column:
    readers = {f.name: f.dates for f in (registry or Registry()).formats}
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in readers.items() for x in pair)), format_name)


def _dated(kind: Column, fields: Column) -> Column:
    written = F.coalesce(dates.exif_date(fields["original"]), dates.exif_date(fields["modified"]), dates.text_chunk_date(fields["created"]))
    return F.when(kind == "mp4", dates.container_date(fields["seconds"])).otherwise(F.coalesce(written, F.lit(dates.UNKNOWN).cast("timestamp_ntz")))


def captured(format_name: Column, content: Column, registry: Registry | None = None) -> Column:
    """Capture date of a file's bytes by its detected format; ``dates.UNKNOWN`` where there is none."""
    kind = _kind(format_name, registry)
    return _dated(kind, media_fields(kind, content))


def captured_in(format_name: Column, path: Column, registry: Registry | None = None) -> Column:
    """``captured`` for the file at ``path``."""
    kind = _kind(format_name, registry)
    return _dated(kind, file_fields(kind, path))
