"""Scalar functions, templates, globs, formats, media dates and XMP."""

import datetime as dt
import hashlib
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratalog.functions import dates, formats, globs, hashing, media, paths, text, xmp


def values(spark, rows, *columns, schema):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def one(spark, column, **fields):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in fields.items()))
    return df.select(column.alias("v")).collect()[0]["v"]


def test_hashes(spark):
    data = [(b"abc",), (b"",), (bytes(range(251)) * 13,), (None,)]
    got = values(spark, data, *(hashing.content_hash(F.col("c"), a) for a in hashing.ALGORITHMS), schema="c binary")
    assert got[0] == (hashlib.md5(b"abc").hexdigest(), hashlib.sha1(b"abc").hexdigest(), hashlib.sha256(b"abc").hexdigest(), "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85", "44bc2cf5ad770999")
    assert got[1][3] == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert got[3] == (None,) * 5 and len(got[2][3]) == 64
    with pytest.raises(ValueError):
        hashing.content_hash(F.col("c"), "crc")
    known = {1023: "10108970eeda3eb932baac1428c7a2163b0e924c9a9e25b35bba72b28f70bd11", 1024: "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7", 31744: "62b6960e1a44bcc1eb1a611a8d6235b6b4b78f32e7abc4fb4c6cdcce94895c47", 102400: "bc3e3d41a1146b069abffad3c0d44860cf664390afce4d9661f7902e7943e085"}
    made = lambda n: (bytes(range(251)) * (n // 251 + 1))[:n]
    assert {n: hashing.blake3_hex(made(n)) for n in known} == known
    long, h = made((2 << 20) + 777), hashing.Blake3()
    for k in range(0, len(long), 300_001):
        h.update(long[k : k + 300_001])
    assert h.hexdigest() == hashing.blake3_hex(long)
    assert [one(spark, hashing.algorithm_name(F.lit(k))) for k in (0, 4, 9)] == ["md5", "xxhash", ""]


def test_extension(spark):
    cases = {"/photos/dir.backup/IMG_0001": "", "C:\\photos\\dir.backup\\IMG_0001": "", "file.tar.gz": ".gz", "/photos/.hidden": ".hidden", ".": "", "a.JPG": ".JPG", "": ""}
    assert values(spark, [(c,) for c in cases], paths.extension(F.col("p")), schema="p string") == [(v,) for v in cases.values()]


def test_destination(spark):
    at = dt.datetime(2021, 12, 25, 6, 22, 23)
    make = lambda dup, when=at, ext=".JPG", **kw: one(spark, paths.destination(F.lit(when).cast("timestamp_ntz"), "sha1", F.lit("c"), F.lit(ext), F.lit(dup), F.lit("20260306_103000"), **kw))
    assert make(False) == "2021/12-Dec/20211225_062223-1-c.jpg"
    assert make(True) == "duplicates/20260306_103000/2021/12-Dec/20211225_062223-1-c.jpg"
    assert make(False, dt.datetime(1902, 2, 20)) == "1902/02-Feb/19020220_000000-1-c.jpg"
    assert make(False, language="fr") == "2021/12-Déc/20211225_062223-1-c.jpg"
    assert make(False, template="{ext}/{day}-{hour}{minute}{second}") == "jpg/25-062223/20211225_062223-1-c.jpg"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(sorted(paths.PATH_TOKENS)).map(lambda t: (t, True)), st.text("abc-_", min_size=1, max_size=4).map(lambda t: (t, False))), min_size=1, max_size=8))
def test_templates_parse_back(parts):
    raw = "".join("{" + t + "}" if token else t for t, token in parts)
    again = "".join("{" + t + "}" if token else t for t, token in paths.parse_template(raw).parts)
    assert again == raw


@pytest.mark.parametrize("bad", ["", "/x", "{year", "year}", "{}", "{a{b}}", "{nope}", "a:b", "../x", "a/./b", "x\0", "{{year}}"])
def test_bad_templates(bad):
    with pytest.raises(paths.TemplateError):
        paths.parse_template(bad)


def test_copyright_template(spark):
    assert one(spark, paths.parse_copyright("(c) {year} {monthname}: me").column(F.lit(dt.datetime(2021, 3, 1)))) == "(c) 2021 Mar: me"
    with pytest.raises(paths.TemplateError):
        paths.parse_copyright("{hour}")


def test_parsed_names(spark):
    c40, c64, c32 = "7d97e98f8af710c7e7fe703abc8f639e0ee507c4", "a" * 64, "b" * 32
    cases = {
        f"20211225_062223-1-{c40}.jpg": (c40, "sha1", True), f"20211225_062223-0-{c32}.jpg": (c32, "md5", True), f"20211225_062223-3-{c64}.jpg": (c64, "blake3", True),
        f"20211225_062223_{c40}.jpg": (c40, "sha1", True), f"20211225_062223_{c64}.jpg": (c64, "sha256", True), "20220202_123101_abcdef0123456789.heic": ("abcdef0123456789", "", True),
        "19020220_000000_12345678.dng": ("12345678", "", True), "random_photo.jpg": ("", "", False), "20211225_062223_short.jpg": ("", "", False), "noextension": ("", "", False), f"20211225_062223-1-{c40}": (c40, "sha1", True), f"20211225_062223_{c40}": (c40, "sha1", True),
        "20211225_062223.jpg": ("", "", False), "": ("", "", False), "../../etc/passwd": ("", "", False), f"20211225_062223-9-{c40}.jpg": ("", "", False),
    }
    got = values(spark, [(n,) for n in cases], paths.parsed_name(F.col("n")).alias("p"), schema="n string")
    assert {n: tuple(g[0]) for n, g in zip(cases, got, strict=True)} == cases


def test_generated_sidecars(spark):
    cases = {"20211225_062223_abc123def456.arw.xmp": True, "notes.xmp": False, "IMG_0001.jpg.xmp": False, "20211225_062223_GHIJ.arw.xmp": False, "20211225_062223-1-abc123.jpg.xmp": False}
    got = values(spark, [(n,) for n in cases], paths.is_generated_sidecar(F.col("n")), paths.is_generated_sidecar(F.col("n"), True), schema="n string")
    assert [g[0] for g in got] == list(cases.values()) and got[-1][1]


def test_slug_language_alias(spark):
    assert one(spark, hashing.slug(F.lit("/mnt/My Photos!"))) == "myphotos-" + hashlib.sha256(b"/mnt/My Photos!").hexdigest()[:8]
    assert paths.detect_language({"LC_ALL": "C", "LANG": "fr_FR.UTF-8"}) == "fr" and paths.detect_language({}) == "en"
    assert paths.resolve_alias("+nas", {"nas": "~/x"}, "/home/u") == "/home/u/x" and paths.resolve_alias("/p", {}) == "/p"
    with pytest.raises(KeyError, match="b, c"):
        paths.resolve_alias("+a", {"c": "", "b": ""})


@pytest.mark.parametrize(("glob", "yes", "no"), [("*.txt", "readme.txt", "photo.jpg"), ("subdir/*.tmp", "subdir/cache.tmp", "cache.tmp"), ("**/x/*.a", "q/x/1.a", "q/y/1.a"), ("{a,b}.c", "b.c", "c.c"), ("[!a]x", "bx", "ax"), ("a?c", "abc", "a/c")])
def test_file_globs(spark, glob, yes, no):
    name = F.regexp_extract("p", "([^/]*)$", 1)
    assert values(spark, [(yes,), (no,)], globs.ignored_file(name, F.col("p"), [glob]), schema="p string") == [(True,), (False,)]


def test_directory_globs(spark):
    name = F.regexp_extract("p", "([^/]*)$", 1)
    hit = lambda p, *g: values(spark, [(p,)], globs.ignored_directory(name, F.col("p"), list(g)), schema="p string") == [(True,)]
    assert hit("a/node_modules", "node_modules/") and hit("x/cache", "**/cache/") and hit("backups/old", "backups/old/") and hit("backups", "backups/**")
    assert not any(hit("node_modules", g) for g in ("*.tmp", "node_modules", "**/*.txt"))
    assert globs.to_regex("[ab") is None and globs.cleaned([" a ", "", "a", "b"]) == ["a", "b"]
    assert values(spark, [("x/y", "x"), ("z", "x"), ("q", "")], globs.within_scope(F.col("r"), F.col("s")), schema="r string, s string") == [("y",), (None,), ("q",)]


def test_text(spark):
    cases = {0: "0 B", 999: "999 B", 1000: "1.0 KB", 1150: "1.1 KB", 1250: "1.2 KB", 1350: "1.4 KB", 1_500_000: "1.5 MB", 2_000_000_000: "2.0 GB"}
    assert values(spark, [(n,) for n in cases], text.decimal_size(F.col("n")), schema="n bigint") == [(f"{n} B" if n < 1000 else f"{n / 10**(3 * ((len(str(n)) - 1) // 3)):.1f} {'KMG'[(len(str(n)) - 1) // 3 - 1]}B",) for n in cases]
    start = dt.datetime(2026, 1, 1)
    spans = {0.8: "0.8s", 23: "23s", 83: "1m 23s", 3912: "1h 5m 12s", -5: "0.0s"}
    assert values(spark, [(start, start + dt.timedelta(seconds=s)) for s in spans], text.duration(F.col("a"), F.col("b")), schema="a timestamp_ntz, b timestamp_ntz") == [(v,) for v in spans.values()]
    assert values(spark, [(start, None)], text.duration(F.col("a"), F.col("b")), text.seconds_between(F.col("a"), F.col("b")), schema="a timestamp_ntz, b timestamp_ntz") == [("—", None)]
    assert values(spark, [(["x", ".aae", ".xmp", "x"],), ([],), (None,)], text.sidecar_note(text.sidecar_order(F.col("e"))), schema="e array<string>") == [(" [+xmp +aae +x]",), ("",), ("",)]
    assert one(spark, text.xml_escape(F.lit("<a & 'b'>\""))) == "&lt;a &amp; &apos;b&apos;&gt;&quot;"
    assert values(spark, [(1,), (2,), (0,)], text.counted(F.col("n"), "file"), schema="n int") == [("1 file",), ("2 files",), (None,)]
    assert text.wrap("aa bb cc dddddddd", "  ", 7) == ["  aa bb", "  cc", "  dddddddd"]
    assert values(spark, [("", ""), ("123456789", "123456789"), (None, "ab")], text.short_checksum(F.col("a")), text.short_id(F.col("b")), schema="a string, b string") == [("—", ""), ("12345678…", "12345678…"), ("—", "ab")]


def tiff(original=None, modified=None, order="<"):
    entries, extra, at = [], b"", 8 + 2 + 12 * (bool(original) + bool(modified)) + 4
    out = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8)
    if modified:
        entries.append(struct.pack(order + "HHII", 0x0132, 2, 20, at))
        extra += modified.encode() + b"\0"
    if original:
        below = at + len(extra)
        entries.append(struct.pack(order + "HHII", 0x8769, 4, 1, below))
        extra += struct.pack(order + "HHHII", 1, 0x9003, 2, 20, below + 18) + struct.pack(order + "I", 0) + original.encode() + b"\0"
    return out + struct.pack(order + "H", len(entries)) + b"".join(entries) + struct.pack(order + "I", 0) + extra


def box(kind, body):
    return struct.pack(">I4s", 8 + len(body), kind) + body


def heic(exif):
    infe = box(b"infe", b"\2\0\0\0" + struct.pack(">HH", 7, 0) + b"Exif\0")
    iinf = box(b"iinf", b"\0\0\0\0" + struct.pack(">H", 1) + infe)
    item = lambda at: box(b"iloc", b"\0\0\0\0\x44\0" + struct.pack(">HHHH", 1, 7, 0, 1) + struct.pack(">II", at, 4 + len(exif)))
    head = box(b"ftyp", b"heic\0\0\0\0")
    size = len(head) + len(box(b"meta", b"\0\0\0\0" + iinf + item(0)))
    return head + box(b"meta", b"\0\0\0\0" + iinf + item(size)) + b"\0\0\0\0" + exif


def test_media_dates(spark):
    when, later = "2021:12:25 06:22:23", "2022:02:02 12:31:01"
    jpeg = lambda t: b"\xff\xd8\xff\xe1" + struct.pack(">H", 8 + len(t)) + b"Exif\0\0" + t + b"\xff\xda\0\0"
    seconds = int((dt.datetime(2021, 12, 25, 6, 22, 23) - dt.datetime(1904, 1, 1)).total_seconds())
    movie = lambda s: box(b"ftyp", b"isom") + box(b"moov", box(b"mvhd", b"\0\0\0\0" + struct.pack(">I", s)))
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + b"\0\0\0\0"
    png = lambda *c: b"\x89PNG\r\n\x1a\n" + b"".join(c)
    photo = jpeg(tiff(when))
    a, b, none = dt.datetime(2021, 12, 25, 6, 22, 23), dt.datetime(2022, 2, 2, 12, 31, 1), dates.UNKNOWN
    cases = [
        ("JPEG", photo, a), ("JPEG", jpeg(tiff(None, later)), b), ("JPEG", jpeg(tiff(when, later, ">")), a), ("JPEG", b"\xff\xd8\xff", none), ("DNG", tiff(when), a), ("TIFF", tiff(None, None), none),
        ("HEIC", heic(tiff(when)), a), ("AVIF", heic(tiff(None, later)), b), ("CR3", box(b"moov", box(b"uuid", b"x" * 16 + tiff(when))), a),
        ("RAF", b"FUJIFILMCCD-RAW ".ljust(0x54, b"\0") + struct.pack(">II", 0x5C, len(photo)) + photo, a), ("MP4", movie(seconds), a), ("MP4", movie(0), none),
        ("PNG", png(chunk(b"eXIf", tiff(when))), a), ("PNG", png(chunk(b"tEXt", b"Creation Time\x002022-02-02T12:31:01+05:00")), b), ("PNG", png(), none),
        ("HEIC", b"\0\0\0\x08meta\xff", none), ("CR3", b"", none), (None, b"x", none), ("JPEG", None, none),
    ]
    got = values(spark, [(f, c) for f, c, _ in cases], media.captured(F.col("f"), F.col("c")), schema="f string, c binary")
    assert [g[0] for g in got] == [w for _, _, w in cases]


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=200), st.sampled_from(sorted(media.READERS)), st.sampled_from([b"", b"II*\0\x08\0\0\0", b"\xff\xd8\xff\xe1\0\x20Exif\0\0MM\0*\0\0\0\x08", b"\0\0\0\x60meta\0\0\0\0"]))
def test_readers_never_raise(data, kind, start):
    media._quiet(media.READERS[kind])(start + data)
    media._quiet(media.png_dates)(start + data)
    media._quiet(media.mp4_seconds)(start + data)


def test_detection(spark):
    r = formats.Registry()
    cases = [(".jpg", b"\xff\xd8\xff\xe0", "JPEG"), (".jpg", b"\x89PNG\r\n\x1a\n", "PNG"), (".NEF", b"II*\0", "NEF"), (".xyz", b"II*\0", "DNG"), (".xyz", b"\0\0\0\0ftyp", "HEIC"), (".cr3", b"\0\0\0\0ftyp", "CR3"), (".txt", b"hello", None), ("", b"", None), (".rw2", b"IIU\0", "RW2")]
    got = values(spark, [c[:2] for c in cases], r.detect(F.col("e"), F.col("h")), schema="e string, h binary")
    assert [g[0] for g in got] == [c[2] for c in cases]
    r.register(formats.Format("MINE", (".jpg",), ((0, b"ME"),)))
    assert values(spark, [(".jpg", b"ME"), (".jpg", b"\xff\xd8\xff")], r.detect(F.col("e"), F.col("h")), schema="e string, h binary") == [("MINE",), ("JPEG",)]


def test_gate(spark):
    day = dt.date(2024, 6, 1)
    got = values(spark, [(dt.datetime(2024, 5, 31, 23, 59, 59),), (dt.datetime(2024, 6, 1),), (dt.datetime(2024, 6, 1, 23, 59, 59),), (dt.datetime(2024, 6, 2),), (None,)], dates.gate_reason(F.col("d"), day, day), schema="d timestamp_ntz")
    assert [g[0] for g in got] == ["outside date range: before 2024-06-01", None, None, "outside date range: after 2024-06-01", None]


def test_xmp(spark):
    packet = one(spark, xmp.packet(F.lit("me & you"), F.lit("")))
    assert "me &amp; you" in packet and "aux" not in packet and one(spark, xmp.packet(F.lit(""), F.lit(None).cast("string"))) is None
    both = xmp.merged_text(packet, "new", "owner", False)
    assert "me &amp; you" in both and "<aux:OwnerName>owner</aux:OwnerName>" in both and both.count('xmlns:aux="') == 1
    assert "new</rdf:li>" in xmp.merged_text(packet, "new", "", True) and xmp.merged_text(both, "", "owner", False) == both
    assert xmp.merged_text("not xml", "a", "b", True) == "not xml"
    assert values(spark, [(packet, "", "o"), (None, "a", "b")], xmp.merged(F.col("c"), F.col("r"), F.col("o")), schema="c string, r string, o string")[1] == (None,)
