"""Media formats: extensions, magic bytes, and detection over a 16-byte header column."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

HEADER_BYTES = 16
SIDECARS = (".aae", ".xmp")


@dataclass(frozen=True)
class Format:
    """A format by name; ``magic`` holds (offset, bytes), any of which identifies it; ``dates`` names its date reader.

    ``tags`` says where its tags go: into a sidecar, into the file itself by ``write_tags(path, rights, owner)``, or nowhere.
    ``digest(path, algorithm)`` hashes what counts as its content, the whole file without it. Both run in tasks. Archives are verified
    by whole files, so one that holds files with a digest of their own is the caller's to verify.
    """

    name: str
    extensions: tuple[str, ...]
    magic: tuple[tuple[int, bytes], ...]
    dates: str = "tiff"
    tags: str = "sidecar"
    write_tags: Callable[[str, str, str], None] | None = None
    digest: Callable[[str, str], str] | None = None


_LE, _BE, _FTYP = (0, b"II*\x00"), (0, b"MM\x00*"), (4, b"ftyp")

#: Fixed values, in registration order: the first format whose magic fits wins for an unknown extension.
BUILT_IN = (
    Format("JPEG", (".jpg", ".jpeg"), ((0, b"\xff\xd8\xff"),), "jpeg"),
    Format("HEIC", (".heic", ".heif"), (_FTYP,), "heic"),
    Format("AVIF", (".avif",), (_FTYP,), "avif"),
    Format("MP4", (".mp4", ".mov"), (_FTYP, (4, b"moov"), (4, b"wide"), (4, b"mdat")), "mp4"),
    Format("PNG", (".png",), ((0, b"\x89PNG\r\n\x1a\n"),), "png"),
    Format("DNG", (".dng",), (_LE, _BE)),
    Format("NEF", (".nef",), (_LE,)),
    Format("CR2", (".cr2",), (_LE,)),
    Format("CR3", (".cr3",), (_FTYP,), "cr3"),
    Format("PEF", (".pef",), (_LE,)),
    Format("ARW", (".arw",), (_LE,)),
    Format("ORF", (".orf",), ((0, b"IIRO"), _LE)),
    Format("RAF", (".raf",), ((0, b"FUJIFILMCCD-RAW "),), "raf"),
    Format("RW2", (".rw2",), ((0, b"IIU\x00"),)),
    Format("TIFF", (".tif", ".tiff"), (_LE, _BE)),
)


@dataclass
class Registry:
    formats: list[Format] = field(default_factory=lambda: list(BUILT_IN))

    def register(self, new: Format) -> None:
        """A later format takes over its extensions; the order of magic tests stays the order of registration."""
        self.formats.append(new)

    def by_name(self) -> dict[str, Format]:
        return {f.name: f for f in self.formats}

    def by_extension(self) -> dict[str, Format]:
        return {e: f for f in self.formats for e in f.extensions}

    def detect(self, ext: Column, header: Column) -> Column:
        """The extension's format if its magic fits, else the first format whose magic fits, else null."""
        known = self.by_extension()
        claimed = F.lit(None).cast("string")
        for e, f in known.items():
            claimed = F.when((F.lower(ext) == e) & has_magic(header, f.magic), F.lit(f.name)).otherwise(claimed)
        first = F.lit(None).cast("string")
        for f in reversed(self.formats):
            first = F.when(has_magic(header, f.magic), F.lit(f.name)).otherwise(first)
        return F.coalesce(claimed, first)


def has_magic(header: Column, magic: tuple[tuple[int, bytes], ...]) -> Column:
    out = F.lit(False)
    for offset, sig in magic:
        out = out | (F.substring(header, offset + 1, len(sig)) == F.lit(bytearray(sig)))
    return F.coalesce(out, F.lit(False))


def is_sidecar(ext: Column) -> Column:
    return F.lower(ext).isin(*SIDECARS)
