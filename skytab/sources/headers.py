"""Metadata of JPEG, PNG and TIFF files from the few blocks of each file that hold it."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from functools import cache
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# layout of TIFF values, fixed values: type to (size, struct letter)
TIFF_TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 7: (1, "s"), 9: (4, "i"), 10: (8, "ii"), 13: (4, "I"), 16: (8, "Q")}
# tags, fixed values
WIDTH, HEIGHT, XMP, EXIF_POINTER, GPS_POINTER = 0x0100, 0x0101, 0x02BC, 0x8769, 0x8825
FOCAL, FOCAL_35MM, TAKEN, COMMENT = 0x920A, 0xA405, 0x9003, 0x9286
GPS_LATITUDE_REF, GPS_LATITUDE, GPS_LONGITUDE_REF, GPS_LONGITUDE, GPS_ALTITUDE, GPS_DIRECTION = 1, 2, 3, 4, 6, 17
XMP_JPEG, XMP_PNG = b"http://ns.adobe.com/xap/1.0/\0", b"XML:com.adobe.xmp\0"
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
SIZE_MARKERS = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}
WANTED = {
    "top": {WIDTH, HEIGHT, XMP, EXIF_POINTER, GPS_POINTER},
    "exif": {FOCAL, FOCAL_35MM, TAKEN, COMMENT},
    "gps": {GPS_LATITUDE_REF, GPS_LATITUDE, GPS_LONGITUDE_REF, GPS_LONGITUDE, GPS_ALTITUDE, GPS_DIRECTION},
}

Read = Callable[[int, int], bytes]


class Blocks:
    """Reads of an open file by whole blocks, each fetched once; ``fetched`` counts their bytes."""

    def __init__(self, file: BinaryIO, block: int = 4096) -> None:
        self.file, self.block, self.held, self.fetched = file, block, {}, 0
        self.size = file.seek(0, 2)

    def __call__(self, at: int, n: int) -> bytes:
        if at + n > self.size:
            raise ValueError("beyond the end of the file")
        first, last = at // self.block, (at + n - 1) // self.block
        missing = [k for k in range(first, last + 1) if k not in self.held]
        if missing:  # one read from the first to the last block that is not there
            self.file.seek(missing[0] * self.block)
            data = self.file.read((missing[-1] - missing[0] + 1) * self.block)
            self.fetched += len(data)
            for k in range(missing[0], missing[-1] + 1):
                self.held[k] = data[(k - missing[0]) * self.block : (k - missing[0] + 1) * self.block]
        whole = b"".join(self.held[k] for k in range(first, last + 1))
        return whole[at - first * self.block :][:n]


def _directory(read: Read, base: int, order: str, wide: bool, at: int, want: set[int]) -> dict[int, object]:
    """The wanted entries of one TIFF directory: text as bytes, single numbers plain, rationals as pairs."""
    count, step, place = ("Q", 20, "Q") if wide else ("H", 12, "I")
    (n_entries,) = struct.unpack(order + count, read(base + at, struct.calcsize(order + count)))
    if n_entries > 65535:
        raise ValueError("not a directory")
    table = read(base + at + struct.calcsize(order + count), step * n_entries)
    out: dict[int, object] = {}
    for k in range(0, len(table), step):
        tag, kind, n = struct.unpack_from(f"{order}HH{place}", table, k)
        if tag not in want or kind not in TIFF_TYPES:
            continue
        size, letter = TIFF_TYPES[kind]
        room, inline = struct.calcsize(order + place), k + 4 + struct.calcsize(order + place)
        data = table[inline : inline + size * n] if size * n <= room else read(base + struct.unpack_from(order + place, table, inline)[0], size * n)
        if letter == "s":
            out[tag] = data if tag == COMMENT else data.rstrip(b"\0")
            continue
        values = struct.unpack(f"{order}{letter * n}", data)
        if len(letter) == 2:
            values = tuple(zip(values[::2], values[1::2]))
        out[tag] = bytes(values) if tag == XMP and kind == 1 else values[0] if n == 1 else values
    return out


def _tiff(read: Read, base: int) -> dict:
    """Directories of a TIFF (the wide form with offsets of eight bytes too) that begins at ``base``."""
    head = read(base, 8)
    order = {b"II": "<", b"MM": ">"}[head[:2]]
    (magic,) = struct.unpack_from(f"{order}H", head, 2)
    if magic not in (42, 43):
        raise ValueError("no TIFF")
    wide = magic == 43
    (first,) = struct.unpack(f"{order}Q", read(base + 8, 8)) if wide else struct.unpack_from(f"{order}I", head, 4)
    out = {"top": _directory(read, base, order, wide, first, WANTED["top"]), "exif": {}, "gps": {}}
    for name, pointer in (("exif", EXIF_POINTER), ("gps", GPS_POINTER)):
        if pointer in out["top"]:
            out[name] = _directory(read, base, order, wide, out["top"][pointer], WANTED[name])
    return out


def _jpeg(read: Read) -> dict:
    out, at = {"width": 0, "height": 0, "exif": {}, "gps": {}, "xmp": b""}, 2
    while True:
        try:
            mark, kind, size = struct.unpack(">BBH", read(at, 4))
        except ValueError:  # ends before the scan: what is there counts
            return out
        if mark != 0xFF or kind == 0xDA:
            return out
        if kind == 0xFF:  # a filling byte
            at += 1
            continue
        body, n = at + 4, size - 2
        if kind in SIZE_MARKERS:
            out["height"], out["width"] = struct.unpack(">HH", read(body + 1, 4))
        elif kind == 0xE1 and n > 6 and read(body, 6) == b"Exif\0\0":
            out.update({k: v for k, v in _tiff(read, body + 6).items() if k != "top"})
        elif kind == 0xE1 and n > len(XMP_JPEG) and read(body, len(XMP_JPEG)) == XMP_JPEG:
            out["xmp"] = read(body + len(XMP_JPEG), n - len(XMP_JPEG))
        at += 2 + size


def _png(read: Read) -> dict:
    """Chunks up to the pixels."""
    out, at = {"width": 0, "height": 0, "exif": {}, "gps": {}, "xmp": b""}, 8
    while True:
        size, kind = struct.unpack(">I4s", read(at, 8))
        if kind in (b"IDAT", b"IEND"):
            return out
        if kind == b"IHDR":
            out["width"], out["height"] = struct.unpack(">II", read(at + 8, 8))
        elif kind == b"eXIf":
            out.update({k: v for k, v in _tiff(read, at + 8).items() if k != "top"})
        elif kind == b"iTXt" and size > len(XMP_PNG) and read(at + 8, len(XMP_PNG)) == XMP_PNG:
            packed, _, rest = *(body := read(at + 8 + len(XMP_PNG), size - len(XMP_PNG)))[:2], body[2:]
            text = rest.split(b"\0", 2)[2]  # after language and translated keyword
            out["xmp"] = zlib.decompress(text) if packed else text
        at += 12 + size


def image_metadata(read: Read) -> dict | None:
    """width, height, exif and gps entries and xmp bytes of an image; None where the bytes are no such image or broken."""
    try:
        head = read(0, 8)
        if head[:2] == b"\xff\xd8":
            return _jpeg(read)
        if head == PNG_SIGNATURE:
            return _png(read)
        if head[:2] in (b"II", b"MM"):
            found = _tiff(read, 0)
            top = found.pop("top")
            return {"width": top.get(WIDTH, 0), "height": top.get(HEIGHT, 0), "xmp": top.get(XMP, b""), **found}
    except (struct.error, zlib.error, IndexError, KeyError, TypeError, ValueError):
        pass
    return None


def _rational(x: object) -> float | None:
    return x[0] / x[1] if isinstance(x, tuple) and len(x) == 2 and x[1] else None


def _degrees(dms: object, ref: object) -> float | None:
    parts = [_rational(x) for x in dms] if isinstance(dms, tuple) and len(dms) == 3 else [None]
    if None in parts:
        return None
    value = parts[0] + parts[1] / 60 + parts[2] / 3600
    return -value if ref in (b"S", b"W", b"s", b"w") else value


RAW = "path string, width int, height int, latitude double, longitude double, gps_altitude double, focal_length double, focal_35mm double, direction double, taken string, comment string, xmp string, bytes_read long"


def _row(path: str, m: dict, fetched: int) -> tuple:
    e, g = m["exif"], m["gps"]
    note, taken, focal = e.get(COMMENT, b""), e.get(TAKEN), e.get(FOCAL_35MM)
    text = lambda v: v.decode("utf-8", "ignore")
    return (
        path,
        m["width"],
        m["height"],
        _degrees(g.get(GPS_LATITUDE), g.get(GPS_LATITUDE_REF)),
        _degrees(g.get(GPS_LONGITUDE), g.get(GPS_LONGITUDE_REF)),
        _rational(g.get(GPS_ALTITUDE)),
        _rational(e.get(FOCAL)),
        float(focal) if isinstance(focal, int) and focal else None,
        _rational(g.get(GPS_DIRECTION)),
        text(taken) if isinstance(taken, bytes) and taken else None,
        text(note[8:]).rstrip("\0") if isinstance(note, bytes) and note.startswith(b"ASCII\0\0\0") else None,
        text(m["xmp"]),
        fetched,
    )


@cache
def _store(scheme: str, authority: str) -> object:
    from pyarrow import fs

    if scheme in ("", "file"):
        return fs.LocalFileSystem()
    return fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{authority}/")[0]


def open_path(path: str) -> BinaryIO:
    """A file of a local disk or of a store that Arrow knows, open for reads anywhere in it."""
    scheme, found, rest = path.partition(":")
    if not found or "/" in scheme:
        return _store("", "").open_input_file(path)
    authority, place = ("", rest) if not rest.startswith("//") else (rest[2:].split("/", 1)[0], "/" + rest[2:].partition("/")[2])
    if scheme in ("s3", "s3a", "s3n", "gs"):  # there the bucket is part of the name
        place = authority + place
    return _store(scheme, authority).open_input_file(place)


def read_raw_metadata(spark: SparkSession, path: str, opener: Callable[[str], BinaryIO] = open_path) -> DataFrame:
    """EXIF values, user comment and XMP text of the JPEG, PNG and TIFF files under a path, and bytes_read, what was
    fetched of the file for them. Files that are no such image, or broken, are left out.

    Spark lists the files and never reads them whole: each is opened in a task, and blocks of 4 KB are fetched
    where the segments, chunks or directories point. ``opener`` opens a path of a store that Arrow does not know.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    files = files.filter(files["path"].rlike(r"(?i)\.(jpg|jpeg|png|tif|tiff)$"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name in batch["path"]:
                with opener(name) as file:
                    blocks = Blocks(file)
                    if m := image_metadata(blocks):
                        rows.append(_row(name, m, blocks.fetched))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in RAW.split(", ")])
            yield out.astype({"taken": object, "comment": object})

    return files.mapInPandas(parse, RAW)
