"""EXIF tags of images, read from the bytes of JPEG and TIFF files without an image library.

``read_tags`` takes ``binaryFile`` rows and returns a map of maps by tag group and name; it parses the header only.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tag numbers.
TAGS = {
    0x010F: "Make", 0x0110: "Model", 0x0112: "Orientation", 0x0132: "DateTime", 0x8769: "ExifIFD", 0x8825: "GPSIFD", 0x829A: "ExposureTime", 0x829D: "FNumber",
    0x8827: "ISOSpeedRatings", 0x9003: "DateTimeOriginal", 0x9291: "SubSecTimeOriginal", 0x9204: "ExposureBiasValue", 0x920A: "FocalLength", 0xA002: "PixelXDimension", 0xA003: "PixelYDimension",
}
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}


def _header(data: bytes) -> bytes | None:
    """The TIFF block of a file: the file itself, or what a JPEG carries in its APP1 segment."""
    if data[:4] in (b"II*\0", b"MM\0*"):
        return data
    if data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        if marker == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            return data[at + 10 : at + 2 + size]
        if marker == 0xDA:
            return None
        at += 2 + size
    return None


def _value(order: str, kind: int, count: int, raw: bytes) -> str | None:
    if kind == 2:
        return raw.split(b"\0")[0].decode("utf-8", "replace").strip()
    if kind in (5, 10):
        pairs = struct.unpack(f"{order}{2 * count}{'I' if kind == 5 else 'i'}", raw[: 8 * count])
        return ",".join(repr(a / b) if b else "" for a, b in zip(pairs[::2], pairs[1::2]))
    code = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}.get(kind)
    return ",".join(map(str, struct.unpack(f"{order}{count}{code}", raw[: count * _SIZES[kind]]))) if code else raw.hex()


def parse(data: bytes) -> dict[str, dict[str, str]]:
    """Tags by group; damaged parts are skipped."""
    block = _header(data)
    out: dict[str, dict[str, str]] = {}
    if not block or len(block) < 8:
        return out
    order = "<" if block[:2] == b"II" else ">"

    def folder(at: int, group: str, depth: int = 0) -> None:
        if at <= 0 or at + 2 > len(block) or depth > 3:
            return
        for i in range(struct.unpack_from(f"{order}H", block, at)[0]):
            entry = at + 2 + 12 * i
            if entry + 12 > len(block):
                return
            tag, kind, count = struct.unpack_from(f"{order}HHI", block, entry)
            size = _SIZES.get(kind, 0) * count
            start = entry + 8 if size <= 4 else struct.unpack_from(f"{order}I", block, entry + 8)[0]
            if not size or start + size > len(block):
                continue
            name = TAGS.get(tag, f"0x{tag:04X}")
            if name in ("ExifIFD", "GPSIFD"):
                folder(struct.unpack_from(f"{order}I", block, entry + 8)[0], name[:-3], depth + 1)
            else:
                value = _value(order, kind, count, block[start : start + size])
                if value is not None:
                    out.setdefault(group, {})[name] = value

    folder(struct.unpack_from(f"{order}I", block, 4)[0], "0th")
    return out


def build(tags: dict[str, dict[str, str | int | tuple[int, int]]]) -> bytes:
    """A little-endian TIFF block with text, whole and rational values, in groups 0th and Exif."""
    numbers = {v: k for k, v in TAGS.items()}
    unknown = [n for g in tags.values() for n in g if n not in numbers]
    if unknown or set(tags) - {"0th", "Exif"}:
        raise ValueError(f"unknown groups or tags: {sorted(set(tags) - {'0th', 'Exif'})} {unknown}")

    def folder(values: dict, at: int, child: int | None) -> bytes:
        items = sorted([(numbers[n], v) for n, v in values.items()] + ([(0x8769, child)] if child is not None else []))
        head, tail = struct.pack("<H", len(items)), b""
        after = at + 2 + 12 * len(items) + 4
        for tag, v in items:
            kind, raw = (2, v.encode() + b"\0") if isinstance(v, str) else (4, struct.pack("<I", v)) if isinstance(v, int) else (5, struct.pack("<II", *v))
            count = len(raw) if kind == 2 else 1
            body = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", after + len(tail))
            tail += raw if len(raw) > 4 else b""
            head += struct.pack("<HHI", tag, kind, count) + body
        return head + struct.pack("<I", 0) + tail

    first = tags.get("0th", {})
    inner = tags.get("Exif")
    if inner is None:
        return b"II*\0" + struct.pack("<I", 8) + folder(first, 8, None)
    size = len(folder(first, 8, 0))
    return b"II*\0" + struct.pack("<I", 8) + folder(first, 8, 8 + size) + folder(inner, 8 + size, None)


def jpeg_with(block: bytes) -> bytes:
    """The least JPEG that carries a TIFF block."""
    body = b"Exif\0\0" + block
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xd9"


def read_tags(files: DataFrame) -> DataFrame:
    """``path, exif`` (map of maps) from rows with path and content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "exif": [parse(bytes(c)) if c is not None else {} for c in pdf["content"]]})

    return files.select("path", "content").mapInPandas(run, "path string, exif map<string, map<string, string>>")


def tag(exif: Column, group: str, name: str) -> Column:
    return F.try_element_at(F.try_element_at(exif, F.lit(group)), F.lit(name))


def rational(text: Column) -> Column:
    """'a/b' as a quotient, NULL for a zero denominator; plain numbers as they are."""
    parts = F.split(text, "/")
    return F.when(F.size(parts) == 2, parts[0].cast("double") / F.nullif(F.get(parts, F.lit(1)).cast("double"), F.lit(0.0))).otherwise(parts[0].try_cast("double"))


def timestamp(text: Column, subsecond: Column | None = None) -> Column:
    """'YYYY:MM:DD HH:MM:SS' with an optional fraction, without time zone; NULL if it doesn't parse."""
    ok = F.regexp_extract(text, r"^\s*(\d{4}:\d{2}:\d{2} \d{2}:\d{2}:\d{2})(\.\d+)?", 1)
    own = F.regexp_extract(text, r"^\s*\d{4}:\d{2}:\d{2} \d{2}:\d{2}:\d{2}(\.\d{1,6})", 1)
    extra = F.lit("") if subsecond is None else F.when(F.trim(subsecond).rlike(r"^\d+$"), F.concat(F.lit("."), F.substring(F.trim(subsecond), 1, 6))).otherwise("")
    fraction = F.when(own != "", own).otherwise(extra)
    iso = F.concat(F.regexp_replace(F.substring(ok, 1, 10), ":", "-"), F.substring(ok, 11, 9), fraction)
    return F.when(ok != "", iso).otherwise(F.lit(None)).try_cast("timestamp_ntz")


def fields(tags: DataFrame) -> DataFrame:
    """Image size, time, exposure, aperture, speed, focal length, make and model."""
    e = F.col("exif")
    when = timestamp(F.coalesce(tag(e, "Exif", "DateTimeOriginal"), tag(e, "0th", "DateTime")), tag(e, "Exif", "SubSecTimeOriginal"))
    number = lambda g, n: tag(e, g, n).try_cast("double")
    return tags.select(
        "path", tag(e, "Exif", "PixelXDimension").try_cast("int").alias("nx"), tag(e, "Exif", "PixelYDimension").try_cast("int").alias("ny"), when.alias("ts"), number("Exif", "ExposureTime").alias("exposure"), number("Exif", "FNumber").alias("aperture"),
        tag(e, "Exif", "ISOSpeedRatings").try_cast("int").alias("iso"), number("Exif", "FocalLength").alias("fmm"), tag(e, "0th", "Make").alias("make"), tag(e, "0th", "Model").alias("model"),
    )
