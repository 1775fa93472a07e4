"""Image headers: size and resolution of every page of a file, without decoding it.

One probe for each format; ``image_metadata`` runs them over a binaryFile table under Arrow. A file that
no probe knows, or that is cut short, gives one row with a status and no size.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "path string, page int, format string, w int, h int, dpi_x int, dpi_y int, status string"
Probe = tuple[str, list[tuple[int, int, float, float]]]


def _png(d: bytes) -> Probe | None:
    if d[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    w, h = struct.unpack(">II", d[16:24])
    at, dx, dy = 8, 0.0, 0.0
    while at + 8 <= len(d):
        n, kind = struct.unpack(">I4s", d[at : at + 8])
        if kind == b"pHYs":
            x, y, unit = struct.unpack(">IIB", d[at + 8 : at + 17])
            dx, dy = (x * 0.0254, y * 0.0254) if unit == 1 else (0.0, 0.0)
        if kind in (b"IDAT", b"IEND"):
            break
        at += 12 + n
    return "png", [(w, h, dx, dy)]


def _jpeg(d: bytes) -> Probe | None:
    if d[:2] != b"\xff\xd8":
        return None
    at, dx, dy = 2, 0.0, 0.0
    while at + 4 <= len(d):
        if d[at] != 0xFF:
            at += 1
            continue
        kind = d[at + 1]
        if kind in (0x01, 0xFF) or 0xD0 <= kind <= 0xD8:
            at += 1 if kind == 0xFF else 2
            continue
        (n,) = struct.unpack(">H", d[at + 2 : at + 4])
        body = d[at + 4 : at + 2 + n]
        if kind == 0xE0 and body[:5] == b"JFIF\0":
            unit, x, y = struct.unpack(">BHH", body[7:12])
            dx, dy = {1: (x, y), 2: (x * 2.54, y * 2.54)}.get(unit, (0.0, 0.0))
        if kind == 0xE1 and body[:6] == b"Exif\0\0" and not dx:
            pages = _tiff(body[6:])
            dx, dy = pages[1][0][2:] if pages and pages[1] else (0.0, 0.0)
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", body[1:5])
            return "jpeg", [(w, h, dx, dy)]
        at += 2 + n
    raise ValueError("no frame header")


def _boxes(d: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """ISO boxes between two offsets: kind, start and end of the body."""
    while at + 8 <= end:
        n, kind = struct.unpack(">I4s", d[at : at + 8])
        start = at + 8
        if n == 1:
            (n,) = struct.unpack(">Q", d[at + 8 : at + 16])
            start = at + 16
        stop = end if n == 0 else at + n
        if stop <= at:
            return
        yield kind, start, min(stop, end)
        at = stop


def _jp2(d: bytes) -> Probe | None:
    if d[4:12] != b"jP  \r\n\x87\n":
        return None
    w = h = 0
    dx = dy = 0.0
    for kind, a, b in _boxes(d, 0, len(d)):
        if kind == b"jp2h":
            for sub, c, e in _boxes(d, a, b):
                if sub == b"ihdr":
                    h, w = struct.unpack(">II", d[c : c + 8])
                if sub == b"res ":
                    for res, r, _ in _boxes(d, c, e):
                        if res in (b"resc", b"resd"):
                            yn, yd, xn, xd, ye, xe = struct.unpack(">HHHHbb", d[r : r + 10])
                            dy, dx = yn / yd * 10.0**ye * 0.0254, xn / xd * 10.0**xe * 0.0254
    if not w:
        raise ValueError("no image header")
    return "jp2", [(w, h, dx, dy)]


def _heic(d: bytes) -> Probe | None:
    if d[4:8] != b"ftyp" or d[8:12] not in (b"heic", b"heix", b"hevc", b"mif1", b"msf1", b"heim", b"heis"):
        return None
    sizes = []
    for kind, a, b in _boxes(d, 0, len(d)):
        if kind == b"meta":
            for k2, a2, b2 in _boxes(d, a + 4, b):
                if k2 == b"iprp":
                    for k3, a3, b3 in _boxes(d, a2, b2):
                        if k3 == b"ipco":
                            sizes += [struct.unpack(">II", d[c + 4 : c + 12]) for k4, c, _ in _boxes(d, a3, b3) if k4 == b"ispe"]
    if not sizes:
        raise ValueError("no image size")
    w, h = max(sizes, key=lambda s: s[0] * s[1])  # tiles and thumbnails are smaller
    return "heic", [(w, h, 0.0, 0.0)]


def _webp(d: bytes) -> Probe | None:
    if d[:4] != b"RIFF" or d[8:12] != b"WEBP":
        return None
    kind, body = d[12:16], d[20:]
    if kind == b"VP8X":
        return "webp", [(1 + int.from_bytes(body[4:7], "little"), 1 + int.from_bytes(body[7:10], "little"), 0.0, 0.0)]
    if kind == b"VP8L" and body[:1] == b"\x2f":
        n = int.from_bytes(body[1:5], "little")
        return "webp", [((n & 0x3FFF) + 1, (n >> 14 & 0x3FFF) + 1, 0.0, 0.0)]
    if kind == b"VP8 " and body[3:6] == b"\x9d\x01\x2a":
        w, h = struct.unpack("<HH", body[6:10])
        return "webp", [(w & 0x3FFF, h & 0x3FFF, 0.0, 0.0)]
    raise ValueError("no frame header")


def _bmp(d: bytes) -> Probe | None:
    if d[:2] != b"BM":
        return None
    (n,) = struct.unpack("<I", d[14:18])
    if n == 12:
        w, h = struct.unpack("<HH", d[18:22])
        return "bmp", [(w, h, 0.0, 0.0)]
    w, h = struct.unpack("<ii", d[18:26])
    x, y = struct.unpack("<ii", d[38:46])
    return "bmp", [(w, abs(h), x * 0.0254, y * 0.0254)]


def _gif(d: bytes) -> Probe | None:
    if d[:6] not in (b"GIF87a", b"GIF89a"):
        return None
    w, h = struct.unpack("<HH", d[6:10])
    return "gif", [(w, h, 0.0, 0.0)]


def pnm_tokens(d: bytes, n: int, at: int = 2) -> tuple[list[int], int]:
    """``n`` numbers of a PNM header, past comments, and the offset after them."""
    out = []
    while len(out) < n:
        while d[at : at + 1].isspace() or d[at : at + 1] == b"#":
            at = d.index(b"\n", at) + 1 if d[at : at + 1] == b"#" else at + 1
        end = at
        while d[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("no number")
        out.append(int(d[at:end]))
        at = end
    return out, at


def _pnm(d: bytes) -> Probe | None:
    if d[:1] != b"P" or d[1:2] not in b"123456" or not d[2:3].isspace():
        return None
    (w, h), _ = pnm_tokens(d, 2)
    return {b"1": "pbm", b"4": "pbm", b"2": "pgm", b"5": "pgm"}.get(d[1:2], "ppm"), [(w, h, 0.0, 0.0)]


def tiff_directories(d: bytes) -> Iterator[dict[int, list]]:
    """The tags of each directory of a TIFF; a loop or a bad offset ends it."""
    order = {b"II": "<", b"MM": ">"}[d[:2]]
    (at,) = struct.unpack(order + "I", d[4:8])
    seen = set()
    while at and at not in seen and at + 2 <= len(d):
        seen.add(at)
        (n,) = struct.unpack(order + "H", d[at : at + 2])
        tags = {}
        for i in range(n):
            tag, kind, count, raw = struct.unpack(order + "HHI4s", d[at + 2 + 12 * i : at + 14 + 12 * i])
            width, code = {1: (1, "B"), 2: (1, "B"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II")}.get(kind, (0, ""))
            if not width:
                continue
            data = raw if width * count <= 4 else d[(o := struct.unpack(order + "I", raw)[0]) : o + width * count]
            values = struct.unpack(order + code * count, data[: width * count])
            tags[tag] = [a / b if b else 0.0 for a, b in zip(values[::2], values[1::2], strict=True)] if kind == 5 else list(values)
        yield tags
        (at,) = struct.unpack(order + "I", d[at + 2 + 12 * n : at + 6 + 12 * n])


def _tiff(d: bytes) -> Probe | None:
    if d[:4] not in (b"II*\0", b"MM\0*"):
        return None
    pages = []
    for t in tiff_directories(d):
        unit = {2: 1.0, 3: 2.54}.get(t.get(296, [2])[0], 0.0)
        pages.append((t.get(256, [0])[0], t.get(257, [0])[0], t.get(282, [0.0])[0] * unit, t.get(283, [0.0])[0] * unit))
    return "tiff", pages


def _pdf(d: bytes) -> Probe | None:
    """Pages of a plain PDF by their media boxes, in points as pixels at 72 dpi; packed object streams aren't read."""
    import re

    if d[:5] != b"%PDF-":
        return None
    boxes = re.findall(rb"/Type\s*/Page\b(?!s).*?/MediaBox\s*\[\s*([\d.\s-]+)\]", d, re.S)
    pages = [[float(x) for x in b.split()] for b in boxes]
    if not pages:
        raise ValueError("no plain page objects")
    return "pdf", [(round(p[2] - p[0]), round(p[3] - p[1]), 72.0, 72.0) for p in pages]


PROBES = (_png, _jpeg, _jp2, _heic, _webp, _bmp, _gif, _tiff, _pdf, _pnm)


def probe(data: bytes) -> Probe:
    for f in PROBES:
        found = f(data)
        if found:
            return found
    raise ValueError("unknown format")


def rows_of(path: str, data: bytes | None) -> list[tuple]:
    """A row for each page; pages count from 1 in files that can have several, else the page is 0."""
    try:
        kind, pages = probe(data or b"")
        many = kind in ("tiff", "pdf") and len(pages) > 1
        return [(path, i + 1 if many else 0, kind, int(w), int(h), round(x), round(y), "ok") for i, (w, h, x, y) in enumerate(pages)]
    except (ValueError, struct.error, KeyError, IndexError, ZeroDivisionError) as e:
        return [(path, 0, None, None, None, None, None, f"unreadable: {e}")]


def image_metadata(files: DataFrame) -> DataFrame:
    """Metadata of files (path, content): one row for each page."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for p, c in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True) for r in rows_of(p, c)]
            kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return files.select("path", "content").mapInArrow(of, SCHEMA)


def read_metadata(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    return image_metadata(spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder))


def snapped_dpi(largest: float) -> int:
    """The resolution to render a PDF at, from the largest raster in its first pages."""
    return 600 if largest > 500 else 400 if largest > 350 else 300
