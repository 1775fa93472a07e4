"""Image codecs in numpy: PNM, BMP, PNG and TIFF (plain, PackBits, Deflate), gray or RGB, 8 bits.

``read_images`` turns a binaryFile table into rasters, ``write_images`` writes rasters as files.
Formats that need a closed or missing decoder (PDF, HEIC, JPEG, JPEG-2000, WebP) are only probed.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame

from .probes import pnm_tokens, tiff_directories

RASTER = "path string, page int, w int, h int, channels int, px binary"


def read_pnm(d: bytes) -> np.ndarray:
    kind = d[1:2]
    if kind in b"14":
        (w, h), at = pnm_tokens(d, 2)
        if kind == b"1":
            bits = np.array([c - 48 for c in d[at:] if c in b"01"], np.uint8)[: w * h].reshape(h, w)
        else:
            row = -(-w // 8)
            bits = np.unpackbits(np.frombuffer(d, np.uint8, row * h, at + 1).reshape(h, row), axis=1)[:, :w]
        return ((1 - bits) * 255).astype(np.uint8)
    (w, h, most), at = pnm_tokens(d, 3)
    c = 3 if kind in b"36" else 1
    if kind in b"23":
        values = np.array(d[at:].split()[: w * h * c], float)
    else:
        values = np.frombuffer(d, ">u2" if most > 255 else np.uint8, w * h * c, at + 1).astype(float)
    out = np.floor(values * 255 / most + 0.5).astype(np.uint8).reshape(h, w, c)
    return out[:, :, 0] if c == 1 else out


def write_pnm(a: np.ndarray) -> bytes:
    kind = b"P6" if a.ndim == 3 else b"P5"
    return b"%s\n%d %d\n255\n" % (kind, a.shape[1], a.shape[0]) + a.astype(np.uint8).tobytes()


def read_bmp(d: bytes) -> np.ndarray:
    (start,), (n,) = struct.unpack("<I", d[10:14]), struct.unpack("<I", d[14:18])
    w, h, _, depth, packed = struct.unpack("<iiHHI", d[18:34])
    if packed:
        raise ValueError("packed BMP")
    row = (w * depth + 31) // 32 * 4
    lines = np.frombuffer(d, np.uint8, row * abs(h), start).reshape(abs(h), row)
    lines = lines[::-1] if h > 0 else lines
    if depth in (24, 32):
        return np.ascontiguousarray(lines[:, : w * depth // 8].reshape(abs(h), w, depth // 8)[:, :, 2::-1])
    colors = np.frombuffer(d, np.uint8, (start - 14 - n) // 4 * 4, 14 + n).reshape(-1, 4)[:, 2::-1]
    index = np.unpackbits(lines, axis=1)[:, :w] if depth == 1 else lines[:, :w]
    if depth not in (1, 8):
        raise ValueError("BMP depth")
    out = colors[index]
    return out[:, :, 0] if (colors[:, :1] == colors).all() else out


def write_bmp(a: np.ndarray, dpi: int = 300) -> bytes:
    h, w = a.shape[:2]
    depth, colors = (24, b"") if a.ndim == 3 else (8, np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(-1, 4).copy().tobytes())
    row = (w * depth + 31) // 32 * 4
    lines = np.zeros((h, row), np.uint8)
    lines[:, : w * depth // 8] = (a[:, :, ::-1] if a.ndim == 3 else a)[::-1].reshape(h, -1)
    meter, start = round(dpi / 0.0254), 54 + len(colors)
    return struct.pack("<2sIHHI", b"BM", start + lines.size, 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, depth, 0, lines.size, meter, meter, len(colors) // 4, 0) + colors + lines.tobytes()


def _unfilter(raw: np.ndarray, bpp: int) -> np.ndarray:
    """PNG lines (filter, then bytes) without their filters."""
    out = np.zeros((len(raw), raw.shape[1] - 1), np.uint8)
    above = np.zeros(out.shape[1], np.uint8)
    for i, line in enumerate(raw):
        kind, x = line[0], line[1:].copy()
        if kind == 2:
            x += above
        elif kind == 1:
            for k in range(bpp):
                x[k::bpp] = np.cumsum(x[k::bpp], dtype=np.uint64).astype(np.uint8)
        elif kind in (3, 4):
            v = x.tolist()
            up = above.tolist()
            for j in range(len(v)):
                a, b = (v[j - bpp] if j >= bpp else 0), up[j]
                if kind == 3:
                    p = (a + b) // 2
                else:
                    c = up[j - bpp] if j >= bpp else 0
                    da, db, dc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    p = a if da <= db and da <= dc else b if db <= dc else c
                v[j] = (v[j] + p) & 255
            x = np.array(v, np.uint8)
        out[i] = above = x
    return out


def read_png(d: bytes) -> np.ndarray:
    at, data, palette = 8, [], None
    w, h, depth, kind, _, _, laced = struct.unpack(">IIBBBBB", d[16:29])
    while at + 8 <= len(d):
        n, tag = struct.unpack(">I4s", d[at : at + 8])
        if tag == b"IDAT":
            data.append(d[at + 8 : at + 8 + n])
        if tag == b"PLTE":
            palette = np.frombuffer(d, np.uint8, n, at + 8).reshape(-1, 3)
        at += 12 + n
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    if laced or depth == 16:
        raise ValueError("interlaced or 16-bit PNG")
    row = -(-w * channels * depth // 8)
    lines = _unfilter(np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)[: h * (row + 1)].reshape(h, row + 1), max(1, channels * depth // 8))
    if depth < 8:
        bits = np.unpackbits(lines, axis=1).reshape(h, -1, depth)[:, :w]
        lines = (bits * (1 << np.arange(depth)[::-1])).sum(2).astype(np.uint8)
        if kind == 0:
            lines = lines * (255 // ((1 << depth) - 1))
    out = lines.reshape(h, w, channels)
    if kind == 3:
        return palette[out[:, :, 0]]
    return out[:, :, 0] if channels < 3 else out[:, :, :3]


def write_png(a: np.ndarray, dpi: int = 300) -> bytes:
    h, w = a.shape[:2]
    lines = np.zeros((h, a.size // h + 1), np.uint8)
    lines[:, 1:] = a.reshape(h, -1)
    chunk = lambda tag, body: struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))
    meter = round(dpi / 0.0254)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if a.ndim == 3 else 0, 0, 0, 0)) + chunk(b"pHYs", struct.pack(">IIB", meter, meter, 1)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def _packbits(d: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(d):
        n = d[i]
        if n < 128:
            out += d[i + 1 : i + 2 + n]
            i += 2 + n
        else:
            if n > 128:
                out += d[i + 1 : i + 2] * (257 - n)
            i += 2
    return bytes(out)


def read_tiff(d: bytes, page: int = 0) -> np.ndarray:
    """One page of a TIFF: 1-bit, 8-bit gray or indexed, or RGB."""
    t = list(tiff_directories(d))[page]
    w, h, depth = t[256][0], t[257][0], t.get(258, [1])
    packed, kind, samples = t.get(259, [1])[0], t.get(262, [1])[0], t.get(277, [1])[0]
    unpack = {1: bytes, 8: zlib.decompress, 32946: zlib.decompress, 32773: _packbits}.get(packed)
    if unpack is None:
        raise ValueError(f"TIFF compression {packed}")
    data = b"".join(unpack(d[o : o + n]) for o, n in zip(t[273], t[279], strict=True))
    row = -(-w * samples * depth[0] // 8)
    lines = np.frombuffer(data, np.uint8, row * h).reshape(h, row)
    if depth[0] == 1:
        bits = np.unpackbits(lines, axis=1)[:, :w]
        return ((bits if kind == 1 else 1 - bits) * 255).astype(np.uint8)
    out = lines.reshape(h, w, samples)
    if kind == 3:
        table = (np.array(t[320]).reshape(3, -1).T >> 8).astype(np.uint8)
        return table[out[:, :, 0]]
    out = 255 - out if kind == 0 else out
    return out[:, :, 0].copy() if samples < 3 else out[:, :, :3].copy()


def write_tiff(pages: list[np.ndarray], dpi: int = 300, deflate: bool = True) -> bytes:
    """A multi-page TIFF; boolean pages (black is true) get one bit a pixel."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for a in pages:
        h, w = a.shape[:2]
        bilevel, samples = a.dtype == bool, 3 if a.ndim == 3 else 1
        raw = np.packbits(a, axis=1).tobytes() if bilevel else a.astype(np.uint8).tobytes()
        data = zlib.compress(raw) if deflate else raw
        at = len(out)
        out += data + b"\0" * (len(data) % 2)
        extra = len(out)
        out += struct.pack("<IIII", dpi, 1, dpi, 1) + struct.pack("<HHH", 8, 8, 8) + b"\0\0"
        short, long_, ratio = 3, 4, 5
        tags = [(256, long_, 1, w), (257, long_, 1, h), (258, short, samples, 1 if bilevel else 8 if samples == 1 else extra + 16), (259, short, 1, 8 if deflate else 1), (262, short, 1, 0 if bilevel else 2 if samples == 3 else 1),
                (273, long_, 1, at), (277, short, 1, samples), (278, long_, 1, h), (279, long_, 1, len(data)), (282, ratio, 1, extra), (283, ratio, 1, extra + 8), (296, short, 1, 2)]
        out[link : link + 4] = struct.pack("<I", len(out))
        out += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *x) for x in tags)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def decode(data: bytes, page: int = 0) -> np.ndarray:
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return read_png(data)
    if data[:2] == b"BM":
        return read_bmp(data)
    if data[:4] in (b"II*\0", b"MM\0*"):
        return read_tiff(data, page)
    if data[:1] == b"P" and data[1:2] in b"123456":
        return read_pnm(data)
    raise ValueError("no decoder for this format")


WRITERS = {"png": write_png, "bmp": write_bmp, "tif": lambda a: write_tiff([a]), "pnm": write_pnm}


def read_images(files: DataFrame) -> DataFrame:
    """Files (path, content, page from 0) to rasters; a file that can't be decoded has a null raster. A few images at a time."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data, page in zip(*[b.column(c).to_pylist() for c in ("path", "content", "page")], strict=True):
                try:
                    a = decode(data or b"", page)
                    row = (path, page, a.shape[1], a.shape[0], 3 if a.ndim == 3 else 1, np.ascontiguousarray(a).tobytes())
                except (ValueError, struct.error, KeyError, IndexError, zlib.error):
                    row = (path, page, None, None, None, None)
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
                yield pa.record_batch([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in RASTER.split(", ")])

    return files.select("path", "content", "page").mapInArrow(of, RASTER)


def write_images(rasters: DataFrame, folder: str, ext: str = "png") -> DataFrame:
    """Write rasters (path: the file's name, w, h, channels, px) under ``folder``; a file appears whole or not at all."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for b in batches:
            names = []
            for name, w, h, c, px in zip(*[b.column(k).to_pylist() for k in ("path", "w", "h", "channels", "px")], strict=True):
                a = np.frombuffer(px, np.uint8).reshape((h, w, 3) if c == 3 else (h, w))
                path = f"{root}/{name}.{ext}"
                fs.create_dir(os.path.dirname(path), recursive=True)
                made = f"{path}.{uuid.uuid4().hex}.part"
                with fs.open_output_stream(made) as out:
                    out.write(WRITERS[ext](a))
                fs.move(made, path)
                names.append(path)
            yield pa.record_batch([pa.array(names, pa.string())], names=["path"])

    return rasters.select("path", "w", "h", "channels", "px").mapInArrow(of, "path string")
