"""PDF sink: rasters in page order, with recognised words as an invisible text layer.

A file is written by one task as its pages pass by in order; only the offsets of its objects are kept.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Presets: largest resolution written.
QUALITY = {"small": 150, "normal": 300, "best": 600}


def _escape(text: str) -> bytes:
    raw = text.encode("cp1252", "replace")
    return raw.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")


def text_layer(words: list[dict], h: int, scale: float) -> bytes:
    """Words (text, x, y, w, h in pixels from the top) as text that isn't drawn, each stretched over its box."""
    out = [b"BT 3 Tr"]
    for w in words:
        size, raw = max(1.0, w["h"] * scale), _escape(w["text"])
        if not raw:
            continue
        stretch = 100 * w["w"] * scale / max(0.5 * size * len(w["text"]), 0.01)
        out.append(b"/F1 %.2f Tf %.2f Tz 1 0 0 1 %.2f %.2f Tm (%s) Tj" % (size, stretch, w["x"] * scale, (h - w["y"] - w["h"]) * scale, raw))
    return b"\n".join([*out, b"ET"])


class Writer:
    def __init__(self, out, title: str = "", author: str = ""):
        self.out, self.at, self.offsets, self.pages = out, 0, {}, []
        self._put(b"%PDF-1.5\n%\xe2\xe3\xcf\xd3\n")
        self._object(3, b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>")
        self._object(4, b"<< /Title (%s) /Author (%s) >>" % (_escape(title), _escape(author)))
        self.next = 5

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _object(self, number: int, body: bytes, stream: bytes | None = None) -> None:
        self.offsets[number] = self.at
        if stream is not None:
            body = body[:-2] + b"/Length %d >>\nstream\n%s\nendstream" % (len(stream), stream)
        self._put(b"%d 0 obj\n%s\nendobj\n" % (number, body))

    def page(self, a: np.ndarray, dpi: int, words: list[dict] = ()) -> None:
        """A page: bits for images of only black and white, else gray or RGB."""
        h, w = a.shape[:2]
        scale = 72 / dpi
        if a.ndim == 2 and np.isin(a, (0, 255)).all():
            kind, data = b"/ColorSpace /DeviceGray /BitsPerComponent 1", np.packbits(a > 127, axis=1).tobytes()
        else:
            kind, data = (b"/ColorSpace /DeviceRGB" if a.ndim == 3 else b"/ColorSpace /DeviceGray") + b" /BitsPerComponent 8", a.tobytes()
        image, content, page = self.next, self.next + 1, self.next + 2
        self.next += 3
        self._object(image, b"<< /Type /XObject /Subtype /Image /Width %d /Height %d %s /Filter /FlateDecode >>" % (w, h, kind), zlib.compress(data))
        draw = b"q %.2f 0 0 %.2f 0 0 cm /I Do Q\n" % (w * scale, h * scale) + (text_layer(list(words), h, scale) if words else b"")
        self._object(content, b"<< /Filter /FlateDecode >>", zlib.compress(draw))
        self._object(page, b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %.2f %.2f] /Resources << /XObject << /I %d 0 R >> /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (w * scale, h * scale, image, content))
        self.pages.append(page)

    def close(self) -> None:
        self._object(2, b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(self.pages), b" ".join(b"%d 0 R" % p for p in self.pages)))
        self._object(1, b"<< /Type /Catalog /Pages 2 0 R >>")
        start, n = self.at, max(self.offsets) + 1
        self._put(b"xref\n0 %d\n0000000000 65535 f \n" % n + b"".join(b"%010d 00000 n \n" % self.offsets[i] for i in range(1, n)))
        self._put(b"trailer << /Size %d /Root 1 0 R /Info 4 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (n, start))


def export(pages: DataFrame, folder: str, quality: str = "normal") -> DataFrame:
    """Write one PDF for each project of ``pages`` (project, pos, w, h, channels, px, dpi, words array of text, x, y, w, h).

    Pages of a project go to one task, sorted; they pass by one at a time. A page over the preset's
    resolution is scaled down. Returns project, path, pages. A file that is written again replaces the old one.
    """
    from ..functions import kernels as K

    most = QUALITY[quality]
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = pages.select("project", "pos", "w", "h", "channels", "px", "dpi", "words").repartition(n, "project").sortWithinPartitions("project", "pos")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        name, writer, out, made = None, None, None, None

        def finish() -> pa.RecordBatch:
            writer.close()
            out.close()
            path = f"{root}/{name}.pdf"
            fs.move(made, path)
            return pa.record_batch([pa.array([name]), pa.array([path]), pa.array([len(writer.pages)], pa.int32())], names=["project", "path", "pages"])

        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                if writer is None or row["project"] != name:
                    if writer is not None:
                        yield finish()
                    name, made = row["project"], f"{root}/{row['project']}.{uuid.uuid4().hex}.part"
                    out = fs.open_output_stream(made)
                    writer = Writer(out, name)
                a = np.frombuffer(row["px"], np.uint8).reshape((row["h"], row["w"], 3) if row["channels"] == 3 else (row["h"], row["w"]))
                dpi, words = row["dpi"] or 300, row["words"] or []
                if dpi > most:
                    f = most / dpi
                    size = max(1, round(row["h"] * f)), max(1, round(row["w"] * f))
                    a = K.scale_to_gray(a, *size) if a.ndim == 2 else np.stack([K.scale_to_gray(a[:, :, c], *size) for c in range(3)], 2)
                    words, dpi = [{**x, **{k: x[k] * f for k in "xywh"}} for x in words], most
                writer.page(a, dpi, words)
        if writer is not None:
            yield finish()

    return ordered.mapInArrow(of, "project string, path string, pages int")


def thumbnails(rasters: DataFrame, size: int = 200, scheme: int = 1) -> DataFrame:
    """Small gray images of rasters (path, w, h, channels, px), with the key they are kept by: the path's md5, size and scheme."""
    from ..functions import kernels as K

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, w, h, c, px in zip(*[b.column(k).to_pylist() for k in ("path", "w", "h", "channels", "px")], strict=True):
                if px is None:
                    continue
                g = K.luma(np.frombuffer(px, np.uint8).reshape((h, w, 3) if c == 3 else (h, w)))
                f = min(1.0, size / max(w, h))
                t = K.scale_to_gray(g, max(1, round(h * f)), max(1, round(w * f)))
                yield pa.record_batch([pa.array([path]), pa.array([t.shape[1]], pa.int32()), pa.array([t.shape[0]], pa.int32()), pa.array([t.tobytes()], pa.binary())], names=["path", "w", "h", "px"])

    small = rasters.select("path", "w", "h", "channels", "px").mapInArrow(of, "path string, w int, h int, px binary")
    return small.withColumn("key", F.concat_ws("-", F.md5("path"), F.lit(size), F.lit(scheme)))
