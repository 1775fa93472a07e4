import os
import struct
import zlib

import numpy as np
import pytest

from folioloom.sources import codecs as C
from folioloom.sources import probes as P
from folioloom.sources import project

GRAY = np.arange(19 * 31, dtype=np.int64).reshape(19, 31).astype(np.uint8)
RGB = np.stack([GRAY, 255 - GRAY, GRAY // 2], 2)


def box(kind, body):
    return struct.pack(">I4s", 8 + len(body), kind) + body


HEADERS = {
    "gif": (b"GIF89a" + struct.pack("<HH", 40, 30) + b"\0" * 5, (40, 30, 0, 0)),
    "webp": (b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (39).to_bytes(3, "little") + (29).to_bytes(3, "little"), (40, 30, 0, 0)),
    "jpeg": (b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"JFIF\0\1\1\1" + struct.pack(">HH", 300, 200) + b"\0\0\xff\xc0" + struct.pack(">HBHHB", 17, 8, 30, 40, 3) + b"\0" * 9, (40, 30, 300, 200)),
    "jp2": (box(b"jP  ", b"\r\n\x87\n") + box(b"ftyp", b"jp2 ") + box(b"jp2h", box(b"ihdr", struct.pack(">II", 30, 40) + b"\0" * 6) + box(b"res ", box(b"resc", struct.pack(">HHHHbb", 300, 254, 300, 254, 4, 4)))), (40, 30, 300, 300)),
    "heic": (box(b"ftyp", b"heic\0\0\0\0") + box(b"meta", b"\0" * 4 + box(b"iprp", box(b"ipco", box(b"ispe", b"\0" * 4 + struct.pack(">II", 20, 10)) + box(b"ispe", b"\0" * 4 + struct.pack(">II", 40, 30))))), (40, 30, 0, 0)),
    "ppm": (b"P3\n# a comment\n40 30\n255\n", (40, 30, 0, 0)),
    "pdf": (b"%PDF-1.4 1 0 obj <</Type /Page /MediaBox [0 0 40 30]>> endobj", (40, 30, 72, 72)),
}


@pytest.mark.parametrize("kind", HEADERS)
def test_headers(kind):
    data, want = HEADERS[kind]
    assert P.rows_of("f", data) == [("f", 0, kind, *want, "ok")]
    for cut in range(len(data)):
        rows = P.rows_of("f", data[:cut])  # a file cut short never breaks the scan
        assert len(rows) >= 1


@pytest.mark.parametrize("a", [GRAY, RGB], ids=["gray", "rgb"])
def test_codecs_round_trip(a):
    for write in C.WRITERS.values():
        data = write(a)
        assert (C.decode(data) == a).all()
        (row,) = P.rows_of("x", data)
        assert row[3:5] == (31, 19)
    assert P.rows_of("x", C.write_png(a, 400))[0][5:7] == (400, 400)
    assert P.rows_of("x", C.write_bmp(a, 400))[0][5:7] == (400, 400)


def test_tiff_pages():
    data = C.write_tiff([GRAY, RGB, GRAY > 99], dpi=600)
    rows = P.rows_of("x", data)
    assert [r[1] for r in rows] == [1, 2, 3] and {r[5] for r in rows} == {600}
    assert (C.read_tiff(data, 1) == RGB).all()
    assert (C.read_tiff(data, 2) == np.where(GRAY > 99, 0, 255)).all()
    assert C._packbits(bytes([2, 1, 2, 3, 254, 9, 128])) == b"\1\2\3\x09\x09\x09"


def test_png_filters():
    h, w = GRAY.shape
    raw, above = b"", np.zeros(w, int)
    for y, line in enumerate(GRAY.astype(int)):
        left, corner = np.concatenate([[0], line[:-1]]), np.concatenate([[0], above[:-1]])
        p = left + above - corner
        da, db, dc = abs(p - left), abs(p - above), abs(p - corner)
        paeth = np.where((da <= db) & (da <= dc), left, np.where(db <= dc, above, corner))
        guess = [np.zeros(w, int), left, above, (left + above) // 2, paeth][y % 5]
        raw += bytes([y % 5]) + ((line - guess) & 255).astype(np.uint8).tobytes()
        above = line
    chunk = lambda t, b: struct.pack(">I", len(b)) + t + b + struct.pack(">I", zlib.crc32(t + b))
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    assert (C.read_png(data) == GRAY).all()


def test_ascii_pnm():
    assert C.read_pnm(b"P1\n3 2\n1 0 1\n0 1 0\n").tolist() == [[0, 255, 0], [255, 0, 255]]
    assert C.read_pnm(b"P2\n2 1\n15\n15 0\n").tolist() == [[255, 0]]


def test_scan_and_write(spark, tmp_path):
    for name, data in {"a.png": C.write_png(GRAY), "b.tif": C.write_tiff([GRAY, GRAY]), "c.bin": b"junk", "d.pgm": C.write_pnm(GRAY)}.items():
        (tmp_path / name).write_bytes(data)
    rows = P.read_metadata(spark, f"file://{tmp_path}").collect()
    assert len(rows) == 5 and sum(r.status == "ok" for r in rows) == 4
    files = spark.read.format("binaryFile").load(f"file://{tmp_path}").selectExpr("path", "content", "0 as page")
    found = {r.path.rsplit("/")[-1]: r for r in C.read_images(files).collect()}
    assert found["c.bin"].px is None and found["b.tif"].px == GRAY.tobytes()
    rasters = spark.createDataFrame([("out/x", 31, 19, 1, bytearray(GRAY.tobytes()))], "path string, w int, h int, channels int, px binary")
    (w,) = C.write_images(rasters, f"file://{tmp_path}/r").collect()
    assert (C.decode((tmp_path / "r/out/x.png").read_bytes()) == GRAY).all() and w.path.endswith("r/out/x.png")


PROJECT = """<project version="4" layoutDirection="LTR" outputDirectory="out">
<directories><directory id="1" path="scans"/></directories>
<files><file id="2" dirId="1" name="page1.png"/><file id="5" dirId="1" name="spread.png"/></files>
<images><image id="3" fileId="2" fileImage="0" subPages="1"><size width="1000" height="1400"/><dpi horizontal="300" vertical="300"/></image>
<image id="6" fileId="5" fileImage="0" subPages="2"><size width="2000" height="1400"/><dpi horizontal="300" vertical="300"/></image></images>
<pages><page id="4" imageId="3" subPage="single"/><page id="7" imageId="6" subPage="left"/><page id="8" imageId="6" subPage="right"/></pages>
<filters><deskew><params id="4" angle="1.25"/></deskew></filters></project>"""


def test_project_round_trip(spark, tmp_path):
    (tmp_path / "p.xml").write_text(PROJECT)
    path = f"file://{tmp_path}/p.xml"
    pages = project.read_pages(spark, path)
    want = [(4, "scans/page1.png", "single", 1000), (7, "scans/spread.png", "left", 2000), (8, "scans/spread.png", "right", 2000)]
    assert sorted((r.page_id, r.path, r["sub"], r.w) for r in pages.collect()) == want
    assert project.read_version(spark, path).first().is_supported
    assert project.read_stage(spark, path, "params", "_id int, _angle double").first()._angle == 1.25
    project.write_pages(pages, f"file://{tmp_path}/out")
    again = project.read_pages(spark, f"file://{tmp_path}/out/*")
    assert sorted((r.path, r["sub"], r.w, r.dpi_x) for r in again.collect()) == sorted((w[1], w[2], w[3], 300) for w in want)


def test_sidecar_and_metrics(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"version": 1, "item": {"key": "K"}, "attachment": {"path": "a.pdf"}, "other": 1}')
    (tmp_path / "t.json").write_text("{}")
    got = {r.is_valid for r in project.read_sidecars(spark, f"file://{tmp_path}/*.json").collect()}
    assert got == {True, False}
    rows = spark.createDataFrame([("r", "split", 40, 2), ("r", "ocr", 60, 2)], "run string, stage string, ms int, pages int")
    assert project.metrics_json(rows).first().json == '{"run":"r","total_ms":100,"pages":2,"ms_per_page":50.0,"stages":{"ocr":60,"split":40}}'


def test_snapped_dpi():
    assert [P.snapped_dpi(x) for x in (100, 351, 500, 501)] == [300, 400, 400, 600]


def test_pdf(spark, tmp_path):
    from folioloom.sources import pdf

    rows = [("book", i, 31, 19, 1, bytearray(GRAY.tobytes()), 300, [("Hi (you)", 1.0, 2.0, 10.0, 5.0)]) for i in (1, 0)] + [("other", 0, 31, 19, 3, bytearray(RGB.tobytes()), 600, None)]
    kind = "project string, pos int, w int, h int, channels int, px binary, dpi int, words array<struct<text:string,x:double,y:double,w:double,h:double>>"
    got = {r.project: r for r in pdf.export(spark.createDataFrame(rows, kind), f"file://{tmp_path}").collect()}
    assert {k: r.pages for k, r in got.items()} == {"book": 2, "other": 1}
    data = (tmp_path / "book.pdf").read_bytes()
    assert data.startswith(b"%PDF-") and data.endswith(b"%%EOF\n")
    start = int(data.rsplit(b"startxref\n", 1)[1].split()[0])
    table = data[start:].split(b"\n")
    for i, line in enumerate(table[3 : 3 + int(table[1].split()[1]) - 1], 1):
        assert data[int(line[:10]) :].startswith(b"%d 0 obj" % i)
    assert [r[3:5] for r in P.rows_of("f", data)] == [(7, 5), (7, 5)]
    assert {p.name for p in tmp_path.iterdir()} == {"book.pdf", "other.pdf"}


def test_thumbnails(spark):
    from folioloom.sources import pdf

    df = spark.createDataFrame([("p", 31, 19, 1, bytearray(GRAY.tobytes())), ("q", 1, 1, 1, None)], "path string, w int, h int, channels int, px binary")
    (r,) = pdf.thumbnails(df, 10).collect()
    assert (r.w, r.h, len(r.px)) == (10, 6, 60) and r.key.endswith("-10-1")


def test_project_folder(tmp_path):
    folder = project.project_folder(str(tmp_path / "Book"), create=True)
    assert all(os.path.isdir(folder[k]) for k in ("originals", "cache", "output"))
    assert os.path.basename(folder["project"]) == "Book.xml"
    (tmp_path / "a.b.tif").write_bytes(b"1")
    (tmp_path / "plain").write_bytes(b"2")
    copied = [os.path.basename(project.copy_original(str(tmp_path / n), str(tmp_path / "Book"))) for n in ("a.b.tif", "a.b.tif", "a.b.tif", "plain", "plain")]
    assert copied == ["a.b.tif", "a.b_1.tif", "a.b_2.tif", "plain", "plain_1"]
    assert project.copy_original(str(tmp_path / "none"), str(tmp_path / "Book")) is None
