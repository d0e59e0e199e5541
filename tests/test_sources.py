import json
import struct

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidarium.operators import counters
from evidarium.sources import files, sheets, slides, tables, threads


def test_sheets(spark, tmp_path):
    (tmp_path / "kits.csv").write_text('junk,,\n"x, y",,\n #,Brand,,Brand\n1,Acme,note,again\n2,—,,\n')
    df = sheets.with_header(spark, str(tmp_path / "kits.csv"), ["#", "brand"])
    assert df.columns == ["line", "#", "brand", "col2", "col3"]
    assert [tuple(r)[1:] for r in df.orderBy("line").collect()] == [("1", "Acme", "note", "again"), ("2", None, None, None)]
    with pytest.raises(ValueError):
        sheets.with_header(spark, str(tmp_path / "kits.csv"), ["nothing"])
    (tmp_path / "m.csv").write_text("b,n,M1,M2\nAcme,k,x,\nAcme,l,,maybe\n")
    got = sheets.donor_matrix(spark, str(tmp_path / "m.csv"), ["brand", "name"], ["M1", "M2"])
    assert sorted(tuple(r)[1:] for r in got.collect()) == [("Acme", "k", "M1", "x"), ("Acme", "l", "M2", "maybe")]


def test_wide_sheets_keep_every_cell(spark, tmp_path):
    names = ["#", "brand", *(f"n{i}" for i in range(30))]
    values = ["1", 'a, "b"\nc', *(str(i) for i in range(30)), "beyond the header"]
    quoted = ",".join('"' + v.replace('"', '""') + '"' for v in values)
    (tmp_path / "wide.csv").write_text("note\n" + ",".join(names) + "\n" + quoted + "\n")
    row = sheets.with_header(spark, str(tmp_path / "wide.csv"), ["#", "brand"]).collect()[0].asDict()
    assert list(row)[1:] == [*names, "col32"] and list(row.values())[1:] == values


def images():
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 640, 480)
    gif = b"GIF89a" + struct.pack("<HH", 33, 44)
    bmp = b"BM" + b"\0" * 16 + struct.pack("<ii", 7, 9)
    riff = lambda kind, body: b"RIFF\0\0\0\0WEBP" + kind + body
    vp8 = riff(b"VP8 ", b"\0" * 10 + struct.pack("<HH", 320 | 0x4000, 200))
    vp8x = riff(b"VP8X", b"\0" * 8 + (99).to_bytes(3, "little") + (49).to_bytes(3, "little"))
    vp8l = riff(b"VP8L", b"\0" * 4 + b"\x2f" + ((11) | (21 << 14)).to_bytes(4, "little"))
    jpg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x11\x08" + struct.pack(">HH", 30, 50) + b"\0" * 8
    tif = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 2) + struct.pack("<HHIHH", 256, 3, 1, 120, 0) + struct.pack("<HHII", 257, 4, 1, 80)
    big = b"MM\0*" + struct.pack(">I", 8) + struct.pack(">H", 2) + struct.pack(">HHIHH", 256, 3, 1, 12, 0) + struct.pack(">HHII", 257, 4, 1, 8)
    return {"a.png": (png, 640, 480), "b.gif": (gif, 33, 44), "c.bmp": (bmp, 7, 9), "d.webp": (vp8, 320, 200), "e.webp": (vp8x, 100, 50), "f.webp": (vp8l, 12, 22), "g.jpg": (jpg, 50, 30), "h.tif": (tif, 120, 80), "i.tiff": (big, 12, 8), "j.png": (png[:20], None, None), "k.jpg": (jpg[:9], None, None), "l.tif": (tif[:20], None, None)}


def test_image_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "skip").mkdir()
    for name, (data, _, _) in images().items():
        (tmp_path / "sub" / name).write_bytes(data)
    (tmp_path / "skip" / "x.png").write_bytes(images()["a.png"][0])
    (tmp_path / "copy.png").write_bytes(images()["a.png"][0])
    (tmp_path / "note.txt").write_text("x")
    sized = files.with_sizes(files.scan_files(spark, f"file://{tmp_path}", exclude=("skip",)))
    got = {r["filename"]: (r["width"], r["height"]) for r in sized.collect()}
    assert got == {n: (w, h) for n, (_, w, h) in images().items()} | {"copy.png": (640, 480)}
    listed = files.inventory(sized)
    by = {r["rel_path"]: r for r in listed.collect()}
    assert by["copy.png"]["duplicate_count"] == 2 and by["copy.png"]["is_canonical"] and not by["sub/a.png"]["is_canonical"]
    total = counters.duplicate_totals(listed).first()
    assert tuple(total) == (13, 12, 1, 1)
    assert files.load_ready(listed, F.lit("Subject")).count() == 12


def test_sizes_that_stand_far_behind(spark, tmp_path):
    far = (1 << 20) + 4096
    tif = b"II*\0" + struct.pack("<I", 8 + far) + b"\1" * far + struct.pack("<H", 2) + struct.pack("<HHIHH", 256, 3, 1, 120, 0) + struct.pack("<HHII", 257, 4, 1, 80)
    jpg = b"\xff\xd8" + (b"\xff\xe2\xff\xff" + b"\1" * 65533) * 20 + b"\xff\xc0\0\x11\x08" + struct.pack(">HH", 30, 50) + b"\0" * 8
    (tmp_path / "a.tif").write_bytes(tif)
    (tmp_path / "b.jpg").write_bytes(jpg)
    got = files.with_sizes(files.scan_files(spark, f"file://{tmp_path}")).select("filename", "width", "height").collect()
    assert sorted(map(tuple, got)) == [("a.tif", 120, 80), ("b.jpg", 50, 30)]


def test_threads(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"thread_urls": ["https://x/forums/threads/a.1/", ["https://x/forums/threads/b.22/", "B title"]]}))
    got = sorted(tuple(r) for r in threads.read_manifest(spark, str(tmp_path / "m.json")).select("thread_id", "title", "position").collect())
    assert got == [("1", None, 0), ("22", "B title", 1)]
    text = "=====\nTHREAD : Side guns?\nURL    : https://x/1\nTotal posts: 2\n=====\nPost #1  (forum post #77)\nAuthor    : Ann\nDate      : Mar 5, 2010 at 7:42 PM\nHello\n[IMAGE: a.jpg]\n-----\nPost #2  (forum post #78)\nAuthor    : Bo\nDate      : someday\nBye\n"
    posts = threads.parse_posts(spark.createDataFrame([(text,), ("no posts",)], "value string")).orderBy("number").collect()
    assert [(p["thread"], p["number"], p["post_id"], p["author"], p["total_agrees"]) for p in posts] == [("Side guns?", 1, "77", "Ann", True), ("Side guns?", 2, "78", "Bo", True)]
    assert str(posts[0]["posted_at"]) == "2010-03-05 19:42:00" and posts[1]["posted_at"] is None
    assert posts[0]["body"] == "Hello\n[IMAGE: a.jpg]" and posts[0]["images"] == ["a.jpg"] and posts[1]["body"] == "Bye"
    html = '<article data-content="p1" data-author="Ann"><time datetime="2010"></time><img src="/a.jpg"><img data-src="/a.jpg?x"><img src="data:x"><img src="/b.png"></article><img src="/no.png"><article data-content="p2"><article>x</article><img src="/c.gif"></article>'
    for name in ("t_page-2.html", "t.html", "t_latest.html"):
        (tmp_path / name).write_text(html if name == "t.html" else "<p>none</p>")
    pages = threads.scan_pages(spark, str(tmp_path / "*.html"))
    assert sorted((r["thread"], r["page_no"]) for r in pages.collect()) == [("t", 0), ("t", 2), ("t", 2147483647)]
    found = threads.post_images(pages, "https://h")
    assert sorted((r["post_id"], r["image_index"], r["image_url"]) for r in found.collect()) == [("p1", 1, "https://h/a.jpg"), ("p1", 2, "https://h/b.png"), ("p2", 1, "https://h/c.gif")]
    links = threads.link_manifest(found, spark.createDataFrame([("https://h/a.jpg", "s1")], "image_url string, sha256 string"))
    assert tuple(threads.thread_manifest(links).first()) == ("t", 1, 1, 2, 1)
    more = links.select("thread", "page_no", "place", "image_index", "image_url", "sha256", "status").union(spark.createDataFrame([("s", 9, 0, 1, "https://h/z.jpg", "s1", "copied"), ("u", 1, 0, 1, "https://h/y.jpg", "s2", "copied")], "thread string, page_no int, place int, image_index int, image_url string, sha256 string, status string"))
    assert sorted(map(tuple, threads.image_manifest(more).collect())) == [("s1", "s", 9, "https://h/z.jpg", 2), ("s2", "u", 1, "https://h/y.jpg", 1)]
    titles = spark.createDataFrame([("Side: guns?",), ("Top_Hull",), ("none",)], "title string")
    exports = spark.createDataFrame([("Side_ guns_", "p1"), ("side guns", "p2"), ("top hull", "p3"), ("TOP-HULL", "p4")], "name string, path string")
    assert sorted(map(tuple, threads.text_exports(titles, exports).select("title", "path").collect()), key=repr) == [("Side: guns?", "p1"), ("Top_Hull", "p3"), ("none", None)]


SLIDE = """<p:sld xmlns:p="p" xmlns:a="a" xmlns:r="r"><p:cSld><p:spTree>
<p:pic><p:blipFill><a:blip r:embed="rId1"/><a:srcRect l="10000" r="10000"/></p:blipFill><p:spPr><a:xfrm><a:off x="0" y="0"/><a:ext cx="100" cy="100"/></a:xfrm></p:spPr></p:pic>
<p:pic><p:blipFill><a:blip r:embed="rId2"/></p:blipFill><p:spPr><a:xfrm><a:off x="200" y="0"/><a:ext cx="200" cy="200"/></a:xfrm></p:spPr></p:pic>
<p:sp><p:spPr><a:xfrm><a:off x="40" y="40"/><a:ext cx="20" cy="20"/></a:xfrm><a:ln><a:solidFill><a:srgbClr val="00FF00"/></a:solidFill></a:ln></p:spPr><p:txBody><a:p><a:r><a:t>Gun </a:t></a:r><a:r><a:t>port</a:t></a:r></a:p></p:txBody></p:sp>
<p:sp><p:spPr><a:xfrm><a:off x="410" y="90"/><a:ext cx="20" cy="20"/></a:xfrm></p:spPr><p:txBody><a:p><a:r><a:t>Hull</a:t></a:r></a:p></p:txBody></p:sp>
<p:sp><p:spPr/><p:txBody><a:p><a:r><a:t>Deck Date: 1977 Source: x</a:t></a:r></a:p></p:txBody></p:sp>
</p:spTree></p:cSld></p:sld>"""


def test_slides(spark, tmp_path):
    (tmp_path / "slide7.xml").write_text(SLIDE)
    shapes = slides.read_shapes(spark, str(tmp_path))
    relations = spark.createDataFrame([(7, "rId1", "m1.png"), (7, "rId2", "m2.png")], "slide int, rel_id string, media_name string")
    pictures = slides.read_pictures(spark, str(tmp_path), relations)
    known = spark.createDataFrame([("m1.png", "old.png")], "media_name string, original_name string")
    got = {r["label_text"]: r for r in slides.overlay_labels(shapes, pictures, known, (1000, 500)).collect()}
    assert set(got) == {"Gun port", "Hull"}
    gun, hull = got["Gun port"], got["Hull"]
    assert (gun["assigned_media"], gun["mapping_quality"], gun["label_status"], gun["slide_title"]) == ("m1.png", "high_exact_reused_image", "identified_in_this_image", "Deck")
    assert gun["projected_x"] == pytest.approx(0.1 + 0.5 * 0.8) and gun["projected_y"] == 0.5 and gun["slide_x_norm"] == 0.05
    table = slides.overlay_labels(shapes, pictures, known, (1000, 500))
    assert slides.slide_table(table, pictures).select("slide", "picture_count", "unique_media_count", "base_media", "any_match", "here_labels", "other_labels", "same_media_reuse").collect() == [(7, 2, 2, "m2.png", True, 1, 1, False)]
    assert sorted(map(tuple, slides.media_table(table, pictures).collect())) == [("m1.png", "7", 1, 0), ("m2.png", "7", 1, 1)]
    assert (hull["assigned_media"], hull["mapping_quality"], hull["label_status"]) == ("m2.png", "medium_base_image_only", "other_or_unstyled")


def test_tables(spark, tmp_path):
    schema = T.StructType.fromDDL("id long, name string, extra double")
    spark.createDataFrame([(1, "a")], "id long, name string").write.parquet(str(tmp_path / "t"))
    assert [tuple(r) for r in tables.read_table(spark, str(tmp_path), "t", schema).collect()] == [(1, "a", None)]
    assert tables.read_table(spark, str(tmp_path), "none", schema, present=False).count() == 0
    old = spark.createDataFrame([("x", 1)], "name string, gone int")
    assert tables.conform(old, schema).columns == ["id", "name", "extra"]
    assert tables.drift(old, schema) == [("id", "missing"), ("extra", "missing"), ("gone", "undeclared")]
    blobs = spark.createDataFrame([("aa1", b"x"), ("aa1", b"x"), ("bb2", b"y")], "sha256 string, content binary")
    assert tables.write_blobs(blobs, None, str(tmp_path / "blobs")).count() == 2
    held = spark.read.parquet(str(tmp_path / "blobs"))
    tables.write_blobs(blobs, held, str(tmp_path / "blobs"))
    assert spark.read.parquet(str(tmp_path / "blobs")).count() == 2
    images = spark.createDataFrame([(1, "aa1"), (2, "aa1"), (3, "bb2"), (4, None)], "id long, sha256 string")
    assert [r[0] for r in tables.released(images, spark.createDataFrame([(1,), (3,)], "id long")).collect()] == ["bb2"]
    assert [r[0] for r in tables.orphans(held, spark.createDataFrame([("aa1",)], "sha256 string")).select("sha256").collect()] == ["bb2"]


def test_roots_are_names_and_no_patterns(spark, tmp_path):
    for name in ("c++ x", "a[1]{b}*?", "ü (1) $^."):
        root = tmp_path / name
        (root / "skip").mkdir(parents=True)
        (root / "sub").mkdir()
        for part in ("a.png", "skip/b.png", "sub/c d.PNG"):
            (root / part).write_bytes(images()["a.png"][0])
        for given in (str(root), f"file://{root}", f"file:{root}/"):
            got = files.scan_files(spark, given, exclude=("skip",)).select("rel_path", "filename").collect()
            assert sorted(map(tuple, got)) == [("a.png", "a.png"), ("sub/c d.PNG", "c d.PNG")]


def test_sizes_are_read_by_place(spark, tmp_path):
    def tiff(name, at, order, wide=False):
        num = lambda v, n: v.to_bytes(n, order)
        sign = {"little": b"II", "big": b"MM"}[order]
        short = lambda tag, v: num(tag, 2) + num(3, 2) + num(1, 8 if wide else 4) + num(v, 2) + bytes(6 if wide else 2)
        head = sign + (num(43, 2) + num(8, 2) + num(0, 2) + num(at, 8) if wide else num(42, 2) + num(at, 4))
        with open(tmp_path / name, "wb") as out:
            out.write(head)
            out.seek(at)  # the file is sparse
            out.write(num(2, 8 if wide else 2) + short(256, 640) + short(257, 480) + bytes(8))

    tiff("far.tif", 3 << 30, "little")
    tiff("big.tif", (5 << 30) + 6, "big", wide=True)
    tiff("near.tiff", 8, "big")
    (tmp_path / "cut.tif").write_bytes(b"II*\x00\xff\xff\xff\x7f")
    (tmp_path / "empty.jpg").write_bytes(b"\xff")
    (tmp_path / "x.jpg").write_bytes(b"\xff\xd8" + b"\xff\xe1\xff\xff" + bytes(65533) + b"\xff" * 9000 + b"\xc0\x00\x11\x08" + (30).to_bytes(2, "big") + (50).to_bytes(2, "big") + bytes(9))
    listed = files.scan_files(spark, str(tmp_path)).drop("content")
    got = {r["filename"]: (r["width"], r["height"]) for r in files.with_sizes(listed).collect()}
    assert got == {"far.tif": (640, 480), "big.tif": (640, 480), "near.tiff": (640, 480), "cut.tif": (None, None), "empty.jpg": (None, None), "x.jpg": (50, 30)}
