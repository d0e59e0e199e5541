import math

import pytest
from pyspark.sql import functions as F

from evidarium.functions import geometry as g
from evidarium.functions import text as t


def values(spark, expression, *rows):
    return [r[0] for r in spark.createDataFrame([(i, *((r,) if not isinstance(r, tuple) else r)) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{c} string" for c in "abc"[: len(rows[0]) if isinstance(rows[0], tuple) else 1])).orderBy("i").select(expression).collect()]


@pytest.fixture(autouse=True)
def columns(spark):
    globals().update(A=F.col("a"), B=F.col("b"), C=F.col("c"))


def test_numbers(spark):
    rows = ("3", " 4 ", "3.7", "", None, "x", "NaN", "99999999999", "-2")
    assert values(spark, t.to_int(A), *rows) == [3, 4, None, None, None, None, None, None, -2]
    assert values(spark, t.safe_int(A), *rows) == [3, 4, 3, None, None, None, None, None, -2]
    assert values(spark, t.maybe_float(A), "1.5", "N/A", "") == [1.5, None, None]
    assert values(spark, t.flag(A), "Yes", "off", "maybe", None, " 1 ") == [1, 0, None, None, 1]
    assert values(spark, t.loose_flag(A), "no", "x") == [0, 1]


def test_strings(spark):
    assert values(spark, t.clean(A), "—", "none", " a ", "", None, "-") == [None, None, "a", None, None, None]
    assert values(spark, t.tag_list(A), " b, a,,b ", "", None) == [["b", "a", "b"], [], []]
    assert values(spark, t.squeezed(A), " A__b-C  d ") == ["a b c d"]
    assert values(spark, t.nfkc(A), "ﬁ①", None) == ["fi1", None]
    assert values(spark, t.match_key(A), "Don’t-STOP 1") == ["dontstop1"]
    assert values(spark, t.slug_upper(A), " a b! ", "—", None) == ["A-B", "UNKNOWN", "UNKNOWN"]
    assert values(spark, t.safe_filename(A), 'a/b:  c?', "  ", None) == ["a_b_ c_", "thread", "thread"]
    assert values(spark, t.thread_id(A), "https://x/forums/threads/a-b.123/", "https://x/threads/b") == ["123", None]
    assert values(spark, t.image_url(A, "https://b"), "/a.JPG?x=1", "data:image/png;base64,", "//c/d.png#e", "e.txt", "http://f/g.gif") == ["https://b/a.JPG", None, "https://c/d.png", None, "http://f/g.gif"]
    assert values(spark, t.without_date(A), "Title\n Date: 1977\nmore", None) == ["Title", ""]
    assert values(spark, t.ordinal(A), "slide12.xml", "slide.xml") == [12, None]
    assert values(spark, t.note_union(A, B), ("x\ny", " y\nz"), (None, ""), ("a", None)) == ["x\ny\nz", None, "a"]
    assert values(spark, t.note_value(A, "k"), "k=1\nj=2\nk=a=b", "j=1", None) == ["a=b", None, None]
    assert values(spark, t.note_map(A), "k=1\nplain\nj=2\nk=3", None) == [{"j": "2", "k": "3"}, {}]
    assert values(spark, t.generic_title(A), "Slide 3", "image04.PNG", "Hull", "", None, " N/A", "open", "photo", "image4.png.jpg", "image.png", "image3.svg") == [False, True, False, True, True, True, True, False, False, False, False]
    assert values(spark, t.humanized(A), "hull_plate-A  b", "unknown", " ", None, "None", "-_") == ["hull plate A b", None, None, None, None, None]
    assert values(spark, t.excerpt(A, 3), "abcd", "abc") == ["abc...", "abc"]
    assert values(spark, t.file_score(A, ("hull", "wing")), "0123456789abcdef0123.jpg", "hull-a-long-file-name.jpg") == [1, 4]
    assert values(spark, t.hash_like(A), "0123456789ABCDEF0123-x9.jpg", "0123456789abcdef012.jpg", "0123456789abcdef0123-.jpg", "0123456789abcdef0123-a-b") == [True, False, False, False]
    assert values(spark, t.storage_kind(A, B, C), (None, "d", None), ("", None, "u"), ("x", "d", "u"), (None, "", "")) == ["drive", "url", "x", "other"]
    assert values(spark, t.thread_title(A, B, C), (None, "<title> T </title>", "u"), ("", "", "https://x/threads/my-thread.1/"), ("S", "", "")) == ["T", "My Thread", "S"]


def test_reference_numbers(spark):
    df = spark.createDataFrame([(1, 47, None), (2, 47, 0), (3, 47, 2), (4, None, 2)], "n int, b int, s int")
    assert [r[0] for r in df.select(t.reference_number(F.col("n"), F.col("b"), F.col("s"))).collect()] == ["47#", "47#", "472", "4"]


def test_search_text(spark):
    rows = ("a_c", "abc", "A%C", "back\\slash", None, "ÉTÉ")
    assert values(spark, t.like_any("a_c", A), *rows) == [True, True, True, False, False, False]
    assert values(spark, t.like_any("\\s", A), *rows) == [False, False, False, True, False, False]
    assert values(spark, t.like_any("été", A), *rows)[-1]
    assert values(spark, t.whole_word(A, "isd"), "the isd", "isdn", "x-isd.", None) == [True, False, True, None]


def test_geometry(spark):
    one = spark.range(1)
    d = lambda x, y: one.select(g.distance(F.lit(x), F.lit(y), F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(1.0))).first()[0]
    assert d(1.0, 0.5) == 0 and d(5.0, 5.0) == 5.0 and d(-3.0, 1.0) == 3.0
    assert one.select(g.uncropped(F.lit(0.5), F.lit(0.0), F.lit(0.0))).first()[0] == 0.5
    assert one.select(g.relative(F.lit(1.0), F.lit(0.0), F.lit(0.0))).first()[0] is None
    pose = spark.createDataFrame([(math.sqrt(0.5), 0.0, math.sqrt(0.5), 0.0, 1.0, 2.0, 3.0)], "qw double, qx double, qy double, qz double, tx double, ty double, tz double")
    s, turn, shift = 2.0, (math.sqrt(0.5), 0.0, 0.0, math.sqrt(0.5)), (1.0, -1.0, 0.5)
    moved = g.camera_update(pose, s, turn, shift).first()
    quat = lambda q, v: [r for r in one.select(*g.rotated(tuple(map(F.lit, q)), tuple(map(F.lit, v)))).first()]
    p = (0.3, -0.7, 1.1)
    world = [s * a + b for a, b in zip(quat(turn, p), shift)]
    before = [a + b for a, b in zip(quat(tuple(pose.first()[:4]), p), pose.first()[4:])]
    after = [a + b for a, b in zip(quat(tuple(moved[:4]), tuple(world)), moved[4:])]
    assert after == pytest.approx([s * x for x in before])


def test_compatibility_form_puts_marks_and_letters_together(spark):
    import unicodedata

    odd = ["é", "é", "ﬁ①ａＢ", "한", "한", "plain", "", None, "Å x y"]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in odd], "v string").select(t.nfkc(F.col("v"))).collect()]
    assert got == [None if v is None else unicodedata.normalize("NFKC", v) for v in odd]


def test_names_of_social_exports(spark):
    names = ["123456_234567_345678_n.jpg", "x_123456_234567_345678_O", "a123456_234567_345678_n.jpg", "12345_234567_345678_n.jpg", "x_12345678_23456789_34567890_n (1).png", "x_12345678_23456789_34567890_name.png", "hull.jpg", None]
    assert values(spark, t.social_export(A), *names) == [True, True, False, False, True, False, False, None]
    files = spark.createDataFrame([("in/123456_234567_345678_n.jpg",), ("in/hull.jpg",)], "rel_path string")
    from evidarium.operators.rules import Source, infer_source

    found = infer_source(files, {}, [(t.social_export(F.element_at(F.split("rel_path", "/"), -1)), Source("social", "", "", "medium"))])
    assert sorted(r["source_platform"] for r in found.collect()) == ["social", "unknown"]
