import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from foliant.functions import codes, dates, formats, html, text
from foliant.operators.query import fold_literal, parse_query


def one(spark, values, schema, column):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(column).collect()]


def test_fold(spark):
    cases = {"Ships; sails & sea": "ships sails sea", "山。海！川": "山海川", "茶tea茶": "茶 tea 茶", "ＱＲ７": "qr7", "?!": "", "ΚΟΣΜΟΣ": "κοσμοσ", "x-山 y": "x 山 y"}
    assert one(spark, cases, "t string", text.fold(F.col("t"))) == list(cases.values())
    assert [fold_literal(t) for t in cases] == list(cases.values())


def test_words_and_language(spark):
    assert one(spark, ["山海 three short words 7", "-- ??", "red, blue; green", None], "t string", text.word_count(F.col("t"))) == [6, 0, 3, 0]
    assert one(spark, ["山海川月", "さくらの山", "바다와 산", "plain words", ""], "t string", text.guess_language(F.col("t"))) == ["zh", "ja", "ko", None, None]


def test_codes(spark):
    assert one(spark, ["English", " 中文-粵語", "Suomi", "Quenya", None], "t string", codes.language_code(F.col("t"))) == ["en", "zh", "fi", None, None]
    assert one(spark, [" EN", "xx"], "t string", codes.language_label(F.col("t"))) == ["English", "xx"]
    assert one(spark, ["translation_into", "inspired_by", "x"], "t string", codes.relation_kind(F.col("t"))) == ["translation", "related", None]
    assert one(spark, ["1,234 words", "", "none"], "t string", codes.typed_count(F.col("t"))) == [1234, 0, 0]
    assert one(spark, ["3", " 4.5", "x", ""], "t string", codes.typed_position(F.col("t"))) == [3, 4, None, None]
    assert one(spark, ["year", None], "t string", codes.date_title(F.col("t"), F.lit(True))) == ["只知道年份，数值为估算", "没有日期，数值为估算"]


def test_json_and_tags(spark):
    assert one(spark, ['["a","b"]', '[1,"a"]', "oops", None], "t string", text.string_array(F.col("t"))) == [["a", "b"], [], [], []]
    assert one(spark, [[" Fluff ", "fluff", "", "Angst"]], "t array<string>", text.dedupe_nocase(F.col("t"))) == [["Angst", "Fluff"]]


def test_blank_lines(spark):
    assert one(spark, ["\n a \n\n\n\nb\r\n"], "t string", text.collapse_blank_lines(F.col("t"))) == ["a\n\nb"]


def test_dates(spark):
    cases = {"2018-06-09": ("2018-06-09", "day"), "2020-06": ("2020-06-01", "month"), "2020": ("2020-01-01", "year"), "2018/6/9": ("2018-06-09", "day"), "2018.06": ("2018-06-01", "month"), "2018-xx-05": ("2018-01-01", "year"), "2018-06-": ("2018-06-01", "month"), "2019-02-31": ("2019-02-31", "day"), "1-2-3-4": None, "2018-13": None, "2018-00": None, "text": None, "": None}
    got = one(spark, cases, "t string", dates.parse_loose(F.col("t")))
    assert [g and tuple(g) for g in got] == list(cases.values())
    assert one(spark, ["2019-01-01"], "t string", dates.display(F.col("t"), F.lit("year"), F.lit(True))) == ["~2019"]


def test_formats(spark):
    cases = [("a.txt", b"%PDF-1.4 x", "pdf"), ("b.zip", b"PK\x03\x04" + b"x" * 30 + b"mimetypeapplication/epub+zip" + b"x" * 20, "epub"), ("c", b"<!DOCTYPE html><p>x", "html"), ("d.azw3", b"\0\0\0\0", "azw3"), ("notes.md", b"plain words", "txt")]
    df = spark.createDataFrame([(n, bytearray(c)) for n, c, _ in cases], "n string, c binary")
    assert [r[0] for r in df.select(formats.detect(F.col("n"), F.col("c"))["detail"]).collect()] == [d for _, _, d in cases]
    raw = [b"\xef\xbb\xbfhi", b"plain", b"\xd6\xd0\xce\xc4", b"\xff\xfeh\0i\0"]
    assert one(spark, [bytearray(x) for x in raw], "c binary", formats.decode_text(F.col("c"))) == ["hi", "plain", "中文", "hi"]
    assert one(spark, [bytearray(b"abc")], "c binary", formats.file_hash(F.col("c"))) == ["ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"]
    assert one(spark, [(-1234567)], "n long", formats.grouped_digits(F.col("n"))) == ["-1,234,567"]
    assert [tuple(s) for s in one(spark, ["Abcabx"], "t string", formats.highlight(F.col("t"), "ab"))[0]] == [("Ab", True), ("c", False), ("ab", True), ("x", False)]


PAGE = """<html><head><title>No</title></head><body><div id=preface><h1>Site</h1><a rel=author>Nobody</a><p>See <a href="http://example.test/works/1">this</a></p><p class=message>At <a href="http://example.test/works/77?x=1">here</a></p>
<dl class=tags><dt>Rating:</dt><dd><a>General</a></dd><dt>Additional Tags:</dt><dd><a>Fluff</a>, <a>Tea</a></dd><dt>Language:</dt><dd>English</dd><dt>Collections:</dt><dd><a>Winter</a></dd><dt>Stats:</dt><dd>Published: 2019-05-01 Words: 1,234 Chapters: 2/?</dd></dl>
<ul><li>A translation of <a href="/works/5">Other</a> by <a rel=author href="/users/x">Xan</a> <span lang=fr>Français</span></li><li>Remix of a lost work</li><li>see also</li></ul><div class=meta><h1>The Tale</h1></div><div class=byline><a rel=author>Ann</a></div><p>Summary</p><blockquote><p>Short &amp; sweet</p></blockquote></div><p>Text<p>More</body></html>"""


def test_download(spark):
    got = one(spark, [PAGE, "<h1>none</h1>", None], "t string", html.parse(F.col("t")))
    assert got[1:] == [None, None]
    r = got[0]
    assert (r.work_id, r.title, r.author, r.summary, r.language_label, r.tags, r.published, r.words, r.chapters) == ("77", "The Tale", "Ann", "Short & sweet", "English", ["General", "Fluff", "Tea"], "2019-05-01", 1234, "2/?")
    assert (r.rating, r.additional, r.collections, r.warnings) == (["General"], ["Fluff", "Tea"], ["Winter"], [])
    assert [(x.kind, x.work_id, x.title, x.author, x.language, x.language_label) for x in r.related] == [("translation_of", "5", "Other", "Xan", "fr", "Français"), ("remix_of", None, None, None, None, None)]
    assert one(spark, ["<p>a<br>b</p><!-- c --><p>d &amp; e</p>"], "t string", html.html_text(F.col("t"))) == ["a\n\nb\n\nd & e"]


class Text(HTMLParser):
    """Page text by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out = []

        self.open = False

    def end_paragraph(self):
        self.out.append("\n" if self.open else "")
        self.open = False

    def handle_starttag(self, tag, attrs):
        if tag == "p" or tag in html.ENDING:
            self.end_paragraph()
        self.out.append("\n\n" if tag == "br" else "\n" if tag in html.BLOCKS else "")
        self.open = self.open or tag == "p"

    handle_startendtag = handle_starttag

    def handle_endtag(self, tag):
        if tag == "p" and not self.open:
            self.out.append("\n\n")
        elif tag == "p" or tag in html.ENDING:
            self.end_paragraph()
        if tag != "p":
            self.out.append("\n\n" if tag == "br" else "\n" if tag in html.BLOCKS else "")

    def handle_data(self, data):
        self.out.append(data)


def text_by_parser(page):
    parser = Text()
    parser.feed(page)
    parser.close()
    lines = []
    for line in map(str.strip, "".join(parser.out).split("\n")):
        if line or (lines and lines[-1]):
            lines.append(line)
    return "\n".join(lines).strip("\n")


def test_page_text_equals_a_parser(spark):
    rng = random.Random(4)
    parts = ["<p>", "</p>", "<P class='x>y'>", "<br/>", "<br>", "<div id=\"a>b\">", "</div >", "<span>", "</span>", "<!-- c <p> -->", "<script>if (a<b) x='</p>' &amp; y</script>", "<style>p{}</style>", "<!DOCTYPE html>", "<h1>", "</h1>", "<blockquote>", "<pre>", "<li>", "<h10>", "<ul>", "</ul>", "</article>", "text", " ", "\n", "\u00a0", "é", "粽子", "a < b", "5 <6", "&amp;", "&lt;p&gt;", "&copy;", "&copy", "&copyright", "&nbsp;", "&#65;", "&#x1F600;", "&#128;", "&#0;", "&#xD800;", "&unknown;", "&", "& ", "&notin;", "&notit;", "&AMP;", "tail"]
    pages = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))) for _ in range(400)] + ["", "plain", "x" * 5000 + "<p>" * 300]
    got = one(spark, pages, "t string", html.html_text(F.col("t")))
    for page, text_ in zip(pages, got, strict=True):
        assert text_ == text_by_parser(page), page
    assert one(spark, [None], "t string", html.html_text(F.col("t"))) == [None]
    plan = spark.createDataFrame([("x",)], "t string").select(html.html_text(F.col("t")))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan


def test_page_references_end_with_their_text(spark):
    """As in a browser: a reference that a tag cuts off is not completed by the text after the tag."""
    assert one(spark, ["<title>x &am</title><style>p{margin:0}</style>", "a &am<b>p; b"], "t string", html.html_text(F.col("t"))) == ["x &amp{margin:0}", "a &amp; b"]


def test_page_text_tells_work_pages(spark, tmp_path):
    from foliant import registry

    work = "<p class='a message'>At <a href='http://example.test/works/77'>here</a></p><h1>Tale</h1>"
    pages = [(1, work), (2, "<p>plain</p><h1>x</h1>"), (3, "<p class=message>no link</p><h1>x</h1>"), (4, None), (5, work.replace("/works/", "&sol;&#119;orks&#47;"))]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r["is_work"] for r in registry.QUERIES["page_text"](spark, str(tmp_path)).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: True}
    del got[5]
    duckdb = pytest.importorskip("duckdb").connect()
    duckdb.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert got == dict(duckdb.execute(f"SELECT page_id, is_work FROM ({registry.SQL['page_text']}) WHERE page_id <> 5").fetchall())


def test_query_terms():
    assert parse_query("tag: Title:Rain x") == [("all", "tag:"), ("title", "Rain"), ("all", "x")]
