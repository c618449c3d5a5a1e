"""Books end to end, markup rewriting, connectors and options."""

import http.server
import json
import os
import sys
import threading

import pytest
from pyspark.sql import functions as F

from lectern.operators import books, catalog, editing, enrich, glossary, markup, ordering
from lectern.sources import connectors, epub, glossary_tsv, options, staged
from lectern.store import written

# a stylesheet cycle, an image that only a kept page shows, a nav with a dead first link before a live child
OPF = """<package><metadata><meta name="cover" content="cov"/><item>kept</item></metadata><manifest>
<item id="c1" href="t/c1.xhtml" media-type="application/xhtml+xml"/><item id="c2" href='t/c2.xhtml' media-type='application/xhtml+xml'></item>
<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>
<item id="css" href="a.css" media-type="text/css"/><item id="css2" href="b.css" media-type="text/css"/><item id="i1" href="i/1.png" media-type="image/png"/>
<item id="i2" href="i/2%20x.png" media-type="image/png"/><item id="bg" href="i/bg.png" media-type="image/png"/><item id="cov" href="i/cov.png" media-type="image/png"/>
</manifest><spine toc="ncx"><itemref idref="c1" linear="no"/><itemref idref="c2"/></spine><guide><reference type="text" href="t/c2.xhtml"/></guide></package>"""
MEMBERS = [
    ("META-INF/container.xml", '<rootfile full-path="O/p.opf"/>'),
    ("O/p.opf", OPF),
    ("O/t/c1.xhtml", '<body><link href="../a.css"/><img src="../i/2%20x.png"/><a id="x"/><a href="c2.xhtml#q">Two</a> <a href="#f">f</a> <a href="http://x/">h</a></body>'),
    ("O/t/c2.xhtml", '<body><img src="../i/1.png"/></body>'),
    ("O/a.css", "@import url(b.css); p{background:url('i/bg.png')}"),
    ("O/b.css", '@import url("a.css")'),
    ("O/nav.xhtml", '<nav><ol><li><a href="t/c2.xhtml">2</a><ol><li><a href="t/c1.xhtml">1</a></li></ol></li><li><a href="t/c1.xhtml">1</a></li></ol></nav>'),
    ("O/toc.ncx", '<navPoint playOrder="4"><content src="t/c2.xhtml"/></navPoint><navPoint playOrder="7"><content src="t/c1.xhtml#z"/></navPoint>'),
    *((f"O/i/{n}.png", n) for n in ("1", "2 x", "bg", "cov")),
    ("mimetype", "application/epub+zip"),
]


@pytest.fixture(scope="module")
def files(spark):
    good = epub.pack([(n, t.encode()) for n, t in MEMBERS])
    plain = epub.pack([("x.txt", b"no package")])
    return spark.createDataFrame([("good", bytearray(good)), ("plain", bytearray(plain)), ("broken", bytearray(b"PK no zip"))], "path string, content binary")


def unpacked(spark, frame):
    rows = epub.entries(frame.withColumnRenamed("book_id", "path")).collect()
    return {r.book_id: {x.name: bytes(x.data).decode() for x in rows if x.book_id == r.book_id} for r in rows}


def test_cut(spark, files):
    got = unpacked(spark, books.cut(files, written, indexes=[0]))
    assert set(got) == {"good"}
    new = got["good"]
    assert set(new) == {n for n, _ in MEMBERS} - {"O/t/c2.xhtml", "O/i/1.png"}  # backgrounds of sheets and the cover stay
    assert list(new)[0] == "mimetype"
    assert '<a id="x"/>Two <a href="#f">' in new["O/t/c1.xhtml"] and '<a href="http://x/">h</a>' in new["O/t/c1.xhtml"]
    assert new["O/nav.xhtml"] == '<nav><ol><li><a href="t/c1.xhtml">1</a></li></ol></nav>'
    assert new["O/toc.ncx"] == '<navPoint playOrder="1"><content src="t/c1.xhtml#z"/></navPoint>'
    opf = new["O/p.opf"]
    assert "c2" not in opf and "guide" not in opf and '<itemref idref="c1" linear="no"/>' in opf and "<item>kept</item>" in opf and 'id="i1"' not in opf
    before, after = epub.entries(files.where("path = 'good'")), epub.entries(books.cut(files, written, ids=["c1"]).withColumnRenamed("book_id", "path"))
    row = books.cut_report(before, after).first()
    assert (row.entries_before, row.entries_after) == (len(MEMBERS), len(MEMBERS) - 2)
    with pytest.raises(ValueError):
        books.cut(files, written, ids=["c1", "c9"])
    with pytest.raises(ValueError):
        books.cut(files, written, indexes=[5])
    with pytest.raises(ValueError):
        books.select_spine(epub.catalog(files, "spine"))


def test_prune_all(spark, files):
    table = {t: epub.catalog(files, t, decode=True) for t in ("manifest", "spine", "cover")}
    kept = books.select_spine(table["spine"], ids=["c2"])
    stays = lambda every: {r.id for r in books.plan_cut(table["spine"], table["manifest"], table["cover"], epub.entries(files), kept, written, every).where("stays").collect()}
    assert stays(False) == {"c2", "nav", "ncx", "css", "css2", "i1", "cov"} and stays(True) == {"c2", "nav", "ncx", "i1", "cov"}


def test_problems_and_texts(spark, files):
    assert {(r.book_id, r.reason.split(":")[0]) for r in epub.problems(files).collect()} == {("plain", "no package document"), ("broken", "BadZipFile")}
    docs = books.spine_texts(epub.catalog(files, "spine"), epub.catalog(files, "manifest"), epub.entries(files))
    rows = docs.orderBy("spine_index").collect()
    assert [(r.idref, r.path, r.text) for r in rows] == [("c1", "O/t/c1.xhtml", "Two f h"), ("c2", "O/t/c2.xhtml", "")]
    assert books.whole_text(docs).first().text == "Two f h\n"
    assert epub.locate_package(["b.opf", "O/a.opf"], '<rootfile full-path="O/a.opf"/>', first=True) == "b.opf"


def test_analysis_of_a_book(spark):
    body = lambda t: f"<body{t}><p>{'word ' * 100}</p></body>"
    docs = [("b", 0, "cov", "cover.xhtml", body(""), []), ("b", 1, "t", "title.xhtml", body(' epub:type="titlepage"'), []), ("b", 2, "c", "c1.xhtml", body(""), []), ("b", 3, "d", "c2.xhtml", body(""), [])]
    docs = spark.createDataFrame(docs, "book_id string, spine_index int, idref string, path string, html string, properties array<string>")
    # landmarks point into the title page, which isn't believed; the guide's first pointer counts
    points = spark.createDataFrame([("b", "landmarks", 0, "bodymatter", "title.xhtml"), ("b", "guide", 0, "text", "c1.xhtml"), ("b", "guide", 1, "text", "c2.xhtml")], "book_id string, kind string, pos int, type string, path string")
    got = books.analyse(docs, points, keep_ids=["t"]).orderBy("spine_index").collect()
    assert [(r.excluded, r.reason) for r in got] == [(True, "cover"), (False, "config"), (False, "kept"), (False, "kept")] and {(r.body_index, r.body_layer) for r in got} == {(2, "guide")}


def test_markup():
    assert markup.prune("<li><span>s</span><li><a href='x'>d</a></li></li>", "li", markup.HREF, lambda h: h == "x") == ("", 1)
    assert markup.prune("<li><span>s</span></li><li><a href='y'></a></li>", "li", markup.HREF, lambda h: False) == ("<li><a href='y'></a></li>", 1)
    assert markup.prune("<li><a href='x'>", "li", markup.HREF, lambda h: True) == ("<li><a href='x'>", 0)
    assert markup.degrade_links("a/b.html", '<A HREF="x">up</A><a href="../k.html#z">k</a><a>no</a>', ["k.html"]) == ('<A HREF="x">up</A><a href="../k.html#z">k</a><a>no</a>', 0)  # names of attributes are lower case
    html = f'<html><head><link href="s"/></head><body><section><h1>A</h1><p>{"x" * 3000}</p><section><h2>VIII. References</h2><p>r1<br/></p></section><p>r2</p></section></body></html>'
    left, refs = markup.split_references(html)
    assert left.endswith("</p><section></section></section></body></html>") and '<h2>VIII. References</h2><p>r1<br/></p><p>r2</p></body>' in refs and '<link href="s"/>' in refs
    assert markup.split_references(html.replace("x" * 3000, "x" * 300)) is None  # too little would be left
    assert markup.split_references("<body><h1>No</h1></body>") is None
    two = "<h2>References</h2><h1>8 Bibliography</h1>"
    assert markup.reference_heading(two) == two.index("<h1>")
    assert markup.register("<manifest></manifest><spine></spine>", "r", "r.xhtml") == '<manifest><item id="r" href="r.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="r"/></spine>'
    assert markup.de_escape_latex("\\[ \\\\cos x \\\\ \\] \\\\sin \\(\\\\a\\)") == "\\[ \\cos x \\\\ \\] \\\\sin \\(\\a\\)"
    assert markup.repair_math('<m:math a="1"><m:mi>x</m:mi></m:math><m:x>') == ('<math xmlns="http://www.w3.org/1998/Math/MathML" a="1"><mi>x</mi></math><m:x>', 1)
    assert markup.repoint_images("![](a.png) ![](b.png)", {"a.png": "/x/a.png"}) == "![](/x/a.png) ![](b.png)"
    spine = '<spine><itemref idref="a"/><itemref idref="b" linear="no"/><itemref idref="c"/><itemref idref="d"/></spine>'
    cut = markup.trim_spine(spine, ["a", "b", "d"])
    assert cut == '<spine><itemref idref="c"/></spine>' and markup.restore_spine(spine, cut, ["a", "b", "d"]) == spine and markup.restore_spine(spine, spine, ["a"]) == spine
    assert markup.trim_spine('<itemref idref="x"></itemref>', ["x"]) == '<itemref idref="x"></itemref>'


def test_documents_of_books(spark):
    rows = [("b", "2.xhtml", "<m:math></m:math>"), ("b", "1.xhtml", "<body><p>" + "y" * 2500 + "</p><h1>References</h1><p>z</p></body>"), ("c", "1.xhtml", None)]
    docs = spark.createDataFrame(rows, "book_id string, path string, html string")
    assert {(r.book_id, r.path, r.changes) for r in books.repair_math(docs).collect()} == {("b", "2.xhtml", 1), ("b", "1.xhtml", 0), ("c", "1.xhtml", 0)}
    assert {(r.book_id, r.path) for r in books.split_references(docs).collect()} == {("b", "2.xhtml"), ("b", "1.xhtml"), ("b", "references.xhtml"), ("c", "1.xhtml")}
    assert books.de_escape_latex(docs.withColumn("html", F.lit("\\(\\\\x\\)"))).select("html").distinct().collect() == [("\\(\\x\\)",)]


def test_glossary_run(spark, tmp_path):
    docs = spark.createDataFrame([(1, "We met Andy Grove today. They met Grove again. We saw Intel."), (2, "We saw Intel, Junk here.")], "doc_id long, text string")
    values = {"Andy Grove": "A", "Grove": "G", "Intel": "I"}

    def resolver(batch):
        assert all(r["context"] for r in batch)
        return [{"en": r["en"], "zh": values.get(r["en"], ""), "confidence": "high" if r["en"] in values else "skip"} for r in batch]

    def make(unify=None):
        return books.make_glossary(docs, resolver, written, unify=unify)

    rows = {r.en: r for r in make().collect()}
    assert {k: (r.zh, r.confidence) for k, r in rows.items()} == {"Andy Grove": ("A", "low"), "Grove": ("G", "low"), "Intel": ("I", "high")} and rows["Intel"].freq == 2
    fixed = {r.en: r.zh for r in make(lambda group: {en: "同" for en, _, _ in group}).collect()}
    assert fixed["Andy Grove"] == fixed["Grove"] == "同"
    path, calls = str(tmp_path / "g"), []
    for _ in range(2):
        got = books.ensure_glossary(spark, path, lambda: calls.append(1) or make())
        assert {r.english for r in got.collect()} >= {"Grove", "Intel"}
    assert calls == [1]
    with pytest.raises(RuntimeError):
        books.make_glossary(docs, lambda b: 1 / 0, written)


def test_translation(spark):
    docs = spark.createDataFrame([("b", "1", "Hello world <code>x</code>"), ("b", "2", "bad words that stay"), ("b", "3", None)], "book_id string, path string, html string")

    def translator(source):
        if "bad" in source:
            raise RuntimeError("down")
        return source.replace("Hello world", "你好")

    got = books.translate(docs, translator, "Simplified Chinese", None, written).cache()
    assert {(r.path, r.html, r.error) for r in got.collect()} == {("1", "你好 <code>x</code>", ""), ("2", "bad words that stay", "RuntimeError: down"), ("3", "", "")}
    done = got.where("error = ''").select("key", F.lit("done [[CODE00001]]").alias("html"))
    again = books.translate(docs, lambda s: 1 / 0, "Simplified Chinese", done, written)
    assert {(r.path, r.html) for r in again.where("error = ''").collect()} == {("1", "done <code>x</code>"), ("3", "done <code>x</code>")}


def test_translated_books(spark):
    opf = '<package><manifest><item id="cov" href="cover.xhtml"/><item id="a" href="a.xhtml"/><item id="b" href="b.xhtml"/></manifest><spine><itemref idref="cov"/><itemref idref="a"/><itemref idref="b"/></spine></package>'
    text = {"cover.xhtml": "<body><p>Cover</p></body>", "a.xhtml": "<body><p>" + "word " * 300 + "</p><m:math><m:mi>x</m:mi></m:math></body>", "b.xhtml": "<body><p>two</p></body>"}
    book = epub.pack([("p.opf", opf.encode()), ("mimetype", b"application/epub+zip"), *((n, t.encode()) for n, t in text.items())])
    files = spark.createDataFrame([("k", bytearray(book))], "path string, content binary")
    made, log = books.translate_books(files, lambda s: s.replace("word", "\u5b57").replace("two", "\u4e8c"), "Simplified Chinese", written, exclude=("b",))
    new = unpacked(spark, made)["k"]
    assert new["cover.xhtml"] == text["cover.xhtml"] and new["b.xhtml"] == text["b.xhtml"] and new["p.opf"] == opf and "\u5b57" in new["a.xhtml"]
    assert [(r.path, r.error) for r in log.collect()] == [("a.xhtml", "")]
    assert "<math xmlns=" in unpacked(spark, books.repair_math_books(files, written))["k"]["a.xhtml"]


def test_image_places(spark):
    links = spark.createDataFrame([("b", "md/d", h) for h in ("x.png", "p/y.png", "z.png", "http://q", "w.png")], "book_id string, folder string, href string")
    files = spark.createDataFrame([("b", p) for p in ("md/d/assets/x.png", "md/d/x.png", "md/d/d/assets/y.png", "md/d/k/z.png", "other/w.png")], "book_id string, path string")
    got = {r.href: r.path for r in editing.find_images(links, files).collect()}
    assert got == {"x.png": "md/d/x.png", "p/y.png": "md/d/d/assets/y.png", "z.png": "md/d/k/z.png", "w.png": None}


def test_numbers_over_all(spark):
    rows = spark.range(1000).select(F.col("id"), (F.col("id") % 7).alias("k")).repartition(5)
    got = ordering.number_globally(rows, [F.col("k"), F.desc("id")], "n", written).collect()
    assert [r.id for r in sorted(got, key=lambda r: r.n)] == sorted(range(1000), key=lambda i: (i % 7, -i)) and sorted(r.n for r in got) == list(range(1000))
    assert catalog.union_in_order(written, rows.select(F.col("id").cast("string").alias("id"), F.lit(1).alias("pos")).limit(0), spark.createDataFrame([("a", 3), ("b", 1), ("a", 0)], "id string, pos int")).orderBy("pos").collect() == [("a", 0), ("b", 1)]
    assert enrich.batches(rows, ["id"], size=300, checkpoint=written).groupBy("batch").count().count() == 4


class Service(http.server.BaseHTTPRequestHandler):
    replies: list = []
    asked: list = []

    def do_POST(self):
        self.asked.append((self.path, json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
        status, body = self.replies.pop(0)
        self.send_response(status)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def log_message(self, *_):
        pass


def test_connectors():
    server = http.server.HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base, pauses = f"http://127.0.0.1:{server.server_port}/", []
    Service.replies[:] = [(503, {}), (200, {"choices": [{"message": {"content": "hi"}}]}), (200, {"content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}), (400, {})]
    assert connectors.chat(base, "k", "m", extra={"x": 1}, sleep=pauses.append)("sys", "user") == "hi" and pauses == [5]
    assert connectors.chat(f"{base}v1", "k", "m", parts=True)("sys", "user") == "ab"
    with pytest.raises(Exception, match="400"):
        connectors.chat(base, "k", "m", sleep=pauses.append)(None, "user")
    assert [p for p, _ in Service.asked] == ["/v1/chat/completions"] * 2 + ["/v1/messages", "/v1/chat/completions"] and Service.asked[0][1]["x"] == 1 and pauses == [5]
    server.shutdown()
    left = iter([ValueError("x"), "no", "yes"])

    def ask(*_):
        x = next(left)
        if isinstance(x, Exception):
            raise x
        return x

    assert connectors.steady(ask, pause=2, check=lambda a: None if a == "yes" else "refused", sleep=pauses.append)(None, "q") == "yes" and pauses == [5, 2, 2]
    assert connectors.waits(5, 60, 6) == [5, 10, 20, 40, 60]
    assert connectors.terms_resolver(lambda s, u: 'so: [{"en": " A ", "zh": "x", "confidence": "HIGH"}, {"en": ""}] ok', "sys")([{"en": "A"}]) == [{"en": "A", "zh": "x", "confidence": "high", "alt": "", "note": ""}]


def test_local_program():
    script = "import json,os,sys; t=sys.stdin.read(); print(json.dumps({'result': os.environ['LECTERN_SYSTEM'] + t, 'is_error': t == 'bad'}))"
    ask = connectors.program([sys.executable, "-c", script], most=2, sleep=lambda s: None)
    assert ask("s:", "hello") == "s:hello"
    with pytest.raises(RuntimeError):
        ask("", "bad")
    slept = []
    with pytest.raises(connectors.Fatal):
        connectors.program([sys.executable, "-c", "print('Error: Not logged in'); raise SystemExit(1)"], sleep=slept.append)("", "x")
    assert not slept
    assert connectors.child_environment(("A",), ("P_",), ("P_OK",), {"A": "1", "P_X": "1", "P_OK": "1", "B": "1"}) == {"P_OK": "1", "B": "1"}
    assert connectors.without_socks({"ALL_PROXY": "socks://x", "http_proxy": "http://y"}) == {"http_proxy": "http://y"}


def test_routes():
    to = lambda p, m, always=True: connectors.route(p, m, ("local",), "typed", "big-", always)
    assert [to(" Local ", "x"), to("typed", "x"), to("", "big-1"), to("other", "big-1"), to("other", "big-1", False), to("", "x")] == ["program", "parts", "parts", "parts", "choices", "choices"]


def test_files_and_guards(spark, tmp_path):
    (tmp_path / "o.yaml").write_text("target: German\nglossary:\n  min_freq: 5\n")
    got = options.load(str(tmp_path / "o.yaml"))
    assert got["target"] == "German" and got["glossary"]["min_freq"] == 5 and got["glossary"]["enabled"]
    (tmp_path / "b.epub").write_bytes(b"")
    options.check_input(str(tmp_path / "b.epub"), indexes="0-1", ids=None)
    for bad in (dict(path=str(tmp_path / "no.epub")), dict(path=str(tmp_path / "o.yaml")), dict(path=str(tmp_path / "b.epub"), indexes="1", ids="a")):
        with pytest.raises((OSError, ValueError)):
            options.check_input(**bad)
    path = str(tmp_path / "t")
    staged.replace(spark, path, lambda p: spark.range(3).write.parquet(p))
    with pytest.raises(ZeroDivisionError):
        staged.replace(spark, path, lambda p: 1 / 0)
    staged.replace(spark, path, lambda p: spark.range(5).write.parquet(p))
    assert spark.read.parquet(path).count() == 5 and sorted(f for f in os.listdir(tmp_path) if f.startswith("t")) == ["t"]
    assert glossary_tsv.SCHEMA and glossary.noted("", F.lit("x")) is not None
