"""Small fixtures for the cases in which a plain translation would give another answer."""

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lectern.functions import rules
from lectern.functions import text as T
from lectern.functions.digest import Md5
from lectern.operators import catalog, editing, enrich, glossary, masking, messages
from lectern.operators.ordering import joined_md5
from lectern.plans.base import written
from lectern.sources import epub, glossary_tsv, options


def test_acronyms_and_names_count_twice(spark):
    s = glossary.sentence_rows(spark.createDataFrame([(1, "We met TSMC today. We use Intel DRAM now.")], "doc_id long, text string"))
    runs = glossary.name_run_rows(s, glossary.trusted_tokens(s))
    both = runs.unionByName(glossary.acronym_rows(s).select(runs.columns))
    assert {r.term: r.freq for r in glossary.candidates(both).collect()} == {"TSMC": 2, "Intel DRAM": 1, "DRAM": 1}


def test_name_runs(spark):
    lines = {
        "the Bank of England rose": ["Bank of England"],
        "near the Bank of In town": ["Bank of"],
        "met Ford, Intel": ["Ford", "Intel"],
        "Zebras ran.": [],
        "Yaks ran to Yaks": ["Yaks", "Yaks"],
        "saw Grove's plan": ["Grove"],
        "the Of Of Of ran": [],
        "we saw De Van Ford go": ["De van Ford"],
        "so AT & T grew": ["AT T"],
        "in De": ["De"],
        "a B-29 and the Chip": ["B-29", "Chip"],
        "": [],
    }
    sentences = spark.createDataFrame([(i, 0, t) for i, t in enumerate(lines)], "doc_id long, sent int, sentence string")
    trusted = spark.createDataFrame([("Yaks",)], "token string")
    got = {}
    for r in glossary.name_run_rows(sentences, trusted).orderBy("doc_id", "seq").collect():
        got.setdefault(r.doc_id, []).append(r.term)
    assert {t: got.get(i, []) for i, t in enumerate(lines)} == lines


def plain_runs(sentence, trusted):
    """The runs of a sentence's tokens, one token after the other."""
    found = list(re.finditer(r"[A-Za-z][A-Za-z0-9.\-']*", sentence))
    clean = lambda t: re.sub(r"^[.'’]+|[.'’]+$", "", re.sub(r"['’]s$", "", t))
    cap = lambda t: t[:1].isupper()
    broken = lambda a, b: any(c in rules.BREAKS for c in sentence[found[a].end() : found[b].start()])
    names = lambda t, first: cap(t) and ((not first and t not in rules.STOP_CAPITALS) or clean(t) in trusted)
    out, i = [], 0
    while i < len(found):
        if not names(found[i][0], i == 0):
            i += 1
            continue
        run, j = [clean(found[i][0])], i + 1
        while j < len(found) and not broken(j - 1, j):
            t = found[j][0]
            if t.lower() in rules.CONNECTORS and j + 1 < len(found):
                if not cap(found[j + 1][0]) or broken(j, j + 1):
                    break
                run.append(t.lower())
            elif names(t, False):
                run.append(clean(t))
            else:
                break
            j += 1
        term = " ".join(run).strip(" .,'’-")
        out += [term] if len(term) > 1 else []
        i = j
    return out


def test_name_runs_token_by_token(spark):
    r = random.Random(4)
    words = [*rules.CONNECTORS, "Of", "De", "The", "AND", "Ford", "Yaks", "B-29", "iPhone", "x-Ray", "a.B", "Grove's", "plan", "went", "3Com", "3of", "..", "'Ford", "-Ford", "Émile", "émile", "été", "In", "I", "of.Ford", "A", "a", "(of", "Ford,", "of,", "“Ford", "7"]
    lines = [r.choice(["", "", "(", "3 "]) + "".join(r.choice(words) + r.choice([" "] * 7 + ["  ", ", ", "-", "\t"]) for _ in range(r.randint(1, 9))).strip() for _ in range(3000)]
    lines += ["Yaks ran.", "De ran", "Zebras ran", "word " * 20000 + "the Ford " * 20000, "a" * 200000 + "Ford"]
    trusted = {"Yaks", "De", "In", "A"}
    sentences = spark.createDataFrame([(i, 0, t) for i, t in enumerate(lines)], "doc_id long, sent int, sentence string")
    got = [[] for _ in lines]
    for x in glossary.name_run_rows(sentences, spark.createDataFrame([(t,) for t in trusted], "token string")).orderBy("doc_id", "seq").select("doc_id", "term").collect():
        got[x.doc_id].append(x.term)
    wrong = [(t[:200], g[:5], plain_runs(t, trusted)[:5]) for t, g in zip(lines, got, strict=True) if g != plain_runs(t, trusted)]
    assert not wrong, wrong[:5]


def test_plain_words_are_left_out(spark):
    lines = ["so it went with the Bank of many words of England, and of (the Ford) x-Ray was here", "Yaks ran to the hills", "Bank of England and the Ford of old"]
    got = spark.createDataFrame([(t,) for t in lines], "s string").select(glossary.without_plain_words(F.col("s"))).collect()
    assert [r[0] for r in got] == ["x Bank x England, x Ford) x-Ray x ", "Yaks x ", "Bank of England x Ford x "]


def entries(spark, *rows):
    return spark.createDataFrame([(en, zh, n, "medium", "", i) for i, (en, zh, n) in enumerate(rows)], "en string, zh string, freq long, confidence string, note string, pos long")


def test_casefold(spark):
    got = glossary.dedup_casefold(entries(spark, ("CHIP", "a", 5), ("Chip", "b", 5))).collect()
    assert [(r.en, r.freq) for r in got] == [("Chip", 10)]


def test_coordinations(spark):
    got = glossary.drop_coordinations(entries(spark, ("A1  and b1", "", 1), ("a1", "", 1), ("B1", "", 1), ("A1 and C1", "", 1)))
    assert {r.en for r in got.collect()} == {"a1", "B1", "A1 and C1"}


def test_conflicting_names(spark):
    got = glossary.flag_conflicts(entries(spark, ("Grove", "x", 2), ("Andy Grove", "y", 1), ("Ann", "z", 1)), written)
    assert {r.en: (r.confidence, r.note) for r in got.collect()} == {"Grove": ("low", "不一致待统一: Andy Grove/Grove"), "Andy Grove": ("low", "不一致待统一: Andy Grove/Grove"), "Ann": ("medium", "")}


def reached(names):
    """Every name's component by brute force; those linked with none aside."""
    words = {n: n.lower().split(" ") for n in names}
    inside = lambda a, b: len(a) < len(b) and any(b[i : i + len(a)] == a for i in range(len(b) - len(a) + 1))
    near = {a: [b for b in names if inside(words[a], words[b]) or inside(words[b], words[a])] for a in names}
    out = {}
    for a in sorted(names):
        todo = [a] if near[a] and a not in out else []
        while todo:
            if (b := todo.pop()) not in out:
                out[b] = a
                todo += near[b]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_name_components(spark, seed):
    r = random.Random(seed)
    names = sorted({" ".join(r.choices([*"abcdeABC", "", "ff", "Gé", *map(str, range(40))], k=r.randint(1, 5))) for _ in range(90)})
    got = glossary.name_components(entries(spark, *((n, "", 1) for n in names)), written).collect()
    assert len(got) == len({g.id for g in got}) and {g.id: g.component for g in got} == reached(names)


def test_notes_of_a_large_component(spark):
    """30000 names in one component: their notes would hold 30000 times 30000 names."""
    rows = spark.range(30000).selectExpr("concat('hub n', id) as en", "'y' as zh", "1L as freq", "'high' as confidence", "'' as note", "id as pos")
    rows = written(rows.union(entries(spark, ("Hub", "x", 1), ("other", "", 1))))
    got = glossary.conflict_digests(rows, written).groupBy("confidence", "note_md5").count().collect()
    note = glossary.rules.NOTE_CONFLICT + "/".join(sorted(["Hub", *(f"hub n{i}" for i in range(30000))]))
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    assert {tuple(r) for r in got} == {("low", md5(note), 30001), ("medium", md5(""), 1)}


def test_digests_go_on_in_other_tasks(spark):
    r = random.Random(1)
    rows = [(g, i, "é" * r.randint(0, 90)) for g, n in ((None, 5), ("", 1), ("a", 300), ("b", 40), ("=", 1), ("c", 200)) for i in range(n)]
    want = {g: hashlib.md5(("f:" + "\n".join(t for h, _, t in rows if h == g)).encode()).hexdigest() for g, _, _ in rows}
    r.shuffle(rows)
    df = spark.createDataFrame([*rows, ("gone", 0, None)], "g string, i int, t string")
    for each in (3000, 1 << 20):
        assert {x.g: x.md5 for x in joined_md5(df, "g", ["i"], "t", "\n", written, first="f:", each=each).collect()} == want


def test_a_text_of_many_documents_is_in_no_one_place(spark):
    kept = []
    keep = lambda df: kept.append(written(df)) or kept[-1]
    rows = spark.range(2000).selectExpr("'en' as lang", "id", "repeat('word ', 100) as text")
    got = joined_md5(rows, "lang", ["id"], "text", "\n", keep, each=200_000).first()
    assert got.md5 == hashlib.md5("\n".join(["word " * 100] * 2000).encode()).hexdigest()
    assert max(r.n for r in kept[0].groupBy("_part").agg(F.sum(F.length("txt")).alias("n")).collect()) < 500_000


def test_digest_states():
    r = random.Random(2)
    for n in (0, 1, 55, 56, 63, 64, 65, 200, 1000):
        data, state = r.randbytes(n), {True: None, False: None}
        for cut in (data[: n // 3], data[n // 3 : n // 2], data[n // 2 :]):
            for native in state:
                m = Md5(state[native], native)
                m.update(cut)
                state[native] = m.state()
        assert {Md5(s, k).hexdigest() for k, s in state.items()} == {hashlib.md5(data).hexdigest()}


def test_collapse_is_greedy(spark):
    got = glossary.collapse_same_value(entries(spark, ("Grove", "x", 5), ("Andy Grove", "x", 3), ("Intel", "x", 1), ("Foo", "", 1))).collect()
    assert {(r.en, r.freq, r.note) for r in got} == {("Grove", 8, "也作: Andy Grove"), ("Intel", 1, ""), ("Foo", 1, "")}
    # "b c" is passed over before "a b" joins the family of "a", and is not looked at again
    assert glossary.families(["a", "b c", "a b", "c"]) == [[0, 2], [1, 3]]
    assert glossary.families(["Chip", "chip", "chipset"]) == [[0, 2], [1]]


def plain_families(names):
    kin = lambda a, b: a != b and (a.startswith(b) or b.startswith(a) or bool(set(a.split()) & set(b.split())))
    low, out, left = [n.lower() for n in names], [], list(range(len(names)))
    while left:
        family = left[:1]
        for i in left[1:]:
            if any(kin(low[i], low[k]) for k in family):
                family.append(i)
        out.append(family)
        left = [i for i in left if i not in family]
    return out


def test_families_as_by_looking_at_all_pairs():
    r = random.Random(3)
    for n in range(600):
        few = r.choice(["ab", "abcdefgh", "abcdefghijklmnopqrstuvwxyzé"])
        names = [r.choice([" ", "  "]).join("".join(r.choices(few, k=r.randint(1, 3))).title() if r.random() < 0.3 else "".join(r.choices(few, k=r.randint(0, 3))) for _ in range(r.randint(0, 3))) for _ in range(n % 40)]
        assert glossary.families(names) == plain_families(names), names


def test_many_families_take_no_square(spark):
    names = [f"n{i:06}x" for i in range(60000)] + [f"n{i:06}x more" for i in range(0, 60000, 2)]  # all pairs: billions of looks
    began = time.time()
    found = glossary.families(names)
    assert time.time() - began < 20
    assert found == [[0, *range(60000, 90000)], *([i] for i in range(1, 60000))]


def test_reconciling_many_entries_of_one_value(spark):
    """Every seventh name shares a word with the next; looking at all pairs would take hours."""
    rows = spark.range(70000).selectExpr("concat('n', lpad(id, 6, '0'), 'x', if(id % 7 = 1, concat(' N', lpad(id - 1, 6, '0'), 'x'), '')) as en", "'v' as zh", "70000 - id as freq", "'high' as confidence", "'' as note", "id as pos")
    began = time.time()
    got = glossary.reconcile(written(rows), written).agg(F.count("*"), F.sum("freq"), F.count_if(F.col("note") != ""), F.max("note")).first()
    assert time.time() - began < 90 and tuple(got) == (60000, 70000 * 70001 // 2, 10000, "也作: n069994x N069993x")


def test_consistent_values(spark):
    rows = entries(spark, ("Grove", "x", 2), ("Andy Grove", "y", 1))
    fixed = spark.createDataFrame([(" Grove ", "z"), ("Andy Grove", " ")], "en string, zh string")
    assert {(r.en, r.zh, r.note) for r in glossary.apply_consistent(rows, fixed).collect()} == {("Grove", "z", "已统一"), ("Andy Grove", "y", "")}


def test_prompt(spark):
    rows = entries(spark, ("A", "x", 1), ("B", "y", 2), ("C", "", 9))
    assert glossary.prompt("base", rows).endswith("\n- B → y\n- A → x") and glossary.prompt("base", rows.limit(0)) == "base"


def test_masks_come_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.createDataFrame([("b", "p", "a<code>x</code>b")], "book_id string, path string, html string")
    for run in (lambda: masking.mask_books(docs, written), lambda: masking.unmask_books(hidden)):
        spark.conf.unset(key)
        hidden = run()
        assert spark.conf.get(key) == str(8 << 20) and hidden.count() == 1


def test_code_masks():
    html = "<pre><code>x</code></pre> <code>y</code> <code>never"
    masked, held = masking.mask_code(html)
    assert list(held) == [1, 2] and masked.endswith("<code>never")
    assert masking.unmask(masked, code=held) == (html, [1, 2])
    assert masking.unmask("[[ code 00002 ]] [[CODE9]] <PRE data-code-id=\"1\"/>", code=held)[0] == "<code>y</code> [[CODE9]] <pre><code>x</code></pre>"
    assert masking.mask_code('<code a=">">b</code>')[1] == {1: '<code a=">">b</code>'}


def test_math_masks_stack():
    html = '<pre><math xmlns="m">1</math></pre> <math>2</math>'
    one, math = masking.mask_math(html)
    two, code = masking.mask_code(one)
    back = masking.unmask(masking.unmask(two, code=code)[0], math=math)[0]
    assert back == html.replace("<math>2", f'<math xmlns="{masking.NAMESPACE}">2')
    assert masking.mask_math("<MATH>1</MATH>")[1] == {} and masking.mask_math("<MATH>1</MATH>", strict=True)[1]


def test_lost_placeholder(spark):
    mapping = spark.createDataFrame([("b", 1), ("b", 2)], "book_id string, idx int")
    back = spark.createDataFrame([("b", 1), ("b", 1)], "book_id string, idx int")
    assert masking.completeness(mapping, back).collect()[0][1:] == (2, 2, 1, 1)


def test_cyclic_closure(spark):
    edges = spark.createDataFrame([("b", "x", "a.css"), ("b", "a.css", "b.css"), ("b", "b.css", "a.css"), ("b", "q", "r")], "book_id string, src string, dst string")
    start = spark.createDataFrame([("b", "x")], "book_id string, node string")
    assert {r.node for r in editing.closure(start, edges, written).collect()} == {"x", "a.css", "b.css"}


def test_restore_order(spark):
    book = lambda rows: spark.createDataFrame([("b", i, n) for n, i in enumerate(rows)], "book_id string, idref string, spine_index int")
    got = catalog.restore(book("abcd"), book("bd"), book("ac"))
    assert "".join(r.idref for r in got.orderBy("position").collect()) == "abcd"


def test_titles_and_names(spark):
    rows = spark.createDataFrame([("titlepage01.xhtml",), ("title-page.xhtml",)], "f string").select(T.name_tokens(F.lit("x"), F.col("f")).alias("n"))
    assert [r[0] for r in rows.select(T.name_matches(F.col("n"), "title[-_]?page")).collect()] == [True, False]


def test_hrefs(spark):
    row = spark.range(1).select(T.resolve_href(F.lit("a/b"), F.lit("../c%20d+e.html#x")).alias("r"), T.is_external(F.lit("//x")).alias("e"), T.is_external(F.lit("a.html")).alias("f")).first()
    assert (row.r, row.e, row.f) == ("a/c d+e.html", True, False)


def test_html_text():
    assert T.html_text("<p>a&amp;b</p><script>no</script><b>c</b> &am") == "\na&b\nc"  # what an unfinished reference holds up is lost


def test_text_of_pages_comes_in_small_batches(spark):
    assert T.html_text("</script><script>no</script>b") == "b"  # an end without a beginning hides and shows nothing
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    docs = spark.createDataFrame([(None,), ("",), ("<p>é&lt;",)], "html string")
    assert [r.t for r in docs.select(T.html_to_text(F.col("html")).alias("t")).collect()] == [None, "", "\né<"]
    assert spark.conf.get(key) == str(8 << 20)


def test_structural_types(spark):
    html = '<body epub:type="frontmatter"><br/><section epub:type="Toc x"><a role="z"/><div data-type="q"><p><p role="late">'
    assert spark.range(1).select(T.structural_types(F.lit(html))).first()[0] == ["frontmatter", "toc", "x", "q"]


def test_validation(spark):
    rows = spark.createDataFrame([("Chapter 1", "第一章"), ("Chapter 1", "Chapter 1"), ("Chapter one is long", "Sure, here it is"), ("Привет", "x")], "s string, a string")
    assert [r[0] is None for r in rows.select(messages.validate(F.col("s"), F.col("a"), "Simplified Chinese")).collect()] == [True, True, False, True]


def test_budget_and_batches(spark):
    def resolver(names):
        if "n3" in {r["en"] for r in names}:
            raise RuntimeError("down")
        return [{"en": r["en"], "zh": r["en"].upper(), "confidence": "skip" if r["en"] == "n1" else "high"} for r in names]

    rows = spark.createDataFrame([(f"n{i}", i) for i in range(6)], "en string, pos long")
    got = written(enrich.resolve(enrich.batches(rows, ["pos"], size=2), resolver))
    row = enrich.failure_ratio(got).first()
    assert (row.n_batches, row.n_failed, row.over_budget) == (3, 1, True)
    assert {r.reason for r in got.collect()} == {"", "RuntimeError: down"}
    with pytest.raises(RuntimeError):
        enrich.check_budget(got)
    refused = enrich.resolve(rows.withColumn("batch", F.lit(1)), lambda b: [], check=lambda said: None if said else "nothing said")
    assert {r.reason for r in refused.collect()} == {"nothing said"}
    counted, seen = enrich.watched(rows, "progress", most=F.max("pos"))
    counted.collect()
    assert seen.get == {"rows": 6, "most": 5}
    assert {r.en: r.zh for r in enrich.apply_resolution(rows, got).collect()} == {"n0": "N0", "n2": "", "n3": "", "n4": "N4", "n5": "N5"}


def test_json(spark):
    rows = spark.createDataFrame([("```json\n[{\"k\":1}]\n```",), ("well: [{\"k\":2}] ok",), ("no",)], "x string").select(T.json_rows(F.col("x"), "array<struct<k:int>>").alias("r"))
    assert [r.r and r.r[0].k for r in rows.collect()] == [1, 2, None]


def test_epub(spark, tmp_path):
    opf = '<package><manifest><item id="a" href="x%20y.xhtml"/><item id="a" href="z.xhtml"/><item id="n" href="nav.xhtml" properties="nav"/></manifest><spine><itemref idref="a"/><itemref idref="q"></itemref></spine><guide><reference type="Text" href="z.xhtml#1"/></guide></package>'
    nav = '<nav epub:type="landmarks"><a epub:type="bodymatter chapter" href="z.xhtml">x</a></nav>'
    members = [("META-INF/container.xml", b'<rootfile full-path="O/p.opf"/>'), ("O/p.opf", opf.encode()), ("O/z.xhtml", b"<p>\xff</p>"), ("O/nav.xhtml", nav.encode()), ("mimetype", b"application/epub+zip")]
    (tmp_path / "b.epub").write_bytes(epub.pack(members))
    files = epub.archives(spark, str(tmp_path))
    assert [r.name for r in epub.entries(files).orderBy("entry_no").collect()][0] == "mimetype"
    spine, manifest = epub.catalog(files, "spine"), epub.catalog(files, "manifest")
    assert [(r.idref, r.path) for r in catalog.join_manifest(spine, manifest).collect()] == [("a", "O/z.xhtml")]
    assert catalog.join_manifest(spine, manifest, keep_unknown=True).count() == 2
    assert {(r.kind, r.type, r.path) for r in epub.catalog(files, "pointer").collect()} == {("guide", "text", "O/z.xhtml"), ("landmarks", "bodymatter", "O/z.xhtml"), ("landmarks", "chapter", "O/z.xhtml")}
    assert [r.path for r in epub.content_files(epub.entries(files, epub.CONTENT)).orderBy("path").collect()] == ["O/nav.xhtml", "O/z.xhtml"]
    again = epub.write(epub.entries(files)).first().content
    assert {n: d for n, d in members} == {r.name: bytes(r.data) for r in epub.entries(spark.createDataFrame([("x", bytes(again))], "path string, content binary")).collect()}


def test_glossary_file(spark, tmp_path):
    rows = spark.createDataFrame([('"Chip', "c", 3, "high", "", "a\tb\nc", '"quoted'), ("", "x", 1, "", "", "", "")], "english string, chinese string, freq long, confidence string, alternatives string, note string, context string")
    glossary_tsv.write(rows, str(tmp_path / "g"))
    got = glossary_tsv.read(spark, str(tmp_path / "g")).collect()
    assert [(r.english, r.freq, r.note, r.context) for r in got] == [('"Chip', 3, "a b c", '"quoted')]


def test_options():
    assert options.index_ranges("0-2,5", 6) == [0, 1, 2, 5]
    assert options.merged({"glossary": {"min_freq": 3}})["glossary"] == {"enabled": True, "min_freq": 3, "max_terms": None}


def test_ingest_takes_each_file_once(spark, tmp_path):
    from lectern.streaming.ingest import process_new

    src, sink, state = (str(tmp_path / x) for x in ("src", "sink", "state"))
    spark.range(3).write.parquet(src)
    assert process_new(spark, src, "id long", lambda d: d, sink, state) == 1
    assert process_new(spark, src, "id long", lambda d: d, sink, state) == 0
    spark.range(3, 5).write.mode("append").parquet(src)
    process_new(spark, src, "id long", lambda d: d, sink, state)
    assert spark.read.parquet(sink).count() == 5
