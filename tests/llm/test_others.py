"""Top-k search, WARC, SentencePiece, word ids, and the queries with SQL."""

import os
import random
import zlib

import duckdb
import numpy as np
import pytest

from . import cases

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op1_topk", "op4_exact_dedup"])
def test_against_sql(spark, name):
    from lectern.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{SF}/{t}'")
    want, got = con.sql(ORACLE_SQL[name]).df(), QUERIES[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    assert sorted(map(tuple, want[columns].values.tolist())) == sorted(map(tuple, got[columns].values.tolist()))


def brute(vectors, k):
    out = {}
    for q, v in vectors:
        if q % 20 == 0:
            scores = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in vectors if i != q))
            out[q] = [(i, -s) for s, i in scores[:k]]
    return out


@pytest.mark.parametrize("scale", [1, 10**5, 10**9])
def test_top_k(spark, scale):
    from lectern.llm.topk import quantise, top_k

    r = random.Random(scale)
    rows = [(i, [r.uniform(-1, 1) * scale for _ in range(6)], "x") for i in range(60)] + [(i, [0.5 * scale] * 6, "x") for i in range(60, 130)]
    bad = [(200, None, "x"), (220, [float("nan")] * 6, "x"), (240, [None] * 6, "x"), (260, [float("inf")] * 6, "x"), (None, [1.0] * 6, "x")]
    df = quantise(spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, score string"), scale=1.0)
    want = brute([(i, [int(np.floor(x)) for x in v]) for i, v, _ in rows], 20)
    got = {}
    for x in top_k(df.where("id % 20 = 0"), df, 20).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.vec_id, x.score))
    assert got == want


def test_top_k_of_equal_rows_and_groups(spark):
    from lectern.llm.topk import quantise, top_k

    rows = spark.range(0, 100_000, 1, 6).selectExpr("id as vec_id", "array(1.0d, -2.0d, 0.5d) as embedding")
    rows = rows.unionByName(spark.createDataFrame([(7, [9.0, 9.0, 9.0]), (7, [9.0, 9.0, 9.0]), (None, [1.0, 1.0, 1.0])], "vec_id long, embedding array<double>"))
    df = quantise(rows, scale=2.0)
    one, many = ({tuple(r) for r in top_k(df.where("id in (0, 7, 9)"), df, 5, query_bytes=b).collect()} for b in (1 << 20, 50))
    # equal rows tie: the smallest identifiers win, and repeated rows are candidates each; a query's own rows are not
    assert one == many and {(r[0], r[1], r[2]) for r in one if r[0] == 9} == {(9, n + 1, i) for n, i in enumerate((0, 1, 2, 3, 4))}


def test_top_k_of_huge_components(spark):
    from lectern.llm.topk import quantise, top_k

    rows = [(0, [2.0**61, 1.0]), (1, [2.0**61, -1.0]), (2, [-(2.0**61), 3.0]), (3, [1e30, 0.0]), (4, [0.0, 5.0])]
    df = quantise(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), scale=1.0)
    got = {r.vec_id: r.score for r in top_k(df.where("id = 0"), df, 9).collect()}
    assert got == {1: 2**63 - 1, 4: 5, 2: -(2**63) + 1}


def test_top_k_of_few(spark):
    from lectern.llm.topk import quantise, top_k

    df = quantise(spark.createDataFrame([(0, [1.0]), (7, [-1.0])], "vec_id long, embedding array<float>"))
    assert [tuple(r) for r in top_k(df.where("id = 0"), df, 20).collect()] == [(0, 1, 7, -4096)]
    assert top_k(df.where("id = 5"), df, 20).count() == 0


def test_top_k_of_uneven_vectors(spark):
    from lectern.llm.topk import quantise, top_k

    df = quantise(spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0]), (2, []), (3, [1.0, 1.0])], "vec_id long, embedding array<double>"), scale=1.0)
    assert [(r.vec_id, r.score) for r in top_k(df.where("id = 0"), df, 20).orderBy("rank").collect()] == [(1, 3), (3, 3), (2, 0)]


# WARC
def test_warc_round_trip(spark):
    from lectern.llm.warc import payload_digest, read_archives, write_archives

    rows = [(5, "http://a/ b\n", "x"), (2, None, "é"), (3, "u", "x"), (9, "u", None), (4, "u", ""), (7, "u", "WARC/1.1\r\n\x1f\x8b" * 1000), (None, "u", "x")]
    df = spark.createDataFrame([(*r, 1, "d") for r in rows], "page_id long, url string, html string, id int, digest string")
    for compress in (True, False):
        got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read_archives(write_archives(df, compress=compress)).collect()}
        size = lambda i: len(({r[0]: r[2] for r in rows}[i] or "").encode())
        digest = lambda i: payload_digest(({r[0]: r[2] for r in rows}[i] or "").encode())
        first = {5: 3, 9: 4}
        assert got == {i: (size(i), digest(i), "revisit" if i in first else "response", first.get(i)) for i in (5, 2, 3, 9, 4, 7)}
    assert read_archives(write_archives(df.limit(0))).count() == 0


@pytest.mark.parametrize("compress", [True, False])
def test_salvage(compress):
    from lectern.llm.warc import gzip_member, make_record, payload_digest, read_archive

    bodies = [b"a" * 50, b"bb" * 4000, b"", b"dd WARC/1.1 inside \x1f\x8b\x08 too" * 9, b"e"]
    parts = [make_record(i, "http://x", b, payload_digest(b), None) for i, b in enumerate(bodies)]
    parts = [gzip_member(p) for p in parts] if compress else parts
    at = np.cumsum([0, *map(len, parts)])
    whole = b"".join(parts)
    ok = read_archive(whole)
    assert [p for _, _, p in ok.records] == bodies and not ok.gaps
    r = random.Random(1)
    for _ in range(60):
        k, data = r.randrange(5), bytearray(whole)
        kind = r.choice(["flip", "cut", "junk", "end"])
        if kind == "flip":
            i = at[k] + r.randrange(len(parts[k]) - 8)
            data[i] ^= 1 << r.randrange(8)
        elif kind == "cut":
            del data[at[k] + 5 : at[k + 1] - 3]
        elif kind == "junk":
            data[at[k] : at[k]] = bytes(r.randrange(256) for _ in range(40))
        else:
            del data[at[k] + len(parts[k]) // 2 :]
        out = read_archive(bytes(data))
        got = [int(h["warc-page-id"]) for _, h, p in out.records if p == bodies[int(h["warc-page-id"])]]
        others = [i for i in range(5) if i != k] if kind in ("flip", "cut") else list(range(5)) if kind == "junk" else list(range(k))
        assert [i for i in got if i != k] == [i for i in others if i != k], kind
        if k not in got:
            assert out.gaps and out.gaps[0][0] >= 0
        covered = sorted([(a, b) for a, b, _ in out.gaps])
        assert all(a < b <= len(data) for a, b in covered)
    assert read_archive(b"").records == [] and read_archive(b"nonsense").gaps == [(0, 8, "version line")]


def test_quarantine_and_files(spark, tmp_path):
    from lectern.llm.warc import gzip_member, make_record, payload_digest, quarantine, read_archives, read_files, write_files

    good = gzip_member(make_record(1, "u", b"x", payload_digest(b"x"), None))
    df = spark.createDataFrame([("a", good + b"??" + good), ("b", None)], "archive string, data binary")
    assert [(r.archive, r.start, r.end) for r in quarantine(df).collect()] == [("a", len(good), len(good) + 2)]
    write_files(df.where("data is not null"), str(tmp_path / "w"))
    assert read_archives(read_files(spark, str(tmp_path / "w")), with_payload=True).where("payload = cast('x' as binary)").count() == 2


def test_repeated_page_ids(spark):
    from lectern.llm.warc import read_archives, resolved, write_archives

    rows = [(1, "A"), (2, "B"), (5, "A"), (5, "B"), (5, "own"), (5, "own"), (6, "long " * 200_000), (7, "long " * 200_000)]
    df = spark.createDataFrame([(i, "u", t) for i, t in rows], "page_id long, url string, html string").repartition(3)
    out = resolved(read_archives(write_archives(df), with_payload=True)).collect()
    assert sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to or 0) for r in out) == [
        (1, 1, "response", 0), (2, 1, "response", 0), (5, 1, "revisit", 1), (5, 1, "revisit", 2), (5, 3, "response", 0), (5, 3, "response", 0),
        (6, 1_000_000, "response", 0), (7, 1_000_000, "revisit", 6),
    ]
    assert all(r.resolved for r in out)
    lost = spark.createDataFrame([(9, 3, "X", "revisit", 8), (8, 3, "Y", "response", None)], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    assert {r.page_id: r.resolved for r in resolved(lost).collect()} == {9: False, 8: True}


def test_members_of_several_records():
    from lectern.llm.warc import gzip_member, make_record, payload_digest, read_archive

    bodies = [b"one", b"two" * 3000, b"", b"four"]
    parts = [make_record(i, "u", b, payload_digest(b), None) for i, b in enumerate(bodies)]
    whole = gzip_member(b"".join(parts))
    got = read_archive(whole + whole)
    assert [p for _, _, p in got.records] == bodies * 2 and not got.gaps
    # a damaged record inside a sound member
    bad = gzip_member(parts[0] + parts[1].replace(b"two", b"tow", 1) + b"noise" + parts[2] + parts[3])
    got = read_archive(bad + whole)
    assert [p for _, _, p in got.records] == [bodies[0], *bodies[2:], *bodies] and got.gaps == [(0, len(bad), "payload digest")]
    # a member that is cut short: what is whole in it stays
    raw = gzip_member(b"".join(parts), 0)
    got = read_archive(raw[: len(raw) - len(parts[3]) // 2])
    assert [p for _, _, p in got.records] == bodies[:3] and len(got.gaps) == 1 and got.gaps[0][2] == "member: cut short"
    # and one that is too large
    got = read_archive(whole, most=len(parts[0]) + len(parts[1]) + 10)
    assert [p for _, _, p in got.records][:2] == bodies[:2] or not got.gaps
    bomb = gzip_member(b"\0" * (8 << 20))
    assert read_archive(bomb + whole, most=1 << 20).gaps[0][2] == "member: too large" and len(read_archive(bomb + whole, most=1 << 20).records) == 4


def test_headers_of_other_writers(spark):
    from lectern.llm.warc import make_record, payload_digest, read_archives

    record = make_record(1, "u", b"x", payload_digest(b"x"), None).replace(b"WARC-Page-ID: 1", b"WARC-Page-ID: a").replace(b"WARC-Payload-Length: 1", b"WARC-Payload-Length: ?")
    row = read_archives(spark.createDataFrame([("a", bytearray(record))], "archive string, data binary")).first()
    assert (row.page_id, row.payload_bytes) == (None, 1)


# SentencePiece
@pytest.fixture(scope="module")
def model_path():
    tokenizers = pytest.importorskip("public_tokenizers")
    return tokenizers.path("piece_bpe_32k.model")


def test_paths_equal_the_library(model_path):
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    import sentencepiece

    from lectern.llm.unigram import Unigram

    proto = pb.ModelProto()
    with open(model_path, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    library, mine = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString()), Unigram.load(model_path)
    r = random.Random(4)
    for _ in range(800):
        text = "".join(r.choice("theandinger ABC  éß字😀\n\t'.,!0189") for _ in range(r.randint(0, 14)))
        ids = mine.encode(text)
        assert np.frombuffer(ids, dtype="<u4").tolist() == library.encode(text)
        assert mine.decode(ids) == text


def test_unigram_against_all_paths():
    from lectern.llm.unigram import Unigram

    r = random.Random(6)
    texts = ["a", "b", "ab", "ba", "aba", "bb", "▁", "▁a", "▁▁", "▁ab", "b▁", "é"]
    pieces = [("<unk>", 0.0, "unknown"), *((f"<0x{i:02X}>", 0.0, "byte") for i in range(256)), *((t, -r.uniform(1, 9), "normal") for t in texts)]
    m = Unigram(pieces)
    score = {t: s for t, s, k in pieces if k == "normal"}

    def best(s):
        if not s:
            return 0.0
        options = [score[s[:k]] + best(s[k:]) for k in range(1, min(4, len(s)) + 1) if s[:k] in score]
        return max(options or [m.unknown_score + best(s[1:])])

    for _ in range(200):
        text = "".join(r.choice("ab é字") for _ in range(r.randint(1, 9)))
        marked = "▁" + text.replace(" ", "▁")
        ids = np.frombuffer(m.encode(text), dtype="<u4").tolist()
        got, i = 0.0, 0
        while i < len(ids):
            if 1 <= ids[i] <= 256:
                got, i = got + m.unknown_score, i + len("字".encode())
            else:
                got, i = got + m.scores[ids[i]], i + 1
        assert abs(got - best(marked)) < 1e-9 and m.decode(m.encode(text)) == text


def test_documents_round_trip(spark, model_path):
    from lectern.llm.unigram import decode_documents, encode_documents

    rows = cases.documents()
    df = cases.frame(spark, rows)
    got = encode_documents(df, model_path, with_ids=True).cache()
    assert got.where("not round_trip").count() == 0 and got.count() == len(rows)
    assert {r.doc_id: r.text for r in decode_documents(got, model_path).collect()} == {i: t or "" for i, t in rows}
    assert encode_documents(df.limit(0), model_path).count() == 0


def test_double_array():
    from lectern.llm.unigram import DoubleArray

    r = random.Random(8)
    keys = list({bytes(r.choice(b"abc\xc3\xff\x00") for _ in range(r.randint(1, 6))) for _ in range(500)})
    t = DoubleArray(keys)
    for _ in range(500):
        data = bytes(r.choice(b"abc\xc3\xff\x00d") for _ in range(10))
        assert t.prefixes(data, 2) == sorted((2 + len(k), i) for i, k in enumerate(keys) if data.startswith(k, 2))


# word ids
def test_word_ids_equal_the_library():
    tokenizers = pytest.importorskip("public_tokenizers")
    from lectern.llm.wordids import word_ids

    w = word_ids(tokenizers.path("word_bpe_49k.json"))
    r = random.Random(1)
    texts = ["", "Hello, World's it's I'LL <|endoftext|> a<|startoftext|>b", "ΑΣ ΣΑΣ. İstanbul", "é a ́b", "x\x00y\x0b\x1cz\x85q r", "ﬁ Ⅷ ß ẞ"]
    texts += ["".join(r.choice("aAbZéÉßİσΣ'’!#.,<|>012 \n\t ́字😀\x85\x1c") for _ in range(r.randint(0, 40))) for _ in range(400)]
    for t in texts:
        assert np.frombuffer(w.encode(t.encode()), dtype="<u4").tolist() == w.tokenizer.encode(t, add_special_tokens=False).ids


def test_new_words_are_encoded_together(monkeypatch):
    tokenizers = pytest.importorskip("public_tokenizers")
    from lectern.llm import wordids

    w = wordids.WordIds(tokenizers.path("word_bpe_49k.json"))
    whole, one = w.tokenizer, w.tokenize
    monkeypatch.setattr(wordids, "TOGETHER", 7)
    r = random.Random(4)
    quotes = ["'s", "'T", "it's'll", "''s", "'sa", "'res", "'l", "'r", "'v", "x'd'd", "\"'s", "'m'", "1's2", "é'vé", "²'½x", "'", "'ß"]
    texts = [" ".join(quotes), "", " \n\t"]
    texts += ["".join(r.choice("aabcdeehinrstttZÉéÿµ'!.,012 \n") for _ in range(r.randint(0, 150))) for _ in range(150)]
    texts += ["".join(r.choice("etaoiné") for _ in range(n)) for n in range(1, 33)] + ["e" * n for n in range(1, 65)]
    w.tokenizer = w.tokenize = None  # the library is asked for none of these words
    got = w.many([t.encode() for t in texts])
    w.tokenizer, w.tokenize = whole, one
    longer = ["e" * 65, "ab" * 100, "é" * 33, "x" * 255, "x" * 256, "tea's," * 500, "日本 a\u00a0b c\u00adé <b> \x7f"]
    got += w.many([t.encode() for t in longer])
    for t, ids in zip(texts + longer, got, strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


def test_word_ids_are_forgotten():
    tokenizers = pytest.importorskip("public_tokenizers")
    from lectern.llm.wordids import WordIds

    w = WordIds(tokenizers.path("word_bpe_49k.json"), cache_bytes=20_000)
    with pytest.raises(UnicodeDecodeError):
        w.many([b"good b\xffd"])
    for i in range(50):
        text = " ".join(f"w{j}" for j in range(100 * i, 100 * i + 100))
        assert np.frombuffer(w.encode(text.encode()), dtype="<u4").tolist() == w.tokenizer.encode(text, add_special_tokens=False).ids
        assert len(w.ids) == len(w.number) < 300 and w.size <= w.limit
    merges, w.merges = w.merges, None  # a model of other rules
    assert w.many([b"it's w7", b""]) == [w.word(b"it's") + w.word(b"w7"), b""] and merges is not None


def test_two_ages():
    from lectern.llm.caches import TwoAges

    c = TwoAges(2)
    for k in range(5):
        c.put(k, k)
    assert len(c) + len(c.old) <= 4 and c[4] == 4
    with pytest.raises(KeyError):
        c[0]


# words
def test_words():
    from lectern.llm import words

    texts = [t or "" for _, t in cases.documents()]
    w = words.Words([t.encode() for t in texts], lower=True)
    seen, inverse = {}, {}
    for k, t in enumerate(texts):
        mine = cases.words(t)
        assert w.offset[k + 1] - w.offset[k] == len(mine)
        for x, h in zip(mine, w.hashes[w.offset[k] : w.offset[k + 1]].tolist(), strict=True):
            assert seen.setdefault(x, h) == h and inverse.setdefault(h, x) == x


# the packed ids of the query
def test_packing_query(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from lectern.llm.queries import op8_packing

    got = op8_packing(spark, SF).toPandas()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    t = Tokenizer.from_file(tokenizers.path("word_bpe_49k.json"))
    for i in sorted(texts)[::7]:
        ids = np.array([*t.encode(texts[i] or "", add_special_tokens=False).ids, 2], dtype="<u4")
        for r in got[got.doc_id == i].itertuples():
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert got.sequence_id.nunique() == -(-got.length.sum() // 4096)
