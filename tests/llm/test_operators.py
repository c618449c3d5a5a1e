"""Every operator over awkward documents against brute force, and over an empty table."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from . import cases

TEXT = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = cases.documents()
    return rows, cases.frame(spark, rows).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], cases.SCHEMA)


# exact dedup
@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_dedup(docs, keep):
    from lectern.llm.exact_dedup import content_groups

    rows, df = docs
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").encode().translate(cases.LOWER), []).append(i)
    want = {i: ((min if keep == "min" else max)(g), len(g), hashlib.sha256(t).hexdigest()) for t, g in groups.items() for i in g}
    got = content_groups(df, keep=keep).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in got} == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)  # identifiers are unique here


def test_exact_dedup_of_hot_and_null(spark, empty):
    from lectern.llm.exact_dedup import content_groups

    rows = [(i, "Hot" if i % 3 else f"t{i}") for i in range(600)] + [(None, "hot"), (None, None), (601, None), (601, None)]
    got = content_groups(spark.createDataFrame(rows, TEXT).repartition(4), keep="max").collect()
    hot = [r for r in got if r.text_sha256 == hashlib.sha256(b"hot").hexdigest()]
    assert len(got) == 604 and len(hot) == 401 and {(r.keep_id, r.group_size) for r in hot} == {(599, 401)} and sum(r.kept for r in hot) == 1
    assert sorted((r.keep_id, r.group_size, r.kept) for r in got if r.text_sha256 == hashlib.sha256(b"").hexdigest()) == [(601, 3, False), (601, 3, False), (601, 3, True)]  # exactly one row stays
    assert content_groups(empty).count() == 0


# near duplicates
@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80)])
def test_classes(docs, n, percent):
    from lectern.llm.jaccard_join import similarity_classes

    rows, df = docs
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similarity_classes(df, n, percent).collect()}
    assert got == cases.components(rows, n, percent)


def test_classes_of_chains_and_copies(spark):
    from lectern.llm.jaccard_join import similarity_classes

    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(words[i : i + 100])) for i in range(0, 200, 4)]  # each like its neighbours alone
    rows += [(1000 + i, "copy of one text that many documents hold in full") for i in range(50)] + [(None, "copy of one text that many documents hold in full"), (None, None)]
    got = {r.doc_id: r.component_id for r in similarity_classes(spark.createDataFrame(rows, TEXT).repartition(5), 4, 85).collect() if r.doc_id is not None}
    assert {got[i] for i in range(0, 200, 4)} == {0} and {got[i] for i in range(1000, 1050)} == {1000}


def test_classes_split_hot_lists(spark, monkeypatch):
    from lectern.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "HOT", 2)
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    rows = cases.documents()[:40]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similarity_classes(cases.frame(spark, rows), 4, 85).collect()}
    assert got == cases.components(rows, 4, 85)


@pytest.mark.parametrize("percent", [50, 75, 80, 85, 90])
def test_classes_of_the_smallest_sets_that_link(spark, percent):
    from lectern.llm.jaccard_join import similarity_classes

    least = -(-percent // (100 - percent))  # of so many shingles, one more makes a similar set; of fewer, a different one
    rows = []
    for k in range(max(1, least - 1), least + 2):
        words = [f"s{k}w{i}" for i in range(k + 5)]  # k shingles of 5 words, then k + 1
        rows += [(10 * k, " ".join(words[:-1])), (10 * k + 1, " ".join(words))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similarity_classes(spark.createDataFrame(rows, TEXT), 5, percent).collect()}
    assert got == cases.components(rows, 5, percent) and got[10 * least + 1] == (least + 1, 10 * least)


@pytest.mark.parametrize("hot,block", [(4096, 128), (2, 3)])
def test_every_link(spark, monkeypatch, hot, block):
    from lectern.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "HOT", hot)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = cases.documents()
    sets = {}
    for i, t in rows:
        if s := cases.shingle_set(t, 4):
            sets.setdefault(s, []).append(i)
    held = sorted((min(of), s, len(of)) for s, of in sets.items())
    want = {(i, i, len(s), len(s), len(s), m * (m - 1) // 2) for i, s, m in held if m > 1}
    for k, (a, x, mx) in enumerate(held):
        for b, y, my in held[k + 1 :]:
            both = len(x & y)
            if 100 * both >= 85 * (len(x) + len(y) - both):
                want.add((a, b, len(x), len(y), both, mx * my))
    got = [tuple(r) for r in jaccard_join.similarity_links(cases.frame(spark, rows).repartition(3), 4, 85).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    linked = [w for w in want if w[0] < w[1]]
    assert len(linked) > len({w[1] for w in linked})  # more links than a tree of each component has


def test_count_vectors_bound_the_difference():
    from lectern.llm.jaccard_join import _least_difference, _vector

    r = np.random.default_rng(1)
    for n, m in ((5, 900), (300, 310), (2000, 70)):
        x, y = (np.unique(r.integers(0, 3000, k, dtype=np.uint64)) for k in (n, m))
        assert _least_difference(_vector(x), _vector(y)) <= len(np.setxor1d(x, y))


# substring dedup
def test_repeats(docs):
    from lectern.llm.substring_dedup import remove_repeats

    rows, df = docs
    got = remove_repeats(df, with_text=True, carry=("id", "rest")).collect()
    want = cases.without_repeats(rows)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want
    texts = dict(rows)
    assert all(r.id == 5 and r.rest == "rest" for r in got) and all(r.kept_text == (texts[r.doc_id] or "") for r in got if not r.n_removed)
    assert any(w[1] for w in want.values())


def test_repeats_in_small_chunks(docs):
    from lectern.llm.substring_dedup import remove_repeats

    rows, df = docs
    got = remove_repeats(df, chunk_bytes=900).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == cases.without_repeats(rows)


def test_repeats_of_equal_and_null_ids(spark):
    from lectern.llm.substring_dedup import remove_repeats

    text = " ".join(f"w{i}" for i in range(20))
    rows = [(3, text), (3, text), (None, text), (None, text)]
    got = remove_repeats(spark.createDataFrame(rows, TEXT)).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 20), (0, 20), (3, 0), (3, 0)]


# packing
def numbers(text):
    return b"".join((len(w) % 50 + 3).to_bytes(4, "little") for w in text.split())


def test_packing(docs):
    from lectern.llm.packing import pack

    rows, df = docs
    got = pack(df, lambda: numbers, capacity=256).toPandas()
    assert got.groupby("doc_id").length.sum().to_dict() == {i: len(cases.words(t)) + 1 for i, t in rows}
    for _, g in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert (g.length.cumsum() - g.length).tolist() == g.offset.tolist() and g.length.sum() <= 256
    assert sorted(got.sequence_id.unique()) == list(range(got.sequence_id.nunique()))
    # two thirds of the pieces are 201 long here, with little to fill the gaps; still near the bound
    assert got.sequence_id.nunique() <= 1.02 * math.ceil(got.length.sum() / 256)


def test_minimum_slack():
    from lectern.llm.packing import SlotTable, best_fill, plan

    assert best_fill({7: 1, 5: 2, 3: 1}, 13) == {5: 2, 3: 1}
    assert sum(k * n for k, n in best_fill({9: 3, 4: 2}, 14).items()) == 13
    r = random.Random(2)
    for _ in range(20):
        lengths = [r.randint(1, 64) for _ in range(r.randint(1, 60))]
        patterns = plan(dict(Counter(lengths)), 64)
        used = Counter()
        for p, times in patterns:
            assert sum(k * n for k, n in p.items()) <= 64
            used.update({k: n * times for k, n in p.items()})
        assert used == Counter(lengths)
        table, rank = SlotTable(patterns), Counter()
        seen = set()
        for x in lengths:
            s, o = table.place(np.array([x]), np.array([rank[x]]))
            rank[x] += 1
            cells = {(int(s[0]), int(o[0]) + i) for i in range(x)}
            assert not cells & seen
            seen |= cells


# language model
def test_language_model(docs):
    from lectern.llm.lm import score_documents

    rows, df = docs
    got = score_documents(df, F.crc32(F.col("doc_id").cast("string")) % 5 == 1, chunk_bytes=20_000).collect()
    tokens = {i: [*cases.words(t), None] for i, t in rows}
    c = Counter(x for i, t in tokens.items() if not cases.held_out(i, 5) for x in t)
    total, kinds = sum(c.values()), len(c)
    assert len(got) == len(rows)
    for r in got:
        t = tokens[r.doc_id]
        base = sum(math.log10(c[w] + 0.5) for w in t) - len(t) * math.log10(total + 0.5 * (kinds + 1))
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(c[w] > 0 for w in t), total, cases.held_out(r.doc_id, 5))
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and r.score < 0


def test_classes_are_a_distribution():
    from lectern.llm import lm

    t = lm.tokens([b"a b a c", b"b a"])
    rows = lm.features(t, 4)
    w = np.random.default_rng(1).normal(size=(lm.KINDS << 4, lm.CLASSES)).astype(np.float32)
    total = sum(10 ** lm.class_log10(w, np.zeros(lm.CLASSES, np.float32), rows, np.full(len(t.doc), k)) for k in range(lm.CLASSES))
    assert np.allclose(total, 1, atol=1e-4)


def test_pair_weights_are_the_optimum():
    from lectern.llm import lm

    r = np.random.default_rng(5)
    share = r.dirichlet(np.ones(30))[:20]  # a third of the class is unseen after each history
    of, count = np.repeat(np.arange(4), 5), r.integers(1, 40, 20).astype(float)
    w, log_z = lm.pair_weights(of, count, share, 5)
    assert log_z[4] == 0  # nothing seen
    for h in range(4):
        k = of == h
        z = 1 + (share[k] * np.expm1(w[k])).sum()
        assert abs(np.log(z) - log_z[h]) < 1e-9  # all words of the class sum to 1
        gradient = count[k] - count[k].sum() * share[k] * np.exp(w[k]) / z - w[k] / lm.VARIANCE
        assert np.abs(gradient).max() < 0.05


def test_gradient_of_the_scales():
    from lectern.llm import lm

    r = random.Random(2)
    t = lm.tokens([" ".join(r.choice("abcdefgh") * r.randint(1, 2) for _ in range(300)).encode()])
    y, _ = lm.word_classes(t, np.empty(0, np.uint64), np.empty(0, np.int64))
    rows, share = lm.features(t, 4), np.full(lm.CLASSES, 1 / lm.CLASSES)
    counts = np.zeros((lm.KINDS << 4, lm.CLASSES))
    for f in rows:
        np.add.at(counts, (f, y), 1)
    direction, n = lm.directions(counts, share)
    bias, scales = np.log(share).astype(np.float32), np.full(lm.KINDS * lm.LEVELS, 0.4)
    at = lambda s: lm.gradient(direction, n, share, s, 4, bias, rows, y)
    got = at(scales)
    for i in np.flatnonzero(np.abs(got[: len(scales)]) > 1)[:6]:
        step = np.zeros(len(scales))
        step[i] = 1e-2
        assert abs((at(scales + step)[-1] - at(scales - step)[-1]) / 2e-2 - got[i]) < 0.02 * abs(got[i]) + 0.1


def test_whole_model_is_a_distribution(spark):
    """Of all next words, known and one unknown of each class, the probabilities sum to 1."""
    from lectern.llm import lm

    r = random.Random(8)
    names = [f"{c}{d}" for c in "abcd" for d in "xyz"]
    train = [(i, " ".join(r.choice(names) for _ in range(r.randint(3, 9)))) for i in range(40)]
    group = lambda w: int(lm.tokens([w.encode()]).group[0])
    known = sorted({w for _, t in train for w in t.split()})
    unknown, k = {}, 0
    while len(unknown) < lm.LETTERS:
        w = f"q{k}{chr(97 + k % 26)}"
        unknown.setdefault(group(w), w)
        k += 1
    # a text of the history alone, and with each next word: the difference of scores is that word's, less the end's
    history = "ax by"
    probes = [(1000 + i, f"{history} {w}") for i, w in enumerate([*known, *unknown.values()])]
    docs = spark.createDataFrame([*train, (999, history), *probes], TEXT)
    got = {x.doc_id: x.score for x in lm.score_documents(docs, F.col("doc_id") >= 999).collect()}
    assert len(got) == 41 + len(probes)
    # the end after the history, and after each longer one, are unknown: bound both
    words = sum(10 ** (got[i] - got[999]) for i, _ in probes)
    assert 0.3 < words < 60


def test_scores_do_not_follow_partitions(spark, docs):
    from lectern.llm import lm

    _, df = docs
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    one, many = ({r.doc_id: r.score for r in lm.score_documents(df.repartition(n), held, chunk_bytes=c).collect()} for n, c in ((1, 1 << 22), (7, 30_000)))
    assert all(abs(one[i] - many[i]) < 1e-5 * abs(one[i]) + 1e-3 for i in one)


def test_gain_on_held_out_texts(spark):
    from lectern.llm.queries import op2_lm_score

    rows = op2_lm_score(spark, "/root/testdata/sf0.01").groupBy("held_out").agg((F.sum("score") / F.sum("n_tokens")).alias("s"), (F.sum("base_score") / F.sum("n_tokens")).alias("b"))
    got = {r.held_out: r.s - r.b for r in rows.collect()}
    assert got[True] > 0.4 and got[False] > got[True]  # log10 a token


def test_end_of_few_long_texts(spark):
    from lectern.llm import lm

    r = random.Random(4)
    texts = [" ".join(f"w{r.randrange(50)}" for _ in range(270_000)) for _ in range(1)]  # the end has less than 1/HOT_WORDS
    rows = spark.createDataFrame([(i, t, i < 1) for i, t in enumerate([*texts, ""])], "id long, text string, train boolean")
    words = lm.vocabulary(rows.where("train"), 4, 1 << 20).cache()
    model = lm.fit(rows.where("train"), words, chunk_bytes=1 << 20)
    assert lm.HOT_WORDS < model.total == 270_001 and abs(model.bias[0] - math.log(1.5 / (model.total + 0.5 * lm.CLASSES))) < 1e-5
    # the end is alone in its class: its probability is that of the class
    end = lm.class_log10(model.weights, model.bias, lm.features(lm.tokens([b""]), model.bits), np.zeros(1, dtype=np.int64))[0]
    got = {x.id: x for x in lm.score(rows, model, words, 4).collect()}
    assert (got[1].n_tokens, got[1].n_known) == (1, 1) and abs(got[1].score - end) < 1e-6


def test_three_bytes():
    from lectern.llm.lm import _from_three, _three

    x = np.array([0, 1, 255, 256, 65536, (1 << 24) - 1])
    assert _from_three(_three(x)).tolist() == x.tolist() and len(_three(x)) == 18


# quality
def test_quality(docs, spark):
    from lectern.llm.quality import classify

    rows, df = docs
    labels = spark.createDataFrame([(i, int(len(cases.words(t)) > 30), 0) for i, t in rows] + [(None, 1, 0), (999, None, 0)], "doc_id long, quality int, toxic int")
    got = classify(df, labels, F.crc32(F.col("doc_id").cast("string")) % 3 == 1).collect()
    assert {r.doc_id for r in got} == {i for i, _ in rows} and all(0 < r.score < 1 and r.predicted == (r.score >= 0.5) and r.held_out == cases.held_out(r.doc_id, 3) for r in got)
    none = classify(df, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}


def test_quality_learns_held_out(spark):
    from lectern.llm.queries import op6_quality

    d = "/root/testdata/sf0.01"
    got = op6_quality(spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").selectExpr("avg(int(predicted = quality)) as a", "count(*) as n").first()
    assert got.n > 80 and got.a > 0.97


# license scan
def test_licenses(spark, empty):
    from lectern.llm.license_scan import TEMPLATES, scan, template_words, window_shape

    r = random.Random(5)
    filler = [f"f{i}" for i in range(100)]
    rows = []
    for k in range(60):
        body = [r.choice(filler) for _ in range(r.randint(0, 60))]
        notice = r.choice(TEMPLATES)[1].split()
        if k % 3 == 0:
            notice[r.randrange(len(notice))] = "changed"
        at = r.randint(0, len(body))
        rows.append((k, " \n".join(body[:at] + (notice if k % 5 else []) + body[at:])))
    rows += [(100, None), (101, ""), (102, "RELEASED under the MIT license."), (102, "Released under the MIT License."), (None, "Released under the MIT License.")]
    want = Counter()
    for i, t in rows:
        w = [x.decode() for x in cases.words(t)]
        s = [tuple(w[j : j + 5]) for j in range(len(w) - 4)]
        for name, text in TEMPLATES:
            tw = template_words(text)
            ts = {tuple(tw[j : j + 5]) for j in range(len(tw) - 4)}
            block, blocks, _ = window_shape(len(ts))
            hits = [(len(ts & set(s[j : j + block * blocks])) / len(ts), j) for j in range(0, len(s), block)]
            hits = [h for h in hits if h[0] >= 0.8]
            if hits:
                want[i, name, max(h[0] for h in hits), len(hits), min(h[1] for h in hits)] += 1
    got = Counter((x.doc_id, x.license_id, x.containment, x.n_windows, x.first_word) for x in scan(spark.createDataFrame(rows, TEXT)).collect())
    assert got == want and scan(empty).count() == 0


def test_registered_licenses(spark, monkeypatch):
    from lectern.llm import queries
    from lectern.llm.license_scan import TEMPLATES
    from lectern.llm.license_texts import licenses

    every = licenses()
    before, after = "some words that stand before it\n", "\nand a few more words after"
    rows = [(i, before + "\n".join(f" * {line}" for line in t.splitlines()) + after) for i, (_, t) in enumerate(every)]
    rows += [(1000 + i, f"{before}\u201c{t.rstrip('.')}\u201d, and{after}") for i, (_, t) in enumerate(TEMPLATES)]
    rows += [(2000, "// SPDX-License-Identifier: (MIT OR Apache-2.0)"), (2001, "nothing of the kind stands in this text"), (2002, None)]
    monkeypatch.setattr(queries, "read", lambda *_: spark.createDataFrame(rows, TEXT).repartition(4))
    got = {}
    for r in queries.op10_license_scan(spark, "").collect():
        got.setdefault(r.doc_id, {})[r.license_id] = r.containment
    for i, (name, _) in enumerate(every):
        assert got[i][name] == 1, name
    for i, (name, _) in enumerate(TEMPLATES):
        assert got[1000 + i][name] == 1, name
    assert got[2000] == {"spdx:mit or apache-2.0": 1} and not {2001, 2002} & set(got)


def test_band_settings():
    from lectern.llm.license_scan import inserted, window_shape

    for m in range(1, 200):
        block, blocks, bands = window_shape(m)
        assert block * blocks >= m + inserted(m) + block - 1  # some window holds any m shingles and what is inserted
        found = math.ceil(0.8 * m - 1e-9)
        assert 1 - (1 - found / (block * blocks + m - found)) ** bands >= 0.999 - 1e-9


def test_inserted_words(spark):
    """Whole-text containment, whatever windows the operator makes: words inserted in the middle or in several places."""
    from lectern.llm.license_scan import MARKS, SHINGLE, inserted, scan, template_words
    from lectern.llm.license_texts import licenses

    r = random.Random(11)
    rows, want = [], set()
    for name, text in licenses():
        w = template_words(text, MARKS)
        grams = lambda x: {tuple(x[j : j + SHINGLE]) for j in range(len(x) - SHINGLE + 1)}
        shingles = grams(w)
        g = inserted(len(shingles))
        if not g:
            continue
        lacks = len(shingles) - math.ceil(0.8 * len(shingles) - 1e-9)
        for places in {1, lacks // (SHINGLE - 1)}:
            cuts, out = sorted(r.sample(range(SHINGLE, len(w) - SHINGLE), places)), []
            for i, word in enumerate(w):
                out += [f"own{r.randrange(10**6)}" for _ in range(g // places if i in cuts else 0)] + [word]
            if len(shingles & grams(out)) >= 0.8 * len(shingles):
                for at in (0, r.randrange(1, 700)):
                    rows.append((len(rows), " ".join([f"before{k}" for k in range(at)] + out + ["after"] * 9)))
                    want.add((len(rows) - 1, name))
    got = {(x.doc_id, x.license_id) for x in scan(spark.createDataFrame(rows, TEXT).repartition(8), licenses(), apart=MARKS).collect()}
    assert len(want) > 80 and want <= got, sorted(want - got)


def test_many_templates(spark, monkeypatch):
    from lectern.llm import license_scan

    monkeypatch.setattr(license_scan, "MOST_TEMPLATES", 3)
    rows = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(license_scan.TEMPLATES)], TEXT)
    assert {(r.doc_id, r.license_id) for r in license_scan.scan(rows).collect()} == {(i, n) for i, (n, _) in enumerate(license_scan.TEMPLATES)}


# what workers keep
def test_chunks_are_bounded():
    import pyarrow as pa

    from lectern.llm.words import chunks

    batch = pa.record_batch({"text": ["", None] * 50_000 + ["x" * 100] * 50})
    got = list(chunks([batch, batch], "text", 1000, rows=4096))
    assert sum(t.num_rows for t in got) == 2 * batch.num_rows and max(t.num_rows for t in got) <= 4096
    assert all(sum(len(x or "") for x in t["text"].to_pylist()) <= 1000 for t in got)


def test_caches_are_bounded():
    from lectern.llm.caches import OVERHEAD, TwoAges, kept, tidy

    c = TwoAges(10_000)
    for i in range(1000):
        c.put(f"k{i}", b"v")
    c.put("x" * 300, b"v")
    assert c["k999"] == b"v" and len(c) + len(c.old) <= 2 * (10_000 // OVERHEAD + 1) and "x" * 300 not in c
    a = kept("a", "m", list)
    assert kept("a", "m", list) is a
    assert list(tidy(lambda b: iter(b), "b")([1, 2])) == [1, 2] and kept("a", "m", list) is not a


def test_batches_of_the_session(spark):
    from lectern.llm.common import bounded_batches

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    for given, want in (("64m", "8388608"), ("1m", "1m"), ("67108864b", "8388608")):
        spark.conf.set(key, given)
        bounded_batches(spark)
        assert spark.conf.get(key).rstrip("b") == want
    spark.conf.set(key, before)


def test_quadratic_discriminant_by_brute_force(spark):
    """The fitted model and its scores against densities computed one row at a time from the same statistics."""
    from lectern.llm import quality

    r = np.random.default_rng(3)
    p = len(quality.FEATURES)
    x = np.column_stack([r.normal(size=(80, p)) * np.arange(1, p + 1), r.integers(0, 60, 80)])
    y = r.integers(0, 2, 80)
    x[:, 0] += 2 * y
    rows = spark.createDataFrame([(i, [float(v) for v in x[i]], int(y[i])) for i in range(80)], "id long, x array<double>, label int").repartition(3)
    model = quality.fit(rows, shrinkage=0.3)
    z = [[(x[i, j] - x[:, j].mean()) / x[:, j].std() * x[i, p] / (x[i, p] + quality.HALF) for j in range(p)] for i in range(80)]
    pooled = np.diag([max(np.mean([row[j] ** 2 for row in z]), 1e-3) for j in range(p)])
    side = []
    for k in (0, 1):
        own = np.array([z[i] for i in range(80) if y[i] == k])
        m, n = own.mean(0), len(own)
        c = sum(np.outer(v - m, v - m) for v in own) / n
        w = (0.3 * n + p) / (n + p)
        side.append((m, (1 - w) * c + w * pooled, math.log((n + 1) / 82)))
    got = {g.id: g.score for g in quality.score(rows, model).collect()}
    for i in range(80):
        d = [prior - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * (z[i] - m) @ np.linalg.solve(c, z[i] - m) for m, c, prior in side]
        assert abs(got[i] - 1 / (1 + math.exp(d[0] - d[1]))) < 1e-9


def test_minimum_slack_is_minimal():
    from itertools import product

    from lectern.llm.packing import best_fill, plan

    r = random.Random(6)
    for _ in range(60):
        counts = Counter(r.randint(1, 20) for _ in range(r.randint(1, 9)))
        target = r.randint(1, 40)
        every = (sum(k * n for k, n in zip(counts, use, strict=True)) for use in product(*(range(n + 1) for n in counts.values())))
        got = best_fill(dict(counts), target)
        assert sum(k * n for k, n in got.items()) == max(s for s in every if s <= target) and all(got[k] <= counts[k] for k in got)
        first, _ = plan(dict(counts), 40)[0]
        assert max(counts) in first  # the longest opens a window


# empty tables
def test_empty_tables(spark, empty):
    from lectern.llm.jaccard_join import similarity_classes
    from lectern.llm.lm import score_documents
    from lectern.llm.packing import pack
    from lectern.llm.quality import classify
    from lectern.llm.substring_dedup import remove_repeats

    labels = spark.createDataFrame([], "doc_id long, quality int")
    for out in (similarity_classes(empty), score_documents(empty), pack(empty, lambda: numbers), classify(empty, labels), remove_repeats(empty)):
        assert out.count() == 0
