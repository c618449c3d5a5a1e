"""The pipeline against brute force, stage by stage, on the smallest tables."""

import pytest

import corpus_pipeline
from lectern.llm.common import materialize, read

from . import cases

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    import corpus_pipeline as c

    columns = read(spark, SF, "documents").columns
    docs = read(spark, SF, "documents")
    rows = lambda d: sorted((r.doc_id, r.text) for r in d.select("doc_id", "text").collect())
    for name, stage in c.STAGES:
        before = rows(docs)
        docs = materialize(stage(spark, docs, SF), f"test-{name}")
        if name == "packing":
            assert set(docs.toPandas().doc_id) == {i for i, _ in before}
            continue
        after = rows(docs)
        assert docs.columns == columns
        if name == "quality":
            labels = {r.doc_id: r.quality for r in read(spark, SF, "labels").collect()}
            kept = {i for i, _ in after}
            right = [(i in kept) == bool(labels[i]) for i, _ in before if i in labels]
            assert sum(right) >= 0.95 * len(right)  # ten rows of one class to learn from
        elif name == "exact_dedup":
            last = {}
            for i, t in before:
                last[(t or "").encode().translate(cases.LOWER)] = i
            assert {i for i, _ in after} == set(last.values())
        elif name == "near_dedup":
            assert {i for i, _ in after} == {i for i, (_, k) in cases.components(before, 5, 80).items() if i == k}
        else:
            want = cases.without_repeats(before)
            texts = dict(before)
            for i, t in after:
                words = cases.words(t, lower=False)
                assert len(words) == want[i][0] - want[i][1] and (want[i][1] or t == texts[i])


def test_run(spark):
    import corpus_pipeline as c

    assert c.run(spark, SF).count() > 0


AWKWARD = [
    (9, "Dup text"), (7, "dup TEXT"), (7, "only here"), (7, "only here"), (None, "null id one"), (None, "null id one"), (None, "null id two"), (3, None), (4, ""), (4, ""), (5, " "),
    (20, " ".join(f"a{i}" for i in range(60))), (21, " ".join(f"a{i}" for i in range(61))), (21, "another text under a number that repeats"), (None, " ".join(f"a{i}" for i in range(62))),
]
COLUMNS = "doc_id long, text string, id long, th long, n long, component long, _rest string, _text string"


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(i, t, k, 1, 2, 3, "r", "t") for k, (i, t) in enumerate(AWKWARD)], COLUMNS).repartition(3)


def kept(frame):
    return sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in frame.collect())


def test_exact_dedup_keeps_one_row_of_each_content(spark, awkward):
    got = corpus_pipeline.exact_dedup(spark, awkward, "")
    assert got.columns == awkward.columns and all(r._rest == "r" and r._text == "t" and r.th == 1 for r in got.collect())
    best = {}
    for i, t in AWKWARD:
        k = (t or "").lower()
        best[k] = max(best.get(k, (-1, "")), (-1 if i is None else i, t or ""), key=lambda x: x[0])
    assert sorted((r.doc_id if r.doc_id is not None else -1, (r.text or "").lower()) for r in got.collect()) == sorted((i, k) for k, (i, _) in best.items())
    assert corpus_pipeline.exact_dedup(spark, awkward.limit(0), "").count() == 0


def test_near_dedup_loses_no_unlike_text(spark, awkward):
    got = corpus_pipeline.near_dedup(spark, awkward, "")
    a60 = " ".join(f"a{i}" for i in range(60))
    texts = [r.text for r in got.collect()]
    assert got.columns == awkward.columns
    assert sorted(t for t in texts if t and t.strip()) == sorted([a60, "dup TEXT", "only here", "null id one", "null id two", "another text under a number that repeats"])
    assert len([t for t in texts if not t or not t.strip()]) == 4  # texts without words are like nothing
    assert corpus_pipeline.near_dedup(spark, awkward.limit(0), "").count() == 0


def test_other_stages_take_awkward_rows(spark, awkward):
    sf = "/root/testdata/sf0.001"
    good = corpus_pipeline.quality(spark, awkward, sf)
    assert good.columns == awkward.columns and good.count() <= len(AWKWARD)
    cut = corpus_pipeline.substring_dedup(spark, awkward, sf)
    assert cut.columns == awkward.columns and cut.count() == len(AWKWARD)
    long_ = {r.id: len(r.text.split()) for r in cut.where("id in (11, 12, 14)").collect()}
    assert long_ == {11: 60, 12: 1, 14: 1}  # word 61 of each is new, or in no repeated window
    packed = corpus_pipeline.packing(spark, awkward, sf).toPandas()
    assert len(packed) == len(AWKWARD) and packed.length.sum() == packed.doc_tokens.sum()
    for stage in (corpus_pipeline.quality, corpus_pipeline.substring_dedup, corpus_pipeline.packing):
        assert stage(spark, awkward.limit(0), sf).count() == 0
