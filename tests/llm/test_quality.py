import numpy as np
import pytest

from histscore.llm import quality as Q
from tests.llm.helpers import SF, no_docs, odd_docs, odd_rows, real_docs, split


def brute(text):
    w = split(text)
    win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = set()
    for i, x in enumerate(win):
        if win.count(x) > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if split(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)]


def test_stats_match_brute_force():
    texts = [r["text"] for r in real_docs()[:60]] + [r[1] for r in odd_rows() if len(r[1] or "") < 5000]
    for t in texts:
        assert Q.document_stats(t)[0] == brute(t)


@pytest.fixture(scope="module")
def labelled():
    docs = {r["doc_id"]: r["text"] for r in real_docs(sf="/root/testdata/sf0.1")}
    rows = real_docs("labels", sf="/root/testdata/sf0.1")
    x = np.array([Q.document_stats(docs[r["doc_id"]])[1] for r in rows])
    return x, np.array([float(r["quality"]) for r in rows])


def test_held_out_accuracy_and_monotone(labelled):
    x, y = labelled
    held = np.arange(len(y)) % 3 == 0
    signs = [s for _, s in Q.FEATURES]
    trees = Q.fit(x[~held], y[~held], signs)
    assert ((trees.score(x[held]) >= 0.5) == y[held]).mean() > 0.97
    for j, s in enumerate(signs):
        if s:
            rising = np.repeat(x[held][:50], 40, axis=0)
            rising[:, j] = np.tile(np.linspace(0, 1, 40), 50)
            steps = np.diff(trees.margin(rising).reshape(50, 40), axis=1)
            assert (s * steps >= -1e-9).all()


def test_flat_arrays_match_a_walk(labelled):
    x, y = labelled
    trees = Q.fit(x[:600], y[:600], [s for _, s in Q.FEATURES], trees=8)
    for row in x[:40]:
        total = trees.base
        for k in trees.roots:
            while trees.left[k] != k:
                k = trees.left[k] if row[trees.feature[k]] <= trees.threshold[k] else trees.right[k]
            total += trees.value[k]
        assert abs(total - trees.margin(row[None])[0]) < 1e-9


def test_odd_rows_and_verdicts(spark):
    rows = Q.score_documents(odd_docs(spark), Q.keep_all()).collect()
    want = sorted((r[0] is None, r[0] or 0, *brute(r[1])) for r in odd_rows() if len(r[1] or "") < 5000)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows if r.doc_id != 7)
    assert got == want
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    kept = Q.keep_documents(odd_docs(spark), Q.keep_all())
    assert kept.schema == odd_docs(spark).schema
    assert kept.count() == sum(r.kept for r in rows)
    assert Q.score_documents(no_docs(spark), Q.keep_all()).count() == 0


def test_labels_with_nulls_or_none(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, None, 0), (77, 0, 1)], "doc_id long, quality int, toxic int")
    trees = Q.fit_quality(docs, labels)
    assert trees.score(np.zeros((1, len(Q.FEATURES))))[0] > 0.5  # one class: keep
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert Q.fit_quality(docs, empty).depth == 0
    real = spark.read.parquet(f"{SF}/documents.parquet")
    found = Q.score_documents(real, Q.fit_quality(real, spark.read.parquet(f"{SF}/labels.parquet")))
    assert 0 < found.filter("kept").count() < found.count()


def test_sample_is_bounded_when_a_labelled_id_repeats(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(50)] + [(k, "other") for k in range(2, 9)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), *[(k, k % 2) for k in range(2, 9)]], "doc_id long, quality int")
    x, y = Q.labelled_sample(docs, labels, rows=5)
    assert len(x) == len(y) == 5
    x, y = Q.labelled_sample(docs, labels, rows=100)
    assert len(y) == 57 and sum(y) == 3  # the smallest label of id 1
