"""Classifiers on held-out rows and odd input; their parts against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import wide
from tidewatch.llm import boosting, langid, quality, toxicity
from tidewatch.llm.common import crc_bucket

SF = "/root/testdata/sf0.01"


def test_trees_learn_an_interaction_and_walk_alike():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(int)
    model = boosting.train_trees(x[:3000], y[:3000])
    assert ((model.probability(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95
    inner = model.feature.shape[1]
    for row, got in zip(x[:50], model.margin(x[:50]), strict=True):
        total = model.base
        for t in range(len(model.feature)):
            node = 0
            while node < inner:
                node = 2 * node + 1 + (row[model.feature[t, node]] > model.threshold[t, node])
            total += model.value[t, node - inner]
        assert got == pytest.approx(total)


@pytest.mark.parametrize("y", [[], [1, 1, 1], [0, 0]])
def test_trees_without_both_classes(y):
    model = boosting.train_trees(np.zeros((len(y), 3)), np.array(y))
    p = model.probability(np.ones((2, 3)))
    assert np.isfinite(p).all() and len(set(p)) == 1


def test_isotonic_is_monotone_and_calibrated():
    rng = np.random.default_rng(6)
    s = rng.normal(size=3000)
    y = (rng.random(3000) < 1 / (1 + np.exp(-3 * s))).astype(int)
    fitted = boosting.fit_isotonic(s, y)
    grid = fitted(np.linspace(-4, 4, 200))
    assert (np.diff(grid) >= 0).all() and abs(fitted(np.array([0.0]))[0] - 0.5) < 0.15
    assert fitted(s).mean() == pytest.approx(y.mean(), abs=0.02)


def test_held_out_quality_and_toxicity(spark):
    import __spark_entry__ as entry
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for key, label, least in (("op2_quality", "quality", 0.97), ("op7_toxicity", "toxic", 0.85)):
        got = entry.queries()[key](spark, SF)
        assert got.count() == 1000 and got.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
        right = got.join(labels, "doc_id").where("held_out").agg(F.avg((F.col("predicted") == F.col(label)).cast("int"))).first()[0]
        assert right >= least, (key, right)
        assert got.where(F.col("held_out") != (crc_bucket("doc_id", 4) == 2)).count() == 0


def test_held_out_language(spark):
    import __spark_entry__ as entry
    got = entry.queries()["op3_language"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


def test_classifiers_on_odd_rows(spark, odd_docs, no_docs, labels):
    for module in (quality, toxicity):
        model = module.train(odd_docs, labels, F.lit(True))
        got = module.score(wide(odd_docs), model)
        assert got.count() == odd_docs.count() and got.where("score IS NULL OR score < 0 OR score > 1").count() == 0
        assert set(got.columns) == set(wide(odd_docs).columns)
        assert module.score(no_docs, module.train(no_docs, labels.limit(0), F.lit(True))).count() == 0
        same = got.where("text IS NULL OR text = ''").select("score").distinct()
        assert same.count() == 1


def test_language_on_odd_rows(spark, odd_docs, no_docs):
    model = langid.train(odd_docs, F.lit(True))
    got = langid.predict(wide(odd_docs), model).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        if r["text"] is None or not any(c.isalpha() for c in r["text"]):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in ("de", "en") and 0 < r["score"] <= 1
    nothing = langid.train(no_docs, F.lit(True))
    assert langid.predict(no_docs, nothing).count() == 0
    assert {r["lang_pred"] for r in langid.predict(odd_docs, nothing).collect()} == {"und"}


def test_network_tables_equal_the_filters():
    rng = np.random.default_rng(8)
    windows = rng.integers(0, 256, (5, langid.WINDOW)).astype(np.uint8)
    total = len(langid.WIDTHS) * langid.FILTERS
    model = langid.ByteNetwork(["a", "b"], rng.normal(size=(256, 6)), [rng.normal(size=(w, 6, langid.FILTERS)) for w in langid.WIDTHS], rng.normal(size=total),
                               rng.normal(size=(total, 2)), np.zeros(2))
    hidden = []
    for width, filters in zip(langid.WIDTHS, model.filters, strict=True):
        e = model.embedding[windows]
        answers = np.stack([np.einsum("bwe,wef->bf", e[:, i:i + width], filters) for i in range(langid.WINDOW - width + 1)])
        hidden.append(answers.max(axis=0))
    logits = np.maximum(np.concatenate(hidden, axis=1) + model.bias, 0) @ model.out
    want = logits - np.log(np.exp(logits - logits.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)) - logits.max(axis=1, keepdims=True)
    assert np.allclose(model.log_probabilities(windows), want, atol=1e-3)


def test_windows_cover_all_bytes():
    for n in (0, 1, 255, 256, 257, 5000):
        data = bytes(i % 251 for i in range(n))
        assert langid.windows_of(data).tobytes()[:n] == data


def test_obfuscation_and_address_count():
    lexicon = toxicity.Lexicon(frozenset({b"idiot"}), frozenset({b"vequ"}))
    plain, hidden = lexicon.features("you are an idiot"), lexicon.features("you are an 1d.i0t")
    assert plain[1] == 1 and plain[8] == 1 and hidden[1] == 0 and hidden[6] == 1
    assert lexicon.features("le vequoir est")[1] == 1 and lexicon.features("le vequoir est")[3] == 0


def test_sample_is_bounded_for_a_repeated_key(spark, labels):
    rows = [(1, f"text {i % 300}") for i in range(900)] + [(i, f"own {i}") for i in range(2, 10)] + [(1, None), (1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sample = [tuple(r) for r in quality.labelled_documents(docs, labels, "quality", F.lit(True), 50).collect()]
    assert len(sample) == len(set(sample)) == 50
    every = [tuple(r) for r in quality.labelled_documents(docs, labels, "quality", F.lit(True), 1000).collect()]
    want = {(k, int(k % 3 > 0), t) for k, t in rows}
    assert len(every) == len(want) and set(every) == want and set(sample) <= want


def samples_of(spark, rows, labels, bound, parts=3):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    return sorted(tuple(r) for r in quality.labelled_documents(docs, marks, "quality", F.lit(True), bound).collect())


def test_labels_that_repeat_or_have_no_document(spark):
    rows = [(i, f"text {i}") for i in range(1000)]
    once = [(i, i % 2) for i in range(1000)]
    want = samples_of(spark, rows, once, 300)
    assert len(want) == 300 and len({k for k, _, _ in want}) == 300
    assert samples_of(spark, rows, once + [(922, 0)] * 20_000, 300, parts=5) == want
    assert samples_of(spark, rows, once + [(i, 1) for i in range(1000, 100_000)], 300) == want


def test_language_sample_with_a_hot_key(spark):
    """One key holds most rows: the sample holds the other languages as well, and is the same however the rows are dealt."""
    from tidewatch.llm.common import distinct_sample
    rows = [(7, "de", f"der text nummer {i % 50}") for i in range(9000)] + [(i, ("en", "fr", "es")[i % 3], f"one text {i}") for i in range(100, 1100)]
    frame = spark.createDataFrame(rows, "key long, lang string, text string")
    got = [sorted(tuple(r) for r in distinct_sample(frame.repartition(n), 300).collect()) for n in (1, 4)]
    assert got[0] == got[1] and len(got[0]) == 300 == len(set(got[0]))
    assert {lang for _, lang, _ in got[0]} == {"de", "en", "fr", "es"} and sum(lang == "de" for _, lang, _ in got[0]) <= 50
    docs = frame.withColumnRenamed("key", "doc_id")
    models = [langid.train(docs.repartition(n), F.lit(True), bound=200) for n in (1, 4)]
    assert models[0].languages == models[1].languages == ["de", "en", "es", "fr"]
    assert all(np.array_equal(a, b) for a, b in zip(models[0].filters, models[1].filters, strict=True))
