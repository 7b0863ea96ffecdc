import numpy as np
import pytest
from pyspark.sql import functions as F

from trustmill.llm import common, langid

WORDS = {"en": "the of and to in is that for with this from have".split(), "de": "der die und das nicht ein ist mit für auf über".split(), "fr": "le de et la les des est dans que une où être".split()}


def text(lang, i, n=30):
    rng = np.random.default_rng(i)
    return " ".join(rng.choice(WORDS[lang], n))


@pytest.fixture(scope="module")
def network(spark):
    rows = [(i, text(lang, i), lang) for i, lang in enumerate(list(WORDS) * 60)] + [(1000, None, "en"), (1001, "the of and", None)]
    return langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_gradients():
    rng = np.random.default_rng(0)
    net = langid.Network(["a", "b"], seed=1)
    x, y = rng.integers(1, 255, (6, langid.WINDOW)).astype(np.uint8), np.array([0, 1, 0, 1, 1, 0])
    loss = lambda: -net.log_probabilities(x)[np.arange(6), y].mean(dtype=np.float64)
    for p, g in zip(net.parameters(), net.gradients(x, y), strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        held, step = p[at], 1e-2
        p[at] = held + step
        up = loss()
        p[at] = held - step
        down = loss()
        p[at] = held
        assert (up - down) / (2 * step) == pytest.approx(g[at], rel=0.1, abs=2e-3)


def test_held_out_accuracy_and_cases(spark, network):
    rows = [(i, text(lang, 5000 + i), lang, "s") for i, lang in enumerate(list(WORDS) * 30)] + [(900, None, "en", "s"), (901, "", "en", "s"), (902, "12 34 !?", "en", "s"), (903, "the " * 60000, "en", "s"), (0, text("en", 5000), "en", "s")]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, score string"), network).collect()
    assert len(got) == len(rows) and sum(r.lang == r.lang_pred for r in got if r.doc_id < 900) >= 88
    by = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert by[900] == by[901] == by[902] == ("und", 0.0) and by[903][0] == "en" and all(0 <= r.score <= 1 for r in got)


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "words", None)], "doc_id long, text string, lang string")
    assert langid.identify(docs, langid.train(docs)).first().lang_pred == "und"
    assert langid.train(docs.limit(0)).labels == []


def test_every_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_DOCS", 140)
    rows = [(i, text("en", i, 200), f"l{i % 70:02}") for i in range(2100)]
    drawn = []
    monkeypatch.setattr(langid.Network, "fit", lambda self, x, y: drawn.append((x, y)) or self)
    net = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    x, y = drawn[0]
    assert len(net.labels) == 70 and x.shape == (len(y), langid.WINDOW)
    # Two documents of a language on average, each of TRAIN_WINDOWS windows at most.
    assert len(set(y.tolist())) > 50 and len(y) <= 2 * 140 * langid.TRAIN_WINDOWS


def test_empty_table(spark, network):
    docs = spark.createDataFrame([], "doc_id long, text string, Score double")
    got = langid.identify(docs, network)
    assert got.columns == ["doc_id", "text", "lang_pred", "score"] and got.count() == 0


def test_fold(spark):
    import zlib

    got = spark.range(200).select("id", common.training_fold(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)
