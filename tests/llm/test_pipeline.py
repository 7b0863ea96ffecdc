import os

import pytest

import corpus_pipeline
from trustmill.llm import common

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    en, fr = "the of and to in is that for with this from have".split(), "le de et la les des est dans que une où être".split()
    import random

    rng = random.Random(1)
    say = lambda w, n=40: " ".join(rng.choice(w) + str(rng.randint(0, 30)) * (rng.random() < 0.5) for _ in range(n))
    leak = "alpha bravo charlie delta echo foxtrot golf hotel india juliet"
    rows = [(i, say(en if i % 2 else fr), "en" if i % 2 else "fr", "s") for i in range(80)]
    rows += [(100, rows[1][1], "en", "s"), (101, rows[3][1] + " more", "en", "s"), (102, say(en) + " " + leak, "en", "s"), (103, say(en) + " write to me@home.org now", "en", "s"), (104, None, "en", "s"), (105, "12 34", "en", "s"), (5, rows[5][1], "en", "s")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = common.materialise(stage(spark, docs, str(tmp_path)), "t")
        if name != "byte_bpe":
            assert out.columns == docs.columns
            docs = out
        kept[name] = sorted(r.doc_id for r in out.select("doc_id").collect())
    assert kept["language_id"] == sorted([*range(80), 100, 101, 102, 103, 5])
    assert kept["near_dup"] == [*range(80), 102, 103] and kept["decontamination"] == [*range(80), 103]
    text = {r.doc_id: (r.text, r.n_chars) for r in docs.collect()}
    assert "<EMAIL>" in text[103][0] and text[103][1] == len(text[103][0]) and text[1][0] == rows[1][1]
    assert kept["byte_bpe"] == kept["pii"] == kept["decontamination"]


def test_odd_tables(spark, tmp_path):
    """Empty tables, no benchmark, null ids and texts, repeated rows that differ in other columns, a very long text, clashing names."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, class string, told string, score double, stay_id long"
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    long = " ".join(f"word{i}" for i in range(60000))
    rows = [(1, "a text of some words that is its own", "en", "s", 1, "c", "t", 0.5, 1), (1, "a text of some words that is its own", "en", "r", 1, "c", "t", 0.5, 1), (None, "no id but words write to a@b.org", None, "s", 1, "c", "t", 0.5, 1)]
    rows += [(2, None, "en", "s", 0, "c", "t", 0.5, 1), (3, "", "en", "s", 0, "c", "t", 0.5, 1), (4, long, "en", "s", len(long), "c", "t", 0.5, 1)]
    for table in (rows, rows[::-1], []):
        docs = spark.createDataFrame(table, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = common.materialise(stage(spark, docs, str(tmp_path)), "t")
            if name != "byte_bpe":
                assert out.columns == docs.columns
                docs = out
        held = {r.doc_id: r for r in docs.collect()}
        assert sorted(held, key=str) == ([1, 4, None] if table else [])
        if table:
            assert held[4].text == long and held[None].text.endswith("write to <EMAIL>") and held[1].source in "rs"
            seen = [held[1].source] if table is rows else [*seen, held[1].source]
    assert len(set(seen)) == 1


def test_stages_give_heap_back(spark, tmp_path):
    old = lambda: sum(b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    docs, before = spark.createDataFrame([(1, "text")], "doc_id long, text string"), old()
    corpus_pipeline.encode(spark, docs, str(tmp_path))
    assert old() > before


def test_scratch_tables_go(spark, tmp_path):
    spark.createDataFrame([(1, "one two three")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, f"text {i} of words {i} and more", "en", "s", 1) for i in range(30)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    before = set(os.listdir(common.shared_dir(spark)))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    assert {x.rsplit("-", 1)[0] for x in set(os.listdir(common.shared_dir(spark))) - before} == {f"stage-{n}" for n, _ in corpus_pipeline.STAGES[:-1]}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100
