import hashlib

import pytest
from pyspark.sql import functions as F

from trustmill.llm import fingerprint as fp


def vectors(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    return {r.i: r for r in fp.fingerprints(rows, ["i"], "t").select("i", "v", fp.to_text(F.col("v")).alias("f")).collect()}


def test_order_and_multiplicity(spark):
    got = vectors(spark, ["a b\nc d\ne", "e\na b\nc d", "a b\nc d\ne\ne", "a b c d\ne", "", None, " ", "\n"])
    assert got[0].f == got[1].f and len({got[i].f for i in (0, 2, 3, 4, 6, 7)}) == 6
    assert got[4].f == got[5].f == "0" * len(got[0].f)


def test_insertion_and_deletion(spark):
    got = vectors(spark, ["one two three\nfour five", "six seven\nfour five", "one two three\nfour five\nsix seven\nfour five"])
    rows = spark.createDataFrame([(got[0].v, got[1].v, got[2].v)], "a array<bigint>, b array<bigint>, c array<bigint>")
    r = rows.select(fp.add(F.col("a"), F.col("b")).alias("s"), fp.subtract(F.col("c"), F.col("b")).alias("d")).first()
    assert r.s == got[2].v and r.d == got[0].v


@pytest.mark.parametrize("per_range", [2, 1000])
def test_versions(spark, monkeypatch, per_range):
    monkeypatch.setattr(fp, "RANGE", per_range)
    texts = {1: "The first text of them all, with some words.", 5: "Ein zweiter Text, etwas länger als der erste davon.", 7: "", 9: None, 40: "x", 41: "words\n" * 50, 90: "The first text of them all, with some words."}
    rows = spark.createDataFrame([(i, t, 0) for i, t in texts.items()], "doc_id long, text string, v int").repartition(3)
    got = {r.doc_id: r for r in fp.fingerprint_versions(rows).select("*", fp.likeness(F.col("v"), F.col("e")).alias("near")).collect()}
    ids = sorted(texts)
    assert sorted(got) == ids
    for i, nxt in zip(ids, ids[1:] + ids[:1], strict=True):
        own, then = texts[i] or "", texts[nxt] or ""
        cut = len(own) // 4
        edited = own[: len(own) - cut] + then[:cut]
        assert got[i].n_chars == len(own) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].w == got[nxt].v and 0 <= got[i].near <= 1
        if edited == own:
            assert got[i].near == 1.0
    assert got[1].v == got[90].v


def test_repeated_ids_and_empty(spark):
    rows = spark.createDataFrame([(1, "b"), (1, "a"), (None, "n"), (1, "a")], "doc_id long, text string")
    assert len(fp.fingerprint_versions(rows).collect()) == 4
    assert fp.fingerprint_versions(rows.limit(0)).count() == 0


@pytest.mark.parametrize("per_range", [2, 1000])
def test_repeated_rows_follow_in_order_of_text(spark, monkeypatch, per_range):
    monkeypatch.setattr(fp, "RANGE", per_range)
    held = [(1, "b b b b"), (1, "a a a a"), (None, "n n n n"), (1, "a a a a"), (2, None), (2, "b b b b"), (0, "zero at all")]
    order = sorted(((i is not None, i or 0, t or "") for i, t in held))
    want = []
    for (_, _, own), (_, _, then) in zip(order, order[1:] + order[:1], strict=True):
        cut = len(own) // 4
        want.append((own, then, own[: len(own) - cut] + then[:cut]))
    texts = sorted({own for own, _, _ in want})
    found = vectors(spark, texts)
    of = {t: found[i].v for i, t in enumerate(texts)}
    # Dealt out anew at each read, with columns that clash with the operator's own.
    rows = spark.createDataFrame([(i, t, 1, 2) for i, t in held], "doc_id long, text string, next_id int, __place int").repartition(5, F.rand())
    got = fp.fingerprint_versions(rows).collect()
    assert sorted((r.v, r.w, r.edited_sha256) for r in got) == sorted((of[own], of[then], hashlib.sha256(e.encode()).hexdigest()) for own, then, e in want)


def test_very_long_text(spark):
    long = "word " * 300_000 + "\nlast line"
    rows = spark.createDataFrame([(1, long), (2, "last line\n" + "word " * 300_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in fp.fingerprint_versions(rows).collect()}
    assert got[1].n_chars == len(long) and got[1].v == got[2].v == got[1].w
