import hashlib
import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from trustmill.llm import common, repeats


def brute(rows):
    """By definition: the least id in which each string of SPAN bytes starts."""
    span, first = repeats.SPAN, {}
    raw = [(i, (t or "").encode()) for i, t in rows]
    big = 1 << 70
    for i, t in raw:
        for k in range(len(t) - span + 1):
            w = t[k : k + span]
            first[w] = min(first.get(w, big), big - 1 if i is None else i)
    out = []
    for i, t in raw:
        gone = bytearray(len(t))
        for k in range(len(t) - span + 1):
            if first[t[k : k + span]] < (big - 1 if i is None else i):
                gone[k : k + span] = b"\1" * span
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        runs = sum(1 for k in range(len(t)) if gone[k] and (not k or not gone[k - 1]))
        out.append((i, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=str)


def made(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("etaoinshé") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    say = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [say(rng.randint(8, 40)) for _ in range(6)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.2 and rows:
            text = rows[rng.randrange(len(rows))][1]
            if text and kind < 0.12:
                k = rng.randrange(len(text))
                text = text[:k] + rng.choice("xyz") + text[k + rng.randint(0, 3) :]
        elif kind < 0.6:
            text = say(rng.randint(0, 20)) + " " + rng.choice(shared) + " " + say(rng.randint(0, 20))
        else:
            text = say(rng.randint(0, 60))
        rows.append((i, text))
    rows += [(n, None), (n + 1, ""), (n + 2, "short"), (n + 3, "ab" * 200), (n + 4, "ab" * 100 + "c"), (5, rows[5][1]), (5, "other text " * 9), (None, shared[0] * 2), (None, shared[0] * 2)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,hot,chunk", [(1, 48, 2 << 20), (2, 2, 1 << 12), (3, 0, 1 << 8)])
def test_against_brute_force(spark, seed, hot, chunk):
    rows = made(seed, 150)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted([tuple(r[:5]) + (bytes(r[5]),) for r in repeats.remove_repeats(docs, keep=True, hot=hot, chunk=chunk).collect()], key=str)
    assert got == brute(rows)


def test_a_string_across_two_copied_passages_is_a_source(spark):
    """Copied passages overlap in a text: strings across both start there first, though all of its bytes go."""
    rng, rows = random.Random(7), []
    say = lambda k: "".join(rng.choices("etaoin shrdlu", k=k))
    for i in range(0, 160, 4):
        x, y, z = say(150), say(30 + i % 19), say(150)
        rows += [(i, x + y + say(40)), (i + 1, say(40) + y + z), (i + 2, x + y + z), (i + 3, say(60) + x[len(y) - 49 :] + y + z[: 49 - len(y)] + say(60))]
    for hot in (repeats.HOT, 0):
        got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), keep=True, hot=hot).collect()
        assert sorted([tuple(r[:5]) + (bytes(r[5]),) for r in got], key=str) == brute(rows)


def test_empty(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string, spans int")).count() == 0


def test_slices_and_buckets_by_bytes(spark):
    """Small slices, and more buckets than shuffle partitions, give the same rows."""
    rows = made(4, 60)
    out = {}
    for kind, most in (("few", 16), ("all", 1 << 40)):
        batch = pa.RecordBatch.from_arrays([pa.array([1 << 60 if r[0] is None else r[0] for r in rows]), pa.array(range(len(rows))), pa.array([r[1] for r in rows])], names=["id", "key", "text"])
        held = [(0, *(x.as_py() for x in (b.column(c)[i] for c in ("docs", "places", "body")))) for b in repeats.map_anchors(1, 1 << 12, 2)(iter([batch])) for i in range(len(b)) if b.column("bucket")[i].is_valid]
        out[kind] = [found(b) for b in repeats.settle_anchors(held, 1 << 12, most)]
    assert out["few"] == out["all"] and out["all"][0]
    left = {r["key"]: (r["spans"], r["open"]) for b in repeats.settle_anchors(held, 1 << 12) for r in b.to_pylist()}
    lists = [pa.array([[left[k][i]] if k in left else [] for k in range(len(rows))], pa.list_(pa.binary())) for i in (0, 1)]
    batch = pa.RecordBatch.from_arrays([*batch.columns, *lists], names=["id", "key", "text", "spans", "open"])
    held = [(0, *(x.as_py() for x in (b.column(c)[i] for c in ("docs", "places", "body")))) for b in repeats.map_suffixes(1, 1 << 12)(iter([batch])) for i in range(len(b)) if b.column("bucket")[i].is_valid]
    few, whole = ([found(b) for b in repeats.settle_suffixes(held, 1 << 12, most)] for most in (16, 1 << 40))
    assert few == whole and whole[0]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted([tuple(r[:5]) + (bytes(r[5]),) for r in repeats.remove_repeats(docs, keep=True, hot=2, bucket=500).collect()], key=str)
    assert got == brute(rows)


def found(batch):
    return sorted((r["id"], r["key"], sorted(np.frombuffer(r["spans"], np.int64).tolist()), sorted(np.frombuffer(r["open"], np.int64).tolist())) for r in batch.to_pylist())


def test_shuffle_files_go_with_the_first_round(spark):
    shuffles = lambda: {f.getName().split("_")[1] for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    docs, before = spark.createDataFrame(made(5, 40), "doc_id long, text string"), shuffles()
    setting = spark.conf.get(common.CLEANUP)
    out = repeats.remove_repeats(docs)
    for _ in range(40):  # they are deleted in the background
        if len(shuffles() - before) <= 1:  # that of the sum of bytes
            break
        time.sleep(0.25)
    assert len(shuffles() - before) <= 1 and spark.conf.get(common.CLEANUP) == setting
    assert out.count() == docs.count()


def test_memory_of_a_bucket_is_bounded():
    """Beside the packed rows, as many bytes for a bucket of 1.6 million anchors as for a slice."""
    rng, per, pack = np.random.default_rng(1), 4000, zstandard.ZstdCompressor(1).compress
    held = []
    for c in range(400):
        places, docs = np.zeros(per, repeats._ANCHOR), np.zeros(50, repeats._DOC)
        places["a"], places["x"], places["p"] = np.sort(rng.integers(0, 1 << 32, per)), rng.integers(0, 1 << 32, per), rng.integers(0, 1 << 16, per)
        docs["id"], docs["start"] = np.arange(50) + c * 50, np.arange(50) * 1000
        held.append((0, repeats._shrink(docs, pack), repeats._shrink(places, pack), None))
    tracemalloc.start()
    try:
        for _ in repeats.settle_anchors(held, repeats.CHUNK):
            pass
        assert tracemalloc.get_traced_memory()[1] < 100e6
    finally:
        tracemalloc.stop()


def test_memory_of_a_chunk():
    """Hashes of a chunk: three arrays of 8 bytes for each of its own, and what does not grow with it."""
    rng = random.Random(3)
    texts = ["".join(rng.choices("etaoin shrdlu", k=4000)).encode() for _ in range(500)]
    repeats._tables(10)
    tracemalloc.start()
    try:
        repeats.Chunk(list(range(500)), [0] * 500, [0] * 500, texts, [True] * 500, repeats.CHUNK)
        assert tracemalloc.get_traced_memory()[1] < 36 * 2_000_000
    finally:
        tracemalloc.stop()
