import os
import random

import numpy as np
import pytest

from trustmill.llm import common, graph, near_dup


def levenshtein(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return row[-1]


def test_distance():
    rng = random.Random(1)
    for _ in range(300):
        x = [rng.randint(0, 5) for _ in range(rng.randint(0, 30))]
        y = [rng.randint(0, 5) for _ in range(rng.randint(0, 30))]
        if rng.random() < 0.5:
            y = list(x)
            for _ in range(rng.randint(0, 5)):
                if y:
                    y[rng.randrange(len(y))] = rng.randint(0, 5)
        real = levenshtein(x, y)
        most = rng.randint(0, 12)
        assert near_dup.distance(np.array(x, np.uint32), np.array(y, np.uint32), most) == min(real, most + 1)
        size = max(len(x), len(y))
        assert near_dup.similar(np.array(x, np.uint32), np.array(y, np.uint32)) == (real <= int(0.2 * size + 1e-9))


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    passage, texts = say(25), []
    for _ in range(60):
        base = say(rng.randint(30, 120)) + (passage if rng.random() < 0.5 else [])
        texts.append(base)
        for _ in range(rng.choice([0, 0, 1, 4])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 40))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(copy)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rows += [(900, None), (901, ""), (902, "one two"), (903, "one two"), (904, "one  two"), (905, "one two three"), (3, rows[3][1]), (None, rows[3][1]), (906, " \n")]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    split = [(t or "").split() for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] or "") == (rows[j][1] or "") or (split[i] and split[i] == split[j]) or (split[i] and split[j] and abs(len(split[i]) - len(split[j])) <= 0.2 * max(len(split[i]), len(split[j])) and levenshtein(split[i], split[j]) <= 0.2 * max(len(split[i]), len(split[j]))):
                parent[root(i)] = root(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(root(i), []).append(r[0])
    want = sorted((str(m), min(x for x in g if x is not None), len(g)) for g in groups.values() for m in g)
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted((str(r.doc_id), r.class_id, r.class_size) for r in got) == want


def test_late_original(spark):
    """Versions that align with their original, but not with each other, and come before it, are one class."""
    rng = random.Random(3)
    fresh = iter(range(10**6))
    say = lambda n: [f"w{next(fresh)}" for _ in range(n)]
    original = say(600)
    texts = []
    for i in range(12):
        at = 20 + 45 * i
        texts.append(original[:at] + say(rng.randint(121, 143)) + original[at:])
    ids = [np.array([hash(w) & 0xFFFFFFFF for w in t], np.uint32) for t in (texts[0], texts[6], original)]
    assert near_dup.similar(ids[0], ids[2]) and near_dup.similar(ids[1], ids[2]) and not near_dup.similar(ids[0], ids[1])
    rows = [(i, " ".join(t)) for i, t in enumerate([*texts, original])]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert sorted((r.class_id, r.class_size) for r in got) == [(0, 13)] * 13


def test_many_classes_in_a_bucket(spark):
    """Near copies among many texts that are unlike but for a boilerplate, which alone has shingles in common with them."""
    rng = random.Random(5)
    fresh = iter(range(10**6))
    say = lambda n: [f"w{next(fresh)}" for _ in range(n)]
    shared = say(300)
    own = [say(100) for _ in range(40)]
    copies = [[w if k % 5 else f"x{rng.random()}" for k, w in enumerate(x)] for x in own[30:]]
    rows = [(i, " ".join(shared + x)) for i, x in enumerate(own + copies)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert sorted((r.class_id, r.class_size) for r in got) == sorted([(i, 1) for i in range(30)] + [(i, 2) for i in range(30, 40)] * 2)


def test_short_texts(spark):
    """Texts to which one edit is allowed are compared exactly, however few shingles they have."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(40)]
    texts = []
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(1, 9))]
        texts.append(base)
        if rng.random() < 0.7:
            copy, at = list(base), rng.randrange(len(base))
            kind = rng.randrange(3)
            copy[at : at + (kind != 2)] = [] if kind == 1 else ["new"]
            texts.append(copy)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts) if len(t) <= 9]
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in rows:
        for k, y in rows:
            if i < k and levenshtein(x.split(), y.split()) <= int(0.2 * max(len(x.split()), len(y.split())) + 1e-9):
                parent[max(root(i), root(k))] = min(root(i), root(k))
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == {i: root(i) for i in parent}


def test_very_long_texts_and_clashing_columns(spark):
    rng = random.Random(10)
    long = [f"w{rng.randrange(5000)}" for _ in range(30000)]
    copy = list(long)
    for _ in range(300):
        copy[rng.randrange(len(copy))] = "x"
    rows = [(1, " ".join(long), 7, "k"), (2, " ".join(copy), 7, "k"), (3, " ".join(reversed(long)), 7, "k"), (4, None, 7, "k")]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, class_id long, node string")).collect()
    assert {r.doc_id: (r.class_id, r.class_size) for r in got} == {1: (1, 2), 2: (1, 2), 3: (3, 1), 4: (4, 1)}


def test_scratch_tables_go(spark):
    folder = common.shared_dir(spark)
    before = set(os.listdir(folder))
    got = near_dup.near_duplicates(spark.createDataFrame([(1, "a b c d e f g h"), (2, "a b c d e f g x")], "doc_id long, text string"))
    left = set(os.listdir(folder)) - before
    assert len(left) == 1 and next(iter(left)).startswith("near_duplicates-")
    assert {r.class_size for r in got.collect()} == {2}


def test_empty(spark):
    assert near_dup.near_duplicates(spark.createDataFrame([], "doc_id long, text string, class_id int")).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 120)] + [(200, 200), (300, 301), (301, 300)]
    got = {r[0]: r[1] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{x: 100 for x in range(100, 120)}, 300: 300, 301: 300}
