import hashlib
import random
import re

from pyspark.sql import functions as F

from trustmill.llm import common, decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    cut = {}
    for item, text in items:
        w = split(text)
        for s in range(max(0, len(w) - 8) + 1 if w else 0):
            cut.setdefault(tuple(w[s : s + 8]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = split(text), set(), set()
        for n in {len(k) for k in cut}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in cut:
                    hit.update(range(s, s + n))
                    found |= cut[tuple(w[s : s + n])]
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(9)
    words = ["Alpha", "beta", "gamma", "été", "İx", "7up", "the", "the", "the", "of"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 8, 12, 20])))) for i in range(15)] + [(99, None), (100, "the the the the the the the the the the"), (2, "repeated id words of the of the of the")]
    docs = []
    for i in range(120):
        text = [rng.choice(words) for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.4:
            text += [rng.choice(items)[1] or ""] + text[:3]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(text)))
    docs += [(200, None), (201, ""), (202, "the " * 3000), (5, docs[5][1]), (5, "other words")]
    d, b = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, n_hit int"), spark.createDataFrame(items, "item_id long, text string")
    got = dc.decontaminate(d, b).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(docs, items)
    assert dc.decontaminate(d, b.limit(0)).where("n_hit > 0").count() == 0 and dc.decontaminate(d.limit(0), b).count() == 0


def test_proximity(spark):
    d = spark.createDataFrame([(1, "zeta two one three four five six seven eight nine"), (2, "one zeta")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "one two three zeta five six seven eight")], "item_id long, text string")
    tokens = dc.token_table(d, "text")
    windows = common.materialise(dc.item_windows(b, 8, "item_id", "text"), "w")
    assert dc.matches(tokens, windows).count() == 0
    rows = dc.matches(tokens, windows, share=0.8).join(tokens, "__row").select(F.col("c0").alias("doc_id")).distinct().collect()
    assert [r.doc_id for r in rows] == [1]


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(dc, "BROADCAST_ROWS", 0)
    docs, items = [(i, f"w{i} a b c d e f g h i") for i in range(20)], [(1, "a b c d e f g h"), (2, "b c d e f g h i")]
    got = dc.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.n_hit, r.n_items, r.contaminated) for r in got} == {(9, 2, True)}


def test_proximity_against_brute_force(spark, monkeypatch):
    """Enough different terms of a window in eight consecutive words; with terms that no document has, too."""
    rng = random.Random(4)
    words = list("abcdefghijkl")
    items = [(i, " ".join(rng.choice([*words, "unseen"]) for _ in range(rng.choice([1, 5, 8, 10])))) for i in range(8)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 50)))) for i in range(60)]
    docs += [(100, items[0][1].replace(items[0][1].split()[0], "changed")), (101, None)]
    expected = set()
    for item, text in items:
        w = split(text)
        for s in range(max(0, len(w) - 8) + 1):
            terms = set(w[s : s + 8])
            for doc, body in docs:
                d = split(body)
                if any(len(terms & set(d[p : p + 8])) >= 0.8 * len(terms) - 1e-9 for p in range(len(d))):
                    expected.add((doc, str(item)))
    assert expected
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for rows in (dc.BROADCAST_ROWS, 0):
        monkeypatch.setattr(dc, "BROADCAST_ROWS", rows)
        got = {r.doc_id: r for r in dc.decontaminate(d, b, share=0.8).collect()}
        for doc, _ in docs:
            found = sorted(i for x, i in expected if x == doc)
            assert (got[doc].n_items, got[doc].items_sha256) == (len(found), hashlib.sha256(",".join(found).encode()).hexdigest())
            assert got[doc].n_hit <= got[doc].n_words
