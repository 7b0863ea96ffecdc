import random

from trustmill.llm import toxicity


def test_folding_and_exceptions():
    lex = toxicity.Lexicon({toxicity.fold("idiot"): 5.0, "scum": 4.0}, [toxicity.fold("scumble")], (-3.0, 2.0, 1.0))
    for text in ("You IDIOT", "you 1d10t", "you іdiоt", "an id​iot here", "idiots!"):
        assert len(lex.hits(toxicity.fold(text))) == 1, text
    assert lex.hits(toxicity.fold("they scumble the paint, dyscum")) == []
    assert lex.score("an idiot") > 0.3 > lex.score("a fine day") and lex.score(None) == lex.score("")
    assert lex.score("idiot " + "fine " * 3000) < lex.score("idiot " + "fine " * 10)


def test_learns_and_generalises(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    docs, labels = [], []
    for i in range(800):
        text, bad = [rng.choice(words) for _ in range(40)], i % 8 == 0
        if bad:
            text[rng.randrange(40)] = rng.choice(["grobble", "Grobbles", "zumpf", "zumpfing"])
        docs.append((i, " ".join(text), 0.0))
        labels.append((i, int(bad)))
    docs += [(900, None, 0.0), (901, "", 0.0), (902, "grobble " * 20000, 0.0), (0, docs[0][1], 0.0)]
    d, y = spark.createDataFrame(docs, "doc_id long, text string, score double"), spark.createDataFrame(labels + [(900, None)], "doc_id long, toxic int")
    lex = toxicity.train(d, y)
    got = {r.doc_id: r for r in toxicity.score(d, lex).collect()}
    truth = dict(labels)
    assert sum(got[i].predicted == truth[i] for i in range(800)) >= 790
    assert got[902].predicted == 1 and got[900].predicted == got[901].predicted == 0 and all(0 <= r.score <= 1 for r in got.values())


def test_no_labels(spark):
    d = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    y = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(d, toxicity.train(d, y)).first().score == 0.0
