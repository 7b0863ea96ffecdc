import hashlib
import random

import pytest

tiktoken = pytest.importorskip("tiktoken")

from trustmill.llm import bpe  # noqa: E402


@pytest.fixture(scope="module")
def both():
    path, pattern = bpe.default_vocabulary(), bpe.default_pattern()
    return bpe.codec(path, pattern), tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})


def test_random_texts(both):
    ours, theirs = both
    rng, letters = random.Random(5), "ab'sté \u0085\x1c\x1f \n\t1²3½ªµ.-日٣ⅷ😀"
    for size in [*range(40)] * 5 + [3000]:
        text = "".join(rng.choice(letters) for _ in range(size))
        assert ",".join(w[0] for w in ours.encode(text)) == ",".join(map(str, theirs.encode_ordinary(text)))


def test_long_words_take_the_heap(both):
    ours, theirs = both
    rng = random.Random(6)
    for word in ("a" * 3000, "".join(rng.choice("etaoin") for _ in range(2000))):
        assert bpe.fold(word.encode(), ours.ranks) == theirs.encode_ordinary(word)


def test_folding_at_once_is_folding_alone(both):
    ours, _ = both
    rng = random.Random(7)
    words = list({"".join(rng.choice("the quickbrwnfxé") for _ in range(rng.randint(1, 40))).encode() for _ in range(500)})
    assert ours.fold_all(words) == [bpe.fold(w, ours.ranks) for w in words]


def test_small_table_forgets_but_stays_right(both, monkeypatch):
    ours, theirs = both
    monkeypatch.setattr(bpe, "MEMO", 20)
    rng = random.Random(8)
    texts = [" ".join(rng.choice("the of and sto rin gre ate".split()) + rng.choice("abc") for _ in range(15)) for _ in range(60)]
    for k in range(0, 60, 4):
        for text, words in zip(texts[k : k + 4], ours.encode_all(texts[k : k + 4]), strict=True):
            assert ",".join(w[0] for w in words) == ",".join(map(str, theirs.encode_ordinary(text)))


def test_table_of_long_words_is_bounded(both):
    ours, _ = both
    rng = random.Random(9)
    for _ in range(32):
        ours.learn({"".join(rng.choices("etaoin", k=3000)) for _ in range(100)})
    held = [*ours.memo, *ours.old]
    assert sum(map(len, held)) < 2 * (bpe.MEMO_CHARS + 300_000) and len(held) <= 2 * (bpe.MEMO + 100)


def test_higher_order_functions_fold_alike(spark, both):
    ours, _ = both
    small = {p: r for p, r in ours.ranks.items() if r < 700}
    words = ["", "a", " the", "thethe", " reading", "été", "xqz zzz"]
    got = {r.word: r.ids for r in bpe.fold_words(spark.createDataFrame([(w,) for w in words], "word string"), small).collect()}
    assert got == {w: bpe.fold(w.encode(), small) if w else [] for w in words}


def test_frame(spark, both):
    _, theirs = both
    texts = [None, "", "Hello world", "Hello world", "<|endoftext|> x" * 300]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    rows = bpe.encode_decode(docs, keep_ids=True).orderBy("doc_id").collect()
    assert len(rows) == 5
    for row, text in zip(rows, texts, strict=True):
        ids = theirs.encode_ordinary(text or "")
        assert row.ids == ids and row.n_tokens == len(ids) and bytes(row.decoded) == (text or "").encode()
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.encode_decode(docs.limit(0)).count() == 0
