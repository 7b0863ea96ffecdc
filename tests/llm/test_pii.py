import math
import random
import re

from pyspark.sql import functions as F

from trustmill.llm import pii

KINDS = list(pii.KINDS)
DOCUMENTED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def expected(text):
    out = []
    for n, (kind, pattern) in enumerate(DOCUMENTED.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (kind == "card" and 14 <= len(digits) <= 19 and luhn(digits)) or (kind == "phone" and 10 <= len(digits) <= 15):
                out.append((m.start(), n, m.end()))
    return sorted(out)


def test_base_spans(spark):
    rng = random.Random(4)
    texts = [None, "", "a@b.c_d@e.f.g", "é 4111 1111 1111 1111 x", "1.2.3.4.5.6.7.8 000.00.0256.1 256.1.1.1 00255.0.0.0", "+1 (555) 123-4567 or +49.30.1234567", "x" * 5000 + "@", "1" * 20000, "1 " * 20000, "😀 a.b-c@d-e.fg 😀 10.0.0.1"]
    for _ in range(300):
        texts.append("".join(rng.choice("ab@@..  --++()0123456789é") for _ in range(rng.randint(1, 60))))
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = {r.i: [(s.start, s.kind, s.end) for s in r.b] for r in rows.select("i", pii.base_spans(F.coalesce("t", F.lit(""))).alias("b")).collect()}
    for i, text in enumerate(texts):
        assert got[i] == expected(text), text


def test_disclosing_terms(spark):
    rows = [(i, f"Filler number {i} of many. Write to our Zanzibar office at head@corp.com about case {i}.", "s") for i in range(4)]
    rows += [(10 + i, f"Plain text {i} about the office and nothing else.", "s") for i in range(60)]
    rows += [(100, "Zanzibar is far from head@other.org", "s"), (101, None, "s"), (102, "", "s"), (0, rows[0][1], "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    found = {r.doc_id: [(s.start, s.kind, s.end) for s in r.spans] for r in pii.find(docs, support=3, disclosure=0.8).select("doc_id", "spans").collect()}
    terms = {rows[0][1][a:b] for a, k, b in found[0] if k == 4}
    assert "Zanzibar" in terms and "office" not in terms
    assert [k for _, k, _ in found[100]] == [0] and found[101] == found[102] == [] and len(found) == 67
    clean = {r.doc_id: r.text for r in pii.sanitise(docs, support=3, disclosure=0.8).collect()}
    assert "Zanzibar" not in clean[0] and "<EMAIL>" in clean[0] and "office" in clean[0]
    assert clean[10] == rows[4][1] and clean[101] is None and clean[102] == ""


def test_terms_far_from_their_entity(spark):
    """A term goes wherever it stands in a text of its entity, and counts however far from it."""
    far = "and so on with many more words of no weight"
    rows = [(i, f"Zanzibar case {i} {far}, write to head@corp.com. We, {far}, heard: zanzibar replied {i}") for i in range(4)]
    rows += [(4, f"We met {far} head@corp.com. Zanzibar {far} Zanzibar")]
    rows += [(10 + i, f"Plain text {i} {far}, write to us. We heard, case replied") for i in range(60)]
    rows += [(100, "Zanzibar is far from head@other.org")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert all("zanzibar" not in clean[i].lower() and "<EMAIL>" in clean[i] and far in clean[i] for i in range(5))
    assert clean[100] == "Zanzibar is far from <EMAIL>" and clean[10] == rows[5][1]
    found = {r.doc_id: {rows[r.doc_id][1][s.start : s.end] for s in r.spans if s.kind == 4} for r in pii.find(docs).where("doc_id < 5").collect()}
    assert all(found[i] >= {"Zanzibar"} for i in range(5)) and "zanzibar" in found[0]


WORD = re.compile(r"[^\W]+")


def brute(rows, support, disclosure):
    """Spans of disclosing terms of each row, from the definition."""
    def found(text):
        return [(KINDS[k], text[a:b], a, b) for a, k, b in expected(text)]

    def entities(text):
        out = set()
        for kind, value, _, _ in found(text):
            v, digits = value.lower(), re.sub("[^0-9]", "", value)
            out |= {(kind, v), (kind + " group", {"email": v.split("@")[-1], "ip": ".".join(v.split(".")[:2]), "card": digits[:6], "phone": digits[:5]}[kind])}
        return out

    def masked(text):
        for _, _, a, b in found(text):
            text = text[:a] + " " * (b - a) + text[b:]
        return text

    texts = {r[1] or "" for r in rows}
    held = {t: entities(t) for t in texts}
    words = {t: {w.lower() for w in WORD.findall(masked(t))} for t in texts}
    plain = {t: {w.lower() for w in WORD.findall(t)} for t in texts}
    told = {}
    for e in set().union(*held.values()):
        own = [t for t in texts if e in held[t]]
        if len(own) < len(texts):
            for w in set().union(*(words[t] for t in own)):
                both = sum(w in words[t] for t in own)
                n_t = max(sum(w in words[t] for t in texts if held[t]), sum(w in plain[t] for t in texts))
                if both >= support and math.log2(len(texts) * both / (n_t * len(own))) >= disclosure * math.log2(len(texts) / len(own)) - 1e-12:
                    told.setdefault(e, set()).add(w)
    out = {}
    for i, text in [(r[0], r[1] or "") for r in rows]:
        some = set().union(*(told.get(e, set()) for e in held[text]), set())
        out[i] = sorted((m.start(), m.end()) for m in WORD.finditer(masked(text)) if m[0].lower() in some)
    return out


def test_term_spans_against_brute_force(spark):
    rng = random.Random(12)
    common_words = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(120):
        words = [rng.choice(common_words) for _ in range(rng.randint(1, 25))]
        kind = rng.randrange(6)
        if kind < 2:
            words[rng.randrange(len(words))] = f"{rng.choice('abc')}@{rng.choice(['one.org', 'two.org', 'three.org'])}"
            words += rng.sample(["Étoile", "harbour", "quay"], kind + 1)
        if kind == 2:
            words += [f"10.{rng.randrange(3)}.0.{rng.randrange(3)}", f"site{rng.randrange(4)}"]
        if kind == 3:
            words += ["+49 30 1234567" + str(rng.randrange(3)), "berlin", "4111 1111 1111 1111"]
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
    rows += [(200, rows[0][1]), (201, None), (202, ""), (203, "a@one.org")]
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "doc_id long, text string, found int, row int, body int, told int")
    got = {r.doc_id: sorted((s.start, s.end) for s in r.spans if s.kind == 4) for r in pii.find(docs).collect()}
    want = brute(rows, pii.SUPPORT, pii.DISCLOSURE)
    assert got == want and sum(map(bool, want.values())) > 10


def test_counts_in_sql(spark):
    """The counts behind the estimate, against plain SQL over words."""
    rows = [(i, f"case {i % 7} of x{i % 3} at u{i % 4}@host{i % 2}.org") for i in range(40)] + [(100 + i, f"case {i % 7} of x{i % 3}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("text as body")
    held = docs.withColumn("found", pii.base_spans(F.col("body"))).withColumn("digest", F.md5("body"))
    got, total = pii.counts(docs, held, 2, 0.0)
    docs.createOrReplaceTempView("texts")
    want = spark.sql(r"""
        WITH d AS (SELECT DISTINCT body FROM texts), w AS (SELECT DISTINCT body, explode(split(regexp_replace(body, ' at \\S+', ' at'), ' ')) AS term FROM d),
        e AS (SELECT body, regexp_extract(body, '@(\\S+)', 1) AS host FROM d WHERE body LIKE '%@%'),
        b AS (SELECT host, term, count(*) AS both FROM e JOIN w USING (body) GROUP BY host, term HAVING count(*) >= 2),
        n AS (SELECT host, count(*) AS n_entity FROM e GROUP BY host), t AS (SELECT term, count(*) AS n_term FROM w GROUP BY term)
        SELECT * FROM b JOIN n USING (host) JOIN t USING (term)""").collect()
    assert total == spark.sql("SELECT count(DISTINCT body) FROM texts").first()[0] and want
    hosts = {x: F.xxhash64(F.lit(4), F.lit(x)) for x in {r.host for r in want}}
    keys = {x: spark.range(1).select(c).first()[0] for x, c in hosts.items()}
    have = {(r.entity, r.term): (r.both, r.n_entity, r.n_term) for r in got.collect()}
    assert all(have[keys[r.host], r.term] == (r.both, r.n_entity, r.n_term) for r in want)


def test_overlapping_spans(spark):
    row = spark.createDataFrame([("ab 4111111111111111.1.2.3 and x",)], "t string")
    body = F.col("t")
    spans = "array(named_struct('start', 3, 'kind', 2, 'end', 19), named_struct('start', 10, 'kind', 1, 'end', 25), named_struct('start', 26, 'kind', 4, 'end', 29))"
    assert row.select(pii.sanitised(body, F.expr(spans))).first()[0] == "ab <CARD>  x"
    assert row.select(pii._masked(body, F.expr(spans))).first()[0] == "ab" + " " * 28 + "x"


def test_empty(spark):
    assert pii.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0
