r"""Personal data, and information-theoretic sanitisation, in DataFrame operations only.

Entities are the personal data found by pattern (email, ip, card, phone), and what stands behind each of them: the mail domain, the
network (first two numbers of an ip), the card's issuer (first six digits), the phone's area (first five digits). How much a
term tells of an entity is estimated from co-occurrence in the corpus: a term that stands in SUPPORT different texts of an entity
at least, at any place outside the personal data itself, discloses it if their pointwise mutual information is DISCLOSURE or more of
the information that the entity itself carries:

    log2(N n(t, e) / (n(t) n(e))) >= DISCLOSURE * log2(N / n(e))

with n counting different texts, exactly. Such terms are spans, too (kind `term`), wherever they stand in a text that holds the entity.
sanitise() generalises spans of personal data to their kind (`<EMAIL>`) and removes terms.

Matches are found leftmost, not overlapping for a kind; a match that fails its check is dropped without a second try. Offsets
are code points, ends exclusive. Terms are runs of letters, digits and _, in lower case; personal data parts them.

Defined cases: null and empty texts have no spans; equal texts count once in the estimate but each row gets its spans;
a match of a kind may overlap one of another kind, sanitise() then covers their union and names the kind that starts first;
an empty table gives an empty table. Columns of docs that clash with results are replaced; any other names are free.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
#: Texts in which a term is with an entity; share of the entity's information that discloses.
SUPPORT, DISCLOSURE = 2, 0.8
#: A side of a join is broadcast up to so many rows (a term or an entity hash each).
BROADCAST_ROWS = 200_000
#: Fixed patterns. Possessive forms of the documented ones: what follows a repeat can never be taken from it, so matches are
#: the same, and no match backtracks or recurses. A local part starts where the last match ended, or behind no character of its own kind.
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap test that a text may hold a match.
HINTS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$")
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _located(text: Column, pattern: str) -> Column:
    """start, end, value of each match: lengths of the gaps between matches and of the matches, summed up."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    blank = F.lit(None).cast("array<struct<start:int,end:int,value:string>>")
    empty = F.struct(F.lit(0).alias("at"), F.coalesce(blank, F.array().cast("array<struct<start:int,end:int,value:string>>")).alias("out"))

    def step(state, x):
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["value"])
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")))).alias("out"))

    return F.aggregate(F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("value")), empty, step)["out"]


def _is(kind: str, m: Column) -> Column:
    return _valid(kind, m["value"])


def _span(i: int, m: Column) -> Column:
    return F.struct(m["start"].alias("start"), F.lit(i).alias("kind"), m["end"].alias("end"), m["value"].alias("value"))


def base_spans(text: Column) -> Column:
    """ARRAY<STRUCT<start, kind, end, value>> of the four kinds (kind as its number), sorted by start and kind."""
    kinds = []
    for i, kind in enumerate(KINDS):
        pattern = PATTERNS[kind]
        some = text.contains(HINTS[kind]) if HINTS[kind] else text.rlike("[0-9]")
        if kind == "card":
            some = text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}")
        elif kind == "ip":
            some = text.rlike(r"[0-9]\.[0-9]")
        elif kind == "phone":
            some = text.contains("+") & text.rlike(r"\+[0-9]")
        found = F.filter(_located(text, pattern), partial(_is, kind))
        as_span = F.transform(found, partial(_span, i))
        kinds.append(F.when(some, as_span).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")))
    return F.array_sort(F.concat(*kinds))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


_WORD = r"[\p{L}\p{N}_]+"


def find(docs: DataFrame, text: str = "text", carry: list[str] | None = None, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """docs (the columns to carry, by default all) with base (the personal data) and spans (that and disclosing terms): arrays of start, kind, end; kind 4 is a term.

    Texts are read three times, and only those with entities are ever moved. Scratch tables are gone when it returns, but the result's own.
    """
    rest = carry or [c for c in docs.columns if c.lower() not in ("base", "spans")]
    with common.scratch(docs.sparkSession):
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("carried"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("body"))
        body = F.col("body")
        held = rows.withColumn("found", base_spans(body))
        held = held.withColumn("row", F.monotonically_increasing_id()).withColumn("digest", F.when(F.size("found") > 0, F.md5(body)))
        # Texts of entities are kept, those of the others are not needed again.
        held = common.materialise(held.withColumn("body", F.when(F.size("found") > 0, body)), "entities", keep=True)
        terms = common.materialise(_disclosing(rows, held, support, disclosure), "disclosing", keep=True)
    own = held.where(F.size("found") > 0).select("row", "body", "found", F.explode(_entities(F.col("found"))).alias("entity"))
    # A text is dealt out once, with the terms of all its entities.
    told = own.select("row", "entity").join(small(terms), "entity").groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("told"))).alias("told"))
    extra = held.where(F.size("found") > 0).select("row", "body", "found").join(told, "row").select("row", _placed(_masked(body, F.col("found")), F.col("told")).alias("terms"))
    held = held.join(extra, "row", "left") if not terms.isEmpty() else held.withColumn("terms", F.lit(None).cast(_SPANS))
    base = F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    every = F.array_sort(F.concat(base, F.coalesce("terms", F.array().cast(_SPANS))))
    return held.select("carried.*", base.alias("base"), every.alias("spans"))


def counts(rows: DataFrame, held: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> tuple[DataFrame, int]:
    """entity, term, both, n_entity, n_term of terms that may disclose their entity, and the number of different texts.

    rows: body. held: digest, body, found of texts with personal data.
    """
    total = rows.select(F.md5("body").alias("d")).distinct().count()
    own = held.where(F.size("found") > 0).dropDuplicates(["digest"]).select("digest", "body", "found", F.explode(_entities(F.col("found"))).alias("entity"))
    # An entity in fewer texts has no term in as many.
    of_entity = own.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")).where((F.col("n_entity") >= support) & (F.col("n_entity") < total))
    of_entity = common.materialise(of_entity, "repeated")
    # A text's terms are taken once, and joined to its entities by its digest.
    entities = common.materialise(own.select("digest", "entity").join(small(of_entity.select("entity")), "entity"), "own")
    texts = held.where(F.size("found") > 0).dropDuplicates(["digest"]).join(entities.select("digest").distinct(), "digest", "left_semi")
    terms = texts.select("digest", F.explode(_terms(_masked(F.col("body"), F.col("found")))).alias("term"))
    together = terms.join(entities, "digest").groupBy("entity", "term").agg(F.count(F.lit(1)).alias("both")).where(F.col("both") >= support)
    # The most texts that a term may stand in and still disclose; no fewer than those in which it is with any such entity.
    seen = terms.groupBy("term").agg(F.count(F.lit(1)).alias("seen"))
    most = F.col("both") * F.pow(F.lit(float(max(total, 1))) / F.col("n_entity"), F.lit(1 - disclosure))
    told = together.join(of_entity, "entity").withColumn("most", most).join(seen, "term").where(F.col("seen") <= F.col("most"))
    told = common.materialise(told.select("entity", "term", "both", "n_entity", "seen"), "told")
    # n(t) of the terms in question, over different texts.
    corpus = rows.select(F.md5("body").alias("d"), F.explode(_terms(F.col("body"))).alias("term")).join(small(told.select("term").distinct()), "term")
    of_term = corpus.groupBy("term").agg(F.countDistinct("d").alias("n_term"))
    # A word that is cut by an entity on all its places is none of the corpus.
    return told.join(of_term, "term", "left").select("entity", "term", "both", "n_entity", F.greatest("seen", F.coalesce("n_term", F.lit(0))).alias("n_term")), total


def _disclosing(rows: DataFrame, held: DataFrame, support: int, disclosure: float) -> DataFrame:
    """entity, told: the terms that disclose it."""
    counted, total = counts(rows, held, support, disclosure)
    n = F.lit(float(max(total, 1)))
    shared = F.log2(n * F.col("both") / (F.col("n_term") * F.col("n_entity")))
    return counted.where(shared >= disclosure * F.log2(n / F.col("n_entity"))).groupBy("entity").agg(F.collect_set("term").alias("told"))


_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _entity(s: Column) -> Column:
    return F.xxhash64(s["kind"], F.lower(s["value"]))


def _behind(s: Column) -> Column:
    """What stands behind personal data: mail domain, network, issuer, area."""
    value, digits = F.lower(s["value"]), F.regexp_replace(s["value"], "[^0-9]", "")
    group = F.when(s["kind"] == 0, F.substring_index(value, "@", -1)).when(s["kind"] == 1, F.substring_index(value, ".", 2)).when(s["kind"] == 2, digits.substr(1, 6)).otherwise(digits.substr(1, 5))
    return F.xxhash64(s["kind"] + len(KINDS), group)


def _entities(found: Column) -> Column:
    return F.array_distinct(F.concat(F.transform(found, _entity), F.transform(found, _behind)))


def _masked(body: Column, spans: Column) -> Column:
    """body with a blank in place of each code point of spans (sorted, they may overlap): words end there, and places stay."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state, s):
        gap = F.concat(body.substr(state["at"] + 1, s["start"] - state["at"]), F.repeat(F.lit(" "), s["end"] - F.greatest(s["start"], state["at"])))
        return F.struct(F.greatest(s["end"], state["at"]).alias("at"), F.concat(state["out"], gap).alias("out"))

    done = F.aggregate(spans, start, step)
    return F.concat(done["out"], body.substr(done["at"] + 1, F.length(body)))


def _terms(body: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(body, F.lit(_WORD), F.lit(0)), F.lower))


def _placed(body: Column, terms: Column) -> Column:
    """Spans of the words of body that are among terms."""
    gaps, found = F.split(body, _WORD, -1), F.regexp_extract_all(body, F.lit(_WORD), F.lit(0))
    empty = F.struct(F.lit(0).alias("at"), F.coalesce(F.lit(None).cast(_SPANS), F.array().cast(_SPANS)).alias("out"))

    def step(state, x):
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["value"])
        span = F.struct(start.alias("start"), F.lit(len(KINDS)).alias("kind"), end.alias("end"))
        # Arrays are copied for words found only.
        return F.struct(end.alias("at"), F.when(F.array_contains(terms, F.lower(x["value"])), F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"))

    return F.aggregate(F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("value")), empty, step)["out"]


def listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def sanitised(body: Column, spans: Column) -> Column:
    """body with entities generalised to <KIND> and terms removed; of overlapping spans the union goes, named by the first."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS], F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state, s):
        fresh = s["start"] >= state["at"]
        gap = F.when(fresh, F.concat(body.substr(state["at"] + 1, s["start"] - state["at"]), F.get(names, s["kind"]))).otherwise(F.lit(""))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.concat(state["out"], gap).alias("out"))

    done = F.aggregate(spans, start, step)
    return F.when(F.size(spans) > 0, F.concat(done["out"], body.substr(done["at"] + 1, F.length(body)))).otherwise(body)


def sanitise(docs: DataFrame, text: str = "text", **parameters) -> DataFrame:
    """docs with its text sanitised; null stays null."""
    found = find(docs, text, **parameters)
    column = F.col(f"`{text}`")
    return found.withColumn(text, F.when(column.isNotNull(), sanitised(column, F.col("spans")))).select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("base", "spans")])


def _counts(i: int, s: Column) -> Column:
    return s["kind"] == i


def op6_pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(common.read(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])
    counts = [F.size(F.filter("base", partial(_counts, i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
