"""Document fingerprints: a homomorphic multiset hash, in DataFrame operations only.

A text is the multiset of its paragraphs (lines). A paragraph hashes to a wide vector: hashes of the whole
paragraph, and of its neighbouring words' pairs, spread over lanes; a fingerprint is the sum of its paragraphs'
vectors modulo powers of two. Sums do not depend on order, and paragraphs can be put in or taken out
by adding or subtracting vectors (add, subtract).

A fingerprint has 4 lanes of 32 bits, sums of paragraph hashes modulo 2**32; the number of word pairs; and
2 * LONGS lanes of 32 bits, two to a long, each of which counts the pairs whose hash has a certain bit. All are written as
16 hex digits for each long. Equal fingerprints mean equal multisets up to hash collisions. likeness() is the cosine of the
counting lanes centred at half of the pairs: the share of word pairs in common, as far as so many lanes can tell.

Defined cases: null and empty texts have no paragraphs, and the fingerprint of all zeros; two such are alike by 1.0, one
of them and another by 0.0; a line of white space only is a paragraph without words; the
document after the last is the first one; documents of equal id follow in order of their text; null ids come first;
a table of one document is followed by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Longs of counting lanes, two lanes each; a multiple of 32, 32 for each hash function.
LONGS = 64
_LOW = 0xFFFFFFFF
_ONES = 1 | 1 << 32
#: Documents in a range of ids that one task orders, and the most ranges.
RANGE, MOST_RANGES = 2_000, 1 << 16


def _pairs(line: Column) -> Column:
    """Hashes of a line's neighbouring words; both ends count as words."""
    words = F.array_remove(F.split(line, r"\s+"), "")
    begun, ended = F.concat(F.array(F.lit("\x02")), words), F.concat(words, F.array(F.lit("\x03")))
    return F.when(F.size(words) > 0, F.zip_with(begun, ended, lambda a, b: F.xxhash64(a, b))).otherwise(F.array().cast("array<bigint>"))


def lines(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(text, "\n"))


def fingerprints(texts: DataFrame, key: list[str], text: str) -> DataFrame:
    """key columns, and v: the vector of each text (ARRAY<BIGINT>). Rows are summed where they are read; one row
    for each text and task moves."""
    held = texts.select(*key, F.posexplode_outer(lines(F.col(text))).alias("__place", "__line"))
    paragraphs = held.select(*key, "__line", F.explode_outer(F.concat(F.array(F.lit(None).cast("bigint")), F.coalesce(_pairs(F.col("__line")), F.array().cast("array<bigint>")))).alias("h"))
    # The leading null of each paragraph carries its own hashes, the others carry pairs.
    whole = F.col("h").isNull() & F.col("__line").isNotNull()
    sums = []
    for seed in (1, 2):
        own = F.xxhash64(F.lit(seed), "__line")
        sums += [F.sum(F.when(whole, x).otherwise(F.lit(0))) for x in (own.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(own, 32))]
    sums.append(F.count("h"))
    for k in range(LONGS // 32):
        hashed = F.when(F.col("h").isNotNull(), F.xxhash64(F.lit(k), "h")) if k else F.col("h")
        sums += [F.sum(F.shiftrightunsigned(hashed, j).bitwiseAND(F.lit(_ONES))) for j in range(32)]
    added = paragraphs.groupBy(*key).agg(*[x.alias(f"s{i}") for i, x in enumerate(sums)])
    zero = F.lit(0).cast("bigint")
    lanes = [F.coalesce(F.col(f"s{i}"), zero) for i in range(len(sums))]
    return added.select(*key, F.array(*[x.bitwiseAND(F.lit(_LOW)) for x in lanes[:4]], *lanes[4:]).alias("v"))


def add(a: Column, b: Column) -> Column:
    """The fingerprint of both multisets together."""
    return F.transform(F.zip_with(a, b, lambda x, y: x + y), lambda x, i: F.when(i < 4, x.bitwiseAND(F.lit(_LOW))).otherwise(x))


def subtract(a: Column, b: Column) -> Column:
    """The fingerprint of what is left when the multiset b is taken out of a."""
    return F.transform(F.zip_with(a, b, lambda x, y: x - y), lambda x, i: F.when(i < 4, x.bitwiseAND(F.lit(_LOW))).otherwise(x))


def to_text(v: Column) -> Column:
    return F.array_join(F.transform(v, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def _centred(v: Column) -> Column:
    """Counting lanes, each twice its count less the pairs."""
    lanes = F.flatten(F.transform(F.slice(v, 6, LONGS), lambda x: F.array(x.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(x, 32))))
    return F.transform(lanes, lambda c: (2 * c - v[4]).cast("double"))


def likeness(a: Column, b: Column) -> Column:
    """Cosine of the centred lanes, 0 at least and 1 at most; of equal vectors 1."""
    x, y = _centred(a), _centred(b)
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda s, t: s * t), F.lit(0.0), lambda s, t: s + t)
    size = F.sqrt(dot(x, x) * dot(y, y))
    cosine = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(x, y) / size))).otherwise(F.lit(0.0))
    return F.round(F.when(a == b, F.lit(1.0)).otherwise(cosine), 6)


def _range(order: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are not above order, by binary search."""
    if not bounds:
        return F.lit(0)
    held, n = F.lit(bounds), len(bounds)
    steps = [1 << k for k in range(n.bit_length() - 1, -1, -1)]
    return F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when((at + step <= n) & (F.get(held, F.least(at + step, F.lit(n)) - 1) <= order), at + step).otherwise(at))


def followed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """docs with __range, __at, next_id and next_text: id and text of the document of the next id, after the last of the first.

    Quantiles of the ids cut them into ranges of about RANGE documents; each range is ordered in a task of its own, and
    its last document gets the first one of the next range. Range and place number the rows. All this follows from ids and texts
    alone, so rows that are read again after an executor was lost are numbered and paired as before.
    """
    order = F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)))
    pieces = min(MOST_RANGES, docs.count() // RANGE + 1)
    shares = [(k + 1) / pieces for k in range(pieces - 1)]
    bounds = sorted(set(docs.select(F.percentile_approx(order, shares, 20 * pieces)).first()[0] or [])) if shares else []
    ranged = docs.withColumn("__range", _range(order, bounds))
    own = Window.partitionBy("__range").orderBy(F.col(doc_id).asc_nulls_first(), F.col(text))
    placed = ranged.withColumns({"__at": F.row_number().over(own), "__then": F.lead(F.struct(doc_id, text)).over(own)})
    heads = ranged.groupBy("__range").agg(F.min(F.struct(doc_id, text)).alias("head"))
    # A row for each range: which range comes next.
    every = Window.orderBy("__range")
    chain = heads.select("__range", F.lead("__range").over(every).alias("then"), F.first("__range").over(every).alias("start")).select("__range", F.coalesce("then", "start").alias("then"))
    after = chain.join(heads.select(F.col("__range").alias("then"), "head"), "then").select("__range", "head")
    out = placed.join(after, "__range").withColumn("__then", F.coalesce("__then", "head"))
    return out.select(*docs.columns, "__range", "__at", F.col(f"__then.{doc_id}").alias("next_id"), F.col(f"__then.{text}").alias("next_text"))


def _version(doc_id: Column, text: Column) -> list[Column]:
    """Two numbers that stand for an id and its text: rows that have both in common have one fingerprint."""
    return [F.coalesce(doc_id.cast("long"), F.lit(0).cast("long")), F.xxhash64(doc_id.isNull(), text)]


def fingerprint_versions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, v, e, w: vectors of each text, of its edited text and of the next document.

    The edited text has its last quarter of code points (rounded down) replaced by as many of the next document's first.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    edited = F.expr("concat(substring(text, 1, length(text) - cast(floor(length(text) / 4) as int)), substring(next_text, 1, cast(floor(length(text) / 4) as int)))")
    own, following = _version(F.col("doc_id"), F.col("text")), _version(F.col("next_id"), F.col("next_text"))
    names = [own[0].alias("own_id"), own[1].alias("own_text"), following[0].alias("then_id"), following[1].alias("then_text")]
    both = followed(rows, "doc_id", "text").select("__range", "__at", "doc_id", *names, F.length("text").cast("long").alias("n_chars"), "text", edited.alias("edited"))
    # Rows are dealt out by range already: with it in the key, sums need no further exchange.
    key = ["__range", "__at", "doc_id", "own_id", "own_text", "then_id", "then_text", "n_chars", "edited_sha256"]
    versions = both.withColumn("edited_sha256", F.sha2(F.col("edited"), 256))
    versions = versions.select(*key, F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t")))).alias("x"))
    found = fingerprints(versions.select(*key, "x.kind", "x.t"), [*key, "kind"], "t")
    pair = found.groupBy(*key).agg(F.max(F.when(F.col("kind") == 0, F.col("v"))).alias("v"), F.max(F.when(F.col("kind") == 1, F.col("v"))).alias("e"))
    pair = common.materialise(pair, "fingerprints")
    # Of repeated rows one vector, which is the same for all.
    heads = pair.groupBy(F.col("own_id").alias("then_id"), F.col("own_text").alias("then_text")).agg(F.first("v").alias("w"))
    return pair.join(heads, ["then_id", "then_text"]).select("doc_id", "n_chars", "edited_sha256", "v", "e", "w")


def op9_multiset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint_versions(common.read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", "edited_sha256", to_text(F.col("v")).alias("fingerprint"), to_text(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("v"), F.col("e")).alias("near_edited"), likeness(F.col("v"), F.col("w")).alias("near_next"),
    )
