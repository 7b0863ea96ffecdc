"""Benchmark decontamination by a distributed positional inverted index, in DataFrame operations only.

Documents become token tables, and these an index, stored in the shared folder: a posting (term, document, position) for each place of
each term that the benchmark has. The places of a window's terms are ranked by their number of postings. A phrase is found by
intersecting lists of postings, each moved by its term's place in the window, so that equal (document, start) meet: those of the FIRST rarest
terms first, then what is left with the lists of all other terms. Proximity starts from as many of the rarest terms as leave too few others
for a match, and looks up the others' postings in the blocks of positions around.

Defined cases: null and empty texts have no words; items without words have no windows; an item of
fewer words than the window is one window; a null item_id counts as an empty string; repeated
document rows are judged row by row; an empty benchmark hits nothing; ties in frequency go to the
alphabetically first term and its first place in the window; a text of any length is only as many postings. Columns of docs that clash with
results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Words of a window; items with occurring windows that make a document contaminated.
WINDOW, MIN_ITEMS = 8, 2
#: Lists of a window's rarest terms that are intersected before the others.
FIRST = 2
#: A side is broadcast up to so many rows and bytes; beyond either the join shuffles, and a side that the benchmark sets is repeated SALTS times,
#: so that postings of a frequent term are spread.
BROADCAST_ROWS, BROADCAST_BYTES, SALTS = 200_000, 32 << 20, 16
#: What parts words, after A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP), "")


def is_small(df: DataFrame) -> bool:
    """Whether a count of rows and bytes proves df small enough to broadcast."""
    size = df.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0)).alias("b")).first()
    return size["n"] <= BROADCAST_ROWS and size["b"] <= BROADCAST_BYTES


def small(df: DataFrame) -> DataFrame:
    """df, with a broadcast hint if it is small."""
    return F.broadcast(df) if is_small(df) else df


def looked_up(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """rows (with __row) joined with a table that the benchmark sets, by a key that may be in a third of all rows."""
    if is_small(table):
        return rows.join(F.broadcast(table), key)
    spread = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64("__row"), F.lit(SALTS)).cast("int")).join(spread, [key, "__salt"]).drop("__salt")


def token_table(docs: DataFrame, text: str) -> DataFrame:
    """row, words and the other columns of docs, stored: what postings are made of."""
    rest = [c for c in docs.columns if c != text]
    rows = docs.select(F.monotonically_increasing_id().alias("__row"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)], words(F.col(f"`{text}`")).alias("__words"))
    return common.materialise(rows, "tokens", keep=True)


def item_windows(items: DataFrame, window: int, item_id: str, text: str) -> DataFrame:
    """window_key, terms, item for each window of each item."""
    w = F.col("w")
    starts = F.sequence(F.lit(0), F.greatest(F.size(w) - window, F.lit(0)))
    own = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    cut = own.select("item", "w", F.explode(starts).alias("s")).select("item", F.slice(w, F.col("s") + 1, window).alias("terms"))
    return cut.select("item", "terms", F.array_join("terms", " ").alias("window_key")).distinct()


def index(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """The positional inverted index, stored: term_id, row, position of each place of each of terms (term_id, term)."""
    places = tokens.select("__row", F.posexplode("__words").alias("position", "term"))
    return common.materialise(looked_up(places, terms, "term").select("term_id", "__row", "position"), "postings")


def ranked(postings: DataFrame, terms: DataFrame, windows: DataFrame) -> DataFrame:
    """window, length, term_id, offset, rank (from 0) of each place of each window, stored: the term of fewest postings first."""
    number = postings.groupBy("term_id").agg(F.count(F.lit(1)).alias("n"))
    places = windows.select("window", F.size("terms").alias("length"), F.posexplode("terms").alias("offset", "term"))
    known = places.join(terms.join(number, "term_id", "left"), "term")
    order = Window.partitionBy("window").orderBy(F.coalesce("n", F.lit(0)), "term", "offset")  # a window has WINDOW places
    return common.materialise(known.select("window", "length", "term_id", "offset", (F.row_number().over(order) - 1).alias("rank")), "ranked")


def phrases(postings: DataFrame, places: DataFrame) -> DataFrame:
    """row, window, start, length of each occurrence of a window, by intersecting offset-adjusted lists of postings."""
    at = ["__row", "window", "start"]
    first = looked_up(postings, places.where(F.col("rank") < FIRST).select("term_id", "window", "offset", "length"), "term_id")
    lists = first.select("__row", "window", (F.col("position") - F.col("offset")).alias("start"), "length").where("start >= 0")
    both = lists.groupBy(*at).agg(F.count(F.lit(1)).alias("lists"), F.first("length").alias("length"))
    left = common.materialise(both.where(F.col("lists") == F.least("length", F.lit(FIRST))).drop("lists"), "intersected")
    others = places.where(F.col("rank") >= FIRST).select("window", "term_id", "offset")
    asked = looked_up(left, others, "window").select(*at, "length", "term_id", (F.col("start") + F.col("offset")).alias("position"))
    held = postings.join(small(asked), ["__row", "term_id", "position"]).groupBy(*at).agg(F.count(F.lit(1)).alias("lists"), F.first("length").alias("length"))
    return held.where(F.col("lists") == F.col("length") - FIRST).drop("lists").unionByName(left.where(F.col("length") <= FIRST))


def proximities(postings: DataFrame, places: DataFrame, window: int, share: float) -> DataFrame:
    """row, window, start, length of each place where a share of a window's different terms stands in so many consecutive words, from the first to the last of them."""
    terms = places.groupBy("window", "term_id").agg(F.min("rank").alias("rank"))
    order = Window.partitionBy("window").orderBy("rank")
    terms = terms.withColumn("rarity", F.row_number().over(order)).withColumn("terms", F.count(F.lit(1)).over(Window.partitionBy("window")))
    terms = terms.withColumn("needed", F.greatest(F.ceil(F.col("terms") * share - 1e-9), F.lit(1)))
    terms = common.materialise(terms.select("window", "term_id", "rarity", "terms", "needed"), "terms")
    # Of needed terms, one at least is among the others' number plus one that are rarest.
    anchors = looked_up(postings, terms.where("rarity <= terms - needed + 1").select("term_id", "window", "needed"), "term_id").select("__row", "window", "needed", F.col("position").alias("anchor"))
    asked = looked_up(anchors, terms.select("window", "term_id"), "window").withColumn("block", F.explode(F.sequence(F.floor((F.col("anchor") - (window - 1)) / window), F.floor((F.col("anchor") + window - 1) / window))))
    blocks = postings.withColumn("block", F.floor(F.col("position") / window))
    near = blocks.join(asked, ["__row", "term_id", "block"]).where(F.abs(F.col("position") - F.col("anchor")) < window)
    # An anchor has no more places around than 2 window - 1, so neither has its array.
    around = near.groupBy("__row", "window", "anchor", "needed").agg(F.collect_set(F.struct("position", "term_id")).alias("places"))
    ends = F.transform("places", lambda a: F.struct(a["position"].alias("start"), F.filter("places", lambda b: (b["position"] >= a["position"]) & (b["position"] < a["position"] + window)).alias("within")))
    met = F.filter(ends, lambda a: F.size(F.array_distinct(a["within"]["term_id"])) >= F.col("needed"))
    found = around.select("__row", "window", F.explode(met).alias("m"))
    return found.select("__row", "window", F.col("m.start").alias("start"), (F.array_max("m.within.position") - F.col("m.start") + 1).alias("length")).distinct()


def matches(tokens: DataFrame, windows: DataFrame, window: int = WINDOW, share: float | None = None) -> DataFrame:
    """row, window_key, start, length of each occurrence of a window as a phrase; with share, of each
    place where that share of the window's different terms stands in window consecutive words (proximity)."""
    distinct = common.materialise(windows.select("window_key", "terms").distinct().withColumn("window", F.monotonically_increasing_id()), "distinct")
    terms = common.materialise(distinct.select(F.explode("terms").alias("term")).distinct().withColumn("term_id", F.monotonically_increasing_id()), "vocabulary")
    postings = index(tokens, terms)
    places = ranked(postings, terms, distinct)
    found = phrases(postings, places) if share is None else proximities(postings, places, window, share)
    return looked_up(found, distinct.select("window", "window_key"), "window").select("__row", "window_key", "start", "length")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, min_items: int = MIN_ITEMS, text: str = "text", item_id: str = "item_id", item_text: str = "text", spans: bool = False, share: float | None = None) -> DataFrame:
    """Adds n_words, n_hit, n_items, items_sha256, contaminated to docs (without its text); with spans, also hit_spans: [start, end) in words of each
    occurrence. Occurrences are phrases; with share, places where that share of a window's different terms stands in window consecutive words, in any order."""
    rest = [c for c in docs.columns if c != text]
    new = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", *(("hit_spans",) if spans else ()))
    with common.scratch(docs.sparkSession):
        tokens = token_table(docs, text)
        windows = common.materialise(item_windows(items, window, item_id, item_text), "windows")
        found = common.materialise(matches(tokens, windows, window, share), "hits")
        covered = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p["start"], p["start"] + p["length"] - 1))))
        places = found.groupBy("__row").agg(F.collect_set(F.struct("start", "length")).alias("places"))
        hits = places.select("__row", F.size(covered).cast("long").alias("n_hit"), F.transform(F.array_sort("places"), lambda p: F.struct(p["start"].alias("start"), (p["start"] + p["length"]).alias("end"))).alias("hit_spans"))
        named = looked_up(found.select("__row", "window_key").distinct(), windows.select("window_key", "item"), "window_key").select("__row", "item").distinct()
        of_items = named.groupBy("__row").agg(F.count(F.lit(1)).alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item")), ","), 256).alias("items_sha256"))
        of_rows = common.materialise(hits.join(of_items, "__row"), "hit_rows", keep=True)
    out = tokens.select("__row", *[f"c{i}" for i in range(len(rest))], F.size("__words").cast("long").alias("n_words")).join(of_rows, "__row", "left")
    zero = F.lit(0).cast("long")
    done = {
        "n_words": F.col("n_words"), "n_hit": F.coalesce("n_hit", zero), "n_items": F.coalesce("n_items", zero),
        "items_sha256": F.coalesce("items_sha256", F.sha2(F.lit(""), 256)), "contaminated": F.coalesce("n_items", zero) >= min_items, "hit_spans": F.col("hit_spans"),
    }
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(rest) if c.lower() not in new], *[done[c].alias(c) for c in new])


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate(docs, common.read(spark, sf_dir, "benchmark")).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item, least(len(w), 8) AS n, array_to_string(w[s:s + 7], ' ') AS k
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 0) + 2)) AS s FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM bw
), dw AS (
  SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)
), hit AS (
  SELECT dw.doc_id, dw.s, dw.n, bw.item FROM dw JOIN bw ON dw.k = bw.k AND dw.n = bw.n
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM hit)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
