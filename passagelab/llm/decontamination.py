"""Benchmark decontamination by a distributed positional inverted index.

The index stores a posting (document, place) for every training token that is a
term of the benchmark; other tokens take part in no match. A match of an item lies
on one diagonal, the document's place minus the item's. For every window of an
item the two rarest terms are looked up first, and their lists, adjusted by the
terms' offsets, meet on the diagonals; only diagonals with enough of them are
intersected with the remaining terms' lists. What is left are exact phrase
matches, or places within a distance for :func:`proximity_matches`.

Everything here is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_bounded, table

WINDOW_WORDS = 10
#: Terms of a window that are looked up first.
RAREST = 2
#: Rows of the benchmark's own tables and of the found documents that are broadcast at most.
BENCHMARK_ROWS = 500_000

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: ASCII characters other than letters and digits; NUL is split on apart, as translate can't map it.
BETWEEN = "".join(map(chr, [*range(0x01, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def split_words(text: Column) -> Column:
    """The words of a text in lower case; an empty string may stand first and last."""
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER + BETWEEN, UPPER.lower() + " " * len(BETWEEN))
    return F.split(plain, "[\\x00 ]+")


def word_count(words: Column) -> Column:
    ends = (F.element_at(words, 1) == "").cast("int") + (F.element_at(words, -1) == "").cast("int")
    return F.when((F.size(words) == 1) & (F.element_at(words, 1) == ""), 0).otherwise(F.size(words) - ends).cast("long")


def item_terms(benchmark: DataFrame, window: int) -> DataFrame:
    """``(item, item_id, place, term, width)``: the words of each distinct item and its window's width."""
    items = benchmark.select("item_id", "text").where("item_id IS NOT NULL").distinct()
    words = items.select(F.xxhash64("item_id", "text").alias("item"), "item_id", F.posexplode(split_words(F.col("text"))).alias("place", "term")).where("term <> ''")
    width = F.least(F.lit(window), F.count("*").over(Window.partitionBy("item")))
    return words.select("item", "item_id", "place", "term", width.cast("int").alias("width"))


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings ``(doc, row, n_words, place, term)`` of ``docs (doc_id, text)``.

    ``terms (term)`` are those that are kept. Every row of ``docs`` also gives one
    row without a term.
    """
    doc = docs.select(F.coalesce("doc_id", F.lit(0)).alias("doc"), F.col("doc_id"), F.xxhash64("doc_id", "text").alias("row"), split_words(F.col("text")).alias("words"))
    marked = doc.select("doc", "doc_id", "row", word_count(F.col("words")).alias("n_words"), F.posexplode(F.concat("words", F.array(F.lit(None).cast("string")))).alias("place", "term"))
    known = broadcast_if_bounded(terms.select(F.col("term").alias("known")), BENCHMARK_ROWS)
    return marked.join(known, F.col("term") == F.col("known"), "left").where("known IS NOT NULL OR term IS NULL").drop("known")


def anchors(items: DataFrame, counts: DataFrame, rarest: int) -> DataFrame:
    """``(item, place, term, needed)``: of every window the rarest terms, and how many an item's diagonal needs."""
    weighed = items.join(counts, "term", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    last = F.max("place").over(Window.partitionBy("item"))
    first = F.min("place").over(Window.partitionBy("item"))
    start = F.explode(F.sequence(F.greatest("first", F.col("place") - F.col("width") + 1), F.least("place", F.col("last") - F.col("width") + 1)))
    windows = weighed.withColumns({"first": first, "last": last}).withColumn("start", start)
    ranked = windows.withColumn("rank", F.row_number().over(Window.partitionBy("item", "start").orderBy("count", "place")))
    chosen = ranked.where(F.col("rank") <= rarest).select("item", "place", "term", F.least(F.lit(rarest), "width").alias("needed"))
    return chosen.distinct()


def phrase_matches(index: DataFrame, items: DataFrame, scratch: Scratch, rarest: int = RAREST, keep: bool = True) -> DataFrame:
    """``(doc, row, item, item_id, begin, end)``: maximal runs of whole windows, by place in the document."""
    items_b = broadcast_if_bounded(items, BENCHMARK_ROWS)
    postings = index.where("term IS NOT NULL")
    counts = postings.groupBy("term").count()
    rare = scratch.keep(anchors(items, counts, rarest), "anchors")
    rare = broadcast_if_bounded(rare.withColumnRenamed("place", "at"), BENCHMARK_ROWS)
    seen = postings.join(rare, "term").select("doc", "row", "item", (F.col("place") - F.col("at")).alias("diagonal"), "at", "needed")
    diagonals = seen.groupBy("doc", "row", "item", "diagonal").agg(F.count_distinct("at").alias("found"), F.max("needed").alias("needed")).where("found >= needed")
    diagonals = scratch.keep(diagonals.select("doc", "row", "item", "diagonal"), "diagonals")
    expected = diagonals.join(items_b, "item").select("doc", "row", "item", "item_id", "width", "diagonal", F.col("place").alias("at"), (F.col("diagonal") + F.col("place")).alias("place"), "term")
    found = broadcast_if_bounded(diagonals.select("doc", "row").distinct(), BENCHMARK_ROWS)
    near = postings.select("doc", "row", "place", "term").join(found, ["doc", "row"], "left_semi")
    matched = expected.join(near, ["doc", "row", "place", "term"]).select("doc", "row", "item", "item_id", "width", "diagonal", "at").distinct()
    along = Window.partitionBy("doc", "row", "item", "diagonal").orderBy("at")
    runs = matched.withColumn("run", F.col("at") - F.row_number().over(along))
    runs = runs.groupBy("doc", "row", "item", "item_id", "width", "diagonal", "run").agg(F.min("at").alias("a"), F.max("at").alias("b"))
    whole = runs.where("b - a + 1 >= width")
    return whole.select("doc", "row", "item", "item_id", (F.col("diagonal") + F.col("a")).alias("begin"), (F.col("diagonal") + F.col("b") + 1).alias("end"))


def proximity_matches(index: DataFrame, terms: list[str], distance: int) -> DataFrame:
    """``(doc, row, begin, end)``: where all ``terms`` stand within ``distance`` places.

    Each occurrence of the rarest term is tried; for every other term the nearest
    places before and after it come from that term's list in the same document.
    """
    wanted = sorted({t.lower() for t in terms})
    postings = index.where(F.col("term").isin(wanted))
    counts = {r[0]: r[1] for r in postings.groupBy("term").count().collect()}
    if len(counts) < len(wanted):
        return postings.select("doc", "row", F.col("place").alias("begin"), F.col("place").alias("end")).limit(0)
    rarest = min(wanted, key=lambda t: (counts[t], t))
    near = postings.where(F.col("term") == rarest).select("doc", "row", F.col("place").alias("p"))
    near = near.withColumns({"begin": F.explode(F.sequence(F.col("p") - distance + 1, F.col("p")))})
    for i, t in enumerate(w for w in wanted if w != rarest):
        other = postings.where(F.col("term") == t).select("doc", "row", F.explode(F.sequence(F.col("place") - distance + 1, F.col("place"))).alias("begin"), F.col("place").alias(f"q{i}"))
        other = other.groupBy("doc", "row", "begin").agg(F.min(f"q{i}").alias(f"q{i}"))
        near = near.join(other, ["doc", "row", "begin"])
    ends = [F.col(c) for c in near.columns if c == "p" or c.startswith("q")]
    starts = F.least(*ends) if len(ends) > 1 else ends[0]
    stops = F.greatest(*ends) if len(ends) > 1 else ends[0]
    return near.select("doc", "row", starts.alias("begin"), stops.alias("end")).distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, window: int = WINDOW_WORDS) -> DataFrame:
    """Per row of ``docs (doc_id, text)``: words, words inside matches, and the items matched.

    Words are runs of ASCII letters and digits and of all other characters beyond
    ASCII, ASCII letters in lower case. A window is ``window`` consecutive words of
    an item; an item of fewer, but not none, is one. Null texts have no words; items
    without id or words match nothing; repeated rows each get their result.
    """
    items = scratch.keep(item_terms(benchmark, window), "items")
    index = scratch.keep(build_index(docs.select("doc_id", "text"), items.select("term").distinct()), "postings")
    matches = scratch.keep(phrase_matches(index, items, scratch), "matches")
    hit = matches.select("doc", "row", F.explode(F.sequence("begin", F.col("end") - 1)).alias("place")).distinct().groupBy("doc", "row").agg(F.count("*").alias("n_hit"))
    named = matches.select("doc", "row", "item_id").distinct().groupBy("doc", "row").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list(F.col("item_id").cast("string"))), ",").alias("names"))
    rows = index.where("term IS NULL").select("doc", "doc_id", "row", "n_words")
    out = rows.join(hit, ["doc", "row"], "left").join(named, ["doc", "row"], "left")
    hits, items_ = F.coalesce("n_hit", F.lit(0)), F.coalesce("n_items", F.lit(0))
    return out.select("doc_id", "row", "n_words", hits.alias("n_hit"), items_.alias("n_items"), F.sha2(F.coalesce("names", F.lit("")).cast("binary"), 256).alias("items_sha256"), (hits > 0).alias("contaminated"))


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    """Words of ``documents`` inside ten-word windows of ``benchmark``."""
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return contamination(docs, benchmark, Scratch(spark, "benchmark")).drop("row")


_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"
OP3_SQL = rf"""
with d as (select doc_id, regexp_extract_all({_LOWER}, '{_WORDS}') as w from documents),
b as (select item_id, regexp_extract_all({_LOWER}, '{_WORDS}') as w from benchmark where item_id is not null),
bw as (select item_id, w, least(10, len(w)) as n from b where len(w) > 0),
win as (select distinct item_id, n, array_to_string(w[s : s + n - 1], ' ') as t
        from (select item_id, w, n, unnest(range(1, len(w) - n + 2)) as s from bw)),
dw as (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as s from d, (select distinct n from win) where len(w) >= n),
m as (select dw.doc_id, dw.s, dw.n, win.item_id from dw join win on win.n = dw.n and win.t = array_to_string(dw.w[dw.s : dw.s + dw.n - 1], ' ')),
h as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + n)) as p from m) group by doc_id),
i as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as names
      from (select distinct doc_id, cast(item_id as varchar) as item_id from m) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(h.n_hit, 0) as n_hit, coalesce(i.n_items, 0) as n_items,
  sha256(coalesce(i.names, '')) as items_sha256, coalesce(h.n_hit, 0) > 0 as contaminated
from d left join h using (doc_id) left join i using (doc_id)
"""
