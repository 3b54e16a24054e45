"""Benchmark decontamination by winnowing, in DataFrame operations alone.

Words are hashed into k-grams (k = 5); of every 6 consecutive k-grams the smallest hash is kept as a fingerprint.
A span of ``span`` = 10 words holds exactly 6 k-grams, so whenever a document and a benchmark item share 10
consecutive words they share the fingerprint of that very window: no shared span of that length is missed.
Items of fewer than ``span`` words are one window of their own length, whose hash is its fingerprint.

1. Fingerprints of all documents are joined with the benchmark's.  That is one pass over the texts, which counts their
   words as well; nothing but a row for each text and the texts that met goes on.
2. Each meeting is extended: in the texts that met, the windows of each fingerprint are compared with the items'
   windows word by word (an equal join on fingerprint and words, so a fingerprint that many windows have multiplies
   nothing), and the windows found mark the document's words.

The benchmark's side is broadcast while it has at most ``BROADCAST_ROWS`` rows, else shuffled.  Texts are identified
by two 64-bit hashes, so copies and repeated doc_ids are no special case.

Defined results: null and word-less texts have no words, no items and are not contaminated; null or word-less
items match nothing, nor does an item without an id; a repeated item_id counts once; ties between hashes cannot
matter, as words decide; repeated rows give equal rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.llm.columns import let
from casewright.session import cut

SPAN, GRAM = 10, 5
#: Words, in text whose A-Z may or may not be lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BROADCAST_ROWS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words of a text with A-Z (only) lower-cased; none for null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), 0)


def text_key(text: Column) -> Column:
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit("key"), F.length(text), text).alias("b"))


def _at(array: Column, i: Column) -> Column:
    return F.element_at(array, (i + 1).cast("int"))


def _positions(count: Column) -> Column:
    """0 .. count - 1, or an empty array."""
    return F.when(count > 0, F.sequence(F.lit(0), (count - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def _marks(words: Column, sizes: list[int], span: int, gram: int) -> Column:
    """Arrays of the fingerprints of a text's windows, by place: of ``span`` words, then of each of the ``sizes``."""
    wide = span - gram + 1

    def winnowed(w: Column) -> Column:
        grams = F.transform(_positions(F.size(w) - (gram - 1)), lambda i: F.xxhash64(*[_at(w, i + j) for j in range(gram)]))
        return let(grams, lambda g: F.transform(_positions(F.size(g) - (wide - 1)), lambda i: F.least(*[_at(g, i + j) for j in range(wide)])))

    def short(w: Column, n: int) -> Column:
        return F.transform(_positions(F.size(w) - (n - 1)), lambda i: F.xxhash64(F.lit(n), *[_at(w, i + j) for j in range(n)]))

    hashes = F.transform(words, lambda x: F.xxhash64(x))
    return let(hashes, lambda w: F.array(winnowed(w), *[short(w, n) for n in sizes]))


def _windows(df: DataFrame, keys: list[str], sizes: list[int], span: int, gram: int) -> DataFrame:
    """keys, mark, at, length and window (its words) of every window; ``df`` holds the keys and words."""
    lengths = [span, *sizes]
    marked = df.select(*keys, "words", F.posexplode_outer(_marks(F.col("words"), sizes, span, gram)).alias("k", "marks"))
    rows = marked.select(*keys, "words", "k", F.posexplode_outer("marks").alias("at", "mark")).where("mark is not null")
    length = F.element_at(F.array(*[F.lit(n) for n in lengths]), F.col("k") + 1)
    return rows.select(*keys, "mark", "at", length.alias("length"), F.array_join(F.slice("words", F.col("at") + 1, length), " ").alias("window"))


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


@dataclass
class Benchmark:
    """(wid, mark, length, window) of every distinct window of the items, the items of each, and what sizes there are."""

    windows: DataFrame
    items: DataFrame
    sizes: list[int]
    rows: int

    @staticmethod
    def of(benchmark: DataFrame, span: int, gram: int) -> Benchmark:
        items = benchmark.where(F.col("item_id").isNotNull()).select("item_id", words_of(F.col("text")).alias("words"))
        items = cut(items.where(F.size("words") > 0).distinct())
        sizes = sorted(r.n for r in items.select(F.size("words").alias("n")).where(F.col("n") < span).distinct().collect())  # below span
        long = _windows(items.where(F.size("words") >= span), ["item_id"], [], span, gram)
        parts = [_windows(items.where(F.size("words") == n), ["item_id"], [n], span, gram).where(F.col("length") == n) for n in sizes]
        found = cut(reduce(DataFrame.unionByName, parts, long).select("item_id", "mark", "length", "window").distinct())
        own = cut(found.select("mark", "length", "window").distinct().withColumn("wid", F.monotonically_increasing_id()))
        named = cut(found.join(own, ["mark", "length", "window"]).select("wid", "item_id"))
        return Benchmark(own, named, sizes, named.count())


def meetings(documents: DataFrame, items: Benchmark, span: int, gram: int) -> DataFrame:
    """A row (the columns of ``documents``, key, n_words, met = false) of each document, and one with met = true for
    each fingerprint that it shares with an item.  ``documents`` must hold text, which is left out.
    """
    others = [c for c in documents.columns if c != "text"]
    read = documents.select(*others, text_key(F.col("text")).alias("key"), words_of(F.col("text")).alias("words"))
    marks = F.array_distinct(F.flatten(_marks(F.col("words"), items.sizes, span, gram)))
    # The first mark stands for the document itself.  A struct of both, so that words are made once.
    both = F.when(F.size("words") > 0, marks).otherwise(F.array().cast("array<long>"))
    read = read.select(*others, "key", F.size("words").cast("long").alias("n_words"), F.posexplode_outer(F.concat(F.array("key.a"), both)).alias("place", "mark"))
    prints = items.windows.select("mark", F.lit(True).alias("known")).distinct()
    rows = read.join(_bounded(prints, items.rows), "mark", "left").withColumn("met", F.col("known").isNotNull() & (F.col("place") > 0))
    return rows.where("met or place = 0").select(*others, "key", "n_words", "met")


def contamination(documents: DataFrame, items: Benchmark, met: DataFrame, span: int, gram: int) -> DataFrame:
    """(key, n_hit, items): for each contaminated text, how many of its words are hit and the items (as text).

    ``met`` holds the keys of the texts to look at.
    """
    n = met.count()
    keyed = documents.select(text_key(F.col("text")).alias("key"), "text").join(_bounded(met, n), "key", "left_semi")
    texts = keyed.groupBy("key").agg(F.first("text").alias("text")).select("key", words_of(F.col("text")).alias("words"))
    placed = _windows(texts, ["key"], items.sizes, span, gram)
    places = cut(placed.join(_bounded(items.windows, items.rows), ["mark", "length", "window"]).select("key", "at", "length", "wid"))
    # Words hit: each place adds its words beyond the furthest end of the places before it.
    spans = F.array_sort(F.collect_set(F.struct("at", (F.col("at") + F.col("length")).alias("end"))))
    folded = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda acc, x: F.struct(
            (acc.n + F.greatest(x.end - F.greatest(acc.to, x["at"]), F.lit(0))).cast("int").alias("n"),
            F.greatest(acc.to, x.end).alias("to"),
        ),
        lambda acc: acc.n.cast("long"),
    )
    n_hit = places.groupBy("key").agg(folded.alias("n_hit"))
    named = places.select("key", "wid").distinct().join(_bounded(items.items, items.rows), "wid")
    named = named.groupBy("key").agg(F.array_sort(F.transform(F.collect_set("item_id"), lambda i: i.cast("string"))).alias("items"))
    return n_hit.join(named, "key")


def decontaminate(documents: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row of ``documents``."""
    items = Benchmark.of(benchmark, span, gram)
    rows = cut(meetings(documents.select("doc_id", "text"), items, span, gram))
    found = cut(contamination(documents, items, cut(rows.where("met").select("key").distinct()), span, gram))
    named = F.coalesce("items", F.array().cast("array<string>"))
    return rows.where("not met").join(_bounded(found, found.count()), "key", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(named).cast("long").alias("n_items"),
        F.sha2(F.array_join(named, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """The rows of ``documents`` without a shared window, with all their columns."""
    items = Benchmark.of(benchmark, span, gram)
    met = cut(meetings(documents.select("text"), items, span, gram).where("met").select("key").distinct())
    found = cut(contamination(documents, items, met, span, gram).select(F.col("key").alias("__met")))
    return documents.join(_bounded(found, found.count()), text_key(F.col("text")).eqNullSafe(F.col("__met")), "left_anti")
