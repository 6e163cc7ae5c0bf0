"""Line deduplication by sorted hashes, with Spark functions only.

A line's key is the line stripped of white space at both ends, with A-Z lowered; keys of at least LEAST_CHARS code points
count. Each such line becomes a row of 128 hash bits, document and position. The rows are dealt out by ranges of the hash
and sorted by hash, document and position, so that one pass sees the first document of a hash before all others; what
comes later from another document is dropped. Frequent hashes, of which a sketch knows all that make more than one line in
HOT_SHARE, don't take part in that shuffle: their first documents are a few aggregated rows, which are broadcast.

A document's keep bitmap is returned run-length coded, as the runs of lines that are dropped; texts meet their bitmaps
last, by one shuffle at every size.

Defined results: null or empty text is one empty line; lines of one document that share a key all stay or all go; where
documents repeat a doc_id or have none, each row is a document of its own, in the order of doc_id (null ids last) and text,
and equal rows keep the lines of one of them; extra columns are ignored; an empty table gives an empty result."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, Scratch, keyed, unkeyed

#: Code points that a key has at least.
LEAST_CHARS = 10
#: A hash is frequent with more than one line in HOT_SHARE and more than HOT_LINES lines: at most HOT_SHARE hashes are.
HOT_SHARE, HOT_LINES = 1024, 1000
_RUN = "array<struct<first:int,n:int>>"


def lines_of(text) -> F.Column:
    return F.split(text, "\n", -1)


def line_rows(rows: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """h1, h2, key, place of each line of (key, text) whose key counts."""
    line = F.translate(F.btrim("line", F.lit(WHITE)), string.ascii_uppercase, string.ascii_lowercase)
    return (
        rows.select("key", F.posexplode(lines_of(F.col("text"))).alias("place", "line"))
        .select("key", "place", line.alias("line"))
        .filter(F.length("line") >= least_chars)
        .select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(LEAST_CHARS), "line").alias("h2"), "key", "place")
    )


def frequent_hashes(lines: DataFrame) -> DataFrame:
    """h1 of the frequent lines, HOT_SHARE rows at most. A sketch of 8 entries a row it may give tells them."""
    found = lines.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(h1, {HOT_SHARE}, {8 * HOT_SHARE})").alias("top"))
    return found.select("n", F.explode("top").alias("top")).filter((F.col("top.count") > HOT_LINES) & (F.col("top.count") * HOT_SHARE > F.col("n"))).select("top.item").toDF("h1")


def later_lines(lines: DataFrame, frequent: DataFrame) -> DataFrame:
    """key, place of every line whose hash an earlier document holds. lines and frequent are written tables."""
    sorted_by = Window.partitionBy("h1", "h2").orderBy("key", "place")
    first = F.first("key").over(sorted_by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranged = lines.join(F.broadcast(frequent), "h1", "left_anti").repartitionByRange("h1", "h2")
    rare = ranged.select("key", "place", first.alias("first")).filter("key > first").select("key", "place")
    hot = lines.join(F.broadcast(frequent), "h1", "left_semi")
    # A row for each task and frequent hash is shuffled, and a row for each frequent hash is broadcast.
    firsts = hot.groupBy("h1", "h2").agg(F.min("key").alias("first"))
    return rare.unionByName(hot.join(F.broadcast(firsts), ["h1", "h2"]).filter("key > first").select("key", "place"))


def _runs(places) -> F.Column:
    """The runs of consecutive numbers in a sorted array."""
    opens = F.filter(places, lambda x, i: (i == 0) | (F.element_at(places, F.greatest(i, F.lit(1))) != x - 1))
    closes = F.filter(places, lambda x, i: (i == F.size(places) - 1) | (F.element_at(places, F.least(i + 2, F.size(places))) != x + 1))
    return F.zip_with(opens, closes, lambda a, b: F.struct(a.alias("first"), (b - a + 1).alias("n")))


def drop_bitmaps(rows: DataFrame, store: Scratch, least_chars: int = LEAST_CHARS) -> DataFrame:
    """key, n_dropped, dropped (runs of places) of each document of (key, text) that loses lines; saved as `bitmaps`."""
    lines = store.save(line_rows(rows, least_chars), "lines")
    frequent = store.save(frequent_hashes(lines), "frequent")
    gone = later_lines(lines, frequent).groupBy("key").agg(F.sort_array(F.collect_list("place")).alias("places"))
    found = store.save(gone.select("key", F.size("places").cast("long").alias("n_dropped"), _runs(F.col("places")).cast(_RUN).alias("dropped")), "bitmaps")
    store.drop("lines", "frequent")
    return found


def kept_text(lines, n_lines, dropped) -> F.Column:
    """What is left of a text's lines, joined."""
    starts = F.concat(F.array(F.lit(0)), F.transform(dropped, lambda r: r["first"] + r["n"]))
    stops = F.concat(F.transform(dropped, lambda r: r["first"]), F.array(n_lines))
    return F.array_join(F.flatten(F.zip_with(starts, stops, lambda a, b: F.slice(lines, a + 1, b - a))), "\n")


def dedup_lines(docs: DataFrame, texts: bool = False, least_chars: int = LEAST_CHARS) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, dropped, kept_sha256; texts: and kept_text."""
    store = Scratch(docs.sparkSession, "line-dedup")
    rows, ids = keyed(docs, store)
    bitmaps = drop_bitmaps(rows, store, least_chars)
    cut = (
        rows.join(bitmaps.hint("merge"), "key", "left")
        .select("key", lines_of(F.col("text")).alias("lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), F.coalesce("dropped", F.array().cast(_RUN)).alias("dropped"))
        .select("key", F.size("lines").alias("n_lines"), "lines", "n_dropped", "dropped")
        .select("key", "n_lines", "n_dropped", "dropped", kept_text(F.col("lines"), F.col("n_lines"), F.col("dropped")).alias("kept_text"))
    )
    out = cut.select(
        "key", F.col("n_lines").cast("long").alias("n_lines"), "n_dropped", "dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"), *["kept_text"] * texts
    )
    return unkeyed(out, ids)
