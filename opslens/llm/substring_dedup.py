"""Removal of repeated passages of words over a de Bruijn graph.

Every k consecutive words are an edge from their first k - 1 words to their last; a text is a walk, and equal passages
are the same edges. Edges that share their least gram form short nonbranching paths (see windows.py), which compact what
is stored: copies of a whole path join its kind, whose earliest occurrence is the source. Only kinds that share a least
gram with another kind are taken apart into edges; each edge is joined to its earliest source coordinate, and edges whose
sources advance together, step by step, compact into one span again. So a span is long only as far as its coordinates
and those of its source verify it.

Of equal windows the earliest stays (smaller doc_id, then earlier start); every word covered by a later one goes.

Defined results: null text counts as empty and has no words; texts shorter than a window lose nothing; rows that repeat a
doc_id or have none are documents of their own, in order of their texts, null ids last; extra columns are ignored; an
empty table gives an empty result."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import windows
from .common import Scratch, strings

WORDS = 20
#: Words of the gram that stands for a window.
GRAM = 5
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_EDGES = pa.schema([("h", pa.int64()), ("edge", pa.int64()), ("key", pa.int64()), ("pos", pa.int32())])
_OUT = pa.schema([("key", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])


def _sequence(text: str) -> tuple[np.ndarray, np.ndarray]:
    words = windows.word_hashes(windows.words_of(text))
    return words, words


def edge_names(x: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive numbers: of one, two, four ... of them, each mixed from two halves, and of their sum."""
    n, size, part, out, done = len(x) - k + 1, 1, x, None, 0
    while True:
        if k & size:  # the stretches of this length that follow what is covered
            at = part[done : done + n]
            out, done = at if out is None else windows.mix(out * _LEFT + at * _RIGHT + np.uint64(size)), done + size
        if done == k:
            return windows.mix(out + np.uint64(k))
        part, size = windows.mix(part[:-size] * _LEFT + part[size:] * _RIGHT), 2 * size


def path_edges(docs: DataFrame, kinds: DataFrame, k: int) -> DataFrame:
    """h, edge, key, pos: the edges of the first occurrence of each kind."""
    places = kinds.groupBy("key").agg(F.collect_list(F.struct("h", "start", "n")).alias("runs"))

    def run(batches):
        for batch in batches:
            out = []
            for key, text, found in zip(batch.column("key").to_pylist(), strings(batch), batch.column("runs")):
                h, start, n = (x.to_numpy(zero_copy_only=False) for x in found.values.flatten())
                at, size = windows.spread(start.astype(np.int64), n.astype(np.int64)), n.astype(np.int64)
                edges = edge_names(_sequence(text)[0], k)[at]
                out.append((np.repeat(h, size), edges.view(np.int64), np.full(len(at), key), at))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*out), _EDGES.types)], schema=_EDGES)

    return docs.join(places, "key").mapInArrow(run, "h long, edge long, key long, pos int")


def compact(later: DataFrame) -> DataFrame:
    """key, start, n, source_key, source_start: stretches of (key, pos) whose sources (source_key, source_pos) advance with them."""
    along = Window.partitionBy("key").orderBy("pos")
    before = F.lag(F.struct("pos", "source_key", "source_pos")).over(along)
    follows = (before["pos"] == F.col("pos") - 1) & (before["source_key"] == F.col("source_key")) & (before["source_pos"] == F.col("source_pos") - 1)
    marked = later.withColumn("opens", F.when(follows, 0).otherwise(1)).withColumn("path", F.sum("opens").over(along))
    return marked.groupBy("key", "path").agg(
        F.min("pos").alias("start"), F.count(F.lit(1)).cast("int").alias("n"), F.first("source_key").alias("source_key"), F.min("source_pos").alias("source_start")
    ).drop("path")


def repeated_spans(docs: DataFrame, k: int, store: Scratch) -> DataFrame:
    """key, start, n, source_key, source_start: stretches of n window starts that occur earlier, at the source."""
    occurrences = windows.shared_runs(docs, _sequence, k, min(GRAM, k), store)
    kinds = windows.run_kinds(occurrences, store)
    source = kinds.filter("copies > 1").select("h", "d", F.col("key").alias("source_key"), F.col("start").alias("source_start"))
    copies = windows.join_kinds(occurrences, kinds, source).filter("key <> source_key or start <> source_start").select("key", "start", "n", "source_key", "source_start")
    edges = store.save(path_edges(docs, kinds.filter("kinds > 1"), k), "edges")
    first = edges.groupBy("h", "edge").agg(F.min(F.struct("key", "pos")).alias("first"), F.count(F.lit(1)).alias("places")).filter("places > 1")
    sources = store.save(first.select("h", "edge", F.col("first.key").alias("source_key"), F.col("first.pos").alias("source_pos")), "sources")
    later = edges.join(sources, ["h", "edge"])
    return copies.unionByName(compact(later.filter("key <> source_key or pos <> source_pos")))


def remove_repeats(docs: DataFrame, k: int = WORDS, texts: bool = True) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 and, if texts, kept_text (words joined by one space)."""
    store = Scratch(docs.sparkSession, "substring-dedup")
    rows, ids = windows.keyed(docs, store)
    spans = repeated_spans(rows, k, store).groupBy("key").agg(F.collect_list(F.struct("start", "n")).alias("spans"))

    def run(batches):
        for batch in batches:
            out = []
            for key, text, found in zip(batch.column("key").to_pylist(), strings(batch), batch.column("spans")):
                words, gone = windows.words_of(text), 0
                n = len(words)
                if found.is_valid:
                    start, size = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in found.values.flatten())
                    hit = windows.covered(n, start, size, k)
                    gone = int(hit.sum())
                    words = [words[i] for i in np.flatnonzero(~hit)]
                kept = b" ".join(words)
                out.append((key, n, gone, hashlib.sha256(kept).hexdigest(), kept.decode() if texts else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5, _OUT.types)], schema=_OUT)

    out = rows.join(spans, "key", "left").mapInArrow(run, "key long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return windows.unkeyed(out if texts else out.drop("kept_text"), ids)
