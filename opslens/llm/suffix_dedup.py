"""Removal of byte strings that occur twice or more, by common prefixes from a Burrows-Wheeler transform.

Equal windows of k bytes have the same least gram (see windows.py), so only runs whose least gram is repeated matter, and
of equal runs only one needs its bytes. The runs of a least gram go to one bucket of bounded size. A bucket's bytes are
sorted by their first k bytes, which gives its Burrows-Wheeler transform, and common prefixes are derived by increasing
length: an interval of all suffixes that begin with a string is extended backward by every byte that precedes it; each new
right end that has no value yet gets the length of the string, and its interval is queued for the next length. At length k
it stops: neighbours without a value share k bytes or more.

A least gram with very many kinds of runs (HOT_KINDS) would make a bucket that no task can hold, so its runs are split by
a second, longer gram: windows with the first gram at the same few offsets share what lies between, and only pieces that
share that too go together. The offsets are halved until no gram is too frequent; at one offset the gram is the whole
window. Pieces whose grams and contents are equal are copies, of which one is sorted, as with runs.

Defined results: null text counts as empty; matches never cross documents; texts shorter than a window lose nothing; all
occurrences of a repeated string go, overlapping ones too; rows that repeat a doc_id or have none are documents of their
own; bytes that are left are hashed as they are, as they need not be whole characters; extra columns are ignored; an
empty table gives an empty result."""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import windows
from .common import Scratch, strings

BYTES = 200
#: Bytes of the gram that stands for a window.
GRAM = 80
#: Kinds of runs in a bucket on average, and most kinds of one least gram in a bucket.
BUCKET_KINDS = 4096
HOT_KINDS = 1024
_PIECES = pa.schema([("h", pa.int64()), ("d", pa.int64()), ("off", pa.int32()), ("n", pa.int32()), ("place", pa.int32()), ("g", pa.int64()), ("e", pa.int64()), ("bytes", pa.binary())])
_PIECE = "h long, d long, off int, n int, place int, g long, e long, bytes binary"
_HITS = pa.schema([("h", pa.int64()), ("d", pa.int64()), ("off", pa.int32()), ("n", pa.int32())])
_OUT = pa.schema([("key", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept_bytes", pa.binary())])


def _sequence(text: str) -> tuple[np.ndarray, np.ndarray]:
    raw = text.encode()
    return np.frombuffer(raw, np.uint8), windows.byte_hashes(raw)


def sort_suffixes(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Starts of suffixes in the order of their first `depth` symbols."""
    bits = max(1, int(symbols.max()).bit_length())
    have = min(depth, 63 // bits)
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(have, np.int64)])
    key = np.zeros(len(symbols), np.int64)
    for i in range(have):
        key = (key << bits) | padded[i : i + len(symbols)]
    while True:
        order = np.argsort(key)
        rank = np.empty(len(key), np.int64)
        rank[order] = np.cumsum(np.concatenate([[1], key[order][1:] != key[order][:-1]]))
        if have >= depth or rank[order[-1]] == len(key):
            return order
        step = min(have, depth - have)
        ahead = np.zeros(len(key), np.int64)
        ahead[: len(key) - step] = rank[step:]
        key = rank * (len(key) + 1) + ahead
        have += step


def prefix_bounds(transform: np.ndarray, least: int) -> np.ndarray:
    """For each place between two sorted suffixes their common prefix if it is under `least`, else -1; symbol 0 ends texts.

    transform: the symbol before each suffix, in sorted order."""
    n = len(transform)
    back = np.argsort(transform, kind="stable")
    step = np.empty(n, np.int64)  # where the suffix that is longer by the symbol before stands
    step[back] = np.arange(n)
    same = transform[back[1:]] == transform[back[:-1]]
    ahead, behind = np.full(n, n), np.full(n, -1)  # the next and the last place with the same symbol
    ahead[back[:-1][same]] = back[1:][same]
    behind[back[1:][same]] = back[:-1][same]
    common = np.full(n + 1, -1)
    common[[0, n]] = 0
    first, end = np.array([0]), np.array([n])
    for length in range(least):
        if not len(first):
            break
        size = end - first
        at = windows.spread(first, size)
        inside = transform[at] != 0 if length else np.ones(n, bool)
        opens = at[inside & (behind[at] < np.repeat(first, size))]
        closes = at[inside & (ahead[at] >= np.repeat(end, size))]
        # Both are in the order of symbol and interval after the step, so they pair up.
        first, end = np.sort(step[opens]), np.sort(step[closes]) + 1
        new = common[end] < 0
        common[end[new]] = length
        if not length:  # the last symbol's interval ends where all do
            new[-1] = True
        first, end = first[new], end[new]
    return common


def repeated_windows(texts: list[bytes], k: int) -> np.ndarray:
    """Whether the k bytes from each place of the texts, joined with one place after each, occur twice or more."""
    joined = np.concatenate([x for t in texts for x in (np.frombuffer(t, np.uint8).astype(np.int32) + 1, np.zeros(1, np.int32))])
    symbols = np.unique(joined, return_inverse=True)[1].astype(np.uint16)  # 0 is the end of a text
    order = sort_suffixes(symbols, k)
    common = prefix_bounds(symbols[order - 1], k)
    alike = common < 0
    out = np.zeros(len(symbols), bool)
    out[order] = alike[:-1] | alike[1:]
    return out


def _bucket_hits(k: int):
    def run(table: pa.Table) -> pa.Table:
        texts = table["bytes"].to_pylist()
        found = repeated_windows(texts, k)
        sizes = np.array([len(t) + 1 for t in texts])
        starts, n = np.concatenate([[0], np.cumsum(sizes)[:-1]]), table["n"].to_numpy().astype(np.int64)
        at = windows.spread(starts, n)
        owner, off = np.repeat(np.arange(len(texts)), n), at - np.repeat(starts, n)
        hit = found[at]
        edge = np.flatnonzero(np.concatenate([[True], (hit[1:] != hit[:-1]) | (owner[1:] != owner[:-1])]))
        size = np.diff(edge, append=len(hit))
        edge, size = edge[hit[edge]], size[hit[edge]]
        rows, first = pa.array(owner[edge]), table["off"].to_numpy().astype(np.int64)[owner[edge]] + off[edge]
        return pa.table([table["h"].take(rows), table["d"].take(rows), pa.array(first, pa.int32()), pa.array(size, pa.int32())], schema=_HITS)

    return run


def _at_kinds(docs: DataFrame, kinds: DataFrame) -> DataFrame:
    """key, text and the kinds of runs whose first occurrence the text has, with the number of kinds of their grams."""
    return docs.join(kinds.groupBy("key").agg(F.collect_list(F.struct("h", "d", "start", "n", "kinds")).alias("runs")), "key")


def _columns(found) -> list[np.ndarray]:
    return [x.to_numpy(zero_copy_only=False).astype(np.int64) for x in found.values.flatten()]


def segments(docs: DataFrame, kinds: DataFrame, k: int) -> DataFrame:
    """Each kind of run as one piece of itself, with what it covers; its gram is g, whose place isn't known yet."""

    def run(batches):
        for batch in batches:
            for text, found in zip(strings(batch), batch.column("runs")):
                raw, (h, d, start, n, many) = text.encode(), _columns(found)
                cut = [raw[a : a + m + k - 1] for a, m in zip(start.tolist(), n.tolist())]
                none = np.zeros(len(n), np.int64)
                columns = (h, d, none, n, none - 1, h, d, cut, many)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    schema = _PIECES.append(pa.field("kinds", pa.int64()))
    return _at_kinds(docs, kinds).mapInArrow(run, _PIECE + ", kinds long")


def split(pieces: DataFrame, k: int, m: int, width: int) -> DataFrame:
    """Pieces by where in a window the first gram stands, in stretches of `width` offsets; g: the hash of what all windows
    with the gram at these offsets share, e: that of the piece. off, n: the windows of the run that a piece has."""

    def run(batches):
        for batch in batches:
            out, names = [], []
            for h, d, off, n, place, raw in zip(*(batch.column(c).to_pylist() for c in ("h", "d", "off", "n", "place", "bytes"))):
                if place < 0:
                    place = windows.least_place(windows.byte_hashes(raw), n, k, m)
                for cell in range((place - n + 1) // width, place // width + 1):
                    low, high = cell * width, min(cell * width + width - 1, k - m)
                    a, b = max(place - n + 1, low), min(place, high)
                    cut = raw[place - b : place - a + k]
                    names.append((xxhash.xxh3_64_intdigest(raw[place - low : place - high + k], cell), xxhash.xxh3_64_intdigest(cut)))
                    out.append((h, d, off + place - b, b - a + 1, b, cut))
            g, e = np.array(names, np.uint64).reshape(-1, 2).view(np.int64).T
            h, d, off, n, place, cut = zip(*out) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((h, d, off, n, place, g, e, cut), _PIECES.types)], schema=_PIECES)

    return pieces.mapInArrow(run, _PIECE)


def narrowed(pieces: DataFrame, k: int, m: int, store: Scratch) -> tuple[list[DataFrame], list[DataFrame]]:
    """From pieces with the number of `kinds` of their gram: pieces of grams with HOT_KINDS kinds or fewer, after as many
    splits as that takes, and h, d, off, n of all pieces that occur twice."""
    ready, copies, width = [], [], k - m + 1
    while True:
        hot = F.col("kinds") > (HOT_KINDS if width > 1 else 1 << 62)
        ready.append(pieces.filter(~hot))
        if not pieces.filter(hot).limit(1).count():
            return ready, copies
        width = -(-width // 2)
        parts = store.save(split(pieces.filter(hot), k, m, width), f"parts-{width}")
        alike = parts.groupBy("g", "e").agg(F.min(F.struct("h", "d", "off")).alias("first"), F.count(F.lit(1)).alias("copies"))
        alike = store.save(alike.select("g", "e", "first.h", "first.d", "first.off", "copies"), f"alike-{width}")
        sizes = store.save(alike.groupBy("g").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1"), f"sizes-{width}")
        copies.append(parts.join(alike.filter("copies > 1").select("g", "e"), ["g", "e"]).select(*_HITS.names))
        one = parts.join(alike.drop("copies"), ["g", "e", "h", "d", "off"])
        pieces = store.save(one.join(sizes, "g").select(*_PIECES.names, "kinds"), f"pieces-{width}")


def repeated_spans(docs: DataFrame, k: int, store: Scratch) -> DataFrame:
    """key, start, n: stretches of n window starts that occur twice or more."""
    m = min(GRAM, k)
    occurrences = windows.shared_runs(docs, _sequence, k, m, store)
    kinds = windows.run_kinds(occurrences, store)
    mixed = kinds.filter("kinds > 1")
    pieces = store.save(segments(docs, mixed, k), "pieces")
    ready, copies = narrowed(pieces, k, m, store)
    ready = reduce(DataFrame.unionByName, ready)
    buckets = max(1, -(-ready.count() // BUCKET_KINDS))
    hits = ready.withColumn("bucket", F.pmod(F.xxhash64("g"), F.lit(buckets))).groupBy("bucket").applyInArrow(_bucket_hits(k), "h long, d long, off int, n int")
    whole = kinds.filter("copies > 1").select("h", "d", F.lit(0).alias("off"), "n")
    found = store.save(reduce(DataFrame.unionByName, copies, hits.unionByName(whole)).withColumnRenamed("n", "size"), "found")
    return windows.join_kinds(occurrences, kinds, found).select("key", (F.col("start") + F.col("off")).alias("start"), F.col("size").alias("n"))


def remove_repeats(docs: DataFrame, k: int = BYTES, contents: bool = True) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if contents, kept_bytes."""
    store = Scratch(docs.sparkSession, "suffix-dedup")
    rows, ids = windows.keyed(docs, store)
    spans = repeated_spans(rows, k, store).groupBy("key").agg(F.collect_list(F.struct("start", "n")).alias("spans"))

    def run(batches):
        for batch in batches:
            out = []
            for key, text, found in zip(batch.column("key").to_pylist(), strings(batch), batch.column("spans")):
                raw, gone, cuts = text.encode(), 0, 0
                n = len(raw)
                if found.is_valid:
                    hit = windows.covered(n, *_columns(found), k)
                    gone, cuts = int(hit.sum()), int(hit[0]) + int((hit[1:] & ~hit[:-1]).sum())
                    raw = np.frombuffer(raw, np.uint8)[~hit].tobytes()
                out.append((key, n, gone, cuts, hashlib.sha256(raw).hexdigest(), raw if contents else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 6, _OUT.types)], schema=_OUT)

    out = rows.join(spans, "key", "left").mapInArrow(run, "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary")
    return windows.unkeyed(out if contents else out.drop("kept_bytes"), ids)
