"""Windows of fixed length over words or bytes, as arrays: hashes, least positions, and runs of windows that share one.

Of the short grams inside a window, the one with the least hash stands for it, the leftmost of equals. Equal windows have
their least gram at the same offset, so they can only be found among windows whose least grams are equal; consecutive
windows share theirs, so a text has few runs of them. A run carries the hash of its least gram and a digest of all it
covers."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, keyed, strings, unkeyed  # noqa: F401  (keyed and unkeyed belong to the windows' operators as well)
from .vocab import Memo, held

_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
#: Window starts of a long text that are taken at once; their places fit into the low bits of a key.
CHUNK = 1 << 23
_PLACE = np.uint64((1 << 24) - 1)
#: Most kinds of runs whose rows are broadcast, each with more than this share of all occurrences.
HOT_SHARE = 1024
RUNS = "h long, d long, key long, start int, n int"
_RUNS = pa.schema([("h", pa.int64()), ("d", pa.int64()), ("key", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit numbers over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def words_of(text: str, lower: bool = False) -> list[bytes]:
    """Words: what stands between space and the characters 9 to 13. lower: A-Z alone are lowered."""
    raw = text.encode()
    return (raw.lower() if lower else raw).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(held(("word hashes",), lambda: Memo(xxhash.xxh3_64_intdigest)).__getitem__, words), np.uint64, len(words))


def byte_hashes(raw: bytes) -> np.ndarray:
    return _BYTES[np.frombuffer(raw, np.uint8)]


@lru_cache(2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""
    found = np.empty((2, size), np.uint64)
    found[0], found[1], found[:, 0] = _BASE, _BACK, 1
    up, down = np.multiply.accumulate(found, axis=1)
    return up, down


class Sums:
    """Hashes of any stretch of a sequence from one pass over it."""

    def __init__(self, x: np.ndarray):
        up, down = _powers(1 << max(12, len(x).bit_length()))
        self.up, self.sums = up, np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * down[: len(x)])])

    def hash(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.up[start] + (stop - start).astype(np.uint64))

    def grams(self, m: int) -> np.ndarray:
        n = len(self.sums) - m
        return mix((self.sums[m:] - self.sums[:n]) * self.up[:n])


def least(keys: np.ndarray, w: int) -> np.ndarray:
    """The least of every w consecutive keys."""
    n = len(keys) - w + 1
    blocks = np.full(-(-len(keys) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    blocks[: len(keys)] = keys
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(blocks, axis=1).ravel()
    return np.minimum(ahead[:n], behind[w - 1 : w - 1 + n])


def runs(x: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """h, first window and number of windows of each run of a sequence; none if it is shorter than a window."""
    if len(x) < k:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none
    grams, windows, w = Sums(x).grams(m), len(x) - k + 1, k - m + 1
    out = []
    for at in range(0, windows, CHUNK):
        part = grams[at : min(at + CHUNK, windows) + w - 1]
        place = least((part & ~_PLACE) | np.arange(len(part), dtype=np.uint64), w) & _PLACE
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        n = np.diff(first, append=len(place))
        out.append((part[place[first].astype(np.int64)], first + at, n))
    return tuple(np.concatenate(c) for c in zip(*out))


def least_place(x: np.ndarray, n: int, k: int, m: int) -> int:
    """Where in what a run of n windows covers its least gram stands: the leftmost of the least among those all windows have."""
    return n - 1 + int(np.argmin(Sums(x).grams(m)[n - 1 : k - m + 1] & ~_PLACE))


def digests(content: np.ndarray, first: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """The digest of all that each run covers: of words by their hashes, of bytes as they are."""
    view, size = memoryview(np.ascontiguousarray(content)).cast("B"), content.itemsize
    return np.fromiter(map(xxhash.xxh3_64_intdigest, [view[a:b] for a, b in zip((first * size).tolist(), ((first + n + k - 1) * size).tolist())]), np.uint64, len(first))


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All numbers of stretches, one stretch after another."""
    return np.arange(n.sum()) + np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n)


def covered(size: int, first: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """Which places are covered by windows of length k, given as stretches of window starts."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + n + k - 1, -1)
    return np.cumsum(edge[:size]) > 0


def shared_runs(docs: DataFrame, sequence, k: int, m: int, store: Scratch) -> DataFrame:
    """The runs (h, d, key, start, n) whose least gram stands in two places or more, saved as `occurrences`.

    sequence: from a text to what is digested (its words' hashes or its bytes) and the hashes of it. Texts are walked once:
    all runs are written, their grams are counted, with a count in each task, and only then are runs joined to the repeated
    ones; a very frequent gram is a few count rows, and its runs are join rows that Spark can split."""

    def whole(batches):
        for batch in batches:
            keys, found = batch.column("key").to_numpy(zero_copy_only=False), []
            for content, x in map(sequence, strings(batch)):
                h, start, n = runs(x, k, m)
                found.append((h, digests(content, start, n, k), start, n))
            if found:
                h, d, start, n = (np.concatenate(c) for c in zip(*found))
                owner = np.repeat(keys, [len(f[0]) for f in found])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((h.view(np.int64), d.view(np.int64), owner, start, n), _RUNS.types)], schema=_RUNS)

    found = store.save(docs.mapInArrow(whole, RUNS), "runs")
    # Written, as Spark splits a join's large partitions only where both sides come from a shuffle of their own.
    repeated = store.save(found.groupBy("h").agg(F.count(F.lit(1)).alias("seen")).filter("seen > 1").select("h"), "repeated")
    occurrences = store.save(found.join(repeated, "h"), "occurrences")
    store.drop("runs", "repeated")
    return occurrences


def run_kinds(occurrences: DataFrame, store: Scratch) -> DataFrame:
    """Of each kind (h, d) of runs: n, copies, the first occurrence (key, start), and the number of kinds of its h; saved as `kinds`."""
    kinds = occurrences.groupBy("h", "d").agg(F.min(F.struct("key", "start")).alias("first"), F.max("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    kinds = store.save(kinds.select("h", "d", "n", "copies", "first.key", "first.start"), "kinds-alone")
    sizes = store.save(kinds.groupBy("h").agg(F.count(F.lit(1)).alias("kinds")), "kinds-sizes")
    return store.save(kinds.join(sizes, "h"), "kinds")


def join_kinds(occurrences: DataFrame, kinds: DataFrame, found: DataFrame) -> DataFrame:
    """Occurrences beside what was found for their kinds, by (h, d); all three are written tables.

    At most HOT_SHARE kinds can have more than 1 / HOT_SHARE of all occurrences. What was found for these is broadcast, so
    that a very frequent run is no key of a shuffle; the others are shuffled."""
    most = max(1, occurrences.count() // HOT_SHARE)
    hot = kinds.filter(F.col("copies") > most).select("h", "d")
    frequent = found.join(F.broadcast(hot), ["h", "d"], "left_semi")
    others = occurrences.join(F.broadcast(hot), ["h", "d"], "left_anti").join(found, ["h", "d"])
    return occurrences.join(F.broadcast(frequent), ["h", "d"]).unionByName(others)
