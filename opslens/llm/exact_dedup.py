"""Exact deduplication against a minimal perfect hash of historical digests.

The history holds one entry per distinct digest that earlier rows had. Entries are dealt into buckets by the first bits of
the digest, so that a bucket has a bounded number of entries at any corpus size, and each bucket has its own minimal
perfect hash: levels of bit arrays in which a key stands where no other key of its level does; its slot is the rank of
its bit. A slot holds the full digest and the locator of the winner. New rows are first combined by digest, so that a hot
group costs one row per task; a lookup computes the slot and compares the whole digest, as a nonmember also hashes to
some slot. Nonmembers form groups of their own.

Defined results: null text counts as empty, all empty texts are one group; of equal texts the longest original stays,
then the smallest doc_id; rows with a null doc_id come last among equals; where ids are null or repeat, rows are numbered by
doc_id and text, each counts for itself, and of equal ones the first number stays, so that one row of a group stays whatever
its ids; extra columns are ignored; an empty table gives an empty result."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, clean, keyed

#: Distinct digests that a bucket has on average.
BUCKET_KEYS = 16_384
#: Bits per key of a level; more bits leave fewer keys to the next level.
GAMMA = 2.0
_WINNER = "struct<n_chars:bigint,neg_id:bigint>"
_HISTORY = "bucket long, n_keys long, sizes array<int>, bits binary, digests binary, winner_id array<bigint>, winner_chars array<bigint>, copies array<bigint>"


def normalised(column: str = "text"):
    """The text without white space."""
    return F.regexp_replace(clean(column), "[\\x20\\x09-\\x0D]+", "")


def digest_rows(rows: DataFrame) -> DataFrame:
    """key, text_sha256, n_chars of the original text, and whether the row belongs to the history, of (key, text, historical)."""
    return rows.select(
        "key",
        F.sha2(normalised().cast("binary"), 256).alias("text_sha256"),
        F.length("text").cast("long").alias("n_chars"),
        F.coalesce("historical", F.lit(False)).alias("historical"),
    )


def _grouped(rows: DataFrame, buckets: int) -> DataFrame:
    """One row per digest: bucket, winner and number of copies."""
    best = F.max(F.struct("n_chars", (-F.col("key")).alias("neg_id")))
    return (
        rows.groupBy("text_sha256")
        .agg(best.alias("best"), F.count(F.lit(1)).alias("copies"))
        .select(
            F.pmod(F.conv(F.substring("text_sha256", 1, 8), 16, 10).cast("long"), F.lit(buckets)).alias("bucket"),
            "text_sha256",
            (-F.col("best.neg_id")).alias("winner_id"),
            F.col("best.n_chars").alias("winner_chars"),
            "copies",
        )
    )


def _as_bytes(hexes: pa.ChunkedArray) -> np.ndarray:
    """Digests as rows of 32 bytes."""
    return np.frombuffer(bytes.fromhex("".join(hexes.to_pylist())), np.uint8).reshape(-1, 32)


def _position(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    """The place of each digest in the bit array of a level: another mix of its words for every level."""
    words = keys.view("<u8")
    mixed = (words[:, 1] ^ np.uint64((level * 0x9E3779B97F4A7C15 + 1) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= words[:, 2 + level % 2] + (mixed >> np.uint64(29))
    mixed *= np.uint64(0x94D049BB133111EB)
    return ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(size)).astype(np.int64)


def build_hash(keys: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Sizes of the levels, and their bits one after another."""
    sizes, bits, left, level = [], [], np.ascontiguousarray(keys), 0
    while len(left):
        size = max(8, int(GAMMA * len(left)))
        at = _position(left, level, size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        left, level = np.ascontiguousarray(left[~alone[at]]), level + 1
    return sizes, np.concatenate(bits) if bits else np.zeros(0, bool)


def slots(keys: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """The slot of each key, -1 if no level has its bit. A key that was not built in may get any slot."""
    rank, out, base = np.cumsum(bits) - 1, np.full(len(keys), -1, np.int64), 0
    for level, size in enumerate(sizes):
        open_ = np.flatnonzero(out < 0)
        if not len(open_):
            break
        at = base + _position(np.ascontiguousarray(keys[open_]), level, size)
        hit = bits[at]
        out[open_[hit]] = rank[at[hit]]
        base += size
    return out


def _build(entries: pa.Table) -> pa.Table:
    keys = _as_bytes(entries["text_sha256"])
    sizes, bits = build_hash(keys)
    order = np.argsort(slots(keys, sizes, bits))
    column = lambda name: [entries[name].to_numpy(zero_copy_only=False)[order]] if not entries[name].null_count else [entries[name].take(pa.array(order)).to_pylist()]
    return pa.table(
        {
            "bucket": pa.array([entries["bucket"][0].as_py()], pa.int64()),
            "n_keys": pa.array([len(keys)], pa.int64()),
            "sizes": pa.array([sizes], pa.list_(pa.int32())),
            "bits": pa.array([np.packbits(bits).tobytes()], pa.binary()),
            "digests": pa.array([keys[order].tobytes()], pa.binary()),
            **{name: pa.array(column(name), pa.list_(pa.int64())) for name in ("winner_id", "winner_chars", "copies")},
        }
    )


def build_history(rows: DataFrame, buckets: int) -> DataFrame:
    """One row per bucket: its perfect hash and its slots, in the order of the slots."""
    return _grouped(rows, buckets).groupBy("bucket").applyInArrow(_build, _HISTORY)


_VERDICT = pa.schema([("text_sha256", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("member", pa.bool_())])


def _lookup(history: pa.Table, news: pa.Table) -> pa.Table:
    """Verdicts on all digests of a bucket, the history's and the new ones."""
    keys = _as_bytes(news["text_sha256"]) if news.num_rows else np.zeros((0, 32), np.uint8)
    new_id, new_chars, new_copies = (news[x].to_pylist() if news.num_rows else [] for x in ("winner_id", "winner_chars", "copies"))
    hexes = news["text_sha256"].to_pylist() if news.num_rows else []
    out: dict[str, list] = {x: [] for x in _VERDICT.names}

    def tell(*row):
        for name, value in zip(_VERDICT.names, row):
            out[name].append(value)

    found = np.full(len(keys), -1, np.int64)
    if history.num_rows:
        stored = np.frombuffer(history["digests"][0].as_py(), np.uint8).reshape(-1, 32)
        sizes = history["sizes"][0].as_py()
        bits = np.unpackbits(np.frombuffer(history["bits"][0].as_py(), np.uint8), count=sum(sizes)).astype(bool)
        ids, chars, copies = (history[x][0].as_py() for x in ("winner_id", "winner_chars", "copies"))
        if len(keys):
            at = slots(keys, sizes, bits)
            same = (at >= 0) & (stored[at] == keys).all(axis=1)
            found[same] = at[same]
        repeat = {int(slot): i for i, slot in enumerate(found) if slot >= 0}
        for slot in range(len(ids)):
            i = repeat.get(slot)
            if i is None:
                tell(stored[slot].tobytes().hex(), ids[slot], copies[slot], True)
                continue
            best = max(((c, x is not None, -(x or 0)), x) for c, x in ((chars[slot], ids[slot]), (new_chars[i], new_id[i])))
            tell(hexes[i], best[1], copies[slot] + new_copies[i], True)
    for i in np.flatnonzero(found < 0):
        tell(hexes[i], new_id[i], new_copies[i], False)
    return pa.table(out, schema=_VERDICT)


def look_up(history: DataFrame, news: DataFrame, buckets: int) -> DataFrame:
    """text_sha256, keep_id, group_size, member (of the history): one row per distinct digest of either side."""
    return (
        history.groupBy("bucket")
        .cogroup(_grouped(news, buckets).groupBy("bucket"))
        .applyInArrow(_lookup, "text_sha256 string, keep_id long, group_size long, member boolean")
    )


def exact_dedup(docs: DataFrame, historical=None, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, member.

    historical: boolean column that marks the rows an earlier run has seen; about every other row, by its id, by default.
    Every row takes part either way: the split only decides which digests go into the perfect hash. Both sides are dealt
    into the same buckets, so their number comes from the digests of both."""
    if historical is None:
        historical = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    store = Scratch(docs.sparkSession, "exact-dedup")
    texts, ids = keyed(docs, store, historical.alias("historical"))
    rows = store.save(digest_rows(texts), "digests")
    keys = rows.agg(F.approx_count_distinct("text_sha256")).first()[0]
    buckets = max(1, -(-keys // bucket_keys))
    history = store.save(build_history(rows.filter("historical"), buckets), "history")
    verdicts = look_up(history, rows.filter("not historical"), buckets).withColumnRenamed("keep_id", "keep_key")
    if ids is None:
        told = rows.withColumn("doc_id", F.col("key")).join(verdicts.withColumn("keep_id", F.col("keep_key")), "text_sha256")
    else:  # one row a digest meets the numbers' ids, so a large group is no key of that join
        told = rows.join(ids, "key").join(verdicts.join(ids.select(F.col("key").alias("keep_key"), F.col("doc_id").alias("keep_id")), "keep_key"), "text_sha256")
    return told.select("doc_id", "keep_id", "group_size", (F.col("key") == F.col("keep_key")).alias("kept"), "text_sha256", "member")
