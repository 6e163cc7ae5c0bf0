"""Jaccard self-join on word shingles, in size-banded tiles with bitmap signatures.

Texts with one set are one class, named by the least key of its texts. Of a set of n shingles, a partner has all but a few;
so a set that has more shingles than that for itself alone has no partner. A share of all shingles, those with the least
hashes, is enough to tell this of most sets, and only the others go on.

Classes fall into bands of set sizes; a partner may be in the same band or the next one.
Two sets that link differ in a bounded number d of shingles, so if shingles are dealt by hash into d + 1 parts, some part
of both is the same; a tile is a band, a part and its content. Where such parts would hold few shingles, so that texts that
only share a passage often meet, there are half as many, of which some has one difference at most: such a part is dealt
into PIECES, all but one of which are the same, and a tile holds all pieces but one. (Some spare parts more than that let
tiles without shingles be left out, as long as a set has no more parts with those.) Within tiles, signatures bound the
overlap from above: a signature holds the parity of shingle counts by hash, so two sets differ in at least as many shingles
as their signatures do in bits. What passes is decided by intersecting sorted arrays.

Most tiles have one class. So tiles travel once, packed: a row holds many tiles of a shard (the leading bits of a tile),
the next TILE_BYTES of each and its text's key. A shard is read row by row, and only tiles that are there twice leave it; a
tile met twice is held as one number, so that memory goes by a shard's distinct tiles and not by the size of a tile.
Tiles that agree in these bits alone are one tile, which adds pairs to verify but loses none.

Links serve to connect. So classes are held against pivots, one of each tile and turn: the class whose tiles have most
classes first, as the text that near copies were made from shares more with each of them than they share with each other;
then the next ones. Each turn takes the tiles whose classes are not all connected yet, and pairs that are not. What is still
open after PIVOTS turns is held against all classes of the tile that it isn't connected to, in blocks of BLOCK. Near copies
of a text meet in hundreds of tiles; so classes whose tiles have the same heaviest class are a group, in which each pair is
compared once, if that is less than its tiles have pairs, and tiles only compare classes of different groups. No link
between unconnected classes is left out.

Defined results: null text counts as empty; a text without words has no shingles and is linked with nothing; a text with
fewer words than a shingle is one shingle; rows that repeat a doc_id or have none are documents of their own, null ids
last; extra columns are ignored; an empty table gives an empty result."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import windows
from .common import Scratch, strings
from .components import components

WORDS = 3
PERCENT = 90
#: A band's largest size is this many times its least, or more where linked sets may differ more in size.
BAND = 1 / 0.7
#: Parts with fewer shingles than this on average are made twice as large and dealt into so many pieces.
THIN = 5
PIECES = 4
#: Tiles that a task packs at once, tiles of a shard that are compared at once, shingles for each shard, least and most bits of a shard.
PACK = 1 << 18
SETTLE = 1 << 19
SHARD = 1 << 17
SHARD_BITS = (6, 24)
TILE_BYTES = 5
#: Longs of a signature at least, and of its fold; longs of the fine one, by which tiles only tell sets of more than LARGE shingles.
SIGNATURE = 8
FINE = 64
LARGE = 900
BLOCK = 512
#: Turns of pivots. The first takes one pivot of each class, the second the same tiles' other ones, the next ones the pivots after those.
PIVOTS = 5
#: The share of shingles that tells whether a set has too many for itself is this many times what a partner may lack.
SHARE = 2.5
#: Ids of texts that may be broadcast: 8 bytes each. Beyond it the texts are shuffled.
BROADCAST_IDS = 500_000
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
_LONGS = pa.list_(pa.int64())
_CLASSES = pa.schema([(x, pa.int64()) for x in ("key", "n", "sampled", "low", "high")])
_KNOWN = pa.schema([("class", pa.int64()), ("n", pa.int64()), *((x, _LONGS) for x in ("signature", "fold", "fine", "shingles"))])


def shingles(text: str, words: int) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles."""
    x = windows.word_hashes(windows.words_of(text, lower=True))
    if not len(x):
        return x
    size = min(words, len(x))
    found = np.full(len(x) - size + 1, size, np.uint64)
    for i in range(size):
        found = windows.mix(found + x[i : len(x) - size + 1 + i] * _SEEDS[i % len(_SEEDS)])
    return np.unique(found)


@lru_cache(4)
def bands(percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each band: its least size, the number of parts, how many of these are spare, and the pieces of a part.

    A band has about as many spare parts as have a tile without shingles in nearly all of its sets: the mean for its
    smallest sets and three deviations."""
    least, ratio = [1], max(BAND, 100 / percent)
    while least[-1] < 1 << 40:
        least.append(max(least[-1] + 1, int(least[-1] * ratio)))
    least, largest = np.array(least[:-1]), np.array(least[1:]) - 1
    differ = 2 * largest * (100 - percent) // (100 + percent)

    def dealt(enough, pieces):
        spare = np.full(len(least), 2)
        for _ in range(8):
            parts = enough + spare
            none = np.exp(-least / parts / pieces)
            bare = parts * (none**pieces + pieces * none ** (pieces - 1) * (1 - none) if pieces > 1 else none)
            spare = np.ceil(bare + 3 * np.sqrt(bare)).astype(np.int64) + 1
        return enough + spare, spare

    (parts, spare), (large, more) = dealt(differ + 1, 1), dealt(differ // 2 + 1, PIECES)
    split = (least < THIN * parts) & (large * PIECES < parts * (PIECES - 1))  # only if tiles hold more by it
    return least, np.where(differ > 0, np.where(split, large, parts), 0), np.where(split, more, spare), np.where(split, PIECES, 1)


def tiles(found: np.ndarray, percent: int) -> np.ndarray:
    """The tiles that a set falls into."""
    n, (least, parts, spares, pieces) = len(found), bands(percent)
    band, out = int(np.searchsorted(least, n, "right")) - 1, []
    for b in (band, band + 1):
        if not n or not parts[b] or b > band and 100 * n < percent * int(least[b]):
            continue  # sets that may not differ link as one class
        size, each = int(parts[b] * pieces[b]), int(pieces[b])
        piece = ((found >> np.uint64(20)) % np.uint64(size)).astype(np.uint16 if size < 65536 else np.int64)
        order = np.argsort(piece, kind="stable")
        piece = piece[order]
        opens = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
        content, filled = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        content[piece[opens]], filled[piece[opens]] = np.add.reduceat(windows.mix(found[order]), opens), 1
        content, filled = content.reshape(-1, each), filled.reshape(-1, each)
        if each > 1:  # a tile for each piece left out
            content, filled = content.sum(axis=1, keepdims=True, dtype=np.uint64) - content, filled.sum(axis=1, keepdims=True) - filled
        names = windows.mix(windows.mix(np.uint64(b << 32) + np.arange(size, dtype=np.uint64)) + content.ravel())
        full = filled.ravel() > 0
        out.append(names[full])
        if (filled == 0).any(axis=1).sum() > spares[b]:
            out.append(names[~full])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def signature(found: np.ndarray, size: int = 0) -> np.ndarray:
    """For each bit the parity of the number of shingles that hash to it, in longs: `size`, or so many that there is a bit for each shingle."""
    size = size or max(SIGNATURE, 1 << max(0, len(found) - 1).bit_length() >> 6)
    odd = np.bincount((found >> np.uint64(7)).astype(np.int64) & (64 * size - 1), minlength=64 * size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def fold(signed: np.ndarray, size: int) -> np.ndarray:
    """The signature with `size` longs of the same set."""
    return np.bitwise_xor.reduce(signed.reshape(-1, size), axis=0)


def apart(left: np.ndarray, right: np.ndarray) -> int:
    """In how many shingles two sets differ at least."""
    size = min(len(left), len(right))
    return int(np.bitwise_count((fold(left, size) ^ fold(right, size)).view(np.uint64)).sum())


def sample(found: np.ndarray, percent: int) -> np.ndarray:
    """The shingles of a set that are in the share with the least hashes."""
    share = min(1.0, SHARE * (100 - percent) / 100)
    return found if share == 1 else found[: np.searchsorted(found, np.uint64(int(share * 2**64)))]


def classes(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """key, n (shingles), sampled (those in the share), and two digests of the set."""

    def run(batches):
        for batch in batches:
            rows = []
            for key, text in zip(batch.column("key").to_pylist(), strings(batch)):
                found = shingles(text, words)
                low = np.add.reduce(windows.mix(found), dtype=np.uint64).view(np.int64)
                high = np.add.reduce(windows.mix(found ^ _SEEDS[0]), dtype=np.uint64).view(np.int64)
                rows.append((key, len(found), len(sample(found, percent)), int(low), int(high)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, _CLASSES.types)], schema=_CLASSES)

    return docs.mapInArrow(run, "key long, n long, sampled long, low long, high long")


def signed_sets(texts: DataFrame, words: int) -> DataFrame:
    """class, n, its signature, the fold of that to SIGNATURE longs, the fine one, and the sorted shingles."""

    def run(batches):
        for batch in batches:
            rows = []
            for key, text in zip(batch.column("key").to_pylist(), strings(batch)):
                found = shingles(text, words)
                signed = signature(found)
                rows.append((key, len(found), signed, fold(signed, SIGNATURE), signature(found, FINE), found.view(np.int64)))
                if len(rows) == 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _KNOWN.types)], schema=_KNOWN)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _KNOWN.types)], schema=_KNOWN)

    return texts.select("key", "text").mapInArrow(run, "class long, n long, signature array<long>, fold array<long>, fine array<long>, shingles array<long>")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts whose key is in `wanted`, which is broadcast if it is small."""
    return docs.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted, "key")


def _pack(keys: list[int], found: list[np.ndarray], bits: int) -> pa.RecordBatch:
    """Tiles by shard: the key that others are counted from, and for each tile TILE_BYTES and the distance of its key by byte planes."""
    tile, owner = np.concatenate(found), np.repeat(np.array(keys, np.int64), [len(x) for x in found])
    shard = (tile >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.int64)
    order = np.argsort(shard, kind="stable")
    shard, base = shard[order], int(owner.min())
    rest = ((tile[order] << np.uint64(bits)) >> np.uint64(64 - 8 * TILE_BYTES)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :TILE_BYTES]
    away = (owner[order] - base).astype("<u8")
    away = away.view(np.uint8).reshape(-1, 8)[:, : max(1, -(-int(away.max()).bit_length() // 8))]
    opens = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
    cuts = list(zip(opens, [*opens[1:], len(shard)]))
    columns = (shard[opens].astype(np.int32), [base] * len(cuts), [rest[i:j].tobytes() for i, j in cuts], [away[i:j].T.tobytes() for i, j in cuts])
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["shard", "base", "rest", "away"])


def _unpack(base: int, rest: bytes, away: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(rest) // TILE_BYTES
    tile, owner = np.zeros((n, 8), np.uint8), np.zeros((n, 8), np.uint8)
    tile[:, :TILE_BYTES] = np.frombuffer(rest, np.uint8).reshape(n, TILE_BYTES)
    owner[:, : len(away) // n] = np.frombuffer(away, np.uint8).reshape(-1, n).T
    return tile.view("<u8").ravel(), owner.view("<i8").ravel() + base


def _shared(texts: DataFrame, names, bits: int, tell, columns: str) -> DataFrame:
    """tell(tile, key) of the tiles that two texts or more have, in parts; names: from a text to its tiles."""

    def pack(batches):
        keys, found, size = [], [], 0
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), strings(batch)):
                own = names(text)
                if len(own):
                    keys.append(key)
                    found.append(own)
                    size += len(own)
                if size >= PACK:
                    yield _pack(keys, found, bits)
                    keys, found, size = [], [], 0
        if keys:
            yield _pack(keys, found, bits)

    def settle(held, twice):
        """What is shared among `held` or known to be, the tiles known to be shared, and what is left."""
        tile, owner = (np.concatenate(c) for c in zip(*held))
        order = np.argsort(tile, kind="stable")
        tile, owner = tile[order], owner[order]
        same = tile[1:] == tile[:-1]
        out = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        if len(twice):
            out |= twice[np.minimum(np.searchsorted(twice, tile), len(twice) - 1)] == tile
        return (tile[out], owner[out]), np.union1d(twice, tile[out]), (tile[~out], owner[~out])

    def meet(batches):
        at, held, fresh, twice = None, [], 0, np.zeros(0, np.uint64)

        def told(part):
            return pa.RecordBatch.from_arrays([pa.array(c) for c in tell(((np.uint64(at << 8 * TILE_BYTES)) + part[0]).view(np.int64), part[1])], names=[x.split()[0] for x in columns.split(", ")])

        for batch in batches:
            for shard, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (shard != at or fresh >= SETTLE):
                    part, twice, left = settle(held, twice)
                    yield told(part)
                    held, fresh = [left], 0
                if shard != at:
                    at, held, fresh, twice = shard, [], 0, np.zeros(0, np.uint64)
                held.append(_unpack(*row))
                fresh += len(held[-1][0])
        if held:
            yield told(settle(held, twice)[0])

    packed = texts.select("key", "text").mapInArrow(pack, "shard int, base long, rest binary, away binary")
    return packed.repartition("shard").sortWithinPartitions("shard").mapInArrow(meet, columns)


def _bits(total: int) -> int:
    return min(max((int(total) // SHARD).bit_length(), SHARD_BITS[0]), SHARD_BITS[1])


def shared_tiles(texts: DataFrame, words: int, percent: int, bits: int) -> DataFrame:
    """tile, class of all tiles that two texts or more have."""
    return _shared(texts, lambda text: tiles(shingles(text, words), percent), bits, lambda tile, key: (tile, key), "tile long, class long")


def shared_sample(texts: DataFrame, words: int, percent: int, bits: int) -> DataFrame:
    """key, n: how many of the sampled shingles of a text others have too, in parts to be summed."""
    return _shared(texts, lambda text: sample(shingles(text, words), percent), bits, lambda tile, key: np.unique(key, return_counts=True), "key long, n long")


def joinable(firsts: DataFrame, rows: DataFrame, words: int, percent: int, store: Scratch) -> DataFrame:
    """class, n of the classes that have not too many shingles for themselves to have a partner, saved."""
    total = firsts.agg(F.sum("sampled")).first()[0] or 0
    texts = _texts(rows, firsts.select(F.col("class").alias("key")))
    others = store.save(shared_sample(texts, words, percent, _bits(total)).groupBy("key").agg(F.sum("n").alias("others")), "others")
    enough = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1
    alone = F.col("sampled") - F.coalesce("others", F.lit(0))
    return store.save(firsts.join(others, firsts["class"] == others["key"], "left").filter(alone < enough).select("class", firsts["n"]), "joinable")


def _with(pairs: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    """The pairs (a, b) with columns of both classes."""
    side = lambda x: table.select(F.col("class").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in columns))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", *(f"{x}_{c}" for x in "ab" for c in columns))


def _longs(column) -> list[np.ndarray]:
    return [x.values.to_numpy() for x in column]


def near_pairs(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """The pairs whose signatures allow a link."""

    def run(batches):
        for batch in batches:
            differ = np.array([apart(x, y) for x, y in zip(_longs(batch.column("a_signature")), _longs(batch.column("b_signature")))], np.int64)
            both = batch.column("a_n").to_numpy() + batch.column("b_n").to_numpy()
            yield batch.select(["a", "b"]).filter(pa.array((100 + percent) * (both - differ) >= 2 * percent * both))

    return _with(pairs, known, "n", "signature").mapInArrow(run, "a long, b long")


def linked_pairs(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets link."""

    def run(batches):
        for batch in batches:
            keep = []
            for left, right in zip(_longs(batch.column("a_shingles")), _longs(batch.column("b_shingles"))):
                both = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(100 * both >= percent * (len(left) + len(right) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return _with(pairs, known, "shingles").mapInArrow(run, "a long, b long")


def linked(pairs: DataFrame, known: DataFrame, percent: int, store: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) of classes that link, saved."""
    near = store.save(near_pairs(pairs, known, percent), f"near-{name}")
    links = store.save(linked_pairs(near, known, percent), f"links-{name}")
    store.drop(f"near-{name}")
    return links


def rooted(rows: DataFrame, roots: DataFrame, column: str, name: str) -> DataFrame:
    """The rows with the root of a column's class; a class without links is its own."""
    known = roots.select(F.col("node").alias(column), F.col("root").alias(name))
    return rows.join(known, column, "left").withColumn(name, F.coalesce(name, column))


def joined_roots(roots: DataFrame, more: DataFrame, store: Scratch, name: str) -> DataFrame:
    """The roots after more links: what is connected already is one node, so that its links to another count once."""
    between = rooted(rooted(more, roots, "a", "a_root"), roots, "b", "b_root").filter("a_root <> b_root")
    tops = components(between.select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct(), store, name)
    fresh = more.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(roots, "node", "left_anti").withColumn("root", F.col("node"))
    return store.save(rooted(roots.unionByName(fresh), tops, "root", "top").select("node", F.col("top").alias("root")), f"roots-{name}")


def open_tiles(members: DataFrame, roots: DataFrame, turn: int, store: Scratch) -> DataFrame:
    """The members (tile, class, weight, root) of tiles whose classes are not all connected, with the tile's main root, its size
    and this turn's pivot (weight, class), which comes after the one of the turn before; saved."""
    rank = F.struct("weight", "class")
    next_ = rank if turn < 2 else F.when(rank < F.col("pivot"), rank)
    labelled = store.save(rooted(members.drop("root", "main", "size", "pivot_root"), roots, "class", "root"), f"labelled-{turn}")
    found = labelled.groupBy("tile").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.max_by("root", rank).alias("main"), F.count(F.lit(1)).alias("size"),
        F.max(next_).alias("pivot"), F.max_by("root", next_).alias("pivot_root"),
    )
    tops = store.save(found.filter("low < high").drop("low", "high"), f"tops-{turn}")
    out = store.save(labelled.drop("pivot").join(tops, "tile"), f"open-{turn}")
    store.drop(f"labelled-{turn}")
    return out


def pivot_pairs(opened: DataFrame, turn: int) -> DataFrame:
    """The pairs (a, b) of a class and a pivot that are not connected; in the first turn one of each class."""
    pairs = opened.filter(F.col("pivot").isNotNull() & (F.col("root") != F.col("pivot_root")))
    if turn == 0:
        pairs = pairs.groupBy("class").agg(F.max("pivot").alias("pivot"))
    found = F.col("pivot")["class"]
    return pairs.select(F.least("class", found).alias("a"), F.greatest("class", found).alias("b")).distinct()


def groups(opened: DataFrame, store: Scratch) -> tuple[DataFrame, DataFrame]:
    """The classes of open tiles by the heaviest class that they meet there, their star: (group, class, root), saved, of the
    stars that have fewer pairs in all than their tiles have together; and the open tiles that such a group doesn't hold
    whole, with each class's group."""
    rank = F.struct("weight", "class")
    tops = opened.groupBy("tile").agg(F.max(rank)["class"].alias("top"), F.max("weight").alias("most"))
    stars = opened.select("tile", "class", "root").join(tops, "tile").groupBy("class").agg(F.max(F.struct("most", "top"))["top"].alias("star"), F.first("root").alias("root"))
    stars = store.save(stars, "stars")
    # This and what follows counts pairs as doubles: a hint what is cheaper, no result.
    parts = store.save(opened.select("tile", "class").join(stars, "class").groupBy("tile", "star").agg(F.count(F.lit(1)).cast("double").alias("n")), "parts")
    by_tiles = parts.groupBy("star").agg(F.sum(F.col("n") * F.col("n")).alias("by_tiles"))
    at_once = stars.groupBy("star").agg(F.count(F.lit(1)).cast("double").alias("n")).join(by_tiles, "star").filter(F.col("n") * F.col("n") <= F.col("by_tiles")).select("star")
    held = store.save(stars.join(at_once, "star").withColumnRenamed("star", "group"), "groups")
    whole = parts.join(at_once.withColumn("held", F.lit(True)), "star", "left").groupBy("tile").agg((F.count(F.lit(1)) == 1).alias("one"), F.max_by(F.when(F.col("held"), F.col("star")), "n").alias("main_group"))
    mixed = whole.filter(~F.col("one") | F.col("main_group").isNull()).select("tile", "main_group")
    return held, opened.join(mixed, "tile").join(held.select("class", "group"), "class", "left")


def _meet(rows: DataFrame, known: DataFrame, percent: int, more) -> DataFrame:
    """The pairs (a, b) of classes of one tile, one of them on the left, that are not connected and whose folded signatures
    allow a link; rows: tile, class, root, group, size, left. more: a further condition, from the columns of a and b."""
    folds = known.select("class", "n", "fine", *(F.col("fold")[i].alias(f"s{i}") for i in range(SIGNATURE)))
    rows = rows.select("tile", "class", "root", "group", "left", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")).join(folds, "class")
    named = lambda x: [F.col(c).alias(f"{x}_{c}") for c in ("class", "root", "group", "n", "fine", *(f"s{i}" for i in range(SIGNATURE)))]
    left = rows.filter("left").select("tile", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), *named("a"))
    right = rows.select("tile", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int").alias("block"), F.col("left").alias("b_left"), *named("b"))
    differ = sum((F.bit_count(F.col(f"a_s{i}").bitwiseXOR(F.col(f"b_s{i}"))) for i in range(SIGNATURE)), F.lit(0))
    both = F.col("a_n") + F.col("b_n")
    meet = (left["tile"] == right["tile"]) & (left["block"] == right["block"]) & (~F.col("b_left") | (F.col("a_class") < F.col("b_class")))
    finely = F.aggregate(F.zip_with("a_fine", "b_fine", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    bound = lambda d: (100 + percent) * (both - d) >= 2 * percent * both
    may = more & (F.col("a_root") != F.col("b_root")) & bound(differ) & (F.col("a_fine").isNull() | F.col("b_fine").isNull() | bound(finely))
    return left.join(right, meet & may).select(F.least("a_class", "b_class").alias("a"), F.greatest("a_class", "b_class").alias("b"))


def group_pairs(held: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """The pairs of _meet of classes of one group, each once."""
    roots = held.groupBy("group", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("group").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("size"))
    rows = held.join(roots, "group").select(F.col("group").alias("tile"), "class", "root", "group", "size", (F.col("root") != F.col("main")).alias("left"))
    return _meet(rows, known, percent, F.lit(True))


def tile_pairs(mixed: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """The pairs of _meet of classes of one tile that are not of one group."""
    alone = F.when(F.col("main_group").isNull(), F.col("root") != F.col("main")).otherwise(F.coalesce(F.col("group") != F.col("main_group"), F.lit(True)))
    rows = mixed.withColumn("left", alone)
    known = known.withColumn("fine", F.when(F.col("n") > LARGE, F.col("fine")))  # most classes have many tiles
    return _meet(rows, known, percent, F.coalesce(F.col("a_group") != F.col("b_group"), F.lit(True))).distinct()


def connected(members: DataFrame, known: DataFrame, percent: int, store: Scratch) -> DataFrame:
    """node, root of the classes with links, from the members (tile, class, weight) of tiles."""
    roots = members.select(F.col("class").alias("node"), F.col("class").alias("root")).limit(0)
    opened = members
    for turn in range(PIVOTS + 1):
        opened = open_tiles(opened, roots, turn, store)
        if turn < PIVOTS:
            pairs = pivot_pairs(opened, turn)
        else:
            held, mixed = groups(opened, store)
            pairs = group_pairs(held, known, percent).union(tile_pairs(mixed, known, percent))
        more = linked(pairs, known, percent, store, str(turn))
        if more.limit(1).count():
            roots = joined_roots(roots, more, store, str(turn))
        store.drop(f"open-{turn - 1}", f"tops-{turn}")
    return roots


def jaccard_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the least doc_id that it reaches by links)."""
    store = Scratch(docs.sparkSession, "ngram-join")
    rows, ids = windows.keyed(docs, store)
    found = store.save(classes(rows, words, percent), "classes")
    firsts = store.save(found.filter("n > 0").groupBy("n", "low", "high").agg(F.min("key").alias("class"), F.max("sampled").alias("sampled")), "firsts")
    wanted = joinable(firsts, rows, words, percent, store)
    total = wanted.agg(F.sum("n")).first()[0] or 0
    shared = store.save(shared_tiles(_texts(rows, wanted.select(F.col("class").alias("key"))), words, percent, _bits(total)), "shared")
    # The weight of a class is the size of all of its tiles.
    sizes = store.save(shared.groupBy("tile").agg(F.count(F.lit(1)).alias("size")), "sizes")
    weights = store.save(shared.join(sizes, "tile").groupBy("class").agg(F.sum("size").alias("weight")), "weights")
    members = store.save(shared.join(weights, "class"), "members")
    store.drop("shared", "sizes")
    known = store.save(signed_sets(_texts(rows, weights.select(F.col("class").alias("key"))), words), "known")
    roots = connected(members, known, percent, store)
    named = firsts.join(roots.select(F.col("node").alias("class"), "root"), "class", "left").select("n", "low", "high", F.coalesce("root", "class").alias("component"))
    named = store.save(named, "named")
    out = found.join(named, ["n", "low", "high"], "left").select("key", F.col("n").alias("n_shingles"), F.coalesce("component", "key").alias("component_id"))
    if ids is not None:
        out = out.join(ids.select(F.col("key").alias("component_id"), F.col("doc_id").alias("named")), "component_id").select("key", "n_shingles", F.col("named").alias("component_id"))
    return windows.unkeyed(out, ids)
