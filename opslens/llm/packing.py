"""Packing documents into sequences by vector bin packing with the dot-product heuristic.

A document is its ids and a closing id. Whole multiples of the sequence length are sequences of their own; what is left
of a document is an item with three demands: tokens, segments (one) and loss-bearing tokens (all but the closing id, or
those that a mask column of the caller marks). Sequences are filled one at a time: of the items that fit, the one whose demands have the
largest dot product with the room that is left goes in; if none fits, the largest item is cut at the room that is left.
The last sequence of a partition is cut at powers of two, at which no padding is needed.

Each task packs what it reads, with a bounded pool of open items, so that nothing is shuffled and no group grows with the
input. Sequence ids are the partition's number in the upper bits and a count in the lower ones.

Defined results: null text counts as empty and is its closing id alone; documents of any length are cut freely; repeated
rows are packed once each; extra columns are ignored; an empty table gives an empty result."""

from __future__ import annotations

import itertools
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import vocab
from .common import strings

SEQUENCE = 1024
MAX_SEGMENTS = 256
#: Bytes of the memo of words: texts have a long tail of words, and one that comes back after the memo has dropped it is encoded anew.
MEMO_BYTES = 100_000_000
#: Items that a task keeps open; each is shorter than a sequence.
POOL = 1024
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
_ARROW = pa.schema([(x.split()[0], pa.int64()) for x in SCHEMA.split(", ")])


class Packer:
    """Items in, pieces out; the pieces of a sequence come together."""

    def __init__(self, first_id: int, sequence: int, max_segments: int, max_loss: int):
        self.limits = np.array([sequence, max_segments, max_loss], np.float64)
        self.sequence, self.next_id = sequence, first_id
        self.items: list[tuple] = []  # doc_id, start, ids, doc_tokens, loss mask
        self.out: list[tuple] = []

    def piece(self, doc_id, start, ids, total, mask, at: int) -> None:
        self.out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next_id, at, int(np.count_nonzero(mask))))

    def add(self, doc_id, ids: np.ndarray, mask: np.ndarray | None = None) -> None:
        """Takes a document; its mask tells which ids bear loss, all but the last one by default."""
        total, at, most = len(ids), 0, int(self.limits[2])
        if mask is None:
            mask = np.arange(total) < total - 1
        sums = None if total <= min(self.sequence, most) else np.concatenate([[0], np.cumsum(mask)])
        while at < total:
            end = total if sums is None else min(total, at + self.sequence, int(np.searchsorted(sums, sums[at] + most, "right")) - 1)
            if end - at == self.sequence:
                self.piece(doc_id, at, ids[at:end], total, mask[at:end], 0)
                self.next_id += 1
            else:
                self.items.append((doc_id, at, ids[at:end], total, mask[at:end]))
            at = end

    def pack(self, least: int) -> None:
        """Fills sequences until fewer than `least` items are open."""
        if len(self.items) < max(least, 1):
            return
        items = self.items
        need = np.array([(len(x[2]), 1, np.count_nonzero(x[4])) for x in items], np.float64)
        open_ = np.ones(len(items), bool)
        weights = 1 / self.limits**2
        while open_.sum() >= max(least, 1):
            room, held = self.limits.copy(), []
            while room[0] > 0 and room[1] > 0:
                fits = open_ & (need[:, 0] <= room[0]) & (need[:, 1] <= room[1]) & (need[:, 2] <= room[2])
                if fits.any():
                    i = int(np.argmax(np.where(fits, need @ (room * weights), -1)))
                    held.append(items[i])
                    room -= need[i]
                    open_[i] = False
                    continue
                if not open_.any() or room[2] <= 0:
                    break
                i = int(np.argmax(np.where(open_, need[:, 0], -1)))
                doc_id, start, ids, total, mask = items[i]
                cut = int(min(room[0], np.searchsorted(np.cumsum(mask), room[2], "right"), len(ids) - 1))
                if cut <= 0:
                    break
                loss = np.count_nonzero(mask[:cut])
                held.append((doc_id, start, ids[:cut], total, mask[:cut]))
                room -= (cut, 1, loss)
                items[i] = (doc_id, start + cut, ids[cut:], total, mask[cut:])
                need[i] -= (cut, 0, loss)
            self.place(held)
        self.items = [x for x, o in zip(items, open_) if o]

    def place(self, held: list[tuple]) -> None:
        """One sequence, or several at powers of two where it would need padding."""
        left = sum(len(x[2]) for x in held)
        whole = left == self.sequence
        room = left if whole else 1 << (left.bit_length() - 1)
        at = 0
        for doc_id, start, ids, total, mask in held:
            while len(ids):
                part = ids[: room - at]
                self.piece(doc_id, start, part, total, mask[: len(part)], at)
                at, start, ids, mask = at + len(part), start + len(part), ids[len(part) :], mask[len(part) :]
                if at == room:
                    left -= room
                    self.next_id, at = self.next_id + 1, 0
                    room = 1 << (left.bit_length() - 1) if left else 0


def pack_sequences(
    docs: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE, max_segments: int = MAX_SEGMENTS, max_loss: int | None = None, closing_id: int = 0, pool: int = POOL, loss: str | None = None
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens.

    loss: column with an array of one boolean or number per id, without the closing id, that marks ids that bear loss; where
    it is null, all do."""
    most_loss = sequence if max_loss is None else max_loss

    def run(batches):
        split, tok = vocab.word_split(tokenizer_path), vocab.tokenizer(tokenizer_path)
        encode = lambda text: np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        memo = _memo(tokenizer_path)
        closing = np.array([closing_id], "<u4").tobytes()
        packer = Packer(TaskContext.get().partitionId() << 33, sequence, max_segments, most_loss)

        def rows():
            found = packer.out
            packer.out = []
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*found) if found else [()] * len(_ARROW))], schema=_ARROW)

        for batch in batches:
            masks = batch.column(loss).to_pylist() if loss else itertools.repeat(None)
            for doc_id, text, mask in zip(batch.column("doc_id").to_pylist(), strings(batch), masks):
                ids = b"".join(map(memo.__getitem__, split(text))) if vocab.is_plain(text) else encode(text)
                ids = np.frombuffer(ids + closing, "<u4")
                if mask is not None and len(mask) != len(ids) - 1:
                    raise ValueError(f"document {doc_id} has {len(ids) - 1} ids, its loss mask {len(mask)}")
                packer.add(doc_id, ids, None if mask is None else np.array([*mask, 0], bool))
                if len(packer.items) >= 2 * pool:
                    packer.pack(pool)
                if len(packer.out) > 20_000:
                    yield rows()
            yield rows()
        packer.pack(0)
        yield rows()

    return docs.select("doc_id", "text", *([loss] if loss else [])).mapInArrow(run, SCHEMA)


def _memo(path: str) -> vocab.Memo:
    """The worker's memo of words to ids as bytes; it outlives a task."""

    def make():
        ids = vocab.word_ids(path)
        return vocab.Memo(lambda word: struct.pack(f"<{len(found := ids(word))}I", *found), MEMO_BYTES)

    return vocab.held(("packing", path), make)
