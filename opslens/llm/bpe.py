"""BPE encoding by speculation: greedy longest match proposes tokens, pair checks verify them, failures are merged exactly.

A sequence of tokens is what the merges give for a word if and only if every two neighbours are what the merges give for
their concatenation (and a lone token is what they give for itself). So the words of a batch that were not seen before get
the tokens of the greedy longest match; the distinct neighbour pairs of all of them are looked up, as arrays, in a sorted
table of pairs with known verdicts; pairs that it lacks are judged once by merging their concatenation; and only words
with a failing pair are merged in full.

Defined results: null text counts as empty and has no ids; special tokens inside a text get their own ids, as the
tokenizers library does by default; texts of any length are encoded whole; extra columns are ignored; an empty table gives
an empty result."""

from __future__ import annotations

import hashlib
import heapq
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import vocab
from .common import strings

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_words long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("n_words", pa.int64())])
#: Code points of texts that are split at once.
RUN_CHARS = 2_000_000
#: Parts of a word that is looked through for each merge.
SHORT = 64
#: Bytes that the memo of words holds at most.
MEMO_BYTES = 120_000_000
_FULL_SCHEMA = "doc_id long, ids array<int>, decoded string"


class Bpe:
    """A byte-level vocabulary with word ends: proposals, verdicts on pairs, exact merges."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        rules = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        #: Neighbour ids to the rank of their merge, and the id that each rank makes.
        self.rank = {(self.ids[a], self.ids[b]): r for r, (a, b) in enumerate(rules)}
        self.made = [self.ids[a + b] for a, b in rules]
        #: Every prefix of a token to its id, or to -1 where it is none.
        self.prefixes: dict[str, int] = {}
        for token in self.ids:
            for stop in range(1, len(token)):
                self.prefixes.setdefault(token[:stop], -1)
        self.prefixes.update(self.ids)
        self.map = vocab.byte_symbols()
        self.good = np.zeros(0, np.int64)  # pairs, as left << 32 | right, that stand as they are; sorted
        self.bad = np.zeros(0, np.int64)

    def symbols(self, word: str) -> list[int]:
        """The first ids of a word: its bytes, the last one with the word end."""
        out = [self.map[b] for b in word.encode()]
        out[-1] += self.end
        return [self.ids[x] for x in out if x in self.ids]

    def merge(self, parts: list[int]) -> list[int]:
        """Exact: the merge of lowest rank is applied, leftmost first, until none applies.

        A short word is looked through for each merge. Of a long one the merges that may apply stand in a heap by rank and
        place, and the parts in a linked list, so that it takes little more than a pass over it; entries whose parts have
        changed since are skipped."""
        return self._merge_short(parts) if len(parts) <= SHORT else self._merge_long(parts)

    def _merge_short(self, parts: list[int]) -> list[int]:
        get, none = self.rank.get, len(self.made)
        ranks = [get(p, none) for p in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            parts[i] = self.made[best]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = get((parts[i], parts[i + 1]), none)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        rank, made, end = self.rank, self.made, len(parts)
        parts, after, before = list(parts), list(range(1, end + 1)), list(range(-1, end - 1))
        heap = [(r, i) for i, pair in enumerate(zip(parts, parts[1:])) if (r := rank.get(pair)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j >= end or rank.get((parts[i], parts[j])) != r:
                continue
            parts[i], parts[j], k = made[r], -1, after[j]
            after[i] = k
            if k < end:
                before[k] = i
                if (r := rank.get((parts[i], parts[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := rank.get((parts[h], parts[i]))) is not None:
                heapq.heappush(heap, (r, h))
        return [x for x in parts if x >= 0]

    def token_symbols(self, token: int) -> list[int]:
        """The first ids of a token."""
        text, end = self.tokens[token], self.end
        if end and text.endswith(end) and len(text) > len(end):
            inner = text[: -len(end)]
            return [self.ids[x] for x in (*inner[:-1], inner[-1] + end)]
        return [self.ids[x] for x in text]

    def propose(self, word: str) -> list[int] | None:
        """The ids of the greedy longest match, None if it gets stuck."""
        text = "".join([self.map[b] for b in word.encode()]) + self.end
        out, at, size, get = [], 0, len(text), self.prefixes.get
        last = size - len(self.end) - 1 if self.end else size  # a token that reaches further takes the word end too
        while at < size:
            stop, token, step = at + 1, -1, at
            while stop <= size and (found := get(text[at:stop])) is not None:
                if found >= 0 and (stop <= last or stop == size):
                    token, step = found, stop
                stop += 1
            if token < 0:
                return None
            out.append(token)
            at = step
        return out

    def judge(self, pair: int) -> bool:
        """Whether the merges leave two tokens side by side; -1 on the left stands for a lone token."""
        left, right = pair >> 32, pair & 0xFFFFFFFF
        want = [right] if left < 0 else [left, right]
        try:
            return self.merge([s for t in want for s in self.token_symbols(t)]) == want
        except KeyError:  # a symbol of its own that no byte stands for
            return False

    def verdicts(self, pairs: np.ndarray) -> np.ndarray:
        """Of each distinct pair, whether it stands; new pairs are judged and remembered."""
        has = lambda known: (known[np.minimum(np.searchsorted(known, pairs), len(known) - 1)] == pairs) if len(known) else np.zeros(len(pairs), bool)
        good, bad = has(self.good), has(self.bad)
        new = pairs[~good & ~bad]
        if len(new):
            stands = np.fromiter((self.judge(int(p)) for p in new), bool, len(new))
            if len(self.good) + len(self.bad) > 4_000_000:
                self.good = self.bad = np.zeros(0, np.int64)
            self.good, self.bad = np.union1d(self.good, new[stands]), np.union1d(self.bad, new[~stands])
            good[~good & ~bad] = stands
        return good

    def encode_words(self, words: list[str]) -> list[list[int]]:
        found = [self.propose(w) for w in words]
        kept = [i for i, x in enumerate(found) if x]
        if kept:
            sizes = np.array([len(found[i]) for i in kept])
            flat = np.fromiter((t for i in kept for t in found[i]), np.int64, int(sizes.sum()))
            owner = np.repeat(np.array(kept), sizes)
            left = np.concatenate([[-1], flat[:-1]])
            first = np.concatenate([[True], owner[1:] != owner[:-1]])
            left[first] = -1
            # A first token needs no check of its own if a pair follows, as that pair's merges give it back.
            wanted = ~first | np.repeat(sizes == 1, sizes)
            pairs = (left[wanted] << 32) | flat[wanted]
            distinct, at = np.unique(pairs, return_inverse=True)
            for i in np.unique(owner[wanted][~self.verdicts(distinct)[at]]):
                found[i] = None
        return [self.merge(self.symbols(w)) if x is None else x for w, x in zip(words, found)]


class Words(dict):
    """The memo of a worker: words to what they give, bounded by bytes. A full one becomes the old one."""

    def __init__(self, bpe: Bpe):
        self.bpe, self.size, self.old = bpe, 0, {}

    def learn(self, words: set[str]) -> None:
        """Holds all of these words from now on: their ids and decoded text, joined, and the number of ids."""
        if self.size > MEMO_BYTES:
            self.old, self.size = dict(self), 0
            self.clear()
        new = [w for w in words if w not in self and w not in self.old]
        found = {w: self.old[w] for w in words if w in self.old and w not in self}
        for word, ids in zip(new, self.bpe.encode_words(new)):
            if word in self.bpe.special:
                ids = [self.bpe.special[word]]
            found[word] = (" ".join(map(str, ids)), " ".join([self.bpe.tokens[i] for i in ids]), len(ids))
        self.update(found)
        self.size += sum(len(w) + len(x[0]) + len(x[1]) + 2 * vocab.ENTRY_BYTES for w, x in found.items())


def _worker(path: str) -> Words:
    """The worker's memo with its vocabulary; it outlives a task."""
    return vocab.held(("bpe", path), lambda: Words(Bpe(path)))


def pieces(text: str, bpe: Bpe) -> list[str]:
    """The words of a text in order; special tokens stand as they are."""
    if vocab.is_plain(text):
        return vocab.end_words(text)
    return _odd_pieces(text, bpe)


def _odd_pieces(text: str, bpe: Bpe) -> list[str]:
    """Words of texts with rare characters or special tokens, split by the library's own classes."""
    tok, out = vocab.tokenizer(bpe.path), []
    for part in re.split("(" + "|".join(map(re.escape, bpe.special)) + ")", text) if bpe.special else [text]:
        if part in bpe.special:
            out.append(part)
        elif part:
            lower = tok.normalizer.normalize_str(part)
            out += [lower[a:b] for _, (a, b) in tok.pre_tokenizer.pre_tokenize_str(lower)]
    return out


def _encoded(batch, path: str):
    """Of runs of rows of a batch: their doc_ids, their texts' words, and the memo of (ids, decoded, number) by word."""
    memo = _worker(path)
    doc_ids, texts = batch.column("doc_id").to_pylist(), strings(batch)
    at = 0
    while at < len(texts):
        chars, first, words = 0, at, []
        while at < len(texts) and chars < RUN_CHARS:
            chars += len(texts[at])
            words.append(pieces(texts[at], memo.bpe))
            at += 1
        memo.learn({w for found in words for w in found})
        yield doc_ids[first:at], words, memo


def encode_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, ids, decoded of every document."""

    def run(batches):
        for batch in batches:
            for doc_ids, texts, memo in _encoded(batch, tokenizer_path):
                ids = [[int(i) for w in words for i in memo[w][0].split()] for words in texts]
                decoded = [" ".join(memo[w][1] for w in words if memo[w][2]) for words in texts]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, _FULL_SCHEMA)


def encode_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_words: the digests of what encode_documents() gives, made in the same task."""

    def run(batches):
        sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
        for batch in batches:
            for doc_ids, texts, memo in _encoded(batch, tokenizer_path):
                rows = []
                for doc_id, words in zip(doc_ids, texts):
                    found = [x for x in map(memo.__getitem__, words) if x[2]]
                    rows.append((doc_id, sum(x[2] for x in found), sha(" ".join([x[0] for x in found])), sha(" ".join([x[1] for x in found])), len(words)))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
