"""Tokenizer vocabularies inside tasks: texts are split into words once, and each distinct word is encoded once per worker.

A word is a pre-token of the tokenizer. The library encodes pre-tokens one by one, so the ids of a text are the ids of
its words in order. Texts with characters that Python's classes and the library's sort differently, or with special
tokens, go to the library whole. A memo holds a bounded number of
bytes and starts anew when it is full; a worker keeps the memos of one operator at a time."""

from __future__ import annotations

import os
import re
import unicodedata
from functools import lru_cache

#: Texts with none of these are split alike by Python and by the library: letters and digits are the same, and so is lower case.
_SPECIAL = r"<\|(?:startof|endof)text\|>"
#: The words of the byte-level tokenizers. Letters come first, as most words are letters, and no other alternative begins with one;
#: those of ASCII are told by a set, which is faster than classes.
BYTE_WORDS = re.compile(r" ?[A-Za-z]++[^\W\d_]*+| ?[^\W\d_]++|'s|'t|'re|'ve|'m|'ll|'d| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: The words of the tokenizer with word ends, after NFC and lower case.
END_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
#: Bytes of the words that a memo holds at most, and what an entry takes besides its word.
MEMO_BYTES = 40_000_000
ENTRY_BYTES = 160


_SPECIAL_TOKEN = re.compile(_SPECIAL)
#: Characters that were seen and are not odd.
_PLAIN: set[str] = set()


def _odd(char: str) -> bool:
    """Numbers that are no digits, unassigned characters, four separators and the capital sigma."""
    return char == "\u03a3" or "\x1c" <= char <= "\x1f" or char >= "\x80" and unicodedata.category(char) in ("No", "Nl", "Cn", "Cs")


def is_plain(text: str) -> bool:
    """Whether a text has no odd character and no special token; its distinct characters are looked at, not each of them."""
    new = set(text) - _PLAIN
    if new:
        if any(map(_odd, new)):
            return False
        _PLAIN.update(new)
    return "<|" not in text or not _SPECIAL_TOKEN.search(text)


def byte_words(text: str) -> list[str]:
    return BYTE_WORDS.findall(text)


def end_words(text: str) -> list[str]:
    return END_WORDS.findall((text if text.isascii() else unicodedata.normalize("NFC", text)).lower())


class Memo(dict):
    """Word to value; a missing word is computed. A full memo (by bytes) becomes the old one, from which words in use come back."""

    def __init__(self, make, most: int = MEMO_BYTES):
        self.make, self.most, self.size, self.old = make, most, 0, {}

    def __missing__(self, word):
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
        if self.size >= self.most:
            self.old, self.size = dict(self), 0
            self.clear()
        self.size += len(word) + ENTRY_BYTES
        self[word] = value
        return value


_HELD: dict = {}


def held(name: tuple, make):
    """What this worker holds for one operator from task to task; dropped when another operator asks for its own."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = make()
    return _HELD[name]


@lru_cache(1)
def byte_symbols() -> list[str]:
    """The visible character that stands for each byte in byte-level vocabularies: printable ones stand for themselves."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def word_ids(path: str):
    """The function that gives the ids of one plain word, by the library's model."""
    model, shown = tokenizer(path).model, byte_symbols()

    def ids(word):
        if word.isascii() and word.isprintable():  # of these characters only the space is shown as another one
            symbols = word.replace(" ", shown[32])
        else:
            symbols = "".join([shown[b] for b in word.encode()])
        return [t.id for t in model.tokenize(symbols)]

    return ids


@lru_cache(4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def word_split(path: str):
    """The function that splits plain texts as this tokenizer does."""
    return end_words if tokenizer(path).model.end_of_word_suffix else byte_words
