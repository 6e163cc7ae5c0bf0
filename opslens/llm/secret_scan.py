"""Secret scans: fixed patterns, and a token-efficiency test for random strings.

The patterns find assignments, access keys and long hex strings. The test takes runs of key characters that hold letters,
leaves out known digests (hex of a digest's length) and identifiers (UUIDs, words of one case and numbers joined by dashes
or underscores), and reports a run if a tiktoken vocabulary needs many tokens for it: text that resembles what the
vocabulary was made of has several characters per token, a random string has hardly more than one and a half. As words
beside a random string hide it in the mean, a run that is not reported whole is tested again in stretches between equals
signs, then between slashes, dashes and underscores, and plus signs as well.

Defined results: null text counts as empty and has no spans; spans are in code points with the end exclusive, ordered by
start and then kind; of one kind they don't overlap, kinds may; whole texts are scanned, at any length, in time that grows
with it; repeated rows and rows without a doc_id are scanned each for itself and keep their id; extra columns are ignored
(redact_documents() passes them through); an empty table gives an empty result."""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from . import vocab
from .common import strings

#: The kinds in their order, with pattern, group that is measured and least length of it.
PATTERNS = (
    ("assign", re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
)
KINDS = ("assign", "access", "hex", "random")
#: Runs that the test looks at, and most characters per token of a random string.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: What is tested of a run besides the whole, from long stretches to short ones.
STRETCHES = tuple(re.compile(f"[^{joints}]{{16,}}") for joints in ("=", "=/", "=/_-", "=/_+-"))
MOST_CHARS_PER_TOKEN = 1.9
DIGEST_CHARS = (32, 40, 48, 56, 64, 96, 128)
_DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_UUID = re.compile(r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}")
_NAME = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)(?:[-_/=+](?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+))*")
_WORDS = re.compile(r"[-_/=+]*(?:(?:[A-Z]?[a-z]+|[A-Z]+)(?:[-_/=+]+|$))*")
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_random", pa.int64())])


@lru_cache(2)
def ranks_encoding(path: str, pattern: str):
    """The tiktoken encoding of a file of ranks."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def is_known(run: str, assigned: bool = False) -> bool:
    """Whether a run is a digest (unless it is assigned to a secret's name) or an identifier: UUID, words of one case and numbers joined, no letters."""
    if len(run) in DIGEST_CHARS and _DIGEST.fullmatch(run):
        return not assigned
    if not re.search("[A-Za-z]", run):
        return True
    return bool(_UUID.fullmatch(run) or _NAME.fullmatch(run) or _WORDS.fullmatch(run))


def is_random(run: str, path: str, pattern: str, most: float, assigned: bool = False) -> bool:
    """Whether a run that is no known digest or identifier has few characters per token. assigned: it is the value of a
    secret's name, so that hex of a digest's length is not taken for a digest."""
    return not is_known(run, assigned) and len(run) < most * len(ranks_encoding(path, pattern).encode_ordinary(run))


def random_stretches(run: str, path: str, pattern: str, most: float, assigned: bool = False) -> tuple[tuple[int, int], ...]:
    """(start, end) of what is random in a run: all of it, or the longest stretches that are."""
    if is_random(run, path, pattern, most, assigned):
        return ((0, len(run)),)
    found: list[tuple[int, int]] = []  # sorted, none meets another
    for stretch in STRETCHES:
        fresh = [m.span() for m in stretch.finditer(run) if len(m[0]) < len(run) and not meets(found, *m.span()) and is_random(m[0], path, pattern, most, assigned)]
        found = sorted(found + fresh)
    return tuple(found)


def meets(spans: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether one of sorted spans that don't meet each other meets [start, end): the last one that begins before the end does, or none."""
    at = bisect_left(spans, (end,)) - 1
    return at >= 0 and spans[at][1] > start


def find_spans(text: str, path: str, pattern: str, most: float = MOST_CHARS_PER_TOKEN) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of every span, in order."""
    found = []
    for kind, (_, regex, group, least) in enumerate(PATTERNS):
        if kind == 1 and "AKIA" not in text:
            continue
        if kind == 2:
            found += [(m.start(), kind, m.end()) for m in _LONG_HEX.finditer(text)]
            continue
        found += [(m.start(), kind, m.end()) for m in regex.finditer(text) if m.end(group) - m.start(group) >= least]
    assigned = [(start, end) for start, kind, end in found if kind == 0]
    memo = vocab.held(("secrets", path, pattern, most), lambda: vocab.Memo(lambda x: random_stretches(x[1:], path, pattern, most, x[0] == "=")))
    for m in RUN.finditer(text):
        found += [(m.start() + start, 3, m.start() + end) for start, end in memo[("=" if meets(assigned, *m.span()) else " ") + m[0]]]
    return sorted(found)


#: The hex pattern's matches are maximal runs, so asking for their length at once finds the same ones.
_LONG_HEX = re.compile(r"[0-9a-f]{16,}")


def joined(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan_documents(docs: DataFrame, ranks_path: str, pattern: str, most: float = MOST_CHARS_PER_TOKEN) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), strings(batch)):
                spans = find_spans(text, ranks_path, pattern, most)
                n = [sum(s[1] == k for s in spans) for k in range(4)]
                rows.append((doc_id, *n[:3], hashlib.sha256(joined(s for s in spans if s[1] < 3).encode()).hexdigest(), joined(spans), n[3]))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * len(_ARROW), _ARROW.types)], schema=_ARROW)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def redact(text: str, spans, mark: str = "<secret>") -> str:
    """The text with every stretch that spans cover replaced by a mark."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact_documents(docs: DataFrame, ranks_path: str, pattern: str, most: float = MOST_CHARS_PER_TOKEN) -> DataFrame:
    """The documents with all columns, their texts redacted."""
    schema = docs.schema

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [None if t is None else redact(t, find_spans(t, ranks_path, pattern, most)) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, schema)
